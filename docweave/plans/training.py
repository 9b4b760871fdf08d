"""Queries on nested records (problem 1) and on hierarchies (problem 5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.operators import hierarchy, nested
from docweave.sources.tables import table


def _packages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "packages", "document_id", "units")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return nested.child_keys(_packages(spark, d)).distinct()


def p1_units(spark: SparkSession, d: str) -> DataFrame:
    return nested.units_table(_packages(spark, d))


def p1_source_refs(spark: SparkSession, d: str) -> DataFrame:
    return nested.child_table(_packages(spark, d), "source_ref")


def p1_formulas(spark: SparkSession, d: str) -> DataFrame:
    """Provenance, variables and warnings are tables of their own."""
    return nested.child_table(_packages(spark, d), "formula").select("document_id", "unit_id", "source_format", "linear_text", "display_latex", "calc_expr", "confidence", F.size("warnings").alias("n_warnings"))


def p1_cells(spark: SparkSession, d: str) -> DataFrame:
    return nested.child_table(_packages(spark, d), "cell")


def p1_variables(spark: SparkSession, d: str) -> DataFrame:
    return nested.variables_table(_packages(spark, d))


def p1_provenance(spark: SparkSession, d: str) -> DataFrame:
    return nested.provenance_table(_packages(spark, d))


def p1_warnings(spark: SparkSession, d: str) -> DataFrame:
    return nested.warnings_table(_packages(spark, d))


def p1_quality(spark: SparkSession, d: str) -> DataFrame:
    return nested.quality_table(_packages(spark, d))


def p1_assets(spark: SparkSession, d: str) -> DataFrame:
    return nested.assets_table(table(spark, d, "packages", "document_id", "assets"))


def p1_document_warnings(spark: SparkSession, d: str) -> DataFrame:
    return nested.document_warnings(table(spark, d, "packages", "document_id", "run_id", "processing"))


def p1_documents(spark: SparkSession, d: str) -> DataFrame:
    return nested.documents_table(table(spark, d, "packages"))


def _tree(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.nodes(table(spark, d, "document_units", "document_id", "unit_id", "parent_id", "loaded_at"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    found = hierarchy.faults(_tree(spark, d))
    return found.select(F.col("scope").alias("document_id"), F.col("node").alias("unit_id"), "fault")


def p5_paths(spark: SparkSession, d: str) -> DataFrame:
    out = hierarchy.resolve(_tree(spark, d))
    return out.select(F.col("scope").alias("document_id"), F.col("node").alias("unit_id"), F.col("root").alias("root_id"), "depth", F.array_join("path", "/").alias("path"))


def p5_descendants(spark: SparkSession, d: str) -> DataFrame:
    pairs = hierarchy.descendants(hierarchy.resolve(_tree(spark, d)))
    return pairs.select(F.col("scope").alias("document_id"), F.col("ancestor").alias("unit_id"), F.col("descendant").alias("descendant_id"), "distance")


QUERIES = {f.__name__: f for f in (p1_found, p1_units, p1_source_refs, p1_formulas, p1_cells, p1_variables, p1_provenance, p1_warnings, p1_quality, p1_assets, p1_document_warnings, p1_documents, p5_found, p5_paths, p5_descendants)}

_U = "(SELECT document_id, u FROM (SELECT document_id, unnest(units) AS u FROM packages) WHERE u IS NOT NULL)"
_SREF = "(u.source_ref.document_id IS NOT NULL OR u.source_ref.page IS NOT NULL OR len(u.source_ref.bbox) > 0 OR u.source_ref.docx_path IS NOT NULL OR u.source_ref.coordinate_system IS NOT NULL OR u.source_ref.page_width IS NOT NULL OR u.source_ref.page_height IS NOT NULL)"
_FORMULA = "(u.formula.source_format IS NOT NULL OR u.formula.linear_text IS NOT NULL OR u.formula.display_latex IS NOT NULL OR u.formula.calc_expr IS NOT NULL OR cardinality(u.formula.variables) > 0 OR u.formula.provenance.parser_path IS NOT NULL OR u.formula.provenance.normalization IS NOT NULL OR u.formula.provenance.confidence_basis IS NOT NULL OR u.formula.confidence IS NOT NULL OR len(u.formula.warnings) > 0)"
_PROVENANCE = "(u.formula.provenance.parser_path IS NOT NULL OR u.formula.provenance.normalization IS NOT NULL OR u.formula.provenance.confidence_basis IS NOT NULL)"
_CELL_FIELDS = ("worksheet", "address", "row_no", "col_no", "value", "value_type", "formula", "data_type", "number_format", "hyperlink")
_CELL = "(" + " OR ".join(f"u.cell.{f} IS NOT NULL" for f in _CELL_FIELDS) + ")"

_TREE = """RECURSIVE n AS (SELECT document_id, unit_id, max_by(parent_id, loaded_at) AS parent_id FROM document_units GROUP BY 1, 2),
l AS (SELECT n.*, n.parent_id IS NOT NULL AND p.unit_id IS NULL AS orphan FROM n LEFT JOIN n p ON p.document_id = n.document_id AND p.unit_id = n.parent_id),
w AS (SELECT document_id, unit_id, unit_id AS root_id, 0 AS depth, unit_id AS path FROM l WHERE parent_id IS NULL OR orphan
UNION ALL SELECT l.document_id, l.unit_id, w.root_id, w.depth + 1, w.path || '/' || l.unit_id FROM w JOIN l ON l.document_id = w.document_id AND l.parent_id = w.unit_id)"""

SQL = {
    "p1_found": f"""SELECT DISTINCT document_id, u.unit_id AS unit_id, 'source_ref' AS child_table, '' AS child_key FROM {_U} WHERE {_SREF}
UNION ALL SELECT DISTINCT document_id, u.unit_id, 'formula', '' FROM {_U} WHERE {_FORMULA}
UNION ALL SELECT DISTINCT document_id, u.unit_id, 'cell', '' FROM {_U} WHERE {_CELL}
UNION ALL SELECT DISTINCT document_id, unit_id, 'variable', k FROM (SELECT document_id, u.unit_id AS unit_id, unnest(map_keys(u.formula.variables)) AS k FROM {_U})""",
    "p1_units": f"SELECT document_id, u.unit_id AS unit_id, u.parent_id AS parent_id, u.type AS type, u.unit_order AS unit_order, u.text AS text, u.asset_ref AS asset_ref FROM {_U}",
    "p1_source_refs": f"SELECT document_id, u.unit_id AS unit_id, u.source_ref.document_id AS source_ref_document_id, u.source_ref.page AS page, u.source_ref.bbox AS bbox, u.source_ref.docx_path AS docx_path, u.source_ref.coordinate_system AS coordinate_system, u.source_ref.page_width AS page_width, u.source_ref.page_height AS page_height FROM {_U} WHERE {_SREF}",
    "p1_formulas": f"SELECT document_id, u.unit_id AS unit_id, u.formula.source_format AS source_format, u.formula.linear_text AS linear_text, u.formula.display_latex AS display_latex, u.formula.calc_expr AS calc_expr, u.formula.confidence AS confidence, CASE WHEN u.formula.warnings IS NULL THEN NULL ELSE CAST(len(u.formula.warnings) AS INTEGER) END AS n_warnings FROM {_U} WHERE {_FORMULA}",
    "p1_cells": f"SELECT document_id, u.unit_id AS unit_id, {', '.join(f'u.cell.{f} AS {f}' for f in _CELL_FIELDS)} FROM {_U} WHERE {_CELL}",
    "p1_variables": f"SELECT document_id, unit_id, e.key AS variable, e.value AS value FROM (SELECT document_id, u.unit_id AS unit_id, unnest(map_entries(u.formula.variables)) AS e FROM {_U})",
    "p1_provenance": f"SELECT document_id, u.unit_id AS unit_id, u.formula.provenance.parser_path AS parser_path, u.formula.provenance.normalization AS normalization, u.formula.provenance.confidence_basis AS confidence_basis FROM {_U} WHERE {_PROVENANCE}",
    "p1_warnings": f"SELECT document_id, unit_id, (i - 1)::INT AS position, w[i] AS warning FROM (SELECT document_id, u.unit_id AS unit_id, u.formula.warnings AS w, unnest(range(1, len(u.formula.warnings) + 1)) AS i FROM {_U})",
    "p1_quality": f"SELECT document_id, unit_id, kind, (i - 1)::INT AS position, w[i] AS value FROM (SELECT document_id, u.unit_id AS unit_id, 'flag' AS kind, u.quality.flags AS w, unnest(range(1, len(u.quality.flags) + 1)) AS i FROM {_U} UNION ALL SELECT document_id, u.unit_id, 'warning', u.quality.warnings, unnest(range(1, len(u.quality.warnings) + 1)) FROM {_U})",
    "p1_assets": "SELECT document_id, a.asset_id AS asset_id, a.type AS type, a.path AS path, a.unit_id AS unit_id, a.sha256 AS sha256, a.filename AS filename, a.size_bytes AS size_bytes, a.media_type AS media_type FROM (SELECT document_id, unnest(assets) AS a FROM packages) WHERE a IS NOT NULL",
    "p1_document_warnings": "SELECT document_id, run_id, (i - 1)::INT AS position, processing.warnings[i] AS warning FROM (SELECT document_id, run_id, processing, unnest(range(1, len(processing.warnings) + 1)) AS i FROM packages)",
    "p1_documents": "SELECT schema_version, document_id, source.original_path AS original_path, source.relative_input_path AS relative_input_path, source.filename AS filename, source.format AS format, source.sha256 AS sha256, source.size_bytes AS size_bytes, processing.route AS route, processing.status AS status, processing.ocr_applied AS ocr_applied, metadata.title AS title, metadata.document_type AS document_type, CAST(coalesce(len(units), 0) AS INTEGER) AS n_units, CAST(coalesce(len(assets), 0) AS INTEGER) AS n_assets, run_id, received_at FROM packages",
    "p5_paths": f"WITH {_TREE} SELECT l.document_id, l.unit_id, w.root_id, w.depth, w.path FROM l LEFT JOIN w ON w.document_id = l.document_id AND w.unit_id = l.unit_id",
    "p5_found": f"""WITH {_TREE}, stuck AS (SELECT l.document_id, l.unit_id, l.parent_id FROM l WHERE NOT EXISTS (SELECT 1 FROM w WHERE w.document_id = l.document_id AND w.unit_id = l.unit_id)),
up AS (SELECT document_id, unit_id AS start_id, parent_id AS at FROM stuck UNION SELECT up.document_id, up.start_id, s.parent_id FROM up JOIN stuck s ON s.document_id = up.document_id AND s.unit_id = up.at)
SELECT document_id, unit_id, 'orphan' AS fault FROM l WHERE orphan
UNION ALL SELECT s.document_id, s.unit_id, CASE WHEN EXISTS (SELECT 1 FROM up WHERE up.document_id = s.document_id AND up.start_id = s.unit_id AND up.at = s.unit_id) THEN 'cycle' ELSE 'below_cycle' END FROM stuck s""",
    "p5_descendants": """WITH RECURSIVE n AS (SELECT document_id, unit_id, max_by(parent_id, loaded_at) AS parent_id FROM document_units GROUP BY 1, 2),
l AS (SELECT n.*, n.parent_id IS NOT NULL AND p.unit_id IS NULL AS orphan FROM n LEFT JOIN n p ON p.document_id = n.document_id AND p.unit_id = n.parent_id),
w AS (SELECT document_id, unit_id, [unit_id] AS path FROM l WHERE parent_id IS NULL OR orphan
UNION ALL SELECT l.document_id, l.unit_id, list_append(w.path, l.unit_id) FROM w JOIN l ON l.document_id = w.document_id AND l.parent_id = w.unit_id)
SELECT document_id, path[i] AS unit_id, unit_id AS descendant_id, CAST(len(path) - i AS INTEGER) AS distance FROM (SELECT *, unnest(range(1, len(path))) AS i FROM w)""",
}
