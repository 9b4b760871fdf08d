"""Structural units: projections, order, sections, chunks, tables, rendering, checks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docweave.functions import text as tx
from docweave.operators import ordered
from docweave.plans.register import Registry
from docweave.sources.tables import table

_R = Registry()
QUERIES, SQL, query = _R.queries, _R.sql, _R.add
_ORDER = ["unit_order", "unit_id"]
#: Distinct deliveries of each unit, as SQL.
_U = "(SELECT DISTINCT document_id, unit_id, parent_id, type, coalesce(unit_order, 0) AS unit_order, text, asset_ref, source_ref.page AS page FROM document_units)"


def _units(spark: SparkSession, d: str, *columns: str | Column) -> DataFrame:
    """Distinct deliveries; only the named columns are read."""
    picked = columns or ("document_id", "unit_id", "parent_id", "type", "unit_order", "text", "asset_ref", "source_ref.page")
    return table(spark, d, "document_units", *[F.coalesce("unit_order", F.lit(0)).alias("unit_order") if isinstance(c, str) and c == "unit_order" else c for c in picked]).distinct()


#: Selecting the nested field names the column page.
_PAGE = "source_ref.page"


@query(f"SELECT document_id, unit_id, printf('u_%06d', (row_number() OVER (PARTITION BY document_id ORDER BY unit_order, unit_id) - 1)::INT) AS new_id FROM (SELECT DISTINCT document_id, unit_id, unit_order FROM {_U})")
def unit_ids(spark, d):
    u = ordered.running_sum(_units(spark, d, "document_id", "unit_id", "unit_order"), "document_id", _ORDER, F.lit(1), "n")
    return u.select("document_id", "unit_id", F.format_string("u_%06d", F.col("n") - 1).alias("new_id"))


@query("SELECT DISTINCT document_id, regexp_full_match(document_id, 'sha256:[0-9a-f]{64}') AS valid, substr(document_id, 8) AS sha256 FROM document_units")
def document_ids(spark, d):
    return table(spark, d, "document_units", "document_id").distinct().select("document_id", F.col("document_id").rlike("^sha256:[0-9a-f]{64}$").alias("valid"), F.expr("substring(document_id, 8)").alias("sha256"))


@query("SELECT document_id, unit_id, type, source_ref.page AS page, source_ref.docx_path AS docx_path, len(source_ref.bbox) = 4 AS has_box, formula.confidence AS confidence, cell.address AS address, coalesce(len(quality.flags), 0)::INT AS n_flags FROM document_units")
def unit_projection(spark, d):
    return table(spark, d, "document_units").select("document_id", "unit_id", "type", "source_ref.page", "source_ref.docx_path", F.when(F.col("source_ref.bbox").isNotNull(), F.size("source_ref.bbox") == 4).alias("has_box"), F.col("formula.confidence").alias("confidence"), "cell.address", F.when(F.col("quality.flags").isNull(), 0).otherwise(F.size("quality.flags")).alias("n_flags"))


@query("SELECT document_id, type, count(*) AS n FROM (SELECT DISTINCT document_id, unit_id, type FROM document_units) GROUP BY 1, 2")
def unit_type_counts(spark, d):
    return _units(spark, d, "document_id", "unit_id", "type").groupBy("document_id", "type").agg(F.count("*").alias("n"))


@query(f"SELECT p.document_id, p.unit_id, count(c.unit_id) AS children, sum(CASE WHEN c.type = 'table_cell' THEN 1 ELSE 0 END)::BIGINT AS cells FROM (SELECT DISTINCT document_id, unit_id FROM {_U}) p JOIN (SELECT DISTINCT document_id, unit_id, parent_id, type FROM {_U}) c ON c.document_id = p.document_id AND c.parent_id = p.unit_id GROUP BY 1, 2")
def unit_children(spark, d):
    u = _units(spark, d, "document_id", "unit_id", "parent_id", "type")
    counts = u.where("parent_id is not null").groupBy("document_id", F.col("parent_id").alias("unit_id")).agg(F.count("*").alias("children"), F.sum((F.col("type") == "table_cell").cast("long")).alias("cells"))
    return counts.join(u.select("document_id", "unit_id").distinct(), ["document_id", "unit_id"], "left_semi").select("document_id", "unit_id", "children", F.coalesce("cells", F.lit(0)).alias("cells"))


@query(f"SELECT document_id, unit_id, (row_number() OVER (PARTITION BY document_id ORDER BY unit_order, unit_id) - 1)::BIGINT AS reading_order FROM (SELECT DISTINCT document_id, unit_id, unit_order FROM {_U})")
def reading_order(spark, d):
    u = ordered.running_sum(_units(spark, d, "document_id", "unit_id", "unit_order"), "document_id", _ORDER, F.lit(1), "n")
    return u.select("document_id", "unit_id", (F.col("n") - 1).alias("reading_order"))


@query(f"SELECT document_id, unit_id, CASE WHEN type LIKE 'table%' THEN 'table' ELSE 'paragraph' END AS kind, row_number() OVER (PARTITION BY document_id, type LIKE 'table%' ORDER BY unit_order, unit_id)::INT AS ordinal FROM (SELECT DISTINCT document_id, unit_id, type, unit_order FROM {_U}) WHERE type IN ('paragraph', 'table', 'table_row', 'table_cell')")
def block_ordinals(spark, d):
    """Numbered through the whole document, also where units have no page."""
    u = _units(spark, d, "document_id", "unit_id", "type", "unit_order").where("type in ('paragraph', 'table', 'table_row', 'table_cell')").withColumn("kind", F.when(F.col("type").startswith("table"), "table").otherwise("paragraph"))
    n = ordered.running_sum(u.withColumn("of", F.struct("document_id", "kind")), "of", _ORDER, F.lit(1), "n")
    return n.select("document_id", "unit_id", "kind", F.col("n").cast("int").alias("ordinal"))


@query(f"SELECT document_id, unit_id, last_value(CASE WHEN type = 'section' AND trim(text) <> '' THEN trim(text) END IGNORE NULLS) OVER (PARTITION BY document_id ORDER BY unit_order, unit_id ROWS UNBOUNDED PRECEDING) AS section FROM {_U}")
def section_path(spark, d):
    u = _units(spark, d, "document_id", "unit_id", "type", "unit_order", "text")
    heading = F.when((F.col("type") == "section") & (F.trim("text") != ""), F.trim("text"))
    return ordered.last_value(u.withColumn("h", heading).drop("text", "type"), "document_id", _ORDER, F.col("h"), "section").select("document_id", "unit_id", "section")


@query(f"SELECT document_id, unit_id FROM (SELECT document_id, unit_id, text, lag(text) OVER (PARTITION BY document_id ORDER BY unit_order, unit_id) AS before FROM {_U} WHERE text IS NOT NULL) WHERE text IS DISTINCT FROM before")
def adjacent_dedup(spark, d):
    u = _units(spark, d, "document_id", "unit_id", "unit_order", "text").where("text is not null")
    return ordered.previous(u, "document_id", _ORDER, F.xxhash64("text"), "before").where("not (before <=> xxhash64(text))").select("document_id", "unit_id")


@query(f"SELECT document_id, count(*) AS drifted FROM (SELECT document_id, unit_order, lag(unit_order) OVER (PARTITION BY document_id ORDER BY unit_id) AS before FROM (SELECT DISTINCT document_id, unit_id, unit_order FROM {_U})) WHERE before >= unit_order GROUP BY 1")
def order_drift(spark, d):
    u = _units(spark, d, "document_id", "unit_id", "unit_order").withColumn("place", F.coalesce(F.regexp_extract("unit_id", r"(\d+)$", 1).try_cast("long"), F.lit(0)))
    return ordered.previous(u, "document_id", ["place", "unit_id"], F.col("unit_order"), "before").where("before >= unit_order").groupBy("document_id").agg(F.count("*").alias("drifted"))


@query(f"SELECT document_id, page, CASE WHEN page IS NULL THEN unit_order // 4096 ELSE 0 END AS stretch, string_agg(text, chr(10) || chr(10) ORDER BY unit_order, unit_id) AS search_text FROM (SELECT DISTINCT document_id, unit_id, type, unit_order, text, page FROM {_U}) WHERE type NOT IN ('header', 'footer') AND text <> '' GROUP BY 1, 2, 3")
def search_text(spark, d):
    """Per page, and per stretch of the order where units have no page: a document of any size is never put together in one row."""
    u = _units(spark, d, "document_id", "unit_id", "type", "unit_order", "text", _PAGE).where("type not in ('header', 'footer') and text <> ''")
    stretch = F.when(F.col("page").isNull(), F.floor(F.col("unit_order") / ordered.STRETCH)).otherwise(0)
    return u.groupBy("document_id", "page", stretch.alias("stretch")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(*_ORDER, "text"))), lambda x: x.text), "\n\n").alias("search_text"))


@query(f"""WITH e AS (SELECT document_id, page, min((unit_order, unit_id, text)) AS first, max((unit_order, unit_id, text)) AS last FROM {_U} WHERE text <> '' AND page IS NOT NULL GROUP BY 1, 2),
s AS (SELECT document_id, first[3] AS text, 'header' AS edge FROM e UNION ALL SELECT document_id, last[3], 'footer' FROM e)
SELECT document_id, edge, text, count(*) AS pages FROM s GROUP BY 1, 2, 3 HAVING count(*) >= 2""")
def repeated_edges(spark, d):
    u = _units(spark, d, "document_id", "unit_id", "unit_order", "text", _PAGE).where("text <> '' and page is not null")
    key = F.struct(*_ORDER, "text")
    e = u.groupBy("document_id", "page").agg(F.min(key).alias("first"), F.max(key).alias("last"))
    edges = e.select("document_id", F.explode(F.array(F.struct(F.lit("header").alias("edge"), F.col("first.text").alias("text")), F.struct(F.lit("footer").alias("edge"), F.col("last.text").alias("text")))).alias("x"))
    return edges.select("document_id", "x.edge", "x.text").groupBy("document_id", "edge", "text").agg(F.count("*").alias("pages")).where("pages >= 2")


@query(f"SELECT document_id, type, text, arg_min(unit_id, (unit_order, unit_id)) AS unit_id, count(*) AS stories FROM {_U} WHERE type IN ('header', 'footer') AND text IS NOT NULL GROUP BY 1, 2, 3")
def header_footer_dedup(spark, d):
    u = _units(spark, d, "document_id", "unit_id", "type", "unit_order", "text").where("type in ('header', 'footer') and text is not null")
    return u.groupBy("document_id", "type", "text").agg(F.min(F.struct(*_ORDER)).alias("w"), F.count("*").alias("stories")).select("document_id", "type", "text", "w.unit_id", "stories")


_STRIP = "regexp_replace({}, '^[\\s\\x0B\\x{{85}}\\p{{Z}}]+|[\\s\\x0B\\x{{85}}\\p{{Z}}]+$', '', 'g')"
#: Types of units that chunks are made of, and the most characters of a chunk.
CHUNKED, CHUNK_CHARS = ("section", "paragraph", "list_item", "caption", "header", "footer", "table_cell", "formula", "figure"), 1200


def _stripped(text: str) -> Column:
    return F.regexp_replace(text, r"(?U)^[\s\p{Z}]+|[\s\p{Z}]+$", "")


@query(f"""WITH RECURSIVE u AS (SELECT document_id, unit_id, type, unit_order, page, asset_ref, {_STRIP.format('text')} AS text FROM (SELECT DISTINCT document_id, unit_id, type, unit_order, text, page, asset_ref FROM {_U}) WHERE document_id IS NOT NULL),
s AS (SELECT *, sum(CASE WHEN type = 'section' AND text <> '' THEN 1 ELSE 0 END) OVER (PARTITION BY document_id ORDER BY unit_order, unit_id ROWS UNBOUNDED PRECEDING) AS section_no FROM u),
b AS (SELECT *, length(text) AS n, row_number() OVER (PARTITION BY document_id, section_no ORDER BY unit_order, unit_id) AS i FROM s WHERE text <> '' AND type IN {CHUNKED}),
w AS (SELECT document_id, section_no, i, n AS size, 1 AS chunk FROM b WHERE i = 1
UNION ALL SELECT b.document_id, b.section_no, b.i, CASE WHEN w.size + 2 + b.n > {CHUNK_CHARS} THEN b.n ELSE w.size + 2 + b.n END, CASE WHEN w.size + 2 + b.n > {CHUNK_CHARS} THEN w.chunk + 1 ELSE w.chunk END FROM w JOIN b ON b.document_id = w.document_id AND b.section_no = w.section_no AND b.i = w.i + 1),
c AS (SELECT document_id, section_no, chunk, coalesce(max(text) FILTER (type = 'section'), '') AS section_path, string_agg(unit_id, ' ' ORDER BY i) AS unit_refs, string_agg(text, chr(10) || chr(10) ORDER BY i) AS text, list_sort(list(DISTINCT page) FILTER (page IS NOT NULL)) AS pages, list_sort(list(DISTINCT asset_ref) FILTER (asset_ref <> '')) AS asset_refs FROM w JOIN b USING (document_id, section_no, i) GROUP BY 1, 2, 3),
p AS (SELECT document_id, section_no, first_value(text) OVER (PARTITION BY document_id, section_no ORDER BY unit_order, unit_id) AS path FROM s WHERE section_no > 0 AND type = 'section' AND text <> '')
SELECT document_id, printf('c_%06d', row_number() OVER (PARTITION BY document_id ORDER BY section_no, chunk)) AS chunk_id, unit_refs, coalesce((SELECT min(path) FROM p WHERE p.document_id = c.document_id AND p.section_no = c.section_no), '') AS section_path, text, coalesce(array_to_string(pages, ' '), '') AS pages, coalesce(array_to_string(asset_refs, ' '), '') AS asset_refs FROM c""")
def chunks(spark, d):
    return chunked(_units(spark, d, "document_id", "unit_id", "type", "unit_order", "text", _PAGE, "asset_ref"))


def chunked(u: DataFrame) -> DataFrame:
    """Greedy packing up to CHUNK_CHARS characters of stripped text, parted by blank lines; a section starts anew and a
    longer unit stays whole. unit_refs, pages and asset_refs are parted by spaces.

    Sections are packed independently. Their units stream through in order, and what is held is the chunk being packed.
    """
    u = u.where("document_id is not null").withColumn("text", _stripped("text"))
    starts = F.coalesce(((F.col("type") == "section") & (F.col("text") != "")).cast("int"), F.lit(0))
    s = ordered.running_sum(u, "document_id", _ORDER, starts, "section_no").where(F.col("type").isin(*CHUNKED) & (F.col("text") != ""))
    s = s.repartition("document_id", "section_no").sortWithinPartitions("document_id", "section_no", *_ORDER)
    columns = ["document_id", "section_no", "first_order", "first_unit", "unit_refs", "section_path", "text", "pages", "asset_refs"]

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, path, size, held, out = None, "", 0, [], []

        def flush() -> None:
            if held:
                pages, assets = sorted({int(x[4]) for x in held if x[4] is not None and x[4] == x[4]}), sorted({x[5] for x in held if x[5]})
                out.append((*key, held[0][0], held[0][1], " ".join(str(x[1]) for x in held), path, "\n\n".join(x[2] for x in held), " ".join(map(str, pages)), " ".join(assets)))
                held.clear()

        for batch in batches:
            for doc, no, order, unit, kind, text, page, asset in zip(*[batch[c] for c in ("document_id", "section_no", "unit_order", "unit_id", "type", "text", "page", "asset_ref")], strict=True):
                if (doc, no) != key:
                    flush()
                    key, path = (doc, no), text if kind == "section" else ""
                elif size + 2 + len(text) > CHUNK_CHARS:
                    flush()
                size = size + 2 + len(text) if held else len(text)
                held.append((order, unit, text, kind, page, asset))
            yield pd.DataFrame(out, columns=columns)
            out.clear()
        flush()
        yield pd.DataFrame(out, columns=columns)

    made = s.select("document_id", "section_no", "unit_order", "unit_id", "type", "text", "page", "asset_ref").mapInPandas(pack, "document_id string, section_no long, first_order int, first_unit string, unit_refs string, section_path string, text string, pages string, asset_refs string")
    numbered = ordered.running_sum(made, "document_id", ["first_order", "first_unit"], F.lit(1), "n")
    return numbered.select("document_id", F.format_string("c_%06d", "n").alias("chunk_id"), "unit_refs", "section_path", "text", "pages", "asset_refs")


@query(f"""WITH r AS (SELECT t.document_id, t.unit_id, c.unit_id AS row_id FROM {_U} t JOIN {_U} c ON c.document_id = t.document_id AND c.parent_id = t.unit_id AND c.type = 'table_row' WHERE t.type = 'table'),
n AS (SELECT r.document_id, r.unit_id, r.row_id, count(x.unit_id) AS cells FROM r LEFT JOIN {_U} x ON x.document_id = r.document_id AND x.parent_id = r.row_id AND x.type = 'table_cell' GROUP BY 1, 2, 3)
SELECT document_id, unit_id, count(*) AS row_count, sum(cells)::BIGINT AS cell_count, count(*) FILTER (cells >= 2) AS wide_rows, count(*) FILTER (cells = 1) AS single_cell_rows, max(cells) AS widest, round_even(count(*) FILTER (cells >= 2) / count(*), 4) AS wide_row_ratio FROM n GROUP BY 1, 2""")
def table_metrics(spark, d):
    u = _units(spark, d, "document_id", "unit_id", "parent_id", "type")
    cells = u.where("type = 'table_cell'").groupBy("document_id", F.col("parent_id").alias("row_id")).agg(F.count("*").alias("cells"))
    rows = u.where("type = 'table_row'").select("document_id", F.col("unit_id").alias("row_id"), F.col("parent_id").alias("unit_id")).join(u.where("type = 'table'").select("document_id", "unit_id"), ["document_id", "unit_id"], "left_semi")
    n = rows.join(cells, ["document_id", "row_id"], "left").withColumn("cells", F.coalesce("cells", F.lit(0)))
    wide = F.count(F.when(F.col("cells") >= 2, 1))
    return n.groupBy("document_id", "unit_id").agg(F.count("*").alias("row_count"), F.sum("cells").alias("cell_count"), wide.alias("wide_rows"), F.count(F.when(F.col("cells") == 1, 1)).alias("single_cell_rows"), F.max("cells").alias("widest"), F.bround(wide / F.count("*"), 4).alias("wide_row_ratio"))


@query(f"""WITH l AS (SELECT document_id, unit_id, unnest(string_split(text, chr(10))) AS line FROM {_U} WHERE type = 'table' AND text IS NOT NULL),
c AS (SELECT document_id, unit_id, len(list_filter(list_transform(regexp_split_to_array(line, ' {{2,}}|\\t+|\\|'), lambda x: trim(x)), lambda x: x <> '')) AS width FROM l)
SELECT document_id, unit_id, arg_max(width, (n, width))::INT AS dominant_width, sum(n)::BIGINT AS lines, count(*) > 1 AS ragged FROM (SELECT document_id, unit_id, width, count(*) AS n FROM c WHERE width >= 2 GROUP BY 1, 2, 3) GROUP BY 1, 2""")
def dominant_width(spark, d):
    u = _units(spark, d, "document_id", "unit_id", "type", "text").where("type = 'table' and text is not null")
    c = u.select("document_id", "unit_id", F.explode(F.split("text", "\n")).alias("line")).select("document_id", "unit_id", F.size(tx.cells(F.col("line"))).alias("width")).where("width >= 2")
    g = c.groupBy("document_id", "unit_id", "width").agg(F.count("*").alias("n"))
    return g.groupBy("document_id", "unit_id").agg(F.max(F.struct("n", "width")).alias("w"), F.sum("n").alias("lines"), F.count("*").alias("k")).select("document_id", "unit_id", F.col("w.width").alias("dominant_width"), "lines", (F.col("k") > 1).alias("ragged"))


#: Rows of a block's cells as SQL: i, cells, the width w of the block, and the island a row belongs to.
_GRID = f"""b AS (SELECT DISTINCT document_id, unit_id, text FROM {_U} WHERE type IN ('table', 'paragraph') AND text IS NOT NULL),
x AS (SELECT document_id, unit_id, list_filter(list_transform(string_split(text, chr(10)), lambda y: list_filter(list_transform(regexp_split_to_array(y, ' {{2,}}|\\t+|\\|'), lambda z: trim(z, ' ')), lambda z: z <> '')), lambda r: len(r) > 0) AS r FROM b),
l AS (SELECT document_id, unit_id, r[i] AS cells, i FROM (SELECT document_id, unit_id, r, unnest(range(1, len(r) + 1)) AS i FROM x)),
m AS (SELECT document_id, unit_id, arg_max(width, (n, width)) AS w FROM (SELECT document_id, unit_id, len(cells) AS width, count(*) AS n FROM l WHERE len(cells) >= 2 GROUP BY 1, 2, 3) GROUP BY 1, 2),
g AS (SELECT l.*, m.w, sum(CASE WHEN l.i = 1 OR len(cells) > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY l.document_id, l.unit_id ORDER BY l.i) AS island FROM l JOIN m ON m.document_id = l.document_id AND m.unit_id = l.unit_id),
h AS (SELECT document_id, unit_id, island, w, arg_min(cells, i) AS head, string_agg(cells[1], chr(10) ORDER BY i) FILTER (i > first_i) AS more FROM (SELECT *, min(i) OVER (PARTITION BY document_id, unit_id, island) AS first_i FROM g) GROUP BY 1, 2, 3, 4),
k AS (SELECT document_id, unit_id, island, w, len(head) <> w AS ragged, len(head) AS width, CASE WHEN len(head) > w THEN list_append(head[1:w - 1], array_to_string(head[w:], ' ')) ELSE list_concat(head, list_transform(range(len(head), w), lambda q: '')) END AS cells, more FROM h),
t AS (SELECT document_id, unit_id, island, w, ragged, width, CASE WHEN more IS NULL THEN cells ELSE list_append(cells[1:w - 1], cells[w] || chr(10) || more) END AS cells FROM k)"""


def _grid(spark: SparkSession, d: str) -> DataFrame:
    """document_id, unit_id, w and rows (array of width as read and cells) of every text block whose lines have cells.

    w is the most frequent width of two cells or more, the greater of several. A line of one cell goes on the row before
    it; what a wider line has beyond w goes into its last cell, a narrower one is filled up. All in one row's arrays.
    """
    u = _units(spark, d, "document_id", "unit_id", "type", "text").where("type in ('table', 'paragraph') and text is not null").select("document_id", "unit_id", "text").distinct()
    lines = F.filter(F.transform(F.split("text", "\n"), tx.cells), lambda r: F.size(r) > 0)
    u = u.select("document_id", "unit_id", lines.alias("l")).withColumn("widths", F.filter(F.transform("l", lambda r: F.size(r)), lambda n: n >= 2)).where(F.size("widths") > 0)
    often = F.transform(F.array_distinct("widths"), lambda n: F.struct(F.size(F.filter("widths", lambda x: x == n)).alias("times"), n.alias("w")))
    u = u.withColumn("w", F.array_max(often)["w"])
    w = F.col("w")

    def row(r: Column) -> Column:
        wide = F.concat(F.slice(r, F.lit(1), w - 1), F.array(F.array_join(F.slice(r, w, F.size(r)), " ")))
        return F.when(F.size(r) > w, wide).otherwise(F.concat(r, F.array_repeat(F.lit(""), w - F.size(r))))

    def step(rows: Column, r: Column) -> Column:
        last = F.element_at(rows, -1)
        longer = F.concat(F.slice(last["cells"], F.lit(1), w - 1), F.array(F.concat(F.element_at(last["cells"], -1), F.lit("\n"), r[0])))
        joined = F.concat(F.slice(rows, F.lit(1), F.size(rows) - 1), F.array(F.struct(last["width"].alias("width"), longer.alias("cells"))))
        return F.when((F.size(r) == 1) & (F.size(rows) > 0), joined).otherwise(F.concat(rows, F.array(F.struct(F.size(r).alias("width"), row(r).alias("cells")))))

    return u.select("document_id", "unit_id", "w", F.aggregate("l", F.array().cast("array<struct<width:int,cells:array<string>>>"), step).alias("rows"))


@query(f"WITH {_GRID} SELECT document_id, unit_id, w::INT AS width, count(*) AS rows_, bool_or(ragged) AS structure_warning, string_agg(array_to_string(cells, ' | '), chr(10) ORDER BY island) AS grid FROM t GROUP BY 1, 2, 3")
def table_parse(spark, d):
    """Blocks of text as rectangular grids; structure_warning where rows had another width."""
    lines = F.array_join(F.transform("rows", lambda r: F.array_join(r["cells"], " | ")), "\n")
    return _grid(spark, d).select("document_id", "unit_id", F.col("w").alias("width"), F.size("rows").cast("long").alias("rows_"), F.exists("rows", lambda r: r["width"] != F.col("w")).alias("structure_warning"), lines.alias("grid"))


@query(f"""WITH {_GRID}, n AS (SELECT document_id, unit_id, w, count(*) AS rows_, count(*) FILTER (width = w) AS aligned, bool_or(ragged) AS ragged, count(*) FILTER (regexp_full_match(cells[1], '([0-9]+|[A-Za-zА-Яа-яЁё])[.)]?')) AS listed, count(*) FILTER (regexp_full_match(cells[1], '([0-9]+|[A-Za-zА-Яа-яЁё])[.)]?') AND len(list_filter(cells[2:], lambda c: length(c) >= 20)) > 0) AS prose, count(*) FILTER (regexp_full_match(cells[1], '([0-9]+|[A-Za-zА-Яа-яЁё])[.)]?') AND len(list_filter(cells[2:], lambda c: regexp_matches(c, '[0-9]'))) > 0) AS numeric, count(*) FILTER (island > 1 AND len(list_filter(cells[2:], lambda c: regexp_matches(c, '[0-9]'))) > 0) AS signals FROM t GROUP BY 1, 2, 3)
SELECT document_id, unit_id, rows_ >= 2 AND aligned >= 2 AND NOT (listed >= 2 AND prose >= 2 AND numeric <= 1) AND NOT (w = 2 AND ragged AND signals = 0) AS is_table FROM n""")
def table_detect(spark, d):
    """A grid is a table with two rows or more of its width, unless it is a numbered list or two ragged columns without digits."""
    return _grid(spark, d).select("document_id", "unit_id", _is_table().alias("is_table"))


def _is_table() -> Column:
    w = F.col("w")
    rest = lambda r: F.slice(r["cells"], F.lit(2), F.size(r["cells"]))
    listed = F.filter("rows", lambda r: r["cells"][0].rlike(r"^([0-9]+|[A-Za-zА-Яа-яЁё])[.)]?$"))
    prose = F.size(F.filter(listed, lambda r: F.exists(rest(r), lambda c: F.length(c) >= 20)))
    numeric = F.size(F.filter(listed, lambda r: F.exists(rest(r), lambda c: c.rlike("[0-9]"))))
    signals = F.exists(F.slice("rows", F.lit(2), F.size("rows")), lambda r: F.exists(rest(r), lambda c: c.rlike("[0-9]")))
    aligned = F.size(F.filter("rows", lambda r: r["width"] == w))
    return (F.size("rows") >= 2) & (aligned >= 2) & ~((F.size(listed) >= 2) & (prose >= 2) & (numeric <= 1)) & ~((w == 2) & F.exists("rows", lambda r: r["width"] != w) & ~signals)


@query(f"WITH {_GRID} SELECT document_id, unit_id AS table_id, unit_id || printf('_r%03d', island::INT) AS row_id, array_to_string(list_transform(cells, lambda c: replace(c, chr(10), ' ')), ' | ') AS row_text, width::INT AS width FROM t")
def table_rows(spark, d):
    """The rows of each grid: single cells joined to the row before, line ends flattened in the row's text."""
    rows = _grid(spark, d).select("document_id", F.col("unit_id").alias("table_id"), F.posexplode("rows").alias("p", "r"))
    return rows.select("document_id", "table_id", F.concat("table_id", F.format_string("_r%03d", F.col("p") + 1)).alias("row_id"), F.array_join(F.transform("r.cells", lambda c: F.replace(c, F.lit("\n"), F.lit(" "))), " | ").alias("row_text"), F.col("r.width").alias("width"))


@query(f"""WITH {_GRID}, c AS (SELECT document_id, unit_id, island, w, unnest(cells) AS cell, unnest(range(1, len(cells) + 1)) AS j FROM t)
SELECT document_id, unit_id || '_t' AS unit_id, unit_id AS parent_id, 'table' AS type, '' AS text, 0::BIGINT AS position FROM t GROUP BY ALL
UNION ALL SELECT document_id, unit_id || printf('_r%03d', island::INT), unit_id || '_t', 'table_row', '', 1 + (island - 1) * (w + 1) FROM t
UNION ALL SELECT document_id, unit_id || printf('_r%03d_c%03d', island::INT, j::INT), unit_id || printf('_r%03d', island::INT), 'table_cell', cell, 1 + (island - 1) * (w + 1) + j FROM c""")
def table_units(spark, d):
    """Each grid as units: the table, its rows, and their cells, with parents and their place in the reading order."""
    g = _grid(spark, d)
    tables = g.select("document_id", F.concat("unit_id", F.lit("_t")).alias("unit_id"), F.col("unit_id").alias("parent_id"), F.lit("table").alias("type"), F.lit("").alias("text"), F.lit(0).cast("long").alias("position"))
    r = g.select("document_id", "unit_id", "w", F.posexplode("rows").alias("p", "r")).withColumn("row_id", F.concat("unit_id", F.format_string("_r%03d", F.col("p") + 1))).withColumn("at", F.lit(1).cast("long") + F.col("p") * (F.col("w") + 1))
    rows = r.select("document_id", F.col("row_id").alias("unit_id"), F.concat("unit_id", F.lit("_t")).alias("parent_id"), F.lit("table_row").alias("type"), F.lit("").alias("text"), F.col("at").alias("position"))
    c = r.select("document_id", "row_id", "at", F.posexplode("r.cells").alias("j", "cell"))
    cells = c.select("document_id", F.concat("row_id", F.format_string("_c%03d", F.col("j") + 1)).alias("unit_id"), F.col("row_id").alias("parent_id"), F.lit("table_cell").alias("type"), F.col("cell").alias("text"), (F.col("at") + F.col("j") + 1).alias("position"))
    return tables.unionByName(rows).unionByName(cells)


@query(f"""SELECT document_id, unit_id, (p + 1)::BIGINT AS paragraph_no, string_agg(line, ' ' ORDER BY i) AS paragraph FROM (SELECT document_id, unit_id, line, i, sum(CASE WHEN regexp_matches(line, '^[0-9]+(\\.[0-9]+)*[.)]? ') AND i > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY document_id, unit_id ORDER BY i) AS p FROM (SELECT document_id, unit_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM {_U} WHERE type = 'paragraph' AND text IS NOT NULL)) GROUP BY ALL""")
def paragraph_split(spark, d):
    u = _units(spark, d, "document_id", "unit_id", "type", "text").where("type = 'paragraph' and text is not null")
    l = u.select("document_id", "unit_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))  # noqa: E741
    starts = (F.col("line").rlike(r"^[0-9]+(\.[0-9]+)*[.)]? ") & (F.col("i") > 0)).cast("long")
    numbered = l.withColumn("p", F.sum(starts).over(Window.partitionBy("document_id", "unit_id").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("document_id", "unit_id", (F.col("p") + 1).alias("paragraph_no")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "line"))), lambda x: x.line), " ").alias("paragraph"))


@query("""WITH w AS (SELECT DISTINCT document_id, asset_id, chunk_order, text, face, charset, height FROM wmf_text_chunks WHERE text IS NOT NULL),
g AS (SELECT *, CASE WHEN lag(face) OVER o IS NOT DISTINCT FROM face AND lag(charset) OVER o IS NOT DISTINCT FROM charset AND lag(height) OVER o IS NOT DISTINCT FROM height AND lag(chunk_order) OVER o = chunk_order - 1 THEN 0 ELSE 1 END AS starts FROM w WINDOW o AS (PARTITION BY document_id, asset_id ORDER BY chunk_order, text))
SELECT document_id, asset_id, min(chunk_order) AS chunk_order, string_agg(text, '' ORDER BY chunk_order, text) AS text, count(*) AS chunks FROM (SELECT *, sum(starts) OVER (PARTITION BY document_id, asset_id ORDER BY chunk_order, text ROWS UNBOUNDED PRECEDING) AS island FROM g) GROUP BY document_id, asset_id, island""")
def adjacent_coalesce(spark, d):
    w = table(spark, d, "wmf_text_chunks", "document_id", "asset_id", "chunk_order", "text", "face", "charset", "height").where("text is not null").distinct()
    o = Window.partitionBy("document_id", "asset_id").orderBy("chunk_order", "text")
    same = F.lag("face").over(o).eqNullSafe(F.col("face")) & F.lag("charset").over(o).eqNullSafe(F.col("charset")) & F.lag("height").over(o).eqNullSafe(F.col("height")) & F.coalesce(F.lag("chunk_order").over(o) == F.col("chunk_order") - 1, F.lit(False)) & (F.row_number().over(o) > 1)
    g = w.withColumn("starts", (~same).cast("int")).withColumn("island", F.sum("starts").over(o.rowsBetween(Window.unboundedPreceding, 0)))
    return g.groupBy("document_id", "asset_id", "island").agg(F.min("chunk_order").alias("chunk_order"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("chunk_order", "text"))), lambda x: x.text), "").alias("text"), F.count("*").alias("chunks")).drop("island")


@query("""WITH w AS (SELECT DISTINCT document_id, asset_id, chunk_order, text, abs(height) AS h FROM wmf_text_chunks WHERE text IS NOT NULL AND height IS NOT NULL), m AS (SELECT document_id, asset_id, max(h) AS top FROM w GROUP BY 1, 2)
SELECT w.document_id, w.asset_id, string_agg(text, ' ' ORDER BY chunk_order, text) FILTER (h = top) AS base, coalesce(string_agg(text, ' ' ORDER BY chunk_order, text) FILTER (h < top), '') AS script FROM w JOIN m USING (document_id, asset_id) GROUP BY 1, 2""")
def wmf_ir(spark, d):
    w = table(spark, d, "wmf_text_chunks", "document_id", "asset_id", "chunk_order", "text", F.abs("height").alias("h")).where("text is not null and h is not null").distinct()
    every = F.sort_array(F.collect_list(F.struct("chunk_order", "text", "h")))
    g = w.groupBy("document_id", "asset_id").agg(every.alias("c"), F.max("h").alias("top"))
    part = lambda keep: F.array_join(F.transform(F.filter("c", keep), lambda x: x.text), " ")
    return g.select("document_id", "asset_id", part(lambda x: x.h == F.col("top")).alias("base"), part(lambda x: x.h < F.col("top")).alias("script"))


@query("SELECT DISTINCT document_id, unit_id, cell.address AS address, cell.value_type AS value_type, CASE WHEN cell.formula IS NOT NULL THEN concat_ws(' ', cell.address || ':', '=' || ltrim(cell.formula, '='), '->', coalesce(cell.value, '')) ELSE concat_ws(' ', cell.address || ':', coalesce(cell.value, '')) END AS search_text, coalesce(cell.value, cell.formula, cell.hyperlink) IS NOT NULL AS has_content FROM document_units WHERE cell.address IS NOT NULL")
def cell_payload(spark, d):
    c = lambda n: F.col(f"cell.{n}")
    head = F.concat(c("address"), F.lit(":"))
    value = F.coalesce(c("value"), F.lit(""))
    shown = F.when(c("formula").isNotNull(), F.concat_ws(" ", head, F.concat(F.lit("="), F.ltrim(c("formula"), F.lit("="))), F.lit("->"), value)).otherwise(F.concat_ws(" ", head, value))
    return table(spark, d, "document_units", "document_id", "unit_id", "cell").where("cell.address is not null").select("document_id", "unit_id", c("address").alias("address"), c("value_type").alias("value_type"), shown.alias("search_text"), F.coalesce(c("value"), c("formula"), c("hyperlink")).isNotNull().alias("has_content")).distinct()


_NUMBER = r"^[-+]?(([0-9](_?[0-9])*(\.([0-9](_?[0-9])*)?)?|\.[0-9](_?[0-9])*)(e[-+]?[0-9](_?[0-9])*)?|inf|infinity)$"


@query(rf"""WITH v AS (SELECT DISTINCT document_id, unit_id, cell.value AS value, replace(regexp_replace(cell.value, '^[\s\x0B\x1c-\x1f\x{{85}}\p{{Z}}]+|[\s\x0B\x1c-\x1f\x{{85}}\p{{Z}}]+$', '', 'g'), ',', '.') AS v FROM document_units WHERE cell.address IS NOT NULL),
n AS (SELECT *, CASE WHEN regexp_matches(v, '{_NUMBER}', 'i') THEN try_cast(replace(ltrim(v, '+'), '_', '') AS DOUBLE) WHEN regexp_matches(v, '^[-+]?nan$', 'i') THEN 'nan'::DOUBLE END AS number FROM v)
SELECT DISTINCT document_id, unit_id, number, CASE WHEN value IS NULL OR v = '' THEN 'empty' WHEN number IS NULL THEN 'not_a_number' ELSE 'ok' END AS outcome FROM n""")
def numeric_coerce(spark, d):
    """Every addressed cell gets a row. Numbers are what Python's float() takes, so '1d' and '0x1p3' are none."""
    value = F.replace(F.regexp_replace("cell.value", r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", ""), F.lit(","), F.lit("."))
    plain = value.rlike("(?i)" + _NUMBER)
    number = F.when(plain, F.replace(value, F.lit("_"), F.lit("")).try_cast("double")).when(value.rlike("(?i)^[-+]?nan$"), F.lit(float("nan")))
    outcome = F.when(F.col("cell.value").isNull() | (value == ""), "empty").when(number.isNull(), "not_a_number").otherwise("ok")
    return table(spark, d, "document_units", "document_id", "unit_id", "cell").where("cell.address is not null").select("document_id", "unit_id", number.alias("number"), outcome.alias("outcome")).distinct()


@query("""WITH u AS (SELECT DISTINCT u.document_id, unit_id, type, route FROM document_units u LEFT JOIN (SELECT 'sha256:' || sha256 AS document_id, min(route) AS route FROM manifest WHERE sha256 IS NOT NULL GROUP BY 1) m ON m.document_id = u.document_id WHERE u.document_id IS NOT NULL)
SELECT document_id, unit_id, flag FROM (SELECT DISTINCT document_id, unit_id, CASE WHEN route IN ('pdf_text', 'pdf_scan') THEN CASE WHEN type IN ('header', 'footer') THEN 'repeated_edge_block' WHEN type IN ('figure', 'formula', 'table') THEN 'semantic_structure_inferred' END WHEN type = 'formula' THEN 'semantic_structure_inferred' WHEN type IN ('section', 'caption', 'list_item', 'figure') THEN 'semantic_style_inferred' END AS flag FROM u) WHERE flag IS NOT NULL""")
def unit_quality_flags(spark, d):
    """The flag a unit gets for how its type was told, by its document's route."""
    u = _units(spark, d, "document_id", "unit_id", "type").where("document_id is not null")
    m = table(spark, d, "manifest", "sha256", "route").where("sha256 is not null").groupBy(F.concat(F.lit("sha256:"), "sha256").alias("document_id")).agg(F.min("route").alias("route"))
    t = F.col("type")
    paged = F.when(t.isin("header", "footer"), "repeated_edge_block").when(t.isin("figure", "formula", "table"), "semantic_structure_inferred")
    styled = F.when(t == "formula", "semantic_structure_inferred").when(t.isin("section", "caption", "list_item", "figure"), "semantic_style_inferred")
    return u.join(m, "document_id", "left").select("document_id", "unit_id", F.when(F.coalesce(F.col("route").isin("pdf_text", "pdf_scan"), F.lit(False)), paged).otherwise(styled).alias("flag")).where("flag is not null").distinct()


@query("SELECT document_id, list_has_any(f, ['empty_text', 'ocr_failed', 'ocr_unavailable', 'asset_extraction_warning', 'rotated_text']) AS review_required FROM (SELECT document_id, list(DISTINCT w) AS f FROM (SELECT document_id, unnest(warnings) AS w FROM scan_results) GROUP BY 1)")
def review_required(spark, d):
    severe = ["empty_text", "ocr_failed", "ocr_unavailable", "asset_extraction_warning", "rotated_text"]
    return table(spark, d, "scan_results", "document_id", "warnings").select("document_id", F.explode("warnings").alias("w")).groupBy("document_id").agg(F.max(F.coalesce(F.col("w").isin(severe), F.lit(False))).alias("review_required"))


# Types a unit may have.
TYPES = ("document", "page", "section", "paragraph", "list", "list_item", "table", "table_row", "table_cell", "formula", "formula_image", "figure", "caption", "header", "footer", "footnote")


@query(f"""WITH u AS (SELECT DISTINCT document_id, unit_id, parent_id, type, unit_order, text, asset_ref, source_ref, formula, cell FROM document_units)
SELECT document_id, unit_id, problem FROM (SELECT DISTINCT document_id, unit_id, unnest([CASE WHEN NOT regexp_full_match(unit_id, 'u_[0-9]{{6}}') THEN 'unit_id' END, CASE WHEN NOT regexp_full_match(document_id, 'sha256:[0-9a-f]{{64}}') THEN 'document_id' END, CASE WHEN type NOT IN {TYPES} THEN 'type' END, CASE WHEN type = 'formula_image' AND asset_ref IS NULL THEN 'asset_ref' END,
CASE WHEN asset_ref LIKE '/%' OR contains(asset_ref, '..') THEN 'asset_path' END, CASE WHEN source_ref.page <= 0 THEN 'page' END, CASE WHEN unit_order < 0 THEN 'unit_order' END, CASE WHEN unit_order IS NULL THEN 'order_missing' END, CASE WHEN type = 'paragraph' AND coalesce(text, '') = '' THEN 'text' END, CASE WHEN len(source_ref.bbox) NOT IN (0, 4) THEN 'bbox' END,
CASE WHEN source_ref.document_id <> document_id THEN 'source_document' END, CASE WHEN parent_id = unit_id THEN 'own_parent' END, CASE WHEN type = 'table_cell' AND parent_id IS NULL THEN 'cell_parent' END, CASE WHEN type = 'formula' AND formula IS NULL THEN 'formula' END, CASE WHEN type <> 'table_cell' AND cell.address IS NOT NULL THEN 'cell' END, CASE WHEN formula.confidence NOT IN ('high', 'medium', 'low') THEN 'confidence' END]) AS problem FROM u) WHERE problem IS NOT NULL""")
def expectation_violations(spark, d):
    """Units against sixteen rules; each broken rule gives a row."""
    c = F.col
    rules = (
        ("unit_id", ~c("unit_id").rlike("^u_[0-9]{6}$")), ("document_id", ~c("document_id").rlike("^sha256:[0-9a-f]{64}$")), ("type", ~c("type").isin(*TYPES)), ("asset_ref", (c("type") == "formula_image") & c("asset_ref").isNull()),
        ("asset_path", c("asset_ref").startswith("/") | c("asset_ref").contains("..")), ("page", c("source_ref.page") <= 0), ("unit_order", c("unit_order") < 0), ("order_missing", c("unit_order").isNull()),
        ("text", (c("type") == "paragraph") & (F.coalesce("text", F.lit("")) == "")), ("bbox", c("source_ref.bbox").isNotNull() & ~F.size("source_ref.bbox").isin(0, 4)), ("source_document", c("source_ref.document_id") != c("document_id")),
        ("own_parent", c("parent_id") == c("unit_id")), ("cell_parent", (c("type") == "table_cell") & c("parent_id").isNull()), ("formula", (c("type") == "formula") & c("formula").isNull()), ("cell", (c("type") != "table_cell") & c("cell.address").isNotNull()),
        ("confidence", ~c("formula.confidence").isin("high", "medium", "low")),
    )
    u = table(spark, d, "document_units", "document_id", "unit_id", "parent_id", "type", "unit_order", "text", "asset_ref", "source_ref", "formula", "cell")
    return u.select("document_id", "unit_id", F.explode(F.array_compact(F.array(*[F.when(broken, name) for name, broken in rules]))).alias("problem")).distinct()


@query("""WITH a AS (SELECT DISTINCT document_id, a.unit_id AS unit_id, a.path AS path FROM (SELECT document_id, unnest(assets) AS a FROM packages) WHERE a.unit_id IS NOT NULL AND a.path IS NOT NULL), u AS (SELECT DISTINCT document_id, u.unit_id AS unit_id, u.asset_ref AS asset_ref FROM (SELECT document_id, unnest(units) AS u FROM packages) WHERE u.unit_id IS NOT NULL)
SELECT u.document_id, u.unit_id, u.asset_ref, CASE WHEN count(DISTINCT a.path) = 1 THEN min(a.path) END AS attached, count(DISTINCT a.path) AS candidates FROM u JOIN a ON a.document_id = u.document_id AND a.unit_id = u.unit_id GROUP BY 1, 2, 3""")
def asset_attach(spark, d):
    """The asset of each unit that has any: attached only if it is a single one."""
    p = table(spark, d, "packages", "document_id", "assets")
    a = p.select("document_id", F.inline("assets")).where("unit_id is not null and path is not null").select("document_id", "unit_id", "path").distinct()
    u = table(spark, d, "packages", "document_id", "units").select("document_id", F.explode("units").alias("u")).select("document_id", "u.unit_id", "u.asset_ref").where("unit_id is not null").distinct()
    g = a.groupBy("document_id", "unit_id").agg(F.count("*").alias("candidates"), F.min("path").alias("path"))
    return u.join(g, ["document_id", "unit_id"]).select("document_id", "unit_id", "asset_ref", F.when(F.col("candidates") == 1, F.col("path")).alias("attached"), "candidates")


_MD = "CASE type WHEN 'document' THEN '# ' || text WHEN 'section' THEN '## ' || text WHEN 'list_item' THEN '- ' || regexp_replace(text, '^[-–] ', '') WHEN 'formula' THEN '`' || text || '`' WHEN 'caption' THEN '*' || text || '*' WHEN 'header' THEN '<!-- ' || text || ' -->' WHEN 'footer' THEN '<!-- ' || text || ' -->' ELSE text END"
_SAFE = "replace(replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"
#: Distinct units with text, and figures with their asset; cells are rendered by their rows.
_SHOWN = f"(SELECT DISTINCT document_id, unit_id, type, unit_order, text, asset_ref FROM {_U} WHERE document_id IS NOT NULL AND type NOT IN ('table_cell', 'table_row') AND (text <> '' OR asset_ref IS NOT NULL))"


@query(f"""WITH r AS (SELECT document_id, unit_id, unit_order, CASE WHEN text <> '' THEN {_MD} ELSE '![' || unit_id || '](' || asset_ref || ')' END AS line FROM {_SHOWN})
SELECT document_id, unit_order // {ordered.STRETCH} AS stretch, string_agg(line, chr(10) || chr(10) ORDER BY unit_order, unit_id, line) AS markdown FROM r WHERE line IS NOT NULL GROUP BY 1, 2""")
def render_markdown(spark, d):
    """Documents as Markdown in their order, a row for each stretch of the order, so no document becomes one row."""
    text, kind = F.col("text"), F.col("type")
    around = lambda a, b: F.concat(F.lit(a), text, F.lit(b))
    shown = F.when(kind == "document", around("# ", "")).when(kind == "section", around("## ", "")).when(kind == "list_item", F.concat(F.lit("- "), F.regexp_replace(text, "^[-–] ", ""))).when(kind == "formula", around("`", "`")).when(kind == "caption", around("*", "*")).when(kind.isin("header", "footer"), around("<!-- ", " -->")).otherwise(text)
    line = F.when(text != "", shown).otherwise(F.concat(F.lit("!["), "unit_id", F.lit("]("), "asset_ref", F.lit(")")))
    return _stretches(spark, d, line, "markdown", "\n\n")


def _stretches(spark: SparkSession, d: str, line: Column, name: str, between: str) -> DataFrame:
    u = _units(spark, d, "document_id", "unit_id", "type", "unit_order", "text", "asset_ref").where("document_id is not null and type not in ('table_cell', 'table_row') and (text <> '' or asset_ref is not null)")
    r = u.select("document_id", "unit_id", "unit_order", line.alias("line")).where("line is not null")
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("unit_order", "unit_id", "line"))), lambda x: x.line), between)
    return r.groupBy("document_id", F.floor(F.col("unit_order") / ordered.STRETCH).alias("stretch")).agg(joined.alias(name))


_TAGS = (("document", "h1"), ("section", "h2"), ("list_item", "li"), ("formula", "code"), ("caption", "figcaption"), ("header", "header"), ("footer", "footer"), ("footnote", "small"))
_TAG = "CASE type " + " ".join(f"WHEN '{k}' THEN '{t}'" for k, t in _TAGS) + " ELSE 'p' END"


@query(f"""WITH r AS (SELECT document_id, unit_id, unit_order, CASE WHEN text <> '' THEN '<' || {_TAG} || '>' || replace({_SAFE.format('text')}, chr(10), '<br>') || '</' || {_TAG} || '>' ELSE '<img src="' || {_SAFE.format('asset_ref')} || '">' END AS line FROM {_SHOWN})
SELECT document_id, unit_order // {ordered.STRETCH} AS stretch, string_agg(line, chr(10) ORDER BY unit_order, unit_id, line) AS html FROM r WHERE line IS NOT NULL GROUP BY 1, 2""")
def render_html(spark, d):
    """Documents as HTML in their order, every kind of unit by its element."""
    tag = F.coalesce(*[F.when(F.col("type") == k, t) for k, t in _TAGS], F.lit("p"))
    source = F.concat(F.lit('<img src="'), tx.escape_html(F.col("asset_ref")), F.lit('">'))
    line = F.when(F.col("text") != "", F.concat(F.lit("<"), tag, F.lit(">"), tx.escape_html(F.col("text")), F.lit("</"), tag, F.lit(">"))).otherwise(source)
    return _stretches(spark, d, line, "html", "\n")


@query(f"""WITH c AS (SELECT DISTINCT document_id, parent_id AS row_id, unit_id, unit_order, replace(replace(coalesce(text, ''), '|', '\\|'), chr(10), '<br>') AS cell FROM {_U} WHERE type = 'table_cell' AND parent_id IS NOT NULL AND document_id IS NOT NULL),
r AS (SELECT c.document_id, r.parent_id AS table_id, c.row_id, min(r.unit_order) AS row_order, count(*) AS n, string_agg(cell, ' | ' ORDER BY c.unit_order, c.unit_id, cell) AS cells FROM c JOIN (SELECT document_id, unit_id, min(parent_id) AS parent_id, min(unit_order) AS unit_order FROM {_U} WHERE type = 'table_row' AND parent_id IS NOT NULL GROUP BY 1, 2) r ON r.document_id = c.document_id AND r.unit_id = c.row_id GROUP BY 1, 2, 3),
w AS (SELECT document_id, table_id, max(n) AS width, min((row_order, row_id)) AS head FROM r GROUP BY 1, 2)
SELECT r.document_id, r.table_id, r.row_id, (row_order, row_id) = head AS is_header, '| ' || cells || repeat(' | ', (width - n)::INT) || ' |' || CASE WHEN (row_order, row_id) = head THEN chr(10) || '|' || repeat(' --- |', width::INT) ELSE '' END AS markdown FROM r JOIN w ON w.document_id = r.document_id AND w.table_id = r.table_id""")
def render_table(spark, d):
    """The rows of tables as Markdown: filled up to the widest, the first one with the line under a head."""
    u = _units(spark, d, "document_id", "unit_id", "parent_id", "type", "unit_order", "text").where("document_id is not null and parent_id is not null")
    safe = F.replace(F.replace(F.coalesce("text", F.lit("")), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit("<br>"))
    cells = u.where("type = 'table_cell'").select("document_id", F.col("parent_id").alias("row_id"), "unit_order", "unit_id", safe.alias("cell")).distinct()
    cells = cells.groupBy("document_id", "row_id").agg(F.count("*").alias("n"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("unit_order", "unit_id", "cell"))), lambda x: x.cell), " | ").alias("cells"))
    rows = u.where("type = 'table_row'").groupBy("document_id", F.col("unit_id").alias("row_id")).agg(F.min("parent_id").alias("table_id"), F.min("unit_order").alias("row_order")).join(cells, ["document_id", "row_id"])
    widest = rows.groupBy("document_id", "table_id").agg(F.max("n").alias("width"), F.min(F.struct("row_order", "row_id")).alias("head"))
    head = F.struct("row_order", "row_id") == F.col("head")
    missing, rule = F.repeat(F.lit(" | "), (F.col("width") - F.col("n")).cast("int")), F.concat(F.lit("\n|"), F.repeat(F.lit(" --- |"), F.col("width").cast("int")))
    return rows.join(widest, ["document_id", "table_id"]).select("document_id", "table_id", "row_id", head.alias("is_header"), F.concat(F.lit("| "), "cells", missing, F.lit(" |"), F.when(head, rule).otherwise("")).alias("markdown"))
