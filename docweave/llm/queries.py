"""Named queries of the subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.llm import encodings, lookalikes, mixing, personal, repetition, scans, splitting, tokenizer
from docweave.sources.tables import table


def _latest_text(spark: SparkSession, d: str) -> DataFrame:
    """One row per unit: redelivered rows count once, the latest text wins."""
    units = table(spark, d, "document_units", "document_id", "unit_id", "unit_order", "text", "loaded_at")
    return units.groupBy("document_id", "unit_id").agg(F.max(F.struct("loaded_at", "unit_order", "text")).alias("w")).select("document_id", "unit_id", F.col("w.unit_order").alias("unit_order"), F.col("w.text").alias("text"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    units = table(spark, d, "document_units", "document_id", "unit_id", "text")
    return splitting.oversized(units, table(spark, d, "chunk_profiles"))


def p2_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.pieces(_latest_text(spark, d), table(spark, d, "chunk_profiles"), ("document_id", "unit_order", "unit_id"))


def _scan_inputs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    units = table(spark, d, "document_units", "document_id", "unit_id", "unit_order", "type", "source_ref", "text", "loaded_at")
    return units, table(spark, d, "scan_results", "document_id", "text_chars")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return scans.found(*_scan_inputs(spark, d))


def p3_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    return scans.paragraphs(scans.repaired(*_scan_inputs(spark, d)))


def p3_chars(spark: SparkSession, d: str) -> DataFrame:
    units, results = _scan_inputs(spark, d)
    return scans.characters_left(scans.paragraphs(scans.repaired(units, results)), results)


def _formula_inputs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    units = table(spark, d, "document_units", "document_id", "unit_id", "text", "formula")
    return units, table(spark, d, "formula_gold", "document_label", "formula_index", "text", "linear_text", "calc_expr")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    units, gold = _formula_inputs(spark, d)
    return lookalikes.found(units, gold, table(spark, d, "scan_results", "document_id"), encodings.train(units))


def p4_canonical(spark: SparkSession, d: str) -> DataFrame:
    return lookalikes.canonical(*_formula_inputs(spark, d))


def _encoding_inputs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return table(spark, d, "document_units", "document_id", "unit_id", "text"), table(spark, d, "wmf_text_chunks", "document_id", "asset_id", "chunk_ref", "chunk_order", "text", "face", "charset")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return encodings.repaired(*_encoding_inputs(spark, d)).select("record_table", "owner_id", "item_id").distinct()


def p6_restored(spark: SparkSession, d: str) -> DataFrame:
    return encodings.repaired(*_encoding_inputs(spark, d)).distinct()


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return personal.found(table(spark, d, "document_units", "document_id", "unit_id", "text"))


def p7_redacted(spark: SparkSession, d: str) -> DataFrame:
    return personal.redact(_latest_text(spark, d))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokenizer.encode(table(spark, d, "documents", "doc_id", "text"))


def _mix_inputs(spark: SparkSession, d: str):
    sized = mixing.sizes(table(spark, d, "documents", "doc_id", "source", "text"))
    return sized, mixing.plan(sized, table(spark, d, "mix_targets"))


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(*_mix_inputs(spark, d))


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.shares(*_mix_inputs(spark, d))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return repetition.found(table(spark, d, "documents", "doc_id", "text"))


def p10_shares(spark: SparkSession, d: str) -> DataFrame:
    return repetition.shares(table(spark, d, "documents", "doc_id", "text"))


QUERIES = {f.__name__: f for f in (p2_found, p2_pieces, p3_found, p3_paragraphs, p3_chars, p4_found, p4_canonical, p6_found, p6_restored, p7_found, p7_redacted, p8_ids, p9_mix, p9_shares, p10_found, p10_shares)}

SQL = {
    "p2_found": "SELECT DISTINCT p.profile, u.document_id, u.unit_id FROM document_units u JOIN chunk_profiles p ON length(u.text) > p.max_chars",
}
