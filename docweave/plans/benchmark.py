"""Formula benchmark: summaries, tiers, gates, gold comparison, entries, caches, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.operators import ordered
from docweave.plans.formulas import _F, _formulas
from docweave.plans.register import Registry
from docweave.sources.tables import table

_R = Registry()
QUERIES, SQL, query = _R.queries, _R.sql, _R.add

# Tiers in their order, and the bounds of the gate as (scope, metric, operator, bound).
TIERS = (("docx_native", "anchor"), ("pdf_text", "gate"), ("pdf_scan", "control"), ("xlsx_native", "rolling"))
BOUNDS = (
    ("gate", "calc_rate", ">=", 0.60), ("gate", "native_rate", ">=", 0.13), ("gate", "low_confidence_rate", "<=", 0.93), ("overall", "calc_rate", ">=", 0.64), ("overall", "native_rate", ">=", 0.15),
    ("overall", "low_confidence_rate", "<=", 0.92), ("overall", "provider_rate", "<=", 0.0), ("overall", "gold_pass_rate", ">=", 1.0),
)
_COUNTS = ("formulas", "calculable", "native", "heuristic", "low_confidence", "provider", "review")
_RATES = (("calc_rate", "calculable"), ("native_rate", "native"), ("low_confidence_rate", "low_confidence"), ("provider_rate", "provider"))


def _n(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def _ratio(part: str, whole: str = "formulas") -> Column:
    return F.when(F.col(whole) > 0, F.bround(F.col(part) / F.col(whole), 4)).otherwise(0.0)


def _marked(spark: SparkSession, d: str) -> DataFrame:
    """One row per formula: document_id, source_format, confidence and a 0/1 column for each counter."""
    f = _formulas(spark, d)
    given = F.coalesce("source_format", F.lit(""))
    native, calc = given.contains("wmf"), F.coalesce(F.trim("calc_expr"), F.lit("")) != ""
    trust = F.trim(F.coalesce("confidence", F.lit("")))
    marks = {"formulas": F.lit(True), "calculable": calc, "native": native, "heuristic": (given != "") & ~native, "low_confidence": (trust != "") & (trust != "high"), "provider": given.contains("provider"), "review": trust.isin("low", "medium") | (F.col("n_warnings") > 0)}
    return f.select("document_id", given.alias("source_format"), trust.alias("confidence"), *[m.cast("int").alias(k) for k, m in marks.items()])


#: The same as SQL.
_M = f"""(SELECT document_id, coalesce(source_format, '') AS source_format, trim(coalesce(confidence, ''), ' ') AS confidence, 1 AS formulas, (coalesce(trim(calc_expr, ' '), '') <> '')::INT AS calculable, contains(coalesce(source_format, ''), 'wmf')::INT AS native,
(coalesce(source_format, '') <> '' AND NOT contains(source_format, 'wmf'))::INT AS heuristic, (trim(coalesce(confidence, ''), ' ') NOT IN ('', 'high'))::INT AS low_confidence, contains(coalesce(source_format, ''), 'provider')::INT AS provider, (trim(coalesce(confidence, ''), ' ') IN ('low', 'medium') OR n_warnings > 0)::INT AS review FROM {_F})"""
_SUMS = ", ".join(f"sum({c})::BIGINT AS {c}" for c in _COUNTS)
_RATE_SQL = ", ".join(f"round_even({part} / formulas, 4) AS {rate}" for rate, part in _RATES)


@query(f"""WITH c AS (SELECT document_id, {_SUMS} FROM {_M} GROUP BY 1),
k AS (SELECT document_id, string_agg(confidence || '=' || n, ';' ORDER BY confidence) AS confidences FROM (SELECT document_id, confidence, count(*) AS n FROM {_M} GROUP BY 1, 2) GROUP BY 1),
s AS (SELECT document_id, string_agg(source_format || '=' || n, ';' ORDER BY source_format) AS source_formats FROM (SELECT document_id, source_format, count(*) AS n FROM {_M} GROUP BY 1, 2) GROUP BY 1),
p AS (SELECT document_id, count(DISTINCT source_ref.page) AS pages FROM document_units GROUP BY 1)
SELECT c.*, {_RATE_SQL}, confidences, source_formats, coalesce(pages, 0) AS pages FROM c LEFT JOIN k USING (document_id) LEFT JOIN s USING (document_id) LEFT JOIN p USING (document_id) WHERE document_id IS NOT NULL""")
def formula_summary(spark, d):
    """Seven counters, four ratios, the counts by confidence and by source format, and the pages of each document."""
    m = _marked(spark, d).where("document_id is not null")
    # one row per document, confidence and format first, so a document of any size is counted in many tasks
    g = m.groupBy("document_id", "confidence", "source_format").agg(*[F.sum(c).alias(c) for c in _COUNTS])
    out = g.groupBy("document_id").agg(*[F.sum(c).alias(c) for c in _COUNTS])

    def counted(by: str, name: str) -> DataFrame:
        each = g.groupBy("document_id", by).agg(F.sum("formulas").alias("n"))
        return each.groupBy("document_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(by, "n"))), lambda x: F.concat(x[by], F.lit("="), x["n"].cast("string"))), ";").alias(name))

    pages = table(spark, d, "document_units", "document_id", "source_ref.page").where("page is not null").distinct().groupBy("document_id").agg(F.count("*").alias("pages"))
    out = out.join(counted("confidence", "confidences"), "document_id").join(counted("source_format", "source_formats"), "document_id").join(pages, "document_id", "left")
    return out.select("document_id", *_COUNTS, *[_ratio(part).alias(rate) for rate, part in _RATES], "confidences", "source_formats", F.coalesce("pages", F.lit(0)).alias("pages"))


_TIER_SQL = "CASE route " + " ".join(f"WHEN '{r}' THEN '{t}'" for r, t in TIERS) + " ELSE 'other' END"
_E = f"(SELECT 'sha256:' || sha256 AS document_id, min({_TIER_SQL}) AS tier, max(status IN ('success', 'partial_success')) AS available FROM manifest WHERE sha256 IS NOT NULL GROUP BY 1)"
_TOTALS = f"""SELECT coalesce(tier, 'overall') AS tier, count(*) AS entries, count(*) FILTER (available) AS available, {_SUMS.replace('sum(', 'coalesce(sum(').replace(')::BIGINT', '), 0)::BIGINT')}, count(*) FILTER (available AND formulas > 0) AS with_formulas
FROM (SELECT e.tier, e.available, c.* FROM {_E} e LEFT JOIN (SELECT document_id AS d, {_SUMS} FROM {_M} GROUP BY 1) c ON c.d = e.document_id) GROUP BY GROUPING SETS ((tier), ())"""


def _entries(spark: SparkSession, d: str) -> DataFrame:
    """document_id, tier and available of every file of the manifest by content."""
    tier = F.coalesce(*[F.when(F.col("route") == r, t) for r, t in TIERS], F.lit("other"))
    m = table(spark, d, "manifest", "sha256", "route", "status").where("sha256 is not null")
    return m.groupBy(F.concat(F.lit("sha256:"), "sha256").alias("document_id")).agg(F.min(tier).alias("tier"), F.max(F.coalesce(F.col("status").isin("success", "partial_success"), F.lit(False))).alias("available"))


def _tiers(spark: SparkSession, d: str) -> DataFrame:
    c = _marked(spark, d).groupBy("document_id").agg(*[F.sum(c).alias(c) for c in _COUNTS])
    e = _entries(spark, d).join(c, "document_id", "left")
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in _COUNTS]
    g = e.groupingSets([["tier"], []], "tier").agg(F.count("*").alias("entries"), _n(F.col("available")).alias("n_available"), *sums, _n(F.col("available") & (F.col("formulas") > 0)).alias("with_formulas"))
    return g.withColumnRenamed("n_available", "available").withColumn("tier", F.coalesce("tier", F.lit("overall")))


@query(_TOTALS)
def tier_summary(spark, d):
    """Entries, available ones and counters of each tier and over all. A document's route tells its tier."""
    return _tiers(spark, d)


_RATED = f"""SELECT tier, {', '.join(f'CASE WHEN formulas > 0 THEN round_even({part} / formulas, 4) ELSE 0 END AS {rate}' for rate, part in _RATES)}, NULL::DOUBLE AS gold_pass_rate,
CASE WHEN tier = 'control' THEN CASE WHEN available > 0 THEN round_even(with_formulas / available, 4) ELSE 0 END END AS false_positive_rate FROM ({_TOTALS})"""


def _rates(spark: SparkSession, d: str) -> DataFrame:
    control = F.when(F.col("tier") == "control", _ratio("with_formulas", "available"))
    return _tiers(spark, d).select("tier", *[_ratio(part).alias(rate) for rate, part in _RATES], F.lit(None).cast("double").alias("gold_pass_rate"), control.alias("false_positive_rate"))


@query(_RATED)
def tier_rates(spark, d):
    """Ratios of each tier; gold_pass_rate is null as no entry has a gold verdict, false positives count for control alone."""
    return _rates(spark, d)


_BOUNDS_SQL = ", ".join(f"('{s}', '{m}', '{o}', {b}::DOUBLE)" for s, m, o, b in BOUNDS)


@query(f"""WITH t(scope, metric, op, bound) AS (VALUES {_BOUNDS_SQL}), m AS (UNPIVOT (SELECT tier AS scope, calc_rate, native_rate, low_confidence_rate, provider_rate, false_positive_rate FROM ({_RATED})) ON calc_rate, native_rate, low_confidence_rate, provider_rate, false_positive_rate INTO NAME metric VALUE value)
SELECT t.scope, t.metric, t.op, t.bound, m.value, coalesce(CASE op WHEN '>=' THEN value >= bound ELSE value <= bound END, false) AS passed FROM t LEFT JOIN m ON m.scope = t.scope AND m.metric = t.metric""")
def threshold_gate(spark, d):
    """Each bound beside its metric; a metric that is missing or null fails."""
    names = ["calc_rate", "native_rate", "low_confidence_rate", "provider_rate", "gold_pass_rate", "false_positive_rate"]
    m = _rates(spark, d).unpivot(["tier"], names, "metric", "value").withColumnRenamed("tier", "scope")
    t = spark.createDataFrame(list(BOUNDS), "scope string, metric string, op string, bound double")
    ok = F.when(F.col("op") == ">=", F.col("value") >= F.col("bound")).otherwise(F.col("value") <= F.col("bound"))
    return F.broadcast(t).join(m, ["scope", "metric"], "left").select("scope", "metric", "op", "bound", "value", F.coalesce(ok, F.lit(False)).alias("passed"))


_FIELDS = ("type", "text", "source_format", "linear_text", "display_latex", "calc_expr", "confidence")
_ACTUAL = f"""(SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY unit_order, unit_id) - 1 AS formula_index FROM (SELECT DISTINCT document_id, unit_id, coalesce(unit_order, 0) AS unit_order, type, text, asset_ref, formula.source_format AS source_format, formula.linear_text AS linear_text, formula.display_latex AS display_latex, formula.calc_expr AS calc_expr, formula.confidence AS confidence, coalesce(len(formula.warnings), 0) AS n_warnings FROM document_units WHERE type IN ('formula', 'formula_image') AND formula IS NOT NULL))"""


@query(f"""WITH a AS {_ACTUAL}, v AS (SELECT g.document_label, a.document_id, count(*) AS n FROM formula_gold g JOIN a ON a.linear_text = g.linear_text WHERE a.document_id IS NOT NULL GROUP BY 1, 2),
b AS (SELECT document_label, document_id FROM (SELECT *, row_number() OVER (PARTITION BY document_label ORDER BY n DESC, document_id) AS r FROM v) WHERE r = 1),
j AS (SELECT g.document_label, g.formula_index, a.unit_id IS NOT NULL AS found, g.*, {', '.join(f'a.{c} AS a_{c}' for c in _FIELDS)} FROM formula_gold g LEFT JOIN b ON b.document_label = g.document_label LEFT JOIN a ON a.document_id = b.document_id AND a.formula_index = g.formula_index)
SELECT document_label, formula_index, 'exists' AS field, 'true' AS expected, NULL AS actual FROM j WHERE NOT found
UNION ALL SELECT document_label, formula_index, field, expected, actual FROM (SELECT document_label, formula_index, unnest([{', '.join(f"'{c}'" for c in _FIELDS)}]) AS field, unnest([{', '.join(_FIELDS)}]) AS expected, unnest([{', '.join(f'a_{c}' for c in _FIELDS)}]) AS actual FROM j WHERE found) WHERE expected IS NOT NULL AND expected IS DISTINCT FROM actual""")
def gold_compare(spark, d):
    """Gold and actual formulas by their place: a label stands for the document that shares the most formulas with it
    (the first by id of several), and the gold formula's index for the document's formula of that index. A gold formula
    beyond the document's gives one row ``exists``; of others every field that gold tells is compared."""
    f = ordered.running_sum(_formulas(spark, d), "document_id", ["unit_order", "unit_id"], F.lit(1), "n").withColumn("formula_index", (F.col("n") - 1).cast("int"))
    gold = table(spark, d, "formula_gold", "document_label", "formula_index", *_FIELDS)
    votes = f.select("document_id", F.col("linear_text").alias("t")).where("document_id is not null").join(gold.select("document_label", F.col("linear_text").alias("t")), "t").groupBy("document_label", "document_id").agg(F.count("*").alias("n"))
    best = votes.groupBy("document_label").agg(F.max(F.struct("n", F.lit(0).alias("z"))).alias("m")).select("document_label", "m.n").join(votes, ["document_label", "n"]).groupBy("document_label").agg(F.min("document_id").alias("document_id"))
    actual = f.select("document_id", "formula_index", F.lit(True).alias("found"), *[F.col(c).alias(f"a_{c}") for c in _FIELDS])
    joined = gold.join(best, "document_label", "left").join(actual, ["document_id", "formula_index"], "left")
    compared = F.array(*[F.when(F.col(c).isNotNull() & ~F.col(c).eqNullSafe(F.col(f"a_{c}")), F.struct(F.lit(c).alias("field"), F.col(c).alias("expected"), F.col(f"a_{c}").alias("actual"))) for c in _FIELDS])
    absent = F.array(F.struct(F.lit("exists").alias("field"), F.lit("true").alias("expected"), F.lit(None).cast("string").alias("actual")))
    return joined.select("document_label", "formula_index", F.inline(F.when(F.col("found"), F.array_compact(compared)).otherwise(absent)))


@query(f"""SELECT document_id, formula_index::INT AS formula_index, type, text, source_format, linear_text, display_latex, calc_expr, confidence FROM {_ACTUAL} WHERE document_id IS NOT NULL""")
def gold_build(spark, d):
    """A gold table made of what was found: every formula of every document by its place."""
    f = ordered.running_sum(_formulas(spark, d).where("document_id is not null"), "document_id", ["unit_order", "unit_id"], F.lit(1), "n")
    return f.select("document_id", (F.col("n") - 1).cast("int").alias("formula_index"), *_FIELDS)


@query("""SELECT run_id, relative_path, problem FROM (SELECT DISTINCT run_id, relative_path, unnest([CASE WHEN coalesce(trim(run_id, ' '), '') = '' THEN 'run_id' END, CASE WHEN coalesce(trim(relative_path, ' '), '') = '' THEN 'relative_path' END, CASE WHEN sha256 IS NULL OR NOT regexp_full_match(sha256, '[0-9a-f]{64}') THEN 'sha256' END, CASE WHEN coalesce(lower(format), '') NOT IN ('docx', 'pdf', 'xlsx') THEN 'input_kind' END]) AS problem FROM manifest) WHERE problem IS NOT NULL""")
def manifest_validate(spark, d):
    c = F.col
    empty = lambda n: F.coalesce(F.trim(n), F.lit("")) == ""
    checks = F.array(F.when(empty("run_id"), "run_id"), F.when(empty("relative_path"), "relative_path"), F.when(c("sha256").isNull() | ~c("sha256").rlike("^[0-9a-f]{64}$"), "sha256"), F.when(~F.coalesce(F.lower("format"), F.lit("")).isin("docx", "pdf", "xlsx"), "input_kind"))
    return table(spark, d, "manifest", "run_id", "relative_path", "sha256", "format").select("run_id", "relative_path", F.explode(F.array_compact(checks)).alias("problem")).distinct()


_STATUS_SQL = f"""SELECT e.document_id, e.tier, CASE WHEN NOT e.available THEN 'missing_input' WHEN u.document_id IS NULL THEN 'runtime_failure' ELSE 'ok' END AS status, coalesce(c.formulas, 0) AS formulas, coalesce(c.calculable, 0) AS calculable, coalesce(c.native, 0) AS native, coalesce(c.low_confidence, 0) AS low_confidence
FROM {_E} e LEFT JOIN (SELECT DISTINCT document_id FROM document_units) u ON u.document_id = e.document_id LEFT JOIN (SELECT document_id, {_SUMS} FROM {_M} GROUP BY 1) c ON c.document_id = e.document_id"""


def _runs(spark: SparkSession, d: str) -> DataFrame:
    have = table(spark, d, "document_units", "document_id").where("document_id is not null").distinct().withColumn("have", F.lit(True))
    c = _marked(spark, d).groupBy("document_id").agg(*[F.sum(c).alias(c) for c in _COUNTS])
    status = F.when(~F.col("available"), "missing_input").when(F.col("have").isNull(), "runtime_failure").otherwise("ok")
    return _entries(spark, d).join(have, "document_id", "left").join(c, "document_id", "left").select("document_id", "tier", status.alias("status"), *[F.coalesce(x, F.lit(0)).alias(x) for x in ("formulas", "calculable", "native", "low_confidence")])


@query(_STATUS_SQL)
def benchmark_entries(spark, d):
    """What became of each entry: its input missing, no units of it, or its counters."""
    return _runs(spark, d)


@query(f"""SELECT document_id, tier, reason FROM (SELECT document_id, tier, unnest([CASE WHEN status <> 'ok' THEN status END, CASE WHEN status = 'ok' AND formulas = 0 THEN 'no_formulas' END, CASE WHEN formulas > 0 AND calculable < formulas THEN 'missing_calc_expr' END, CASE WHEN formulas > 0 AND native = 0 THEN 'no_native' END, CASE WHEN formulas > 0 AND low_confidence = formulas THEN 'all_low_confidence' END, CASE WHEN tier = 'control' AND formulas > 0 THEN 'formula_in_control' END]) AS reason FROM ({_STATUS_SQL})) WHERE reason IS NOT NULL""")
def backlog_reasons(spark, d):
    """Why an entry needs work, by six rules."""
    c = F.col
    some = c("formulas") > 0
    rules = F.array(
        F.when(c("status") != "ok", c("status")), F.when((c("status") == "ok") & ~some, "no_formulas"), F.when(some & (c("calculable") < c("formulas")), "missing_calc_expr"),
        F.when(some & (c("native") == 0), "no_native"), F.when(some & (c("low_confidence") == c("formulas")), "all_low_confidence"), F.when((c("tier") == "control") & some, "formula_in_control"),
    )
    return _runs(spark, d).select("document_id", "tier", F.explode(F.array_compact(rules)).alias("reason"))


_KEY_SQL = "sha256('{\"asset\":\"' || sha256 || '\",\"route\":\"' || coalesce(route, '') || '\",\"version\":\"v1\"}')"


@query(f"""WITH k AS (SELECT DISTINCT run_id, sha256, {_KEY_SQL} AS cache_key FROM manifest WHERE sha256 IS NOT NULL AND run_id IS NOT NULL), f AS (SELECT cache_key, min(run_id) AS first_run FROM k GROUP BY 1)
SELECT k.run_id, count(*) AS entries, count(*) FILTER (k.run_id = f.first_run) AS computed, count(*) FILTER (k.run_id > f.first_run) AS reused FROM k JOIN f USING (cache_key) GROUP BY 1""")
def incremental_cache(spark, d):
    """Entries of each run that must be computed, and those an earlier run has under the same key (canonical JSON, hashed)."""
    canonical = F.to_json(F.struct(F.col("sha256").alias("asset"), F.coalesce("route", F.lit("")).alias("route"), F.lit("v1").alias("version")))
    k = table(spark, d, "manifest", "run_id", "sha256", "route").where("sha256 is not null and run_id is not null").select("run_id", F.sha2(canonical, 256).alias("cache_key")).distinct()
    first = k.groupBy("cache_key").agg(F.min("run_id").alias("first_run"))
    return k.join(first, "cache_key").groupBy("run_id").agg(F.count("*").alias("entries"), _n(F.col("run_id") == F.col("first_run")).alias("computed"), _n(F.col("run_id") > F.col("first_run")).alias("reused"))


@query(f"""WITH t AS ({_TOTALS}), s AS (SELECT coalesce(tier, 'overall') AS tier, count(*) FILTER (status <> 'ok') AS failures FROM ({_STATUS_SQL}) GROUP BY GROUPING SETS ((tier), ()))
SELECT tier, entries, formulas, calculable, failures, CASE WHEN failures > 0 THEN 'failed' WHEN formulas = 0 THEN 'empty' ELSE 'passed' END AS status FROM t JOIN s USING (tier)""")
def benchmark_report(spark, d):
    """The report's rows: totals, failures and status of each tier and over all."""
    return _report(spark, d)


def _report(spark: SparkSession, d: str) -> DataFrame:
    failed = _runs(spark, d).groupingSets([["tier"], []], "tier").agg(_n(F.col("status") != "ok").alias("failures")).withColumn("tier", F.coalesce("tier", F.lit("overall")))
    status = F.when(F.col("failures") > 0, "failed").when(F.col("formulas") == 0, "empty").otherwise("passed")
    return _tiers(spark, d).join(failed, "tier").select("tier", "entries", "formulas", "calculable", "failures", status.alias("status"))


@query()
def markdown_report(spark, d):
    """The report as a Markdown table in one row; at most one line per tier."""
    order = F.coalesce(*[F.when(F.col("tier") == t, i) for i, t in enumerate(["anchor", "gate", "control", "rolling", "other"])], F.lit(9))
    line = F.concat(F.lit("| "), F.concat_ws(" | ", "tier", *[F.col(c).cast("string") for c in ("entries", "formulas", "calculable", "failures")], "status"), F.lit(" |"))
    lines = F.transform(F.sort_array(F.collect_list(F.struct(order.alias("o"), line.alias("line")))), lambda x: x.line)
    head = F.lit("| tier | entries | formulas | calculable | failures | status |\n| --- | --- | --- | --- | --- | --- |\n")
    return _report(spark, d).agg(F.concat(head, F.array_join(lines, "\n")).alias("markdown"))


