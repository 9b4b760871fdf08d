"""Runs and packages: outcomes, queue, labels, compact records, expectations, quality flags, assembly, review."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docweave.operators import ordered
from docweave.plans.register import Registry
from docweave.sources.tables import table

_R = Registry()
QUERIES, SQL, query = _R.queries, _R.sql, _R.add

# Labels of status, flags that call for review, and what a missing value is written as.
LABELS = {"success": "Успешная обработка", "partial_success": "Частичная обработка", "failed": "Ошибка", "skipped_duplicate": "Дубликат", "skipped_unsupported": "Неподдерживаемый формат"}
SEVERE = ("empty_text", "ocr_failed", "ocr_unavailable", "asset_extraction_warning", "rotated_text")
PLACEHOLDERS = ("", "paste-api-key-here", "your-api-key-here", "change-me")
_DONE = ("success", "partial_success")


def _files(spark: SparkSession, d: str) -> DataFrame:
    """One row per file of each run."""
    m = table(spark, d, "manifest", "run_id", "relative_path", "sha256", "status", "duplicate_of", "error").where("run_id is not null and relative_path is not null")
    return m.groupBy("run_id", "relative_path").agg(*[F.max(c).alias(c) for c in ("sha256", "status", "duplicate_of", "error")])


_M = "(SELECT run_id, relative_path, max(sha256) AS sha256, max(status) AS status, max(duplicate_of) AS duplicate_of, max(error) AS error FROM manifest WHERE run_id IS NOT NULL AND relative_path IS NOT NULL GROUP BY 1, 2)"


@query(f"""WITH e AS (SELECT *, CASE WHEN sha256 IS NOT NULL THEN max(CASE WHEN status IN {_DONE} THEN run_id || '|' || status END) OVER (PARTITION BY sha256, relative_path ORDER BY run_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END AS earlier FROM {_M}),
o AS (SELECT run_id, relative_path, CASE WHEN duplicate_of IS NOT NULL THEN 'skipped_duplicate' WHEN earlier IS NOT NULL THEN split_part(earlier, '|', 2) ELSE status END AS outcome, duplicate_of IS NULL AND earlier IS NOT NULL AS resumed FROM e)
SELECT *, CASE outcome WHEN 'failed' THEN 'failed' WHEN 'partial_success' THEN 'partial' ELSE 'completed' END AS bucket FROM o""")
def run_manifest(spark, d):
    """What becomes of each file of a run: a duplicate is skipped, content an earlier run converted at the same path keeps
    that outcome, and the rest has its own."""
    m = _files(spark, d)
    before = Window.partitionBy("sha256", "relative_path").orderBy("run_id").rowsBetween(Window.unboundedPreceding, -1)
    known = F.when(F.col("sha256").isNotNull(), F.max(F.when(F.col("status").isin(*_DONE), F.struct("run_id", "status"))).over(before))
    outcome = F.when(F.col("duplicate_of").isNotNull(), "skipped_duplicate").when(F.col("known").isNotNull(), F.col("known.status")).otherwise(F.col("status"))
    o = m.withColumn("known", known).select("run_id", "relative_path", outcome.alias("outcome"), (F.col("duplicate_of").isNull() & F.col("known").isNotNull()).alias("resumed"))
    return o.withColumn("bucket", F.when(F.col("outcome") == "failed", "failed").when(F.col("outcome") == "partial_success", "partial").otherwise("completed"))


@query("""SELECT run_id, relative_path, CASE WHEN bool_or(event = 'document_failed') THEN 'failed' WHEN bool_or(event = 'document_completed' AND status = 'partial_success') THEN 'partial' WHEN bool_or(event IN ('document_completed', 'document_skipped_duplicate')) THEN 'completed' ELSE 'queued' END AS state FROM run_log WHERE run_id IS NOT NULL AND relative_path IS NOT NULL GROUP BY 1, 2""")
def queue_state(spark, d):
    """The bucket of each file of a run by its events; a file in none of them is queued."""
    has = lambda c: F.max(F.coalesce(c, F.lit(False)))
    e = F.col("event")
    g = table(spark, d, "run_log", "run_id", "relative_path", "event", "status").where("run_id is not null and relative_path is not null").groupBy("run_id", "relative_path").agg(has(e == "document_failed").alias("f"), has((e == "document_completed") & (F.col("status") == "partial_success")).alias("p"), has(e.isin("document_completed", "document_skipped_duplicate")).alias("c"))
    return g.select("run_id", "relative_path", F.when(F.col("f"), "failed").when(F.col("p"), "partial").when(F.col("c"), "completed").otherwise("queued").alias("state"))


_LABEL_SQL = "CASE status " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in LABELS.items()) + " ELSE coalesce(nullif(status, ''), 'Неизвестный статус') END"


@query(f"""SELECT DISTINCT run_id, relative_path, {_LABEL_SQL} AS label, CASE status WHEN 'failed' THEN nullif(error, '') WHEN 'partial_success' THEN nullif(array_to_string(list_filter(list_transform(warnings, lambda w: trim(w, ' ')), lambda w: w <> ''), '; '), '') WHEN 'skipped_duplicate' THEN 'duplicate_of:' || nullif(duplicate_of, '') END AS issue FROM manifest""")
def catalog_labels(spark, d):
    s = F.col("status")
    label = F.coalesce(*[F.when(s == k, v) for k, v in LABELS.items()], F.nullif(s, F.lit("")), F.lit("Неизвестный статус"))
    warnings = F.nullif(F.array_join(F.filter(F.transform("warnings", lambda w: F.trim(w)), lambda w: w != ""), "; "), F.lit(""))
    issue = F.when(s == "failed", F.nullif("error", F.lit(""))).when(s == "partial_success", warnings).when(s == "skipped_duplicate", F.concat(F.lit("duplicate_of:"), F.nullif("duplicate_of", F.lit(""))))
    return table(spark, d, "manifest", "run_id", "relative_path", "status", "error", "warnings", "duplicate_of").select("run_id", "relative_path", label.alias("label"), issue.alias("issue")).distinct()


_EVENT = ("run_id", "event", "level", "status", "relative_path", "route", "size_bytes")


@query("SELECT '{' || array_to_string(list_filter([" + ", ".join(f"'\"{c}\":' || to_json({c})" for c in _EVENT) + ", CASE WHEN len(warnings) > 0 THEN '\"warnings\":' || to_json(warnings) END], lambda x: x IS NOT NULL), ',') || '}' AS record, count(*) AS n FROM run_log GROUP BY 1")
def event_compact_json(spark, d):
    """Log records as compact JSON without nulls and empty lists of warnings."""
    warnings = F.when(F.size("warnings") > 0, F.col("warnings")).alias("warnings")
    return table(spark, d, "run_log", *_EVENT, "warnings").select(F.to_json(F.struct(*_EVENT, warnings)).alias("record")).groupBy("record").agg(F.count("*").alias("n"))


_LINE = ("duplicate_of", "filename", "format", "pages", "relative_path", "run_id", "sha256", "size_bytes", "status", "units_count")


@query(f"SELECT DISTINCT to_json({{{', '.join(f"'{c}': {c}" for c in _LINE)}}})::VARCHAR AS line FROM manifest")
def manifest_json_lines(spark, d):
    """Manifest rows as JSON lines: keys sorted, nulls kept."""
    return table(spark, d, "manifest", *_LINE).select(F.to_json(F.struct(*_LINE), {"ignoreNullFields": "false"}).alias("line")).distinct()


@query(f"""WITH c AS (SELECT run_id, CASE WHEN lower(trim(agent_id, ' ')) IN {PLACEHOLDERS} THEN NULL ELSE trim(agent_id, ' ') END AS env, CASE WHEN lower(trim(task_id, ' ')) IN {PLACEHOLDERS} THEN NULL ELSE trim(task_id, ' ') END AS local, CASE WHEN lower(trim(parent_run_id, ' ')) IN {PLACEHOLDERS} THEN NULL ELSE trim(parent_run_id, ' ') END AS file, try_cast(split_part(tool_version, '.', 1) AS INTEGER) AS number FROM runs)
SELECT run_id, coalesce(env, local, file, 'default') AS value, CASE WHEN env IS NOT NULL THEN 'environment' WHEN local IS NOT NULL THEN 'local' WHEN file IS NOT NULL THEN 'file' ELSE 'default' END AS origin, CASE WHEN number >= 0 THEN number END AS number FROM c""")
def config_precedence(spark, d):
    """Layered settings: the first layer with a value that is no placeholder wins; what is no number from 0 on is null."""
    given = lambda c: F.when(~F.lower(F.trim(c)).isin(*PLACEHOLDERS), F.trim(c))
    c = table(spark, d, "runs").select("run_id", given("agent_id").alias("env"), given("task_id").alias("local"), given("parent_run_id").alias("file"), F.split("tool_version", r"\.")[0].try_cast("int").alias("number"))
    origin = F.when(F.col("env").isNotNull(), "environment").when(F.col("local").isNotNull(), "local").when(F.col("file").isNotNull(), "file").otherwise("default")
    return c.select("run_id", F.coalesce("env", "local", "file", F.lit("default")).alias("value"), origin.alias("origin"), F.when(F.col("number") >= 0, F.col("number")).alias("number"))


@query("""SELECT run_id, CASE WHEN f > 0 AND ok = 0 AND p = 0 THEN 'error' WHEN f > 0 OR p > 0 THEN 'warning' ELSE 'ok' END AS status, CASE WHEN f > 0 AND ok = 0 AND p = 0 THEN 1 ELSE 0 END AS exit_code FROM (SELECT run_id, count(*) FILTER (status = 'failed') AS f, count(*) FILTER (status = 'partial_success') AS p, count(*) FILTER (status IN ('success', 'skipped_duplicate')) AS ok FROM manifest GROUP BY 1)""")
def cli_status(spark, d):
    """What the command line says of each run, and its exit code."""
    n = lambda *s: F.count(F.when(F.col("status").isin(*s), 1))
    g = table(spark, d, "manifest", "run_id", "status").groupBy("run_id").agg(n("failed").alias("f"), n("partial_success").alias("p"), n("success", "skipped_duplicate").alias("ok"))
    bad = (F.col("f") > 0) & (F.col("ok") == 0) & (F.col("p") == 0)
    return g.select("run_id", F.when(bad, "error").when((F.col("f") > 0) | (F.col("p") > 0), "warning").otherwise("ok").alias("status"), F.when(bad, 1).otherwise(0).alias("exit_code"))


#: Roles of paths by their beginning, then by their ending.
_ROLES = (("приказы/", "order"), ("методики/", "method"), ("письма/", "letter"), ("сметы/", "estimate"))
_ENDINGS = (("docx", "text"), ("pdf", "page"), ("xlsx", "table"))


@query("SELECT DISTINCT relative_path, CASE " + " ".join(f"WHEN starts_with(lower(relative_path), '{p}') THEN '{r}'" for p, r in _ROLES) + " " + " ".join(f"WHEN ends_with(lower(relative_path), '.{e}') THEN '{r}'" for e, r in _ENDINGS) + " ELSE 'unknown' END AS role FROM manifest WHERE relative_path IS NOT NULL")
def path_roles(spark, d):
    p = F.lower("relative_path")
    role = F.coalesce(*[F.when(p.startswith(b), r) for b, r in _ROLES], *[F.when(p.endswith("." + e), r) for e, r in _ENDINGS], F.lit("unknown"))
    return table(spark, d, "manifest", "relative_path").where("relative_path is not null").distinct().withColumn("role", role)


@query("""SELECT document_id, run_id, problem FROM (SELECT DISTINCT document_id, run_id, unnest([CASE WHEN document_id IS NULL OR NOT regexp_full_match(document_id, 'sha256:[0-9a-f]{64}') THEN 'document_id' END, CASE WHEN coalesce(len(units), 0) = 0 THEN 'units' END, CASE WHEN coalesce(processing.status, '') NOT IN ('success', 'partial_success', 'failed') THEN 'status' END, CASE WHEN source.sha256 IS NOT NULL AND document_id <> 'sha256:' || source.sha256 THEN 'sha256' END, CASE WHEN metadata IS NULL OR metadata.confidence IS NULL OR metadata.confidence NOT IN ('high', 'medium', 'low') THEN 'confidence' END, CASE WHEN schema_version IS NULL THEN 'schema_version' END]) AS problem FROM packages) WHERE problem IS NOT NULL""")
def package_validate(spark, d):
    c = F.col
    checks = F.array(
        F.when(c("document_id").isNull() | ~c("document_id").rlike("^sha256:[0-9a-f]{64}$"), "document_id"), F.when(F.coalesce(F.size("units"), F.lit(0)) <= 0, "units"),
        F.when(~F.coalesce("processing.status", F.lit("")).isin("success", "partial_success", "failed"), "status"), F.when(c("source.sha256").isNotNull() & (c("document_id") != F.concat(F.lit("sha256:"), "source.sha256")), "sha256"),
        F.when(~F.coalesce(c("metadata.confidence").isin("high", "medium", "low"), F.lit(False)), "confidence"), F.when(c("schema_version").isNull(), "schema_version"),
    )
    return table(spark, d, "packages").select("document_id", "run_id", F.explode(F.array_compact(checks)).alias("problem")).distinct()


_FLOOR_SQL = "greatest(100, least(coalesce(size_bytes, 0) // 300, 5000))"


@query(f"""WITH f AS (SELECT DISTINCT run_id, relative_path, CASE WHEN coalesce(search_text_chars, 0) = 0 THEN 'empty_text' WHEN route IN ('docx_native', 'pdf_text') AND search_text_chars < {_FLOOR_SQL} THEN 'short_extraction' ELSE '' END AS flag, coalesce(array_to_string(list_filter(['empty_text', 'ocr_failed', 'ocr_unavailable', 'asset_extraction_warning', 'rotated_text'], lambda s: list_contains(warnings, s)), ','), '') AS severe FROM manifest)
SELECT run_id, relative_path, flag, severe, flag = 'empty_text' OR severe <> '' AS review_required FROM f""")
def quality_flags_by_route(spark, d):
    """Flags of a file's text: empty alone, or too short for its size on the routes that read text; severe ones call for review."""
    floor = F.greatest(F.lit(100), F.least(F.floor(F.coalesce("size_bytes", F.lit(0)) / 300), F.lit(5000)))
    flag = F.when(F.coalesce("search_text_chars", F.lit(0)) == 0, "empty_text").when(F.col("route").isin("docx_native", "pdf_text") & (F.col("search_text_chars") < floor), "short_extraction").otherwise("")
    severe = F.coalesce(F.array_join(F.filter(F.array(*map(F.lit, SEVERE)), lambda s: F.array_contains("warnings", s)), ","), F.lit(""))
    f = table(spark, d, "manifest", "run_id", "relative_path", "search_text_chars", "route", "size_bytes", "warnings").select("run_id", "relative_path", flag.alias("flag"), severe.alias("severe")).distinct()
    return f.withColumn("review_required", (F.col("flag") == "empty_text") | (F.col("severe") != ""))


@query("""WITH x AS (SELECT DISTINCT source.sha256 AS sha256, processing.route AS expected FROM packages WHERE source.sha256 IS NOT NULL), m AS (SELECT sha256, max(status IN ('success', 'partial_success')) AS ran, min(route) AS route FROM manifest WHERE sha256 IS NOT NULL GROUP BY 1), u AS (SELECT DISTINCT document_id FROM document_units)
SELECT x.sha256, x.expected, CASE WHEN m.sha256 IS NULL THEN 'missing_sample' WHEN NOT coalesce(ran, false) THEN 'missing_run' WHEN u.document_id IS NULL THEN 'missing_document' WHEN x.expected <> m.route THEN 'route' END AS issue FROM x LEFT JOIN m ON m.sha256 = x.sha256 LEFT JOIN u ON u.document_id = 'sha256:' || x.sha256""")
def expectation_join(spark, d):
    """Expected files beside the manifest and the units; what misses first is the issue."""
    x = table(spark, d, "packages", F.col("source.sha256").alias("sha256"), F.col("processing.route").alias("expected")).where("sha256 is not null").distinct()
    m = table(spark, d, "manifest", "sha256", "status", "route").where("sha256 is not null").groupBy("sha256").agg(F.max(F.col("status").isin(*_DONE)).alias("ran"), F.min("route").alias("route"), F.lit(True).alias("listed"))
    u = table(spark, d, "document_units", "document_id").where("document_id like 'sha256:%'").select(F.expr("substring(document_id, 8)").alias("sha256")).distinct().withColumn("made", F.lit(True))
    issue = F.when(F.col("listed").isNull(), "missing_sample").when(~F.coalesce("ran", F.lit(False)), "missing_run").when(F.col("made").isNull(), "missing_document").when(F.col("expected") != F.col("route"), "route")
    return x.join(m, "sha256", "left").join(u, "sha256", "left").select("sha256", "expected", issue.alias("issue"))


@query(f"""SELECT document_id, unit_order // {ordered.STRETCH} AS stretch, count(*) AS units, string_agg(unit_id || ':' || coalesce(type, ''), ' ' ORDER BY unit_order, unit_id, type) AS listing FROM (SELECT DISTINCT document_id, unit_id, type, coalesce(unit_order, 0) AS unit_order FROM document_units WHERE unit_id IS NOT NULL) GROUP BY 1, 2""")
def document_assembly(spark, d):
    """The units of a document in their order, a row for each stretch of the order, so no document becomes one row."""
    u = table(spark, d, "document_units", "document_id", "unit_id", "type", F.coalesce("unit_order", F.lit(0)).alias("unit_order")).where("unit_id is not null").distinct()
    items = F.transform(F.sort_array(F.collect_list(F.struct("unit_order", "unit_id", "type"))), lambda x: F.concat(x.unit_id, F.lit(":"), F.coalesce(x.type, F.lit(""))))
    return u.groupBy("document_id", F.floor(F.col("unit_order") / ordered.STRETCH).alias("stretch")).agg(F.count("*").alias("units"), F.array_join(items, " ").alias("listing"))


@query("""WITH p AS (SELECT document_id, run_id, received_at, units, row_number() OVER () AS k FROM packages), u AS (SELECT document_id, run_id, received_at, k, unnest(units) AS u, unnest(range(1, len(units) + 1)) AS i FROM p)
SELECT document_id, run_id, received_at, u.unit_id AS unit_id, (row_number() OVER (PARTITION BY k ORDER BY coalesce(u.unit_order, 0), i) - 1)::INT AS position FROM u WHERE u IS NOT NULL""")
def unit_sort(spark, d):
    """The units of each delivery by their order, null as 0; equal ones stay as they came."""
    kept = F.filter(F.transform("units", lambda u, i: F.when(u.isNotNull(), F.struct(F.coalesce(u.unit_order, F.lit(0)).alias("o"), i.alias("i"), u.unit_id.alias("unit_id")))), lambda x: x.isNotNull())
    return table(spark, d, "packages", "document_id", "run_id", "received_at", "units").select("document_id", "run_id", "received_at", F.posexplode(F.array_sort(kept)).alias("position", "u")).select("document_id", "run_id", "received_at", "u.unit_id", "position")


@query("""WITH s AS (SELECT run_id, unnest([run_id, agent_id, task_id, parent_run_id]) AS v, unnest([1, 2, 3, 4]) AS i FROM runs), k AS (SELECT run_id, v, min(i) AS i FROM s WHERE length(v) >= 4 GROUP BY 1, 2)
SELECT run_id, string_agg(v, ' ' ORDER BY length(v) DESC, i) AS secrets FROM k GROUP BY 1""")
def secret_order(spark, d):
    """Values of four characters or more, the longest first; equal lengths as they came, equal values once."""
    values = F.array_distinct(F.filter(F.array("run_id", "agent_id", "task_id", "parent_run_id"), lambda v: F.length(v) >= 4))
    keyed = F.transform(values, lambda v, i: F.struct((-F.length(v)).alias("n"), i.alias("i"), v.alias("v")))
    return table(spark, d, "runs").select("run_id", F.array_join(F.transform(F.array_sort(keyed), lambda x: x.v), " ").alias("secrets"))


@query("""WITH e AS (SELECT run_id, count(DISTINCT relative_path) AS started, count(DISTINCT relative_path) FILTER (event <> 'document_started') AS ended FROM run_log WHERE run_id IS NOT NULL GROUP BY 1) SELECT run_id, started, ended, CASE WHEN started > 0 THEN greatest(0, least(5, round_even(5 * ended / started, 0)))::INT ELSE 0 END AS score FROM e""")
def score_0_5(spark, d):
    e = table(spark, d, "run_log", "run_id", "relative_path", "event").where("run_id is not null and relative_path is not null").groupBy("run_id", "relative_path").agg(F.max((F.col("event") != "document_started").cast("int")).alias("ended"))
    g = e.groupBy("run_id").agg(F.count("*").alias("started"), F.sum("ended").alias("ended"))
    return table(spark, d, "run_log", "run_id").where("run_id is not null").distinct().join(g, "run_id", "left").select("run_id", F.coalesce("started", F.lit(0)).alias("started"), F.coalesce("ended", F.lit(0)).alias("ended"), F.when(F.col("started") > 0, F.greatest(F.lit(0), F.least(F.lit(5), F.bround(5 * F.col("ended") / F.col("started"), 0)))).otherwise(0).cast("int").alias("score"))


@query("""SELECT source, coalesce(string_agg(DISTINCT lang, ',' ORDER BY lang), '') AS requested, coalesce(string_agg(DISTINCT lang, ',' ORDER BY lang) FILTER (lang NOT IN ('ru', 'en')), '') AS missing FROM documents WHERE source IS NOT NULL GROUP BY 1""")
def ocr_language_gap(spark, d):
    """The languages of each source, and those that are asked for but not installed (Russian and English are)."""
    langs = table(spark, d, "documents", "source", "lang").where("source is not null").distinct().groupBy("source").agg(F.sort_array(F.collect_set("lang")).alias("l"))
    return langs.select("source", F.array_join("l", ",").alias("requested"), F.array_join(F.array_except("l", F.array(F.lit("ru"), F.lit("en"))), ",").alias("missing"))


@query("""SELECT doc_id, (unnest(range(1, len(string_split(coalesce(text, ''), chr(12))) + 1)))::INT AS page, length(unnest(string_split(coalesce(text, ''), chr(12))))::INT AS chars, CASE WHEN text IS NULL THEN 'unavailable' WHEN regexp_matches(text, '[^\\s]') THEN 'success' ELSE 'failed' END AS status FROM documents""")
def scan_units(spark, d):
    """Pages of what a scan gave, parted at form feeds and left as they are; nothing read is unavailable, only blanks failed."""
    status = F.when(F.col("text").isNull(), "unavailable").when(F.col("text").rlike(r"[^\s]"), "success").otherwise("failed")
    pages = table(spark, d, "documents", "doc_id", "text").select("doc_id", status.alias("status"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\f")).alias("p", "t"))
    return pages.select("doc_id", (F.col("p") + 1).alias("page"), F.length("t").alias("chars"), "status")


@query("""WITH u AS (SELECT document_id, flag FROM (SELECT document_id, unnest(list_concat(coalesce(quality.flags, []), coalesce(quality.warnings, []))) AS flag FROM document_units) WHERE flag IS NOT NULL),
f AS (SELECT document_id, count(*) FILTER (coalesce(formula.confidence, '') <> 'high' OR coalesce(trim(formula.calc_expr, ' '), '') = '') AS marked FROM (SELECT DISTINCT document_id, unit_id, formula FROM document_units WHERE formula IS NOT NULL AND type IN ('formula', 'formula_image')) GROUP BY 1)
SELECT d.document_id, coalesce(marked, 0) > 0 OR severe AS review_required, coalesce(marked, 0) AS units_marked, reasons FROM (SELECT document_id, coalesce(bool_or(flag IN ('empty_text', 'ocr_failed', 'ocr_unavailable', 'asset_extraction_warning', 'rotated_text', 'review_required')), false) AS severe, coalesce(string_agg(DISTINCT flag, ',' ORDER BY flag), '') AS reasons FROM (SELECT DISTINCT document_id FROM document_units) LEFT JOIN u USING (document_id) GROUP BY 1) d LEFT JOIN f ON f.document_id = d.document_id""")
def review_propagation(spark, d):
    """Review marks go from units to their document: flags and warnings of all units once each, and how many formulas
    need a look because they aren't calculable or not sure."""
    u = table(spark, d, "document_units", "document_id", "unit_id", "type", "formula", "quality")
    flags = u.select("document_id", F.explode(F.concat(F.coalesce("quality.flags", F.array().cast("array<string>")), F.coalesce("quality.warnings", F.array().cast("array<string>")))).alias("flag")).where("flag is not null").distinct()
    own = flags.groupBy("document_id").agg(F.max(F.col("flag").isin(*SEVERE, "review_required")).alias("severe"), F.array_join(F.sort_array(F.collect_set("flag")), ",").alias("reasons"))
    open_ = (F.coalesce("confidence", F.lit("")) != "high") | (F.coalesce(F.trim("calc_expr"), F.lit("")) == "")
    f = u.where("formula is not null and type in ('formula', 'formula_image')").select("document_id", "unit_id", F.to_json("formula").alias("f"), F.col("formula.confidence").alias("confidence"), F.col("formula.calc_expr").alias("calc_expr")).distinct().groupBy("document_id").agg(F.count(F.when(open_, 1)).alias("marked"))
    docs = u.select("document_id").where("document_id is not null").distinct()
    marked = F.coalesce("marked", F.lit(0))
    return docs.join(own, "document_id", "left").join(f, "document_id", "left").select("document_id", ((marked > 0) | F.coalesce("severe", F.lit(False))).alias("review_required"), marked.alias("units_marked"), F.coalesce("reasons", F.lit("")).alias("reasons"))


@query(f"""SELECT m.run_id, m.relative_path, coalesce(p.title, m.relative_path) AS title, '<tr><td>' || replace(replace(replace(coalesce(p.title, m.relative_path), '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</td><td>' || coalesce(m.status, '') || '</td></tr>' AS row FROM {_M} m LEFT JOIN (SELECT source.sha256 AS sha256, min(metadata.title) AS title FROM packages GROUP BY 1) p ON p.sha256 = m.sha256""")
def render_index(spark, d):
    """The rows of a run's index: each file with its document's title where there is one."""
    p = table(spark, d, "packages", F.col("source.sha256").alias("sha256"), F.col("metadata.title").alias("t")).where("sha256 is not null").groupBy("sha256").agg(F.min("t").alias("t"))
    m = _files(spark, d).join(p, "sha256", "left").withColumn("title", F.coalesce("t", "relative_path"))
    safe: Column = F.col("title")
    for raw, html in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        safe = F.replace(safe, F.lit(raw), F.lit(html))
    return m.select("run_id", "relative_path", "title", F.concat(F.lit("<tr><td>"), safe, F.lit("</td><td>"), F.coalesce("status", F.lit("")), F.lit("</td></tr>")).alias("row"))
