"""Inventory, manifests, event logs: scans, duplicates, resumption, histograms, checks between tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docweave.operators import ordered
from docweave.plans.register import Registry
from docweave.sources.tables import table

_R = Registry()
QUERIES, SQL, query = _R.queries, _R.sql, _R.add
_FILES = ("relative_path", "filename", "format", "size_bytes", "sha256", "route", "status")


def _files(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return table(spark, d, "manifest", *(columns or _FILES)).distinct()


@query("SELECT DISTINCT relative_path, filename, format, size_bytes FROM manifest WHERE filename NOT LIKE '~$%'")
def inventory_scan(spark, d):
    return _files(spark, d, "relative_path", "filename", "format", "size_bytes").where(~F.col("filename").startswith("~$"))


@query("SELECT doc_id, sha256(text) AS sha256, strlen(text) AS size_bytes FROM documents WHERE text IS NOT NULL")
def content_fingerprint(spark, d):
    return table(spark, d, "documents", "doc_id", "text").where("text is not null").select("doc_id", F.sha2("text", 256).alias("sha256"), F.octet_length("text").cast("long").alias("size_bytes"))


@query("""WITH f AS (SELECT DISTINCT relative_path, filename, sha256, size_bytes, lower(regexp_extract(filename, '\\.([^.]+)$', 1)) IN ('docx', 'pdf', 'xlsx') AS supported FROM manifest WHERE filename IS NOT NULL AND filename NOT LIKE '~$%'),
g AS (SELECT sha256, min((lower(relative_path), relative_path)) AS p, count(*) AS n FROM f WHERE supported AND sha256 IS NOT NULL GROUP BY 1)
SELECT relative_path, f.sha256, size_bytes, supported, CASE WHEN NOT supported THEN 'unsupported_suffix' END AS warning, CASE WHEN supported AND n > 1 THEN 'sha256:' || f.sha256 END AS duplicate_group_id, CASE WHEN supported AND n > 1 AND p[2] <> relative_path THEN p[2] END AS duplicate_of FROM f LEFT JOIN g ON g.sha256 = f.sha256""")
def inventory_build(spark, d):
    """Every file with whether it is supported, and among supported ones the first path of each content as its primary;
    found by a partial aggregate, so no content fills a task. Rows have no order; path_sort gives one."""
    f = _files(spark, d, "relative_path", "filename", "sha256", "size_bytes").where("filename is not null and not startswith(filename, '~$')")
    f = f.withColumn("supported", F.lower(F.regexp_extract("filename", r"\.([^.]+)$", 1)).isin("docx", "pdf", "xlsx"))
    first = f.where("supported and sha256 is not null").groupBy("sha256").agg(F.min(F.struct(F.lower("relative_path").alias("k"), "relative_path")).alias("p"), F.count("*").alias("n")).where("n > 1")
    joined = f.join(first, "sha256", "left")
    primary, group = F.col("p.relative_path"), F.col("supported") & F.col("n").isNotNull()
    return joined.select("relative_path", "sha256", "size_bytes", "supported", F.when(~F.col("supported"), "unsupported_suffix").alias("warning"), F.when(group, F.concat(F.lit("sha256:"), "sha256")).alias("duplicate_group_id"), F.when(group & (primary != F.col("relative_path")), primary).alias("duplicate_of"))


@query("""WITH f AS (SELECT DISTINCT relative_path, sha256 FROM manifest WHERE sha256 IS NOT NULL),
g AS (SELECT sha256, min((lower(relative_path), relative_path)) AS p, count(*) AS n FROM f GROUP BY 1)
SELECT f.relative_path, 'sha256:' || f.sha256 AS duplicate_group_id, p[2] AS primary_path, p[2] = f.relative_path AS is_primary FROM f JOIN g USING (sha256) WHERE n > 1""")
def duplicate_primary(spark, d):
    f = _files(spark, d, "relative_path", "sha256").where("sha256 is not null")
    g = f.groupBy("sha256").agg(F.min(F.struct(F.lower("relative_path").alias("k"), "relative_path")).alias("p"), F.count("*").alias("n")).where("n > 1")
    return f.join(g, "sha256").select("relative_path", F.concat(F.lit("sha256:"), "sha256").alias("duplicate_group_id"), F.col("p.relative_path").alias("primary_path"), (F.col("p.relative_path") == F.col("relative_path")).alias("is_primary"))


@query("SELECT count(*) AS groups, coalesce(sum(n), 0)::BIGINT AS members FROM (SELECT sha256, count(DISTINCT relative_path) AS n FROM manifest WHERE sha256 IS NOT NULL GROUP BY 1 HAVING count(DISTINCT relative_path) > 1)")
def duplicate_groups(spark, d):
    g = _files(spark, d, "relative_path", "sha256").where("sha256 is not null and relative_path is not null").groupBy("sha256").agg(F.count("*").alias("n")).where("n > 1")
    return g.agg(F.count("*").alias("groups"), F.coalesce(F.sum("n"), F.lit(0)).alias("members"))


@query("""SELECT DISTINCT relative_path, CASE lower(regexp_extract(filename, '\\.([^.]+)$', 1)) WHEN 'docx' THEN 'docx_native' WHEN 'pdf' THEN CASE WHEN coalesce(search_text_chars, 0) >= 200 THEN 'pdf_text' ELSE 'pdf_scan' END WHEN 'xlsx' THEN 'xlsx_native' ELSE 'not_classified' END AS route,
CASE WHEN lower(regexp_extract(filename, '\\.([^.]+)$', 1)) IN ('docx', 'pdf', 'xlsx') THEN '' ELSE 'unsupported_suffix' END AS warning FROM manifest WHERE filename IS NOT NULL""")
def route_classify(spark, d):
    suffix = F.lower(F.regexp_extract("filename", r"\.([^.]+)$", 1))
    pdf = F.when(F.coalesce("search_text_chars", F.lit(0)) >= 200, "pdf_text").otherwise("pdf_scan")
    route = F.coalesce(F.when(suffix == "docx", "docx_native"), F.when(suffix == "pdf", pdf), F.when(suffix == "xlsx", "xlsx_native"), F.lit("not_classified"))
    return table(spark, d, "manifest", "relative_path", "filename", "search_text_chars").where("filename is not null").select("relative_path", route.alias("route"), F.when(route == "not_classified", "unsupported_suffix").otherwise("").alias("warning")).distinct()


@query("""SELECT document_id, sum(length(trim(text)))::BIGINT AS chars, CASE WHEN sum(length(trim(text))) >= 200 THEN 'pdf_text' ELSE 'pdf_scan' END AS route
FROM (SELECT DISTINCT document_id, unit_id, text, source_ref.page AS page FROM document_units) WHERE page BETWEEN 1 AND 5 AND text IS NOT NULL GROUP BY 1""")
def pdf_route_probe(spark, d):
    u = table(spark, d, "document_units", "document_id", "unit_id", "text", F.col("source_ref.page").alias("page")).where("page between 1 and 5 and text is not null").distinct()
    g = u.groupBy("document_id").agg(F.sum(F.length(F.trim("text"))).alias("chars"))
    return g.withColumn("route", F.when(F.col("chars") >= 200, "pdf_text").otherwise("pdf_scan"))


@query("SELECT DISTINCT relative_path, filename, lower(regexp_extract(filename, '\\.([^.]+)$', 1)) AS extension, regexp_replace(filename, '\\.[^.]+$', '') AS stem, regexp_replace(regexp_replace(filename, '\\.[^.]+$', ''), '[ _-]*(rev|ред|v)[ ._-]*[0-9]+$', '', 'i') AS base FROM manifest WHERE filename IS NOT NULL")
def filename_parts(spark, d):
    stem = F.regexp_replace("filename", r"\.[^.]+$", "")
    return _files(spark, d, "relative_path", "filename").where("filename is not null").select("relative_path", "filename", F.lower(F.regexp_extract("filename", r"\.([^.]+)$", 1)).alias("extension"), stem.alias("stem"), F.regexp_replace(stem, r"(?iu)[ _-]*(rev|ред|v)[ ._-]*[0-9]+$", "").alias("base"))


@query("""WITH m AS (SELECT run_id, relative_path, max(sha256) AS sha256, max(status) AS status, max(duplicate_of) AS duplicate_of, max(output_dir) AS output_dir, max(units_count) AS units_count FROM manifest GROUP BY 1, 2)
SELECT a.run_id, a.relative_path, a.status, a.duplicate_of, coalesce(b.output_dir, a.output_dir) AS output_dir, coalesce(b.units_count, a.units_count) AS units_count FROM m a LEFT JOIN m b ON b.run_id = a.run_id AND b.relative_path = a.duplicate_of WHERE a.duplicate_of IS NOT NULL""")
def duplicate_inherit(spark, d):
    m = table(spark, d, "manifest", "run_id", "relative_path", "status", "duplicate_of", "output_dir", "units_count").groupBy("run_id", "relative_path").agg(*[F.max(c).alias(c) for c in ("status", "duplicate_of", "output_dir", "units_count")])
    p = m.select("run_id", F.col("relative_path").alias("duplicate_of"), F.col("output_dir").alias("p_dir"), F.col("units_count").alias("p_units"))
    out = m.where("duplicate_of is not null").join(p, ["run_id", "duplicate_of"], "left")
    return out.select("run_id", "relative_path", "status", "duplicate_of", F.coalesce("p_dir", "output_dir").alias("output_dir"), F.coalesce("p_units", "units_count").alias("units_count"))


@query("SELECT sha256, relative_path, max(run_id) AS run_id, arg_max(status, run_id) AS status FROM manifest WHERE status IN ('success', 'partial_success') AND sha256 IS NOT NULL GROUP BY 1, 2")
def latest_run(spark, d):
    m = table(spark, d, "manifest", "sha256", "relative_path", "run_id", "status").where(F.col("status").isin("success", "partial_success") & F.col("sha256").isNotNull())
    return m.groupBy("sha256", "relative_path").agg(F.max(F.struct("run_id", "status")).alias("w")).select("sha256", "relative_path", "w.run_id", "w.status")


@query("""WITH h AS (SELECT sha256, relative_path, run_id FROM (SELECT DISTINCT sha256, relative_path, run_id FROM manifest WHERE status = 'success' AND sha256 IS NOT NULL)),
c AS (SELECT DISTINCT run_id, sha256, relative_path FROM manifest WHERE sha256 IS NOT NULL)
SELECT c.run_id, c.relative_path, max(h.run_id) AS resumed_from FROM c LEFT JOIN h ON h.sha256 = c.sha256 AND h.relative_path = c.relative_path AND h.run_id < c.run_id GROUP BY 1, 2""")
def resume_join(spark, d):
    """The newest earlier run that converted the same content at the same path, by one window instead of a range join."""
    c = table(spark, d, "manifest", "run_id", "sha256", "relative_path", "status").where("sha256 is not null").groupBy("run_id", "sha256", "relative_path").agg(F.max(F.when(F.col("status") == "success", F.col("run_id"))).alias("ok"))
    earlier = Window.partitionBy("sha256", "relative_path").orderBy("run_id").rowsBetween(Window.unboundedPreceding, -1)
    return c.withColumn("r", F.max("ok").over(earlier)).groupBy("run_id", "relative_path").agg(F.max("r").alias("resumed_from"))


_SUMMED = (("success", "status = 'success'"), ("partial", "status = 'partial_success'"), ("failed", "status = 'failed'"), ("duplicates", "status = 'skipped_duplicate'"), ("unsupported", "status = 'skipped_unsupported'"), ("units", None), ("pages", None))
_REASON_SQL = "SELECT run_id, string_agg(reason || '=' || n, ';' ORDER BY reason) AS {1} FROM (SELECT run_id, reason, count(*) AS n FROM (SELECT DISTINCT run_id, relative_path, {0} AS reason FROM manifest WHERE relative_path IS NOT NULL) WHERE reason <> '' GROUP BY 1, 2) GROUP BY 1"


@query(f"""WITH m AS (SELECT run_id, relative_path, max(status) AS status, max(coalesce(units_count, 0)) AS units, max(coalesce(pages, 0)) AS pages FROM manifest WHERE relative_path IS NOT NULL GROUP BY 1, 2),
c AS (SELECT run_id, count(*) AS files, {', '.join(f"count(*) FILTER ({c}) AS {n}" if c else f"sum({n})::BIGINT AS {n}" for n, c in _SUMMED)} FROM m GROUP BY 1),
w AS ({_REASON_SQL.format("unnest(warnings)", "warning_reasons")}), e AS ({_REASON_SQL.format("error", "error_reasons")}), o AS ({_REASON_SQL.format("route", "routes")})
SELECT r.run_id, r.tool_version, coalesce(files, 0) AS files, {', '.join(f"coalesce({n}, 0) AS {n}" for n, _ in _SUMMED)}, coalesce(warning_reasons, '') AS warning_reasons, coalesce(error_reasons, '') AS error_reasons, coalesce(routes, '') AS routes FROM runs r LEFT JOIN c USING (run_id) LEFT JOIN w USING (run_id) LEFT JOIN e USING (run_id) LEFT JOIN o USING (run_id)""")
def run_summary(spark, d):
    """Eight counters of each run, and how often each warning, error and route occurs in its files."""
    m = table(spark, d, "manifest", "run_id", "relative_path", "status", "units_count", "pages", "warnings", "error", "route").where("relative_path is not null")
    # one row per file first, so a run with most of the rows is counted in many tasks
    f = m.groupBy("run_id", "relative_path").agg(F.max("status").alias("status"), F.max(F.coalesce("units_count", F.lit(0))).alias("units"), F.max(F.coalesce("pages", F.lit(0))).alias("pages"))
    counters = f.groupBy("run_id").agg(F.count("*").alias("files"), *[F.count(F.when(F.expr(c), 1)).alias(n) if c else F.sum(n).alias(n) for n, c in _SUMMED])

    def reasons(value: Column, name: str) -> DataFrame:
        each = m.select("run_id", "relative_path", value.alias("reason")).distinct().where("reason <> ''").groupBy("run_id", "reason").agg(F.count("*").alias("n"))
        return each.groupBy("run_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("reason", "n"))), lambda x: F.concat(x.reason, F.lit("="), x.n.cast("string"))), ";").alias(name))

    out = table(spark, d, "runs", "run_id", "tool_version").join(counters, "run_id", "left")
    for value, name in ((F.explode("warnings"), "warning_reasons"), (F.col("error"), "error_reasons"), (F.col("route"), "routes")):
        out = out.join(reasons(value, name), "run_id", "left")
    return out.select("run_id", "tool_version", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("files", *[n for n, _ in _SUMMED])], *[F.coalesce(c, F.lit("")).alias(c) for c in ("warning_reasons", "error_reasons", "routes")])


@query("""SELECT run_id, CASE WHEN f > 0 AND ok = 0 THEN 'failed' WHEN f > 0 OR p > 0 THEN 'partial_success' ELSE 'success' END AS status
FROM (SELECT run_id, count(*) FILTER (status = 'failed') AS f, count(*) FILTER (status = 'partial_success') AS p, count(*) FILTER (status IN ('success', 'skipped_duplicate')) AS ok FROM manifest GROUP BY 1)""")
def run_status(spark, d):
    n = lambda *s: F.count(F.when(F.col("status").isin(*s), 1))
    g = table(spark, d, "manifest", "run_id", "status").groupBy("run_id").agg(n("failed").alias("f"), n("partial_success").alias("p"), n("success", "skipped_duplicate").alias("ok"))
    return g.select("run_id", F.when((F.col("f") > 0) & (F.col("ok") == 0), "failed").when((F.col("f") > 0) | (F.col("p") > 0), "partial_success").otherwise("success").alias("status"))


@query("SELECT reason, count(*) AS n FROM (SELECT trim(unnest(warnings)) AS reason FROM manifest) WHERE reason <> '' GROUP BY 1")
def reason_histogram(spark, d):
    return table(spark, d, "manifest", "warnings").select(F.explode("warnings").alias("reason")).select(F.trim("reason").alias("reason")).where("reason <> ''").groupBy("reason").agg(F.count("*").alias("n"))


@query("SELECT reason, sum(n)::BIGINT AS n FROM (SELECT unnest(warnings) AS reason, 1 AS n FROM manifest UNION ALL SELECT unnest(warnings), 1 FROM run_log UNION ALL SELECT unnest(warnings), 1 FROM scan_results) WHERE reason IS NOT NULL GROUP BY 1")
def counter_merge(spark, d):
    one = lambda t: table(spark, d, t, "warnings").select(F.explode("warnings").alias("reason")).where("reason is not null").groupBy("reason").agg(F.count("*").alias("n"))
    return one("manifest").unionByName(one("run_log")).unionByName(one("scan_results")).groupBy("reason").agg(F.sum("n").alias("n"))


@query("SELECT coalesce(route, '') AS route, coalesce(lower(format), '') AS format, count(*) AS files, coalesce(sum(size_bytes), 0)::BIGINT AS size_bytes, GROUPING(route)::INT AS all_routes FROM (SELECT DISTINCT run_id, relative_path, route, format, size_bytes FROM manifest) GROUP BY GROUPING SETS ((route, lower(format)), (lower(format)), ())")
def dry_run_counts(spark, d):
    files = table(spark, d, "manifest", "run_id", "relative_path", "route", "format", "size_bytes").distinct().withColumn("fmt", F.lower("format"))
    out = files.groupingSets([["route", "fmt"], ["fmt"], []], "route", "fmt").agg(F.count("*").alias("files"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("size_bytes"), F.grouping("route").cast("int").alias("all_routes"))
    return out.select(F.coalesce("route", F.lit("")).alias("route"), F.coalesce("fmt", F.lit("")).alias("format"), "files", "size_bytes", "all_routes")


@query("SELECT m.run_id, m.relative_path, m.status, d.filename, d.route AS package_route FROM (SELECT DISTINCT run_id, relative_path, status, sha256 FROM manifest) m JOIN (SELECT DISTINCT source.sha256 AS sha256, source.filename AS filename, processing.route AS route FROM packages) d ON d.sha256 = m.sha256")
def catalog_join(spark, d):
    p = table(spark, d, "packages", F.col("source.sha256").alias("sha256"), F.col("source.filename").alias("filename"), F.col("processing.route").alias("package_route")).distinct()
    return _files(spark, d, "run_id", "relative_path", "status", "sha256").join(p, "sha256").drop("sha256")


@query("SELECT DISTINCT relative_path AS name, 'manifest' AS origin FROM manifest WHERE relative_path IS NOT NULL UNION ALL SELECT DISTINCT source.relative_input_path, 'package' FROM packages WHERE source.relative_input_path IS NOT NULL")
def catalog_union(spark, d):
    a = _files(spark, d, "relative_path").where("relative_path is not null").select(F.col("relative_path").alias("name"), F.lit("manifest").alias("origin"))
    b = table(spark, d, "packages", F.col("source.relative_input_path").alias("name")).where("name is not null").distinct().withColumn("origin", F.lit("package"))
    return a.unionByName(b)


@query("SELECT DISTINCT p.document_id, p.processing.route AS route, m.route AS expected FROM packages p JOIN (SELECT DISTINCT sha256, route FROM manifest) m ON m.sha256 = p.source.sha256 WHERE p.processing.route <> m.route")
def route_mismatch(spark, d):
    p = table(spark, d, "packages", "document_id", F.col("processing.route").alias("route"), F.col("source.sha256").alias("sha256")).distinct()
    return p.join(_files(spark, d, "sha256", F.col("route").alias("expected")), "sha256").where("route <> expected").select("document_id", "route", "expected").distinct()


@query("SELECT DISTINCT 'run_log' AS child, run_id FROM run_log l WHERE run_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM runs r WHERE r.run_id = l.run_id) UNION ALL SELECT DISTINCT 'document_units', run_id FROM document_units l WHERE run_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM runs r WHERE r.run_id = l.run_id) UNION ALL SELECT DISTINCT 'parent_run', parent_run_id FROM runs l WHERE parent_run_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM runs r WHERE r.run_id = l.parent_run_id)")
def fk_violations(spark, d):
    runs = table(spark, d, "runs", "run_id")
    def miss(t: str, column: str, label: str) -> DataFrame:
        return table(spark, d, t, F.col(column).alias("run_id")).where("run_id is not null").distinct().join(runs, "run_id", "left_anti").select(F.lit(label).alias("child"), "run_id")
    return miss("run_log", "run_id", "run_log").unionByName(miss("document_units", "run_id", "document_units")).unionByName(miss("runs", "parent_run_id", "parent_run"))


@query("SELECT document_id FROM (SELECT DISTINCT 'sha256:' || sha256 AS document_id FROM manifest WHERE sha256 IS NOT NULL AND status = 'success') EXCEPT SELECT document_id FROM document_units")
def coverage_gap(spark, d):
    made = table(spark, d, "manifest", "sha256", "status").where("sha256 is not null and status = 'success'").select(F.concat(F.lit("sha256:"), "sha256").alias("document_id")).distinct()
    return made.join(table(spark, d, "document_units", "document_id").distinct(), "document_id", "left_anti")


@query("SELECT DISTINCT source AS missing FROM mix_targets WHERE source NOT IN (SELECT source FROM documents WHERE source IS NOT NULL)")
def missing_members(spark, d):
    return table(spark, d, "mix_targets", F.col("source").alias("missing")).distinct().join(table(spark, d, "documents", F.col("source").alias("missing")).distinct(), "missing", "left_anti").where("missing is not null")


@query("SELECT document_id, unit_id, count(*) AS n FROM document_units GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_keys(spark, d):
    return table(spark, d, "document_units", "document_id", "unit_id").groupBy("document_id", "unit_id").agg(F.count("*").alias("n")).where("n > 1")


@query("SELECT count(*) AS only_in_either FROM ((SELECT DISTINCT document_id FROM scan_results EXCEPT SELECT DISTINCT document_id FROM document_units) UNION ALL (SELECT DISTINCT 'sha256:' || sha256 FROM manifest WHERE route = 'pdf_scan' AND status = 'success' EXCEPT SELECT DISTINCT document_id FROM scan_results))")
def drift_check(spark, d):
    scans, units = table(spark, d, "scan_results", "document_id").distinct(), table(spark, d, "document_units", "document_id").distinct()
    made = table(spark, d, "manifest", "sha256", "route", "status").where("route = 'pdf_scan' and status = 'success'").select(F.concat(F.lit("sha256:"), "sha256").alias("document_id")).distinct()
    return scans.join(units, "document_id", "left_anti").unionByName(made.join(scans, "document_id", "left_anti")).agg(F.count("*").alias("only_in_either"))


@query("SELECT DISTINCT lower(relative_path) AS folded, relative_path, row_number() OVER (PARTITION BY run_id ORDER BY lower(relative_path), relative_path) AS position, run_id FROM (SELECT DISTINCT run_id, relative_path FROM manifest)")
def path_sort(spark, d):
    """The place of each path in its run. Runs are cut by range into stretches of paths, which are counted apart."""
    f = _files(spark, d, "run_id", "relative_path").withColumn("folded", F.lower("relative_path"))
    return ordered.ranked(f, ["run_id"], ["folded", "relative_path"], "position")


@query("SELECT logged_at, run_id, event, relative_path, CASE WHEN event LIKE '%failed%' THEN 'error' WHEN event LIKE '%partial%' OR event LIKE '%cancel%' THEN 'warning' ELSE 'info' END AS level FROM run_log")
def event_levels(spark, d):
    level = F.when(F.col("event").contains("failed"), "error").when(F.col("event").contains("partial") | F.col("event").contains("cancel"), "warning").otherwise("info")
    return table(spark, d, "run_log", "logged_at", "run_id", "event", "relative_path").withColumn("level", level)


@query("SELECT DISTINCT logged_at, run_id, event, nullif(trim(relative_path), '') AS relative_path, nullif(trim(status), '') AS status, nullif(error_type, '') AS error_type, coalesce(len(warnings), 0)::INT AS n_warnings, try_cast(size_bytes AS BIGINT) AS size_bytes FROM run_log")
def event_normalize(spark, d):
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    return table(spark, d, "run_log").select("logged_at", "run_id", "event", blank("relative_path").alias("relative_path"), blank("status").alias("status"), F.nullif("error_type", F.lit("")).alias("error_type"), F.when(F.col("warnings").isNull(), 0).otherwise(F.size("warnings")).alias("n_warnings"), "size_bytes").distinct()


@query("SELECT run_id, relative_path, max(logged_at) AS logged_at, arg_max(event, (logged_at, event)) AS event FROM run_log WHERE logged_at IS NOT NULL AND relative_path IS NOT NULL GROUP BY 1, 2")
def latest_event(spark, d):
    e = table(spark, d, "run_log", "run_id", "relative_path", "logged_at", "event").where("logged_at is not null and relative_path is not null")
    return e.groupBy("run_id", "relative_path").agg(F.max(F.struct("logged_at", "event")).alias("w")).select("run_id", "relative_path", "w.logged_at", "w.event")


@query("""SELECT run_id, logged_at, event, relative_path, count(*) FILTER (event <> 'document_started') OVER (PARTITION BY run_id ORDER BY logged_at, event, relative_path ROWS UNBOUNDED PRECEDING) AS processed
FROM (SELECT DISTINCT run_id, logged_at, event, relative_path FROM run_log WHERE logged_at IS NOT NULL AND relative_path IS NOT NULL)""")
def progress_curve(spark, d):
    """How many files of a run are processed by each event; a run of any size is counted in stretches of its time."""
    e = table(spark, d, "run_log", "run_id", "logged_at", "event", "relative_path").where("logged_at is not null and relative_path is not null").distinct()
    e = e.withColumn("second", F.unix_timestamp("logged_at"))
    counted = F.coalesce((F.col("event") != "document_started").cast("int"), F.lit(0))
    return ordered.running_sum(e, "run_id", ["second", "logged_at", "event", "relative_path"], counted, "processed").select("run_id", "logged_at", "event", "relative_path", "processed")


@query("SELECT date_trunc('day', logged_at) AS day, event, count(*) AS n FROM run_log WHERE logged_at >= (SELECT max(logged_at) FROM run_log) - INTERVAL 7 DAY GROUP BY 1, 2")
def date_window(spark, d):
    e = table(spark, d, "run_log", "logged_at", "event")
    latest = e.agg(F.max("logged_at").alias("latest"))  # one row
    recent = e.join(F.broadcast(latest)).where(F.col("logged_at") >= F.col("latest") - F.expr("INTERVAL 7 DAY"))
    return recent.groupBy(F.date_trunc("day", "logged_at").alias("day"), "event").agg(F.count("*").alias("n"))


@query("SELECT run_id, coalesce(nullif(trim(agent_id), ''), 'manual') AS agent_id, coalesce(nullif(trim(task_id), ''), run_id) AS task_id, coalesce(nullif(trim(tool_version), ''), 'unknown') AS tool_version, nullif(trim(parent_run_id), '') AS parent_run_id FROM runs")
def run_metadata_defaults(spark, d):
    given = lambda c: F.nullif(F.trim(c), F.lit(""))
    return table(spark, d, "runs").select("run_id", F.coalesce(given("agent_id"), F.lit("manual")).alias("agent_id"), F.coalesce(given("task_id"), "run_id").alias("task_id"), F.coalesce(given("tool_version"), F.lit("unknown")).alias("tool_version"), given("parent_run_id").alias("parent_run_id"))


@query("SELECT DISTINCT relative_path, greatest(100, least(coalesce(size_bytes, 0) // 300, 5000))::BIGINT AS text_floor, CASE WHEN coalesce(search_text_chars, 0) = 0 THEN 'empty_text' WHEN route IN ('docx_native', 'pdf_text') AND search_text_chars < greatest(100, least(coalesce(size_bytes, 0) // 300, 5000)) THEN 'short_extraction' ELSE '' END AS flag FROM manifest")
def quality_flags(spark, d):
    floor = F.greatest(F.lit(100), F.least(F.floor(F.coalesce("size_bytes", F.lit(0)) / 300), F.lit(5000))).cast("long")
    flag = F.when(F.coalesce("search_text_chars", F.lit(0)) == 0, "empty_text").when(F.col("route").isin("docx_native", "pdf_text") & (F.col("search_text_chars") < floor), "short_extraction").otherwise("")
    return table(spark, d, "manifest").select("relative_path", floor.alias("text_floor"), flag.alias("flag")).distinct()


@query("""WITH m AS (SELECT DISTINCT run_id, relative_path, status, sha256, error, coalesce(warnings, []) AS w FROM manifest), q AS (SELECT document_id, bool_or(f IN ('empty_text', 'ocr_failed', 'ocr_unavailable', 'asset_extraction_warning', 'rotated_text', 'review_required')) AS severe FROM (SELECT document_id, unnest(list_concat(coalesce(quality.flags, []), coalesce(quality.warnings, []))) AS f FROM document_units) WHERE document_id IS NOT NULL GROUP BY 1)
SELECT DISTINCT run_id, relative_path, status, array_to_string(list_sort(list_distinct(CASE WHEN status = 'failed' THEN list_append(w, coalesce(error, 'conversion_failed')) ELSE w END)), ';') AS warnings, coalesce(severe, false) AS flagged FROM m LEFT JOIN q ON q.document_id = 'sha256:' || m.sha256 WHERE status IN ('failed', 'partial_success') OR len(w) > 0 OR severe""")
def review_queue(spark, d):
    """Files to look at: failed or partial, with any warning, or with a severe flag in their units; a failure's error is a warning too."""
    severe = ("empty_text", "ocr_failed", "ocr_unavailable", "asset_extraction_warning", "rotated_text", "review_required")
    empty = F.array().cast("array<string>")
    m = table(spark, d, "manifest", "run_id", "relative_path", "status", "sha256", "error", F.coalesce("warnings", empty).alias("w")).distinct()
    marks = table(spark, d, "document_units", "document_id", "quality").where("document_id is not null").select("document_id", F.explode(F.concat(F.coalesce("quality.flags", empty), F.coalesce("quality.warnings", empty))).alias("f"))
    q = marks.where(F.col("f").isin(*severe)).select(F.expr("substring(document_id, 8)").alias("sha256"), F.lit(True).alias("severe")).distinct()
    said = F.when(F.col("status") == "failed", F.concat("w", F.array(F.coalesce("error", F.lit("conversion_failed"))))).otherwise(F.col("w"))
    out = m.join(q, "sha256", "left").where(F.col("status").isin("failed", "partial_success") | (F.size("w") > 0) | F.coalesce("severe", F.lit(False)))
    return out.select("run_id", "relative_path", "status", F.array_join(F.sort_array(F.array_distinct(said)), ";").alias("warnings"), F.coalesce("severe", F.lit(False)).alias("flagged")).distinct()


_CONTRACT = (
    ("document_id", "document_id IS NULL OR NOT {full}(document_id, 'sha256:[0-9a-f]{{64}}')"), ("metadata.confidence", "metadata.confidence IS NULL OR metadata.confidence NOT IN ('high', 'medium', 'low')"), ("metadata.title", "metadata.title IS NULL"),
    ("processing.route", "processing.route IS NULL OR processing.route NOT IN ('docx_native', 'pdf_text', 'pdf_scan', 'xlsx_native')"), ("processing.status", "processing.status IS NULL OR processing.status NOT IN ('success', 'partial_success', 'failed')"),
    ("schema_version", "schema_version IS NULL"), ("source.filename", "source.filename IS NULL OR source.filename = ''"), ("source.sha256", "source.sha256 IS NULL OR NOT {full}(source.sha256, '[0-9a-f]{{64}}')"), ("source.size_bytes", "source.size_bytes IS NULL OR source.size_bytes < 0"),
    ("units", "units IS NULL"), ("units.type", "{any_type}"), ("units.unit_id", "{any_id}"),
)


def _contract(full: str, any_type: str, any_id: str) -> str:
    checks = [f"CASE WHEN {c.format(full=full, any_type=any_type, any_id=any_id)} THEN '{p}' END" for p, c in _CONTRACT]
    return ", ".join(checks)


@query("WITH c AS (SELECT document_id, run_id, received_at, list_filter([" + _contract("regexp_full_match", "len(list_filter(units, lambda u: u IS NOT NULL AND u.type IS NULL)) > 0", "len(list_filter(units, lambda u: u IS NOT NULL AND u.unit_id IS NULL)) > 0") + "], lambda x: x IS NOT NULL) AS broken FROM packages) SELECT document_id, run_id, received_at, broken[1] AS first_error, len(broken)::INT AS errors FROM c")
def contract_violations(spark, d):
    """Each delivery against the contract of its record, nested fields too: the first broken path in their order, and how many."""
    checks = _contract("regexp_like", "exists(units, u -> u is not null and u.type is null)", "exists(units, u -> u is not null and u.unit_id is null)").replace("'sha256:[0-9a-f]{64}'", "'^sha256:[0-9a-f]{64}$'").replace("'[0-9a-f]{64}'", "'^[0-9a-f]{64}$'")
    broken = table(spark, d, "packages").select("document_id", "run_id", "received_at", F.array_compact(F.expr(f"array({checks})")).alias("broken"))
    return broken.select("document_id", "run_id", "received_at", F.get("broken", F.lit(0)).alias("first_error"), F.size("broken").alias("errors"))


@query("""WITH g AS (SELECT route, status, count(*) AS n FROM (SELECT DISTINCT run_id, relative_path, route, status FROM manifest) GROUP BY 1, 2)
SELECT route, status, n, round_even(n / sum(n) OVER (PARTITION BY route), 4) AS share, count(*) FILTER (status = 'failed') OVER (PARTITION BY route) = 0 AND count(*) FILTER (status IN ('success', 'partial_success')) OVER (PARTITION BY route) > 0 AS route_passed FROM g""")
def pilot_summary(spark, d):
    """Files by route and status with their share of the route; a route passes with something converted and nothing failed."""
    g = _files(spark, d, "run_id", "relative_path", "route", "status").groupBy("route", "status").agg(F.count("*").alias("n"))
    w = Window.partitionBy("route")  # a row per route and status
    has = lambda *s: F.count(F.when(F.col("status").isin(*s), 1)).over(w)
    return g.select("route", "status", "n", F.bround(F.col("n") / F.sum("n").over(w), 4).alias("share"), ((has("failed") == 0) & (has("success", "partial_success") > 0)).alias("route_passed"))


@query("SELECT document_id, asset_id, path, coalesce(media_type, CASE lower(regexp_extract(path, '\\.([^.]+)$', 1)) WHEN 'png' THEN 'image/png' WHEN 'jpg' THEN 'image/jpeg' WHEN 'jpeg' THEN 'image/jpeg' WHEN 'wmf' THEN 'image/x-wmf' WHEN 'emf' THEN 'image/x-emf' ELSE 'application/octet-stream' END) AS media_type, size_bytes FROM (SELECT DISTINCT document_id, a.asset_id AS asset_id, a.path AS path, a.media_type AS media_type, a.size_bytes AS size_bytes FROM (SELECT document_id, unnest(assets) AS a FROM packages) WHERE a IS NOT NULL)")
def asset_records(spark, d):
    a = table(spark, d, "packages", "document_id", "assets").select("document_id", F.inline("assets")).select("document_id", "asset_id", "path", "media_type", "size_bytes").distinct()
    kinds = {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "wmf": "image/x-wmf", "emf": "image/x-emf"}
    known = F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv])
    return a.select("document_id", "asset_id", "path", F.coalesce("media_type", known[F.lower(F.regexp_extract("path", r"\.([^.]+)$", 1))], F.lit("application/octet-stream")).alias("media_type"), "size_bytes")


@query("""WITH a AS (SELECT DISTINCT document_id, a.asset_id AS asset_id, a.path AS path, coalesce(a.size_bytes, 0) AS size_bytes FROM (SELECT document_id, unnest(assets) AS a FROM packages) WHERE a IS NOT NULL)
SELECT document_id, count(*) AS entries, sum(size_bytes)::BIGINT AS total_bytes, count(*) <= 4096 AND sum(size_bytes) <= 134217728 AND NOT bool_or(coalesce(path LIKE '/%' OR contains(path, '..') OR contains(path, chr(92)) OR regexp_matches(path, '^[A-Za-z]:'), false)) AS admitted FROM a GROUP BY 1""")
def archive_admission(spark, d):
    a = table(spark, d, "packages", "document_id", "assets").select("document_id", F.inline("assets")).select("document_id", "asset_id", "path", F.coalesce("size_bytes", F.lit(0)).alias("size_bytes")).distinct()
    unsafe = F.coalesce(F.col("path").startswith("/") | F.col("path").contains("..") | F.col("path").contains("\\") | F.col("path").rlike("^[A-Za-z]:"), F.lit(False))
    g = a.groupBy("document_id").agg(F.count("*").alias("entries"), F.sum("size_bytes").alias("total_bytes"), F.max(unsafe).alias("bad"))
    return g.select("document_id", "entries", "total_bytes", ((F.col("entries") <= 4096) & (F.col("total_bytes") <= 128 << 20) & ~F.col("bad")).alias("admitted"))
