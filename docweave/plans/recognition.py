"""Recognition of formulas and scans: responses, audit, text of scans, paragraph types, drawn formulas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docweave.functions import text as tx
from docweave.plans.formulas import _F, _formulas
from docweave.plans.register import Registry
from docweave.plans.units import _U, _units
from docweave.sources.tables import table

_R = Registry()
QUERIES, SQL, query = _R.queries, _R.sql, _R.add
_RESPONSE = "linear_text string, display_latex string, calc_expr string, confidence string"
# Signs of a formula in a line, beginnings of captions, and the longest formula line.
FORMULA_SIGNS = r"(^|\s)[A-Za-zА-Яа-я][\wА-Яа-я]*\s*=|[=∑√≤≥±×÷≈]|(^|[^\wА-Яа-яЁё])(sum|sqrt|frac)($|[^\wА-Яа-яЁё])"
CAPTION, FORMULA_CHARS = r"^(рис\.|рисунок|figure)\s", 180


def _responses(spark: SparkSession, d: str) -> DataFrame:
    """What a model answered for each formula: JSON in a fenced block or in the middle of a sentence, as models do."""
    f = _formulas(spark, d).select("document_id", "unit_id", "unit_order", "linear_text", "display_latex", "calc_expr", "confidence").distinct()
    body = F.to_json(F.struct("linear_text", "display_latex", "calc_expr", "confidence"))
    fenced = F.concat(F.lit("```json\n"), body, F.lit("\n```"))
    return f.select("document_id", "unit_id", F.when(F.col("unit_order") % 2 == 0, fenced).otherwise(F.concat(F.lit("Here it is: "), body, F.lit(" - as asked."))).alias("content"))


def salvaged(content: Column, schema: str) -> Column:
    """The object in a text: what stands between its outermost braces; null if that is no JSON."""
    return F.from_json(F.regexp_extract(content, r"(?s)\{.*\}", 0), schema, {"mode": "PERMISSIVE"})


_D = f"(SELECT DISTINCT document_id, unit_id, linear_text, display_latex, calc_expr, confidence, unit_order FROM {_F})"


@query(f"SELECT document_id, unit_id, linear_text, display_latex, calc_expr, confidence FROM {_D}")
def json_salvage(spark, d):
    return _responses(spark, d).select("document_id", "unit_id", salvaged(F.col("content"), _RESPONSE).alias("r")).select("document_id", "unit_id", "r.*")


def _given(c: str) -> Column:
    """Stripped, or null where nothing or the word null is left."""
    return F.when(~F.trim(c).isin("", "null"), F.trim(c))


_GIVEN = "CASE WHEN trim({0}, ' ') NOT IN ('', 'null') THEN trim({0}, ' ') END"


@query(f"""WITH g AS (SELECT document_id, unit_id, {_GIVEN.format('linear_text')} AS l, {_GIVEN.format('display_latex')} AS x, {_GIVEN.format('calc_expr')} AS c, {_GIVEN.format('confidence')} AS s FROM {_D})
SELECT document_id, unit_id, coalesce(l, x) AS linear_text, coalesce(x, l) AS display_latex, c AS calc_expr, CASE WHEN s IN ('high', 'medium', 'low') THEN s ELSE 'low' END AS confidence, CASE WHEN l IS NULL AND x IS NULL THEN 'no_text' ELSE '' END AS error FROM g""")
def response_normalize(spark, d):
    """Answers as formulas: linear and display form stand in for each other, an unknown confidence is low."""
    r = json_salvage(spark, d).select("document_id", "unit_id", *[_given(c).alias(c) for c in ("linear_text", "display_latex", "calc_expr", "confidence")])
    l, x = F.col("linear_text"), F.col("display_latex")  # noqa: E741
    return r.select("document_id", "unit_id", F.coalesce(l, x).alias("linear_text"), F.coalesce(x, l).alias("display_latex"), "calc_expr", F.when(F.col("confidence").isin("high", "medium", "low"), F.col("confidence")).otherwise("low").alias("confidence"), F.when(l.isNull() & x.isNull(), "no_text").otherwise("").alias("error"))


@query(f"SELECT document_id, unit_id, {_GIVEN.format('display_latex')} AS latex, {_GIVEN.format('calc_expr')} AS asciimath FROM {_D}")
def typed_lookup(spark, d):
    """The first value of a type in a list of typed values."""
    data = F.array(F.struct(F.lit("latex").alias("type"), F.col("display_latex").alias("value")), F.struct(F.lit("asciimath").alias("type"), F.col("calc_expr").alias("value")), F.struct(F.lit("latex").alias("type"), F.lit("second").alias("value")))
    f = _formulas(spark, d).select("document_id", "unit_id", "unit_order", "linear_text", "display_latex", "calc_expr", "confidence").distinct().withColumn("data", data)
    first = lambda k: F.get(F.filter("data", lambda x: x.type == k), F.lit(0)).value
    found = f.select("document_id", "unit_id", first("latex").alias("latex"), first("asciimath").alias("asciimath"))
    return found.select("document_id", "unit_id", _given("latex").alias("latex"), _given("asciimath").alias("asciimath"))


@query(f"SELECT document_id, unit_id, trim(display_latex, ' ') AS latex FROM {_D} WHERE display_latex IS NOT NULL AND NOT regexp_matches(display_latex, '[\\x0B\\s]$|^[\\x0B\\s]')")
def strip_delimiters(spark, d):
    """Display forms freed of the signs that mark mathematics: \\( \\), \\[ \\] and $ $."""
    f = _formulas(spark, d).select("document_id", "unit_id", "unit_order", "linear_text", "display_latex", "calc_expr", "confidence").distinct().where(F.col("display_latex").isNotNull() & ~F.col("display_latex").rlike(r"[\x0B\s]\z|^[\x0B\s]"))
    n, x = F.col("unit_order") % 4, F.col("display_latex")
    marked = F.when(n == 0, F.concat(F.lit("\\( "), x, F.lit(" \\)"))).when(n == 1, F.concat(F.lit("\\["), x, F.lit("\\]"))).when(n == 2, F.concat(F.lit(" $"), x, F.lit("$ "))).otherwise(x)
    return f.select("document_id", "unit_id", unmarked(marked).alias("latex"))


def unmarked(text: Column) -> Column:
    text = F.trim(text)
    n = F.length(text)
    pair = (text.startswith("\\(") & text.endswith("\\)")) | (text.startswith("\\[") & text.endswith("\\]"))
    return F.when(pair, F.trim(F.substring(text, F.lit(3), n - 4))).when(text.startswith("$") & text.endswith("$") & (n > 1), F.trim(F.substring(text, F.lit(2), n - 2))).otherwise(text)


_STAR = "regexp_replace({}, '([)\\]A-Za-zА-Яа-я0-9])\\s*\\*\\s*([(\\[A-Za-zА-Яа-я0-9])', '\\1 x \\2', 'g')"


@query(f"SELECT doc_id, trim(regexp_replace({_STAR.format(_STAR.format('t'))}, '\\s+', ' ', 'g'), ' ') AS clean FROM (SELECT doc_id, replace(replace(text, chr(12), ' '), '×', '*') AS t FROM documents WHERE text IS NOT NULL)")
def ocr_text_normalize(spark, d):
    """Text of a local reader: form feeds are spaces, a star between operands is an x, spaces are single."""
    t = F.replace(F.replace("text", F.lit("\f"), F.lit(" ")), F.lit("×"), F.lit("*"))
    t = F.regexp_replace(t, r"(?<=[)\]A-Za-zА-Яа-я0-9])\s*\*\s*(?=[(\[A-Za-zА-Яа-я0-9])", " x ")
    return table(spark, d, "documents", "doc_id", "text").where("text is not null").select("doc_id", F.trim(F.regexp_replace(t, r"\s+", " ")).alias("clean"))


@query("SELECT event_id, CASE WHEN value / 200 >= 0.95 THEN 'high' WHEN value / 200 >= 0.8 THEN 'medium' ELSE 'low' END AS bucket FROM events")
def confidence_bucket(spark, d):
    """Scores (a value as a share of 200) as words of confidence; no score is low."""
    score = F.col("value") / 200
    return table(spark, d, "events", "event_id", "value").select("event_id", F.when(score >= 0.95, "high").when(score >= 0.8, "medium").otherwise("low").alias("bucket"))


@query(f"SELECT document_id, unit_id, coalesce(trim(calc_expr, ' '), '') <> '' AS machine_readable, coalesce(confidence, '') IN ('high', 'medium') AS locally_sufficient, coalesce(trim(calc_expr, ' '), '') = '' OR confidence = 'low' IS TRUE AS needs_review FROM {_F}".replace("confidence = 'low' IS TRUE", "coalesce(confidence, '') = 'low'"))
def formula_contract_class(spark, d):
    calc, trust = F.coalesce(F.trim("calc_expr"), F.lit("")) != "", F.coalesce("confidence", F.lit(""))
    return _formulas(spark, d).select("document_id", "unit_id", calc.alias("machine_readable"), trust.isin("high", "medium").alias("locally_sufficient"), (~calc | (trust == "low")).alias("needs_review"))


@query(f"""SELECT document_id, unit_id, CASE WHEN type = 'formula_image' THEN 'image' ELSE 'text' END AS candidate, CASE WHEN coalesce(confidence, '') IN ('high', 'medium') THEN 'local' ELSE 'null' END AS stage, CASE WHEN coalesce(confidence, '') IN ('high', 'medium') THEN 'recognized' WHEN type = 'formula_image' AND asset_ref IS NULL THEN 'asset_missing' ELSE 'unresolved' END AS outcome,
CASE WHEN coalesce(trim(calc_expr, ' '), '') = '' THEN 'formula_recognition_unresolved' WHEN confidence = 'low' THEN 'formula_recognition_low_confidence' ELSE '' END AS reason FROM {_F} WHERE coalesce(trim(calc_expr, ' '), '') = '' OR coalesce(confidence, '') <> 'high'""")
def recognition_audit(spark, d):
    """One record per formula that recognition is asked for, with the provider that recognises nothing: what the text itself
    told is taken if it is sure enough, the rest stays open with its reason."""
    calc, trust = F.coalesce(F.trim("calc_expr"), F.lit("")) != "", F.coalesce("confidence", F.lit(""))
    local, image = trust.isin("high", "medium"), F.col("type") == "formula_image"
    outcome = F.when(local, "recognized").when(image & F.col("asset_ref").isNull(), "asset_missing").otherwise("unresolved")
    reason = F.when(~calc, "formula_recognition_unresolved").when(trust == "low", "formula_recognition_low_confidence").otherwise("")
    return _formulas(spark, d).where(~calc | (trust != "high")).select("document_id", "unit_id", F.when(image, "image").otherwise("text").alias("candidate"), F.when(local, "local").otherwise("null").alias("stage"), outcome.alias("outcome"), reason.alias("reason"))


_JAVA_SIGNS = "(?iu)" + FORMULA_SIGNS
_IS_FORMULA = "(length({0}) <= " + str(FORMULA_CHARS) + " AND regexp_matches({0}, '" + FORMULA_SIGNS + "', 'i'))"


def _is_formula(text: Column) -> Column:
    return (F.length(text) <= FORMULA_CHARS) & text.rlike(_JAVA_SIGNS)


@query(f"""SELECT document_id, unit_id, CASE WHEN {_IS_FORMULA.format("trim(text, ' ')")} THEN 'formula' WHEN type IN ('section', 'caption', 'list_item') THEN type ELSE 'paragraph' END AS told, CASE WHEN {_IS_FORMULA.format("trim(text, ' ')")} THEN 'semantic_structure_inferred' WHEN type IN ('section', 'caption', 'list_item') THEN 'semantic_style_inferred' ELSE '' END AS flag
FROM (SELECT DISTINCT document_id, unit_id, type, text FROM {_U}) WHERE text IS NOT NULL AND type IN ('section', 'paragraph', 'list_item', 'caption', 'formula')""")
def paragraph_types(spark, d):
    """The type of a paragraph: a formula by its signs before what its style says; and the flag such a guess gets."""
    u = _units(spark, d, "document_id", "unit_id", "type", "text").where("text is not null and type in ('section', 'paragraph', 'list_item', 'caption', 'formula')")
    formula, styled = _is_formula(F.trim("text")), F.col("type").isin("section", "caption", "list_item")
    return u.select("document_id", "unit_id", F.when(formula, "formula").when(styled, F.col("type")).otherwise("paragraph").alias("told"), F.when(formula, "semantic_structure_inferred").when(styled, "semantic_style_inferred").otherwise("").alias("flag"))


@query(f"""WITH p AS (SELECT doc_id, unnest(regexp_split_to_array(text, '\\n[ \\t]*\\n')) AS paragraph, unnest(range(1, len(regexp_split_to_array(text, '\\n[ \\t]*\\n')) + 1))::INT AS n FROM documents WHERE text IS NOT NULL)
SELECT doc_id, n AS paragraph_no, CASE WHEN len(list_filter(string_split(paragraph, chr(10)), lambda l: len(list_filter(list_transform(regexp_split_to_array(l, ' {{2,}}|\\t+|\\|'), lambda z: trim(z, ' ')), lambda z: z <> '')) >= 2)) >= 2 THEN 'table' WHEN regexp_matches(paragraph, '{CAPTION}', 'i') THEN 'figure' WHEN {_IS_FORMULA.format("trim(paragraph, ' ')")} THEN 'formula' ELSE 'paragraph' END AS type FROM p WHERE regexp_matches(paragraph, '[^\\s]')""")
def scan_paragraph_units(spark, d):
    """What a scanned paragraph becomes: a table of two lines with cells, else a figure, a formula, or a paragraph."""
    p = table(spark, d, "documents", "doc_id", "text").where("text is not null").select("doc_id", F.posexplode(F.split("text", r"\n[ \t]*\n")).alias("n", "paragraph")).where(F.col("paragraph").rlike(r"[^\s]"))
    rows = F.size(F.filter(F.split("paragraph", "\n"), lambda x: F.size(tx.cells(x)) >= 2))
    kind = F.when(rows >= 2, "table").when(F.col("paragraph").rlike("(?iu)" + CAPTION), "figure").when(_is_formula(F.trim("paragraph")), "formula").otherwise("paragraph")
    return p.select("doc_id", (F.col("n") + 1).alias("paragraph_no"), kind.alias("type"))


@query(f"""WITH c AS (SELECT document_id, unit_id, list_filter(list_transform(string_split(text, chr(10)), lambda l: trim(l, ' ')), lambda l: l <> '') AS l FROM (SELECT DISTINCT document_id, unit_id, text FROM {_U} WHERE type = 'table_cell' AND text IS NOT NULL))
SELECT document_id, unit_id, array_to_string(l, ' ') AS flat, list_filter(l, lambda x: {_IS_FORMULA.format('x')})[1] AS formula FROM c""")
def cell_formula(spark, d):
    """A cell's paragraphs in one line, and the first of them that looks like a formula."""
    u = _units(spark, d, "document_id", "unit_id", "type", "text").where("type = 'table_cell' and text is not null").select("document_id", "unit_id", "text").distinct()
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(x)), lambda x: x != "")
    return u.select("document_id", "unit_id", lines.alias("l")).select("document_id", "unit_id", F.array_join("l", " ").alias("flat"), F.get(F.filter("l", _is_formula), F.lit(0)).alias("formula"))


@query("""SELECT DISTINCT document_id, unit_id, cell.address || ': ' || CASE WHEN cell.formula IS NOT NULL THEN '=' || ltrim(cell.formula, '=') || ' -> ' ELSE '' END || CASE lower(cell.value) WHEN 'true' THEN 'TRUE' WHEN 'false' THEN 'FALSE' ELSE coalesce(cell.value, '') END AS search_text FROM document_units WHERE cell.address IS NOT NULL AND (cell.value IS NOT NULL OR cell.formula IS NOT NULL)""")
def cell_search_text(spark, d):
    c = lambda n: F.col(f"cell.{n}")
    value = F.when(F.lower(c("value")) == "true", "TRUE").when(F.lower(c("value")) == "false", "FALSE").otherwise(F.coalesce(c("value"), F.lit("")))
    formula = F.when(c("formula").isNotNull(), F.concat(F.lit("="), F.ltrim(c("formula"), F.lit("=")), F.lit(" -> "))).otherwise("")
    return table(spark, d, "document_units", "document_id", "unit_id", "cell").where("cell.address is not null and (cell.value is not null or cell.formula is not null)").select("document_id", "unit_id", F.concat(c("address"), F.lit(": "), formula, value).alias("search_text")).distinct()


_LINES = "(SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents WHERE text IS NOT NULL)"


@query(f"""WITH l AS (SELECT *, CASE WHEN regexp_matches(line, '^#+ +[^\\s]|^[0-9]+(\\.[0-9]+)+ +[^\\s]') THEN regexp_replace(line, '^[#]+ +', '') END AS heading FROM {_LINES}),
s AS (SELECT *, count(heading) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS section_no FROM l)
SELECT doc_id, section_no, coalesce(min(heading), '') AS heading, count(*) FILTER (trim(line, ' ') <> '' AND heading IS NULL) AS lines, min(regexp_extract(line, '^[-*] +(.+)$', 1)) FILTER (regexp_matches(line, '^[-*] +.+$')) AS a_bullet, count(*) FILTER (regexp_matches(line, '^[A-Za-zА-Яа-я]+ *: +[^\\s]')) AS pairs FROM s GROUP BY 1, 2""")
def md_sections(spark, d):
    """The sections of each text by its headings: their lines, the least bullet, and how many lines are a key and a value."""
    line = F.col("line")
    l = table(spark, d, "documents", "doc_id", "text").where("text is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))  # noqa: E741
    l = l.withColumn("heading", F.when(line.rlike(r"^#+ +[^\s]|^[0-9]+(\.[0-9]+)+ +[^\s]"), F.regexp_replace("line", "^#+ +", "")))  # noqa: E741
    s = l.withColumn("section_no", F.count("heading").over(Window.partitionBy("doc_id").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)))
    bullet = r"^[-*] +(.+)$"
    return s.groupBy("doc_id", "section_no").agg(F.coalesce(F.min("heading"), F.lit("")).alias("heading"), F.count(F.when((F.trim("line") != "") & F.col("heading").isNull(), 1)).alias("lines"), F.min(F.when(line.rlike(bullet), F.regexp_extract("line", bullet, 1))).alias("a_bullet"), F.count(F.when(line.rlike(r"^[A-Za-zА-Яа-я]+ *: +[^\s]"), 1)).alias("pairs"))


_CHUNKS = """t AS (SELECT DISTINCT document_id, asset_id, chunk_order, trim(text, ' ') AS text, coalesce(face, '') AS face, charset, abs(height) AS h FROM wmf_text_chunks WHERE text IS NOT NULL AND trim(text, ' ') <> '' AND height IS NOT NULL AND asset_id IS NOT NULL AND document_id IS NOT NULL),
m AS (SELECT document_id, asset_id, max(h) AS top FROM t GROUP BY 1, 2),
a AS (SELECT t.document_id, t.asset_id, count(*) AS n, coalesce(string_agg(text, '' ORDER BY chunk_order, text) FILTER (h = top), '') AS base, coalesce(string_agg(text, '' ORDER BY chunk_order, text) FILTER (h < top AND length(text) = 1 AND coalesce(charset, -1) <> 204), '') AS sup, coalesce(string_agg(text, '' ORDER BY chunk_order, text) FILTER (h < top AND NOT (length(text) = 1 AND coalesce(charset, -1) <> 204)), '') AS sub,
string_agg(text, '' ORDER BY chunk_order, text) FILTER (lower(face) = 'symbol') AS symbols, count(*) FILTER (lower(face) = 'symbol') AS n_symbols, string_agg(text, '' ORDER BY chunk_order, text) FILTER (lower(face) <> 'symbol') AS letters FROM t JOIN m ON m.document_id = t.document_id AND m.asset_id = t.asset_id GROUP BY 1, 2)"""


@query(f"""WITH {_CHUNKS} SELECT document_id, asset_id, CASE WHEN n = 2 AND n_symbols = 1 AND length(symbols) = 2 AND length(letters) = 3 AND symbols[1] = '=' THEN letters[1] || ' = ' || letters[2] || ' ' || symbols[2] || ' ' || letters[3] ELSE base || CASE WHEN sub <> '' THEN '_(' || sub || ')' ELSE '' END || CASE WHEN sup <> '' THEN '^(' || sup || ')' ELSE '' END END AS formula FROM a""")
def wmf_assemble(spark, d):
    """The formula drawn in a picture: two signs between three letters, else the letters of full height with what is
    smaller as their lower part, or as their upper part if it is a single letter of no Cyrillic font."""
    c = table(spark, d, "wmf_text_chunks").select("document_id", "asset_id", "chunk_order", F.trim("text").alias("text"), F.coalesce("face", F.lit("")).alias("face"), "charset", F.abs("height").alias("h")).where("text <> '' and h is not null and asset_id is not null and document_id is not null").distinct()
    g = c.groupBy("document_id", "asset_id").agg(F.sort_array(F.collect_list(F.struct("chunk_order", "text", "face", "charset", "h"))).alias("t"), F.max("h").alias("top"))
    joined = lambda keep: F.array_join(F.transform(F.filter("t", keep), lambda x: x.text), "")
    upper = lambda x: (x.h < F.col("top")) & (F.length(x.text) == 1) & (F.coalesce(x.charset, F.lit(-1)) != 204)
    symbol = lambda x: F.lower(x.face) == "symbol"
    g = g.select("document_id", "asset_id", F.size("t").alias("n"), joined(lambda x: x.h == F.col("top")).alias("base"), joined(upper).alias("sup"), joined(lambda x: (x.h < F.col("top")) & ~upper(x)).alias("sub"), joined(symbol).alias("s"), joined(lambda x: ~symbol(x)).alias("l"), F.size(F.filter("t", symbol)).alias("k"))
    between = (F.col("n") == 2) & (F.col("k") == 1) & (F.length("s") == 2) & (F.length("l") == 3) & F.col("s").startswith("=")
    at = lambda c, i: F.substring(c, i, 1)
    scripts = F.concat("base", F.when(F.col("sub") != "", F.concat(F.lit("_("), "sub", F.lit(")"))).otherwise(""), F.when(F.col("sup") != "", F.concat(F.lit("^("), "sup", F.lit(")"))).otherwise(""))
    return g.select("document_id", "asset_id", F.when(between, F.concat_ws(" ", at("l", 1), F.lit("="), at("l", 2), at("s", 2), at("l", 3))).otherwise(scripts).alias("formula"))


def run_text(runs: Column) -> Column:
    """The text of a paragraph's runs (array of struct<text, script>): lower and upper parts in brackets with their sign."""
    marked = F.transform(runs, lambda r: F.when(r.text == "", "").when(r.script == "sub", F.concat(F.lit("_("), r.text, F.lit(")"))).when(r.script == "super", F.concat(F.lit("^("), r.text, F.lit(")"))).otherwise(r.text))
    return F.array_join(marked, "")


@query("""SELECT document_id, unit_id, text AS run_text FROM (SELECT DISTINCT document_id, unit_id, formula.linear_text AS text FROM document_units WHERE formula.linear_text IS NOT NULL) WHERE regexp_full_match(text, '([^_^()]|_\\([^()]+\\)|\\^\\([^()]+\\))*')""", name="run_text")
def run_text_query(spark, d):
    """Formulas parted into runs of plain, lower and upper text, and put together again."""
    f = table(spark, d, "document_units", "document_id", "unit_id", F.col("formula.linear_text").alias("text")).where("text is not null").distinct().where(F.col("text").rlike(r"^([^_^()]|_\([^()]+\)|\^\([^()]+\))*$"))
    parts = F.regexp_extract_all("text", F.lit(r"[_^]\([^()]+\)|[^_^()]+"), F.lit(0))
    script = lambda p: F.when(p.startswith("_("), "sub").when(p.startswith("^("), "super").otherwise("")
    runs = F.transform(parts, lambda p: F.struct(F.when(script(p) != "", F.substring(p, F.lit(3), F.length(p) - 3)).otherwise(p).alias("text"), script(p).alias("script")))
    return f.select("document_id", "unit_id", run_text(runs).alias("run_text"))

