"""Text of documents: lines, normalised forms, predicates, metadata, redaction of secrets."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweave.functions import text as tx
from docweave.plans.formulas import _translit_sql
from docweave.plans.register import Registry
from docweave.sources.tables import table

_R = Registry()
QUERIES, SQL, query = _R.queries, _R.sql, _R.add
_SQUEEZE = "trim(regexp_replace({}, '[\\s\\x0B ]+', ' ', 'g'))"
_L = "(SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10)))))::INT AS line_no FROM documents WHERE text IS NOT NULL)"


def _docs(spark: SparkSession, d: str, *more: str) -> DataFrame:
    return table(spark, d, "documents", "doc_id", "text", *more).where("text is not null")


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


@query("SELECT doc_id, lang, source, document_type, sha256(coalesce(text, '')) AS sha256, coalesce(length(text), 0)::BIGINT AS chars FROM documents")
def txt_document(spark, d):
    return table(spark, d, "documents").select("doc_id", "lang", "source", "document_type", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256"), F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("chars"))


# Signs of a formula in a line (as the pages of PDF text are typed), beginnings of captions.
_SIGNS, _CAPTION = r"(^|\s)[A-Za-zА-Яа-я][\wА-Яа-я]*\s*=|[=∑√≤≥±×÷≈]", r"^(рис\.|рисунок|figure)\s"
_P = "(SELECT doc_id, unnest(string_split(text, chr(12))) AS page_text, unnest(range(1, len(string_split(text, chr(12))) + 1))::INT AS page FROM documents WHERE text IS NOT NULL)"


@query(f"""WITH b AS (SELECT doc_id, page, unnest(regexp_split_to_array(page_text, '\\n[ \\t]*\\n')) AS block, unnest(range(1, len(regexp_split_to_array(page_text, '\\n[ \\t]*\\n')) + 1))::INT AS n FROM {_P}),
k AS (SELECT doc_id, page, n, {_SQUEEZE.format('block')} AS t, len(list_filter(string_split(block, chr(10)), lambda l: contains(l, ' | '))) AS rows_ FROM b WHERE regexp_matches(block, '[^\\s]')),
e AS (SELECT *, n = min(n) OVER (PARTITION BY doc_id, page) AS first, n = max(n) OVER (PARTITION BY doc_id, page) AS last FROM k),
h AS (SELECT doc_id, t FROM e WHERE first GROUP BY 1, 2 HAVING count(*) > 1), f AS (SELECT doc_id, t FROM e WHERE last GROUP BY 1, 2 HAVING count(*) > 1)
SELECT e.doc_id, e.page, e.n AS block_no, CASE WHEN e.first AND h.t IS NOT NULL THEN 'header' WHEN e.last AND f.t IS NOT NULL THEN 'footer' WHEN rows_ >= 2 THEN 'table' WHEN regexp_matches(e.t, '{_CAPTION}', 'i') THEN 'figure' WHEN length(e.t) <= 180 AND regexp_matches(e.t, '{_SIGNS}', 'i') THEN 'formula' ELSE 'paragraph' END AS type FROM e LEFT JOIN h ON h.doc_id = e.doc_id AND h.t = e.t LEFT JOIN f ON f.doc_id = e.doc_id AND f.t = e.t""")
def text_units(spark, d):
    """Blocks of pages (parted at form feeds) as units: headers and footers return at the same edge of several pages, then
    tables, figures, formulas, paragraphs."""
    pages = _docs(spark, d).select("doc_id", F.posexplode(F.split("text", "\f")).alias("p", "page_text"))
    b = pages.select("doc_id", (F.col("p") + 1).alias("page"), F.posexplode(F.split("page_text", r"\n[ \t]*\n")).alias("i", "block")).where(F.col("block").rlike(r"[^\s]"))
    k = b.select("doc_id", "page", (F.col("i") + 1).alias("n"), tx.squeeze(F.col("block")).alias("t"), F.size(F.filter(F.split("block", "\n"), lambda x: x.contains(" | "))).alias("rows_"))
    w = Window.partitionBy("doc_id", "page")
    e = k.select("*", (F.col("n") == F.min("n").over(w)).alias("first"), (F.col("n") == F.max("n").over(w)).alias("last"))
    again = lambda edge, name: e.where(edge).groupBy("doc_id", "t").agg(F.count("*").alias("c")).where("c > 1").select("doc_id", "t", F.lit(True).alias(name))
    e = e.join(again("first", "h"), ["doc_id", "t"], "left").join(again("last", "f"), ["doc_id", "t"], "left")
    t = F.col("t")
    kind = F.when(F.col("first") & F.col("h").isNotNull(), "header").when(F.col("last") & F.col("f").isNotNull(), "footer").when(F.col("rows_") >= 2, "table").when(t.rlike("(?iu)" + _CAPTION), "figure").when((F.length(t) <= 180) & t.rlike("(?iu)" + _SIGNS), "formula").otherwise("paragraph")
    return e.select("doc_id", "page", F.col("n").alias("block_no"), kind.alias("type"))


@query(f"SELECT doc_id, {_SQUEEZE.format('text')} AS squeezed FROM documents WHERE text IS NOT NULL")
def normalize_space(spark, d):
    return _docs(spark, d).select("doc_id", tx.squeeze(F.col("text")).alias("squeezed"))


@query(f"SELECT doc_id, count(*) AS lines, sum(length(s))::BIGINT AS chars FROM (SELECT doc_id, {_SQUEEZE.format('line')} AS s FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '\\r\\n|[\\n\\r\\x0B\\f]')) AS line FROM documents)) WHERE s <> '' GROUP BY 1")
def text_lines(spark, d):
    return _docs(spark, d).select("doc_id", F.explode(tx.lines(F.col("text"))).alias("s")).groupBy("doc_id").agg(F.count("*").alias("lines"), F.sum(F.length("s")).alias("chars"))


@query("SELECT doc_id, CASE WHEN length(text) <= 500 THEN text ELSE regexp_replace(substr(text, 1, 500), ' [^ ]*$', '') || '…' END AS clipped FROM documents WHERE text IS NOT NULL")
def clip_text(spark, d):
    return _docs(spark, d).select("doc_id", tx.clip(F.col("text"), 500).alias("clipped"))


@query("SELECT doc_id, CASE WHEN length(text) <= 120 THEN text ELSE regexp_replace(substr(text, 1, 120), '[ .,:;]+$', '') || '…' END AS compacted FROM documents WHERE text IS NOT NULL")
def compact_text(spark, d):
    return _docs(spark, d).select("doc_id", tx.compact(F.col("text"), 120).alias("compacted"))


@query(f"SELECT doc_id, line_no, CASE WHEN s = '' THEN 'item' ELSE s END AS slug FROM (SELECT doc_id, line_no, regexp_replace(regexp_replace(lower(line), '[^\\p{{L}}\\p{{N}}]+', '-', 'g'), '^-+|-+$', '', 'g') AS s FROM {_L})")
def slug(spark, d):
    return _lines(spark, d).select("doc_id", "line_no", tx.slug(F.col("line")).alias("slug"))


@query(f"SELECT doc_id, line_no, replace(replace(replace(replace(line, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;') AS html FROM {_L} WHERE regexp_matches(line, '[&<>\"]')")
def html_escape(spark, d):
    return _lines(spark, d).where(F.col("line").rlike('[&<>"]')).select("doc_id", "line_no", tx.escape_html(F.col("line")).alias("html"))


@query("SELECT doc_id, list_sum(list_transform(regexp_extract_all(text, '[\\p{L}\\p{N}_]+|[^\\p{L}\\p{N}_\\s]'), lambda x: CASE WHEN regexp_matches(x, '^[\\p{L}\\p{N}_]') THEN ceil(length(x) / 4) ELSE 1 END))::BIGINT AS tokens FROM documents WHERE text <> '' AND regexp_matches(text, '[^\\s]')")
def token_estimate(spark, d):
    return _docs(spark, d).where("text <> ''").where(F.col("text").rlike(r"[^\s]")).select("doc_id", tx.token_estimate(F.col("text")).alias("tokens"))


@query("SELECT coalesce(source, '') AS source, coalesce(lang, '') AS lang, count(*) AS documents, sum(length(text))::BIGINT AS chars, sum(ceil(length(text) / 4))::BIGINT AS tokens FROM documents WHERE text IS NOT NULL GROUP BY CUBE (source, lang) HAVING grouping(source) + grouping(lang) < 2")
def token_totals(spark, d):
    g = _docs(spark, d, "source", "lang").cube("source", "lang").agg(F.count("*").alias("documents"), F.sum(F.length("text")).alias("chars"), F.sum(F.ceil(F.length("text") / 4)).alias("tokens"), F.grouping_id().alias("g"))
    return g.where("g < 3").select(F.coalesce("source", F.lit("")).alias("source"), F.coalesce("lang", F.lit("")).alias("lang"), "documents", "chars", "tokens")


@query(f"SELECT doc_id, line_no, len(list_filter(list_transform(regexp_split_to_array(line, ' {{2,}}|\\t+|\\|'), lambda x: trim(x)), lambda x: x <> ''))::INT AS cells FROM {_L} WHERE contains(line, '|')")
def cell_split(spark, d):
    return _lines(spark, d).where(F.col("line").contains("|")).select("doc_id", "line_no", F.size(tx.cells(F.col("line"))).alias("cells"))


@query(f"SELECT doc_id, count(*) AS rows_, count(*) FILTER (regexp_matches(line, '[0-9]')) AS numeric_rows, count(*) FILTER (regexp_matches(line, '^([0-9]+|[A-Za-zА-я])[.)] ')) AS listed_rows FROM {_L} WHERE trim(line) <> '' GROUP BY 1")
def grid_signals(spark, d):
    n = lambda p: F.count(F.when(F.col("line").rlike(p), 1))
    return _lines(spark, d).where("trim(line) <> ''").groupBy("doc_id").agg(F.count("*").alias("rows_"), n("[0-9]").alias("numeric_rows"), n("^([0-9]+|[A-Za-zА-я])[.)] ").alias("listed_rows"))


@query(f"SELECT doc_id, {_translit_sql('document_type')} AS latin FROM documents WHERE document_type IS NOT NULL")
def transliterate(spark, d):
    return table(spark, d, "documents", "doc_id", "document_type").where("document_type is not null").select("doc_id", tx.transliterate(F.col("document_type")).alias("latin"))


@query(f"SELECT doc_id, line_no FROM {_L} WHERE length(trim(line)) <= 180 AND regexp_matches(line, '[A-Za-zА-Яа-яЁё_)] *=|[×÷Σ√≤≥]|(^|[^a-z])(sum|sqrt|frac)([^a-z]|$)')")
def formula_line_filter(spark, d):
    return _lines(spark, d).where((F.length(F.trim("line")) <= 180) & F.col("line").rlike("[A-Za-zА-Яа-яЁё_)] *=|[×÷Σ√≤≥]|(^|[^a-z])(sum|sqrt|frac)([^a-z]|$)")).select("doc_id", "line_no")


@query(f"SELECT doc_id, line_no, line FROM {_L} WHERE regexp_matches(line, '^(рис\\.|рисунок|figure|abbildung) ', 'i')")
def figure_caption_filter(spark, d):
    return _lines(spark, d).where(F.col("line").rlike(r"(?iu)^(рис\.|рисунок|figure|abbildung) ")).select("doc_id", "line_no", "line")


@query(f"SELECT doc_id, line_no, regexp_extract(line, '^([0-9]+(\\.[0-9]+)*)', 1) AS number FROM {_L} WHERE regexp_matches(line, '^[0-9]+(\\.[0-9]+)*[.)]? +[A-ZА-ЯЁÄÖÜ]')")
def numbered_block_filter(spark, d):
    return _lines(spark, d).where(F.col("line").rlike(r"^[0-9]+(\.[0-9]+)*[.)]? +[A-ZА-ЯЁÄÖÜ]")).select("doc_id", "line_no", F.regexp_extract("line", r"^([0-9]+(\.[0-9]+)*)", 1).alias("number"))


@query(f"SELECT doc_id, line_no, regexp_replace(regexp_replace(regexp_replace(line, '^([0-9]+(\\.[0-9]+)+)([A-ZА-ЯЁ])', '\\1 \\3'), ' +([,.;:])', '\\1', 'g'), '\\( +', '(', 'g') AS block FROM {_L} WHERE line <> ''")
def block_normalize(spark, d):
    b = F.regexp_replace("line", r"^([0-9]+(\.[0-9]+)+)([A-ZА-ЯЁ])", "$1 $3")
    return _lines(spark, d).where("line <> ''").select("doc_id", "line_no", F.regexp_replace(F.regexp_replace(b, " +([,.;:])", "$1"), r"\( +", "(").alias("block"))


_KINDS = (("order", "приказ|order|anordnung"), ("method", "методик|method"), ("letter", "письмо|letter|schreiben"), ("protocol", "протокол|minutes|protokoll"), ("report", "отч[её]т|report|bericht"), ("instruction", "инструкци|instruction|anweisung"), ("prices", "расценк|сборник|price|preis"))


# Kinds of act in the order in which they are tried, and openings of a body that end a title.
_ALONE = "(?<![A-Za-zА-Яа-яЁё]){}(?![A-Za-zА-Яа-яЁё])"
_LABELS = (
    ("федеральный закон", r"\bфедеральн(?:ый|ого)\s+закон\b"), ("технический регламент", r"\bтехническ(?:ий|ого)\s+регламент\b"), ("постановление", r"\bпостановлени[ея]\b"),
    ("распоряжение", r"\bраспоряжени[ея]\b"), ("приказ", r"\bприказ\b"), ("письмо", r"\bписьмо\b"), ("указ", r"\bуказ\b"), ("решение", r"\bрешени[ея]\b"), ("регламент", r"\bрегламент\b"),
    ("свод правил", r"\bсвод\s+правил\b|" + _ALONE.format("сп")), ("гост", _ALONE.format("гост")), ("санпин", _ALONE.format("санпин")), ("закон", r"\bзакон\b"), ("кодекс", r"\bкодекс\b"),
    ("методические указания", r"\bметодическ(?:ие|их)\s+указан"), ("методические рекомендации", r"\bметодическ(?:ие|их)\s+рекомендац"), ("методическое пособие", r"\bметодическ(?:ое|ого)\s+пособи[ея]\b"), ("методика", r"\bметодик[аиуе]?\b"),
)
_STOPS = r"^(в\s+соответствии\b|приказываю\b|постановляет\b|постановляю\b|утвердить\b|1[.)]\s+)"


_EDGE = {"(?<![A-Za-zА-Яа-яЁё])": "(?:^|[^A-Za-zА-Яа-яЁё])", "(?![A-Za-zА-Яа-яЁё])": "(?:$|[^A-Za-zА-Яа-яЁё])", r"\s": r"[\s\x0B\p{Z}]"}


def _re2(pattern: str) -> str:
    """The pattern for DuckDB, which knows no look-around and only ASCII word boundaries."""
    for java, re2 in _EDGE.items():
        pattern = pattern.replace(java, re2)
    return re.sub(r"\\b(?=[\w(]|$)(?!\)|$)", r"(?:^|[^\\p{L}\\p{N}_])", pattern).replace("\\b", r"(?:$|[^\p{L}\p{N}_])")


def _java(pattern: str) -> str:
    """The pattern for Java: a word's beginning is checked behind its first letters, so most places fail at one letter."""
    def turned(one: str) -> str:
        m = re.match(r"(\\b|\(\?<!\[A-Za-zА-Яа-яЁё\]\))([а-яё]+)(.*)$", one)
        if not m:
            return one
        before = r"[\p{L}\p{N}_]" if m.group(1) == "\\b" else "[A-Za-zА-Яа-яЁё]"
        return m.group(2) + f"(?<!{before}{m.group(2)})" + m.group(3)

    parts = re.split(r"\|(?=\\b|\(\?<!)", pattern)
    return "|".join(map(turned, parts)).replace("\\b", r"(?![\p{L}\p{N}_])").replace(r"\s", r"[\s\x0B\p{Z}]")


def _beginnings(pattern: str) -> list[str]:
    """Plain letters with which each alternative of a pattern begins."""
    return [re.match("[a-zа-яё]+", re.sub(r"^(\\b|\(\?<!\[[^]]*\]\))", "", one)).group() for one in re.split(r"\|(?![^(]*\))", pattern)]


def _may(text: Column, patterns: list[str]) -> Column:
    """Does the text hold the beginning of any? Plain letters are found many times faster than patterns."""
    return reduce(lambda a, b: a | b, [text.contains(x) for x in sorted({x for p in patterns for x in _beginnings(p)})])


def _classified(patterns: tuple, text: Column, before: str = "") -> Column:
    """The first label whose pattern is found in a text of lower case, else null."""
    return F.coalesce(*[F.when(_may(text, [p]) & text.rlike(f"{before}({_java(p)})"), k) for k, p in patterns])


def _settled(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with the column computed once. Later uses of a projected column may repeat its expression; what a generator gives they only read."""
    return df.select(*[c for c in df.columns if c != name], F.explode(F.array(value)).alias(name))


def _names_type(line: Column) -> Column:
    """Does a line of lower case name any type?"""
    patterns = [p for _, p in (*_LABELS, *_KINDS)]
    return _may(line, patterns) & line.rlike("|".join(map(_java, patterns)))


def _titled(docs: DataFrame) -> DataFrame:
    """With the first 30 lines (head), the title lines (l), from two before the first of these that names a type, up to ten
    or a stop line, the same in lower case (low), and which of them name a type (named)."""
    stops = _re2(_STOPS)
    t = _settled(docs, "l", tx.lines(F.col("text")))
    t = _settled(t, "l", F.slice(F.filter("l", lambda x, i: (i == 0) | (x != F.get("l", i - 1))), 1, 44))
    t = _settled(t, "head", F.slice("l", 1, 30))
    t = _settled(t, "low", F.transform("head", lambda x: F.lower(x)))
    t = _settled(t, "at", F.array_position(F.transform("low", lambda x: _names_type(x)), F.lit(True)))
    t = _settled(t, "l", F.slice("l", F.greatest(F.col("at") - 2, F.lit(1)).cast("int"), F.lit(14)))
    t = _settled(t, "stop", F.array_position(F.transform("l", lambda x, i: (i > 0) & F.lower(x).rlike(stops)), F.lit(True)))
    t = _settled(t, "l", F.slice("l", F.lit(1), F.when(F.col("stop") > 0, F.least(F.col("stop") - 1, F.lit(10))).otherwise(10).cast("int")))
    t = _settled(t, "low", F.transform("l", lambda x: F.lower(x)))  # once a line, not once a pattern
    return _settled(t, "named", F.transform("low", _names_type)).drop("at", "stop")


def _label(name: Column) -> Column:
    """The kind of act that a line of lower case is, or begins with before a space; null if none."""
    return F.nullif(F.regexp_extract(F.trim(name, F.lit(" .,:;№n")), f"^({_LABEL_NAMES})( |$)", 1), F.lit(""))


def _typed(df: DataFrame, name: str, patterns: tuple, exact: Callable[[Column], Column]) -> DataFrame:
    df = _settled(_settled(df, "joined", F.lower(F.array_join("l", "\n"))), "front", F.lower(F.substring("text", 1, 1000)))
    first = F.get(F.array_compact(F.transform("low", exact)), F.lit(0))
    return df.withColumn(name, F.coalesce(first, _classified(patterns, F.col("joined")), _classified(patterns, F.col("front")), F.lit("unknown"))).drop("joined", "front")


def _first_sql(patterns: tuple, text: str, before: str = "") -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({text}, '{before}({_re2(p)})', 'i') THEN '{k}'" for k, p in patterns) + " END"


_ANY_TYPE = "|".join(p for _, p in (*_LABELS, *_KINDS))
_SQUEEZED = _SQUEEZE.format("x")
_TITLED = f"""l0 AS (SELECT doc_id, text, list_filter(list_transform(regexp_split_to_array(text, '\\r\\n|[\\n\\r\\x0B\\f]'), lambda x: {_SQUEEZED}), lambda x: x <> '') AS l FROM documents WHERE text IS NOT NULL),
l1 AS (SELECT doc_id, text, list_filter(l, lambda x, i: i = 1 OR x <> l[i - 1])[1:44] AS l FROM l0),
l2 AS (SELECT *, l[1:30] AS head, greatest(coalesce(list_position(list_transform(l[1:30], lambda x: regexp_matches(x, '{_re2(_ANY_TYPE)}', 'i')), true), 0) - 2, 1) AS lo FROM l1),
l3 AS (SELECT doc_id, text, head, l[lo:lo + 13] AS l FROM l2),
t AS (SELECT doc_id, text, head, l[1:coalesce(least(nullif(list_position(list_transform(l, lambda x, i: i > 1 AND regexp_matches(x, '{_re2(_STOPS)}', 'i')), true), 0) - 1, 10), 10)] AS l FROM l3)"""
_LABEL_NAMES = "|".join(k for k, _ in _LABELS)


@query(f"""WITH {_TITLED}, k AS (SELECT doc_id, list_filter(list_transform(l, lambda x: {_first_sql(_KINDS, 'x', '^')}), lambda x: x IS NOT NULL)[1] AS kind1,
list_filter(list_transform(l, lambda x: nullif(regexp_extract(trim(lower(x), ' .,:;№n'), '^({_LABEL_NAMES})( |$)', 1), '')), lambda x: x IS NOT NULL)[1] AS label1, array_to_string(l, chr(10)) AS joined, substr(text, 1, 1000) AS front FROM t)
SELECT doc_id, coalesce(kind1, {_first_sql(_KINDS, 'joined')}, {_first_sql(_KINDS, 'front')}, 'unknown') AS kind, coalesce(label1, {_first_sql(_LABELS, 'joined')}, {_first_sql(_LABELS, 'front')}, 'unknown') AS label FROM k""")
def document_type(spark, d):
    """kind: in three languages; label: kinds of act by their Russian names. Both by the same rules: a title
    line that starts with the label, else the first label found in the title lines, else in the first 1000 characters."""
    t = _typed(_titled(_docs(spark, d)), "kind", _KINDS, lambda x: _classified(_KINDS, x, "^"))
    return _typed(t, "label", _LABELS, _label).select("doc_id", "kind", "label")


_LABEL_SQL = f"coalesce(list_filter(list_transform(l, lambda x: nullif(regexp_extract(trim(lower(x), ' .,:;№n'), '^({_LABEL_NAMES})( |$)', 1), '')), lambda x: x IS NOT NULL)[1], {_first_sql(_LABELS, 'array_to_string(l, chr(10))')}, {_first_sql(_LABELS, 'substr(text, 1, 1000)')}, 'unknown')"
# A line with a date or a number, and the most characters of a title or summary.
_DATED = r"(^|[^\p{L}\p{N}_])от\s+[0-9]{1,2}($|[^\p{L}\p{N}_])|(^|[^\p{L}\p{N}_])n\s*[\p{L}\p{N}_/-]+|[\p{L}\p{N}_]№\s*[\p{L}\p{N}_/-]+"
_MOST = 500
_CLIP_SQL = "CASE WHEN length({0}) <= 500 THEN {0} ELSE regexp_replace(substr({0}, 1, 500), ' [^ ]*$', '') || '…' END"
_M0 = f"""{_TITLED}, m0 AS (SELECT doc_id, l, {_LABEL_SQL} AS document_type, array_to_string(l, ' ') AS said, coalesce(act_series, '') AS stem, list_transform(l, lambda x: regexp_matches(x, '{_re2(_ANY_TYPE)}', 'i')) AS named FROM t JOIN (SELECT doc_id AS k, act_series FROM documents) s ON s.k = t.doc_id),
m1 AS (SELECT *, {_CLIP_SQL.format('said')} AS title0, CASE WHEN coalesce(list_position(named, true), 0) > 0 THEN l[list_position(named, true) + 1:] ELSE l END AS rest FROM m0),
m2 AS (SELECT *, CASE WHEN title0 = '' OR (length(title0) < 40 AND length(stem) > length(title0)) THEN {_CLIP_SQL.format('stem')} ELSE title0 END AS title, list_filter(rest, lambda x: NOT regexp_matches(lower(x), '{_DATED}')) AS kept FROM m1),
m3 AS (SELECT *, coalesce(list_position(list_transform(kept, lambda x: regexp_matches(x, '{_re2(_STOPS)}', 'i')), true), 0) AS stop FROM m2),
m4 AS (SELECT *, list_filter(CASE WHEN stop > 0 THEN kept[1:stop - 1] ELSE kept END, lambda x: document_type = 'unknown' OR trim(lower(x), ' .,:;№n') <> document_type) AS subject_lines FROM m3),
m5 AS (SELECT *, array_to_string(subject_lines, ' ') AS s0 FROM m4),
m6 AS (SELECT *, coalesce(nullif({_CLIP_SQL.format('s0')}, ''), nullif({_CLIP_SQL.format('stem')}, ''), title) AS subject FROM m5)"""


def _metadata(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, l, document_type, title and subject of each document; the series of an act stands for a file's name."""
    t = _typed(_titled(_docs(spark, d, "act_series")), "document_type", _LABELS, _label).withColumn("stem", F.coalesce("act_series", F.lit("")))
    t = _settled(t, "title", tx.clip(F.array_join("l", " "), _MOST))
    t = _settled(t, "title", F.when((F.col("title") == "") | ((F.length("title") < 40) & (F.length("stem") > F.length("title"))), tx.clip(F.col("stem"), _MOST)).otherwise(F.col("title")))
    at = F.array_position("named", F.lit(True))
    t = _settled(t, "kept", F.filter(F.slice("l", (at + 1).cast("int"), F.greatest(F.size("l"), F.lit(1))), lambda x: ~F.lower(x).rlike(_DATED)))
    t = _settled(t, "stop", F.array_position(F.transform("kept", lambda x: F.lower(x).rlike(_re2(_STOPS))), F.lit(True)))
    before = F.when(F.col("stop") > 0, F.slice("kept", F.lit(1), (F.col("stop") - 1).cast("int"))).otherwise(F.col("kept"))
    only_type = lambda x: (F.col("document_type") != "unknown") & (F.trim(F.lower(x), F.lit(" .,:;№n")) == F.col("document_type"))
    t = _settled(t, "subject", tx.clip(F.array_join(F.filter(before, lambda x: ~only_type(x)), " "), _MOST))
    return t.withColumn("subject", F.coalesce(F.nullif("subject", F.lit("")), F.nullif(tx.clip(F.col("stem"), _MOST), F.lit("")), "title"))


@query(f"WITH {_M0} SELECT doc_id, title, document_type, CASE WHEN document_type = 'unknown' THEN subject ELSE upper(left(document_type, 1)) || substr(document_type, 2) || ': ' || subject END AS summary, CASE WHEN document_type <> 'unknown' AND subject <> '' AND subject <> title AND len(l) >= 2 THEN 'high' WHEN document_type <> 'unknown' OR subject <> '' THEN 'medium' ELSE 'low' END AS confidence FROM m6")
def document_metadata(spark, d):
    """Title, type, summary and how sure they are."""
    c = F.col
    known = c("document_type") != "unknown"
    summary = F.when(~known, c("subject")).otherwise(F.concat(F.upper(F.substring("document_type", 1, 1)), F.expr("substring(document_type, 2)"), F.lit(": "), "subject"))
    sure = F.when(known & (c("subject") != "") & (c("subject") != c("title")) & (F.size("l") >= 2), "high").when(known | (c("subject") != ""), "medium").otherwise("low")
    return _metadata(spark, d).select("doc_id", "title", "document_type", summary.alias("summary"), sure.alias("confidence"))


@query(f"WITH {_M0} SELECT doc_id, subject, len(subject_lines)::INT > 0 AS from_title FROM m6")
def subject_extract(spark, d):
    """What a document is about: the title lines behind its type, without dates, numbers and the type, up to where the body
    begins; else the series, else the title."""
    t = _metadata(spark, d)
    before = F.when(F.col("stop") > 0, F.slice("kept", F.lit(1), (F.col("stop") - 1).cast("int"))).otherwise(F.col("kept"))
    only_type = lambda x: (F.col("document_type") != "unknown") & (F.trim(F.lower(x), F.lit(" .,:;№n")) == F.col("document_type"))
    return t.select("doc_id", "subject", F.exists(before, lambda x: ~only_type(x)).alias("from_title"))


@query(f"WITH {_M0} SELECT doc_id, title FROM m6")
def title_select(spark, d):
    """The title lines joined, or the series where that says more."""
    return _metadata(spark, d).select("doc_id", "title")


@query(f"WITH {_TITLED} SELECT doc_id, unnest(range(1, len(l) + 1))::INT AS position, unnest(l) AS line FROM t")
def title_lines(spark, d):
    """The lines of the title: the feature itself, at most ten of a document."""
    return _titled(_docs(spark, d)).select("doc_id", F.posexplode("l").alias("p", "line")).select("doc_id", (F.col("p") + 1).alias("position"), "line")


@query(f"SELECT doc_id, line_no, line FROM (SELECT doc_id, line_no, s AS line, lag(s) OVER (PARTITION BY doc_id ORDER BY line_no) AS before FROM (SELECT doc_id, line_no, {_SQUEEZE.format('line')} AS s FROM {_L}) WHERE s <> '') WHERE before IS DISTINCT FROM line")
def metadata_lines(spark, d):
    s = _lines(spark, d).select("doc_id", "line_no", tx.squeeze(F.col("line")).alias("line")).where("line <> ''")
    return s.withColumn("before", F.lag("line").over(Window.partitionBy("doc_id").orderBy("line_no"))).where("not (before <=> line)").drop("before")


@query(f"""WITH {_TITLED}, e AS (SELECT doc_id, list_filter(list_transform(l, lambda x: nullif(regexp_extract(trim(lower(x), ' .,:;№n'), '^({_LABEL_NAMES})( |$)', 1), '')), lambda x: x IS NOT NULL)[1] AS exact, {_first_sql(_LABELS, 'array_to_string(l, chr(10))')} AS header, {_first_sql(_LABELS, 'substr(text, 1, 1000)')} AS body,
nullif(regexp_extract(text, '№ *([0-9]+(-[0-9]+)?)', 1), '') AS number, try_strptime(nullif(regexp_extract(array_to_string(head, chr(10)), '([0-9]{{2}}\\.[0-9]{{2}}\\.[0-9]{{4}})', 1), ''), '%d.%m.%Y')::DATE AS dated FROM t)
SELECT *, CASE WHEN exact IS NOT NULL THEN 'exact' WHEN header IS NOT NULL THEN 'header' WHEN body IS NOT NULL THEN 'body' ELSE 'none' END AS origin FROM e""")
def header_type(spark, d):
    """Where a document's type is told: an exact label in the title comes before a pattern in it, the title before the body.
    Beside it the date in the first 30 lines and the number in the whole text."""
    t = _settled(_settled(_titled(_docs(spark, d)), "joined", F.lower(F.array_join("l", "\n"))), "front", F.lower(F.substring("text", 1, 1000)))
    dated = F.regexp_extract(F.array_join("head", "\n"), r"([0-9]{2}\.[0-9]{2}\.[0-9]{4})", 1)
    t = t.select(
        "doc_id", F.get(F.array_compact(F.transform("low", _label)), F.lit(0)).alias("exact"), _classified(_LABELS, F.col("joined")).alias("header"), _classified(_LABELS, F.col("front")).alias("body"),
        F.nullif(F.regexp_extract("text", "№ *([0-9]+(-[0-9]+)?)", 1), F.lit("")).alias("number"), F.try_to_timestamp(F.nullif(dated, F.lit("")), F.lit("dd.MM.yyyy")).cast("date").alias("dated"),
    )
    return t.withColumn("origin", F.when(F.col("exact").isNotNull(), "exact").when(F.col("header").isNotNull(), "header").when(F.col("body").isNotNull(), "body").otherwise("none"))


@query(f"WITH {_M0} SELECT doc_id, CASE WHEN document_type <> 'unknown' AND subject <> '' AND subject <> title AND len(l) >= 2 THEN 'high' WHEN document_type <> 'unknown' OR subject <> '' THEN 'medium' ELSE 'low' END AS confidence FROM m6")
def metadata_confidence(spark, d):
    return document_metadata(spark, d).select("doc_id", "confidence")


@query("SELECT text_sha, min(doc_id) AS doc_id, count(*) AS copies FROM (SELECT sha256(text) AS text_sha, doc_id FROM documents WHERE text IS NOT NULL) GROUP BY 1 HAVING count(*) > 1")
def exact_copies(spark, d):
    return _docs(spark, d).select("doc_id", F.sha2("text", 256).alias("text_sha")).groupBy("text_sha").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).where("copies > 1")


# What is no secret, and the least length of one.
_NO_SECRET, _SECRET_CHARS = ("", "paste-api-key-here", "your-api-key-here", "change-me"), 4


def redacted(text: Column, secrets: dict[str, str]) -> Column:
    """The text with every secret value replaced by the name of its setting, the longest value first.

    secrets: settings by name; only names that hold API_KEY, TOKEN or SECRET count, values are stripped, and of settings
    with one value the first names it. Null stays null.
    """
    named: dict[str, str] = {}
    for key, raw in secrets.items():
        value = raw.strip()
        if any(mark in key.upper() for mark in ("API_KEY", "TOKEN", "SECRET")) and len(value) >= _SECRET_CHARS and value.lower() not in _NO_SECRET:
            named.setdefault(value, key)
    for value in sorted(named, key=len, reverse=True):
        text = F.replace(text, F.lit(value), F.lit(f"[REDACTED_ENV:{named[value]}]"))
    return text


def redacted_frame(df: DataFrame, secrets: dict[str, str]) -> DataFrame:
    """df with every string in it redacted, at any depth of structs, arrays and map values; keys and names stay."""
    def deep(value: Column, kind: T.DataType) -> Column:
        if isinstance(kind, T.StringType):
            return redacted(value, secrets)
        if isinstance(kind, T.ArrayType):
            return F.transform(value, lambda x: deep(x, kind.elementType))
        if isinstance(kind, T.MapType):
            return F.transform_values(value, lambda _, x: deep(x, kind.valueType))
        if isinstance(kind, T.StructType):
            return F.when(value.isNotNull(), F.struct(*[deep(value[f.name], f.dataType).alias(f.name) for f in kind.fields]))
        return value

    return df.select(*[deep(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields])


#: Words of the corpus that stand for secrets in the query.
_SECRETS = {"DEMO_API_KEY": "camera", "SECOND_TOKEN": "cameras and", "THE_SECRET": "смет", "OTHER_TOKEN": "сметной", "PATH": "the", "SHORT_TOKEN": "abc", "SAME_SECRET": "смет", "EMPTY_TOKEN": "change-me"}


@query("SELECT doc_id, replace(replace(replace(replace(text, 'cameras and', '[REDACTED_ENV:SECOND_TOKEN]'), 'сметной', '[REDACTED_ENV:OTHER_TOKEN]'), 'camera', '[REDACTED_ENV:DEMO_API_KEY]'), 'смет', '[REDACTED_ENV:THE_SECRET]') AS text, source, lang FROM documents")
def redact(spark, d):
    return redacted_frame(table(spark, d, "documents", "doc_id", "text", "source", "lang"), _SECRETS)


@query("SELECT event_type, strftime(date_trunc('hour', ts), '%Y-%m-%dT%H:00:00') AS hour, count(*) AS n, sum(value::DECIMAL(18, 4))::DOUBLE AS value FROM events GROUP BY 1, 2")
def event_windows(spark, d):
    e = table(spark, d, "events", "ts", "event_type", "value").groupBy("event_type", F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,4)")).cast("double").alias("value"))
    return e.select("event_type", F.date_format("w.start", "yyyy-MM-dd'T'HH:00:00").alias("hour"), "n", "value")


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS iso, CASE WHEN value >= 95 THEN 'high' WHEN value >= 80 THEN 'medium' ELSE 'low' END AS bucket, greatest(0, least(5, round_even(value / 20, 0)))::INT AS score FROM events")
def iso_cell(spark, d):
    v = F.col("value")
    return table(spark, d, "events", "event_id", "ts", "value").select("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("iso"), F.when(v >= 95, "high").when(v >= 80, "medium").otherwise("low").alias("bucket"), F.greatest(F.lit(0), F.least(F.lit(5), F.bround(v / 20, 0))).cast("int").alias("score"))


@query("SELECT user_id, best, second, best >= 0.16 AND best - second >= 0.02 AS decided FROM (SELECT user_id, list_reverse_sort(list(DISTINCT value))[1] AS best, coalesce(list_reverse_sort(list(DISTINCT value))[2], 0) AS second FROM events GROUP BY 1)")
def best_with_margin(spark, d):
    """Best and second-best value by two partial maxima, without gathering a user's values."""
    e = table(spark, d, "events", "user_id", "value").where("value is not null")
    best = e.groupBy("user_id").agg(F.max("value").alias("best"))
    rest = e.groupBy("user_id", "value").agg(F.lit(1)).join(best, "user_id").where("value < best").groupBy("user_id").agg(F.max("value").alias("second"))
    out = best.join(rest, "user_id", "left").withColumn("second", F.coalesce("second", F.lit(0.0)))
    return out.withColumn("decided", (F.col("best") >= 0.16) & (F.col("best") - F.col("second") >= 0.02))


@query("SELECT event_type, event_id, value FROM (SELECT event_type, event_id, value, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS r FROM events) WHERE r <= 3")
def top_n_per_group(spark, d):
    """Top three per type; the filter on the row number is pushed into the window as a group limit before the shuffle."""
    w = Window.partitionBy("event_type").orderBy(F.desc("value"), "event_id")
    return table(spark, d, "events", "event_id", "event_type", "value").withColumn("r", F.row_number().over(w)).where("r <= 3").select("event_type", "event_id", "value")


@query("SELECT doc_id, string_agg(w, ' ' ORDER BY p) AS words FROM (SELECT doc_id, w, min(p) AS p FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS w, unnest(range(1, len(string_split(text, ' ')) + 1)) AS p FROM documents WHERE text IS NOT NULL) GROUP BY 1, 2) GROUP BY 1")
def ordered_distinct(spark, d):
    return _docs(spark, d).select("doc_id", F.array_join(F.array_distinct(F.split("text", " ")), " ").alias("words"))


@query("SELECT l_orderkey, lines, CASE WHEN q > 0 THEN p::DOUBLE / q::DOUBLE ELSE 0 END AS safe_ratio FROM (SELECT l_orderkey, count(*) AS lines, sum(l_quantity::DECIMAL(18, 2)) AS q, sum(l_extendedprice::DECIMAL(18, 2)) AS p FROM lineitem GROUP BY 1)")
def safe_ratio(spark, d):
    """Sums in decimals, so the result doesn't depend on the order of rows."""
    exact = lambda c: F.sum(F.col(c).cast("decimal(18,2)")).cast("double")
    g = table(spark, d, "lineitem", "l_orderkey", "l_quantity", "l_extendedprice").groupBy("l_orderkey").agg(F.count("*").alias("lines"), exact("l_quantity").alias("q"), exact("l_extendedprice").alias("p"))
    return g.select("l_orderkey", "lines", F.when(F.col("q") > 0, F.col("p") / F.col("q")).otherwise(0.0).alias("safe_ratio"))
