"""Formulas: projections, summaries, gold comparison, gates, calculable forms, evaluation."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.functions import formulas as fx
from docweave.operators import ordered
from docweave.plans.register import Registry
from docweave.sources.tables import table

_R = Registry()
QUERIES, SQL, query = _R.queries, _R.sql, _R.add
#: Distinct formula units, as SQL.
_F = "(SELECT DISTINCT document_id, unit_id, coalesce(unit_order, 0) AS unit_order, type, text, asset_ref, formula.source_format AS source_format, formula.linear_text AS linear_text, formula.display_latex AS display_latex, formula.calc_expr AS calc_expr, formula.confidence AS confidence, coalesce(len(formula.warnings), 0) AS n_warnings FROM document_units WHERE type IN ('formula', 'formula_image') AND formula IS NOT NULL)"


def _formulas(spark: SparkSession, d: str) -> DataFrame:
    u = table(spark, d, "document_units", "document_id", "unit_id", "unit_order", "type", "text", "asset_ref", "formula").where("type in ('formula', 'formula_image') and formula is not null")
    f = lambda n: F.col(f"formula.{n}").alias(n)
    return u.select("document_id", "unit_id", F.coalesce("unit_order", F.lit(0)).alias("unit_order"), "type", "text", "asset_ref", f("source_format"), f("linear_text"), f("display_latex"), f("calc_expr"), f("confidence"), F.coalesce(F.when(F.col("formula.warnings").isNotNull(), F.size("formula.warnings")), F.lit(0)).cast("long").alias("n_warnings")).distinct()


@query(f"SELECT document_id, unit_id, (row_number() OVER (PARTITION BY document_id ORDER BY unit_order, unit_id) - 1)::INT AS formula_index, nullif(trim(calc_expr), '') AS calc_expr, coalesce(confidence, '') IN ('low', 'medium') OR n_warnings > 0 AS review FROM {_F}")
def formula_units(spark, d):
    f = ordered.running_sum(_formulas(spark, d), "document_id", ["unit_order", "unit_id"], F.lit(1), "n")
    return f.select("document_id", "unit_id", (F.col("n") - 1).cast("int").alias("formula_index"), F.nullif(F.trim("calc_expr"), F.lit("")).alias("calc_expr"), (F.coalesce("confidence", F.lit("")).isin("low", "medium") | (F.col("n_warnings") > 0)).alias("review"))


@query(f"SELECT document_id, unit_id, CASE WHEN type = 'formula_image' AND asset_ref IS NOT NULL THEN 'image' WHEN type = 'formula' AND text <> '' THEN 'text' END AS kind FROM {_F} WHERE coalesce(confidence, 'low') <> 'high' AND coalesce(trim(calc_expr), '') = ''")
def recognition_candidates(spark, d):
    kind = F.when((F.col("type") == "formula_image") & F.col("asset_ref").isNotNull(), "image").when((F.col("type") == "formula") & (F.col("text") != ""), "text")
    return _formulas(spark, d).where((F.coalesce("confidence", F.lit("low")) != "high") & (F.coalesce(F.trim("calc_expr"), F.lit("")) == "")).select("document_id", "unit_id", kind.alias("kind"))


@query(f"SELECT document_id, unit_id, coalesce(trim(calc_expr), '') <> '' AS calculable, coalesce(confidence, '') IN ('high', 'medium') AS trusted, CASE WHEN coalesce(trim(calc_expr), '') <> '' THEN 'calculable' WHEN coalesce(display_latex, linear_text, '') <> '' THEN 'display_only' ELSE 'unresolved' END AS class FROM {_F}")
def formula_class(spark, d):
    calc = F.coalesce(F.trim("calc_expr"), F.lit("")) != ""
    return _formulas(spark, d).select("document_id", "unit_id", calc.alias("calculable"), F.coalesce("confidence", F.lit("")).isin("high", "medium").alias("trusted"), F.when(calc, "calculable").when(F.coalesce("display_latex", "linear_text", F.lit("")) != "", "display_only").otherwise("unresolved").alias("class"))


@query(f"SELECT DISTINCT f.document_id, f.unit_id, g.calc_expr AS known_calc FROM {_F} f JOIN (SELECT linear_text, min(calc_expr) AS calc_expr FROM formula_gold WHERE calc_expr IS NOT NULL GROUP BY 1) g ON g.linear_text = f.linear_text")
def known_formula_lookup(spark, d):
    known = table(spark, d, "formula_gold", "linear_text", "calc_expr").where("calc_expr is not null").groupBy("linear_text").agg(F.min("calc_expr").alias("known_calc"))
    return _formulas(spark, d).join(known, "linear_text").select("document_id", "unit_id", "known_calc").distinct()


#: Signature rules in their order: name, the exact text, marks that must all occur, and (marks, ending) pairs of which one must hold.
_SIGNS = (
    ("identity", "К_(ср) = С_(ср)", (), ()), ("price", None, ("СТ", "ОТ"), ()), ("labour", None, ("ЗТ", "="), ()), ("rate", None, (), ((("НР", "×"), ","), (("МР",), ":"))),
    ("cost", None, ("TC",), ()), ("share", None, ("÷",), ()),
)


def _holds_sql(exact: str | None, marks: tuple, endings: tuple) -> str:
    every = lambda ms: " AND ".join(f"contains(text, '{m}')" for m in ms)
    return " OR ".join(filter(None, [f"text = '{exact}'" if exact else "", every(marks), *[f"({every(ms)} AND ends_with(text, '{end}'))" for ms, end in endings]]))


@query(f"SELECT document_id, unit_id, CASE {' '.join(f"WHEN {_holds_sql(*rule[1:])} THEN '{rule[0]}'" for rule in _SIGNS)} END AS signature FROM {_F} WHERE text IS NOT NULL")
def signature_match(spark, d):
    """The first rule that holds: its exact text, all its marks, or one of its pairs of marks and ending. The rules are
    few, so they become one expression."""
    text = F.col("text")

    def every(marks: tuple) -> Column:
        return reduce(lambda a, b: a & b, [text.contains(m) for m in marks])

    chosen: Column = F.lit(None).cast("string")
    for name, exact, marks, endings in reversed(_SIGNS):
        options = ([text == exact] if exact else []) + ([every(marks)] if marks else []) + [every(ms) & text.endswith(end) for ms, end in endings]
        chosen = F.when(reduce(lambda a, b: a | b, options), name).otherwise(chosen)
    return _formulas(spark, d).where("text is not null").select("document_id", "unit_id", chosen.alias("signature"))


def _normalize_sql(text: str) -> str:
    steps = [fx.NORMALIZE[0], fx.NORMALIZE[1], *[(f"[{c}]\\s*\\n+\\s*[{c}]" if c != "-" else r"-\s*\n+\s*-", c) for c in fx.CONTINUES], *fx.NORMALIZE[2:]]
    text = f"trim({text})"
    for pattern, to in steps:
        text = f"regexp_replace({text}, '{pattern}', '{to}', 'g')"
    return f"trim({text})"


@query(f"SELECT document_id, unit_id, {_normalize_sql('text')} AS linear FROM {_F} WHERE text IS NOT NULL")
def formula_normalize(spark, d):
    return _formulas(spark, d).where("text is not null").select("document_id", "unit_id", fx.normalize(F.col("text")).alias("linear"))


@query(f"SELECT document_id, unit_id, nullif(regexp_extract(text, '\\(([0-9]+(?:\\.[0-9]+)*)\\)[ ,.;]*(?:где:|where:)?$', 1), '') AS number FROM {_F} WHERE text IS NOT NULL")
def formula_number(spark, d):
    return _formulas(spark, d).where("text is not null").select("document_id", "unit_id", fx.number_of(F.col("text")).alias("number"))


_TIMES_SQL = "regexp_replace({}, '([)\\]A-Za-zА-Яа-я0-9])\\s+(?:[×xX]\\s+)*[×xX]\\s+([(\\[A-Za-zА-Яа-я0-9])', '\\1 × \\2', 'g')"


@query(f"SELECT document_id, unit_id, {_TIMES_SQL.format(_TIMES_SQL.format('text'))} AS operators FROM {_F} WHERE text IS NOT NULL")
def operator_normalize(spark, d):
    return _formulas(spark, d).where("text is not null").select("document_id", "unit_id", fx.operators(F.col("text")).alias("operators"))


def _translit_sql(x: str) -> str:
    from docweave.functions.text import DIGRAPHS, SINGLE

    for a, b in DIGRAPHS:
        x = f"replace({x}, '{a}', '{b}')"
    return f"translate({x}, '{SINGLE[0]}', '{SINGLE[1]}')"


_SYMBOL = r"^([A-Za-zА-Яа-я][A-Za-zА-Яа-я0-9]*)(?:_\(([^()]+)\))?(?:\^\(([^()]+)\))?$"


@query(f"""WITH p AS (SELECT symbol, list_transform([1, 2, 3], lambda i: CASE i WHEN 1 THEN regexp_extract(symbol, '{_SYMBOL}', 1) WHEN 2 THEN regexp_extract(symbol, '{_SYMBOL}', 2) ELSE regexp_extract(symbol, '{_SYMBOL}', 3) END) AS parts FROM (SELECT DISTINCT unnest(map_keys(formula.variables)) AS symbol FROM document_units)),
k AS (SELECT symbol, array_to_string(list_filter(list_transform(parts, lambda x: trim(regexp_replace(x, '[^0-9A-Za-zА-Яа-я]+', '_', 'g'), '_')), lambda x: x <> ''), '_') AS k FROM p),
t AS (SELECT symbol, trim(regexp_replace({_translit_sql('k')}, '_+', '_', 'g'), '_') AS t FROM k)
SELECT symbol, nullif(CASE WHEN regexp_matches(t, '^[0-9]') THEN 'v_' || t ELSE t END, '') AS key FROM t""")
def symbol_key(spark, d):
    s = table(spark, d, "document_units", "formula.variables").select(F.explode(F.map_keys("variables")).alias("symbol")).distinct()
    return s.select("symbol", fx.symbol_key(F.col("symbol")).alias("key"))


def _each(df, make: Callable[[str | None], tuple], schema: str, keys: tuple[str, ...] = ("document_id", "unit_id"), text: str = "linear") -> DataFrame:
    """The keys and what make says of each text; texts cross into Python as Arrow batches."""
    width = len(schema.split(", "))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            made = [make(x) for x in b[text]]
            out = b[list(keys)].copy()
            for i, name in enumerate(x.split(" ")[0] for x in schema.split(", ")):
                out[name] = pd.Series([m[i] for m in made] if width else [], dtype=object, index=out.index)
            yield out

    return df.select(*dict.fromkeys((*keys, text))).mapInPandas(run, ", ".join(f"{k} string" for k in keys) + ", " + schema)


def _linear(spark, d) -> DataFrame:
    return _formulas(spark, d).where("text is not null").select("document_id", "unit_id", fx.normalize(F.col("text")).alias("linear"))


def _pairs(names: dict[str, str]) -> str:
    return "; ".join(f"{k}={v}" for k, v in names.items())


@query()
def formula_tokens(spark, d):
    """Tokens of each formula's right side, parted by spaces, and their number; null where a sign isn't known."""
    def make(x):
        got = fx.tokens(x.split("=", 1)[-1])
        return (got[0], len(got[0].split())) if got else (None, None)

    return _each(_linear(spark, d), make, "tokens string, n int")


@query()
def calc_candidates(spark, d):
    """One row per part of a formula's text that may state a calculation, in the order in which they are tried."""
    rows = _each(_linear(spark, d), lambda x: ("\x1f".join(fx.candidates(x)),), "parts string")
    return rows.select("document_id", "unit_id", F.posexplode(F.split("parts", "\x1f")).alias("position", "candidate")).where("candidate <> ''")


@query()
def calc_expr(spark, d):
    """The calculation each formula's text states, with its variables (key=ASCII name, target first)."""
    def make(x):
        said = fx.calculation(x)
        return (said[0], _pairs(said[1])) if said else (None, None)

    return _each(_linear(spark, d), make, "calc_expr string, variables string")


@query()
def formula_latex(spark, d):
    return _each(_linear(spark, d), lambda x: (fx.latex(x),), "latex string")


@query()
def formula_representation(spark, d):
    """The whole decision for each formula's text. Known formulas are the gold ones; they stand in the table joined."""
    known = table(spark, d, "formula_gold", F.col("linear_text").alias("linear"), F.col("source_format").alias("k_format"), F.col("display_latex").alias("k_latex"), F.col("calc_expr").alias("k_calc")).groupBy("linear").agg(F.min(F.struct("k_format", "k_latex", "k_calc")).alias("k"))

    def make(x):
        got = fx.representation(x)
        return (got["source_format"], got["display_latex"], got["calc_expr"], got["confidence"], "; ".join(got["warnings"]), len(got["variables"])) if got else (None,) * 6

    made = _each(_linear(spark, d), make, "source_format string, display_latex string, calc_expr string, confidence string, warnings string, variables int", ("document_id", "unit_id", "linear"))
    sure = F.col("k").isNotNull()
    return made.join(known, "linear", "left").select("document_id", "unit_id", "linear", sure.alias("known"), *[F.when(sure, F.col(f"k.{k}")).otherwise(F.col(c)).alias(c) for c, k in (("source_format", "k_format"), ("display_latex", "k_latex"), ("calc_expr", "k_calc"))], F.when(sure, "high").otherwise(F.col("confidence")).alias("confidence"), F.when(sure, "").otherwise(F.col("warnings")).alias("warnings"))


@query("""WITH f AS (SELECT DISTINCT document_id, unit_id, formula.source_format AS source_format, coalesce(list_contains(formula.warnings, 'formula_native_wmf_pattern_recovered'), false) AS recovered, formula.provenance AS given FROM document_units WHERE formula.source_format IS NOT NULL)
SELECT document_id, unit_id, CASE WHEN given IS NOT NULL AND given.parser_path IS NOT NULL THEN given.parser_path WHEN source_format <> 'mathtype_wmf_text_records' THEN 'docx_text_heuristic' WHEN recovered THEN 'mathtype_wmf_known_pattern' ELSE 'mathtype_wmf_text_records' END AS parser_path,
CASE WHEN given IS NOT NULL AND given.parser_path IS NOT NULL THEN given.normalization ELSE 'formula_text_v1' END AS normalization,
CASE WHEN given IS NOT NULL AND given.parser_path IS NOT NULL THEN given.confidence_basis WHEN source_format = 'mathtype_wmf_text_records' THEN 'native_wmf_text_records' ELSE 'heuristic_text_normalization' END AS confidence_basis FROM f""")
def formula_provenance(spark, d):
    """Provenance as delivered, else told by the source format and the warnings."""
    f = table(spark, d, "document_units", "document_id", "unit_id", "formula.source_format", F.col("formula.provenance").alias("given"), F.coalesce(F.array_contains("formula.warnings", fx.RECOVERED), F.lit(False)).alias("recovered")).where("source_format is not null")
    has, native = F.col("given.parser_path").isNotNull(), F.col("source_format") == fx.WMF
    path = F.when(has, F.col("given.parser_path")).when(~native, "docx_text_heuristic").when(F.col("recovered"), "mathtype_wmf_known_pattern").otherwise(fx.WMF)
    return f.select("document_id", "unit_id", path.alias("parser_path"), F.when(has, F.col("given.normalization")).otherwise("formula_text_v1").alias("normalization"), F.when(has, F.col("given.confidence_basis")).when(native, "native_wmf_text_records").otherwise("heuristic_text_normalization").alias("confidence_basis")).distinct()


@query(f"""WITH g AS (SELECT {_normalize_sql('text')} AS noisy, min(linear_text) AS clean FROM formula_gold WHERE text IS NOT NULL AND linear_text IS NOT NULL GROUP BY 1),
f AS (SELECT document_id, unit_id, {_normalize_sql('text')} AS linear FROM {_F} WHERE text IS NOT NULL)
SELECT document_id, unit_id, coalesce(g.clean, f.linear) AS linear, g.clean IS NOT NULL AS recovered FROM f LEFT JOIN g ON g.noisy = f.linear""")
def noisy_recovery(spark, d):
    """Texts as scanned or typed replaced by the clean form the gold table has for them."""
    clean = table(spark, d, "formula_gold", fx.normalize(F.col("text")).alias("linear"), "linear_text").where("linear is not null and linear_text is not null").groupBy("linear").agg(F.min("linear_text").alias("clean"))
    return _linear(spark, d).join(clean, "linear", "left").select("document_id", "unit_id", F.coalesce("clean", "linear").alias("linear"), F.col("clean").isNotNull().alias("recovered"))


@query(f"""WITH o AS (SELECT document_id, unit_id, unit_order, type, text, lag(type) OVER w AS t1, lag(text) OVER w AS x1, lag(unit_id) OVER w AS u1 FROM (SELECT DISTINCT document_id, unit_id, unit_order, type, text FROM document_units_ordered) WINDOW w AS (PARTITION BY document_id ORDER BY unit_order, unit_id)),
c AS (SELECT document_id, unit_id, u1, x1, text, right(rtrim(x1), 1) AS op FROM o WHERE t1 = 'formula' AND text IS NOT NULL AND contains('+-x×÷*/=', right(rtrim(x1), 1)) AND rtrim(x1) <> '')
SELECT document_id, u1 AS unit_id, unit_id AS continued_by, trim(rtrim(x1) || ' ' || CASE WHEN starts_with(text, op) THEN ltrim(substr(text, 2)) ELSE text END) AS merged FROM c WHERE starts_with(text, op) OR left(text, 1) IN ('(', '[', '{{')""".replace("document_units_ordered", "(SELECT document_id, unit_id, coalesce(unit_order, 0) AS unit_order, type, text FROM document_units)"))
def formula_continuation(spark, d):
    """A formula that ends in an operator, and the next unit of the reading order that begins with the same one or a bracket."""
    u = table(spark, d, "document_units", "document_id", "unit_id", F.coalesce("unit_order", F.lit(0)).alias("unit_order"), "type", "text").distinct()
    p = ordered.previous(u, "document_id", ["unit_order", "unit_id"], F.struct("unit_id", "type", "text"), "p").where("p.type = 'formula' and text is not null")
    left, text = F.rtrim("p.text"), F.col("text")
    op = F.substring(left, -1, 1)
    p = p.withColumn("left", left).withColumn("op", op).where((F.col("left") != "") & F.lit(fx.CONTINUES).contains(F.col("op")))
    same = text.startswith(F.col("op"))
    rest = F.when(same, F.ltrim(F.expr("substring(text, 2)"))).otherwise(text)
    return p.where(same | F.substring(text, 1, 1).isin("(", "[", "{")).select("document_id", F.col("p.unit_id").alias("unit_id"), F.col("unit_id").alias("continued_by"), F.trim(F.concat("left", F.lit(" "), rest)).alias("merged"))


@query("""WITH c AS (SELECT DISTINCT formula.calc_expr AS calc FROM document_units WHERE formula.calc_expr IS NOT NULL),
p AS (SELECT calc, trim(split_part(calc, '=', 1), ' ') AS target, trim(substr(calc, strpos(calc, '=') + 1), ' ') AS expression, contains(calc, '=') AS assigns FROM c)
SELECT calc AS calc_expr, CASE WHEN assigns THEN target END AS target, CASE WHEN assigns THEN expression ELSE trim(calc, ' ') END AS expression, (NOT assigns OR regexp_full_match(target, '[A-Za-z_][A-Za-z0-9_]*')) AND regexp_full_match(CASE WHEN assigns THEN expression ELSE trim(calc, ' ') END, '[-A-Za-z0-9_ .+*/()]+') AS plausible FROM p""")
def formula_columns(spark, d):
    """Each distinct calculation parted at its first equals sign, and whether it holds but arithmetic signs, names and numbers."""
    c = table(spark, d, "document_units", F.col("formula.calc_expr").alias("calc_expr")).where("calc_expr is not null").distinct()
    assigns = F.col("calc_expr").contains("=")
    target = F.when(assigns, F.trim(F.split("calc_expr", "=", 2)[0]))
    expression = F.trim(F.when(assigns, F.split("calc_expr", "=", 2)[1]).otherwise(F.col("calc_expr")))
    return c.select("calc_expr", target.alias("target"), expression.alias("expression"), ((~assigns | target.rlike("^[A-Za-z_][A-Za-z0-9_]*$")) & expression.rlike("^[-A-Za-z0-9_ .+*/()]+$")).alias("plausible"))


_REVENUE = ("rev = l_extendedprice * ( 1 - l_discount )", "charge = rev * ( 1 + l_tax )", "unit = charge / l_quantity")


@query("SELECT l_orderkey, l_linenumber, rev, charge, charge / nullif(l_quantity, 0) AS unit FROM (SELECT *, rev * (1 + l_tax) AS charge FROM (SELECT *, l_extendedprice * (1 - l_discount) AS rev FROM lineitem))")
def formula_eval(spark, d):
    """Formulas as Columns: evaluated in the JVM, later ones over the targets of earlier ones."""
    df = table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_extendedprice", "l_discount", "l_tax", "l_quantity")
    for calc in _REVENUE:
        target, value = fx.column(calc)
        df = df.withColumn(target, value)
    return df.select("l_orderkey", "l_linenumber", "rev", "charge", "unit")


def evaluate_documents(formulas: DataFrame, values: DataFrame) -> DataFrame:
    """document_id, unit_id, target, outcome ('ok', 'error', 'missing'), value, missing (sorted names) of every formula.

    formulas: document_id, unit_order, unit_id, calc_expr; values: document_id, name, value given from outside. Formulas
    are taken in order; a target is known to all after it, in the same pass. Passes go on over what is left until one
    has no success. Division by zero and what isn't arithmetic are errors; a null document is one of its own.

    Rows stream through in order, sorted on disk where needed; what is held of a document are its values by name and the
    formulas still waiting for one, never the document.
    """
    given = values.where("name is not null and value is not null").groupBy("document_id", "name").agg(F.max("value").alias("value"))
    rows = given.select("document_id", F.lit(0).alias("k"), F.lit(0).alias("unit_order"), F.lit("").alias("unit_id"), F.col("name").alias("calc_expr"), "value")
    rows = rows.unionByName(formulas.where("trim(calc_expr) <> ''").select("document_id", F.lit(1).alias("k"), F.coalesce("unit_order", F.lit(0)).alias("unit_order"), F.coalesce("unit_id", F.lit("")).alias("unit_id"), "calc_expr", F.lit(None).cast("double").alias("value")))
    rows = rows.repartition("document_id").sortWithinPartitions("document_id", "k", "unit_order", "unit_id")
    columns = ["document_id", "unit_id", "target", "outcome", "value", "missing"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        doc, known, waiting, out, progress = None, {}, [], [], False

        def attempt(unit: str, parsed) -> bool:
            nonlocal progress
            if parsed is None:
                out.append((doc, unit, None, "error", None, ""))
                return True
            if any(n not in known for n in parsed[2]):
                return False
            try:
                value = fx.evaluate(parsed[1], known)
            except (ZeroDivisionError, OverflowError, TypeError):
                out.append((doc, unit, parsed[0], "error", None, ""))
                return True
            progress = True
            if parsed[0]:
                known[parsed[0]] = value
            out.append((doc, unit, parsed[0], "ok", value, ""))
            return True

        def close() -> None:
            nonlocal waiting, progress
            while waiting and progress:
                progress = False
                waiting = [w for w in waiting if not attempt(*w)]
            for unit, parsed in waiting:
                out.append((doc, unit, parsed[0], "missing", None, ", ".join(n for n in parsed[2] if n not in known)))

        for batch in batches:
            for document, k, unit, calc, value in zip(batch["document_id"], batch["k"], batch["unit_id"], batch["calc_expr"], batch["value"], strict=True):
                if document != doc:
                    close()
                    doc, known, waiting, progress = document, {}, [], False
                if not k:
                    known[calc] = value
                    continue
                parsed = fx.parse(calc)
                if not attempt(unit, parsed):
                    waiting.append((unit, parsed))
            yield pd.DataFrame(out, columns=columns)
            out.clear()
        close()
        yield pd.DataFrame(out, columns=columns)

    return rows.mapInPandas(run, "document_id string, unit_id string, target string, outcome string, value double, missing string")


def _document_values(spark, d) -> DataFrame:
    """Values for the evaluation queries: each name that a document's formulas declare and none of them computes stands for its length."""
    u = table(spark, d, "document_units", "document_id", "formula.variables", "formula.calc_expr")
    named = u.select("document_id", F.explode(F.map_values("variables")).alias("name")).where("name is not null").distinct()
    computed = u.where("calc_expr is not null").select("document_id", F.trim(F.split("calc_expr", "=", 2)[0]).alias("name")).distinct()
    return named.join(computed, ["document_id", "name"], "left_anti").withColumn("value", F.length("name").cast("double"))


def _evaluated(spark, d) -> DataFrame:
    f = table(spark, d, "document_units", "document_id", "unit_id", "unit_order", "formula.calc_expr").where("calc_expr is not null and document_id is not null").distinct()
    return evaluate_documents(f, _document_values(spark, d))


@query()
def document_formula_eval(spark, d):
    return _evaluated(spark, d)


@query()
def formula_eval_counts(spark, d):
    n = lambda o: F.count(F.when(F.col("outcome") == o, 1)).alias(o)
    return _evaluated(spark, d).groupBy("document_id").agg(F.count("*").alias("formulas"), n("ok"), n("missing"), n("error"))


@query(f"SELECT document_id, unit_id, sha256(to_json({{'asset': asset_ref, 'kind': type, 'prompt': 'v1', 'text': linear_text}})::VARCHAR) AS cache_key FROM {_F}")
def cache_key(spark, d):
    """The key of a prediction: what it is made from as canonical JSON (keys sorted, nulls kept, no spaces), hashed."""
    canonical = F.to_json(F.struct(F.col("asset_ref").alias("asset"), F.col("type").alias("kind"), F.lit("v1").alias("prompt"), F.col("linear_text").alias("text")), {"ignoreNullFields": "false"})
    return _formulas(spark, d).select("document_id", "unit_id", F.sha2(canonical, 256).alias("cache_key"))


@query(f"SELECT cache_key, count(*) AS uses, count(*) - 1 AS hits, min(linear_text) AS text FROM (SELECT linear_text, sha256(to_json({{'asset': asset_ref, 'kind': type, 'prompt': 'v1', 'text': linear_text}})::VARCHAR) AS cache_key FROM {_F}) GROUP BY 1")
def prediction_dedup(spark, d):
    """The predictions needed, one for each key, and how many formulas the cache then serves."""
    canonical = F.to_json(F.struct(F.col("asset_ref").alias("asset"), F.col("type").alias("kind"), F.lit("v1").alias("prompt"), F.col("linear_text").alias("text")), {"ignoreNullFields": "false"})
    g = _formulas(spark, d).groupBy(F.sha2(canonical, 256).alias("cache_key")).agg(F.count("*").alias("uses"), F.min("linear_text").alias("text"))
    return g.select("cache_key", "uses", (F.col("uses") - 1).alias("hits"), "text")


#: Strings that no text of a formula may hold.
_BANNED = ("__", "import", "\\input", "\u200b", "\ufeff", "???")


@query(f"SELECT document_id, unit_id, banned FROM (SELECT document_id, unit_id, concat_ws(chr(10), text, linear_text, display_latex, calc_expr) AS every, unnest([{', '.join(f"'{b}'" for b in _BANNED)}]) AS banned FROM {_F}) WHERE contains(every, banned)")
def banned_substrings(spark, d):
    """Each banned string in the texts of a formula put together."""
    every = F.concat_ws("\n", "text", "linear_text", "display_latex", "calc_expr")
    return _formulas(spark, d).select("document_id", "unit_id", F.explode(F.array_compact(F.array(*[F.when(every.contains(b), F.lit(b)) for b in _BANNED]))).alias("banned"))


@query(f"SELECT document_id, unit_id, coalesce(trim(display_latex, ' '), '') <> '' AND (coalesce(confidence, '') <> 'low' OR coalesce(trim(calc_expr, ' '), '') <> '' OR regexp_matches(display_latex, '\\\\[a-z]+|[_^]')) AS as_math FROM {_F}")
def render_as_math(spark, d):
    """A formula is set as mathematics if it has a display form that is sure, calculable, or marked up."""
    x = F.coalesce(F.trim("display_latex"), F.lit("")) != ""
    marked = F.col("display_latex").rlike(r"\\[a-z]+|[_^]")
    calc = F.coalesce(F.trim("calc_expr"), F.lit("")) != ""
    return _formulas(spark, d).select("document_id", "unit_id", (x & ((F.coalesce("confidence", F.lit("")) != "low") | calc | F.coalesce(marked, F.lit(False)))).alias("as_math"))
