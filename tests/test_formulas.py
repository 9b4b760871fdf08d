import random

import pytest
from pyspark.sql import functions as F

from docweave.functions import formulas as fx
from docweave.functions import text as tx
from docweave.plans.formulas import evaluate_documents


@pytest.mark.parametrize(
    ("linear", "calc"),
    [
        ("Ж_(см) = Н_(1) + Щ_(к)", "Zh_sm = N_1 + Shch_k"), ("W = (2 - Q_(b)%)^3", "W = ( 2 - Q_b / 100 ) ** 3"), ("k = a × 1,5 ÷ b", "k = a * 1.5 / b"), ("∑ x = 1", None), ("a + b", "a + b"), ("", None), (None, None),
        ("plain words", None), ("цена: P = 2 x 3", "P = 2 * 3"), ("итог (K = a × b) руб.", "K = a * b"), ("x = a; y = b + 1", "x = a"), ("S_(2)^(н) = [a + b] : c", "S_2_n = ( a + b ) / c"), ("q = * % 3", None), ("r = a & b", None),
    ],
)
def test_calculable(linear, calc):
    assert fx.calculable(linear) == calc


def test_candidates_and_symbols():
    assert fx.candidates("тариф: A = B = c; D = e,") == ["тариф: A = B = c; D = e", "A = B = c; D = e", "тариф: A = B = c", "A = B = c", "D = e", "c; D", "B", "тариф: A", "A"]
    assert fx.symbol("Ц_(б ю)^(1)") == ("Ц_б_ю_1", "Ts_b_yu_1") and fx.symbol("1a") is None and fx.symbol("Ъ") is None
    assert fx.tokens("3% + a") == ("3 / 100 + a", {"a": "a"}) and fx.tokens("a ? b") is None and fx.tokens(" ") is None


def test_latex_and_representation():
    assert fx.latex("Кол_(ж) = a_(2)^(к) × 5%") == r"\mathrm{Кол}_{\text{ж}} = a_{2}^{\text{к}}  \times  5\%"
    assert fx.latex("sum_(i=1)^n b^(2)") == r"\sum_{i=1}^{n} b^{2}"
    assert fx.representation("d = 1 ÷ КЗ")["confidence"] == "high" and fx.representation("d = 1 ÷ КЗ")["calc_expr"] is None
    assert fx.representation("g = h × 2")["warnings"] == [fx.HEURISTIC_DISPLAY, fx.HEURISTIC_CALC, fx.NEEDS_BINDING]
    assert fx.representation("только слова") is None and fx.representation("x", {"known": 1}) == {"known": 1}


def test_evaluate():
    target, tree, names = fx.parse("W = ( 2 - Q_b / 100 ) ** 3")
    assert (target, names) == ("W", ["Q_b"])
    assert fx.evaluate(tree, {"Q_b": 50}) == pytest.approx(3.375)
    assert fx.parse("R = sum(A, B)") is None and fx.parse("1a = 2") is None and fx.parse("a = True") is None
    assert fx.parse("a + 1")[0] is None and fx.parse("a = b = 1") is None


def brute(formulas, values):
    """unit -> (outcome, value, missing), taken in passes until one has no success."""
    known, out, waiting = dict(values), {}, list(formulas)
    while waiting:
        left, moved = [], False
        for unit, calc in waiting:
            parsed = fx.parse(calc)
            if parsed is None:
                out[unit] = ("error", None, "")
            elif any(n not in known for n in parsed[2]):
                left.append((unit, calc))
            else:
                try:
                    v = fx.evaluate(parsed[1], known)
                    out[unit], moved = ("ok", v, ""), True
                    if parsed[0]:
                        known[parsed[0]] = v
                except ZeroDivisionError:
                    out[unit] = ("error", None, "")
        waiting = left
        if not moved:
            break
    for unit, calc in waiting:
        out[unit] = ("missing", None, ", ".join(n for n in fx.parse(calc)[2] if n not in known))
    return out


def test_documents_are_evaluated_in_passes(spark):
    rng = random.Random(4)
    rows, given, want = [], [], {}
    for d in range(8):
        names = [f"n{i}" for i in range(7)]
        values = {n: float(rng.randrange(-1, 3)) for n in rng.sample(names, 2)}
        formulas = [(f"u{i:02d}", f"{rng.choice(names)} = {rng.choice(names)} {rng.choice('+*/-')} {rng.choice([*names, '0'])}") for i in range(12)] + [("u98", "b = f ( 1 )"), ("u99", "n1 + 1")]
        rows += [(f"d{d}", i, u, c) for i, (u, c) in enumerate(formulas)]
        given += [(f"d{d}", n, v) for n, v in values.items()]
        want |= {(f"d{d}", u): x for u, x in brute(formulas, values).items()}
    f = spark.createDataFrame(rows + [("d0", 1, "null", None), ("d0", 1, "blank", " ")], "document_id string, unit_order int, unit_id string, calc_expr string")
    v = spark.createDataFrame(given + [("d0", None, 1.0)], "document_id string, name string, value double")
    got = {(r.document_id, r.unit_id): (r.outcome, r.value, r.missing) for r in evaluate_documents(f, v).collect()}
    assert got == want and {x[0] for x in want.values()} == {"ok", "missing", "error"}
    assert evaluate_documents(f.limit(0), v.limit(0)).count() == 0


def test_expressions(spark):
    df = spark.createDataFrame([("a  b\n c ",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(tx.squeeze(F.col("t"))).collect()] == ["a b c", "", None]
    assert [r[0] for r in df.select(tx.token_estimate(F.lit("abcde, x!"))).collect()][0] == 5
    assert df.select(tx.transliterate(F.lit("Щука ёж, Цех"))).first()[0] == "Shchuka ezh, Tsekh"
    assert df.select(fx.normalize(F.lit(" A = B + C, (1.2), "))).first()[0] == "A = B + C"
    assert df.select(fx.normalize(F.lit("A = B ×\n × C;  ГДЕ: "))).first()[0] == "A = B × C"
    assert df.select(fx.symbol_key(F.lit("Ц_(б ю)^(1)"))).first()[0] == "Ts_b_yu_1" and df.select(fx.symbol_key(F.lit("a b"))).first()[0] is None
