"""Formula text: normalisation, tokens, calculable expressions, display form, evaluation.

Grammar of a linear formula: identifiers may carry a lower part ``_(…)`` and an upper part ``^(…)``; numbers may use
a decimal comma; operators are + - * / ^ and their printed forms; % divides by a hundred.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

from pyspark.sql import Column
from pyspark.sql import functions as F

from docweave.functions.text import LATIN

# Operands and operators as patterns, the operators' calculable forms, and the words of results.
_OPERAND_END, _OPERAND_START = r"[)\]A-Za-zА-Яа-я0-9]", r"[(\[A-Za-zА-Яа-я0-9]"
IDENTIFIER = r"[A-Za-zА-Яа-я][A-Za-zА-Яа-я0-9]*(?:_\([^()]+\))?(?:\^\([^()]+\))?"
CALCULABLE = {"×": "*", "÷": "/", "^": "**"}
CONTINUES = "+-x×÷*/="
HEURISTIC_DISPLAY, HEURISTIC_CALC, NEEDS_BINDING = "formula_display_latex_is_heuristic", "formula_calc_expr_is_heuristic", "calculation_expression_requires_domain_variable_binding"
WMF, LINEARIZED, RECOVERED = "mathtype_wmf_text_records", "docx_text_linearized", "formula_native_wmf_pattern_recovered"

#: Steps of normalisation as (pattern, replacement), for Java and RE2 alike.
NORMALIZE = (
    (r"\s*[,;]?\s*\([0-9]+(?:\.[0-9]+)*\),?\s*$", ""), (r"\s*,?\s*[гГ][дД][еЕ]:\s*$", ""), (r"\s*[,;]\s*$", ""), (r"\s+", " "),
)
_WRAPPED = tuple(CONTINUES)


def normalize(text: Column) -> Column:
    """Without a trailing number in brackets, a trailing 'where', an operator repeated over a line's end, trailing
    punctuation and double spaces."""
    steps = [NORMALIZE[0], NORMALIZE[1], *[(rf"\{c}\s*\n+\s*\{c}" if c not in "x×÷=" else rf"{c}\s*\n+\s*{c}", c) for c in _WRAPPED], *NORMALIZE[2:]]
    text = F.trim(text)
    for pattern, to in steps:
        text = F.regexp_replace(text, pattern, to)
    return F.trim(text)


def operators(text: Column) -> Column:
    """An x between operands is a sign of multiplication; repeated signs count once."""
    return F.regexp_replace(text, rf"(?<={_OPERAND_END})\s+(?:[×xX]\s+)*[×xX]\s+(?={_OPERAND_START})", " × ")


_TIMES = re.compile(rf"(?<={_OPERAND_END})\s+(?:[×xX]\s+)*[×xX]\s+(?={_OPERAND_START})")


def number_of(text: Column) -> Column:
    """The trailing formula number, or null."""
    return F.nullif(F.regexp_extract(text, r"\(([0-9]+(?:\.[0-9]+)*)\)[ ,.;]*(?:где:|where:)?$", 1), F.lit(""))


def _part(value: str) -> str:
    return "_".join(x for x in re.split(r"[^0-9A-Za-zА-Яа-я]+", value) if x)


_SYMBOL = re.compile(r"([A-Za-zА-Яа-я][A-Za-zА-Яа-я0-9]*)(?:_\(([^()]+)\))?(?:\^\(([^()]+)\))?")


def symbol(name: str) -> tuple[str, str] | None:
    """Key (base, lower and upper part) and ASCII name of an identifier; None if it is none."""
    m = _SYMBOL.fullmatch(name)
    if not m:
        return None
    key = "_".join(x for x in map(_part, filter(None, m.groups())) if x)
    ascii_name = "_".join(x for x in "".join(LATIN.get(c, c if c.isascii() else "_") for c in key).split("_") if x)
    if not ascii_name:
        return None
    return key, f"v_{ascii_name}" if ascii_name[0].isdigit() else ascii_name


def symbol_key(name: Column) -> Column:
    """The ASCII name of an identifier as a Column; null if it is none."""
    from docweave.functions.text import transliterate

    parts = [F.regexp_extract(name, rf"^{_SYMBOL.pattern}$", i) for i in (1, 2, 3)]
    clean = [F.regexp_replace(F.regexp_replace(p, "[^0-9A-Za-zА-Яа-я]+", "_"), "^_|_$", "") for p in parts]
    key = F.array_join(F.filter(F.array(*clean), lambda x: x != ""), "_")
    plain = F.regexp_replace(F.regexp_replace(transliterate(key), "_+", "_"), "^_|_$", "")
    return F.nullif(F.when(plain.rlike("^[0-9]"), F.concat(F.lit("v_"), plain)).otherwise(plain), F.lit(""))


_TOKEN = re.compile(rf"\s*(?:(?P<number>\d+(?:[.,]\d+)?)|(?P<name>{IDENTIFIER})|(?P<sign>[-+*/()^×÷%])|(?P<end>$))")


def tokens(text: str) -> tuple[str, dict[str, str]] | None:
    """A linear expression in plain ASCII, its tokens parted by spaces, and its variables (key to ASCII name); None
    where a sign isn't known or % follows an operator."""
    out: list[str] = []
    names: dict[str, str] = {}
    at = 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            return None
        at = m.end()
        kind, value = m.lastgroup, m.group(m.lastgroup)
        if kind == "number":
            out.append(value.replace(",", "."))
        elif kind == "name":
            known = symbol(value)
            if known is None:
                return None
            names.setdefault(*known)
            out.append(known[1])
        elif value == "%":
            if not out or out[-1] in ("+", "-", "*", "/", "**", "("):
                return None
            out += ["/", "100"]
        elif kind == "sign":
            out.append(CALCULABLE.get(value, value))
        elif m.start() == at:
            break
    return (" ".join(out), names) if out else None


def _bare(text: str) -> str:
    return re.sub(r"\s*[,;]\s*$", "", text.strip()).strip()


def _after_prefix(text: str) -> str:
    """What stands behind words and a colon, if it looks like a formula."""
    words, colon, rest = text.strip().partition(":")
    return rest.strip() if colon and re.search("[A-Za-zА-Яа-я]", words) and re.search(r"[=+\-*/×÷^%()xX]", rest) else text.strip()


def _in_brackets(text: str) -> Iterator[str]:
    """Outermost bracketed parts."""
    depth = begin = 0
    for i, c in enumerate(text):
        if c == "(":
            begin = i + 1 if depth == 0 else begin
            depth += 1
        elif c == ")" and depth:
            depth -= 1
            if depth == 0:
                yield text[begin:i]


def candidates(text: str) -> list[str]:
    """Parts of a text that may state a calculation, the likeliest first: the whole, what follows a prefix, and of
    both the clauses between semicolons, bracketed equations and the members of a chain of equations from the right."""
    whole = list(dict.fromkeys(filter(None, (_bare(text), _bare(_after_prefix(text))))))
    more: list[str] = []
    for c in whole:
        for clause in filter(lambda x: "=" in x, map(_bare, c.split(";"))):
            more += [clause, _bare(_after_prefix(clause))]
        more += [part for part in map(_bare, _in_brackets(c)) if "=" in part]
        more += [_bare(_after_prefix(part)) for part in reversed(c.split("=")[:-1])]
    return list(dict.fromkeys(whole + [c for c in more if c]))


def _expression(text: str) -> tuple[str, dict[str, str]] | None:
    divided = re.sub(rf"(?<={_OPERAND_END})\s*:\s*(?={_OPERAND_START})", " ÷ ", text.strip())
    return tokens(_bare(divided.replace("[", "(").replace("]", ")")))


def _stated(text: str) -> tuple[str, dict[str, str]] | None:
    """The assignment or the expression with an operator that a candidate states."""
    left, equals, right = text.partition("=")
    said = _expression(right if equals else text)
    if said is None:
        return None
    if not equals:
        return said if any(f" {op} " in said[0] for op in ("+", "-", "*", "/", "**")) else None
    target = symbol(_bare(left))
    return (f"{target[1]} = {said[0]}", {target[0]: target[1], **said[1]}) if target else None


def calculation(text: str | None) -> tuple[str, dict[str, str]] | None:
    """The first candidate that states a calculation, in plain ASCII, and its variables; None for sums and prose."""
    if not text:
        return None
    text = _TIMES.sub(" × ", text)
    if "sum_(" in text or "∑" in text:
        return None
    return next((said for said in map(_stated, candidates(text)) if said), None)


def calculable(text: str | None) -> str | None:
    said = calculation(text)
    return said[0] if said else None


def _letters(value: str) -> str:
    return value if re.fullmatch("[A-Za-z]", value) else rf"\mathrm{{{value}}}"


def _script(value: str) -> str:
    return value if re.fullmatch("[A-Za-z0-9]+", value) else rf"\text{{{value}}}"


_SIGNS = {"×": r" \times ", "÷": r" \div ", "%": r"\%"}
_SUM = re.compile(r"\bsum_\(([^=()]+)=([^()]+)\)\^([A-Za-zА-Яа-я0-9]+)")
_MARKED = re.compile(r"([A-Za-zА-Яа-я][A-Za-zА-Яа-я0-9]*)(?:_\(([^()]+)\)(?:\^\(([^()]+)\))?|\^\(([^()]+)\))")


def latex(text: str) -> str:
    """Display form: operators, sums, lower and upper parts."""
    text = re.sub("[×÷%]", lambda m: _SIGNS[m.group()], _TIMES.sub(" × ", text))
    text = _SUM.sub(lambda m: "\\sum_{%s=%s}^{%s}" % tuple(x.strip() for x in m.groups()), text)

    def marked(m: re.Match) -> str:
        low, high = m.group(2), m.group(3) or m.group(4)
        return _letters(m.group(1)) + (f"_{{{_script(low)}}}" if low else "") + (f"^{{{_script(high)}}}" if high else "")

    return _MARKED.sub(marked, text)


def representation(text: str, known: dict | None = None) -> dict | None:
    """What a normalised text is as a formula: the known one, a range ``a = 1 ÷ B``, one by heuristic, or None.

    known: its representation if the text is a known formula.
    """
    if known is not None:
        return known
    share = re.fullmatch(r"([A-Za-zА-Яа-я]+)\s*=\s*1\s*÷\s*([A-Za-zА-Яа-я]+)", text)
    if share:
        return {"source_format": WMF, "linear_text": text, "display_latex": rf"{_letters(share.group(1))} = 1 \div {_letters(share.group(2))}", "calc_expr": None, "variables": {}, "confidence": "high", "warnings": []}
    if not re.search(r"_\(|\^\(|[=∑×÷]", text):
        return None
    said = calculation(text)
    return {
        "source_format": LINEARIZED, "linear_text": text, "display_latex": latex(text), "calc_expr": said and said[0], "variables": said[1] if said else {}, "confidence": "low",
        "warnings": [HEURISTIC_DISPLAY, *([HEURISTIC_CALC, NEEDS_BINDING] if said else [])],
    }


_ALLOWED = (ast.Expression, ast.BinOp, ast.UnaryOp, ast.Add, ast.Sub, ast.Mult, ast.Div, ast.Pow, ast.USub, ast.UAdd, ast.Name, ast.Load, ast.Constant)


def parse(calc: str) -> tuple[str | None, ast.Expression, list[str]] | None:
    """Target (None for a bare expression), tree and names; None if it holds anything but arithmetic on names and numbers."""
    target, equals, right = calc.partition("=")
    target, right = (target.strip(), right) if equals else (None, calc)
    if target is not None and not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", target):
        return None
    try:
        tree = ast.parse(right.strip(), mode="eval")
    except (SyntaxError, ValueError):
        return None
    if not all(isinstance(n, _ALLOWED) for n in ast.walk(tree)) or not all(isinstance(n.value, (int, float)) for n in ast.walk(tree) if isinstance(n, ast.Constant)) or any(isinstance(n, ast.Constant) and isinstance(n.value, bool) for n in ast.walk(tree)):
        return None
    return target, tree, sorted({n.id for n in ast.walk(tree) if isinstance(n, ast.Name)})


def evaluate(tree: ast.AST, values: dict[str, float]) -> float:
    """Value of an arithmetic tree; ZeroDivisionError and OverflowError are the caller's."""
    if isinstance(tree, ast.Expression):
        return evaluate(tree.body, values)
    if isinstance(tree, ast.Constant):
        return float(tree.value)
    if isinstance(tree, ast.Name):
        return values[tree.id]
    if isinstance(tree, ast.UnaryOp):
        v = evaluate(tree.operand, values)
        return -v if isinstance(tree.op, ast.USub) else v
    a, b = evaluate(tree.left, values), evaluate(tree.right, values)
    if isinstance(tree.op, ast.Add):
        return a + b
    if isinstance(tree.op, ast.Sub):
        return a - b
    if isinstance(tree.op, ast.Mult):
        return a * b
    if isinstance(tree.op, ast.Div):
        return a / b
    return float(a**b)


def column(calc: str) -> tuple[str, Column] | None:
    """An assignment as a Column over columns of the names it uses; division by zero gives null."""
    parsed = parse(calc)
    if parsed is None:
        return None

    def build(n: ast.AST) -> Column:
        if isinstance(n, ast.Expression):
            return build(n.body)
        if isinstance(n, ast.Constant):
            return F.lit(float(n.value))
        if isinstance(n, ast.Name):
            return F.col(n.id)
        if isinstance(n, ast.UnaryOp):
            return -build(n.operand) if isinstance(n.op, ast.USub) else build(n.operand)
        a, b = build(n.left), build(n.right)
        return {ast.Add: lambda: a + b, ast.Sub: lambda: a - b, ast.Mult: lambda: a * b, ast.Div: lambda: F.try_divide(a, b), ast.Pow: lambda: F.pow(a, b)}[type(n.op)]()

    return parsed[0], build(parsed[1])
