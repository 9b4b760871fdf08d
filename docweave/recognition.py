"""Recognition of formulas by providers that a caller registers: chain, cache, one pass per distinct input.

A provider is asked for many inputs at once inside Arrow batches; what it can't do is None, what it breaks on is a warning
and leaves the others alone. Without providers everything stays open.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.functions import formulas as fx

# Modes of the chain, with the order in which kinds of providers are asked.
MODES = {"off": (), "fallback": ("local", "ocr", "llm"), "llm_first": ("local", "llm", "ocr"), "mathpix_first": ("ocr", "local", "llm")}
DEFAULT_MODE, DEFAULT_PROMPT = "fallback", "v1"


def mode_of(value: str | None) -> str:
    """The mode that a setting names, whatever its case and hyphens; the usual one where it names none."""
    said = (value or "").strip().lower().replace("-", "_")
    return said if said in MODES else DEFAULT_MODE


def mode_column(value: Column) -> Column:
    said = F.replace(F.lower(F.trim(value)), F.lit("-"), F.lit("_"))
    return F.when(said.isin(*MODES), said).otherwise(DEFAULT_MODE)


@dataclass(frozen=True)
class Provider:
    """name; kind ('local', 'ocr' or 'llm'); predict: from (text, asset, hint) of each input to a formula (dict) or None."""

    name: str
    kind: str
    predict: Callable[[list[tuple[str | None, str | None, str | None]]], list[dict | None]]


def from_text(inputs: list[tuple[str | None, str | None, str | None]]) -> list[dict | None]:
    """The local provider: what the text itself tells; nothing of a picture."""
    return [fx.representation(text) if text else None for text, _, _ in inputs]


LOCAL = Provider("text", "local", from_text)


def chain(providers: list[Provider], mode: str | None = None) -> list[Provider]:
    """The providers in the order the mode asks them; of one kind as they were given."""
    return [p for kind in MODES[mode_of(mode)] for p in providers if p.kind == kind]


def sufficient(formula: dict | None) -> bool:
    return formula is not None and (formula.get("confidence") in ("high", "medium") or bool((formula.get("calc_expr") or "").strip()))


def ask(inputs: list[tuple[str | None, str | None]], providers: list[Provider]) -> list[dict]:
    """provider, linear_text, display_latex, calc_expr, confidence, warnings and calls of each input (text, asset).

    Providers are asked in turn for what isn't settled; the best unsure answer so far is the next one's hint and stands
    in the end if no better one comes.
    """
    best: list[tuple[str, dict] | None] = [None] * len(inputs)
    warnings: list[list[str]] = [[] for _ in inputs]
    calls = [0] * len(inputs)
    for p in providers:
        left = [i for i, b in enumerate(best) if not (b and sufficient(b[1]))]
        if not left:
            break
        try:
            answers = p.predict([(*inputs[i], (best[i] or ("", {}))[1].get("linear_text")) for i in left])
        except Exception as x:  # a provider's failure is no document's
            answers = [None] * len(left)
            for i in left:
                warnings[i].append(f"{p.name}_failed:{type(x).__name__}")
        for i, a in zip(left, answers, strict=True):
            calls[i] += 1
            if a and (best[i] is None or sufficient(a)):
                best[i] = (p.name, a)
    out = []
    for b, w, n in zip(best, warnings, calls, strict=True):
        name, a = b or (None, {})
        linear, latex = a.get("linear_text") or a.get("display_latex"), a.get("display_latex") or a.get("linear_text")
        reason = [] if sufficient(a or None) else ["formula_recognition_low_confidence" if a else "formula_recognition_unresolved"]
        out.append({"provider": name, "linear_text": linear, "display_latex": latex, "calc_expr": a.get("calc_expr"), "confidence": a.get("confidence"), "warnings": [*(a.get("warnings") or []), *w, *reason], "calls": n})
    return out


_ANSWER = "cache_key string, provider string, linear_text string, display_latex string, calc_expr string, confidence string, warnings array<string>, calls int"


def recognise(candidates: DataFrame, providers: list[Provider], mode: str | None = None, prompt: str | None = None) -> DataFrame:
    """candidates (document_id, unit_id, text, asset) with the answer for each, and review_required.

    Equal inputs are asked for once: keys are canonical JSON, hashed, and answers are joined back.
    """
    asked = chain(providers, mode)
    version = (prompt or "").strip() or DEFAULT_PROMPT
    key = F.sha2(F.to_json(F.struct("asset", F.lit(version).alias("prompt"), F.lit(",".join(p.name for p in asked)).alias("providers"), "text"), {"ignoreNullFields": "false"}), 256)
    keyed = candidates.withColumn("cache_key", key)
    distinct = keyed.groupBy("cache_key").agg(F.first("text").alias("text"), F.first("asset").alias("asset"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            answers = ask(list(zip(b["text"].where(b["text"].notna(), None), b["asset"].where(b["asset"].notna(), None), strict=True)), asked)
            yield pd.DataFrame([{"cache_key": k, **a} for k, a in zip(b["cache_key"], answers, strict=True)], columns=[c.split(" ")[0] for c in _ANSWER.split(", ")])

    answers = distinct.mapInPandas(run, _ANSWER)
    open_ = (F.coalesce(F.trim("calc_expr"), F.lit("")) == "") | (F.coalesce("confidence", F.lit("low")) == "low")
    return keyed.drop("text", "asset").join(answers, "cache_key").withColumn("review_required", open_)
