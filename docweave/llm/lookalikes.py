"""Visually identical text with different characters, brought to one form.

Full-width forms, separate accents, invisible characters and unusual spaces are told and normalised by table. A
letter of another alphabet is judged word by word. Every word that holds letters of another alphabet, all of which look
like letters of the text's own, is put to a weighted edit automaton over the vocabulary trie of that alphabet:
look-alikes and ignorable characters cost nothing, an edit of the last letters (another ending) costs one, any other
edit is beyond the budget. A word of mixed alphabets is a case; the known word that the automaton reaches at no cost
is its canonical spelling, and a word that reaches none is normalised by table. A word wholly of another alphabet is a
case only if the automaton reaches a known word and the word isn't known in texts of its own alphabet: foreign words
stay as they are.

Known words are those that occur at least KNOWN times in texts of their own alphabet.

Defined results
* null fields have no canonical form and are no case; empty ones stay empty;
* signs with a meaning of their own, accents without a composed letter and foreign words stay as they are;
* parts of e-mail addresses, and foreign parts of words with a hyphen beside a truly foreign one, are left alone;
* the text's own alphabet is that of most of its letters (Latin where they are as many);
* rows delivered twice give equal rows.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.llm.batches import chunks
from docweave.session import cut_lineage

# Letters that look alike. Each line: a Latin letter, then Cyrillic and Greek ones like it.
ALIKE = (
    "AАΑ", "BВΒ", "CСϹ", "EЕΕ", "HНΗ", "IІΙӀ", "JЈ", "KКΚ", "MМΜ", "NΝ", "OОΟ", "PРΡ", "SЅ", "TТΤ", "XХΧ", "YУΥҮ", "ZΖ",
    "aа", "cсϲ", "dԁ", "eе", "iіι", "jј", "kкκ", "oоο", "pрρ", "sѕ", "uυ", "vνѵ", "xхχ", "yуγ", "hһ", "mм", "tт", "bЬ", "qԛ", "wԝ", "nп",
)
#: Pairs of the list that only some founts draw alike; they count within words of mixed alphabets, not for whole words.
LOOSE = frozenset("mмtтkкnпbЬuγ")
INVISIBLE = "­᠎​‌‍‎‏‪‫‬‭‮⁠⁡⁢⁣⁤﻿"
SPACES = "               　"
#: Price of an edit within the last ENDING letters, and what edits may cost together; a word must keep STEM letters.
EDIT, BUDGET, ENDING, STEM = 1, 1, 2, 3
#: Occurrences that make a word known, and its letters that shard the vocabulary (no more than the letters without edits).
KNOWN, PREFIX = 3, 3

_CLASS = {c: group[0] for group in ALIKE for c in group}
_FULL = {c: c - 0xFEE0 for c in range(0xFF01, 0xFF5F)} | {0x3000: 0x20}
_SPACE = {ord(c): " " for c in SPACES}
_GONE = {ord(c): None for c in INVISIBLE}


def _composed() -> dict[str, str]:
    """For each combining mark the letters it composes with, by the rules of normalisation."""
    out: dict[str, str] = {}
    for mark in map(chr, range(0x300, 0x370)):
        bases = "".join(c for c in map(chr, [*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC0, 0x250), *range(0x391, 0x3CA), *range(0x400, 0x460)]) if len(unicodedata.normalize("NFC", c + mark)) == 1)
        if bases:
            out[mark] = bases
    return out


_FULL_FORM = "[\\uFF01-\\uFF5E\\uFFE0-\\uFFE6]"
_ACCENT = "(?:" + "|".join(f"[{bases}]\\u{ord(mark):04X}" for mark, bases in _composed().items()) + ")"
#: The same signs as ranges, which are matched faster.
_ODD_SIGN = "[\\u00A0\\u00AD\\u1680\\u180E\\u2000-\\u200F\\u202A-\\u202F\\u205F-\\u2064\\u3000\\uFEFF\\uFF01-\\uFF5E\\uFFE0-\\uFFE6]"
_ODD = re.compile(_ODD_SIGN)


def script(c: str) -> str:
    """L, C or G for a letter of these alphabets, else ''."""
    o = ord(c)
    if o < 0x250:
        return "L" if c.isalpha() and c not in "ªºµ" else ""
    return "G" if 0x370 <= o < 0x400 else "C" if 0x400 <= o < 0x530 else ""


def plain(text: str) -> str:
    """Full-width forms, accents, spaces and invisible characters by table."""
    if text.isascii():
        return text
    if not _ODD.search(text):
        return text if unicodedata.is_normalized("NFC", text) else unicodedata.normalize("NFC", text)
    return unicodedata.normalize("NFC", text.translate(_FULL)).translate(_GONE).translate(_SPACE)


def to_script(word: str, own: str) -> str:
    """Look-alikes of other alphabets replaced by letters of this one."""
    return "".join(_INTO[own].get(_CLASS.get(c, c), c) if script(c) not in ("", own) else c for c in word)


_INTO = {s: {group[0]: next((c for c in group if script(c) == s), group[0]) for group in ALIKE if any(script(c) == s for c in group)} for s in "LCG"}
_RUN = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)*")
_SCRIPTS = np.zeros(0x530, dtype=np.uint8)
for _c in range(0x530):
    _SCRIPTS[_c] = "\0LCG".index(script(chr(_c)) or "\0")
#: Letters that aren't of the alphabet, and those of them without a look-alike in it.
_FOREIGN = {own: frozenset(chr(c) for c in range(0x530) if script(chr(c)) not in ("", own)) for own in "LC"}
_LATIN, _CYRILLIC = re.compile("[A-Za-z\u00c0-\u024f]"), re.compile("[\u0400-\u052f]")
_ELSEWHERE = {"L": re.compile("[\u0370-\u052f]"), "C": re.compile("[A-Za-z\u00c0-\u024f\u0370-\u03ff]")}
_STRANGERS = {own: frozenset(c for c in _FOREIGN[own] if _CLASS.get(c, c) not in _INTO[own]) for own in "LC"}


def own_script(text: str) -> str:
    marks = np.bincount(_SCRIPTS[np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32), 0x52F)], minlength=4)
    return "C" if marks[2] > marks[1] else "L"


def words_of(text: str) -> tuple[str, list[tuple[str, bool]], list[str]]:
    """The own alphabet; strange words, with look-alikes of another, as (word, mixed); and words of the own one alone."""
    if text.isascii():
        return "L", [], _RUN.findall(text)
    text = plain(text)
    own = own_script(text) if _LATIN.search(text) else "C" if _CYRILLIC.search(text) else "L"
    if not _ELSEWHERE[own].search(text):
        return own, [], _RUN.findall(text)
    foreign, strangers = _FOREIGN[own], _STRANGERS[own]
    strange, sound = [], []
    for m in _RUN.finditer(text):
        run = m.group()
        if foreign.isdisjoint(run):
            sound.append(run)
            continue
        before, after = text[m.start() - 1 : m.start()], text[m.end() : m.end() + 2]
        if before in ("@", ".") and before or after[:1] == "@" or (after[:1] == "." and after[1:2].isalnum()):
            continue  # part of an address
        parts = run.split("-")
        abroad = any(not strangers.isdisjoint(part) for part in parts)
        for part in parts:
            if foreign.isdisjoint(part) or not strangers.isdisjoint(part):
                continue
            mixed = not all(c in foreign for c in part)
            if not mixed and (abroad or not LOOSE.isdisjoint(part) or before.isdigit() or after[:1].isdigit()):
                continue
            strange.append((part, mixed))
    return own, strange, sound


def strange_words(text: str) -> tuple[str, list[tuple[str, bool]]]:
    return words_of(text)[:2]


class Trie:
    """Words by look-alike class, with how often each spelling occurs."""

    def __init__(self) -> None:
        self.root: dict = {}

    def add(self, word: str, n: int) -> None:
        node = self.root
        for c in word:
            node = node.setdefault(_CLASS.get(c, c), {})
        best = node.get("")
        if best is None or (n, word) > best:
            node[""] = (n, word)

    def nearest(self, word: str, budget: int = BUDGET) -> tuple[int, str] | None:
        """Cost and spelling of the known word of least cost, then of greatest frequency.

        The automaton's states are trie nodes with the least cost of reaching them. A letter moves along its class at no
        cost; near the word's end it may also move along another class, move nowhere, or be moved past, at EDIT each.
        """
        letters = [c for c in word if c not in INVISIBLE]
        states: dict[int, tuple[dict, int]] = {id(self.root): (self.root, 0)}

        def offer(into: dict[int, tuple[dict, int]], node: dict, cost: int) -> None:
            if cost <= budget and cost < into.get(id(node), (None, budget + 1))[1]:
                into[id(node)] = (node, cost)

        for i, c in enumerate(letters):
            after: dict[int, tuple[dict, int]] = {}
            loose = i >= max(STEM, len(letters) - ENDING)
            for node, cost in list(states.values()):
                child = node.get(_CLASS.get(c, c))
                if child is not None:
                    offer(after, child, cost)
                if loose:
                    offer(after, node, cost + EDIT)
                    for label, other in node.items():
                        if label:
                            offer(after, other, cost + EDIT)
                            further = other.get(_CLASS.get(c, c))  # a letter more in the known word
                            if further is not None:
                                offer(after, further, cost + EDIT)
            states = after
        if len(letters) > STEM:  # a letter more at the end
            for node, cost in list(states.values()):
                for label, other in node.items():
                    if label:
                        offer(states, other, cost + EDIT)
        ends = [(cost, -node[""][0], node[""][1]) for node, cost in states.values() if "" in node]
        return (min(ends)[0], min(ends)[2]) if ends else None


def fields(units: DataFrame, gold: DataFrame) -> DataFrame:
    """record_table, owner_id, item_id, field, text: every field of both tables that isn't null."""
    def of(table: str, owner: Column, item: Column, text: Column, linear: Column, calc: Column, df: DataFrame) -> DataFrame:
        each = F.array(*[F.struct(F.lit(n).alias("field"), c.alias("text")) for n, c in (("text", text), ("linear_text", linear), ("calc_expr", calc))])
        return df.select(F.lit(table).alias("record_table"), owner.alias("owner_id"), item.cast("string").alias("item_id"), F.inline(each)).where("text is not null")

    c = F.col
    return of("document_units", c("document_id"), c("unit_id"), c("text"), c("formula.linear_text"), c("formula.calc_expr"), units).unionByName(
        of("formula_gold", c("document_label"), c("formula_index"), c("text"), c("linear_text"), c("calc_expr"), gold)
    )


KEYS = ["record_table", "owner_id", "item_id", "field"]


def _by_form(rows: DataFrame) -> DataFrame:
    text = F.col("text")
    return rows.where(F.when(F.col("field") == "calc_expr", text.rlike("[^\\x00-\\x7F]")).otherwise(text.rlike(_ODD_SIGN) | (text.rlike("[\\u0300-\\u036F]") & text.rlike(_ACCENT))))


def _words(rows: DataFrame) -> DataFrame:
    """One pass over all fields but calc_expr. Rows of strange words: KEYS, word, own and mixed; and, with n, how often a
    batch of texts has a word of the text's own alphabet, in lower case."""
    schema = ", ".join(f"{k} string" for k in KEYS) + ", word string, own string, mixed boolean, n bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, Counter] = {"L": Counter(), "C": Counter()}
        for batch in batches:
            for part, texts in chunks(batch, "text"):
                names = part.column("field").to_pylist()
                out, heard = [], {"L": [], "C": []}
                for i, text in enumerate(texts):
                    own, strange, sound = words_of(text)
                    if strange:
                        out += [(i, w, own, mixed) for w, mixed in strange]
                    if names[i] == "text":
                        heard[own] += sound
                for own, words in heard.items():
                    known[own].update(words)
                columns = list(zip(*out, strict=True)) if out else [()] * 4
                of = pa.array(columns[0], pa.int64())
                yield pa.RecordBatch.from_arrays([*[part.column(k).take(of) for k in KEYS], pa.array(columns[1], pa.string()), pa.array(columns[2], pa.string()), pa.array(columns[3], pa.bool_()), pa.nulls(len(of), pa.int64())], [*KEYS, "word", "own", "mixed", "n"])
            if sum(map(len, known.values())) > 200_000:  # partial counts; the shuffle after adds them up
                for own in known:
                    yield tally(own, known[own])
                    known[own].clear()
        for own in known:
            yield tally(own, known[own])

    def tally(own: str, heard: Counter) -> pa.RecordBatch:
        lower: Counter = Counter()
        for word, n in heard.items():
            lower[word.lower()] += n
            if "-" in word:
                for piece in word.lower().split("-"):
                    lower[piece] += n
        size = len(lower)
        return pa.RecordBatch.from_arrays([*[pa.nulls(size, pa.string())] * 4, pa.array(list(lower), pa.string()), pa.array([own] * size, pa.string()), pa.nulls(size, pa.bool_()), pa.array(list(lower.values()), pa.int64())], [*KEYS, "word", "own", "mixed", "n"])

    return rows.select(*KEYS, "text").where("field != 'calc_expr'").mapInArrow(run, schema)


def _shard(word: Column) -> Column:
    """First letters by look-alike class."""
    return F.substring(F.translate(word, "".join(c for g in ALIKE for c in g[1:]), "".join(g[0] * (len(g) - 1) for g in ALIKE)), 1, PREFIX)


def _vocabulary(words: DataFrame) -> DataFrame:
    """word and own of every known word, with n."""
    letters = F.when(F.col("word").rlike("^[A-Za-z\\u00C0-\\u024F-]+$"), "L").when(F.col("word").rlike("^[\\u0400-\\u04FF-]+$"), "C")
    return words.where("n is not null").groupBy("own", "word").agg(F.sum("n").alias("n")).where((F.col("n") >= KNOWN) & (letters == F.col("own")))


def spellings(words: DataFrame) -> DataFrame:
    """word, own, mixed, spelling and cost of each strange word that the automaton leads to a known one.

    words: the result of ``_words``. Words wholly of another alphabet that are known there are left out.
    """
    known = _vocabulary(words)
    asked = words.where("n is null").select("word", "own", "mixed").distinct()
    abroad = F.when(F.col("mixed"), F.lit(None).cast("string")).when(F.col("own") == "C", "L").otherwise("C")
    asked = asked.withColumn("other", abroad).withColumn("lower", F.lower("word"))
    asked = asked.join(known.select(F.col("word").alias("lower"), F.col("own").alias("other")), ["lower", "other"], "left_anti").select("word", "own", "mixed", _shard(F.col("word")).alias("shard"))
    # capitals look alike where small letters don't, so every word is known in its three usual forms
    forms = F.array_distinct(F.array("word", F.upper("word"), F.concat(F.upper(F.substring("word", 1, 1)), F.expr("substring(word, 2)"))))
    known = known.select(F.explode(forms).alias("form"), "n", F.col("own").alias("of")).withColumn("part", _shard(F.col("form")))
    known = known.join(asked.select(F.col("own").alias("of"), F.col("shard").alias("part")).distinct(), ["of", "part"], "left_semi")  # no shard without a question
    # a shard's words are those of one alphabet with one beginning; its size is bounded by the vocabulary, not the text
    schema = "word string, own string, mixed boolean, spelling string, cost int"

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        trie = Trie()
        for word, n in zip(right["form"], right["n"], strict=True):
            trie.add(word, n)
        got = [(w, o, m, trie.nearest(w)) for w, o, m in zip(left["word"], left["own"], left["mixed"], strict=True)]
        return pd.DataFrame([(w, o, m, g[1], g[0]) for w, o, m, g in got if g], columns=["word", "own", "mixed", "spelling", "cost"])

    return asked.groupBy("own", "shard").cogroup(known.groupBy("of", "part")).applyInPandas(run, schema)


def odd_fields(units: DataFrame, gold: DataFrame) -> DataFrame:
    """KEYS of every field with a character that only looks like the usual one, before any exclusion."""
    rows = fields(units, gold)
    words = cut_lineage(_words(rows))
    whole = words.where("n is null and not mixed")
    reached = spellings(words).where("not mixed").select("word", "own")
    by_word = words.where("mixed").select(*KEYS).unionByName(whole.join(reached, ["word", "own"], "left_semi").select(*KEYS))
    return _by_form(rows).select(*KEYS).unionByName(by_word).distinct()


def found(units: DataFrame, gold: DataFrame, scans: DataFrame, model) -> DataFrame:
    """KEYS of every case; units of scanned documents and units garbled by a wrong encoding are left out.

    model: a trained model of docweave.llm.encodings, to tell the latter among the candidates.
    """
    from docweave.llm.encodings import garbled_units

    odd = cut_lineage(odd_fields(units, gold))
    scanned = scans.select(F.col("document_id").alias("owner_id")).where("owner_id is not null").distinct()
    keep = odd.where("record_table = 'formula_gold'")
    mine = odd.where("record_table = 'document_units'").join(scanned, "owner_id", "left_anti")
    suspects = units.join(mine.select(F.col("owner_id").alias("document_id"), F.col("item_id").alias("unit_id")).distinct(), ["document_id", "unit_id"], "left_semi")
    garbled = garbled_units(suspects, model).select("owner_id", "item_id").distinct()
    return mine.join(garbled, ["owner_id", "item_id"], "left_anti").select(*KEYS).unionByName(keep)


def canonical_text(text: str, spelling: dict[str, str], field: str) -> str:
    """spelling: canonical spellings of strange words; mixed ones without any are normalised by table."""
    text = plain(text)
    if text.isascii():
        return text
    if field == "calc_expr":
        return to_script(text, "L")
    own, words = strange_words(text)
    swap = {w: spelling.get(w) or to_script(w, own) for w, mixed in words if mixed or w in spelling}
    return _RUN.sub(lambda m: "-".join(swap.get(part, part) for part in m.group().split("-")), text) if swap else text


def canonical(units: DataFrame, gold: DataFrame) -> DataFrame:
    """KEYS and canonical: one consistent form of every field. Fields of plain ASCII stay in the JVM."""
    rows = fields(units, gold)
    words = cut_lineage(_words(rows))
    # a known word with another ending shows that the word is one of the alphabet, but isn't its spelling
    into = [F.translate(F.col("word"), *_table(own)) for own in "LC"]
    spelled = spellings(words).select("word", "own", F.when(F.col("cost") == 0, F.col("spelling")).when(F.col("own") == "L", into[0]).otherwise(into[1]).alias("spelling"))
    spelled = words.where("n is null").select(*KEYS, "word", "own").join(spelled, ["word", "own"]).select(*KEYS, "word", "spelling").distinct()
    maps = spelled.groupBy(*KEYS).agg(F.map_from_entries(F.collect_set(F.struct("word", "spelling"))).alias("spelling"))
    odd = F.col("text").rlike("[^\\x00-\\x7F]")
    schema = ", ".join(f"{k} string" for k in KEYS) + ", canonical string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in chunks(batch, "text"):
                maps_, names = part.column("spelling").to_pylist(), part.column("field").to_pylist()
                out = [canonical_text(t, dict(m or ()), f) for t, m, f in zip(texts, maps_, names, strict=True)]
                yield pa.RecordBatch.from_arrays([*[part.column(k) for k in KEYS], pa.array(out, pa.string())], [*KEYS, "canonical"])

    same = rows.where(~odd).select(*KEYS, F.col("text").alias("canonical"))
    return same.unionByName(rows.where(odd).join(maps, KEYS, "left").select(*KEYS, "text", "spelling").mapInArrow(run, schema)).distinct()


def _table(own: str) -> tuple[str, str]:
    """Look-alikes of other alphabets, and the letters of this one in their places."""
    swaps = [(c, to_script(c, own)) for group in ALIKE for c in group if to_script(c, own) != c]
    return "".join(a for a, _ in swaps), "".join(b for _, b in swaps)
