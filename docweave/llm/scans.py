"""Noise in text from scanned pages: running headers, page numbers, broken words, misread characters.

Lines are compared by a key in which words stand by their confusable-glyph skeleton and numbers are masked; a key
that returns on several pages of a document is its running header. Words of the body are grouped by skeleton with the
forms that are frequent in the sound text of the same corpus. A form that isn't known there, or is far rarer than
another, is read as one of the known ones: where a group has several, as the one that sound text most often has beside
the same neighbouring words, and of those that it has alike, as the most frequent. A word broken at a line's end is joined if the joined form, or one of its skeleton,
is better known than the form with the hyphen. Windows over the reading order then join lines and units into
paragraphs.

Defined results
* null and empty texts have no noise and give no paragraph; documents that are not scanned are left alone;
* repeated rows of a unit count once (the latest text wins);
* a unit without a page counts as a page of its own;
* a word known nowhere in sound text, with no form of its skeleton known either, is left as it is.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweave.llm.batches import chunks
from docweave.session import cut_lineage

# Which glyphs scanners take for each other. A glyph read as two others is first written as these;
# then all members of a class share its first character.
SPELLED = (("ы", "ь|"), ("ю", "10"), ("m", "rn"), ("d", "cl"), ("n", "ri"), ("u", "ii"))
CLASSES = ("о0", "нпилк", "тг", "в8", "се", "мшщ", "б6", "з3", "ec", "s5", "tf", "o0", "il!1|", "g9", "bh")
#: Sound occurrences that make a word known, and how many times rarer than its best form a misreading must be.
KNOWN, RARER = 3, 200
MARKS = "-¬\u00ad‐–"

_CYRILLIC = str.maketrans({c: k[0] for k in CLASSES if k[0] >= "а" for c in k[1:]} | {"|": "1"})
_LATIN = str.maketrans({c: k[0] for k in CLASSES if k[0] < "а" for c in k[1:]})
_HAS_CYRILLIC = re.compile("[а-яё]")


@lru_cache(maxsize=200_000)
def skeleton(word: str) -> str:
    """The word's confusable-glyph skeleton, in lower case."""
    word = word.lower()
    cyrillic = _HAS_CYRILLIC.search(word)
    for one, two in SPELLED[:2] if cyrillic else SPELLED[2:]:
        word = word.replace(one, two)
    return word.translate(_CYRILLIC if cyrillic else _LATIN)


def line_key(line: Column) -> Column:
    """A line's key: numbers masked, words by skeleton, spaces single."""
    key = F.regexp_replace(F.lower(line), r"(?<![\p{L}])[\dolоiзбs|!]*\d[\dolоiзбs|!]*(?![\p{L}])", "#")
    for one, two in SPELLED:
        key = F.replace(key, F.lit(one), F.lit(two))
    pairs = {c: k[0] for k in CLASSES for c in k[1:] if c != "0"} | {"о": "0", "o": "0"}  # one zero for both alphabets
    return F.trim(F.regexp_replace(F.translate(key, "".join(pairs), "".join(pairs.values())), r"\s+", " "))


#: A line that is a page number: bare, in brackets or dashes, after a word for page, or with the number of pages.
_NUMBER = r"[\dOОоolIlЗзбi|!SsБ]{0,3}"
PAGE_LINE = rf"(?iu)^\s*(?:(?:[-–—\[(|/]+\s*)?{_NUMBER}\d{_NUMBER}(?:\s*[-–—\])|/]+)?|[-–—\[(]+\s*[\dOОоolIlЗзбi!SsБ]{{1,4}}\s*[-–—\])]+|(?:с[тг]р|[cсе]|[pр][aа]g[eс]|p|seite|s|лис[тг])[.]?\s+{_NUMBER}\d{_NUMBER}(?:\s+(?:из|нз|of|von)\s+{_NUMBER}\d?{_NUMBER})?|{_NUMBER}\d{_NUMBER}\s+(?:из|of|von)\s+\d+)\s*$"


def scan_units(units: DataFrame, scans: DataFrame) -> DataFrame:
    """The latest row of each unit of a scanned document."""
    ids = scans.select("document_id").where("document_id is not null").distinct()
    picked = F.struct("loaded_at", "unit_order", "type", F.col("source_ref.page").alias("page"), "text")
    return units.join(ids, "document_id", "left_semi").groupBy("document_id", "unit_id").agg(F.max(picked).alias("w")).select("document_id", "unit_id", F.col("w.unit_order").alias("unit_order"), F.col("w.type").alias("type"), F.col("w.page").alias("page"), F.col("w.text").alias("text")).where("length(text) > 0")


def marked_lines(units: DataFrame) -> DataFrame:
    """document_id, unit_id, lines: array of (line_no, line, furniture) of each unit, in order.

    A page number is told by its form. A running header stands in units of that type, or its key returns at an edge
    (first or last line of a page, or beside a page number) on at least two pages of the document.
    """
    lines = units.select("document_id", "unit_id", "unit_order", "type", F.coalesce(F.col("page").cast("string"), "unit_id").alias("page"), F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    lines = lines.withColumn("number", F.col("line").rlike(PAGE_LINE) & (F.length(F.trim("line")) > 0)).withColumn("key", F.when(~F.col("number"), line_key(F.col("line"))))
    onward = Window.partitionBy("document_id", "page").orderBy("unit_order", "unit_id", "line_no")
    near = lambda step: F.coalesce(F.lag("number", step).over(onward), F.lit(True))
    running = F.col("type").isin("header", "footer")
    # headers carry no sentence: they don't end in a stop, and no table row is one
    fit = (F.length("key") > 3) & ~F.col("line").contains(" | ") & ~F.col("line").rlike(r"[.,;:]\s*$") & F.col("line").rlike(r"^\s*\P{Ll}") & ~F.col("line").rlike(r"^\s*\d+(\.\d+)+") & (F.col("type") != "section")
    # keys travel as hashes, and only what later steps need travels at all
    lines = lines.select("document_id", "unit_id", "line_no", "line", "number", running.alias("running"), "page", F.xxhash64("key").alias("key"), (near(1) | near(-1)).alias("edge"), fit.alias("fit"))
    lines = cut_lineage(lines)  # read twice below
    keys = (
        lines.where("fit and (edge or running)")
        .groupBy("document_id", "key", "page").agg(F.max("running").alias("running"))
        .groupBy("document_id", "key").agg(F.max("running").alias("running"), F.count("*").alias("pages"))
        .where("running or pages >= 2").select("document_id", "key", F.lit(True).alias("header"))
    )
    own = lines.select("document_id", "unit_id", "line_no", "line", "key", "fit", (F.col("number") | F.col("running")).alias("sure"))
    flagged = own.join(keys, ["document_id", "key"], "left").withColumn("furniture", F.col("sure") | (F.coalesce("header", F.lit(False)) & F.col("fit")))
    return flagged.groupBy("document_id", "unit_id").agg(F.sort_array(F.collect_list(F.struct("line_no", "line", "furniture"))).alias("lines"))


_TOKEN = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)*")
#: A word of the body as read: letters with digits or signs that scanners put for letters.
_READ = re.compile(r"(?:[^\W\d_]|(?<=[^\W\d_])[\d|!](?=[\d|!]*[^\W\d_])|[\d|!]+(?=[^\W\d_]{2})|(?<=ь)\||(?<=[^\W\d_]{2})[\d|!](?!\w))+")
_END = re.compile(rf"((?:[\w|!]+-)*[\w|!]*[^\W\d_][\w|!]*)([{MARKS}]) *$")
_BEGIN = re.compile(r"[\w|!]*[^\W\d_][\w|!]*")


def word_counts(units: DataFrame, scans: DataFrame) -> DataFrame:
    """word (lower case, with its hyphens), skeleton and n of all words in documents that aren't scanned."""
    ids = scans.select("document_id").where("document_id is not null").distinct()
    sound = units.select("document_id", "text").where("length(text) > 0").join(ids, "document_id", "left_anti").select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for batch in batches:
            for _, texts in chunks(batch, "text"):
                for text in texts:
                    found.update(_TOKEN.findall(text))
            if len(found) > 200_000:  # partial counts; the shuffle below adds them up
                yield _counts(found)
                found.clear()
        yield _counts(found)

    return sound.mapInArrow(run, "word string, skeleton string, n bigint").groupBy("word", "skeleton").agg(F.sum("n").alias("n"))


def _counts(found: Counter) -> pa.RecordBatch:
    lower: Counter = Counter()
    for w, n in found.items():
        lower[w.lower()] += n
        if "-" in w:
            for part in w.lower().split("-"):
                lower[part] += n
    words = [w for w in lower if not _mixed(w)]
    return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([skeleton(w) for w in words], pa.string()), pa.array([lower[w] for w in words], pa.int64())], ["word", "skeleton", "n"])


def _mixed(word: str) -> bool:
    return bool(_HAS_CYRILLIC.search(word)) and bool(re.search("[a-z]", word))


def body_words(marked: DataFrame) -> DataFrame:
    """One row per unit: words, the distinct words of its body in lower case; breaks, each with the joined form and the
    form with a hyphen, their skeletons and the mark."""
    pair = "array<struct<word:string,skeleton:string,other:string,other_skeleton:string,mark:string>>"
    kind = pa.list_(pa.struct([(n, pa.string()) for n in ("word", "skeleton", "other", "other_skeleton", "mark")]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, breaks = [], []
            for lines in batch.column("lines").to_pylist():
                own, split = unit_words([x["line"] for x in lines if not x["furniture"]])
                words.append(list(own))
                breaks.append([{"word": a, "skeleton": skeleton(a), "other": b, "other_skeleton": skeleton(b), "mark": m} for a, b, m in split])
            yield pa.RecordBatch.from_arrays([batch.column("document_id"), batch.column("unit_id"), pa.array(words, pa.list_(pa.string())), pa.array(breaks, kind)], ["document_id", "unit_id", "words", "breaks"])

    return marked.select("document_id", "unit_id", "lines").mapInArrow(run, f"document_id string, unit_id string, words array<string>, breaks {pair}")


def unit_words(lines: list[str]) -> tuple[set[str], list[tuple[str, str, str]]]:
    """Distinct words, lower case; and breaks as (joined, hyphenated, mark)."""
    breaks: list[tuple[str, str, str]] = []
    text = ""
    for line in lines:
        line = line.strip(" ")
        if not line:
            continue
        end = _end(text)
        begin = _BEGIN.match(line) if end else None
        if end and begin and begin.group()[0].islower() | begin.group()[0].isdigit() | (begin.group().isupper() and end.group(1).isupper()):
            left, right = end.group(1).lower(), begin.group().lower()
            last = left.rpartition("-")[2]
            breaks.append((last + right, last + "-" + right, end.group(2)))
            text = text[: end.start(2)] + "\0" + line  # whole again for the words below, but not taken as read
            continue
        text = f"{text} {line}" if text else line
    return {w for w in read_words(text) if len(w) > 2}, breaks


def read_words(text: str) -> list[str]:
    """Words as read, in order and lower case; \\0 stands where a broken word was put together."""
    out = []
    for part in text.replace("/", " ").split():
        bare = part.strip(_EDGES)
        if bare.isalpha():
            out.append(bare.lower())
            continue
        for piece in bare.replace("\0", "").split("-") if "\0" not in bare else [bare.replace("\0", "")]:
            found = _READ.search(piece)
            if found:
                out.append(found.group().lower())
    return out


#: Signs that stand around words.
_EDGES = ".,;:()«»\"„“”'"


def _end(text: str) -> re.Match | None:
    """A word with a mark at the very end of the text."""
    bare = text.rstrip(" ")
    return _END.search(text, bare.rfind(" ") + 1) if bare[-1:] in MARKS and bare else None


def known_words(counts: DataFrame) -> DataFrame:
    return counts.where(F.col("n") >= KNOWN)


def _with_skeleton(words: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("word"), pa.array([skeleton(w) for w in batch.column("word").to_pylist()], pa.string())], ["word", "skeleton"])

    return words.mapInArrow(run, "word string, skeleton string")


def options(body: DataFrame, counts: DataFrame) -> DataFrame:
    """word and forms (array of n and form, the most frequent first) for each word of the body that may be a misreading.

    A word that isn't known may be any known form of its skeleton; one that is known, but far rarer than the most
    frequent form, may also be itself.
    """
    read = _with_skeleton(body.select(F.explode("words").alias("word")).distinct())
    best = known_words(counts).groupBy("skeleton").agg(F.sort_array(F.collect_list(F.struct("n", F.col("word").alias("form"))), asc=False).alias("forms"))  # as many as words may look alike
    own = counts.select("word", F.col("n").alias("own"))
    most = F.col("forms")[0]["n"]
    return read.join(best, "skeleton").join(own, "word", "left").where((F.coalesce("own", F.lit(0)) < KNOWN) | (F.col("own") * RARER < most)).select("word", "forms")


def misread(options_: DataFrame) -> DataFrame:
    """word and its right form, for each misread word that can be one form only."""
    return options_.where(F.size("forms") == 1).select("word", F.col("forms")[0]["form"].alias("right_form")).where("word != right_form")


#: Size of the sets that tell which words' neighbours are looked at. A word outside may get in by chance; none is left out.
BITS = 1 << 20


def _bits(words: DataFrame) -> np.ndarray:
    """The set of the words (one column) as bits: of one size, however many they are."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([_bit(w) for w in batch.column(0).to_pylist()], pa.int32())], ["bit"])

    out = np.zeros(BITS, dtype=bool)
    out[[r.bit for r in words.mapInArrow(run, "bit int").distinct().collect()]] = True  # at most BITS rows
    return out


def _bit(word: str) -> int:
    return zlib.crc32(word.encode()) % BITS


def _beside(texts: DataFrame, keys: list[str], bits: np.ndarray, words: Callable[[str], list[str]]) -> DataFrame:
    """keys, word and neighbour ('<' and the word before, '>' and the word after) for each word in the set; text is a column of texts."""
    shared = texts.sparkSession.sparkContext.broadcast(np.packbits(bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chosen = np.unpackbits(shared.value)[:BITS]
        known: dict[str, bool] = {}
        for batch in batches:
            for part, own in chunks(batch, "text"):
                rows, found, beside = [], [], []
                for i, text in enumerate(own):
                    read = words(text)
                    for k, w in enumerate(read):
                        wanted = known.get(w)
                        if wanted is None:
                            if len(known) > 200_000:
                                known.clear()
                            wanted = known[w] = bool(chosen[_bit(w)])
                        if wanted:
                            rows += [i, i]
                            found += [w, w]
                            beside += ["<" + (read[k - 1] if k else ""), ">" + (read[k + 1] if k + 1 < len(read) else "")]
                of = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays([*[part.column(c).take(of) for c in keys], pa.array(found, pa.string()), pa.array(beside, pa.string())], [*keys, "word", "neighbour"])

    return texts.select(*keys, "text").mapInArrow(run, ", ".join(f"{k} string" for k in keys) + (", " if keys else "") + "word string, neighbour string")


def in_context(options_: DataFrame, marked: DataFrame, units: DataFrame, scans: DataFrame) -> DataFrame | None:
    """document_id, unit_id, word and right_form of each word that may be several forms; None if there is no such word.

    The support of a form is how often sound text has it beside the words that stand beside the word here.
    """
    open_ = cut_lineage(options_.where(F.size("forms") > 1))
    if open_.isEmpty():
        return None
    pairs = open_.select("word", F.inline("forms"))
    body = marked.select("document_id", "unit_id", F.array_join(F.transform(F.filter("lines", lambda x: ~x.furniture), lambda x: x.line), " ").alias("text"))
    here = _beside(body, ["document_id", "unit_id"], _bits(open_.select("word")), read_words).join(open_.select("word"), "word", "left_semi").distinct()
    ids = scans.select("document_id").where("document_id is not null").distinct()
    sound = units.select("document_id", "text").where("length(text) > 0").join(ids, "document_id", "left_anti")
    there = _beside(sound, [], _bits(pairs.select("form").distinct()), lambda t: [w.lower() for w in _TOKEN.findall(t)])
    there = there.where("length(neighbour) > 1").groupBy(F.col("word").alias("form"), "neighbour").agg(F.count("*").alias("times"))
    weighed = here.join(pairs, "word").join(there, ["form", "neighbour"], "left").groupBy("document_id", "unit_id", "word", "form").agg(F.sum(F.coalesce("times", F.lit(0))).alias("support"), F.max("n").alias("n"))
    best = weighed.groupBy("document_id", "unit_id", "word").agg(F.max(F.struct("support", "n", "form")).alias("b"))
    return best.select("document_id", "unit_id", "word", F.col("b.form").alias("right_form"))


def judged_breaks(body: DataFrame, counts: DataFrame) -> DataFrame:
    """Each break with n of the joined (whole) and of the hyphenated form (compound), and broken: no compound at its own hyphen."""
    n = known_words(counts).groupBy("skeleton").agg(F.sum("n").alias("n"))
    breaks = body.where(F.size("breaks") > 0).select("document_id", "unit_id", F.inline("breaks"))
    joined = breaks.join(n.withColumnRenamed("n", "whole"), "skeleton", "left").join(n.select(F.col("skeleton").alias("other_skeleton"), F.col("n").alias("compound")), "other_skeleton", "left")
    return joined.withColumn("broken", F.col("mark").isin("¬", "\u00ad") | (F.coalesce("whole", F.lit(0)) >= F.coalesce("compound", F.lit(0))))


def found(units: DataFrame, scans: DataFrame) -> DataFrame:
    """document_id, unit_id, noise: 'broken_word', 'misread', 'furniture'; each once for a unit."""
    marked = cut_lineage(marked_lines(scan_units(units, scans)))
    counts = cut_lineage(word_counts(units, scans))
    body = cut_lineage(body_words(marked))
    furniture = marked.where(F.exists("lines", lambda x: x.furniture)).select("document_id", "unit_id", F.lit("furniture").alias("noise"))
    may = cut_lineage(options(body, counts))
    wrong = body.select("document_id", "unit_id", F.explode("words").alias("word")).join(misread(may), "word", "left_semi").select("document_id", "unit_id", F.lit("misread").alias("noise"))
    told = in_context(may, marked, units, scans)
    if told is not None:
        wrong = wrong.unionByName(told.where("word != right_form").select("document_id", "unit_id", F.lit("misread").alias("noise")))
    breaks = judged_breaks(body, counts)
    split = breaks.where("broken").select("document_id", "unit_id", F.lit("broken_word").alias("noise"))
    # a compound at its own hyphen whose exact form is unknown holds a misreading
    inside = breaks.where("not broken").join(known_words(counts).select(F.col("word").alias("other")), "other", "left_anti").select("document_id", "unit_id", F.lit("misread").alias("noise"))
    return furniture.unionByName(wrong).unionByName(split).unionByName(inside).distinct()


def _recase(like: str, word: str) -> str:
    return word.upper() if like.isupper() else word[:1].upper() + word[1:] if like[:1].isupper() else word


def repair(lines: list[str], fixes: dict[str, str], joins: dict[str, str]) -> str:
    """Body lines as one line of text. fixes: misread to right form; joins: hyphenated to what it becomes."""
    text = ""
    for line in lines:
        line = line.strip(" ")
        end = _end(text)
        begin = _BEGIN.match(line)
        if end and begin:
            left, right = end.group(1), begin.group()
            last = left.rpartition("-")[2]
            to = joins.get(f"{last}-{right}".lower())
            if to is not None:
                text = text[: end.start(2)] + ("-" if "-" in to else "") + line
                continue
        text = f"{text} {line}" if text and line else text or line
    return _READ.sub(lambda m: _recase(m.group(), fixes[m.group().lower()]) if m.group().lower() in fixes else m.group(), text) if fixes else text


def repaired(units: DataFrame, scans: DataFrame) -> DataFrame:
    """document_id, unit_id, unit_order, type, text (of one line) of every unit that keeps text without its furniture."""
    latest = cut_lineage(scan_units(units, scans))
    marked = cut_lineage(marked_lines(latest))
    counts = cut_lineage(word_counts(units, scans))
    body = cut_lineage(body_words(marked))
    key = ["document_id", "unit_id"]
    may = cut_lineage(options(body, counts))
    fixes = body.select(*key, F.explode("words").alias("word")).join(misread(may), "word").select(*key, "word", "right_form")
    told = in_context(may, marked, units, scans)
    if told is not None:
        fixes = fixes.unionByName(told.where("word != right_form"))
    fixes = fixes.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("word", "right_form"))).alias("fixes"))
    joins = judged_breaks(body, counts).select(*key, "other", F.when(F.col("broken"), F.col("word")).otherwise(F.col("other")).alias("to")).groupBy(*key, "other").agg(F.min("to").alias("to")).groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("other", "to"))).alias("joins"))
    parts = marked.join(fixes, key, "left").join(joins, key, "left").join(latest.select(*key, "unit_order", "type"), key)
    schema = "document_id string, unit_id string, unit_order int, type string, text string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines, fix, join = (batch.column(c).to_pylist() for c in ("lines", "fixes", "joins"))
            texts = [repair([x["line"] for x in own if not x["furniture"]], dict(f or ()), dict(j or ())) for own, f, j in zip(lines, fix, join, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("document_id", "unit_id", "unit_order", "type")] + [pa.array(texts, pa.string())], ["document_id", "unit_id", "unit_order", "type", "text"])

    return parts.select("document_id", "unit_id", "unit_order", "type", "lines", "fixes", "joins").mapInArrow(run, schema).where("length(text) > 0")


#: Units in reading order that one window partition holds; a document of any size spans many.
WINDOW_UNITS = 4096


def paragraphs(fixed: DataFrame) -> DataFrame:
    """document_id, paragraph_no, text: units in reading order, those that go on a sentence joined to the one before.

    Windows run over stretches of a document; what a stretch takes from those before it comes from a window over
    one row per stretch.
    """
    stretch = F.floor(F.coalesce("unit_order", F.lit(0)) / WINDOW_UNITS).alias("stretch")
    rows = fixed.select("*", stretch, (~F.col("text").rlike(r"[.!?:;…]\s*$") & (F.col("type") == "paragraph")).alias("open"), (F.col("text").rlike(r"^\p{Ll}") & (F.col("type") == "paragraph")).alias("goes_on"))
    order = ["unit_order", "unit_id"]
    within = Window.partitionBy("document_id", "stretch").orderBy(*order)
    ends = rows.groupBy("document_id", "stretch").agg(F.max_by("open", F.struct(*order)).alias("last_open"))
    before = ends.select("document_id", "stretch", F.lag("last_open").over(Window.partitionBy("document_id").orderBy("stretch")).alias("was_open"))
    rows = rows.join(before, ["document_id", "stretch"]).withColumn("starts", (~(F.col("goes_on") & F.coalesce(F.lag("open").over(within), F.col("was_open"), F.lit(False)))).cast("long"))
    rows = rows.withColumn("own", F.sum("starts").over(within.rowsBetween(Window.unboundedPreceding, 0)))
    sums = rows.groupBy("document_id", "stretch").agg(F.sum("starts").alias("total"))
    base = sums.select("document_id", "stretch", F.coalesce(F.sum("total").over(Window.partitionBy("document_id").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    numbered = rows.join(base, ["document_id", "stretch"]).withColumn("paragraph_no", F.col("base") + F.col("own"))
    return numbered.groupBy("document_id", "paragraph_no").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(*order, "text"))), lambda x: x.text), " ").alias("text"))


def characters_left(paragraphs_: DataFrame, scans: DataFrame) -> DataFrame:
    """document_id, text_chars as recorded (the greatest, where rows differ), and what the repaired paragraphs hold, one blank line between them."""
    left = paragraphs_.groupBy("document_id").agg((F.sum(F.length("text")) + 2 * (F.count("*") - 1)).alias("chars_left"), F.count("*").alias("paragraphs"))
    known = scans.where("document_id is not null").groupBy("document_id").agg(F.max("text_chars").alias("text_chars"))
    return known.join(left, "document_id", "left").select("document_id", "text_chars", F.coalesce("chars_left", F.lit(0)).alias("chars_left"), F.coalesce("paragraphs", F.lit(0)).alias("paragraphs"))


__all__ = ["body_words", "characters_left", "found", "judged_breaks", "line_key", "in_context", "marked_lines", "misread", "options", "paragraphs", "read_words", "repaired", "scan_units", "skeleton", "unit_words", "word_counts"]
