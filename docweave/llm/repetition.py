"""Repetition inside a document.

Every document gets rule statistics that take one sort each: the share of its words that lie in a word pair which
occurred earlier or repeat the word before (echo_share), of words that repeat the word before (run_share), and of its
lines that occurred earlier (line_share). An isolation forest over these (path lengths over random splits) scores the
documents, and only those it marks as anomalous get the exact rule, which sorts passages and phrases.

A copied word always lies in an earlier pair or repeats its neighbour, so a document that meets the rule has an
echo_share no less than the rule's share. The threshold is the least score that the forest can give such a document
at all: it holds for every document, sampled or not. Labelled rows calibrate it by choosing among forests the one
whose threshold lets the fewest other documents pass. The forests are grown, and the labels taken, on a bounded sample
(SAMPLE_ROWS).

Defined results
* words are runs of letters, case folded; digits, punctuation and spacing are ignored;
* a word counts as copied if it lies in eight words, or in a back-to-back phrase of up to seven, that occurred
  earlier in the document; the first occurrence is no copy;
* null, empty and wordless texts have share 0 and are never found;
* equal texts under several ids are all found; rows with a null id keep it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.llm.batches import chunks

PASSAGE = 8
#: A document is found from this share on, given as numerator and denominator.
SHARE = (1, 3)
#: The forest: labelled rows at most (about), trees, rows of a tree, seed.
SAMPLE_ROWS, TREES, TREE_ROWS, SEED = 20_000, 64, 256, 7
STATISTICS = ("echo_share", "run_share", "line_share")
#: Statistics and seeds of the forests that labelled rows choose from; the first statistic bears the threshold.
FORESTS = (((0,), 7), ((0, 1, 2), 7), ((0, 1, 2), 8), ((0, 2), 7))
_WORD = re.compile(r"[^\W\d_]+").findall
_SALT, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0x100000001B3)


def _earlier(keys: np.ndarray) -> np.ndarray:
    """Does the same key occur at an earlier place?"""
    order = np.argsort(keys, kind="stable")
    same = np.zeros(len(keys), dtype=bool)
    ordered = keys[order]
    same[order[1:][ordered[1:] == ordered[:-1]]] = True
    return same


def _cover(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Positions within width of a marked start."""
    edge = np.zeros(n + width + 1, dtype=np.int32)
    at = np.flatnonzero(starts)
    np.add.at(edge, at, 1) if len(at) < 64 else edge.__iadd__(np.bincount(at, minlength=len(edge)).astype(np.int32))
    ends = np.bincount(at + width, minlength=len(edge)).astype(np.int32) if len(at) else 0
    return np.cumsum(edge - ends)[:n] > 0


@dataclass
class Words:
    """Hashes of the words and lines of many texts, one after the other, with the text each belongs to."""

    n_texts: int
    words: np.ndarray
    doc: np.ndarray
    counts: np.ndarray
    lines: np.ndarray
    line_doc: np.ndarray

    @property
    def salt(self) -> np.ndarray:
        return (self.doc.astype(np.uint64) + np.uint64(1)) * _SALT

    def gram(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the width words from each position on, and whether they lie in one text."""
        m = max(len(self.words) - width + 1, 0)
        key = np.zeros(m, dtype=np.uint64)
        for j in range(width):
            key = key * _STEP + (self.words[j : j + m] ^ (self.words[j : j + m] >> np.uint64(29)))
        return key ^ self.salt[:m], self.doc[:m] == self.doc[width - 1 : width - 1 + m]

    def repeated(self, width: int) -> np.ndarray:
        """Does the gram that starts here occur earlier in the text?"""
        out = np.zeros(len(self.words), dtype=bool)
        key, inside = self.gram(width)
        at = np.flatnonzero(inside)
        out[at] = _earlier(key[at])
        return out

    def echoes(self, width: int) -> np.ndarray:
        """Is this word the one ``width`` words before?"""
        out = np.zeros(len(self.words), dtype=bool)
        if len(out) > width:
            out[width:] = (self.words[width:] == self.words[:-width]) & (self.doc[width:] == self.doc[:-width])
        return out

    def per_text(self, flags: np.ndarray) -> np.ndarray:
        return np.bincount(self.doc[flags], minlength=self.n_texts)


def words_of(texts: list[str | None]) -> Words:
    words: list[int] = []
    counts = np.zeros(len(texts), dtype=np.int64)
    lines: list[int] = []
    line_counts = np.zeros(len(texts), dtype=np.int64)
    for i, text in enumerate(texts):
        if text:
            own = _WORD(text.casefold())
            words.extend(map(hash, own))
            counts[i] = len(own)
            kept = [hash(x) for x in text.split("\n") if x and not x.isspace()]
            lines.extend(kept)
            line_counts[i] = len(kept)
    every = np.arange(len(texts))
    return Words(len(texts), np.array(words, dtype=np.int64).view(np.uint64), np.repeat(every, counts), counts, np.array(lines, dtype=np.int64).view(np.uint64), np.repeat(every, line_counts))


def statistics(w: Words) -> np.ndarray:
    """A row of STATISTICS for each text."""
    pair, same = w.repeated(2), w.echoes(1)
    echo = pair | same
    echo[1:] |= pair[:-1]
    seen = _earlier(w.lines ^ ((w.line_doc.astype(np.uint64) + np.uint64(1)) * _SALT))
    size, line_size = np.maximum(w.counts, 1), np.maximum(np.bincount(w.line_doc, minlength=w.n_texts), 1)
    return np.column_stack([w.per_text(echo) / size, w.per_text(same) / size, np.bincount(w.line_doc[seen], minlength=w.n_texts) / line_size])


def copied(w: Words) -> np.ndarray:
    """The exact rule: how many words of each text lie in copies."""
    n = len(w.words)
    marked = _cover(w.repeated(PASSAGE), PASSAGE, n)
    for width in range(1, PASSAGE):
        same = w.echoes(width)
        if same.any():
            total = np.concatenate([[0], np.cumsum(same)])
            starts = np.zeros(n, dtype=bool)
            starts[: n - width + 1] = total[width:] - total[: n - width + 1] == width
            marked |= _cover(starts, width, n)
    return w.per_text(marked)


def meets_rule(n_copied: np.ndarray, n_words: np.ndarray) -> np.ndarray:
    return (n_words > 0) & (n_copied * SHARE[1] >= n_words * SHARE[0])


class IsolationForest:
    """Random splits; a row's score is 2 ** -(mean path length / usual path length)."""

    def __init__(self, rows: np.ndarray, trees: int = TREES, tree_rows: int = TREE_ROWS, seed: int = SEED):
        """rows: a matrix of statistics, one row a document."""
        rng = np.random.default_rng(seed)
        self.usual = _usual(min(tree_rows, len(rows)))
        self.trees = []
        for _ in range(trees):
            own = rows[rng.choice(len(rows), min(tree_rows, len(rows)), replace=False)]
            feature, split, left, right, length = [], [], [], [], []
            limit = int(np.ceil(np.log2(max(len(own), 2))))

            def grow(x: np.ndarray, depth: int) -> int:
                at = len(feature)
                for column in (feature, split, left, right, length):
                    column.append(0)
                spread = np.flatnonzero(x.max(0) > x.min(0)) if len(x) > 1 else []
                if depth >= limit or not len(spread):
                    feature[at], length[at] = -1, depth + _usual(len(x))
                    return at
                f = int(rng.choice(spread))
                cut = rng.uniform(x[:, f].min(), x[:, f].max())
                feature[at], split[at] = f, cut
                below = x[:, f] <= cut
                left[at] = grow(x[below], depth + 1)
                right[at] = grow(x[~below], depth + 1)
                return at

            grow(own, 0)
            self.trees.append((np.array(feature), np.array(split, dtype=float), np.array(left), np.array(right), np.array(length, dtype=float)))

    def score(self, rows: np.ndarray) -> np.ndarray:
        total = np.zeros(len(rows))
        for feature, split, left, right, length in self.trees:
            at = np.zeros(len(rows), dtype=np.int64)
            while True:
                inner = feature[at] >= 0
                if not inner.any():
                    break
                go = np.flatnonzero(inner)
                node = at[go]
                at[go] = np.where(rows[go, feature[node]] <= split[node], left[node], right[node])
            total += length[at]
        return np.power(2.0, -(total / len(self.trees)) / max(self.usual, 1e-9))

    def least(self, column: int, low: float) -> float:
        """A score that no row falls below whose statistic in this column is at least low.

        In each tree such a row can end only in leaves on the statistic's upper side; the longest path among them
        bounds its path length.
        """
        total = 0.0
        for feature, split, left, right, length in self.trees:
            longest, open_ = 0.0, [0]
            while open_:
                at = open_.pop()
                if feature[at] < 0:
                    longest = max(longest, float(length[at]))
                    continue
                open_.append(right[at])
                if feature[at] != column or split[at] >= low:
                    open_.append(left[at])
            total += longest
        return float(np.power(2.0, -(total / len(self.trees)) / max(self.usual, 1e-9)))


def _usual(n: int) -> float:
    """Mean path length of an unsuccessful search among n rows."""
    return 0.0 if n < 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n if n > 2 else 1.0


@dataclass
class Marker:
    """A forest over some statistics and the score from which documents are marked."""

    columns: tuple[int, ...]
    forest: IsolationForest
    threshold: float

    def score(self, rows: np.ndarray) -> np.ndarray:
        return self.forest.score(rows[:, self.columns])


def train(rows: np.ndarray, labels: np.ndarray) -> Marker | None:
    """The forest whose threshold marks the fewest rows that aren't labelled; None without rows to grow one on."""
    if len(rows) < 2:
        return None
    markers = []
    for columns, seed in FORESTS:
        forest = IsolationForest(rows[:, columns], seed=seed)
        marker = Marker(columns, forest, forest.least(0, SHARE[0] / SHARE[1]) - 1e-9)
        markers.append((int((~labels & (marker.score(rows) >= marker.threshold)).sum()), len(markers), marker))
    return min(markers)[2]


def _sample(documents: DataFrame, key: str, text: str, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Statistics and labels of about ``rows`` rows at most, chosen by a seeded hash without order or shuffle of the rest."""
    share = min(1.0, rows / max(documents.count(), 1))
    draw = F.pmod(F.xxhash64(F.lit(SEED), key), F.lit(1 << 30)) / F.lit(float(1 << 30))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in chunks(batch, text):
                w = words_of(texts)
                yield pa.RecordBatch.from_arrays([*[pa.array(c) for c in statistics(w).T], pa.array(meets_rule(copied(w), w.counts))], [*STATISTICS, "label"])

    picked = documents.where(draw <= share).select(text).mapInArrow(run, ", ".join(f"{s} double" for s in STATISTICS) + ", label boolean").limit(rows + rows // 10).toPandas()
    return picked[list(STATISTICS)].to_numpy(dtype=float), picked["label"].to_numpy(dtype=bool)


def _marked(documents: DataFrame, key: str, text: str, sample_rows: int, everywhere: bool) -> DataFrame:
    """key, share, score, candidate and found of every row; without everywhere, share only of candidates."""
    marker = train(*_sample(documents, key, text, sample_rows))
    schema = f"`{key}` {documents.schema[key].dataType.simpleString()}, share double, score double, candidate boolean, found boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in chunks(batch, text):
                w = words_of(texts)
                score = marker.score(statistics(w)) if marker else np.ones(len(texts))
                candidate = score >= (marker.threshold if marker else 0.0)
                n_copied = np.zeros(len(texts), dtype=np.int64)
                if everywhere:
                    n_copied = copied(w)
                elif candidate.any():
                    at = np.flatnonzero(candidate)
                    n_copied[at] = copied(words_of([texts[i] for i in at]))
                share = np.where(candidate | everywhere, n_copied / np.maximum(w.counts, 1), np.nan)
                yield pa.RecordBatch.from_arrays([part.column(key), pa.array(share, from_pandas=True), pa.array(score), pa.array(candidate), pa.array(candidate & meets_rule(n_copied, w.counts))], [key, "share", "score", "candidate", "found"])

    return documents.select(key, text).mapInArrow(run, schema)


def found(documents: DataFrame, key: str = "doc_id", text: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The key of every document that the forest marks and the exact rule then finds."""
    return _marked(documents, key, text, sample_rows, False).where("found").select(key).distinct()


def shares(documents: DataFrame, key: str = "doc_id", text: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """key, share of repeated content, score, candidate (marked by the forest) and found of every row."""
    return _marked(documents, key, text, sample_rows, True)
