"""Splitting oversized texts at natural boundaries.

Every boundary of a text is joined to its successor: the farthest boundary a piece may end at if the piece before
ended here (strongest kind of boundary in the second half of the window first, then weaker ones, then a cut
between characters, which becomes a boundary too). Squaring the successor tables (pointer doubling) marks all ends
reachable from the start in a logarithmic number of vectorised rounds, for all texts of a batch at once. Tables hold
boundaries, not characters.

Defined results
* lengths are code points of the stored text; a piece never exceeds max_chars;
* each piece but the first begins overlap_chars before the end of the one before it, so pieces without their
  overlap join up to the text;
* a text of at most max_chars is one piece; null and empty texts have none;
* a hard cut keeps combining marks, joiners and variation selectors with their letter where the window allows;
* a profile whose max_chars isn't positive, or whose overlap isn't below it, is an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.llm.batches import chunks, code_points

#: Most profiles a table may have; they are held on the driver.
MAX_PROFILES = 1000
_SPACES = np.array([0x20, 0x09, 0x0A, 0x0D, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000], dtype=np.uint32)
_STOPS = np.array([ord(c) for c in ".!?…。！？"], dtype=np.uint32)
_CLOSERS = np.array([ord(c) for c in "\"'»”’)]"], dtype=np.uint32)
_COMMAS = np.array([ord(c) for c in ",;:–—，；"], dtype=np.uint32)


def boundaries(points: np.ndarray) -> list[np.ndarray]:
    """For each natural kind, strongest first, the positions a piece may end before: line, sentence, clause, word.

    A boundary lies behind the last white space of a run; the run and the characters beside it tell its kinds.
    """
    space = np.isin(points, _SPACES)
    word = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    runs = np.flatnonzero(space & ~np.concatenate([[False], space[:-1]]))[: len(word)]
    back = np.maximum(runs - 1, 0)  # the character before the run
    quoted = np.where(np.isin(points[back], _CLOSERS) & (back > 0), back - 1, back)
    ends = np.flatnonzero(points == 10)
    broken = np.searchsorted(ends, word) > np.searchsorted(ends, back + 1)
    stop, comma, ahead = np.isin(points[quoted], _STOPS), np.isin(points[back], _COMMAS), points[word]
    lower = ((ahead >= 0x61) & (ahead <= 0x7A)) | ((ahead >= 0x430) & (ahead <= 0x45F)) | ((ahead >= 0xDF) & (ahead <= 0xFF))
    return [word[broken], word[stop & ~lower], word[comma | stop], word]


def _glued(points: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Would a cut here part a letter from its marks?"""
    ahead = np.where(at < len(points), points[np.minimum(at, len(points) - 1)], 0)
    return ((ahead >= 0x300) & (ahead <= 0x36F)) | (ahead == 0x200D) | ((ahead >= 0xFE00) & (ahead <= 0xFE0F)) | ((ahead >= 0x1F3FB) & (ahead <= 0x1F3FF)) | (points[at - 1] == 0x200D)


def successors(points: np.ndarray, kinds: list[np.ndarray], at: np.ndarray, size: int, overlap: int) -> np.ndarray:
    """Where the next piece ends if the last one ended at each of these positions."""
    n = len(points)
    start = np.where(at == 0, 0, at - overlap)
    limit = np.minimum(start + size, n)
    least = np.where(at == 0, overlap, at)  # a piece goes beyond its overlap, so the next one begins later
    half = np.maximum(start + size // 2, least)
    out = np.full(len(at), -1, dtype=np.int64)
    for kind, floor in zip(kinds, [half, half, half, least], strict=True):
        which = np.searchsorted(kind, limit, "right") - 1
        nearest = np.where(which >= 0, kind[np.maximum(which, 0)], -1) if len(kind) else np.full(len(at), -1)
        out = np.where((out < 0) & (nearest > floor), nearest, out)
    hard = np.flatnonzero((out < 0) & (limit < n))
    cut = limit[hard]
    while True:  # back to the nearest place that parts no letter from its marks
        move = _glued(points, cut) & (cut - 1 > least[hard])
        if not move.any():
            break
        cut = cut - move
    out[hard] = np.where(_glued(points, cut), limit[hard], cut)
    return np.where(limit == n, n, out)


def _table(text: str, size: int, overlap: int) -> tuple[np.ndarray, np.ndarray]:
    """Boundaries of a text (0, the natural ones, and those that cuts between characters make) and their successors."""
    points = code_points(text)
    kinds = boundaries(points)
    at = np.unique(np.concatenate([[0], kinds[-1], [len(points)]]))
    step = successors(points, kinds, at, size, overlap)
    fresh = np.setdiff1d(step, at)
    while len(fresh):
        more = successors(points, kinds, fresh, size, overlap)
        at, step = np.concatenate([at, fresh]), np.concatenate([step, more])
        fresh = np.setdiff1d(more, at)
    order = np.argsort(at)
    return at[order], np.searchsorted(at[order], step[order])


def cuts(texts: list[str], sizes: list[int], overlaps: list[int]) -> list[np.ndarray]:
    """Ends of the pieces of each text, by squaring the batch's successor table."""
    if not texts:
        return []
    places, tables, base, offset = [], [], [], 0
    for text, size, overlap in zip(texts, sizes, overlaps, strict=True):
        at, step = _table(text, size, overlap) if text else (np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64))
        places.append(at)
        tables.append(step + offset)
        base.append(offset)
        offset += len(at)
    jump = np.concatenate(tables)
    reached = np.zeros(offset, dtype=bool)
    front = np.array(base, dtype=np.int64)
    reached[front] = True
    while True:
        # all ends reached so far, and the same again twice as far on
        more = jump[front]
        new = more[~reached[more]]
        if not len(new):
            break
        reached[new] = True
        front = np.flatnonzero(reached)
        jump = jump[jump]
    ends = np.flatnonzero(reached)
    edges = np.searchsorted(ends, [*base, offset])
    return [at[ends[a:b] - o] for at, a, b, o in zip(places, edges, edges[1:], base)]


def _profiles(profiles: DataFrame) -> list:
    rows = profiles.select("profile", "max_chars", "overlap_chars").where("profile is not null").distinct().limit(MAX_PROFILES + 1).collect()
    if len(rows) > MAX_PROFILES:
        raise ValueError(f"more than {MAX_PROFILES} profiles")
    for r in rows:
        if r.max_chars is None or r.max_chars < 1 or not 0 <= (r.overlap_chars or 0) < r.max_chars:
            raise ValueError(f"profile {r.profile}: max_chars {r.max_chars}, overlap_chars {r.overlap_chars}")
    return sorted(rows, key=lambda r: r.profile)


def pieces(units: DataFrame, profiles: DataFrame, keys: tuple[str, ...] = ("document_id", "unit_id")) -> DataFrame:
    """profile, the keys, piece_no, n_pieces, start_char, text of every piece of every unit.

    Units that fit stay in the JVM; only longer ones pass through Python, once for each profile they exceed.
    """
    known = _profiles(profiles)
    if not known:
        return units.select(F.lit("").alias("profile"), *keys, F.lit(0).alias("piece_no"), F.lit(1).alias("n_pieces"), F.lit(0).alias("start_char"), "text").limit(0)
    which = F.array(*[F.struct(F.lit(r.profile).alias("profile"), F.lit(r.max_chars).alias("max_chars"), F.lit(r.overlap_chars or 0).alias("overlap_chars")) for r in known])
    units = units.select(*keys, "text").where(F.length("text") > 0)
    length = F.length("text")
    fits = units.withColumn("p", F.explode(F.filter(which, lambda p: p.max_chars >= length)))
    whole = fits.select(F.col("p.profile").alias("profile"), *keys, F.lit(0).alias("piece_no"), F.lit(1).alias("n_pieces"), F.lit(0).alias("start_char"), "text")
    long = units.where(length > min(r.max_chars for r in known)).withColumn("p", F.explode(F.filter(which, lambda p: p.max_chars < length))).select(F.col("p.profile").alias("profile"), "p.max_chars", "p.overlap_chars", *keys, "text")
    schema = whole.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in chunks(batch, "text"):
                sizes, overlaps = part.column("max_chars").to_pylist(), part.column("overlap_chars").to_pylist()
                row, number, total, start, out = [], [], [], [], []
                for i, (text, ends) in enumerate(zip(texts, cuts(texts, sizes, overlaps), strict=True)):
                    stops = ends[1:].tolist()
                    for k, stop in enumerate(stops):
                        begin = stops[k - 1] - overlaps[i] if k else 0
                        row.append(i)
                        number.append(k)
                        total.append(len(stops))
                        start.append(begin)
                        out.append(text[begin:stop])
                of = pa.array(row, pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("profile").take(of), *[part.column(k).take(of) for k in keys], pa.array(number, pa.int32()), pa.array(total, pa.int32()), pa.array(start, pa.int32()), pa.array(out, pa.string())], schema.names)

    return whole.unionByName(long.mapInArrow(run, schema))


def oversized(units: DataFrame, profiles: DataFrame, keys: tuple[str, ...] = ("document_id", "unit_id")) -> DataFrame:
    """profile and keys of each unit that had to be cut; equal rows count once."""
    return pieces(units, profiles, keys).where("n_pieces > 1").select("profile", *keys).distinct()
