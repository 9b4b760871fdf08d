"""Corpus encoding with a public byte-level BPE vocabulary.

Two tiers. A pre-token that is itself in the vocabulary is resolved by a minimal perfect hash (hash and displace:
a displacement per bucket sends the keys of every bucket to free slots; single keys name their slot). A miss is
merged by a heap over linked bytes: the pair of lowest rank, leftmost first, is joined until none is in the
vocabulary. Each worker keeps the pieces of pre-tokens it has met, up to a bound, and gathers the ids of a batch
from them by index.

Defined results: an empty text and a null text both have the empty list of ids; white space and the strings of
special tokens are ordinary text; no special token is ever added; texts are encoded whole.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from docweave.llm.batches import chunks, list_column, ranges

#: Pre-tokens of the byte-level vocabulary (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pre-tokens a worker keeps; beyond that it starts anew.
CACHE_TOKENS = 400_000


def _public(name: str) -> str:
    """Where the public tokenizers' package keeps a file; without the package the folder it is installed to."""
    try:
        import public_tokenizers

        return str(public_tokenizers.path(name))
    except ImportError:
        return f"/opt/tokenizers/{name}"


VOCABULARY = _public("byte_bpe_50k.tiktoken")


class PerfectHash:
    """Minimal perfect hash of byte strings to integers; keys are kept to tell strangers."""

    def __init__(self, values: dict[bytes, int], per_bucket: int = 3):
        import xxhash

        keys = list(values)
        n = self.size = len(keys)
        self.buckets = max(1, n // per_bucket)
        self.shift = np.zeros(self.buckets, dtype=np.int64)
        self.keys: list[bytes | None] = [None] * n
        self.values = np.zeros(n, dtype=np.int32)
        hashes = [xxhash.xxh3_128_intdigest(k) for k in keys]
        members: dict[int, list[int]] = {}
        for i, h in enumerate(hashes):
            members.setdefault((h >> 64) % self.buckets, []).append(i)
        taken = bytearray(n)
        single = []
        for bucket, ids in sorted(members.items(), key=lambda x: -len(x[1])):
            if len(ids) == 1:
                single.append((bucket, ids[0]))
                continue
            parts = [((hashes[i] & 0xFFFFFFFF), ((hashes[i] >> 32) & 0xFFFFFFFF) | 1) for i in ids]
            d = 0
            while True:
                slots = [(a + d * b) % n for a, b in parts]
                if not any(taken[s] for s in slots) and len(set(slots)) == len(slots):
                    break
                d += 1
            self.shift[bucket] = d
            for s, i in zip(slots, ids, strict=True):
                taken[s] = 1
                self.keys[s], self.values[s] = keys[i], values[keys[i]]
        free = (s for s in range(n) if not taken[s])
        for bucket, i in single:
            s = next(free)
            self.shift[bucket] = -1 - s
            self.keys[s], self.values[s] = keys[i], values[keys[i]]

    def get(self, key: bytes) -> int:
        """The key's value, or -1."""
        import xxhash

        h = xxhash.xxh3_128_intdigest(key)
        d = int(self.shift[(h >> 64) % self.buckets])
        s = -1 - d if d < 0 else ((h & 0xFFFFFFFF) + d * (((h >> 32) & 0xFFFFFFFF) | 1)) % self.size
        return int(self.values[s]) if self.keys[s] == key else -1


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines) if a}


def merge_bytes(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: pairs joined in order of rank, by a heap over a doubly linked list of spans."""
    n = len(piece)
    if n == 1:
        return [ranks[piece]]
    end = list(range(1, n + 1))  # end of the span that begins here
    before = list(range(-1, n - 1))
    live = [True] * n
    heap: list[tuple[int, int, int]] = []

    def offer(at: int) -> None:
        middle = end[at]
        if middle < n and (rank := ranks.get(piece[at : end[middle]])) is not None:
            heapq.heappush(heap, (rank, at, end[middle]))

    for i in range(n - 1):
        offer(i)
    while heap:
        _, at, stop = heapq.heappop(heap)
        if not live[at] or end[at] == n or end[end[at]] != stop:
            continue
        gone = end[at]
        live[gone] = False
        end[at] = stop
        if stop < n:
            before[stop] = at
        offer(at)
        if before[at] >= 0:
            offer(before[at])
    out, at = [], 0
    while at < n:
        out.append(ranks[piece[at : end[at]]])
        at = end[at]
    return out


class _Pieces(dict):
    """Pre-token -> index of its ids in the pool; fills itself."""

    def __init__(self, ranks: dict[bytes, int], whole: PerfectHash):
        self.ranks, self.whole = ranks, whole
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.pool: list[int] = []
        self.starts: list[int] = []
        self.sizes: list[int] = []
        self.arrays: tuple[int, np.ndarray, np.ndarray, np.ndarray] | None = None

    def __missing__(self, token: str) -> int:
        piece = token.encode("utf-8")
        found = self.whole.get(piece)
        ids = [found] if found >= 0 else merge_bytes(piece, self.ranks)
        self.starts.append(len(self.pool))
        self.sizes.append(len(ids))
        self.pool += ids
        self[token] = index = len(self.starts) - 1
        return index

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if self.arrays is None or self.arrays[0] != len(self.starts):
            self.arrays = (len(self.starts), np.array(self.pool, dtype=np.int32), np.array(self.starts, dtype=np.int64), np.array(self.sizes, dtype=np.int64))
        return self.arrays[1:]


class Encoder:
    """Texts to ids; one per worker process."""

    def __init__(self, ranks: dict[bytes, int], whole: PerfectHash | None = None):
        import regex

        self.pieces = _Pieces(ranks, whole or PerfectHash(ranks))
        self.split = regex.compile(PATTERN).findall

    def indices(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Pool index of every pre-token, and their number in each text."""
        if len(self.pieces) > CACHE_TOKENS:
            self.pieces.reset()
        at: list[int] = []
        counts = np.zeros(len(texts), dtype=np.int64)
        get, split = self.pieces.__getitem__, self.split
        for i, text in enumerate(texts):
            if text:
                tokens = split(text)
                at.extend(map(get, tokens))
                counts[i] = len(tokens)
        return np.array(at, dtype=np.int64), counts

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other, and their number in each text."""
        at, counts = self.indices(texts)
        pool, starts, sizes = self.pieces.tables()
        if not len(at):
            return np.zeros(0, dtype=np.int32), counts
        lengths = sizes[at]
        return pool[ranges(starts[at], lengths)], _sums(lengths, counts)

    def count(self, texts: list[str | None]) -> np.ndarray:
        at, counts = self.indices(texts)
        return _sums(self.pieces.tables()[2][at], counts) if len(at) else counts


def _sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values)])
    edge = np.concatenate([[0], np.cumsum(counts)])
    return total[edge[1:]] - total[edge[:-1]]


_ENCODERS: dict[int, Encoder] = {}


def _shared(df: DataFrame, path: str):
    """The vocabulary and its hash (about 1 MB, fixed by the vocabulary) for all workers."""
    ranks = read_ranks(path)
    return df.sparkSession.sparkContext.broadcast((ranks, PerfectHash(ranks)))


def _encoder(shared) -> Encoder:
    if shared.id not in _ENCODERS if hasattr(shared, "id") else True:
        _ENCODERS.clear()
        _ENCODERS[getattr(shared, "id", 0)] = Encoder(*shared.value)
    return next(iter(_ENCODERS.values()))


def encode(df: DataFrame, key: str = "doc_id", text: str = "text", path: str = VOCABULARY) -> DataFrame:
    """key and ids (array<int>) of each row; other columns are not read."""
    shared = _shared(df, path)
    schema = f"`{key}` {df.schema[key].dataType.simpleString()}, ids array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared)
        for batch in batches:
            for part, texts in chunks(batch, text):
                ids, counts = encoder.encode(texts)
                yield pa.RecordBatch.from_arrays([part.column(key), list_column(ids, counts, pa.int32())], [key, "ids"])

    return df.select(key, text).mapInArrow(run, schema)


def count_tokens(df: DataFrame, text: str = "text", name: str = "tokens", path: str = VOCABULARY) -> DataFrame:
    """df with the text replaced by its number of ids (0 for null and empty texts)."""
    shared = _shared(df, path)
    others = [c for c in df.columns if c != text]
    schema = ", ".join([f"`{c}` {df.schema[c].dataType.simpleString()}" for c in others] + [f"`{name}` bigint"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared)
        for batch in batches:
            for part, texts in chunks(batch, text):
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in others], pa.array(encoder.count(texts), pa.int64())], [*others, name])

    return df.select(*others, text).mapInArrow(run, schema)
