"""Helpers for operators that take text through Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Characters of text handled at once inside a worker; bounds a task's memory, never the text.
CHUNK_CHARS = 1_000_000


def chunks(batch: pa.RecordBatch, column: str, limit: int = CHUNK_CHARS) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Slices of the batch whose texts have about ``limit`` characters together, with the texts as Python strings.

    A longer text makes a slice of its own and is never cut.
    """
    texts = batch.column(column)
    if not batch.num_rows:
        return
    import pyarrow.compute as pc

    lengths = pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    group = np.cumsum(lengths) // limit
    edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
    for a, b in zip(edges, edges[1:]):
        if b > a:
            part = batch.slice(a, b - a)
            yield part, part.column(column).to_pylist()


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[0], starts[0]+1, … for lengths[0] steps, then the same for the next, and so on."""
    before = np.cumsum(lengths) - lengths
    return np.arange(int(lengths.sum())) - np.repeat(before - starts, lengths)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def list_column(values: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.Array:
    offsets = np.zeros(len(lengths) + 1, dtype=np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))
