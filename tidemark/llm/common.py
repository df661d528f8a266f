"""Helpers shared by the operators: Arrow batches, word hashes.

Word hashes are computed with numpy over whole byte buffers, so no Python object
exists per word.  A hash is a random-table polynomial modulo 2**64 followed by a
bit mixer; equal words always get equal hashes in every task.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: ASCII and letters and signs of common alphabets, on whose classes, cases and compositions all versions of Unicode agree.
WELL_KNOWN = re.compile("[\x00-\x7e\xa0-ſΑ-ΡΣ-ώА-я‐-‧‰-⁞€一-龥]*")
SEGMENT_BYTES = 1 << 20
SUB_BATCH_ROWS = 256
SUB_BATCH_CHARS = 4 << 20


def map_texts(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema) -> DataFrame:
    """``mapInArrow`` that hands ``fn`` small slices, bounded by rows and by characters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch):
                yield fn(piece)

    return df.mapInArrow(run, schema)


def filter_texts(df: DataFrame, text_col: str, keep: Callable[[list], list[bool]]) -> DataFrame:
    """The rows of ``df``, all columns, whose text ``keep`` lets through."""
    at = df.columns.index(text_col)

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array(keep(batch.column(at).to_pylist()), pa.bool_()))

    return map_texts(df, fn, df.schema)


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    start, rows = 0, batch.num_rows
    sizes = np.full(rows, 8, np.int64)
    for col in batch.columns:
        if pa.types.is_string(col.type) or pa.types.is_binary(col.type) or pa.types.is_large_string(col.type):
            sizes += np.asarray(col.is_valid()).astype(np.int64) * 0 + _lengths(col)
    ends = np.cumsum(sizes)
    while start < rows:
        base = ends[start - 1] if start else 0
        stop = int(np.searchsorted(ends, base + SUB_BATCH_CHARS, "right"))
        stop = min(rows, max(start + 1, min(stop, start + SUB_BATCH_ROWS)))
        yield batch.slice(start, stop - start)
        start = stop


def _lengths(col: pa.Array) -> np.ndarray:
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser on uint64 arrays."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) | np.uint64(1)
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 16)
        tables = []
        for base in (_BASE, _INVERSE):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            tables.append(np.multiply.accumulate(steps))
        _powers[:] = tables
    return _powers[0], _powers[1]


def _segment(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    inside = ~SPACE[buf]
    edge = np.diff(np.concatenate(([False], inside, [False])).astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return starts, np.zeros(0, np.uint64)
    up, down = _power_tables(len(buf) + 1)
    terms = _BYTE[buf] * up[: len(buf)]
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)))
    return starts, mix((total[ends] - total[starts]) * down[starts])


def hash_words(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words ``[^\\x20\\x09-\\x0D]+`` of all parts, and the offsets of each part in them.

    Buffers are cut into segments of about 1 MB at white space, so a very long
    text needs memory for one segment and its hashes only.
    """
    joined = np.frombuffer(b"\n".join(parts) + b"\n", np.uint8)
    bounds = np.cumsum([0] + [len(p) + 1 for p in parts])
    found: list[np.ndarray] = []
    where: list[np.ndarray] = []
    at = 0
    while at < len(joined):
        stop = min(len(joined), at + SEGMENT_BYTES)
        while stop < len(joined):  # end at white space
            space = np.flatnonzero(SPACE[joined[stop : stop + SEGMENT_BYTES]])
            if len(space):
                stop += int(space[0]) + 1
                break
            stop = min(len(joined), stop + SEGMENT_BYTES)
        starts, hashes = _segment(joined[at:stop])
        found.append(hashes)
        where.append(starts + at)
        at = stop
    starts = np.concatenate(where)
    return np.concatenate(found), np.searchsorted(starts, bounds)


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """A hash for each window of ``k`` words (one for all words, if there are fewer, none without words)."""
    n = len(words)
    if n == 0:
        return words
    width = min(k, n)
    out = np.full(n - width + 1, width, np.uint64)
    for i in range(width):
        out = mix(out * np.uint64(0xA0761D6478BD642F) + words[i : n - width + 1 + i])
    return out


def utf8(texts: list) -> list[bytes]:
    return [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts]
