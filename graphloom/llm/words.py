"""Arrays of words, word hashes and shingles of a batch of texts, and small helpers around Arrow batches.

A word is a run of bytes other than 0x20 and 0x09-0x0D; these separators are single bytes in UTF-8, so
cutting the bytes cuts the code points. All functions work on whole texts; a null text counts as empty.
Hashes have 64 bits and depend on the bytes alone, never on where a word stands.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one step of a kernel looks at; a longer text is one step of its own.
STEP_BYTES = 2_000_000
HASH_STEP = 1 << 19


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit integers (a bijection)."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _tables(fold_case: bool) -> tuple[np.ndarray, np.ndarray]:
    separators = np.zeros(256, bool)
    separators[[9, 10, 11, 12, 13, 32]] = True
    values = mix(np.arange(1, 257, dtype=np.uint64))
    if fold_case:
        values[65:91] = values[97:123]
    values[separators] = 0
    return separators, values


_POWERS: list[np.ndarray] = []


def _powers(size: int) -> list[np.ndarray]:
    """At least ``size`` powers of a number, and of its inverse; those of a step are kept."""
    power = 0x9E3779B97F4A7C15
    if _POWERS and len(_POWERS[0]) >= size:
        return _POWERS
    found = [np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(max(size, HASH_STEP), np.uint64(x)))]) for x in (power, pow(power, -1, 1 << 64))]
    if size <= HASH_STEP:
        _POWERS[:] = found
    return found


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts after each other, and where each text begins (one more entry for the end)."""
    column = pc.fill_null(column, "") if column.null_count else column
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


class Words:
    """The words of a batch: byte range, and for each text the range of its words."""

    def __init__(self, column: pa.Array, fold_case: bool = False):
        separators, self._values = _tables(fold_case)
        self.data, self.text_at = text_bytes(column)
        n = len(self.data)
        inside = ~separators[self.data]
        first = np.zeros(n, bool)
        if n:
            first[1:] = ~inside[:-1]
            first[self.text_at[:-1][self.text_at[:-1] < n]] = True
        first &= inside
        self.starts = np.flatnonzero(first)
        last = np.zeros(n, bool)
        if n:
            last[:-1] = ~inside[1:] | first[1:]
            last[-1] = True
            ends = self.text_at[1:]
            last[ends[ends > 0] - 1] = True
        last &= inside
        self.ends = np.flatnonzero(last) + 1
        #: words of text i: offsets[i] .. offsets[i + 1]
        self.offsets = np.searchsorted(self.starts, self.text_at)

    def counts(self) -> np.ndarray:
        return np.diff(self.offsets)

    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.offsets) - 1), self.counts())

    def hashes(self) -> np.ndarray:
        """A hash for each word: a polynomial over its bytes, shifted to the word's start, then mixed."""
        out = np.empty(len(self.starts), np.uint64)
        i, n = 0, len(self.starts)
        while i < n:
            at = self.starts[i]
            j = max(int(np.searchsorted(self.ends, at + HASH_STEP, "right")), i + 1)
            stop = int(self.ends[j - 1])
            up, down = _powers(stop - at)
            values = self._values[self.data[at:stop]] * up[: stop - at]
            local = self.starts[i:j] - at
            out[i:j] = np.add.reduceat(values, local) * down[local]
            i = j
        return mix(out)


def shingles(hashes: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``k`` words, and their ranges by text. A text of fewer words has none."""
    n = len(hashes)
    counts = np.maximum(np.diff(offsets) - k + 1, 0)
    ranges = np.concatenate([[0], np.cumsum(counts)])
    if n < k:
        return np.zeros(0, np.uint64), ranges
    total = hashes[: n - k + 1].copy()
    factor = 1
    for j in range(1, k):
        factor = factor * 0xBF58476D1CE4E5B9 % (1 << 64)
        total += hashes[j : n - k + 1 + j] * np.uint64(factor)
    keep = np.repeat(offsets[:-1], counts) + np.arange(ranges[-1]) - np.repeat(ranges[:-1], counts)
    return mix(total[keep]), ranges


def steps(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches cut so that each holds about ``limit`` bytes of ``column``, and one row at least."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        total = np.cumsum(sizes, dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            before = total[at - 1] if at else 0
            end = max(int(np.searchsorted(total, before + limit, "right")), at + 1)
            yield batch.slice(at, end - at)
            at = end


def groups(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of equal keys from batches that are sorted by the keys."""
    held: list[pa.RecordBatch] = []
    held_key = None
    for batch in batches:
        n = batch.num_rows
        if n == 0:
            continue
        change = np.zeros(n, bool)
        for k in keys:
            values = batch.column(k).to_numpy(zero_copy_only=False)
            change[1:] |= values[1:] != values[:-1]
        edges = [0, *np.flatnonzero(change).tolist(), n]
        for a, b in zip(edges, edges[1:]):
            key = tuple(batch.column(k)[a].as_py() for k in keys)
            if held and key != held_key:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            held_key = key
    if held:
        yield pa.Table.from_batches(held)


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def free_name(taken: Iterable[str], name: str) -> str:
    """``name``, with underscores added until no column (in any case) has it."""
    taken = {c.lower() for c in taken}
    while name.lower() in taken:
        name += "_"
    return name


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def word_count(text):
    """Words of a text as a column, by built-in functions; null has none."""
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))), F.lit(0)).cast("long")
