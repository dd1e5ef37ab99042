"""Exact name-similarity join inside blocks.

Input is already reduced to distinct (block, name) rows with a count, so copies of a record cost nothing
here. Ordinary blocks are joined on the block key and scored pair by pair. A block whose pair count is
above ``direct_pairs`` is cut into cells of bounded size instead: every cell is one task-sized group, an
upper bound on the shared bytes (one matrix product) discards most of the cell, only survivors are
scored, and only pairs at or above the lowest level leave the task. Both ways give the same rows.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.functions.names import (
    PREFIX_BYTES,
    byte_rows,
    jaro_winkler_similarity,
    length_can_reach,
    lowest_jaro,
    pair_scores,
)
from graphloom.plans.skew import grid, pieces, salted_lookup

DIRECT_PAIRS = 50_000
CELL_ROWS = 2_048
MAX_CELL_PARTITIONS = 20_000

_CLASSES, _DEPTH, _STRIP = 32, 4, 512


def distinct_names(people: DataFrame, block: Sequence[str], name: str) -> DataFrame:
    """One row per block and name, with its number of records ``n``."""
    return people.groupBy(*block, F.col(name).alias("name")).agg(F.count(F.lit(1)).alias("n"))


def name_blocks(left: DataFrame, right: DataFrame, block: Sequence[str]) -> DataFrame:
    """Per shared block: distinct names (``n_l``, ``n_r``) and records (``rows_l``, ``rows_r``)."""

    def side(df: DataFrame, s: str) -> DataFrame:
        return df.groupBy(*block).agg(
            F.count(F.lit(1)).alias(f"n_{s}"), F.sum("n").alias(f"rows_{s}")
        )

    return side(left, "l").join(side(right, "r"), list(block))


def level_of(same: Column, score: Column, thresholds: Sequence[float]) -> Column:
    """Top level for equal names, then one level per threshold, 0 below the lowest."""
    level = F.when(same, F.lit(len(thresholds) + 1))
    for k, t in enumerate(thresholds):
        level = level.when(score >= F.lit(float(t)), F.lit(len(thresholds) - k))
    return level.otherwise(F.lit(0))


def _class_of_byte() -> np.ndarray:
    table = 28 + (np.arange(256) & 3)
    table[97:123] = np.arange(26)
    table[32], table[0xC3] = 26, 27
    return table


def _byte_profile(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray):
    """Per text: one flag per (byte class, repeat up to _DEPTH), and the bytes beyond that depth."""
    row = np.repeat(np.arange(len(lengths)), lengths)
    at = np.repeat(starts - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths) + np.arange(len(row))
    cls = _class_of_byte()[flat[at]] if len(row) else np.zeros(0, int)
    counts = np.bincount(row * _CLASSES + cls, minlength=len(lengths) * _CLASSES).reshape(-1, _CLASSES)
    flags = (counts[:, :, None] > np.arange(_DEPTH)).reshape(len(lengths), -1).astype(np.float32)
    return flags, np.maximum(counts - _DEPTH, 0).sum(1).astype(np.float32)


def _first_bytes(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    cols = np.arange(PREFIX_BYTES)
    at = np.minimum(starts[:, None] + cols, len(flat) - 1)
    return np.ascontiguousarray(np.where(cols < lengths[:, None], flat[at].astype(np.int16), -1).T)


def cell_pairs(left: pa.Array, right: pa.Array, lowest: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row numbers and scores of all pairs of two name arrays that score at least ``lowest``."""
    a, b = byte_rows(left), byte_rows(right)
    (la, lb) = a[2], b[2]
    flags_a, over_a = _byte_profile(*a)
    flags_b, over_b = _byte_profile(*b)
    head_a, head_b = _first_bytes(*a), _first_bytes(*b)
    # m shared bytes give Jaro at most (m/n1 + m/n2 + 1) / 3
    need = np.array([3.0 * lowest_jaro(lowest, k) - 1.0 for k in range(PREFIX_BYTES + 1)]) - 1e-4
    inv_b = (1.0 / np.maximum(lb, 1)).astype(np.float32)
    found = []
    for lo in range(0, len(la), _STRIP):
        s = slice(lo, lo + _STRIP)
        shared = flags_a[s] @ flags_b.T
        if over_a[s].any() and over_b.any():
            shared += np.minimum(over_a[s, None], over_b)
        inv_a = (1.0 / np.maximum(la[s], 1)).astype(np.float32)
        bound = shared * (inv_a[:, None] + inv_b)
        i, j = np.divmod(np.flatnonzero(bound >= need.min()), len(lb))
        alike, prefix = True, np.zeros(len(i), np.int64)
        for k in range(PREFIX_BYTES):
            alike = alike & (head_a[k][i + lo] == head_b[k][j]) & (head_b[k][j] >= 0)
            prefix += alike
        keep = bound[i, j] >= need[prefix]
        i, j = i[keep] + lo, j[keep]
        score = pair_scores(a, b, i, j, lowest)
        keep = score >= lowest
        found.append((i[keep], j[keep], score[keep]))
    blank = [(np.array([x]), np.array([y]), np.ones(1)) for x in np.nonzero(la == 0)[0] for y in np.nonzero(lb == 0)[0]]
    found += blank  # two empty names are equal, though their score is 0
    if not found:
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0)
    return tuple(np.concatenate(x) for x in zip(*found))


def _cell_count(sizes: DataFrame, rows: int) -> int:
    cells = (pieces("n_l", rows) * pieces("n_r", rows)).cast("decimal(38,0)")
    return int(sizes.agg(F.coalesce(F.sum(cells), F.lit(0))).first()[0])


def _similar_in_cells(left: DataFrame, right: DataFrame, block: Sequence[str], lowest: float, partitions: int) -> DataFrame:
    fields = [f for f in left.schema.fields if f.name in block]
    schema = T.StructType(
        [
            *fields,
            T.StructField("name_l", T.StringType()),
            T.StructField("name_r", T.StringType()),
            T.StructField("n_l", T.LongType()),
            T.StructField("n_r", T.LongType()),
            T.StructField("score", T.DoubleType()),
        ]
    )

    def score_cell(l: pa.Table, r: pa.Table) -> pa.Table:
        l, r = l.combine_chunks(), r.combine_chunks()
        names = [t.column("name").combine_chunks() if t.num_rows else pa.array([], pa.string()) for t in (l, r)]
        i, j, score = cell_pairs(*names, lowest)
        out = {c: l.column(c).take(pa.array(i)) for c in block}
        out |= {"name_l": l.column("name").take(pa.array(i)), "name_r": r.column("name").take(pa.array(j))}
        out |= {"n_l": l.column("n").take(pa.array(i)), "n_r": r.column("n").take(pa.array(j))}
        return pa.table({**out, "score": pa.array(score, pa.float64())})

    keys = [*block, "_i", "_j"]
    # A cell is few bytes and much work: a fixed partition count keeps adaptive execution from merging cells.
    left, right = (df.repartition(partitions, *keys) for df in (left, right))
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(score_cell, schema)


def similar_names(
    left: DataFrame,
    right: DataFrame,
    block: Sequence[str],
    thresholds: Sequence[float],
    direct_pairs: int = DIRECT_PAIRS,
    cell_rows: int = CELL_ROWS,
    block_range: tuple[float, float] | None = None,
) -> DataFrame:
    """Pairs of distinct names of one block at level 1 or higher.

    ``left`` and ``right`` come from ``distinct_names`` without null names. ``block_range`` is the
    smallest and the largest pair count of a block; when unknown it is looked up with one small job.
    It decides which of the two ways the plan needs at all.
    """
    block = list(block)
    thresholds = sorted(thresholds, reverse=True)
    lowest = thresholds[-1]
    sizes = name_blocks(left, right, block)
    product = F.col("n_l").cast("decimal(19,0)") * F.col("n_r").cast("decimal(19,0)")
    if block_range is None:
        low, high = sizes.agg(F.min(product), F.max(product)).first()
        block_range = (float(low or 0), float(high or 0))
    parts = []
    large = sizes.where(product > direct_pairs)
    if block_range[0] <= direct_pairs:
        small_l, small_r = left, right
        if block_range[1] > direct_pairs:
            flag = large.select(*block, F.lit(True).alias("_large"))
            small_l, small_r = (
                salted_lookup(df, flag, block).where(F.col("_large").isNull()).drop("_large") for df in (left, right)
            )
        paired = small_l.select(*block, F.col("name").alias("name_l"), F.col("n").alias("n_l")).join(
            small_r.select(*block, F.col("name").alias("name_r"), F.col("n").alias("n_r")), block
        )
        possible = paired.where(length_can_reach(F.col("name_l"), F.col("name_r"), lowest))
        parts.append(possible.withColumn("score", jaro_winkler_similarity(F.col("name_l"), F.col("name_r"), lowest)))
    if block_range[1] > direct_pairs:
        cells = grid(left, right, block, large, cell_rows)
        partitions = min(2 * _cell_count(large, cell_rows) + 1, MAX_CELL_PARTITIONS)
        parts.append(_similar_in_cells(*cells, block, lowest, partitions))
    scored = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    same = F.col("name_l") == F.col("name_r")
    return scored.withColumn("level", level_of(same, F.col("score"), thresholds)).where("level > 0")
