"""Joins that stay even when one key holds a large share of the rows."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LOOKUP_SALTS = 16
# Pairs are few bytes in and much work: these many a task, whatever adaptive execution would merge by bytes.
PAIRS_PER_TASK = 1_000_000
COPIES_PER_TASK = 250_000
MAX_TASKS = 20_000


def salted_lookup(df: DataFrame, lookup: DataFrame, keys: Sequence[str], salts: int = LOOKUP_SALTS) -> DataFrame:
    """Left join of ``df`` to a small frame with one row per key.

    The rows of one key are spread over ``salts`` tasks and the looked-up row is repeated for each. When
    the lookup side turns out small, adaptive execution replaces the shuffle by a broadcast.
    """
    spread = df.withColumn("_salt", F.pmod(F.xxhash64(*df.columns), F.lit(salts)).cast("int"))
    copies = lookup.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return spread.join(copies, [*keys, "_salt"], "left").drop("_salt")


def tasks_for(work: float, each: int) -> int:
    """Tasks for ``work`` units; beyond ``MAX_TASKS`` each gets more."""
    return min(math.ceil(work / each), MAX_TASKS)


def spread_pairs(left: DataFrame, right: DataFrame, keys: Sequence[str], pairs: float) -> tuple[DataFrame, DataFrame]:
    """Both sides of a join on ``keys`` that gives ``pairs`` rows, dealt to as many tasks as these need."""
    tasks = tasks_for(pairs, PAIRS_PER_TASK)
    if tasks <= 1:
        return left, right
    return left.repartition(tasks, *keys), right.repartition(tasks, *keys)


def pieces(count: str, rows: int):
    """How many pieces of about ``rows`` rows a group of ``count`` rows is cut into."""
    return F.coalesce(F.ceil(F.col(count) / F.lit(rows)), F.lit(1)).cast("int")


def piece_of(columns: Sequence[str], n: str):
    return F.pmod(F.xxhash64(*columns), F.col(n)).cast("int")


def each_piece(n: str):
    return F.explode(F.sequence(F.lit(0), F.col(n) - 1))


def grid(
    left: DataFrame, right: DataFrame, keys: Sequence[str], sizes: DataFrame, rows: int
) -> tuple[DataFrame, DataFrame]:
    """Cut every key's rows into pieces and lay left pieces against right pieces.

    ``sizes`` has one row per key with ``n_l`` and ``n_r``. Both results carry ``_i`` and ``_j``; a left
    and a right row of one key share exactly one cell, and a cell holds about ``rows`` rows a side.
    Keys without a row in ``sizes`` are dropped: they have no partner. A row is copied once for each piece of the other
    side, so the rows are dealt to tasks by the number of copies first.
    """
    cut = sizes.select(*keys, pieces("n_l", rows).alias("_pl"), pieces("n_r", rows).alias("_pr"))
    copies = sizes.agg(
        *[F.sum(F.col(n).cast("double") * pieces(other, rows)).alias(n) for n, other in (("n_l", "n_r"), ("n_r", "n_l"))]
    ).first()

    def lay(df: DataFrame, n: str, own: str, other: str, mine: str, theirs: str) -> DataFrame:
        located = salted_lookup(df, cut, keys).where(F.col(own).isNotNull())
        tasks = tasks_for(copies[n] or 0, COPIES_PER_TASK)
        if tasks > 1:
            located = located.repartition(tasks, *df.columns)
        # the copies are made last, so that a row is hashed once; no further name, which could be one of its columns
        return located.select(*df.columns, piece_of(df.columns, own).alias(mine), other).select(
            *df.columns, mine, each_piece(other).alias(theirs)
        )

    return lay(left, "n_l", "_pl", "_pr", "_i", "_j"), lay(right, "n_r", "_pr", "_pl", "_j", "_i")
