"""CSV whose quoted cells may hold line ends, read in splits: many tasks for one file.

Spark's own multi-line mode reads a file in one task, as only the quotes before a line tell whether it begins a record.
Here each split counts its quotes (a narrow aggregate), a running sum over the splits of a file tells which of them
begin inside a cell, and each task then cuts its own lines into records. What is open at the edge of a split goes to its
neighbours as a fragment: two a split at most, so only these and the split table are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_RECORD = "file string, block long, place long, begins boolean, whole boolean, record string"
_BAD = "_bad_record"


def _cut(lines: pa.Array, inside: bool) -> tuple[pa.Array, bool]:
    """Lines joined to records (the first of which began before if ``inside``), and whether the last one is still open."""
    odd = pc.fill_null(pc.count_substring(lines, '"'), 0).to_numpy(zero_copy_only=False) % 2
    state = (np.cumsum(odd) + int(inside)) % 2
    before = np.concatenate([[int(inside)], state[:-1]])
    starts = np.flatnonzero(before == 0)
    if not len(starts) or starts[0]:
        starts = np.concatenate([[0], starts])
    lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(lines)), pa.int32()), lines)
    return pc.binary_join(lists, "\n"), bool(state[-1])


def records(spark: SparkSession, path: str | list[str], encoding: str = "UTF-8") -> DataFrame:
    """``file, block, place, record``: the records of all files, by the split in which each begins and its place there.

    Line ends within a record are ``\\n`` as in the file (a ``\\r`` before it stays); blank records are left out. A quote
    without an end takes the rest of its file, as in any CSV reader. ``encoding`` must keep ASCII bytes as they are.
    """
    raw = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"), "value"
    )
    if encoding.upper() != "UTF-8":
        raw = raw.withColumn("value", F.decode(F.col("value").cast("binary"), encoding))
    quotes = F.length("value") - F.length(F.replace(F.col("value"), F.lit('"'), F.lit("")))
    splits = raw.groupBy("file", "block").agg(F.sum(quotes).alias("n"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select("file", "block", (F.coalesce(F.sum("n").over(earlier), F.lit(0)) % 2 == 1).alias("inside"))
    # lines of one split lie in one task, whichever join Spark takes
    placed = raw.join(splits, ["file", "block"]).sortWithinPartitions("file", "block", "line")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: tuple | None = None
        held: list[pa.Array] = []  # lines of a record that the last batch left open
        inside, begun_before, place = False, False, 0

        def rows(texts: pa.Array, first_before: bool, last_open: bool) -> pa.RecordBatch:
            nonlocal place
            n = len(texts)
            begins, whole = np.ones(n, bool), np.ones(n, bool)
            begins[0] = whole[0] = not first_before
            if last_open:
                whole[-1] = False
            columns = [pa.array([at[0]] * n), pa.array([at[1]] * n, pa.int64()), pa.array(np.arange(place, place + n)), pa.array(begins), pa.array(whole), texts]
            place += n
            return pa.RecordBatch.from_arrays(columns, ["file", "block", "place", "begins", "whole", "record"])

        def rest() -> Iterator[pa.RecordBatch]:
            """What is open at the end of a split."""
            if held:
                lists = pa.ListArray.from_arrays(pa.array([0, sum(map(len, held))], pa.int32()), pa.concat_arrays(held))
                yield rows(pc.binary_join(lists, "\n"), begun_before, True)
                held.clear()

        for batch in batches:
            if not batch.num_rows:
                continue
            file, block = batch.column("file"), batch.column("block").to_numpy()
            new = np.ones(len(block), bool)
            new[1:] = (block[1:] != block[:-1]) | pc.not_equal(file[1:], file[:-1]).to_numpy(zero_copy_only=False)
            edges = [*np.flatnonzero(new).tolist(), len(block)]
            for x, y in zip(edges, edges[1:]):
                if at != (file[x].as_py(), int(block[x])):
                    yield from rest()
                    at, place = (file[x].as_py(), int(block[x])), 0
                    inside = begun_before = batch.column("inside")[x].as_py()
                lines = batch.column("value").slice(x, y - x)
                texts, still = _cut(lines, inside or bool(held))
                if held:  # the first piece ends, or goes on with, what is held
                    held.append(pa.array([texts[0].as_py()], texts.type))
                    if len(texts) == 1 and still:
                        continue
                    lists = pa.ListArray.from_arrays(pa.array([0, len(held)], pa.int32()), pa.concat_arrays(held))
                    yield rows(pc.binary_join(lists, "\n"), begun_before, False)
                    held.clear()
                    texts, begun_before = texts[1:], False
                if still:
                    held.append(texts[-1:])
                    texts = texts[:-1]
                if len(texts):
                    yield rows(texts, begun_before, False)
                    begun_before = False
                inside = False
        yield from rest()

    pieces = placed.select("file", "block", "inside", "value").mapInArrow(cut, _RECORD)
    order = Window.partitionBy("file").orderBy("block", "place")
    parts = pieces.where("not whole").withColumn("of", F.sum(F.col("begins").cast("int")).over(order))
    joined = parts.groupBy("file", "of").agg(F.sort_array(F.collect_list(F.struct("block", "place", "record"))).alias("p")).select(
        "file", F.col("p")[0]["block"].alias("block"), F.col("p")[0]["place"].alias("place"), F.array_join(F.col("p.record"), "\n").alias("record")
    )
    every = pieces.where("whole").select("file", "block", "place", "record").union(joined)
    return every.withColumn("record", F.regexp_replace("record", "\r$", "")).where(F.trim("record") != "")


def read_csv_split(spark: SparkSession, path: str | list[str], sep: str = ";", encoding: str = "UTF-8") -> DataFrame:
    """Text columns of CSV files of one header, with line ends in quoted cells, read by as many tasks as there are splits.

    A file with another header, and a record with more or fewer cells than the header, is an error when it is read.
    """
    found = records(spark, path, encoding)
    first = found.where("block = 0 and place = 0").select(F.regexp_replace("record", "^﻿", "").alias("h")).agg(F.min("h").alias("h")).first()["h"]
    if first is None:
        raise ValueError(f"no header under {path}")
    options = {"sep": sep, "quote": '"', "escape": '"', "mode": "PERMISSIVE", "multiLine": "true", "columnNameOfCorruptRecord": _BAD}
    width = first.count(sep) + 1
    names = spark.range(1).select(F.from_csv(F.lit(first), ", ".join(f"c{i} string" for i in range(width)), {k: v for k, v in options.items() if k != "columnNameOfCorruptRecord"}).alias("c")).first()["c"]
    columns = [c.strip() for c in names if c is not None]
    if len(set(map(str.lower, columns))) < len(columns):
        raise ValueError(f"repeated column names under {path}: {columns}")
    head = (F.col("block") == 0) & (F.col("place") == 0)
    same = F.regexp_replace("record", "^﻿", "") == F.lit(first)
    body = found.where(F.when(head, F.when(same, False).otherwise(F.raise_error(F.concat(F.lit("another header in "), F.col("file"))))).otherwise(True))
    schema = ", ".join(f"`{c}` string" for c in [*columns, _BAD])
    cells = body.select("file", F.from_csv("record", schema, options).alias("c"))
    fault = F.concat(F.lit("a record of another width in "), F.col("file"), F.lit(": "), F.col(f"c.{_BAD}"))
    value = F.when(F.col(f"c.{_BAD}").isNotNull(), F.raise_error(fault)).otherwise(F.col("c"))
    return cells.select(value.alias("c")).select(*[F.col("c").getField(c).alias(c) for c in columns])
