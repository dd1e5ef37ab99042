"""Delimited text and N-Triples that record their faults: what can be read, and beside it what cannot, with file and place.

Nothing of a file passes through the driver but the different headers of a folder. A record is a line here: cells with
line ends in them need :func:`graphloom.sources.tables.read_csv` with ``multi_line``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.rdf import parse_triple_line

_BAD = "_bad_record"


def file_lines(spark: SparkSession, path: str | list[str], fallback: str = "ISO-8859-1") -> DataFrame:
    """``file, block, line, value`` of all lines: where the split begins and which of its lines it is, from 0.

    A file with a line that is no UTF-8 is read in the fallback encoding as a whole; the files meet their verdict in a
    join, so their number does not matter.
    """
    raw = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("_id"), "value"
    )
    split = raw.groupBy("file", "block").agg(F.min("_id").alias("_first"), F.bool_and(F.is_valid_utf8("value")).alias("_ok"))
    files = split.groupBy("file").agg(F.bool_and("_ok").alias("_utf8"))
    known = split.drop("_ok").join(files, "file")
    text = F.when(F.col("_utf8"), F.col("value")).otherwise(F.decode(F.col("value").cast("binary"), fallback))
    return raw.join(known, ["file", "block"]).select("file", "block", (F.col("_id") - F.col("_first")).alias("line"), text.alias("value"))


def _cells(value: Column, columns: list[str], sep: str) -> Column:
    schema = ", ".join(f"`{c}` string" for c in [*columns, _BAD])
    options = {"sep": sep, "quote": '"', "escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": _BAD}
    return F.from_csv(value, schema, options)


def read_csv_recorded(spark: SparkSession, path: str | list[str], sep: str = ";", fallback: str = "ISO-8859-1") -> tuple[DataFrame, DataFrame]:
    """Rows of all files under ``path`` as text columns, and the lines that are no rows.

    Files may have different headers (other columns, another order): columns are matched by name, those that a file
    lacks are null. Faults are ``file, block, line, value, reason`` with the reasons ``cells`` (more or fewer than the
    file's header), ``quote`` (one without an end in its line) and ``header`` (a blank or repeated column name: the
    whole file is at fault).
    """
    lines = file_lines(spark, path, fallback)
    head = lines.where("block = 0 and line = 0").select("file", F.col("value").alias("_header"))
    headers = [r["_header"] for r in head.select("_header").distinct().orderBy("_header").collect()]
    body = lines.where("not (block = 0 and line = 0)").where(F.trim("value") != "").join(head, "file")
    rows = faults = None
    place = ["file", "block", "line", "value"]
    for header in headers:
        own = body.where(F.col("_header") == F.lit(header))
        columns = [c.strip().removeprefix("﻿") for c in _header_names(spark, header, sep)]
        if len(set(columns)) < len(columns) or not all(columns):
            bad = own.select(*place, F.lit("header").alias("reason"))
        else:
            odd = (F.length("value") - F.length(F.replace(F.col("value"), F.lit('"'), F.lit("")))) % 2 == 1
            read = own.withColumn("_c", _cells(F.col("value"), columns, sep))
            read = read.withColumn("reason", F.when(odd, "quote").when(F.col(f"_c.{_BAD}").isNotNull(), "cells"))
            good = read.where(F.col("reason").isNull()).select(*[F.col("_c").getField(c).alias(c) for c in columns])
            rows = good if rows is None else rows.unionByName(good, allowMissingColumns=True)
            bad = read.where(F.col("reason").isNotNull()).select(*place, "reason")
        faults = bad if faults is None else faults.unionByName(bad)
    if faults is None:
        raise ValueError(f"no header under {path}")
    if rows is None:
        raise ValueError(f"no usable header under {path}")
    return rows, faults


def _header_names(spark: SparkSession, header: str, sep: str) -> list[str]:
    """The cells of one header line, by Spark's own rules of quoting."""
    width = header.count(sep) + 1
    cells = _cells(F.lit(header), [f"c{i}" for i in range(width)], sep)
    row = spark.range(1).select(cells.alias("c")).first()["c"]
    given = header if row[_BAD] is None else row[_BAD]
    return [row[f"c{i}"] or "" for i in range(width) if row[_BAD] is None or row[f"c{i}"] is not None] or [given]


def read_ntriples_recorded(spark: SparkSession, path: str | list[str], distinct: bool = True) -> tuple[DataFrame, DataFrame]:
    """Triples as a set, and the lines that are none, with file and place."""
    lines = file_lines(spark, path).where(~F.col("value").rlike(r"^\s*(#.*)?$")).withColumn("_t", parse_triple_line(F.col("value")))
    triples = lines.where("_t is not null").select("_t.*")
    return triples.distinct() if distinct else triples, lines.where("_t is null").select("file", "block", "line", "value")
