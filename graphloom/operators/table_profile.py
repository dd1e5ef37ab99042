"""Profiles of whole tables, whatever their column types, and profiles that are kept per part and merged.

Types are ``numeric``, ``text``, ``date`` (dates and times), ``boolean`` and ``other`` (arrays, maps, structs, binary). Values of
``other`` are compared by their text form. Nothing is cut off: every column and every row takes part.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.functions.text import ratio

# 2 ** LG_K registers: a relative error of about 1.6 %.
LG_K = 12


def column_type(kind: T.DataType) -> str:
    if isinstance(kind, T.NumericType):
        return "numeric"
    if isinstance(kind, T.BooleanType):
        return "boolean"
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "date"
    return "text" if isinstance(kind, (T.StringType, T.CharType, T.VarcharType)) else "other"


def _text(c: Column, kind: T.DataType) -> Column:
    """A value as text; containers as JSON, bytes as base64."""
    if isinstance(kind, T.BinaryType):
        return F.base64(c)
    return F.to_json(c) if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)) else c.cast("string")


def _digest(c: Column, kind: T.DataType) -> Column:
    """64 bits that stand for a value; null for null."""
    plain = _text(c, kind) if column_type(kind) == "other" else c
    return F.when(c.isNotNull(), F.xxhash64(plain))


def _measures(c: Column, kind: T.DataType) -> dict[str, Column]:
    """Aggregates of one column; those that its type lacks are null."""
    type_, none = column_type(kind), F.lit(None)
    number = c.cast("double") if type_ == "numeric" else none.cast("double")
    length = F.length(c).cast("long") if type_ == "text" else none.cast("long")
    ordered = type_ in ("numeric", "date", "text")
    return {
        "rows": F.count(F.lit(1)), "missing": F.count_if(c.isNull()),
        "min": _text(F.min(c), kind) if ordered else none.cast("string"), "max": _text(F.max(c), kind) if ordered else none.cast("string"),
        "total": F.sum(number), "zeros": F.count_if(number == 0) if type_ == "numeric" else none.cast("long"),
        "trues": F.count_if(c) if type_ == "boolean" else none.cast("long"),
        "blank": F.count_if(length == 0) if type_ == "text" else none.cast("long"),
        "min_length": F.min(length), "max_length": F.max(length),
    }


def _long(aggregated: DataFrame, fields: Sequence[T.StructField], names: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """One row with ``<measure>_<i>`` for each column (and each group of ``keep``) as one row a column."""
    rows = [
        F.struct(F.lit(i).alias("ord"), F.lit(f.name).alias("column"), F.lit(column_type(f.dataType)).alias("type"), *[F.col(f"{m}_{i}").alias(m) for m in names])
        for i, f in enumerate(fields)
    ]
    return aggregated.select(*keep, F.inline(F.array(*rows)))


def table_profile(df: DataFrame) -> DataFrame:
    """One row a column: type, rows, missing, distinct and unique values, range, mean, zeros, true values, text lengths.

    One wide aggregate for the measures. Distinct and unique values come from counts of 64-bit digests: partial
    counts are combined in each task, and what is shuffled is two numbers a distinct value of a task, never a text.
    """
    fields = df.schema.fields
    columns = [F.col(f"`{f.name}`") for f in fields]
    measures = [_measures(c, f.dataType) for c, f in zip(columns, fields)]
    wide = df.agg(*[m.alias(f"{name}_{i}") for i, own in enumerate(measures) for name, m in own.items()])
    table = _long(wide, fields, list(measures[0]))
    cells = df.select(F.inline(F.array(*[F.struct(F.lit(i).alias("ord"), _digest(c, f.dataType).alias("v")) for i, (c, f) in enumerate(zip(columns, fields))])))
    counted = cells.groupBy("ord", "v").agg(F.count(F.lit(1)).alias("n")).where("v is not null")
    values = counted.groupBy("ord").agg(F.count(F.lit(1)).alias("distinct"), F.count_if(F.col("n") == 1).alias("unique"))
    filled = F.col("rows") - F.col("missing")
    return table.join(F.broadcast(values), "ord", "left").select(  # a row for each column
        "ord", "column", "type", "rows", "missing", F.coalesce("distinct", F.lit(0)).alias("distinct"), F.coalesce("unique", F.lit(0)).alias("unique"),
        "min", "max", F.when(F.col("type") == "numeric", ratio(F.col("total"), filled)).alias("mean"), "zeros", "trues", "blank", "min_length", "max_length",
    )


MERGED = ("rows", "missing", "total", "zeros", "trues", "blank", "min_length", "max_length")


def table_sketches(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """A profile for each part of a table (by day, by source, ...), in a form that merges.

    One row a part and column, with a sketch of its distinct values: kept next to the data, it profiles a table that
    grows by parts without reading the old ones again.
    """
    fields = [f for f in df.schema.fields if f.name not in by]
    columns = [F.col(f"`{f.name}`") for f in fields]
    aggregates = []
    for i, (c, f) in enumerate(zip(columns, fields)):
        own = {k: m for k, m in _measures(c, f.dataType).items() if k in MERGED}
        own["sketch"] = F.hll_sketch_agg(_digest(c, f.dataType), F.lit(LG_K))
        aggregates += [m.alias(f"{name}_{i}") for name, m in own.items()]
    return _long(df.groupBy(*by).agg(*aggregates), fields, [*MERGED, "sketch"], by)


def merge_sketches(parts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Profiles of several parts as one (for each group of ``by``); distinct values are estimated from the merged sketch."""
    added = [F.sum(c).alias(c) for c in MERGED if not c.endswith("_length")]
    return parts.groupBy(*by, "ord", "column", "type").agg(
        *added, F.min("min_length").alias("min_length"), F.max("max_length").alias("max_length"), F.hll_union_agg("sketch").alias("sketch"),
    ).withColumn("distinct", F.hll_sketch_estimate("sketch"))
