"""Row and column quality of a table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def drop_null_rows(df: DataFrame, subset: Sequence[str], observation: Observation | None = None) -> DataFrame:
    """Rows without a null in ``subset``.

    With an observation the scan that uses the result also counts ``rows_in`` and ``rows_dropped``, so the
    count needs no job of its own.
    """
    if observation is not None:
        whole = F.lit(True)
        for c in subset:
            whole = whole & F.col(c).isNotNull()
        df = df.observe(observation, F.count(F.lit(1)).alias("rows_in"), F.count_if(~whole).alias("rows_dropped"))
    return df.dropna(subset=list(subset))


def row_digest(columns: Sequence[str]) -> Column:
    """SHA-256 over all values of a row, nulls equal to each other and unlike any text.

    Grouping on it moves 64 characters a row instead of the row. Each value carries its length, so
    no two different rows give the same input.
    """
    parts = []
    for c in columns:
        text = F.col(c).cast("string")
        parts.append(F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.sha2(F.concat_ws(",", *parts).cast("binary"), 256)


def duplicate_count(df: DataFrame) -> DataFrame:
    """Rows beyond the first of each group of identical rows."""
    groups = df.select(row_digest(df.columns).alias("_d")).groupBy("_d").agg(F.count(F.lit(1)).alias("n"))
    return groups.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_rows"))


def _null_counts(df: DataFrame) -> list[Column]:
    return [F.count_if(F.col(c).isNull()).alias(f"_n{i}") for i, c in enumerate(df.columns)]


def quality_report(df: DataFrame, source: str) -> DataFrame:
    """One row: rows, columns, share of nulls in percent, duplicate rows. One scan, one narrow shuffle."""
    width = len(df.columns)
    nulls = sum((F.col(c).isNull().cast("int") for c in df.columns[1:]), F.col(df.columns[0]).isNull().cast("int"))
    groups = df.select(row_digest(df.columns).alias("_d"), nulls.alias("_n")).groupBy("_d").agg(
        F.count(F.lit(1)).alias("n"), F.sum("_n").alias("nulls")
    )
    total = groups.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.coalesce(F.sum("nulls"), F.lit(0)).alias("nulls"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_rows"),
    )
    return total.select(
        F.lit(source).alias("source"), "rows", F.lit(width).alias("columns"),
        F.coalesce(F.round(F.try_divide(F.col("nulls") * 100.0, F.col("rows") * width), 2), F.lit(0.0)).cast("double").alias("null_pct"),
        "duplicate_rows", F.lit(",".join(df.columns)).alias("column_names"),
    )


def null_rates(df: DataFrame, keep_rows: bool = False) -> DataFrame:
    """One row per column: null count and rate. One narrow aggregate, turned to rows at the end."""
    counted = df.agg(F.count(F.lit(1)).alias("_rows"), *_null_counts(df))
    rows = F.array(
        *[
            F.struct(
                F.lit(i).alias("ord"), F.lit(c).alias("column"), F.col(f"_n{i}").alias("nulls"),
                F.coalesce(F.try_divide(F.col(f"_n{i}").cast("double"), F.col("_rows")), F.lit(0.0)).alias("null_rate"),
            )
            for i, c in enumerate(df.columns)
        ]
    )
    return counted.select(*(["_rows"] if keep_rows else []), F.inline(rows))


def high_null_columns(df: DataFrame, above: float = 0.20) -> DataFrame:
    return null_rates(df).where(F.col("null_rate") > above)


def schema_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Every column name of either table: where it occurs and how many values it has there."""

    def side(df: DataFrame, name: str) -> DataFrame:
        filled = F.col("_rows") - F.col("nulls")
        return null_rates(df, keep_rows=True).select("column", F.lit(True).alias(f"in_{name}"), filled.alias(f"values_{name}"))

    both = side(left, "left").join(side(right, "right"), "column", "full_outer")
    return both.select(
        "column", *[F.coalesce(f"in_{s}", F.lit(False)).alias(f"in_{s}") for s in ("left", "right")],
        *[F.coalesce(f"values_{s}", F.lit(0)).alias(f"values_{s}") for s in ("left", "right")],
    )
