"""Two differing tables of the same entities, and revenue per customer from transactions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.text import digest_number, seeded_digest


def entity_views(
    entities: DataFrame, in_left: Column, in_right: Column, left: Mapping[str, Column], right: Mapping[str, Column]
) -> tuple[DataFrame, DataFrame]:
    """Two projections of one entity table with their own columns, ids and formats.

    Membership is decided per row, so the overlap is exactly the rows where both conditions hold.
    """
    return (
        entities.where(in_left).select(*[c.alias(n) for n, c in left.items()]),
        entities.where(in_right).select(*[c.alias(n) for n, c in right.items()]),
    )


def customer_revenue(
    transactions: DataFrame, customer: str = "customer_id", quantity: str = "quantity", price: str = "price",
    country: str = "country", first_by: Sequence[str] = ("country",),
) -> DataFrame:
    """Revenue and country per customer, net returns left out.

    "First country" is the one of the smallest ``first_by``, so it does not depend on row order.
    """
    known = transactions.dropna(subset=[customer]).withColumn("_revenue", F.col(quantity) * F.col(price))
    return (
        known.groupBy(F.col(customer).cast("long").alias("customer_id"))
        .agg(F.sum("_revenue").alias("_sum"), F.min_by(country, F.struct(*first_by)).alias("country"))
        .where(F.col("_sum") > 0)
        .select("customer_id", F.round("_sum", 2).alias("revenue"), "country")
    )


def seeded_sample(df: DataFrame, n: int, key: Sequence[str], seed: int = 42) -> DataFrame:
    """``n`` rows without replacement, the same ones on every run. Each task keeps ``n`` at most."""
    return df.orderBy(seeded_digest(seed, *[F.col(k) for k in key]), *key).limit(n)


def shuffled_ids(df: DataFrame, key: Sequence[str], seed: int = 42, name: str = "seq", buckets: int = 4096) -> DataFrame:
    """Rows in seeded random order, numbered 1, 2, 3 ... without a gap.

    The order is a digest of ``key``, so its leading digits cut the table into even ranges. Rows are ranked
    inside a range, and the start of each range comes from the counts of the ranges before it: at most
    ``buckets`` numbers, whatever the table. No task sees the whole order.
    """
    from pyspark.sql import Window

    digest = seeded_digest(seed, *[F.col(k) for k in key])
    placed = df.withColumn("_d", digest).withColumn("_b", F.floor(digest_number(F.col("_d")) * F.lit(buckets) / F.lit(16**8)).cast("int"))
    counts = placed.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    starts = counts.select("_b", (F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("_b")) - F.col("_n")).alias("_start"))
    rank = F.row_number().over(Window.partitionBy("_b").orderBy("_d", *key))
    located = placed.withColumn("_r", rank).join(F.broadcast(starts), "_b")
    return located.withColumn(name, F.col("_start") + F.col("_r")).drop("_d", "_b", "_n", "_r", "_start")
