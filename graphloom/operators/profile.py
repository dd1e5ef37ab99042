"""Column profiles as tables."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.functions.text import ratio, seeded_digest

# The quantiles of a profile.
QUANTILES = {"p05": 0.05, "p25": 0.25, "median": 0.5, "p75": 0.75, "p95": 0.95}
# The quantile sketch is off by at most one rank in this many rows.
QUANTILE_ACCURACY = 10_000
# A coarser sketch is enough to bracket an exact quantile, and takes half the time.
SELECT_ACCURACY = 1_000
# Values that one aggregate may gather to find an order statistic among them.
BOUNDED = 5_000
# Leading hex digits of a digest by which samples are cut before anything is ordered.
PREFIX = 3


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def _rows_per_column(aggregated: DataFrame, columns: Sequence[str], fields: dict[str, Column]) -> DataFrame:
    """A single wide row with ``<field>_<i>`` values as one row per column."""
    rows = [
        F.struct(F.lit(c).alias("column"), *[F.col(f"{name}_{i}").alias(name) for name in fields])
        for i, c in enumerate(columns)
    ]
    return aggregated.select(F.inline(F.array(*rows)))


class _Search:
    """One order statistic: an open interval that holds it, and how many values lie below the interval."""

    def __init__(self, column: str, q: float, n: int):
        self.column, self.q, self.n = column, q, n
        self.rank = max(math.ceil(q * n), 1)
        self.low = self.high = None  # not included; None: no end
        self.below, self.inside = 0, n
        self.value: float | None = None

    def within(self, c: Column) -> Column:
        out = c.isNotNull()
        if self.low is not None:
            out = out & (c > F.lit(self.low))
        return out if self.high is None else out & (c < F.lit(self.high))

    def ends(self, margin: float) -> list[float]:
        at = (self.rank - self.below) / self.inside
        return [max(at - margin, 0.0), min(at + margin, 1.0)]

    def narrow(self, low: float, high: float, counts: Sequence[int]) -> None:
        """``counts``: values below ``low``, up to it, below ``high``, up to it."""
        edges = [(None, self.low), (counts[0], low), (counts[1], low), (counts[2], high), (counts[3], high)]
        if counts[0] < self.rank <= counts[1]:
            self.value = low
        elif counts[2] < self.rank <= counts[3]:
            self.value = high
        elif self.rank <= counts[0]:
            self.high, self.inside = edges[1][1], counts[0] - self.below
        elif self.rank <= counts[2]:
            self.low, self.high, self.below, self.inside = low, high, counts[1], counts[2] - counts[1]
        else:
            self.low, self.inside, self.below = high, self.below + self.inside - counts[3], counts[3]


def _sketch(c: Column, ends: Sequence[float], accuracy: int) -> Column:
    return F.percentile_approx(c, F.array(*map(F.lit, ends)), F.lit(accuracy))


def _select(df: DataFrame, searches: list[_Search], accuracy: int, brackets: dict | None = None) -> None:
    """Give each search its value. Nothing is sorted or shuffled but counters, and at most ``BOUNDED`` values a search.

    A round narrows every open interval to what lies between two values of a sketch, a share of about
    ``6 / accuracy`` of its rows, by counting; both ends are excluded or found, so a round always gains.
    When few values are left inside, they are put in order by the aggregate that gathers them.
    """
    value = lambda s: F.col(s.column).cast("double")
    margin = 3.0 / accuracy
    while True:
        wide = [s for s in searches if s.value is None and s.inside > BOUNDED]
        if not wide:
            break
        if brackets is None:
            found = df.agg(*[_sketch(F.when(s.within(value(s)), value(s)), s.ends(margin), accuracy).alias(f"e{i}") for i, s in enumerate(wide)]).first()
            brackets = {(s.column, s.q): found[f"e{i}"] for i, s in enumerate(wide)}
        counts = df.agg(
            *[F.count_if(test).alias(f"c{i}_{k}") for i, s in enumerate(wide) for lo, hi in [brackets[s.column, s.q]]
              for k, test in enumerate((value(s) < lo, value(s) <= lo, value(s) < hi, value(s) <= hi))]
        ).first()
        for i, s in enumerate(wide):
            s.narrow(*brackets[s.column, s.q], [counts[f"c{i}_{k}"] for k in range(4)])
        brackets = None
    few = [s for s in searches if s.value is None]
    if few:
        ordered = [F.element_at(F.sort_array(F.collect_list(F.when(s.within(value(s)), value(s)))), s.rank - s.below).alias(f"v{i}") for i, s in enumerate(few)]
        row = df.agg(*ordered).first()
        for i, s in enumerate(few):
            s.value = row[f"v{i}"]


def exact_quantiles(df: DataFrame, columns: Sequence[str], probabilities: Sequence[float], accuracy: int = SELECT_ACCURACY) -> DataFrame:
    """``column, q, value``: the smallest value that at least ``q`` of the column's values do not exceed."""
    columns = list(columns)
    n = df.agg(*[F.count(c).alias(f"n{i}") for i, c in enumerate(columns)]).first()
    searches = [_Search(c, q, n[f"n{i}"]) for i, c in enumerate(columns) for q in probabilities if n[f"n{i}"]]
    _select(df, searches, accuracy)
    return df.sparkSession.createDataFrame([(s.column, s.q, s.value) for s in searches], "column string, q double, value double")


def numeric_profile(
    df: DataFrame, columns: Sequence[str] | None = None, exact: bool = True, accuracy: int | None = None
) -> DataFrame:
    """Statistics of numeric columns: one scan and one aggregate for all columns, no shuffle of values.

    Skewness and kurtosis carry the sample correction; kurtosis is excess. Exact quantiles take two more scans on most
    tables (:func:`exact_quantiles`); with ``exact`` off they come from the sketch of the first.
    """
    columns = list(columns or numeric_columns(df))
    accuracy = accuracy or (SELECT_ACCURACY if exact else QUANTILE_ACCURACY)
    if not columns:
        raise ValueError("the table has no numeric column to profile")

    def measures(name: str) -> dict[str, Column]:
        c = F.col(name).cast("double")
        quantiles = F.percentile_approx(c, F.array(*[F.lit(q) for q in QUANTILES.values()]), F.lit(accuracy))
        return {
            "count": F.count(c), "missing": F.count_if(F.col(name).isNull()), "min": F.min(c), "max": F.max(c),
            "mean": F.avg(c), "variance": F.var_samp(c), "sum": F.sum(c),
            "zeros": F.count_if(c == 0), "negatives": F.count_if(c < 0), "_g1": F.skewness(c), "_g2": F.kurtosis(c),
            **({} if exact else {"_q": quantiles}),
        }

    fields = measures(columns[0])
    aggregates = [m.alias(f"{name}_{i}") for i, c in enumerate(columns) for name, m in measures(c).items()]
    quantiles = list(QUANTILES.values())
    if exact:
        # the first brackets of the order statistics come from the same scan
        ends = [p for q in quantiles for p in (max(q - 3.0 / accuracy, 0.0), min(q + 3.0 / accuracy, 1.0))]
        sketches = [_sketch(F.col(c).cast("double"), ends, accuracy).alias(f"_e_{i}") for i, c in enumerate(columns)]
        scanned = df.agg(*aggregates, *sketches)
        row, schema = scanned.first(), scanned.schema
        aggregated = df.sparkSession.createDataFrame([row], schema)
    else:
        aggregated = df.agg(*aggregates)
    n = F.col("count").cast("double")
    skew = F.when(n > 2, F.sqrt(n * (n - 1)) / (n - 2) * F.col("_g1"))
    kurt = F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.col("_g2") + 6))
    table = _rows_per_column(aggregated, columns, fields).select(
        "*", F.sqrt("variance").alias("std"), skew.alias("skewness"), kurt.alias("kurtosis"), (F.col("max") - F.col("min")).alias("range"),
    ).drop("_g1", "_g2")
    if not exact:
        return table.select("*", *[F.try_element_at("_q", F.lit(i + 1)).alias(q) for i, q in enumerate(QUANTILES)]).drop("_q")
    searches = {(c, q): _Search(c, q, row[f"count_{i}"]) for i, c in enumerate(columns) for q in quantiles if row[f"count_{i}"]}
    brackets = {(c, q): row[f"_e_{i}"][2 * k : 2 * k + 2] for i, c in enumerate(columns) for k, q in enumerate(quantiles) if row[f"count_{i}"]}
    _select(df, list(searches.values()), accuracy, brackets)
    values = [(c, *[searches[c, q].value if (c, q) in searches else None for q in quantiles]) for c in columns]
    wide = df.sparkSession.createDataFrame(values, "column string, " + ", ".join(f"{q} double" for q in QUANTILES))
    return table.join(F.broadcast(wide), "column", "left")


def long_values(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """One row per cell: the kept columns, ``column`` and ``value`` as text."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])
    return df.select(*keep, F.inline(cells))


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows per column and value. A value that fills a third of the table is counted before the shuffle."""
    return long_values(df, columns).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


def categorical_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count, missing, distinct and unique values and text lengths per column, from the value counts."""
    value, n = F.col("value"), F.col("n")
    length = F.length(value)
    return (
        value_counts(df, columns)
        .groupBy("column")
        .agg(
            F.coalesce(F.sum(F.when(value.isNotNull(), n)), F.lit(0)).alias("count"),
            F.coalesce(F.sum(F.when(value.isNull(), n)), F.lit(0)).alias("missing"),
            F.count(value).alias("distinct"),
            F.count_if(value.isNotNull() & (n == 1)).alias("unique"),
            F.min(length).alias("min_length"),
            F.max(length).alias("max_length"),
            F.sum(length * n).alias("_chars"),
        )
        .withColumn("mean_length", ratio(F.col("_chars"), F.col("count")))
        .drop("_chars")
    )


def approximate_distinct(df: DataFrame, columns: Sequence[str], rsd: float = 0.02) -> DataFrame:
    """Distinct values per column from fixed-size sketches: no shuffle of values."""
    aggregated = df.agg(*[F.approx_count_distinct(c, rsd).alias(f"distinct_{i}") for i, c in enumerate(columns)])
    return _rows_per_column(aggregated, list(columns), {"distinct": F.lit(0)})


def top_values(df: DataFrame, columns: Sequence[str], k: int = 5) -> DataFrame:
    """The ``k`` most frequent values per column; each task keeps ``k`` of a column before the shuffle."""
    counts = value_counts(df, columns).where("value is not null")
    rank = F.row_number().over(Window.partitionBy("column").orderBy(F.desc("n"), "value"))
    return counts.withColumn("rank", rank).where(F.col("rank") <= k).select("column", "rank", "value", "n")


def histogram(df: DataFrame, columns: Sequence[str], bins: int = 10) -> DataFrame:
    """Equal-width bins. Two scans: the ranges, then counts that are combined before the shuffle."""
    columns = list(columns)
    limits = df.agg(*[f(F.col(c).cast("double")).alias(f"{a}{i}") for i, c in enumerate(columns) for a, f in (("lo", F.min), ("hi", F.max))]).first()
    cells = []
    for i, c in enumerate(columns):
        lo, hi = limits[f"lo{i}"], limits[f"hi{i}"]
        if lo is None:
            continue
        width = (hi - lo) / bins or 1.0
        x = F.col(c).cast("double")
        at = F.least(F.floor((x - F.lit(lo)) / F.lit(width)), F.lit(bins - 1)).cast("int")
        cells.append(F.struct(F.lit(c).alias("column"), at.alias("bin"), F.lit(lo).alias("_lo"), F.lit(width).alias("_w")))
    if not cells:
        return df.sparkSession.createDataFrame([], "column string, bin int, low double, high double, n bigint")
    long = df.select(F.inline(F.array(*cells))).where("bin is not null")
    counted = long.groupBy("column", "bin", "_lo", "_w").agg(F.count(F.lit(1)).alias("n"))
    return counted.select(
        "column", "bin", (F.col("_lo") + F.col("bin") * F.col("_w")).alias("low"),
        (F.col("_lo") + (F.col("bin") + 1) * F.col("_w")).alias("high"), "n",
    )


def column_samples(
    df: DataFrame, columns: Sequence[str], row_key: Sequence[str], k: int = 3, seed: int = 42, by: Sequence[str] = (),
    keep_empty: bool = False,
) -> DataFrame:
    """Up to ``k`` non-null values per column (and per ``by`` group), the same on every run.

    The order is a digest of seed, column, value and row key. Cells are first counted by the leading digits of their
    digest; the counts, combined before the shuffle, tell beyond which digits no cell can be among the first
    ``k``, and only cells up to there are ordered: about one in ``16 ** PREFIX`` and k. With ``keep_empty`` a column
    without values is kept with null values.
    """
    cells = long_values(df, columns, [*by, *row_key])
    if not keep_empty:
        cells = cells.where("value is not null")
    order = seeded_digest(seed, F.col("column"), F.col("value"), *[F.col(c) for c in row_key])
    group = [*by, "column"]
    # cells without a value come last; "g" is behind every hex digit
    marked = cells.withColumn("_o", order).withColumn("_p", F.when(F.col("value").isNull(), F.lit("g")).otherwise(F.substring("_o", 1, PREFIX)))
    counts = marked.groupBy(*group, "_p").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*group).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cut = counts.withColumn("_b", before).where(F.col("_b") < k).groupBy(*group).agg(F.max("_p").alias("_cut"))
    if not by:
        cut = F.broadcast(cut)  # a row for each column
    first = marked.alias("m").join(cut.alias("c"), [F.col(f"m.{c}").eqNullSafe(F.col(f"c.{c}")) for c in group]).where("_p <= _cut").select("m.*")
    window = Window.partitionBy(*group).orderBy(F.col("value").isNull(), "_o", "value")
    return first.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= k).select(*group, "rank", "value")
