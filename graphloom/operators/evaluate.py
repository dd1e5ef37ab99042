"""Scoring of predictions against a gold table, and comparison of variants."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.text import ratio

UNMATCHED = "UNMATCHED"


def verdict(predicted: Column, expected: Column) -> Column:
    """TN/FP where nothing is expected, else FN, TP or FP. A wrong target counts as FP only."""
    none = predicted == UNMATCHED
    return (
        F.when(expected.isNull(), F.when(none, "TN").otherwise("FP"))
        .when(none, "FN")
        .when(predicted == expected, "TP")
        .otherwise("FP")
    )


def judge(predictions: DataFrame, gold: DataFrame, key: Sequence[str] = ("source_column",)) -> DataFrame:
    """Predictions with what the gold table expects and a verdict; a key it lacks expects no match.

    ``gold`` has the key columns and ``expected_uri``, one row per key.
    """
    found = predictions.join(gold.select(*key, "expected_uri", F.lit(True).alias("in_gold")), list(key), "left")
    return found.withColumns(
        {
            "verdict": verdict(F.col("target_uri"), F.col("expected_uri")),
            "expected": F.coalesce("expected_uri", F.lit(UNMATCHED)),
            "in_gold": F.coalesce("in_gold", F.lit(False)),
        }
    ).drop("expected_uri")


def confusion(judged: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    counts = [F.count_if(F.col("verdict") == v.upper()).alias(v) for v in ("tp", "fp", "fn", "tn")]
    return judged.groupBy(*by).agg(*counts) if by else judged.agg(*counts)


def rates(counts: DataFrame, digits: int = 4) -> DataFrame:
    """Precision, recall, F1 and specificity; 0 where a denominator is 0."""
    if "tn" not in counts.columns:
        counts = counts.withColumn("tn", F.lit(0).cast("bigint"))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    raw = counts.withColumns({"_p": ratio(tp, tp + fp), "_r": ratio(tp, tp + fn), "_s": ratio(tn, tn + fp)})
    f1 = ratio(2.0 * F.col("_p") * F.col("_r"), F.col("_p") + F.col("_r"))
    return raw.withColumns(
        {
            "precision": F.round("_p", digits),
            "recall": F.round("_r", digits),
            "f1": F.round(f1, digits),
            "specificity": F.round("_s", digits),
        }
    ).drop("_p", "_r", "_s")


def compute_metrics(predictions: DataFrame, gold: DataFrame, key: Sequence[str] = ("source_column",), by: Sequence[str] = ()) -> DataFrame:
    """Counts and rates of a prediction table, overall or per group, in one aggregate."""
    return rates(confusion(judge(predictions, gold, key), by))
