"""Whole-table profiles, merged sketches, order statistics by narrowing and samples behind a cut."""

import datetime
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.operators import profile as P
from graphloom.operators.table_profile import merge_sketches, table_profile, table_sketches


@pytest.fixture(scope="module")
def odd(spark):
    day = datetime.date
    rows = [
        (1, "é", True, day(2020, 1, 2), [1, 2], 0.0, None, "x"), (1, "", False, day(2019, 5, 1), [1, 2], -2.5, None, "x"),
        (None, None, None, None, None, None, None, "y"), (3, "éé", True, day(2020, 1, 2), [], 0.0, None, "y"), (3, "b" * 500, None, None, [None], 7.0, None, None),
    ]
    return spark.createDataFrame(rows, "`a.b` int, t string, f boolean, d date, l array<int>, x double, none string, part string")


def test_every_type_of_column(odd):
    got = {r["column"]: r for r in table_profile(odd).collect()}
    assert [got[c]["type"] for c in odd.columns] == ["numeric", "text", "boolean", "date", "other", "numeric", "text", "text"]
    assert [(got[c]["missing"], got[c]["distinct"], got[c]["unique"]) for c in odd.columns] == [
        (1, 2, 0), (1, 4, 4), (2, 2, 1), (2, 2, 1), (1, 3, 2), (1, 3, 2), (5, 0, 0), (1, 2, 0)]
    assert (got["a.b"]["min"], got["a.b"]["max"], got["a.b"]["mean"]) == ("1", "3", 2.0)
    assert (got["t"]["blank"], got["t"]["min_length"], got["t"]["max_length"]) == (1, 0, 500)
    assert (got["f"]["trues"], got["f"]["min"], got["x"]["zeros"], got["d"]["min"], got["d"]["max"]) == (2, None, 2, "2019-05-01", "2020-01-02")
    assert got["none"]["max_length"] is None and got["l"]["min"] is None
    empty = table_profile(odd.where("1 = 0")).collect()
    assert len(empty) == 8 and {(r["rows"], r["missing"], r["distinct"]) for r in empty} == {(0, 0, 0)}


def test_texts_are_not_shuffled(odd):
    """What the counts of distinct values shuffle is a column number and a digest."""
    plan = table_profile(odd)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "hashpartitioning(ord" in plan


def test_sketches_merge(spark):
    df = spark.range(40_000).select(F.col("id"), (F.col("id") % 700).cast("string").alias("t"), (F.col("id") % 9).alias("part"), F.when(F.col("id") % 3 > 0, F.col("id") / 7).alias("x"))
    parts = table_sketches(df, ["part"])
    assert parts.count() == 27
    first, second = parts.where("part < 4"), parts.where("part >= 4")
    together = merge_sketches(first.unionByName(second)).orderBy("ord").collect()
    exact = {r["column"]: r for r in table_profile(df.drop("part")).collect()}
    for r in together:
        want = exact[r["column"]]
        assert (r["rows"], r["missing"], r["zeros"], r["min_length"], r["max_length"]) == tuple(want[c] for c in ("rows", "missing", "zeros", "min_length", "max_length"))
        assert abs(r["distinct"] - want["distinct"]) <= 0.05 * want["distinct"]
    assert merge_sketches(parts, ["part"]).count() == 27


@pytest.mark.parametrize("bounded", [1, 20])
def test_order_statistics_by_rounds(spark, monkeypatch, bounded):
    """Intervals narrow until one value is left, over ties, infinities and columns with nulls."""
    monkeypatch.setattr(P, "BOUNDED", bounded)
    rng = np.random.default_rng(3)
    values = np.concatenate([rng.normal(size=1500), np.full(700, 0.25), rng.pareto(0.3, 800), [np.inf, -np.inf, -0.0, 0.0]])
    rng.shuffle(values)
    df = spark.createDataFrame([(float(v), i % 7, None if i % 2 else float(v)) for i, v in enumerate(values)], "x double, n int, y double").repartition(4)
    probabilities = [0.0, 0.001, 0.3, 0.5, 0.777, 0.999, 1.0]
    got = {(r["column"], r["q"]): r["value"] for r in P.exact_quantiles(df, ["x", "n", "y"], probabilities, accuracy=20).collect()}
    for name, v in (("x", values), ("n", np.arange(len(values)) % 7), ("y", values[::2])):
        v = np.sort(v)
        for q in probabilities:
            assert got[name, q] == v[max(int(np.ceil(q * len(v))), 1) - 1], (name, q)


def test_no_window_in_quantiles(spark, small):
    df = spark.read.parquet(f"{small}/lineitem.parquet")
    plan = P.numeric_profile(df, ["l_quantity", "l_tax"])._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Sort" not in plan


@pytest.mark.parametrize("prefix", [1, 3])
def test_samples_are_the_smallest_digests(spark, monkeypatch, prefix):
    import hashlib

    monkeypatch.setattr(P, "PREFIX", prefix)
    rng = random.Random(2)
    rows = [(i, rng.choice("ab"), rng.choice([None, "p", "q", "r"]), i % 5) for i in range(400)] + [(400, "c", None, None), (401, None, "p", 1)]
    df = spark.createDataFrame(rows, "k long, g string, t string, n int").repartition(6)
    got = {}
    for r in P.column_samples(df, ["t", "n"], ["k"], k=4, by=["g"], keep_empty=True).collect():
        got.setdefault((r["g"], r["column"]), []).append((r["rank"], r["value"]))
    for g in ("a", "b", "c", None):
        for c, at in (("t", 2), ("n", 3)):
            own = [(r[at] is None, hashlib.md5("|".join(["42", c, *([] if r[at] is None else [str(r[at])]), str(r[0])]).encode()).hexdigest(), r[at]) for r in rows if r[1] == g]
            want = [(k, None if v is None else str(v)) for k, (_, _, v) in enumerate(sorted(own, key=str)[:4], 1)]
            assert sorted(got[g, c]) == want, (g, c)


def test_samples_are_cut_before_they_are_ordered(spark, small):
    df = spark.read.parquet(f"{small}/customer.parquet")
    plan = P.column_samples(df, ["c_name", "c_nationkey"], ["c_custkey"])._jdf.queryExecution().executedPlan().toString()
    sort = plan.index("Sort [column")
    assert "_cut" in plan[sort : plan.index("Scan parquet", sort)]  # the cut stands between the sort and the scan
