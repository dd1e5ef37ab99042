import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.operators import profile as P
from graphloom.operators import quality as Q
from graphloom.operators.views import customer_revenue, seeded_sample, shuffled_ids


@pytest.fixture(scope="module")
def table(spark):
    rows = [("a", 1.0, None), ("a", 1.0, None), ("b", None, None), (None, -2.0, None), ("", 0.0, None), ("a|1:b", 7.0, None)]
    return spark.createDataFrame(rows, "t string, x double, e string")


def test_report(spark, table):
    r = Q.quality_report(table, "src").first()
    assert (r["rows"], r["columns"], r["null_pct"], r["duplicate_rows"], r["column_names"]) == (6, 3, 44.44, 1, "t,x,e")
    empty = Q.quality_report(table.limit(0), "none").first()
    assert (empty["rows"], empty["null_pct"], empty["duplicate_rows"]) == (0, 0.0, 0)
    assert [r["column"] for r in Q.high_null_columns(table).collect()] == ["e"]  # x and t have one in six
    assert {r["null_rate"] for r in Q.null_rates(table.limit(0)).collect()} == {0.0}


def test_duplicates_tell_null_from_text(spark):
    rows = [(None, "x"), ("-", "x"), ("", "x"), (None, "x"), ("a,1:b", None), ("a", "b")]
    assert Q.duplicate_count(spark.createDataFrame(rows, "a string, b string")).first()[0] == 1


def test_schema_difference(spark, table):
    got = {r["column"]: tuple(r)[1:] for r in Q.schema_difference(table, table.select("t", F.lit(1).alias("n"))).collect()}
    assert got == {"t": (True, True, 5, 5), "x": (True, False, 5, 0), "e": (True, False, 0, 0), "n": (False, True, 0, 6)}


def test_numeric_profile_of_odd_columns(spark, table):
    df = table.withColumns({"one": F.lit(4), "none": F.lit(None).cast("double")})
    got = {r["column"]: r for r in P.numeric_profile(df, ["x", "one", "none"]).collect()}
    assert (got["x"]["zeros"], got["x"]["negatives"], got["x"]["missing"], got["x"]["median"]) == (1, 1, 1, 1.0)
    assert got["one"]["std"] == 0.0 and got["one"]["p05"] == got["one"]["p95"] == 4.0
    assert got["none"]["count"] == 0 and got["none"]["mean"] is None and got["none"]["median"] is None
    assert P.histogram(df, ["none"]).count() == 0
    assert [tuple(r) for r in P.histogram(df, ["one"], 3).collect()] == [("one", 0, 4.0, 5.0, 6)]


def test_numeric_profile_needs_a_number(table):
    with pytest.raises(ValueError, match="no numeric"):
        P.numeric_profile(table.select("t", "e"))


@pytest.mark.parametrize("accuracy", [10, 1000])
def test_quantiles_are_exact_with_a_coarse_sketch(spark, accuracy):
    """Half of the values are one and the same; the sketch alone would be far off."""
    rng = np.random.default_rng(5)
    values = np.where(rng.random(4000) < 0.5, 3.5, rng.normal(size=4000).round(3))
    df = spark.createDataFrame([(float(v), float(-v)) for v in values], "x double, y double").repartition(5)
    probabilities = [0.0, 0.05, 0.5, 0.51, 0.95, 1.0]
    got = {(r["column"], r["q"]): r["value"] for r in P.exact_quantiles(df, ["x", "y"], probabilities, accuracy).collect()}
    for name, v in (("x", np.sort(values)), ("y", np.sort(-values))):
        for q in probabilities:
            assert got[name, q] == v[max(int(np.ceil(q * len(v))), 1) - 1]


def test_categorical_profile_and_top_values(spark, table):
    got = {r["column"]: r for r in P.categorical_profile(table, ["t", "e"]).collect()}
    assert (got["t"]["count"], got["t"]["missing"], got["t"]["distinct"], got["t"]["unique"], got["t"]["max_length"]) == (5, 1, 4, 3, 5)
    assert (got["e"]["count"], got["e"]["distinct"], got["e"]["mean_length"]) == (0, 0, 0.0)
    top = [tuple(r) for r in P.top_values(table, ["t", "e"], 2).orderBy("rank").collect()]
    assert top == [("t", 1, "a", 2), ("t", 2, "", 1)]


def test_approximate_distinct_is_close(spark, small):
    df = spark.read.parquet(f"{small}/lineitem.parquet")
    exact = df.select("l_orderkey").distinct().count()
    assert abs(P.approximate_distinct(df, ["l_orderkey"]).first()["distinct"] - exact) < 0.08 * exact


def test_samples(spark, table):
    keyed = table.withColumn("k", F.monotonically_increasing_id())
    got = P.column_samples(keyed, ["t", "x", "e"], ["k"], k=2).collect()
    assert {r["column"] for r in got} == {"t", "x"} and len(got) == 4 and all(r["value"] is not None for r in got)
    plan = P.column_samples(keyed, ["t"], ["k"])._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
    assert seeded_sample(keyed, 3, ["k"]).collect() == seeded_sample(keyed.repartition(3), 3, ["k"]).collect()


def test_ids_have_no_gap(spark):
    df = spark.range(5000).repartition(7)
    got = {r["id"]: r["seq"] for r in shuffled_ids(df, ["id"], buckets=64).collect()}
    assert sorted(got.values()) == list(range(1, 5001)) and [got[i] for i in range(50)] != sorted(got[i] for i in range(50))
    again = {r["id"]: r["seq"] for r in shuffled_ids(df.repartition(3), ["id"], buckets=8).collect()}
    assert again == got


def test_revenue(spark):
    rows = [(1.0, 2, 3.5, "FR"), (1.0, -1, 1.0, "DE"), (None, 9, 9.0, "FR"), (2.0, -3, 1.0, "FR"), (3.0, 1, 0.0, "FR")]
    df = spark.createDataFrame(rows, "customer_id double, quantity int, price double, country string")
    assert [tuple(r) for r in customer_revenue(df).collect()] == [(1, 6.0, "DE")]
