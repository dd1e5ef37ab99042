import pytest
from pyspark.sql import functions as F

from graphloom.functions import text as X


def one(spark, column, **values):
    schema = ", ".join(f"{k} string" for k in values)
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "raw, want",
    [("  Ana\t", "ana"), (" Zoé ", "zoé"), ("a  b", "a  b"), ("", ""), (None, None), ("\x1cX\x1f", "x")],
)
def test_normalize_name(spark, raw, want):
    assert one(spark, X.normalize_name(F.col("c")), c=raw) == want


@pytest.mark.parametrize("raw, want", [("1/2/2020", "2020-02-01"), ("01/02/2020", "2020-02-01"), (None, None)])
def test_strict_date(spark, raw, want):
    assert one(spark, X.strict_date(F.col("c")), c=raw) == want


@pytest.mark.parametrize("raw", ["31/02/2020", "2020-01-01", "soon"])
def test_strict_date_fails(spark, raw):
    with pytest.raises(Exception, match="not a date"):
        one(spark, X.strict_date(F.col("c")), c=raw)


@pytest.mark.parametrize(
    "raw, want", [("2020-1-2", "2020-01-02"), ("2/1/2020", "2020-01-02"), ("31/02/2020", None), ("", None), (None, None)]
)
def test_lenient_date(spark, raw, want):
    assert one(spark, X.lenient_date(F.col("c")), c=raw) == want


def test_names_numbers_ids(spark):
    assert one(spark, X.joined_name(F.col("a"), F.col("b")), a=None, b=None) == " "
    assert one(spark, X.padded_id("RH-", F.col("a").cast("long")), a="1234567") == "RH-1234567"
    assert one(spark, X.padded_id("RH-", F.col("a").cast("long")), a="7") == "RH-00007"
    assert one(spark, X.decimal_to_comma(F.col("a")), a="12.50") == "12,50"
    assert str(one(spark, X.comma_to_decimal(F.col("a")), a="12,50")) == "12.50"
    assert one(spark, X.comma_to_decimal(F.col("a")), a="n/a") is None
