"""CSV with line ends in quoted cells, one file in many tasks."""

import random

import pytest
from pyspark.errors import PySparkException

from graphloom.sources.split_csv import read_csv_split, records


def cell(rng):
    return "".join(rng.choice(['a', 'b', ' ', ';', '"', '\n', '\n', '\r\n', 'é', 'x"\n"y', ',']) for _ in range(rng.choice([0, 3, 8, 30, 400])))


def quoted(x):
    return '"' + x.replace('"', '""') + '"'


@pytest.fixture
def small_splits(spark):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize("batch, threshold", [(3, "10485760"), (10_000, "-1")])
def test_any_cells(spark, tmp_path, small_splits, batch, threshold):
    """Records of any length, against the rows they were written from, for both joins and any batch size."""
    rng, want = random.Random(3), []
    for f in range(2):
        rows = [(f"{f}-{i}", "t" + cell(rng) + ("." * 3_000 + "\n" if i % 37 == 5 else ""), "u" + cell(rng)) for i in range(60)]
        text = "id;text;other\n" + "".join(";".join([r[0], quoted(r[1]), quoted(r[2])]) + ("\r\n" if f == 1 else "\n") for r in rows) + "\n \n"
        (tmp_path / f"{f}.csv").write_bytes(text.encode())
        want += rows
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        df = read_csv_split(spark, str(tmp_path))
        assert df.columns == ["id", "text", "other"]
        assert sorted(map(tuple, df.collect())) == sorted(want)
        blocks = records(spark, str(tmp_path)).select("file", "block").distinct().count()
        assert blocks > 2 * 3
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_faults(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id;text\n1;"x\ny"\n')
    assert [tuple(r) for r in read_csv_split(spark, str(tmp_path / "a.csv")).collect()] == [("1", "x\ny")]
    (tmp_path / "b.csv").write_text("text;id\nx;1\n")
    with pytest.raises(PySparkException, match="another header"):
        read_csv_split(spark, str(tmp_path)).collect()
    for bad in ("1;x;y", "1"):
        (tmp_path / "c.csv").write_text(f"id;text\n{bad}\n")
        with pytest.raises(PySparkException, match="another width"):
            read_csv_split(spark, str(tmp_path / "c.csv")).collect()
    (tmp_path / "d.csv").write_bytes('id;text\n1;"é\nè"\n'.encode("latin-1"))
    assert [tuple(r) for r in read_csv_split(spark, str(tmp_path / "d.csv"), encoding="ISO-8859-1").collect()] == [("1", "é\nè")]
    (tmp_path / "e.csv").write_text("")
    with pytest.raises(ValueError):
        read_csv_split(spark, str(tmp_path / "e.csv"))
