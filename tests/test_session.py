"""Scratch folders and how long they stay."""

import os
import time

import pytest

from graphloom.session import scratch_path, scratch_scope


def test_scratch_scope(spark):
    kept = scratch_path(spark, "kept")
    with scratch_scope(spark):
        inner = scratch_path(spark, "inner")
        spark.range(10).write.parquet(inner)
        with scratch_scope(spark):
            deep = scratch_path(spark, "deep")
            spark.range(3).write.parquet(deep)
        assert not os.path.exists(deep) and os.path.exists(inner)
        spark.read.parquet(inner).write.parquet(kept)
    assert not os.path.exists(inner)
    assert spark.read.parquet(kept).count() == 10


def test_scratch_scope_after_an_error(spark):
    with pytest.raises(ValueError), scratch_scope(spark):
        path = scratch_path(spark, "lost")  # never written
        raise ValueError
    outside = scratch_path(spark, "outside")
    spark.range(2).write.parquet(outside)
    assert not os.path.exists(path) and spark.read.parquet(outside).count() == 2


def test_scratch_scope_deletes_shuffles(spark):
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    jsc = spark.sparkContext._jsc.sc()

    def shuffles():
        blocks = jsc.env().blockManager().diskBlockManager().getAllFiles()
        return sum(blocks.apply(i).getName().startswith("shuffle_") for i in range(blocks.size()))

    kept = scratch_path(spark, "kept")
    with scratch_scope(spark):
        assert spark.conf.get(key) == "true"
        before = shuffles()
        spark.range(1_000).repartition(4, "id").write.parquet(kept)
        for _ in range(50):
            if shuffles() <= before:
                break
            time.sleep(0.1)
        assert shuffles() <= before
    assert spark.conf.get(key, None) is None
    assert spark.read.parquet(kept).count() == 1_000
