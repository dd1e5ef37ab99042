"""A graph kept as a table: a folder for each predicate, in it buckets by subject.

A pattern with a predicate reads that predicate's folder alone. Triples of one subject lie in the bucket of equal number
under every predicate, so joins on the subject need no shuffle. Added triples are shuffled to the buckets; what is stored stays where it is.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from graphloom.operators.triples import TRIPLE_COLUMNS, match_triples
from graphloom.session import scratch_path


def _write(graph: DataFrame, name: str, path: str, buckets: int, mode: str) -> int:
    seen = Observation()
    # dealt by the function that also numbers the buckets: a task writes one file for each predicate
    dealt = graph.select(*TRIPLE_COLUMNS).observe(seen, F.count(F.lit(1)).alias("n")).repartition(buckets, "s")
    writer = dealt.write.mode(mode).partitionBy("p").bucketBy(buckets, "s").sortBy("s")
    writer.option("path", path).saveAsTable(name)
    return seen.get["n"]


def store_graph(graph: DataFrame, name: str, path: str, buckets: int) -> int:
    """Keep ``graph``, a set of triples, as table ``name`` at ``path``; what was there is replaced. Returns its size.

    ``buckets`` is fixed for the life of the table: choose it so that a bucket of the largest predicate fits a task.
    """
    return _write(graph, name, path, buckets, "overwrite")


def stored_graph(spark: SparkSession, name: str) -> DataFrame:
    return spark.table(name).select(*TRIPLE_COLUMNS)


def stored_pattern(spark: SparkSession, name: str, s: str | None = None, p: str | None = None, o: str | None = None) -> DataFrame:
    """Triples that agree with every given position; with ``p`` no other folder is read, with ``s`` one bucket of each."""
    return match_triples(stored_graph(spark, name), s, p, o)


def subjects(spark: SparkSession, name: str, predicates: Mapping[str, str]) -> DataFrame:
    """``s`` and a column for each named predicate, for subjects that have all of them, from bucket to bucket.

    A subject with several objects of a predicate gives a row for each combination.
    """
    out = None
    for column, p in predicates.items():
        one = stored_pattern(spark, name, p=p).select("s", F.col("o").alias(column))
        out = one if out is None else out.join(one.hint("merge"), "s")
    return out


def _buckets(spark: SparkSession, name: str) -> tuple[int, str]:
    rows = {r["col_name"]: r["data_type"] for r in spark.sql(f"DESCRIBE TABLE EXTENDED {name}").collect()}
    return int(rows["Num Buckets"]), rows["Location"]


def add_triples(spark: SparkSession, name: str, graph: DataFrame) -> int:
    """Add the triples of ``graph`` (repeats allowed) that the stored set lacks; returns how many those are.

    Only the new triples are shuffled: they meet the stored ones in the buckets of their subjects, and of the stored
    table only the folders of their predicates are read.
    """
    buckets, path = _buckets(spark, name)
    held = scratch_path(spark, "added")
    graph.select(*TRIPLE_COLUMNS).distinct().write.parquet(held)
    new = spark.read.parquet(held)
    predicates = [r["p"] for r in new.select("p").distinct().collect()]  # a vocabulary, not data
    stored = stored_graph(spark, name).where(F.col("p").isin(predicates))
    return _write(missing_triples(stored, new, buckets), name, path, buckets, "append")


def missing_triples(stored: DataFrame, new: DataFrame, buckets: int) -> DataFrame:
    """The rows of ``new`` that ``stored`` lacks; joined on the subject alone, so that the buckets of ``stored`` serve."""
    a, b = new.repartition(buckets, "s").alias("a"), stored.alias("b")
    # behind a function the comparison of the rest is a condition, not one more key that the buckets would not match
    rest = [F.struct(*[F.col(f"{t}.{c}") for c in TRIPLE_COLUMNS if c != "s"]) for t in "ab"]
    same = (F.col("a.s") == F.col("b.s")) & F.greatest(rest[0].eqNullSafe(rest[1]), F.lit(False))
    return a.join(b.hint("merge"), same, "left_anti")
