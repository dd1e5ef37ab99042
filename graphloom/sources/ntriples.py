"""N-Triples in and out. Partitions are the chunks: no task holds more than one record batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.rdf import parse_triple_line, triple_line

RECORDS_PER_FILE = 5_000_000


def triple_lines(graph: DataFrame) -> DataFrame:
    return graph.select(triple_line(*[F.col(c) for c in ("s", "p", "o", "o_kind", "o_datatype", "o_lang")]).alias("value"))


def write_ntriples(graph: DataFrame, path: str, records_per_file: int = RECORDS_PER_FILE, mode: str = "overwrite") -> int:
    """Write the graph and return the number of lines, counted by the writing job itself.

    An empty graph still replaces what was at ``path``.
    """
    seen = Observation()
    lines = triple_lines(graph).observe(seen, F.count(F.lit(1)).alias("n"))
    lines.write.mode(mode).option("maxRecordsPerFile", records_per_file).text(path)
    return seen.get["n"]


def _parsed(spark: SparkSession, path: str | list[str]) -> DataFrame:
    lines = spark.read.text(path).where(~F.col("value").rlike(r"^\s*(#.*)?$"))
    # through ``explode`` of one element a line is parsed once, not again for each field and filter
    return lines.select("value", F.explode(F.array(parse_triple_line(F.col("value")))).alias("t"))


def read_ntriples(spark: SparkSession, path: str | list[str], distinct: bool = True, fail: bool = False) -> DataFrame:
    """Triples of one or more files as a set (``distinct=False`` where it is known to be one).

    Lines that do not parse are left to ``malformed_lines``; with ``fail`` the first of them is an error.
    """
    parsed = _parsed(spark, path)
    if fail:
        wrong = F.raise_error(F.concat(F.lit("malformed line: "), F.col("value")))
        parsed = parsed.withColumn("t", F.when(F.col("t").isNull(), wrong).otherwise(F.col("t")))
    triples = parsed.where("t is not null").select("t.*")
    return triples.distinct() if distinct else triples


def malformed_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return _parsed(spark, path).where("t is null").select("value")
