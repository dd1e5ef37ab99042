"""Reading and writing tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def require_columns(df: DataFrame, required: Sequence[str], where: str) -> None:
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise KeyError(f"missing columns in {where}: {missing}; columns present: {df.columns}")


def _file_system(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop_path


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, hadoop_path = _file_system(spark, path)
    found = fs.globStatus(hadoop_path)
    return found is not None and len(found) > 0


def require_paths(spark: SparkSession, paths: dict[str, str]) -> None:
    """Every labelled path must exist; one error names all that do not."""
    missing = [f"{label}: '{path}'" for label, path in paths.items() if not path_exists(spark, path)]
    if missing:
        raise FileNotFoundError("missing inputs:\n" + "\n".join(missing))


def strip_headers(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip() for c in df.columns])


def _csv_options(reader, sep: str, encoding: str, multi_line: bool, mode: str = "FAILFAST"):
    return (
        reader.option("sep", sep).option("encoding", encoding).option("quote", '"').option("escape", '"')
        .option("multiLine", multi_line).option("mode", mode)
    )


def csv_header(spark: SparkSession, path: str, sep: str, encoding: str = "UTF-8") -> list[str]:
    """Column names from the first line; no row is typed or counted."""
    return _csv_options(spark.read, sep, encoding, False).option("header", True).option("inferSchema", False).csv(path).columns


def read_csv(
    spark: SparkSession, path: str | list[str], sep: str = ";", encoding: str = "UTF-8", schema: T.StructType | None = None,
    multi_line: bool = False, mode: str = "FAILFAST",
) -> DataFrame:
    """Delimited text with a header, every column a string unless a schema is given.

    A row with more or fewer cells than the header, or a file with another header than the first, is an
    error; with ``mode="PERMISSIVE"`` such rows are cut or filled up instead.
    """
    reader = _csv_options(spark.read, sep, encoding, multi_line, mode).option("header", True).option("enforceSchema", mode == "PERMISSIVE")
    if schema is None:
        first = path if isinstance(path, str) else path[0]
        schema = T.StructType([T.StructField(c, T.StringType()) for c in csv_header(spark, first, sep, encoding)])
    return reader.schema(schema).csv(path)


def undecodable_files(spark: SparkSession, path: str) -> list[str]:
    """Files under ``path`` that are not valid UTF-8.

    The CSV reader would put replacement characters without a word, so the raw lines are checked per
    file. One aggregate over the text; the driver receives the names of bad files only.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.is_valid_utf8("value").alias("ok"))
    bad = lines.where(~F.col("ok")).select("file").distinct()
    return [r["file"] for r in bad.collect()]


def read_csv_any_encoding(
    spark: SparkSession, path: str, sep: str = ";", fallback: str = "ISO-8859-1", multi_line: bool = False,
    schema: T.StructType | None = None, mode: str = "FAILFAST",
) -> DataFrame:
    """UTF-8 files as such, the others in the fallback encoding, as one table."""
    bad = undecodable_files(spark, path)
    if not bad:
        return read_csv(spark, path, sep, schema=schema, multi_line=multi_line, mode=mode)
    table = None
    good = [r["file"] for r in _files(spark, path).collect() if r["file"] not in set(bad)]
    for files, encoding in ((good, "UTF-8"), (bad, fallback)):
        if files:
            part = read_csv(spark, files, sep, encoding, schema, multi_line, mode)
            table = part if table is None else table.unionByName(part)
    return table


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"))


def load_source(
    spark: SparkSession, path: str, fmt: str | None = None, sep: str = ";", fallback: str = "ISO-8859-1", multi_line: bool = True,
    schema: T.StructType | None = None, mode: str = "FAILFAST",
) -> DataFrame:
    """A table by the format of its name: ``.csv`` (with encoding fallback), ``.xlsx``, ``.parquet``.

    Quoted cells of a CSV may hold line ends. Without any, ``multi_line=False`` lets Spark split large files.
    """
    from graphloom.sources.xlsx import read_xlsx

    kind = (fmt or path.rstrip("/").rsplit(".", 1)[-1]).lower()
    if kind not in ("csv", "xlsx", "parquet"):
        raise ValueError(f"format not supported: '{kind}'")
    require_paths(spark, {"source": path})
    if kind == "csv":
        return read_csv_any_encoding(spark, path, sep, fallback, multi_line, schema, mode)
    return read_xlsx(spark, path) if kind == "xlsx" else spark.read.parquet(path)


def write_csv(df: DataFrame, path: str, sep: str = ";", encoding: str = "UTF-8", mode: str = "overwrite") -> None:
    (
        df.write.mode(mode).option("sep", sep).option("header", True).option("encoding", encoding)
        .option("quote", '"').option("escape", '"').csv(path)
    )


def convert_table(spark: SparkSession, source: str, target: str, sep: str = ",", reuse: bool = False) -> None:
    """A workbook (or any readable table) as CSV with clean headers.

    The target is rewritten by default; ``reuse`` keeps one that is already there.
    """
    write_csv(strip_headers(load_source(spark, source)), target, sep, mode="ignore" if reuse else "overwrite")


def write_documents(documents: DataFrame, path: str, column: str = "document", mode: str = "overwrite") -> None:
    """JSON documents (results, comparison reports), one per line."""
    documents.select(column).write.mode(mode).text(path)
