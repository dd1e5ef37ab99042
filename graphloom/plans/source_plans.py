"""Named queries that write given tables in a format and read them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.plans.people import SQL_SOURCES, sources, table
from graphloom.session import scratch_path
from graphloom.sources.recorded import read_csv_recorded, read_ntriples_recorded
from graphloom.sources.split_csv import read_csv_split
from graphloom.sources.tables import convert_table, load_source, write_csv
from graphloom.sources.xlsx import read_xlsx, write_xlsx

CUSTOMER = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]


def _csv(spark, d):
    path = scratch_path(spark, "customer") + ".csv"
    write_csv(table(spark, d, "customer").select(*CUSTOMER), path)
    return load_source(spark, path)


def _csv_documents(spark, d):
    """Whole texts with line ends, quotes and separators inside."""
    path = scratch_path(spark, "documents") + ".csv"
    write_csv(table(spark, d, "documents").select("doc_id", "lang", "text"), path)
    return load_source(spark, path)


def _csv_split(spark, d):
    """The same whole texts, each file read by as many tasks as it has splits."""
    path = scratch_path(spark, "documents") + ".csv"
    write_csv(table(spark, d, "documents").select("doc_id", "lang", "text"), path)
    return read_csv_split(spark, path)


def _latin1(spark, d):
    """One folder, half of its rows in UTF-8 files and half in Latin-1 files."""
    path = scratch_path(spark, "mixed")
    a = sources(spark, d)[0].drop("src", "pid").withColumn("_even", F.crc32("ID_Client") % 2 == 0)
    write_csv(a.where("_even").drop("_even"), path + "/utf8.csv")
    write_csv(a.where("not _even").drop("_even"), path + "/latin1.csv", encoding="ISO-8859-1")
    return load_source(spark, path + "/*.csv", "csv")


def _xlsx(spark, d):
    folder = scratch_path(spark, "customer-xlsx")
    write_xlsx(table(spark, d, "customer").select(*CUSTOMER).repartition(4, "c_custkey"), folder)
    return read_xlsx(spark, folder)


def _xlsx_to_csv(spark, d):
    """Workbooks with blanks around the headers, converted to CSV and loaded."""
    folder = scratch_path(spark, "rh")
    b = sources(spark, d)[1].drop("src", "pid")
    write_xlsx(b.toDF(*[f" {c} " for c in b.columns]), folder + ".xlsx")
    convert_table(spark, folder + ".xlsx", folder + ".csv", sep=",")
    return load_source(spark, folder + ".csv", sep=",")


QUERIES = {
    "csv_roundtrip": _csv,
    "csv_documents_roundtrip": _csv_documents,
    "csv_documents_split": _csv_split,
    "latin1_roundtrip": _latin1,
    "xlsx_roundtrip": _xlsx,
    "xlsx_to_csv": _xlsx_to_csv,
}

_CUSTOMER_SQL = "SELECT " + ", ".join(f"{c}::VARCHAR AS {c}" for c in CUSTOMER) + " FROM customer"

ORACLE = {
    "csv_roundtrip": _CUSTOMER_SQL,
    "csv_documents_roundtrip": "SELECT doc_id::VARCHAR AS doc_id, lang, text FROM documents",
    "csv_documents_split": "SELECT doc_id::VARCHAR AS doc_id, lang, text FROM documents",
    "latin1_roundtrip": f"WITH {SQL_SOURCES.strip()} SELECT * EXCLUDE (src, pid) FROM src_a",
    "xlsx_roundtrip": _CUSTOMER_SQL,
    "xlsx_to_csv": f"WITH {SQL_SOURCES.strip()} SELECT * EXCLUDE (src, pid) FROM src_b",
}


def _untidy_customers(spark, d):
    """Customers in two folders of CSV: other column orders, one in Latin-1, with cells too many or too few here and there."""
    root = scratch_path(spark, "untidy")
    c = table(spark, d, "customer").select(
        F.col("c_custkey").cast("string").alias("k"), F.concat(F.lit("é "), F.col("c_name")).alias("n"), F.col("c_mktsegment").alias("m"), F.col("c_custkey").alias("i")
    )
    extra = F.when(F.col("i") % 13 == 0, ";more").when(F.col("i") % 17 == 0, None).otherwise("")
    plain = {"k;n;m": F.concat_ws(";", "k", F.concat(F.lit('"'), "n", F.lit(';"')), "m"), "m;k": F.concat_ws(";", "m", "k")}
    for (header, cells), part, encoding in zip(plain.items(), (0, 1), ("ISO-8859-1", "UTF-8")):
        line = F.when(F.col("i") % 17 == 0, F.col("k")).otherwise(F.concat(cells, F.coalesce(extra, F.lit("")))).alias(header)
        raw = c.where(F.col("i") % 2 == part).select(line)
        raw.write.option("header", True).option("sep", "\x01").option("quote", "").option("encoding", encoding).csv(f"{root}/{part}")
    return read_csv_recorded(spark, [f"{root}/0", f"{root}/1"])


def _mixed_headers(spark, d):
    return _untidy_customers(spark, d)[0].select("k", "n", "m")


def _ragged(spark, d):
    faults = _untidy_customers(spark, d)[1]
    return faults.select("value", "reason", F.when(F.col("file").contains("/0/"), 0).otherwise(1).alias("folder"))


def _damaged_triples(spark, d):
    """A graph read from files with repeated and damaged lines: how many triples and faults there are."""
    path = scratch_path(spark, "damaged")
    lines = table(spark, d, "customer").select(F.col("c_custkey").alias("i"), F.concat(F.lit("<http://x/"), "c_custkey", F.lit('> <http://x/name> "'), "c_name", F.lit('"')).alias("t"))
    kept = lines.select(F.explode(F.array(F.concat("t", F.lit(" .")), F.concat("t", F.when(F.col("i") % 10 == 0, "").otherwise(' . # "again"')))).alias("value"))
    kept.write.text(path)
    triples, faults = read_ntriples_recorded(spark, path)
    place = F.concat_ws(":", "file", "block", "line").alias("place")
    both = triples.select(F.lit(None).cast("string").alias("place")).unionByName(faults.select(place))
    return both.agg(F.count_if(F.col("place").isNull()).alias("triples"), F.count("place").alias("faults"), F.count_distinct("place").alias("places"))


_UNTIDY = """SELECT c_custkey AS i, c_custkey::VARCHAR AS k, 'é ' || c_name AS n, c_mktsegment AS m FROM customer"""
QUERIES |= {"csv_mixed_headers": _mixed_headers, "csv_ragged": _ragged, "ntriples_set": _damaged_triples}
ORACLE |= {
    "csv_mixed_headers": f"SELECT k, CASE WHEN i % 2 = 0 THEN n || ';' END AS n, m FROM ({_UNTIDY}) WHERE i % 13 <> 0 AND i % 17 <> 0",
    "csv_ragged": f"""SELECT CASE WHEN i % 17 = 0 THEN k WHEN i % 2 = 0 THEN k || ';"' || n || ';";' || m || ';more' ELSE m || ';' || k || ';more' END AS value,
      'cells' AS reason, (i % 2)::INTEGER AS folder FROM ({_UNTIDY}) WHERE i % 13 = 0 OR i % 17 = 0""",
    "ntriples_set": """SELECT count(*) AS triples, count(*) FILTER (c_custkey % 10 = 0) AS faults, count(*) FILTER (c_custkey % 10 = 0) AS places FROM customer""",
}
