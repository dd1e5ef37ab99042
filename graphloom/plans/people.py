"""Two person tables derived from ``documents``: the second and fourth word of a text make a person.

Each frame stands next to the SQL that derives the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.text import padded_id
from graphloom.operators.linkage import standardize_full_name, standardize_split_name
from graphloom.operators.views import entity_views

# Fixed values.
SEGMENTS = ["Gold", "Silver", "Bronze", "Platinum"]
DEPARTMENTS = ["Informatique", "Ressources Humaines", "Finance", "Marketing", "Juridique", "Logistique", "R&D"]
CONTRACTS = ["CDI", "CDD", "Stage", "Alternance", "Freelance"]
WORDS = "[a-zà-öø-ÿ]{3,}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One person per text with four words or more.

    The queries below read the pool several times; its few short columns are kept (memory, then disk) so
    that the texts are read and cut once.
    """
    words = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("pid"), F.col("source").alias("src"),
        # through ``explode`` of one element the words are cut once, not again in the filter below
        F.explode(F.array(F.regexp_extract_all(F.lower("text"), F.lit(WORDS), F.lit(0)))).alias("w"),
    )
    return words.where(F.size("w") >= 4).select(
        "pid", "src", F.col("w")[1].alias("fn"), F.col("w")[2].alias("city"), F.col("w")[3].alias("ln"),
        F.date_add(F.lit("1960-01-01").cast("date"), (F.col("pid") * 7919 % 400).cast("int")).alias("bd"),
    ).persist()


def _pick(values: list[str], index):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def sources(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Customers (joined name, day-first dates, decimal commas) and employees (split name, ISO dates)."""
    pid, fn, ln = F.col("pid"), F.col("fn"), F.col("ln")
    cents = 1000000 + pid * 104729 % 49000000
    kind = pid % 4
    left = {
        "src": F.col("src"), "pid": pid,
        "ID_Client": padded_id("CRM-", pid),
        "nom_complet": F.concat_ws(" ", fn, ln),
        "email": F.when(pid % 11 != 0, F.concat(fn, F.lit("."), ln, F.lit("@example.org"))),
        "dt_naissance": F.date_format("bd", "dd/MM/yyyy"),
        "ville": F.initcap("city"),
        "ca_annuel": F.concat((cents / 100).cast("long").cast("string"), F.lit(","), F.lpad((cents % 100).cast("string"), 2, "0")),
        "segment": F.when(pid % 5 != 0, _pick(SEGMENTS, pid % 4)),
    }
    right = {
        "src": F.col("src"), "pid": pid,
        "Matricule_RH": padded_id("RH-", pid),
        "Nom_Famille": F.when(kind == 1, F.expr("left(ln, length(ln) - 1)")).when(kind == 3, F.concat(ln, F.lit("s"))).otherwise(ln),
        "Prenom": F.when(kind == 2, F.substring(fn, 1, 1)).otherwise(fn),
        "date_nais": F.date_format("bd", "yyyy-MM-dd"),
        "departement": _pick(DEPARTMENTS, pid * 31 % 7),
        "contrat": _pick(CONTRACTS, pid * 17 % 5),
        "salaire_mensuel": (1800 + pid * 263 % 6701).cast("string"),
        "date_embauche": F.date_format(F.date_add(F.lit("2015-01-01").cast("date"), (pid * 6151 % 3650).cast("int")), "yyyy-MM-dd"),
    }
    return entity_views(pool(spark, sf_dir), pid % 10 < 6, pid % 10 >= 3, left, right)


def standardized(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    a, b = sources(spark, sf_dir)
    return standardize_full_name(a), standardize_split_name(b, last_col="Nom_Famille", first_col="Prenom")


def employees_and_customers(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The two tables under the column names of the mapping rules."""
    a, b = sources(spark, sf_dir)
    return {"customers": a, "employees": b.withColumnsRenamed({"Nom_Famille": "last_name", "Prenom": "first_name"})}


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identity pairs: a person in both tables."""
    pid = F.col("pid")
    both = pool(spark, sf_dir).where((pid % 10 < 6) & (pid % 10 >= 3))
    return both.select(padded_id("CRM-", pid).alias("id_l"), padded_id("RH-", pid).alias("id_r"))


def _list(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


SQL_SOURCES = f"""
pool AS (
  SELECT doc_id AS pid, source AS src, w[2] AS fn, w[3] AS city, w[4] AS ln,
         DATE '1960-01-01' + CAST(doc_id * 7919 % 400 AS INTEGER) AS bd
  FROM (SELECT doc_id, source, regexp_extract_all(lower(text), '{WORDS}') AS w FROM documents)
  WHERE len(w) >= 4
),
src_a AS (
  SELECT src, pid, 'CRM-' || printf('%05d', pid) AS ID_Client, fn || ' ' || ln AS nom_complet,
         CASE WHEN pid % 11 <> 0 THEN fn || '.' || ln || '@example.org' END AS email,
         strftime(bd, '%d/%m/%Y') AS dt_naissance,
         upper(city[1]) || city[2:] AS ville,
         CAST((1000000 + pid * 104729 % 49000000) // 100 AS VARCHAR) || ',' ||
           printf('%02d', (1000000 + pid * 104729 % 49000000) % 100) AS ca_annuel,
         CASE WHEN pid % 5 <> 0 THEN {_list(SEGMENTS)}[pid % 4 + 1] END AS segment
  FROM pool WHERE pid % 10 < 6
),
src_b AS (
  SELECT src, pid, 'RH-' || printf('%05d', pid) AS Matricule_RH,
         CASE pid % 4 WHEN 1 THEN left(ln, length(ln) - 1) WHEN 3 THEN ln || 's' ELSE ln END AS Nom_Famille,
         CASE WHEN pid % 4 = 2 THEN left(fn, 1) ELSE fn END AS Prenom,
         strftime(bd, '%Y-%m-%d') AS date_nais,
         {_list(DEPARTMENTS)}[pid * 31 % 7 + 1] AS departement,
         {_list(CONTRACTS)}[pid * 17 % 5 + 1] AS contrat,
         CAST(1800 + pid * 263 % 6701 AS VARCHAR) AS salaire_mensuel,
         strftime(DATE '2015-01-01' + CAST(pid * 6151 % 3650 AS INTEGER), '%Y-%m-%d') AS date_embauche
  FROM pool WHERE pid % 10 >= 3
),
std_a AS (
  SELECT ID_Client AS unique_id, trim(lower(nom_complet)) AS nom_comparaison,
         strftime(strptime(dt_naissance, '%d/%m/%Y'), '%Y-%m-%d') AS date_comparaison FROM src_a
),
std_b AS (
  SELECT Matricule_RH AS unique_id, trim(lower(coalesce(Prenom, '') || ' ' || coalesce(Nom_Famille, ''))) AS nom_comparaison,
         strftime(strptime(date_nais, '%Y-%m-%d'), '%Y-%m-%d') AS date_comparaison FROM src_b
)
"""
