"""The named queries of the operators, op1 to op13, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import chosen_path, hard_negatives, imatch, language_id, line_cleaning, merkle, mixing, ngram_join, passages, sentencepiece_scan, token_counts, warc, weak_labels
from graphloom.llm.words import documents
from graphloom.session import scratch_path


def op1_line_cleaning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and verdict of every document, and how much of it its lines keep."""
    return line_cleaning.clean(documents(spark, sf_dir).select("doc_id", "text")).drop("text", "clean_text")


def op2_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document, of its edited text, and their likeness."""
    return imatch.edits(documents(spark, sf_dir))


def op3_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every passage of at least fifty words that is near an earlier document's."""
    return passages.repeated_passages(documents(spark, sf_dir))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of every document a mix of 150 % takes."""
    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op5_weak_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Votes, posterior and learned quality of every document."""
    scored = weak_labels.score(documents(spark, sf_dir).select("doc_id", "text")).drop("text")
    return scored.withColumn("kept", F.col("quality") >= 0.5)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as archives and read back."""
    path = scratch_path(spark, "warc")
    warc.write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    records = warc.read_archives(spark, path)
    page = lambda c: F.expr(f"try_cast(regexp_extract({c}, '^<urn:page:(-?[0-9]*)>$', 1) AS BIGINT)")
    sound = F.when(F.col("error").isNotNull(), F.raise_error(F.concat(F.lit("damaged record: "), "error"))).otherwise(F.col("payload_bytes"))
    return records.select(page("record_id").alias("page_id"), sound.cast("long").alias("payload_bytes"), "payload_digest", "record_type", page("refers_to").alias("refers_to"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from the documents that are not held out."""
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang").withColumn("held_out", language_id.held_out(F.col("doc_id")))
    model = language_id.train(docs.where(~F.col("held_out") & F.col("doc_id").isNotNull()))
    return language_id.predict(docs.drop("lang"), model).select("doc_id", "held_out", "lang_pred", "score", "accepted")


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents by links of at least 85 % on four-word shingles."""
    return ngram_join.near_duplicates(documents(spark, sf_dir), size=4, percent=85)


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of every document, a digest of their ids, and whether they decode to the text."""
    done = sentencepiece_scan.decode(sentencepiece_scan.encode(documents(spark, sf_dir)))
    ids = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return done.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), F.md5(ids).alias("ids_md5"), F.coalesce(F.col("decoded") == F.col("text"), F.col("text").isNull()).alias("round_trip"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document, found in flat files of all their tokens."""
    path = scratch_path(spark, "tokens")
    token_counts.write_tokens(documents(spark, sf_dir), path)
    counts = token_counts.token_counts(spark, path)
    return counts.select(F.regexp_extract("file", "part-([0-9]+)", 1).cast("int").alias("file"), "doc_number", "n_tokens", "ended")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every fiftieth embedding among all embeddings."""
    return hard_negatives.mine_embeddings(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op12_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents by links of at least 85 % on three-word shingles, and who stays."""
    return chosen_path.near_duplicates(documents(spark, sf_dir), size=3, percent=85)


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, roots and proof of every document, and the root that its tampered copy folds to."""
    return merkle.tamper_audit(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_line_cleaning, op2_imatch, op3_passages, op4_mixing, op5_weak_labels, op6_warc, op7_language_id, op8_ngram_join, op9_sentencepiece, op10_token_counts, op11_hard_negatives, op12_chosen_path, op13_merkle)
}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_NGRAM_SQL = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(COALESCE(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
),
g AS (
  SELECT DISTINCT doc_id, gram FROM (
    SELECT doc_id, array_to_string(w[i:i + 3], ' ') AS gram FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM w WHERE len(w) > 0)
  )
),
n AS (SELECT doc_id, COUNT(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, COUNT(*) AS shared FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 85 * (x.n + y.n - shared)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b)
SELECT d.doc_id, COALESCE(n.n, 0)::BIGINT AS n_shingles, c.component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT a, MIN(b) AS component_id FROM r GROUP BY a) c ON c.a = d.doc_id
"""

_PATH_SQL = _NGRAM_SQL.replace("w[i:i + 3]", "w[i:i + 2]").replace("len(w) - 3", "len(w) - 2").replace("c.component_id\n", "c.component_id, d.doc_id IS NOT DISTINCT FROM c.component_id AS kept\n")

ORACLE = {"op1_line_cleaning": line_cleaning.SQL, "op4_mixing": mixing.SQL, "op6_warc": warc.SQL, "op8_ngram_join": _NGRAM_SQL, "op11_hard_negatives": hard_negatives.SQL, "op12_chosen_path": _PATH_SQL, "op13_merkle": merkle.SQL}
