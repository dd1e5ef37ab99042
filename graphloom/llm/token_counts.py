"""Operator 10: token counts of the documents in flat token files, by a scan for the end-of-document id.

A token file is nothing but fixed-width ids (little-endian), each document followed by the end-of-document id; there is
no index. Files are read whole as rows, each is searched block by block with array comparisons, and a
block tells how many tokens and separators it has, where its last separator lies, and how long the pieces before
its separators are. A document may span blocks: running sums and maxima over a file's blocks (a prefix scan) give what is
carried into each block. Only these summaries are shuffled, never tokens.

Empty cases: a null or empty text has no tokens and counts 0. Tokens after a file's last separator are a
document that is not ended. A file that is no whole number of ids is an error. An empty folder gives no rows.
A file must fit into a row (2 GB); the writer makes one per task.
"""

from __future__ import annotations

import base64
import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.llm.words import steps

TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_multi_50k.tiktoken"
END = 50_256
WIDTH = 2
BLOCK_BYTES = 1 << 20
# Fixed value: how the public vocabulary's text is cut before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _ranks(folder: str, name: str) -> dict[bytes, int]:
    with open(os.path.join(folder, name), "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def write_tokens(docs: DataFrame, path: str, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> None:
    """Write the tokens of ``docs(text)`` as flat 16-bit files into the new folder ``path``, a file per task, in the order of the rows."""
    shared = docs.sparkSession.sparkContext.broadcast(_ranks(folder, vocabulary))

    def tokens(batches):
        from tiktoken import Encoding

        encoding = Encoding("flat", pat_str=PATTERN, mergeable_ranks=shared.value, special_tokens={})
        for step in steps(batches):
            ids = [np.array(encoding.encode_ordinary(t or ""), "<u2").tobytes() for t in step.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary())], ["ids"])

    flat = docs.select("text").mapInArrow(tokens, "ids binary").select(F.col("ids").cast("string").alias("value"))
    end = END.to_bytes(WIDTH, "little").decode("latin-1")
    # bytes pass through: the line separator is the end-of-document id itself
    flat.write.option("lineSep", end).option("encoding", "ISO-8859-1").option("compression", "none").text(path)


def scan_block(ids: np.ndarray, end: int) -> tuple[int, int, np.ndarray]:
    """Tokens of a block (separators included), place of its last separator (-1), and the lengths before each of its separators."""
    at = np.flatnonzero(ids == end)
    return len(ids), int(at[-1]) if len(at) else -1, np.diff(at, prepend=-1) - 1


def token_counts(spark: SparkSession, path: str, end: int = END, width: int = WIDTH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``file, doc_number, n_tokens, ended`` for each document of the files under ``path``; numbers from 0 within a file."""
    kind = f"<u{width}"

    def scan(batches):
        for batch in batches:
            for file, content in zip(batch.column("path"), batch.column("content")):
                data = memoryview(content.as_buffer())
                if len(data) % width:
                    raise ValueError(f"{file.as_py()} is no whole number of ids")
                size = block_bytes // width * width
                found = [scan_block(np.frombuffer(data[s : s + size], kind), end) for s in range(0, len(data), size)]
                n = [x[0] for x in found]
                lengths = [x[2] for x in found]
                at = np.concatenate([[0], np.cumsum([len(x) for x in lengths])]).astype(np.int32)
                flat = pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate([np.zeros(0, np.int64), *lengths]), pa.int64()))
                columns = [pa.array([file.as_py()] * len(n), pa.string()), pa.array(range(len(n)), pa.int64()), pa.array(n, pa.int64()), pa.array([x[1] for x in found], pa.int64()), flat]
                yield pa.RecordBatch.from_arrays(columns, ["file", "block", "n", "last", "lengths"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    blocks = files.mapInArrow(scan, "file string, block long, n long, last long, lengths array<bigint>")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)))
    blocks = blocks.withColumn("separator", F.when(F.col("last") >= 0, F.col("start") + F.col("last")))
    blocks = blocks.withColumn("carried", F.col("start") - 1 - F.coalesce(F.max("separator").over(before), F.lit(-1)))
    blocks = blocks.withColumn("first", F.coalesce(F.sum(F.size("lengths")).over(before), F.lit(0)))
    ended = blocks.select("file", "first", "carried", F.posexplode("lengths").alias("i", "length")).select(
        "file", (F.col("first") + F.col("i")).alias("doc_number"), (F.col("length") + F.when(F.col("i") == 0, F.col("carried")).otherwise(0)).alias("n_tokens"), F.lit(True).alias("ended")
    )
    whole = blocks.groupBy("file").agg(F.sum("n").alias("n"), F.max("separator").alias("separator"), F.sum(F.size("lengths")).alias("doc_number"))
    open_end = whole.withColumn("n_tokens", F.col("n") - 1 - F.coalesce("separator", F.lit(-1))).where("n_tokens > 0")
    return ended.union(open_end.select("file", "doc_number", "n_tokens", F.lit(False)))
