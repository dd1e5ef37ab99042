"""The nearest of any number of targets for any number of vectors, by cosine."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TARGETS_PER_BLOCK = 2_048
VECTORS_PER_CHUNK = 32_768
_STRIP = 2_048


def _rows(column: pa.ChunkedArray) -> np.ndarray:
    """Vectors as a matrix; missing ones and missing components are zero."""
    lists = column.combine_chunks().to_pylist()
    width = max((len(x) for x in lists if x is not None), default=0)
    out = np.zeros((len(lists), width))
    for i, x in enumerate(lists):
        if x:
            out[i, : len(x)] = [0.0 if v is None else v for v in x]
    return out


def nearest_target(
    vectors: DataFrame, vector: str, targets: DataFrame, target: str, target_vector: str, keep: Sequence[str],
    targets_per_block: int = TARGETS_PER_BLOCK, vectors_per_chunk: int = VECTORS_PER_CHUNK,
) -> DataFrame:
    """The ``keep`` columns of every row of ``vectors`` with its nearest ``target`` and their ``score``.

    Vectors are dealt to chunks and targets to blocks, and every chunk meets every block in a cell of bounded size: one
    matrix product, of which a row for each vector leaves the task. Nothing is collected and neither side is broadcast.
    Ties go to the smaller target; a missing or zero vector scores 0 with all. Repeated rows stay.
    """
    n_targets, n_vectors = targets.count(), vectors.count()
    blocks, chunks = max(-(-n_targets // targets_per_block), 1), max(-(-n_vectors // vectors_per_chunk), 1)
    left = vectors.select(*keep, F.col(vector).alias("_v"), F.monotonically_increasing_id().alias("_id"))
    left = left.withColumn("_i", F.pmod(F.xxhash64("_id"), F.lit(chunks)).cast("int")).withColumn("_j", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = targets.select(F.col(target).alias("_t"), F.col(target_vector).alias("_w"))
    right = right.withColumn("_j", F.pmod(F.xxhash64("_t"), F.lit(blocks)).cast("int")).withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    kept = [f for f in left.schema.fields if f.name in (*keep, "_id")]
    kind = right.schema["_t"].dataType
    schema = T.StructType([*kept, T.StructField("_t", kind), T.StructField("_s", T.DoubleType())])

    def best(l: pa.Table, r: pa.Table) -> pa.Table:
        columns = [l.column(f.name) for f in kept]
        if not l.num_rows or not r.num_rows:
            return pa.table({**{f.name: c.slice(0, 0) for f, c in zip(kept, columns)}, "_t": r.column("_t").slice(0, 0), "_s": pa.array([], pa.float64())})
        r = r.sort_by("_t")
        w, v = _rows(r.column("_w")), _rows(l.column("_v"))
        size = max(w.shape[1], v.shape[1])
        w, v = (np.pad(x, ((0, 0), (0, size - x.shape[1]))) for x in (w, v))
        norms = np.linalg.norm(w, axis=1)
        at, score = np.zeros(len(v), np.int64), np.zeros(len(v))
        for a in range(0, len(v), _STRIP):
            part = v[a : a + _STRIP]
            lengths = np.linalg.norm(part, axis=1)[:, None] * norms
            similar = np.divide(part @ w.T, lengths, out=np.zeros(lengths.shape), where=lengths > 0)
            at[a : a + _STRIP] = similar.argmax(axis=1)
            score[a : a + _STRIP] = similar.max(axis=1)
        return pa.table(dict(zip([f.name for f in kept], columns)) | {"_t": r.column("_t").take(pa.array(at)), "_s": pa.array(score)})

    found = left.groupBy("_i", "_j").cogroup(right.groupBy("_i", "_j")).applyInArrow(best, schema)
    first = F.min(F.struct((-F.col("_s")).alias("_s"), "_t")).alias("_b")
    joined = found.groupBy("_id").agg(first, *[F.first(c).alias(c) for c in keep])
    return joined.select(*keep, F.col("_b._t").alias("target"), (-F.col("_b._s")).alias("score"))
