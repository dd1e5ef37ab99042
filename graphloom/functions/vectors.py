"""Similarity of texts and vectors to a small, fixed list of targets."""

from __future__ import annotations

import json
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Accented Latin letters and their base letters.
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyy"

BEST = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("back", T.IntegerType())])
_GRAM_TARGETS = "array<struct<grams: map<string, double>, norm: double>>"
_TARGET_BYTES_PER_CALL = 32 * 1024 * 1024


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two numeric arrays in double; 0 where a norm is 0. For pairs already side by side."""

    def dot(x: Column, y: Column) -> Column:
        products = F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double"))
        return F.aggregate(products, F.lit(0.0), lambda s, v: s + v)

    return F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), F.lit(0.0))


def character_grams(text: Column, size: int = 3) -> Column:
    """Character n-grams of a text in lower case without accents, words set off by spaces."""
    plain = F.regexp_replace(F.translate(F.lower(text), ACCENTED, PLAIN), "[^a-z0-9]+", " ")
    padded = F.concat(F.lit(" "), F.trim(plain), F.lit(" "))
    starts = F.sequence(F.lit(1), F.greatest(F.length(padded) - (size - 1), F.lit(1)))
    return F.transform(starts, lambda i: F.substring(padded, i, F.lit(size)))


def gram_counts(grams: Column) -> Column:
    """Distinct grams with their counts, as an array of structs."""
    return F.transform(
        F.array_distinct(grams),
        lambda g: F.struct(g.alias("gram"), F.size(F.filter(grams, lambda x: x == g)).cast("double").alias("n")),
    )


def gram_norm(counts: Column) -> Column:
    return F.sqrt(F.aggregate(counts, F.lit(0.0), lambda s, x: s + x["n"] * x["n"]))


def best_by_grams(text: Column, targets: Sequence[tuple[dict[str, float], float]]) -> Column:
    """``BEST`` struct of the closest target, each given as gram counts and norm.

    The targets are literals of the plan, so every row is scored in place: no join and no shuffle.
    """
    counts = gram_counts(character_grams(text))
    norm = gram_norm(counts)
    # one literal that the optimizer folds, instead of a literal per gram
    listed = F.from_json(F.lit(json.dumps([{"grams": g, "norm": n} for g, n in targets])), _GRAM_TARGETS)

    def score(target: Column, at: Column) -> Column:
        dot = F.aggregate(counts, F.lit(0.0), lambda s, x: s + x["n"] * F.coalesce(F.try_element_at(target["grams"], x["gram"]), F.lit(0.0)))
        # the larger ``back`` (the earlier target) wins a tie
        return F.struct(F.coalesce(F.try_divide(dot, norm * target["norm"]), F.lit(0.0)).alias("score"), (-at).alias("back"))

    return F.array_max(F.transform(listed, score))


def _nearest_udf(targets: np.ndarray, first: int):
    norms = np.linalg.norm(targets, axis=1)

    @F.arrow_udf(BEST)
    def nearest(vectors: pa.Array) -> pa.Array:
        mask = vectors.is_null().to_numpy(zero_copy_only=False)
        known = vectors.filter(pa.array(~mask))
        score, back = np.zeros(len(mask)), np.full(len(mask), -first, np.int32)
        if len(known):
            rows = known.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(known), -1)
            lengths = np.linalg.norm(rows, axis=1)[:, None] * norms
            similarity = np.divide(rows @ targets.T, lengths, out=np.zeros(lengths.shape), where=lengths > 0)
            at = similarity.argmax(axis=1)
            score[~mask] = similarity[np.arange(len(at)), at]
            back[~mask] = -(first + at).astype(np.int32)
        return pa.StructArray.from_arrays([pa.array(score), pa.array(back)], ["score", "back"])

    # a filter on the score must not repeat the product below the projection
    return nearest.asNondeterministic()


def best_by_vectors(vector: Column, targets: Sequence[Sequence[float]]) -> Column:
    """``BEST`` struct of the closest target vector by cosine; the earlier target wins a tie.

    The targets travel with the plan, one matrix product per Arrow batch; a long list is cut into several
    calls whose winners are compared.
    """
    matrix = np.asarray(targets, dtype=np.float64)
    per_call = max(1, _TARGET_BYTES_PER_CALL // max(matrix[:1].nbytes, 1))
    found = [_nearest_udf(matrix[i : i + per_call], i)(vector) for i in range(0, len(matrix), per_call)]
    return found[0] if len(found) == 1 else F.array_max(F.array(*found))
