"""Operator 5: a quality classifier from weak labels.

Heuristic labellers look at each text and vote good, poor, or not at all. Votes of all documents are counted by pattern (there are
3 ^ labellers patterns at most, whatever the input, and a handful in practice); expectation-maximisation over the counts estimates how often each
labeller votes how for good and for poor documents, and the share of good ones. The posterior of a pattern labels its
documents, and the posterior labels train a linear scorer over hashed byte trigrams, which also judges what no labeller
speaks about.

Votes, counts and scores cover all documents. The scorer is fitted on at most ``sample`` different texts, those with the smallest
digests, half of them from either side of the posterior: a bounded sample, as its fit does not gain from more. Digests are
counted by their logarithm, which tells below which value each half lies; only texts below it leave their tasks, copies once.

Empty cases: a null or empty text has no words; the labellers find it poor, and its score is 0. Repeated rows and rows without ``doc_id`` vote and get a
result row each. Without any fault found in the corpus all posteriors are good.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from graphloom.llm.words import Words, mix, shingles, steps, text_bytes
from graphloom.session import scratch_path

GOOD, POOR, NONE = 1, 0, 2
LABELLERS = ["symbols", "marked", "letters", "endings", "capitals", "repeats", "variety", "pairs", "triples", "sentences", "bars", "length", "word_size"]
DIMENSIONS = 1 << 16
SAMPLE = 8_000
STEPS = 150


def _bytes(chars: str) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(chars.encode())] = True
    return table


def votes(words: Words) -> np.ndarray:
    """One row for each text, one column for each labeller."""
    at, n = words.text_at, words.counts()

    def share(table: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(table[words.data])])
        return total[at[1:]] - total[at[:-1]]

    size = np.maximum(np.diff(at), 1)
    h, text = words.hashes(), words.text_of()
    some = np.maximum(n, 1)
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (text[1:] == text[:-1])
    repeats = np.bincount(text[same], minlength=len(n)) / some
    distinct = np.unique(h ^ mix(text.astype(np.uint64) + np.uint64(1)), return_index=True)[1]
    variety = np.bincount(text[distinct], minlength=len(n)) / np.minimum(some, 200)

    def repeated(length: int) -> np.ndarray:
        """Share of the runs of ``length`` words that the text has had before."""
        grams, ranges = shingles(h, words.offsets, length)
        owner = np.repeat(np.arange(len(n)), np.diff(ranges))
        first = np.unique(grams ^ mix(owner.astype(np.uint64) + np.uint64(1)), return_index=True)[1]
        total = np.maximum(np.diff(ranges), 1)
        return np.where(np.diff(ranges) > 0, 1 - np.bincount(owner[first], minlength=len(n)) / total, 0)

    per_word = lambda table: np.bincount(text[np.add.reduceat(np.append(table[words.data], False), np.stack([words.starts, words.ends], 1).ravel())[::2] > 0] if len(h) else text, minlength=len(n)) / some
    letter = _bytes("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
    letter[128:] = True
    plain_end = letter | _bytes(".,;:?0123456789)'\"")
    endings = np.bincount(text[~plain_end[words.data[words.ends - 1]]], minlength=len(n)) / some
    filled = ~_bytes(" \t\n\r\v\f")
    closing = _bytes(".!?")
    ends = np.bincount(text[closing[words.data[words.ends - 1]]], minlength=len(n)) / some
    capitals = share(_bytes("ABCDEFGHIJKLMNOPQRSTUVWXYZ")) / np.maximum(share(_bytes("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")), 1)
    rules = [
        (share(_bytes("#*$%&<>")) / size, 0.01, 0.04),
        (per_word(_bytes("#*$%&<>|")), 0.05, 0.25),
        (1 - share(letter) / np.maximum(share(filled), 1), 0.06, 0.15),
        (endings, 0.05, 0.25),
        (capitals, 0.2, 0.5),
        (repeats, 0.05, 0.3),
        (-variety, -0.35, -0.2),
        (repeated(2), 0.3, 0.6),
        (repeated(3), 0.15, 0.5),
        (-ends, -0.02, -0.005),
        (share(_bytes("|")) / some, 0.05, 0.3),
        (-n.astype(float), -50, -20),
        (np.abs(np.diff(at) / some - 7), 4, 8),
    ]
    out = np.stack([np.where(value <= good, GOOD, np.where(value > poor, POOR, NONE)) for value, good, poor in rules], axis=1)
    out[n == 0] = POOR
    return out


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, np.ndarray, float]:
    """Posterior of good for each pattern of votes; for each labeller the chances of its votes for poor and good documents; share of good ones."""
    # to begin with: a labeller that finds a fault is believed, as faults seldom come together
    posterior = np.where((patterns == POOR).any(1), 0.1, 0.9)
    # votes of a labeller that hardly votes carry a little prior weight
    chance = np.zeros((2, patterns.shape[1], 3))
    prior = 0.5
    for _ in range(rounds):
        for c, weight in enumerate((counts * (1 - posterior), counts * posterior)):
            for v in range(3):
                chance[c, :, v] = ((patterns == v) * weight[:, None]).sum(0) + 0.5
            chance[c] /= chance[c].sum(1, keepdims=True)
        prior = float(np.clip((counts * posterior).sum() / counts.sum(), 0.01, 0.99))
        log = np.log([1 - prior, prior])[:, None] + np.log(chance[:, np.arange(patterns.shape[1]), patterns]).sum(2)
        new = 1 / (1 + np.exp(np.clip(log[0] - log[1], -50, 50)))
        if np.abs(new - posterior).max() < 1e-9:
            break
        posterior = new
    return posterior, chance, prior


def features(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed features of each text, their weights (which sum to about 2), and ranges by text.

    Byte trigrams with A-Z folded and digits alike, by share; whether a word repeats the one before; and runs of capitals, marked apart.
    """
    fold = np.arange(256, dtype=np.uint64)
    fold[48:58] = 48
    data = words.data
    upper = (data >= 65) & (data <= 90)
    x = fold[np.where(upper, data + 32, data)]
    n = len(x)
    text = np.repeat(np.arange(len(words.text_at) - 1), np.diff(words.text_at))
    gram = x.copy()
    gram[2:] = x[:-2] << np.uint64(16) | x[1:-1] << np.uint64(8) | x[2:]
    loud = np.zeros(n, bool)
    loud[2:] = upper[:-2] & upper[1:-1] & upper[2:]
    gram |= loud.astype(np.uint64) << np.uint64(40)
    whole = np.zeros(n, bool)
    whole[2:] = text[2:] == text[:-2]
    h = words.hashes()
    word_text = words.text_of()
    same = np.zeros(len(h), np.uint64)
    same[1:] = (h[1:] == h[:-1]) & (word_text[1:] == word_text[:-1])
    index = np.concatenate([mix(gram[whole]), mix(same + np.uint64(1 << 50))]) % np.uint64(DIMENSIONS)
    owner = np.concatenate([text[whole], word_text])
    weight = np.concatenate([1 / np.bincount(text[whole], minlength=1)[text[whole]], 1 / np.maximum(words.counts(), 1)[word_text]])
    key = owner.astype(np.int64) * DIMENSIONS + index.astype(np.int64)
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    total = np.add.reduceat(weight[order], first) if len(first) else np.zeros(0)
    return key[first] % DIMENSIONS, total, np.searchsorted(key[first] // DIMENSIONS, np.arange(len(words.text_at)))


def _sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(values)])
    return total[at[1:]] - total[at[:-1]]


def fit(index: np.ndarray, weight: np.ndarray, at: np.ndarray, label: np.ndarray, importance: np.ndarray) -> np.ndarray:
    """Weights of a logistic scorer (the last one is the bias) by Adam over the whole sample."""
    w, m, v = (np.zeros(DIMENSIONS + 1) for _ in range(3))
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    for step in range(1, STEPS + 1):
        p = 1 / (1 + np.exp(-np.clip(_sums(w[index] * weight, at) + w[-1], -50, 50)))
        error = importance * (p - label)
        g = np.append(np.bincount(index, weights=weight * error[row], minlength=DIMENSIONS), error.sum()) / importance.sum() + 1e-6 * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.3 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w


def digests(column: pa.Array) -> np.ndarray:
    """A digest of 63 bits for each text."""
    data, at = text_bytes(column)
    raw = memoryview(np.ascontiguousarray(data))
    return np.array([xxhash.xxh3_64_intdigest(raw[a:b]) >> 1 for a, b in zip(at.tolist(), at[1:].tolist())], np.int64)


def ranges(digest: np.ndarray) -> np.ndarray:
    """Range of a digest: at most 16,129 ranges, whose bounds grow by 0.3 % each."""
    return np.floor(256 * np.log2(digest + 1.0)).astype(np.int32)


def score(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``docs`` with ``n_good``, ``n_poor`` (votes), ``posterior`` (of the votes) and ``quality`` (the scorer's, 0 to 1)."""
    spark = docs.sparkSession
    k = len(LABELLERS)
    base = 3 ** np.arange(k)

    def vote(batches):
        for step in steps(batches):
            digest = digests(step.column("text"))
            arrays = [pa.array(votes(Words(step.column("text"))) @ base, pa.int32()), pa.array(digest), pa.array(ranges(digest))]
            yield pa.RecordBatch.from_arrays(arrays, ["code", "digest", "range"])

    path = scratch_path(spark, "votes")
    docs.select("text").mapInArrow(vote, "code int, digest long, range int").write.parquet(path)
    voted = spark.read.parquet(path)
    counted = voted.groupBy("code").count().toArrow()
    code, count = counted.column("code").to_numpy(), counted.column("count").to_numpy().astype(float)
    table = np.full(3**k, 0.5)
    if len(code):
        patterns = code[:, None] // base % 3
        table[code] = estimate(patterns, count)[0]
    labels = spark.sparkContext.broadcast(table)

    def sided(batches):
        for batch in batches:
            side = labels.value[batch.column("code").to_numpy()] >= 0.5
            yield pa.RecordBatch.from_arrays([batch.column("range"), pa.array(side.astype(np.int8))], ["range", "side"])

    different = voted.groupBy("digest").agg(F.min("code").alias("code"), F.min("range").alias("range"))
    held = different.select("code", "range").mapInArrow(sided, "range int, side byte").groupBy("side", "range").count().toArrow()
    last = np.full(2, -1)
    for side in (0, 1):
        mine = held.column("side").to_numpy() == side
        at, n = held.column("range").to_numpy()[mine], held.column("count").to_numpy()[mine]
        order = np.argsort(at)
        if len(order):
            enough = int(np.searchsorted(np.cumsum(n[order]), sample // 2))
            last[side] = at[order][min(enough, len(order) - 1)]

    def describe(batches):
        seen: set[int] = set()
        for step in steps(batches):
            digest = digests(step.column("text"))
            near = np.flatnonzero(ranges(digest) <= last.max())
            near = np.array([i for i in near.tolist() if not (digest[i] in seen or seen.add(digest[i]))], np.int64)
            if not len(near):
                continue
            words, digest = Words(step.column("text").take(pa.array(near))), digest[near]
            posterior = labels.value[votes(words) @ base]
            side = (posterior >= 0.5).astype(np.int8)
            index, weight, at = features(words)
            lists = lambda x: pa.array([x[a:b].tobytes() for a, b in zip(at, at[1:])], pa.binary())
            arrays = [pa.array(digest), pa.array(side), pa.array(posterior), lists(index.astype(np.int32)), lists(weight.astype(np.float32))]
            batch = pa.RecordBatch.from_arrays(arrays, ["digest", "side", "posterior", "index", "weight"])
            yield batch.filter(pa.array(ranges(digest) <= last[side]))

    drawn = docs.select("text").mapInArrow(describe, "digest long, side byte, posterior double, index binary, weight binary").dropDuplicates(["digest"])
    rows = drawn.toArrow().sort_by("digest")
    side = rows.column("side").to_numpy()
    rows = rows.take(pa.array(np.sort(np.concatenate([np.flatnonzero(side == s)[: sample // 2] for s in (0, 1)]))))
    fitted = np.zeros(DIMENSIONS + 1)
    if rows.num_rows:
        index = [np.frombuffer(x, np.int32) for x in rows.column("index").to_pylist()]
        weight = [np.frombuffer(x, np.float32) for x in rows.column("weight").to_pylist()]
        label = rows.column("posterior").to_numpy()
        at = np.concatenate([[0], np.cumsum([len(x) for x in index])])
        sides = np.maximum(np.bincount((label >= 0.5).astype(int), minlength=2), 1)
        fitted = fit(np.concatenate(index).astype(np.int64), np.concatenate(weight), at, label, 1 / sides[(label >= 0.5).astype(int)])
    scorer = spark.sparkContext.broadcast(fitted)
    schema = StructType([*docs.schema.fields, StructField("n_good", IntegerType()), StructField("n_poor", IntegerType()), StructField("posterior", DoubleType()), StructField("quality", DoubleType())])
    if len(set(schema.names)) < len(schema.names):
        raise ValueError("the table has a column named n_good, n_poor, posterior or quality")

    def judge(batches):
        for step in steps(batches):
            words = Words(step.column("text"))
            v = votes(words)
            index, weight, at = features(words)
            w = scorer.value
            quality = 1 / (1 + np.exp(-np.clip(_sums(w[index] * weight, at) + w[-1], -50, 50)))
            quality[words.counts() == 0] = 0
            arrays = [pa.array((v == GOOD).sum(1), pa.int32()), pa.array((v == POOR).sum(1), pa.int32()), pa.array(labels.value[v @ base]), pa.array(quality)]
            yield pa.RecordBatch.from_arrays([*step.columns, *arrays], schema.names)

    return docs.mapInArrow(judge, schema)
