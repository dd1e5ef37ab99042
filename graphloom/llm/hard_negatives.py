"""Operator 11: hard negatives of anchors by threshold joins of inner products over an inverted index.

Components are integers (the floor of 256 times each), so scores are exact. A block of rows is indexed by
segments of dimensions in one global order (most energy first). A segment lists the rows whose suffix, from there
on, could still lift a score to the threshold; rows whose suffix norm already covers the rest are left out of it. Partial scores are
accumulated segment by segment; rows that no anchor can reach any more (partial score plus the product of the
remaining norms below the threshold) leave on the way, and the pairs that stay at the end are scored exactly. Thresholds start
high and go down, with the index growing to match, until the windows of an anchor are full or their lower end is reached.

Three joins of the anchors with all rows, in blocks: with the blocks of the own label for the positives; with one
block, which gives each window a lower bound for its last place; with all other blocks from that bound on. Every join is exact,
so the result does not depend on the blocks. Rows and anchors of a block meet in one task, rows first (a bounded number, kept as
narrow integers), then the anchors in a stream.

Rows without a label or vector, with a null or non-finite component, or so long that a score would not fit into a long
(squared norm of 2^63 or more) take no part. Missing components of shorter vectors count as 0; an empty vector scores 0. Repeated
rows stand for themselves: a copy of the anchor is another row. Ties go to the smaller id, rows without an id come last and are no anchors. An
empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.words import parts
from graphloom.session import scratch_path

#: Rows of a block at most; a task keeps the block's components as narrow integers.
BLOCK = 1 << 19
#: Rows and anchors that meet in one matrix.
SUB, CHUNK = 8192, 256
SEGMENTS = 8
#: Where thresholds stand between the lower and the upper end of a window, round by round.
ROUNDS = (0.75, 0.5, 0.25, 0.0)
SCALE = 256
_LOWEST = -(2.0**64)


def _share(score: np.ndarray, percent: int, up: bool) -> np.ndarray:
    """``percent`` of integer scores, rounded down or up, without overflow."""
    x = -score if up else score
    part = percent * (x // 100) + percent * (x % 100) // 100
    return -part if up else part


def _integers(column: pa.Array) -> tuple[list[bytes | None], np.ndarray]:
    """Vectors as narrow little-endian integers (None for those that take no part), and the energy of each dimension."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.nan_to_num(pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(float)).astype(np.int64)
    values = np.floor(SCALE * pc.fill_null(column.flatten().cast(pa.float64()), np.nan).to_numpy(zero_copy_only=False))
    at = np.concatenate([[0], np.cumsum(lengths)])
    energy = np.zeros(int(lengths.max(initial=0)))
    packed: list[bytes | None] = [None] * len(column)
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    for size in np.unique(lengths).tolist():
        rows = np.flatnonzero((lengths == size) & valid)
        with np.errstate(over="ignore", invalid="ignore"):
            x = values[at[rows][:, None] + np.arange(size)] if size else np.zeros((len(rows), 0))
            sound = np.isfinite(x).all(axis=1) & ((x * x).sum(axis=1) < 2.0**63)
        rows, x = rows[sound], x[sound]
        energy[:size] += (x * x).sum(axis=0)
        largest = np.abs(x).max(axis=1, initial=0)
        for kind, low, high in ((np.int16, -1, 2**15), (np.int32, 2**15, 2**31), (np.int64, 2**31, 2.0**64)):
            here = np.flatnonzero((largest >= low) & (largest < high))
            for i, raw in zip(rows[here].tolist(), x[here].astype(kind)):
                packed[i] = bytes([raw.itemsize]) + raw.tobytes()
    return packed, energy


def _matrix(packed: list[bytes], order: np.ndarray) -> np.ndarray:
    """Packed vectors as a matrix of integers with its dimensions in ``order``."""
    kinds = {2: np.int16, 4: np.int32, 8: np.int64}
    width = max((x[0] for x in packed), default=2)
    out = np.zeros((len(packed), len(order)), kinds[width])
    shapes = np.array([(x[0], len(x)) for x in packed]).reshape(-1, 2)
    for item, length in np.unique(shapes, axis=0).tolist():
        rows = np.flatnonzero((shapes == (item, length)).all(axis=1))
        raw = np.frombuffer(b"".join(packed[i][1:] for i in rows.tolist()), kinds[item])
        size = (length - 1) // item
        padded = np.zeros((len(rows), max(len(order), 1)), kinds[width])
        padded[:, :size] = raw.reshape(len(rows), size)
        out[rows] = padded[:, order] if len(order) else out[rows]
    return out


class Vectors:
    """Integer vectors with the norms of their suffixes by segment."""

    def __init__(self, x: np.ndarray, cuts: np.ndarray):
        self.x, self.cuts = x, cuts
        square = np.add.reduceat(x.astype(float) ** 2, cuts[:-1], axis=1) if x.size else np.zeros((len(x), len(cuts) - 1))
        rest = np.concatenate([np.cumsum(square[:, ::-1], axis=1)[:, ::-1], np.zeros((len(x), 1))], axis=1)
        self.rest = np.sqrt(rest)  # rest[i, s]: norm of vector i from segment s on

    def part(self, a: int, b: int) -> Vectors:
        out = object.__new__(Vectors)
        out.x, out.cuts, out.rest = self.x[a:b], self.cuts, self.rest[a:b]
        return out

    def numbers(self, exact: bool) -> np.ndarray:
        """Doubles where they hold every score exactly, else integers of 64 bits."""
        return self.x.astype(np.float64 if exact else np.int64)


class Search:
    """Partial scores of some anchors with the rows of a block."""

    def __init__(self, anchors: Vectors, rows: Vectors):
        self.q, self.r, self.cuts = anchors, rows, rows.cuts
        top = anchors.rest[:, 0].max(initial=0) * rows.rest[:, 0].max(initial=0)
        self.exact = bool(top < 2.0**53)
        self.slack = 1e-12 * top
        self.a, self.b = anchors.numbers(self.exact), rows.numbers(self.exact)
        self.score = np.zeros((len(self.a), len(self.b)), self.a.dtype)
        self.done = np.zeros(len(self.b), np.int64)  # segments that are accumulated, by row

    def above(self, active: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs (anchor, row, score) of the active anchors that reach their thresholds ``least``."""
        whole = len(active) == len(self.a)
        low, last = least.min() - self.slack, len(self.cuts) - 1
        reach = self.q.rest[active].max(axis=0)
        alive = np.arange(len(self.b))
        for s in range(last):
            covered = self.r.rest[alive, s] * reach[s] < low
            out = covered & (self.done[alive] == 0)  # the whole vector is too short
            rows = alive[(self.done[alive] == s) & ~covered]
            alive = alive[~out]
            if not len(rows):
                continue
            a, b = self.cuts[s], self.cuts[s + 1]
            if whole and len(rows) == len(self.b):
                self.score += self.a[:, a:b] @ self.b[:, a:b].T
            else:
                self.score[np.ix_(active, rows)] += self.a[active, a:b] @ self.b[rows, a:b].T
            self.done[rows] = s + 1
            if s + 1 < last and reach[s + 1] * self.r.rest[rows, s + 1].max() < low - self.slack + reach[0] * self.r.rest[rows, 0].max() * 0.5:
                bound = self.score[np.ix_(active, rows)] + self.q.rest[active, s + 1][:, None] * self.r.rest[rows, s + 1][None, :]
                lost = rows[(bound < least[:, None] - self.slack).all(axis=0)]
                alive = np.setdiff1d(alive, lost, assume_unique=True)
        score = self.score if whole and len(alive) == len(self.b) else self.score[np.ix_(active, alive)]
        bound = score + self.q.rest[active][:, self.done[alive]] * self.r.rest[alive, self.done[alive]][None, :]
        i, j = np.nonzero(bound >= least[:, None] - self.slack)
        anchor, row, found = active[i], alive[j], score[i, j]
        for s in range(last):  # what the index leaves out of these pairs
            open_ = np.flatnonzero(self.done[row] <= s)
            for part in np.array_split(open_, len(open_) // 500_000 + 1):
                a, b = self.cuts[s], self.cuts[s + 1]
                found[part] += (self.a[anchor[part], a:b] * self.b[row[part], a:b]).sum(axis=1)
        keep = found >= least[i]
        return anchor[keep], row[keep], found[keep].astype(np.int64)


def _first(keys: tuple[np.ndarray, ...], score: np.ndarray, row: np.ndarray, k: int) -> np.ndarray:
    """Where the ``k`` highest scores of each key stand, ties by row."""
    order = np.lexsort((row, -score, *reversed(keys)))
    new = np.zeros(len(order), bool)
    new[:1] = True
    for key in keys:
        new[1:] |= key[order][1:] != key[order][:-1]
    first = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0)) if len(order) else np.zeros(0, np.int64)
    return order[np.arange(len(order)) - first < k]


def fill(anchors: Vectors, rows: Vectors, low: np.ndarray, high: np.ndarray, k: int, rounds: np.ndarray, allowed) -> tuple[np.ndarray, ...]:
    """The ``k`` best allowed rows in each window ``low..high`` (anchors x windows, ``low > high`` for none).

    ``rounds`` (anchors x rounds) are falling thresholds; ``allowed(anchor, row)`` tells which pairs count. Gives
    anchor, window, row and score of what is found. A window is full when k rows reach the threshold of the round.
    """
    search = Search(anchors, rows)
    active = np.flatnonzero((low <= high).any(axis=1))
    out: list[tuple[np.ndarray, ...]] = []
    for r in range(rounds.shape[1]):
        if not len(active):
            break
        least = rounds[active, r]
        a, b, score = search.above(active, least)
        pick = allowed(a, b)
        a, b, score = a[pick], b[pick], score[pick]
        full = np.ones(len(rounds), bool)
        found = []
        for w in range(low.shape[1]):
            inside = np.flatnonzero((score >= low[a, w]) & (score <= high[a, w]))
            best = inside[_first((a[inside],), score[inside], b[inside], k)]
            full &= (np.bincount(a[best], minlength=len(full)) >= k) | (low[:, w] > high[:, w])
            found.append((a[best], np.full(len(best), w), b[best], score[best]))
        full |= rounds[:, min(r, rounds.shape[1] - 1)] <= rounds[:, -1]
        out += [tuple(x[full[f[0]]] for x in f) for f in found]
        active = active[~full[active]]
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 4


# --- Spark ----------------------------------------------------------------------------------------------------


def _written(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def prepared(vectors: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """Rows that take part as ``uid, id, label, anchor, v``, and the order of dimensions by falling energy."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed, _ = _integers(batch.column("vector"))
            rows = np.flatnonzero([x is not None for x in packed])
            arrays = [batch.column(c).take(pa.array(rows)) for c in ("uid", "id", "label", "anchor")]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array([packed[i] for i in rows.tolist()], pa.binary())], ["uid", "id", "label", "anchor", "v"])

    def energies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0)
        for batch in batches:
            _, energy = _integers(batch.column("vector"))
            size = max(len(total), len(energy))
            total = np.pad(total, (0, size - len(total))) + np.pad(energy, (0, size - len(energy)))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["dim", "energy"])

    part = vectors.where(F.col("label").isNotNull() & F.col("vector").isNotNull()).withColumn("uid", F.monotonically_increasing_id())
    part = part.withColumn("anchor", F.coalesce(F.col("anchor"), F.lit(False)) & F.col("id").isNotNull())
    rows = _written(part.mapInArrow(pack, "uid long, id long, label long, anchor boolean, v binary"), "vectors")
    found = part.select("vector").mapInArrow(energies, "dim long, energy double").groupBy("dim").agg(F.sum("energy").alias("energy")).collect()
    order = np.array([r["dim"] for r in sorted(found, key=lambda r: (-r["energy"], r["dim"]))], np.int64)
    return rows, order


_MEMBER = ("major", "minor", "kind", "uid", "id", "label", "v", "p", "least")
_FOUND = "anchor long, p long, uid long, id long, score long"


def _joined(rows: DataFrame, anchors: DataFrame, order: np.ndarray, each) -> DataFrame:
    """``each(anchor batch, anchor vectors, row columns, row vectors)`` for all anchors and rows of equal (major, minor)."""
    cuts = np.unique(np.linspace(0, len(order), SEGMENTS + 1).astype(np.int64)) if len(order) else np.array([0, 0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, block = None, [], None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            values = np.stack([batch.column(c).to_numpy() for c in ("major", "minor", "kind")])
            edges = [0, *(np.flatnonzero((values[:, 1:] != values[:, :-1]).any(axis=0)) + 1).tolist(), n]
            for a, b in zip(edges, edges[1:]):
                if key != (values[0, a], values[1, a]):
                    key, held, block = (values[0, a], values[1, a]), [], None
                piece = batch.slice(a, b - a)
                if values[2, a] == 0:
                    held.append(piece)
                    continue
                if not held:
                    continue
                if block is None:
                    table = pa.Table.from_batches(held).combine_chunks()
                    columns = {c: table.column(c).combine_chunks() for c in ("uid", "id", "label")}
                    block = columns, Vectors(_matrix(table.column("v").to_pylist(), order), cuts)
                for c in range(0, piece.num_rows, CHUNK):
                    some = piece.slice(c, CHUNK)
                    out = each(some, Vectors(_matrix(some.column("v").to_pylist(), order), cuts), *block)
                    if out.num_rows:
                        yield out

    both = rows.select(*_MEMBER).unionByName(anchors.select(*_MEMBER))
    dealt = both.repartition(parts(rows.sparkSession), "major", "minor")
    return dealt.sortWithinPartitions("major", "minor", "kind", F.col("id").asc_nulls_last(), "uid").mapInArrow(run, _FOUND)


def _as_rows(df: DataFrame) -> DataFrame:
    none = F.lit(None).cast("array<long>")
    return df.withColumns({"kind": F.lit(0), "p": none, "least": none})


def _result(some: pa.RecordBatch, columns: dict, anchor: np.ndarray, p: np.ndarray, row: np.ndarray, score: np.ndarray) -> pa.RecordBatch:
    pick = pa.array(row)
    arrays = [some.column("uid").take(pa.array(anchor)), pa.array(p), columns["uid"].take(pick), columns["id"].take(pick), pa.array(score)]
    return pa.RecordBatch.from_arrays(arrays, ["anchor", "p", "uid", "id", "score"])


def _by_parts(anchors: Vectors, rows: Vectors, low, high, k, rounds, allowed) -> tuple[np.ndarray, ...]:
    """:func:`fill` over a block in sub-blocks; the best of all."""
    got = []
    for at in range(0, len(rows.x), SUB):
        a, w, b, score = fill(anchors, rows.part(at, at + SUB), low, high, k, rounds, lambda a, b, at=at: allowed(a, b + at))
        got.append((a, w, b + at, score))
    a, w, b, score = (np.concatenate(x) for x in zip(*got))
    best = _first((a, w), score, b, k)
    return a[best], w[best], b[best], score[best]


def _best(found: DataFrame, k: int) -> DataFrame:
    """Of each anchor and window the ``k`` best, with their ``rank``; Spark keeps k of each before the shuffle."""
    order = Window.partitionBy("anchor", "p").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last(), "uid")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def nearest_of_label(rows: DataFrame, order: np.ndarray, k: int) -> DataFrame:
    """``anchor, uid, id, score, rank``: of each anchor the ``k`` best other rows of its label."""
    sizes = rows.groupBy("label").agg(F.ceil(F.count("*") / F.lit(min(BLOCK, 4 * SUB))).cast("long").alias("minors"))
    keyed = rows.join(sizes, "label").withColumn("major", F.col("label"))
    members = _as_rows(keyed.withColumn("minor", F.pmod(F.xxhash64("uid"), "minors")))
    none = F.lit(None).cast("array<long>")
    anchors = keyed.where("anchor").withColumn("minor", F.explode(F.sequence(F.lit(0).cast("long"), F.col("minors") - 1)))
    anchors = anchors.withColumns({"kind": F.lit(1), "p": none, "least": none})

    def each(some, q, columns, block):
        n = len(q.x)
        mine, theirs = some.column("uid").to_numpy(), columns["uid"].to_numpy()
        top = q.rest[:, 0] * block.rest[:, 0].max(initial=0)
        rounds = np.stack([top * f for f in ROUNDS[:-1]] + [np.full(n, _LOWEST)], axis=1)
        low, high = np.full((n, 1), -(2**63)), np.full((n, 1), 2**63 - 1)
        a, _, b, score = _by_parts(q, block, low, high, k, rounds, lambda a, b: mine[a] != theirs[b])
        return _result(some, columns, a, np.zeros(len(a), np.int64), b, score)

    return _best(_joined(members, anchors, order, each), k)


def mine(vectors: DataFrame, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """Hard negatives in ``vectors(id, label, vector, anchor)``, see the module.

    For each anchor and each of its best ``positives`` other rows of its label: the first ``negatives`` rows of other
    labels whose score lies between ``low`` and ``high`` percent of the positive's. Gives ``anchor_id, positive_id,
    rank, negative_id, positive_score, negative_score``.
    """
    rows, order = prepared(vectors)
    spark = rows.sparkSession
    n_blocks = max(3 * parts(spark), -(-rows.count() // BLOCK))
    positive = _written(nearest_of_label(rows, order, positives).select("anchor", F.col("uid").alias("positive"), F.col("id").alias("positive_id"), "score"), "positives")
    windows = positive.where("score >= 0").select("anchor", F.col("score").alias("p")).distinct()
    block = F.pmod(F.xxhash64("uid", F.lit(1)), F.lit(n_blocks)).cast("long")
    members = _as_rows(rows.withColumns({"major": block, "minor": F.lit(0).cast("long")}))
    anchors = rows.where("anchor").withColumns({"home": block, "minor": F.lit(0).cast("long"), "kind": F.lit(1)})

    def each(some, q, columns, block):
        n = len(q.x)
        label, theirs = some.column("label").to_numpy(), columns["label"].to_numpy()
        ps, leasts = some.column("p").to_pylist(), some.column("least").to_pylist()
        width = max(map(len, ps))
        p, lo, hi = np.zeros((n, width), np.int64), np.ones((n, width), np.int64), np.zeros((n, width), np.int64)
        known = True
        for i, (own, least) in enumerate(zip(ps, leasts)):
            m = len(own)
            p[i, :m] = own
            lo[i, :m], hi[i, :m] = _share(p[i, :m], low, True), _share(p[i, :m], high, False)
            known &= least is not None
            if least is not None:
                lo[i, :m] = np.maximum(lo[i, :m], [-1 if x is None else x for x in least])
        real = lo <= hi
        bottom = np.where(real, lo, 2**62).min(axis=1).astype(float)
        top = np.where(real, hi, 0).max(axis=1).astype(float)
        rounds = np.stack([bottom + f * (top - bottom) for f in (ROUNDS[-1:] if known else ROUNDS)], axis=1)
        a, w, b, score = _by_parts(q, block, lo, hi, negatives, rounds, lambda a, b: label[a] != theirs[b])
        return _result(some, columns, a, p[a, w], b, score)

    asked = anchors.join(windows.groupBy(F.col("anchor").alias("uid")).agg(F.sort_array(F.collect_list("p")).alias("p")), "uid")
    first = asked.withColumns({"major": F.col("home"), "least": F.lit(None).cast("array<long>")})
    seeds = _written(_best(_joined(members, first, order, each), negatives).drop("rank"), "seeds")
    reached = seeds.groupBy("anchor", "p").agg(F.count("*").alias("n"), F.min("score").alias("s"))
    reached = windows.join(reached, ["anchor", "p"], "left").select("anchor", "p", F.when(F.col("n") >= negatives, F.col("s")).alias("s"))
    reached = reached.groupBy(F.col("anchor").alias("uid")).agg(F.sort_array(F.collect_list(F.struct("p", "s"))).alias("w"))
    second = anchors.join(reached, "uid").withColumns({"p": F.col("w.p"), "least": F.col("w.s")})
    second = second.withColumn("major", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))).where("major <> home")
    second = second.withColumn("major", F.col("major").cast("long"))
    found = _best(_joined(members, second, order, each).unionByName(seeds), negatives)
    names = rows.where("anchor").select(F.col("uid").alias("anchor"), F.col("id").alias("anchor_id"))
    pairs = positive.withColumn("p", F.col("score")).join(found.select("anchor", "p", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score")), ["anchor", "p"])
    return pairs.join(names, "anchor").select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", F.col("score").alias("positive_score"), "negative_score")


def relabelled(every: int, labels: int) -> Column:
    """``label``, moved on by one modulo ``labels`` where ``every`` divides ``vec_id``."""
    label = F.col("label").cast("long")
    return F.when(F.col("vec_id") % every == 0, (label + 1) % labels).otherwise(label)


def mine_embeddings(embeddings: DataFrame) -> DataFrame:
    """Hard negatives of the embeddings whose ``vec_id`` is divisible by 50."""
    return mine(embeddings.select(F.col("vec_id").cast("long").alias("id"), relabelled(7, 10).alias("label"), F.col("embedding").alias("vector"), (F.col("vec_id") % 50 == 0).alias("anchor")))


SQL = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
s AS (
  SELECT a.r AS anchor, a.vec_id AS anchor_id, b.r AS other, b.vec_id AS other_id, a.label = b.label AS same, list_inner_product(a.x, b.x)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.r <> b.r
),
p AS (
  SELECT anchor, anchor_id, other AS positive, other_id AS positive_id, score AS positive_score
  FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, other_id NULLS LAST, other) <= 5
)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor, positive ORDER BY score DESC, other_id NULLS LAST, other)::INTEGER AS rank,
  other_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN (SELECT anchor, other, other_id, score FROM s WHERE NOT same) n USING (anchor)
WHERE 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor, positive ORDER BY score DESC, other_id NULLS LAST, other) <= 3
"""
