"""Operator 12: exact links of near duplicates found by a forest of chosen paths.

A set is the distinct shingles of a text; sets that are equal are one class throughout. Each class has ``COORDINATES``
minwise tokens. A tree branches its nodes: a node chooses ``BRANCHES`` coordinates by a hash of its path, and the
members of a node that agree on the minwise token of a coordinate go on together into a child. As ``BRANCHES`` times the
threshold is above one, a pair of similar sets keeps some common path however deep a tree grows, and a pair of unlike sets
loses all. Nodes of up to ``SMALL`` members are compared exhaustively by their minwise tokens, larger ones compare
with a few pivots: who is near one is tied to it and leaves, the others branch on. Trees are independent, and as many are
grown as the target of recall needs (:func:`trees_for`). What is still large at ``DEPTH`` is compared exhaustively in cells.

So far nothing is decided: pairs that may link only tie classes into groups. In a group all full sets are
compared exactly, each with each but where the triangle inequality of the Jaccard distance (or an earlier link) already
tells the outcome. A group too large for a task is first compared with pivots by all tasks; members whose links are all known
through a pivot leave, and what stays large is compared in cells of bounded size. No pair is ever a row but for
links of a spanning forest.

Empty cases: a text without words (or null, or empty) has an empty set, links with nothing and is its own component. A
row without ``doc_id`` takes part, but cannot name a component; where all of a component lack it, ``component_id`` is
null and they are kept. Repeated rows give a result row each. Other columns are not read. No rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log, sqrt

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.components import components
from graphloom.llm.words import Words, groups, mix, parts, shingles, signed, steps
from graphloom.session import scratch_path

COORDINATES = 128
BRANCHES = 2
RECALL = 0.9999
#: Nodes are compared from this depth on; nodes above hold chance neighbours of one shared token.
FIRST_DEPTH = 2
SMALL = 1000
DEPTH = 8
#: Members this like one of the pivots leave the node. Whoever links with one that left is at least ``NEAR`` less
#: (1 - threshold) like that pivot, and members down to three deviations of the estimate below that are tied to it.
NEAR = 0.7
PIVOTS = 8
#: Shingles of a group or block that one task compares.
WEIGHT = 2_000_000
PIVOT_ROUNDS = 3
SALTS = 16

_ODD = (mix(np.arange(1, COORDINATES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def trees_for(threshold: float, recall: float = RECALL) -> int:
    """Trees after which a pair at the threshold shares a leaf with the wanted probability.

    ``kept`` is the limit of kept = 1 - (1 - threshold * kept) ** BRANCHES, the chance of a common path in one tree.
    """
    kept = 1.0
    for _ in range(1000):
        kept = 1 - (1 - threshold * kept) ** BRANCHES
    return ceil(log(1 - recall) / log(1 - kept))


class Sets:
    """The distinct shingles of each text of a batch, sorted, with a digest of the set."""

    def __init__(self, column: pa.Array, size: int):
        words = Words(column, fold_case=True)
        hashes, counts = words.hashes(), words.counts()
        grams, at = shingles(hashes, words.offsets, size)
        short = np.flatnonzero((counts > 0) & (counts < size))
        if len(short):  # the whole sequence is the one shingle
            alone = np.zeros(len(short), np.uint64)
            for j in range(size):
                here = counts[short] > j
                alone[here] = mix(alone[here] + hashes[words.offsets[short[here]] + j] + np.uint64(j + 1))
            grams = np.insert(grams, at[short], alone)
            add = np.zeros(len(counts), np.int64)
            add[short] = 1
            at = at + np.concatenate([[0], np.cumsum(add)])
        for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
            grams[a:b].sort()
        new = np.ones(len(grams), bool)
        new[1:] = grams[1:] != grams[:-1]
        new[at[:-1][at[:-1] < len(grams)]] = True
        self.key = grams[new]
        self.at = np.concatenate([[0], np.cumsum(new)])[at]
        self.n = np.diff(self.at)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(self.key))])
        self.digest = mix((total[self.at[1:]] - total[self.at[:-1]]) ^ mix(self.n.astype(np.uint64)))

    def minwise(self) -> np.ndarray:
        """16 bits of the minwise token of each coordinate; rows without shingles hold zeros."""
        out = np.zeros((len(self.n), COORDINATES), np.uint16)
        some = np.flatnonzero(self.n)
        if len(some):
            narrow = (self.key >> np.uint64(32)).astype(np.uint32)
            for c, odd in enumerate(_ODD):
                low = np.minimum.reduceat(narrow * odd, self.at[:-1][some])
                out[some, c] = (low ^ (low >> np.uint32(16))).astype(np.uint16)
        return out


def _pack(column: pa.Array) -> pa.Array:
    pack = zstandard.ZstdCompressor(level=3).compress
    return pa.array([pack((t or "").encode()) for t in column.to_pylist()], pa.binary())


def _sets_of(packed: list[bytes], size: int) -> list[np.ndarray]:
    """Full sets of compressed texts, a bounded number at a time."""
    unpack, out = zstandard.ZstdDecompressor().decompress, []
    for at in range(0, len(packed), 256):
        texts = pa.RecordBatch.from_arrays([pa.array([unpack(t).decode() for t in packed[at : at + 256]], pa.large_string())], ["text"])
        for step in steps([texts]):
            s = Sets(step.column("text"), size)
            out += [s.key[a:b] for a, b in zip(s.at[:-1], s.at[1:])]
    return out


def _children(node: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """The ``BRANCHES`` children that each member goes to: ``(n, BRANCHES)`` from its node and minwise tokens."""
    first = mix(node + np.uint64(1)) % np.uint64(COORDINATES)
    out = np.empty((len(node), BRANCHES), np.uint64)
    for b in range(BRANCHES):
        step = np.uint64(0) if b == 0 else np.uint64(1) + mix(node + np.uint64(1 + b)) % np.uint64(COORDINATES // BRANCHES - 1) + np.uint64((b - 1) * (COORDINATES // BRANCHES))
        at = (first + step) % np.uint64(COORDINATES)
        value = tokens[np.arange(len(node)), at.astype(np.int64)].astype(np.uint64)
        out[:, b] = mix(mix(node + np.uint64(0x51)) ^ (at << np.uint64(32)) ^ value)
    return out


def _tokens(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, COORDINATES)


def _labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of ``n`` nodes the smallest node that the links a-b connect it with."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = np.minimum(new, new[new])
        if (new == label).all():
            return label
        label = new


def _edges(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    keep = a != b
    return pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep])], ["a", "b"])


def _whole(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables that end where a key ends; rows must be sorted by ``keys``."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        same = np.ones(n, bool)
        for k in keys:
            values = batch.column(k).to_numpy()
            same &= values == values[-1]
        cut = int(n - np.argmin(same[::-1])) if not same.all() else 0
        if held and cut == 0 and any(held[-1].column(k)[0].as_py() != batch.column(k)[0].as_py() for k in keys):
            yield pa.Table.from_batches(held)
            held = []
        if cut:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


def _compare(percent: int, keys: list[str]):
    """Ties between members of a node that may link: all pairs of a node are compared by their minwise tokens."""
    level = percent / 100
    least = COORDINATES * (level - 4 * sqrt(level * (1 - level) / COORDINATES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole(batches, keys):
            tokens, digest = _tokens(table.column("tokens")), table.column("digest").to_numpy()
            n = len(digest)
            new = np.zeros(n, bool)
            for k in keys:
                values = table.column(k).to_numpy()
                new[1:] |= values[1:] != values[:-1]
            group = np.cumsum(new)
            a, b = [], []
            for d in range(1, int(np.bincount(group).max())):
                i = np.flatnonzero(group[d:] == group[:-d])
                for part in np.array_split(i, len(i) // 16_384 + 1):
                    near = part[(tokens[part] == tokens[part + d]).sum(axis=1) >= least]
                    a.append(near)
                    b.append(near + d)
            if a:
                label = _labels(n, np.concatenate(a), np.concatenate(b))
                yield _edges(digest, digest[label])

    return run


def _written(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def candidates(classes: DataFrame, percent: int) -> DataFrame:
    """``a, b``: ties of ``classes(digest, tokens)`` through which all sets that link are (to the target) connected."""
    spark = classes.sparkSession
    n_parts, n_trees = parts(spark), trees_for(percent / 100)
    level = NEAR - (1 - percent / 100)  # how like a pivot a set is that links with one that left
    tied_from = level - 3 * sqrt(level * (1 - level) / COORDINATES)

    def plant(batches):
        for batch in batches:
            tokens, digest = _tokens(batch.column("tokens")), batch.column("digest").to_numpy()
            for tree in range(n_trees):
                nodes, own, named = np.full(len(digest), (tree + 1) << 8, np.uint64), tokens, digest
                for _ in range(FIRST_DEPTH):
                    nodes = _children(nodes, own).ravel()
                    own, named = np.repeat(own, BRANCHES, axis=0), np.repeat(named, BRANCHES)
                yield pa.RecordBatch.from_arrays([pa.array(signed(nodes)), pa.array(named)], ["node", "digest"])

    def part_ways(batches):
        """Members of a large node against its pivots: ties (kind 0), and children of those that stay (kind 1)."""
        for batch in batches:
            if not batch.num_rows:
                continue
            tokens, digest = _tokens(batch.column("tokens")), batch.column("digest").to_numpy()
            pivots, offsets = batch.column("pivots").flatten(), batch.column("pivots").offsets.to_numpy()
            offsets = offsets - offsets[0]
            owner = np.repeat(np.arange(len(digest)), np.diff(offsets))
            against = pivots.field("digest").to_numpy()
            like = (tokens[owner] == _tokens(pivots.field("tokens"))).mean(axis=1)
            best = np.maximum.reduceat(like, offsets[:-1])
            tied = np.flatnonzero((like >= tied_from) & (digest[owner] != against))
            stay = np.flatnonzero(best < NEAR)
            nodes = _children(batch.column("node").to_numpy()[stay].astype(np.int64).view(np.uint64), tokens[stay])
            kind = np.repeat(np.array([0, 1], np.int32), [len(tied), nodes.size])
            left = np.concatenate([digest[owner[tied]], signed(nodes.ravel())])
            right = np.concatenate([against[tied], np.repeat(digest[stay], BRANCHES)])
            own = pa.concat_arrays([pa.nulls(len(tied), pa.binary()), batch.column("tokens").take(pa.array(np.repeat(stay, BRANCHES)))])
            yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(left), pa.array(right), own], ["kind", "a", "b", "tokens"])

    members = _written(classes.mapInArrow(plant, "node long, digest long"), "paths")
    ties: list[DataFrame] = []
    for depth in range(FIRST_DEPTH, DEPTH + 1):
        sizes = members.groupBy("node").agg(F.count("*").alias("size"), F.bit_xor(F.xxhash64("digest")).alias("all"), F.min("digest").alias("low"))
        sizes = _written(sizes.where("size > 1"), "sizes")
        # Small nodes of the same members need one comparison; most near copies share many nodes.
        once = sizes.where(F.col("size") <= SMALL).groupBy("size", "all", "low").agg(F.min("node").alias("node")).select("node", "size")
        chosen = members.join(once.union(sizes.where(F.col("size") > SMALL).select("node", "size")), "node")
        placed = _written(chosen.join(classes, "digest") if depth == FIRST_DEPTH else chosen, "nodes").select("node", "size", "digest", "tokens")
        small = placed.where(F.col("size") <= SMALL).select("node", "digest", "tokens").repartition(n_parts, "node").sortWithinPartitions("node")
        ties.append(_written(small.mapInArrow(_compare(percent, ["node"]), "a long, b long"), "ties"))
        large = placed.where(F.col("size") > SMALL)
        if large.isEmpty():
            break
        if depth == DEPTH:
            blocks = F.ceil(F.col("size") / (SMALL // 2)).cast("int")
            cells = large.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("digest"), "blocks").cast("int"))
            cells = cells.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            cells = cells.select("node", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "digest", "tokens")
            cells = cells.repartition(n_parts, "node", "i", "j").sortWithinPartitions("node", "i", "j")
            ties.append(_written(cells.mapInArrow(_compare(percent, ["node", "i", "j"]), "a long, b long"), "ties"))
            break
        pivots = large.groupBy("node", F.pmod(F.xxhash64("digest"), F.lit(PIVOTS)).alias("of")).agg(F.min_by(F.struct("digest", "tokens"), F.xxhash64("digest", F.lit(1))).alias("p"))
        pivots = pivots.groupBy("node").agg(F.collect_list("p").alias("pivots")).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        met = large.withColumn("salt", F.pmod("digest", F.lit(SALTS))).join(pivots, ["node", "salt"]).select("node", "digest", "tokens", "pivots")
        met = _written(met.mapInArrow(part_ways, "kind int, a long, b long, tokens binary"), "met")
        ties.append(met.where("kind = 0").select("a", "b"))
        members = met.where("kind = 1").select(F.col("a").alias("node"), F.col("b").alias("digest"), "tokens")
    out = ties[0]
    for more in ties[1:]:
        out = out.union(more)
    return out.distinct()


# --- exact comparison of groups ------------------------------------------------------------------------------


def _linked(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """For each set the smallest index that links connect it with.

    A set meets those behind it that are not connected yet, unless sizes, or distances to an earlier set, exclude a link.
    """
    n = np.array([len(s) for s in sets])
    _, token = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), n)
    order = np.argsort(token, kind="stable")
    owners, edge = owner[order], np.concatenate([[0], np.cumsum(np.bincount(token))])
    at = np.concatenate([[0], np.cumsum(n)])
    label = np.arange(len(sets))
    known: list[np.ndarray] = []
    for x in range(len(sets) - 1):
        may = (label[x + 1 :] != label[x]) & (100 * np.minimum(n[x + 1 :], n[x]) >= percent * np.maximum(n[x + 1 :], n[x]))
        for far in known:
            may &= np.abs(far[x + 1 :] - far[x]) <= 1 - percent / 100 + 1e-9
        if not may.any():
            continue
        own = token[at[x] : at[x + 1]]
        low, size = edge[own], edge[own + 1] - edge[own]
        hit = owners[np.repeat(low - np.cumsum(size) + size, size) + np.arange(size.sum())]
        shared = np.bincount(hit, minlength=len(sets))
        union = n + n[x] - shared
        joint = np.unique(label[100 * shared >= percent * union])
        label[np.isin(label, joint)] = joint[0]
        known = [*known[-15:], 1 - shared / union]
    return label


def _exhaustive(size: int, percent: int, keys: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b, held = [], [], 0
        for table in groups(batches, keys):
            digest = table.column("digest").to_numpy()
            label = _linked(_sets_of(table.column("packed").to_pylist(), size), percent)
            a.append(digest)
            b.append(digest[label])
            held += len(digest)
            if held > 20_000:
                yield _edges(np.concatenate(a), np.concatenate(b))
                a, b, held = [], [], 0
        if a:
            yield _edges(np.concatenate(a), np.concatenate(b))

    return run


def links(grouped: DataFrame, size: int, percent: int) -> DataFrame:
    """``a, b``: links that connect what links connect in each group of ``grouped(root, digest, n, packed)``, exactly."""
    spark = grouped.sparkSession
    n_parts = parts(spark)

    def meet(batches):
        """Distances to the pivot, ``linked`` where they allow a link."""
        for batch in batches:
            if not batch.num_rows:
                continue
            pivots: dict[bytes, np.ndarray] = {}
            sets = _sets_of(batch.column("packed").to_pylist(), size)
            far, linked = [], []
            for own, packed in zip(sets, batch.column("pivot_packed").to_pylist()):
                if packed not in pivots:
                    pivots = {packed: _sets_of([packed], size)[0]}
                shared = len(np.intersect1d(own, pivots[packed], assume_unique=True))
                union = len(own) + len(pivots[packed]) - shared
                far.append(1 - shared / union)
                linked.append(100 * shared >= percent * union)
            arrays = [batch.column("root"), batch.column("digest"), batch.column("pivot"), pa.array(far), pa.array(linked)]
            yield pa.RecordBatch.from_arrays(arrays, ["root", "digest", "pivot", "far", "linked"])

    found: list[DataFrame] = []
    left = grouped
    for turn in range(PIVOT_ROUNDS + 1):
        weights = left.groupBy("root").agg(F.sum("n").alias("weight"))
        sized = _written(left.join(weights, "root"), "groups")
        small = sized.where(F.col("weight") <= WEIGHT).repartition(n_parts, "root").sortWithinPartitions("root")
        found.append(_written(small.mapInArrow(_exhaustive(size, percent, ["root"]), "a long, b long"), "links"))
        large = sized.where(F.col("weight") > WEIGHT)
        if large.isEmpty():
            break
        if turn == PIVOT_ROUNDS:
            blocks = F.ceil(2 * F.col("weight") / WEIGHT).cast("int")
            cells = large.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("digest"), "blocks").cast("int"))
            cells = cells.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            cells = cells.select("root", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "digest", "packed")
            cells = cells.repartition(n_parts, "root", "i", "j").sortWithinPartitions("root", "i", "j")
            found.append(_written(cells.mapInArrow(_exhaustive(size, percent, ["root", "i", "j"]), "a long, b long"), "links"))
            break
        chosen = large.groupBy("root").agg(F.min_by("digest", F.xxhash64("digest", F.lit(turn))).alias("pivot"))
        pivots = chosen.join(large.select(F.col("digest").alias("pivot"), F.col("packed").alias("pivot_packed")), "pivot").select("root", "pivot", "pivot_packed")
        salted = large.withColumn("salt", F.pmod("digest", F.lit(SALTS)))
        spread = pivots.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        met = salted.join(spread, ["root", "salt"]).select("root", "digest", "packed", "pivot", "pivot_packed")
        met = _written(met.mapInArrow(meet, "root long, digest long, pivot long, far double, linked boolean"), "pivots")
        found.append(met.where("linked and digest <> pivot").select(F.col("digest").alias("a"), F.col("pivot").alias("b")))
        # A set at distance f from the pivot links, if at all, with sets at most f + (1 - threshold) from it; when all of
        # those link with the pivot themselves, its own links add nothing.
        edge = met.where("not linked").groupBy("root").agg(F.min("far").alias("nearest"))
        stay = met.join(edge, "root").where(~F.col("linked") | (F.col("far") >= F.col("nearest") - (1 - percent / 100) - 1e-9))
        left = large.drop("weight").join(stay.select("root", "digest"), ["root", "digest"], "left_semi")
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for each row of ``docs(doc_id, text)``.

    Two documents link when 100 * |intersection| >= ``percent`` * |union| of their sets of ``size``-word shingles
    (A-Z lower-cased; a shorter text is one shingle). ``component_id`` is the smallest ``doc_id`` reachable by links.
    """
    spark = docs.sparkSession

    def sign(batches):
        for step in steps(batches):
            s = Sets(step.column("text"), size)
            arrays = [step.column("doc_id"), step.column("uid"), pa.array(s.n), pa.array(signed(s.digest)), pa.array([t.tobytes() for t in s.minwise()], pa.binary()), _pack(step.column("text"))]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "uid", "n_shingles", "digest", "tokens", "packed"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.monotonically_increasing_id().alias("uid"))
    signed_rows = _written(rows.mapInArrow(sign, "doc_id long, uid long, n_shingles long, digest long, tokens binary, packed binary"), "signatures")
    full = signed_rows.where("n_shingles > 0")
    heads = full.groupBy("digest").agg(F.min("uid").alias("uid"), F.min("doc_id").alias("first_id"))
    heads = _written(heads, "classes")
    classes = _written(heads.select("uid").join(full.select("uid", "digest", "n_shingles", "tokens"), "uid").drop("uid"), "tokens")
    grouped = components(spark, candidates(classes.select("digest", "tokens"), percent)).withColumnRenamed("node", "digest")
    wanted = grouped.join(heads.select("digest", "uid"), "digest")
    texts = wanted.join(full.select("uid", F.col("n_shingles").alias("n"), "packed"), "uid").select("root", "digest", "n", "packed")
    linked = components(spark, links(texts, size, percent)).withColumnRenamed("node", "digest")
    named = _written(linked.join(heads.select("digest", "first_id"), "digest"), "linked")
    lowest = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    lowest = lowest.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    joint = named.withColumn("salt", F.pmod("digest", F.lit(SALTS))).join(lowest, ["root", "salt"]).select("digest", "component_id", F.lit(True).alias("several"))
    ids = heads.select("digest", "first_id").join(joint, "digest", "left")
    ids = ids.select("digest", F.when(F.col("several"), F.col("component_id")).otherwise(F.col("first_id")).alias("component_id"))
    out = full.select("doc_id", "n_shingles", "digest").join(ids, "digest").select("doc_id", "n_shingles", "component_id")
    alone = signed_rows.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return out.union(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
