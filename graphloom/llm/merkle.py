"""Operator 13: a Merkle manifest of a dataset whose parents keep the hash states before their child slots.

A leaf is the digest of a row. The leaves of a group (a language) stand in the order of their ids; runs of
``fanout`` nodes become the hash of their digests as hex text until one node remains, the subroot, and the
subroots of all groups give the root in the same way. The hex text of a digest is one block of SHA-256, so the
hash state before each child slot of a parent is eight words. A parent keeps these states; to fold a replaced
child upwards, the state before its slot is resumed with the replacement and the siblings to its right, and
what stands to its left is never read.

Positions come from ranges: rows are dealt by ranges of (group, id), numbered inside each range, and the counts
of the ranges before are added. Then ``fanout ** chunk_levels`` neighbours at a time are one chunk; a chunk is a
subtree that one task builds, keeps with its states, and folds all its leaves in. Chunk roots are the nodes of the next
tier, so a group of any size, and any number of groups, needs a few tiers and no task holds more than a chunk.

Empty cases: no rows give no result. A null field has its own mark in a leaf, so it differs from an empty one.
Rows without a group form a group of their own, which stands first. Rows without an id stand first in their group.
Rows of equal ids stand in the order of their leaves; equal rows are leaves of their own. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.words import groups, parts
from graphloom.session import scratch_path

CHUNK_LEVELS = 12
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


# --- SHA-256 of many messages side by side, with states that can be kept ---------------------------------


def _root_bits(p: int, cube: bool) -> int:
    """The first 32 bits behind the point of the square or cube root of ``p``."""
    if not cube:
        return isqrt(p << 64) & 0xFFFFFFFF
    low, high = 0, 1 << 40
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (middle, high) if middle**3 <= p << 96 else (low, middle)
    return low & 0xFFFFFFFF


_PRIMES = [p for p in range(2, 312) if all(p % q for q in range(2, isqrt(p) + 1))]
_ROUND = np.array([_root_bits(p, True) for p in _PRIMES], np.uint32)
_START = np.array([_root_bits(p, False) for p in _PRIMES[:8]], np.uint32)[:, None]
_HEX = np.frombuffer(b"".join(b"%02x" % i for i in range(256)), np.uint8).reshape(256, 2)


def _turn(x: np.ndarray, by: int) -> np.ndarray:
    return (x >> np.uint32(by)) | (x << np.uint32(32 - by))


def absorb(state: np.ndarray, block: np.ndarray) -> np.ndarray:
    """States ``(8, n)`` after one more block ``(16, n)`` each; one block for all may be ``(16, 1)``."""
    w = list(block)
    for t in range(16, 64):
        x, y = w[t - 15], w[t - 2]
        w.append(w[t - 16] + (_turn(x, 7) ^ _turn(x, 18) ^ (x >> np.uint32(3))) + w[t - 7] + (_turn(y, 17) ^ _turn(y, 19) ^ (y >> np.uint32(10))))
    a, b, c, d, e, f, g, h = state
    for t in range(64):
        one = h + (_turn(e, 6) ^ _turn(e, 11) ^ _turn(e, 25)) + (g ^ (e & (f ^ g))) + (w[t] + _ROUND[t])
        two = (_turn(a, 2) ^ _turn(a, 13) ^ _turn(a, 22)) + ((a & b) | (c & (a | b)))
        a, b, c, d, e, f, g, h = one + two, a, b, c, d + one, e, f, g
    return state + np.stack(np.broadcast_arrays(a, b, c, d, e, f, g, h))


def finish(state: np.ndarray, blocks: np.ndarray | int) -> np.ndarray:
    """Digests ``(8, n)`` of messages that end after ``blocks`` whole blocks."""
    bits = np.atleast_1d(np.asarray(blocks, np.uint64)) * np.uint64(512)
    pad = np.zeros((16, len(bits)), np.uint32)
    pad[0] = 0x80000000
    pad[14], pad[15] = bits >> np.uint64(32), bits & np.uint64(0xFFFFFFFF)
    return absorb(state, pad)


def hex_blocks(digests: np.ndarray) -> np.ndarray:
    """Digests ``(8, n)`` as blocks ``(16, n)`` of hex text."""
    raw = to_bytes(digests)
    return np.ascontiguousarray(_HEX[raw].reshape(len(raw), 64).view(">u4").T.astype(np.uint32))


def to_bytes(words: np.ndarray) -> np.ndarray:
    """``(8, n)`` words as ``(n, 32)`` bytes."""
    return np.ascontiguousarray(words.T).astype(">u4").view(np.uint8).reshape(-1, 32)


def from_bytes(raw: bytes) -> np.ndarray:
    """Concatenated runs of 32 bytes as ``(8, n)`` words."""
    return np.ascontiguousarray(np.frombuffer(raw, ">u4").reshape(-1, 8).T.astype(np.uint32))


def _fixed(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return from_bytes(b"".join(column.to_pylist()))


def _binary(words: np.ndarray) -> pa.Array:
    return pa.array([x.tobytes() for x in to_bytes(words)], pa.binary())


# --- one subtree ------------------------------------------------------------------------------------------


@dataclass
class Level:
    """Nodes of a level as blocks of text, and for each parent the states before its slots."""

    blocks: np.ndarray
    states: list[np.ndarray]


def build(nodes: np.ndarray, levels: int, fanout: int) -> tuple[list[Level], np.ndarray]:
    """``levels`` levels above ``nodes``, each with its parents' states, and the nodes that remain."""
    kept: list[Level] = []
    for _ in range(levels):
        blocks, n = hex_blocks(nodes), nodes.shape[1]
        parents = -(-n // fanout)
        state, states = np.repeat(_START, parents, axis=1), []
        for slot in range(fanout):
            states.append(state)
            here = blocks[:, slot::fanout]
            state = np.concatenate([absorb(state[:, : here.shape[1]], here), state[:, here.shape[1] :]], axis=1)
        kept.append(Level(blocks, states))
        nodes = finish(state, np.minimum(n - np.arange(parents) * fanout, fanout))
    return kept, nodes


def fold(kept: list[Level], at: np.ndarray, nodes: np.ndarray, fanout: int) -> np.ndarray:
    """What the top becomes when, one at a time, the nodes at ``at`` are replaced by ``nodes``."""
    for level in kept:
        parent, slot, n = at // fanout, at % fanout, level.blocks.shape[1]
        state = np.empty((8, len(at)), np.uint32)
        for s in range(fanout):
            here = np.flatnonzero(slot == s)
            state[:, here] = level.states[s][:, parent[here]]
        state = absorb(state, hex_blocks(nodes))
        for s in range(1, fanout):
            here = np.flatnonzero((slot < s) & (parent * fanout + s < n))
            state[:, here] = absorb(state[:, here], level.blocks[:, parent[here] * fanout + s])
        nodes, at = finish(state, np.minimum(n - parent * fanout, fanout)), parent
    return nodes


def proofs(kept: list[Level], at: np.ndarray, fanout: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash states over the siblings of the nodes at ``at``, level by level, and how many siblings there are."""
    state, count = np.repeat(_START, len(at), axis=1), np.zeros(len(at), np.int64)
    for level in kept:
        parent, slot, n = at // fanout, at % fanout, level.blocks.shape[1]
        for s in range(fanout):
            here = np.flatnonzero((slot != s) & (parent * fanout + s < n))
            state[:, here] = absorb(state[:, here], level.blocks[:, parent[here] * fanout + s])
            count[here] += 1
        at = parent
    return state, count


def height(n: int, fanout: int) -> int:
    levels = 0
    while n > 1:
        n, levels = -(-n // fanout), levels + 1
    return levels


# --- positions ----------------------------------------------------------------------------------------------


def _written(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def ranked(df: DataFrame, group: str, order: Sequence[Column]) -> DataFrame:
    """``df`` with ``pos``, the place of a row among those of equal ``group`` in the given order, from 0.

    ``order`` must begin with ``group``. No task holds more than a range of rows.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", part int, idx long"

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, at = TaskContext.get().partitionId(), None, -1
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            values = np.array(batch.column(batch.schema.get_field_index(group)).to_pylist() + [None], object)[:n]
            new = np.ones(n, bool)
            new[1:] = values[1:] != values[:-1]
            new[0] = at < 0 or values[0] != last
            first = np.maximum.accumulate(np.where(new, np.arange(n), -1))
            idx = np.where(first >= 0, np.arange(n) - first, np.arange(n) + at + 1)
            last, at = values[-1], int(idx[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(n, part, np.int32)), pa.array(idx)], [*batch.schema.names, "part", "idx"])

    dealt = df.repartitionByRange(parts(df.sparkSession), *order).sortWithinPartitions(*order)
    numbered = _written(dealt.mapInArrow(number, schema), "numbered")
    before = Window.partitionBy(group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = numbered.groupBy(group, "part").agg((F.max("idx") + 1).alias("n"))
    counts = counts.select(F.col(group).alias("of"), F.col("part").alias("in"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    joined = numbered.join(counts, numbered[group].eqNullSafe(counts["of"]) & (numbered["part"] == counts["in"]))
    return joined.withColumn("pos", F.col("idx") + F.col("offset")).drop("part", "idx", "of", "in", "offset")


# --- tiers ----------------------------------------------------------------------------------------------------


def _tier(nodes: DataFrame, fanout: int, size: int, each, schema: str) -> DataFrame:
    """Run ``each(table, levels)`` over the chunks of ``nodes(g, n, pos, digest, ...)`` of ``size`` neighbours."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, ["g", "chunk"]):
            n = table.column("n")[0].as_py()
            yield each(table, height(min(n, size), fanout))

    chunked = nodes.withColumn("chunk", F.floor(F.col("pos") / size).cast("long"))
    return chunked.repartition(parts(nodes.sparkSession), "g", "chunk").sortWithinPartitions("g", "chunk", "pos").mapInArrow(run, schema)


_NODES = "g long, n long, pos long, digest binary, root boolean, path binary"


def _upper(nodes: DataFrame, fanout: int, size: int) -> DataFrame:
    """Children with their path to the root of their chunk (states, siblings), and the roots of the chunks.

    A path has for each level the state before the child's slot, how many siblings stand left and right, and they.
    """

    def each(table: pa.Table, levels: int) -> pa.RecordBatch:
        digests = _fixed(table.column("digest"))
        kept, top = build(digests, levels, fanout)
        count = digests.shape[1]
        plain = [to_bytes(level_nodes) for level_nodes in _nodes_of(digests, levels, fanout)]
        paths = [bytearray() for _ in range(count)]
        at = np.arange(count)
        for level, raw in zip(kept, plain):
            for i, a in enumerate(at.tolist()):
                parent, slot = divmod(a, fanout)
                run = raw[parent * fanout : parent * fanout + fanout]
                paths[i] += to_bytes(level.states[slot][:, parent : parent + 1]).tobytes() + bytes([slot, len(run) - slot - 1])
                paths[i] += run[:slot].tobytes() + run[slot + 1 :].tobytes()
            at = at // fanout
        g, n, chunk = (table.column(c)[0].as_py() for c in ("g", "n", "chunk"))
        arrays = [
            pa.array([g] * (count + 1), pa.int64()),
            pa.array([n] * count + [-(-n // size)], pa.int64()),
            pa.array([*table.column("pos").to_pylist(), chunk], pa.int64()),
            pa.array([*table.column("digest").to_pylist(), to_bytes(top)[0].tobytes()], pa.binary()),
            pa.array([False] * count + [True]),
            pa.array([*map(bytes, paths), None], pa.binary()),
        ]
        return pa.RecordBatch.from_arrays(arrays, ["g", "n", "pos", "digest", "root", "path"])

    return _tier(nodes, fanout, size, each, _NODES)


def _nodes_of(nodes: np.ndarray, levels: int, fanout: int) -> Iterator[np.ndarray]:
    for _ in range(levels):
        yield nodes
        _, nodes = build(nodes, 1, fanout)


def _climb(nodes: DataFrame, most: int, fanout: int, size: int) -> tuple[DataFrame, DataFrame]:
    """Tiers over ``nodes(g, n, pos, digest)`` to one root a group: ``(g, pos, path)`` of each node, and ``(g, digest)``."""
    tiers: list[DataFrame] = []
    while True:
        both = _written(_upper(nodes, fanout, size), "tier")
        tiers.append(both.where("not root").select("g", "pos", "path"))
        nodes, most = both.where("root").select("g", "n", "pos", "digest"), -(-most // size)
        if most <= 1:
            break
    paths = tiers[-1]
    for lower in reversed(tiers[:-1]):
        above = paths.select("g", F.col("pos").alias("chunk"), F.col("path").alias("rest"))
        paths = lower.withColumn("chunk", F.floor(F.col("pos") / size).cast("long")).join(above, ["g", "chunk"])
        paths = paths.select("g", "pos", F.concat("path", "rest").alias("path"))
    return paths, nodes.select("g", "digest")


def field_text(columns: Sequence[Column]) -> Column:
    """Values one after the other, each with its length in bytes, ``-`` for null; integers as decimal digits."""
    texts = [c.cast("string") for c in columns]
    return F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts))


def leaf(columns: Sequence[Column]) -> Column:
    """The digest of a row's values as lower-case hex text."""
    return F.sha2(field_text(columns).cast("binary"), 256)


def audit(leaves: DataFrame, fanout: int = 2, chunk_levels: int = CHUNK_LEVELS) -> DataFrame:
    """A manifest of ``leaves(group, id, leaf, replacement)`` and, for each leaf, what its replacement makes of the root.

    ``leaf`` and ``replacement`` are hex digests. Gives ``id, leaf, subroot, root, proof_sha256, folded_root``:
    ``proof_sha256`` is the hash of all siblings from the leaf to the root.
    """
    size = fanout**chunk_levels
    binary = leaves.select("group", "id", F.unhex("leaf").alias("digest"), F.unhex("replacement").alias("replacement"))
    order = [F.col("group").asc_nulls_first(), F.col("id").asc_nulls_first(), F.col("digest"), F.monotonically_increasing_id()]
    placed = ranked(binary, "group", order)
    trees = placed.groupBy("group").agg(F.count("*").alias("n")).withColumn("all", F.lit(0))
    trees = _written(ranked(trees, "all", [F.col("all"), F.col("group").asc_nulls_first()]), "trees")
    n_trees, most = trees.agg(F.count("*"), F.coalesce(F.max("n"), F.lit(0))).first()
    trees = trees.select(F.col("group").alias("of"), "n", F.col("pos").alias("g"))
    nodes = placed.join(trees, placed["group"].eqNullSafe(trees["of"])).select("g", "n", "pos", "id", "digest", "replacement")

    def each(table: pa.Table, levels: int) -> pa.RecordBatch:
        digests, replaced = _fixed(table.column("digest")), _fixed(table.column("replacement"))
        kept, top = build(digests, levels, fanout)
        count = digests.shape[1]
        at = np.arange(count)
        state, siblings = proofs(kept, at, fanout)
        g, n, chunk = (table.column(c)[0].as_py() for c in ("g", "n", "chunk"))
        more = lambda column, value, kind: pa.array([*column.to_pylist(), value], kind)
        arrays = [
            pa.array([g] * (count + 1), pa.int64()),
            pa.array([n] * count + [-(-n // size)], pa.int64()),
            pa.array([chunk] * (count + 1), pa.int64()),
            pa.array([False] * count + [True]),
            more(table.column("id"), None, pa.int64()),
            more(table.column("digest"), to_bytes(top)[0].tobytes(), pa.binary()),
            more(_binary(fold(kept, at, replaced, fanout)), None, pa.binary()),
            more(_binary(state), None, pa.binary()),
            pa.array([*siblings.tolist(), None], pa.int64()),
        ]
        return pa.RecordBatch.from_arrays(arrays, ["g", "n", "chunk", "root", "id", "digest", "folded", "state", "siblings"])

    schema = "g long, n long, chunk long, root boolean, id long, digest binary, folded binary, state binary, siblings long"
    tier = _written(_tier(nodes, fanout, size, each, schema), "folded")
    chunks = tier.where("root").select("g", "n", F.col("chunk").alias("pos"), "digest")
    paths, subroots = _climb(chunks, -(-most // size), fanout, size)
    tops = subroots.select(F.lit(0).cast("long").alias("g"), F.lit(n_trees).cast("long").alias("n"), F.col("g").alias("pos"), "digest")
    over, root = _climb(tops, n_trees, fanout, size)
    over = over.join(root.select("g", F.col("digest").alias("all_root")), "g").select(F.col("pos").alias("g"), F.col("path").alias("last"), "all_root")
    whole = paths.join(over, "g").join(subroots.select("g", F.col("digest").alias("subroot")), "g")
    whole = whole.select("g", F.col("pos").alias("chunk"), F.concat("path", "last").alias("path"), "subroot", "all_root")
    rows = tier.where("not root").drop("n", "root").join(whole, ["g", "chunk"])

    def end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            g, chunk = (batch.column(c).to_numpy() for c in ("g", "chunk"))
            nodes, state = _fixed(batch.column("folded")), _fixed(batch.column("state"))
            count = batch.column("siblings").to_numpy().copy()
            order = np.lexsort((chunk, g))
            edge = np.flatnonzero((np.diff(g[order]) != 0) | (np.diff(chunk[order]) != 0)) + 1
            for here in np.split(order, edge):
                nodes[:, here], state[:, here], more = _along(batch.column("path")[int(here[0])].as_py(), nodes[:, here], state[:, here])
                count[here] += more
            proof = finish(state, count)
            columns = [batch.column("id"), batch.column("digest"), batch.column("subroot"), batch.column("all_root"), _binary(proof), _binary(nodes)]
            yield pa.RecordBatch.from_arrays(columns, ["id", "leaf", "subroot", "root", "proof_sha256", "folded_root"])

    found = rows.mapInArrow(end, "id long, leaf binary, subroot binary, root binary, proof_sha256 binary, folded_root binary")
    return found.select("id", *(F.lower(F.hex(c)).alias(c) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")))


def _along(path: bytes, nodes: np.ndarray, proof: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Fold ``nodes`` along a kept path; carry the proof's states over its siblings; how many those were."""
    at = siblings = 0
    while at < len(path):
        state, left, right = from_bytes(path[at : at + 32]), path[at + 32], path[at + 33]
        at += 34
        others = hex_blocks(from_bytes(path[at : at + 32 * (left + right)])) if left + right else np.zeros((16, 0), np.uint32)
        at += 32 * (left + right)
        resumed = absorb(np.repeat(state, nodes.shape[1], axis=1), hex_blocks(nodes))
        for s in range(left, left + right):
            resumed = absorb(resumed, others[:, s : s + 1])
        nodes = finish(resumed, left + right + 1)
        for s in range(left + right):
            proof = absorb(proof, others[:, s : s + 1])
        siblings += left + right
    return nodes, proof, siblings


def tamper_audit(docs: DataFrame) -> DataFrame:
    """``documents`` as leaves by language; where 7 divides the CRC of ``doc_id``, ``n_chars`` is one more.

    Gives ``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified``.
    """
    columns = [F.col(c) for c in FIELDS]
    raised = [(F.col(c).cast("decimal(38,0)") + 1).cast("decimal(38,0)") if c == "n_chars" else F.col(c) for c in FIELDS]
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.lit(False)) & F.col("n_chars").isNotNull()
    leaves = docs.select(F.col("lang").alias("group"), F.col("doc_id").cast("long").alias("id"), leaf(columns).alias("leaf"), F.when(hit, leaf(raised)).alias("replacement"))
    result = audit(leaves.withColumn("replacement", F.coalesce("replacement", "leaf")))
    return result.withColumnRenamed("id", "doc_id").withColumn("verified", F.col("folded_root") == F.col("root"))


SQL = """
WITH RECURSIVE d AS (
  SELECT doc_id, lang, n_chars,
    list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: list_transform(range(0, 8), lambda i: ((ord(c) >> i::INT) & 1)::BIGINT)))),
      lambda c, b: xor(c >> 1, (xor(c, b) & 1) * 3988292384)) AS crc,
    COALESCE(octet_length(doc_id::VARCHAR::BLOB) || ':' || doc_id, '-') || COALESCE(octet_length(source::BLOB) || ':' || source, '-') || COALESCE(octet_length(lang::BLOB) || ':' || lang, '-') AS front,
    COALESCE(octet_length(encode(text)) || ':' || text, '-') AS back
  FROM (SELECT doc_id, lang, n_chars, source, text FROM documents)
),
h AS (
  SELECT doc_id, lang, sha256(front || COALESCE(octet_length(n_chars::VARCHAR::BLOB) || ':' || n_chars, '-') || back) AS leaf,
    sha256(front || COALESCE(octet_length(m::VARCHAR::BLOB) || ':' || m, '-') || back) AS replacement
  FROM (SELECT *, CASE WHEN xor(crc, 4294967295) % 7 = 0 THEN n_chars + 1 ELSE n_chars END AS m FROM d)
),
r AS (
  SELECT *, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS g, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
    COUNT(*) OVER (PARTITION BY lang) AS n
  FROM h
),
low AS (
  SELECT g, 0 AS level, pos, n, leaf AS h FROM r
  UNION ALL
  SELECT g, level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM low WHERE n > 1 GROUP BY g, level, pos // 2, n
),
sub AS (SELECT g, h, level FROM low WHERE n = 1),
high AS (
  SELECT 0 AS level, g AS pos, COUNT(*) OVER () AS n, h FROM sub
  UNION ALL
  SELECT level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM high WHERE n > 1 GROUP BY level, pos // 2, n
),
nodes AS (
  SELECT low.g AS tree, low.level, low.pos, low.h FROM low WHERE n > 1
  UNION ALL SELECT -1, level, pos, h FROM high WHERE n > 1
),
up AS (
  SELECT 0 AS step, r.g, doc_id, r.pos AS row_pos, CASE WHEN sub.level = 0 THEN -1 ELSE r.g END AS tree, 0 AS level, CASE WHEN sub.level = 0 THEN r.g ELSE r.pos END AS pos,
    replacement AS cur, '' AS proof, sub.level AS levels
  FROM r JOIN sub USING (g)
  UNION ALL
  SELECT step + 1, g, doc_id, row_pos, CASE WHEN up.tree >= 0 AND up.level + 1 = levels THEN -1 ELSE up.tree END,
    CASE WHEN up.tree >= 0 AND up.level + 1 = levels THEN 0 ELSE up.level + 1 END,
    CASE WHEN up.tree >= 0 AND up.level + 1 = levels THEN g ELSE up.pos // 2 END,
    CASE WHEN up.pos % 2 = 0 THEN sha256(cur || COALESCE(s.h, '')) ELSE sha256(s.h || cur) END, proof || COALESCE(s.h, ''), levels
  FROM up JOIN nodes me ON me.tree = up.tree AND me.level = up.level AND me.pos = up.pos
  LEFT JOIN nodes s ON s.tree = up.tree AND s.level = up.level AND s.pos = xor(up.pos, 1)
),
last AS (SELECT g, row_pos, arg_max(cur, step) AS folded_root, arg_max(proof, step) AS proof FROM up GROUP BY g, row_pos)
SELECT r.doc_id, r.leaf, sub.h AS subroot, top.h AS root, sha256(last.proof) AS proof_sha256, last.folded_root, last.folded_root = top.h AS verified
FROM r JOIN sub USING (g) JOIN last ON last.g = r.g AND last.row_pos = r.pos CROSS JOIN (SELECT h FROM high WHERE n = 1) top
"""
