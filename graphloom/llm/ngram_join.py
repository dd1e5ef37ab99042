"""Operator 8: exact Jaccard self-join of documents on word n-grams, by vertical partitioning.

All n-grams stand in one global order: those that many documents hold come last, by level of frequency, the
others by hash. Two sets at or above the threshold share an n-gram among the first few of each (the prefix),
so documents that share a prefix n-gram form a *canopy* around its smallest holder, and every pair that can
link meets in a canopy. A first fragment of the n-grams bounds all overlaps in a canopy from above, and members that
cannot link with any other leave it. What stays is laid out in cells of bounded size, and the global order is cut into
fragments: each (cell, fragment) counts the partial overlaps of its members in a matrix of its own, and the
matrices are summed per cell. From the sums come exact links, of which a cell hands on a spanning forest, so
that no pair is ever a row. Equal sets are one class throughout; components are found over classes.

What is broadcast: the list of n-grams in at least ``share`` of all documents. It has at most
(mean set size / share) entries however many documents there are, and changes only the order, not the result.

Empty cases: a text without words (or null, or empty) has an empty set, links with nothing and is its own
component. Documents with equal sets always link. A row without ``doc_id`` takes part, but cannot name a
component; where all of a component lack it, ``component_id`` is null. Repeated rows give a result row each.
Other columns are ignored by :func:`near_duplicates` and kept by :func:`keep_first`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.components import components
from graphloom.llm.words import Words, free_name, groups, mix, parts, shingles, signed, steps
from graphloom.session import SHUFFLES_GO, scratch_path, settings

BLOCK = 512
FRAGMENTS = 4
WIDTH = 6  # bytes of a hash that are compared within a cell
LOCAL_COUNT = 4
SKETCH = 3  # sixteenths of the hash range


class Sets:
    """The distinct n-grams of each text of a batch, in global order."""

    def __init__(self, column: pa.Array, size: int, hot: np.ndarray, level: np.ndarray):
        words = Words(column, fold_case=True)
        hashes = words.hashes()
        grams, at = shingles(hashes, words.offsets, size)
        counts = words.counts()
        short = np.flatnonzero((counts > 0) & (counts < size))
        text = np.repeat(np.arange(len(counts)), np.diff(at))
        if len(short):  # the whole sequence is the one n-gram
            alone = np.array([self._whole(hashes[words.offsets[i] : words.offsets[i + 1]]) for i in short], np.uint64)
            grams, text = np.insert(grams, at[short], alone), np.insert(text, at[short], short)
            at = np.searchsorted(text, np.arange(len(counts) + 1))
        key = grams >> np.uint64(6)
        if len(hot):
            place = np.minimum(np.searchsorted(hot, key), len(hot) - 1)
            key |= np.where(hot[place] == key, level[place], 0).astype(np.uint64) << np.uint64(58)
        for i in np.flatnonzero(np.diff(at) > 1).tolist():  # a text at a time is much faster than one order of all
            key[at[i] : at[i + 1]].sort()
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (text[1:] != text[:-1])
        self.key, self.text = key[new], text[new]
        self.at = np.searchsorted(self.text, np.arange(len(counts) + 1))
        self.n = np.diff(self.at)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(self.key << np.uint64(6)))])
        self.digest = mix((total[self.at[1:]] - total[self.at[:-1]]) ^ self.n.astype(np.uint64))

    def sketches(self) -> list[bytes]:
        """For each text the different values of 32 bits of the n-grams of the first fragment; n-grams that share one count as not in it."""
        chosen = (self.key >> np.uint64(20) & np.uint64(15)) < SKETCH
        at = np.concatenate([[0], np.cumsum(chosen)])[self.at]
        narrow = (self.key[chosen] >> np.uint64(24)).astype(np.uint32)
        return [np.unique(narrow[a:b]).tobytes() for a, b in zip(at[:-1], at[1:])]

    @staticmethod
    def _whole(hashes: np.ndarray) -> np.uint64:
        value = len(hashes)
        for h in hashes.tolist():
            value = (value * 0x94D049BB133111EB + h) % (1 << 64)
        return mix(np.array([value], np.uint64))[0]


def _frequent(docs: DataFrame, size: int, share: float) -> tuple[np.ndarray, np.ndarray]:
    """N-grams that at least ``share`` of the documents hold, and their level of frequency (from 1)."""
    none = (np.zeros(0, np.uint64), np.zeros(0, np.uint8))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            value, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            many = n >= LOCAL_COUNT
            return pa.RecordBatch.from_arrays([pa.array(signed(value[many])), pa.array(n[many])], ["gram", "n"])

        for step in steps(batches):
            held.append(Sets(step.column("text"), size, *none).key)
            if sum(map(len, held)) > 2_000_000:
                yield flush()
        if held:
            yield flush()

    found = docs.select("text").mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    least = max(share * docs.count(), 2 * LOCAL_COUNT)
    rows = found.where(F.col("n") >= least).toArrow()
    hot = rows.column("gram").to_numpy().astype(np.int64).view(np.uint64)
    level = np.clip(np.log2(rows.column("n").to_numpy() / least).astype(np.int64) + 1, 1, 63).astype(np.uint8)
    order = np.argsort(hot)
    return hot[order], level[order]


def _forest(linked: np.ndarray) -> np.ndarray:
    """For each node of a symmetric matrix of links the smallest node it is connected with."""
    label = np.arange(len(linked))
    while True:
        best = np.where(linked, label[None, :], len(label)).min(axis=1)
        new = np.minimum(label, best)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of each left set with each right set."""
    a, b = np.concatenate(left), np.concatenate(right)
    row = np.repeat(np.arange(len(left)), [len(x) for x in left])
    col = np.repeat(np.arange(len(right)), [len(x) for x in right])
    out = np.zeros((len(left), len(right)), np.float32)
    shared = np.intersect1d(a, b)
    if not len(shared):
        return out.astype(np.int32)
    ia, ib = np.searchsorted(shared, a), np.searchsorted(shared, b)
    hit_a = shared[np.minimum(ia, len(shared) - 1)] == a
    hit_b = shared[np.minimum(ib, len(shared) - 1)] == b
    ia, row, ib, col = ia[hit_a], row[hit_a], ib[hit_b], col[hit_b]
    wide = 4096
    for s in range(0, len(shared), wide):
        e = min(s + wide, len(shared))
        x, y = np.zeros((len(left), e - s), np.float32), np.zeros((len(right), e - s), np.float32)
        pick = (ia >= s) & (ia < e)
        x[row[pick], ia[pick] - s] = 1
        pick = (ib >= s) & (ib < e)
        y[col[pick], ib[pick] - s] = 1
        out += x @ y.T
    return out.astype(np.int32)


def _zstd(column: pa.Array) -> pa.Array:
    pack = zstandard.ZstdCompressor(level=3).compress
    return pa.array([pack((t or "").encode()) for t in column.to_pylist()], pa.binary())


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed one by one, as all of them are shuffled to meet the few that are compared."""
    for step in steps(batches):
        yield pa.RecordBatch.from_arrays([step.column("doc_id"), _zstd(step.column("text"))], ["doc_id", "text"])


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of compressed texts as steps of plain ones; few rows at a time, as sizes are known only afterwards."""
    unpack = zstandard.ZstdDecompressor().decompress
    for batch in steps(batches):
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            text = pa.array([unpack(t).decode() for t in part.column("text").to_pylist()], pa.large_string())
            yield from steps([part.set_column(part.schema.get_field_index("text"), "text", text)])


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, share: float = 1e-4) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for each row of ``docs(doc_id, text)``.

    Two documents link when 100 * |intersection| >= ``percent`` * |union| of their sets of ``size``-word
    n-grams (A-Z lower-cased). ``component_id`` is the smallest ``doc_id`` reachable by links.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    n_parts = parts(spark)
    frequent = spark.sparkContext.broadcast(_frequent(docs, size, share))

    def sign(batches):
        for step in steps(batches):
            s = Sets(step.column("text"), size, *frequent.value)
            arrays = [step.column("doc_id"), pa.array(s.n), pa.array(signed(s.digest)), pa.array(s.sketches(), pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_shingles", "digest", "sketch"])

    path = scratch_path(spark, "signatures")
    docs.mapInArrow(sign, "doc_id long, n_shingles long, digest long, sketch binary").write.parquet(path)
    signatures = spark.read.parquet(path)

    def prefixes(batches):
        seen: set[int] = set()
        for step in steps(batches):
            s = Sets(step.column("text"), size, *frequent.value)
            new = np.array([not (d in seen or seen.add(d)) for d in s.digest.tolist()], bool) & (s.n > 0)
            length = np.where(new, s.n - (percent * s.n + 99) // 100 + 1, 0)
            pick = np.repeat(s.at[:-1], length) + np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
            columns = [signed(s.key[pick]), np.repeat(s.n, length), signed(np.repeat(s.digest, length))]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["gram", "n", "digest"])

    def canopies(batches):
        """Rows sorted by n-gram and size. Holders of an n-gram part where a size is too small for the next; each part
        of two or more different sets gives its members, with the smallest as their pivot."""
        held = np.zeros((3, 0), np.int64)

        def cut(rows: np.ndarray) -> pa.RecordBatch:
            gram, n, digest = rows
            apart = np.ones(len(gram), bool)
            apart[1:] = (gram[1:] != gram[:-1]) | (100 * n[:-1] < percent * n[1:])
            first = np.flatnonzero(apart)
            if not len(first):
                return pa.RecordBatch.from_pydict({"pivot": [], "digest": []}, pa.schema([("pivot", pa.int64()), ("digest", pa.int64())]))
            low, high = np.minimum.reduceat(digest, first), np.maximum.reduceat(digest, first)
            size = np.diff(np.append(first, len(gram)))
            some = np.repeat(low != high, size)
            pairs = np.unique(np.stack([np.repeat(low, size)[some], digest[some]], axis=1), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["pivot", "digest"])

        for batch in batches:
            rows = np.concatenate([held, np.stack([batch.column(c).to_numpy() for c in ("gram", "n", "digest")])], axis=1)
            whole = int(np.searchsorted(rows[0], rows[0][-1])) if rows.shape[1] else 0
            held = rows[:, whole:]
            yield cut(rows[:, :whole])
        yield cut(held)

    held = docs.select("text").mapInArrow(prefixes, "gram long, n long, digest long").repartition(n_parts, "gram")
    members = held.sortWithinPartitions("gram", "n").mapInArrow(canopies, "pivot long, digest long").distinct()
    path = scratch_path(spark, "canopies")
    with settings(spark, SHUFFLES_GO):
        members.write.parquet(path)
    members = spark.read.parquet(path)

    def placed(members):
        blocks = members.groupBy("pivot").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
        return members.join(blocks, "pivot").withColumn("block", F.pmod(F.xxhash64("digest"), F.col("blocks")).cast("int"))

    def survivors(batches):
        """Members of a cell that may link with another one, by an upper bound of their overlap."""
        a: list[np.ndarray] = []
        b: list[np.ndarray] = []
        for group in groups(batches, ["pivot", "i", "j"]):
            digest, block, n = (group.column(c).to_numpy() for c in ("digest", "block", "n"))
            sets = [np.frombuffer(x, np.uint32) for x in group.column("sketch").to_pylist()]
            left, right = np.flatnonzero(block == group.column("i")[0].as_py()), np.flatnonzero(block == group.column("j")[0].as_py())
            if not len(left) or not len(right):
                continue
            rest = n - np.array([len(x) for x in sets])
            most = _overlaps([sets[x] for x in left], [sets[x] for x in right]) + np.minimum(rest[left][:, None], rest[right][None, :])
            may = 100 * most >= percent * (n[left][:, None] + n[right][None, :] - most)
            may &= digest[left][:, None] != digest[right][None, :]
            stay = np.unique(np.concatenate([digest[left][may.any(axis=1)], digest[right][may.any(axis=0)]]))
            a.append(np.full(len(stay), group.column("pivot")[0].as_py()))
            b.append(stay)
            if len(a) >= 1000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["pivot", "digest"])
                a, b = [], []
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["pivot", "digest"])

    one = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "n_shingles", "sketch"))
    holder = signatures.where("n_shingles > 0").groupBy("digest").agg(one.alias("h"))
    sketched = placed(members).join(holder, "digest").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    sketched = sketched.select("pivot", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "digest", F.col("h.n_shingles").alias("n"), "h.sketch")
    sketched = sketched.repartition(n_parts, "pivot", "i", "j").sortWithinPartitions("pivot", "i", "j")
    path = scratch_path(spark, "survivors")
    with settings(spark, SHUFFLES_GO):
        sketched.mapInArrow(survivors, "pivot long, digest long").distinct().write.parquet(path)
    wanted = placed(spark.read.parquet(path)).groupBy("digest").agg(F.collect_list(F.struct("pivot", "block", "blocks")).alias("places"))
    holder = signatures.where("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("doc_id"))
    nameless = docs.where("doc_id is null").select("doc_id", "text", F.lit(None).cast("long").alias("digest"))
    # A class of which no row has a doc_id is rare; its texts are looked up by their digest instead.
    packed = docs.where("doc_id is not null").mapInArrow(_pack, "doc_id long, text binary")
    sourced = wanted.join(holder, "digest").join(packed, "doc_id").select("text", "digest", "places")
    orphans = wanted.join(holder, "digest", "left_anti")

    cell_schema = "pivot long, i int, j int, fragment int, block int, digest long, n long, grams binary"

    def lay(batches):
        for step in _unpacked(batches):
            s = Sets(step.column("text"), size, *frequent.value)
            rows: dict[str, list] = {k: [] for k in ("pivot", "i", "j", "fragment", "block", "digest", "n", "grams")}
            fragment = ((s.key >> np.uint64(56)) & np.uint64(FRAGMENTS - 1)).astype(np.int64)
            narrow = np.ascontiguousarray(s.key.view(np.uint8).reshape(-1, 8)[:, :WIDTH])
            digests = signed(s.digest).tolist()
            for t, (digest, places) in enumerate(zip(step.column("digest").to_pylist(), step.column("places").to_pylist())):
                if digest != digests[t]:
                    continue  # another text under the same doc_id
                a, b = s.at[t], s.at[t + 1]
                segments = [narrow[a:b][fragment[a:b] == f].tobytes() for f in range(FRAGMENTS)]
                for place in places:
                    for other in range(place["blocks"]):
                        i, j = sorted((place["block"], other))
                        for f in range(FRAGMENTS):
                            for k, v in zip(rows, (place["pivot"], i, j, f, place["block"], digest, int(b - a), segments[f])):
                                rows[k].append(v)
                if len(rows["pivot"]) > 20_000:
                    yield pa.RecordBatch.from_pydict(rows, schema=_arrow_schema)
                    rows = {k: [] for k in rows}
            yield pa.RecordBatch.from_pydict(rows, schema=_arrow_schema)

    _arrow_schema = pa.schema(
        [("pivot", pa.int64()), ("i", pa.int32()), ("j", pa.int32()), ("fragment", pa.int32()), ("block", pa.int32()), ("digest", pa.int64()), ("n", pa.int64()), ("grams", pa.binary())]
    )

    def count(batches):
        """Partial overlaps of a cell in one fragment."""
        out: list[tuple] = []
        for group in groups(batches, ["pivot", "i", "j", "fragment"]):
            group = group.combine_chunks()
            digest, first = np.unique(group.column("digest").to_numpy(), return_index=True)
            block, n = group.column("block").to_numpy()[first], group.column("n").to_numpy()[first]
            i, j = group.column("i")[0].as_py(), group.column("j")[0].as_py()
            raw = group.column("grams").take(pa.array(first)).to_pylist()
            sets = []
            for x in raw:
                wide = np.zeros((len(x) // WIDTH, 8), np.uint8)
                wide[:, :WIDTH] = np.frombuffer(x, np.uint8).reshape(-1, WIDTH)
                sets.append(wide.view(np.uint64).ravel())
            left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
            if len(left) and len(right):
                m = _overlaps([sets[x] for x in left], [sets[x] for x in right])
                out.append((group.column("pivot")[0].as_py(), i, j, digest[left].tobytes(), digest[right].tobytes(), n[left].tobytes(), n[right].tobytes(), m.tobytes()))
            if len(out) >= 200 or sum(len(x[-1]) for x in out) > 8_000_000:
                yield _matrices(out)
                out = []
        if out:
            yield _matrices(out)

    def _matrices(out):
        names = ["pivot", "i", "j", "left", "right", "n_left", "n_right", "overlaps"]
        kinds = [pa.int64(), pa.int32(), pa.int32()] + [pa.binary()] * 5
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out), kinds)], names)

    def add_up(batches):
        """Sum of a cell's partial overlaps, and a spanning forest of its links."""
        a: list[np.ndarray] = []
        b: list[np.ndarray] = []
        for group in groups(batches, ["pivot", "i", "j"]):
            # the members of a cell are the same, in the same order, in every fragment
            one = {c: group.column(c)[0].as_py() for c in ("left", "right", "n_left", "n_right")}
            left, right = np.frombuffer(one["left"], np.int64), np.frombuffer(one["right"], np.int64)
            shared = sum(np.frombuffer(x.as_py(), np.int32) for x in group.column("overlaps")).reshape(len(left), len(right)).astype(np.int64)
            union = np.frombuffer(one["n_left"], np.int64)[:, None] + np.frombuffer(one["n_right"], np.int64)[None, :] - shared
            linked = 100 * shared >= percent * union
            names = np.concatenate([left, right])
            whole = np.zeros((len(names), len(names)), bool)
            whole[: len(left), len(left) :] = linked
            whole |= whole.T
            label = _forest(whole)
            a.append(names)
            b.append(names[label])
            if len(a) >= 500:
                yield _edges(a, b)
                a, b = [], []
        if a:
            yield _edges(a, b)

    def _edges(a, b):
        x, y = np.concatenate(a), np.concatenate(b)
        return pa.RecordBatch.from_arrays([pa.array(x[x != y]), pa.array(y[x != y])], ["a", "b"])

    cells = sourced.mapInArrow(lay, cell_schema)
    rest = _orphan_texts(nameless, size, frequent, orphans)
    if rest is not None:
        cells = cells.union(rest.mapInArrow(lay, cell_schema))
    partial = cells.repartition(n_parts, "pivot", "i", "j", "fragment").sortWithinPartitions("pivot", "i", "j", "fragment", "digest")
    partial = partial.mapInArrow(count, "pivot long, i int, j int, left binary, right binary, n_left binary, n_right binary, overlaps binary")
    summed = partial.repartition(n_parts, "pivot", "i", "j").sortWithinPartitions("pivot", "i", "j")
    edges = summed.mapInArrow(add_up, "a long, b long")

    with settings(spark, SHUFFLES_GO):
        linked = components(spark, edges)
    roots = linked.select(F.col("node").alias("digest"), "root")
    rooted = signatures.join(roots, "digest", "left").withColumn("root", F.coalesce("root", "digest"))
    full = rooted.where("n_shingles > 0")
    smallest = full.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return full.join(smallest, "root").select("doc_id", "n_shingles", "component_id").union(
        signatures.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    )


def _orphan_texts(nameless: DataFrame, size: int, frequent, orphans: DataFrame) -> DataFrame | None:
    """One text for each class whose rows all lack a doc_id; None where no row lacks it."""
    if nameless.isEmpty():
        return None

    def digest(batches):
        for step in steps(batches):
            s = Sets(step.column("text"), size, *frequent.value)
            yield pa.RecordBatch.from_arrays([_zstd(step.column("text")), pa.array(signed(s.digest))], ["text", "digest"])

    texts = nameless.select("text").mapInArrow(digest, "text binary, digest long").groupBy("digest").agg(F.min("text").alias("text"))
    return texts.join(orphans, "digest").select("text", "digest", "places")


def keep_first(docs: DataFrame, size: int = 5, percent: int = 80, share: float = 1e-4) -> DataFrame:
    """The rows of ``docs`` without near duplicates: of each component the row with the smallest ``doc_id``.

    Of rows with one ``doc_id`` and one text one stays. Rows without words or without ``doc_id`` stay. Further columns
    may have any names.
    """
    result = near_duplicates(docs.select("doc_id", "text"), size, percent, share)
    kept = result.where("doc_id = component_id").select("doc_id").distinct()
    named = docs.where("doc_id is not null")
    place = free_name(docs.columns, "row")
    row = F.row_number().over(Window.partitionBy("doc_id", "text").orderBy("doc_id"))
    staying = named.join(kept, "doc_id", "left_semi").withColumn(place, row).where(F.col(place) == 1).drop(place)
    return staying.unionByName(docs.where("doc_id is null"))
