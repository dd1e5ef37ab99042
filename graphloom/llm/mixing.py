"""Operator 4: mixing sources to target weights by Sainte-Laguë apportionment of equal blocks of words.

The words of the mix are cut into blocks of ``block`` words. Blocks are seats: sources get them one by one by the
highest quotient target / (2 * seats + 1), and a source's seats are handed on to its shards (documents dealt by
a seeded digest, about ``shard_words`` words each) by the same rule, which gives an integer quota per shard: the
quotient of the last seat is narrowed for all sources at once, by aggregates over the shards. In
a shard the documents follow each other in seeded order as one stream of blocks; each block is taken
quota // blocks times, and of the rest a seeded systematic choice once more. Where a document's words lie in the stream
is a running sum within the shard, so no block is ever a row.

The driver sees rows per source (name, words, seats that some quotients give), nothing per document or shard. Sources of any size spread over
shards, so a source with a third of all rows is no hot group.

Empty cases: a null text has no words, a null source is a source of its own and the last one, a row without
``doc_id`` is dealt as any other; repeated rows each count and are each taken by their own decision. An empty table
gives an empty mix. Reruns agree. The columns of ``docs`` may have any names.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType, LongType, StructField, StructType

from graphloom.llm.words import Words, steps

BLOCK = 16
#: Quotients tried at once for each source while the seats of its shards are counted.
TRIES = 32
SHARD_WORDS = 1_000_000
WEIGHTS = (3, 1, 2)
SEED = "mix"
_TAKE = ["passes", "rest", "n_blocks", "start", "block"]


def targets(sizes: Sequence[int], weights: Sequence[float], budget: float, limit: float = 2.0) -> list[float]:
    """Shares of ``budget`` by weight; none above ``limit`` times its size, the excess shared again by weight."""
    out = [0.0] * len(sizes)
    order = sorted(range(len(sizes)), key=lambda i: (limit * sizes[i] / weights[i], i))
    left, weight = float(budget), float(sum(weights))
    for i in order:
        out[i] = min(limit * sizes[i], left * weights[i] / weight) if weight else 0.0
        left, weight = left - out[i], weight - weights[i]
    return out


def seats(votes: Sequence[float], house: int) -> list[int]:
    """Sainte-Laguë: ``house`` seats by the highest quotients votes / (2s + 1); ties to the earlier party."""
    v = np.asarray(votes, float)
    if not len(v) or v.sum() <= 0:
        return [0] * len(v)

    def given(divisor: float) -> np.ndarray:
        """Seats whose quotient is above ``divisor``."""
        return np.maximum(np.ceil((v / divisor - 1) / 2), 0)

    low, high = v.max() / (2.0 * house + 3), v.max() * 2
    for _ in range(200):
        middle = (low + high) / 2
        if given(middle).sum() > house:
            low = middle
        else:
            high = middle
    out = given(high).astype(np.int64)
    for _ in range(house - int(out.sum())):  # at most one tied seat per party is left
        out[int(np.argmax(v / (2 * out + 1)))] += 1
    return out.tolist()


def sized(docs: DataFrame) -> DataFrame:
    """``doc_id, source, size``: words of each whole text."""

    def count(batches):
        for step in steps(batches):
            n = Words(step.column("text")).counts()
            yield pa.RecordBatch.from_arrays([step.column("doc_id"), step.column("source"), pa.array(n)], ["doc_id", "source", "size"])

    return docs.select("doc_id", "source", "text").mapInArrow(count, "doc_id long, source string, size long")


def _digest(doc_id, salt: str):
    return F.md5(F.concat(F.lit(f"{SEED}/{salt}/"), F.coalesce(doc_id.cast("string"), F.lit("null"))))


def _number(digest):
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def mix(docs: DataFrame, share: float = 1.5, weights: Sequence[int] = WEIGHTS, block: int = BLOCK, shard_words: int = SHARD_WORDS) -> DataFrame:
    """Each row's part of the mix: ``doc_id, size, source_size, target, taken`` and its place in its shard's stream.

    ``share`` is the mix's size relative to all words; sources in code-point order get ``weights`` in turn.
    The columns from ``passes`` on tell which words are taken: all of them ``passes`` times, and those in
    chosen blocks once more (see :func:`chosen`).
    """
    words = sized(docs)
    return _placed(words, _source_table(words, share, weights, block, shard_words), block).select(
        "doc_id", "source", "size", "source_size", "target", "taken", "passes", "rest", "n_blocks", "start", "block"
    )


def _source_table(words: DataFrame, share: float, weights: Sequence[int], block: int, shard_words: int) -> DataFrame:
    """Words, target, quota of blocks and number of shards of each source."""
    found = sorted(((r["source"], r["size"]) for r in words.groupBy("source").agg(F.sum("size").alias("size")).collect()), key=lambda r: (r[0] is None, r[0] or ""))
    sizes = [n for _, n in found]
    budget = share * sum(sizes)
    goal = targets(sizes, [weights[i % len(weights)] for i in range(len(found))], budget)
    quota = seats(goal, round(budget / block))
    return words.sparkSession.createDataFrame(
        [(s, n, t, q, max(1, -(-n // shard_words))) for (s, n), t, q in zip(found, goal, quota)],
        "_source string, source_size long, target double, quota long, shards long",
    )


def _shard_seats(shard: DataFrame) -> DataFrame:
    """``source, shard, shard_size, seats`` for ``shard(source, shard, shard_size, quota)``: quotas by the highest quotients.

    Seats that are left over are ties of the last quotient and go to the first shards that have it; only these are ranked.
    """
    spark = shard.sparkSession
    shard = shard.where("shard_size > 0 and quota > 0").persist()
    known = shard.groupBy("source").agg(F.sum("shard_size").alias("size"), F.count("*").alias("n"), F.max("shard_size").alias("top"), F.first("quota").alias("quota")).collect()
    quota = {r["source"]: r["quota"] for r in known}
    #: too many seats at the first bound, enough or too few at the second: s seats of v words have v / d within 2 s - 1 and 2 s + 1
    bounds = {
        r["source"]: (r["size"] / (2.0 * r["quota"] + r["n"] + 3), r["size"] / (2.0 * r["quota"] - r["n"] - 1) if 2 * r["quota"] > r["n"] + 1 else 2.0 * r["top"]) for r in known
    }

    def given(quotient):
        """Seats whose quotient is above ``quotient``."""
        return F.greatest(F.ceil((F.col("shard_size") / quotient - 1) / 2), F.lit(0))

    def of(values: dict, names: list[str]) -> DataFrame:
        """The shards of these sources with numbers of their source."""
        table = spark.createDataFrame([(k, *map(float, v)) for k, v in values.items()], "_source string, " + ", ".join(f"{n} double" for n in names))
        return shard.join(F.broadcast(table), shard["source"].eqNullSafe(table["_source"])).drop("_source")

    names = [f"_q{j}" for j in range(TRIES)]
    last: dict[str | None, tuple[float, float, int]] = {}
    while bounds:
        tried = {}
        for k, (low, high) in list(bounds.items()):
            between = [x for x in (low + (high - low) * j / (TRIES + 1) for j in range(1, TRIES + 1)) if low < x < high]
            tried[k] = (between or [high]) + [high] * (TRIES - max(len(between), 1))
        for r in of(tried, names).groupBy("source").agg(*[F.sum(given(F.col(n))).alias(n) for n in names]).collect():
            k = r["source"]
            low, high = bounds[k]
            n = {x: r[name] for x, name in zip(tried[k], names)}
            enough = min((x for x in n if n[x] <= quota[k]), default=high)
            low = max((x for x in n if n[x] > quota[k]), default=low)
            bounds[k] = (low, enough)
            # no number lies between the bounds, or no seat is missing
            if set(n) == {high} or n.get(enough) == quota[k]:
                last[k] = (enough, low, quota[k] - n[enough])
                del bounds[k]

    seated = of(last, ["_last", "_below", "_left"]) if last else shard.selectExpr("*", "0D AS _last", "0D AS _below", "0D AS _left")
    seated = seated.withColumn("seats", given(F.col("_last")).cast("long"))
    tied = seated.where((F.col("_left") > 0) & (given(F.col("_below")) > F.col("seats")))
    order = Window.partitionBy("source").orderBy((F.col("shard_size") / (2 * F.col("seats") + 1)).desc(), "shard")
    more = tied.withColumn("_place", F.row_number().over(order)).where("_place <= _left").select(F.col("source").alias("_s"), F.col("shard").alias("_h"))
    seated = seated.join(more, seated["source"].eqNullSafe(more["_s"]) & (seated["shard"] == more["_h"]), "left")
    return seated.select("source", "shard", "shard_size", (F.col("seats") + F.col("_h").isNotNull().cast("long")).alias("seats"))


def _placed(rows: DataFrame, table: DataFrame, block: int, last: Sequence = ()) -> DataFrame:
    """``rows(doc_id, source, size, ...)`` with target, words taken and place in their shard's stream.

    Rows of one id and size follow each other by ``last``.
    """
    # a row for each source, and one for each ``shard_words`` words: sent to all tasks, so the texts are dealt only once
    placed = rows.join(F.broadcast(table), rows["source"].eqNullSafe(table["_source"])).drop("_source")
    placed = placed.withColumn("shard", _number(_digest(F.col("doc_id"), "shard")) % F.col("shards"))
    shard = placed.groupBy("source", "shard").agg(F.sum("size").alias("shard_size"), F.first("quota").alias("quota"))
    shard = _shard_seats(shard).withColumn("n_blocks", F.ceil(F.col("shard_size") / block))
    shard = shard.select(F.col("source").alias("_s"), F.col("shard").alias("_h"), "n_blocks", F.least(F.col("seats"), 2 * F.col("n_blocks")).alias("seats"))

    stream = Window.partitionBy("source", "shard").orderBy(_digest(F.col("doc_id"), "order"), "doc_id", "size", *last).rowsBetween(Window.unboundedPreceding, 0)
    placed = placed.withColumn("end", F.sum("size").over(stream))
    # a shard without seats or words has no row
    placed = placed.join(F.broadcast(shard), placed["source"].eqNullSafe(shard["_s"]) & (placed["shard"] == shard["_h"]), "left").drop("_s", "_h")
    placed = placed.fillna(0, ["n_blocks", "seats"])
    placed = placed.withColumn("passes", F.expr("IF(n_blocks > 0, seats DIV n_blocks, 0)")).withColumn("rest", F.expr("IF(n_blocks > 0, seats % n_blocks, 0)"))
    placed = placed.withColumn("start", F.col("end") - F.col("size"))
    more = _before(F.col("end"), block) - _before(F.col("start"), block)
    return placed.withColumn("taken", F.col("passes") * F.col("size") + more).withColumn("block", F.lit(block).cast("long"))


def _before(position, block: int):
    """Words of chosen blocks before a position of the stream. Block j is chosen where j * rest // n_blocks steps up."""
    j = F.floor(position / block)
    at = lambda x: F.floor((x * F.col("rest") + F.col("n_blocks") - 1) / F.greatest("n_blocks", F.lit(1)))
    return F.when(F.col("rest") > 0, at(j) * block + (at(j + 1) - at(j)) * (position - j * block)).otherwise(F.lit(0))


def chosen(start: int, size: int, rest: int, n_blocks: int, block: int) -> np.ndarray:
    """Which words of a document lie in chosen blocks."""
    j = (start + np.arange(size)) // block
    at = lambda x: (x * rest + n_blocks - 1) // max(n_blocks, 1)
    return at(j + 1) > at(j)


def mix_documents(docs: DataFrame, share: float = 1.5, weights: Sequence[int] = WEIGHTS, block: int = BLOCK, shard_words: int = SHARD_WORDS) -> DataFrame:
    """The mix itself, with the columns of ``docs``: each document as many times as it is taken whole, and once
    more, cut down to the words of its chosen blocks, where a part is taken again. ``n_chars`` is set anew.

    Each row carries its own decision, so repeated rows and rows without ``doc_id`` are taken as :func:`mix` counts them.
    Documents without words stay once.
    """
    names, schema = docs.columns, docs.schema

    def count(batches):
        for batch in batches:
            for step in steps([batch.append_column("text", batch.column("row").field("text"))]):
                yield step.drop_columns(["text"]).append_column("size", pa.array(Words(step.column("text")).counts()))

    def take(batches):
        for batch in batches:
            row = batch.column("row")
            flat = pa.RecordBatch.from_arrays([*row.flatten(), *(batch.column(c) for c in _TAKE)], [f"{i}" for i in range(len(names) + len(_TAKE))])
            for step in steps([flat], str(names.index("text"))):
                yield taken(step)

    def taken(step):
        columns = dict(zip(names, step.columns))
        text = columns["text"]
        words = Words(text)
        rows, texts = [], []
        for i, (passes, rest, n_blocks, start, block) in enumerate(zip(*(c.to_pylist() for c in step.columns[len(names) :]))):
            a, b = words.offsets[i], words.offsets[i + 1]
            whole = text[i].as_py()
            if a == b:
                rows.append(i)
                texts.append(whole)
                continue
            rows += [i] * passes
            texts += [whole] * passes
            pick = chosen(start, int(b - a), rest, n_blocks, block)
            if pick.all():
                rows.append(i)
                texts.append(whole)
            elif pick.any():
                edge = np.flatnonzero(np.diff(np.concatenate([[0], pick.astype(np.int8), [0]])))
                spans = [words.data[words.starts[a + x] : words.ends[a + y - 1]].tobytes().decode() for x, y in zip(edge[::2], edge[1::2])]
                rows.append(i)
                texts.append("\n".join(spans))
        columns = {c: v.take(pa.array(rows, pa.int64())) for c, v in columns.items()}
        columns["text"] = pa.array(texts, text.type)
        if "n_chars" in columns:
            columns["n_chars"] = pa.array([None if x is None else len(x) for x in texts], pa.int64()).cast(step.column(names.index("n_chars")).type)
        return pa.RecordBatch.from_arrays(list(columns.values()), names)

    whole = docs.select("doc_id", "source", F.struct(*[docs[c] for c in names]).alias("row"))
    counted = whole.mapInArrow(count, StructType([*whole.schema.fields, StructField("size", LongType())]))
    # equal ids and sizes go by the text, then by the plain columns
    plain = [F.col("row").getField(f.name) for f in schema.fields if f.name != "text" and isinstance(f.dataType, AtomicType)]
    placed = _placed(counted, _source_table(sized(docs), share, weights, block, shard_words), block, [F.xxhash64(F.col("row").getField("text")), *plain])
    return placed.select("row", *_TAKE).mapInArrow(take, schema)


SQL = f"""
WITH RECURSIVE w AS (
  SELECT row_number() OVER () AS r, doc_id, source, COALESCE(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM documents
),
s AS (
  SELECT *, [3, 1, 2][(row_number() OVER (ORDER BY source IS NULL, source COLLATE "binary") - 1) % 3 + 1] AS weight,
    row_number() OVER (ORDER BY source IS NULL, source COLLATE "binary") AS rank
  FROM (SELECT source, SUM(size)::BIGINT AS source_size FROM w GROUP BY source)
),
o AS (SELECT *, row_number() OVER (ORDER BY 2.0 * source_size / weight, rank) AS k FROM s),
fill AS (
  SELECT 0::BIGINT AS k, 0::BIGINT AS rank, 0::DOUBLE AS target, 1.5::DOUBLE * (SELECT SUM(source_size) FROM s) AS rest, (SELECT SUM(weight) FROM s)::DOUBLE AS weights
  UNION ALL
  SELECT o.k, o.rank, least(2.0::DOUBLE * source_size, rest * weight / weights), rest - least(2.0::DOUBLE * source_size, rest * weight / weights), weights - weight
  FROM fill JOIN o ON o.k = fill.k + 1
),
house AS (SELECT round_even(1.5::DOUBLE * SUM(source_size) / {BLOCK}, 0)::BIGINT AS n FROM s),
quotient AS (
  SELECT rank, target / (2 * x + 1) AS q FROM fill, house, LATERAL (SELECT unnest(range(CAST(target / {BLOCK} AS BIGINT) + 20)) AS x) WHERE rank > 0
),
top AS (SELECT rank, q, row_number() OVER (ORDER BY q DESC, rank) AS place FROM quotient),
quota AS (SELECT rank, COUNT(*) AS quota FROM top, house WHERE place <= n GROUP BY rank),
src AS (
  SELECT s.source, s.source_size, fill.target, COALESCE(quota, 0) AS quota, greatest(1, ceil(s.source_size / {SHARD_WORDS}))::BIGINT AS shards
  FROM s JOIN fill USING (rank) LEFT JOIN quota USING (rank)
),
placed AS (
  SELECT w.*, source_size, target, quota, shards, CAST('0x' || substr(md5('{SEED}/shard/' || COALESCE(doc_id::VARCHAR, 'null')), 1, 8) AS BIGINT) % shards AS shard
  FROM w JOIN src ON w.source IS NOT DISTINCT FROM src.source
),
shard0 AS (
  SELECT source, shard, SUM(size)::BIGINT AS shard_size, any_value(quota) AS quota, any_value(source_size) AS source_size, any_value(shards) AS shards
  FROM placed GROUP BY source, shard
),
shard1 AS (
  SELECT source, shard, quota, shard_size / (2 * x + 1) AS q
  FROM shard0, LATERAL (SELECT unnest(range(CAST(ceil(shard_size * (2.0::DOUBLE * quota + shards + 3) / greatest(source_size, 1) / 2) AS BIGINT) + 2)) AS x) WHERE shard_size > 0
),
shard2 AS (SELECT source, shard, quota, row_number() OVER (PARTITION BY source ORDER BY q DESC, shard) AS place FROM shard1),
won AS (SELECT source, shard, COUNT(*) AS seats FROM shard2 WHERE place <= quota GROUP BY source, shard),
shard3 AS (
  SELECT s.source, s.shard, ceil(shard_size / {BLOCK})::BIGINT AS n_blocks, least(COALESCE(seats, 0), 2 * ceil(shard_size / {BLOCK}))::BIGINT AS seats
  FROM shard0 s LEFT JOIN won ON won.shard = s.shard AND won.source IS NOT DISTINCT FROM s.source
),
stream AS (
  SELECT *, (SUM(size) OVER (PARTITION BY source, shard ORDER BY md5('{SEED}/order/' || COALESCE(doc_id::VARCHAR, 'null')), doc_id, size, r ROWS UNBOUNDED PRECEDING))::BIGINT AS e FROM placed
),
cut AS (
  SELECT stream.*, e - size AS b, n_blocks, CASE WHEN n_blocks > 0 THEN seats // n_blocks ELSE 0 END AS passes, CASE WHEN n_blocks > 0 THEN seats % n_blocks ELSE 0 END AS rest
  FROM stream JOIN shard3 ON stream.shard = shard3.shard AND stream.source IS NOT DISTINCT FROM shard3.source
)
SELECT doc_id, size, source_size, target,
  (passes * size + CASE WHEN rest > 0
    THEN ((((e // {BLOCK}) * rest + n_blocks - 1) // greatest(n_blocks, 1)) * {BLOCK} + (((((e // {BLOCK}) + 1) * rest + n_blocks - 1) // greatest(n_blocks, 1)) - (((e // {BLOCK}) * rest + n_blocks - 1) // greatest(n_blocks, 1))) * (e - (e // {BLOCK}) * {BLOCK}))
       - ((((b // {BLOCK}) * rest + n_blocks - 1) // greatest(n_blocks, 1)) * {BLOCK} + (((((b // {BLOCK}) + 1) * rest + n_blocks - 1) // greatest(n_blocks, 1)) - (((b // {BLOCK}) * rest + n_blocks - 1) // greatest(n_blocks, 1))) * (b - (b // {BLOCK}) * {BLOCK}))
    ELSE 0 END)::BIGINT AS taken
FROM cut
"""
