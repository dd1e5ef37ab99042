"""Operator 7: language identification by interpolated Kneser-Ney character models.

Every language gets a model of four-letter runs, counted over all training texts; no run is dropped, so what is gathered
grows with the input. Letters are lower-cased, anything else is a single blank; letters above U+FFFF share 4,096 codes.
Counts, continuation counts, discounts and the weights of shorter runs are tables that Spark groups and joins. The runs
of the texts at hand are scored order by order in all languages, once for each different run. The scores stand in sorted arrays of
hashes: one array sent to all tasks while it has at most ``shared_bytes``; beyond that the texts are written in chunks,
and each chunk meets the array of its own runs. Both ways give the same rows.

A text's language is the one with the lowest cross-entropy per character. A text whose cross-entropy lies too far above
that of the language's own training text is rejected; how far is calibrated from the counts alone: half way to the most
similar foreign text, plus an allowance for short texts. The driver gets a few numbers for each language.

Empty cases: null text or text without a letter is ``und`` with score 0 and rejected. Rows without ``lang``, text or
``doc_id`` do not train, but are predicted. Without any training row every text is ``und``. Repeated rows train and are
predicted each. Ties go to the first language in code-point order.
"""

from __future__ import annotations

import pickle
import uuid
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, LongType, StringType, StructField, StructType

from graphloom.llm.words import free_name, mix, signed, steps
from graphloom.session import scratch_path

ORDER = 4
UNKNOWN = "und"
#: Allowance for short texts, in standard deviations of a text's cross-entropy.
DEVIATIONS = 4.0
#: Runs that one flush of the counting holds.
FLUSH = 4_000_000
#: Largest array of scores that is sent to all tasks.
SHARED_BYTES = 64_000_000
#: Letters in a chunk of texts that meets its own array.
CHUNK = 8_000_000


def letters(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Letter codes of all texts, ``ORDER`` - 1 blanks before each; where each text's codes begin and end; and whether it has a letter."""
    texts = ["" if t is None else t.lower() + " " for t in column.to_pylist()]
    raw = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    at = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    seen = np.flatnonzero(np.bincount(raw, minlength=1))
    code = np.zeros(int(seen[-1]) + 1 if len(seen) else 1, np.uint64)
    for c in seen.tolist():
        if chr(c).isalpha():
            code[c] = c if c < 0x10000 else 0xE000 + (c & 0xFFF)  # rare letters share the private codes
    codes = code[raw]
    full = codes > 0
    keep = full.copy()
    keep[1:] |= full[:-1]  # one blank after a run of letters
    begins = at[:-1][at[:-1] < len(raw)]
    keep[begins] = full[begins]
    text = np.repeat(np.arange(len(texts)), np.diff(at))[keep]
    kept = np.where(full, codes, np.uint64(32))[keep]
    n = np.bincount(text, minlength=len(texts))
    pad = ORDER - 1
    out = np.full(len(kept) + pad * len(texts), 32, np.uint64)
    out[np.arange(len(kept)) + pad * (text + 1)] = kept
    end = np.cumsum(n) + pad * np.arange(1, len(texts) + 1)
    return out, np.stack([end - n, end]), n > 0


def runs(codes: np.ndarray, length: int) -> np.ndarray:
    """For each place the ``length`` codes that end there, packed; places without so many before them are not meaningful."""
    out = codes.copy()
    for back in range(1, length):
        out[back:] |= codes[:-back] << np.uint64(16 * back)
    return out


class Hashed:
    """A sorted array of 64-bit hashes with a directory of their leading bits."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.append(keys, np.uint64(2**64 - 1))
        bits = min(max(int(len(keys)).bit_length() + 1, 1), 24)
        self.shift = np.uint64(64 - bits)
        self.directory = np.searchsorted(keys, np.arange(1 << bits, dtype=np.uint64) << self.shift).astype(np.int32)

    def find(self, query: np.ndarray) -> np.ndarray:
        """Places of the queried hashes, -1 where there is none."""
        at = self.directory[(query >> self.shift).astype(np.int64)].astype(np.int64)
        behind = np.flatnonzero(self.keys[at] < query)
        while len(behind):
            at[behind] += 1
            behind = behind[self.keys[at[behind]] < query[behind]]
        hit = (self.keys[at] == query) & (at < len(self.keys) - 1)
        return np.where(hit, at, -1)


@dataclass
class Model:
    """What the training texts teach; tables are in the shared folder."""

    languages: list[str]
    counts: dict[int, DataFrame]  # by order: lang (place in ``languages``), gram, n
    discounts: dict[int, list[float]]  # by order, for each language
    letters: int  # different letters of all languages
    tables: dict[int, tuple[DataFrame, DataFrame]] = field(default_factory=dict)  # by order, see ``_seen_and_left``
    scored: DataFrame | None = None  # gram, logs: the training runs in all languages
    mean: np.ndarray | None = None  # of a language's own text, per character
    deviation: np.ndarray | None = None
    margin: np.ndarray | None = None


@dataclass
class Scores:
    """Log-probabilities of packed runs in all languages, by sorted hashes."""

    grams: Hashed
    logs: np.ndarray

    @classmethod
    def of(cls, grams: np.ndarray, logs: np.ndarray) -> Scores:
        hashes = mix(grams)
        order = np.argsort(hashes)
        return cls(Hashed(hashes[order]), logs[order])

    def score(self, grams: np.ndarray) -> np.ndarray:
        at = self.grams.find(mix(grams))
        if len(at) and at.min() < 0:
            raise ValueError("a text has changed while its language was looked for")
        return self.logs[at]

    def entropy(self, codes: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Cross-entropy per character of each text in every language (nan where a text has no letter)."""
        n = ends[1] - ends[0]
        total = np.zeros((len(n), self.logs.shape[1]))
        grams = runs(codes, ORDER)[_inside(codes, ends)]
        text = np.repeat(np.arange(len(n)), n)
        size = max(8_000_000 // (self.logs.shape[1] + 4), 1)
        for s in range(0, len(grams), size):
            part = text[s : s + size]
            first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
            total[part[first]] += np.add.reduceat(self.score(grams[s : s + size]), first, axis=0, dtype=np.float64)
        with np.errstate(divide="ignore", invalid="ignore"):
            return -total / n[:, None]


def _inside(codes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which codes belong to a text and not to the blanks before it."""
    edge = np.zeros(len(codes) + 1, np.int8)
    np.add.at(edge, ends[0], 1)
    np.add.at(edge, ends[1], -1)
    return np.cumsum(edge[:-1]) > 0


def _mask(order: int) -> int:
    """The last ``order`` letters of a packed run, as a signed number."""
    return int(np.array([(1 << 16 * order) - 1], np.uint64).view(np.int64)[0])


def _matrix(column: pa.Array, size: int, missing: float) -> np.ndarray:
    """Lists of (place, value) as rows of a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    row = np.repeat(np.arange(len(column)), column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    pairs = column.flatten()
    out = np.full((len(column), size), missing)
    out[row, pairs.field(0).to_numpy()] = pairs.field(1).to_numpy()
    return out


def _rows(column: pa.Array, size: int) -> np.ndarray:
    """Lists of ``size`` numbers each as rows of a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy().reshape(-1, size)


def _list(matrix: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(matrix) + 1, dtype=np.int32) * matrix.shape[1], pa.int32()), pa.array(matrix.ravel()))


def _written(table: DataFrame, name: str) -> DataFrame:
    """``table`` in the shared folder. Each step is a plan of its own: one plan of all orders is planned anew after each of its many shuffles, in the driver's memory."""
    path = scratch_path(table.sparkSession, name)
    table.write.parquet(path)
    return table.sparkSession.read.parquet(path)


def _seen_and_left(counts: DataFrame, discounts: list[float], order: int) -> tuple[DataFrame, DataFrame]:
    """Of the training runs of ``order`` letters ``gram, seen``: discounted shares by language; of what precedes the last letter ``context, left``: the weights of shorter runs."""
    cut = F.element_at(F.array(*[F.lit(d) for d in discounts]), F.col("lang") + 1)
    # at most as many rows in a window as there are letters
    same = Window.partitionBy("lang", "context")
    counted = counts.withColumn("context", F.shiftrightunsigned("gram", 16)).withColumns({"all": F.sum("n").over(same), "kinds": F.count("*").over(same)})
    seen = counted.groupBy("gram").agg(F.collect_list(F.struct("lang", (F.greatest(F.col("n") - cut, F.lit(0.0)) / F.col("all")).alias("p"))).alias("seen"))
    left = counted.select("lang", "context", (cut * F.col("kinds") / F.col("all")).alias("p")).distinct().groupBy("context").agg(F.collect_list(F.struct("lang", "p")).alias("left"))
    return _written(seen, f"seen-{order}"), _written(left, f"left-{order}")


def _probabilities(model: Model, grams: DataFrame, order: int) -> DataFrame:
    """``gram, p`` of different runs of ``order`` letters: the last one's probability after the others, in every language."""
    size = len(model.languages)
    seen, left = model.tables[order]
    asked = grams.withColumns({"context": F.shiftrightunsigned("gram", 16), "short": F.col("gram").bitwiseAND(F.lit(_mask(order - 1)))})
    if order > 1:
        shorter = _written(_probabilities(model, _written(asked.select(F.col("short").alias("gram")).distinct(), f"asked-{order - 1}"), order - 1), f"scored-{order - 1}")
    asked = asked.join(seen, "gram", "left").join(left, "context", "left")
    if order > 1:
        asked = asked.join(shorter.select(F.col("gram").alias("short"), F.col("p").alias("low")), "short")
    else:
        asked = asked.withColumn("low", F.array(*[F.lit(1.0 / (model.letters + 1))] * size))

    def combine(batches):
        for batch in batches:
            if batch.num_rows:
                p = _matrix(batch.column("seen"), size, 0.0) + _matrix(batch.column("left"), size, 1.0) * _rows(batch.column("low"), size)
                yield pa.RecordBatch.from_arrays([batch.column("gram"), _list(p)], ["gram", "p"])

    return asked.select("gram", "seen", "left", "low").mapInArrow(combine, "gram long, p array<double>")


def scores(model: Model, grams: DataFrame) -> DataFrame:
    """``gram, logs`` of different runs of ``ORDER`` letters, in the shared folder."""
    logs = F.transform("p", lambda p: F.log(p).cast("float")).alias("logs")
    return _written(_probabilities(model, _written(grams, f"asked-{ORDER}"), ORDER).select("gram", logs), "run-scores")


def _calibrated(model: Model) -> Model:
    """``model`` with the cross-entropies of the training text: of its own language and of the most similar foreign one."""
    size = len(model.languages)

    def weigh(batches):
        total = np.zeros((size, 1 + size))
        square = np.zeros(size)
        for batch in batches:
            lang, n = batch.column("lang").to_numpy(), batch.column("n").to_numpy().astype(np.float64)
            surprise = -_rows(batch.column("logs"), size).astype(np.float64)
            np.add.at(total, lang, np.column_stack([n, surprise * n[:, None]]))
            np.add.at(square, lang, n * np.square(surprise[np.arange(len(lang)), lang]))
        at = np.flatnonzero(total[:, 0])
        lang, other = np.repeat(at, size), np.tile(np.arange(size), len(at))
        columns = [lang, other, total[lang, 0], total[lang, 1 + other], square[lang]]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int32(), pa.int32(), *[pa.float64()] * 3])], ["lang", "other", "n", "s", "square"])

    met = model.counts[ORDER].join(model.scored, "gram").select("lang", "n", "logs").mapInArrow(weigh, "lang int, other int, n double, s double, square double")
    pairs = met.groupBy("lang", "other").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("square").alias("square"))
    own = F.col("lang") == F.col("other")
    entropy = F.col("s") / F.col("n")
    rows = pairs.groupBy("other").agg(
        F.max(F.when(own, entropy)).alias("mean"), F.max(F.when(own, F.col("square") / F.col("n"))).alias("square"), F.min(F.when(~own, entropy)).alias("foreign")
    ).orderBy("other").collect()
    model.mean = np.array([r["mean"] for r in rows])
    model.deviation = np.sqrt(np.maximum(np.array([r["square"] for r in rows]) - np.square(model.mean), 0))
    model.margin = np.array([2.0 if r["foreign"] is None else max((r["foreign"] - r["mean"]) / 2, 0.5) for r in rows])
    return model


def train(docs: DataFrame) -> Model | None:
    """A model from all rows of ``docs(text, lang)`` with both."""
    spark = docs.sparkSession

    def count(batches):
        held: dict[str, list[np.ndarray]] = {}
        size = 0

        def flush():
            for lang, parts in held.items():
                grams, n = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams)), pa.array(signed(grams)), pa.array(n)], ["lang", "gram", "n"])
            held.clear()

        for step in steps(batches):
            codes, ends, _ = letters(step.column("text"))
            grams = runs(codes, ORDER)
            langs = step.column("lang").to_pylist()
            for i, lang in enumerate(langs):
                held.setdefault(lang, []).append(grams[ends[0, i] : ends[1, i]])
            size += len(grams)
            if size > FLUSH:
                yield from flush()
                size = 0
        yield from flush()

    rows = docs.where("text is not null and lang is not null").select("text", "lang")
    counts = _written(rows.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")), "runs")
    languages = sorted(r["lang"] for r in counts.select("lang").distinct().collect())
    if not languages:
        return None
    places = spark.createDataFrame(list(enumerate(languages)), "place int, lang string")
    model = Model(languages, {ORDER: counts.join(places, "lang").select(F.col("place").alias("lang"), "gram", "n")}, {}, 0)
    for order in range(ORDER - 1, 0, -1):  # below the highest order a count is the number of different letters before
        short = F.col("gram").bitwiseAND(F.lit(_mask(order))).alias("gram")
        model.counts[order] = _written(model.counts[order + 1].groupBy("lang", short).agg(F.count("*").alias("n")), f"runs-{order}")
    for order, table in model.counts.items():
        seldom = table.groupBy("lang").agg(F.count_if(F.col("n") == 1).alias("once"), F.count_if(F.col("n") == 2).alias("twice")).collect()
        cut = {r["lang"]: _discount(r["once"], r["twice"]) for r in seldom}
        model.discounts[order] = [cut[i] for i in range(len(languages))]
        model.tables[order] = _seen_and_left(table, model.discounts[order], order)
    model.letters = model.counts[1].select("gram").distinct().count()
    model.scored = scores(model, model.counts[ORDER].select("gram").distinct())
    return _calibrated(model)


def _discount(once: int, twice: int) -> float:
    """What Kneser and Ney take off each count, from how many runs were seen once and twice."""
    return float(np.clip(once / (once + 2 * twice), 0.1, 0.9)) if once and twice else 0.5


def predict(docs: DataFrame, model: Model | None, shared_bytes: int = SHARED_BYTES) -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` (share of the chosen language among all, 0 to 1) and ``accepted``; reads ``text`` alone.

    A table that has a column of one of these names is refused with an error; :func:`identified` takes any names.
    """
    names = ["lang_pred", "score", "accepted"]
    if any(free_name(docs.columns, c) != c for c in names):
        raise ValueError("the table has a column named lang_pred, score or accepted")
    return _judged(docs, model, names, shared_bytes)


def _verdicts(model: Model | None, scores: Scores | None, text: pa.Array) -> list[pa.Array]:
    """Language, score and whether it is accepted, of each text."""
    codes, ends, has = letters(text)
    size = len(text)
    name, score, accepted = np.full(size, UNKNOWN, object), np.zeros(size), np.zeros(size, bool)
    if model is not None and has.any():
        entropy = scores.entropy(codes, ends)[has]
        n = (ends[1] - ends[0])[has]
        best = entropy.argmin(axis=1)
        own = entropy[np.arange(len(best)), best]
        name[has] = np.array(model.languages, object)[best]
        score[has] = 1 / np.exp(-(entropy - own[:, None]) * np.minimum(n, 100)[:, None]).sum(axis=1)
        accepted[has] = own <= model.mean[best] + model.margin[best] + DEVIATIONS * model.deviation[best] / np.sqrt(n)
    return [pa.array(name, pa.string()), pa.array(score), pa.array(accepted)]


def _different_runs(docs: DataFrame) -> DataFrame:
    """``gram``: each run of ``ORDER`` letters of the texts once, in the shared folder (each order of the model asks for them)."""

    def cut(batches):
        held = np.zeros(0, np.uint64)
        for step in steps(batches):
            codes, ends, _ = letters(step.column("text"))
            held = np.union1d(held, runs(codes, ORDER)[_inside(codes, ends)])
            if len(held) > FLUSH:
                yield pa.RecordBatch.from_arrays([pa.array(signed(held))], ["gram"])
                held = held[:0]
        yield pa.RecordBatch.from_arrays([pa.array(signed(held))], ["gram"])

    return _written(docs.select("text").mapInArrow(cut, "gram long").distinct(), "different-runs")


def _judged(docs: DataFrame, model: Model | None, names: list[str], shared_bytes: int = SHARED_BYTES) -> DataFrame:
    """``docs`` with language, score and verdict under these names."""
    spark = docs.sparkSession
    kinds = [StringType(), DoubleType(), BooleanType()]
    schema = StructType([*docs.schema.fields, *[StructField(c, k) for c, k in zip(names, kinds)]])
    if model is None:
        return docs.select("*", *[F.lit(v).cast(k).alias(c) for c, k, v in zip(names, kinds, (UNKNOWN, 0.0, False))])
    new = scores(model, _different_runs(docs).join(model.scored.select("gram"), "gram", "left_anti"))
    scored = model.scored.unionByName(new)
    plain = Model(model.languages, {}, {}, model.letters, mean=model.mean, deviation=model.deviation, margin=model.margin)
    size = len(model.languages)
    if scored.count() * (8 + 4 * size) > shared_bytes:
        return _judged_in_chunks(docs, scored, plain, schema)
    table = scored.toArrow()
    known = Scores.of(table.column("gram").to_numpy().view(np.uint64), _rows(table.column("logs"), size))
    shared = spark.sparkContext.broadcast(cloudpickle.dumps((plain, known)))  # a plain broadcast would need the package on the workers

    def judge(batches):
        m, known = pickle.loads(shared.value)
        for step in steps(batches):
            yield pa.RecordBatch.from_arrays([*step.columns, *_verdicts(m, known, step.column("text"))], schema.names)

    return docs.mapInArrow(judge, schema)


def _judged_in_chunks(docs: DataFrame, scored: DataFrame, model: Model, schema: StructType) -> DataFrame:
    """The same, where the scores are too many for one array: each chunk of texts meets those of its own runs."""
    spark = docs.sparkSession
    chunk, grams = free_name(schema.names, "chunk"), free_name(schema.names, "grams")
    size, columns = len(model.languages), docs.columns

    def deal(batches):
        held, found, n = [], np.zeros(0, np.uint64), 0

        def flush():
            key = uuid.uuid4().hex  # a task that runs again writes new files; those of one attempt alone are kept
            for i, rows in enumerate(held):
                own = [signed(found).tolist() if i == 0 and j == 0 else None for j in range(rows.num_rows)]
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array([key] * rows.num_rows), pa.array(own, pa.list_(pa.int64()))], [*columns, chunk, grams])

        for step in steps(batches):
            codes, ends, _ = letters(step.column("text"))
            held.append(step)
            found = np.union1d(found, runs(codes, ORDER)[_inside(codes, ends)])
            n += len(codes)
            if n > CHUNK:
                yield from flush()
                held, found, n = [], found[:0], 0
        if held:
            yield from flush()

    path = scratch_path(spark, "chunks")
    fields = [*docs.schema.fields, StructField(chunk, StringType()), StructField(grams, ArrayType(LongType()))]
    docs.mapInArrow(deal, StructType(fields)).write.parquet(path)
    rows = spark.read.schema(StructType(fields)).parquet(path)
    own = rows.where(F.col(grams).isNotNull()).select(F.col(chunk).alias("chunk"), F.explode(grams).alias("gram")).join(scored, "gram").select("chunk", "gram", "logs")

    def judge(texts: pa.Table, table: pa.Table) -> pa.Table:
        known = Scores.of(table.column("gram").to_numpy().view(np.uint64), _rows(table.column("logs"), size))
        texts = texts.select(columns)
        done = [pa.Table.from_arrays([*step.columns, *_verdicts(model, known, step.column("text"))], schema.names) for step in steps(texts.to_batches())]
        return pa.concat_tables(done)

    return rows.drop(grams).groupBy(chunk).cogroup(own.groupBy("chunk")).applyInArrow(judge, schema)


def held_out(doc_id):
    """Whether a row is kept from training."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def identified(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text is accepted as one of the languages that ``docs`` itself teaches; columns as given, of any names."""
    names = [free_name(docs.columns, c) for c in ("lang_pred", "score", "accepted")]
    return _judged(docs, train(docs.select("text", "lang")), names).where(F.col(names[-1])).select(*docs.columns)
