"""Operator 9: SentencePiece encoding and decoding with a max-plus parallel scan for giant documents.

The best segmentation of a text is a longest path over its cuts. No piece has the blank mark after another character,
so a cut stands before every run of blanks and the stretches between such cuts (units) are segmented on their own, each
different unit of a step once (told apart by 64-bit hashes), all units of like length at a time with arrays.

A giant document is cut into chunks of ``chunk`` characters, wherever that falls. The state at a boundary is how
many characters before it the last cut lies; a chunk yields the matrix of best scores from each state at its begin to
each state at its end. Matrices combine by (max, +), and the scan gives the best scores of all states at all boundaries.
With these, a chunk knows for each state in which a path leaves it the one in which it enters; these maps are
composed from the text's end, and every chunk is traced back on its own. Chunks are rows, spread over the cluster.

Scores: a unigram model's own. The vocabulary at hand was made by merging and holds merge ranks in place of
log-probabilities, so for it a piece's score is its Zipf log-probability by rank, in sixteenths so that sums are exact.
Texts are handled as the model file says for it: no normalisation, a blank before the text, blanks as U+2581, unknown
characters as bytes. Of equally good segmentations the one whose last piece is longest wins, at every cut.

Empty cases: null and empty texts give no pieces and decode to null and to an empty text. A text that itself
holds U+2581 decodes with a blank in its place; everything else survives the round trip. Repeated rows and rows
without ``doc_id`` give a result row each; other columns are ignored.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from graphloom.llm.words import groups, mix, parts, steps

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
BLANK = "▁"
CHUNK = 16_384
#: Units up to this length are segmented many at a time.
UNIT = 64
LOW = -1e18
_UNITS = re.compile(f"{BLANK}+[^{BLANK}]*|[^{BLANK}]+")
_BEGIN = re.compile(f"(?<!{BLANK}){BLANK}")
_LEAD = np.uint64(44)
#: Bytes of text that are segmented together; arrays of some thirty times as many bytes stand beside them, in each of an executor's workers.
TOGETHER = 3_000_000
#: Ids that are decoded together.
DECODED = 500_000


def zipf_scores(n: int) -> np.ndarray:
    rank = np.arange(1, n + 1)
    return -np.round(16 * np.log(rank * (1 / rank).sum())) / 16


def load(path: str = MODEL, own_scores: bool | None = None) -> dict:
    """Pieces, scores and byte pieces of a model file as plain arrays. ``own_scores``: take the file's (None: where they are log-probabilities)."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=os.fspath(path))
    n = model.get_piece_size()
    scores = np.array([model.get_score(i) for i in range(n)])
    if own_scores is None:
        own_scores = bool((scores > -100).all())
    if not own_scores:
        scores = zipf_scores(n)
    special = [model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i) for i in range(n)]
    pieces = [model.id_to_piece(i) for i in range(n)]
    normal = np.array([i for i in range(n) if not special[i]])
    if any(BLANK in pieces[i].lstrip(BLANK) for i in normal):
        raise ValueError("a piece has a blank after another character; units would not be independent")
    values = np.array([_hash(pieces[i]) for i in normal], np.uint64)
    order = np.argsort(values)
    sharing = np.bincount((values >> _LEAD).astype(np.int64), minlength=1 << 64 - int(_LEAD))
    return {
        "sieve": sharing > 0, "first": (np.cumsum(sharing) - sharing).astype(np.int32), "deepest": int(sharing.max()),
        "pieces": pieces, "keys": values[order], "ids": normal[order].astype(np.int32), "scores": scores[normal][order],
        "longest": max(len(pieces[i]) for i in normal), "unknown": float(scores[normal].min() - 10),
        "bytes": [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)],
    }


_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def _hash(piece: str) -> int:
    h = np.zeros(1, np.uint64)
    for c in piece:
        h = h * _FACTOR + np.uint64(ord(c) + 1)
    return int(mix(h)[0])


def lookup(model: dict, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of the hashes are pieces, and their places. The leading bits sort most others out and lead to the first key that shares them."""
    lead = value >> _LEAD
    some = np.flatnonzero(model["sieve"][lead])
    value, at = value[some], model["first"][lead[some]]
    for _ in range(model["deepest"] - 1):
        at = np.minimum(at + (model["keys"][at] < value), len(model["keys"]) - 1)
    hit = model["keys"][at] == value
    return some[hit], at[hit]


def matches(model: dict, text: str) -> tuple[np.ndarray, np.ndarray]:
    """Scores and ids of the pieces that begin at each character, by length (last axis); -1 for an unknown character."""
    codes = code_points([text])[0].astype(np.uint64) + np.uint64(1)
    longest, width = model["longest"], len(codes)
    score, ids = np.full((width, longest + 1), LOW), np.full((width, longest + 1), -2, np.int32)
    h = np.zeros(width, np.uint64)
    for n in range(1, min(longest, width) + 1):
        h = h[: width - n + 1] * _FACTOR + codes[n - 1 :]
        row, at = lookup(model, mix(h))
        score[row, n], ids[row, n] = model["scores"][at], model["ids"][at]
    alone = ids[:, 1] == -2
    score[alone, 1], ids[alone, 1] = model["unknown"], -1
    return score, ids


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts after each other, and where each begins (one more entry for the end)."""
    at = np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)])
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), at


def _spread(counts: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Places ``starts[i] .. starts[i] + counts[i]`` for all i after each other."""
    before = np.cumsum(counts) - counts
    return np.arange(counts.sum()) + np.repeat(starts - before, counts)


def _distinct(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One place for each different unit, and for each unit which that is, by a 64-bit hash of its characters."""
    out, i = np.empty(len(starts), np.uint64), 0
    inverse = np.uint64(pow(int(_FACTOR), -1, 1 << 64))
    while i < len(starts):
        j = max(int(np.searchsorted(ends, starts[i] + (1 << 19), "right")), i + 1)
        begin, size = starts[i], int(ends[j - 1] - starts[i])
        up = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size, _FACTOR)]))
        down = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size, inverse)]))
        local = starts[i:j] - begin
        total = np.add.reduceat(mix(codes[begin : begin + size].astype(np.uint64) + np.uint64(1)) * up[:size], local)
        out[i:j] = mix(total * down[local])
        i = j
    _, first, which = np.unique(out, return_index=True, return_inverse=True)
    return first, which


def _lattices(model: dict, codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the best segmentation of units of like length, one unit a column, and how many ids each has. An unknown character ``c`` is ``-4 - c``."""
    width, n = int(sizes.max()), len(starts)
    place = np.arange(width)[:, None]
    inside = place < sizes[None, :]
    code = np.where(inside, codes[np.where(inside, starts[None, :] + place, 0)].astype(np.uint64) + np.uint64(1), np.uint64(0))
    best = np.full((width + 1, n), LOW)
    best[0] = 0
    back, piece = np.zeros((width + 1, n), np.int32), np.full((width + 1, n), -3, np.int32)
    for i in range(width):
        h = np.zeros(n, np.uint64)
        for length in range(1, min(model["longest"], width - i) + 1):
            h = h * _FACTOR + code[i + length - 1]
            end = i + length
            if length == 1:
                alone = best[i] + model["unknown"] > best[end]
                best[end][alone] = best[i][alone] + model["unknown"]
                back[end][alone] = 1
                piece[end][alone] = -3 - code[i][alone].astype(np.int32)
            column, at = lookup(model, mix(h))
            new = best[i][column] + model["scores"][at]
            better = new > best[end][column]  # of ties the first stays: the longest last piece
            column, at = column[better], at[better]
            best[end][column] = new[better]
            back[end][column] = length
            piece[end][column] = model["ids"][at]
    cut, each, found = sizes.astype(np.int64), np.arange(n), []
    while cut.any():
        found.append(np.where(cut > 0, piece[cut, each], -3))
        cut = cut - back[cut, each]
    ids = np.stack(found[::-1]).T
    return ids[ids != -3], (ids != -3).sum(axis=1)


def _spelled(model: dict, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unknown characters as their bytes."""
    odd = ids < -3
    if not odd.any():
        return ids, counts
    chars, which = np.unique(-4 - ids[odd], return_inverse=True)
    spelt = [np.array([model["bytes"][b] for b in chr(c).encode("utf-8", "surrogatepass")], np.int32) for c in chars.tolist()]
    sizes = np.ones(len(ids), np.int64)
    sizes[odd] = np.array([len(x) for x in spelt])[which]
    out = np.repeat(ids, sizes)
    out[np.repeat(odd, sizes)] = np.concatenate([spelt[i] for i in which.tolist()])
    return out, np.bincount(np.repeat(np.arange(len(counts)), counts), sizes, len(counts)).astype(np.int64)


def segmented(model: dict, texts: list[str]) -> list[np.ndarray]:
    """Ids of each text. A text begins with a blank or is one unit; each different unit is segmented once."""
    codes, text_at = code_points(texts)
    if not len(codes):
        return [np.zeros(0, np.int32)] * len(texts)
    first = codes == ord(BLANK)
    first[1:] &= codes[:-1] != ord(BLANK)
    first[text_at[:-1][np.diff(text_at) > 0]] = True
    starts = np.flatnonzero(first)
    ends = np.append(starts[1:], len(codes))
    one, which = _distinct(codes, starts, ends)
    begin, size = starts[one], (ends - starts)[one]
    counts, held, place = np.zeros(len(one), np.int64), [], np.zeros(len(one), np.int64)
    order, at, total = np.argsort(size, kind="stable"), 0, 0
    ordered = size[order]
    while at < len(order):
        small = int(ordered[at])
        if small > UNIT:
            part = order[at : at + 1]
            text = codes[begin[part[0]] : begin[part[0]] + small].tobytes().decode("utf-32-le", "surrogatepass")
            ids = np.array(Encoder(model).unit(text), np.int32)
            n = np.array([len(ids)])
        else:
            wide = small if small <= 16 else min(small * 5 // 4, UNIT)
            stop = min(int(np.searchsorted(ordered, wide, "right")), at + max(400_000 // small, 1))
            part = order[at:stop]
            ids, n = _spelled(model, *_lattices(model, codes, begin[part], size[part]))
        counts[part], place[part] = n, total + np.cumsum(n) - n
        held.append(ids)
        total += len(ids)
        at += len(part)
    counts, place = counts[which], place[which]
    ids = np.concatenate(held)[_spread(counts, place)]
    ends = np.concatenate([[0], np.cumsum(counts)])[np.searchsorted(starts, text_at)]
    return [ids[a:b] for a, b in zip(ends[:-1], ends[1:])]


def _trace(model: dict, text: str, begin: int, end: int, back: list[int], ids: np.ndarray) -> list[int]:
    found: list[int] = []
    while end > begin:
        start = end - back[end]
        piece = int(ids[start, back[end]])
        found += [piece] if piece >= 0 else [model["bytes"][b] for b in reversed(text[start:end].encode())]
        end = start
    return found[::-1]


class Encoder:
    """Paths through one text, character by character: units that are long, and the two ends of a chunk."""

    def __init__(self, model: dict):
        self.model, self.known = model, {}

    def unit(self, text: str) -> list[int]:
        _, back, ids = self.paths(text, 0, np.zeros((1, 1)))
        return _trace(self.model, text, 0, len(text), back[0], ids)

    def units(self, units: Iterable[str]) -> None:
        """The plain way, unit by unit: ids and score go to ``known``."""
        for u in dict.fromkeys(units):
            self.known[u] = (self.unit(u), float(self.paths(u, 0, np.zeros((1, 1)))[0][0, len(u)]))

    def paths(self, text: str, boundary: int, starts: np.ndarray) -> tuple[np.ndarray, list, np.ndarray]:
        """Best scores at all cuts of ``text`` and the ways back. ``starts[i, a]`` is what path i has at the cut ``a`` characters before ``boundary``."""
        score, ids = matches(self.model, text)
        best = np.full((len(starts), len(text) + 1), LOW)
        back = np.zeros((len(starts), len(text) + 1), np.int32)
        states = min(starts.shape[1] - 1, boundary)
        best[:, boundary - states : boundary + 1] = starts[:, : states + 1][:, ::-1]
        for j in range(boundary + 1, len(text) + 1):
            first = max(j - self.model["longest"], 0)
            begin = np.arange(first, j)
            new = best[:, first:j] + score[begin, j - begin][None, :]
            pick = new.argmax(axis=1)  # ties: the longest last piece
            best[:, j] = np.maximum(new[np.arange(len(new)), pick], LOW)
            back[:, j] = j - (first + pick)
        return best, back.tolist(), ids

    def parts(self, text: str, boundary: int) -> tuple[str, str, str | None]:
        """A chunk's head up to the first unit that begins in it, its whole units, and the last one (None: no unit begins in it)."""
        inner = _BEGIN.search(text, boundary)
        if inner is None:
            return text, "", None
        last = len(text[: text.rfind(BLANK) + 1].rstrip(BLANK))
        last = max(last, inner.start())
        return text[: inner.start()], text[inner.start() : last], text[last:]

    def transfer(self, text: str, boundary: int) -> np.ndarray:
        """Best scores of ``text[boundary:]`` from each state at its begin to each state at its end, up to what all paths share: the units that lie whole in it."""
        top = self.model["longest"]
        head, _, tail = self.parts(text, boundary)
        apart = np.where(np.eye(top, dtype=bool), 0.0, LOW)
        first = self.paths(head, boundary, apart)[0]
        ends = first[:, ::-1][:, :top] if tail is None else first[:, -1:] + self.paths(tail, 0, apart[:1, :1])[0][:, ::-1][:, :top]
        matrix = np.full((top, top), LOW)
        matrix[:, : ends.shape[1]] = np.maximum(ends, LOW)
        return matrix

    def ends(self, text: str, boundary: int, reach: np.ndarray, leave: int) -> tuple[int, list[int], str, list[int]]:
        """Where the path that leaves in state ``leave`` enters, the ids up to the first unit that begins in the chunk, the whole units, and the
        ids after these; ``reach`` has the best scores of the states at the begin."""
        head, rest, tail = self.parts(text, boundary)
        _, back, ids = self.paths(head, boundary, reach[None, :] - reach.max())
        end = len(head) - (leave if tail is None else 0)
        begin = end
        while begin > boundary:
            begin -= back[0][begin]
        before, after = _trace(self.model, head, begin, end, back[0], ids), []
        if tail is not None:
            _, back, ids = self.paths(tail, 0, np.zeros((1, 1)))
            after = _trace(self.model, tail, 0, len(tail) - leave, back[0], ids)
        return boundary - begin, before, rest, after

    def trace(self, text: str, boundary: int, reach: np.ndarray, leave: int) -> tuple[int, list[int]]:
        """Where the path that leaves in state ``leave`` enters, and the ids between."""
        enter, before, rest, after = self.ends(text, boundary, reach, leave)
        return enter, before + segmented(self.model, [rest])[0].tolist() + after

    def entries(self, text: str, boundary: int, reach: np.ndarray, possible: np.ndarray) -> list[int]:
        """The state in which a path enters, for each state in which it may leave. Where a unit begins in the chunk, all paths enter alike."""
        if self.parts(text, boundary)[2] is not None:
            return [self.ends(text, boundary, reach, 0)[0]] * len(possible)
        return [self.ends(text, boundary, reach, b)[0] if ok else 0 for b, ok in enumerate(possible)]


def normalised(text: str) -> str:
    return BLANK + text.replace(" ", BLANK) if text else ""


def decoded(model: dict, ids: Iterable[int]) -> str:
    """The text of a whole sequence of ids."""
    of_byte = {p: b for b, p in enumerate(model["bytes"])}
    out, raw = [], bytearray()
    for i in ids:
        if i in of_byte:
            raw.append(of_byte[i])
            continue
        if raw:
            out.append(raw.decode("utf-8", "replace"))
            raw = bytearray()
        out.append(model["pieces"][i])
    if raw:
        out.append(raw.decode("utf-8", "replace"))
    text = "".join(out).replace(BLANK, " ")
    return text[1:] if text.startswith(" ") else text


def scan(matrices: list[np.ndarray]) -> list[np.ndarray]:
    """Best scores of the states at each boundary from the text's begin; the last entry is at its end."""
    reach = [np.where(np.arange(len(matrices[0])) == 0, 0.0, LOW)]
    for m in matrices:
        reach.append(np.maximum((reach[-1][:, None] + m).max(axis=0), LOW))
    return reach


def compose(entries: list[list[int]]) -> list[int]:
    """States at all boundaries, from each chunk's map of leaving to entering states; the text ends with a cut."""
    states = [0]
    for chunk in entries[::-1]:
        states.append(chunk[states[-1]])
    return states[::-1]


def encode(docs: DataFrame, model_path: str = MODEL, chunk: int = CHUNK) -> DataFrame:
    """``doc_id, text, ids`` for each row of ``docs(doc_id, text)``; ``ids`` is an array of piece ids."""
    spark = docs.sparkSession
    model = load(model_path)
    if chunk < model["longest"]:
        raise ValueError(f"a chunk must have at least {model['longest']} characters, as the longest piece")
    shared = spark.sparkContext.broadcast(model)
    docs = docs.select("doc_id", "text")
    long = F.coalesce(F.char_length("text") > chunk, F.lit(False))
    narrow = np.uint16 if len(model["pieces"]) <= 1 << 16 else np.int32  # ids of chunks while they are shuffled

    def short(batches):
        for step in steps(batches, limit=TOGETHER):
            ids = segmented(shared.value, [normalised(t or "") for t in step.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([*step.columns, _lists(ids)], ["doc_id", "text", "ids"])

    def cut(batches):
        """Chunks with as many characters before them as a piece across the boundary may have."""
        lead = shared.value["longest"] - 1
        for step in steps(batches):
            for key, text in zip(step.column("key").to_pylist(), step.column("text").to_pylist()):
                text = " " + text  # blanks become three bytes where a chunk is read
                first = range(0, len(text), chunk)
                rows = [[key] * len(first), list(range(len(first))), [min(s, lead) for s in first], [text[max(s - lead, 0) : s + chunk] for s in first]]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, (pa.string(), pa.int32(), pa.int32(), pa.string()))], ["key", "n", "boundary", "text"])

    def read(step: pa.RecordBatch) -> list[str]:
        return [t.replace(" ", BLANK) for t in step.column("text").to_pylist()]

    def transfer(batches):
        encoder = Encoder(shared.value)
        for step in steps(batches):
            found = [encoder.transfer(t, b).tobytes() for t, b in zip(read(step), step.column("boundary").to_pylist())]
            yield pa.RecordBatch.from_arrays([step.column("key"), step.column("n"), pa.array(found, pa.binary())], ["key", "n", "matrix"])

    def forward(batches):
        size = shared.value["longest"]
        for group in groups(batches, ["key"]):
            reach = scan([np.frombuffer(m, float).reshape(size, size) for m in group.column("matrix").to_pylist()])
            rows = [[x.tobytes() for x in reach[:-1]], [(x > LOW / 2).tolist() for x in reach[1:]]]
            yield pa.RecordBatch.from_arrays([group.column("key").combine_chunks(), group.column("n").combine_chunks(), pa.array(rows[0], pa.binary()), pa.array(rows[1], pa.list_(pa.bool_()))], ["key", "n", "reach", "possible"])

    def enter(batches):
        encoder = Encoder(shared.value)
        for step in steps(batches):
            rows = zip(read(step), *(step.column(c).to_pylist() for c in ("boundary", "reach", "possible")))
            found = [encoder.entries(t, b, np.frombuffer(r, float), p) for t, b, r, p in rows]
            yield pa.RecordBatch.from_arrays([step.column("key"), step.column("n"), pa.array(found, pa.list_(pa.int32()))], ["key", "n", "entries"])

    def backward(batches):
        for group in groups(batches, ["key"]):
            states = compose(group.column("entries").to_pylist())
            yield pa.RecordBatch.from_arrays([group.column("key").combine_chunks(), group.column("n").combine_chunks(), pa.array(states[1:], pa.int32())], ["key", "n", "leave"])

    def trace(batches):
        encoder = Encoder(shared.value)
        for step in steps(batches, limit=TOGETHER):
            rows = zip(read(step), *(step.column(c).to_pylist() for c in ("boundary", "reach", "leave")))
            ends = [encoder.ends(t, b, np.frombuffer(r, float), x) for t, b, r, x in rows]
            inner = segmented(shared.value, [rest for _, _, rest, _ in ends])
            ids = [np.concatenate([np.array(x, narrow) for x in (before, ids, after)]).tobytes() for (_, before, _, after), ids in zip(ends, inner)]
            yield pa.RecordBatch.from_arrays([step.column("key"), step.column("n"), pa.array(ids, pa.binary())], ["key", "n", "ids"])

    def widened(batches):
        for batch in batches:
            ids = [np.concatenate([np.frombuffer(x, narrow) for x in row]) for row in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text"), _lists(ids)], ["doc_id", "text", "ids"])

    n = parts(spark)
    giants = docs.where(long).withColumn("key", F.sha2("text", 256))
    # copies of a text give equal chunks, of which one stays; each task drops its own copies before the shuffle
    chunks = giants.select("key", "text").mapInArrow(cut, "key string, n int, boundary int, text string").dropDuplicates(["key", "n"])
    by_text = lambda df: df.repartition(n, "key").sortWithinPartitions("key", "n")
    reached = by_text(chunks.mapInArrow(transfer, "key string, n int, matrix binary")).mapInArrow(forward, "key string, n int, reach binary, possible array<boolean>")
    entered = by_text(chunks.join(reached, ["key", "n"]).mapInArrow(enter, "key string, n int, entries array<int>"))
    left = entered.mapInArrow(backward, "key string, n int, leave int")
    traced = chunks.join(reached, ["key", "n"]).join(left, ["key", "n"]).mapInArrow(trace, "key string, n int, ids binary")
    whole = traced.groupBy("key").agg(F.transform(F.sort_array(F.collect_list(F.struct("n", "ids"))), lambda x: x["ids"]).alias("ids"))
    of_giants = giants.join(whole, "key").select("doc_id", "text", "ids").mapInArrow(widened, "doc_id long, text string, ids array<int>")
    return docs.where(~long).mapInArrow(short, "doc_id long, text string, ids array<int>").union(of_giants)


def _lists(ids: list[np.ndarray]) -> pa.Array:
    at = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate([np.zeros(0, np.int32), *ids]).astype(np.int32, copy=False), pa.int32()))


def _by_ids(batch: pa.RecordBatch) -> Iterable[pa.RecordBatch]:
    """``batch`` in slices of about ``DECODED`` ids, and one row at least."""
    total = np.cumsum(batch.column("ids").value_lengths().fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        end = max(int(np.searchsorted(total, (total[at - 1] if at else 0) + DECODED, "right")), at + 1)
        yield batch.slice(at, end - at)
        at = end


def decode(encoded: DataFrame, model_path: str = MODEL) -> DataFrame:
    """``encoded`` with ``decoded``, the text of ``ids``."""
    shared = encoded.sparkSession.sparkContext.broadcast(load(model_path))
    schema = StructType([*encoded.schema.fields, StructField("decoded", StringType())])

    def read(batches):
        model = shared.value
        pieces = np.array([p.replace(BLANK, " ") for p in model["pieces"]], object)
        plain = np.ones(len(pieces), bool)
        plain[model["bytes"]] = False
        for batch in (part for whole in batches for part in _by_ids(whole)):
            out = []
            for ids in batch.column("ids"):
                ids = ids.values.to_numpy()
                if plain[ids].all():
                    text = "".join(pieces[ids].tolist())
                    out.append(text[1:] if text.startswith(" ") else text)
                else:
                    out.append(decoded(model, ids.tolist()))
            yield batch.append_column("decoded", pa.array(out, pa.string()))

    return encoded.mapInArrow(read, schema)
