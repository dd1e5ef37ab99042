"""Operator 2: I-Match fingerprints. Of a text's terms those within a band of inverse document frequency are kept,
the distinct ones sorted, and hashed once for each of several randomised subsets of the lexicon.

A term is a word with A-Z lower-cased. The band holds the terms that between 1 / ``rare`` and 1 / ``common`` of all
documents have. So the lexicon has at most (mean distinct terms of a document) x ``rare`` entries, however many documents there
are; this bounded list is what is broadcast. The subsets keep from a half down to a 256th of the lexicon: the wide ones tell close texts
apart, the narrow ones still agree for texts that share a part.

A fingerprint is a string of 8 hexadecimal digits per subset, zeros where the text has no term of it. The likeness of two
fingerprints is the share of subsets with equal hashes among those where either is not empty; of two empty
fingerprints it is 1. A text without any term in the band is hashed by all of its terms.

Empty cases: a null text counts as empty, an empty text has an empty fingerprint. Repeated rows get a row each. Rows without ``doc_id``
have no next document: their next text is the empty one. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.words import STEP_BYTES, Words, mix, parts, signed, steps

RARE = 2_000
COMMON = 20
KEEP_BITS = (1, 1, 3, 3, 5, 5, 5, 5, *[7] * 8, *[8] * 8)
FLUSH = 2_000_000


def terms(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct term hashes of each text, and their ranges."""
    words = Words(column, fold_case=True)
    h, text = words.hashes(), words.text_of()
    order = np.lexsort((h, text))
    h, text = h[order], text[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    return h[new], np.searchsorted(text[new], np.arange(len(column) + 1))


def lexicon(docs: DataFrame, rare: int = RARE, common: int = COMMON) -> np.ndarray:
    """Sorted hashes of the terms in the band. Document frequencies count every row of ``docs(text)``."""

    def count(batches):
        held: list[np.ndarray] = []

        def flush():
            value, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(signed(value)), pa.array(n)], ["term", "n"])

        for step in steps(batches):
            held.append(terms(step.column("text"))[0])
            if sum(map(len, held)) > FLUSH:
                yield flush()
        if held:
            yield flush()

    total = docs.count()
    counts = docs.select("text").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    band = counts.where(F.col("n").between(max(2.0, total / rare), max(2.0, total / common))).select("term").toArrow()
    return np.sort(band.column("term").to_numpy().astype(np.int64).view(np.uint64))


def fingerprints(column: pa.Array, band: np.ndarray) -> np.ndarray:
    """A row of 32-bit hashes for each text, one for each subset; 0 is an empty subset."""
    h, at = terms(column)
    n = len(at) - 1
    text = np.repeat(np.arange(n), np.diff(at))
    inside = np.zeros(len(h), bool)
    if len(band):
        inside = band[np.minimum(np.searchsorted(band, h), len(band) - 1)] == h
    known = np.bincount(text[inside], minlength=n) > 0
    inside |= ~known[text]
    h, text = h[inside], text[inside]
    out = np.zeros((n, len(KEEP_BITS)), np.uint32)
    for k, bits in enumerate(KEEP_BITS):
        lot = mix(h ^ np.uint64((k + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
        chosen = (lot >> np.uint64(64 - bits)) == 0
        # the terms are distinct, so their sum stands for the sorted list
        total = np.zeros(n, np.uint64)
        np.add.at(total, text[chosen], mix(lot[chosen]))
        some = np.bincount(text[chosen], minlength=n) > 0
        out[:, k] = np.where(some, np.maximum(mix(total) >> np.uint64(32), 1), 0)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    either = ((a > 0) | (b > 0)).sum(axis=1)
    same = ((a == b) & (a > 0)).sum(axis=1)
    return np.where(either > 0, same / np.maximum(either, 1), 1.0)


def shown(f: np.ndarray) -> pa.Array:
    return pa.array(["".join(f"{x:08x}" for x in row) for row in f.tolist()], pa.string())


def fingerprint(docs: DataFrame, rare: int = RARE, common: int = COMMON) -> DataFrame:
    """``doc_id, fingerprint`` for each row of ``docs(doc_id, text)``."""
    band = docs.sparkSession.sparkContext.broadcast(lexicon(docs, rare, common))

    def run(batches):
        for step in steps(batches):
            yield pa.RecordBatch.from_arrays([step.column("doc_id"), shown(fingerprints(step.column("text"), band.value))], ["doc_id", "fingerprint"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fingerprint string")


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edits(docs: DataFrame, rare: int = RARE, common: int = COMMON) -> DataFrame:
    """Fingerprints of each text and of its edited text, whose last half is taken from the document with the next smaller ``doc_id``.

    Documents are dealt to ranges of ``doc_id``; the document at a range's border goes to both sides, and the largest to the
    smallest's range too, so that each finds its next one where it is. Texts travel once, compressed.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    band = spark.sparkContext.broadcast(lexicon(docs, rare, common))
    n = parts(spark)
    row = docs.agg(F.percentile_approx("doc_id", [i / (4 * n) for i in range(1, 4 * n)], 100_000).alias("cuts"), F.max("doc_id").alias("top")).first()
    top = row["top"]
    cuts = np.array(sorted({x for x in row["cuts"] or [] if x != top}), np.int64)

    def deal(batches):
        packer = zstandard.ZstdCompressor(level=1)
        for step in steps(batches):
            rows: list[tuple] = []
            for doc_id, text in zip(step.column("doc_id").to_pylist(), step.column("text").to_pylist()):
                raw = (text or "").encode()
                tie = int.from_bytes(hashlib.blake2b(raw, digest_size=7).digest(), "little")
                packed = packer.compress(raw)
                place = int(np.searchsorted(cuts, doc_id))
                rows.append((place, 0, doc_id, tie, packed))
                if place < len(cuts) and cuts[place] == doc_id:
                    rows.append((place + 1, 1, doc_id, tie, packed))
                if doc_id == top:
                    rows.append((0, 2, doc_id, tie, packed))
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["place", "lent", "doc_id", "tie", "packed"])

    def judged(ids: list, texts: list[str], following: list[str]) -> pa.RecordBatch:
        """``following`` has one text for each of ``ids``."""
        halves = [len(t) // 2 for t in texts]
        edited = [t[: len(t) - m] + f[:m] for t, m, f in zip(texts, halves, following)]
        odd = [i for i, f in enumerate(following) if i + 1 == len(texts) or f is not texts[i + 1]]
        seen = fingerprints(pa.array([*texts, *(following[i] for i in odd)], pa.string()), band.value)
        own, ahead = seen[: len(texts)], np.roll(seen[: len(texts)], -1, axis=0)
        ahead[odd] = seen[len(texts) :]
        changed = fingerprints(pa.array(edited, pa.string()), band.value)
        arrays = [
            pa.array(ids, pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited]),
            shown(own), shown(changed), pa.array(likeness(own, changed)), pa.array(likeness(own, ahead)),
        ]
        return pa.RecordBatch.from_arrays(arrays, [f.split()[0] for f in RESULT.split(", ")])

    def walk(batches) -> Iterator[pa.RecordBatch]:
        """Rows sorted by place and falling doc_id: each with the one after it. Lent rows are only followers."""
        reader = zstandard.ZstdDecompressor()
        ids: list = []
        texts: list[str] = []
        following: list[str] = []
        held, size = None, 0
        for batch in batches:
            for place, lent, doc_id, packed in zip(*(batch.column(c).to_pylist() for c in ("place", "lent", "doc_id", "packed"))):
                text = reader.decompress(packed).decode()
                if held is not None and held[0] == place and not held[1]:
                    ids.append(held[2])
                    texts.append(held[3])
                    following.append(text)
                    size += 2 * len(held[3])
                held = (place, lent, doc_id, text)
                if size > STEP_BYTES:
                    yield judged(ids, texts, following)
                    ids, texts, following, size = [], [], [], 0
        if ids:
            yield judged(ids, texts, following)

    def alone(batches):
        for step in steps(batches):
            texts = [t or "" for t in step.column("text").to_pylist()]
            yield judged([None] * len(texts), texts, [""] * len(texts))

    dealt = docs.where("doc_id is not null").mapInArrow(deal, "place int, lent int, doc_id long, tie long, packed binary").repartition(n, "place")
    ordered = dealt.sortWithinPartitions("place", "lent", F.desc("doc_id"), "tie")
    return ordered.mapInArrow(walk, RESULT).union(docs.where("doc_id is null").mapInArrow(alone, RESULT))
