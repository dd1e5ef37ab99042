"""Hard negatives, chosen paths and the Merkle manifest against brute force, and on awkward tables."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import chosen_path, hard_negatives, merkle

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# --- operator 11 -----------------------------------------------------------------------------------------


def usable(row):
    return row[1] is not None and row[2] is not None and all(x is not None and math.isfinite(x) for x in row[2])


def mined(rows, positives=5, negatives=3):
    """Rows (id, label, vector, anchor) by brute force, with integers of Python."""
    kept = [(i, *r) for i, r in enumerate(rows) if usable(r)]
    whole = {i: [math.floor(256 * x) for x in v] for i, _, _, v, _ in kept}
    dot = lambda a, b: sum(x * y for x, y in zip(whole[a], whole[b]))
    place = lambda r: (r[1] is None, r[1] or 0, r[0])
    out = []
    for a in kept:
        if not a[4] or a[1] is None:
            continue
        same = sorted(((-dot(a[0], r[0]), *place(r)), r) for r in kept if r[2] == a[2] and r[0] != a[0])[:positives]
        for key, p in same:
            ps = -key[0]
            other = sorted((-dot(a[0], r[0]), *place(r)) for r in kept if r[2] != a[2] and 50 * ps <= 100 * dot(a[0], r[0]) <= 95 * ps)
            out += [(a[1], p[1], k, rows[n[-1]][0], ps, -n[0]) for k, n in enumerate(other[:negatives], 1)]
    return sorted(out, key=str)


VECTORS = "id long, label long, vector array<double>, anchor boolean"


def test_mining_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "SUB", 16)
    monkeypatch.setattr(hard_negatives, "CHUNK", 3)
    monkeypatch.setattr(hard_negatives, "BLOCK", 40)
    rng = random.Random(4)
    centre = [[rng.gauss(0, 1) for _ in range(12)] for _ in range(3)]
    rows = [(i, i % 3, [c + rng.gauss(0, 0.8) for c in centre[(i // 2) % 3]], i % 5 == 0) for i in range(150)]
    rows += [(200 + i, 1, rows[10][2], False) for i in range(30)]  # one vector many times
    got = hard_negatives.mine(spark.createDataFrame(rows, VECTORS))
    assert sorted(map(tuple, got.collect()), key=str) == mined(rows)


def test_mining_awkward(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, 1, [1.0, 2.0, 0.5], True), (0, 1, [1.0, 2.0, 0.5], True), (1, 1, [1.0, 2.0, 0.5], False), (2, 2, [0.6, 1.1, 0.2], False),
        (3, 2, [0.6, 1.1, 0.2], False), (None, 2, [0.6, 1.1, 0.2], True), (None, 1, [2.0, 2.0, 2.0], False), (4, None, [1.0, 1.0, 1.0], True),
        (5, 1, None, True), (6, 1, [1.0, None, 1.0], True), (7, 1, [1.0, nan, 1.0], True), (8, 2, [inf, 1.0, 1.0], True), (9, 2, [0.7, 1.0], True),
        (10, 2, [], True), (11, 3, [-1.0, -1.0, -1.0], True), (12, 3, [1.0, 1.0, 1.0], True), (13, 1, [0.0, 0.0, 0.0], True), (14, 2, [3e3, 1e2, 1.0], True),
    ]
    df = spark.createDataFrame([(*r, 1.0, 2) for r in rows], VECTORS + ", score double, p long")
    got = hard_negatives.mine(df)
    assert sorted(map(tuple, got.collect()), key=str) == mined(rows)
    assert hard_negatives.mine(df.where("1 = 0")).collect() == []
    assert hard_negatives.mine(df.where("label = 1")).collect() == []


def test_scores_beyond_doubles(spark):
    """Integers whose products a double cannot hold are still exact; vectors too long for a long take no part."""
    big = 2.0**22
    rows = [(0, 1, [big, big + 1 / 256, 3.0], True), (1, 1, [big, big, 7.0], False), (2, 2, [0.9 * big, 0.9 * big, 1.0], False), (3, 2, [0.7 * big, big, 1.0], False), (4, 2, [1e30, 1.0, 1.0], False)]
    assert sorted(map(tuple, hard_negatives.mine(spark.createDataFrame(rows, VECTORS)).collect()), key=str) == mined(rows[:4])


# --- operator 12 -----------------------------------------------------------------------------------------


def shingle_set(text, size):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + size]) for i in range(max(len(words) - size + 1, 1))} if words else set()


def components_of(rows, size, percent):
    sets = [shingle_set(t, size) for _, t in rows]
    label = list(range(len(rows)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                label[root(i)] = root(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[root(i)] = min(low.get(root(i), d), d)
    out = []
    for i, (d, _) in enumerate(rows):
        c = low.get(root(i)) if sets[i] else d
        out.append((d, len(sets[i]), c, d == c))
    return sorted(out, key=str)


def clusters(rng, groups, copies, words):
    """Texts that are edited at random, some just above and some just below the threshold, around a few originals."""
    out = []
    for g in range(groups):
        base = [f"w{rng.randint(0, 400)}" for _ in range(words)]
        for _ in range(copies):
            text = list(base)
            for _ in range(rng.randint(0, max(2, words // 25))):
                text[rng.randrange(words)] = f"x{rng.randint(0, 10**6)}"
            out.append(" ".join(text))
    return out


@pytest.mark.parametrize("small, weight, depth", [(1000, 2_000_000, 8), (4, 2_000_000, 8), (4, 600, 3)])
def test_paths_against_all_pairs(spark, monkeypatch, small, weight, depth):
    monkeypatch.setattr(chosen_path, "SMALL", small)
    monkeypatch.setattr(chosen_path, "WEIGHT", weight)
    monkeypatch.setattr(chosen_path, "DEPTH", depth)
    rng = random.Random(8)
    texts = clusters(rng, 4, 18, 60) + clusters(rng, 12, 3, 25) + [" ".join(f"y{rng.randint(0, 50)}" for _ in range(40)) for _ in range(40)]
    rows = [(1000 - i, t) for i, t in enumerate(texts)]
    got = chosen_path.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85)
    assert sorted(map(tuple, got.collect()), key=str) == components_of(rows, 3, 85)


def test_paths_awkward(spark):
    base, long = "One two THREE four five six seven eight", " ".join(f"v{i}" for i in range(30_000))
    rows = [
        (5, base), (3, base.lower()), (3, base), (9, None), (8, ""), (7, " \n\t"), (6, "just two"), (4, "JUST two"), (None, base), (None, "nobody else has this text"),
        (None, "nobody else has this text"), (2, long), (1, long + " end"), (10, "é" * 70_000), (11, "just  two"),
    ]
    df = spark.createDataFrame([(*r, i, i) for i, r in enumerate(rows)], "doc_id long, text string, digest long, node long")
    want = [(d, n, c, k or (d is None and c is None)) for d, n, c, k in components_of(rows, 3, 85)]
    assert sorted(map(tuple, chosen_path.near_duplicates(df, 3, 85).collect()), key=str) == sorted(want, key=str)
    assert chosen_path.near_duplicates(df.where("1 = 0"), 3, 85).collect() == []


def test_enough_trees():
    assert (chosen_path.trees_for(0.85), chosen_path.trees_for(0.8)) == (3, 4)


# --- operator 13 -----------------------------------------------------------------------------------------


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row, more=0):
    d, text, lang, source, n = row
    n = None if n is None else n + more
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (d, source, lang, n, text)))


def levels_of(nodes, fanout):
    out = [nodes]
    while len(nodes) > 1:
        nodes = [sha("".join(nodes[i : i + fanout])) for i in range(0, len(nodes), fanout)]
        out.append(nodes)
    return out


def manifest(rows, fanout=2):
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    own = {g: sorted((r for r in rows if r[2] == g), key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r))) for g in langs}
    trees = {g: levels_of([leaf_of(r) for r in own[g]], fanout) for g in langs}
    top = levels_of([trees[g][-1][0] for g in langs], fanout)
    out = []
    for k, g in enumerate(langs):
        for i, r in enumerate(own[g]):
            hit = r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            cur, proof = leaf_of(r, 1 if hit else 0), ""
            for at, tree in ((i, trees[g]), (k, top)):
                for level in tree[:-1]:
                    run = at // fanout * fanout
                    nodes = level[run : run + fanout]
                    proof += "".join(n for j, n in enumerate(nodes) if j != at - run)
                    nodes[at - run] = cur
                    cur, at = sha("".join(nodes)), at // fanout
            out.append((r[0], leaf_of(r), trees[g][-1][0], top[-1][0], sha(proof), cur, cur == top[-1][0]))
    return sorted(out, key=str)


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_hash_states():
    digests = [hashlib.sha256(bytes([i])).digest() for i in range(5)]
    nodes, state = merkle.from_bytes(b"".join(digests)), np.repeat(merkle._START, 5, axis=1)
    for n in range(3):
        assert [x.tobytes() for x in merkle.to_bytes(merkle.finish(state, n))] == [hashlib.sha256(d.hex().encode() * n).digest() for d in digests]
        state = merkle.absorb(state, merkle.hex_blocks(nodes))


@pytest.mark.parametrize("fanout, chunk_levels", [(2, 12), (2, 1), (2, 3), (3, 2)])
def test_manifest_against_one_tree(spark, fanout, chunk_levels):
    rng = random.Random(fanout)
    rows = [(rng.randint(0, 10**6), f"text {i} é", rng.choice(["en", "en", "de", "ß", "z", None]), "s", i) for i in range(90)]
    df = spark.createDataFrame(rows, DOCS)
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.lit(False))
    cells = [F.col(c) for c in merkle.FIELDS]
    raised = [F.col("n_chars") + 1 if c == "n_chars" else F.col(c) for c in merkle.FIELDS]
    leaves = df.select(F.col("lang").alias("group"), F.col("doc_id").alias("id"), merkle.leaf(cells).alias("leaf"), F.when(hit, merkle.leaf(raised)).otherwise(merkle.leaf(cells)).alias("replacement"))
    got = merkle.audit(leaves, fanout, chunk_levels).withColumn("verified", F.col("folded_root") == F.col("root"))
    assert sorted(map(tuple, got.collect()), key=str) == manifest(rows, fanout)


def test_manifest_awkward(spark):
    rows = [
        (1, "a", "en", "s", 1), (1, "a", "en", "s", 1), (1, "b", "en", "s", 1), (None, "a", "en", None, 2), (None, None, None, None, None), (7, "", "", "", 0),
        (8, "x" * 100_000, "de", "-", None), (-5, "é\x00😀", "é", "1:-", 2**63 - 1), (14, "t", "en", "s", None),
    ] + [(i, "t", "fr", "s", i) for i in range(40)]
    df = spark.createDataFrame([(*r, 1, "x", True) for r in rows], DOCS + ", pos long, leaf string, root boolean")
    assert sorted(map(tuple, merkle.tamper_audit(df).collect()), key=str) == manifest(rows)
    assert merkle.tamper_audit(df.where("1 = 0")).collect() == []
    assert sorted(map(tuple, merkle.tamper_audit(df.where("doc_id = -5")).collect()), key=str) == manifest([rows[7]])
