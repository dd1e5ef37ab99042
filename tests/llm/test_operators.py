"""Each operator against brute force, an exact round trip, or labels, and on awkward tables."""

import collections
import hashlib
import math
import random
import re
import tracemalloc

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from graphloom.llm import imatch, language_id, line_cleaning, mixing, ngram_join, passages, queries, sentencepiece_scan, token_counts, warc, weak_labels
from graphloom.llm.words import Words, mix, shingles
from graphloom.session import scratch_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TABLES = ("documents", "pages", "embeddings")


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n)) + "."


@pytest.fixture(scope="module")
def awkward(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, and a column whose name clashes with inner ones."""
    base = prose(1, 120)
    rows = [
        (1, base, "en", "a", 1), (2, base, "en", "a", 1), (2, base, "en", "a", 1), (3, None, None, None, None), (4, "", "en", "a", 0),
        (None, base, "en", None, 1), (None, prose(5, 80), "en", "b", 1), (5, prose(2, 30_000), "de", "b", 1), (6, "x" * 50_000, None, "b", 1),
        (7, " \n\t ", "de", "c", 3), (8, "Short one.", "en", "c", 1), (9, prose(3, 90), "de", "é", 1),
    ]
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long, n long")


@pytest.fixture(scope="module")
def empty(awkward):
    return awkward.where("1 = 0")


def sql(tiny, text):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tiny}/{t}.parquet'")
    return con.sql(text)


def plain(rows):
    return sorted((tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_against_sql(spark, tiny, name):
    got, want = queries.QUERIES[name](spark, tiny), sql(tiny, queries.ORACLE[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got.select(*want.columns).collect()) == plain(want.fetchall())


def test_words():
    random.seed(1)
    texts = ["", None, "a", " a b", "é\tz\x0bq", "a" * 3000] + ["".join(random.choice("ab é\n") for _ in range(random.randint(0, 40))) for _ in range(200)]
    words, named = Words(pa.array(texts)), {}
    found = WORD.findall
    hashes = words.hashes().tolist()
    assert words.counts().tolist() == [len(found(t or "")) for t in texts]
    for word, h in zip([w for t in texts for w in found(t or "")], hashes):
        assert named.setdefault(word, h) == h
    assert len(set(named.values())) == len(named)
    grams, at = shingles(words.hashes(), words.offsets, 3)
    assert np.diff(at).tolist() == [max(len(found(t or "")) - 2, 0) for t in texts]


# 1


def test_line_cleaning_awkward(awkward, empty):
    rows = line_cleaning.clean(awkward.drop("n")).collect()
    assert len(rows) == awkward.count()
    null = next(r for r in rows if r.doc_id == 3)
    assert (null.n_words, null.kept, null.clean_text, null.base_failed) == (0, False, None, True)
    assert line_cleaning.clean(empty).count() == 0
    with pytest.raises(ValueError):
        line_cleaning.clean(awkward.withColumn("kept", F.lit(1)))


def test_lines_removed(spark):
    good = "\n".join(prose(i, 12) for i in range(4))
    text = "Home | About | Contact\n" + good + "\nAll rights reserved.\nno end of sentence\n\nAA BB CC DD EE FF GG HH."
    row = line_cleaning.clean(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert row.clean_text == good + "\n"
    assert row.kept and row.n_failed_lines == 4


def test_line_cleaning_keeps_clean_documents(spark, small):
    kept = line_cleaning.clean(spark.read.parquet(f"{small}/documents.parquet")).join(spark.read.parquet(f"{small}/labels.parquet"), "doc_id")
    share = {r["quality"]: r["k"] for r in kept.where("NOT base_failed").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("k")).collect()}
    assert share[1] > 0.99 and share[0] < 0.05


# 2


def test_imatch(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    rows = sorted(((r.doc_id, r.text) for r in docs.collect()), reverse=True)
    got = {r.doc_id: r for r in imatch.edits(docs).collect()}
    own = {r.doc_id: r.fingerprint for r in imatch.fingerprint(docs).collect()}
    prints = collections.defaultdict(set)
    for i, (k, text) in enumerate(rows):
        after, half = rows[(i + 1) % len(rows)], len(text) // 2
        edited = text[: len(text) - half] + after[1][:half]
        assert got[k].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert got[k].fingerprint == own[k] and got[k].n_chars == len(text)
        a, b = ([own[x][j : j + 8] for j in range(0, len(own[x]), 8)] for x in (k, after[0]))
        either = [(x, y) for x, y in zip(a, b) if x != "0" * 8 or y != "0" * 8]
        assert got[k].near_next == pytest.approx(sum(x == y for x, y in either) / len(either) if either else 1)
        prints[text].add(own[k])
    assert all(len(p) == 1 for p in prints.values())
    assert sum(r.near_edited for r in got.values()) > 10 * sum(r.near_next for r in got.values())


def test_imatch_awkward(spark, awkward, empty):
    rows = imatch.edits(awkward).collect()
    assert len(rows) == awkward.count() and imatch.edits(empty).count() == 0
    blank = next(r for r in rows if r.doc_id == 4)
    assert set(blank.fingerprint) == {"0"} and blank.n_chars == 0
    alone = imatch.edits(spark.createDataFrame([(1, "one two")], "doc_id long, text string")).first()
    assert alone.near_next == 1.0 and alone.edited_sha256 == hashlib.sha256(b"one one").hexdigest()


# 3


def test_compact_windows():
    rng = np.random.default_rng(1)
    for _ in range(200):
        n, width = int(rng.integers(1, 60)), int(rng.integers(1, 9))
        tokens = mix(rng.integers(0, 12, n).astype(np.uint64))
        at = np.array([0, *sorted(rng.integers(0, n + 1, 2).tolist()), n])
        got = set(zip(*(x.tolist() for x in passages.compact_windows(tokens, at, 3, width))))
        place = np.uint64(max((n - 1).bit_length(), 1))
        v = mix(tokens ^ np.uint64(3 * 0x9E3779B97F4A7C15 % (1 << 64)))
        v = (v >> place << place) | np.arange(n, dtype=np.uint64)
        want = set()
        for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
            for i in range(a, b):
                x = y = i
                while x > a and v[x - 1] > v[i]:
                    x -= 1
                while y < b - 1 and v[y + 1] > v[i]:
                    y += 1
                if y - x + 1 >= width:
                    want.add((i, x, y))
        assert got == want


def test_every_exact_passage_is_found(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    texts = {r.doc_id: WORD.findall(r.text) for r in docs.collect()}
    covered = {i: np.zeros(len(w), bool) for i, w in texts.items()}
    for r in passages.repeated_passages(docs).collect():
        assert r.of_doc_id < r.doc_id and r.to_word - r.from_word >= 49 and r.similarity >= 0.8
        covered[r.doc_id][r.from_word : r.to_word + 1] = True
    seen, repeats = {}, 0
    for i in sorted(texts):
        for j in range(len(texts[i]) - 49):
            if seen.setdefault(tuple(texts[i][j : j + 50]), i) != i:
                repeats += 1
                assert covered[i][j : j + 50].all()
    assert repeats > 1000
    assert sum(c.any() for c in covered.values()) < 0.2 * len(texts)


def test_near_passages_and_cutting(spark):
    passage = prose(9, 60).split()
    edited = passage[:30] + ["changed"] + passage[31:]
    rows = [(i, prose(100 + i, 70) + " " + " ".join(passage if i % 2 else edited) + " " + prose(200 + i, 70), i) for i in range(1, 9)] + [(20, " ".join(passage), 0), (21, prose(300, 150), 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    assert {r.doc_id for r in passages.repeated_passages(docs).collect()} == {2, 3, 4, 5, 6, 7, 8, 20}
    kept = {r.doc_id: r for r in passages.cut_passages(docs).collect()}
    assert 20 not in kept and kept[21].text == rows[-1][1] and kept[1].text == rows[0][1]
    assert all(len(WORD.findall(kept[i].text)) == 140 and kept[i].n_chars == len(kept[i].text) for i in range(2, 9))


def test_every_candidate_of_one_start_is_verified(spark):
    """Each earlier document quotes the beginning of a passage and holds all of it before or after; the later one begins with it."""
    rows, starts = [], range(0, 60, 2)
    for i in starts:
        passage = prose(1000 + i, 200).split()
        held = [" ".join(passage[:60]), prose(2000 + i, 300), " ".join(passage)]
        rows.append((i, " ".join(held if i % 4 else held[::-1])))
        rows.append((i + 1, " ".join(passage) + " " + prose(3000 + i, 100)))
    covered = {i + 1: np.zeros(300, bool) for i in starts}
    for r in passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        covered[r.doc_id][r.from_word : r.to_word + 1] = True
    assert [i for i, c in covered.items() if not c[:200].all()] == []


def test_stretches_of_many_pairs_are_verified_at_once():
    """Against sets of each stretch alone: edits, tokens that stand again and again, stretches too short to hold a passage."""

    def alone(b, a, width, percent):
        at = {}
        for i, t in enumerate(a):
            at.setdefault(t, i)
        todo = [([i for i, t in enumerate(b) if t in at], 0)] if min(len(a), len(b)) >= width else []
        while todo:
            shared, k = todo.pop()
            cuts = [0, *[i for i in range(1, len(shared)) if shared[i] - shared[i - 1] > passages.GAPS[k]], len(shared)]
            for run in (shared[x:y] for x, y in zip(cuts, cuts[1:])):
                if not run or run[-1] - run[0] + 1 < width:
                    continue
                x, y, to = run[0], run[-1], [at[b[i]] for i in run]
                shifts = sorted(j - i for i, j in zip(run, to))
                shift = int((shifts[(len(run) - 1) // 2] + shifts[len(run) // 2]) / 2)
                one, best = set(b[x : y + 1]), (0.0, 0, 0)
                for s, e in ((min(to), max(to)), (max(x + shift, 0), min(y + shift, len(a) - 1))):
                    other = set(a[s : e + 1])
                    if 100 * len(one & other) >= percent * len(one | other):
                        best = max(best, (len(one & other) / len(one | other), s, e))
                if best[0]:
                    yield x, y, best[1], best[2], best[0]
                elif k + 1 < len(passages.GAPS):
                    todo.append((run, k + 1))

    rng = random.Random(3)
    pairs = []
    for i in range(400):
        b = [rng.randrange((3, 60, 500, 2**32)[i % 4]) for _ in range(rng.randrange(1, 200))]
        a = list(b)
        for _ in range(rng.randrange(6)):
            x, n = rng.randrange(len(a)), rng.randrange(1, 25)
            a[x : x + rng.choice([0, n])] = [rng.randrange(2**32) for _ in range(n)]
        a = rng.choice([a, a[len(a) // 2 :] + a, a[rng.randrange(len(a)) :]])
        pairs.append((b, a) if rng.random() < 0.5 else (a, b))
    want = sorted((i, *r) for i, (b, a) in enumerate(pairs) for r in alone(b, a, 46, 80))
    flat = [(np.array([t for p in pairs for t in p[k]], np.uint32), np.cumsum([0, *[len(p[k]) for p in pairs]])) for k in (0, 1)]
    found = passages._verified(*flat[0], *flat[1], 46, 80)
    assert sorted((*r[:5], r[5] / r[6]) for r in found.tolist()) == want and len(want) > 100


def test_passages_around_a_frequent_line(spark):
    """Passages of which most is a line that stands in foreign contexts too, before, between and behind, over many partitions."""
    line = prose(5000, 44)
    around = lambda i: f"{prose(6000 + i, 8)} {line} {prose(7000 + i, 8)}"
    first, second, foreign = range(100, 140), range(300, 340), [*range(20), *range(200, 240), *range(400, 420)]
    texts = {i: f"{prose(10_000 + i, 60)} {prose(20_000 + i, 8)} {line} {prose(30_000 + i, 60)}" for i in foreign}
    texts |= {i: f"{prose(10_000 + i, 60)} {around(i % 100)} {prose(30_000 + i, 60)}" for i in (*first, *second)}
    docs = spark.createDataFrame(sorted(texts.items()), "doc_id long, text string")
    for n in (1, 40):
        covered = {i: np.zeros(180, bool) for i in second}
        for r in passages.repeated_passages(docs.repartition(n, "doc_id")).collect():
            assert r.of_doc_id < r.doc_id
            if r.doc_id in covered and r.of_doc_id == r.doc_id - 200:
                covered[r.doc_id][r.from_word : r.to_word + 1] = True
        assert [i for i, c in covered.items() if not c[60:120].all()] == []


def test_near_passages_of_frequent_lines(spark):
    """Near copies, each with a word changed in the frequent line that is most of them, around many lines in foreign contexts."""
    line = prose(5000, 44).split()
    changed = lambda i: " ".join([*line[:22], f"changed{i}", *line[23:]])
    around = lambda i, middle: f"{prose(6000 + i, 8)} {middle} {prose(7000 + i, 8)}"
    first, second, foreign = range(100, 140), range(300, 340), [*range(20), *range(200, 240), *range(400, 420)]
    texts = {i: f"{prose(10_000 + i, 60)} {around(20_000 + i, ' '.join(line))} {prose(30_000 + i, 60)}" for i in foreign}
    texts |= {i: f"{prose(10_000 + i, 60)} {around(i, ' '.join(line))} {prose(30_000 + i, 60)}" for i in first}
    texts |= {i: f"{prose(10_000 + i, 60)} {around(i - 200, changed(i))} {prose(30_000 + i, 60)}" for i in second}
    docs = spark.createDataFrame(sorted(texts.items()), "doc_id long, text string")
    for n in (1, 40):
        found = passages.repeated_passages(docs.repartition(n, "doc_id")).collect()
        assert {r.doc_id for r in found if r.of_doc_id == r.doc_id - 200} >= set(second)


def test_near_passages_of_frequent_tokens_alone(spark):
    """Two frequent lines with a word of their own between them: nothing that two documents share is rare."""
    one, other = prose(5001, 30), prose(5002, 30)
    texts = {i: f"{prose(10_000 + i, 60)} {one} {prose(20_000 + i, 60)} {other} {prose(30_000 + i, 60)}" for i in range(30)}
    texts |= {i: f"{prose(10_000 + i, 60)} {one} between{i} {other} {prose(30_000 + i, 60)}" for i in range(100, 140)}
    docs = spark.createDataFrame(sorted(texts.items()), "doc_id long, text string")
    for n in (1, 40):
        assert {r.doc_id for r in passages.repeated_passages(docs.repartition(n, "doc_id")).collect()} == set(range(101, 140))


def test_memory_of_passage_tasks():
    """A task's arrays while it cuts a million windows, and while it deals out a million places, and what it gives at once."""

    def most(rows) -> tuple[int, int]:
        tracemalloc.start()
        largest = max(batch.nbytes for batch in rows)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return peak, largest

    class Docs:
        def mapInArrow(self, cut, schema):
            return cut

    rng = np.random.default_rng(3)
    words = np.array([f"w{i}" for i in range(5000)])
    texts = [" ".join(words[rng.integers(0, 5000, 60_000)]) for _ in range(50)]
    docs = pa.RecordBatch.from_arrays([pa.array(range(50), pa.int64()), pa.array(texts)], ["doc_id", "text"])
    peak, largest = most(passages._window_rows(Docs(), 46)([docs] * 2))
    assert peak < 85e6 and largest < 8e6
    token, doc = rng.integers(0, 200_000, 1_000_000) << 1, np.repeat(np.arange(2000), 500)
    held = [np.column_stack([token, doc, np.tile(np.arange(500), 2000)])]
    peak, largest = most(passages._places(held, 46, 400, 9))
    assert peak < 105e6 and largest < 8e6


def test_passages_awkward(awkward, empty):
    assert {r.doc_id for r in passages.repeated_passages(awkward).collect()} == {2}
    cut = passages.cut_passages(awkward)
    assert cut.columns == awkward.columns and {r.doc_id for r in cut.collect()} == {None, 1, 3, 4, 5, 6, 7, 8, 9}
    assert passages.repeated_passages(empty).count() == 0 and passages.cut_passages(empty).count() == 0


# 4


def test_seats_by_highest_quotient():
    rng = random.Random(2)
    for _ in range(200):
        votes, house = [rng.randint(0, 50) for _ in range(rng.randint(1, 6))], rng.randint(0, 40)
        if sum(votes):
            want = [0] * len(votes)
            for _ in range(house):
                want[max(range(len(votes)), key=lambda i: (votes[i] / (2 * want[i] + 1), -i))] += 1
            assert mixing.seats(votes, house) == want


def test_targets():
    assert mixing.targets([10, 100], [3, 1], 165) == [20, 145]
    assert mixing.targets([], [], 0) == []


def test_mix_many_shards(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = mixing.mix(docs, shard_words=3_000).collect()
    by = collections.defaultdict(list)
    for r in rows:
        assert 0 <= r.taken <= 2 * r.size
        by[r.source].append(r)
    for part in by.values():
        assert abs(sum(r.taken for r in part) - part[0].target) <= max(0.02 * part[0].target, 64)
    assert sum(r["size"] for r in mixing.sized(mixing.mix_documents(docs)).collect()) == sum(r.taken for r in mixing.mix(docs).collect())


def test_mix_awkward(awkward, empty):
    rows = mixing.mix(awkward).collect()
    assert len(rows) == awkward.count() and all(r.taken <= 2 * r["size"] for r in rows)
    out = mixing.mix_documents(awkward)
    assert out.columns == awkward.columns and out.count() > 0
    assert mixing.mix(empty).count() == 0 and mixing.mix_documents(empty).count() == 0


# 5


def test_weak_labels_find_quality(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{small}/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    rows = weak_labels.score(docs).join(labels, "doc_id").collect()
    assert np.mean([(r["label"] == 1) == (r["quality"] >= 0.5) for r in rows]) > 0.97


def test_accuracies_are_estimated():
    rng = np.random.default_rng(3)
    truth = rng.random(20_000) < 0.8
    right = np.array([0.95, 0.9, 0.85, 0.7])
    given = np.where(rng.random((20_000, 4)) < right, truth[:, None], ~truth[:, None]).astype(int)
    patterns, counts = np.unique(given, axis=0, return_counts=True)
    posterior, chance, prior = weak_labels.estimate(patterns, counts.astype(float))
    assert abs(prior - 0.8) < 0.05
    assert np.abs(chance[1, :, 1] - right).max() < 0.05


def test_weak_labels_awkward(awkward, empty):
    rows = weak_labels.score(awkward).collect()
    assert len(rows) == awkward.count() and all(r.quality == 0 for r in rows if not (r.text or "").strip())
    assert weak_labels.score(empty).count() == 0


# 6


def test_archives_by_hand():
    payloads = [f"<p>{prose(i, 50)}</p>".encode() for i in range(300)] + [b""]
    frames = list(warc._frames(iter([warc._record(i, "http://x/é", p, None) for i, p in enumerate(payloads)])))
    data = warc.SEPARATOR.encode().join(frames)
    found = list(warc.read_records(data))
    assert [r["payload"] for _, r in found] == payloads and all(r["error"] is None for _, r in found)
    assert data[:4] == bytes.fromhex("5d2a4d18")
    assert [r["error"] for _, r in warc.read_records(data[:-3])][-1] == "frame is cut off"
    raw = warc._record(1, None, b"abc", None)
    for damaged in (raw.replace(b"Content-Length: 3", b"Content-Length: 4"), raw.replace(b"abc", b"abd"), raw[:-2], raw.replace(b"WARC/1.1", b"WARD/1.1"), raw.replace(b"WARC-Date", b"WARC-Dote")):
        assert warc.parse_record(damaged)["error"]


def test_archives_awkward(spark):
    rows = [(1, "u", "same"), (2, None, "same"), (None, "u", "same"), (3, "u", None), (4, "u", ""), (5, "a\nb", "ü" * 100_000), (5, "v", "other"), (5, "v", "other"), (6, "w", "tiny")]
    pages = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "page_id long, url string, html string, payload int")
    for least in (0, 10**6):
        path = scratch_path(spark, "warc")
        warc.write_archives(pages, path, least)
        got = warc.read_archives(spark, path).collect()
        assert len(got) == len(rows) and not any(r.error for r in got)
        types = collections.Counter((r.record_id[10:-1], r.record_type) for r in got)
        assert types[("1", "revisit")] == types[("", "revisit")] == types[("3", "revisit")] == (1 if least == 0 else 0)
        assert types[("5", "response")] == 3
    path = scratch_path(spark, "warc")
    warc.write_archives(pages.where("1 = 0"), path)
    assert warc.read_archives(spark, path).count() == 0


# 7


def test_kneser_ney(spark):
    texts = [("aa", "abab abcab!"), ("aa", "bca bac, Ab"), ("bb", "xyx yzz abz"), ("bb", "zzxy  y")]
    counts = {}
    for lang, t in texts:
        padded = "   " + " ".join("".join(c if c.isalpha() else " " for c in t.lower()).split()) + " "
        assert "".join(chr(int(c)) for c in language_id.letters(pa.array([t]))[0]) == padded
        for i in range(3, len(padded)):
            counts.setdefault(lang, collections.Counter())[padded[i - 3 : i + 1]] += 1
    pack = lambda g: sum(ord(c) << (16 * (len(g) - 1 - i)) for i, c in enumerate(g))
    model = language_id.train(spark.createDataFrame(texts, "lang string, text string"))
    asked = [*counts["aa"], *counts["bb"], "qqqq", "abcq", "xabc"]
    grams = spark.createDataFrame([(pack(g),) for g in set(asked)], "gram long")
    scored = {r.gram: r.logs for r in language_id.scores(model, grams).collect()}
    kinds = len({g[-1] for c in counts.values() for g in c}) + 1
    for i, c in enumerate(counts.values()):
        by = {4: c}
        for order in (3, 2, 1):
            by[order] = collections.Counter(g[1:] for g in by[order + 1])
        cut = {o: language_id._discount(sum(n == 1 for n in x.values()), sum(n == 2 for n in x.values())) for o, x in by.items()}

        def p(gram, order):
            gram = gram[-order:]
            low = p(gram, order - 1) if order > 1 else 1 / kinds
            total = sum(n for g, n in by[order].items() if g[:-1] == gram[:-1])
            if not total:
                return low
            different = sum(g[:-1] == gram[:-1] for g in by[order])
            return max(by[order][gram] - cut[order], 0) / total + cut[order] * different / total * low

        for gram in asked:
            assert scored[pack(gram)][i] == pytest.approx(math.log(p(gram, 4)), abs=1e-4)
        # the calibration holds every run, however rare
        surprise = {other: sum(n * -math.log(p(g, 4)) for g, n in c.items()) / sum(c.values()) for other, c in counts.items()}
        own = surprise.pop(model.languages[i])
        assert model.mean[i] == pytest.approx(own, abs=1e-4) and model.margin[i] == pytest.approx(max((min(surprise.values()) - own) / 2, 0.5), abs=1e-4)


def test_held_out_accuracy(spark, small):
    rows = queries.op7_language_id(spark, small).join(spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    out = [r for r in rows if r.held_out]
    assert len(out) > 200 and np.mean([r.lang == r.lang_pred for r in out]) > 0.99
    assert all(r.accepted and 0 <= r.score <= 1 for r in rows)


def test_language_id_awkward(spark, awkward, empty, small):
    rows = language_id.predict(awkward, language_id.train(awkward)).collect()
    assert len(rows) == awkward.count()
    assert all((r.lang_pred, r.score, r.accepted) == ("und", 0.0, False) for r in rows if r.doc_id in (3, 4, 7))
    assert language_id.identified(empty).count() == 0
    model = language_id.train(spark.read.parquet(f"{small}/documents.parquet"))
    noise = spark.createDataFrame([("zxqj wkvq pqzx jjqk vvxz qqwk zzzz kjq",), ("123 $",)], "text string")
    assert [r.accepted for r in language_id.predict(noise, model).collect()] == [False, False]


def test_language_id_in_chunks(spark, awkward, empty, small, monkeypatch):
    monkeypatch.setattr(language_id, "CHUNK", 50_000)
    docs = spark.read.parquet(f"{small}/documents.parquet")
    model = language_id.train(docs)
    for rows in (docs, awkward, empty):
        one, many = (sorted(language_id.predict(rows, model, shared_bytes=n).collect(), key=str) for n in (10**9, 0))
        assert one == many


def test_each_order_is_planned_alone(spark):
    """Spark plans and describes the whole of a plan anew after each of its shuffles, in the memory of the driver."""
    model = language_id.train(spark.createDataFrame([("en", "the cat"), ("de", "der hund")], "lang string, text string"))
    plan = language_id._probabilities(model, model.scored.select("gram"), language_id.ORDER)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") <= 6 and "Window" not in plan


def test_rare_runs_stay_in_the_model(spark):
    """One text among a million letters of others still teaches its runs."""
    docs = spark.createDataFrame([("en", prose(i, 5_000)) for i in range(50)] + [("en", "zyzzyva")], "lang string, text string")
    model = language_id.train(docs)
    assert model.counts[4].agg(F.sum("n")).first()[0] > 10**6
    zyzz = sum(ord(c) << (16 * (3 - i)) for i, c in enumerate("zyzz"))
    assert [r.n for r in model.counts[4].where(F.col("gram") == zyzz).collect()] == [1]


# 8


def exact_components(texts: dict, size: int, percent: int) -> dict:
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for i, t in texts.items():
        w = WORD.findall((t or "").translate(fold))
        sets[i] = {tuple(w[j : j + size]) for j in range(max(len(w) - size + 1, 1))} if w else set()
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize("size, percent", [(4, 85), (5, 80), (2, 60)])
def test_components_against_all_pairs(spark, monkeypatch, size, percent):
    monkeypatch.setattr(ngram_join, "BLOCK", 8)  # several cells in a canopy
    rng = random.Random(size)
    texts = {}
    for group in range(6):
        words = prose(group, rng.randint(3, 90)).split()
        for copy in range(rng.randint(1, 25)):
            edited = list(words)
            for _ in range(rng.randint(0, max(len(words) // 15, 1))):
                edited[rng.randrange(len(edited))] = f"w{rng.randrange(1000)}"
            texts[len(texts)] = " ".join(edited)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(docs, size, percent).collect()}
    assert got == exact_components(texts, size, percent)


def test_ngram_join_deletes_shuffles(spark, monkeypatch):
    """The shuffles of n-grams, canopies and cells go once what they give is written."""
    from pyspark.sql.readwriter import DataFrameWriter

    key, seen, write = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", {}, DataFrameWriter.parquet

    def noted(self, path, *more, **names):
        seen[path.split("/")[-1].split("-")[0]] = spark.conf.get(key, None)
        return write(self, path, *more, **names)

    monkeypatch.setattr(DataFrameWriter, "parquet", noted)
    base = [prose(i, 80) for i in range(10)]
    docs = spark.createDataFrame([(i, base[i % 10] + f" end{i}") for i in range(60)], "doc_id long, text string")
    result = ngram_join.near_duplicates(docs)
    assert {seen[x] for x in ("canopies", "survivors", "edges", "parents")} == {"true"} and spark.conf.get(key, None) is None
    assert {r.component_id for r in result.collect()} == set(range(10))


def test_sets_of_texts_against_sorted_words():
    texts = [prose(i, 5 + 7 * i) + (" again and again and again" * (i % 3)) for i in range(12)]
    texts[3:3] = ["two words", None, "", "Two WORDS", "one"]
    none = np.zeros(0, np.uint64)
    sets = ngram_join.Sets(pa.array(texts), 3, none, none)
    for i, t in enumerate(texts):
        words = (t or "").lower().split()
        grams = {tuple(words[j : j + 3]) for j in range(max(len(words) - 2, min(len(words), 1)))}
        key = sets.key[sets.at[i] : sets.at[i + 1]]
        assert sets.n[i] == len(grams) == len(key) and (np.diff(key.astype(np.float64)) >= 0).all() and (sets.text[sets.at[i] : sets.at[i + 1]] == i).all()
    assert sets.digest[3] == sets.digest[6] != sets.digest[7]


def test_ngram_join_awkward(awkward, empty):
    rows = ngram_join.near_duplicates(awkward).collect()
    assert len(rows) == awkward.count()
    assert sorted((r.component_id for r in rows if r.n_shingles == 116), key=str) == [1, 1, 1, 1]
    assert {r.component_id for r in rows if r.n_shingles == 0} == {3, 4, 7}
    kept = ngram_join.keep_first(awkward)
    assert kept.columns == awkward.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([1, 3, 4, 5, 6, 7, 8, 9, None, None], key=str)
    assert ngram_join.near_duplicates(empty).count() == 0


def test_sketches_of_long_texts_hold_different_values():
    """Among some 187,000 n-grams some share their 32 bits; the overlap of two sketches counts these once."""
    none = np.zeros(0, np.uint64)
    sets = ngram_join.Sets(pa.array([" ".join(map(str, range(1_000_000)))]), 4, none, none)
    sketch = np.frombuffer(sets.sketches()[0], np.uint32)
    assert len(sketch) > 100_000 and len(np.unique(sketch)) == len(sketch)
    assert ngram_join._overlaps([sketch], [sketch])[0, 0] == len(sketch)


# 9


def test_chunks_give_the_whole_segmentation():
    model = sentencepiece_scan.load()
    encoder = sentencepiece_scan.Encoder(model)
    random.seed(3)
    texts = ["", "a", "  x", "日本 語", "a" * 200, "characteristics" * 20, " " * 40 + "z"] + ["".join(random.choice("abe the😀 \n") for _ in range(random.randint(1, 120))) for _ in range(100)]
    for t in texts:
        whole = sentencepiece_scan.normalised(t)
        units = sentencepiece_scan._UNITS.findall(whole)
        encoder.units(units)
        want = [x for u in units for x in encoder.known[u][0]]
        assert sentencepiece_scan.decoded(model, want) == t
        for size in (16, 19, 50):
            lead = model["longest"] - 1
            rows = [(whole[max(s - lead, 0) : s + size], min(s, lead)) for s in range(0, len(whole), size)]
            if rows:
                reach = sentencepiece_scan.scan([encoder.transfer(*r) for r in rows])
                states = sentencepiece_scan.compose([encoder.entries(*r, x, y > sentencepiece_scan.LOW / 2) for r, x, y in zip(rows, reach, reach[1:])])
                assert [x for r, a, b in zip(rows, reach, states[1:]) for x in encoder.trace(*r, a, b)[1]] == want


def test_units_together_as_one_by_one():
    model = sentencepiece_scan.load()
    plain = sentencepiece_scan.Encoder(model)
    random.seed(4)
    texts = ["", "a\0b", "日本語" * 50, "x" * 300, "▁ ▁"] + ["".join(random.choice("abe the😀 \n\0") for _ in range(random.randint(0, 200))) for _ in range(60)]
    whole = [sentencepiece_scan.normalised(t) for t in texts * 2]
    for text, ids in zip(whole, sentencepiece_scan.segmented(model, whole)):
        units = sentencepiece_scan._UNITS.findall(text)
        plain.units(units)
        assert ids.tolist() == [x for u in units for x in plain.known[u][0]]
    assert all(len(x) == 0 for x in sentencepiece_scan.segmented(model, ["", ""]))


def test_ids_are_decoded_in_parts(monkeypatch):
    monkeypatch.setattr(sentencepiece_scan, "DECODED", 5)
    lists = [[1, 2, 3], None, [], [4, 5, 6], list(range(9)), [7]]
    batch = pa.RecordBatch.from_arrays([pa.array(lists, pa.list_(pa.int32()))], ["ids"])
    for b in (batch, batch.slice(1)):
        parts = list(sentencepiece_scan._by_ids(b))
        assert [x for p in parts for x in p.column("ids").to_pylist()] == b.column("ids").to_pylist()
        assert all(p.num_rows == 1 or sum(len(x or []) for x in p.column("ids").to_pylist()) <= 5 for p in parts) and len(parts) > 2


def test_segmentation_stays_in_bounds():
    """Arrays beside a step of texts: a worker has two to four neighbours and the heap in one executor."""
    import tracemalloc

    model, words = sentencepiece_scan.load(), [f"w{i}" for i in range(2_000)]
    random.seed(5)
    texts = [sentencepiece_scan.normalised(" ".join(random.choices(words, k=300))) for _ in range(sentencepiece_scan.TOGETHER // 1_500)]
    tracemalloc.start()
    sentencepiece_scan.segmented(model, texts)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 120_000_000


def test_round_trip(spark, awkward, empty, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    rows = sentencepiece_scan.decode(sentencepiece_scan.encode(docs, chunk=1_000)).collect()
    once = {r.doc_id: r.ids for r in sentencepiece_scan.encode(docs).collect()}
    assert len(rows) == docs.count() and all(r.text == r.decoded and r.ids == once[r.doc_id] for r in rows)
    rows = sentencepiece_scan.decode(sentencepiece_scan.encode(awkward)).collect()
    assert len(rows) == awkward.count() and all((r.text or "") == r.decoded for r in rows)
    assert sentencepiece_scan.encode(empty).count() == 0
    with pytest.raises(ValueError):
        sentencepiece_scan.encode(docs, chunk=3)


# 10


def test_token_counts(spark, awkward, empty):
    from tiktoken import Encoding

    path = scratch_path(spark, "tokens")
    token_counts.write_tokens(awkward, path)
    encoding = Encoding("t", pat_str=token_counts.PATTERN, mergeable_ranks=token_counts._ranks(token_counts.TOKENIZERS, token_counts.VOCABULARY), special_tokens={})
    want = collections.Counter(len(encoding.encode_ordinary(r.text or "")) for r in awkward.collect())
    for block in (2, 30, 1 << 20):
        got = token_counts.token_counts(spark, path, block_bytes=block).collect()
        assert collections.Counter(r.n_tokens for r in got) == want and all(r.ended for r in got)
        for _, n in collections.Counter(r.file for r in got).items():
            assert n
    path = scratch_path(spark, "tokens")
    token_counts.write_tokens(empty, path)
    assert token_counts.token_counts(spark, path).count() == 0


def test_blocks():
    n, last, lengths = token_counts.scan_block(np.array([5, 9, 9, 1, 2, 9, 3]), 9)
    assert (n, last, lengths.tolist()) == (7, 5, [1, 0, 2])


# pipeline


def test_pipeline_stages_awkward(spark, awkward, empty, tiny):
    docs = awkward
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, tiny)
        if i < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == awkward.columns
        path = scratch_path(spark, "stage")
        docs.write.parquet(path)
        docs = spark.read.parquet(path)
        assert stage(spark, empty, tiny).count() == 0
    assert docs.count() > 0


def test_pipeline(spark, tiny):
    out = corpus_pipeline.run(spark, tiny).collect()
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    kept = {i for i, c in exact_components({r.doc_id: r.text for r in docs.collect()}, 5, 80).items() if c[1] == i}
    # the mix repeats or leaves documents, but only of those that the join keeps
    assert {r.doc_id for r in out} <= kept and len({r.doc_id for r in out}) > 0.6 * len(kept)
    assert all(r.n_pieces == len(r.ids) for r in out)
