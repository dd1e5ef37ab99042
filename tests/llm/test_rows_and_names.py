"""Rows that repeat an id, rows without one, columns with the names of inner ones, seats of many unequal shards."""

import collections
import os
import random

import pytest

import corpus_pipeline
from graphloom.llm import language_id, mixing, ngram_join, passages
from graphloom.session import scratch_path
from tests.llm.test_operators import plain, prose, sql

INNER = ("score", "accepted", "lang_pred", "_id", "_row", "row", "_size", "size", "_spans", "spans", "_take", "taken", "shard", "end", "kept", "quality", "text_key", "Score", "quota")


@pytest.fixture(scope="module")
def clashing(spark):
    """Every inner name as a column, the same texts under one id, an id with two texts, rows without id, source, text or language."""
    base, other = prose(1, 120), prose(7, 140)
    rows = [
        (1, base, "en", "a", 1), (2, other, "en", "a", 2), (2, base + " " + prose(9, 200), "en", "a", 2), (2, "Short.", "en", "a", 2), (3, base, "en", None, 3),
        (None, base, "en", "a", 1), (None, None, None, None, None), (4, "", "de", "b", 0), (5, "Short.", "de", "b", 1), (5, "Short.", "de", "b", 1),
    ]
    names = [n for n in INNER if n != "Score"]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in names)
    return spark.createDataFrame([(*r, *[f"{n}{i}" for n in names]) for i, r in enumerate(rows)], schema)


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_take_any_names(spark, clashing, tiny, name, stage):
    for docs in (clashing, clashing.where("1 = 0"), clashing.withColumnRenamed("score", "SCORE")):
        out = stage(spark, docs, tiny)
        if name != "sentencepiece":
            assert out.schema.simpleString() == docs.schema.simpleString()
            # further columns stay with their row
            assert all(r["shard"][5:] == r["taken"][5:] == r["end"][3:] for r in out.collect())
        else:
            assert out.count() == docs.count()


def test_results_with_inner_names_are_refused(clashing):
    with pytest.raises(ValueError):
        language_id.predict(clashing, None)


def test_one_row_of_each_text_under_one_id(clashing):
    kept = ngram_join.keep_first(clashing).collect()
    assert max(collections.Counter((r.doc_id, r.text) for r in kept if r.doc_id is not None).values()) == 1
    assert sum(r.doc_id is None for r in kept) == 2


def test_passages_of_an_id_with_several_texts(spark):
    passage, short = prose(1, 80), "A short text."
    rows = [(1, passage), (1, short), (2, prose(2, 60) + " " + passage), (2, short), (2, prose(3, 300)), (3, prose(4, 200))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for n in (1, 3):
        found = passages.repeated_passages(docs.repartition(n)).collect()
        assert {(r.doc_id, r.of_doc_id) for r in found} == {(2, 1)}
        assert all(abs(r.from_word - 60) <= 4 and r.to_word == 139 for r in found)
        out = passages.cut_passages(docs.repartition(n)).collect()
        got = collections.Counter((r.doc_id, len(r.text.split())) for r in out)
        # only the text that holds the passage loses it
        assert got == collections.Counter([(1, 80), (1, 3), (2, 60), (2, 3), (2, 300), (3, 200)])


def test_rows_without_id_are_mixed_by_their_own_decision(spark):
    rng = random.Random(1)
    rows = [(None, " ".join(f"w{rng.randrange(10**6)}" for _ in range(20)), "s") for _ in range(400)]
    rows += [(7, f"{prose(i, 30)}", "t") for i in range(50)] + [(8, prose(1, 30), "t")] * 20
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    taken = sum(r.taken for r in mixing.mix(docs).collect())
    runs = [sorted(r.text for r in mixing.mix_documents(docs.repartition(n)).collect()) for n in (1, 5)]
    assert sum(len(t.split()) for t in runs[0]) == taken
    assert runs[0] == runs[1]


def test_seats_of_shards_by_highest_quotient(spark):
    rng = random.Random(4)
    parts = [("hot", [1_000_000] + [1_400] * 10, 1_014), (None, [0, 5], 3), ("even", [10] * 9, 4), ("none", [3, 4], 0)]
    parts += [(f"s{i}", [rng.randint(0, 60) for _ in range(rng.randint(1, 9))], rng.randint(0, 50)) for i in range(60)]
    rows = [(s, i, n, q) for s, sizes, q in parts for i, n in enumerate(sizes)]
    got = collections.defaultdict(dict)
    for r in mixing._shard_seats(spark.createDataFrame(rows, "source string, shard long, shard_size long, quota long")).collect():
        got[r.source][r.shard] = r.seats
    for s, sizes, q in parts:
        want = mixing.seats(sizes, q)
        assert [got[s].get(i, 0) for i in range(len(sizes))] == want, s


def test_many_shards_against_sql(spark, tiny, monkeypatch):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    got = mixing.mix(docs, shard_words=500).select("doc_id", "size", "source_size", "target", "taken")
    want = sql(tiny, mixing.SQL.replace(str(mixing.SHARD_WORDS), "500"))
    assert plain(got.select(*want.columns).collect()) == plain(want.fetchall())


def test_passages_leave_no_inner_folders(spark, tiny):
    root = os.path.dirname(scratch_path(spark, "any").removeprefix("file://"))
    before = set(os.listdir(root))
    cut = passages.cut_passages(spark.read.parquet(f"{tiny}/documents.parquet"))
    assert {x.split("-")[0] for x in set(os.listdir(root)) - before} == {"passages"}
    assert cut.count() > 0
