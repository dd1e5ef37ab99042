"""A stored graph: pruning, joins without a shuffle, and additions."""

import re

import pytest
from pyspark.sql import functions as F

from graphloom.operators.triples import TRIPLE_COLUMNS
from graphloom.session import scratch_path
from graphloom.sources import graph_store as G
from graphloom.sources.ntriples import read_ntriples

SCHEMA = ", ".join(f"{c} string" for c in TRIPLE_COLUMNS)


def triples(spark, rows):
    return spark.createDataFrame([(*r, *[None] * (6 - len(r))) for r in rows], SCHEMA)


ROWS = [(f"s{i}", p, f"o{i}{p[-1]}", "literal", "d" if i % 2 else None, None if i % 3 else "fr") for i in range(60) for p in ("http://x/a", "http://x/b b=%2F")] + [("s1", "http://x/a", "more", "iri")]


@pytest.fixture()
def stored(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    name = "graph_" + scratch_path(spark, "t").rsplit("-", 1)[-1]
    assert G.store_graph(triples(spark, ROWS), name, scratch_path(spark, "store"), 4) == len(ROWS)
    yield name
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def everything(df):
    return sorted((tuple(r) for r in df.select(*TRIPLE_COLUMNS).collect()), key=str)


def test_what_is_stored_comes_back(spark, stored):
    assert everything(G.stored_graph(spark, stored)) == everything(triples(spark, ROWS))
    assert G.stored_pattern(spark, stored, s="s1").count() == 3 and G.stored_pattern(spark, stored, o="nothing").count() == 0


def test_a_predicate_reads_its_folder_alone(spark, stored):
    found = G.stored_pattern(spark, stored, p="http://x/a")
    assert found.count() == 61
    filters = re.search(r"PartitionFilters: \[([^\]]*)\]", found._jdf.queryExecution().toString())
    assert "http://x/a" in filters[1]
    assert {f.rsplit("/", 2)[-2] for f in found.select(F.col("s")).inputFiles()} == {"p=http%253A%252F%252Fx%252Fa"}


def test_subjects_meet_without_a_shuffle(spark, stored):
    both = G.subjects(spark, stored, {"a": "http://x/a", "b": "http://x/b b=%2F"})
    assert "Exchange" not in plan_of(both)
    assert both.count() == 61 and {tuple(r) for r in both.where("s = 's1'").collect()} == {("s1", "o1a", "o1F"), ("s1", "more", "o1F")}


def test_only_new_triples_are_shuffled(spark, stored):
    new = triples(spark, [("s1", "http://x/a", "more", "iri"), ("s6", "http://x/a", "o6a", "literal"), ("new", "http://x/c", "o", "iri")])
    missing = G.missing_triples(G.stored_graph(spark, stored), new, 4)
    assert plan_of(missing).count("Exchange hashpartitioning") == 1
    assert missing.count() == 2  # the second differs from the stored one by its language


def test_additions_keep_the_set(spark, stored):
    new = ROWS[:7] + [("s1", "http://x/a", "more", "iri"), ("é", "http://x/new", "1", "iri"), ("é", "http://x/new", "1", "iri"), ("s3", "http://x/a", None, "iri")]
    assert G.add_triples(spark, stored, triples(spark, new)) == 2
    assert G.add_triples(spark, stored, triples(spark, new)) == 0
    assert G.add_triples(spark, stored, triples(spark, [])) == 0
    assert everything(G.stored_graph(spark, stored)) == everything(triples(spark, [*ROWS, new[-1], new[-2]]))


def test_comments_after_literals(spark, tmp_path):
    lines = [
        r'<s> <p> "y" . # say "hi"', r'<s> <p> "a \" b"@fr .# "', r'<s> <p> "x"^^<d> .', r'<s> <p> "open . # "x', r'<s> <p> "two" "three" .', r'<s> <p> "end\\" .', r'<s> <p> "bad\" .',
        '<s> <p> "' + 'ab\\"' * 200_000 + '" . # long "one"',
    ]
    (tmp_path / "g.nt").write_text("\n".join(lines))
    got = {(r["o"][:12], len(r["o"]), r["o_datatype"], r["o_lang"]) for r in read_ntriples(spark, str(tmp_path)).collect()}
    assert got == {("y", 1, None, None), ('a " b', 5, None, "fr"), ("x", 1, "d", None), ("end\\", 4, None, None), ('ab"ab"ab"ab"', 600_000, None, None)}
