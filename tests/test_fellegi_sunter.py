"""Linkage with comparisons and rules of the user's choice against brute force."""

import collections
import datetime
import math
import random

import pytest

from graphloom.operators import fellegi_sunter as G

SCHEMA = "unique_id string, name string, born date, city string, amount double, extra string"
SETTINGS = G.Settings(
    comparisons=(G.similarity("name", "name"), G.closeness("born", "born", [0, 30], days=True), G.equality("city", "city"), G.closeness("amount", "amount", [0, 5.0])),
    rules=(("born",), ("name", "city")),
    pairs_per_record=40,
)


@pytest.fixture(scope="module")
def tables():
    rng = random.Random(5)

    def person(tag, i):
        name = rng.choice(["ana", "bela", "carlo", "dina maria", None])
        born = rng.choice([None] + [datetime.date(1990, 1, 1) + datetime.timedelta(days=15 * k) for k in range(4)])
        return (f"{tag}{i}", name, born, rng.choice(["x", "y", None]), rng.choice([None, 1.0, 4.0, 90.0]), "e")

    return [person("L", i) for i in range(60)], [person("R", i) for i in range(80)]


def graded(a, b):
    """Levels of a pair by hand; names here are equal or far apart."""
    name = -1 if a[1] is None or b[1] is None else 3 if a[1] == b[1] else 0
    born = -1 if a[2] is None or b[2] is None else (2 if a[2] == b[2] else 1 if abs((a[2] - b[2]).days) <= 30 else 0)
    city = -1 if a[3] is None or b[3] is None else int(a[3] == b[3])
    amount = -1 if a[4] is None or b[4] is None else (2 if a[4] == b[4] else 1 if abs(a[4] - b[4]) <= 5 else 0)
    return name, born, city, amount


def test_each_pair_once_with_its_levels(spark, tables):
    left, right = (spark.createDataFrame(rows, SCHEMA) for rows in tables)
    pairs = G.candidate_pairs(left, right, SETTINGS)
    got = {(r["unique_id_l"], r["unique_id_r"]): (*(r[g] for g in SETTINGS.gammas), r["hit_0"], r["hit_1"]) for r in pairs.collect()}
    want = {}
    for a in tables[0]:
        for b in tables[1]:
            first = a[2] is not None and a[2] == b[2]
            second = a[1] is not None and a[1] == b[1] and a[3] is not None and a[3] == b[3]
            if first or second:
                want[a[0], b[0]] = (*graded(a, b), first, second)
    assert pairs.count() == len(want) and got == want
    patterns = {tuple(r)[:-1]: r["pairs"] for r in G.pattern_table(pairs, SETTINGS).collect()}
    assert patterns == dict(collections.Counter(want.values()))


def test_training_and_scores(spark, tables):
    left, right = (spark.createDataFrame(rows, SCHEMA) for rows in tables)
    model, pairs = G.fit(left, right, SETTINGS)
    for table in (model.m, model.u):
        assert all(abs(sum(levels.values()) - 1) < 1e-6 for levels in table.values())
    assert [r for r, _, _ in model.runs] == [0, 1]
    assert model.m["name"] != model.m["born"]
    got = {(r["id_l"], r["id_r"]): r for r in G.scored(pairs, model, threshold=0.0).collect()}
    by_id = {r[0]: r for side in tables for r in side}
    for (i, j), row in got.items():
        bits = math.log2(SETTINGS.prior / (1 - SETTINGS.prior))
        for c, level in zip(SETTINGS.comparisons, graded(by_id[i], by_id[j])):
            if level >= 0:
                bits += math.log2(model.m[c.name][level] / model.u[c.name][level])
        assert abs(row["match_weight"] - bits) < 1e-9 and abs(row["match_probability"] - 1 / (1 + 2**-bits)) < 1e-9
    assert G.scored(pairs, model, threshold=1.1).count() == 0


def test_one_free_comparison_is_the_plain_model(spark, small):
    """With names and dates alone, blocked on the date, the model is that of the fixed linkage."""
    from graphloom.operators.linkage import Linkage, LinkageConfig
    from graphloom.plans.people import standardized

    a, b = standardized(spark, small)
    plain = Linkage.fit(a, b, LinkageConfig(pairs_per_record=10**6))
    settings = G.Settings(
        (G.similarity("name", "nom_comparaison"), G.equality("date", "date_comparaison")), (("date_comparaison",),), pairs_per_record=10**6
    )
    model, pairs = G.fit(a, b, settings)
    for k in range(4):
        assert abs(model.u["name"][k] - plain.model.u["name"][k]) < 1e-9 and abs(model.m["name"][k] - plain.model.m["name"][k]) < 1e-9
    assert {(r["id_l"], r["id_r"]) for r in G.scored(pairs, model).collect()} == {(r["id_l"], r["id_r"]) for r in plain.links().collect()}
    plain.release()


def test_missing_columns_and_empty_tables(spark, tables):
    left, right = (spark.createDataFrame(rows, SCHEMA) for rows in tables)
    with pytest.raises(KeyError, match="city"):
        G.candidate_pairs(left.drop("city"), right, SETTINGS)
    model, pairs = G.fit(left.where("1 = 0"), right, SETTINGS)
    assert pairs.count() == 0 and [s for _, s, _ in model.runs] == [0, 0]
    assert G.scored(pairs, model, threshold=0.0).count() == 0


def test_candidates_plan(spark, tables):
    """Rules are equi-joins, and names are compared in one Python step for each rule."""
    left, right = (spark.createDataFrame(rows, SCHEMA) for rows in tables)
    plan = G.candidate_pairs(left, right, SETTINGS)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_records_that_agree_in_all_are_compared_once(spark, tables):
    left, right = (spark.createDataFrame(rows + [(f"{r[0]}+{k}", *r[1:]) for r in rows[:9] for k in range(5)], SCHEMA) for rows in tables)
    every, once = G.candidate_pairs(left, right, SETTINGS), G.candidate_pairs(left, right, SETTINGS, alike_once=True)
    assert {tuple(r) for r in G.pattern_table(every, SETTINGS).collect()} == {tuple(r) for r in G.pattern_table(once, SETTINGS).collect()}
    assert once.count() < every.count()


def test_random_pairs_are_spread_over_tasks(spark, tables, monkeypatch):
    from graphloom.plans import skew

    left, right = (spark.createDataFrame(rows, SCHEMA) for rows in tables)
    want = G.random_levels(left, right, SETTINGS)
    asked = []
    spread = skew.spread_pairs
    monkeypatch.setattr(skew, "PAIRS_PER_TASK", 200)
    monkeypatch.setattr(G, "spread_pairs", lambda *a: asked.append([x.rdd.getNumPartitions() for x in spread(*a)]) or spread(*a))
    assert G.random_levels(left, right, SETTINGS) == want and asked == [[12, 12]]


def test_a_block_of_more_than_a_thousand_different_records(spark):
    """Above ``piece_rows`` blocks are cut: patterns, training and scores of records that are counted."""
    days = [datetime.date(1990, 1, 1), datetime.date(1990, 1, 16)]
    sides = [[(f"{t}{i}", f"{c * 9} {i}", days[i % 2], "x", 1.0, "e") for i in range(n)] for t, c, n in (("L", "a", 2_400), ("R", "b", 60))]
    sides = [[*rows, *[(f"{r[0]}+", *r[1:]) for r in rows[:5]]] for rows in sides]
    settings = G.Settings((G.equality("name", "name"), G.equality("city", "city")), (("born",), ("name", "city")), pairs_per_record=40)
    left, right = (spark.createDataFrame(rows, SCHEMA) for rows in sides)
    table = G.pattern_table(G.candidate_pairs(left, right, settings, alike_once=True), settings).collect()
    n = sum(a[2] == b[2] for a in sides[0] for b in sides[1])
    assert [(r["gamma_name"], r["gamma_city"], r["hit_0"], r["hit_1"], r["pairs"]) for r in table] == [(0, 1, True, False, n)]
    model, pairs = G.fit(left, right, settings)
    assert pairs.count() == n == G.scored(pairs, model, threshold=0.0).count()
