import duckdb
import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from graphloom.functions import names
from graphloom.functions.names import (
    byte_matrix,
    byte_rows,
    jaro_winkler,
    jaro_winkler_similarity,
    length_can_reach,
    lowest_jaro,
    pair_scores,
)
from graphloom.operators.similarity import cell_pairs

word = st.one_of(st.text("abc é", max_size=12), st.text("abcdefghijklmnopqrstuvwxyzéè ", max_size=30), st.text("ab", min_size=50, max_size=90))


def reference(xs, ys):
    t = pa.table({"x": xs, "y": ys})  # noqa: F841
    return np.array([r[0] for r in duckdb.sql("SELECT jaro_winkler_similarity(x, y) FROM t").fetchall()])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(word, word), min_size=1, max_size=40))
def test_scores_equal_the_database(pairs):
    xs, ys = [p[0] for p in pairs], [p[1] for p in pairs]
    a, b, each = byte_rows(pa.array(xs)), byte_rows(pa.array(ys)), np.arange(len(xs))
    got = pair_scores(a, b, each, each)
    assert ((got >= 0) & (got <= 1)).all()
    assert np.array_equal(got, reference(xs, ys))
    general = jaro_winkler(byte_matrix(*a), a[2], byte_matrix(*b), b[2])
    assert np.array_equal(got, general)


@settings(max_examples=40, deadline=None)
@given(st.lists(word, min_size=1, max_size=25), st.lists(word, min_size=1, max_size=25), st.sampled_from([0.7, 0.8, 0.9, 0.95]))
def test_cell_finds_every_pair(xs, ys, lowest):
    i, j, score = cell_pairs(pa.array(xs), pa.array(ys), lowest)
    every = reference([x for x in xs for _ in ys], [y for _ in xs for y in ys]).reshape(len(xs), len(ys))
    want = {(p, q) for p, q in zip(*np.nonzero(every >= lowest))}
    want |= {(p, q) for p in range(len(xs)) for q in range(len(ys)) if xs[p] == ys[q] == ""}
    assert set(zip(i.tolist(), j.tolist())) == want and len(i) == len(want)


def test_bound_is_safe():
    for prefix in range(5):
        jaro = lowest_jaro(0.8, prefix)
        assert jaro + 0.1 * prefix * (1 - jaro) >= 0.8 - 1e-12 or jaro == 0.7


def test_column_form(spark):
    df = spark.createDataFrame([("martha", "marhta"), ("", ""), (None, "a"), ("é", "è")], "x string, y string")
    rows = df.select(
        jaro_winkler_similarity(F.col("x"), F.col("y")).alias("s"), length_can_reach(F.col("x"), F.col("y"), 0.8).alias("l")
    ).collect()
    assert abs(rows[0]["s"] - 0.9611111111111111) < 1e-12 and rows[0]["l"]
    assert rows[1]["s"] == 0.0 and rows[2]["s"] is None
    assert abs(rows[3]["s"] - 2 / 3) < 1e-12


def test_a_floor_spares_pairs_and_loses_none(monkeypatch):
    rng = np.random.default_rng(3)
    letters = np.array(list("abcdeéñ z"))
    pool = ["".join(rng.choice(letters, rng.integers(0, 12))) for _ in range(120)] + ["a" * 80, "a" * 81, "ab" * 50]
    pool += [x + "s" for x in pool] + [x[:-1] for x in pool]
    left, right = (pa.array([pool[k] for k in rng.integers(0, len(pool), 20_000)]) for _ in range(2))
    each = np.arange(len(left))
    want = names.pair_scores(names.byte_rows(left), names.byte_rows(right), each, each)
    scored = []
    real = names.pair_scores
    monkeypatch.setattr(names, "pair_scores", lambda a, b, i, j, floor: scored.append(len(i)) or real(a, b, i, j, floor))
    assert (names.column_scores(left, right) == want).all()
    for floor in (0.6, 0.8, 0.9):
        got = names.column_scores(left, right, floor)
        assert (got[want >= floor] == want[want >= floor]).all() and (got[want < floor] < floor).all()
    assert scored[2] < 0.2 * len(left) and scored[3] < 0.1 * len(left)
