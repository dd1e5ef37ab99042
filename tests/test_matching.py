import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.functions.vectors import best_by_vectors, cosine
from graphloom.operators import evaluate as E
from graphloom.operators import matching as M

# The best score and target of the built-in encoder.
GOLDEN = {
    "ID_Client": (0.4330, "ex:employeeId"), "nom_complet": (0.6617, "ex:fullName"), "email": (0.4564, "schema:email"),
    "dt_naissance": (0.4215, "schema:birthDate"), "ville": (0.5423, "schema:addressLocality"), "ca_annuel": (0.3381, "ex:annualRevenue"),
    "segment": (0.2333, "ex:department"), "Matricule_RH": (0.0700, "schema:addressLocality"), "Nom_Famille": (0.5839, "ex:fullName"),
    "Prenom": (0.5345, "foaf:firstName"), "date_nais": (0.4326, "schema:birthDate"), "departement": (0.5118, "ex:department"),
    "contrat": (0.4292, "schema:jobTitle"), "salaire_mensuel": (0.2182, "ex:annualRevenue"), "date_embauche": (0.1800, "schema:birthDate"),
}


@pytest.fixture(scope="module")
def columns(spark):
    rows = [(i, c, [] if c == "segment" else ["v1", "v2"]) for i, c in enumerate(GOLDEN)]
    return spark.createDataFrame(rows, "ord int, source_column string, samples array<string>").persist()


def test_golden_encoder(columns):
    got = {r["source_column"]: (round(r["score"], 4), r["best_uri"]) for r in M.with_best_target(columns).collect()}
    assert got == GOLDEN


def test_golden_metrics(spark, columns):
    gold = M.gold_table(spark)
    forced = E.compute_metrics(M.match_forced(columns), gold).first()
    assert (forced["tp"], forced["fp"], forced["fn"], forced["tn"]) == (10, 5, 0, 0)
    assert (forced["precision"], forced["recall"], forced["f1"], forced["specificity"]) == (0.6667, 1.0, 0.8, 0.0)
    silent = M.CallResolver(lambda payload: None, min_wait=0)
    split = E.compute_metrics(M.match_hybrid(columns, resolver=silent), gold).first()
    assert (split["tp"], split["fp"], split["fn"], split["tn"]) == (10, 1, 1, 3)
    assert (split["precision"], split["recall"], split["f1"], split["specificity"]) == (0.9091, 0.9091, 0.9091, 0.75)


def test_threshold_is_inclusive_and_ties_go_first(spark):
    df = spark.createDataFrame([(0, "abc", ["x"]), (1, "zzz", ["x"])], "ord int, source_column string, samples array<string>")
    same = {"u:1": "abc", "u:2": "abc"}
    got = {r["source_column"]: r for r in M.match_hybrid(df, same, tau=1.0).collect()}
    assert got["abc"]["target_uri"] == "u:1" and got["abc"]["method"] == M.BY_ENCODER and got["abc"]["pass_no"] == 1
    assert got["zzz"]["target_uri"] == E.UNMATCHED and got["zzz"]["confidence"] == 0.0
    assert M.with_best_target(df, same).where("source_column = 'zzz'").first()["best_uri"] == "u:1"


@pytest.mark.parametrize(
    "answer, want",
    [
        ('{"cible": " ex:a ", "confiance": 0.5, "justification": "ok"}', ("ex:a", 0.5, "ok")),
        ('[{"cible": "ex:a", "confiance": 1, "justification": ""}, {}]', ("ex:a", 1.0, "")),
        ('{"cible": "ex:a", "confiance": "0.25", "justification": "x"}', ("ex:a", 0.25, "x")),
        ('{"cible": "ex:a", "justification": "no confidence"}', None),
        ('{"cible": "ex:a", "confiance": "high", "justification": "x"}', None),
        ("[]", None), ("no json", None), ("", None), (None, None),
    ],
)
def test_answers(spark, answer, want):
    got = spark.createDataFrame([(answer,)], "a string").select(M.parse_answer(F.col("a")).alias("x")).first()["x"]
    assert (tuple(got) if got else None) == want


def test_resolver_calls(spark, columns, tmp_path):
    """Retries until an answer comes; unknown targets, errors and empty columns end unmatched."""
    marks = str(tmp_path)

    def call(payload):
        import os

        name = payload["column"]
        if name == "Matricule_RH":
            if len(os.listdir(marks)) < 2:
                open(f"{marks}/{len(os.listdir(marks))}", "w").close()
                raise ConnectionError("busy")
            assert json.loads(payload["samples"]) == ["v1", "v2"] and "ex:employeeId" in payload["targets"]
            return [{"cible": "ex:employeeId", "confiance": 0.87654, "justification": "id"}]
        if name == "salaire_mensuel":
            return {"cible": "ex:unknown", "confiance": 0.9, "justification": "?"}
        raise ValueError("broken")

    got = {r["source_column"]: r for r in M.match_hybrid(columns, resolver=M.CallResolver(call, min_wait=0.01)).collect()}
    assert (got["Matricule_RH"]["target_uri"], got["Matricule_RH"]["confidence"], got["Matricule_RH"]["method"]) == ("ex:employeeId", 0.8765, "LLM")
    for c in ("salaire_mensuel", "date_embauche", "segment"):
        assert (got[c]["target_uri"], got[c]["method"], got[c]["confidence"]) == (E.UNMATCHED, E.UNMATCHED, 0.0)
    assert [got[c]["calls"] for c in ("ID_Client", "segment", "date_embauche")] == [0, 0, 1]
    only = {r["source_column"]: r for r in M.match_resolver_only(columns, resolver=M.CallResolver(call, min_wait=0.01)).collect()}
    assert only["segment"]["justification"] == "no values to ask about" and {r["method"] for r in only.values()} == {"LLM_ONLY"}
    never = M.CallResolver(lambda p: (_ for _ in ()).throw(TimeoutError()), attempts=2, min_wait=0.001)
    assert {r["target_uri"] for r in M.match_resolver_only(columns, resolver=never).collect()} == {E.UNMATCHED}


def test_vector_encoder(spark, columns):
    encoder = M.VectorEncoder(lambda texts: [[float(len(t)), 1.0] for t in texts])
    got = M.with_best_target(columns, {"u:short": "abc", "u:long": "x" * 400}, encoder).collect()
    assert {r["best_uri"] for r in got} <= {"u:short", "u:long"} and all(0 < r["score"] <= 1 for r in got)


def test_vectors(spark, monkeypatch):
    rows = [(0, [1.0, 0.0]), (1, [0.0, 0.0]), (2, None), (3, [1.0, 1.0]), (4, [-1.0, 0.0])]
    df = spark.createDataFrame(rows, "i int, v array<float>")
    targets = [[0.0, 1.0], [1.0, 0.0], [2.0, 0.0]]
    for limit in (32 * 1024 * 1024, 16):  # one call, and one call per target
        monkeypatch.setattr("graphloom.functions.vectors._TARGET_BYTES_PER_CALL", limit)
        got = {r["i"]: (round(r["b"]["score"], 6), -r["b"]["back"]) for r in df.select("i", best_by_vectors(F.col("v"), targets).alias("b")).collect()}
        assert got == {0: (1.0, 1), 1: (0.0, 0), 2: (0.0, 0), 3: (round(np.sqrt(0.5), 6), 0), 4: (0.0, 0)}
    assert [r[0] for r in df.orderBy("i").select(cosine(F.col("v"), F.array(F.lit(1.0), F.lit(0.0)))).collect()][:2] == [1.0, 0.0]


def test_column_table_of_an_empty_table(spark):
    df = spark.createDataFrame([], "k int, a string, b string")
    got = M.column_table(df, ["a", "b"], ["k"]).orderBy("ord").collect()
    assert [(r["ord"], r["source_column"], r["samples"]) for r in got] == [(0, "a", []), (1, "b", [])]


def test_scores_without_anything(spark):
    gold = M.gold_table(spark, {"a": None})
    rows = spark.createDataFrame([("a", E.UNMATCHED), ("new", E.UNMATCHED), ("new2", "x")], "source_column string, target_uri string")
    judged = {r["source_column"]: (r["verdict"], r["expected"], r["in_gold"]) for r in E.judge(rows, gold).collect()}
    assert judged == {"a": ("TN", "UNMATCHED", True), "new": ("TN", "UNMATCHED", False), "new2": ("FP", "UNMATCHED", False)}
    none = E.compute_metrics(rows.limit(0), gold).first()
    assert (none["precision"], none["recall"], none["f1"], none["specificity"]) == (0.0, 0.0, 0.0, 0.0)


def test_reports(spark, columns):
    results = M.match_hybrid(columns)
    document = json.loads(M.results_envelope(results).first()["document"])
    assert document["total_columns"] == 15 and len(document["results"]) == 15 and set(document["results"][0]) == set(M.RESULT)
    assert document["results"][0]["source_column"] == "ID_Client" and "timestamp" in document
    rows = [(0, "A", 0.5, 0.5, 0.8, 0, 0.0), (1, "B", 0.5, 0.5, 0.8, 10, 2.0), (2, "C", 0.5, 0.5, 0.8, 4, 2.0)]
    scores = spark.createDataFrame(rows, "ord int, variant string, precision double, recall double, f1 double, llm_calls long, avg_latency_ms double")
    compared = M.compare_variants(scores).first()
    assert compared["best_f1_variant"] == "A" and compared["reduction_hybrid_vs_llm_only_pct"] == 60.0
    report = json.loads(M.comparison_report(scores).first()["document"])
    assert list(report["summary"]) == ["A", "B", "C"] and report["finops_analysis"]["llm_calls_hybrid"] == 4
    counts = M.method_counts(results.limit(0)).first()
    assert counts["avg_latency_ms"] == 0.0 and counts["llm_calls"] == 0


def test_first_result_of_a_column(spark):
    judged = spark.createDataFrame([("a", "x", "TP", 1.0, "SBERT"), ("b", "y", "FP", 1.0, "SBERT")], "source_column string, target_uri string, verdict string, confidence double, method string")
    results = spark.createDataFrame([("a", 0.5, "LLM", 1), ("a", 0.25, "SBERT", 0)], "source_column string, confidence double, method string, ord int")
    got = {r["source_column"]: (r["confidence"], r["method"]) for r in M.first_result(judged, results).collect()}
    assert got == {"a": ("0.25", "SBERT"), "b": ("—", "—")}
