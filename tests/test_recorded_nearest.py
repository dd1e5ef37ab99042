"""Readers that record faults, targets of any number, and calls that are spread."""

import glob

import numpy as np
import pytest
from pyspark import TaskContext
from pyspark.sql import functions as F

from graphloom.operators import matching as M
from graphloom.operators.nearest import nearest_target
from graphloom.sources.recorded import file_lines, read_csv_recorded, read_ntriples_recorded


def test_csv_faults_have_a_place(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id;name\n1;"x;y"\n2\n\n3;a;b\n4;"open\n5;é\n')
    (tmp_path / "b.csv").write_bytes("name;id;town\nBé;6;Öl\nC;7\n".encode("latin-1"))
    (tmp_path / "c.csv").write_text("id;id\n8;9\n")
    (tmp_path / "d.csv").write_text("id;name\n")
    (tmp_path / "e.csv").write_text("﻿id;name\n10;z\n")
    rows, faults = read_csv_recorded(spark, str(tmp_path))
    assert {tuple(r) for r in rows.select("id", "name", "town").collect()} == {("1", "x;y", None), ("5", "é", None), ("6", "Bé", "Öl"), ("10", "z", None)}
    got = {(r["file"].rsplit("/", 1)[1], r["line"], r["value"], r["reason"]) for r in faults.collect()}
    assert got == {("a.csv", 2, "2", "cells"), ("a.csv", 4, "3;a;b", "cells"), ("a.csv", 5, '4;"open', "quote"), ("b.csv", 2, "C;7", "cells"), ("c.csv", 1, "8;9", "header")}
    with pytest.raises(ValueError, match="header"):
        read_csv_recorded(spark, str(tmp_path / "c.csv"))


def test_lines_of_split_files(spark, tmp_path):
    """A file in several splits: each line once, its place unique, the header found in the first split alone."""
    lines = ["id;t"] + [f"{i};{'x' * (i % 50)}" for i in range(4000)]
    (tmp_path / "big.csv").write_text("\n".join(lines) + "\nbroken\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    try:
        found = file_lines(spark, str(tmp_path)).collect()
        assert len({r["block"] for r in found}) > 3 and len({(r["block"], r["line"]) for r in found}) == len(found) == 4002
        rows, faults = read_csv_recorded(spark, str(tmp_path))
        assert rows.count() == 4000 and [r["value"] for r in faults.collect()] == ["broken"]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_triples_with_faults(spark, tmp_path):
    (tmp_path / "g.nt").write_text('<s> <p> <o> .\n# note\n\n<s> <p> <o> . # again\n<s> <p> "open .\n<s> <p> <o>\n')
    triples, faults = read_ntriples_recorded(spark, str(tmp_path))
    assert triples.count() == 1 and sorted((r["line"], r["value"]) for r in faults.collect()) == [(4, '<s> <p> "open .'), (5, "<s> <p> <o>")]


@pytest.mark.parametrize("block, chunk", [(2048, 32768), (7, 11), (1, 1000)])
def test_nearest_of_many_targets(spark, block, chunk):
    rng = np.random.default_rng(1)
    targets = [(int(t), [float(x) for x in rng.normal(size=5)]) for t in rng.permutation(40)] + [(100, [0.0] * 5), (101, None)]
    targets += [(50 + t, [2 * x for x in v]) for t, v in targets[:5]]  # ties go to the smaller target
    rows = [(i, "a", [float(x) for x in rng.normal(size=5)]) for i in range(60)] + [(60, None, None), (61, "z", [0.0] * 5), (None, "b", [1.0] * 5), (None, "b", [1.0] * 5)]
    vectors, wanted = spark.createDataFrame(rows, "i int, tag string, v array<double>"), spark.createDataFrame(targets, "t int, w array<double>")
    got = nearest_target(vectors, "v", wanted, "t", "w", ["i", "tag"], block, chunk).collect()

    def best(v):
        v = np.zeros(5) if v is None else np.array(v)
        scores = []
        for t, w in targets:
            w = np.zeros(5) if w is None else np.array(w)
            n = np.linalg.norm(v) * np.linalg.norm(w)
            scores.append((-round(float(v @ w / n), 9) if n else 0.0, t))
        return min(scores)

    want = sorted(((i, tag, best(v)[1], round(-best(v)[0], 6)) for i, tag, v in rows), key=str)
    assert sorted(((r["i"], r["tag"], r["target"], round(r["score"], 6) + 0.0) for r in got), key=str) == [(*w[:3], w[3] + 0.0) for w in want]
    assert nearest_target(vectors.where("1 = 0"), "v", wanted, "t", "w", ["i"]).collect() == []


def test_calls_are_made_once_and_spread(spark, tmp_path):
    folder = str(tmp_path)

    def call(payload):
        with open(f"{folder}/{TaskContext.get().partitionId()}", "a") as f:
            f.write(payload["column"] + "\n")
        return {"cible": "ex:fullName", "confiance": 0.5, "justification": "ok"}

    rows = [(i, f"zz{i % 40}", ["1"]) for i in range(200)] + [(200, "empty", [])]
    df = spark.createDataFrame(rows, "ord int, source_column string, samples array<string>").coalesce(1)
    got = M.match_resolver_only(df, resolver=M.CallResolver(call, tasks=8)).collect()
    assert len(got) == 201 and sum(r["calls"] for r in got) == 200 and {r["target_uri"] for r in got if r["source_column"] != "empty"} == {"ex:fullName"}
    made = {f: open(f).read().split() for f in glob.glob(f"{folder}/*")}
    assert len(made) == 8 and max(map(len, made.values())) <= 10 and sorted(x for v in made.values() for x in v) == sorted(f"zz{i}" for i in range(40))


def test_answers_are_parsed_once(spark):
    df = spark.createDataFrame([('{"cible": "a", "confiance": 1, "justification": "j"}',)], "answer string")
    plan = df.select(M.parse_answer(F.col("answer")).alias("a")).select("a.*")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") <= 1


def test_type_rules(spark):
    results = spark.createDataFrame([("t", 0, "id", "ex:employeeId", 0.9), ("t", 1, "n", "ex:fullName", 0.8), ("u", 0, "n", "ex:fullName", 0.8)], "src string, ord int, source_column string, target_uri string, confidence double")
    rules = M.mapping_from_matches(results, "src", classes={"t": ["ex:A", "ex:B"], "x": ["ex:C"]}).collect()
    assert sorted((r["predicate"], r["object_template"], r["term_type"]) for r in rules) == [
        ("ex:employeeId", "$(id)", "literal"), ("ex:fullName", "$(n)", "literal"), ("rdf:type", "ex:A", "iri"), ("rdf:type", "ex:B", "iri")]


def test_reports_are_written(spark, tmp_path):
    """A report with its time, from one scan of the scores, as a file; and the results of a table as another."""
    import json

    from graphloom.sources.tables import write_documents

    scores = spark.createDataFrame(
        [(i, v, 0.5, 0.5, f1, calls, 0.0) for i, (v, f1, calls) in enumerate([("A", 0.5, 0), ("B", 0.75, 8), ("C", 0.75, 2)])],
        "ord int, variant string, precision double, recall double, f1 double, llm_calls long, avg_latency_ms double",
    )
    report = M.comparison_report(scores, timestamp=True, elapsed_s=1.26)
    assert report._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") <= 1
    write_documents(report, str(tmp_path / "report"))
    (line,) = [x["value"] for x in spark.read.text(str(tmp_path / "report")).collect()]
    got = json.loads(line)
    assert got["elapsed_s"] == 1.3 and len(got["generated_at"]) == 19 and list(got["summary"]) == ["A", "B", "C"]
    assert got["finops_analysis"]["reduction_hybrid_vs_llm_only_pct"] == 75.0 and got["quality_analysis"]["best_f1_variant"] == "B"
    results = spark.createDataFrame([(0, "id", "ex:a", 0.9, "SBERT", "j"), (1, "x", "UNMATCHED", 0.0, "UNMATCHED", "k")], "ord int, source_column string, target_uri string, confidence double, method string, justification string")
    write_documents(M.results_envelope(results.withColumn("calls", F.lit(0))), str(tmp_path / "results"))
    (line,) = [x["value"] for x in spark.read.text(str(tmp_path / "results")).collect()]
    assert '"sbert_count":1' in line and '"unmatched":1' in line
