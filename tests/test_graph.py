import pytest
from pyspark.sql import functions as F

from graphloom.functions import rdf
from graphloom.operators import graph as G
from graphloom.operators import triples as T
from graphloom.session import scratch_path
from graphloom.sources.ntriples import malformed_lines, read_ntriples, triple_lines, write_ntriples
from graphloom.streaming.triples import stream_triples

EX = rdf.PREFIXES["ex"]

EMPLOYEE = "Matricule_RH string, last_name string, first_name string, date_nais string, departement string, contrat string, salaire_mensuel string, date_embauche string"
CUSTOMER = "ID_Client string, nom_complet string, email string, ville string"


@pytest.fixture(scope="module")
def frames(spark):
    return {
        "employees": spark.createDataFrame([("RH17215", "Carpentier", "Aimé", "1962-12-25", "Marketing", "CDI", "6455.26", "2020-12-08")], EMPLOYEE),
        "customers": spark.createDataFrame([("C-17215", "Aimé Carpentier", "francklucas@example.org", "EvrardBourg")], CUSTOMER),
    }


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_golden_subgraph(spark, frames):
    """One employee, one customer, one link: 17 edges and 17 nodes."""
    g = T.materialize(frames, [T.EMPLOYEE_MAPPING, T.CUSTOMER_MAPPING])
    links = spark.createDataFrame([(EX + "Employee_RH17215", EX + "Customer_C-17215")], "link_s string, link_o string")
    around = G.link_subgraphs(g, links).persist()
    assert around.count() == 17
    # the id and the two full terms of classes count by term; names are literals
    assert G.nodes(around).count() == 17
    assert G.edges(around).where("style = 'link'").select("label").first()["label"] == "owl:sameAs"
    styles = {r["label"]: r["style"] for r in G.nodes(around).collect()}
    assert styles["Employee_RH17215"] == "employee" and styles["Customer_C-17215"] == "customer" and styles["CDI"] == "value"
    # the link may already be part of the graph
    both = T.add_triple(g, EX + "Employee_RH17215", rdf.SAME_AS, EX + "Customer_C-17215")
    assert G.link_subgraphs(both, G.link_ends(both)).count() == 17
    assert G.link_subgraphs(g, G.link_ends(g)).count() == 0 and G.first_link(g).count() == 0


def test_null_gives_no_triple_and_terms_are_encoded(spark):
    df = spark.createDataFrame([("a b/ü*", None, "x"), (None, "y", "z")], CUSTOMER.replace(", ville string", ""))
    mapping = T.TableMapping("m", "t", "ex:C_$(ID_Client)", (T.Rule("ex:n", "$(nom_complet)"), T.Rule("ex:e", "$(email) $(ID_Client)"), T.Rule("ex:k", "const")))
    got = rows(T.materialize({"t": df}, [mapping]).select("s", "p", "o"))
    assert got == [(EX + "C_a%20b%2F%C3%BC%2A", EX + "e", "x a b/ü*"), (EX + "C_a%20b%2F%C3%BC%2A", EX + "k", "const")]
    with pytest.raises(KeyError, match="nom_complet"):
        T.materialize({"t": df.drop("nom_complet")}, [mapping])


def test_graph_is_a_set(spark, frames):
    twice = frames["employees"].unionByName(frames["employees"]).unionByName(frames["employees"].withColumn("contrat", F.lit("CDD")))
    assert not T.subjects_are_unique(twice, T.EMPLOYEE_MAPPING)
    g = T.materialize({"employees": twice}, [T.EMPLOYEE_MAPPING])
    assert g.count() == 11 and T.materialize({"employees": twice}, [T.EMPLOYEE_MAPPING], distinct="never").count() == 30
    same = T.TableMapping("s", "employees", "ex:E_$(Matricule_RH)", (T.Rule("ex:x", "$(contrat)"), T.Rule("ex:x", "$(departement)")))
    equal = frames["employees"].withColumn("departement", F.col("contrat"))
    assert T.materialize({"employees": equal}, [same]).count() == 1
    near = T.TableMapping("n", "employees", "ex:E_$(last_name)", (T.Rule("ex:x", "1"),))
    clash = frames["employees"].withColumn("last_name", F.col("Matricule_RH"))
    assert T.materialize({"employees": clash}, [near, T.TableMapping("o", "employees", "ex:E_$(Matricule_RH)", (T.Rule("ex:x", "1"),))]).count() == 1


def test_unique_subjects_skip_the_distinct(spark, frames):
    plan = T.materialize(frames, [T.EMPLOYEE_MAPPING, T.CUSTOMER_MAPPING])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Aggregate" not in plan


def test_mapping_rows_round_trip(spark):
    rules = T.mapping_rows([T.EMPLOYEE_MAPPING, T.CUSTOMER_MAPPING])
    schema = "mapping string, source string, subject_template string, predicate string, object_template string, term_type string, datatype string, lang string"
    frame = spark.createDataFrame([tuple(r.values()) for r in rules], schema)
    assert T.mappings_from_rows(frame) == [T.EMPLOYEE_MAPPING, T.CUSTOMER_MAPPING] == T.mappings_from_rows(rules)


TEXTS = ['quote " and \\ slash', "line\nbreak\r\ttab", "", "ends with \\", '\\n is not a break', "\x1f   é 漢 😀", '"', '" .', "x" * 30_000, 'a\\"b\n' * 3_000, "# no comment", "\\u0041"]


def test_ntriples_round_trip(spark):
    data = [(f"http://x/{i}", "http://x/p", t, "literal", dt, lang) for i, t in enumerate(TEXTS) for dt, lang in ((None, None), ("http://x/t", None), (None, "fr-CA"))]
    data += [("_:b1", "http://x/p", "_:b2", "iri", None, None), ("http://x/s", "http://x/p", "http://x/o", "iri", None, None)]
    schema = "s string, p string, o string, o_kind string, o_datatype string, o_lang string"
    df = spark.createDataFrame(data, schema)
    path = scratch_path(spark, "nt")
    assert write_ntriples(df, path) == len(data)
    assert rows(read_ntriples(spark, path)) == sorted(data, key=str)
    assert malformed_lines(spark, path).count() == 0
    # no triples at all still replace an older file
    assert write_ntriples(df.limit(0), path) == 0 and read_ntriples(spark, path).count() == 0


def test_ntriples_lines(spark):
    good = [
        ('<a:s> <a:p> "x\\u00e9\\U0001F600\\\\n" . # note', "xé😀\\n"),
        ("  _:b <a:p>   <a:o>.", "a:o"),
        ('<a:s>\t<a:p>\t"v"@en .', "v"),
        ('<a:s> <a:p> "a \\" . b" .', 'a " . b'),
    ]
    bad = ["nonsense", "<a:s> <a:p> .", '<a:s> <a:p> "open .', '<a:s> <a:p> "a" b" .', "<a:s> <a:p> <a:o>", '<a:s> "p" <a:o> .', '<a:s> <a:p> " .']
    path = scratch_path(spark, "lines")
    spark.createDataFrame([(x,) for x in [g for g, _ in good] + bad + ["", "# comment"]], "value string").write.text(path)
    assert sorted(r["o"] for r in read_ntriples(spark, path).collect()) == sorted(o for _, o in good)
    assert sorted(r["value"] for r in malformed_lines(spark, path).collect()) == sorted(bad)


def test_counts_and_validation(spark, frames):
    g = T.materialize(frames, [T.EMPLOYEE_MAPPING])
    report = T.validate_graph(g)
    assert report["triples"] == 10 and report["entities"] == {"ex:Employee": 1, "ex:Customer": 0} and len(report["warnings"]) == 1
    with pytest.raises(ValueError, match="empty"):
        T.validate_graph(g.limit(0))
    assert [tuple(r) for r in T.entity_counts(g, ["ex:Employee"]).collect()] == [(EX + "Employee", 1)]
    assert T.match_triples(g, p=rdf.RDF_TYPE).count() == 2 and T.match_triples(g).count() == 10
    assert T.terms_containing(g, "RH17215").count() == 10 and T.terms_containing(g, "CDI", "o").count() == 1


def test_labels_may_collide(spark):
    data = [("http://a#x", "p", "http://b/x", "iri", None, None)]
    g = spark.createDataFrame(data, "s string, p string, o string, o_kind string, o_datatype string, o_lang string")
    assert G.nodes(g).count() == 2
    assert [tuple(r) for r in G.nodes_by_label(g).collect()] == [("x", "http://a#x", 2)]


def test_prefixes(spark):
    assert rdf.expand_prefix("ex:a") == EX + "a" and rdf.expand_prefix("http://x/y") == "http://x/y" and rdf.expand_prefix("zz:a") == "zz:a"
    got = spark.createDataFrame([("ex:a",), ("zz:a",), ("http://x",), ("plain",)], "t string").select(rdf.expand_prefix_column(F.col("t")).alias("x"))
    assert [r["x"] for r in got.collect()] == [EX + "a", "zz:a", "http://x", "plain"]


def test_shapes(spark):
    data = [
        ("e:1", rdf.RDF_TYPE, EX + "E", "iri", None), ("e:1", EX + "d", "2020-01-01", "literal", rdf.XSD_DATE),
        ("e:2", rdf.RDF_TYPE, EX + "E", "iri", None), ("e:2", EX + "d", "x", "literal", None), ("e:2", EX + "d", "y", "literal", rdf.XSD_DATE),
        ("e:3", rdf.RDF_TYPE, EX + "E", "iri", None), ("e:4", EX + "d", "z", "literal", None),
    ]
    g = spark.createDataFrame([(*r, None) for r in data], "s string, p string, o string, o_kind string, o_datatype string, o_lang string")
    shape = G.Shape("ex:E", "ex:d", 1, 1, "xsd:date", r"^\d{4}")
    got = {(r["focus"], r["constraint"], r["found"]) for r in G.shape_violations(g, [shape]).collect()}
    assert got == {("e:2", "maxCount", 2), ("e:2", "datatype", 1), ("e:2", "pattern", 2), ("e:3", "minCount", 0)}


def test_stream(spark, frames):
    source, out, check = (scratch_path(spark, n) for n in ("in", "out", "check"))
    frames["customers"].write.parquet(source)
    stream = spark.readStream.schema(frames["customers"].schema).parquet(source)
    query = stream_triples(stream, T.CUSTOMER_MAPPING, out, check, available_now=True)
    query.awaitTermination(120)
    assert rows(read_ntriples(spark, out)) == rows(T.materialize(frames, [T.CUSTOMER_MAPPING]))
    assert triple_lines(stream.limit(0).selectExpr("'a' s", "'b' p", "'c' o", "'iri' o_kind", "'' o_datatype", "'' o_lang")).isStreaming


def test_ntriples_set_failing_mode_and_whole_iris(spark, tmp_path):
    (tmp_path / "g.nt").write_text("<http://a> <http://p> <http://b> .\n<http://a> <http://p> <http://b> .\nnonsense\n")
    path = str(tmp_path / "g.nt")
    assert read_ntriples(spark, path).count() == 1 and read_ntriples(spark, path, distinct=False).count() == 2
    with pytest.raises(Exception, match="malformed line"):
        read_ntriples(spark, path, fail=True).collect()
    one = spark.createDataFrame([("http://x.org/a?b=c",)], "url string").select(rdf.iri_from_template("$(url)").alias("u"))
    assert one.first()["u"] == "http://x.org/a?b=c"
    graph = read_ntriples(spark, path)
    assert T.add_triple(graph, "http://a", "http://p", "http://b").count() == 1


def test_a_line_is_parsed_once(spark, tmp_path):
    from graphloom.sources.ntriples import read_ntriples

    (tmp_path / "a.nt").write_text('<a> <b> "x\\n\\u00e9 \\\\u0041 \\"q\\""@en .\n<a> <b> <c> .\njunk\n')
    read = read_ntriples(spark, str(tmp_path / "a.nt"))
    assert {tuple(r) for r in read.collect()} == {("a", "b", 'x\né \\u0041 "q"', "literal", None, "en"), ("a", "b", "c", "iri", None, None)}
    plan = read._jdf.queryExecution().optimizedPlan().toString()
    # one pass cuts the line, one the literal
    assert plan.count("regexp_replace(") == 2
