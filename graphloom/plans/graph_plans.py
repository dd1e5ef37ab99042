"""Named queries over the graph of the two person tables and over documents as triples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.rdf import RDF_TYPE, SAME_AS, expand_prefix_column, local_name, triple_line
from graphloom.operators.graph import (
    Shape,
    edges,
    first_link,
    first_subject,
    link_ends,
    link_subgraphs,
    nodes,
    nodes_by_label,
    preview,
    shape_violations,
)
from graphloom.operators.linkage import link_triples
from graphloom.operators.triples import (
    CUSTOMER_MAPPING,
    EMPLOYEE_MAPPING,
    Rule,
    TableMapping,
    add_triple,
    entity_counts,
    match_triples,
    materialize,
    terms_containing,
    union_graphs,
)
from graphloom.plans.linkage_plans import SQL_LINKS, fitted, linkage_sql
from graphloom.plans.people import SQL_SOURCES, employees_and_customers, table
from graphloom.session import scratch_path
from graphloom.sources.graph_store import add_triples, store_graph, stored_graph, stored_pattern, subjects
from graphloom.sources.ntriples import malformed_lines, read_ntriples, write_ntriples

FIRST_NAME = "http://xmlns.com/foaf/0.1/firstName"
FAMILY_NAME = "http://xmlns.com/foaf/0.1/familyName"
SHAPES = [
    Shape("ex:Employee", "foaf:familyName", min_count=1, max_count=1),
    Shape("ex:Employee", "schema:birthDate", min_count=1, max_count=1, datatype="xsd:date", pattern=r"^\d{4}-\d{2}-\d{2}$"),
    Shape("ex:Employee", "ex:monthlySalary", datatype="xsd:decimal", pattern=r"^[2-8]\d{3}$"),
    Shape("ex:Customer", "schema:email", min_count=1, max_count=1, pattern=r"^[a-z.]+@"),
    Shape("ex:Customer", "ex:fullName", min_count=1),
]
DOCUMENTS = TableMapping(
    "documents", "documents", "http://kg.projet.fr/ontology#Document_$(source)/$(doc_id)",
    (Rule("rdf:type", "ex:Document", "iri"), Rule("ex:text", "$(text)"), Rule("ex:lang", "$(lang)")),
)


def graph(spark: SparkSession, d: str) -> DataFrame:
    return materialize(employees_and_customers(spark, d), [EMPLOYEE_MAPPING, CUSTOMER_MAPPING])


def _one(mapping):
    def run(spark, d):
        return materialize(employees_and_customers(spark, d), [mapping])
    return run


def _links(spark, d):
    return link_triples(fitted(spark, d).links())


def _linked(spark, d):
    return union_graphs(graph(spark, d), _links(spark, d), distinct=False)


def _repeated(spark, d):
    """Rules whose subject is shared by many rows: one node per department and per town."""
    rules = (Rule("rdf:type", "ex:Group", "iri"), Rule("ex:member", "ex:Employee_$(Matricule_RH)", "iri"), Rule("ex:contract", "$(contrat)"))
    by_department = TableMapping("groups", "employees", "ex:Group_$(departement)", rules)
    return materialize(employees_and_customers(spark, d), [by_department])


def _roundtrip(spark, d):
    path = scratch_path(spark, "graph")
    write_ntriples(graph(spark, d), path)
    return read_ntriples(spark, path)


def _documents(spark, d):
    return materialize({"documents": table(spark, d, "documents")}, [DOCUMENTS])


def _documents_roundtrip(spark, d):
    path = scratch_path(spark, "documents")
    write_ntriples(_documents(spark, d), path)
    return read_ntriples(spark, path)


def _malformed(spark, d):
    """Lines of a file in which the lines of one class lack their end."""
    path = scratch_path(spark, "damaged")
    lines = graph(spark, d).select(
        "s", "o_datatype", triple_line(*[F.col(c) for c in ("s", "p", "o", "o_kind", "o_datatype", "o_lang")]).alias("value")
    )
    broken = F.when(F.col("o_datatype").isNotNull(), F.expr("left(value, length(value) - 2)")).otherwise(F.col("value"))
    lines.select(broken.alias("value")).write.text(path)
    return malformed_lines(spark, path)


def _stored(spark: SparkSession, triples: DataFrame) -> str:
    """A table of its own for ``triples``; returns its name."""
    path = scratch_path(spark, "store")
    name = "graph_" + path.rsplit("-", 1)[-1]
    store_graph(triples, name, path, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return name


def _stored_pattern(spark, d):
    return stored_pattern(spark, _stored(spark, graph(spark, d)), p=FIRST_NAME)


def _stored_subjects(spark, d):
    return subjects(spark, _stored(spark, graph(spark, d)), {"first": FIRST_NAME, "family": FAMILY_NAME})


def _stored_union(spark, d):
    """A stored graph of employees to which all triples are added, and then all once more."""
    name = _stored(spark, _one(EMPLOYEE_MAPPING)(spark, d))
    everything = graph(spark, d)
    fresh, none = add_triples(spark, name, everything.unionByName(everything)), add_triples(spark, name, everything)
    counts = stored_graph(spark, name).groupBy("p").agg(F.count(F.lit(1)).alias("triples"), F.count_distinct("s").alias("subjects"))
    return counts.withColumns({"added": F.lit(fresh).cast("bigint"), "added_again": F.lit(none).cast("bigint")})


def _added(spark, d):
    g = graph(spark, d)
    one = g.agg(F.min("s").alias("s"))
    linked = union_graphs(g, one.select(
        "s", F.lit(SAME_AS).alias("p"), F.col("s").alias("o"), F.lit("iri").alias("o_kind"),
        F.lit(None).cast("string").alias("o_datatype"), F.lit(None).cast("string").alias("o_lang")))
    return add_triple(linked, "http://kg.projet.fr/ontology#Graph", RDF_TYPE, "http://kg.projet.fr/ontology#Graph")


def _curies(spark, d):
    """Prefix expansion and local names over every predicate of the graph, per predicate."""
    g = graph(spark, d)
    short = F.concat(F.lit("ex:"), local_name(F.col("p")))
    return g.groupBy("p").agg(F.count(F.lit(1)).alias("triples")).select(
        local_name(F.col("p")).alias("local"), expand_prefix_column(short).alias("expanded"), "triples"
    )


def _shapes(spark, d):
    """Shape faults, with dates damaged and names doubled for some employees before the check."""
    g = graph(spark, d)
    number = F.regexp_extract("s", r"(\d+)$", 1).cast("long")
    damaged = g.withColumn(
        "o", F.when((F.col("p") == "https://schema.org/birthDate") & (number % 13 == 0), F.lit("unknown")).otherwise(F.col("o"))
    ).withColumn("o_datatype", F.when((F.col("p") == "https://schema.org/birthDate") & (number % 17 == 0), F.lit(None)).otherwise(F.col("o_datatype")))
    doubled = g.where((F.col("p") == "http://xmlns.com/foaf/0.1/familyName") & (number % 7 == 0)).withColumn("o", F.concat("o", F.lit("-bis")))
    return shape_violations(damaged.unionByName(doubled), SHAPES)


def _butterfly(spark, d):
    links = _links(spark, d)
    return link_subgraphs(graph(spark, d), link_ends(links))


QUERIES = {
    "triples_employees": _one(EMPLOYEE_MAPPING),
    "triples_customers": _one(CUSTOMER_MAPPING),
    "triples_shared_subjects": _repeated,
    "graph_union": graph,
    "graph_add_triple": _added,
    "ntriples_roundtrip": _roundtrip,
    "ntriples_documents_roundtrip": _documents_roundtrip,
    "ntriples_malformed": _malformed,
    "entity_counts": lambda s, d: entity_counts(graph(s, d), ["ex:Employee", "ex:Customer", "ex:Supplier"]),
    "triple_pattern": lambda s, d: match_triples(graph(s, d), p=FIRST_NAME),
    "stored_pattern": _stored_pattern,
    "stored_subjects": _stored_subjects,
    "stored_union": _stored_union,
    "terms_containing": lambda s, d: terms_containing(graph(s, d), "Employee").select("s").distinct(),
    "predicate_names": _curies,
    "graph_preview": lambda s, d: preview(graph(s, d), 300),
    "first_link": lambda s, d: first_link(_linked(s, d)),
    "first_subject": lambda s, d: first_subject(graph(s, d), "Customer"),
    "butterfly": _butterfly,
    "nodes": lambda s, d: nodes(_butterfly(s, d)),
    "edges": lambda s, d: edges(_butterfly(s, d)),
    "nodes_by_label": lambda s, d: nodes_by_label(graph(s, d)),
    "shape_violations": _shapes,
}

_EX, _XSD = "http://kg.projet.fr/ontology#", "http://www.w3.org/2001/XMLSchema#"


def _po(predicate: str, value: str, kind: str = "literal", datatype: str | None = None) -> str:
    dt = f"'{datatype}'" if datatype else "NULL"
    return f"{{'p': '{predicate}', 'o': {value}, 'o_kind': '{kind}', 'o_datatype': {dt}}}"


_EMP = ", ".join(
    [
        _po(RDF_TYPE, f"'{_EX}Employee'", "iri"),
        _po(RDF_TYPE, "'http://xmlns.com/foaf/0.1/Person'", "iri"),
        _po(_EX + "employeeId", "Matricule_RH"),
        _po("http://xmlns.com/foaf/0.1/familyName", "Nom_Famille"),
        _po(FIRST_NAME, "Prenom"),
        _po("https://schema.org/birthDate", "date_nais", datatype=_XSD + "date"),
        _po(_EX + "department", "departement"),
        _po("https://schema.org/jobTitle", "contrat"),
        _po(_EX + "monthlySalary", "salaire_mensuel", datatype=_XSD + "decimal"),
        _po("https://schema.org/startDate", "date_embauche", datatype=_XSD + "date"),
    ]
)
_CUS = ", ".join(
    [
        _po(RDF_TYPE, f"'{_EX}Customer'", "iri"),
        _po(RDF_TYPE, "'http://xmlns.com/foaf/0.1/Person'", "iri"),
        _po(_EX + "clientId", "ID_Client"),
        _po(_EX + "fullName", "nom_complet"),
        _po("https://schema.org/email", "email"),
        _po("https://schema.org/addressLocality", "ville"),
    ]
)
_UNNEST = "SELECT s, t.p AS p, t.o AS o, t.o_kind AS o_kind, t.o_datatype AS o_datatype, NULL::VARCHAR AS o_lang FROM (SELECT {s} AS s, unnest([{po}]) AS t FROM {src}) WHERE t.o IS NOT NULL"
SQL_EMPLOYEES = _UNNEST.format(s=f"'{_EX}Employee_' || url_encode(Matricule_RH)", po=_EMP, src="src_b")
SQL_CUSTOMERS = _UNNEST.format(s=f"'{_EX}Customer_' || url_encode(ID_Client)", po=_CUS, src="src_a")
SQL_GRAPH = f"graph AS (SELECT DISTINCT * FROM ({SQL_EMPLOYEES} UNION ALL {SQL_CUSTOMERS}))"


def graph_sql(select: str) -> str:
    return f"WITH {SQL_SOURCES.strip()}, {SQL_GRAPH}\n{select}"


_LINKED = f"same AS ({SQL_LINKS})"
_FLY = f"""fly AS (
  SELECT same.s AS link_s, same.o AS link_o, graph.* FROM same JOIN graph ON graph.s = same.s OR graph.s = same.o
  UNION ALL
  SELECT s, o, s, p, o, 'iri', NULL, NULL FROM same
)"""


def fly_sql(select: str) -> str:
    return linkage_sql(f", {SQL_GRAPH}, {_LINKED}, {_FLY}\n{select}")


_LOCAL = "split_part(split_part({x}, '#', -1), '/', -1)"
_NODES = f"""SELECT term, kind, {_LOCAL.format(x='term')} AS label, substr(min(style), 3) AS style FROM (
  SELECT s AS term, 'iri' AS kind, CASE WHEN contains(s, 'Employee') THEN '1-employee' WHEN contains(s, 'Customer') THEN '2-customer' ELSE '3-subject' END AS style FROM {{g}}
  UNION ALL SELECT o, o_kind, '4-value' FROM {{g}}) GROUP BY term, kind"""
_DOCS = f"""SELECT '{_EX}Document_' || url_encode(source) || '/' || doc_id AS s, t.p AS p, t.o AS o, t.o_kind AS o_kind, NULL::VARCHAR AS o_datatype, NULL::VARCHAR AS o_lang
FROM (SELECT *, unnest([{_po(RDF_TYPE, f"'{_EX}Document'", 'iri')}, {_po(_EX + 'text', 'text')}, {_po(_EX + 'lang', 'lang')}]) AS t FROM documents)"""

ORACLE = {
    "triples_employees": graph_sql(SQL_EMPLOYEES),
    "triples_customers": graph_sql(SQL_CUSTOMERS),
    "triples_shared_subjects": graph_sql(
        "SELECT DISTINCT * FROM (" + _UNNEST.format(
            s=f"'{_EX}Group_' || url_encode(departement)",
            po=", ".join([_po(RDF_TYPE, f"'{_EX}Group'", "iri"), _po(_EX + "member", f"'{_EX}Employee_' || url_encode(Matricule_RH)", "iri"), _po(_EX + "contract", "contrat")]),
            src="src_b",
        ) + ")"
    ),
    "graph_union": graph_sql("SELECT * FROM graph"),
    "graph_add_triple": graph_sql(
        f"""SELECT * FROM graph UNION SELECT min(s), '{SAME_AS}', min(s), 'iri', NULL, NULL FROM graph
        UNION SELECT '{_EX}Graph', '{RDF_TYPE}', '{_EX}Graph', 'iri', NULL, NULL"""
    ),
    "ntriples_roundtrip": graph_sql("SELECT * FROM graph"),
    "ntriples_documents_roundtrip": _DOCS,
    "ntriples_malformed": graph_sql(
        """SELECT '<' || s || '> <' || p || '> "' || o || '"^^<' || o_datatype || '>' AS value FROM graph WHERE o_datatype IS NOT NULL"""
    ),
    "entity_counts": graph_sql(
        f"""SELECT c.class, count(s) AS entities FROM (VALUES ('{_EX}Employee'), ('{_EX}Customer'), ('{_EX}Supplier')) c(class)
        LEFT JOIN graph ON p = '{RDF_TYPE}' AND o = c.class GROUP BY c.class"""
    ),
    "triple_pattern": graph_sql(f"SELECT * FROM graph WHERE p = '{FIRST_NAME}'"),
    "stored_pattern": graph_sql(f"SELECT * FROM graph WHERE p = '{FIRST_NAME}'"),
    "stored_subjects": graph_sql(f"SELECT a.s, a.o AS first, b.o AS family FROM graph a JOIN graph b ON a.s = b.s AND a.p = '{FIRST_NAME}' AND b.p = '{FAMILY_NAME}'"),
    "stored_union": graph_sql(
        f"""SELECT p, count(*) AS triples, count(DISTINCT s) AS subjects, (SELECT count(*) FROM graph WHERE NOT contains(s, '#Employee_')) AS added,
        0::BIGINT AS added_again FROM graph GROUP BY p"""
    ),
    "terms_containing": graph_sql("SELECT DISTINCT s FROM graph WHERE contains(s, 'Employee')"),
    "predicate_names": graph_sql(
        f"SELECT {_LOCAL.format(x='p')} AS local, '{_EX}' || {_LOCAL.format(x='p')} AS expanded, count(*) AS triples FROM graph GROUP BY p"
    ),
    "graph_preview": graph_sql("SELECT * FROM graph ORDER BY s, p, o, o_kind, o_datatype, o_lang LIMIT 300"),
    "first_link": linkage_sql(f", {_LINKED}\nSELECT s AS link_s, o AS link_o FROM same ORDER BY 1, 2 LIMIT 1"),
    "first_subject": graph_sql("SELECT min(s) AS s FROM graph WHERE contains(s, 'Customer')"),
    "butterfly": fly_sql("SELECT * FROM fly"),
    "nodes": fly_sql(_NODES.format(g="fly")),
    "edges": fly_sql(
        f"""SELECT s AS source, o AS target, p AS title, {_LOCAL.format(x='s')} AS source_label, {_LOCAL.format(x='o')} AS target_label,
        CASE WHEN contains(p, 'sameAs') THEN 'owl:sameAs' ELSE {_LOCAL.format(x='p')} END AS label,
        CASE WHEN contains(p, 'sameAs') THEN 'link' ELSE 'property' END AS style FROM fly"""
    ),
    "nodes_by_label": graph_sql(
        f"SELECT label, min(term) AS title, count(*) AS terms FROM ({_NODES.format(g='graph')}) GROUP BY label"
    ),
    "shape_violations": f"""WITH {SQL_SOURCES.strip()},
    e AS (SELECT '{_EX}Employee_' || url_encode(Matricule_RH) AS focus, *, CASE WHEN pid % 13 = 0 THEN 'unknown' ELSE date_nais END AS bd FROM src_b),
    c AS (SELECT '{_EX}Customer_' || url_encode(ID_Client) AS focus, * FROM src_a)
    SELECT focus, '{_EX}Employee' AS class, 'http://xmlns.com/foaf/0.1/familyName' AS path, 'maxCount' AS constraint, 2 AS found FROM e WHERE pid % 7 = 0
    UNION ALL SELECT focus, '{_EX}Employee', 'https://schema.org/birthDate', 'datatype', 1 FROM e WHERE pid % 17 = 0
    UNION ALL SELECT focus, '{_EX}Employee', 'https://schema.org/birthDate', 'pattern', 1 FROM e WHERE NOT regexp_matches(bd, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$')
    UNION ALL SELECT focus, '{_EX}Employee', '{_EX}monthlySalary', 'pattern', 1 FROM e WHERE NOT regexp_matches(salaire_mensuel, '^[2-8][0-9]{{3}}$')
    UNION ALL SELECT focus, '{_EX}Customer', 'https://schema.org/email', 'minCount', 0 FROM c WHERE email IS NULL
    UNION ALL SELECT focus, '{_EX}Customer', 'https://schema.org/email', 'pattern', 1 FROM c WHERE NOT regexp_matches(email, '^[a-z.]+@')""",
}
