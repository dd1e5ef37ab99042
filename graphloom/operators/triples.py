"""Tables to triples by declarative rules, and counts over the result.

A graph is a DataFrame of ``TRIPLE_COLUMNS`` with set semantics.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.rdf import (
    PREFIXES,
    RDF_TYPE,
    expand_prefix,
    iri_from_template,
    template_prefix,
    template_references,
    text_from_template,
)
from graphloom.sources.tables import require_columns

TRIPLE_COLUMNS = ["s", "p", "o", "o_kind", "o_datatype", "o_lang"]


@dataclass(frozen=True)
class Rule:
    """One predicate-object rule. ``object`` is a template; ``kind`` is ``literal`` or ``iri``."""

    predicate: str
    object: str
    kind: str = "literal"
    datatype: str | None = None
    lang: str | None = None


@dataclass(frozen=True)
class TableMapping:
    name: str
    source: str
    subject: str
    rules: tuple[Rule, ...]

    def expanded(self, prefixes: Mapping[str, str] = PREFIXES) -> "TableMapping":
        def rule(r: Rule) -> Rule:
            obj = expand_prefix(r.object, prefixes) if r.kind == "iri" else r.object
            dt = expand_prefix(r.datatype, prefixes) if r.datatype else None
            return replace(r, predicate=expand_prefix(r.predicate, prefixes), object=obj, datatype=dt)

        return replace(self, subject=expand_prefix(self.subject, prefixes), rules=tuple(rule(r) for r in self.rules))

    @property
    def references(self) -> list[str]:
        found = [*template_references(self.subject)]
        for r in self.rules:
            found += template_references(r.object)
        return list(dict.fromkeys(found))


def mappings_from_rows(rows: DataFrame | Iterable[Mapping]) -> list[TableMapping]:
    """Rules given as rows ``mapping, source, subject_template, predicate, object_template, term_type, datatype``.

    A mapping document is configuration: a few rows, read by the driver.
    """
    if isinstance(rows, DataFrame):
        rows = [r.asDict() for r in rows.collect()]
    grouped: dict[tuple[str, str, str], list[Rule]] = {}
    for r in rows:
        key = (r["mapping"], r["source"], r["subject_template"])
        grouped.setdefault(key, []).append(
            Rule(r["predicate"], r["object_template"], r.get("term_type") or "literal", r.get("datatype"), r.get("lang"))
        )
    return [TableMapping(*key, tuple(rules)) for key, rules in grouped.items()]


def mapping_rows(mappings: Sequence[TableMapping]) -> list[dict]:
    """The inverse of ``mappings_from_rows``."""
    return [
        {"mapping": m.name, "source": m.source, "subject_template": m.subject, "predicate": r.predicate,
         "object_template": r.object, "term_type": r.kind, "datatype": r.datatype, "lang": r.lang}
        for m in mappings for r in m.rules
    ]


def _text(x: str | None) -> Column:
    return F.lit(x).cast("string")


def table_triples(df: DataFrame, mapping: TableMapping) -> DataFrame:
    """All triples of one table in one pass over its rows; a null object gives no triple. Not yet a set."""
    require_columns(df, mapping.references, f"mapping {mapping.name}")
    made = F.array(
        *[
            F.struct(
                _text(r.predicate).alias("p"),
                (iri_from_template(r.object) if r.kind == "iri" else text_from_template(r.object)).alias("o"),
                _text(r.kind).alias("o_kind"),
                _text(r.datatype).alias("o_datatype"),
                _text(r.lang).alias("o_lang"),
            )
            for r in mapping.rules
        ]
    )
    flat = df.select(iri_from_template(mapping.subject).alias("s"), F.explode(made).alias("_t")).select("s", "_t.*")
    return flat.where(F.col("s").isNotNull() & F.col("o").isNotNull())


def _rules_can_repeat(mapping: TableMapping) -> bool:
    """Whether one row may give the same triple twice."""
    for p in {r.predicate for r in mapping.rules}:
        same = [r for r in mapping.rules if r.predicate == p]
        if len(same) > 1 and (len(set(same)) < len(same) or any(template_references(r.object) for r in same)):
            return True
    return False


def _subjects_overlap(mappings: Sequence[TableMapping]) -> bool:
    heads = [template_prefix(m.subject) for m in mappings]
    return any(a.startswith(b) or b.startswith(a) for i, a in enumerate(heads) for b in heads[i + 1 :])


def subjects_are_unique(df: DataFrame, mapping: TableMapping) -> bool:
    """True if no two rows share a subject. Shuffles the key columns only."""
    keyed = df.select(iri_from_template(mapping.subject).alias("s")).where("s is not null")
    return keyed.groupBy("s").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()


def materialize(
    frames: Mapping[str, DataFrame], mappings: Sequence[TableMapping], prefixes: Mapping[str, str] = PREFIXES,
    distinct: str = "auto",
) -> DataFrame:
    """The graph of all mappings.

    A graph is a set, and making a set of all triples shuffles every one of them. With ``auto`` the keys
    are checked first (a shuffle of one narrow column per table); where subjects are unique and mappings
    cannot meet, no triple can repeat and the shuffle is left out. ``always`` and ``never`` skip the check.
    """
    full = [m.expanded(prefixes) for m in mappings]
    parts, proven = [], distinct == "never"
    if distinct == "auto":
        proven = not _subjects_overlap(full) and not any(_rules_can_repeat(m) for m in full)
        proven = proven and all(subjects_are_unique(frames[m.source], m) for m in full)
    for m in full:
        parts.append(table_triples(frames[m.source], m))
    return union_graphs(*parts, distinct=not proven)


def union_graphs(*graphs: DataFrame, distinct: bool = True) -> DataFrame:
    """Several graphs as one set of triples."""
    out = graphs[0]
    for g in graphs[1:]:
        out = out.unionByName(g)
    return out.distinct() if distinct else out


def add_triple(graph: DataFrame, s: str, p: str, o: str, kind: str = "iri", datatype: str | None = None) -> DataFrame:
    """``graph``, a set of triples, with one more; no shuffle."""
    values = {"s": s, "p": p, "o": o, "o_kind": kind, "o_datatype": datatype, "o_lang": None}
    row = graph.sparkSession.range(1).select(*[_text(v).alias(c) for c, v in values.items()])
    same = F.lit(True)
    for c, v in values.items():
        same &= F.col(c).eqNullSafe(_text(v))
    return union_graphs(graph.where(~same), row, distinct=False)


def match_triples(graph: DataFrame, s: str | None = None, p: str | None = None, o: str | None = None) -> DataFrame:
    """Triples that agree with every given position; the others are wildcards."""
    for name, value in (("s", s), ("p", p), ("o", o)):
        if value is not None:
            graph = graph.where(F.col(name) == value)
    return graph


def terms_containing(graph: DataFrame, text: str, position: str = "s") -> DataFrame:
    return graph.where(F.col(position).contains(text))


def entity_counts(graph: DataFrame, classes: Sequence[str] | None = None) -> DataFrame:
    """Entities per class, one aggregate for all classes; a wanted class without entities counts 0."""
    typed = graph.where(F.col("p") == RDF_TYPE)
    if classes is None:
        return typed.groupBy(F.col("o").alias("class")).agg(F.count(F.lit(1)).alias("entities"))
    wanted = [expand_prefix(c) for c in classes]
    counted = typed.agg(*[F.count_if(F.col("o") == c).alias(f"n{i}") for i, c in enumerate(wanted)])
    rows = [F.struct(F.lit(c).alias("class"), F.col(f"n{i}").alias("entities")) for i, c in enumerate(wanted)]
    return counted.select(F.inline(F.array(*rows)))


def validate_graph(graph: DataFrame, classes: Sequence[str] = ("ex:Employee", "ex:Customer")) -> dict:
    """Size and class counts in one aggregate; empty graph is an error, a class without entities a warning."""
    full = [expand_prefix(c) for c in classes]
    row = graph.agg(
        F.count(F.lit(1)).alias("triples"),
        *[F.count_if((F.col("p") == RDF_TYPE) & (F.col("o") == c)).alias(f"c{i}") for i, c in enumerate(full)],
    ).first()
    if row["triples"] == 0:
        raise ValueError("the graph is empty: check the mapping rules and the source tables")
    counts = {c: row[f"c{i}"] for i, c in enumerate(classes)}
    return {"triples": row["triples"], "entities": counts, "warnings": [f"no entity of class {c}" for c, n in counts.items() if n == 0]}


# The rules for the two person tables.
EMPLOYEE_MAPPING = TableMapping(
    "employes", "employees", "http://kg.projet.fr/ontology#Employee_$(Matricule_RH)",
    (
        Rule("rdf:type", "ex:Employee", "iri"),
        Rule("rdf:type", "foaf:Person", "iri"),
        Rule("ex:employeeId", "$(Matricule_RH)"),
        Rule("foaf:familyName", "$(last_name)"),
        Rule("foaf:firstName", "$(first_name)"),
        Rule("schema:birthDate", "$(date_nais)", datatype="xsd:date"),
        Rule("ex:department", "$(departement)"),
        Rule("schema:jobTitle", "$(contrat)"),
        Rule("ex:monthlySalary", "$(salaire_mensuel)", datatype="xsd:decimal"),
        Rule("schema:startDate", "$(date_embauche)", datatype="xsd:date"),
    ),
)
CUSTOMER_MAPPING = TableMapping(
    "clients", "customers", "http://kg.projet.fr/ontology#Customer_$(ID_Client)",
    (
        Rule("rdf:type", "ex:Customer", "iri"),
        Rule("rdf:type", "foaf:Person", "iri"),
        Rule("ex:clientId", "$(ID_Client)"),
        Rule("ex:fullName", "$(nom_complet)"),
        Rule("schema:email", "$(email)"),
        Rule("schema:addressLocality", "$(ville)"),
    ),
)
