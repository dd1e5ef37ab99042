"""Views and checks of a graph: sub-graphs around links, node and edge tables, shapes."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import astuple, dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.rdf import PREFIXES, RDF_TYPE, SAME_AS, expand_prefix, local_name
from graphloom.operators.triples import TRIPLE_COLUMNS

XSD_STRING = PREFIXES["xsd"] + "string"


def link_ends(graph: DataFrame, predicate: str = SAME_AS) -> DataFrame:
    return graph.where(F.col("p") == predicate).select(F.col("s").alias("link_s"), F.col("o").alias("link_o"))


def first_link(graph: DataFrame, predicate: str = SAME_AS) -> DataFrame:
    """The smallest link, or no row."""
    best = link_ends(graph, predicate).agg(F.min(F.struct("link_s", "link_o")).alias("m"))
    return best.where("m is not null").select("m.*")


def first_subject(graph: DataFrame, text: str) -> DataFrame:
    """The smallest subject that contains ``text``, or no row."""
    found = graph.where(F.col("s").contains(text)).agg(F.min("s").alias("s"))
    return found.where("s is not null")


def link_subgraphs(graph: DataFrame, links: DataFrame, predicate: str = SAME_AS) -> DataFrame:
    """For every link at once: all triples of its two ends, and the link itself.

    Each link is turned into one row per end and joined on the subject: one equi-join, no ``OR``. Without
    links the result is empty.
    """
    ends = links.select("link_s", "link_o", F.explode(F.array_distinct(F.array("link_s", "link_o"))).alias("s"))
    around = graph.join(ends, "s").where(
        ~((F.col("s") == F.col("link_s")) & (F.col("p") == predicate) & (F.col("o") == F.col("link_o")))
    )
    bridge = links.select(
        "link_s", "link_o", F.col("link_s").alias("s"), F.lit(predicate).alias("p"), F.col("link_o").alias("o"),
        F.lit("iri").alias("o_kind"), F.lit(None).cast("string").alias("o_datatype"), F.lit(None).cast("string").alias("o_lang"),
    )
    return around.select("link_s", "link_o", *TRIPLE_COLUMNS).unionByName(bridge)


def preview(graph: DataFrame, n: int = 300) -> DataFrame:
    """The first ``n`` triples in term order."""
    return graph.orderBy(*TRIPLE_COLUMNS).limit(n)


def style_of(term: Column, is_subject: Column) -> Column:
    """Style class of a node; employees before customers before other subjects before values."""
    return (
        F.when(is_subject & term.contains("Employee"), "1-employee")
        .when(is_subject & term.contains("Customer"), "2-customer")
        .when(is_subject, "3-subject")
        .otherwise("4-value")
    )


def edges(graph: DataFrame) -> DataFrame:
    """One row per triple with short labels; identity links have their own style."""
    is_link = F.col("p").contains("sameAs")
    return graph.select(
        F.col("s").alias("source"), F.col("o").alias("target"), F.col("p").alias("title"),
        local_name(F.col("s")).alias("source_label"), local_name(F.col("o")).alias("target_label"),
        F.when(is_link, "owl:sameAs").otherwise(local_name(F.col("p"))).alias("label"),
        F.when(is_link, "link").otherwise("property").alias("style"),
    )


def nodes(graph: DataFrame) -> DataFrame:
    """One row per term, with its label and style.

    Nodes are told apart by the full term; labels of different terms may be equal. A term that is both a
    subject and an object takes the subject's style.
    """
    both = F.array(
        F.struct(F.col("s").alias("term"), F.lit("iri").alias("kind"), style_of(F.col("s"), F.lit(True)).alias("style")),
        F.struct(F.col("o").alias("term"), F.col("o_kind").alias("kind"), F.lit("4-value").alias("style")),
    )
    found = graph.select(F.inline(both)).groupBy("term", "kind").agg(F.min("style").alias("style"))
    return found.select("term", "kind", local_name(F.col("term")).alias("label"), F.substring("style", 3, 20).alias("style"))


def nodes_by_label(graph: DataFrame) -> DataFrame:
    """One row per label, with the smallest term as title and the number of terms that share it."""
    return nodes(graph).groupBy("label").agg(F.min("term").alias("title"), F.count(F.lit(1)).alias("terms"))


@dataclass(frozen=True)
class Shape:
    """What every entity of a class must satisfy along one property."""

    target_class: str
    path: str
    min_count: int | None = None
    max_count: int | None = None
    datatype: str | None = None
    pattern: str | None = None


def shape_violations(graph: DataFrame, shapes: Sequence[Shape]) -> DataFrame:
    """Entities that break a shape: ``focus, class, path, constraint, found``.

    ``found`` is the number of values for the count constraints and the number of offending values for
    the others. The shapes are configuration and travel with the plan; the graph is read twice (types,
    properties), reduced to one row per entity and shape before the join.
    """
    spark = graph.sparkSession
    rows = [(i, *astuple(s)) for i, s in enumerate(shapes)]
    frame = spark.createDataFrame(
        rows, "shape int, class string, path string, min_count int, max_count int, datatype string, pattern string"
    )
    expanded = F.broadcast(
        frame.replace({s: expand_prefix(s) for r in shapes for s in (r.target_class, r.path, r.datatype) if s}, subset=["class", "path", "datatype"])
    )
    classes = sorted({expand_prefix(s.target_class) for s in shapes})
    paths = sorted({expand_prefix(s.path) for s in shapes})
    members = (
        graph.where((F.col("p") == RDF_TYPE) & F.col("o").isin(classes))
        .select(F.col("s").alias("focus"), F.col("o").alias("class"))
        .join(expanded, "class")
    )
    values = (
        graph.where(F.col("p").isin(paths))
        .join(expanded.select("shape", F.col("path").alias("p"), "datatype", "pattern"), "p")
        .groupBy(F.col("s").alias("focus"), "shape")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count_if(
                F.col("datatype").isNotNull()
                & ((F.col("o_kind") != "literal") | (F.coalesce("o_datatype", F.lit(XSD_STRING)) != F.col("datatype")))
            ).alias("bad_datatype"),
            F.count_if(F.col("pattern").isNotNull() & ~F.expr("o rlike pattern")).alias("bad_pattern"),
        )
    )
    checked = members.join(values, ["focus", "shape"], "left").fillna(0, ["n", "bad_datatype", "bad_pattern"])
    faults = F.array(
        F.when(F.col("n") < F.col("min_count"), F.struct(F.lit("minCount").alias("constraint"), F.col("n").alias("found"))),
        F.when(F.col("n") > F.col("max_count"), F.struct(F.lit("maxCount").alias("constraint"), F.col("n").alias("found"))),
        F.when(F.col("bad_datatype") > 0, F.struct(F.lit("datatype").alias("constraint"), F.col("bad_datatype").alias("found"))),
        F.when(F.col("bad_pattern") > 0, F.struct(F.lit("pattern").alias("constraint"), F.col("bad_pattern").alias("found"))),
    )
    return checked.select("focus", "class", "path", F.explode(F.array_compact(faults)).alias("_f")).select(
        "focus", "class", "path", "_f.constraint", "_f.found"
    )
