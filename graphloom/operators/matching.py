"""Matching of column names to a target vocabulary, in two passes.

The unit is a row per (table, column), so one run covers a whole lake of tables. Pass one takes the
closest target by an encoder; what stays below the threshold goes to a resolver, which sees the name
and a few values. The vocabulary is configuration: an ordered list of a few targets.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.functions.text import ratio
from graphloom.functions.vectors import best_by_grams, best_by_vectors, character_grams, gram_counts, gram_norm
from graphloom.operators.evaluate import UNMATCHED, judge, rates
from graphloom.operators.profile import column_samples

# The target vocabulary in its order, which decides ties.
ONTOLOGY = {
    "ex:employeeId": "Identifiant unique de l'employé ou du client",
    "schema:birthDate": "Date de naissance de la personne",
    "foaf:familyName": "Nom de famille de la personne",
    "foaf:firstName": "Prénom de la personne",
    "ex:fullName": "Nom complet (prénom + nom de famille concaténés)",
    "schema:email": "Adresse email de contact",
    "ex:department": "Département ou service dans l'organisation",
    "ex:annualRevenue": "Chiffre d'affaires ou revenu annuel",
    "schema:jobTitle": "Poste ou type de contrat professionnel",
    "schema:addressLocality": "Ville ou localité",
}
# The expected target per column; None expects no match.
GOLD = {
    "ID_Client": "ex:employeeId",
    "nom_complet": "ex:fullName",
    "email": "schema:email",
    "dt_naissance": "schema:birthDate",
    "ville": "schema:addressLocality",
    "ca_annuel": "ex:annualRevenue",
    "segment": None,
    "Matricule_RH": "ex:employeeId",
    "Nom_Famille": "foaf:familyName",
    "Prenom": "foaf:firstName",
    "date_nais": "schema:birthDate",
    "departement": "ex:department",
    "contrat": "schema:jobTitle",
    "salaire_mensuel": None,
    "date_embauche": None,
}
# Method labels of a result.
BY_ENCODER, BY_RESOLVER, RESOLVER_ONLY = "SBERT", "LLM", "LLM_ONLY"

# The threshold of the built-in encoder. A sentence encoder works with 0.82.
NGRAM_TAU = 0.30
ENCODER_TAU = 0.82

RESULT = ["source_column", "target_uri", "confidence", "method", "justification"]


def gold_table(spark: SparkSession, gold: Mapping[str, str | None] = GOLD) -> DataFrame:
    return spark.createDataFrame(list(gold.items()), "source_column string, expected_uri string")


def ontology_table(spark: SparkSession, ontology: Mapping[str, str] = ONTOLOGY) -> DataFrame:
    rows = [(i, u, d) for i, (u, d) in enumerate(ontology.items())]
    return spark.createDataFrame(rows, "ord int, uri string, description string")


# --- encoders --------------------------------------------------------------------------------------


@dataclass(frozen=True)
class NgramEncoder:
    """Character trigram counts: deterministic, no model, native expressions only."""

    def best(self, spark: SparkSession, text: Column, ontology: Mapping[str, str]) -> Column:
        counts = gram_counts(character_grams(F.col("description")))
        rows = ontology_table(spark, ontology).select("ord", counts.alias("c"), gram_norm(counts).alias("norm")).collect()
        return best_by_grams(text, [({g["gram"]: g["n"] for g in r["c"]}, r["norm"]) for r in sorted(rows)])


@dataclass(frozen=True)
class VectorEncoder:
    """Any model that turns a batch of texts into vectors; it is called inside the tasks, per Arrow batch."""

    encode: Callable[[list[str]], Sequence[Sequence[float]]]

    def best(self, spark: SparkSession, text: Column, ontology: Mapping[str, str]) -> Column:
        encode = self.encode

        @F.pandas_udf(T.ArrayType(T.FloatType()))
        def vectors(texts: pd.Series) -> pd.Series:
            return pd.Series([[float(x) for x in v] for v in encode(texts.fillna("").tolist())])

        return best_by_vectors(vectors(text), self.encode(list(ontology.values())))


def with_best_target(
    columns: DataFrame, ontology: Mapping[str, str] = ONTOLOGY, encoder=NgramEncoder(), name: str = "source_column"
) -> DataFrame:
    """``columns`` with ``best_uri`` and ``score``; a tie goes to the earlier target."""
    uris = F.array(*[F.lit(u) for u in ontology])
    scored = columns.withColumn("_best", encoder.best(columns.sparkSession, F.col(name), ontology))
    return scored.select(
        *columns.columns, F.element_at(uris, 1 - F.col("_best.back")).alias("best_uri"), F.col("_best.score").alias("score")
    )


# --- resolvers -------------------------------------------------------------------------------------
#
# A resolver takes rows with ``source_column``, ``samples`` and the flag ``_ask`` and adds ``answer`` (JSON
# text, null where not asked) and ``latency_ms``. Rows pass through, so the input is computed once.

_ANSWER = T.StructType(
    [T.StructField("cible", T.StringType()), T.StructField("confiance", T.StringType()), T.StructField("justification", T.StringType())]
)


def parse_answer(answer: Column) -> Column:
    """An answer as struct ``cible, confiance, justification``: an object, or the first of a list.

    Null where the text is no JSON, a key is missing or the confidence is no number.
    """
    def checked(chosen: Column) -> Column:
        confidence = chosen["confiance"].try_cast("double")
        complete = chosen["cible"].isNotNull() & confidence.isNotNull() & chosen["justification"].isNotNull()
        fields = F.struct(
            F.trim(chosen["cible"]).alias("cible"), confidence.alias("confiance"), F.trim(chosen["justification"]).alias("justification")
        )
        return F.when(complete, fields)

    # an object reads as a list of one; inside ``transform`` the text is parsed once for all its fields
    listed = F.from_json(answer, T.ArrayType(_ANSWER))
    return F.try_element_at(F.transform(F.slice(listed, 1, 1), checked), F.lit(1))


def _looks_like(pattern: str) -> Callable[[Column], Column]:
    return lambda value: value.rlike(pattern)


@dataclass(frozen=True)
class EvidenceResolver:
    """Answers from an alias table and from the look of the sampled values. Native expressions only."""

    aliases: Mapping[str, str] = field(default_factory=lambda: {"matricule": "ex:employeeId", "famille": "foaf:familyName"})
    patterns: Mapping[str, str] = field(
        default_factory=lambda: {"schema:email": r"^[^@\s]+@[^@\s]+\.[a-z]+$", "ex:employeeId": r"^[A-Z]{1,4}-?\d+$"}
    )

    def __call__(self, rows: DataFrame, ontology: Mapping[str, str]) -> DataFrame:
        name, samples = F.lower("source_column"), F.col("samples")
        answer = None

        def say(uri: str, confidence: float, why: str) -> Column:
            return F.to_json(F.struct(F.lit(uri).alias("cible"), F.lit(confidence).alias("confiance"), F.lit(why).alias("justification")))

        for word, uri in self.aliases.items():
            hit = F.array_contains(F.split(name, "[^a-z0-9]+"), word)
            answer = F.when(hit, say(uri, 0.9, f"alias {word}")) if answer is None else answer.when(hit, say(uri, 0.9, f"alias {word}"))
        for uri, pattern in self.patterns.items():
            hit = F.forall(samples, _looks_like(pattern))
            answer = F.when(hit, say(uri, 0.7, "values")) if answer is None else answer.when(hit, say(uri, 0.7, "values"))
        none = say(UNMATCHED, 0.0, "no evidence")
        given = none if answer is None else answer.otherwise(none)
        return rows.withColumns({"answer": F.when(F.col("_ask"), given), "latency_ms": F.lit(0.0)})


@dataclass(frozen=True)
class CallResolver:
    """Answers from a user's function, called once for each different question.

    Only rows that ask are sent out: equal questions are asked once, the calls are dealt evenly to ``tasks`` tasks,
    and the answers are joined back. ``per_minute`` bounds the calls of all tasks together.

    The function gets ``{"column", "samples", "targets"}`` (samples and targets as JSON) and returns a dict, a list or JSON text.
    ``retry_on`` errors are tried again with doubling waits; an error that lasts gives no answer.
    """

    call: Callable[[dict], object]
    attempts: int = 4
    min_wait: float = 2.0
    max_wait: float = 60.0
    retry_on: tuple[type[BaseException], ...] = (ConnectionError, TimeoutError)
    tasks: int = 32
    per_minute: float | None = None

    def _ask(self, payload: dict) -> str | None:
        for attempt in range(1, self.attempts + 1):
            try:
                answer = self.call(payload)
                return answer if isinstance(answer, str) or answer is None else json.dumps(answer, ensure_ascii=False)
            except self.retry_on:
                if attempt < self.attempts:
                    time.sleep(min(self.min_wait * 2 ** (attempt - 1), self.max_wait))
            except Exception:
                return None
        return None

    def __call__(self, rows: DataFrame, ontology: Mapping[str, str]) -> DataFrame:
        listing = json.dumps(dict(ontology), ensure_ascii=False)
        asked = rows.where("_ask").select("source_column", "samples").distinct()
        schema = T.StructType([*asked.schema.fields, T.StructField("answer", T.StringType()), T.StructField("latency_ms", T.DoubleType())])
        pause = 60.0 * self.tasks / self.per_minute if self.per_minute else 0.0

        def resolve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                answers, times = [], []
                for column, samples in zip(batch["source_column"], batch["samples"]):
                    start = time.perf_counter()
                    answers.append(self._ask({"column": column, "samples": json.dumps(list(samples), ensure_ascii=False), "targets": listing}))
                    spent = time.perf_counter() - start
                    times.append(round(spent * 1000, 1))
                    time.sleep(max(pause - spent, 0.0))
                yield batch.assign(answer=answers, latency_ms=times)

        answers = asked.repartition(self.tasks).mapInPandas(resolve, schema).alias("a")
        same = F.col("r._ask") & F.col("r.source_column").eqNullSafe(F.col("a.source_column")) & F.col("r.samples").eqNullSafe(F.col("a.samples"))
        return rows.alias("r").join(answers, same, "left").select("r.*", "a.answer", F.coalesce("a.latency_ms", F.lit(0.0)).alias("latency_ms"))


# --- input: one row per column ---------------------------------------------------------------------


def column_table(
    df: DataFrame, columns: Sequence[str], row_key: Sequence[str], by: Sequence[str] = (), k: int = 3, seed: int = 42
) -> DataFrame:
    """One row per column (and ``by`` group) with its position and up to ``k`` sampled values.

    A column without any value is there with an empty sample list. One scan: each task keeps ``k`` cells
    of a column before the shuffle.
    """
    picked = column_samples(df, columns, row_key, k, seed, by, keep_empty=True)
    if not by:  # the columns of an empty table are columns too
        empty = [F.struct(F.lit(c).alias("column"), F.lit(k + 1).alias("rank"), F.lit(None).cast("string").alias("value")) for c in columns]
        picked = picked.unionByName(df.sparkSession.range(1).select(F.inline(F.array(*empty))))
    values = F.sort_array(F.collect_list(F.when(F.col("value").isNotNull(), F.struct("rank", "value"))))
    position = F.array_position(F.array(*[F.lit(c) for c in columns]), F.col("column")) - 1
    return picked.groupBy(*by, "column").agg(values.alias("_v")).select(
        *by, position.cast("int").alias("ord"), F.col("column").alias("source_column"), F.transform("_v", lambda x: x["value"]).alias("samples")
    )


# --- variants --------------------------------------------------------------------------------------


def _result(df: DataFrame, keep: Sequence[str], **columns: Column) -> DataFrame:
    return df.select(*keep, *[c.alias(n) for n, c in columns.items()])


def match_forced(columns: DataFrame, ontology=ONTOLOGY, tau: float = NGRAM_TAU, encoder=NgramEncoder()) -> DataFrame:
    """The closest target for every column, marked whether it reaches the threshold."""
    keep = [c for c in columns.columns if c != "samples"]
    scored = with_best_target(columns, ontology, encoder)
    above = F.col("score") >= tau
    sign = F.when(above, "not below").otherwise("below")
    return _result(
        scored, keep, target_uri=F.col("best_uri"), confidence=F.round("score", 4), method=F.lit(BY_ENCODER),
        justification=F.format_string(f"similarity %.4f, %s {tau}", F.col("score"), sign), latency_ms=F.lit(0.0), calls=F.lit(0),
        above_tau=above,
    )


def split_by_threshold(scored: DataFrame, tau: float) -> tuple[DataFrame, DataFrame]:
    """Rows at or above the threshold, and the rest."""
    return scored.where(F.col("score") >= tau), scored.where(F.col("score") < tau)


def known_or_unmatched(uri: Column, ontology: Mapping[str, str]) -> Column:
    return F.when(uri.isin(list(ontology)), uri).otherwise(UNMATCHED)


def _resolved(rows: DataFrame, ontology, resolver, wanted: Column) -> DataFrame:
    """Rows with the checked answer ``_a`` and its target ``_uri``; only ``wanted`` rows with values are asked."""
    asked = resolver(rows.withColumn("_ask", wanted & (F.size("samples") > 0)), ontology).withColumn("_a", parse_answer(F.col("answer")))
    uri = F.coalesce(known_or_unmatched(F.col("_a.cible"), ontology), F.lit(UNMATCHED))
    return asked.withColumn("_uri", uri)


def match_resolver_only(columns: DataFrame, ontology=ONTOLOGY, resolver=EvidenceResolver()) -> DataFrame:
    """Every column goes to the resolver, which may also answer that nothing fits."""
    keep = [c for c in columns.columns if c != "samples"]
    rows = _resolved(columns, ontology, resolver, F.lit(True))
    given = F.col("_a").isNotNull()
    return _result(
        rows, keep, target_uri=F.col("_uri"), confidence=F.when(given, F.round("_a.confiance", 4)).otherwise(0.0),
        method=F.lit(RESOLVER_ONLY),
        justification=F.when(~F.col("_ask"), "no values to ask about").when(given, F.col("_a.justification")).otherwise("no usable answer"),
        latency_ms=F.col("latency_ms"), calls=F.col("_ask").cast("int"),
    )


def match_hybrid(
    columns: DataFrame, ontology=ONTOLOGY, tau: float = NGRAM_TAU, encoder=NgramEncoder(), resolver=EvidenceResolver()
) -> DataFrame:
    """Closest target where it reaches the threshold, the resolver for the rest.

    ``pass_no`` and ``ord`` give the order of the result: accepted columns first, then the resolved ones.
    """
    keep = [c for c in columns.columns if c != "samples"]
    accepted = F.col("score") >= tau
    rows = _resolved(with_best_target(columns, ontology, encoder), ontology, resolver, ~accepted)
    found = F.col("_uri") != UNMATCHED
    return _result(
        rows, keep,
        target_uri=F.when(accepted, F.col("best_uri")).otherwise(F.col("_uri")),
        confidence=F.when(accepted, F.round("score", 4)).when(found, F.round("_a.confiance", 4)).otherwise(0.0),
        method=F.when(accepted, BY_ENCODER).when(found, BY_RESOLVER).otherwise(UNMATCHED),
        justification=F.when(accepted, F.format_string(f"similarity %.4f reaches {tau}", F.col("score")))
        .when(found, F.col("_a.justification")).otherwise("neither pass found a target"),
        latency_ms=F.col("latency_ms"), calls=F.col("_ask").cast("int"),
        pass_no=F.when(accepted, 1).otherwise(2),
    )


# --- results ---------------------------------------------------------------------------------------


def method_counts(results: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Columns per method and resolver calls with their latency, in one aggregate."""
    called = F.col("calls") > 0
    aggregates = [
        F.count(F.lit(1)).alias("total_columns"),
        F.count_if(F.col("method") == BY_ENCODER).alias("sbert_count"),
        F.count_if(F.col("method").isin(BY_RESOLVER, RESOLVER_ONLY)).alias("llm_count"),
        F.count_if(F.col("method") == UNMATCHED).alias("unmatched"),
        F.coalesce(F.sum("calls"), F.lit(0)).alias("llm_calls"),
        F.coalesce(F.round(F.avg(F.when(called, F.col("latency_ms"))), 1), F.lit(0.0)).alias("avg_latency_ms"),
        F.coalesce(F.round(F.sum("latency_ms") / 1000, 2), F.lit(0.0)).alias("total_llm_time_s"),
    ]
    return results.groupBy(*by).agg(*aggregates) if by else results.agg(*aggregates)


def results_envelope(results: DataFrame, by: Sequence[str] = (), timestamp: bool = True) -> DataFrame:
    """The results of each table as one JSON document: time, counts per method, rows in order.

    A document holds one row per column of a table, so its size follows the width of a schema.
    """
    order = ["pass_no", "ord"] if "pass_no" in results.columns else ["ord"]
    rows = F.sort_array(F.collect_list(F.struct(*order, F.struct(*RESULT).alias("r"))))
    counted = [
        F.count(F.lit(1)).alias("total_columns"),
        F.count_if(F.col("method") == BY_ENCODER).alias("sbert_count"),
        F.count_if(F.col("method").isin(BY_RESOLVER, RESOLVER_ONLY)).alias("llm_count"),
        F.count_if(F.col("method") == UNMATCHED).alias("unmatched"),
    ]
    grouped = results.groupBy(*by).agg(*counted, rows.alias("_rows")) if by else results.agg(*counted, rows.alias("_rows"))
    head = [F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp")] if timestamp else []
    body = F.struct(
        *head, "total_columns", "sbert_count", "llm_count", "unmatched", F.transform("_rows", lambda x: x["r"]).alias("results")
    )
    return grouped.select(*by, F.to_json(body).alias("document"))


def first_result(judged: DataFrame, results: DataFrame, key: Sequence[str] = ("source_column",)) -> DataFrame:
    """Verdicts with confidence and method of the first result of the column; ``—`` where there is none."""
    first = results.groupBy(*key).agg(F.min_by(F.struct("confidence", "method"), F.col("ord")).alias("_f"))
    found = judged.drop("confidence", "method").join(first, list(key), "left")
    dash = F.lit("—")
    return found.withColumns(
        {"confidence": F.coalesce(F.col("_f.confidence").cast("string"), dash), "method": F.coalesce(F.col("_f.method"), dash)}
    ).drop("_f")


# --- from matches to mapping rules -----------------------------------------------------------------

# Targets whose values are typed literals.
TARGET_DATATYPES = {"schema:birthDate": "xsd:date", "ex:annualRevenue": "xsd:decimal"}


def mapping_from_matches(
    results: DataFrame, table: str, id_target: str = "ex:employeeId", base: str = "http://kg.projet.fr/ontology#",
    classes: Mapping[str, Sequence[str]] = {},
) -> DataFrame:
    """Mapping rows (as ``triples.mappings_from_rows`` takes them) from accepted matches.

    Each table's subject comes from its best column for ``id_target``; a table without one gives no rows. ``classes``
    names what the rows of a table are: a type rule for each.
    """
    accepted = results.where(F.col("target_uri") != UNMATCHED)
    ids = (
        accepted.where(F.col("target_uri") == id_target)
        .groupBy(table)
        .agg(F.max_by("source_column", F.struct("confidence", -F.col("ord"))).alias("_id"))
    )
    datatype = F.lit(None).cast("string")
    for uri, dt in TARGET_DATATYPES.items():
        datatype = F.when(F.col("target_uri") == uri, dt).otherwise(datatype)
    subject = F.concat(F.lit(base), F.col(table), F.lit("_$("), F.col("_id"), F.lit(")")).alias("subject_template")
    head = [F.col(table).alias("mapping"), F.col(table).alias("source"), subject]
    rules = accepted.join(ids, table).select(
        *head, F.col("target_uri").alias("predicate"), F.concat(F.lit("$("), F.col("source_column"), F.lit(")")).alias("object_template"),
        F.lit("literal").alias("term_type"), datatype.alias("datatype"),
    )
    if not classes:
        return rules
    named = F.create_map(*[x for k, v in classes.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    typed = ids.select(
        *head, F.lit("rdf:type").alias("predicate"), F.explode(F.try_element_at(named, F.col(table))).alias("object_template"),
        F.lit("iri").alias("term_type"), F.lit(None).cast("string").alias("datatype"),
    )
    return typed.unionByName(rules)


# --- comparison of variants ------------------------------------------------------------------------


def run_variants(
    columns: DataFrame, gold: DataFrame, ontology=ONTOLOGY, tau: float = NGRAM_TAU, encoder=NgramEncoder(), resolver=EvidenceResolver()
) -> DataFrame:
    """The three variants over one input, scored: a row per variant with rates, calls and latency.

    The column table is small next to the data it was sampled from; it is kept so that the data is read once.
    """
    columns = columns.persist()
    runs = {
        "A_SBERT_Only": match_forced(columns, ontology, tau, encoder),
        "B_LLM_Only": match_resolver_only(columns, ontology, resolver),
        "C_Hybrid": match_hybrid(columns, ontology, tau, encoder, resolver),
    }
    every = None
    for i, (name, results) in enumerate(runs.items()):
        part = results.select("source_column", "target_uri", "calls", "latency_ms", F.lit(i).alias("ord"), F.lit(name).alias("variant"))
        every = part if every is None else every.unionByName(part)
    called = F.when(F.col("calls") > 0, F.col("latency_ms"))
    counts = judge(every, gold).groupBy("ord", "variant").agg(
        *[F.count_if(F.col("verdict") == v.upper()).alias(v) for v in ("tp", "fp", "fn", "tn")],
        F.sum("calls").alias("llm_calls"), F.coalesce(F.round(F.avg(called), 1), F.lit(0.0)).alias("avg_latency_ms"),
    )
    return rates(counts)


def _compared(scores: DataFrame, *more: Column) -> DataFrame:
    """One row: best variant, calls saved, F1 gaps, and further aggregates of the same scan."""

    def of(i: int, column: str) -> Column:
        return F.max(F.when(F.col("ord") == i, F.col(column)))

    wide = scores.agg(
        F.max_by("variant", F.struct("f1", -F.col("ord"))).alias("best_f1_variant"),
        *[of(i, "f1").alias(f"f1_{v}") for i, v in enumerate("abc")],
        *[of(i, "llm_calls").alias(f"calls_{v}") for i, v in enumerate("abc")], *more,
    )
    saved = ratio((F.col("calls_b") - F.col("calls_c")) * 100.0, F.col("calls_b"))
    return wide.withColumns({
        "llm_calls_sbert_only": F.col("calls_a"), "llm_calls_llm_only": F.col("calls_b"), "llm_calls_hybrid": F.col("calls_c"),
        "reduction_hybrid_vs_llm_only_pct": F.round(saved, 1),
        "f1_gain_hybrid_vs_sbert_pct": F.round((F.col("f1_c") - F.col("f1_a")) * 100, 2),
        "f1_delta_hybrid_vs_llm_pct": F.round((F.col("f1_c") - F.col("f1_b")) * 100, 2),
    })


# The fields of a comparison report.
_CALLS = ("llm_calls_sbert_only", "llm_calls_llm_only", "llm_calls_hybrid", "reduction_hybrid_vs_llm_only_pct")
_GAPS = ("f1_gain_hybrid_vs_sbert_pct", "f1_delta_hybrid_vs_llm_pct")


def compare_variants(scores: DataFrame) -> DataFrame:
    """One row from the rows ``ord, variant, f1, llm_calls``: best variant, calls saved, F1 gaps.

    The variants are, in order, encoder only, resolver only and hybrid.
    """
    return _compared(scores).select("best_f1_variant", *_CALLS, *_GAPS)


def comparison_report(scores: DataFrame, timestamp: bool = False, elapsed_s: float | None = None) -> DataFrame:
    """The comparison as one JSON document: summary per variant, call analysis, quality analysis; one aggregate.

    With ``timestamp`` it tells when it was made, with ``elapsed_s`` how long the run took.
    """
    per_variant = F.struct("ord", "variant", F.struct("precision", "recall", "f1", "llm_calls", "avg_latency_ms").alias("m"))
    row = _compared(scores, F.sort_array(F.collect_list(per_variant)).alias("_v"))
    summary = F.map_from_entries(F.transform("_v", lambda x: F.struct(x["variant"], x["m"]))).alias("summary")
    head = [F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss").alias("generated_at")] if timestamp else []
    head += [F.lit(round(float(elapsed_s), 1)).alias("elapsed_s")] if elapsed_s is not None else []
    parts = [*head, summary, F.struct(*_CALLS).alias("finops_analysis"), F.struct(*_GAPS, "best_f1_variant").alias("quality_analysis")]
    return row.select(F.to_json(F.struct(*parts)).alias("document"))
