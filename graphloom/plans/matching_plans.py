"""Named queries: columns and vectors matched to a vocabulary, results scored and compared.

Each value of ``documents.source`` counts as a table of its own with the columns of both person tables,
so there are as many (table, column) rows as sources, and their samples come from all rows.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.functions.vectors import cosine
from graphloom.operators.evaluate import compute_metrics, judge
from graphloom.operators.matching import (
    NGRAM_TAU,
    ONTOLOGY,
    column_table,
    compare_variants,
    comparison_report,
    first_result,
    gold_table,
    known_or_unmatched,
    mapping_from_matches,
    match_forced,
    match_hybrid,
    match_resolver_only,
    method_counts,
    parse_answer,
    results_envelope,
    run_variants,
    split_by_threshold,
    with_best_target,
)
from graphloom.operators.nearest import nearest_target
from graphloom.operators.triples import mappings_from_rows, materialize
from graphloom.plans.people import SQL_SOURCES, sources, table

# The matched columns in order.
COLUMNS_A = ["ID_Client", "nom_complet", "email", "dt_naissance", "ville", "ca_annuel", "segment"]
COLUMNS_B = ["Matricule_RH", "Nom_Famille", "Prenom", "date_nais", "departement", "contrat", "salaire_mensuel", "date_embauche"]
VECTOR_TAU = 0.30


def lake(spark, d):
    """One row per source and column; the sources with an odd number have no segment values."""
    a, b = sources(spark, d)
    odd = F.regexp_extract("src", r"(\d+)$", 1).cast("int") % 2 == 1
    a = a.withColumn("segment", F.when(~odd, F.col("segment")))
    left = column_table(a, COLUMNS_A, ["pid"], by=["src"])
    right = column_table(b, COLUMNS_B, ["pid"], by=["src"]).withColumn("ord", F.col("ord") + len(COLUMNS_A))
    return left.unionByName(right)


def _lake(spark, d):
    return lake(spark, d).withColumn("samples", F.array_join("samples", "|"))


def _ngram(spark, d):
    return with_best_target(lake(spark, d).drop("samples")).withColumn("score", F.round("score", 6))


def _hybrid(spark, d):
    return match_hybrid(lake(spark, d))


def _plain(df, *more):
    """The columns of a result without wall-clock times."""
    return df.select("src", "ord", "source_column", "target_uri", "confidence", "method", "justification", "calls", *more)


def _metrics(spark, d):
    return compute_metrics(_hybrid(spark, d), gold_table(spark), by=["src"])


def _verdicts(spark, d):
    return judge(_hybrid(spark, d), gold_table(spark)).select("src", "source_column", "target_uri", "expected", "verdict", "in_gold")


def _report_rows(spark, d):
    results = _hybrid(spark, d)
    return first_result(judge(results, gold_table(spark)), results, ["src", "source_column"]).select(
        "src", "source_column", "target_uri", "expected", "verdict", "method", "confidence"
    )


def variants(spark, d):
    return run_variants(lake(spark, d), gold_table(spark))


#: What the rows of the two tables are.
CLASSES = {"customers": ["ex:Customer", "foaf:Person"], "employees": ["ex:Employee", "foaf:Person"]}


def _mapping_triples(spark, d):
    """The generated rules put to work on the tables they came from, one mapping per table kind."""
    a, b = sources(spark, d)
    frames = {"customers": (a, COLUMNS_A), "employees": (b, COLUMNS_B)}
    rules = None
    for name, (df, columns) in frames.items():
        found = mapping_from_matches(match_hybrid(column_table(df.withColumn("table", F.lit(name)), columns, ["pid"], by=["table"])), "table", classes=CLASSES)
        rules = found if rules is None else rules.unionByName(found)
    return materialize({k: v[0] for k, v in frames.items()}, mappings_from_rows(rules))


def label_targets(spark, d):
    """The first vector of every label."""
    return table(spark, d, "embeddings").groupBy("label").agg(F.min_by("embedding", "vec_id").alias("target"))


def scored_vectors(spark, d):
    e, targets = table(spark, d, "embeddings"), label_targets(spark, d).select(F.col("label").alias("of"), F.col("target").alias("at"))
    return nearest_target(e, "embedding", targets, "of", "at", ["vec_id", "label"])


def _vector_split(spark, d):
    accepted, ambiguous = split_by_threshold(scored_vectors(spark, d), VECTOR_TAU)
    both = accepted.withColumn("side", F.lit("accepted")).unionByName(ambiguous.withColumn("side", F.lit("ambiguous")))
    return both.groupBy("side", "label").agg(F.count(F.lit(1)).alias("n"), F.round(F.min("score"), 6).alias("lowest"), F.round(F.max("score"), 6).alias("highest"))


def _vector_metrics(spark, d):
    predictions = scored_vectors(spark, d).withColumn(
        "target_uri", F.when(F.col("score") >= VECTOR_TAU, F.concat(F.lit("label:"), F.col("target").cast("string"))).otherwise("UNMATCHED")
    )
    gold = table(spark, d, "embeddings").select(
        "vec_id", F.when(F.col("label") < 8, F.concat(F.lit("label:"), F.col("label").cast("string"))).alias("expected_uri")
    )
    return compute_metrics(predictions.select("vec_id", "target_uri"), gold, ["vec_id"])


def _vector_pairs(spark, d):
    """Cosine of each vector to the first vector of its own label."""
    e = table(spark, d, "embeddings")
    paired = e.join(label_targets(spark, d), "label")
    return paired.select("vec_id", F.round(cosine(F.col("embedding"), F.col("target")), 6).alias("cosine"))


def _uri_validation(spark, d):
    """Event types as predicted targets against a vocabulary that lacks some of them."""
    known = {"ev:click": "", "ev:view": "", "ev:purchase": ""}
    uri = F.concat(F.lit("ev:"), F.col("event_type"))
    checked = table(spark, d, "events").select(uri.alias("predicted"), known_or_unmatched(uri, known).alias("target_uri"))
    return checked.groupBy("predicted", "target_uri").agg(F.count(F.lit(1)).alias("n"))


def _answers(spark, d):
    """Answers in five forms made of each event's properties, parsed."""
    k = F.get_json_object("props", "$.k")
    body = F.concat(F.lit('{"cible": " ev:'), F.col("event_type"), F.lit('", "confiance": 0.'), k, F.lit(', "justification": "k='), k, F.lit('"}'))
    form = F.col("event_id") % 5
    answer = (
        F.when(form == 0, body)
        .when(form == 1, F.concat(F.lit("["), body, F.lit(", {}]")))
        .when(form == 2, F.expr("left(props, length(props) - 1)"))
        .when(form == 3, F.col("props"))
        .otherwise(F.lit("[]"))
    )
    parsed = table(spark, d, "events").select("event_id", parse_answer(answer).alias("_a"))
    return parsed.select("event_id", "_a.cible", "_a.confiance", "_a.justification")


QUERIES = {
    "column_table": _lake,
    "column_match_ngram": _ngram,
    "match_forced": lambda s, d: _plain(match_forced(lake(s, d)), "above_tau"),
    "match_resolver": lambda s, d: _plain(match_resolver_only(lake(s, d))),
    "match_hybrid": lambda s, d: _plain(_hybrid(s, d), "pass_no"),
    "match_summary": lambda s, d: method_counts(_hybrid(s, d), ["src"]).drop("avg_latency_ms", "total_llm_time_s"),
    "match_envelope": lambda s, d: results_envelope(_hybrid(s, d), ["src"], timestamp=False),
    "match_metrics": _metrics,
    "match_verdicts": _verdicts,
    "match_report_rows": _report_rows,
    "variant_scores": lambda s, d: variants(s, d).drop("avg_latency_ms"),
    "variant_comparison": lambda s, d: compare_variants(variants(s, d)),
    "variant_report": lambda s, d: comparison_report(variants(s, d)),
    "mapping_from_matches": lambda s, d: mapping_from_matches(_hybrid(s, d), "src"),
    "mapping_triples": _mapping_triples,
    "embedding_top1": lambda s, d: scored_vectors(s, d).withColumn("score", F.round("score", 6)),
    "embedding_split": _vector_split,
    "embedding_metrics": _vector_metrics,
    "embedding_cosine": _vector_pairs,
    "uri_validation": _uri_validation,
    "json_answer_parse": _answers,
}

_ONTOLOGY_SQL = ", ".join(f"({i}, '{u}', '{t.replace(chr(39), chr(39) * 2)}')" for i, (u, t) in enumerate(ONTOLOGY.items()))
# What each column should match.
_GOLD_SQL = """gold AS (SELECT * FROM (VALUES ('ID_Client', 'ex:employeeId'), ('nom_complet', 'ex:fullName'), ('email', 'schema:email'),
  ('dt_naissance', 'schema:birthDate'), ('ville', 'schema:addressLocality'), ('ca_annuel', 'ex:annualRevenue'), ('segment', NULL),
  ('Matricule_RH', 'ex:employeeId'), ('Nom_Famille', 'foaf:familyName'), ('Prenom', 'foaf:firstName'), ('date_nais', 'schema:birthDate'),
  ('departement', 'ex:department'), ('contrat', 'schema:jobTitle'), ('salaire_mensuel', NULL), ('date_embauche', NULL)) g(source_column, expected_uri))"""


def _cells(src: str, columns: list[str], start: int) -> str:
    return " UNION ALL ".join(
        f"SELECT src, pid, {start + i} AS ord, '{c}' AS source_column, "
        + (f"CASE WHEN CAST(regexp_extract(src, '([0-9]+)$', 1) AS INTEGER) % 2 = 0 THEN {c} END" if c == "segment" else c)
        + f" AS value FROM {src}"
        for i, c in enumerate(columns)
    )


_LAKE_SQL = f"""WITH {SQL_SOURCES.strip()},
cells AS ({_cells('src_a', COLUMNS_A, 0)} UNION ALL {_cells('src_b', COLUMNS_B, len(COLUMNS_A))}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY src, source_column ORDER BY md5('42|' || source_column || '|' || value || '|' || pid), value) AS rank
  FROM cells WHERE value IS NOT NULL),
lake AS (SELECT c.src, c.ord, c.source_column, coalesce(r.samples, []) AS samples FROM (SELECT DISTINCT src, ord, source_column FROM cells) c
  LEFT JOIN (SELECT src, source_column, list(value ORDER BY rank) AS samples FROM ranked WHERE rank <= 3 GROUP BY 1, 2) r
  ON c.src = r.src AND c.source_column = r.source_column),
onto AS (SELECT * FROM (VALUES {_ONTOLOGY_SQL}) o(ord, uri, description)),
texts AS (SELECT DISTINCT 'c' AS kind, source_column AS id, source_column AS txt FROM lake UNION ALL SELECT 'o', uri, description FROM onto),
padded AS (SELECT kind, id, ' ' || trim(regexp_replace(strip_accents(lower(txt)), '[^a-z0-9]+', ' ', 'g')) || ' ' AS t FROM texts),
grams AS (SELECT kind, id, gram, count(*) AS n FROM (SELECT kind, id, unnest([t[i:i + 2] FOR i IN range(1, length(t) - 1)]) AS gram FROM padded) GROUP BY ALL),
norms AS (SELECT kind, id, sqrt(sum(n * n)) AS norm FROM grams GROUP BY ALL),
dots AS (SELECT c.id AS source_column, o.id AS uri, sum(c.n * o.n) AS dot FROM grams c JOIN grams o ON c.gram = o.gram AND c.kind = 'c' AND o.kind = 'o' GROUP BY ALL),
scores AS (SELECT c.id AS source_column, onto.uri, onto.ord, coalesce(dot, 0) / (c.norm * o.norm) AS score
  FROM norms c JOIN norms o ON c.kind = 'c' AND o.kind = 'o' JOIN onto ON onto.uri = o.id LEFT JOIN dots ON dots.source_column = c.id AND dots.uri = o.id),
best AS (SELECT source_column, uri AS best_uri, score FROM (SELECT *, row_number() OVER (PARTITION BY source_column ORDER BY score DESC, ord) AS r FROM scores) WHERE r = 1),
scored AS (SELECT lake.*, best_uri, score FROM lake JOIN best USING (source_column)),
answers AS (SELECT *, CASE WHEN list_contains(regexp_split_to_array(lower(source_column), '[^a-z0-9]+'), 'matricule') THEN 'ex:employeeId'
    WHEN list_contains(regexp_split_to_array(lower(source_column), '[^a-z0-9]+'), 'famille') THEN 'foaf:familyName'
    WHEN len(list_filter(samples, lambda v: NOT regexp_matches(v, '^[^@\\s]+@[^@\\s]+\\.[a-z]+$'))) = 0 THEN 'schema:email'
    WHEN len(list_filter(samples, lambda v: NOT regexp_matches(v, '^[A-Z]{{1,4}}-?[0-9]+$'))) = 0 THEN 'ex:employeeId' ELSE 'UNMATCHED' END AS uri,
  CASE WHEN list_contains(regexp_split_to_array(lower(source_column), '[^a-z0-9]+'), 'matricule') THEN 'alias matricule'
    WHEN list_contains(regexp_split_to_array(lower(source_column), '[^a-z0-9]+'), 'famille') THEN 'alias famille' ELSE 'values' END AS why FROM scored),
forced AS (SELECT src, ord, source_column, best_uri AS target_uri, round(score, 4) AS confidence, 'SBERT' AS method,
  printf('similarity %.4f, %s {NGRAM_TAU}', score, CASE WHEN score >= {NGRAM_TAU} THEN 'not below' ELSE 'below' END) AS justification, 0 AS calls, score >= {NGRAM_TAU} AS above_tau FROM scored),
resolver AS (SELECT src, ord, source_column, CASE WHEN len(samples) = 0 THEN 'UNMATCHED' ELSE uri END AS target_uri,
  CASE WHEN len(samples) = 0 OR uri = 'UNMATCHED' THEN 0 WHEN starts_with(why, 'alias') THEN 0.9 ELSE 0.7 END::DOUBLE AS confidence, 'LLM_ONLY' AS method,
  CASE WHEN len(samples) = 0 THEN 'no values to ask about' WHEN uri = 'UNMATCHED' THEN 'no evidence' ELSE why END AS justification,
  CASE WHEN len(samples) = 0 THEN 0 ELSE 1 END AS calls FROM answers),
hybrid AS (SELECT src, ord, source_column,
  CASE WHEN score >= {NGRAM_TAU} THEN best_uri WHEN len(samples) = 0 THEN 'UNMATCHED' ELSE uri END AS target_uri,
  CASE WHEN score >= {NGRAM_TAU} THEN round(score, 4) WHEN len(samples) = 0 OR uri = 'UNMATCHED' THEN 0 WHEN starts_with(why, 'alias') THEN 0.9 ELSE 0.7 END AS confidence,
  CASE WHEN score >= {NGRAM_TAU} THEN 'SBERT' WHEN len(samples) = 0 OR uri = 'UNMATCHED' THEN 'UNMATCHED' ELSE 'LLM' END AS method,
  CASE WHEN score >= {NGRAM_TAU} THEN printf('similarity %.4f reaches {NGRAM_TAU}', score)
    WHEN len(samples) = 0 OR uri = 'UNMATCHED' THEN 'neither pass found a target' ELSE why END AS justification,
  CASE WHEN score >= {NGRAM_TAU} OR len(samples) = 0 THEN 0 ELSE 1 END AS calls, CASE WHEN score >= {NGRAM_TAU} THEN 1 ELSE 2 END AS pass_no FROM answers),
{_GOLD_SQL},
runs AS (SELECT 0 AS vo, 'A_SBERT_Only' AS variant, src, source_column, target_uri, calls FROM forced
  UNION ALL SELECT 1, 'B_LLM_Only', src, source_column, target_uri, calls FROM resolver UNION ALL SELECT 2, 'C_Hybrid', src, source_column, target_uri, calls FROM hybrid),
judged AS (SELECT r.*, g.expected_uri, CASE WHEN expected_uri IS NULL THEN CASE WHEN target_uri = 'UNMATCHED' THEN 'TN' ELSE 'FP' END
  WHEN target_uri = 'UNMATCHED' THEN 'FN' WHEN target_uri = expected_uri THEN 'TP' ELSE 'FP' END AS verdict FROM runs r LEFT JOIN gold g USING (source_column))
"""


def _rates_sql(counts: str, keys: str) -> str:
    return f"""SELECT {keys} tp, fp, fn, tn, round(pr, 4) AS precision, round(re, 4) AS recall,
    round(CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0 END, 4) AS f1, round(CASE WHEN tn + fp > 0 THEN tn / (tn + fp) ELSE 0 END, 4) AS specificity
    FROM (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS pr, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS re FROM ({counts}))"""


_COUNT_VERDICTS = "count(*) FILTER (verdict = 'TP') AS tp, count(*) FILTER (verdict = 'FP') AS fp, count(*) FILTER (verdict = 'FN') AS fn, count(*) FILTER (verdict = 'TN') AS tn"
_VARIANTS = _rates_sql(f"SELECT vo AS ord, variant, {_COUNT_VERDICTS}, sum(calls)::BIGINT AS llm_calls FROM judged GROUP BY vo, variant", "ord, variant, llm_calls,")
_COMPARED = f"""SELECT max_by(variant, f1 * 1000 - ord) AS best_f1_variant, max(llm_calls) FILTER (ord = 0) AS llm_calls_sbert_only,
  max(llm_calls) FILTER (ord = 1) AS llm_calls_llm_only, max(llm_calls) FILTER (ord = 2) AS llm_calls_hybrid,
  round((max(llm_calls) FILTER (ord = 1) - max(llm_calls) FILTER (ord = 2)) * 100.0 / max(llm_calls) FILTER (ord = 1), 1) AS reduction_hybrid_vs_llm_only_pct,
  round((max(f1) FILTER (ord = 2) - max(f1) FILTER (ord = 0)) * 100, 2) AS f1_gain_hybrid_vs_sbert_pct,
  round((max(f1) FILTER (ord = 2) - max(f1) FILTER (ord = 1)) * 100, 2) AS f1_delta_hybrid_vs_llm_pct FROM ({_VARIANTS})"""
_VECTORS = """WITH t AS (SELECT label AS target, arg_min(embedding, vec_id)::DOUBLE[] AS v FROM embeddings GROUP BY label),
s AS (SELECT vec_id, label, target, list_cosine_similarity(embedding::DOUBLE[], v) AS score FROM embeddings, t),
b AS (SELECT vec_id, label, target, score FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, target) AS r FROM s) WHERE r = 1)
"""
_ANSWER_SQL = """SELECT event_id, CASE WHEN event_id % 5 < 2 THEN 'ev:' || event_type END AS cible,
  CASE WHEN event_id % 5 < 2 THEN CAST('0.' || (props->>'$.k') AS DOUBLE) END AS confiance,
  CASE WHEN event_id % 5 < 2 THEN 'k=' || (props->>'$.k') END AS justification FROM events"""
_DT = "CASE target_uri WHEN 'schema:birthDate' THEN 'xsd:date' WHEN 'ex:annualRevenue' THEN 'xsd:decimal' END AS datatype"

ORACLE = {
    "column_table": _LAKE_SQL + "SELECT src, ord, source_column, array_to_string(samples, '|') AS samples FROM lake",
    "column_match_ngram": _LAKE_SQL + "SELECT src, ord, source_column, best_uri, round(score, 6) AS score FROM scored",
    "match_forced": _LAKE_SQL + "SELECT * FROM forced",
    "match_resolver": _LAKE_SQL + "SELECT * FROM resolver",
    "match_hybrid": _LAKE_SQL + "SELECT * FROM hybrid",
    "match_summary": _LAKE_SQL + """SELECT src, count(*) AS total_columns, count(*) FILTER (method = 'SBERT') AS sbert_count, count(*) FILTER (method = 'LLM') AS llm_count,
      count(*) FILTER (method = 'UNMATCHED') AS unmatched, sum(calls)::BIGINT AS llm_calls FROM hybrid GROUP BY src""",
    "match_envelope": _LAKE_SQL + """SELECT src, to_json({'total_columns': count(*), 'sbert_count': count(*) FILTER (method = 'SBERT'), 'llm_count': count(*) FILTER (method = 'LLM'),
      'unmatched': count(*) FILTER (method = 'UNMATCHED'), 'results': list({'source_column': source_column, 'target_uri': target_uri, 'confidence': confidence::DOUBLE, 'method': method, 'justification': justification}
      ORDER BY pass_no, ord)})::VARCHAR AS document FROM hybrid GROUP BY src""",
    "match_metrics": _LAKE_SQL + _rates_sql(f"SELECT src, {_COUNT_VERDICTS} FROM judged WHERE vo = 2 GROUP BY src", "src,"),
    "match_verdicts": _LAKE_SQL + "SELECT src, source_column, target_uri, coalesce(expected_uri, 'UNMATCHED') AS expected, verdict, true AS in_gold FROM judged WHERE vo = 2",
    "match_report_rows": _LAKE_SQL + """SELECT j.src, j.source_column, j.target_uri, coalesce(expected_uri, 'UNMATCHED') AS expected, verdict, h.method, h.confidence::VARCHAR AS confidence
      FROM judged j JOIN hybrid h USING (src, source_column) WHERE vo = 2""",
    "variant_scores": _LAKE_SQL + _VARIANTS,
    "variant_comparison": _LAKE_SQL + _COMPARED,
    "variant_report": _LAKE_SQL + f""", v AS ({_VARIANTS}), c AS ({_COMPARED})
      SELECT to_json({{'summary': {{{", ".join(f"'{n}': (SELECT {{'precision': precision, 'recall': recall, 'f1': f1, 'llm_calls': llm_calls, 'avg_latency_ms': 0::DOUBLE}} FROM v WHERE ord = {i})" for i, n in enumerate(["A_SBERT_Only", "B_LLM_Only", "C_Hybrid"]))}}},
      'finops_analysis': {{'llm_calls_sbert_only': llm_calls_sbert_only, 'llm_calls_llm_only': llm_calls_llm_only, 'llm_calls_hybrid': llm_calls_hybrid, 'reduction_hybrid_vs_llm_only_pct': reduction_hybrid_vs_llm_only_pct::DOUBLE}},
      'quality_analysis': {{'f1_gain_hybrid_vs_sbert_pct': f1_gain_hybrid_vs_sbert_pct, 'f1_delta_hybrid_vs_llm_pct': f1_delta_hybrid_vs_llm_pct, 'best_f1_variant': best_f1_variant}}}})::VARCHAR AS document FROM c""",
    "mapping_from_matches": _LAKE_SQL + f"""SELECT h.src AS mapping, h.src AS source, 'http://kg.projet.fr/ontology#' || h.src || '_$(' || i.id || ')' AS subject_template,
      target_uri AS predicate, '$(' || source_column || ')' AS object_template, 'literal' AS term_type, {_DT}
      FROM hybrid h JOIN (SELECT src, arg_max(source_column, confidence * 1000 - ord) AS id FROM hybrid WHERE target_uri = 'ex:employeeId' GROUP BY src) i USING (src)
      WHERE target_uri <> 'UNMATCHED'""",
    "embedding_top1": _VECTORS + "SELECT vec_id, label, target, round(score, 6) AS score FROM b",
    "embedding_split": _VECTORS + f"""SELECT CASE WHEN score >= {VECTOR_TAU} THEN 'accepted' ELSE 'ambiguous' END AS side, label, count(*) AS n,
      round(min(score), 6) AS lowest, round(max(score), 6) AS highest FROM b GROUP BY 1, 2""",
    "embedding_metrics": _VECTORS + _rates_sql(
        f"""SELECT {_COUNT_VERDICTS} FROM (SELECT CASE WHEN label >= 8 THEN CASE WHEN score < {VECTOR_TAU} THEN 'TN' ELSE 'FP' END
        WHEN score < {VECTOR_TAU} THEN 'FN' WHEN target = label THEN 'TP' ELSE 'FP' END AS verdict FROM b)""", ""
    ),
    "embedding_cosine": _VECTORS + "SELECT vec_id, round(score, 6) AS cosine FROM s WHERE label = target",
    "uri_validation": """SELECT 'ev:' || event_type AS predicted, CASE WHEN event_type IN ('click', 'view', 'purchase') THEN 'ev:' || event_type ELSE 'UNMATCHED' END AS target_uri,
      count(*) AS n FROM events GROUP BY 1, 2""",
    "json_answer_parse": _ANSWER_SQL,
}


def _generated_triples_sql() -> str:
    """What the generated rules say of the two tables, written out."""
    ex, xsd, schema = "http://kg.projet.fr/ontology#", "http://www.w3.org/2001/XMLSchema#", "https://schema.org/"
    rules = {
        ("src_a", "customers", "ID_Client", "Customer"): {
            "ID_Client": (f"{ex}employeeId", None), "nom_complet": (f"{ex}fullName", None), "email": (f"{schema}email", None), "dt_naissance": (f"{schema}birthDate", "date"),
            "ville": (f"{schema}addressLocality", None), "ca_annuel": (f"{ex}annualRevenue", "decimal"),
        },
        ("src_b", "employees", "Matricule_RH", "Employee"): {
            "Matricule_RH": (f"{ex}employeeId", None), "Nom_Famille": (f"{ex}fullName", None), "Prenom": ("http://xmlns.com/foaf/0.1/firstName", None),
            "date_nais": (f"{schema}birthDate", "date"), "departement": (f"{ex}department", None), "contrat": (f"{schema}jobTitle", None),
        },
    }
    parts = []
    for (source, name, key, of), columns in rules.items():
        s = f"'{ex}{name}_' || url_encode({key})"
        for c in (f"{ex}{of}", "http://xmlns.com/foaf/0.1/Person"):
            parts.append(f"SELECT {s} AS s, 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type' AS p, '{c}' AS o, 'iri' AS o_kind, NULL::VARCHAR AS o_datatype, NULL::VARCHAR AS o_lang FROM {source}")
        for c, (p, kind) in columns.items():
            parts.append(f"SELECT {s}, '{p}', {c}, 'literal', {f"'{xsd}{kind}'" if kind else 'NULL'}, NULL FROM {source} WHERE {c} IS NOT NULL")
    return f"WITH {SQL_SOURCES.strip()}\n" + " UNION ".join(parts)


ORACLE["mapping_triples"] = _generated_triples_sql()
