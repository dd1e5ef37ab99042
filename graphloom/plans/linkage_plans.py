"""Named queries over the two person tables: standard form, blocks, model, links."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.text import normalize_name, joined_name, lenient_date, strict_date
from graphloom.operators import fellegi_sunter as general
from graphloom.operators.evaluate import rates
from graphloom.operators.linkage import (
    Linkage,
    LinkageConfig,
    block_sizes,
    blocking_pairs,
    compare_pairs,
    counted,
    link_triples,
    pattern_counts,
    score_links,
)
from graphloom.plans.people import SQL_SOURCES, sources, standardized, truth

CONFIG = LinkageConfig()
EXACT = LinkageConfig(pairs_per_record=None)


def fitted(spark: SparkSession, sf_dir: str, config: LinkageConfig = CONFIG, prior=None) -> Linkage:
    return Linkage.fit(*standardized(spark, sf_dir), config, prior)


def _source_a(spark, d):
    return sources(spark, d)[0]


def _source_b(spark, d):
    return sources(spark, d)[1]


def _standardize_a(spark, d):
    return standardized(spark, d)[0]


def _standardize_b(spark, d):
    return standardized(spark, d)[1]


def _block_sizes(spark, d):
    sizes = block_sizes(*standardized(spark, d))
    return sizes.withColumn("pairs", F.col("pairs").cast("bigint"))


def _blocking_pairs(spark, d):
    return blocking_pairs(*standardized(spark, d)).select(
        F.col("unique_id_l").alias("id_l"), F.col("unique_id_r").alias("id_r"), F.col("date_comparaison_l").alias("block")
    )


def _blocking_two_rules(spark, d):
    pairs = blocking_pairs(*standardized(spark, d), rules=[["date_comparaison"], ["nom_comparaison"]])
    return compare_pairs(pairs, CONFIG.thresholds).select(
        F.col("unique_id_l").alias("id_l"), F.col("unique_id_r").alias("id_r"), "gamma_name", "gamma_date"
    )


def _pattern_counts(spark, d):
    # records that agree in both columns are compared once
    sides = [counted(df, ["date_comparaison", "nom_comparaison"]) for df in standardized(spark, d)]
    return pattern_counts(compare_pairs(blocking_pairs(*sides), CONFIG.thresholds))


def _name_levels(spark, d):
    return fitted(spark, d).level_table().select("gamma_name", "pairs")


def _u(config):
    def run(spark, d):
        return _u_rows(spark, fitted(spark, d, config))
    return run


def _u_rows(spark, linkage):
    rows = [(c, k, linkage.model.u[c][k]) for c in ("name", "date") for k in linkage.model.u[c]]
    return spark.createDataFrame(rows, "comparison string, level int, u double").withColumn("u", F.round("u", 9))


def _m(spark, d):
    model = fitted(spark, d).model
    rows = [("name", k, model.m["name"][k], model.iterations, model.training_prior) for k in model.m["name"]]
    frame = spark.createDataFrame(rows, "comparison string, level int, m double, iterations int, training_prior double")
    return frame.withColumns({"m": F.round("m", 6), "training_prior": F.round("training_prior", 6)})


def _scored_levels(spark, d):
    return fitted(spark, d).level_table().withColumns(
        {"match_weight": F.round("match_weight", 6), "match_probability": F.round("match_probability", 6)}
    )


def _scored_pairs(config):
    def run(spark, d):
        return fitted(spark, d, config).links().withColumns(
            {"match_weight": F.round("match_weight", 6), "match_probability": F.round("match_probability", 6)}
        )
    return run


def _sameas(spark, d):
    return link_triples(fitted(spark, d).links()).select("s", "p", "o")


def _coverage(spark, d):
    linkage = fitted(spark, d)
    return linkage.coverage(linkage.links())


def _metrics(spark, d):
    return rates(score_links(fitted(spark, d).links(), truth(spark, d)), digits=6)


#: Names, dates and where a record comes from (unknown for some), blocked on the date and on the name.
TWO_RULES = general.Settings(
    comparisons=(general.similarity("name", "name"), general.equality("date", "date"), general.equality("origin", "origin")),
    rules=(("date",), ("name",)),
)


def persons(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Both person tables with the origin of their records, which every seventh person lacks."""
    a, b = sources(spark, sf_dir)
    origin = F.when(F.col("pid") % 7 != 0, F.col("src")).alias("origin")
    left = a.select(F.col("ID_Client").alias("unique_id"), normalize_name(F.col("nom_complet")).alias("name"), strict_date(F.col("dt_naissance")).alias("date"), origin)
    full = normalize_name(joined_name(F.col("Prenom"), F.col("Nom_Famille")))
    return left, b.select(F.col("Matricule_RH").alias("unique_id"), full.alias("name"), lenient_date(F.col("date_nais")).alias("date"), origin)


def _model_two_rules(spark, d):
    model, _ = general.fit(*persons(spark, d), TWO_RULES)
    rows = [(c.name, k, model.m[c.name][k], model.u[c.name][k]) for c in TWO_RULES.comparisons for k in range(c.levels)]
    frame = spark.createDataFrame(rows, "comparison string, level int, m double, u double")
    return frame.withColumns({"m": F.round("m", 6), "u": F.round("u", 9)})


def _runs_two_rules(spark, d):
    model, _ = general.fit(*persons(spark, d), TWO_RULES)
    return spark.createDataFrame([*model.runs], "rule int, iterations int, share double").withColumn("share", F.round("share", 6))


def _patterns_two_rules(spark, d):
    return general.pattern_table(general.candidate_pairs(*persons(spark, d), TWO_RULES, alike_once=True), TWO_RULES)


def _scored_two_rules(spark, d):
    model, pairs = general.fit(*persons(spark, d), TWO_RULES)
    return general.scored(pairs, model).withColumns({"match_weight": F.round("match_weight", 6), "match_probability": F.round("match_probability", 6)})


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identity links as triples. The prior follows the table sizes, so that small tables give links too."""
    linkage = fitted(spark, sf_dir, CONFIG, prior=lambda n_l, n_r: 1.0 / max(n_l, n_r, 2))
    return link_triples(linkage.links()).select("s", "p", "o")


QUERIES = {
    "source_a": _source_a,
    "source_b": _source_b,
    "standardize_a": _standardize_a,
    "standardize_b": _standardize_b,
    "block_sizes": _block_sizes,
    "blocking_pairs": _blocking_pairs,
    "blocking_two_rules": _blocking_two_rules,
    "pattern_counts": _pattern_counts,
    "name_levels": _name_levels,
    "u_probabilities": _u(CONFIG),
    "u_probabilities_exact": _u(EXACT),
    "m_probabilities": _m,
    "scored_levels": _scored_levels,
    "scored_pairs": _scored_pairs(CONFIG),
    "scored_pairs_exact_u": _scored_pairs(EXACT),
    "sameas_links": _sameas,
    "link_coverage": _coverage,
    "link_metrics": _metrics,
    "pattern_counts_two_rules": _patterns_two_rules,
    "m_probabilities_two_rules": _model_two_rules,
    "training_two_rules": _runs_two_rules,
    "scored_pairs_two_rules": _scored_two_rules,
}

_LEVEL = """CASE WHEN {a} = {b} THEN 3 WHEN jaro_winkler_similarity({a}, {b}) >= 0.9 THEN 2
            WHEN jaro_winkler_similarity({a}, {b}) >= 0.8 THEN 1 ELSE 0 END"""
_NAMES = _LEVEL.format(a="a.nom_comparaison", b="b.nom_comparaison")

_CANDIDATES = f"""
candidates AS (
  SELECT a.unique_id AS id_l, b.unique_id AS id_r, {_NAMES} AS g
  FROM std_a a JOIN std_b b ON a.date_comparaison = b.date_comparaison
),
sizes AS (SELECT (SELECT count(*) FROM std_a) AS nl, (SELECT count(*) FROM std_b) AS nr),
in_block AS (SELECT l.g, count(c.g) AS pairs FROM (VALUES (0), (1), (2), (3)) l(g) LEFT JOIN candidates c ON c.g = l.g GROUP BY l.g)
"""

_BUCKET = "('0x' || substr(md5('42|' || {t}.unique_id), 1, 8))::BIGINT % (SELECT CAST(greatest(ceil(greatest(nl, nr) / 1e3), 1) AS BIGINT) FROM sizes)"
_SAMPLED = f"""
cross_levels AS (
  SELECT {_NAMES} AS g FROM std_a a JOIN std_b b ON {_BUCKET.format(t='a')} = {_BUCKET.format(t='b')}
)
"""
_EVERY = f"""
cross_levels AS (SELECT {_NAMES} AS g FROM std_a a, std_b b)
"""
_U = """
equal AS (
  SELECT coalesce(sum(n * m), 0)::DOUBLE / (SELECT nl * nr FROM sizes) AS u
  FROM (SELECT nom_comparaison, count(*) AS n FROM std_a GROUP BY 1) JOIN (SELECT nom_comparaison, count(*) AS m FROM std_b GROUP BY 1) USING (nom_comparaison)
),
u AS (
  SELECT l.g, least(greatest(CASE WHEN l.g = 3 THEN any_value(equal.u)
    ELSE (1 - any_value(equal.u)) * count(c.g)::DOUBLE / (SELECT count(*) FROM cross_levels WHERE g < 3) END, 1e-9), 1 - 1e-9) AS u
  FROM (VALUES (0), (1), (2), (3)) l(g) CROSS JOIN equal LEFT JOIN cross_levels c ON c.g = l.g GROUP BY l.g
),
ud AS (SELECT (SELECT sum(pairs) FROM in_block)::DOUBLE / (nl * nr) AS u FROM sizes)
"""
_EM = """
em AS (
  SELECT 0 AS it, 1e0 AS delta, 0.95e0 AS m3, 0.05e0 / 3 AS m2, 0.05e0 / 3 AS m1, 0.05e0 / 3 AS m0,
         (SELECT 1e-4 / (1 - 1e-4) * 0.95 / u / (1 + 1e-4 / (1 - 1e-4) * 0.95 / u) FROM ud) AS lam
  UNION ALL
  SELECT it + 1, greatest(abs(x3 / mass - m3), abs(x2 / mass - m2), abs(x1 / mass - m1), abs(x0 / mass - m0), abs(mass / total - lam)),
         x3 / mass, x2 / mass, x1 / mass, x0 / mass, mass / total
  FROM (
    SELECT *, x3 + x2 + x1 + x0 AS mass FROM (
      SELECT em.*, k.n3 + k.n2 + k.n1 + k.n0 AS total,
             k.n3 * lam * m3 / (lam * m3 + (1 - lam) * k.u3) AS x3, k.n2 * lam * m2 / (lam * m2 + (1 - lam) * k.u2) AS x2,
             k.n1 * lam * m1 / (lam * m1 + (1 - lam) * k.u1) AS x1, k.n0 * lam * m0 / (lam * m0 + (1 - lam) * k.u0) AS x0
      FROM em, knowns k WHERE it < 25 AND delta >= 1e-4
    )
  )
),
trained AS (SELECT * FROM em ORDER BY it DESC LIMIT 1),
model AS (
  SELECT u.g, u.u, CASE u.g WHEN 3 THEN m3 WHEN 2 THEN m2 WHEN 1 THEN m1 ELSE m0 END AS m, it, lam FROM u, trained
),
weights AS (
  SELECT g, w, 1 / (1 + pow(2, -w)) AS p
  FROM (SELECT g, log2(1e-4 / (1 - 1e-4)) + log2(m / model.u) + log2(0.95 / ud.u) AS w FROM model, ud)
),
links AS (SELECT id_l, id_r, c.g, w, p FROM candidates c JOIN weights USING (g) WHERE p >= 0.85)
"""
_KNOWNS = """
knowns AS (
  SELECT max(CASE WHEN g = 3 THEN pairs END) AS n3, max(CASE WHEN g = 2 THEN pairs END) AS n2,
         max(CASE WHEN g = 1 THEN pairs END) AS n1, max(CASE WHEN g = 0 THEN pairs END) AS n0,
         max(CASE WHEN g = 3 THEN u END) AS u3, max(CASE WHEN g = 2 THEN u END) AS u2,
         max(CASE WHEN g = 1 THEN u END) AS u1, max(CASE WHEN g = 0 THEN u END) AS u0
  FROM in_block JOIN u USING (g)
)
"""


def linkage_sql(select: str, cross: str = _SAMPLED) -> str:
    """``select`` over ``links`` and the steps before it; one that starts with a comma adds steps."""
    parts = [SQL_SOURCES, _CANDIDATES, cross, _U, _KNOWNS, _EM]
    return "WITH RECURSIVE " + ",".join(p.strip() for p in parts) + "\n" + select


_SCORED = "SELECT id_l, id_r, g AS gamma_name, 1 AS gamma_date, round(w, 6) AS match_weight, round(p, 6) AS match_probability FROM links"
_U_ROWS = """SELECT 'name' AS comparison, g AS level, round(u, 9) AS u FROM u
UNION ALL SELECT 'date', 1, round(u, 9) FROM ud UNION ALL SELECT 'date', 0, round(1 - u, 9) FROM ud"""
SQL_LINKS = """SELECT 'http://kg.projet.fr/ontology#Employee_' || url_encode(id_r) AS s,
  'http://www.w3.org/2002/07/owl#sameAs' AS p, 'http://kg.projet.fr/ontology#Customer_' || url_encode(id_l) AS o FROM links"""


def _plain(select: str) -> str:
    return f"WITH {SQL_SOURCES.strip()}\n{select}"


ORACLE = {
    "source_a": _plain("SELECT * FROM src_a"),
    "source_b": _plain("SELECT * FROM src_b"),
    "standardize_a": _plain("SELECT * FROM std_a"),
    "standardize_b": _plain("SELECT * FROM std_b"),
    "block_sizes": _plain(
        """SELECT date_comparaison, n_l, n_r, n_l * n_r AS pairs
        FROM (SELECT date_comparaison, count(*) AS n_l FROM std_a GROUP BY 1)
        JOIN (SELECT date_comparaison, count(*) AS n_r FROM std_b GROUP BY 1) USING (date_comparaison)"""
    ),
    "blocking_pairs": _plain(
        """SELECT a.unique_id AS id_l, b.unique_id AS id_r, date_comparaison AS block
        FROM std_a a JOIN std_b b USING (date_comparaison)"""
    ),
    "blocking_two_rules": _plain(
        f"""SELECT a.unique_id AS id_l, b.unique_id AS id_r, {_NAMES} AS gamma_name,
        CASE WHEN a.date_comparaison = b.date_comparaison THEN 1 ELSE 0 END AS gamma_date
        FROM std_a a JOIN std_b b ON a.date_comparaison = b.date_comparaison OR a.nom_comparaison = b.nom_comparaison"""
    ),
    "pattern_counts": linkage_sql("SELECT g AS gamma_name, 1 AS gamma_date, pairs FROM in_block WHERE pairs > 0"),
    "name_levels": linkage_sql("SELECT g AS gamma_name, pairs FROM in_block"),
    "u_probabilities": linkage_sql(_U_ROWS),
    "u_probabilities_exact": linkage_sql(_U_ROWS, _EVERY),
    "m_probabilities": linkage_sql(
        "SELECT 'name' AS comparison, g AS level, round(m, 6) AS m, it AS iterations, round(lam, 6) AS training_prior FROM model"
    ),
    "scored_levels": linkage_sql(
        """SELECT g AS gamma_name, pairs, round(w, 6) AS match_weight, round(p, 6) AS match_probability
        FROM weights JOIN in_block USING (g)"""
    ),
    "scored_pairs": linkage_sql(_SCORED),
    "scored_pairs_exact_u": linkage_sql(_SCORED, _EVERY),
    "sameas_links": linkage_sql(SQL_LINKS),
    "link_coverage": linkage_sql(
        """SELECT count(*) AS links, (SELECT count(*) FROM std_a) AS left_rows,
        round(count(*) / (SELECT count(*) FROM std_a) * 100, 6) AS coverage_pct FROM links"""
    ),
    "link_metrics": linkage_sql(
        """SELECT tp, fp, fn, 0 AS tn, round(pr, 6) AS precision, round(re, 6) AS recall,
        round(CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0 END, 6) AS f1, 0.0::DOUBLE AS specificity
        FROM (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS pr, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS re
        FROM (SELECT count(*) FILTER (l.id_l IS NOT NULL AND t.id_l IS NOT NULL) AS tp,
                     count(*) FILTER (t.id_l IS NULL) AS fp, count(*) FILTER (l.id_l IS NULL) AS fn
              FROM links l FULL JOIN (SELECT ID_Client AS id_l, Matricule_RH AS id_r FROM src_a JOIN src_b USING (pid)) t
              ON l.id_l = t.id_l AND l.id_r = t.id_r))"""
    ),
}

_ORIGIN = "CASE WHEN a.origin IS NULL OR b.origin IS NULL THEN -1 WHEN a.origin = b.origin THEN 1 ELSE 0 END"
_THREE = f"""{_LEVEL.format(a="a.name", b="b.name")} AS gn, CASE WHEN a.date = b.date THEN 1 ELSE 0 END AS gd, {_ORIGIN} AS go"""
_DRAWN = "('0x' || substr(md5('42|' || {t}.unique_id), 1, 8))::BIGINT % (SELECT CAST(greatest(ceil(greatest(nl, nr) / 3e2), 1) AS BIGINT) FROM n)"


def _em_sql(name: str, patterns: str, levels: dict[str, int], odds: str) -> str:
    """A recursive table ``name``: one row per iteration, a column ``<comparison><level>`` for each m, and ``lam``."""
    every = [(c, k) for c, n in levels.items() for k in range(n)]
    start = ", ".join(f"{'0.95e0' if k == levels[c] - 1 else f'0.05e0 / {levels[c] - 1}'} AS {c}{k}" for c, k in every)
    pick = {c: "CASE g" + c + " " + " ".join(f"WHEN {k} THEN {c}{k}" for k in range(n)) + " ELSE 1 END" for c, n in levels.items()}
    yes = " * ".join(pick.values())
    kept = ", ".join(f"any_value({c}{k}) AS {c}{k}" for c, k in every)
    sums = ", ".join(f"coalesce(sum(x) FILTER (g{c} = {k}), 0) / sum(x) FILTER (g{c} >= 0) AS new_{c}{k}" for c, k in every)
    clamp = "least(greatest({}, 1e-9), 1 - 1e-9)".format
    news = ", ".join(clamp(f"new_{c}{k}") for c, k in every)
    change = ", ".join(f"abs({clamp(f'new_{c}{k}')} - {c}{k})" for c, k in every)
    return f"""
{name} AS (
  SELECT 0 AS it, 1e0 AS delta, ({odds}) / (1 + ({odds})) AS lam, {start}
  UNION ALL
  SELECT it + 1, greatest(abs({clamp('new_lam')} - lam), {change}), {clamp('new_lam')}, {news}
  FROM (SELECT it, any_value(lam) AS lam, sum(x) / sum(pairs) AS new_lam, {kept}, {sums}
        FROM (SELECT *, pairs * lam * {yes} / (lam * {yes} + (1 - lam) * uu) AS x FROM {name}, {patterns} WHERE it < 25 AND delta >= 1e-4) GROUP BY it)
),
{name}_end AS (SELECT * FROM {name} ORDER BY it DESC LIMIT 1)"""


def two_rules_sql(select: str) -> str:
    u_rows = " UNION ALL ".join(
        f"SELECT '{c}' AS c, l AS k, least(greatest((count(*) FILTER (g{c[0]} = l))::DOUBLE / (count(*) FILTER (g{c[0]} >= 0)), 1e-9), 1 - 1e-9) AS u FROM drawn, range(0, {n}) t(l) GROUP BY l"
        for c, n in (("name", 4), ("date", 2), ("origin", 2))
    )
    look = lambda c, g: f"coalesce((SELECT u FROM u WHERE c = '{c}' AND k = {g}), 1)"
    odds = lambda c, top: f"SELECT 1e-4 / (1 - 1e-4) * 0.95e0 / u FROM u WHERE c = '{c}' AND k = {top}"
    m_rows = " UNION ALL ".join(
        [f"SELECT 'name' AS c, {k} AS k, n{k} AS m FROM by_date_end" for k in range(4)] + [f"SELECT 'date', {k}, d{k} FROM by_name_end" for k in range(2)]
        + [f"SELECT 'origin', {k}, (a.o{k} + b.o{k}) / 2 FROM by_date_end a, by_name_end b" for k in range(2)]
    )
    return f"""WITH RECURSIVE {SQL_SOURCES.strip()},
per_a AS (SELECT ID_Client AS unique_id, trim(lower(nom_complet)) AS name, strftime(strptime(dt_naissance, '%d/%m/%Y'), '%Y-%m-%d') AS date, CASE WHEN pid % 7 <> 0 THEN src END AS origin FROM src_a),
per_b AS (SELECT Matricule_RH AS unique_id, trim(lower(coalesce(Prenom, '') || ' ' || coalesce(Nom_Famille, ''))) AS name, date_nais AS date, CASE WHEN pid % 7 <> 0 THEN src END AS origin FROM src_b),
n AS (SELECT (SELECT count(*) FROM per_a) AS nl, (SELECT count(*) FROM per_b) AS nr),
drawn AS (SELECT {_THREE} FROM per_a a JOIN per_b b ON {_DRAWN.format(t='a')} = {_DRAWN.format(t='b')}),
u AS ({u_rows}),
pairs AS (SELECT a.unique_id AS id_l, b.unique_id AS id_r, {_THREE}, a.date = b.date AS hit_0, a.name = b.name AS hit_1 FROM per_a a JOIN per_b b ON a.date = b.date OR a.name = b.name),
on_date AS (SELECT *, {look('name', 'gn')} * {look('origin', 'go')} AS uu FROM (SELECT gn, go, count(*) AS pairs FROM pairs WHERE hit_0 GROUP BY gn, go)),
on_name AS (SELECT *, {look('date', 'gd')} * {look('origin', 'go')} AS uu FROM (SELECT gd, go, count(*) AS pairs FROM pairs WHERE hit_1 GROUP BY gd, go)),
{_em_sql('by_date', 'on_date', {'n': 4, 'o': 2}, odds('date', 1)).strip()},
{_em_sql('by_name', 'on_name', {'d': 2, 'o': 2}, odds('name', 3)).strip()},
m AS ({m_rows}),
bits AS (SELECT c, k, log2(m / u) AS w FROM m JOIN u USING (c, k)),
weighed AS (
  SELECT id_l, id_r, gn, gd, go, log2(1e-4 / (1 - 1e-4)) + x.w + y.w + coalesce(z.w, 0) AS w
  FROM pairs JOIN bits x ON x.c = 'name' AND x.k = gn JOIN bits y ON y.c = 'date' AND y.k = gd LEFT JOIN bits z ON z.c = 'origin' AND z.k = go
)
{select}"""


ORACLE |= {
    "pattern_counts_two_rules": two_rules_sql("SELECT gn AS gamma_name, gd AS gamma_date, go AS gamma_origin, hit_0, hit_1, count(*) AS pairs FROM pairs GROUP BY ALL"),
    "m_probabilities_two_rules": two_rules_sql("SELECT c AS comparison, k::INTEGER AS level, round(m, 6) AS m, round(u, 9) AS u FROM m JOIN u USING (c, k)"),
    "training_two_rules": two_rules_sql("SELECT 0 AS rule, it AS iterations, round(lam, 6) AS share FROM by_date_end UNION ALL SELECT 1, it, round(lam, 6) FROM by_name_end"),
    "scored_pairs_two_rules": two_rules_sql(
        """SELECT id_l, id_r, gn AS gamma_name, gd AS gamma_date, go AS gamma_origin, round(w, 6) AS match_weight, round(1 / (1 + pow(2, -w)), 6) AS match_probability
        FROM weighed WHERE 1 / (1 + pow(2, -w)) >= 0.85"""
    ),
}
