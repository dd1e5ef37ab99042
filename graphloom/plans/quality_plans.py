"""Named queries: quality, profiles, samples, ids and revenue over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.operators.profile import (
    approximate_distinct,
    categorical_profile,
    column_samples,
    histogram,
    numeric_profile,
    top_values,
)
from graphloom.operators.quality import duplicate_count, high_null_columns, null_rates, quality_report, schema_difference
from graphloom.operators.table_profile import merge_sketches, table_profile, table_sketches
from graphloom.operators.views import customer_revenue, seeded_sample, shuffled_ids
from graphloom.plans.people import SQL_SOURCES, sources, table

_ROUND = ["mean", "std", "variance", "sum", "skewness", "kurtosis", "range"]
LINE_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
PART_NUMBERS = ["p_size", "p_retailprice"]
EVENT_TEXTS = ["event_type", "props", "user_id"]


def events_with_nulls(spark, d):
    """Events without every fifth user, three in ten values and half of the properties."""
    e = table(spark, d, "events")
    i = F.col("event_id")
    return e.select(
        "event_id", "event_type", F.when(i % 5 != 0, F.col("user_id")).alias("user_id"),
        F.when(i % 10 >= 3, F.col("value")).alias("value"), F.when(i % 2 == 0, F.col("props")).alias("props"),
    )


SQL_EVENTS = """e AS (SELECT event_id, event_type, CASE WHEN event_id % 5 <> 0 THEN user_id END AS user_id,
  CASE WHEN event_id % 10 >= 3 THEN value END AS value, CASE WHEN event_id % 2 = 0 THEN props END AS props FROM events)"""


def _rounded(df, columns=_ROUND, digits=4):
    return df.withColumns({c: F.round(c, digits) for c in columns})


def _transactions(spark, d):
    """A row an order, summed before anything is joined: lines are combined in each task and meet their order alone."""
    line, order, customer, nation = (table(spark, d, t) for t in ("lineitem", "orders", "customer", "nation"))
    # returned lines count against the customer; cents as whole numbers keep the sum exact
    quantity = F.when(F.col("l_returnflag") == "R", -F.col("l_quantity").cast("long")).otherwise(F.col("l_quantity").cast("long"))
    cents = F.sum(quantity * F.round(F.col("l_extendedprice") * 100).cast("long"))
    sums = line.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(cents.alias("price"))
    return (
        sums.join(order.select("o_orderkey", F.col("o_custkey").alias("c_custkey")), "o_orderkey")
        .join(customer.select("c_custkey", F.col("c_nationkey").alias("n_nationkey")), "c_custkey", "left")
        .join(nation.select("n_nationkey", "n_name"), "n_nationkey", "left")
        .select(
            F.when(F.col("o_orderkey") % 7 != 0, F.col("c_custkey").cast("double")).alias("customer_id"),
            F.lit(1).alias("quantity"), "price", F.col("n_name").alias("country"),
        )
    )


def _revenue(spark, d):
    return customer_revenue(_transactions(spark, d)).withColumn("revenue", F.col("revenue").cast("bigint"))


def _words(spark, d):
    t = table(spark, d, "documents")
    return t.select("lang", "source", "text")


def _numeric_sql(t: str, columns: list[str]) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count({c}) AS count, count(*) - count({c}) AS missing, min({c})::DOUBLE AS min, max({c})::DOUBLE AS max,
        round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, round(var_samp({c}), 4) AS variance, round(sum({c}::DOUBLE), 4) AS sum,
        count(*) FILTER ({c} = 0) AS zeros, count(*) FILTER ({c} < 0) AS negatives, round(skewness({c}), 4) AS skewness,
        round(kurtosis({c}), 4) AS kurtosis, round((max({c}) - min({c}))::DOUBLE, 4) AS range, quantile_disc({c}, 0.05)::DOUBLE AS p05, quantile_disc({c}, 0.25)::DOUBLE AS p25,
        quantile_disc({c}, 0.5)::DOUBLE AS median, quantile_disc({c}, 0.75)::DOUBLE AS p75, quantile_disc({c}, 0.95)::DOUBLE AS p95 FROM {t}"""
        for c in columns
    )


def _histogram_sql(t: str, columns: list[str], bins: int) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", bin, round(lo + bin * w, 6) AS low, round(lo + (bin + 1) * w, 6) AS high, count(*) AS n
        FROM (SELECT CAST(least(floor(({c} - lo) / w), {bins - 1}) AS INTEGER) AS bin, lo, w
              FROM {t}, (SELECT min({c})::DOUBLE AS lo, (max({c})::DOUBLE - min({c})::DOUBLE) / {bins} AS w FROM {t})) GROUP BY bin, lo, w"""
        for c in columns
    )


def _typed(spark, d):
    """Customers with a flag, a balance that is missing for some, and lists."""
    return table(spark, d, "customer").withColumns({
        "in_debt": F.when(F.col("c_custkey") % 11 != 0, F.col("c_acctbal") < 0), "c_acctbal": F.when(F.col("c_custkey") % 5 != 0, F.col("c_acctbal")),
    })


def _all_profiles(*tables):
    def run(spark, d):
        out = None
        for t in tables:
            one = table_profile(_typed(spark, d) if t == "typed" else table(spark, d, t)).select(F.lit(t).alias("table"), "*")
            out = one if out is None else out.unionByName(one)
        return out.withColumn("mean", F.round("mean", 4))
    return run


def _profile_sql(t: str, columns: dict[str, str]) -> str:
    """One row a column; ``columns`` has their types."""
    null = "NULL"
    rows = []
    for i, (c, kind) in enumerate(columns.items()):
        text, number, ordered = kind == "text", kind == "numeric", kind in ("numeric", "date", "text")
        rows.append(
            f"""SELECT '{t}' AS "table", {i} AS ord, '{c}' AS "column", '{kind}' AS type, count(*) AS rows, count(*) - count({c}) AS missing,
            count(DISTINCT {c}) AS "distinct", (SELECT count(*) FROM (SELECT {c} FROM {t} WHERE {c} IS NOT NULL GROUP BY {c} HAVING count(*) = 1)) AS "unique",
            {f'min({c})' if ordered else null}::VARCHAR AS min, {f'max({c})' if ordered else null}::VARCHAR AS max,
            {f'round(avg({c}), 4)' if number else null}::DOUBLE AS mean, {f'count(*) FILTER ({c} = 0)' if number else null}::BIGINT AS zeros,
            {f'count(*) FILTER ({c})' if kind == 'boolean' else null}::BIGINT AS trues, {f"count(*) FILTER ({c} = '')" if text else null}::BIGINT AS blank,
            {f'min(length({c}))' if text else null}::BIGINT AS min_length, {f'max(length({c}))' if text else null}::BIGINT AS max_length FROM {t}"""
        )
    return " UNION ALL ".join(rows)


def _sketch_bounds(spark, d):
    """Line items profiled by return flag and merged: sums are exact, distinct values within five percent."""
    line = table(spark, d, "lineitem")
    merged = merge_sketches(table_sketches(line, ["l_returnflag"])).select("column", "rows", "missing", "min_length", "max_length", F.col("distinct").alias("estimate"))
    exact = table_profile(line.drop("l_returnflag")).select("column", "distinct")
    close = F.abs(F.col("estimate") - F.col("distinct")) <= 0.05 * F.col("distinct")
    return merged.join(exact, "column").select("column", "rows", "missing", "min_length", "max_length", "distinct", close.alias("close"))


PROFILED = {
    "lineitem": {
        "l_orderkey": "numeric", "l_partkey": "numeric", "l_suppkey": "numeric", "l_linenumber": "numeric", "l_quantity": "numeric", "l_extendedprice": "numeric",
        "l_discount": "numeric", "l_tax": "numeric", "l_returnflag": "text", "l_linestatus": "text", "l_shipdate": "date",
    },
    "events": {"event_id": "numeric", "ts": "date", "user_id": "numeric", "event_type": "text", "value": "numeric", "props": "text"},
    "documents": {"doc_id": "numeric", "text": "text", "lang": "text", "source": "text", "n_chars": "numeric"},
    "typed": {"c_custkey": "numeric", "c_name": "text", "c_nationkey": "numeric", "c_acctbal": "numeric", "c_mktsegment": "text", "in_debt": "boolean"},
}
SQL_TYPED = """typed AS (SELECT * REPLACE (CASE WHEN c_custkey % 5 <> 0 THEN c_acctbal END AS c_acctbal),
  CASE WHEN c_custkey % 11 <> 0 THEN c_acctbal < 0 END AS in_debt FROM customer)"""

COLUMNS_A = ["src", "pid", "ID_Client", "nom_complet", "email", "dt_naissance", "ville", "ca_annuel", "segment"]
COLUMNS_B = ["src", "pid", "Matricule_RH", "Nom_Famille", "Prenom", "date_nais", "departement", "contrat", "salaire_mensuel", "date_embauche"]


def _filled(columns: list[str]) -> str:
    return ", ".join(f"count({c}) AS {c}" for c in columns)


QUERIES = {
    "quality_report": lambda s, d: quality_report(events_with_nulls(s, d), "events"),
    "null_rates": lambda s, d: null_rates(events_with_nulls(s, d)),
    "high_null_columns": lambda s, d: high_null_columns(events_with_nulls(s, d)),
    "duplicate_rows": lambda s, d: duplicate_count(_words(s, d)),
    "profile_numeric": lambda s, d: _rounded(numeric_profile(table(s, d, "lineitem"), LINE_NUMBERS)),
    "profile_quantile_sketch": lambda s, d: numeric_profile(table(s, d, "lineitem"), LINE_NUMBERS, exact=False).select("column", "median"),
    "profile_numeric_part": lambda s, d: _rounded(numeric_profile(table(s, d, "part"), PART_NUMBERS)),
    "profile_categorical": lambda s, d: _rounded(categorical_profile(events_with_nulls(s, d), EVENT_TEXTS), ["mean_length"], 6),
    "profile_top_values": lambda s, d: top_values(events_with_nulls(s, d), EVENT_TEXTS, 5),
    "profile_histogram": lambda s, d: _rounded(histogram(table(s, d, "lineitem"), LINE_NUMBERS, 10), ["low", "high"], 6),
    "profile_approximate_distinct": lambda s, d: approximate_distinct(table(s, d, "lineitem"), ["l_orderkey", "l_partkey", "l_suppkey"]),
    "profile_table": _all_profiles("lineitem", "events", "documents", "typed"),
    "profile_merged_sketches": _sketch_bounds,
    "schema_difference": lambda s, d: schema_difference(*sources(s, d)),
    "column_samples": lambda s, d: column_samples(table(s, d, "customer"), ["c_name", "c_mktsegment", "c_nationkey"], ["c_custkey"]),
    "seeded_sample": lambda s, d: seeded_sample(table(s, d, "customer").select("c_custkey", "c_name", "c_mktsegment"), 100, ["c_custkey"]),
    "shuffled_ids": lambda s, d: shuffled_ids(table(s, d, "customer").select("c_custkey", "c_name"), ["c_custkey"]),
    "customer_revenue": _revenue,
}

ORACLE = {
    "quality_report": f"""WITH {SQL_EVENTS} SELECT 'events' AS source, count(*) AS rows, 5 AS columns,
      round(100.0 * (5 * count(*) - count(event_id) - count(event_type) - count(user_id) - count(value) - count(props)) / (5 * count(*)), 2) AS null_pct,
      count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM e)) AS duplicate_rows,
      'event_id,event_type,user_id,value,props' AS column_names FROM e""",
    "null_rates": f"WITH {SQL_EVENTS} " + " UNION ALL ".join(
        f"""SELECT {i} AS ord, '{c}' AS "column", count(*) - count({c}) AS nulls, (count(*) - count({c}))::DOUBLE / count(*) AS null_rate FROM e"""
        for i, c in enumerate(["event_id", "event_type", "user_id", "value", "props"])
    ),
    "high_null_columns": f"WITH {SQL_EVENTS} SELECT * FROM (" + " UNION ALL ".join(
        f"""SELECT {i} AS ord, '{c}' AS "column", count(*) - count({c}) AS nulls, (count(*) - count({c}))::DOUBLE / count(*) AS null_rate FROM e"""
        for i, c in enumerate(["event_id", "event_type", "user_id", "value", "props"])
    ) + ") WHERE null_rate > 0.20",
    "duplicate_rows": "SELECT count(*) - (SELECT count(*) FROM (SELECT DISTINCT lang, source, text FROM documents)) AS duplicate_rows FROM documents",
    "profile_numeric": _numeric_sql("lineitem", LINE_NUMBERS),
    "profile_numeric_part": _numeric_sql("part", PART_NUMBERS),
    "profile_categorical": f"WITH {SQL_EVENTS}, v AS (" + " UNION ALL ".join(f"""SELECT '{c}' AS "column", {c}::VARCHAR AS value FROM e""" for c in EVENT_TEXTS)
    + """), c AS (SELECT "column", value, count(*) AS n FROM v GROUP BY 1, 2)
      SELECT "column", sum(n) FILTER (value IS NOT NULL)::BIGINT AS count, coalesce(sum(n) FILTER (value IS NULL), 0)::BIGINT AS missing, count(value) AS "distinct",
      count(*) FILTER (value IS NOT NULL AND n = 1) AS "unique", min(length(value)) AS min_length, max(length(value)) AS max_length,
      round((sum(length(value) * n) / sum(n) FILTER (value IS NOT NULL))::DOUBLE, 6) AS mean_length FROM c GROUP BY 1""",
    "profile_top_values": f"WITH {SQL_EVENTS}, v AS (" + " UNION ALL ".join(f"""SELECT '{c}' AS "column", {c}::VARCHAR AS value FROM e""" for c in EVENT_TEXTS)
    + """) SELECT * FROM (SELECT "column", row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value) AS rank, value, n
      FROM (SELECT "column", value, count(*) AS n FROM v WHERE value IS NOT NULL GROUP BY 1, 2)) WHERE rank <= 5""",
    "profile_histogram": _histogram_sql("lineitem", LINE_NUMBERS, 10),
    "profile_table": f"WITH {SQL_TYPED} " + " UNION ALL ".join(_profile_sql(t, columns) for t, columns in PROFILED.items()),
    "profile_merged_sketches": " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count(*) AS rows, count(*) - count({c}) AS missing, {f'min(length({c}))' if kind == 'text' else 'NULL'}::BIGINT AS min_length,
        {f'max(length({c}))' if kind == 'text' else 'NULL'}::BIGINT AS max_length, count(DISTINCT {c}) AS "distinct", true AS close FROM lineitem"""
        for c, kind in PROFILED["lineitem"].items() if c != "l_returnflag"
    ),
    "schema_difference": f"""WITH {SQL_SOURCES.strip()},
      la AS (UNPIVOT (SELECT {_filled(COLUMNS_A)} FROM src_a) ON * INTO NAME name VALUE n),
      lb AS (UNPIVOT (SELECT {_filled(COLUMNS_B)} FROM src_b) ON * INTO NAME name VALUE n)
      SELECT coalesce(la.name, lb.name) AS "column", la.name IS NOT NULL AS in_left, lb.name IS NOT NULL AS in_right,
      coalesce(la.n, 0) AS values_left, coalesce(lb.n, 0) AS values_right FROM la FULL JOIN lb ON la.name = lb.name""",
    "column_samples": "SELECT * FROM (" + " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", row_number() OVER (ORDER BY md5('42|{c}|' || {c}::VARCHAR || '|' || c_custkey)) AS rank, {c}::VARCHAR AS value FROM customer"""
        for c in ["c_name", "c_mktsegment", "c_nationkey"]
    ) + ") WHERE rank <= 3",
    "seeded_sample": "SELECT c_custkey, c_name, c_mktsegment FROM customer ORDER BY md5('42|' || c_custkey) LIMIT 100",
    "shuffled_ids": "SELECT c_custkey, c_name, row_number() OVER (ORDER BY md5('42|' || c_custkey)) AS seq FROM customer",
    "customer_revenue": """SELECT customer_id, revenue, country FROM (
      SELECT c_custkey AS customer_id, sum(CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END * l_quantity::BIGINT * round(l_extendedprice * 100)::BIGINT)::BIGINT AS revenue,
             min(n_name) AS country
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey
      WHERE o_orderkey % 7 <> 0 AND c_custkey IS NOT NULL GROUP BY c_custkey) WHERE revenue > 0""",
}
