"""Time the headline queries and print one JSON line.

Reading ``documents`` into the person pool is timed once, as ``person_pool``; the queries start from it.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import functions as F

from graphloom.plans.catalog import QUERIES
from graphloom.plans.graph_plans import graph
from graphloom.operators.linkage import link_triples
from graphloom.plans.people import pool, table
from graphloom.session import local_session, scratch_path
from graphloom.sources.ntriples import write_ntriples

HEADLINE = [
    "quality_report", "duplicate_rows", "profile_numeric", "profile_categorical", "profile_table", "customer_revenue", "block_sizes",
    "blocking_pairs", "u_probabilities_exact", "scored_pairs", "sameas_links", "graph_union", "butterfly", "shape_violations", "stored_pattern",
    "match_hybrid", "variant_comparison", "embedding_top1", "json_answer_parse",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores)
    spark.sparkContext.setLogLevel("ERROR")
    for name in ("scored_pairs", "graph_union"):  # start the JVM and the Python workers
        QUERIES[name](spark, sf_dir).collect()
    spark.catalog.clearCache()
    times: dict[str, float] = {}
    start = time.perf_counter()
    pool(spark, sf_dir).count()
    times["person_pool"] = round(time.perf_counter() - start, 3)
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        spark.catalog.clearCache()
        pool(spark, sf_dir).count()
    start = time.perf_counter()
    triples = write_ntriples(graph(spark, sf_dir), scratch_path(spark, "bench"))
    times["ntriples_write"] = round(time.perf_counter() - start, 3)
    spark.catalog.clearCache()
    start = time.perf_counter()
    write_ntriples(graph(spark, sf_dir), scratch_path(spark, "bench"))
    times["ntriples_from_source"] = round(time.perf_counter() - start, 3)
    # as many links as the published figure is about, from order lines, each several times under another id
    lines = table(spark, sf_dir, "lineitem")
    times_each = max(round(5_000_000 / max(lines.count(), 1)), 1)
    copies = lines.select("l_orderkey", "l_partkey", F.explode(F.sequence(F.lit(1), F.lit(times_each))).alias("k"))
    name = lambda c: F.concat_ws("-", c, "k").alias
    links = copies.repartition(int(cores) * 4).select(name("l_orderkey")("id_l"), name("l_partkey")("id_r"))
    start = time.perf_counter()
    written = write_ntriples(link_triples(links), scratch_path(spark, "links"))
    times["links_write"] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "triples_per_second": round(triples / times["ntriples_write"]),
                "triples_per_second_from_source": round(triples / times["ntriples_from_source"]),
                "links_written": written, "links_per_second": round(written / times["links_write"]),
            }
        )
    )


if __name__ == "__main__":
    main()
