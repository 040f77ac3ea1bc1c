"""Times the headline queries: ``python bench.py`` prints one JSON line.

Every query is forced in full by a write that keeps nothing.  It runs once to
load and compile and then ``BENCH_RUNS`` times (default 1), of which the best
counts.  ``hops_per_sec`` is the rate of the long walks drawn by running sums, as
in earlier rounds; ``rates`` has those of all walks: by alias tables, and biased
on a graph with triangles.  ``transition2`` is the operator, every row of it.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import DataFrame, SparkSession

from meander.operators import transition as T, walk as W
from meander.scratch import Scratch
from meander.workloads import graphs as G
from meander.workloads.queries import QUERIES, SEED

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = int(os.environ.get("BENCH_CPUS", "8"))
RUNS = int(os.environ.get("BENCH_RUNS", "1"))

HEADLINE = ["pad_edges", "node2id", "index_edges", "adjacency", "triplets", "transition1",
            "random_walk", "random_walk_tri", "hop_tag"]
LONG_STEPS, LONG_WALKS = 16, 10
# name: graph, p, q, method
WALKS = {"long_walk": ("customer_part", 1.0, 1.0, "sums"), "long_walk_alias": ("customer_part", 1.0, 1.0, "alias"),
         "biased_walk": ("tripartite", 0.25, 4.0, "sums"), "biased_walk_alias": ("tripartite", 0.25, 4.0, "alias")}


def force(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def long_walk(spark: SparkSession, adj: DataFrame, p: float, q: float, method: str) -> None:
    with Scratch(spark) as scratch:
        force(W.random_walk(adj, LONG_STEPS, LONG_WALKS, p, q, SEED, scratch=scratch, method=method))


def transitions(spark: SparkSession, adj: DataFrame) -> None:
    with Scratch(spark) as scratch:
        force(T.transition2(adj, 0.25, 4.0, scratch))


def timed(run) -> float:
    run()
    times = []
    for _ in range(RUNS):
        start = time.perf_counter()
        run()
        times.append(time.perf_counter() - start)
    return min(times)


def main() -> None:
    spark = (SparkSession.builder.master(f"local[{CPUS}]").appName("bench")
             .config("spark.sql.shuffle.partitions", str(CPUS))
             .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "16g"))
             .config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false")
             .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {name: round(timed(lambda: force(QUERIES[name](spark, SF_DIR))), 3)
               for name in HEADLINE}
    scratch = Scratch(spark)
    adj = {g: scratch.cut(G.indexed(spark, SF_DIR, g, scratch).adjacency(50), "adj") for g in ("customer_part", "tripartite")}
    seconds["transition2"] = round(timed(lambda: transitions(spark, adj["tripartite"])), 3)
    rates = {}
    for name, (graph, p, q, method) in WALKS.items():
        seconds[name] = round(timed(lambda: long_walk(spark, adj[graph], p, q, method)), 3)
        rates[name] = round(adj[graph].count() * LONG_WALKS * (LONG_STEPS + 1) / seconds[name])
    scratch.close()
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
        "hops_per_sec": rates["long_walk"], "rates": rates}))


if __name__ == "__main__":
    main()
