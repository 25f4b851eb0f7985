"""Times the headline queries and prints one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the cores.  Besides queries
over the tables, two recursive programs of the published baseline are run on
graphs of its kind: the closure of a random graph of 1,000 nodes with about 10
edges each (``tc_g1k``), and same generation on a random tree of depth 7 with 1
to 4 children (``sg_tree7``).  Both are made from hashes, alike in every run.
"""

from __future__ import annotations

import json
import os
import random
import time

from pyspark.sql import SparkSession

from ruleloom import queries as rule_queries
from ruleloom.operators import same_generation, transitive_closure

HEADLINE = (
    "q1_group_agg", "filter_project", "inner_join_chain", "value_join", "anti_join", "semi_join", "left_outer_combine", "full_outer_merge",
    "multi_body_agg", "count_distinct", "set_agg", "argmax_k", "cumulative_sum", "window_max", "order_limit", "unnest_split", "list_combine",
    "nested_combine", "as_of", "closure", "distance", "same_generation", "customer_distribution",
)


def random_graph(spark, nodes: int, edges_each: int = 10):
    return spark.range(nodes * edges_each).selectExpr(f"pmod(xxhash64(id, 1), {nodes}) as x", f"pmod(xxhash64(id, 2), {nodes}) as y").distinct()


def random_tree(spark, depth: int):
    r, rows, layer, n = random.Random(depth), [], [0], 1
    for _ in range(depth):
        below = []
        for parent in layer:
            for _ in range(r.randint(1, 4)):
                rows.append((n, parent))
                below.append(n)
                n += 1
        layer = below
    return spark.createDataFrame(rows, "x long, p long")


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    jobs = {n: (lambda n=n: rule_queries.run(spark, sf_dir, n)) for n in HEADLINE}
    jobs |= {"tc_g1k": lambda: transitive_closure(random_graph(spark, 1000)), "sg_tree7": lambda: same_generation(random_tree(spark, 7))}
    rule_queries.run(spark, sf_dir, "q1_group_agg").write.format("noop").mode("overwrite").save()  # starts the engine
    took = {}
    for name, job in jobs.items():
        began = time.time()
        job().write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "total wall time of the headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf_dir.rpartition("sf")[2]}))
    spark.stop()


if __name__ == "__main__":
    main()
