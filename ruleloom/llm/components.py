"""Distributed connected components by alternating star contractions.

Works on any orderable node type with DataFrame operations only.  Each round
attaches larger neighbours, then smaller ones, to the least node that a node
sees, until every component is a star around its least node; the number of
rounds is logarithmic in the graph's diameter in practice.  Every round is a
written table, so lineage stays short and lost executors cost one round.  The
links of a node with very many are dealt into parts for the join with what it
sees; no neighbour list is ever gathered in one place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ruleloom.llm.common import discard, materialize, salted_join


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
    joined = salted_join(both.where("v > u"), least, "u", "w")
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), "m")
    moved = salted_join(edges, least, "u", "w").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select(F.col("w").alias("u"), F.col("m").alias("v"))).where("u <> v").distinct()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Return ``(node, component)`` for every node that has a link.

    ``component`` is the least node of the component.  Null ends, loops and
    repeated links are ignored; a table without links gives an empty result.
    """
    start = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull()).where("u <> v").distinct()
    now = materialize(start, "links")
    seen = _signature(now)
    while seen[0]:
        after = materialize(_small_star(_large_star(now)), "links")
        signature = _signature(after)
        discard(now)
        now = after
        if signature == seen:
            break
        seen = signature
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
