"""Connected components of an edge table, by alternating large and small stars on shared tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlake.llm.shared import hot_keys, salted_join, saved

#: Rounds grow with the logarithm of the number of nodes.
MOST_ROUNDS = 60


def _joined(edges: DataFrame, total: int) -> tuple[DataFrame, DataFrame]:
    """edges (u, v) with m, the smallest v of their u; and (u, m). A hub's edges are dealt to many tasks."""
    least = saved(edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "least")
    hot = hot_keys(least, ["u"], total)
    return salted_join(edges, least.select(F.col("u").alias("node"), "m"), {"u": "node"}, hot, ["v"]), least


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (u, v) of longs: component is its smallest node.

    Smallest nodes' own rows are included. Edges with a null end are ignored; so are loops, but their
    node is kept. Each round's table is written to the shared folder, so lineage stays short; minima are
    pre-aggregated, and a hub's edges are salted where they are joined to its minimum.
    """
    ends = edges.where(F.col("u").isNotNull() & F.col("v").isNotNull())
    now = saved(ends.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    loops = now.where("u = v").select("u")
    now = now.where("u > v")
    before = None
    for _ in range(MOST_ROUNDS):
        seen = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if seen == before:
            break
        before = seen
        both, _ = _joined(now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v"))), 2 * seen["n"])
        large = saved(both.where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct(), "large-star")
        own, least = _joined(large, seen["n"])
        small = own.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        now = saved(small, "small-star")
    else:
        raise RuntimeError(f"no fixed point after {MOST_ROUNDS} rounds")
    roots = now.select("v").unionByName(loops.select(F.col("u").alias("v"))).distinct()
    alone = roots.join(now.select(F.col("u").alias("v")), "v", "left_anti")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(alone.select(F.col("v").alias("node"), F.col("v").alias("component")))
