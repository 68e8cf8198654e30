"""Connected components as joins, for the operators that link rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from mapwise.llm.storage import stored


def _smallest(edges: DataFrame) -> DataFrame:
    """(u, v, low): each edge with the least of ``u`` and its neighbours; a hub's edges are pre-aggregated."""
    lows = edges.groupBy("u").agg(F.min("v").alias("least")).select(F.col("u").alias("of"), "least")
    return edges.join(lows, F.col("u") == F.col("of")).select("u", "v", F.least("u", "least").alias("low"))


def components(edges: DataFrame, purpose: str = "components") -> DataFrame:
    """(node, component): the least node reachable over undirected ``edges`` (u, v), for each node with an edge.

    Alternates two rewirings until nothing changes: every larger neighbour of a node is linked to the least
    neighbour, then every smaller one. Both keep the components, a round costs two joins on a node, and the
    number of rounds grows with the logarithm of the longest chain. Each round is written to the shared folder, so
    lineage stays short; no node's neighbours are gathered. Nodes may be of any ordered type and are not null;
    loops and repeated edges are allowed.
    """
    now = stored(
        edges.filter(F.col("u") != F.col("v"))
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), purpose)
    mark = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _smallest(both).filter("v > u").select(F.col("v").alias("u"), F.col("low").alias("v")).distinct()
        rows = _smallest(large.filter("u > v"))
        small = rows.select(F.col("v").alias("u"), F.col("low").alias("v")).unionByName(
            rows.select("u", F.col("low").alias("v"))).filter("u != v").distinct()
        now = stored(small, purpose)
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == mark:
            break
        mark = seen
    tops = now.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(tops)
