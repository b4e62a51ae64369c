"""Connected components by randomised contraction, as DataFrame jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.session import cut


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """Smallest member of each node's component: (node, component), for nodes that occur in edges.

    Each round every node takes the neighbour (or itself) with the least seeded hash as its new name and
    edges are renamed; a constant share of the nodes vanishes per round whatever the shape, so chains and
    stars both take about log(n) rounds. Names come from min() aggregates and joins only, so a node with
    very many neighbours is pre-aggregated map-side and never gathered. Null ends and self links are ignored.
    """
    pairs = edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a is not null and b is not null")
    names = None
    cur = cut(pairs.where("a <> b").distinct(), "edges")
    for seed in range(max_rounds):
        if cur.isEmpty():
            break
        both = cur.unionByName(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = both.groupBy("a").agg(F.min(F.struct(F.xxhash64("b", F.lit(seed)).alias("h"), F.col("b").alias("v"))).alias("m"))
        own = F.struct(F.xxhash64("a", F.lit(seed)).alias("h"), F.col("a").alias("v"))
        hop = cut(near.select(F.col("a").alias("from"), F.least(own, F.col("m"))["v"].alias("to")), "hop")
        left = cur.join(hop, cur.a == hop["from"]).select(F.col("to").alias("a"), "b")
        cur = cut(left.join(hop, left.b == hop["from"]).select("a", F.col("to").alias("b")).where("a <> b").distinct(), "edges")
        if names is None:
            names = hop.select(F.col("from").alias("node"), F.col("to").alias("name"))
        else:
            names = cut(names.join(hop, names.name == hop["from"], "left").select("node", F.coalesce("to", "name").alias("name")), "names")
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    if names is None:
        return cur.select(F.col("a").alias("node"), F.col("b").alias("component"))  # no links, no rows
    least = names.groupBy("name").agg(F.min("node").alias("component"))
    return names.join(least, "name").select("node", "component")
