"""Connected components of an edge table, without bringing it to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyra.llm.common import drop_written, written


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) for each node of ``edges`` (columns ``a``, ``b``: long); component is the smallest node reachable.

    Alternating large-star and small-star steps: each round at least halves
    the height of the trees, so that rounds grow with the logarithm of the
    longest chain. A hub's edges are only aggregated (min), never gathered.
    Self-loops and repeated edges are allowed; nulls are ignored; an empty
    table gives an empty result. Rounds end when a table of distinct edges has the
    count and two 64-bit hash sums of the one before.
    """
    pairs = written(
        edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(),
        "edges",
    )
    mark = lambda x: x.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first()
    before = mark(pairs)
    for _ in range(most_rounds):
        # large star: every larger neighbour of a node is linked to the smallest of its neighbours and itself
        both = pairs.select("u", "v").union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # written, so that both sides of the join are plain shuffles and a hub's edges can be split among tasks
        nearest = written(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "nearest")
        large = both.where("v > u").join(nearest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = written(large, "large")
        # small star: a node's smaller neighbours and itself are linked to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(least.select("u", F.col("m").alias("v"))).distinct()
        small = written(small, "small")
        now = mark(small)
        changed, before = now != before, now
        drop_written(nearest, large, pairs)
        pairs = small
        if not changed:
            break
    else:
        raise RuntimeError(f"components didn't settle in {most_rounds} rounds")
    roots = pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
