"""Connected components of a link table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import discard, materialize


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """node, component (its smallest node) for each node of links (u, v); nodes are longs.

    Every round is a few joins and sums over the links, written to the shared folder; nothing is collected but the
    row count and checksum that show that a round changed nothing. The smallest neighbours are written before they are
    joined, so that Spark can broadcast a small result or split a hub's rows. Self-links and repeats are ignored.
    """
    edges = materialize(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "links")
    before = None
    for _ in range(rounds):
        both = edges.union(edges.select("v", "u"))
        low = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "low")
        large = materialize(both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        low2 = materialize(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        small = large.join(low2, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low2.select("u", F.col("m").alias("v")))
        new = materialize(small.distinct(), "links")
        now = new.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_003), F.sum(F.xxhash64("v", "u") % 999_983)).first()
        discard(edges, low, large, low2)
        edges = new
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"no fixed point after {rounds} rounds")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
