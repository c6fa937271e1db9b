"""Connected components by alternating large and small stars, with reliable checkpoints between the rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import durable, release


def _sum(edges: DataFrame) -> tuple[int, int]:
    """Number of edges and a hash of them all, to see whether a round changed anything."""
    r = edges.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))).first()
    return r[0], r[1]


def components(edges: DataFrame, rows: int | None = None) -> DataFrame:
    """(u, root) of every node of edges(u, v) that is not its component's smallest node, which is root.

    Edges may repeat and go either way; loops and nulls are left out. rows: about how many edges there are, if known. Stars
    only: the work of a round is linear in the edges, a node's neighbours are reduced to their minimum before the exchange,
    and joins on a hot node can be split.
    """
    now = durable(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u > v").distinct(), rows)
    seen = _sum(now)
    while seen[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        old, now = now, durable(small.filter("u > v").distinct(), seen[0])
        release(old)
        last, seen = seen, _sum(now)
        if seen == last:
            break
    return now.select("u", F.col("v").alias("root"))
