"""Link graphs: level-synchronous traversal with a cap."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_URLS = 1000


def crawl_levels(start: DataFrame, links: DataFrame, max_depth: int, most: int = MOST_URLS) -> DataFrame:
    """(url, depth) reached from start(url) over links(src, dst) in at most max_depth steps, the first `most` by depth and URL.

    One equi-join and one anti-join a level. The visited set is at most the cap, so it is broadcast; each level's lineage is cut
    with a checkpoint where a folder for it is set. A max_depth under 1 gives the start alone.
    """
    cut = (lambda df: df.checkpoint()) if start.sparkSession.sparkContext.getCheckpointDir() else (lambda df: df)
    level = start.select("url", F.lit(0).alias("depth")).distinct()
    seen = cut(level.orderBy("url").limit(most))
    level = seen
    for depth in range(1, max(0, max_depth) + 1):
        reached = links.join(F.broadcast(level.select(F.col("url").alias("src"))), "src").select(F.col("dst").alias("url")).distinct()
        level = cut(reached.join(F.broadcast(seen), "url", "left_anti").orderBy("url").limit(most).select("url", F.lit(depth).alias("depth")))
        if level.isEmpty():
            break
        seen = cut(seen.unionByName(level).orderBy("depth", "url").limit(most))
    return seen
