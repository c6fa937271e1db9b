"""Robots rules: parsing as a window over lines, matching as a prefix join."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagemill.functions.urls import path

#: Rules of a host that a URL is compared with by broadcast; more go through an equi-join on the host alone.
MOST_BROADCAST = 100_000


def parse_robots(bodies: DataFrame) -> DataFrame:
    """(host, kind, rule, ord) of bodies(host, body), kind being allow, disallow or crawl-delay.

    Lines are lower-cased; rules count while the last agent line above them names every agent; empty rules do not count.
    """
    lines = bodies.select("host", F.posexplode(F.split(F.lower("body"), r"\r\n|[\r\n]")).alias("ord", "line")).withColumn("line", F.trim(F.regexp_replace("line", r"^\s+|\s+$", "")))
    field = F.regexp_extract("line", r"^(user-agent|disallow|allow|crawl-delay):", 1)
    value = F.regexp_replace(F.regexp_extract("line", r"^[a-z-]+:(.*)$", 1), r"^\s+|\s+$", "")
    above = Window.partitionBy("host").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    marked = lines.select("host", "ord", field.alias("kind"), value.alias("rule"))
    marked = marked.withColumn("agent", F.last(F.when(F.col("kind") == "user-agent", F.col("rule")), ignorenulls=True).over(above))
    return marked.filter((F.col("agent") == "*") & F.col("kind").isin("allow", "disallow", "crawl-delay") & (F.col("rule") != "")).select("host", "kind", "rule", "ord")


def crawl_delays(rules: DataFrame) -> DataFrame:
    """(host, crawl_delay): the last delay of a host that is a number."""
    delays = rules.filter(F.col("kind") == "crawl-delay").select("host", "ord", F.col("rule").try_cast("double").alias("delay")).filter("delay is not null")
    return delays.groupBy("host").agg(F.max_by("delay", "ord").alias("crawl_delay"))


def robots_allowed(urls: DataFrame, rules: DataFrame, url_col: str = "url", host_col: str = "host") -> DataFrame:
    """urls' columns and `allowed`: the longest rule that the path begins with decides, allowing on a tie or without one.

    A left join on the host with the prefix as a residual, then the longest of each kind; urls need a column __row or get one.
    """
    keyed = urls.withColumn("__row", F.monotonically_increasing_id()) if "__row" not in urls.columns else urls
    own = rules.filter(F.col("kind").isin("allow", "disallow")).select(F.col("host").alias("__host"), "kind", "rule").distinct()
    own = F.broadcast(own) if own.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST else own
    hit = keyed.join(own, (F.col(host_col) == F.col("__host")) & F.startswith(path(F.col(url_col)), F.col("rule")), "left")
    longest = lambda kind: F.max(F.when(F.col("kind") == kind, F.length("rule")))
    groups = [c for c in keyed.columns]
    decided = hit.groupBy(*groups).agg((F.coalesce(longest("allow"), F.lit(-1)) >= F.coalesce(longest("disallow"), F.lit(-1))).alias("allowed"))
    return decided.drop("__row") if "__row" not in urls.columns else decided


def robots_filter(urls: DataFrame, rules: DataFrame, url_col: str = "url", host_col: str = "host") -> DataFrame:
    """the urls that are allowed."""
    return robots_allowed(urls, rules, url_col, host_col).filter("allowed").drop("allowed")
