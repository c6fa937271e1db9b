"""Jobs over pages: caches, cascades, replies, counters, resuming and states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.functions.urls import path

CACHE_TTL, JOB_TTL = 86400, 3600
STATE_FIELDS = ("job_id", "request", "completed_urls", "failed_urls", "pending_urls")
TERMINAL = ("job_done", "job_cancelled", "job_error")


def cache_key(url: Column) -> Column:
    return F.substring(F.sha2(url, 256), 1, 16)


def cache_latest(entries: DataFrame) -> DataFrame:
    """Of entries(key, url, html, ts) the latest of each key, as an overwritten file leaves it."""
    row = F.struct(*entries.columns)
    return entries.groupBy("key").agg(F.max_by(row, F.struct("ts", "url")).alias("r")).select("r.*")


def cache_lookup(urls: DataFrame, entries: DataFrame, now: Column, ttl: int = CACHE_TTL) -> DataFrame:
    """Urls and the cached html, null where there is none, of another URL or older than ttl seconds (0: any age)."""
    own = entries.select("key", F.col("url").alias("__url"), F.col("html").alias("html"), "ts")
    fresh = F.lit(True) if ttl <= 0 else (F.unix_timestamp(now) - F.unix_timestamp("ts") <= ttl)
    keyed = urls.withColumn("key", cache_key(F.col("url")))
    hit = keyed.join(own, (keyed["key"] == own["key"]) & (F.col("url") == F.col("__url")) & fresh, "left")
    return hit.select(*urls.columns, "html", F.col("__url").isNotNull().alias("hit"))


def cache_put(entries: DataFrame, pages: DataFrame, blocked: Column) -> DataFrame:
    """K5: entries and those of pages(url, html, ts) that are not blocked."""
    return entries.unionByName(pages.filter(~blocked).select(cache_key(F.col("url")).alias("key"), "url", "html", "ts"))


def first_success(attempts: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Of attempts(key, order, value) the value of the lowest order that has one, and that order."""
    good = attempts.filter(F.col(value).isNotNull())
    return good.groupBy(key).agg(F.min_by(F.struct(order, value), order).alias("b")).select(key, f"b.{order}", f"b.{value}")


def all_of_first_success(attempts: DataFrame, key: str, order: str) -> DataFrame:
    """U2 for stages that give sets: all rows of the lowest order that a key has."""
    first = attempts.groupBy(key).agg(F.min(order).alias("__first"))
    return attempts.join(first, key).filter(F.col(order) == F.col("__first")).drop("__first")


def reply_urls(reply: Column) -> Column:
    """the URLs of a model's reply, a JSON array bare or in a fence; null if it is none."""
    bare = F.regexp_replace(reply, r"^\s+|\s+$", "")
    lines = F.split(bare, "\n")
    inside = F.array_join(F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 2, F.lit(0))), "\n")
    text = F.when(bare.startswith("```"), inside).otherwise(bare)
    return F.when(text.rlike(r"(?s)^\s*\["), F.from_json(text, "array<string>"))


def apply_reply(urls: DataFrame, replies: DataFrame, key: str) -> DataFrame:
    """For urls(key, url, ord) and replies(key, reply) the URLs in the reply's order that were asked about, else all.

    The result has pos, the place to order by.
    """
    parsed = replies.select(key, reply_urls(F.col("reply")).alias("list"))
    kept = parsed.filter("list is not null").select(key, F.posexplode("list").alias("pos", "url")).join(urls.select(key, "url").distinct(), [key, "url"], "left_semi")
    failed = urls.join(parsed.filter("list is not null").select(key).distinct(), key, "left_anti").select(key, F.col("ord").cast("int").alias("pos"), "url")
    return kept.select(key, "pos", "url").unionByName(failed)


def pending(urls: DataFrame, *done: DataFrame, key: str = "url") -> DataFrame:
    """Urls without those of any of the others; by another key, a URL that is listed under several stays until all are done."""
    for other in done:
        urls = urls.join(other.select(key), key, "left_anti")
    return urls


def index_markdown(urls: DataFrame, order: str) -> DataFrame:
    """K3: one row, the index of all pages in order; as one file it meets in one task."""
    bare = F.regexp_replace(path(F.col("url")), "^/+|/+$", "")
    name = F.element_at(F.split(bare, "/"), -1)
    line = F.concat(F.lit("- ["), F.when(name == "", "Home").otherwise(name), F.lit("]("), F.when(bare == "", "index").otherwise(bare), F.lit(".md)"))
    lines = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("l"))))
    return urls.agg(F.concat_ws("\n", F.lit("# Documentation Index\n"), F.transform(lines, lambda x: x["l"])).alias("markdown"))


def job_counters(pages: DataFrame) -> DataFrame:
    """One row of counters of pages(status, fetch_method, retried, cache_hit)."""
    is_ = lambda c, v: F.count_if(F.col(c) == v)
    return pages.agg(
        is_("status", "ok").alias("pages_ok"), is_("status", "partial").alias("pages_partial"), is_("status", "failed").alias("pages_failed"),
        F.count_if("retried").alias("pages_retried"), *(is_("fetch_method", m).alias(f"pages_{m}") for m in ("native_md", "proxy_md", "http_fast", "playwright")),
        is_("status", "skipped").alias("pages_skipped"), is_("status", "blocked").alias("pages_blocked"),
        F.count_if("cache_hit").alias("cache_hits"), F.count_if(~F.col("cache_hit")).alias("cache_misses"),
    )


def attrition(rows: DataFrame, stages: list[tuple[str, Column]]) -> DataFrame:
    """A3: for each stage's condition, applied after those before it, the rows before, after and removed: one aggregation."""
    passed, columns = F.lit(True), []
    for name, test in stages:
        before, passed = passed, passed & test
        columns.append(F.struct(F.lit(name).alias("stage"), F.count_if(before).alias("before"), F.count_if(passed).alias("after")))
    table = rows.agg(*(c.alias(f"s{k}") for k, c in enumerate(columns))).select(F.posexplode(F.array(*(f"s{k}" for k in range(len(columns))))).alias("ord", "s"))
    return table.select("ord", "s.*", (F.col("s.before") - F.col("s.after")).alias("removed"))


def active_jobs(jobs: DataFrame) -> DataFrame:
    """A4."""
    return jobs.agg(F.count_if(F.col("status").isin("pending", "running")).alias("active"))


def expired_jobs(jobs: DataFrame, now: Column, ttl: int = JOB_TTL) -> DataFrame:
    """Finished jobs older than ttl seconds; none if ttl is 0 or less."""
    return jobs.filter(F.lit(ttl > 0) & F.col("completed_at").isNotNull() & (now - F.col("completed_at") > ttl))


def until_terminal(events: DataFrame, job: str, order: Column, kind: str = "event_type", terminal: tuple[str, ...] = TERMINAL) -> DataFrame:
    """Each job's events up to its first terminal one."""
    last = events.filter(F.col(kind).isin(*terminal)).groupBy(job).agg(F.min(order).alias("__last"))
    return events.join(last, job, "left").filter(F.col("__last").isNull() | (order <= F.col("__last"))).drop("__last")


def progress(pages: DataFrame, job: str, order: str) -> DataFrame:
    """Each page's number and its job's number of pages; a job's pages meet in one task to be numbered, with no more than the two columns if no others are given."""
    numbered = F.row_number().over(Window.partitionBy(job).orderBy(order))
    return pages.withColumn("i", numbered).join(pages.groupBy(job).agg(F.count("*").alias("n")), job)


def missing_fields(state: Column) -> Column:
    """Required fields that a state's map lacks."""
    return F.array_except(F.array(*map(F.lit, STATE_FIELDS)), F.map_keys(state))


#: The states that a job may go to from each.
MOVES = {
    "pending": ("running", "cancelled"), "running": ("paused", "cancelled", "completed", "failed"), "paused": ("running", "cancelled"),
    "cancelled": (), "completed": (), "failed": (),
}


def may_move(state: Column, to: Column) -> Column:
    allowed = F.lit(False)
    for a, targets in MOVES.items():
        if targets:
            allowed = allowed | ((state == a) & to.isin(*targets))
    return allowed
