"""Queries on pages (S8, S9, S10, T1-T7, G1, the page report): expressions with oracles, trees as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.functions import text, urls
from pagemill.operators import graph, html
from pagemill.queries.common import table
from pagemill.queries.texts import HASH, VOTES
from pagemill.queries.urls import AUTHORITY, CANONICAL, NORMALIZED

QUERIES, ORACLES = {}, {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages")


def _strip(tags) -> str:
    out = "html"
    for t in tags:
        out = f"regexp_replace({out}, '(?is)<{t}[\\s>].*?</{t}>', '', 'g')"
    return out


VISIBLE = rf"trim(regexp_replace(regexp_replace(regexp_replace({_strip(('script', 'style', 'nav', 'footer', 'title'))}, '(?s)<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))"
ARTICLE = "(CASE WHEN length(regexp_extract(html, '(?is)<article[^>]*>(.*?)</article>', 1)) >= 200 THEN regexp_extract(html, '(?is)<article[^>]*>(.*?)</article>', 1) ELSE regexp_extract(html, '(?is)<body[^>]*>(.*?)</body>', 1) END)"
HREFS = "list_filter(regexp_extract_all(html, '(?i)<a\\s[^>]*?href=\"([^\"]*)\"', 1), lambda h: NOT regexp_matches(lower(h), '#|javascript:|mailto:|tel:'))"
NAV = "regexp_extract_all(array_to_string(regexp_extract_all(html, '(?is)<nav[^>]*>(.*?)</nav>', 1), ' '), '(?i)<a\\s[^>]*?href=\"([^\"]*)\"', 1)"
ROOT = "regexp_extract(url, '^(https?://[^/?#]*)', 1)"


@query("SELECT page_id, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS title FROM pages")
def page_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages(spark, sf_dir).select("page_id", html.title(F.col("html")).alias("title"))


@query("SELECT page_id, trim(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1)) AS h1 FROM pages")
def page_h1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages(spark, sf_dir).select("page_id", html.first_heading(F.col("html")).alias("h1"))


@query(f"SELECT DISTINCT page_id, {ROOT} || h AS link FROM (SELECT page_id, url, unnest({HREFS}) AS h FROM pages)")
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html.to_links(pages(spark, sf_dir)).select("page_id", "url", F.explode("links").alias("h")).withColumn("link", urls.resolve(F.col("url"), F.col("h")))
    return found.filter(urls.same_domain(F.col("link"), F.col("url"))).select("page_id", "link").distinct()


@query(f"SELECT page_id, {ROOT} || h AS link FROM (SELECT DISTINCT page_id, url, unnest({NAV}) AS h FROM pages) QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY {ROOT} || h) <= 100")
def nav_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html.to_links(pages(spark, sf_dir)).select("page_id", "url", F.explode(F.array_distinct("nav")).alias("h"))
    links = found.select("page_id", urls.resolve(F.col("url"), F.col("h")).alias("link")).distinct().groupBy("page_id")
    return links.agg(F.slice(F.array_sort(F.collect_list("link")), 1, html.MOST_NAV).alias("l")).select("page_id", F.explode("l").alias("link"))


@query(f"SELECT page_id, {_strip(('script', 'style', 'noscript', 'iframe', 'nav', 'footer', 'header'))} AS html FROM pages")
def page_noise_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages(spark, sf_dir).select("page_id", html.without_noise(F.col("html")).alias("html"))


@query(f"SELECT page_id, {ARTICLE} AS article FROM pages")
def article_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages(spark, sf_dir).select("page_id", html.article(F.col("html")).alias("article"))


@query(f"SELECT page_id, length({VISIBLE}) >= 500 AS fast FROM pages")
def fast_path_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages(spark, sf_dir).select("page_id", (F.length(html.visible_text(F.col("html"))) >= 500).alias("fast"))


@query(f"SELECT page_id, length({VISIBLE}) AS n_chars, {HASH(VISIBLE)} AS hash FROM pages")
def page_text_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = html.visible_text(F.col("html"))
    return pages(spark, sf_dir).select("page_id", F.length(seen).alias("n_chars"), text.content_hash(seen).alias("hash"))


@query(
    f"WITH p AS (SELECT page_id, {NORMALIZED('url')} AS url_norm, {CANONICAL('url')} AS url_canon, {AUTHORITY('url')} AS host, {VISIBLE} AS text FROM pages),"
    f" q AS (SELECT *, ({VOTES('text', text.BLOCKED_PATTERNS, '(?i)')}) >= 2 AS blocked, {HASH('text')} AS hash FROM p),"
    " f AS (SELECT hash, min(page_id) AS first FROM q WHERE NOT blocked GROUP BY hash)"
    " SELECT host, count(*) AS pages, count(DISTINCT url_norm) AS urls, count(DISTINCT url_canon) AS canonical_urls, count(*) FILTER (blocked) AS blocked,"
    " count(*) FILTER (NOT blocked AND page_id = first) AS kept, count(*) FILTER (NOT blocked AND page_id <> first) AS duplicates, sum(length(text)) AS n_chars FROM q LEFT JOIN f USING (hash) GROUP BY host"
)
def page_dedup_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: per host, pages and URLs, blocked, kept and duplicate pages; first wins by page_id."""
    u = F.col("url")
    rows = pages(spark, sf_dir).select("page_id", urls.normalize(u).alias("url_norm"), urls.canonical(u).alias("url_canon"), urls.authority(u).alias("host"), "html")
    rows = text.once(text.once(rows, text=html.visible_text(F.col("html"))), blocked=text.is_blocked(F.col("text")), hash=text.content_hash(F.col("text")), n=F.length("text")).drop("html", "text")
    first = rows.filter("not blocked").groupBy("hash").agg(F.min("page_id").alias("first"))
    return rows.join(first, "hash", "left").groupBy("host").agg(
        F.count("*").alias("pages"), F.countDistinct("url_norm").alias("urls"), F.countDistinct("url_canon").alias("canonical_urls"), F.count_if("blocked").alias("blocked"),
        F.count_if(~F.col("blocked") & (F.col("page_id") == F.col("first"))).alias("kept"), F.count_if(~F.col("blocked") & (F.col("page_id") != F.col("first"))).alias("duplicates"), F.sum("n").alias("n_chars"),
    )


_EDGES = f"(SELECT DISTINCT h[i] AS src, h[i + 1] AS dst FROM (SELECT h, unnest(generate_series(1, len(h) - 1)) AS i FROM (SELECT {HREFS} AS h FROM pages)))"


@query(
    f"WITH RECURSIVE e AS {_EDGES}, w(url, depth) AS (SELECT (SELECT min(src) FROM e), 0 UNION SELECT dst, depth + 1 FROM w JOIN e ON src = url WHERE depth < 3)"
    " SELECT url, min(depth) AS depth FROM w GROUP BY url ORDER BY 2, 1 LIMIT 1000"
)
def link_bfs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps from each link of a page to the next one, three levels deep."""
    h = pages(spark, sf_dir).select(html.hrefs(F.col("html")).alias("h"))
    edges = h.select(F.explode(F.arrays_zip(F.slice("h", F.lit(1), F.greatest(F.size("h") - 1, F.lit(0))).alias("src"), F.slice("h", F.lit(2), F.size("h")).alias("dst"))).alias("e")).select("e.src", "e.dst").dropna().distinct()
    return graph.crawl_levels(edges.agg(F.min("src").alias("url")), edges, 3)


@query()
def html_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.to_markdown(pages(spark, sf_dir).select("page_id", "html"), clean=False)


@query()
def content_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.to_markdown(pages(spark, sf_dir).select("page_id", "html"))


@query()
def html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html.to_blocks(pages(spark, sf_dir).select("page_id", "html"))
    return found.select("page_id", "title", F.posexplode("blocks").alias("ix", "b")).select("page_id", "title", "ix", "b.*")
