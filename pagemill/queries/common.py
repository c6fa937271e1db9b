"""Inputs that the queries share, and the same inputs in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Paths put after some pages' URLs, by page_id % 8, so that every URL rule meets cases.
TAILS = ("", "/guide.PDF", "/blog/post", "/en/intro", "/de/start/", "/en-us/fr/x", "/v1.2/setup.html", "//")


def varied_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages with url varied by TAILS, put before the query string, and base, the same host's /docs for some."""
    bare = F.regexp_replace("url", r"[?#].*$", "")
    back = F.regexp_extract("url", r"([?#].*)$", 1)
    tail = F.element_at(F.array(*map(F.lit, TAILS)), (F.col("page_id") % len(TAILS) + 1).cast("int"))
    host = F.regexp_extract("url", r"^(https?://[^/?#]*)", 1)
    pages = table(spark, sf_dir, "pages")
    base = F.when(F.col("page_id") % 3 == 0, F.concat(host, F.lit("/en/"))).when(F.col("page_id") % 7 == 0, F.lit("https://elsewhere.example.net/")).otherwise(F.concat(host, F.lit("/")))
    return pages.select("page_id", F.concat(bare, tail, back).alias("url"), base.alias("base"), "html")


VARIED_PAGES = (
    r"(SELECT page_id, regexp_replace(url, '[?#].*$', '') || (["
    + ", ".join(f"'{t}'" for t in TAILS)
    + r"])[page_id % 8 + 1] || regexp_extract(url, '([?#].*)$', 1) AS url, CASE WHEN page_id % 3 = 0 THEN regexp_extract(url, '^(https?://[^/?#]*)', 1) || '/en/'"
    r" WHEN page_id % 7 = 0 THEN 'https://elsewhere.example.net/' ELSE regexp_extract(url, '^(https?://[^/?#]*)', 1) || '/' END AS base, html FROM pages)"
)


def decorated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text) with headings, fences, tables, braces, noise lines, formulas, prices and bot checks put into the documents."""
    t, d = F.col("text"), F.col("doc_id")
    some = lambda n, x: F.when(d % n == 0, x).otherwise("")
    half = F.floor(F.length(t) / 2).cast("int")
    body = F.when(d % 5 == 0, F.concat(F.lit("```\n# in code\n"), F.substring(t, F.lit(1), half), F.lit("\n```\n"), F.substr(t, half + 1))).otherwise(t)
    body = F.concat(F.lit("# "), "source", F.lit("\n"), F.when(d % 2 == 0, F.regexp_replace(body, r"\.\n", ".\n\n\n\n## part\n")).otherwise(body))
    parts = [
        some(3, "On this page\nNext \n Last updated 2024-01-01\n"), body, some(7, F.concat(F.lit("\n| a | b |\n"), F.when(d % 2 == 0, "|---|---|\n").otherwise(""), F.lit("| c | d |\n"))),
        some(11, "\n{\ncolor: red\n}\nafter the block"), some(33, "\n {\nnever closed"), some(13, "\n\\frac{a}{b} and \\begin{x}"), some(17, "\nonly $9.99 or $x$ now"),
        some(19, "\nJust a moment... Checking your browser"), some(23, "\nsolve the CAPTCHA"), some(29, "\nOur Cookie notice"), some(31, "\n``` left open"),
    ]
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(*parts).alias("text"))


DECORATED = r"""(SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN E'On this page\nNext \n Last updated 2024-01-01\n' ELSE '' END || '# ' || source || chr(10)
 || CASE WHEN doc_id % 2 = 0 THEN regexp_replace(body, '\.\n', E'.\n\n\n\n## part\n', 'g') ELSE body END
 || CASE WHEN doc_id % 7 = 0 THEN E'\n| a | b |\n' || CASE WHEN doc_id % 2 = 0 THEN E'|---|---|\n' ELSE '' END || E'| c | d |\n' ELSE '' END
 || CASE WHEN doc_id % 11 = 0 THEN E'\n{\ncolor: red\n}\nafter the block' ELSE '' END
 || CASE WHEN doc_id % 33 = 0 THEN E'\n {\nnever closed' ELSE '' END
 || CASE WHEN doc_id % 13 = 0 THEN E'\n\\frac{a}{b} and \\begin{x}' ELSE '' END
 || CASE WHEN doc_id % 17 = 0 THEN E'\nonly $9.99 or $x$ now' ELSE '' END
 || CASE WHEN doc_id % 19 = 0 THEN E'\nJust a moment... Checking your browser' ELSE '' END
 || CASE WHEN doc_id % 23 = 0 THEN E'\nsolve the CAPTCHA' ELSE '' END
 || CASE WHEN doc_id % 29 = 0 THEN E'\nOur Cookie notice' ELSE '' END
 || CASE WHEN doc_id % 31 = 0 THEN E'\n``` left open' ELSE '' END AS text
FROM (SELECT *, CASE WHEN doc_id % 5 = 0 THEN E'```\n# in code\n' || substring(text, 1, CAST(length(text) // 2 AS BIGINT)) || E'\n```\n' || substring(text, CAST(length(text) // 2 + 1 AS BIGINT)) ELSE text END AS body FROM documents))"""
