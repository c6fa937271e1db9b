"""Sitemaps over stored bodies (S1-S6, U1): parsing, indexes, gzip, tolerance and caching."""

from __future__ import annotations

import gzip
import re
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions import urls

NAMESPACE = "http://www.sitemaps.org/schemas/sitemap/0.9"
#: Addresses of sitemaps that every site may have (fixed values).
LOCATIONS = ("/sitemap.xml", "/sitemap_index.xml")


def cut_lineage(df: DataFrame) -> DataFrame:
    """df checkpointed where the session has a folder for that, else as it is: plans then grow by a join a level."""
    return df.checkpoint() if df.sparkSession.sparkContext.getCheckpointDir() or df.sparkSession.sparkContext.getConf().get("spark.checkpoint.dir") else df


def read_bodies(spark, path: str) -> DataFrame:
    """(sitemap_url, body) of stored files, gzipped or not; the file's path stands for the URL."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("sitemap_url"), F.col("content").alias("body"))


def locations(body: bytes | None, any_namespace: bool = False) -> tuple[list[str], list[str]]:
    """Page and child-sitemap addresses of one body; nothing if it is no gzip or no XML, or declares entities."""
    if not body:
        return [], []
    try:
        text = gzip.decompress(body) if body[:2] == b"\x1f\x8b" else body
        if re.search(rb"<!ENTITY", text, re.IGNORECASE):
            return [], []
        root = ElementTree.fromstring(text)
    except (OSError, EOFError, ElementTree.ParseError):
        return [], []
    found: dict[str, list[str]] = {"url": [], "sitemap": []}
    for own in root.iter():
        space, _, name = own.tag.rpartition("}") if isinstance(own.tag, str) else ("", "", "")
        if name in found and (any_namespace or space == "{" + NAMESPACE):
            for child in own:
                if isinstance(child.tag, str) and child.tag.rpartition("}")[2] == "loc" and child.text and child.text.strip():
                    found[name].append(child.text.strip())
    return found["url"], found["sitemap"]


def parse_sitemaps(bodies: DataFrame, any_namespace: bool = False) -> DataFrame:
    """(sitemap_url, kind, loc) of bodies(sitemap_url, body BINARY or STRING), kind being url or sitemap."""
    schema = pa.schema([("sitemap_url", pa.string()), ("kind", pa.string()), ("loc", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for address, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                pages, children = locations(body, any_namespace)
                rows += [(address, "url", u) for u in pages] + [(address, "sitemap", u) for u in children]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in (zip(*rows, strict=True) if rows else ([], [], []))], schema=schema)

    return bodies.select("sitemap_url", F.col("body").cast("binary")).mapInArrow(run, "sitemap_url string, kind string, loc string")


def robots_sitemaps(bodies: DataFrame) -> DataFrame:
    """(host, sitemap_url) that robots files name."""
    lines = bodies.select("host", F.explode(F.split("body", r"\r\n|[\r\n]")).alias("line"))
    return lines.select("host", F.trim(F.regexp_extract("line", r"(?i)^\s*sitemap:\s*(\S+)", 1)).alias("sitemap_url")).filter("sitemap_url != ''")


def site_urls(bodies: DataFrame, roots: DataFrame, base: Column, any_namespace: bool = False) -> DataFrame:
    """(url) normalised, of all sitemaps reached from roots(sitemap_url), on base's host and below its path.

    Children are found by a join a level, at any depth; bodies are parsed once. Missing bodies give nothing.
    """
    parsed = parse_sitemaps(bodies, any_namespace).distinct().cache()
    level = seen = roots.select("sitemap_url").distinct()
    while not level.isEmpty():  # a level has only what no level before it had, so that cycles end
        children = parsed.filter("kind = 'sitemap'").join(level, "sitemap_url").select(F.col("loc").alias("sitemap_url")).distinct()
        level = cut_lineage(children.join(seen, "sitemap_url", "left_anti"))
        seen = cut_lineage(seen.unionByName(level))
    found = parsed.filter("kind = 'url'").join(seen, "sitemap_url", "left_semi").select(F.col("loc").alias("url"))
    return found.filter(urls.same_domain(F.col("url"), base) & urls.under_path(F.col("url"), base)).select(urls.normalize(F.col("url")).alias("url")).distinct()
