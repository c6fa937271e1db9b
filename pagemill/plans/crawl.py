"""The whole job over stored pages as one lazy plan (3.1 of the blueprint): filter, fetch result, gate, chunk, clean, assemble."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.functions import text, urls
from pagemill.operators import chunk, dedup, html, robots
from pagemill.specs import JobSpec

#: A cleaner gets a chunk and its level and gives the cleaned chunk; what it raises leaves the chunk as it was.
Cleaner = Callable[[str, str], str]


def rule_cleaner(chunk_: str, level: str) -> str:
    """The offline cleaner: drops lines of navigation residue; for heavy chunks puts a rule into tables without one."""
    kept = [line for line in chunk_.split("\n") if not any(p in line.lower() for p in text.NOISE_PHRASES)]
    if level == "heavy":
        rows = [k for k, line in enumerate(kept) if re.fullmatch(r"\|.+\|", line)]
        if len(rows) >= 2 and not any(re.fullmatch(r"\|[\s\-:|]+\|", kept[k]) for k in rows):
            kept.insert(rows[0] + 1, "|" + " --- |" * (kept[rows[0]].count("|") - 1))
    return "\n".join(kept)


def clean_chunks(chunks: DataFrame, cleaner: Cleaner = rule_cleaner) -> DataFrame:
    """chunks(..., chunk) with level, cleaned and ok; only those that need it go through the cleaner."""
    rows = chunks.withColumn("level", text.cleanup_level(F.col("chunk")))
    easy = rows.filter("level = 'skip'").withColumns({"cleaned": F.col("chunk"), "ok": F.lit(True)})
    schema = rows.select("*", F.lit("").alias("cleaned"), F.lit(True).alias("ok")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cleaned, good = [], []
            for own, level in zip(batch.column("chunk").to_pylist(), batch.column("level").to_pylist(), strict=True):
                try:
                    done = cleaner(own, level)
                except Exception:  # the chunk stays as it was and is counted
                    done = None
                good.append(bool(done and done.strip()))
                cleaned.append(done if good[-1] else own)
            yield batch.append_column("cleaned", pa.array(cleaned, pa.string())).append_column("ok", pa.array(good, pa.bool_()))

    return easy.unionByName(rows.filter("level != 'skip'").mapInArrow(run, schema))


@dataclass(frozen=True)
class Crawl:
    """The stages of a job; each is a lazy DataFrame."""

    accepted: DataFrame
    converted: DataFrame
    blocked: DataFrame
    unique: DataFrame
    chunks: DataFrame
    documents: DataFrame
    failed: DataFrame

    def status(self) -> DataFrame:
        """(page_id, url, status): ok, partial, blocked, skipped or failed; blocked and duplicate pages are done, not pending."""
        partial = self.chunks.groupBy("page_id").agg(F.bool_and("ok").alias("ok"))
        done = self.unique.select("page_id", "url").join(partial, "page_id", "left").select("page_id", "url", F.when(F.coalesce("ok", F.lit(True)), "ok").otherwise("partial").alias("status"))
        rest = self.converted.filter("error is null").select("page_id", "url").join(self.unique.select("page_id"), "page_id", "left_anti").join(self.blocked.select("page_id", F.lit(True).alias("b")), "page_id", "left")
        rest = rest.select("page_id", "url", F.when(F.col("b"), "blocked").otherwise("skipped").alias("status"))
        return done.unionByName(rest).unionByName(self.failed.select("page_id", "url", F.lit("failed").alias("status")))


def crawl(pages: DataFrame, spec: JobSpec, rules: DataFrame | None = None, cleaner: Cleaner = rule_cleaner, size: int = chunk.CHUNK_SIZE) -> Crawl:
    """pages(page_id, url, html) through all stages. URL filters come before any conversion, the hash before any chunking."""
    base = F.lit(spec.url)
    rows = pages.select("page_id", "url", "html").filter(urls.accepted(F.col("url"), base, spec.language))
    if rules is not None and spec.respect_robots_txt:
        rows = robots.robots_filter(rows.withColumn("host", urls.authority(F.col("url"))), rules).drop("host")
    converted = html.to_markdown(rows, converter=spec.converter, noise=spec.noise_selectors, content=spec.content_selectors)
    failed = converted.filter("error is not null")
    good = converted.filter("error is null").withColumn("blocked", text.is_blocked(F.col("markdown")))
    blocked = good.filter("blocked")
    kept = good.filter("not blocked").select("page_id", "url", "markdown", text.content_hash(F.col("markdown")).alias("hash"))
    unique = dedup.first_by(kept, F.col("hash"), F.col("page_id"))
    cut = chunk.chunk_markdown(unique.select("page_id", "url", "markdown"), F.col("markdown"), size).select("page_id", "url", F.posexplode("chunks").alias("ix", "chunk"))
    cleaned = cut.withColumns({"level": F.lit("skip"), "cleaned": F.col("chunk"), "ok": F.lit(True)}) if spec.skip_llm_cleanup else clean_chunks(cut, cleaner)
    documents = chunk.reassemble(cleaned, "page_id", "ix", "cleaned").join(unique.select("page_id", "url"), "page_id").withColumn("file", urls.file_path(F.col("url"), base))
    return Crawl(rows, converted, blocked, unique, cleaned, documents, failed)


def write_documents(documents: DataFrame, folder: str, form: str = "parquet") -> None:
    """K1, K2: the documents as Parquet or JSON lines; the writer's commit makes them appear whole."""
    documents.write.mode("overwrite").format(form).save(folder)
