"""Structured Streaming (X1, X2, X5, X6, X11): pages to unique Markdown, and windowed counts of events with late data.

The same column functions serve batch and stream, so that a finite stream gives the batch result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.functions import text, urls
from pagemill.operators import html


def read_pages(spark: SparkSession, folder: str, files_a_batch: int = 20, pattern: str = "pages.parquet") -> DataFrame:
    """A stream of the page files in folder, or in folders there, that the pattern names; at most files_a_batch files a micro-batch, which is the back-pressure of a bounded queue."""
    schema = "page_id long, url string, html string"
    # braces: a path without a pattern is taken for the base of partition folders, which a file cannot be
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).option("recursiveFileLookup", "true").parquet(f"{folder}/{{{pattern}}}")


def page_texts(pages: DataFrame) -> DataFrame:
    """(page_id, url_norm, text, hash) of all pages; batch or stream."""
    rows = pages.select("page_id", urls.normalize(F.col("url")).alias("url_norm"), html.visible_text(F.col("html")).alias("text"))
    return rows.withColumn("hash", text.content_hash(F.col("text")))


def accepted_pages(pages: DataFrame) -> DataFrame:
    """page_texts of pages that are not blocked."""
    return page_texts(pages).filter(~text.is_blocked(F.col("text")))


def unique_pages(pages: DataFrame, within: str | None = None, time_col: str | None = None, blocked: bool = False) -> DataFrame:
    """Of accepted pages, or with blocked of all, one for each hash; with a time column and a delay, state is kept no longer than that."""
    rows = page_texts(pages) if blocked else accepted_pages(pages)
    if within and time_col:
        return rows.withWatermark(time_col, within).dropDuplicatesWithinWatermark(["hash"])
    return rows.dropDuplicates(["hash"])


def run_to_table(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run a finite stream to its end into a memory table and give that; the checkpoint makes it go on where it stopped."""
    running = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    running.awaitTermination()
    return stream.sparkSession.table(name)


def run_to_folder(stream: DataFrame, folder: str, checkpoint: str) -> DataFrame:
    """Run a finite stream into Parquet files and give their rows, none if there were none; stop() and another run resume by the checkpoint."""
    stream.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(folder)


def windowed_events(events: DataFrame, width: str = "1 hour", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """X11: counts and sums of events(ts, event_type, value) in tumbling or sliding windows; later rows than `late` are dropped."""
    frame = F.window("ts", width, slide) if slide else F.window("ts", width)
    kept = events.withWatermark("ts", late) if events.isStreaming else events
    return kept.groupBy(frame.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """X11: each user's sessions of events without a longer pause than `gap`."""
    kept = events.withWatermark("ts", late) if events.isStreaming else events
    return kept.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
