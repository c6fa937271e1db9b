"""Chunking (T11, T12, A8): whole texts that fit and sections that fit stay in the JVM, the rest is cut in Arrow batches."""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions.lines import LEAST_SECTION, heading_sections, preclean
from pagemill.functions.text import once, stripped

CHUNK_SIZE, OVERLAP, LEAST_SIZE = 6000, 200, 400


#: Where a piece may end, the best first: what is looked for, characters from there that must fit, those that stay in the piece.
ENDS = ((re.compile(r"\n(?=#)"), 2, 1), (re.compile(r"\n(?=\n)"), 2, 2), (re.compile(r"\n"), 1, 1))


def spans(text: str, size: int) -> Iterator[tuple[int, int]]:
    """Begin and end of overlapping pieces of at most `size` characters; all places to end at are found once and looked up."""
    places = [[m.start() for m in mark.finditer(text)] for mark, _, _ in ENDS]
    begin = end = 0
    while end < len(text):
        limit = begin + size
        end = min(limit, len(text))
        if limit < len(text):
            half = begin + size // 2
            for heading, (found, (_, fit, stay)) in enumerate(zip(places, ENDS, strict=True)):
                k = bisect.bisect_right(found, limit - fit) - 1
                if k >= 0 and found[k] >= half + (heading > 0):  # a heading may stand at the very half
                    end = found[k] + stay
                    break
        yield begin, end
        begin = end - OVERLAP


def cut_by_size(text: str, size: int) -> list[str]:
    """Pieces of at most `size` characters that end at a heading, paragraph or line in their second half if they can.

    Consecutive pieces overlap by 200 characters; pieces of under 50 without white space at the ends are dropped.
    """
    if len(text) <= size:
        return [text] if text.strip() else []
    pieces = [text[a:b].strip() for a, b in spans(text, size)]
    return [p for p in pieces if len(p) >= LEAST_SECTION] or [text.strip()]


def _cut(rows: DataFrame, size: int) -> DataFrame:
    """rows(..., text, sections, chunks) to (..., chunks), with chunks from text, or from its sections, where they are null."""
    keys = [c for c in rows.columns if c not in ("text", "sections", "chunks")]
    schema = rows.select(*keys, "chunks").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chunks = batch.column("chunks")
            if chunks.null_count:
                open_ = np.flatnonzero(chunks.is_null().to_numpy(zero_copy_only=False))
                own = zip(*(batch.column(c).take(pa.array(open_)).to_pylist() for c in ("text", "sections")), strict=True)
                cut = [[c for s in sections for c in cut_by_size(s, size)] if sections else cut_by_size(text, size) for text, sections in own]
                order = np.arange(len(chunks))
                order[open_] = len(chunks) + np.arange(len(open_))
                chunks = pa.concat_arrays([chunks, pa.array(cut, chunks.type)]).take(pa.array(order))
            yield batch.select(keys).append_column("chunks", chunks)

    need = F.col("chunks").isNull()  # the rest of the texts stays in the JVM
    return rows.select(*keys, F.when(need, F.col("text")).alias("text"), F.when(need, F.col("sections")).alias("sections"), "chunks").mapInArrow(run, schema)


def _whole() -> Column:
    return F.when(stripped(F.col("text")) != "", F.array("text")).otherwise(F.array().cast("array<string>"))


def chunk_markdown(df: DataFrame, text: Column, size: int = CHUNK_SIZE, native_tokens: Column | None = None) -> DataFrame:
    """df's columns but text, sections and chunks, and the array of a text's chunks in order; blank and null texts have none.

    A text is one chunk if it fits, by its length or its native token count; else its heading sections; else pieces by size.
    One pass: each text is cleaned once, split once if it is long, and only what must be cut goes through Python.
    """
    if size < LEAST_SIZE:
        raise ValueError(f"chunks of under {LEAST_SIZE} characters need not advance")
    columns = [c for c in df.columns if c not in ("text", "sections", "chunks")]
    tokens = native_tokens if native_tokens is not None else F.lit(None).cast("int")
    rows = once(df.select(*columns, F.coalesce(text, F.lit("")).alias("__raw"), tokens.alias("__tokens")), text=preclean(F.col("__raw")))
    fits = (F.length("text") <= size) | F.coalesce(F.col("__tokens") * 4 <= size, F.lit(False))
    rows = once(rows.select(*columns, "text", fits.alias("__fits")), sections=F.when(~F.col("__fits"), heading_sections(F.col("text"))))
    easy = F.col("sections").isNotNull() & ~F.exists("sections", lambda s: F.length(s) > size)
    rows = once(rows, chunks=F.when(F.col("__fits"), _whole()).when(easy, F.col("sections")))
    return _cut(rows.select(*columns, "text", "sections", "chunks"), size)


def size_chunks(df: DataFrame, text: Column, size: int = CHUNK_SIZE) -> DataFrame:
    """T11 alone: df's columns but text, sections and chunks, and chunks; texts that fit stay in the JVM."""
    columns = [c for c in df.columns if c not in ("text", "sections", "chunks")]
    rows = once(df.select(*columns, F.coalesce(text, F.lit("")).alias("text")), chunks=F.when(F.length("text") <= size, _whole()))
    return _cut(rows.select(*columns, "text", F.lit(None).cast("array<string>").alias("sections"), "chunks"), size)


def reassemble(chunks: DataFrame, key: str, order: str, text: str, joint: str = "\n\n") -> DataFrame:
    """Each key's chunks joined in order; a page's chunks meet in one task, as they must for its file."""
    ordered = F.array_sort(F.collect_list(F.struct(order, text)))
    return chunks.groupBy(key).agg(F.array_join(F.transform(ordered, lambda c: c[text]), joint).alias("markdown"))
