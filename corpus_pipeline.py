"""A corpus pipeline: toxic texts go, texts of no known language go, one of each group of near copies stays, then packing.

Each stage takes the rows that the one before kept, with all columns of documents, and works on all of them.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from pagemill.llm.common import durable, keep_rows, small_batches, table
from pagemill.llm.language import UNDETERMINED, fit_languages
from pagemill.llm.near_copies import drop_near_copies
from pagemill.llm.packing import pack_documents
from pagemill.llm.queries import SEQUENCE, held_out
from pagemill.llm.toxicity import fit_toxicity, words_of


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the toxicity operator, fitted on the labelled ones outside its held-out part, scores 0.5 or more."""
    small_batches(spark)
    model = fit_toxicity(docs.filter(~held_out(5, 0)), table(spark, sf_dir, "labels").filter(~held_out(5, 0)))

    def clean(text: str) -> bool:
        words = words_of(text)
        return model.score(model.surprise(words, model.segments(words))) < 0.5

    def keep(texts: list[str | None]) -> list[bool]:
        return [clean(t or "") for t in texts]

    return keep_rows(docs, "text", keep)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents without a letter, or whose language the output codes leave open."""
    small_batches(spark)
    model = fit_languages(docs.filter(~held_out(4, 2)))

    def keep(texts: list[str | None]) -> list[bool]:
        names, _, ambiguous = model.predict([t or "" for t in texts])
        return [n != UNDETERMINED and not a for n, a in zip(names, ambiguous.tolist(), strict=True)]

    return keep_rows(docs, "text", keep)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep of each group of copies and near copies (five-word shingles, similarity 0.8 or more) the smallest id."""
    small_batches(spark)
    return drop_near_copies(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the documents' tokens into sequences; a row is a piece and its place."""
    small_batches(spark)
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), SEQUENCE)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("language", language),
    ("near_dedup", near_dedup),
    ("packing", packing),
]

#: Learned models and near copies are not to be written in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of all stages on documents; each stage's rows are stored, as the next reads them several times."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = durable(docs)
    return docs
