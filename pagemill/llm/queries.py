"""The registered queries of the corpus operators; each returns the columns that its contract names."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm.common import id_remainder, table
from pagemill.llm.fingerprints import edited_fingerprints
from pagemill.llm.html_text import extract_text
from pagemill.llm.language import fit_languages, identify_languages
from pagemill.llm.licenses import license_scan
from pagemill.llm.neighbours import nearest
from pagemill.llm.packing import pack_documents
from pagemill.llm.pieces import piece_digests
from pagemill.llm.simhash import simhash_components
from pagemill.llm.token_counts import token_counts
from pagemill.llm.toxicity import fit_toxicity, score_toxicity

#: Tokens above which op10 marks a document.
TOKEN_LIMIT = 1024


#: Tokens of a packed sequence.
SEQUENCE = 4096


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), SEQUENCE)


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan(table(spark, sf_dir, "documents"))
    joined = {c: F.array_join(c, ",") for c in ("base_labels", "labels", "expressions")}
    return found.withColumns(joined)


def op3_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(table(spark, sf_dir, "documents"))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))


def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"))


def held_out(parts: int, part: int) -> Column:
    """Whether a document is kept from training: its remainder is `part`; null ids have none."""
    return F.coalesce(id_remainder(F.col("doc_id"), parts) == part, F.lit(False))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = fit_languages(documents.filter(~held_out(4, 2)))
    found = identify_languages(documents, model)
    return found.select("doc_id", held_out(4, 2).alias("held_out"), "lang_pred", "score", "ambiguous")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = fit_toxicity(*(table(spark, sf_dir, t).filter(~held_out(5, 0)) for t in ("documents", "labels")))
    found = score_toxicity(documents, model)
    return found.select("doc_id", held_out(5, 0).alias("held_out"), "score", "predicted", F.size("passages").alias("n_passages"))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), n=4)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return counted.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


QUERIES = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_license_scan": op2_license_scan,
    "op3_document_fingerprints": op3_document_fingerprints,
    "op4_html_extraction": op4_html_extraction,
    "op5_nearest_neighbours": op5_nearest_neighbours,
    "op6_simhash_near_dedup": op6_simhash_near_dedup,
    "op7_language_id": op7_language_id,
    "op8_sentencepiece": op8_sentencepiece,
    "op9_toxicity": op9_toxicity,
    "op10_token_counts": op10_token_counts,
}

ORACLES: dict[str, str] = {}
