"""Language identification by error-correcting output codes over byte n-grams.

Every language has a codeword; one linear classifier per bit of the code learns from relative frequencies of hashed byte
n-grams whether a text's language has that bit set. A text's margins are compared with every codeword: each bit adds its
logistic loss, weighted by how reliably that bit told the language in training, and the nearest codeword wins. Few
languages get the exhaustive code, many get random words at a distance. A text is ambiguous if the second codeword is nearly
as near.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import STEP_CHARS, batch_of, rows_of, steps

UNDETERMINED = "und"
#: Labelled texts a language that the classifiers are fitted on, and about how many in all that many languages share: the fit
#: takes about 0.5 GB of the driver for so many, whatever the number of languages.
SAMPLE, ROWS = 400, 4000
#: Buckets of hashed n-grams, the n, ridge penalty, and the share of the two nearest words below which a text is ambiguous.
BUCKETS, GRAMS, RIDGE, CLEAR = 1 << 13, (1, 2, 3), 1e-3, 0.6
#: ASCII letters stay, other ASCII reads as a blank.
LETTERS = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
LETTER = regex.compile(r"\p{L}")
SCHEMA = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("ambiguous", pa.bool_())])


def gram_buckets(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of all texts, one row for each n, and the text that each position belongs to (-1: between)."""
    parts = [b" ".join((b"", *t.lower().encode().translate(LETTERS).split(), b"")) for t in texts]
    whole = np.frombuffer(b"\0\0".join(parts) + b"\0\0\0", np.uint8).astype(np.uint32)
    n = len(whole) - 2
    owner = np.full(n, -1, np.int64)
    sizes = np.array([len(p) for p in parts])
    begins = np.cumsum(sizes + 2) - sizes - 2
    inside = np.repeat(np.arange(len(parts)), sizes)
    owner[np.repeat(begins - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())] = inside
    code, rows = np.zeros(n, np.uint32), []
    for k in range(max(GRAMS)):
        code = code << np.uint32(8) | whole[k : k + n]
        if k + 1 in GRAMS:
            rows.append((((code + np.uint32(k)) * np.uint32(2654435761)) >> np.uint32(32 - 13)).astype(np.int32))
    return np.array(rows), owner


def margins(texts: list[str], weights: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """The classifiers' margins: the mean weight of a text's n-grams, and the bias."""
    out = np.tile(bias, (len(texts), 1))
    for a, b in steps(texts, STEP_CHARS // 8):
        buckets, owner = gram_buckets(texts[a:b])
        there = owner >= 0
        n = np.bincount(owner[there], minlength=b - a)
        for k in range(weights.shape[1]):
            column = weights[:, k]
            total = np.bincount(owner[there], weights=column[buckets[:, there]].sum(axis=0), minlength=b - a)
            out[a:b, k] += total / np.maximum(n, 1)
    return out


def frequencies(texts: list[str]) -> np.ndarray:
    """Relative frequencies of the buckets, one row a text, as margins() weighs them."""
    rows = np.zeros((len(texts), BUCKETS), np.float32)
    for i, t in enumerate(texts):
        buckets, owner = gram_buckets([t])
        there = owner >= 0
        if there.any():
            rows[i] = np.bincount(buckets[:, there].ravel(), minlength=BUCKETS) / there.sum()
    return rows


def code_book(n: int) -> np.ndarray:
    """Codewords of -1 and 1, one row a language: the exhaustive code up to 7, else random bits of a fixed seed, 15 log2 n of them."""
    if n <= 2:
        return np.array([[1.0], [-1.0]])[:n]
    if n <= 7:
        columns = np.arange(2 ** (n - 1), 2**n - 1)
        return np.where(columns >> np.arange(n - 1, -1, -1)[:, None] & 1, 1.0, -1.0)
    return np.random.default_rng(n).choice([-1.0, 1.0], (n, int(15 * np.log2(n))))


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    code: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    trust: np.ndarray

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, share of the nearest codeword (0 to 1), and whether the text is ambiguous."""
        names = np.full(len(texts), UNDETERMINED, object)
        score, doubt = np.zeros(len(texts)), np.ones(len(texts), bool)
        there = [i for i, t in enumerate(texts) if LETTER.search(t)]
        if there and self.languages:
            m = margins([texts[i] for i in there], self.weights, self.bias)
            loss = [np.logaddexp(0, -4 * sign * m) @ (self.trust * (self.code == sign)).T for sign in (1, -1)]
            far = (loss[0] + loss[1]) / self.trust.sum(axis=1)
            share = np.exp(-4 * (far - far.min(axis=1, keepdims=True)))
            share /= share.sum(axis=1, keepdims=True)
            best = share.argmax(axis=1)
            names[there] = np.array(self.languages, object)[best]
            score[there] = share.max(axis=1)
            two = np.sort(share, axis=1)[:, -2:]
            doubt[there] = two[:, -1] / two.sum(axis=1) < CLEAR
        return names.tolist(), score, doubt


def fit_languages(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> LanguageModel:
    """Fit on about `sample` texts of each language of labelled, picked by a hash of the id; rows with nulls are left out.

    Every language is learnt. Many share about ROWS texts, each with one at least.
    """
    rows = labelled.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).dropna()
    many = rows.groupBy("lang").agg(F.count("*").alias("n"), F.min(F.xxhash64("doc_id")).alias("least")).collect()
    languages = tuple(sorted(r["lang"] for r in many))
    if not languages:
        return LanguageModel((), np.zeros((0, 1)), np.zeros((BUCKETS, 1)), np.zeros(1), np.zeros((0, 1)))
    few = len(languages) * sample > ROWS
    sample = max(1, ROWS // len(languages)) if few else sample
    steps_of = labelled.sparkSession.createDataFrame([(r["lang"], -(-r["n"] // sample), r["least"]) for r in many], "lang string, step long, least long")
    keep = (F.pmod(F.xxhash64("doc_id"), F.col("step")) == 0) | (F.lit(few) & (F.xxhash64("doc_id") == F.col("least")))
    picked = rows.join(F.broadcast(steps_of), "lang").filter(keep).select("doc_id", "text", "lang")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = frequencies(rows_of(batch))
            yield pa.record_batch([batch.column(0), batch.column(2), pa.array([r.tobytes() for r in x.astype(np.float16)], pa.binary())], names=["doc_id", "lang", "x"])

    found = picked.mapInArrow(run, f"{rows.schema['doc_id'].name} {rows.schema['doc_id'].dataType.simpleString()}, lang string, x binary").orderBy("doc_id", "lang").limit(2 * sample * len(languages)).toPandas()
    x = np.zeros((len(found), BUCKETS), np.float32)
    for k, r in enumerate(found.pop("x")):
        x[k] = np.frombuffer(r, np.float16)
    y = np.searchsorted(languages, found["lang"].to_numpy(str)) if len(found) else np.zeros(0, int)
    code = code_book(len(languages))
    target = code[y]
    centre, aim = x.mean(axis=0) if len(x) else np.zeros(BUCKETS, np.float32), target.mean(axis=0) if len(x) else np.zeros(code.shape[1])
    x -= centre
    gram = (x @ x.T).astype(np.float64)
    gram[np.diag_indices(len(gram))] += RIDGE * max(np.trace(gram) / max(len(gram), 1), 1e-12)
    weights = x.T @ np.linalg.solve(gram, target - aim) if len(x) else np.zeros((BUCKETS, code.shape[1]))
    bias = aim - centre @ weights
    right = ((x @ weights + aim) * target > 0).astype(float) if len(x) else np.zeros((0, code.shape[1]))
    trust = np.array([(right[y == k].sum(axis=0) + 1) / ((y == k).sum() + 2) for k in range(len(languages))])
    return LanguageModel(languages, code, weights, bias, trust)


def identify_languages(df: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, ambiguous) of every whole text, one row per input row.

    lang_pred is a language of the model, or `und` with score 0 for null texts and texts without a letter. Ids may be null
    or repeat; empty tables give empty results; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch_of(SCHEMA, batch.column(0), *model.predict(rows_of(batch)))

    return df.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, "doc_id long, lang_pred string, score double, ambiguous boolean")
