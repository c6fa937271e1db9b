"""Toxic passages by maximum-scoring segment search over token log-odds.

A token is a word; its evidence is the strongest of its own and of its character n-grams' log-odds between toxic and other
texts, with a Dirichlet prior in proportion to the whole sample and less a multiple of its standard error. Tokens without
evidence cost a little. A linear-time scan finds all disjoint segments of maximum score. Their scores follow an extreme-value
law on clean text, with the rate at which the clean tokens' exponentiated scores average to one; a segment of a text of n
tokens is significant if fewer than `expect` such segments are expected by chance. A text's significant segments add their
surprise, and a logistic curve fitted on the sample turns the sum into a score from 0 to 1.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import batch_of, durable, rows_of

#: Labelled texts of each class that the model is fitted on, features kept, and distinct words a worker remembers.
SAMPLE, MOST_FEATURES, MOST_WORDS = 4000, 20_000, 200_000
#: Lengths of character n-grams (word ends marked), prior's weight in tokens, standard errors taken off, least evidence, texts that a feature needs.
GRAMS, PRIOR, ERRORS, LEAST, LEAST_TEXTS = (4, 5, 6), 1000.0, 2.0, 2.0, 5
#: What a token without evidence costs, and the chance segments expected below which one is significant.
COST, EXPECT = 0.5, 0.05
#: ASCII letters and digits stay, other ASCII reads as a blank.
FOLD = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
SEGMENTS = pa.list_(pa.struct([("first_word", pa.int64()), ("last_word", pa.int64()), ("score", pa.float64())]))
SCHEMA = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("predicted", pa.int32()), ("passages", SEGMENTS)])


def words_of(text: str) -> list[bytes]:
    return text.lower().encode().translate(FOLD).split()


def features_of(word: bytes) -> set[str]:
    """The word itself, marked, and its character n-grams."""
    marked = f"<{word.decode()}>"
    return {"=" + marked} | {marked[k : k + n] for n in GRAMS for k in range(len(marked) - n + 1)}


def maximal_segments(at: list[int], gain: list[float], cost: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, last, score) of a sequence with these gains at these places and -cost elsewhere.

    The scan keeps candidates with the cumulative score before and after each. A new one looks leftwards for the nearest
    that began lower: if that one ends lower too, they join with all between and the look goes on, else the new one stands
    alone. Each candidate remembers where its own look ended, so that the scan is linear in the places.
    """
    kept: list[tuple[int, int, float, float, int]] = []  # first, last, sum before, sum after, nearest that began lower
    total, last = 0.0, -1
    for k, g in zip(at, gain, strict=True):
        total -= cost * (k - last - 1)
        first, before, last = k, total, k
        total += g
        j = len(kept) - 1
        while True:
            while j >= 0 and kept[j][2] >= before:
                j = kept[j][4]
            if j < 0 or kept[j][3] >= total:
                kept.append((first, k, before, total, j))
                break
            first, before, below = kept[j][0], kept[j][2], kept[j][4]
            del kept[j:]
            j = below
    return [(a, b, y - x) for a, b, x, y, _ in kept]


@dataclass
class ToxicModel:
    evidence: dict[str, float]
    rate: float = 1.0
    slope: float = 1.0
    offset: float = -3.0
    known: dict[bytes, float] = field(default_factory=dict, repr=False)

    def weight(self, word: bytes) -> float:
        w = self.known.get(word)
        if w is None:
            if len(self.known) > MOST_WORDS:
                self.known.clear()
            get = self.evidence.get
            w = self.known[word] = max((get(f, 0.0) for f in features_of(word)), default=0.0)
        return w

    def segments(self, words: list[bytes]) -> list[tuple[int, int, float]]:
        """The significant segments, by first word."""
        weights = list(map(self.weight, words))
        at = [k for k, w in enumerate(weights) if w > 0]
        least = np.log(max(len(words), 1) / EXPECT) / self.rate
        return [s for s in maximal_segments(at, [weights[k] for k in at], COST) if s[2] >= least]

    def surprise(self, words: list[bytes], segments: list[tuple[int, int, float]]) -> float:
        n = np.log(max(len(words), 1))
        return float(sum(self.rate * s[2] - n for s in segments))

    def score(self, surprise: float) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * np.log1p(surprise) + self.offset, -30, 30))))


def one_of_copies(words: list[bytes]) -> int:
    """The least hash of the three-word shingles: alike for most near copies, so that a group of copies counts once."""
    return min((xxhash.xxh64_intdigest(b" ".join(words[k : k + 3])) for k in range(max(1, len(words) - 2))), default=0) >> 1


def log_odds(toxic: np.ndarray, clean: np.ndarray, n_toxic: float, n_clean: float) -> np.ndarray:
    """Log-odds ratios with an informative Dirichlet prior, less ERRORS standard errors."""
    prior = 0.5 + PRIOR * (toxic + clean) / (n_toxic + n_clean)
    a, b = toxic + prior, clean + prior
    ratio = np.log(a / (n_toxic + PRIOR - a)) - np.log(b / (n_clean + PRIOR - b))
    return ratio - ERRORS * np.sqrt(1 / a + 1 / b)


def fit_toxicity(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> ToxicModel:
    """Fit on about `sample` texts of each class of documents(doc_id, text) with labels(doc_id, toxic), picked by hash.

    Rows with nulls are left out; of repeated labels the largest counts; of copies in the sample one counts.
    """
    known = labels.select("doc_id", (F.col("toxic") > 0).cast("int").alias("toxic")).dropna().groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    many = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(many) < 2:
        return ToxicModel({})
    rare = {c: -(-n // sample) for c, n in many.items()}
    few = known.filter(F.pmod(F.xxhash64("doc_id"), F.when(F.col("toxic") == 1, rare[1]).otherwise(rare[0])) == 0)
    few = durable(few.orderBy("doc_id").limit(4 * sample))  # so many ids at most: texts need no exchange to meet them
    picked = documents.select("doc_id", "text").dropna().join(F.broadcast(few), "doc_id").select("doc_id", "text", "toxic")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row a text: its class, sign, words and their features' counts stay together until copies are left out."""
        for batch in batches:
            words = [words_of(t) for t in rows_of(batch)]
            signs, joined = pa.array(map(one_of_copies, words), pa.int64()), pa.array([b" ".join(w) for w in words], pa.binary())
            yield pa.record_batch([signs, batch.column(0), batch.column(2), joined], names=["sign", "doc_id", "toxic", "words"])

    signed = picked.mapInArrow(count, "sign long, doc_id long, toxic int, words binary")
    single = durable(signed.groupBy("sign").agg(F.min_by(F.struct("toxic", "words"), "doc_id").alias("r")).select("r.toxic", "r.words"))

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, Counter] = {0: Counter(), 1: Counter()}
        texts: dict[int, Counter] = {0: Counter(), 1: Counter()}
        for batch in batches:
            for toxic, words in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = Counter()
                for w, n in Counter(words.split()).items():
                    for f in features_of(w):
                        own[f] += n
                total[toxic].update(own)
                texts[toxic].update(own.keys())
        names = list(total[0].keys() | total[1].keys())
        yield pa.record_batch([pa.array(names, pa.string()), *(pa.array([c[f] for f in names], pa.int64()) for c in (total[1], total[0], texts[1]))], names=["f", "toxic", "clean", "texts"])

    counts = single.mapInArrow(tally, "f string, toxic long, clean long, texts long").groupBy("f").agg(*(F.sum(c).alias(c) for c in ("toxic", "clean", "texts")))
    own = single.select("toxic", F.size(F.split(F.col("words").cast("string"), " ")).alias("n")).groupBy("toxic").agg(F.sum("n").alias("n"))
    size = {r["toxic"]: float(r["n"]) for r in own.collect()}
    if len(size) < 2:
        return ToxicModel({})
    likely = counts.filter(F.col("texts") >= LEAST_TEXTS).filter(F.col("toxic") * size[0] > 2 * F.col("clean") * size[1])
    found = likely.orderBy(F.desc(F.col("toxic") / (F.col("clean") + 1)), "f").limit(4 * MOST_FEATURES).toPandas()
    odds = log_odds(found["toxic"].to_numpy(float), found["clean"].to_numpy(float), size[1], size[0])
    best = np.argsort(-odds, kind="stable")[:MOST_FEATURES]
    model = ToxicModel({found["f"].iloc[k]: float(odds[k]) for k in best if odds[k] >= LEAST})

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per text: class, words, and the weights above 0 with their places."""
        for batch in batches:
            weights = [list(map(model.weight, words.split())) for words in batch.column(1).to_pylist()]
            places = [[k for k, x in enumerate(w) if x > 0] for w in weights]
            gains = [[w[k] for k in at] for w, at in zip(weights, places, strict=True)]
            rows = pa.array(map(len, weights), pa.int64()), pa.array(places, pa.list_(pa.int64())), pa.array(gains, pa.list_(pa.float64()))
            yield pa.record_batch([batch.column(0), *rows], names=["toxic", "n", "at", "gain"])

    seen = single.mapInArrow(weigh, "toxic int, n long, at array<long>, gain array<double>").toPandas()
    clean = seen[seen["toxic"] == 0]
    model.rate = decay_rate(np.concatenate([*clean["gain"], np.zeros(0)]), float(clean["n"].sum()))
    x = np.array([_sample_surprise(model, n, at, gain) for n, at, gain in zip(seen["n"], seen["at"], seen["gain"], strict=True)])
    model.slope, model.offset = logistic(np.log1p(x), seen["toxic"].to_numpy(float))
    return model


def _sample_surprise(model: ToxicModel, n: int, at: np.ndarray, gain: np.ndarray) -> float:
    least = np.log(max(n, 1) / EXPECT) / model.rate
    return float(sum(model.rate * s[2] - np.log(max(n, 1)) for s in maximal_segments(list(at), list(gain), COST) if s[2] >= least))


def decay_rate(gains: np.ndarray, n: float) -> float:
    """The positive root of mean(exp(rate * score)) = 1 over clean tokens; one more gain of each kind keeps it finite."""
    gains = np.append(gains, gains.mean() if len(gains) else 3.0)
    low, high = 1e-3, 50.0
    for _ in range(80):
        mid = (low + high) / 2
        value = (np.exp(np.minimum(mid * gains, 600)).sum() + max(n - len(gains), 1) * np.exp(-mid * COST)) / (n + 1)
        low, high = (mid, high) if value < 1 else (low, mid)
    return low


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve by Newton steps, with a light penalty; classes weigh alike."""
    weight = np.where(y > 0, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9))
    a = np.zeros(2)
    design = np.stack([x, np.ones_like(x)], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ a, -30, 30)))
        slope = design.T @ (weight * (y - p)) - 1e-2 * a
        bend = (design * (weight * p * (1 - p) + 1e-9)[:, None]).T @ design + 1e-2 * np.eye(2)
        a = a + np.clip(np.linalg.solve(bend, slope), -2, 2)
    return float(a[0]), float(a[1])


def score_toxicity(df: DataFrame, model: ToxicModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, predicted, passages) of every whole text, one row per input row.

    passages are the significant segments by word numbers from 0; predicted is 1 if the score is at least 0.5. Null and
    empty texts have no passage and the score of such texts. Ids may be null or repeat; empty tables give empty results;
    other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores, passages = [], []
            for text in rows_of(batch):
                words = words_of(text)
                own = model.segments(words)
                scores.append(model.score(model.surprise(words, own)))
                passages.append([{"first_word": a, "last_word": b, "score": s} for a, b, s in own])
            yield batch_of(SCHEMA, batch.column(0), scores, [int(s >= 0.5) for s in scores], passages)

    return df.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, "doc_id long, score double, predicted int, passages array<struct<first_word: long, last_word: long, score: double>>")
