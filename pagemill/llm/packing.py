"""Best-fit packing by exact-complement hashing.

Texts become pieces of at most `capacity` tokens. What decides the packing is only how many pieces of each length there are:
a histogram of at most `capacity` rows, however many pieces. On it the driver plans *patterns*, multisets of lengths that go
into one sequence together, each with a multiplicity. A pattern opens with the longest length left and fills its gap
exactly from the indexes of single lengths, of sums of two and of sums of three, as far as the counts of available pieces
allow; where no combination is exact, the longest piece that fits goes in and the rest of the gap is looked up anew. Every
pattern is used as often as the counts allow, so that each step exhausts a length and the plan stays small.

Pieces get their rank among those of equal length without any task seeing a whole length: pieces are dealt to buckets by
hash, ranks inside a bucket are added to the counts of the buckets before it. Rank and plan give sequence and offset.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagemill.llm.common import batch_of, byte_letters, durable, held, rows_of

PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
PIECES_DDL = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Distinct words whose ids a worker keeps.
MOST_WORDS = 300_000
#: Pieces of a length that one bucket ranks: at least, and at most.
LEAST_BUCKET, MOST_BUCKET = 100, 1_000_000


class WordIds(dict):
    """Blank-delimited word -> its ids as little-endian 32-bit numbers. White space never enters a token of these vocabularies.

    A word of Latin letters, with a point or comma after it or not, goes to the merges straight away in lower case; any other
    goes through the whole library.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        self.cores: dict[str, bytes] = {}
        self.tails = {c: self.whole(c) for c in ".,"}

    def whole(self, word: str) -> bytes:
        return np.array(self.library.encode(word, add_special_tokens=False).ids, "<u4").tobytes()

    def __missing__(self, word: str) -> bytes:
        tail = word[-1:] if word[-1:] in self.tails else ""
        core = (word[:-1] if tail else word).lower()
        if core.isascii() and core.isalpha():
            letters = core
        elif core.isalpha() and max(core) < "\u0250" and "\u0130" not in word:  # composed letters, alike in every form
            letters = core.encode().decode("latin-1").translate(byte_letters())
        else:
            ids = self[word] = self.whole(word)
            return ids
        ids = self.cores.get(core)
        if ids is None:
            found = [t.id for t in self.model.tokenize(letters)]
            ids = self.cores[core] = struct.pack(f"<{len(found)}I", *found)
        if tail:
            ids += self.tails[tail]
        self[word] = ids
        return ids

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text."""
        for t in texts:
            if len(self) > MOST_WORDS:
                self.clear()
                self.cores.clear()
            yield b"".join(map(self.__getitem__, t.replace("\n", " ").split(" ")))


def token_pieces(df: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each text's ids and then end_id, cut after every `capacity` ids.

    A null text counts as empty and gives one piece of length 1. Null ids and repeated rows stay as they are.
    """
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word_ids = held(("word ids", tokenizer_path), lambda: WordIds(tokenizer_path))
        for batch in batches:
            rows = []
            for doc_id, ids in zip(batch.column(0).to_pylist(), word_ids.encode(rows_of(batch)), strict=True):
                ids += end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    cut = ids[at : at + 4 * capacity]
                    rows.append((doc_id, k, at // 4, len(cut) // 4, zlib.crc32(cut)))
            yield batch_of(PIECES, *(zip(*rows, strict=True) if rows else [[]] * 5))

    return df.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, PIECES_DDL)


class Stock:
    """Counts of available lengths, with the indexes of single lengths and of sums of two distinct ones."""

    def __init__(self, counts: np.ndarray):
        self.left = counts.astype(np.int64).copy()
        self.there = self.left > 0
        self.pairs = np.zeros(len(counts), np.int64)  # ways to write a sum as two different available lengths
        for a in np.flatnonzero(self.there):
            self.index(a, 1)

    def index(self, a: int, change: int) -> None:
        """Count the sums of a with smaller available lengths in or out."""
        b = np.flatnonzero(self.there[: min(a, len(self.pairs) - a)])
        self.pairs[a + b] += change

    def take(self, lengths: list[int], times: int) -> None:
        for a, k in zip(*np.unique(lengths, return_counts=True), strict=True):
            self.left[a] -= k * times
            if not self.left[a]:
                self.there[a] = False
                c = np.flatnonzero(self.there)
                c = c[c < len(self.pairs) - a]
                self.pairs[a + c] -= 1

    def single(self, gap: int, used: list[int]) -> list[int] | None:
        return [gap] if self.left[gap] > used.count(gap) else None

    def double(self, gap: int, used: list[int]) -> list[int] | None:
        """Two lengths that sum to the gap, the larger one as large as possible."""
        if self.pairs[gap] > 0:
            a = np.arange(gap - 1, (gap - 1) // 2, -1)
            for x in a[self.there[a] & self.there[gap - a]]:
                y = gap - x
                if self.left[x] - used.count(x) >= 1 + (x == y) and self.left[y] - used.count(y) >= 1 + (x == y):
                    return [int(x), int(y)]
        if gap % 2 == 0 and gap and self.left[gap // 2] - used.count(gap // 2) >= 2:
            return [gap // 2] * 2
        return None

    def triple(self, gap: int, used: list[int]) -> list[int] | None:
        """Three lengths that sum to the gap, found by one length and the index of sums of two."""
        a = np.arange(gap - 2, (gap - 1) // 3, -1)
        rest = gap - a
        fits = self.there[a] & ((self.pairs[rest] > 0) | ((rest % 2 == 0) & (self.left[rest // 2] > 1)))
        for x in a[fits]:
            if self.left[x] > used.count(x):
                two = self.double(gap - int(x), [*used, int(x)])
                if two:
                    return [int(x), *two]
        return None

    def longest(self, gap: int, used: list[int]) -> int | None:
        """Best fit: the longest available length of at most `gap`."""
        for a in np.flatnonzero(self.there[: gap + 1])[::-1]:
            if self.left[a] > used.count(a):
                return int(a)
        return None


def plan_patterns(counts: np.ndarray) -> list[tuple[list[int], int]]:
    """Patterns (lengths, times) that use up counts[length] pieces of every length of at most len(counts) - 1, the capacity."""
    capacity = len(counts) - 1
    stock, patterns = Stock(counts), []
    top = capacity
    while True:
        while top and not stock.there[top]:
            top -= 1
        if not top:
            return patterns
        used, gap = [top], capacity - top
        while gap:
            more = stock.single(gap, used) or stock.double(gap, used) or stock.triple(gap, used)
            if more is None:
                best = stock.longest(gap, used)
                if best is None:
                    break
                more = [best]
            used += more
            gap -= sum(more)
        each = {a: used.count(a) for a in used}
        times = int(min(stock.left[a] // k for a, k in each.items()))
        stock.take(used, times)
        patterns.append((sorted(used, reverse=True), times))


def plan_places(patterns: list[tuple[list[int], int]]) -> dict[str, np.ndarray]:
    """By length and first rank: pieces of that length a sequence, the first sequence, the offset of the first such piece."""
    rows, ranks, sequence = [], {}, 0
    for lengths, times in patterns:
        offset = 0
        for a, k in sorted(((a, lengths.count(a)) for a in set(lengths)), reverse=True):
            rows.append((a, ranks.get(a, 0), k, sequence, offset))
            ranks[a] = ranks.get(a, 0) + k * times
            offset += a * k
        sequence += times
    rows.sort()
    names = ("length", "rank", "each", "sequence", "offset")
    return dict(zip(names, np.array(rows, np.int64).reshape(-1, 5).T, strict=True))


def pack(pieces: DataFrame, capacity: int = 4096, keys: tuple[str, ...] = ("doc_id", "piece", "start")) -> DataFrame:
    """The rows of pieces, with their sequence_id and offset; lengths of a sequence sum to at most `capacity`.

    pieces has a column length of 1 to capacity and is read twice: give it durable. keys tell pieces apart; rows that are
    alike in them too are interchangeable. An empty table gives an empty result.
    """
    histogram = pieces.groupBy("length").agg(F.count("*").alias("n")).collect()  # at most `capacity` rows
    counts = np.zeros(capacity + 1, np.int64)
    for r in histogram:
        counts[r["length"]] = r["n"]
    places = plan_places(plan_patterns(counts))
    # every length gets buckets by its own count, so that a frequent length is no larger a task than others
    size = int(np.clip(counts.sum() // 4096, LEAST_BUCKET, MOST_BUCKET))
    buckets = pieces.sparkSession.createDataFrame([(a, int(-(-counts[a] // size))) for a in np.flatnonzero(counts).tolist()], "length long, n_buckets long")
    dealt = pieces.join(F.broadcast(buckets), "length").withColumn("bucket", F.pmod(F.xxhash64(*keys), F.col("n_buckets")))
    before = dealt.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    up = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = before.select("length", "bucket", F.coalesce(F.sum("n").over(up), F.lit(0)).alias("ahead"))
    inside = F.row_number().over(Window.partitionBy("length", "bucket").orderBy(*keys))
    ranked = dealt.withColumn("inside", inside).join(before, ["length", "bucket"]).withColumn("rank", F.col("ahead") + F.col("inside") - 1)
    schema = pieces.select(*pieces.columns, F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset")).schema
    at = places["length"] << 40 | places["rank"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy(zero_copy_only=False)
            rank = batch.column("rank").to_numpy(zero_copy_only=False)
            k = np.searchsorted(at, length << 40 | rank, side="right") - 1
            since = rank - places["rank"][k]
            each = places["each"][k]
            batch = batch.drop_columns(["rank"])
            yield batch.append_column("sequence_id", pa.array(places["sequence"][k] + since // each)).append_column("offset", pa.array(places["offset"][k] + since % each * length))

    return ranked.select(*pieces.columns, "rank").mapInArrow(run, schema)


def pack_documents(df: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every text's pieces with their sequence and offset; see token_pieces and pack."""
    return pack(durable(token_pieces(df, tokenizer_path, capacity, end_id, id_col, text_col)), capacity)
