"""SimHash near-duplicates: Golay-code fuzzy hashing of fingerprint segments, join and verification.

A fingerprint of 64 bits is cut into three segments of 21, 21 and 22 bits. Of at most 2 differing bits, one segment has
none, and the segment after it at most 2. So two linked fingerprints agree in a key made of one whole segment and the index of a
Golay codeword near the next one. Equal fingerprints are one node; only distinct ones get keys. A key shared by a few is
verified pair by pair. A key shared by many (near copies by the thousand) is not expanded into pairs: its fingerprints
hash to themselves and their 64 neighbours at 1 bit. Two of them within 2 bits meet in the word in their middle, and any
two that meet are within 2 bits, so each meeting point is a star that needs no verification.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm import golay
from pagemill.llm.common import batch_of, durable, rows_of
from pagemill.llm.components import components

SEGMENTS = ((0, 21), (21, 21), (42, 22))
MAX_BITS = 2
#: Fingerprints of a key that are compared pair by pair; more meet in their neighbours.
FEW = 24
#: A-Z lowered, all else as it is.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
PRINTS = pa.schema([("doc_id", pa.int64()), ("bits", pa.int64())])
KEYS = pa.schema([("key", pa.int64()), ("bits", pa.int64())])
SHINGLES_A_STEP = 1 << 16


def words_of(text: str) -> list[bytes]:
    """Words between ASCII white space, A-Z lowered."""
    return text.encode().translate(LOWER).split()


def shingles_of(words: list[bytes], size: int) -> Iterator[bytes]:
    """Shingles of `size` words, repeats included; of fewer words the whole sequence; of none nothing."""
    if 0 < len(words) < size:
        return iter([b" ".join(words)])
    return map(b" ".join, zip(*(islice(words, k, None) for k in range(size)), strict=False))


def simhash(words: list[bytes], size: int) -> int:
    """The fingerprint as a signed 64-bit number: a bit is set if it is in over half of the shingles' XXH64."""
    total, n = np.zeros(64, np.int64), 0
    digests = map(partial(xxhash.xxh64_digest, seed=42), shingles_of(words, size))
    while part := b"".join(islice(digests, SHINGLES_A_STEP)):
        bits = np.unpackbits(np.frombuffer(part, np.uint8)).reshape(-1, 64)
        total += bits.sum(axis=0, dtype=np.int64)
        n += len(bits)
    return int.from_bytes(np.packbits(total * 2 > n).tobytes(), "big", signed=True)


def fingerprints(df: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, bits) of every whole text; null and wordless texts have no bit set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch_of(PRINTS, batch.column(0), [simhash(words_of(t), shingle) for t in rows_of(batch)])

    return df.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, "doc_id long, bits long")


def segment_keys(bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, position) of all fingerprints: which segment is whole, that segment, a codeword index of the next one."""
    words = bits.view(np.uint64)
    segments = [(words >> np.uint64(at) & np.uint64((1 << n) - 1)).astype(np.int64) for at, n in SEGMENTS]
    near = [golay.keys(s) for s in segments]
    key, at = [], []
    for k, whole in enumerate(segments):
        own, index = near[(k + 1) % 3]
        key.append(k << 40 | whole[own] << 12 | index)
        at.append(own)
    return np.concatenate(key), np.concatenate(at)


def neighbours(bits: np.ndarray) -> np.ndarray:
    """Each fingerprint and the 64 at 1 bit from it, as rows."""
    flips = np.concatenate([[0], np.uint64(1) << np.arange(64, dtype=np.uint64)]).astype(np.uint64)
    return (bits.view(np.uint64)[:, None] ^ flips).view(np.int64)


def _keyed(nodes: DataFrame, near: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = batch.column(0).to_numpy(zero_copy_only=False)
            for part in np.array_split(bits, max(1, len(bits) // 2000)):
                if near:
                    yield batch_of(KEYS, neighbours(part).ravel(), np.repeat(part, 65))
                else:
                    key, at = segment_keys(part)
                    yield batch_of(KEYS, key, part[at])

    return nodes.select("bits").mapInArrow(run, "key long, bits long")


def links(nodes: DataFrame, few: int = FEW) -> DataFrame:
    """(u, v) of distinct fingerprints nodes(bits) at most 2 bits apart: enough links to connect all that are connected."""
    keyed = durable(_keyed(nodes, near=False))
    shared = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("bits").alias("low"), F.max("bits").alias("high")).filter("n > 1")
    close = lambda u, v: F.bit_count(F.col(u).bitwiseXOR(F.col(v))) <= MAX_BITS
    twos = shared.filter("n = 2").select(F.col("low").alias("u"), F.col("high").alias("v")).filter(close("u", "v"))
    members = keyed.join(shared.filter("n > 2").select("key", "n"), "key")
    own = members.filter(F.col("n") <= few).groupBy("key").agg(F.array_sort(F.collect_list("bits")).alias("all"))  # at most `few`
    pairs = own.select(F.posexplode("all").alias("at", "u"), "all").select("u", F.explode(F.slice("all", F.lit(1), F.col("at"))).alias("v")).filter(close("u", "v"))
    many = _keyed(members.filter(F.col("n") > few).select("bits").distinct(), near=True)
    lowest = many.groupBy("key").agg(F.min("bits").alias("v"), F.max("bits").alias("high")).filter("v < high").select("key", "v")
    stars = many.join(lowest, "key").select(F.col("bits").alias("u"), "v").filter("u > v")
    return twos.unionByName(pairs).unionByName(stars).distinct()


def simhash_components(df: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text", few: int = FEW) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row, one row per input row.

    Fingerprints link at 2 or fewer differing bits, equal ones too; component_id is the smallest doc_id reachable. A null
    text counts as empty; all wordless texts have fingerprint zero and are linked like any other. Null ids and repeated rows
    stay; a component of null ids only has a null component_id. An empty table gives an empty result; other columns are
    not read. few decides only how links are found.
    """
    prints = durable(fingerprints(df, shingle, id_col, text_col))
    nodes = durable(prints.groupBy("bits").agg(F.min("doc_id").alias("low")))
    roots = nodes.join(components(links(nodes, few)), nodes["bits"] == F.col("u"), "left").select("bits", "low", F.coalesce("root", "bits").alias("root"))
    roots = durable(roots)
    lowest = roots.groupBy("root").agg(F.min("low").alias("component_id"))
    named = roots.join(lowest, "root").select("bits", "component_id")
    return prints.join(named, "bits").select("doc_id", F.lpad(F.lower(F.hex("bits")), 16, "0").alias("fingerprint"), "component_id")
