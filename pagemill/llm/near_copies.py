"""Near copies by SimHash: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Texts of equal word sequence are one node. A node's SimHash is taken over its words, so that an edited word moves it little,
and cut into three segments; the indices of the Golay codewords near a segment stay equal while at most 2 of its bits
differ. An index alone is shared by too many, so each key also holds the least shingle hash under a function of the segment's.
A key shared by a few nodes gives all its pairs, one shared by many gives each node's pairs with three representatives, so
that a group of near copies is never expanded into all pairs. The pairs are verified exactly on the whole shingle sets.

That joins nearly all groups in work that is linear in the texts, but proves nothing about the pairs it leaves out. So an
exact prefix join follows for what is still apart: with all shingles in one order, the rare first, two sets at 0.8 share one of
the first n - ceil(0.8 n) + 1 of each. All pairs of different groups that share such a shingle are looked at, however many
share it, but for those whose sizes, or whose places of the last such shingle, rule 0.8 out. Few of them are alike: the sets of
16-bit hashes, a quarter as large, rule out nearly all the others, and what they leave is verified as before.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction
from functools import partial
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagemill.llm import golay
from pagemill.llm.common import batch_of, durable, fresh, parts, release, rows_of, small, steps
from pagemill.llm.components import components
from pagemill.llm.simhash import SEGMENTS, SHINGLES_A_STEP, shingles_of, simhash, words_of

SHINGLE, SIMILARITY = 5, 0.8
#: Nodes of a key that are paired all with all; representatives beyond that.
FEW, REPRESENTATIVES = 16, 3
#: Shingles that a task counts at a time, the share of texts and the texts at least that make one frequent there, and the most that are told. Only the order depends on it.
COUNTED, SHARE, LEAST, FREQUENT = 1_000_000, 1e-3, 3, 100_000
#: Members of a key that meet in one part of the prefix join; characters of the texts that a task takes at a time.
PART, CHARS = 256, 1_000_000
FACTORS = np.random.default_rng(20).integers(1, 1 << 63, len(SEGMENTS), dtype=np.uint64) | np.uint64(1)
SKETCHES = pa.schema([
    ("doc_id", pa.int64()), ("mark", pa.int64()), ("high", pa.int64()), ("low", pa.int64()), ("size", pa.int64()), ("rare", pa.int64()), ("keys", pa.list_(pa.int64())), ("prefix", pa.list_(pa.int64())),
])
SETS = pa.schema([("node", pa.int64()), ("size", pa.int32()), ("shingles", pa.list_(pa.int64()))])
SHORT_SETS = pa.schema([("node", pa.int64()), ("size", pa.int32()), ("shingles", pa.list_(pa.int16()))])


def text_hash(words: list[bytes]) -> tuple[int, int]:
    """128 bits of a hash of the word sequence."""
    both = xxhash.xxh3_128_digest(b" ".join(words))
    return int.from_bytes(both[:8], "big", signed=True), int.from_bytes(both[8:], "big", signed=True)


def shingle_set(words: list[bytes], size: int = SHINGLE) -> np.ndarray:
    """The distinct 64-bit hashes of the shingles, ascending."""
    digests = map(partial(xxhash.xxh64_digest, seed=42), shingles_of(words, size))
    parts = []
    while part := b"".join(islice(digests, SHINGLES_A_STEP)):
        parts.append(np.unique(np.frombuffer(part, ">u8").astype(np.uint64)))
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)


def least_hash(shingles: np.ndarray, factor: np.uint64) -> np.uint64:
    """The least value of the shingles under the hash function of this factor."""
    mixed = shingles * factor
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    return mixed.min()


def frequent_shingles(docs: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that many of docs(doc_id, text) hold, ascending, and how many do; n: how many rows docs has.

    Every text is counted. A task drops what only few of its texts hold; a shingle that SHARE of all texts hold is held by
    that share in some task. Small partitions are put together, as LEAST texts are more than that share of a small one.
    """
    docs = docs.coalesce(max(1, int(n * SHARE / LEAST)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def counted() -> pa.RecordBatch:
            found, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *held]), return_counts=True)
            many = n >= max(LEAST, SHARE * len(held))
            held.clear()
            return pa.record_batch([pa.array(found[many].view(np.int64)), pa.array(n[many].astype(np.int64))], ["shingle", "n"])

        size = 0
        for batch in parts(batches):
            for words in map(words_of, rows_of(batch)):
                if len(words) >= SHINGLE:
                    held.append(shingle_set(words))
                    size += len(held[-1])
                if size >= COUNTED:
                    yield counted()
                    size = 0
        yield counted()

    counts = docs.select("doc_id", "text").mapInArrow(run, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    top = counts.orderBy(F.desc("n"), "shingle").limit(FREQUENT).toArrow()
    found, n = (top.column(k).to_numpy() for k in range(2))
    order = np.argsort(found.view(np.uint64))
    return found.view(np.uint64)[order], n[order]


def counts_of(shingles: np.ndarray, frequent: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """How many texts hold each of the shingles, 0 for those that are not frequent."""
    known, counts = frequent
    if not len(known):
        return np.zeros(len(shingles), np.int64)
    at = np.minimum(np.searchsorted(known, shingles), len(known) - 1)
    return np.where(known[at] == shingles, counts[at], 0)


def prefix_of(shingles: np.ndarray, counts: np.ndarray, similarity: float = SIMILARITY) -> np.ndarray:
    """The first shingles, the rare before the frequent: two sets as similar share one of theirs under any common order."""
    n = len(shingles) - math.ceil(similarity * len(shingles) - 1e-9) + 1 if len(shingles) else 0
    return shingles[np.argsort(counts, kind="stable")][:n].view(np.int64)


def golay_keys(words: list[bytes], shingles: np.ndarray) -> np.ndarray:
    """For each segment of the words' SimHash the indices of the codewords near it, each with the segment's least shingle hash."""
    prints = np.array([simhash(words, 1)], np.int64).view(np.uint64)
    keys = []
    for k, (at, n) in enumerate(SEGMENTS):
        _, near = golay.keys((prints >> np.uint64(at) & np.uint64((1 << n) - 1)).astype(np.int64))
        keys.append((least_hash(shingles, FACTORS[k]) ^ near.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ np.uint64(k << 60)).view(np.int64))
    return np.unique(np.concatenate(keys))


def lists(parts: list[np.ndarray], kind: type = np.int64) -> pa.ListArray:
    """One list of numbers a part."""
    ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, kind), *parts]).view(kind)))


def sketches(docs: DataFrame, n: int) -> DataFrame:
    """(doc_id, mark, high, low, size, rare, keys, prefix) of every one of the n rows of docs(doc_id, text, mark); rare counts the shingles that few texts hold.

    Texts of under five words have no keys.
    """
    frequent = frequent_shingles(docs, n)
    none = np.zeros(0, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            texts = rows_of(batch)
            for a, b in steps(texts, CHARS):
                hashes, sizes, rare, keys, prefixes = [], [], [], [], []
                for words in map(words_of, texts[a:b]):
                    shingles = shingle_set(words) if len(words) >= SHINGLE else none
                    hashes.append(text_hash(words))
                    counts = counts_of(shingles, frequent)
                    sizes.append(len(shingles))
                    rare.append(int((counts == 0).sum()))
                    keys.append(golay_keys(words, shingles) if len(shingles) else none)
                    prefixes.append(prefix_of(shingles, counts) if len(shingles) else none)
                yield batch_of(SKETCHES, batch.column(0)[a:b], batch.column(2)[a:b], *zip(*hashes, strict=True), sizes, rare, lists(keys), lists(prefixes))

    return docs.select("doc_id", "text", "mark").mapInArrow(run, "doc_id long, mark long, high long, low long, size long, rare long, keys array<long>, prefix array<long>")


def candidates(nodes: DataFrame, rows: int | None = None) -> DataFrame:
    """Pairs (u, v), u > v, of nodes(node, rare, keys) that share a key: all of a key of a few, with representatives in one of many.

    One representative is the node with the fewest rare shingles: of copies with edits of their own it is nearest to what they
    were made from. The next differs from key to key; what follows is first in an order of all nodes, so that the keys of one
    group, which have much the same nodes, pick the same one. Keys are first only counted, so that the many which one node has
    alone go no further.
    """
    keyed = nodes.select("node", "rare", F.explode("keys").alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    members = durable(keyed.join(shared, "key"))
    few = members.filter(F.col("n") <= FEW).groupBy("key").agg(F.array_sort(F.collect_list("node")).alias("all"))  # at most FEW
    few = few.select(F.posexplode("all").alias("at", "u"), "all").select("u", F.explode(F.slice("all", F.lit(1), F.col("at"))).alias("v"))
    hot = members.filter(F.col("n") > FEW)
    ranks = (F.struct("rare", "node"), *(F.struct(F.xxhash64(*(["key"] if k == 1 else []), "node", F.lit(k)), "node") for k in range(1, REPRESENTATIVES)))
    picks = hot.groupBy("key").agg(*(F.min(r)["node"].alias(f"r{k}") for k, r in enumerate(ranks)))
    many = hot.join(picks, "key").select(F.col("node").alias("u"), F.explode(F.array(*(f"r{k}" for k in range(REPRESENTATIVES)))).alias("v"))
    pairs = few.unionByName(many).filter("u != v")
    found = durable(pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), rows)
    release(members)
    return found


def shingle_sets(asked: DataFrame, docs: DataFrame, nodes: DataFrame, repeated: bool, n: int | None = None, short: bool = False) -> DataFrame:
    """(node, size, shingles) of the nodes asked for; nodes(node, doc_id, mark) says which rows of docs(doc_id, text, mark) have a node's text.

    size counts the shingles; short has of each hash the last 16 bits only, and equal ones once.
    """

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            texts = rows_of(batch)
            for a, b in steps(texts, CHARS):
                found = [shingle_set(words_of(t)) for t in texts[a:b]]
                sizes = list(map(len, found))
                if short:
                    yield batch_of(SHORT_SETS, batch.column(0)[a:b], sizes, lists([np.unique(f.astype(np.uint16)).view(np.int16) for f in found], np.int16))
                else:
                    yield batch_of(SETS, batch.column(0)[a:b], sizes, lists([f.view(np.int64) for f in found]))

    rows = durable(nodes.select("node", "doc_id", "mark").join(asked, "node", "left_semi"), n)
    found = docs.join(small(rows), ["doc_id", "mark"]).select("node", "text").mapInArrow(sets, f"node long, size int, shingles array<{'smallint' if short else 'long'}>")
    found = durable(found.dropDuplicates(["node"]) if repeated else found)
    release(rows)
    return found


def verified(pairs: DataFrame, sets: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Those of pairs (u, v) whose shingle sets, as sets(node, size, shingles) has them, are as similar.

    With short hashes those that can be: what two texts share has its short hashes shared too, but for shingles of one text
    that have one short hash, of which there are size less what the set holds.
    """
    side = lambda name: sets.select(F.col("node").alias(name), F.col("size").alias(f"n{name}"), F.col("shingles").alias(f"s{name}"))
    part, whole = parts_of(similarity)
    merged = lambda name: F.col(f"n{name}") - F.size(f"s{name}")
    common = F.size(F.array_intersect("su", "sv")) + F.least(merged("u"), merged("v"))
    alike = common.cast("long") * (part + whole) >= (F.col("nu").cast("long") + F.col("nv")) * part
    near = F.least("nu", "nv").cast("long") * whole >= F.greatest("nu", "nv").cast("long") * part
    return pairs.join(side("u"), "u").join(side("v"), "v").filter(near).filter(alike).select("u", "v")


def parts_of(similarity: float) -> tuple[int, int]:
    """The similarity as a ratio of whole numbers, so that comparisons are exact."""
    ratio = Fraction(similarity).limit_denominator(1000)
    return ratio.numerator, ratio.denominator


def pairs_apart(nodes: DataFrame, similarity: float = SIMILARITY, rows: int | None = None) -> DataFrame:
    """All pairs (u, v), u > v, of nodes(node, root, size, prefix) with different roots that can be as similar.

    Keys of one root only go no further. The others' members meet part by part, so that a hot key is many tasks. Up to the last
    shingle that two prefixes share, all that the sets share is in both prefixes; what follows in either bounds the rest.
    """
    part, whole = parts_of(similarity)
    keyed = nodes.select("node", "root", "size", F.posexplode("prefix").alias("at", "key"))
    keyed = keyed.select("key", "node", "root", F.col("size").cast("int").alias("size"), (F.col("size") - F.col("at")).cast("int").alias("rest"))
    apart = keyed.groupBy("key").agg(F.min("root").alias("least"), F.max("root").alias("most"), F.count("*").alias("n")).filter("least < most")
    keyed = durable(keyed.join(apart.select("key", F.ceil(F.col("n") / PART).alias("parts")), "key"))
    one = F.struct("node", "root", "size", "rest")
    a = keyed.select("key", one.alias("a"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    b = keyed.select("key", one.alias("b"), F.pmod(F.xxhash64("node"), F.col("parts")).alias("part"))
    sizes = F.least("a.size", "b.size") * whole >= part * F.greatest("a.size", "b.size")
    rests = F.least("a.rest", "b.rest") * (part + whole) >= part * (F.col("a.size") + F.col("b.size"))  # holds for the first of those shared, then up to one of them
    met = a.join(b, ["key", "part"]).filter((F.col("a.node") > F.col("b.node")) & (F.col("a.root") != F.col("b.root")) & sizes & rests)
    met = met.select(F.col("a.node").alias("u"), F.col("b.node").alias("v"), (F.col("a.size") + F.col("b.size")).alias("sizes"), F.col("a.rest").alias("ra"), F.col("b.rest").alias("rb"))
    pairs = met.groupBy("u", "v").agg(F.count("*").alias("n"), F.min("ra").alias("ra"), F.min("rb").alias("rb"), F.min("sizes").alias("sizes"))
    found = durable(pairs.filter((F.col("n") + F.least("ra", "rb") - 1) * (part + whole) >= part * F.col("sizes")).select("u", "v"), rows)
    release(keyed)
    return found


def near_copy_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, group_id) of every row with an id: group_id is the smallest doc_id that links reach from the text.

    Texts link if their word sequences agree or their sets of five-word shingles are 0.8 or more alike. A null text counts as
    empty; all wordless texts are alike. Texts of one to four words link only to equal ones. Rows of a repeated id give a row
    each. An empty table gives an empty result; other columns are not read.
    """
    return grouped(df, id_col, text_col)[0]


def grouped(df: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, int]:
    """near_copy_groups, and how many rows it has. What is stored between its steps has about a row a text."""
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).dropna(subset=["doc_id"])
    docs = docs.withColumn("mark", F.xxhash64("text"))
    n, most = docs.groupBy("doc_id").count().agg(F.coalesce(F.sum("count"), F.lit(0)), F.coalesce(F.max("count"), F.lit(0))).first()
    repeated = most > 1
    rows = durable(sketches(docs, n))
    nodes = rows.groupBy("high", "low", "size").agg(F.min(F.struct("doc_id", "mark", "rare", "keys", "prefix")).alias("s"))
    nodes = durable(nodes.select(F.monotonically_increasing_id().alias("node"), "high", "low", "size", "s.*"), n)
    own = durable(rows.select("doc_id", "high", "low", "size").join(nodes.select("high", "low", "size", "node"), ["high", "low", "size"]).select("doc_id", "node"), n)
    release(rows)

    def checked(pairs: DataFrame, short: bool) -> DataFrame:
        sets = shingle_sets(pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct(), docs, nodes, repeated, n, short)
        links = durable(verified(pairs, sets), n)
        release(sets, pairs)
        return links

    links = checked(candidates(nodes, n), short=False)
    roots = components(links, n)
    rooted = nodes.select("node", "size", "prefix").join(small(roots), F.col("node") == F.col("u"), "left").select("node", F.coalesce("root", "node").alias("root"), "size", "prefix")
    more = checked(checked(pairs_apart(rooted, rows=n), short=True), short=False)  # most pairs are not alike: short hashes tell
    release(links)
    roots = components(roots.select("u", F.col("root").alias("v")).unionByName(more), n)
    named = durable(nodes.select("node", "doc_id").join(small(roots), F.col("node") == F.col("u"), "left").select("node", "doc_id", F.coalesce("root", "node").alias("root")), n)
    release(nodes, more)
    groups = named.join(named.groupBy("root").agg(F.min("doc_id").alias("group_id")), "root").select("node", "group_id")
    return own.join(groups, "node").select("doc_id", "group_id"), n


def drop_near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of df, all columns, with one document of each group of near copies: that of the smallest id.

    Rows that repeat an id are one document, of which one row stays. Rows without an id are never compared and stay.
    """
    groups, n = grouped(df, id_col, text_col)
    groups = groups.groupBy("doc_id").agg(F.min("group_id").alias("group_id"))
    dropped = durable(groups.filter("doc_id != group_id").select(F.col("doc_id").alias(id_col)), n)
    rows = df.join(small(dropped), id_col, "left_anti").select(df.columns)
    ids = df.select(id_col).dropna()
    if not ids.groupBy(id_col).count().filter("count > 1").isEmpty():
        at = fresh(df, "at")
        first = Window.partitionBy(id_col).orderBy(F.xxhash64(text_col))
        rows = rows.withColumn(at, F.row_number().over(first)).filter((F.col(at) == 1) | F.col(id_col).isNull()).drop(at)
    return rows
