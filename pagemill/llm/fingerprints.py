"""Canonical exact fingerprints of documents, in DataFrame operations only.

A text's canonical form has its compatibility characters normalised, its case folded and its white space reduced to single
blanks. The fingerprint is a wide xxhash of that form. Documents are grouped by fingerprint and, inside equal fingerprints,
by the bytes of the canonical form: a map-side aggregation first leaves one copy per task, so that no group of copies meets
in one task as full texts.

A document's neighbour is found with one exchange of the texts: documents go to ranges of ids, and the first document of
each range goes to the range before it too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.llm.common import durable

NORMALIZER, CASES = "com.ibm.icu.text.Normalizer", "com.ibm.icu.lang.UCharacter"
#: Ranges of ids: rows that one is meant to hold, ranges at most, and ids looked at for each range to place the bounds.
RANGE_ROWS, MOST_RANGES, IDS_A_RANGE = 500, 10_000, 40


def canonical(text: Column) -> Column:
    """Compatibility composition and case folding, each white-space run one blank, none at the ends."""
    compose = lambda x: F.java_method(F.lit(NORMALIZER), F.lit("compose"), x, F.lit(True))
    folded = compose(F.java_method(F.lit(CASES), F.lit("foldCase"), compose(text), F.lit(True)))
    folded = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(folded)  # ASCII needs no tables
    return F.trim(F.regexp_replace(folded, r"(?U)\s+", " "))


def wide_hash(canon: Column, digits: int = 32) -> Column:
    """Two chained 64-bit xxhashes in hexadecimal; fewer digits are for tests of the comparison by bytes."""
    one = lambda *x: F.lpad(F.lower(F.hex(F.xxhash64(*x))), 16, "0")
    return F.substring(F.concat(one(canon), one(F.lit(1), canon)), 1, digits)


def buckets(canon: DataFrame) -> tuple[DataFrame, DataFrame, bool]:
    """Of canon(doc_id, canon, fingerprint): its classes of equal bytes, the same by fingerprint alone, and whether that is enough.

    A task first leaves one copy of each text, so that no bucket meets in one task as full texts.
    """
    own = canon.groupBy("fingerprint", "canon").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size"))
    found = durable(own.groupBy("fingerprint").agg(F.count("*").alias("n_texts"), F.min("class_id").alias("class_id"), F.sum("class_size").alias("class_size")))
    return own, found.drop("n_texts"), found.filter("n_texts > 1").isEmpty()


def classes(docs: DataFrame, digits: int = 32) -> DataFrame:
    """(doc_id, fingerprint, class_id, class_size) of docs(doc_id, text): documents of equal canonical bytes are a class.

    class_id is the smallest doc_id of the class, null only if all are null. Repeated rows count in class_size.
    """
    canon = docs.select("doc_id", canonical(F.col("text")).alias("canon")).withColumn("fingerprint", wide_hash(F.col("canon"), digits))
    own, found, alone = buckets(canon)
    if alone:
        return canon.select("doc_id", "fingerprint").join(found, "fingerprint")
    return canon.join(own, ["fingerprint", "canon"]).drop("canon")  # a collision: only the bytes tell


def id_ranges(docs: DataFrame) -> tuple[list[int], list[int | None], list[int]]:
    """Bounds of id ranges (descending), the greatest id of each range that has rows, and the range before each such range.

    Bounds come from ids picked by hash, a bounded number; they decide only what is dealt where. Range k has the ids of at
    most bounds[k - 1] and above bounds[k]; null ids are in the last.
    """
    ids = docs.select("doc_id")
    n = ids.count()
    many = min(max(1, n // RANGE_ROWS), MOST_RANGES)
    every = max(1, n // (many * IDS_A_RANGE))
    picked = sorted((r[0] for r in ids.filter(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0).dropna().distinct().limit(2 * MOST_RANGES * IDS_A_RANGE).collect()), reverse=True)
    bounds = sorted({picked[len(picked) * k // many] for k in range(1, many)}, reverse=True) if picked else []
    heads = {r[0]: r[1] for r in ids.groupBy(range_of(F.col("doc_id"), bounds).alias("range")).agg(F.max("doc_id")).collect()}
    there = sorted(heads)
    before = {there[k]: there[k - 1] for k in range(len(there))}  # of the first: the last
    many = len(bounds) + 1
    return bounds, [heads.get(k) for k in range(many)], [before.get(k, -1) for k in range(many)]


def range_of(doc_id: Column, bounds: list[int]) -> Column:
    """How many bounds are at least doc_id, by two searches of about the square root of their number."""
    if not bounds:
        return F.lit(0)
    step = max(1, int(len(bounds) ** 0.5))
    blocks = [bounds[k : k + step] for k in range(0, len(bounds), step)]
    at_least = lambda numbers: F.size(F.filter(numbers, lambda x: x >= doc_id))
    full = at_least(F.array([F.lit(b[-1]).cast("long") for b in blocks]))  # blocks that lie wholly at or above
    table = F.array([F.array([F.lit(x).cast("long") for x in b]) for b in [*blocks, []]]) if len(blocks[-1]) else None
    return F.when(doc_id.isNull(), F.lit(len(bounds))).otherwise(F.least(F.lit(len(bounds)), full * step + at_least(F.element_at(table, full + 1))))


def with_next(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text, fingerprint) with the text and fingerprint of the next row by descending doc_id, cyclically.

    Null ids come last; rows of equal ids are in the order of a hash of their texts.
    """
    bounds, heads, before = id_ranges(docs)
    own = range_of(F.col("doc_id"), bounds)
    pick = lambda values, kind: F.element_at(F.array([F.lit(x).cast(kind) for x in values]), F.col("range") + 1)
    to = lambda k, guest: F.struct(k.alias("range"), F.lit(guest).alias("guest"))
    rows = docs.withColumn("range", own)
    sent = F.when(pick(heads, "long").eqNullSafe(F.col("doc_id")), F.array(to(F.col("range"), False), to(pick(before, "int"), True))).otherwise(F.array(to(F.col("range"), False)))
    rows = rows.withColumn("to", F.explode(sent)).select("doc_id", "text", "fingerprint", "to.range", "to.guest")
    order = Window.partitionBy("range").orderBy("guest", F.col("doc_id").desc_nulls_last(), F.xxhash64("text"))
    return rows.withColumns({"next_text": F.lead("text").over(order), "next_fingerprint": F.lead("fingerprint").over(order)}).filter("not guest")


def document_fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", digits: int = 32) -> DataFrame:
    """(doc_id, n_chars, fingerprint, class_id, class_size), one row per input row.

    Texts of equal canonical form have equal fingerprints, and the same class if their bytes agree. A null text counts as
    empty; empty texts are a class like any other; null ids and repeated rows stay. Empty tables give empty results; other
    columns are not read.
    """
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return classes(docs, digits)


def edited_fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", digits: int = 32) -> DataFrame:
    """Fingerprints and classes of every text, and those of its edited text, whose last third is replaced by the beginning of the next text.

    The next text is that of the next lower id, of the lowest id the highest's; a single document is its own next. near_edited
    and near_next are 1.0 if the canonical bytes agree with the edited text's or the next text's, else 0.0. class_id and
    class_size are those of document_fingerprints. Nulls, ties and repeated rows as there and in with_next.
    """
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    docs = docs.withColumn("fingerprint", wide_hash(canonical(F.col("text")), digits))
    rows = with_next(docs).withColumn("n_chars", F.char_length("text").cast("long"))
    third = F.floor(F.col("n_chars") / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - third), F.substring("next_text", F.lit(1), third))
    rows = rows.withColumn("edited", edited).withColumn("edited_canon", canonical(F.col("edited"))).withColumn("edited_fingerprint", wide_hash(F.col("edited_canon"), digits))
    alike = lambda same, other: F.when(same, (canonical(F.col("text")) == other).cast("double")).otherwise(F.lit(0.0))
    found = rows.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint",
        alike(F.col("fingerprint") == F.col("edited_fingerprint"), F.col("edited_canon")).alias("near_edited"),
        alike(F.col("fingerprint") == F.col("next_fingerprint"), canonical(F.col("next_text"))).alias("near_next"), "text",
    )
    own, by_print, alone = buckets(docs.select("doc_id", canonical(F.col("text")).alias("canon"), "fingerprint"))
    if alone:
        return found.drop("text").join(by_print, "fingerprint")
    return found.withColumn("canon", canonical(F.col("text"))).drop("text").join(own, ["fingerprint", "canon"]).drop("canon")
