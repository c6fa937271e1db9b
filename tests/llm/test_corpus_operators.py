"""Fingerprints, neighbours, near copies, languages, toxicity and the pipeline against brute force and held-out labels."""

import hashlib
import random
import re
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from pagemill.llm import golay, queries
from pagemill.llm.components import components
from pagemill.llm.fingerprints import document_fingerprints, edited_fingerprints, id_ranges
from pagemill.llm.language import code_book, fit_languages, identify_languages
from pagemill.llm.near_copies import candidates, drop_near_copies, frequent_shingles, near_copy_groups, pairs_apart, shingle_set, words_of
from pagemill.llm.neighbours import nearest
from pagemill.llm.simhash import links, simhash, simhash_components
from pagemill.llm.toxicity import ToxicModel, fit_toxicity, maximal_segments, score_toxicity

SF = "/root/testdata/sf0.001"


def frame(spark, texts, ids=None):
    ids = ids or range(len(texts))
    return spark.createDataFrame([(k, t, 1, 2, "x", 3) for k, t in zip(ids, texts, strict=True)], "doc_id long, text string, bits long, range int, key string, node long")


def documents(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


def canonical(t):
    if t.isascii():
        folded = t.lower()
    else:
        folded = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", t).casefold())
    return re.sub(r"\s+", " ", folded).strip(" ")


@pytest.mark.parametrize("digits", [32, 1])
def test_edited_fingerprints(spark, digits):
    rows = documents(spark) + [(-1, ""), (-2, None), (-3, "Straße ﬁ"), (-4, "STRASSE  FI"), (10**12, "É"), (10**12 + 1, "é")]
    rows.sort(key=lambda r: -r[0])
    df = frame(spark, [t for _, t in rows], [k for k, _ in rows])
    got = {r.doc_id: r for r in edited_fingerprints(df, digits=digits).collect()}
    assert len(got) == len(rows)
    prints, first, size = {}, {}, {}
    for k, t in rows:
        own = canonical(t or "")
        first[own], size[own] = min(first.get(own, k), k), size.get(own, 0) + 1
    for i, (k, t) in enumerate(rows):
        t, after = t or "", rows[(i + 1) % len(rows)][1] or ""
        edited = t[: len(t) - len(t) // 3] + after[: len(t) // 3]
        r = got[k]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.near_edited, r.near_next) == (float(canonical(t) == canonical(edited)), float(canonical(t) == canonical(after)))
        assert (r.class_id, r.class_size) == (first[canonical(t)], size[canonical(t)])
        prints.setdefault(canonical(t), set()).add(r.fingerprint)
    assert all(len(v) == 1 for v in prints.values())
    if digits == 32:
        assert len({x for v in prints.values() for x in v}) == len(prints)


@pytest.mark.parametrize("digits", [32, 1])
def test_classes_are_told_by_bytes(spark, digits):
    rows = documents(spark)
    first, size = {}, {}
    for k, t in rows:
        first[canonical(t)] = min(first.get(canonical(t), k), k)
        size[canonical(t)] = size.get(canonical(t), 0) + 1
    got = document_fingerprints(frame(spark, [t for _, t in rows], [k for k, _ in rows]), digits=digits).collect()
    texts = dict(rows)
    assert len(got) == len(rows)
    assert all(r.class_id == first[canonical(texts[r.doc_id])] and r.class_size == size[canonical(texts[r.doc_id])] for r in got)


def test_fingerprints_of_odd_tables(spark):
    assert edited_fingerprints(frame(spark, [])).count() == 0 and document_fingerprints(frame(spark, [])).count() == 0
    one = edited_fingerprints(frame(spark, ["abcdef"])).first()
    assert one.edited_sha256 == hashlib.sha256(b"abcdab").hexdigest() and one.near_next == 1.0
    df = spark.createDataFrame([(1, "a"), (1, "a"), (None, "b"), (None, None)], "doc_id long, text string")
    assert edited_fingerprints(df).count() == 4


CONTRACTS = {
    "op1_best_fit_packing": {"doc_id": "bigint", "piece": "int", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "sequence_id": "bigint", "offset": "bigint"},
    "op2_license_scan": {"doc_id": "bigint", "n_words": "bigint", "n_base": "bigint", "first_word": "bigint", "last_word": "bigint", "base_labels": "string", "labels": "string", "score": "double"},
    "op3_document_fingerprints": {"doc_id": "bigint", "n_chars": "bigint", "edited_sha256": "string", "fingerprint": "string", "edited_fingerprint": "string", "near_edited": "double", "near_next": "double"},
    "op4_html_extraction": {"page_id": "bigint", "text": "string"},
    "op5_nearest_neighbours": {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "double"},
    "op6_simhash_near_dedup": {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"},
    "op7_language_id": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op8_sentencepiece": {"doc_id": "bigint"},
    "op9_toxicity": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op10_token_counts": {"doc_id": "bigint", "n_bytes": "bigint", "n_tokens": "bigint", "over_limit": "boolean"},
}


@pytest.mark.parametrize("name", CONTRACTS)
def test_registered_queries_keep_their_contract(spark, name):
    found = queries.QUERIES[name](spark, SF)
    kinds = dict(found.dtypes)
    assert {c: kinds.get(c) for c in CONTRACTS[name]} == CONTRACTS[name]
    rows = found.collect()
    if name not in ("op1_best_fit_packing", "op5_nearest_neighbours"):
        table = "pages" if name.startswith("op4") else "documents"
        assert len(rows) == spark.read.parquet(f"{SF}/{table}.parquet").count()
    assert all(0 <= r.score <= 1 for r in rows) or name in ("op5_nearest_neighbours", "op8_sentencepiece") if "score" in kinds else rows


def test_toxicity_on_documents(spark):
    sf = "/root/testdata/sf0.1"
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [(r.predicted, toxic[r.doc_id]) for r in queries.op9_toxicity(spark, sf).collect() if r.held_out and r.doc_id in toxic]
    found = sum(p for p, t in held if t) / sum(t for _, t in held)
    assert found > 0.6 and sum(p for p, t in held if not t) / len(held) < 0.01


def test_ranges_cover_all_ids(spark):
    bounds, heads, before = id_ranges(spark.range(5000).withColumnRenamed("id", "doc_id"))
    assert len(bounds) >= 5 and heads[0] == 4999 and len(heads) == len(before) == len(bounds) + 1
    assert before[0] == len(bounds) and before[1:] == list(range(len(bounds)))


def test_neighbours_recall_and_scores(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = df.select("vec_id", "embedding").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows])
    found = {}
    for r in nearest(df, F.col("vec_id") % 20 == 0, rerank=60).collect():
        found.setdefault(r.query_id, []).append(r)
    hits = total = 0
    for q in ids[ids % 20 == 0]:
        own = sorted(found[q], key=lambda r: r.rank)
        assert [r.rank for r in own] == list(range(1, 21)) and q not in [r.vec_id for r in own]
        exact = x @ x[ids == q][0]
        assert all(abs(exact[ids == r.vec_id][0] - r.score) < 1e-12 for r in own)
        assert [(-r.score, r.vec_id) for r in own] == sorted((-r.score, r.vec_id) for r in own)
        order = [i for i in np.lexsort((ids, -exact)) if ids[i] != q][:20]
        hits += len({int(ids[i]) for i in order} & {r.vec_id for r in own})
        total += 20
    assert hits / total >= 0.9


def test_neighbours_recall_as_registered(spark):
    """At the candidates that the query reranks, on the largest of the tables, against all inner products."""
    sf = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows])
    found = {}
    for r in queries.op5_nearest_neighbours(spark, sf).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    hits = [len(found[q] & set(ids[[i for i in np.lexsort((ids, -(x @ x[ids == q][0]))) if ids[i] != q][:20]].tolist())) for q in ids[ids % 20 == 0].tolist()]
    assert len(found) == len(hits) and sum(hits) / (20 * len(hits)) >= 0.9


def test_neighbours_of_huge_and_tiny_vectors(spark):
    for size in (1e200, 1e-200):
        r = np.random.default_rng(3)
        x = r.standard_normal((60, 8)) * size
        got = nearest(spark.createDataFrame([(k, v) for k, v in enumerate(x.tolist())], "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0, k=5).collect()
        assert len(got) == 15 and {g.query_id for g in got} == {0, 20, 40}


def test_neighbours_of_odd_vectors(spark):
    vectors = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [float("nan"), 1.0]), (6, [None, 1.0]), (7, [1.0]), (8, [0.5, 2.0]), (20, [0.0, 1.0]), (None, [1.0, 1.0]), (1, [1.0, 0.0]), (9, [float("inf"), 0.0])]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in nearest(df, F.col("vec_id") % 20 == 0).collect())
    assert got == [(0, 1, 1, 1.0), (0, 2, 2, 1.0), (0, 3, 8, 0.5), (0, 4, 20, 0.0), (20, 1, 8, 2.0), (20, 2, 0, 0.0), (20, 3, 1, 0.0), (20, 4, 2, 0.0)]
    assert nearest(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_golay_keys_meet():
    r = random.Random(5)
    words = [r.getrandbits(23) for _ in range(1500)]
    for w in words:
        other = w
        for b in r.sample(range(23), r.randint(0, 2)):
            other ^= 1 << b
        assert set(golay.keys(np.array([w]))[1].tolist()) & set(golay.keys(np.array([other]))[1].tolist())
    _, errors, many = golay.tables()
    assert many.tolist().count(6) == 1771 and many.sum() == 277 + 1771 * 6


def union(pairs, nodes):
    up = {n: n for n in nodes}

    def root(a):
        while up[a] != a:
            up[a] = up[up[a]]
            a = up[a]
        return a

    for a, b in pairs:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def test_components(spark):
    r = random.Random(6)
    pairs = [(r.randint(0, 150), r.randint(0, 150)) for _ in range(90)] + [(k, k + 1) for k in range(200, 230)] + [(300, k) for k in range(301, 340)] + [(7, 7)]
    want = union(pairs, {n for p in pairs for n in p})
    got = {x.u: x.root for x in components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    assert got == {n: root for n, root in want.items() if n != root}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


@pytest.mark.parametrize("few", [2, 24])
def test_links_connect_all_within_two_bits(spark, few):
    r = random.Random(7)
    bits = [r.getrandbits(64) for _ in range(30)]
    for _ in range(250):  # a chain of near ones: many share keys
        w = r.choice(bits)
        for b in r.sample(range(64), r.randint(1, 3)):
            w ^= 1 << b
        bits.append(w)
    bits = list(dict.fromkeys(w - (1 << 64) if w >> 63 else w for w in bits))
    near = [(a, b) for k, a in enumerate(bits) for b in bits[:k] if bin((a ^ b) & (1 << 64) - 1).count("1") <= 2]
    got = [(x.u, x.v) for x in links(spark.createDataFrame([(b,) for b in bits], "bits long"), few).collect()]
    assert set(map(frozenset, got)) <= set(map(frozenset, near))
    assert union(got, bits) == union(near, bits)


def test_simhash_components(spark):
    rows = documents(spark) + [(-5, ""), (-6, None), (-7, "\n \t"), (-8, "one"), (-9, "ONE")]
    got = {r.doc_id: r for r in simhash_components(frame(spark, [t for _, t in rows], [k for k, _ in rows])).collect()}

    def plain(t):
        t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
        h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
        return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h))

    prints = {k: plain(t) for k, t in rows}
    assert all(got[k].fingerprint == f"{v:016x}" for k, v in prints.items())
    ids = sorted(prints)
    want = union([(a, b) for i, a in enumerate(ids) for b in ids[:i] if bin(prints[a] ^ prints[b]).count("1") <= 2], ids)
    assert {k: got[k].component_id for k in ids} == want
    assert simhash(words_of("a b c"), 3) == simhash(words_of("A\tb  c"), 3)
    assert simhash_components(frame(spark, [])).count() == 0


def copies(spark):
    """Documents with planted near copies, and links by brute force."""
    rows = [(k, t) for k, t in documents(spark)][:120]
    r = random.Random(8)
    base = max((t for _, t in rows), key=len).split()[:200]
    for k in range(40):
        w = list(base)
        for _ in range(r.randint(0, 6)):
            w[r.randrange(len(w))] = f"new{r.randrange(10**6)}"
        rows.append((10_000 + k, " ".join(w)))
    rows += [(20_000, ""), (20_001, None), (20_002, "one two"), (20_003, "ONE  two"), (20_004, "one three")]
    sets = {k: set(shingle_set(words_of(t or "")).tolist()) for k, t in rows}
    pairs = [(a, b) for a in sets for b in sets if a > b and (len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) if sets[a] | sets[b] else True)]
    return rows, union(pairs, sets)


def test_near_copies(spark):
    rows, want = copies(spark)
    df = frame(spark, [t for _, t in rows], [k for k, _ in rows])
    assert {r.doc_id: r.group_id for r in near_copy_groups(df).collect()} == want
    kept = drop_near_copies(df.unionByName(df.filter("doc_id < 5")).unionByName(df.limit(1).withColumn("doc_id", F.lit(None).cast("long"))))
    assert kept.columns == df.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted({g for g in want.values()}) and ids.count(None) == 1
    assert near_copy_groups(frame(spark, [])).count() == 0


def edited(n, words=300, edits=5):
    """A text and n copies, each with words of its own at places of its own."""
    r = random.Random(n)
    base = [f"w{r.randrange(10**6)}" for _ in range(words)]
    texts = [" ".join(base)]
    for k in range(n):
        w = list(base)
        for at in r.sample(range(5, words - 5, 6), edits):
            w[at] = f"new{k}x{at}"
        texts.append(" ".join(w))
    return texts


@pytest.mark.parametrize("n", [100, 1000])
def test_near_copies_of_one_original_only(spark, n):
    texts = edited(n)
    sets = [set(shingle_set(words_of(t)).tolist()) for t in texts]
    assert all(0.8 <= len(s & sets[0]) / len(s | sets[0]) < 0.88 for s in sets[1:])
    assert all(len(a & b) / len(a | b) < 0.8 for a, b in zip(sets[1:], sets[2:], strict=False))
    got = near_copy_groups(frame(spark, texts, range(7, 8 + n))).collect()
    assert len(got) == n + 1 and {g.group_id for g in got} == {7}


def test_candidates_of_a_group_share_a_representative(spark):
    """A group of near copies has many keys in common; only one of a key's representatives is its own."""
    few = [(k, k % 7, [j for j in range(12) if (k * 31 + j * 17) % 5]) for k in range(600)]
    nodes = spark.createDataFrame(few, "node long, rare long, keys array<long>")
    got = [(p.u, p.v) for p in candidates(nodes).collect()]
    assert len(union(got, range(600))) == 600 and set(union(got, range(600)).values()) == {0}
    assert len(got) < 16 * 600


def test_frequent_shingles_of_small_partitions(spark):
    """What every fifth text holds is frequent, though each of many small partitions has two of those texts only."""
    shared = "one line that many texts have"
    texts = [f"{shared} {k} " * (k % 5 == 0) + " ".join(f"w{k}x{j}" for j in range(6)) for k in range(2000)]
    docs = frame(spark, texts).repartitionByRange(200, "doc_id").select("doc_id", "text")
    assert docs.rdd.getNumPartitions() == 200
    found, n = frequent_shingles(docs, 2000)
    held = shingle_set(words_of(shared))
    assert set(held.tolist()) == set(found.tolist()) and set(n.tolist()) == {400}


def test_near_copies_by_added_words(spark):
    r = random.Random(3)
    texts = []
    for k in range(400):
        words = [f"w{r.randrange(10**9)}" for _ in range(74)]
        texts += [" ".join(words[:60]), " ".join(words)]  # 56 of 70 shingles: 0.8
    got = {g.doc_id: g.group_id for g in near_copy_groups(frame(spark, texts)).collect()}
    assert got == {k: k - k % 2 for k in range(800)}


def test_pipeline_sends_small_batches(spark):
    """A batch of Spark's own size is tens of MB of text beside the heap."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    rows = spark.range(0, 2500, 1, 1).mapInArrow(lambda batches: (pa.record_batch([pa.array([b.num_rows])], ["id"]) for b in batches), "id long")
    spark.conf.unset(key)
    assert [r.id for r in rows.select("id").collect()] == [2500]
    corpus_pipeline.near_dedup(spark, frame(spark, ["one two three", "four"]).select("doc_id", "text"), SF)
    assert [r.id for r in rows.select("id").collect()] == [1000, 1000, 500]
    spark.conf.set(key, "10")
    corpus_pipeline.packing(spark, frame(spark, ["one"]).select("doc_id", "text"), SF)
    assert spark.conf.get(key) == "10"
    spark.conf.unset(key)


def test_representatives_differ_from_key_to_key(spark):
    nodes = spark.createDataFrame([(k, k, [1, 2, 3, 4, 5]) for k in range(40)], "node long, rare long, keys array<long>")
    assert candidates(nodes).count() > 39 + 38 + 37  # the pairs of three nodes with all others


def test_languages_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = queries.op7_language_id(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(got) == docs.count() and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.97 and all(0 <= r.score <= 1 for r in got)


def test_languages_of_odd_rows(spark):
    train = spark.createDataFrame([(k, t, x) for k in range(40) for t, x in ((f"the of and {k}", "en"), (f"der die und {k}", "de"))] + [(None, "x", "en"), (1, None, "de"), (2, "y", None)], "doc_id long, text string, lang string")
    model = fit_languages(train)
    got = identify_languages(frame(spark, [None, "", "123 !", "the and of", "und die der"]), model).orderBy("doc_id").collect()
    assert [r.lang_pred for r in got] == ["und", "und", "und", "en", "de"] and [r.score for r in got[:3]] == [0.0] * 3
    assert identify_languages(frame(spark, ["the"]), fit_languages(train.limit(0))).first().lang_pred == "und"
    for n in (1, 2, 3, 7, 30):
        code = code_book(n)
        assert len({tuple(c) for c in code}) == n


def test_more_languages_than_most(spark):
    r = random.Random(6)
    own = {f"l{k:03}": ["".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=7)) for _ in range(6)] for k in range(300)}
    rows = [(k, " ".join(r.choices(w, k=30)), x) for k, (x, w) in enumerate((x, w) for x, w in own.items() for _ in range(3))]
    model = fit_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert set(model.languages) == set(own)
    found, _, _ = model.predict([t for _, t, _ in rows])
    assert sum(a == x for a, (_, _, x) in zip(found, rows, strict=True)) > 0.95 * len(rows)


def brute_segments(x):
    out = []

    def search(a, b):
        best = None
        for i in range(a, b):
            total = 0.0
            for j in range(i, b):
                total += x[j]
                if total > 0 and (best is None or total > best[0] + 1e-9 or (abs(total - best[0]) < 1e-9 and j - i < best[2] - best[1])):
                    best = (total, i, j)
        if best:
            search(a, best[1])
            out.append((best[1], best[2], round(best[0], 6)))
            search(best[2] + 1, b)

    search(0, len(x))
    return out


def test_maximal_segments():
    r = random.Random(5)
    for _ in range(400):
        x = [r.choice([-0.5, -0.5, -0.5, 1.3, 2.7, 0.4]) for _ in range(r.randint(0, 25))]
        at = [k for k, v in enumerate(x) if v > 0]
        assert [(a, b, round(s, 6)) for a, b, s in maximal_segments(at, [x[k] for k in at], 0.5)] == brute_segments(x)


def test_toxicity_on_held_out_rows(spark):
    r = random.Random(9)
    words = ["".join(r.choices(["th", "er", "an", "on", "re"], k=r.randint(1, 4))) for _ in range(300)]
    rows = []
    for k in range(1200):
        toxic = int(k % 5 == 0)
        text = r.choices(words, k=60)
        for _ in range(3 * toxic):
            text[r.randrange(60)] = r.choice(["vilefoo", "nastybar"])
        rows.append((k, " ".join(text), toxic))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = fit_toxicity(df.filter("doc_id % 7 != 0").select("doc_id", "text"), df.select("doc_id", "toxic"))
    got = {x.doc_id: x for x in score_toxicity(df, model).collect()}
    held = [(got[k].predicted, toxic) for k, _, toxic in rows if k % 7 == 0]
    assert sum(p == t for p, t in held) / len(held) > 0.97
    hit = next(got[k] for k, t, _ in rows if "vilefoo" in t)
    assert hit.passages and all(p.first_word <= p.last_word for p in hit.passages)
    odd = score_toxicity(frame(spark, [None, "", "clean words"]), model).orderBy("doc_id").collect()
    assert all(0 <= x.score < 0.5 and x.predicted == 0 and x.passages == [] for x in odd)
    assert score_toxicity(frame(spark, ["x"]), ToxicModel({})).first().predicted == 0


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = docs
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "language", "near_dedup", "packing"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, kept, SF)
        assert after.schema.names == docs.schema.names
        assert {r.doc_id for r in after.select("doc_id").collect()} <= {r.doc_id for r in kept.select("doc_id").collect()}
        kept = after
    packed = corpus_pipeline.STAGES[-1][1](spark, kept, SF)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == {r.doc_id for r in kept.select("doc_id").collect()}
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0
