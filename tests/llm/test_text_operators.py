"""Token counts, licences, packing, HTML text and pieces against libraries, brute force and literals."""

import random
import re
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from pagemill.llm import token_counts as token_counts_module
from pagemill.llm.html_text import extract_text, html_text
from pagemill.llm.licenses import BASE_PHRASES, NOTICE_PHRASES, evaluate, license_scan, postfix, scan
from pagemill.llm.packing import WordIds, pack_documents, plan_patterns
from pagemill.llm.pieces import BLANK, Vocabulary, decode_pieces, encode_pieces, piece_digests
from pagemill.llm.token_counts import Counter, token_counts

LETTERS = "aest rvlld'RE12 \n\t　é漢!-<|>😀\x1c\x85\r'Σς́ẞİ"
EDGES = ["", " ", "<|endoftext|>a <|endoftext|>", "'re", "'r", "x'v", "''s", " 's", "a'll b'l", "\x00a", "a" * 70000, "x y " * 40000]
BYTES, WORDS, PIECES = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))


def some_texts(n: int, most: int = 40) -> list[str]:
    r = random.Random(3)
    return ["".join(r.choices(LETTERS, k=r.randint(0, most))) for _ in range(n)] + EDGES


def frame(spark, texts, kind="doc_id long, text string, n long, key string, length int"):
    """Rows with columns whose names operators use inside."""
    return spark.createDataFrame([(k, t, -1, "k", -2) for k, t in enumerate(texts)], kind)


def test_token_counts_are_the_library_s():
    own, library, texts = Counter(BYTES), Tokenizer.from_file(BYTES), some_texts(3000)
    assert own.count(texts).tolist() == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


def test_transitions_come_again_after_a_clearing(monkeypatch):
    monkeypatch.setattr(token_counts_module, "MOST_TRANSITIONS", 50)
    monkeypatch.setattr(token_counts_module, "LANES", 7)
    monkeypatch.setattr(token_counts_module, "LONG", 20)
    monkeypatch.setattr(token_counts_module, "MOST_KNOWN", 5)
    own, library, texts = Counter(BYTES), Tokenizer.from_file(BYTES), some_texts(300)[:300] + ["abcde" * 30, "qzx" * 50]
    assert own.count(texts).tolist() == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


def test_every_code_point_counts_alike():
    own, library = Counter(BYTES), Tokenizer.from_file(BYTES)
    every = [chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000]
    texts = ["a" + "".join(f"{x}1{x} b" for x in every[i : i + 512]) for i in range(0, len(every), 512)]
    assert own.count(texts).tolist() == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


def test_token_counts_rows(spark):
    got = token_counts(frame(spark, [None, "", "a b", "a b"]), BYTES).orderBy("doc_id").collect()
    assert [(r.doc_id, r.n_bytes, r.n_tokens) for r in got] == [(0, 0, 0), (1, 0, 0), (2, 3, 2), (3, 3, 2)]
    df = spark.createDataFrame([(None, "a b"), (None, None), (1, "a b"), (1, "a b")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.n_tokens) for r in token_counts(df, BYTES).collect()) == [(0, 0), (0, 2), (1, 2), (1, 2)]
    assert token_counts(frame(spark, []), BYTES).count() == 0


def brute_scan(t: str):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)
    at, labels = [], set()
    for phrase, label in BASE_PHRASES.items():
        p = phrase.split()
        for i in range(len(words) - len(p) + 1):
            if words[i : i + len(p)] == p:
                at.append(i)
                labels.add(label)
    return len(words), len(at), min(at, default=None), max(at, default=None), sorted(labels)


def test_licences_against_brute_force():
    phrases = tuple(sorted([(p, x, True) for p, x in BASE_PHRASES.items()] + [(p, x, False) for p, x in NOTICE_PHRASES.items()]))
    r = random.Random(1)
    parts = ["cc", "by", "CC-BY", "general", "public", "License", "all rights", "reserved", "nc", "é", "漢by", "by\x80", "1", " cc by cc by "]
    for _ in range(4000):
        t = "".join(r.choice(parts) + r.choice([" ", "-", "\n", "\t", ".", "  ", ""]) for _ in range(r.randint(0, 12)))
        assert scan(t, phrases)[:5] == brute_scan(t)


@pytest.mark.parametrize(
    ("text", "parts", "level"),
    [
        ("MIT", ["MIT"], 1), ("MIT OR GPL-2.0-only AND BSD-3-Clause", ["MIT", "GPL-2.0-only", "BSD-3-Clause", "and", "or"], 1), ("(MIT or GPL-3.0) and AGPL-3.0", ["MIT", "GPL-3.0", "or", "AGPL-3.0", "and"], 3),
        ("GPL-2.0 WITH Classpath-exception-2.0", ["GPL-2.0", "Classpath-exception-2.0", "with"], 2), ("Apache-2.0. More text", ["Apache-2.0"], 1), ("(MIT", [], None), ("or MIT", [], None), ("", [], None), ("own-terms", ["own-terms"], 4),
    ],
)
def test_expressions(text, parts, level):
    assert postfix(text) == parts
    assert (evaluate(parts).obligation if parts else None) == level


def test_licence_rows(spark):
    got = license_scan(frame(spark, [None, "// SPDX-License-Identifier: MIT OR Zlib\nAll rights reserved.", "x"])).orderBy("doc_id").collect()
    assert got[0].n_words == 0 and got[0].labels == [] and got[0].score == 0.0 and got[0].first_word is None
    assert got[1].labels == ["mit", "reserved", "zlib"] and got[1].base_labels == ["reserved"] and got[1].expressions == ["MIT Zlib or"] and 0 < got[1].score <= 1
    assert license_scan(frame(spark, [])).count() == 0


def test_word_ids_are_the_library_s():
    own, texts = WordIds(WORDS), some_texts(3000)
    assert [np.frombuffer(x, "<u4").tolist() for x in own.encode(texts)] == [e.ids for e in own.library.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("seed", range(30))
def test_plans_use_every_piece_once(seed):
    r = np.random.default_rng(seed)
    counts = np.zeros(65, np.int64)
    counts[1:] = r.integers(0, 30, 64) * r.integers(0, 2, 64)
    used = np.zeros_like(counts)
    plan = plan_patterns(counts)
    for lengths, times in plan:
        assert sum(lengths) <= 64 and times > 0
        for a in lengths:
            used[a] += times
    assert (used == counts).all()
    bins, least = sum(t for _, t in plan), -(-int((counts * np.arange(65)).sum()) // 64)
    assert least <= bins <= max(least * 1.3 + 2, (counts[33:]).sum() + 1)


def test_packed_sequences_are_gapless(spark):
    texts = ["w " * n for n in (0, 1, 5, 9, 10, 11, 25, 30, 4, 4, 4, 7)] + [None, "long " * 95]
    rows = pack_documents(frame(spark, texts), WORDS, capacity=10).collect()
    own = WordIds(WORDS)
    ids = [next(own.encode([t or ""])) + b"\1\0\0\0" for t in texts]
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
        assert zlib.crc32(ids[r.doc_id][4 * r.start : 4 * (r.start + r.length)]) == r.ids_crc32
    for k, own_rows in by_doc.items():
        own_rows.sort(key=lambda r: r.piece)
        assert [r.length for r in own_rows] == [10] * (len(ids[k]) // 40) + ([len(ids[k]) // 4 % 10] if len(ids[k]) // 4 % 10 else [])
    assert sorted(by_doc) == list(range(len(texts)))
    for own_rows in by_sequence.values():
        at = 0
        for r in sorted(own_rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 10
    assert len(by_sequence) <= -(-sum(len(i) // 4 for i in ids) // 10) + 1
    assert pack_documents(frame(spark, []), WORDS).count() == 0


def test_packing_with_repeated_rows_and_null_ids(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c"), (None, None)], "doc_id long, text string")
    rows = pack_documents(df, WORDS, capacity=6).collect()
    assert len(rows) == 4 and len({(r.sequence_id, r.offset) for r in rows}) == 4


def test_html_layout():
    page = """<html><head><title>t</title><style>p{}</style></head><body><h1>Head &amp; line</h1><p>one <b>two</b>three<p>four<br>five<ul><li>a<li>b<ol start=3><li>x<li>y</ol></ul>
<table><caption>Cap</caption><tr><th>n<th>漢字 v<tr><td>1<td>long cell<tr><td rowspan=2>r<td>q<tr><td>z</table><pre> a
   b	c
</pre><div hidden>no</div><div style="display: none">no</div><script>var x="</p>";</script>tail < 3 &lt; <blockquote>q1</blockquote><dl><dt>T<dd>D</dl></body></html>"""
    assert html_text(page) == (
        "Head & line\n\none twothree\n\nfour\nfive\n\n- a\n- b\n  3. x\n  4. y\n\nCap\nn  漢字 v\n1  long cell\nr  q\n   z\n\n a\n   b    c\n\ntail < 3 <\n\n> q1\n\nT\n    D"
    )


@pytest.mark.parametrize("bad", ["<", "<<p", "<a <b>", "</p>", "<table><table><tr><td><table>", "<" * 1000, "<div>" * 3000 + "x", "<p title='", "<script>", "&#xD800;&#0;&bogus;", "<!--", "<![CDATA[x]]>", "<li>" * 500])
def test_html_never_fails(bad):
    html_text(bad)
    assert "word" in html_text("word " + bad)


def test_html_keeps_visible_words():
    r = random.Random(4)
    tags = ["p", "div", "b", "td", "tr", "table", "li", "ul", "dl", "dd", "span", "pre", "a", "select", "option", "h2", "blockquote"]
    for n in range(300):
        words = [f"w{n}x{k}" for k in range(12)]
        page = "".join(r.choice(["", f"<{r.choice(tags)}>", f"</{r.choice(tags)}>", f"<{r.choice(tags)}>"]) + f" {w} " for w in words)
        shown = html_text(page)
        assert sorted(re.findall(r"w\d+x\d+", shown)) == sorted(words), page


@pytest.mark.parametrize(
    ("page", "shown"),
    [
        ("<html><head><title>T</title><h1>Hi</h1><p>text", "Hi\n\ntext"),
        ("<head><meta charset=utf-8><script>x</script> \nplain text<b>b</b>", "plain textb"),
        ("<head><title>T</title></head><body>a", "a"),
        ("<table><colgroup><col><tr><td>x<td>y</table>z", "x  y\n\nz"),
        ("<table><colgroup><col></colgroup><colgroup span=2><thead><tr><th>h<tbody><tr><td>x</table>", "h\nx"),
        ("<math><mi>x</mi><mo>=</mo><mn>1</mn><annotation>tex</annotation></math>", "x=1"),
        ("a<svg><title>no</title><defs/><path d='M0'/><text>one</text><text>two</text></svg>b", "a\none\ntwo\nb"),
        ("<svg><defs><text>no</text></defs><foreignObject><div/>in</foreignObject></svg>", "in"),
        ("<span aria-hidden=true>seen</span> <i hidden>no</i>", "seen"),
    ],
)
def test_html_implied_ends_and_foreign_text(page, shown):
    assert html_text(page) == shown


@pytest.mark.parametrize(
    ("page", "shown"),
    [
        ("<div style='visibility:hidden'>no<b style='visibility: visible'>yes</b><img alt=no></div>z", "yes\nz"),
        ("<div style='visibility:hidden'>no<p>no</p></div>z", "z"),
        ("<p style='display:none;visibility:visible'>no<i style='visibility:visible'>no</i>", ""),
        ("a <p 'x>b", "a\n\nb"),
        ('<a title="1 > 0">b</a>', "b"),
        ("x<a <a <a", "x<a <a <a"),
    ],
)
def test_html_visibility_and_quotes(page, shown):
    assert html_text(page) == shown


@pytest.mark.parametrize("levels", [100, 250, 10_000])
def test_html_hides_at_any_depth(levels):
    page = "<div>" * levels + "a<div hidden>secret<p>more</p></div>b<div style='visibility:hidden'>no<b style='visibility:visible'>c</b></div>" + "</div>" * levels + "end"
    assert html_text(page).split() == ["ab", "c", "end"]
    assert html_text("<div hidden>" + "<div>" * levels + "secret" + "</div>" * levels + "</div>seen") == "seen"
    assert html_text("<div style='visibility:hidden'>" + "<div>" * levels + "no<i style='visibility:visible'>yes</i>") .split() == ["yes"]


@pytest.mark.parametrize("piece", ["<a ", "<a '", "<a \"'>", "<", "<a x='>", "</x>", "<div></x>", "<!--", "<p>", "<li>", "<table>", "&"])
def test_html_takes_linear_time(piece):
    page = piece * (1_000_000 // len(piece))
    began = time.process_time()
    html_text(page)
    assert time.process_time() - began < 30
    if piece == "<a ":
        assert time.process_time() - began < 3


def test_html_of_repeated_rows_and_clashing_columns(spark):
    schema = "page_id long, html string, text string, tag string"
    got = extract_text(spark.createDataFrame([(1, "<p>x", "u", "t"), (1, "<p>x", "u", "t"), (None, "y", None, None)], schema)).collect()
    assert sorted((r.page_id or 0, r.text) for r in got) == [(0, "y"), (1, "x"), (1, "x")]
    assert extract_text(spark.createDataFrame([], schema)).count() == 0


def test_html_rows(spark):
    got = extract_text(spark.createDataFrame([(1, None, "u"), (2, "", "u"), (3, "<p>x", "u")], "page_id long, html string, text string")).orderBy("page_id").collect()
    assert [r.text for r in got] == [None, "", "x"]


@pytest.fixture(scope="module")
def vocabulary():
    return Vocabulary(PIECES)


def test_n_best_against_enumeration(vocabulary):
    def every(s, end):
        return [(0.0, ())] if not end else [(a + score, i + ids) for begin, ids, score in vocabulary.edges(s, end) for a, i in every(s, begin)]

    r = random.Random(2)
    for _ in range(60):
        t = "".join(r.choices("thean o é漢\n͸", k=r.randint(1, 10)))
        s = BLANK + t.replace(" ", BLANK)
        best = sorted(every(s, len(s)), key=lambda x: -x[0])
        ids, score, ways = vocabulary.encode(t, 6)
        assert [x for x, _ in ways] == [x for x, _ in best[:6]]
        assert (score, tuple(np.frombuffer(ids, "<u4").tolist())) in best


def test_pieces_round_trip(spark, vocabulary):
    texts = [t for t in some_texts(500) if BLANK not in t]
    for t in texts:
        assert vocabulary.decode(np.frombuffer(vocabulary.encode(t, 3)[0], "<u4")) == t
    coded = encode_pieces(frame(spark, [None, "", "a  b\n", "a  b\n"]), PIECES, 3)
    assert [r.text for r in decode_pieces(coded, PIECES).orderBy("doc_id").collect()] == ["", "", "a  b\n", "a  b\n"]
    rows = piece_digests(frame(spark, [None, "the cat"]), PIECES).orderBy("doc_id").collect()
    assert rows[0].n_best == 0 and rows[0].nth_score is None and rows[1].round_trip and rows[1].nth_score <= rows[1].score
