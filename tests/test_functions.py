"""Literal and property tests of the column functions."""

import random
import re
from urllib.parse import urljoin

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagemill.functions import lines, text, urls
from pagemill.operators.chunk import cut_by_size, spans


def one(spark, value, *columns):
    return list(spark.createDataFrame([(value,)], "x string").select(*columns).first())


@pytest.mark.parametrize(
    ("url", "expected"),
    [
        ("https://EXAMPLE.com/Path/", "https://example.com/Path"), ("https://a.com/", "https://a.com/"), ("https://a.com//", "https://a.com"), ("https://a.com/p#s", "https://a.com/p"),
        ("https://a.com/p?q=1#s", "https://a.com/p?q=1"), ("HTTP://A.com/x/;v=1", "http://a.com/x;v=1"), ("ftp://A.com/x/", "ftp://A.com/x/"), ("", ""), ("/rel/", "/rel"), ("https://a.com/é/", "https://a.com/é"),
    ],
)
def test_normalize(spark, url, expected):
    assert one(spark, url, urls.normalize(F.col("x"))) == [expected]


def test_normalize_cuts_long_urls(spark):
    assert len(one(spark, "https://a.com/" + "x" * 3000, urls.normalize(F.col("x")))[0]) == 2000


@pytest.mark.parametrize(
    ("path", "language", "base", "expected"),
    [
        ("/en-us/docs", "en", "/", True), ("/de/x", "en", "/", False), ("/en/de/x", "en", "/", True), ("/docs", "en", "/en/", False), ("/docs", "en", "/", True),
        ("/docs/en", "en", "/", True), ("/it/x", "it", "/", True), ("/x", "all", "/en/", True),
    ],
)
def test_language(spark, path, language, base, expected):
    assert one(spark, "https://h" + path, urls.matches_language(F.col("x"), language, F.lit("https://h" + base))) == [expected]


@pytest.mark.parametrize(("url", "base", "file"), [("https://h/", "https://h/", "index.md"), ("https://h/docs/a/page.html", "https://h/docs/", "a/page.md"), ("https://h/v1.2/x", "https://h/", "v1.2/x.md"), ("https://h/docs-old/x", "https://h/docs", "-old/x.md")])
def test_file_path(spark, url, base, file):
    assert one(spark, url, urls.file_path(F.col("x"), F.lit(base))) == [file]


@pytest.mark.parametrize(("base", "href", "expected"), [("https://h/a/b", "/x", "https://h/x"), ("https://h/a/b", "c", "https://h/a/c"), ("https://h", "c", "https://h/c"), ("https://h/a", "//o/x", "https://o/x"), ("https://h/a", "http://o/", "http://o/"), ("https://h/a", "?q", "https://h/a?q")])
def test_resolve(spark, base, href, expected):
    assert one(spark, href, urls.resolve(F.lit(base), F.col("x"))) == [expected]


@pytest.mark.parametrize(
    ("content", "expected"),
    [("Access denied by Cloudflare", True), ("captcha captcha", False), ("captchas and cloudflares", False), ("", False), (None, False), ("JUST A MOMENT... ddos protection", True)],
)
def test_blocked(spark, content, expected):
    assert one(spark, content, text.is_blocked(F.col("x"))) == [expected]


def test_hash_ignores_white_space_and_case(spark):
    same = [" A b\r\nC ", "a b\tc", "A  B c\n"]
    assert len({one(spark, s, text.content_hash(F.col("x")))[0] for s in same}) == 1


@pytest.mark.parametrize(
    ("chunk", "level"),
    [
        ("short", "skip"), ("short with cookie", "cleanup"), ("x" * 1999, "skip"), ("x" * 2000, "cleanup"), ("x" * 2000 + "\n|a|\n|b|\n", "heavy"), ("x" * 2000 + "\n|a|\n|-|\n", "cleanup"),
        ("cookie $x$", "heavy"), ("cookie $x$ for $5", "cleanup"), ("```" + "c" * 94 + "```" + "cookie", "skip"), ("", "skip"),
    ],
)
def test_levels(spark, chunk, level):
    assert one(spark, chunk, text.cleanup_level(F.col("x"))) == [level]


def test_tokens_and_time(spark):
    t = text.token_estimate(F.col("x"))
    assert one(spark, "", t, text.cleanup_timeout(t)) == [1, 45]
    assert one(spark, "a" * 4000, t, text.cleanup_timeout(t)) == [1000, 85]


ALPHABET = st.sampled_from(["```", "\n", "#", "# ", "## x", "a", " ", "{", "}", "};", "|", "$", " ", "\r", "Next", "cookie", "b" * 60])
TEXTS = st.lists(ALPHABET, max_size=25).map("".join)


def model_preclean(t: str) -> str:
    out, inside = [], False
    for line in t.split("\n"):
        bare = line.strip()
        if inside:
            inside = bare not in ("}", "};")
        elif bare == "{":
            inside = True
        elif not re.match(r"(?i)^\s*next\s*$", line):
            out.append(line)
    return re.sub(r"\n{3,}", "\n\n", "\n".join(out)).strip()


def model_sections(t: str) -> list[str] | None:
    masked = re.sub(r"```[\s\S]*?```", lambda m: " " * len(m[0]), t)
    at = [m.start() for m in re.finditer(r"(?m)^#{1,3}\s+", masked)]
    if len(at) < 2:
        return None
    found = [t[a:b].strip() for a, b in zip(at, [*at[1:], len(t)], strict=True)]
    return [s for s in found if len(s) >= 50] or None


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(TEXTS, min_size=40, max_size=60))
def test_models_agree(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "x string")
    x = F.col("x")
    for r in df.select("x", text.mask_code(x).alias("m"), text.code_density(x).alias("d"), lines.preclean(x).alias("p"), lines.heading_sections(x).alias("s")).collect():
        code = re.findall(r"```[\s\S]*?```", r.x)
        assert r.m == re.sub(r"```[\s\S]*?```", lambda m: " " * len(m[0]), r.x)
        assert r.d == (sum(map(len, code)) / len(r.x) if r.x else 0.0)
        assert r.p == model_preclean(r.x)
        assert r.s == model_sections(r.x)


def test_cut_by_size():
    body = "word " * 2000
    pieces = cut_by_size(body, 1000)
    assert all(50 <= len(p) <= 1000 for p in pieces) and pieces[0][-150:].strip() in pieces[1]
    assert cut_by_size("  ", 1000) == [] and cut_by_size("tiny", 1000) == ["tiny"]
    headed = "a" * 700 + "\n# next\n" + "b" * 900
    assert cut_by_size(headed, 1000)[1].endswith("b") and cut_by_size(headed, 1000)[0] == "a" * 700


def test_resolve_as_the_library_does(spark):
    base = "https://h.example/docs/v1/page.html?q=1#top"
    hrefs = ["x", "../x", "../../x", "../../../../x", "./x", "a/../b", ".", "..", "../", "/a/./b/../c", "/a/b/..", "//other.example/a", "?z=2", "x?y=../z", "#part", "x#a/../b", "https://k.example/a"]
    df = spark.createDataFrame([(base, h) for h in hrefs], "base string, href string")
    got = {r.href: r.u for r in df.select("href", urls.resolve(F.col("base"), F.col("href")).alias("u")).collect()}
    assert got == {h: urljoin(base, h) for h in hrefs}


def test_pieces_end_where_they_should():
    r = random.Random(4)
    for _ in range(300):
        body = "".join(r.choices(["word ", "\n", "\n\n", "\n# head ", "x" * 60], k=r.randint(1, 200)))
        for a, b in (found := list(spans(body, 400))):
            assert 0 < b - a <= 400
            own, half = body[a:b], 200
            if b < len(body):
                best = [own.rfind(m, half if m == "\n#" else half + 1) for m in ("\n#", "\n\n", "\n")]
                tail = body[a : a + 400]
                heading, paragraph, line = (tail.rfind(m, half + (m != "\n#")) for m in ("\n#", "\n\n", "\n"))
                assert len(own) == (heading + 1 if heading >= 0 else paragraph + 2 if paragraph >= 0 else line + 1 if line >= 0 else 400), best
        assert all(c == b - 200 for (_, b), (c, _) in zip(found, found[1:], strict=False)) and (not found or found[-1][1] == len(body))
