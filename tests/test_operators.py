"""Literal tests of operators, sources, plans and streams."""

import gzip
import http.server
import json
import os
import threading
import uuid

import pytest
from oracle import TABLES, compare
from pyspark.sql import functions as F

from pagemill.operators import graph, html, jobs, robots
from pagemill.plans.crawl import clean_chunks, crawl
from pagemill.queries.catalog import ORACLES, QUERIES
from pagemill.sources import sitemap, state, web
from pagemill.specs import JobSpec
from pagemill.streaming import flow


def allowed(spark, body, *paths):
    rules = robots.parse_robots(spark.createDataFrame([("h", body)], "host string, body string"))
    rows = robots.robots_allowed(spark.createDataFrame([(p, "https://h" + p, "h") for p in paths], "p string, url string, host string"), rules).collect()
    return {r.p: r.allowed for r in rows}


def test_robots_precedence(spark):
    got = allowed(spark, "User-agent: *\nDisallow: /\nAllow: /a\nDisallow: /a/b\nAllow: /c\nDisallow: /c", "/a", "/a/b", "/c", "/z")
    assert got == {"/a": True, "/a/b": False, "/c": True, "/z": False}
    assert allowed(spark, "User-agent: x\nDisallow: /", "/a") == {"/a": True}
    assert allowed(spark, "", "/a") == {"/a": True}


def test_crawl_delay(spark):
    rules = robots.parse_robots(spark.createDataFrame([("h", "user-agent: *\ncrawl-delay: 2\ncrawl-delay: x\ncrawl-delay: 3.5")], "host string, body string"))
    assert [tuple(r) for r in robots.crawl_delays(rules).collect()] == [("h", 3.5)]


def test_bfs_cap_and_depth(spark):
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("a", "d")], "src string, dst string")
    start = spark.createDataFrame([("a",)], "url string")
    level = lambda *a: {r.url: r.depth for r in graph.crawl_levels(start, links, *a).collect()}
    assert level(5) == {"a": 0, "b": 1, "d": 1, "c": 2}
    assert level(1) == {"a": 0, "b": 1, "d": 1} and level(0) == {"a": 0} and level(5, 2) == {"a": 0, "b": 1}


PAGE = """<html><head><title> T </title><style>x</style></head><body><nav><a href="/n">n</a></nav><main><h2>Head</h2><p>One <code>c</code> two</p><code>alone</code>
<pre><code class="x language-py">a
 b</code></pre><table><tr><th>k</th><td>v</td></tr></table><ul><li>a</li><li>b</li></ul><blockquote>q</blockquote><img src="i.png" alt="A"><img alt="none">bare
<span>short</span><span>a text of more than twenty characters</span></main><footer>f</footer></body></html>"""


def test_blocks():
    title, blocks = html.structured(PAGE)
    assert title == "T"
    assert [(b["type"], b["content"]) for b in blocks] == [
        ("heading", "Head"), ("paragraph", "One c two"), ("code", "alone"), ("code", "a\n b"), ("table", '[["k", "v"]]'), ("list", "a\nb"), ("blockquote", "q"), ("image", "i.png"),
        ("paragraph", "a text of more than twenty characters"),
    ]
    assert blocks[0]["level"] == 2 and blocks[3]["language"] == "py" and blocks[7]["alt"] == "A"


def test_markdown_and_selectors():
    md = html.html_to_markdown(PAGE)
    assert "## Head" in md and "```py\na\n b\n```" in md and "| k | v |" in md and "* a" in md and "<" not in md
    root = html.remove_noise(html.parse(PAGE), (".none",))
    assert "n</a>" not in root.html() and "<footer" not in root.html()
    assert html.extract_content(html.parse(PAGE), ()).startswith("<h2>")
    assert html.selector("div.a #b[c*='d']")
    with pytest.raises(ValueError):
        html.selector("a > b")
    with pytest.raises(ValueError):
        html.get_converter("nothing")


def test_bad_pages_are_rows(spark):
    html.register_converter("fails", lambda h: 1 / 0)
    rows = html.to_markdown(spark.createDataFrame([(1, "<p>x</p>"), (2, None)], "page_id long, html string"), converter="fails").orderBy("page_id").collect()
    assert rows[0].error.startswith("ZeroDivisionError") and rows[1].error is None and rows[1].markdown is None


SITEMAP = '<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">{}</urlset>'


def test_sitemaps(spark):
    index = '<sitemapindex xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><sitemap><loc>b</loc></sitemap><sitemap><loc>a</loc></sitemap></sitemapindex>'
    pages = SITEMAP.format("<url><loc> https://h/docs/x/ </loc></url><url><loc>https://o/docs/y</loc></url><url><loc>https://h/other</loc></url>")
    bodies = [("a", index.encode()), ("b", gzip.compress(pages.encode())), ("c", b"<urlset><url><loc>x"), ("d", b"\x1f\x8bbroken"), ("e", None)]
    df = spark.createDataFrame([(u, None if b is None else bytearray(b)) for u, b in bodies], "sitemap_url string, body binary")
    roots = spark.createDataFrame([("a",), ("c",), ("d",), ("missing",)], "sitemap_url string")
    assert [r.url for r in sitemap.site_urls(df, roots, F.lit("https://h/docs")).collect()] == ["https://h/docs/x"]
    assert sitemap.locations(b"<urlset><url><loc>x</loc></url></urlset>") == ([], [])
    assert sitemap.locations(b"<urlset><url><loc>x</loc></url></urlset>", any_namespace=True) == (["x"], [])
    lines = spark.createDataFrame([("h", "User-agent: *\nSitemap: https://h/s.xml\n")], "host string, body string")
    assert [r.sitemap_url for r in sitemap.robots_sitemaps(lines).collect()] == ["https://h/s.xml"]


def test_state(spark, tmp_path):
    row = spark.createDataFrame([("j", {"url": "u"}, ["a"], [], ["b"])], state.SCHEMA)
    state.save_state(row, str(tmp_path / "s"))
    assert state.load_state(spark, str(tmp_path / "s")).first().pending_urls == ["b"]
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "x.json").write_text('{"job_id": "j"}\n')
    with pytest.raises(ValueError, match="pending_urls"):
        state.load_state(spark, str(tmp_path / "t"))


def test_model_listing(spark):
    reply = json.dumps({"data": [{"id": "a:free"}, {"id": "b", "pricing": {"prompt": "0.1"}}, {"id": "c", "name": "Free c", "pricing": {"prompt": "1"}}]})
    got = spark.createDataFrame([(reply,), ("no",)], "r string").select(state.listed_models(F.col("r"), "openrouter").alias("m")).collect()
    assert [(m.name, m.is_free) for m in got[0].m] == [("a:free", True), ("b", False), ("c", True)] and got[1].m == []


def test_replies(spark):
    asked = spark.createDataFrame([(k, u, o) for k in range(6) for o, u in enumerate(["a", "b", "c"])], "k int, url string, ord int")
    replies = ['["c", "x", "a"]', '```json\n["b"]\n```', "nonsense", '{"a": 1}', '["a", "b"', '["x"]']
    got = jobs.apply_reply(asked, spark.createDataFrame(list(enumerate(replies)), "k int, reply string"), "k").orderBy("k", "pos").collect()
    by = {k: [r.url for r in got if r.k == k] for k in range(6)}
    assert by == {0: ["c", "a"], 1: ["b"], 2: ["a", "b", "c"], 3: ["a", "b", "c"], 4: ["a", "b", "c"], 5: []}


def test_cache_edges(spark):
    key = jobs.cache_key(F.col("url"))
    entries = spark.createDataFrame([("a", 100), ("b", 99)], "url string, s long").select(key.alias("key"), "url", F.lit("h").alias("html"), F.timestamp_seconds("s").alias("ts"))
    asked = spark.createDataFrame([("a",), ("b",), ("c",)], "url string")
    hit = lambda ttl: {r.url: r.hit for r in jobs.cache_lookup(asked, entries, F.timestamp_seconds(F.lit(110)), ttl).collect()}
    assert hit(10) == {"a": True, "b": False, "c": False} and hit(0) == {"a": True, "b": True, "c": False}


def test_states(spark):
    moves = [("pending", "running", True), ("paused", "completed", False), ("completed", "running", False), ("running", "paused", True)]
    df = spark.createDataFrame(moves, "a string, b string, ok boolean")
    assert df.filter(jobs.may_move(F.col("a"), F.col("b")) != F.col("ok")).count() == 0


@pytest.mark.parametrize("bad", [{"url": "ftp://x"}, {"delay_ms": 1}, {"output_path": "/data/../etc"}, {"noise_selectors": ("a{}",)}, {"proxy_url": "http://p"}, {"proxy_url": "https://127.0.0.1"}, {"converter": "none"}, {"pipeline_model": None}])
def test_spec_checks(bad):
    good = {"url": "https://h/", "pipeline_model": "m"}
    JobSpec(**good)
    with pytest.raises(ValueError):
        JobSpec(**good | bad)


def test_crawl_plan(spark):
    body = "<article><h1>{}</h1><p>" + "word " * 100 + "{}</p></article>"
    pages = [(1, "https://h/en/a", body.format("A", "")), (2, "https://h/en/b", body.format("A", "")), (3, "https://h/en/c", body.format("C", "captcha cloudflare")), (4, "https://h/de/d", body.format("D", "")), (5, "https://h/en/e", body.format("E", "our cookie"))]
    for n in (1, 6):
        df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(n)
        done = crawl(df, JobSpec(url="https://h/", pipeline_model="m"))
        assert {r.page_id: r.status for r in done.status().collect()} == {1: "ok", 2: "skipped", 3: "blocked", 5: "ok"}
        assert {r.page_id: r.file for r in done.documents.collect()} == {1: "en/a.md", 5: "en/e.md"}


def test_failing_cleaner_keeps_chunks(spark):
    def fails(chunk, level):
        raise RuntimeError("no")

    rows = clean_chunks(spark.createDataFrame([(1, "with cookie"), (2, "plain")], "id int, chunk string"), fails).orderBy("id").collect()
    assert [(r.cleaned, r.ok) for r in rows] == [("with cookie", False), ("plain", True)]


def test_stream_equals_batch(spark, tmp_path):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    pages.unionByName(pages).repartition(4).write.parquet(str(tmp_path / "in"))
    stream = flow.unique_pages(flow.read_pages(spark, str(tmp_path / "in"), 1, "*.parquet")).select("hash")
    got = flow.run_to_table(stream, f"t{uuid.uuid4().hex}", str(tmp_path / "ck"))
    want = flow.accepted_pages(pages).select("hash").distinct()
    assert sorted(r.hash for r in got.collect()) == sorted(r.hash for r in want.collect())


def parted_tables(spark, folder):
    """The smallest tables with pages in a folder of parts: every URL on two pages, two blocked pages of one text, a page without text."""
    for t in TABLES:
        if t != "pages":
            os.symlink(f"/root/testdata/sf0.001/{t}.parquet", folder / f"{t}.parquet")
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    n = pages.agg(F.max("page_id")).first()[0] + 1
    again = pages.withColumn("page_id", F.col("page_id") + n)
    odd = [(2 * n + k, "https://x.example.net/", h) for k, h in enumerate(["<p>Just a moment. Checking your browser: solve the captcha</p>"] * 2 + [None])]
    pages.unionByName(again).unionByName(spark.createDataFrame(odd, pages.schema)).repartition(3).write.parquet(str(folder / "pages.parquet"))
    return str(folder)


def test_stream_pipeline_reads_parts(spark, tmp_path):
    folder = parted_tables(spark, tmp_path)
    assert compare(spark, folder, QUERIES["stream_pipeline"], ORACLES["stream_pipeline"]) == ""
    pages = spark.read.parquet(f"{folder}/pages.parquet")
    assert flow.accepted_pages(pages).count() == pages.count() - 2


def test_stream_dedup_reads_parts(spark, tmp_path):
    assert compare(spark, parted_tables(spark, tmp_path), QUERIES["stream_dedup"], ORACLES["stream_dedup"]) == ""


def test_pending_urls_of_several_pages(spark, tmp_path):
    assert compare(spark, parted_tables(spark, tmp_path), QUERIES["pending_urls"], ORACLES["pending_urls"]) == ""


def test_pending_keys(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, None)], "page_id long, url string")
    left = lambda **key: sorted(r.page_id for r in jobs.pending(rows, rows.filter("page_id = 2"), rows.filter("page_id = 3"), **key).collect())
    assert left() == [4] and left(key="page_id") == [1, 4]


def test_live_source(spark):
    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            self.send_response(404 if self.path == "/gone" else 200)
            self.send_header("Content-Type", "text/markdown; charset=utf-8")
            self.send_header("x-markdown-tokens", "7")
            self.end_headers()
            self.wfile.write("# é".encode())

        def log_message(self, *a):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    root = f"http://127.0.0.1:{server.server_port}"
    spark.dataSource.register(web.WebSource)
    read = lambda **o: {r.url: r for r in spark.read.format("web").options(urls=json.dumps([root + "/a", root + "/gone"]), delay="0", tries="1", **o).load().collect()}
    open_ = read(allowPrivate="true")
    assert open_[root + "/a"].body == "# é" and open_[root + "/a"].tokens == 7 and open_[root + "/gone"].status == 404
    assert "not public" in read()[root + "/a"].error
    server.shutdown()


def test_pages_nested_to_any_depth():
    deep = "<div>" * 5000 + "<p>inside</p>" + "</div>" * 5000
    assert html.html_to_markdown(deep) == "inside"
    assert [b["content"] for b in html.structured("<body>" + deep)[1]] == ["inside"]
    assert "450" in html.html_to_markdown("<ul>" + "".join(f"<li>{k}" for k in range(451)))


def test_links_of_the_tree():
    page = """<nav><ul><li><a href='/one'>1</a></ul></nav><div class="x sidebar"><p><a href=/two>2</a></div><div role='navigation'><a href="#f">f</a></div>
    <a href='mailto:x@y'>m</a><a href="/three?a=1&amp;b=2">3</a><a>none</a><a href="JavaScript:x">s</a>"""
    assert html.links_of(page) == (["/one", "/two"], ["/one", "/two", "/three?a=1&b=2"])


def test_sitemap_indexes_of_any_depth(spark):
    space = 'xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"'
    index = lambda *u: f"<sitemapindex {space}>" + "".join(f"<sitemap><loc>{x}</loc></sitemap>" for x in u) + "</sitemapindex>"
    bodies = [(f"https://h/s{k}", index(f"https://h/s{k + 1}", "https://h/s0")) for k in range(8)] + [("https://h/s8", f"<urlset {space}><url><loc>https://h/docs/a</loc></url></urlset>")]
    df = spark.createDataFrame(bodies, "sitemap_url string, body string")
    found = sitemap.site_urls(df, df.filter("sitemap_url = 'https://h/s0'"), F.lit("https://h/"))
    assert [r.url for r in found.collect()] == ["https://h/docs/a"]
