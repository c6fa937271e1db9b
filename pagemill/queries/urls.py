"""Queries on URLs (F rows, J1, J7-J9, A3, S1-S5, U1, U4) over varied pages and inline values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.functions import models, urls
from pagemill.operators import jobs, robots
from pagemill.queries.common import VARIED_PAGES, table, varied_pages
from pagemill.sources import sitemap

QUERIES, ORACLES = {}, {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


P = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"
SCHEME, AUTHORITY = (lambda u: f"lower(regexp_extract({u}, '{P}', 1))"), (lambda u: f"regexp_extract({u}, '{P}', 2)")
WHOLE, QUERY = (lambda u: f"regexp_extract({u}, '{P}', 3)"), (lambda u: f"regexp_extract({u}, '{P}', 4)")
PATH = lambda u: f"regexp_replace({WHOLE(u)}, ';[^/]*$', '')"
BARE = lambda u: f"rtrim({PATH(u)}, '/')"
NORMALIZED = lambda u: (
    f"CASE WHEN {SCHEME(u)} IN ('http', 'https', '') THEN CASE WHEN {SCHEME(u)} <> '' THEN {SCHEME(u)} || ':' ELSE '' END || CASE WHEN {AUTHORITY(u)} <> '' THEN '//' || lower({AUTHORITY(u)}) ELSE '' END"
    f" || CASE WHEN {PATH(u)} = '/' THEN '/' ELSE {BARE(u)} END || regexp_extract({WHOLE(u)}, ';[^/]*$', 0) || CASE WHEN {QUERY(u)} <> '' THEN '?' || {QUERY(u)} ELSE '' END ELSE {u} END"
)
CANONICAL = lambda u: f"{SCHEME(u)} || '://' || {AUTHORITY(u)} || {BARE(u)}"
EXTENSION = f"regexp_matches(lower({BARE('url')}), '\\.({'|'.join(urls.EXCLUDED_EXTENSIONS)})$')"
PATTERN = f"regexp_matches(lower({BARE('url')}), '{'|'.join(urls.EXCLUDED_PATTERNS)}')"


def _language(language: str) -> str:
    own = "|".join(urls.LANGUAGE_PATTERNS[language])
    other = "|".join(p for k, v in urls.LANGUAGE_PATTERNS.items() if k != language for p in v)
    every = "|".join(p for v in urls.LANGUAGE_PATTERNS.values() for p in v)
    low = f"lower({BARE('url')})"
    return f"CASE WHEN regexp_matches({low}, '{own}') THEN true WHEN regexp_matches({low}, '{other}') THEN false ELSE NOT regexp_matches(lower({PATH('base')}), '{every}') END"


SAME = f"{AUTHORITY('url')} = {AUTHORITY('base')}"
UNDER = f"starts_with({BARE('url')}, {BARE('base')})"


@query(f"SELECT page_id, {NORMALIZED('url')} AS url_norm FROM {VARIED_PAGES}")
def url_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return varied_pages(spark, sf_dir).select("page_id", urls.normalize(F.col("url")).alias("url_norm"))


@query(f"SELECT page_id, {CANONICAL('url')} AS url_canon FROM {VARIED_PAGES}")
def url_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return varied_pages(spark, sf_dir).select("page_id", urls.canonical(F.col("url")).alias("url_canon"))


@query(f"SELECT page_id, url FROM {VARIED_PAGES} WHERE {SAME}")
def url_domain_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return varied_pages(spark, sf_dir).filter(urls.same_domain(F.col("url"), F.col("base"))).select("page_id", "url")


@query(f"SELECT page_id, url FROM {VARIED_PAGES} WHERE {UNDER}")
def url_path_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return varied_pages(spark, sf_dir).filter(urls.under_path(F.col("url"), F.col("base"))).select("page_id", "url")


@query(f"SELECT page_id, url FROM {VARIED_PAGES} WHERE NOT {EXTENSION}")
def url_extension_exclude(spark: SparkSession, sf_dir: str) -> DataFrame:
    return varied_pages(spark, sf_dir).filter(~urls.has_excluded_extension(F.col("url"))).select("page_id", "url")


@query(f"SELECT page_id, url FROM {VARIED_PAGES} WHERE NOT {PATTERN}")
def url_pattern_exclude(spark: SparkSession, sf_dir: str) -> DataFrame:
    return varied_pages(spark, sf_dir).filter(~urls.has_excluded_pattern(F.col("url"))).select("page_id", "url")


@query(f"SELECT page_id, {_language('en')} AS en, {_language('de')} AS de FROM {VARIED_PAGES}")
def url_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    matches = lambda name: urls.matches_language(F.col("url"), name, F.col("base")).alias(name)
    return varied_pages(spark, sf_dir).select("page_id", matches("en"), matches("de"))


@query(f"SELECT DISTINCT {CANONICAL('url')} AS url FROM {VARIED_PAGES} WHERE {SAME} AND {UNDER} AND NOT {EXTENSION} AND NOT {PATTERN} AND {_language('en')}")
def url_filter_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(varied_pages(spark, sf_dir), F.col("base")).orderBy("url")


_REST = f"trim(CASE WHEN {UNDER.replace(BARE('url'), PATH('url'))} THEN substring({PATH('url')}, length({BARE('base')}) + 1) ELSE {PATH('url')} END, '/')"


@query(
    f"SELECT page_id, CASE WHEN contains(list_last(string_split(n, '/')), '.') THEN regexp_replace(n, '\\.[^.]*$', '') ELSE n END || '.md' AS file"
    f" FROM (SELECT page_id, CASE WHEN r = '' THEN 'index' ELSE r END AS n FROM (SELECT page_id, {_REST} AS r FROM {VARIED_PAGES}))"
)
def url_filepath(spark: SparkSession, sf_dir: str) -> DataFrame:
    return varied_pages(spark, sf_dir).select("page_id", urls.file_path(F.col("url"), F.col("base")).alias("file"))


@query(
    f"SELECT E'# Documentation Index\\n\\n' || string_agg('- [' || CASE WHEN list_last(string_split(p, '/')) = '' THEN 'Home' ELSE list_last(string_split(p, '/')) END || '](' || CASE WHEN p = '' THEN 'index' ELSE p END || '.md)', chr(10) ORDER BY page_id) AS markdown"
    f" FROM (SELECT page_id, trim({PATH('url')}, '/') AS p FROM {VARIED_PAGES})"
)
def url_index_md(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.index_markdown(varied_pages(spark, sf_dir), "page_id")


ROBOTS = "User-agent: other\nDisallow: /\nUSER-AGENT: *\nDisallow: /en/\r\nAllow: /en/1\nDisallow:\nAllow: /en/\nCrawl-delay: slow\nCrawl-delay: 2.5\nDisallow: /fr\n# note\nDisallow: /de/2\nAllow: /de/22\nUser-agent: last\nDisallow: /es"
RULES = (("disallow", "/en/"), ("allow", "/en/1"), ("allow", "/en/"), ("disallow", "/fr"), ("disallow", "/de/2"), ("allow", "/de/22"))


def _rules(spark: SparkSession) -> DataFrame:
    return robots.parse_robots(spark.createDataFrame([("*", ROBOTS)], "host string, body string"))


@query("SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{r}')" for k, r in RULES) + ", ('crawl-delay', 'slow'), ('crawl-delay', '2.5')) AS t(kind, rule)")
def robots_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rules(spark).select("kind", "rule")


@query(
    f"SELECT page_id, coalesce(max(CASE WHEN kind = 'allow' THEN length(rule) END), -1) >= coalesce(max(CASE WHEN kind = 'disallow' THEN length(rule) END), -1) AS allowed"
    f" FROM (SELECT page_id, {PATH('url')} AS p FROM pages) LEFT JOIN (VALUES " + ", ".join(f"('{k}', '{r}')" for k, r in RULES) + ") AS t(kind, rule) ON starts_with(p, rule) GROUP BY page_id"
)
def robots_allowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.lit("*").alias("host"))
    return robots.robots_allowed(pages, _rules(spark)).select("page_id", "allowed")


@query(
    f"SELECT page_id, url FROM (SELECT page_id, url, {PATH('url')} AS p FROM pages) LEFT JOIN (VALUES " + ", ".join(f"('{k}', '{r}')" for k, r in RULES) + ") AS t(kind, rule) ON starts_with(p, rule) GROUP BY page_id, url"
    " HAVING coalesce(max(length(rule)) FILTER (kind = 'allow'), -1) >= coalesce(max(length(rule)) FILTER (kind = 'disallow'), -1)"
)
def robots_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.lit("*").alias("host"))
    return robots.robots_filter(pages, _rules(spark)).select("page_id", "url")


ROOT = "regexp_extract(url, '^(https?://[^/?#]*)', 1)"
#: Child sitemaps that a page's sitemap names: the tree of all has a level for each digit of the ids to this base.
CHILDREN = 16


@query(f"SELECT {AUTHORITY('url')} AS host, {ROOT} || '/map-' || page_id || '.xml' AS sitemap_url FROM pages WHERE page_id % 3 <> 2")
def robots_sitemaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A robots body a page, which names a sitemap in one of two spellings or none."""
    named = F.element_at(F.array(F.lit("Sitemap: "), F.lit("  sitemap:"), F.lit("# ")), (F.col("page_id") % 3 + 1).cast("int"))
    address = F.concat(F.regexp_extract("url", r"^(https?://[^/?#]*)", 1), F.lit("/map-"), F.col("page_id").cast("string"), F.lit(".xml"))
    body = F.concat(F.lit("User-agent: *\r\nDisallow: /x\n"), named, address, F.lit("\nAllow: /"))
    return sitemap.robots_sitemaps(table(spark, sf_dir, "pages").select(urls.authority(F.col("url")).alias("host"), body.alias("body")))


@query(f"SELECT DISTINCT {NORMALIZED('url')} AS url FROM pages WHERE page_id >= {CHILDREN} OR page_id % 5 <> 4")
def sitemap_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sitemap a page, which names the page and child sitemaps, itself or missing ones among them; some roots' pages are of another namespace."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    address = lambda k: F.concat(F.lit("map-"), k.cast("string"), F.lit(".xml"))
    children = F.transform(F.sequence(F.col("page_id") * CHILDREN, F.col("page_id") * CHILDREN + CHILDREN - 1), lambda k: F.concat(F.lit("<sitemap><loc> "), address(k), F.lit("</loc></sitemap>")))
    other = (F.col("page_id") < CHILDREN) & (F.col("page_id") % 5 == 4)
    page = F.concat(F.when(other, '<url xmlns="http://elsewhere.example.net/">').otherwise("<url>"), F.lit("<loc>"), F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit("</loc></url>"))
    body = F.concat(F.lit(f'<sitemapindex xmlns="{sitemap.NAMESPACE}">'), page, F.array_join(children, ""), F.lit("</sitemapindex>"))
    roots = pages.filter(F.col("page_id") < CHILDREN).select(address(F.col("page_id")).alias("sitemap_url"))
    return sitemap.site_urls(pages.select(address(F.col("page_id")).alias("sitemap_url"), body.alias("body")), roots, F.regexp_extract("url", r"^(https?://[^/?#]*)", 1))


@query("SELECT page_id, greatest((page_id % 5) * 700 / 1000.0, coalesce(CASE WHEN page_id % 3 = 0 THEN NULL WHEN page_id % 3 = 1 THEN 0.0 ELSE 1.5 END, 0.0))::DOUBLE AS delay FROM pages")
def effective_delay(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = F.when(F.col("page_id") % 3 == 1, 0.0).when(F.col("page_id") % 3 == 2, 1.5)
    return table(spark, sf_dir, "pages").select("page_id", urls.effective_delay((F.col("page_id") % 5) * 700, given).alias("delay"))


ADDRESSES = {
    "http://127.0.0.1/": True, "https://10.1.2.3:8080/x": True, "http://172.15.0.1": False, "http://172.31.255.255/": True, "http://192.168.0.9/": True, "http://169.254.169.254/": True,
    "http://8.8.8.8/": False, "http://user@10.0.0.1/": True, "https://docs.example.net/": False, "http://300.1.1.1/": False, "http://[::1]/": True, "/no/host": None,
}


@query("SELECT * FROM (VALUES " + ", ".join(f"('{u}', {'NULL' if b is None else str(b).lower()})" for u, b in ADDRESSES.items()) + ") AS t(url, private)")
def ssrf_literal_ip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(u,) for u in ADDRESSES], "url string").select("url", urls.targets_private_address(F.col("url")).alias("private"))


MODELS = ("mistral:7b", "openrouter/meta:free", "opencode/Free-x", "qwen/qwen3", "lmstudio/a", "openrouter/paid", "opencode/paid", "llama")
_MODELS = "(SELECT * FROM (VALUES " + ", ".join(f"('{m}')" for m in MODELS) + ") AS t(model))"
_PROVIDER = "CASE WHEN contains(model, '/') AND split_part(model, '/', 1) IN ('ollama', 'openrouter', 'opencode', 'lmstudio', 'llamacpp') THEN split_part(model, '/', 1) ELSE 'ollama' END"


@query(f"SELECT model, {_PROVIDER} AS provider FROM {_MODELS}")
def model_provider(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(m,) for m in MODELS], "model string").select("model", models.provider(F.col("model")).alias("provider"))


@query(
    "SELECT model, CASE WHEN p IN ('ollama', 'lmstudio', 'llamacpp') THEN true WHEN p = 'openrouter' THEN contains(model, ':free')"
    f" WHEN p = 'opencode' THEN contains(lower(model), 'free') ELSE false END AS is_free FROM (SELECT model, {_PROVIDER} AS p FROM {_MODELS})"
)
def model_is_free(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(m,) for m in MODELS], "model string").select("model", models.is_free(F.col("model"), models.provider(F.col("model"))).alias("is_free"))


@query("SELECT * FROM (VALUES ('gemma:2b'), ('phi')) AS t(model)")
def model_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = spark.createDataFrame([("mistral:7b",), ("gemma:2b",), ("llama",), ("phi",), ("exact",)], "model string")
    have = spark.createDataFrame([("mistral:latest",), ("llama:8b",), ("exact",), ("phi3:mini",)], "name string")
    return models.missing_models(wanted, have)


_STEPS = (("domain", SAME), ("path", UNDER), ("extension", f"NOT {EXTENSION}"), ("pattern", f"NOT {PATTERN}"), ("language", _language("en")))


@query(
    "WITH t AS (SELECT " + ", ".join(f"({sql}) AS c{k}" for k, (_, sql) in enumerate(_STEPS)) + f" FROM {VARIED_PAGES}) "
    + " UNION ALL ".join(
        f"SELECT {k} AS ord, '{name}' AS stage, count(*) FILTER ({' AND '.join(['true', *(f'c{j}' for j in range(k))])}) AS before, count(*) FILTER ({' AND '.join(f'c{j}' for j in range(k + 1))}) AS after,"
        f" count(*) FILTER ({' AND '.join(['true', *(f'c{j}' for j in range(k))])}) - count(*) FILTER ({' AND '.join(f'c{j}' for j in range(k + 1))}) AS removed FROM t"
        for k, (name, _) in enumerate(_STEPS)
    )
)
def url_attrition(spark: SparkSession, sf_dir: str) -> DataFrame:
    u, b = F.col("url"), F.col("base")
    tests = (urls.same_domain(u, b), urls.under_path(u, b), ~urls.has_excluded_extension(u), ~urls.has_excluded_pattern(u), urls.matches_language(u, "en", b))
    return jobs.attrition(varied_pages(spark, sf_dir), [(name, test) for (name, _), test in zip(_STEPS, tests, strict=True)])
