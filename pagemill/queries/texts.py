"""Queries on texts (T8-T25, F15, A5, A7, A8, D2, W1, W2, W4) over documents with decorations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.functions import lines, text
from pagemill.operators import chunk, dedup
from pagemill.queries.common import DECORATED, decorated, table

QUERIES, ORACLES = {}, {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


STRIP = lambda x: rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"
HASH = lambda x: rf"md5(regexp_replace({STRIP(f'lower({x})')}, '\s+', ' ', 'g'))"
VOTES = lambda x, patterns, flags="": " + ".join(f"CAST(regexp_matches({x}, {quoted(flags + p)}) AS INTEGER)" for p in patterns)
DENSITY = r"coalesce(list_sum(list_transform(regexp_extract_all(text, '```[\s\S]*?```'), lambda x: length(x))), 0) / length(text)"
BROKEN = r"(len(regexp_extract_all(text, '(?m)^\|.+\|$')) >= 2 AND len(regexp_extract_all(text, '(?m)^\|[\s\-:|]+\|$')) = 0)"
SIGNS = f"({VOTES('text', text.LATEX_PATTERNS)})"
LATEX = f"({SIGNS} > 1 OR ({SIGNS} = 1 AND NOT regexp_matches(text, {quoted(text.PRICE_PATTERN)})))"
NOISE = f"regexp_matches(lower(text), {quoted('|'.join(text.NOISE_PHRASES))})"
LEVEL = f"CASE WHEN {DENSITY} > 0.6 THEN 'skip' WHEN length(text) < 2000 AND NOT {NOISE} THEN 'skip' WHEN {BROKEN} OR {LATEX} THEN 'heavy' ELSE 'cleanup' END"
RATIO = lambda d: f"CASE WHEN {d} > 0.5 THEN 3.0 WHEN {d} > 0.2 THEN 3.5 ELSE 4.0 END"
TOKENS = f"greatest(1, CAST(floor(length(text) / CAST({RATIO(DENSITY)} AS DOUBLE)) AS INTEGER))"
CLEAN = (
    f"{STRIP(rf'''regexp_replace(regexp_replace(regexp_replace(regexp_replace(text || chr(10), {quoted('(?sm)' + lines.BRACE_BLOCK)}, '', 'g'), {quoted('(?m)' + lines.NOISE_LINE)}, '', 'g'), '\n$', ''), '\n{{3,}}', chr(10) || chr(10), 'g')''')}"
)
MASKED = (
    "(SELECT CASE WHEN len(s) % 2 = 0 THEN array_to_string(s[1:len(s) - 1], '') || '```' || s[len(s)] ELSE array_to_string(s, '') END FROM (SELECT list_transform(p, lambda x, i:"
    " CASE WHEN i % 2 = 0 AND i < len(p) THEN repeat(' ', length(x) + 6) ELSE x END) AS s FROM (SELECT string_split(text, '```') AS p)))"
)


@query(f"SELECT doc_id, {HASH('text')} AS hash FROM documents")
def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.content_hash(F.col("text")).alias("hash"))


@query(f"SELECT min(doc_id) AS doc_id, {HASH('text')} AS hash, count(*) AS copies FROM documents GROUP BY 2")
def content_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", text.content_hash(F.col("text")).alias("hash"))
    first = dedup.first_by(docs, F.col("hash"), F.col("doc_id"))
    return first.join(docs.groupBy("hash").agg(F.count("*").alias("copies")), "hash").select("doc_id", "hash", "copies")


@query(f"SELECT doc_id, ({VOTES('text', text.BLOCKED_PATTERNS, '(?i)')}) AS signs, ({VOTES('text', text.BLOCKED_PATTERNS, '(?i)')}) >= 2 AS blocked FROM {DECORATED}")
def blocked_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return decorated(spark, sf_dir).select("doc_id", text.count_patterns(t, text.BLOCKED_PATTERNS, "(?i)").alias("signs"), text.is_blocked(t).alias("blocked"))


@query(f"SELECT doc_id, CAST({DENSITY} AS DOUBLE) AS density FROM {DECORATED}")
def code_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decorated(spark, sf_dir).select("doc_id", text.code_density(F.col("text")).alias("density"))


@query(f"SELECT doc_id, {TOKENS} AS tokens FROM {DECORATED}")
def token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decorated(spark, sf_dir).select("doc_id", text.token_estimate(F.col("text")).alias("tokens"))


@query(f"SELECT doc_id, {LATEX} AS latex FROM {DECORATED}")
def has_latex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decorated(spark, sf_dir).select("doc_id", text.has_latex(F.col("text")).alias("latex"))


@query(f"SELECT doc_id, {BROKEN} AS broken FROM {DECORATED}")
def broken_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decorated(spark, sf_dir).select("doc_id", text.has_broken_tables(F.col("text")).alias("broken"))


@query(f"SELECT doc_id, {LEVEL} AS level, {LEVEL} <> 'skip' AS needs FROM {DECORATED}")
def classify_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return decorated(spark, sf_dir).select("doc_id", text.cleanup_level(t).alias("level"), text.needs_cleanup(t).alias("needs"))


@query(f"SELECT conv_id, turn, {LEVEL} AS level FROM conversations")
def classify_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.cleanup_level(F.col("text")).alias("level"))


@query(f"SELECT doc_id, greatest(2048, {TOKENS} + 1024) AS num_ctx, least({TOKENS} + 512, 4096) AS num_predict, CAST(0.1 AS DOUBLE) AS temperature, 1024 AS num_batch FROM {DECORATED}")
def cleanup_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decorated(spark, sf_dir).select("doc_id", text.cleanup_options(text.token_estimate(F.col("text"))).alias("o")).select("doc_id", "o.*")


@query(f"SELECT doc_id, least(CAST(floor(45 + {TOKENS} / 250.0 * 10) AS INTEGER), 90) AS timeout FROM {DECORATED}")
def cleanup_timeout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decorated(spark, sf_dir).select("doc_id", text.cleanup_timeout(text.token_estimate(F.col("text"))).alias("timeout"))


@query(f"SELECT doc_id, CASE WHEN {LEVEL} = 'heavy' THEN {quoted(text.HEAVY_PROMPT)} ELSE {quoted(text.CLEANUP_PROMPT)} END || '<document>' || chr(10) || text || chr(10) || '</document>' AS prompt FROM {DECORATED}")
def cleanup_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decorated(spark, sf_dir).select("doc_id", text.cleanup_prompt(F.col("text")).alias("prompt"))


@query(
    f"SELECT host, greatest(4096, {TOKENS} + 1324) AS num_ctx, least(n * 20 + 256, 4096) AS num_predict"
    " FROM (SELECT regexp_extract(url, '^https?://([^/?#]*)', 1) AS host, string_agg(url, chr(10) ORDER BY url) AS text, count(*) AS n FROM pages GROUP BY 1)"
)
def filter_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select(F.regexp_extract("url", "^https?://([^/?#]*)", 1).alias("host"), "url")
    listed = pages.groupBy("host").agg(F.array_join(F.array_sort(F.collect_list("url")), "\n").alias("text"), F.count("*").alias("n"))
    return listed.select("host", text.filter_options(text.token_estimate(F.col("text")), F.col("n")).alias("o")).select("host", "o.*")


@query(f"SELECT page_id, least(CAST(floor(length(html) / 3.0) AS INTEGER) + 2048, 131072) AS num_ctx FROM pages")
def conversion_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.conversion_context(F.col("html")).alias("num_ctx"))


@query("SELECT doc_id, CASE WHEN strlen(text) >= 1024 THEN format('{:.1f} KB', strlen(text) / 1024.0) ELSE strlen(text) || ' B' END AS label FROM documents")
def size_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.size_label(F.col("text")).alias("label"))


@query(f"SELECT doc_id, {CLEAN} AS text FROM {DECORATED}")
def preclean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decorated(spark, sf_dir).select("doc_id", lines.preclean(F.col("text")).alias("text"))


@query(f"SELECT doc_id, {MASKED} AS masked FROM {DECORATED}")
def mask_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decorated(spark, sf_dir).select("doc_id", text.mask_code(F.col("text")).alias("masked"))


def _sections(source: str) -> str:
    """(doc_id, sec, section, n_headings, text) of source(doc_id, text), before short ones are dropped."""
    return rf"""(SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY place) - 1 AS sec, {STRIP("substring(text, CAST(place + 1 AS BIGINT), CAST(lead(place, 1, length(text)) OVER (PARTITION BY doc_id ORDER BY place) - place AS BIGINT))")} AS section,
 count(*) OVER (PARTITION BY doc_id) AS n_headings FROM (SELECT doc_id, text, line, sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - length(line) - 1 AS place
 FROM (SELECT doc_id, text, unnest(string_split(m, chr(10))) AS line, generate_subscripts(string_split(m, chr(10)), 1) AS k FROM (SELECT doc_id, text, {MASKED} AS m FROM {source}))) WHERE regexp_matches(line, '^#{{1,3}}\s'))"""


@query(f"SELECT doc_id, section FROM {_sections(DECORATED)} WHERE n_headings >= 2 AND length(section) >= 50")
def heading_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decorated(spark, sf_dir).select("doc_id", F.explode(lines.heading_sections(F.col("text"))).alias("section"))


def _cut(source: str, size: int) -> str:
    """(doc_id, sec, ix, chunk) of source(doc_id, sec, text) cut by size."""
    last = lambda w, mark, at: f"CASE WHEN strpos(reverse({w}), reverse({mark})) > 0 THEN {at} + length({w}) - strpos(reverse({w}), reverse({mark})) - length({mark}) + 1 ELSE -1 END"
    return rf"""(WITH RECURSIVE cut(doc_id, sec, text, pos, ix, chunk) AS (SELECT doc_id, sec, text, CAST(0 AS BIGINT), 0, CASE WHEN length(text) <= {size} AND {STRIP('text')} <> '' THEN text END FROM {source}
 UNION ALL SELECT doc_id, sec, text, CAST(CASE WHEN e < n THEN e - 200 ELSE e END AS BIGINT), ix + 1, {STRIP('substring(text, CAST(pos + 1 AS BIGINT), CAST(e - pos AS BIGINT))')}
 FROM (SELECT *, CASE WHEN e0 >= n THEN e0 WHEN h > pos THEN h + 1 WHEN p > half THEN p + 2 WHEN l > half THEN l + 1 ELSE e0 END AS e
 FROM (SELECT *, {last('wh', "(chr(10) || '#')", 'half')} AS h, {last('wa', '(chr(10) || chr(10))', 'pos')} AS p, {last('wa', 'chr(10)', 'pos')} AS l
 FROM (SELECT *, substring(text, half + 1, e0 - half) AS wh, substring(text, pos + 1, e0 - pos) AS wa FROM (SELECT *, length(text) AS n, CAST(least(pos + {size}, length(text)) AS BIGINT) AS e0, CAST(pos + {size // 2} AS BIGINT) AS half FROM cut WHERE length(text) > {size} AND pos < length(text))))))
 SELECT doc_id, sec, ix, chunk FROM cut WHERE chunk IS NOT NULL AND (ix = 0 OR length(chunk) >= 50))"""


def _numbered(chunks: DataFrame) -> DataFrame:
    return chunks.select("doc_id", F.posexplode("chunks").alias("ix", "chunk"))


def _ordered(source: str) -> str:
    return f"(SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY sec, ix) - 1 AS ix, chunk FROM {source})"


@query(f"SELECT * FROM {_ordered(_cut(f'(SELECT doc_id, 0 AS sec, text FROM {DECORATED})', 1000))}")
def size_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _numbered(chunk.size_chunks(decorated(spark, sf_dir), F.col("text"), 1000))


_CLEANED = f"(SELECT doc_id, {CLEAN} AS text FROM {DECORATED})"
_LONG = f"(SELECT * FROM {_CLEANED} WHERE length(text) > 1500)"
_ROUTED = f"""(WITH s AS (SELECT doc_id, sec, section AS text FROM {_sections(_LONG)} WHERE n_headings >= 2 AND length(section) >= 50)
 SELECT * FROM s UNION ALL SELECT doc_id, 0, text FROM {_CLEANED} WHERE length(text) <= 1500 OR doc_id NOT IN (SELECT doc_id FROM s))"""


@query(f"SELECT * FROM {_ordered(_cut(_ROUTED, 1500))}")
def chunk_routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _numbered(chunk.chunk_markdown(decorated(spark, sf_dir), F.col("text"), 1500))


@query(f"SELECT doc_id, string_agg(chunk, chr(10) || chr(10) ORDER BY ix) AS markdown FROM {_ordered(_cut(_ROUTED, 1500))} GROUP BY doc_id")
def chunk_reassemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk.reassemble(_numbered(chunk.chunk_markdown(decorated(spark, sf_dir), F.col("text"), 1500)), "doc_id", "ix", "chunk")
