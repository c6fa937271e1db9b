"""URL expressions: split, normalise, compare and map to files, all as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Groups: scheme, authority, path with parameters, query.
PARTS = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"
#: Parameters stand after the first semicolon of the last path segment.
PARAMETERS = r";[^/]*$"
MOST_CHARS = 2000

# They must equal the reference's for the same rows to pass.
EXCLUDED_EXTENSIONS = (
    "pdf", "zip", "tar", "gz", "rar", "png", "jpg", "jpeg", "gif", "svg", "ico", "webp", "mp4", "mp3", "wav", "avi", "mov",
    "doc", "docx", "xls", "xlsx", "ppt", "pptx", "exe", "dmg", "deb", "rpm",
)
EXCLUDED_PATTERNS = ("/blog/", "/changelog/", "/api-reference/", "/releases/", "/download/", "/assets/")
LANGUAGE_PATTERNS = {
    "en": ("/en/", "/en-us/", "/en-gb/", "/en-au/", "/en-ca/", "/en-in/", "/english/"),
    "es": ("/es/", "/es-es/", "/es-mx/", "/es-ar/", "/es-cl/", "/es-co/", "/spanish/"),
    "fr": ("/fr/", "/fr-fr/", "/fr-ca/", "/french/"),
    "de": ("/de/", "/de-de/", "/de-at/", "/de-ch/", "/german/"),
    "ja": ("/ja/", "/jp/", "/japanese/"),
    "zh": ("/zh/", "/zh-cn/", "/zh-tw/", "/zh-hk/", "/chinese/"),
    "pt": ("/pt/", "/pt-br/", "/pt-pt/", "/portuguese/"),
    "ru": ("/ru/", "/russian/"),
    "ko": ("/ko/", "/kr/", "/korean/"),
}
PRIVATE_NETWORKS = ("127.0.0.0/8", "10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "169.254.0.0/16")


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, PARTS, 1))


def authority(url: Column) -> Column:
    return F.regexp_extract(url, PARTS, 2)


def path(url: Column) -> Column:
    """The path without parameters."""
    return F.regexp_replace(F.regexp_extract(url, PARTS, 3), PARAMETERS, "")


def query(url: Column) -> Column:
    return F.regexp_extract(url, PARTS, 4)


def bare_path(url: Column) -> Column:
    """The path without trailing slashes."""
    return F.regexp_replace(path(url), "/+$", "")


def normalize(url: Column) -> Column:
    """cut to 2000 characters, lower scheme and authority, no trailing slash but the root's, no fragment."""
    cut = F.substring(url, 1, MOST_CHARS)
    kept = F.when(path(cut) == "/", F.lit("/")).otherwise(bare_path(cut))
    parameters = F.regexp_extract(F.regexp_extract(cut, PARTS, 3), PARAMETERS, 0)
    front = F.concat(F.when(scheme(cut) != "", F.concat(scheme(cut), F.lit(":"))).otherwise(""), F.when(authority(cut) != "", F.concat(F.lit("//"), F.lower(authority(cut)))).otherwise(""))
    back = F.when(query(cut) != "", F.concat(F.lit("?"), query(cut))).otherwise("")
    return F.when(scheme(cut).isin("http", "https", ""), F.concat(front, kept, parameters, back)).otherwise(cut)


def canonical(url: Column) -> Column:
    """scheme, authority and bare path."""
    return F.concat(scheme(url), F.lit("://"), authority(url), bare_path(url))


def same_domain(url: Column, base: Column) -> Column:
    """equal authorities, case and port included."""
    return authority(url) == authority(base)


def under_path(url: Column, base: Column) -> Column:
    """the bare path begins with the base's, as plain text."""
    return bare_path(url).startswith(bare_path(base))


def has_excluded_extension(url: Column) -> Column:
    """F4."""
    return bare_path(url).rlike(r"(?i)\.(?:" + "|".join(EXCLUDED_EXTENSIONS) + ")$")


def has_excluded_pattern(url: Column) -> Column:
    """F5."""
    return F.lower(bare_path(url)).rlike("|".join(EXCLUDED_PATTERNS))


def _has_language(text: Column, languages) -> Column:
    return text.rlike("|".join(p for name in languages for p in LANGUAGE_PATTERNS.get(name, (f"/{name}/",))))


def matches_language(url: Column, language: str, base: Column) -> Column:
    """the target language's pattern wins, then another's loses; without either the base decides."""
    if language == "all":
        return F.lit(True)
    low = F.lower(bare_path(url))
    others = [name for name in LANGUAGE_PATTERNS if name != language]  # U4
    return F.when(_has_language(low, [language]), True).when(_has_language(low, others), False).otherwise(~_has_language(F.lower(path(base)), LANGUAGE_PATTERNS))


def accepted(url: Column, base: Column, language: str = "en") -> Column:
    """F2-F6 together, the cheap ones first."""
    return same_domain(url, base) & under_path(url, base) & ~has_excluded_extension(url) & ~has_excluded_pattern(url) & matches_language(url, language, base)


def filter_urls(urls: DataFrame, base: Column, language: str = "en", url_col: str = "url") -> DataFrame:
    """F8: the canonical URLs that pass all filters, each once."""
    return urls.filter(accepted(F.col(url_col), base, language)).select(canonical(F.col(url_col)).alias("url")).distinct()


def effective_delay(delay_ms: Column, crawl_delay: Column) -> Column:
    """seconds between requests; a crawl delay of null or 0 does not count."""
    return F.greatest(delay_ms / 1000.0, F.coalesce(crawl_delay, F.lit(0.0)))


def resolve(base: Column, href: Column) -> Column:
    """an href made absolute: absolute, scheme-relative, rooted, sibling, query-only and fragment-only ones, dot segments resolved."""
    root = F.concat(scheme(base), F.lit("://"), authority(base))
    folder = F.regexp_replace(path(base), "[^/]*$", "")
    front, back = F.regexp_extract(href, "^[^?#]*", 0), F.regexp_extract(href, "(?s)[?#].*$", 0)
    joined = lambda p: F.concat(root, without_dots(p), back)
    return (
        F.when(F.regexp_extract(href, PARTS, 1) != "", href)
        .when(href.startswith("//"), F.concat(scheme(base), F.lit(":"), href))
        .when(href.startswith("/"), joined(front))
        .when(href == "", base)
        .when(href.startswith("?"), F.concat(root, path(base), href))
        .when(href.startswith("#"), F.concat(F.regexp_extract(base, "^[^#]*", 0), href))
        .otherwise(joined(F.concat(F.when(folder == "", "/").otherwise(folder), front)))
    )


def without_dots(path_: Column) -> Column:
    """An absolute path without `.` and `..` segments; those that lead above the root go."""
    def kept(parts: Column) -> Column:
        up = lambda a: F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(1)))
        step = lambda a, s: F.when(s == ".", a).when(s == "..", up(a)).otherwise(F.concat(a, F.array(s)))
        whole = F.aggregate(parts, F.array().cast("array<string>"), step)
        return F.concat(F.array_join(whole, "/"), F.when(F.element_at(parts, -1).isin(".", ".."), "/").otherwise(""))

    return F.when(path_.rlike(r"/\.\.?(/|$)"), kept(F.split(path_, "/"))).otherwise(path_)


def file_path(url: Column, base: Column) -> Column:
    """the file of a page below the output folder."""
    own, front = path(url), bare_path(base)
    rest = F.when(own.startswith(front), F.substr(own, F.length(front) + 1)).otherwise(own)
    rest = F.regexp_replace(rest, "^/+|/+$", "")
    named = F.when(rest == "", "index").otherwise(rest)
    return F.concat(F.when(F.element_at(F.split(named, "/"), -1).contains("."), F.regexp_replace(named, r"\.[^.]*$", "")).otherwise(named), F.lit(".md"))


def ipv4_number(host: Column) -> Column:
    """A dotted quad as a number, null for other hosts."""
    parts = F.split(host, r"\.")
    number = sum((parts[k].cast("long") * (256 ** (3 - k)) for k in range(4)), F.lit(0))
    octet = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
    return F.when(host.rlike(rf"^{octet}(?:\.{octet}){{3}}$"), number)


def targets_private_address(url: Column) -> Column:
    """F16 for literal addresses: null without a host, false for names, whose resolution is left to the live source."""
    host = F.lower(F.regexp_replace(F.regexp_replace(authority(url), "^.*@", ""), r":\d*$", ""))
    number, inside = ipv4_number(host), F.lit(False)
    for network in PRIVATE_NETWORKS:
        address, bits = network.split("/")
        low = sum(int(x) << 8 * (3 - k) for k, x in enumerate(address.split(".")))
        inside = inside | number.between(low, low + (1 << 32 - int(bits)) - 1)
    six = host.rlike(r"^\[(?:::1|f[cd][0-9a-f]{2}:.*)\]$")
    return F.when(host != "", F.coalesce(inside, F.lit(False)) | six)
