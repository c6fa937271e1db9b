"""HTML pages: a small document tree, selectors, Markdown, typed blocks, links and content extraction.

Pages go through Python once, in Arrow batches, for what needs a tree; titles, headings, links and noise have expressions.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Selectors that must equal the reference's for the same content to stay.
NOISE_SELECTORS = (
    "script", "style", "noscript", "iframe", "nav", "footer", "header", "[role='navigation']", "[role='banner']", "[role='contentinfo']", ".sidebar",
    "#sidebar", ".navbar", "#navbar", ".table-of-contents", "#table-of-contents", ".breadcrumb", ".footer", ".header", ".cookie-banner", "[id*='mintlify']",
    ".prev-next-links", ".pagination-nav", ".edit-this-page", ".last-updated", ".theme-toggle", ".search-bar", "[data-search]",
)
CONTENT_SELECTORS = ("main", "article", "[role='main']", "#content", ".content", ".markdown-body", ".docs-content", ".documentation", "#main-content")
NAV_SELECTORS = ("nav a", "aside a", ".sidebar a", ".navigation a", "[role='navigation'] a", ".toc a", ".menu a")
CONTAINERS = frozenset("div section article main aside nav header body html [document]".split())
LEAST_CONTENT, LEAST_FALLBACK, MOST_NAV = 200, 20, 100

BLOCKS = "array<struct<type:string,content:string,level:int,language:string,alt:string>>"
BLOCK_TYPE = pa.list_(pa.struct([("type", pa.string()), ("content", pa.string()), ("level", pa.int32()), ("language", pa.string()), ("alt", pa.string())]))


class Element:
    __slots__ = ("attributes", "children", "name", "parent")

    def __init__(self, name: str, attributes: dict[str, str], parent: Element | None):
        self.name, self.attributes, self.parent = name, attributes, parent
        self.children: list[Element | str] = []

    def walk(self) -> Iterator[Element]:
        """All elements below, in document order."""
        stack = [c for c in reversed(self.children) if isinstance(c, Element)]
        while stack:
            own = stack.pop()
            yield own
            stack += [c for c in reversed(own.children) if isinstance(c, Element)]

    def strings(self) -> Iterator[str]:
        stack: list[Element | str] = [self]
        while stack:
            own = stack.pop()
            if isinstance(own, str):
                yield own
            else:
                stack += reversed(own.children)

    def text(self, joint: str = "", strip: bool = False) -> str:
        parts = (s.strip() for s in self.strings()) if strip else self.strings()
        return joint.join(s for s in parts if s or not strip)

    def html(self) -> str:
        """The markup inside."""
        out: list[str] = []
        stack: list[Element | str | tuple[str]] = list(reversed(self.children))
        while stack:
            own = stack.pop()
            if isinstance(own, tuple):
                out.append(own[0])
            elif isinstance(own, str):
                out.append(own.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;"))
            else:
                out.append(f"<{own.name}" + "".join(f' {k}="{v.replace("&", "&amp;").replace(chr(34), "&quot;")}"' for k, v in own.attributes.items()) + ">")
                if own.name not in VOID:
                    stack.append((f"</{own.name}>",))
                    stack += reversed(own.children)
        return "".join(out)


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Element("[document]", {}, None)
        self.at = self.root

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        own = Element(tag, {k: v or "" for k, v in reversed(attrs)}, self.at)
        self.at.children.append(own)
        if tag not in VOID:
            self.at = own

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.at.children.append(Element(tag, {k: v or "" for k, v in reversed(attrs)}, self.at))

    def handle_endtag(self, tag: str) -> None:
        own: Element | None = self.at
        while own is not None and own.name != tag:
            own = own.parent
        if own is not None and own.parent is not None:
            self.at = own.parent

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)


def parse(html: str) -> Element:
    builder = _Builder()
    builder.feed(html)
    builder.close()
    return builder.root


_SIMPLE = re.compile(r"([a-zA-Z][\w-]*|\*)|\.([\w-]+)|#([\w-]+)|\[([\w-]+)(?:([*^$~|]?=)['\"]?([^'\"\]]*)['\"]?)?\]")


def selector(text: str) -> Callable[[Element], bool]:
    """A matcher of one selector: tags, classes, ids and attributes, with descendants separated by blanks."""
    steps = [_SIMPLE.findall(part) for part in text.split()]
    if not steps or any("".join(m.group(0) for m in _SIMPLE.finditer(p)) != p for p in text.split()):
        raise ValueError(f"not a selector that is supported: {text}")

    def simple(own: Element, tests) -> bool:
        for tag, cls, id_, name, kind, value in tests:
            has = own.attributes.get(name)
            good = (
                (tag in (own.name, "*")) if tag else (cls in own.attributes.get("class", "").split()) if cls else (own.attributes.get("id") == id_) if id_
                else has is not None and {"": True, "=": has == value, "*=": value in has, "^=": has.startswith(value), "$=": has.endswith(value), "~=": value in has.split(), "|=": has == value or has.startswith(value + "-")}[kind]
            )
            if not good:
                return False
        return True

    def matches(own: Element) -> bool:
        if not simple(own, steps[-1]):
            return False
        up, left = own.parent, steps[:-1]
        while left and up is not None:
            if simple(up, left[-1]):
                left = left[:-1]
            up = up.parent
        return not left

    return matches


def remove_noise(root: Element, user: tuple[str, ...] = ()) -> Element:
    """Elements of the user's and the fixed selectors leave the tree."""
    tests = [selector(s) for s in (*user, *NOISE_SELECTORS)]
    for own in list(root.walk()):
        if any(t(own) for t in tests):
            own.parent.children.remove(own)
    return root


def extract_content(root: Element, user: tuple[str, ...] = ()) -> str:
    """T4: the first selector's first element with 200 characters of markup, else the densest element, else the body."""
    for text in (*user, *CONTENT_SELECTORS):
        test = selector(text)
        own = next((e for e in root.walk() if test(e)), None)
        if own is not None and len(html := own.html()) >= LEAST_CONTENT:
            return html
    dense = max((e for e in root.walk() if e.name in ("div", "section", "td")), key=_density, default=None)
    if dense is not None and len(markdown_of(dense)) >= LEAST_CONTENT:
        return dense.html()
    body = next((e for e in root.walk() if e.name == "body"), root)
    return body.html()


def _density(own: Element) -> float:
    """Characters of the paragraphs directly inside, less those of links."""
    paragraphs = [c for c in own.children if isinstance(c, Element) and c.name in ("p", "pre", "blockquote")]
    return sum(len(p.text()) - sum(len(a.text()) for a in p.walk() if a.name == "a") for p in paragraphs)


#: Elements that stand as paragraphs of their own, and those that give no Markdown.
APART = frozenset("p div section article main aside header footer nav figure form body html".split())
SILENT = frozenset("script style head template".split())
MARKS = {"b": "**", "strong": "**", "i": "*", "em": "*", "code": "`"}


def table_cells(own: Element) -> list[list[str]]:
    """The texts of a table's cells, row by row."""
    return [[c.text(" ", True) for c in r.walk() if c.name in ("td", "th")] for r in own.walk() if r.name == "tr"]


def heading_level(name: str) -> int:
    """1 to 6, or 0 for what is no heading."""
    return int(name[1]) if len(name) == 2 and name[0] == "h" and name[1] in "123456" else 0


def code_of(own: Element) -> tuple[Element | None, str | None]:
    """The code element inside, and the language that its class names."""
    code = next((c for c in own.walk() if c.name == "code"), None)
    marks = code.attributes.get("class", "").split() if code is not None else []
    return code, next((m.removeprefix("language-") for m in marks if m.startswith("language-")), None)


def _whole_markdown(own: Element) -> str | None:
    """The Markdown of elements that are shown without that of their children; null for others."""
    name = own.name
    if name in SILENT:
        return ""
    if name == "br":
        return "  \n"
    if name == "hr":
        return "\n\n---\n\n"
    if name == "img":
        return f"![{own.attributes.get('alt', '')}]({own.attributes.get('src', '')})"
    if name == "pre":
        return f"\n\n```{code_of(own)[1] or ''}\n{own.text().strip(chr(10))}\n```\n\n"
    if name == "table":
        rows = [[" ".join(c.split()).replace("|", r"\|") for c in r] for r in table_cells(own) if r]
        lines = ["| " + " | ".join(r) + " |" for r in rows]
        return "\n\n" + "\n".join([*lines[:1], "|" + " --- |" * len(rows[0]), *lines[1:]]) + "\n\n" if rows else ""
    return None


def _markdown_around(own: Element, text: str, number: int) -> str:
    """The Markdown of an element whose children's is text; number: a list item's place in an ordered list, or 0."""
    name, bare = own.name, text.strip()
    if level := heading_level(name):
        return f"\n\n{'#' * level} {' '.join(bare.split())}\n\n" if bare else ""
    if name == "a":
        return f"[{bare}]({own.attributes['href']})" if bare and own.attributes.get("href") else text
    if name in MARKS and bare:
        return MARKS[name] + bare + MARKS[name]
    if name == "li":
        return "\n" + (f"{number}. " if number else "* ") + re.sub(r"\n+", "\n  ", bare)
    if name in ("ul", "ol"):
        return f"\n\n{bare}\n\n" if own.parent is None or own.parent.name != "li" else "\n" + text.strip("\n")
    if name == "blockquote" and bare:
        return "\n\n> " + bare.replace("\n", "\n> ") + "\n\n"
    if name in APART:
        return f"\n\n{bare}\n\n" if bare else ""
    return text


def markdown_of(root: Element) -> str:
    """Headings with marks, links, emphasis, code, lists, quotes and tables; other tags vanish, their text stays.

    Elements are shown from the last to the first, children before their parents, so that nesting of any depth is no recursion.
    """
    shown: dict[int, str] = {}
    numbers: dict[int, int] = {}

    def inside(own: Element) -> str:
        return "".join(re.sub(r"\s+", " ", c) if isinstance(c, str) else shown.pop(id(c)) for c in own.children)

    every = list(root.walk())
    for own in every:
        if own.name == "ol":
            numbers |= {id(c): k for k, c in enumerate((c for c in own.children if isinstance(c, Element) and c.name == "li"), 1)}
    for own in reversed(every):
        text = inside(own)
        whole = _whole_markdown(own)
        shown[id(own)] = _markdown_around(own, text, numbers.get(id(own), 0)) if whole is None else whole
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+\n", lambda m: m[0] if m[0] == "  \n" else "\n", inside(root))).strip()


def html_to_markdown(html: str) -> str:
    return markdown_of(parse(html))


def _block(kind: str, content: str, level: int | None = None, language: str | None = None, alt: str | None = None) -> dict:
    return {"type": kind, "content": content, "level": level, "language": language, "alt": alt}


def _list_block(own: Element) -> dict | None:
    items = [c.text(" ", True) for c in own.children if isinstance(c, Element) and c.name == "li"]
    return _block("list", "\n".join(items)) if items else None


def _table_block(own: Element) -> dict | None:
    rows = table_cells(own)
    return _block("table", json.dumps(rows)) if rows else None


def _pre_block(own: Element) -> dict:
    code, language = code_of(own)
    return _block("code", (code or own).text(), language=language)


def _text_block(kind: str, joint: str = " ", **more) -> Callable[[Element], dict | None]:
    """A maker of blocks whose content is the element's text; none if there is no text."""
    return lambda own: _block(kind, text, **more) if (text := own.text(joint, True)) else None


#: What makes the block of an element, by its tag.
BLOCK_OF: dict[str, Callable[[Element], dict | None]] = {
    **{f"h{k}": _text_block("heading", level=k) for k in range(1, 7)},
    "p": _text_block("paragraph"),
    "blockquote": _text_block("blockquote", "\n"),
    "ul": _list_block, "ol": _list_block, "table": _table_block, "pre": _pre_block,
    "code": lambda own: _block("code", own.text()) if own.text().strip() else None,
    "img": lambda own: _block("image", own.attributes["src"], alt=own.attributes.get("alt") or None) if own.attributes.get("src") else None,
}


def blocks_of(root: Element) -> list[dict]:
    """The typed blocks of an element, in document order; containers give those of what is in them."""
    found, open_ = [], [root]
    while open_:
        own = open_.pop()
        if own.name in BLOCK_OF:
            found.append(BLOCK_OF[own.name](own))
        elif own.name in CONTAINERS:
            open_ += [c for c in reversed(own.children) if isinstance(c, Element)]
        elif len(text := own.text(" ", True)) > LEAST_FALLBACK:
            found.append(_block("paragraph", text))
    return [b for b in found if b]


def structured(html: str) -> tuple[str | None, list[dict]]:
    """T5: title and blocks of the main part of a page."""
    root = parse(html)
    every = list(root.walk())
    title = next((e.text(strip=True) for e in every if e.name == "title"), None)
    tests = (lambda e: e.name == "main", lambda e: e.name == "article", lambda e: e.attributes.get("role") == "main", lambda e: e.name == "body")
    main = next((e for t in tests for e in every if t(e)), root)
    return title, blocks_of(main)


# Converters by name (T2, M17): functions from markup to Markdown.
CONVERTERS: dict[str, Callable[[str], str]] = {}


def register_converter(name: str, convert: Callable[[str], str]) -> None:
    CONVERTERS[name] = convert


def get_converter(name: str | None = None) -> Callable[[str], str]:
    if (name or "markdown") not in CONVERTERS:
        raise ValueError(f"no such converter: {name}; there are {', '.join(sorted(CONVERTERS))}")
    return CONVERTERS[name or "markdown"]


register_converter("markdown", html_to_markdown)


def _mapped(df: DataFrame, html_col: str, out: dict[str, tuple[str, pa.DataType]], convert: Callable[[str], tuple]) -> DataFrame:
    """df without the page and with new columns, null for null pages and for pages that fail; `error` says why."""
    keys = [c for c in df.columns if c != html_col and c not in out]
    ddl = ", ".join(f"{c} {k}" for c, (k, _) in out.items()) + ", error string"
    schema = df.select(*keys).schema
    for f in df.sparkSession.createDataFrame([], ddl).schema:
        schema = schema.add(f)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for html in batch.column(html_col).to_pylist():
                try:
                    rows.append((*(convert(html) if html is not None else (None,) * len(out)), None))
                except Exception as e:  # X13: one bad page never ends the job; its reason goes along
                    rows.append((*(None,) * len(out), f"{type(e).__name__}: {e}"))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * (len(out) + 1)
            batch = batch.select(keys)
            for (c, (_, kind)), values in zip([*out.items(), ("error", ("string", pa.string()))], columns, strict=True):
                batch = batch.append_column(c, pa.array(values, kind))
            yield batch

    return df.select(*keys, html_col).mapInArrow(run, schema)


def to_markdown(df: DataFrame, html_col: str = "html", converter: str | None = None, noise: tuple[str, ...] = (), content: tuple[str, ...] = (), clean: bool = True) -> DataFrame:
    """Df without the page, with markdown and error; clean drops noise and takes the main content first."""
    convert = get_converter(converter)

    def run(html: str) -> tuple[str]:
        return (convert(extract_content(remove_noise(parse(html), noise), content) if clean else html),)

    return _mapped(df, html_col, {"markdown": ("string", pa.string())}, run)


def to_blocks(df: DataFrame, html_col: str = "html") -> DataFrame:
    """T5, M4: df without the page, with title, blocks and error."""
    return _mapped(df, html_col, {"title": ("string", pa.string()), "blocks": (BLOCKS, BLOCK_TYPE)}, structured)


def links_of(html: str) -> tuple[list[str], list[str]]:
    """Hrefs of navigation links that begin neither as fragments nor as scripts, and those of all links to pages."""
    tests = [selector(t) for t in NAV_SELECTORS]
    anchors = [e for e in parse(html).walk() if e.name == "a" and e.attributes.get("href")]
    nav = [e.attributes["href"] for e in anchors if any(t(e) for t in tests) and not e.attributes["href"].startswith(("#", "javascript:"))]
    return nav, [e.attributes["href"] for e in anchors if not re.search("#|javascript:|mailto:|tel:", e.attributes["href"], re.IGNORECASE)]


def to_links(df: DataFrame, html_col: str = "html") -> DataFrame:
    """Df without the page, with nav and links, arrays of hrefs in document order, and error."""
    return _mapped(df, html_col, {c: ("array<string>", pa.list_(pa.string())) for c in ("nav", "links")}, links_of)


# Expressions for what needs no tree.


def title(html: Column) -> Column:
    return F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))


def first_heading(html: Column) -> Column:
    return F.trim(F.regexp_extract(html, r"(?is)<h1[^>]*>(.*?)</h1>", 1))


def without_noise(html: Column, tags: tuple[str, ...] = ("script", "style", "noscript", "iframe", "nav", "footer", "header")) -> Column:
    """T3 for noise that is told by its tag."""
    for tag in tags:
        html = F.regexp_replace(html, rf"(?is)<{tag}[\s>].*?</{tag}>", "")
    return html


def article(html: Column) -> Column:
    """T4 for pages with one article: its markup if it has 200 characters, else the body's."""
    own = F.regexp_extract(html, r"(?is)<article[^>]*>(.*?)</article>", 1)
    return F.when(F.length(own) >= LEAST_CONTENT, own).otherwise(F.regexp_extract(html, r"(?is)<body[^>]*>(.*?)</body>", 1))


def visible_text(html: Column) -> Column:
    """The text outside noise and tags, white space reduced to single blanks."""
    bare = F.regexp_replace(F.regexp_replace(without_noise(html, ("script", "style", "nav", "footer", "title")), r"(?s)<!--.*?-->", " "), r"<[^>]*>", " ")
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def hrefs(html: Column) -> Column:
    """The hrefs of links that are no fragments, scripts, mails or calls."""
    found = F.regexp_extract_all(html, F.lit(r'(?i)<a\s[^>]*?href="([^"]*)"'), F.lit(1))
    return F.filter(found, lambda h: ~F.lower(h).rlike("#|javascript:|mailto:|tel:"))


def nav_hrefs(html: Column) -> Column:
    """S8, F19 for links in <nav>: those that don't begin as fragments or scripts."""
    inside = F.array_join(F.regexp_extract_all(html, F.lit(r"(?is)<nav[^>]*>(.*?)</nav>"), F.lit(1)), " ")
    found = F.regexp_extract_all(inside, F.lit(r'(?i)<a\s[^>]*?href="([^"]*)"'), F.lit(1))
    return F.filter(found, lambda h: ~h.rlike("^(?:#|javascript:)"))
