"""HTML to laid-out text: a tree builder with implied tags, visibility rules and block layout.

The tokenizer reads tags, comments, raw-text elements and character references; it never fails. The builder closes what
HTML closes by implication (paragraphs before blocks, list items, table parts, options) and drops nothing that is visible.
The renderer walks the tree: hidden elements give no text; blocks stand on lines of their own, with a blank line around
those that have margins; list items get bullets or numbers and are indented by depth; preformatted text keeps its white space;
tables come as cells padded to their columns' widths.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import batch_of

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is text up to their own end tag, as it stands.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
#: Elements that are never rendered.
UNSEEN = frozenset("head script style template noscript iframe object audio video canvas datalist noembed noframes param".split())
#: Elements of graphics and formulas that are never rendered.
UNSEEN_WITHIN = {
    "svg": frozenset("title desc metadata defs symbol clippath mask marker pattern lineargradient radialgradient filter".split()),
    "math": frozenset("annotation annotation-xml".split()),
}
#: Start tags that leave the head open; any other ends it, as text does.
IN_HEAD = frozenset("head title meta link base basefont bgsound style script noscript noframes template".split())
IN_COLGROUP = frozenset("col template".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header"
    " hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table ul xmp".split()
)
#: Blocks with a margin, which shows as a blank line.
SPACED = frozenset("blockquote dl fieldset figure h1 h2 h3 h4 h5 h6 hr ol p pre table ul menu xmp".split())
#: Start tags that end an open paragraph.
ENDS_PARAGRAPH = BLOCK - frozenset("body html option optgroup legend".split()) | {"table"}
#: For a start tag: what it ends, and the elements beyond which it does not look.
IMPLIED_END = {
    "li": ({"li"}, {"ul", "ol", "menu", "table", "td", "th"}), "dt": ({"dt", "dd"}, {"dl", "table"}), "dd": ({"dt", "dd"}, {"dl", "table"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}), "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}), "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}), "body": ({"head"}, set()), "a": ({"a"}, {"td", "th", "li", "div", "p"}),
}
#: End tags stop looking for their start at these; those of table parts only at the table.
SCOPES = frozenset("table td th caption html".split())
TABLE_PARTS = frozenset("table thead tbody tfoot tr td th caption".split())
#: Comments, declarations and text; tags are read by Tags.
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>?|<\?[^>]*>?|[^<]+|<", re.DOTALL)
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
TAG_MARK = re.compile("[\"'>]")
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
DISPLAY, VISIBILITY = (re.compile(rf"(?:^|[;\s]){name}\s*:\s*([a-z-]+)", re.IGNORECASE) for name in ("display", "visibility"))
#: Levels of nesting that the tree keeps; what is deeper becomes children of the last level, as far as it is visible.
DEPTH = 200
SCHEMA = pa.schema([("page_id", pa.int64()), ("text", pa.string())])


class Node:
    __slots__ = ("tag", "attributes", "children", "depth", "within")

    def __init__(self, tag: str, attributes: str, depth: int, within: str = ""):
        self.tag, self.attributes, self.depth, self.within = tag, attributes, depth, within  # within: svg, math or nothing
        self.children: list[Node | str] = []

    def attribute(self, name: str) -> str | None:
        """The first such attribute's value, the empty text if it has none."""
        if name not in self.attributes.lower():
            return None
        for m in ATTRIBUTE.finditer(self.attributes):
            if m[1].lower() == name:
                return unescape((m[2] or "").strip("\"'"))
        return None

    def hidden(self) -> bool:
        if self.tag in UNSEEN or (self.within and self.tag in UNSEEN_WITHIN[self.within]):
            return True
        if not self.attributes:
            return self.tag == "dialog"
        if self.attribute("hidden") is not None or (self.tag == "input" and (self.attribute("type") or "").lower() == "hidden"):
            return True
        if self.tag == "dialog" and self.attribute("open") is None:
            return True
        shown = DISPLAY.findall(self.attribute("style") or "")
        return bool(shown) and shown[-1].lower() == "none"

    def unseen(self, above: bool) -> bool:
        """Whether the element's own text is invisible, above being so for what it stands in: descendants may be visible again."""
        said = VISIBILITY.findall(self.attribute("style") or "") if self.attributes else ()
        return said[-1].lower() in ("hidden", "collapse") if said and said[-1].lower() != "inherit" else above

    def drop_unseen(self, unseen: bool = False) -> None:
        """Take out what visibility hides, and the elements that hold nothing else."""
        kept: list[Node | str] = []
        for child in self.children:
            if isinstance(child, str):
                if not unseen:
                    kept.append(child)
            elif not child.hidden():
                own = child.unseen(unseen)
                child.drop_unseen(own)
                if child.children or not own:
                    kept.append(child)
        self.children = kept


class Tags:
    """Finds the end of a tag in time linear in the page: quotes that turn out not to close are not trusted from there on."""

    def __init__(self, html: str):
        self.html, self.last, self.quoted = html, {c: html.rfind(c) for c in "\"'>"}, True

    def end(self, at: int) -> int:
        """The place of the > that ends a tag whose attributes begin here; -1 if none does."""
        if at > self.last[">"]:
            return -1
        place = at
        while self.quoted:
            m = TAG_MARK.search(self.html, place)
            if m is None:
                self.quoted = False
            elif m[0] == ">":
                return m.start()
            elif m.start() < self.last[m[0]]:
                place = self.html.index(m[0], m.end()) + 1
            else:
                place = m.end()
        return self.html.index(">", at)


class Deep:
    """Elements below the levels that the tree keeps: their tags, and whether they are gone or unseen."""

    def __init__(self, above: list[Node]):
        self.gone = any(n.hidden() for n in above)
        self.unseen = False
        for n in above:
            self.unseen = n.unseen(self.unseen)
        self.above = self.unseen
        self.open: list[tuple[str, bool, bool]] = []
        self.many: Counter[str] = Counter()

    def push(self, node: Node) -> None:
        self.open.append((node.tag, self.gone, self.unseen))
        self.many[node.tag] += 1
        self.gone = self.gone or node.hidden()
        self.unseen = node.unseen(self.unseen)

    def end(self, tag: str) -> list[Node]:
        """End the innermost element of this tag, which is there; a line ends with it if it is a visible block."""
        own, was_gone = "", False
        while own != tag:
            was_gone = self.gone
            own, self.gone, self.unseen = self.open.pop()
            self.many[own] -= 1
        return [Node("div", "", 0)] if tag in BLOCK and not was_gone else []

    def stand_in(self, node: Node) -> list[Node]:
        """What stands for an element in the last level of the tree: for a block the end of a line."""
        if node.hidden() or (self.unseen and node.tag not in BLOCK):
            return []
        return [Node("div", "", 0)] if node.tag in BLOCK and node.tag not in VOID else [node]

    def text(self, text: str) -> list[Node | str]:
        """What stands for a text in the last level of the tree."""
        if self.gone or self.unseen:
            return []
        if not self.above:
            return [text]
        seen = Node("span", 'style="visibility:visible"', 0)
        seen.children.append(text)
        return [seen]


def build_tree(html: str) -> Node:
    """The tree of a page; every visible character of it is in some node."""
    root = Node("html", "", 0)
    open_: list[Node] = [root]
    at, size = 0, len(html)
    lowered, tags, deep = None, Tags(html), None

    def close(tags, stop) -> None:
        """End the innermost element of `tags` with all in it, if no element of `stop` comes first."""
        for k in range(len(open_) - 1, 0, -1):
            if open_[k].tag in tags:
                del open_[k:]
                return
            if open_[k].tag in stop:
                return

    def put(text: str) -> None:
        open_[-1].children += deep.text(text) if deep else [text]

    while at < size:
        m = TAG.match(html, at)
        end = tags.end(m.end()) if m else -1
        if end < 0:  # no tag
            m = TOKEN.match(html, at)
            at = m.end()
            text = m[0]
            if text[0] != "<" or text == "<":
                if open_[-1].tag in ("head", "colgroup") and not text.isspace():
                    open_.pop()
                put(unescape(text) if "&" in text else text)
            continue
        tag, attributes = m[2], html[m.end() : end]
        at = end + 1
        tag = tag.lower()
        if m[1]:
            if tag in ("html", "body"):
                continue
            if tag == "br":
                if open_[-1].tag in ("head", "colgroup"):
                    open_.pop()
                open_[-1].children.append(Node("br", "", 0))
            elif deep and deep.many[tag]:
                open_[-1].children += deep.end(tag)
                deep = deep if deep.open else None
            elif tag == "p" and not any(n.tag == "p" for n in open_):
                open_[-1].children.append(Node("p", "", 0))
            else:
                levels = len(open_)
                close((tag,), {"table"} - {tag} if tag in TABLE_PARTS else SCOPES)
                if len(open_) < levels:
                    deep = None
            continue
        if tag == "html":
            root.attributes = root.attributes or attributes
            continue
        if (open_[-1].tag == "head" and tag not in IN_HEAD) or (open_[-1].tag == "colgroup" and tag not in IN_COLGROUP):
            open_.pop()
        if tag in ENDS_PARAGRAPH and not deep:
            close(("p",), SCOPES | {"button", "div", "article", "section", "main", "li"})
        if deep and tag in IMPLIED_END and deep.open[-1][0] in IMPLIED_END[tag][0]:
            open_[-1].children += deep.end(deep.open[-1][0])
            deep = deep if deep.open else None
        elif tag in IMPLIED_END and not deep:
            ends, stop = IMPLIED_END[tag]
            while any(open_[k].tag in ends for k in range(len(open_) - 1, 0, -1)):
                before = len(open_)
                close(ends, stop)
                if len(open_) == before:
                    break
        foreign = open_[-1].within if open_[-1].tag != "foreignobject" else ""
        node = Node(tag, attributes.rstrip("/ \t\r\n"), len(open_), tag if tag in UNSEEN_WITHIN else foreign)
        if not deep and len(open_) == DEPTH and tag not in VOID and tag not in RAW:
            deep = Deep(open_)
        if not deep:
            open_[-1].children.append(node)
        elif not deep.gone:
            open_[-1].children += deep.stand_in(node)
        if node.within and attributes.endswith("/"):  # only there does a slash end an element
            deep = deep if deep and deep.open else None
            continue
        if tag in RAW:
            lowered = html.lower() if lowered is None else lowered
            if len(lowered) != size:  # a character that changes its length: look for the end tag itself
                end = re.compile(f"</{re.escape(tag)}", re.IGNORECASE).search(html, at)
                stop_at = end.start() if end else size
            else:
                stop_at = lowered.find(f"</{tag}", at)
                stop_at = size if stop_at < 0 else stop_at
            raw = html[at:stop_at]
            node.children.append(unescape(raw) if tag in ("title", "textarea") else raw)
            end = html.find(">", stop_at)
            at = size if end < 0 else end + 1
        elif tag not in VOID:
            if len(open_) < DEPTH:
                open_.append(node)
            else:
                deep.push(node)
    if re.search("visibility", html, re.IGNORECASE):
        root.drop_unseen(root.unseen(False))
    return root


def width(text: str) -> int:
    """Columns of a line on a terminal: wide characters take two, combining ones none."""
    if text.isascii():
        return len(text)
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


class Layout:
    """Lines of text under construction; blank lines between blocks collapse to one."""

    def __init__(self):
        self.lines: list[str] = []
        self.line: list[str] = []
        self.indents: list[str] = []
        self.bullet: str | None = None
        self.gap = self.blank_due = False

    def words(self, text: str) -> None:
        """Inline text; white space collapses to one blank, none at the ends of a line."""
        parts = text.split()
        if not parts:
            self.gap = self.gap or bool(text)
            return
        if self.line and (self.gap or text[0].isspace()):
            self.line.append(" ")
        self.line.append(" ".join(parts))
        self.gap = text[-1].isspace()

    def end_line(self, empty: bool = False) -> None:
        text = "".join(self.line).rstrip()
        self.line, self.gap = [], False
        if text or (empty and self.lines):
            self.put(text)

    def put(self, text: str) -> None:
        if self.blank_due and self.lines and self.lines[-1]:
            self.lines.append("")
        self.blank_due = False
        lead = "".join(self.indents)
        if self.bullet is not None and text:
            lead = "".join(self.indents[:-1]) + self.bullet
            self.bullet = None
        self.lines.append((lead + text).rstrip())

    def block(self, spaced: bool) -> None:
        self.end_line()
        self.blank_due = self.blank_due or spaced

    def text(self) -> str:
        self.end_line()
        return "\n".join(self.lines).strip("\n")


def render(node: Node, out: Layout, pre: bool = False) -> None:
    for child in node.children:
        if isinstance(child, str):
            if pre:
                first, *others = child.expandtabs(8).split("\n")
                out.line.append(first)
                for line in others:
                    out.end_line(empty=True)
                    out.line.append(line)
            else:
                out.words(child)
            continue
        tag = child.tag
        if child.hidden():
            continue
        if tag == "br":
            out.end_line(empty=True)
        elif tag == "hr":
            out.block(True)
            out.put("-" * 8)
            out.block(True)
        elif tag == "img":
            out.words(child.attribute("alt") or "")
        elif tag == "input":
            out.words(child.attribute("value") or child.attribute("placeholder") or "")
        elif tag == "text" and child.within == "svg":  # placed apart from what stands beside it
            out.block(False)
            render(child, out, pre)
            out.block(False)
        elif tag == "wbr":
            continue
        elif tag == "table":
            out.block(True)
            render_table(child, out)
            out.block(True)
        elif tag in ("ul", "ol", "menu", "dir"):
            out.block(not out.indents)
            render_list(child, out)
            out.block(not out.indents)
        elif tag in ("blockquote", "dd"):
            out.block(tag in SPACED)
            out.indents.append("> " if tag == "blockquote" else "    ")
            render(child, out, pre)
            out.end_line()
            out.indents.pop()
            out.block(tag in SPACED)
        elif tag in BLOCK:
            out.block(tag in SPACED)
            render(child, out, pre or tag in ("pre", "xmp", "textarea"))
            out.block(tag in SPACED)
        elif tag in ("td", "th"):  # outside a table
            render(child, out, pre)
            out.gap = True
        elif tag in ("tr", "thead", "tbody", "tfoot", "caption"):
            out.block(False)
            render(child, out, pre)
            out.block(False)
        else:
            render(child, out, pre or tag == "textarea")


def render_list(node: Node, out: Layout) -> None:
    number = node.attribute("start") if node.tag == "ol" else None
    count = int(number) if number and re.fullmatch(r"-?\d{1,9}", number) else 1
    for child in node.children:
        if isinstance(child, str):
            out.words(child)
            continue
        if child.hidden():
            continue
        if child.tag != "li":
            inner = Node("div", "", 0)
            inner.children = [child]
            render(inner, out)
            continue
        bullet = "- "
        if node.tag == "ol":
            own = child.attribute("value")
            count = int(own) if own and re.fullmatch(r"-?\d{1,9}", own) else count
            bullet = f"{count}. "
            count += 1
        out.end_line()
        out.indents.append(" " * len(bullet))
        out.bullet = bullet
        render(child, out)
        out.end_line()
        out.bullet = None
        out.indents.pop()


def table_rows(node: Node) -> tuple[list[str], list[list[Node]], list[Node | str]]:
    """Captions' texts, the rows' cells, and what stands in the table without being part of it."""
    captions, rows, stray = [], [], []
    for child in node.children:
        if isinstance(child, str):
            if child.strip():
                stray.append(child)
        elif child.hidden() or child.tag in ("col", "colgroup"):
            continue
        elif child.tag == "caption":
            captions.append(cell_text(child))
        elif child.tag == "tr":
            rows.append([c for c in child.children if isinstance(c, Node) and c.tag in ("td", "th") and not c.hidden()])
            stray += [c for c in child.children if (isinstance(c, str) and c.strip()) or (isinstance(c, Node) and c.tag not in ("td", "th"))]
        elif child.tag in ("thead", "tbody", "tfoot"):
            more = table_rows(child)
            captions += more[0]
            rows += more[1]
            stray += more[2]
        elif child.tag in ("td", "th"):
            rows.append([child])
        else:
            stray.append(child)
    return captions, rows, stray


def cell_text(node: Node) -> str:
    inner = Layout()
    render(node, inner)
    return inner.text()


def render_table(node: Node, out: Layout) -> None:
    """Cells padded to their columns; cells of several lines take several; spanning cells leave the columns they span empty."""
    captions, rows, stray = table_rows(node)
    for piece in stray:  # shown before the table, as browsers do
        holder = Node("div", "", 0)
        holder.children = [piece]
        render(holder, out)
        out.end_line()
    for caption in captions:
        for line in caption.split("\n"):
            out.put(line)
    grid: list[list[list[str]]] = []
    held: dict[int, int] = {}  # columns that a cell from above still covers: rows left
    for row in rows:
        cells: list[list[str]] = []
        for cell in row:
            while held.get(len(cells), 0) > 0:
                held[len(cells)] -= 1
                cells.append([""])
            begin = len(cells)
            cells.append(cell_text(cell).split("\n"))
            spans = [int(v) if v and re.fullmatch(r"\d{1,3}", v) else 1 for v in (cell.attribute("colspan"), cell.attribute("rowspan"))]
            cells += [[""]] * (spans[0] - 1)
            if spans[1] > 1:
                held |= dict.fromkeys(range(begin, len(cells)), spans[1] - 1)
        for column in sorted(held):
            if column == len(cells) and held[column] > 0:
                held[column] -= 1
                cells.append([""])
        grid.append(cells)
    columns = max((len(r) for r in grid), default=0)
    widths = [max((width(line) for r in grid if k < len(r) for line in r[k]), default=0) for k in range(columns)]
    for row in grid:
        for k in range(max((len(c) for c in row), default=0)):
            parts = [c[k] if k < len(c) else "" for c in row]
            out.put("  ".join(p + " " * (w - width(p)) for p, w in zip(parts, widths, strict=False)).rstrip())


def html_text(html: str) -> str:
    """All visible text of a page, laid out."""
    out = Layout()
    render(build_tree(html.replace("\r\n", "\n").replace("\r", "\n")), out)
    return out.text()


def extract_text(df: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(page_id, text) of every whole page, one row per input row.

    A null page has a null text, an empty one or one without visible text the empty text. Malformed markup never fails: what is
    no tag is text. Null ids and repeated rows stay; an empty table gives an empty result; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch_of(SCHEMA, batch.column(0), [None if h is None else html_text(h) for h in batch.column(1).to_pylist()])

    return df.select(F.col(id_col).cast("long"), F.col(html_col).cast("string")).mapInArrow(run, "page_id long, text string")
