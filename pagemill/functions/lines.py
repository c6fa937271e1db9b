"""Line-level cleaning and heading sections, as column expressions (T8, T10). Nothing is exploded, so nothing is shuffled."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagemill.functions.text import let, mask_code, stripped

# They must equal the reference's for the same lines to go.
NOISE_ANYWHERE = (
    r"(?i:self\.__next_[a-zA-Z_]*)", r"document\.querySelectorAll\([^)\n]*\)", r"document\.getElementById\([^)\n]*\)", r"window\.addEventListener\([^)\n]*\)",
    r"data-page-mode\s*=", "suppressHydrationWarning",
)
NOISE_LINES = (
    "On this page", "Edit this page", r"Was this page helpful\??", r"Last updated\s*(?:on\s+)?[\d/\-]+", r"Skip to (?:main )?content", "Table of contents?", "Previous", "Next",
)

BLANK = r"[^\S\n]*"
#: A line of one opening brace, and all up to a line of one closing brace or the end.
BRACE_BLOCK = rf"^{BLANK}\{{{BLANK}\n.*?(?:^{BLANK}\}};?{BLANK}\n|\z)"
NOISE_LINE = rf"^(?:[^\n]*(?:{'|'.join(NOISE_ANYWHERE)})[^\n]*|{BLANK}(?i:{'|'.join(NOISE_LINES)}){BLANK})\n"
HEADING = r"(?md)(?=^#{1,3}\s)"
LEAST_SECTION = 50


def preclean(text: Column) -> Column:
    """Without brace blocks and noise lines, at most one empty line in a row, nothing blank at the ends."""
    lines = F.concat(text, F.lit("\n"))
    lines = F.regexp_replace(lines, f"(?Usmd){BRACE_BLOCK}", "")
    lines = F.regexp_replace(lines, f"(?Umd){NOISE_LINE}", "")
    return stripped(F.regexp_replace(F.regexp_replace(lines, r"\n\z", ""), r"\n{3,}", "\n\n"))


def heading_sections(text: Column) -> Column:
    """The sections from each heading of level 1 to 3 outside code to the next; null with under two headings.

    Text before the first heading and sections of under 50 characters are left out; null if no section is left.
    """
    def sections(parts: Column) -> Column:
        """The parts with where each ends, in one pass."""
        begin = F.struct(F.lit(0).alias("end"), F.array().cast("array<struct<part:string,end:int>>").alias("all"))
        step = lambda a, p: F.struct((a["end"] + F.length(p)).alias("end"), F.concat(a["all"], F.array(F.struct(p.alias("part"), (a["end"] + F.length(p)).alias("end")))).alias("all"))
        return F.aggregate(parts, begin, step, lambda a: a["all"])

    def cut(placed: Column) -> Column:
        headed = F.filter(placed, lambda x: x["part"].rlike(r"^#{1,3}\s"))
        whole = F.transform(headed, lambda x: stripped(F.substr(text, x["end"] - F.length(x["part"]) + 1, F.length(x["part"]))))
        kept = lambda s: F.filter(s, lambda x: F.length(x) >= LEAST_SECTION)
        return F.when(F.size(headed) >= 2, let(kept(whole), lambda k: F.when(F.size(k) > 0, k)))

    return let(let(F.split(mask_code(text), HEADING, -1), sections), cut)
