"""Licence scans: an Aho-Corasick automaton over the words of a text, and a shunting-yard parser for licence expressions.

The automaton holds notice phrases and identifier tags. It runs over the text's words joined by single blanks, so that it
finds words standing consecutively whatever stood between them. Where it meets an identifier tag, the rest of that line is
read as a licence expression: `with` binds closest, then `and`, then `or`; parentheses group. The parser writes the
expression in postfix order and evaluates it to the set of licences it names and the obligation that is left to a user who
takes the mildest alternative of every `or` and all of every `and`.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import batch_of, rows_of

#: The base phrases, by label.
BASE_PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Further notice phrases, by label.
NOTICE_PHRASES = {
    "cc by sa": "cc-by-sa", "cc by nc": "cc-by-nc", "cc by nd": "cc-by-nd", "cc0": "cc0", "creative commons zero": "cc0",
    "creative commons attribution": "cc-by", "creative commons attribution sharealike": "cc-by-sa",
    "creative commons attribution noncommercial": "cc-by-nc", "mit license": "mit", "apache license": "apache-2.0",
    "permission is hereby granted free of charge": "mit", "bsd license": "bsd", "isc license": "isc",
    "redistribution and use in source and binary forms": "bsd", "mozilla public license": "mpl",
    "lesser general public license": "lgpl", "affero general public license": "agpl", "eclipse public license": "epl",
    "public domain": "public-domain", "no part of this publication may be reproduced": "reserved",
}
#: Words after which the line holds a licence expression.
TAG = "spdx license identifier"
#: Label and obligation of the families of identifiers; an identifier belongs to the longest prefix that fits.
FAMILIES = {
    "mit": ("mit", 1), "apache": ("apache-2.0", 1), "bsd": ("bsd", 1), "isc": ("isc", 1), "zlib": ("zlib", 1), "unlicense": ("public-domain", 0),
    "cc0": ("cc0", 0), "cc-by": ("cc-by", 1), "cc-by-sa": ("cc-by-sa", 3), "cc-by-nc": ("cc-by-nc", 4), "cc-by-nd": ("cc-by-nd", 4),
    "mpl": ("mpl", 2), "epl": ("epl", 2), "lgpl": ("lgpl", 2), "gpl": ("gpl", 3), "agpl": ("agpl", 3), "proprietary": ("reserved", 4),
}
#: Obligation of the labels that phrases give: 0 none, 1 attribution, 2 file-wise copyleft, 3 copyleft, 4 use restricted.
OBLIGATION = dict(FAMILIES.values()) | {"public-domain": 0, "reserved": 4}
#: What one phrase and one well-formed tag tell for themselves that the text carries a licence.
PHRASE_WEIGHT, TAG_WEIGHT = 0.7, 0.95

SCHEMA = pa.schema([
    ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()),
    ("base_labels", pa.list_(pa.string())), ("labels", pa.list_(pa.string())), ("expressions", pa.list_(pa.string())), ("obligation", pa.int32()), ("score", pa.float64()),
])
DDL = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels array<string>, labels array<string>, expressions array<string>, obligation int, score double"

#: Every byte as the scan reads it: A-Z lowered, ASCII that is neither letter nor digit blank, all else as it is.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
STRENGTH = {"or": 1, "and": 2, "with": 3}


@dataclass(frozen=True)
class Value:
    labels: frozenset[str]
    obligation: int
    known: bool


def family(identifier: str) -> Value:
    """The label of a licence identifier; one of no known family is its own label and counts as restricted."""
    name = identifier.lower().rstrip("+")
    for cut in range(len(name), 0, -1):
        if name[:cut] in FAMILIES and (cut == len(name) or name[cut] == "-"):
            label, level = FAMILIES[name[:cut]]
            return Value(frozenset([label]), level, True)
    return Value(frozenset([name]), 4, False)


def postfix(text: str) -> list[str]:
    """Shunting-yard over the longest prefix that is an expression; empty if there is none."""
    output: list[str] = []
    stack: list[str] = []
    good = 0, []  # the longest prefix so far
    operand = False
    for m in re.finditer(r"\s*([()]|[A-Za-z0-9][A-Za-z0-9.+-]*)|\s*(\S)", text):
        token = m[1]
        if token is None:
            break
        word = token.lower()
        if word in STRENGTH:
            if not operand:
                break
            while stack and stack[-1] != "(" and STRENGTH[stack[-1]] >= STRENGTH[word]:
                output.append(stack.pop())
            stack.append(word)
            operand = False
        elif token == "(":
            if operand:
                break
            stack.append(token)
        elif token == ")":
            if not operand or "(" not in stack:
                break
            while stack[-1] != "(":
                output.append(stack.pop())
            stack.pop()
        else:
            if operand:
                break
            output.append(token.rstrip(".-"))
            operand = True
        if operand and "(" not in stack:
            good = m.end(), output + stack[::-1]
    return good[1]


def evaluate(parts: list[str]) -> Value | None:
    """The value of a postfix expression: `or` takes the milder side's obligation, `and` the stricter; `with` eases copyleft."""
    stack: list[Value] = []
    for part in parts:
        if part not in STRENGTH:
            stack.append(family(part))
            continue
        right, left = stack.pop(), stack.pop()
        if part == "with":  # the right side names an exception, not a licence
            stack.append(Value(left.labels, min(left.obligation, 2) if left.obligation == 3 else left.obligation, left.known))
        else:
            pick = min if part == "or" else max
            stack.append(Value(left.labels | right.labels, pick(left.obligation, right.obligation), left.known and right.known))
    return stack[0] if stack else None


@lru_cache(maxsize=4)
def automaton(phrases: tuple[tuple[str, str, bool], ...]) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for phrase, label, base in phrases:
        found.add_word(f" {phrase} ", (len(phrase), label, base))
    found.add_word(f" {TAG} ", (len(TAG), "", False))
    found.make_automaton()
    return found


def scan(text: str, phrases: tuple[tuple[str, str, bool], ...]) -> tuple:
    """n_words, n_base, first_word, last_word, base labels, labels, expressions, obligation, score."""
    words = text.encode().translate(FOLD).split()
    line = (b" " + b" ".join(words) + b" ").decode("latin-1")
    n_base, first, last, base, labels, tagged = 0, None, None, set(), set(), False
    levels, expressions, miss = [], [], 1.0
    for end, (size, label, is_base) in automaton(phrases).iter(line):
        if not label:
            tagged = True
            continue
        if label not in labels:
            miss *= 1 - PHRASE_WEIGHT
            levels.append(OBLIGATION.get(label, 4))
        labels.add(label)
        if is_base:
            n_base += 1
            base.add(label)
            begin = end - size  # a blank, then the phrase, then the blank at `end`
            first = begin if first is None else min(first, begin)
            last = begin if last is None else max(last, begin)
    if first is not None:
        first, last = line.count(" ", 0, first) - 1, line.count(" ", 0, last) - 1
    if tagged:
        for m in re.finditer(r"(?i)spdx-license-identifier\W*?:\s*([^\n\r]*)", text):
            value = evaluate(parts := postfix(m[1]))
            if value:
                expressions.append(" ".join(parts))
                labels |= value.labels
                levels.append(value.obligation)
                miss *= 1 - TAG_WEIGHT * (1 if value.known else 0.5)
    return len(words), n_base, first, last, sorted(base), sorted(labels), expressions, max(levels, default=None), 1 - miss


def license_scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", base: Mapping[str, str] = BASE_PHRASES, notices: Mapping[str, str] = NOTICE_PHRASES) -> DataFrame:
    """Licence words, labels and expressions of every whole text; one row per input row.

    base and notices give the label of each phrase, in lower-case words and single blanks. n_base counts all places of base
    phrases, overlapping ones too; first_word and last_word are their smallest and largest start among the words, counted
    from 0, or null. labels has the base labels, those of notices and those that expressions name; expressions are in postfix
    order; obligation is the strictest found, null if none; score is the chance that at least one sign is right, 0 without
    signs. A null text counts as empty: 0 words, no labels, score 0. Null ids and repeated rows stay; an empty table gives an
    empty result; other columns are not read.
    """
    phrases = tuple(sorted([(p, x, True) for p, x in base.items()] + [(p, x, False) for p, x in notices.items() if p not in base]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [scan(t, phrases) for t in rows_of(batch)]
            yield batch_of(SCHEMA, batch.column(0), *(zip(*found, strict=True) if found else [[]] * 9))

    return df.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, DDL)
