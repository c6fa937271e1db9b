"""SentencePiece encoding and decoding with N-best segmentation.

A text is a lattice of the vocabulary's pieces; a segmentation's score is the sum of its pieces' scores. A forward Viterbi pass
gives each position the best score of what lies before it. That is the exact cost to go of a backward search, so that A-star
from the end pops whole segmentations in the order of their scores and expands little else.

No piece of these vocabularies has a blank after another character or spans a line break, so that the lattice falls into units,
each a run of blanks with the characters after it. Units are solved once per worker. The N best of a text combine the units' own: a text's second
segmentation changes one unit, and only the N - 1 occurrences whose second best costs least can matter for its N best.
"""

from __future__ import annotations

import heapq
import re
import struct
import zlib
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import batch_of, held, rows_of

BLANK = "▁"
#: What a character without a piece scores below the least piece score, and distinct units that a worker remembers solved and ranked.
UNKNOWN_PENALTY, MOST_UNITS, MOST_RANKED = 10.0, 900_000, 50_000
CHANGES = pa.list_(pa.struct([("score", pa.float64()), ("changes", pa.list_(pa.struct([("unit", pa.int64()), ("ids", pa.list_(pa.int32()))])))]))
SCHEMA = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("score", pa.float64()), ("alternatives", CHANGES)])
DDL = "doc_id long, ids array<int>, score double, alternatives array<struct<score: double, changes: array<struct<unit: long, ids: array<int>>>>>"


class Vocabulary:
    def __init__(self, path: str):
        import sentencepiece

        library = sentencepiece.SentencePieceProcessor(model_file=path)
        every = range(library.get_piece_size())
        plain = [i for i in every if not (library.is_byte(i) or library.is_control(i) or library.is_unknown(i) or library.is_unused(i))]
        self.pieces = {library.id_to_piece(i): (i, library.get_score(i)) for i in plain}
        if any(BLANK in p.lstrip(BLANK) for p in self.pieces):
            raise ValueError("a piece has a blank after another character: texts don't fall into units")
        self.bytes = {int(library.id_to_piece(i)[3:5], 16): i for i in every if library.is_byte(i)}
        self.unknown = (library.unk_id(), min(s for _, s in self.pieces.values()) - UNKNOWN_PENALTY)
        self.longest = max(map(len, self.pieces))
        self.spelled = [self._spell(library, i) for i in every]
        #: Every end of a piece: the piece's id and score, or an empty tuple if it is none itself.
        self.ends = {p[k:]: self.pieces.get(p[k:], ()) for p in self.pieces for k in range(len(p))}
        apart = "" if any("\n" in p for p in self.pieces) else "\n"  # in no piece, so that nothing spans it
        self.cut = re.compile(f"{BLANK}+[^{BLANK}{apart}]*|[^{BLANK}{apart}]+" + ("|\n" if apart else ""))
        self.units: dict[str, tuple[bytes, float, float]] = {}
        self.ranked: dict[tuple[str, int], list[tuple[float, tuple[int, ...]]]] = {}

    @staticmethod
    def _spell(library, i: int) -> bytes:
        if library.is_byte(i):
            return bytes([int(library.id_to_piece(i)[3:5], 16)])
        return b"" if library.is_control(i) or library.is_unknown(i) else library.id_to_piece(i).encode()

    def edges(self, text: str, end: int) -> Iterator[tuple[int, tuple[int, ...], float]]:
        """(begin, ids, score) of what may end there; a character without a piece is its bytes, or unknown."""
        get, alone = self.pieces.get, False
        for begin in range(end - 1, max(-1, end - self.longest - 1), -1):
            found = get(text[begin:end])
            if found:
                alone = alone or begin == end - 1
                yield begin, found[:1], found[1]
        if not alone:
            yield end - 1, self.fallback(text[end - 1]), self.unknown[1]

    def fallback(self, character: str) -> tuple[int, ...]:
        return tuple(self.bytes[b] for b in character.encode()) if self.bytes else (self.unknown[0],)

    def forward(self, text: str) -> list[float]:
        """The best score of each beginning of the text."""
        best = [0.0]
        for end in range(1, len(text) + 1):
            best.append(max(best[begin] + score for begin, _, score in self.edges(text, end)))
        return best

    def segmentations(self, text: str) -> Iterator[tuple[float, tuple[int, ...]]]:
        """All segmentations, best first; of equal scores in a fixed order."""
        best, number = self.forward(text), count()
        heap = [(-best[-1], len(text), 0, 0.0, None)]
        while heap:
            total, at, _, behind, path = heapq.heappop(heap)
            if not at:
                ids: list[int] = []
                while path:
                    ids += path[0]
                    path = path[1]
                yield -total, tuple(ids)
                continue
            for begin, ids, score in self.edges(text, at):
                heapq.heappush(heap, (-(best[begin] + behind + score), begin, next(number), behind + score, (ids, path)))

    def solve(self, text: str) -> tuple[tuple[int, ...], float, float]:
        """Best ids, their score, and what the second best loses; one forward pass with the two best scores of each beginning."""
        get, low = self.ends.get, -np.inf
        best, second, come = [0.0], [low], [(0, ())]
        for end in range(1, len(text) + 1):
            top, next_, alone, way = low, low, False, (0, ())
            for begin in range(end - 1, -1, -1):
                found = get(text[begin:end])
                if found:
                    alone = alone or begin == end - 1
                    score = found[1]
                    value, other = best[begin] + score, second[begin] + score
                    if value > top:
                        if top > next_:
                            next_ = top
                        top, way = value, (begin, found[:1])
                    elif value > next_:
                        next_ = value
                    if other > next_:
                        next_ = other
                elif found is None:
                    break
            if not alone:
                begin, score = end - 1, self.unknown[1]
                value, other = best[begin] + score, second[begin] + score
                if value > top:
                    next_, top, way = max(next_, top), value, (begin, self.fallback(text[begin]))
                elif value > next_:
                    next_ = value
                next_ = max(next_, other)
            best.append(top)
            second.append(next_)
            come.append(way)
        parts, at = [], len(text)
        while at:
            at, ids = come[at]
            parts.append(ids)
        return tuple(i for ids in reversed(parts) for i in ids), best[-1], best[-1] - second[-1]

    def unit(self, text: str) -> tuple[bytes, float, float]:
        """Best ids as 32-bit numbers, their score, and what the second best loses (infinite if there is none)."""
        found = self.units.get(text)
        if found is None:
            if len(self.units) > MOST_UNITS:
                self.units.clear()
            ids, score, lost = self.solve(text)
            found = self.units[text] = (struct.pack(f"<{len(ids)}I", *ids), score, lost)
        return found

    def n_best(self, text: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
        """What each of the n best segmentations loses, and its ids; the first is that of solve()."""
        found = self.ranked.get((text, n))
        if found is None:
            if len(self.ranked) > MOST_RANKED:
                self.ranked.clear()
            first, top, _ = self.solve(text)
            others = (w for w in self.segmentations(text) if w[1] != first)
            found = self.ranked[text, n] = [(0.0, first), *((top - s, ids) for (s, ids), _ in zip(others, range(n - 1), strict=False))]
        return found

    def encode(self, text: str, n: int) -> tuple[bytes, float, list[tuple[float, list[tuple[int, tuple[int, ...]]]]]]:
        """Best ids and score, and the n best as scores with the units (by number) that differ from the best, with their ids."""
        if not text:
            return b"", 0.0, []
        units = self.cut.findall(BLANK + text.replace(" ", BLANK))
        solved = list(map(self.unit, units))
        score = float(sum(s for _, s, _ in solved))
        losses = np.array([x for _, _, x in solved])
        likely = np.argsort(losses, kind="stable")[: n - 1] if len(losses) <= 4 * n else _least(losses, n - 1)
        ways = []
        for k in likely.tolist():
            if losses[k] < np.inf:
                ways.append((k, self.n_best(units[k], n)))
        return b"".join(b for b, _, _ in solved), score, [(score - lost, changes) for lost, changes in combine(ways, n)]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; the blank that encoding puts before a text goes."""
        text = b"".join(map(self.spelled.__getitem__, ids.tolist())).decode("utf-8", "replace").replace(BLANK, " ")
        return text[1:] if text.startswith(" ") else text


def _least(values: np.ndarray, n: int) -> np.ndarray:
    """Places of the n least values, ties to the earlier, in order."""
    if n <= 0:
        return np.zeros(0, int)
    edge = np.partition(values, n - 1)[n - 1]
    below = np.flatnonzero(values < edge)
    found = np.concatenate([below, np.flatnonzero(values == edge)[: n - len(below)]])
    return found[np.argsort(values[found], kind="stable")]


def combine(ways: list[tuple[int, list]], n: int) -> list[tuple[float, list]]:
    """The n least sums of one loss from each unit's list (of losses from 0, ascending), with the choices that aren't the first."""
    best = [(0.0, [])]
    for unit, own in ways:
        sums = [(lost + more, changes + ([(unit, ids)] if k else [])) for lost, changes in best for k, (more, ids) in enumerate(own)]
        best = sorted(sums, key=lambda x: x[0])[:n]
    return best


def vocabulary(path: str) -> Vocabulary:
    return held(("pieces", path), lambda: Vocabulary(path))


def encode_pieces(df: DataFrame, model_path: str, n: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, score, alternatives) of every whole text: its best segmentation, and its n best or all if fewer.

    alternatives has the best too, first, with no changes; each other one lists the units, by number, whose ids differ from the
    best. Null and empty texts have no ids, score 0 and no alternatives. Null ids and repeated rows stay; empty tables give
    empty results; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = vocabulary(model_path)
        for batch in batches:
            for some in (batch.slice(k, 256) for k in range(0, batch.num_rows, 256)):
                found = [own.encode(t, n) for t in rows_of(some)]
                ids = pa.array([np.frombuffer(b, "<i4") for b, _, _ in found], pa.list_(pa.int32()))
                alternatives = [[{"score": s, "changes": [{"unit": u, "ids": list(i)} for u, i in c]} for s, c in ways] for _, _, ways in found]
                yield batch_of(SCHEMA, some.column(0), ids, [s for _, s, _ in found], alternatives)

    return df.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, DDL)


def decode_pieces(df: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text) of every row's ids; null ids give a null text."""
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = vocabulary(model_path)
        for batch in batches:
            yield batch_of(schema, batch.column(0), [None if i is None else own.decode(np.array(i, np.int64)) for i in batch.column(1).to_pylist()])

    return df.select(F.col(id_col).cast("long"), F.col(ids_col).cast("array<int>")).mapInArrow(run, "doc_id long, text string")


def piece_digests(df: DataFrame, model_path: str, n: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """encode_pieces in short: (doc_id, n_pieces, ids_crc32, score, n_best, nth_score, round_trip) of every whole text.

    ids_crc32 is that of the best ids as little-endian 32-bit numbers; nth_score is the last of the n_best alternatives', null
    without any; round_trip tells whether the ids decode to the text, U+2581 read as a blank.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_pieces", pa.int64()), ("ids_crc32", pa.int64()), ("score", pa.float64()), ("n_best", pa.int32()), ("nth_score", pa.float64()), ("round_trip", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = vocabulary(model_path)
        for batch in batches:
            rows = []
            for text in rows_of(batch):
                ids, score, ways = own.encode(text, n)
                again = own.decode(np.frombuffer(ids, "<u4"))
                rows.append((len(ids) // 4, zlib.crc32(ids), score, len(ways), ways[-1][0] if ways else None, again == text.replace(BLANK, " ")))
            yield batch_of(schema, batch.column(0), *(zip(*rows, strict=True) if rows else [[]] * 6))

    return df.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, "doc_id long, n_pieces long, ids_crc32 long, score double, n_best int, nth_score double, round_trip boolean")
