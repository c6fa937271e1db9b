"""Token counts by compiled finite-state transducers.

Two deterministic transducers are compiled. The first reads character classes and emits, on its transitions, the bounds of
the pre-tokens of byte-level BPE. A batch of texts is one long tape cut into chunks; every chunk yields its state map (for
each entry state the exit state), the maps compose in a parallel prefix scan, and a second pass with the entry states now
known emits the bounds of all chunks at once.

The second reads the bytes of a pre-token and emits, on each transition, by how much that byte changes the number of tokens of
what was read. The tokens of a text without its last token t are the tokens of the shorter text, and t is the one token
ending there that merges leave alone beside the token before it. So a state needs the longest suffix that a token may still
go on from, and for each place within it the token that ends there and the number of tokens up to there, less that of the whole.
Its transitions are compiled from the vocabulary's merges when first met and kept per worker within a bound; all distinct
pre-tokens of a batch run through the table in step. The count of a text is the sum of what its path emits.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import batch_of, bounded_cache, byte_letters, held, rows_of, steps

SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])

#: Classes of characters on the tape.
RESET, SPACE, WHITE, LETTER, NUMBER, OTHER, QUOTE, ONE, R, V, E, L = range(12)
#: States; the names say what the open pre-token is, with the pending contraction letters in Q_*.
START, IN_LETTERS, IN_NUMBERS, IN_OTHERS, ONE_SPACE, ONE_WHITE, RUN_SPACE, RUN_WHITE, Q, Q_R, Q_V, Q_L, CONTRACTED = range(13)
#: Emissions: a pre-token begins at this character, or at the one before.
HERE, BEFORE = 1, 2
#: Characters of a chunk, and of the texts that run together.
CHUNK, CHARS = 256, 2_000_000
#: Characters of a chunk that are read from every entry state before constant maps go on alone.
SETTLE = 24
#: Transitions and pairs of tokens that a worker keeps; pre-tokens that run in step, and the bytes of one that runs alone, with the transitions kept meanwhile.
MOST_TRANSITIONS, MOST_PAIRS, LANES, LONG, MOST_KNOWN = 1_000_000, 500_000, 1 << 16, 4096, 100_000
BYTES = [bytes([b]) for b in range(256)]


def compile_bounds() -> tuple[np.ndarray, np.ndarray]:
    """Next state and emission by state and class, for the pattern of contractions, letter, number, other and white-space runs."""
    letters = (LETTER, ONE, R, V, E, L)
    go = np.zeros((13, 12), np.uint8)
    out = np.zeros((13, 12), np.uint8)

    def put(state: int, classes, to: int, emits: int) -> None:
        for c in classes if isinstance(classes, tuple) else (classes,):
            go[state, c], out[state, c] = to, emits

    def begin(state: int, emits: int) -> None:
        """Whatever comes begins a pre-token."""
        put(state, letters, IN_LETTERS, emits)
        for c, to in ((NUMBER, IN_NUMBERS), (OTHER, IN_OTHERS), (QUOTE, Q), (SPACE, ONE_SPACE), (WHITE, ONE_WHITE)):
            put(state, c, to, emits)

    for state in (START, IN_LETTERS, IN_NUMBERS, IN_OTHERS, ONE_WHITE, Q, CONTRACTED):
        begin(state, HERE)
    put(IN_LETTERS, letters, IN_LETTERS, 0)
    put(IN_NUMBERS, NUMBER, IN_NUMBERS, 0)
    put(IN_OTHERS, (OTHER, QUOTE), IN_OTHERS, 0)
    for state, emits in ((ONE_SPACE, 0), (RUN_SPACE, BEFORE)):  # the last blank joins what follows
        put(state, letters, IN_LETTERS, emits)
        put(state, NUMBER, IN_NUMBERS, emits)
        put(state, (OTHER, QUOTE), IN_OTHERS, emits)
    begin(RUN_WHITE, HERE | BEFORE)  # the last of a run stands alone
    for state in (ONE_SPACE, ONE_WHITE, RUN_SPACE, RUN_WHITE):
        put(state, SPACE, RUN_SPACE, 0)
        put(state, WHITE, RUN_WHITE, 0)
    put(Q, ONE, CONTRACTED, 0)
    put(Q, (OTHER, QUOTE), IN_OTHERS, 0)
    for state, first, second in ((Q_R, R, E), (Q_V, V, E), (Q_L, L, L)):
        put(Q, first, state, 0)
        begin(state, HERE | BEFORE)
        put(state, letters, IN_LETTERS, BEFORE)
        put(state, second, CONTRACTED, 0)
        put(state, RESET, START, BEFORE)
    return go, out


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """The class of every code point."""
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    found = np.full(0x110000, OTHER, np.uint8)
    for pattern, c in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\p{White_Space}+", WHITE)):
        for m in regex.finditer(pattern, every):
            low, high = ord(m[0][0]), ord(m[0][-1])
            found[low : high + 1] = c  # surrogates never stand in a text
    for text, c in ((" ", SPACE), ("'", QUOTE), ("stmd", ONE), ("r", R), ("v", V), ("e", E), ("l", L)):
        for x in text:
            found[ord(x)] = c
    return found


def entry_states(tape: np.ndarray, go: np.ndarray) -> np.ndarray:
    """The state before each chunk (a row of the tape), by composing the chunks' state maps in a prefix scan."""
    flat, width = go.ravel(), np.uint8(go.shape[1])  # state * width + class stays under 256
    maps = np.repeat(np.arange(len(go), dtype=np.uint8)[:, None], len(tape), axis=1)
    for k in range(SETTLE):
        maps = flat[maps * width + tape[:, k]]
    one = (maps == maps[0]).all(axis=0)  # most maps are constant by now and need one path only
    for own, rows in ((maps[:1, one], tape[one]), (maps[:, ~one], tape[~one])):
        for k in range(SETTLE, tape.shape[1]):
            own = flat[own * width + rows[:, k]]
        maps[:, one if len(own) == 1 else ~one] = own
    before = maps.T.copy()  # chunk, entry state -> exit state
    hop = 1
    while hop < len(before):  # a row then maps the entry of the chunk 2 * hop - 1 back to its own exit
        before[hop:] = np.take_along_axis(before[hop:], before[:-hop], axis=1)
        hop *= 2
    return np.concatenate([[START], before[:-1, START]]).astype(np.uint8)


def begins(codes: np.ndarray, go: np.ndarray, out: np.ndarray) -> np.ndarray:
    """Positions where pre-tokens begin, of classes of which the last is RESET."""
    tape = np.zeros(-(-len(codes) // CHUNK) * CHUNK, np.uint8)
    tape[: len(codes)] = codes
    tape = tape.reshape(-1, CHUNK)
    state = entry_states(tape, go)
    emitted = np.empty_like(tape)
    for k in range(CHUNK):
        at = state * np.uint8(go.shape[1]) + tape[:, k]
        emitted[:, k] = out.ravel()[at]
        state = go.ravel()[at]
    emitted = emitted.ravel()
    flags = (emitted & HERE).astype(bool)
    flags[:-1] |= (emitted[1:] & BEFORE).astype(bool)
    return np.flatnonzero(flags[: len(codes)])


def distinct(points: np.ndarray, at: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First occurrences of the distinct slices at..stop, and for each slice the number of its first one.

    Slices of up to 16 code points below 256 without NUL are compared in whole, as two words of 8 bytes; each other slice
    counts as distinct, so that equal numbers always mean equal slices.
    """
    size = stop - at
    padded = np.concatenate([np.minimum(points, 256), np.zeros(16, np.uint32)])
    short = np.flatnonzero(size <= 16)
    inside = np.arange(16) < np.arange(17)[:, None]
    taken = np.where(inside[size[short]], padded[at[short, None] + np.arange(16)], 0)
    plain = (taken < 256).all(axis=1) & ((taken > 0).sum(axis=1) == size[short])
    short = short[plain]
    words = np.ascontiguousarray(taken[plain].astype(np.uint8)).view(np.uint64)
    mixed = words[:, 0] * np.uint64(0x9E3779B97F4A7C15) ^ (words[:, 1] * np.uint64(0xC2B2AE3D27D4EB4F) >> np.uint64(7))
    _, first, number = np.unique(mixed, return_index=True, return_inverse=True)
    good = (words == words[first[number]]).all(axis=1)
    other = np.ones(len(at), bool)
    other[short[good]] = False
    other = np.flatnonzero(other)
    same = np.empty(len(at), np.int64)
    same[short[good]] = number[good]
    same[other] = len(first) + np.arange(len(other))
    return np.concatenate([short[first], other]), same


class Merges:
    """The tokens of a byte-level BPE vocabulary, and which two of them stand side by side in what merges make."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            held = json.load(file)
        model = held["model"]
        if model["type"] != "BPE" or model.get("ignore_merges") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix") or held.get("normalizer"):
            raise ValueError("only plain byte-level BPE is compiled")
        byte = {letter: b for b, letter in byte_letters().items()}
        text = lambda token: bytes(map(byte.__getitem__, token))
        self.special = [t["content"] for t in held["added_tokens"]]
        self.ids = {text(t): n for t, n in model["vocab"].items() if t not in self.special}
        self.bytes = {n: t for t, n in self.ids.items()}
        self.rank = {}
        for k, m in enumerate(model["merges"]):
            left, right = map(text, m.split(" ") if isinstance(m, str) else m)
            self.rank[self.ids[left], self.ids[right]] = k, self.ids[left + right]
        self.open = {t[:k] for t in self.ids for k in range(1, len(t))}  # what a token may still go on from
        self.beside: dict[tuple[int, int], bool] = {}

    def merged(self, text: bytes) -> list[int]:
        """The tokens of a text: the first merge in rank, the leftmost of it, until none is left."""
        ids = [self.ids[text[k : k + 1]] for k in range(len(text))]
        while len(ids) > 1:
            found = min(((self.rank[p], k) for k, p in enumerate(zip(ids, ids[1:], strict=False)) if p in self.rank), default=None)
            if found is None:
                break
            (_, whole), k = found
            ids[k : k + 2] = [whole]
        return ids

    def stands(self, before: int, token: int) -> bool:
        """Whether merges leave token as it is, after the token before it or, with before = -1, at the beginning."""
        known = self.beside.get((before, token))
        if known is None:
            bounded_cache(self.beside, MOST_PAIRS)
            text = self.bytes[token]
            want = [token] if before < 0 else [before, token]
            known = self.beside[before, token] = self.merged(text if before < 0 else self.bytes[before] + text) == want
        return known


#: A state: the open suffix, and for each place from its beginning to its end the token that ends there and the tokens up to there less all so far.
State = tuple[bytes, tuple[int, ...], tuple[int, ...]]
FIRST: State = (b"", (-1,), (0,))


class CountTransducer:
    """The transducer of token counts: transitions from (state, byte) to (state, emitted count) in an open hash table."""

    def __init__(self, merges: Merges):
        self.merges = merges
        self.clear()

    def clear(self) -> None:
        self.states: list[State] = [FIRST]
        self.number: dict[State, int] = {FIRST: 0}
        self.made = 0
        self.grow(1 << 16)

    def grow(self, slots: int) -> None:
        old = (self.key, self.to, self.out) if self.made else None
        self.slots = slots
        self.key, self.to, self.out = np.full(slots, -1, np.int64), np.zeros(slots, np.int32), np.zeros(slots, np.int16)
        if old is not None:
            there = old[0] >= 0
            self.put(old[0][there], old[1][there], old[2][there])

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20)).astype(np.int64) & self.slots - 1

    def put(self, keys: np.ndarray, to: np.ndarray, out: np.ndarray) -> None:
        """Enter distinct new keys; of those that want one slot the first gets it, the others look further."""
        at = self.slot(keys)
        left = np.arange(len(keys))
        while len(left):
            free = left[self.key[at[left]] < 0]
            _, first = np.unique(at[free], return_index=True)
            won = free[first]
            self.key[at[won]], self.to[at[won]], self.out[at[won]] = keys[won], to[won], out[won]
            left = left[self.key[at[left]] != keys[left]]
            at[left] = at[left] + 1 & self.slots - 1

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The slot of every key, -1 where it is not there."""
        at = self.slot(keys)
        left = np.arange(len(keys))
        while len(left):
            held = self.key[at[left]]
            at[left[held < 0]] = -1
            left = left[(held != keys[left]) & (held >= 0)]
            at[left] = at[left] + 1 & self.slots - 1
        return at

    def follow(self, state: State, byte: int) -> tuple[State, int]:
        """The state after one more byte, and by how much the number of tokens changes."""
        suffix, last, counts = state
        whole = suffix + BYTES[byte]
        ids, stands = self.merges.ids, self.merges.stands
        for k in range(len(whole)):
            token = ids.get(whole[k:])
            if token is not None and stands(last[k], token):
                break
        else:
            raise ValueError("a byte without a token")
        change = counts[k] + 1
        at = 0  # the longest suffix that is open
        while at < len(whole) and whole[at:] not in self.merges.open:
            at += 1
        return (whole[at:], (*last[at:], token), (*(c - change for c in counts[at:]), 0)), change

    def compile(self, keys: np.ndarray) -> None:
        """Transitions for new keys: a state's number times 256, plus the byte."""
        to, out = np.empty(len(keys), np.int32), np.empty(len(keys), np.int16)
        for k, key in enumerate(keys.tolist()):
            state, out[k] = self.follow(self.states[key >> 8], key & 255)
            n = self.number.get(state)
            if n is None:
                n = self.number[state] = len(self.states)
                self.states.append(state)
            to[k] = n
        self.made += len(keys)
        while 2 * self.made > self.slots:
            self.made -= len(keys)
            self.grow(2 * self.slots)
            self.made += len(keys)
        self.put(keys, to, out)

    def counts(self, data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The numbers of tokens of the pre-tokens that begin at these places of data and have these sizes in bytes."""
        total = np.zeros(len(begin), np.int64)
        order = np.argsort(-size, kind="stable")
        short = order[np.searchsorted(-size[order], -LONG, side="left") :]
        for k in order[: len(order) - len(short)].tolist():
            total[k] = self.one(data[begin[k] : begin[k] + size[k]].tobytes())
        for lanes in (short[k : k + LANES] for k in range(0, len(short), LANES)):
            if self.made > MOST_TRANSITIONS:
                self.clear()
            own, sizes, state = begin[lanes], size[lanes], np.zeros(len(lanes), np.int64)
            for j in range(int(sizes[0]) if len(sizes) else 0):
                n = int(np.searchsorted(-sizes, -j, side="left"))  # the lanes that have a byte left
                keys = state[:n] << 8 | data[own[:n] + j]
                at = self.find(keys)
                if (at < 0).any():
                    self.compile(np.unique(keys[at < 0]))
                    at = self.find(keys)
                state[:n] = self.to[at]
                total[lanes[:n]] += self.out[at]
        return total

    def one(self, text: bytes) -> int:
        """The number of tokens of one long pre-token; its states are kept for a while only."""
        known: dict[tuple[State, int], tuple[State, int]] = {}
        state, total = FIRST, 0
        for byte in text:
            step = known.get((state, byte))
            if step is None:
                bounded_cache(known, MOST_KNOWN)
                step = known[state, byte] = self.follow(state, byte)
            state, change = step
            total += change
        return total


class Counter:
    """Counts tokens of texts with one vocabulary; one per Python worker."""

    def __init__(self, path: str):
        merges = Merges(path)
        self.go, self.out = compile_bounds()
        self.paths = CountTransducer(merges)
        self.special = regex.compile("|".join(map(regex.escape, sorted(merges.special, key=len, reverse=True)))) if merges.special else None

    def count(self, texts: list[str]) -> np.ndarray:
        totals = np.zeros(len(texts), np.int64)
        for a, b in steps(texts, CHARS):
            parts, owner = [], []
            for i in range(a, b):
                own = self.special.split(texts[i]) if self.special and self.special.search(texts[i]) else [texts[i]]
                totals[i] += len(own) - 1  # each special string is one token
                parts += own
                owner += [i] * len(own)
            whole = "\n".join(parts) + "\n"
            points = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
            codes = classes()[points]
            ends = np.cumsum([len(p) + 1 for p in parts])
            codes[ends - 1] = RESET
            at = begins(codes, self.go, self.out)
            if not len(at):
                continue
            part = np.searchsorted(ends, at, side="right")
            stop = np.minimum(np.append(at[1:], len(whole)), ends[part] - 1)
            first, same = distinct(points, at, stop)
            place = np.concatenate([[0], np.cumsum(1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000))])  # in bytes
            data = np.frombuffer(whole.encode(), np.uint8)
            counts = self.paths.counts(data, place[at[first]], place[stop[first]] - place[at[first]])[same]
            totals += np.bincount(np.array(owner)[part], weights=counts, minlength=len(texts)).astype(np.int64)
        return totals


def token_counts(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens) of every row, as a byte-level BPE tokenizer file counts the whole text.

    A null text counts as empty: 0 bytes, 0 tokens. Null ids and repeated rows stay, one result row per input row. Special
    strings inside a text are one token each. An empty table gives an empty result; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = rows_of(batch)
            counter = held(("token counts", tokenizer_path), lambda: Counter(tokenizer_path))
            yield batch_of(SCHEMA, batch.column(0), [len(t.encode()) for t in texts], counter.count(texts))

    return df.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
