"""Fuzzy hashing with the perfect binary Golay code of 23 bits.

Every 23-bit word lies within 3 bits of exactly one of the 4096 codewords. The keys of a word are the indices of all codewords
within 4 bits: one key if its own codeword is at most 2 bits away, otherwise six. Two words at most 2 bits apart have a word
in the middle that is at most 1 bit from each; the codeword of that one is within 4 bits of both, so they share a key.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np

#: The generator polynomial x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GENERATOR = 0b101011100011
LENGTH, CHECK_BITS = 23, 11


def remainder(word: int) -> int:
    for bit in range(LENGTH - 1, CHECK_BITS - 1, -1):
        if word >> bit & 1:
            word ^= GENERATOR << bit - CHECK_BITS
    return word


@lru_cache(maxsize=1)
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the three bytes of a word; for each syndrome, the up to six errors of at most 4 bits; their number."""
    of_bit = [remainder(1 << b) for b in range(LENGTH)]
    parts = np.zeros((3, 256), np.int64)
    for byte in range(3):
        for v in range(256):
            for k in range(8):
                if v >> k & 1 and 8 * byte + k < LENGTH:
                    parts[byte, v] ^= of_bit[8 * byte + k]
    errors = np.zeros((1 << CHECK_BITS, 6), np.int64)
    many = np.zeros(1 << CHECK_BITS, np.int64)
    for weight in range(5):
        for bits in combinations(range(LENGTH), weight):
            syndrome = 0
            for b in bits:
                syndrome ^= of_bit[b]
            errors[syndrome, many[syndrome]] = sum(1 << b for b in bits)
            many[syndrome] += 1
    return parts, errors, many


def keys(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position of the word, index of a codeword within 4 bits of it) for all words."""
    parts, errors, many = tables()
    syndrome = parts[0][words & 255] ^ parts[1][words >> 8 & 255] ^ parts[2][words >> 16]
    at = np.repeat(np.arange(len(words)), many[syndrome])
    inside = np.arange(len(at)) - np.repeat(np.cumsum(many[syndrome]) - many[syndrome], many[syndrome])
    return at, (words[at] ^ errors[syndrome[at], inside]) >> CHECK_BITS
