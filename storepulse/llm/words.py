"""Words of many texts at once: numpy views over one UTF-8 buffer.

Words are maximal runs of bytes other than ASCII white space.  Each gets a 64-bit
fingerprint; A-Z may be folded to lower case in it.  That of a word of up to ``LONG`` bytes is a
polynomial modulo 2**64, under which some longer words collide for certain (a Thue-Morse string
and its complement); a longer word has its BLAKE2b digest.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import numpy as np

from storepulse.llm.common import mix64

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
LONG = 32
_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS = np.array([pow(_BASE, i, 1 << 64) for i in range(LONG)], dtype=np.uint64)
_BYTE_CODES = mix64(np.arange(256, dtype=np.uint64))
_FOLDED_CODES = _BYTE_CODES.copy()
_FOLDED_CODES[65:91] = _BYTE_CODES[97:123]


class Words(NamedTuple):
    start: np.ndarray  # first byte of each word
    end: np.ndarray  # byte after its last one
    text: np.ndarray  # which text it is in
    code: np.ndarray  # fingerprint
    first: np.ndarray  # for each text, its first word; one more entry at the end


def words_of(data: np.ndarray, starts: np.ndarray, fold: bool = False) -> Words:
    """The words of the texts ``data[starts[i]:starts[i + 1]]``."""
    n = len(data)
    inside = ~_SPACE[data]
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    at_text = starts[:-1][starts[:-1] < n]
    opens[at_text] = inside[at_text]
    closes = np.zeros(n, dtype=bool)
    if n:
        closes[:-1] = inside[:-1] & ~inside[1:]
        closes[-1] = inside[-1]
        last = starts[1:][(starts[1:] > 0)] - 1
        closes[last] = inside[last]
    start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    first = np.searchsorted(start, starts)
    text = np.repeat(np.arange(len(starts) - 1), np.diff(first))
    code = np.zeros(len(start), dtype=np.uint64)
    if len(start):
        length = end - start
        held = data[inside]
        begin = np.cumsum(length) - length
        # places and their powers repeat every LONG bytes, so that a byte of each tells them
        place = np.arange(len(held), dtype=np.uint32).astype(np.uint8) - np.repeat(begin.astype(np.uint32).astype(np.uint8), length)
        weight = _POWERS[place % LONG]
        weight *= (_FOLDED_CODES if fold else _BYTE_CODES)[held]
        code = mix64(np.add.reduceat(weight, begin) + length.astype(np.uint64))
        for k in np.flatnonzero(length > LONG):
            word = data[start[k]:end[k]].tobytes()
            digest = hashlib.blake2b(word.lower() if fold else word, digest_size=8).digest()  # lower() of bytes folds A-Z alone
            code[k] = np.uint64(int.from_bytes(digest, "little"))
    return Words(start, end, text, code, first)


def spans(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The places ``start[i]`` to ``start[i] + length[i] - 1`` of each ``i``, one after the other."""
    ends = np.cumsum(length)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - length), length)


def same_bytes(a: np.ndarray, at_a: np.ndarray, b: np.ndarray, at_b: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether the words of ``length`` bytes at ``at_a`` of ``a`` and ``at_b`` of ``b`` are the same."""
    same = np.ones(len(length), dtype=bool)
    # eight bytes at a time, from any place on
    here, there = (np.ndarray(len(x) + 1, "<u8", np.concatenate([x, np.zeros(8, np.uint8)]), strides=(1,)) for x in (a, b))
    check = np.arange(len(length))
    for at in range(0, LONG, 8):
        if not len(check):
            break
        unused = np.maximum(8 * (8 - (length[check] - at)), 0).astype(np.uint64)
        alike = (here[at_a[check] + at] ^ there[at_b[check] + at]) << unused == 0
        same[check[~alike]] = False
        check = check[alike & (length[check] > at + 8)]
    for k in check:
        same[k] = np.array_equal(a[at_a[k]:at_a[k] + length[k]], b[at_b[k]:at_b[k] + length[k]])
    return same


def distinct_words(data: np.ndarray, words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(a word of each distinct spelling, which of these each word is).  Bytes decide; fingerprints only group them."""
    _, first, which = np.unique(words.code, return_index=True, return_inverse=True)
    if not len(first):
        return first, which
    model = first[which]
    length = words.end - words.start
    same = length == length[model]
    check = np.flatnonzero(same & (model != np.arange(len(model))))
    same[check] = same_bytes(data, words.start[check], data, words.start[model[check]], length[check])
    others: dict[bytes, int] = {}
    extra = []
    for k in np.flatnonzero(~same):
        word = data[words.start[k]:words.end[k]].tobytes()
        if word not in others:
            others[word] = len(first) + len(extra)
            extra.append(k)
        which[k] = others[word]
    return np.concatenate([first, np.array(extra, dtype=first.dtype)]), which
