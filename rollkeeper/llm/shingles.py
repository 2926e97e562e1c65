"""Shingle sets and SuperMinHash signatures of the texts of a batch, for all texts at once."""

from __future__ import annotations

import hashlib

import numpy as np

from rollkeeper.llm.common import BLANKS

WORDS = 5
PLACES = 128
_STEP = 57

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WORD = np.ones(256, dtype=bool)
_IS_WORD[[ord(b) for b in BLANKS]] = False
_ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """A hash of every word, A to Z in lower case, and the number of its text."""
    sizes = np.array([len(t or b"") + 1 for t in texts], dtype=np.int64)
    ends = np.cumsum(sizes)
    data = _LOWER[np.frombuffer(b"\n".join(t or b"" for t in texts) + b"\n" * 9, dtype=np.uint8)]
    inside = _IS_WORD[data]
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if inside[0]:
        edges = np.concatenate([[0], edges])
    starts, stops = edges[0::2], edges[1::2]
    eights = np.ndarray((len(data) - 7,), dtype="<u8", buffer=data.data, strides=(1,))
    left = stops - starts
    out = mix(left.astype(np.uint64) * _ODD)
    at, who = starts, np.arange(len(starts))
    while len(who):
        part = eights[at]
        short = left < 8
        part[short] &= (np.uint64(1) << (left[short] * 8).astype(np.uint64)) - np.uint64(1)
        out[who] = mix(out[who] + part * _ODD)
        more = left > 8
        at, left, who = at[more] + 8, left[more] - 8, who[more]
    return out, np.searchsorted(ends, starts, side="right")


def shingle_sets(texts: list[bytes | None], words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles of each text in order, and where each text's set begins (one entry more at the end).

    A text with fewer words is one shingle of them all, one without words has none.
    """
    hashes, text = word_hashes(texts)
    n = len(texts)
    count = np.bincount(text, minlength=n)
    first = np.cumsum(count) - count
    whole = max(len(hashes) - words + 1, 0)
    value = np.full(whole, np.uint64(words))
    for k in range(words):
        value = mix(value + hashes[k : k + whole]) if whole else value
    good = text[:whole] == text[words - 1 :] if whole else np.zeros(0, dtype=bool)
    values, owners = [value[good]], [text[:whole][good]]
    for i in np.flatnonzero((count > 0) & (count < words)):
        one = np.full(1, np.uint64(count[i]))
        for h in hashes[first[i] : first[i] + count[i]]:
            one = mix(one + h)
        values.append(one)
        owners.append(np.array([i]))
    values, owners = np.concatenate(values), np.concatenate(owners)
    order = np.lexsort((values, owners))
    values, owners = values[order], owners[order]
    new = np.ones(len(values), dtype=bool)
    new[1:] = (values[1:] != values[:-1]) | (owners[1:] != owners[:-1])
    values, owners = values[new], owners[new]
    return values, np.concatenate([[0], np.cumsum(np.bincount(owners, minlength=n))]).astype(np.int64)


def super_minhash(values: np.ndarray, begins: np.ndarray, places: int = PLACES) -> np.ndarray:
    """Signatures of sets, a row each, of ``places`` numbers.

    Every element walks through a permutation of the places of its own. In round j it comes to its j-th place with a
    rank between j and j + 1, so ranks of one element are spread over the places, and a set whose places all have a
    rank below j + 1 after round j needs no further round: most sets stop after two or three.
    """
    sets = len(begins) - 1
    best = np.full((sets, places), np.iinfo(np.uint64).max, dtype=np.uint64)
    owner = np.repeat(np.arange(sets), np.diff(begins))
    walk = np.tile(np.arange(places, dtype=np.uint8), (len(values), 1)) if len(values) else np.zeros((0, places), dtype=np.uint8)
    flat = best.reshape(-1)
    for j in range(places):
        if not len(values):
            break
        draw = mix(values + np.uint64((j + 1) * int(_ODD) % 2**64))
        place = j + (mix(draw + _ODD) % np.uint64(places - j)).astype(np.int64)
        each = np.arange(len(values))
        to = walk[each, place].astype(np.int64)
        walk[each, place] = walk[:, j]
        rank = (np.uint64(j) << np.uint64(_STEP)) | (draw >> np.uint64(64 - _STEP))
        np.minimum.at(flat, owner * places + to, rank)
        open_sets = best.max(axis=1) >= (np.uint64(j + 1) << np.uint64(_STEP))
        goes_on = open_sets[owner]
        if not goes_on.all():
            values, owner, walk = values[goes_on], owner[goes_on], walk[goes_on]
    return best


def set_digest(values: np.ndarray) -> bytes:
    return hashlib.blake2b(values.tobytes(), digest_size=16).digest()
