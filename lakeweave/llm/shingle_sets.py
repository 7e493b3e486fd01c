"""Sets of five-word shingles as sorted 64-bit hashes, and signatures of their segments.

The universe of hashes is cut into equal segments, so a sorted set falls into runs. A segment's content is
identified by the sum of its hashes, mixed once more, modulo 2**64; leaving one hash out is a
subtraction.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import xxhash

WIDTH = 5
NUMERATOR, DENOMINATOR = 4, 5  # similarity of 0.8 or more
MEMORY_WORDS = 100_000
# Size bands of the index begin at these ratios; a set near a border belongs to both bands.
BAND_RATIO = 1.6
# Sets smaller than this are indexed by one-deletion neighbourhoods, as few words leave weak segments.
SMALL = 48
# Share of further segments, so that weak and popular ones can be done without.
SPARE = 0.20

_GOLD = np.uint64(0x9E3779B97F4A7C15)
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)]
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A published 64-bit finaliser."""
    x = x + _GOLD  # numpy arrays wrap around silently
    x ^= x >> np.uint64(30)
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


class _Hashes(dict):
    def __missing__(self, word):
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


_MEMORY = _Hashes()


def sets_of(texts: list[str | None]) -> list[np.ndarray]:
    """The sorted different shingle hashes of each text."""
    if len(_MEMORY) > MEMORY_WORDS:
        _MEMORY.clear()
    split = [(t or "").encode().lower().split() for t in texts]  # bytes: letters A-Z and ASCII blanks only
    counts = [len(w) for w in split]
    h = np.fromiter(map(_MEMORY.__getitem__, chain.from_iterable(split)), np.uint64, sum(counts))
    n = max(0, len(h) - WIDTH + 1)
    acc = np.zeros(n, np.uint64)
    for i, odd in enumerate(_ODD):  # words hash at random, so a sum with odd factors does before the mixing
        acc += h[i : i + n] * odd
    acc = mix(acc)
    out, at = [], 0
    for c in counts:
        if c >= WIDTH:
            one = np.sort(acc[at : at + c - WIDTH + 1])
            fresh = one[1:] != one[:-1]
            out.append(one if fresh.all() else one[np.concatenate([[True], fresh])])
        elif c:  # the whole sequence is one
            one = np.full(1, c, np.uint64)
            for i in range(at, at + c):
                one = mix(one ^ h[i : i + 1])
            out.append(one)
        else:
            out.append(np.zeros(0, np.uint64))
        at += c
    return out


def key_of(s: np.ndarray) -> int:
    """A signed 64-bit key of a set's content."""
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return DENOMINATOR * shared >= NUMERATOR * (len(a) + len(b) - shared)


def parity(s: np.ndarray) -> bytes:
    """A bitmap with, at each place, the parity of the elements hashed to it: at least twice as many bits as
    elements. Two bitmaps differ in no more bits than the sets have elements apart."""
    bits = 1 << max(6, int(2 * len(s) - 1).bit_length())
    counts = np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(counts.astype(np.uint8), bitorder="little").tobytes()


def may_be_similar(a: bytes, n: int, b: bytes, m: int) -> bool:
    """False only if two sets with these bitmaps and sizes cannot be similar."""
    if DENOMINATOR * min(n, m) < NUMERATOR * max(n, m):
        return False
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    while len(x) > len(y):  # the place is the lowest bits of the hash, so halves fold onto each other
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum()) <= most_different(n + m)


def most_different(total: int) -> int:
    """The largest symmetric difference of two similar sets with ``total`` elements together."""
    shared = -(-NUMERATOR * total // (NUMERATOR + DENOMINATOR))
    return total - 2 * shared


@dataclass(frozen=True)
class Band:
    """Sets of ``low`` to ``high`` elements, in ``segments`` of which similar sets share one.

    ``near``: a segment counts as shared when it differs in one element at most. ``spare`` segments may be weak
    (empty, or for ``near`` with at most one element) without spoiling the guarantee.
    """

    number: int
    low: int
    high: int
    near: bool
    segments: int
    spare: int


@lru_cache(maxsize=None)
def band(number: int) -> Band:
    """Bands overlap so that any two similar sets lie together in one: the next begins at ``0.8 * high``."""
    low = 1
    for _ in range(number):
        low = max(low + 1, math.floor(_top(low) * NUMERATOR / DENOMINATOR))
    high = _top(low)
    budget = max(most_different(s) for s in range(max(0, 2 * high - 8), 2 * high + 1))
    if budget <= 0:
        return Band(number, low, high, False, 0, 0)
    # Two ways to spend the budget: segments shared exactly, or, at twice the worth but with a signature per
    # element, segments that differ in one. The second keeps the segments of small sets strong.
    near = low < SMALL
    need = -(-(budget + 1) // 2) if near else budget + 1
    spare = 0 if near else math.ceil(SPARE * need)
    return Band(number, low, high, near, need + spare, spare)


def _top(low: int) -> int:
    return max(low, math.floor(low * BAND_RATIO))


def bands_of(size: int) -> list[Band]:
    """The bands that a set of this size belongs to."""
    out, i = [], 0
    while size:
        b = band(i)
        if b.low > size:
            break
        if size <= b.high and b.segments:
            out.append(b)
        i += 1
    return out


@lru_cache(maxsize=100_000)
def _bands_of(size: int) -> tuple[Band, ...]:
    return tuple(bands_of(size))


@lru_cache(maxsize=1000)
def _tags(number: int, segments: int) -> np.ndarray:
    return mix((np.arange(segments, dtype=np.uint64) << np.uint64(8)) + np.uint64(number))


def signatures(s: np.ndarray) -> tuple[np.ndarray, int]:
    """All signatures of a sorted set, and how many of them it can do without.

    Two similar sets that are not equal have a signature in common. If one of them leaves out no
    more than it can do without, both still have one in common.
    """
    out, slack = [], len(s)
    value, high = mix(s), s >> np.uint64(32)
    for b in _bands_of(len(s)):
        at = (high * np.uint64(b.segments)) >> np.uint64(32)
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        seg, sums = at[first].astype(np.int64), np.add.reduceat(value, first)
        tag = _tags(b.number, b.segments)
        out.append(mix(sums ^ tag[seg]))
        weak = b.segments - len(seg)
        strong = seg
        if b.near:
            lengths = np.diff(np.append(first, len(s)))
            left = np.repeat(sums, lengths) - value
            out.append(mix(left ^ tag[at.astype(np.int64)])[np.repeat(lengths, lengths) > 1])
            weak += int((lengths == 1).sum())
            strong = seg[lengths > 1]
        if weak > b.spare:  # such sets find each other by their weak segments
            empty = np.ones(b.segments, bool)
            empty[strong] = False
            out.append(mix(tag[empty]))
        slack = min(slack, 0 if b.near else max(0, b.spare - weak))
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), slack
