"""Periodic runs of words, found by internal pattern matching.

A run is a stretch of words that repeats itself with some smallest period at least twice and that no
neighbouring word continues. If its period is ``2L - 1`` or more, its first period holds a block of
``L`` words that begins at a multiple of ``L``, and the block occurs again one period later. So for every
dyadic length the blocks are asked for their occurrences in the window ``2L - 1`` to ``4L - 2`` words on: the
suffix array gives all occurrences of a block as one interval, and a wavelet tree over the array gives the next or
last position of the interval in a window without listing it. Each half of a window is so short that the occurrences
in it form one arithmetic progression; one or two of them are candidate periods themselves, a longer one
gives those that the ends of its periodic stretch allow. Candidates are extended to both sides through the
names of dyadic substrings, which prefix doubling leaves behind, and kept if they are long enough.

All texts of a chunk share one suffix array; words of different texts never count as equal, so a chunk is only
a matter of speed. Spark splits the table, and no text meets another one.

Defined results: a null or empty text has no words and no runs; repeated rows get the same result; null ids are kept; an
empty table gives an empty result; further columns are not read; a text of any length is searched whole.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeweave.llm.common import bounded_batches
from lakeweave.llm.quality import _Numbered

# The shortest run that counts. Blocks of four words at every second place meet all periods below seven in it.
SHORTEST = 12
BASE = 4
# Words that share a suffix array, where the texts are not longer themselves.
CHUNK_WORDS = 120_000

_COLUMNS = (
    "doc_id string, n_runs long, start long, length long, period long, exponent_milli long, "
    "runs_sha256 string, collapsed_sha256 string"
)


# -- suffix array, names of dyadic substrings, wavelet tree ----------------------------------------


class Suffixes:
    """``names[k][i]`` is the first place of the suffix array whose suffix begins with the ``2**k`` words at ``i``.

    ``ends[k]`` has the place after the last one, at the first one's index. There are as many levels as the longest
    repeated substring needs; places that nothing else equals are not sorted again.
    """

    def __init__(self, words: np.ndarray):
        n = len(words)
        order = np.argsort(words, kind="stable")
        first, end = _groups(words[order])
        name = np.empty(n, np.int64)
        name[order] = first
        self.names, self.ends = [name], [_by_first(first, end, n)]
        step, places = 1, np.arange(n)
        while True:
            # ``first`` and ``end`` are those of ``places``, which are the open ones and ascend.
            still = end - first > 1
            places, first = places[still], first[still]
            if not len(places):
                break
            at = order[places]
            after = np.where(at + step < n, name[np.minimum(at + step, n - 1)], -1)
            key = first * (n + 1) + after + 1
            sort = np.argsort(key, kind="stable")
            order[places] = at[sort]
            low, high = _groups(key[sort])
            first, end = places[low], places[high - 1] + 1
            name = name.copy()
            name[order[places]] = first
            ends = self.ends[-1].copy()
            ends[first] = end
            self.names.append(name)
            self.ends.append(ends)
            step *= 2
        self.order = order

    def after(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words from ``i`` on equal those from ``j`` on, ``i`` below ``j``."""
        n, length = len(self.order), np.zeros(len(i), np.int64)
        for k in range(len(self.names) - 1, -1, -1):
            inside = j + length + (1 << k) <= n
            p, q = np.where(inside, i + length, 0), np.where(inside, j + length, 0)
            length += ((self.names[k][p] == self.names[k][q]) & inside).astype(np.int64) << k
        return length

    def before(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words that end before ``i`` equal those that end before ``j``, ``i`` below ``j``."""
        length = np.zeros(len(i), np.int64)
        for k in range(len(self.names) - 1, -1, -1):
            p = i - length - (1 << k)
            inside = p >= 0
            p, q = np.where(inside, p, 0), np.where(inside, j - length - (1 << k), 0)
            length += ((self.names[k][p] == self.names[k][q]) & inside).astype(np.int64) << k
        return length


def _groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per entry of an ascending array where the entries equal to it begin and end."""
    if not len(keys):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    sizes = np.diff(starts, append=len(keys))
    return np.repeat(starts, sizes), np.repeat(starts + sizes, sizes)


def _by_first(first: np.ndarray, end: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n, np.int64)
    out[first] = end
    return out


class Wavelet:
    """A wavelet matrix over numbers: for many intervals at once, the next or last number of each in a range."""

    def __init__(self, values: np.ndarray, top: int):
        self.bits = range(max(1, int(top).bit_length()) - 1, -1, -1)
        self.top, self.zeros = 1 << len(self.bits), []
        for b in self.bits:
            one = (values >> b) & 1 == 1
            self.zeros.append(np.concatenate(([0], np.cumsum(~one))))
            values = np.concatenate((values[~one], values[one]))

    def below(self, low: np.ndarray, high: np.ndarray, x: np.ndarray) -> np.ndarray:
        """How many numbers of ``low:high`` are below ``x``."""
        whole, x = x >= self.top, np.minimum(x, self.top - 1)
        count, size = np.zeros(len(low), np.int64), high - low
        for b, zeros in zip(self.bits, self.zeros):
            one = (x >> b) & 1 == 1
            l, h = zeros[low], zeros[high]
            count += np.where(one, h - l, 0)
            low, high = np.where(one, zeros[-1] + low - l, l), np.where(one, zeros[-1] + high - h, h)
        return np.where(whole, size, count)

    def nth(self, low: np.ndarray, high: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The ``n``-th smallest number of ``low:high``, from 0."""
        value = np.zeros(len(low), np.int64)
        for b, zeros in zip(self.bits, self.zeros):
            l, h = zeros[low], zeros[high]
            one = n >= h - l
            n = np.where(one, n - (h - l), n)
            value |= one.astype(np.int64) << b
            low, high = np.where(one, zeros[-1] + low - l, l), np.where(one, zeros[-1] + high - h, h)
        return value

    def successor(self, low: np.ndarray, high: np.ndarray, x: np.ndarray, last: np.ndarray) -> np.ndarray:
        """The smallest number of ``low:high`` from ``x`` to ``last``, or -1."""
        out = np.full(len(low), -1, np.int64)
        n = self.below(low, high, x)
        some = np.flatnonzero(n < high - low)
        value = self.nth(low[some], high[some], n[some])
        out[some] = np.where(value <= last[some], value, -1)
        return out

    def predecessor(self, low: np.ndarray, high: np.ndarray, last: np.ndarray) -> np.ndarray:
        """The largest number of ``low:high`` up to ``last``; there must be one."""
        return self.nth(low, high, self.below(low, high, last + 1) - 1)


# -- runs ------------------------------------------------------------------------------------------


def runs(words: np.ndarray) -> np.ndarray:
    """``start, length, period`` of every run, by start and period. Equal numbers are equal words."""
    index = Suffixes(words)
    n, base = len(words), BASE.bit_length() - 1
    if len(index.names) <= base:
        return np.zeros((0, 3), np.int64)
    # Only suffixes that share their first block with another one can be answers.
    first = index.names[base][index.order]
    shared = index.ends[base][first] - first > 1
    kept = np.concatenate(([0], np.cumsum(shared)))
    wavelet = Wavelet(index.order[shared], n)

    def blocks(level: int, stride: int):
        at = np.arange(0, n, stride)
        low = index.names[level][at]
        high = index.ends[level][low]
        some = high - low > 1
        return at[some], kept[low[some]], kept[high[some]]

    found = [_short_periods(wavelet, *blocks(base, 2))]
    for level in range(base, len(index.names)):
        size = 1 << level
        at, low, high = blocks(level, size)
        if not len(at):
            break
        for nearest in (2 * size - 1, 3 * size - 1):
            found.append(_periods(index, wavelet, at, low, high, at + nearest, at + nearest + size - 1))
    at, period = np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])
    start = at - index.before(at, at + period)
    end = at + period + index.after(at, at + period)
    long = end - start >= np.maximum(SHORTEST, 2 * period)
    start, end, period = start[long], end[long], period[long]
    # The same stretch is found by many blocks, and with multiples of its period.
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    new = np.ones(len(start), bool)
    new[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    out = np.stack([start[new], end[new] - start[new], period[new]], axis=1)
    return out[np.lexsort((out[:, 2], out[:, 0]))]


def _short_periods(wavelet: Wavelet, at, low, high) -> tuple[np.ndarray, np.ndarray]:
    """All occurrences of a block up to six words on."""
    places, periods, last, x = [], [], at + 2 * BASE - 2, at
    while len(at):
        x = wavelet.successor(low, high, x + 1, last)
        some = x >= 0
        at, low, high, last, x = at[some], low[some], high[some], last[some], x[some]
        places.append(at)
        periods.append(x - at)
    return np.concatenate([np.zeros(0, np.int64), *places]), np.concatenate([np.zeros(0, np.int64), *periods])


def _periods(index: Suffixes, wavelet: Wavelet, at, low, high, nearest, last) -> tuple[np.ndarray, np.ndarray]:
    """Candidate periods from the occurrences of blocks in half a window."""
    x = wavelet.successor(low, high, nearest, last)
    some = x >= 0
    at, low, high, last, x = at[some], low[some], high[some], last[some], x[some]
    y = wavelet.successor(low, high, x + 1, last)
    places, periods = [at], [x - at]
    some = y >= 0
    at, low, high, last, x, y = at[some], low[some], high[some], last[some], x[some], y[some]
    places.append(at)
    periods.append(y - at)
    z = wavelet.predecessor(low, high, last)
    some = z > y
    at, x, z, step = at[some], x[some], z[some], (y - x)[some]
    # Three or more: the block itself has the period ``step``. Its stretch and that of the occurrences end somewhere.
    left, right = at - index.before(at, at + step), at + step + index.after(at, at + step)
    other_left, other_right = x - index.before(x, x + step), x + step + index.after(x, x + step)
    for period in (other_right - right, other_left - left):
        usable = (period >= x - at) & (period <= z - at)
        places.append(at[usable])
        periods.append(period[usable])
    # Two stretches that meet out of step make a run of every distance between them.
    meet = (other_left <= right) & (other_left != left)
    at, x, z, step = at[meet], x[meet], z[meet], step[meet]
    count = (z - x) // step + 1
    each = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    places.append(np.repeat(at, count))
    periods.append(np.repeat(x - at, count) + each * np.repeat(step, count))
    return np.concatenate(places), np.concatenate(periods)


# -- texts -----------------------------------------------------------------------------------------


def periodic_tail(doc_id: str | None, words: list[bytes]) -> list[bytes]:
    """The words of the query's contract: every tenth document's tail repeats its beginning."""
    h = zlib.crc32(doc_id.encode()) if doc_id is not None else 1
    if h % 10 or not words:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    unit, rest = words[a : a + p], n - a
    return words[:a] + (unit * (rest // len(unit) + 1))[:rest]


def detect_all(split: list[list[bytes]]) -> list[tuple]:
    """Per list of words the columns of the result from ``n_runs`` on."""
    number = _Numbered()
    sizes = np.array([len(w) for w in split], np.int64)
    offsets = np.concatenate(([0], np.cumsum(sizes)))
    ids = np.array([number[x] for w in split for x in w], np.int64)
    own = ids + np.repeat(np.arange(len(split)), sizes) * max(1, len(number))
    found = runs(own)
    doc = np.searchsorted(offsets, found[:, 0], "right") - 1
    borders = np.searchsorted(doc, np.arange(len(split) + 1))
    # Words after the first period of a run are copies.
    change = np.zeros(len(own) + 1, np.int64)
    np.add.at(change, found[:, 0] + found[:, 2], 1)
    np.add.at(change, found[:, 0] + found[:, 1], -1)
    copied = np.cumsum(change)[:-1] > 0
    out = []
    for i, words in enumerate(split):
        mine = found[borders[i] : borders[i + 1]] - (offsets[i], 0, 0)
        kept, best, listed = words, (None, None, None, None), b""
        if len(mine):
            mask = copied[offsets[i] : offsets[i + 1]]
            kept = [w for w, c in zip(words, mask.tolist()) if not c]
            start, length, period = mine[np.lexsort((mine[:, 2], mine[:, 0], -mine[:, 1]))[0]].tolist()
            best = start, length, period, 1000 * length // period
            listed = "".join(f"{s},{l},{p}\n" for s, l, p in mine.tolist()).encode()
        digests = hashlib.sha256(listed).hexdigest(), hashlib.sha256(b" ".join(kept)).hexdigest()
        out.append((len(mine), *best, *digests))
    return out


def detect(documents: DataFrame, prepare: Callable[[str | None, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """``doc_id``, the number of runs, the longest one, and digests of all runs and of the words without copies.

    ``prepare`` may change the words of a document before the search.
    """
    names = [x.split()[0] for x in _COLUMNS.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids, split, held = [], [], 0
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                words = (text or "").encode().split()
                ids.append(doc_id)
                split.append(prepare(doc_id, words) if prepare else words)
                held += len(words)
                if held >= CHUNK_WORDS:
                    yield _frame(ids, split, names)
                    ids, split, held = [], [], 0
            if ids:
                yield _frame(ids, split, names)

    texts = documents.select(documents["doc_id"].cast("string").alias("doc_id"), documents["text"].cast("string").alias("text"))
    return bounded_batches(texts).mapInPandas(run, _COLUMNS).withColumn("doc_id", F.col("doc_id").cast("long"))


def _frame(ids: list, split: list[list[bytes]], names: list[str]) -> pd.DataFrame:
    columns = dict(zip(names, zip(*[(d, *x) for d, x in zip(ids, detect_all(split))])))
    kinds = {c: "Int64" for c in ("start", "length", "period", "exponent_milli")}
    return pd.DataFrame({c: pd.array(v, kinds[c]) if c in kinds else list(v) for c, v in columns.items()})
