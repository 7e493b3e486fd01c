"""Packing of documents into token sequences by non-negative least squares.

Documents are encoded once. Their windows of full length are sequences of their own; what
remains of each is kept whole where possible: combinations of two or three remainders that
fill a window exactly are enumerated, and non-negative least squares finds how often to use each so that
together they use up the histogram of lengths. Rounded down, they leave a few remainders over; these
are cut into pieces whose lengths are powers of two and laid end to end, longest first, so
that none crosses the end of a window. Only the last sequence can be short.

The histogram has as many entries as a window has tokens, so the plan is made on the driver. Which place a
remainder takes follows from its rank among those of its length: a task counts its own while it
writes the tokens, and the counts of the tasks before it are added afterwards. No task sees more
than its own documents, whatever length a third of them may have.

Defined results: a null or empty text is the end token alone; repeated rows and null ids are packed
like any other; an empty table gives an empty result; further columns are not read; a text of any length is
encoded whole. The numbering of sequences depends on how the table is split into tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from lakeweave.llm.common import BROADCAST_ROWS, bounded_batches
from lakeweave.session import materialize

WINDOW = 2048
END = 1
# Combinations that the plan weighs. All pairs come first, then triples, the commonest lengths first.
MAX_COMBINATIONS = 400_000
STEPS = 300

# Ids pass through Python as text: as numbers, a null among them would turn all into floating point.
_TOKENS = "doc_id string, task long, n long, rest int, nth long, nth_window long, ids binary"
_PIECES = T.StructType(
    [
        T.StructField("doc_id", T.StringType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("doc_tokens", T.LongType()),
        T.StructField("sequence_id", T.LongType()),
        T.StructField("offset", T.LongType()),
        T.StructField("ids", T.BinaryType()),
    ]
)


# -- encoding -----------------------------------------------------------------------------------


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(maxsize=2)
def _encoder(path: str):
    """Encodes a list of texts to lists of ids, as the vocabulary file's own library does.

    The file's merges are run by ``tiktoken``, which is several times faster on one core and gives the same
    ids; texts that hold the name of a special token, which the file turns into that token, go
    to ``tokenizers``.
    """
    import json

    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    own = lru_cache(maxsize=1)(lambda: Tokenizer.from_file(path))  # seldom needed and large
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    special = [t["content"] for t in spec.get("added_tokens", [])]
    letters = _byte_letters()
    ranks = {bytes(letters[c] for c in word): i for word, i in spec["model"]["vocab"].items() if word not in special}
    fast = tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(texts: list[str]) -> list[list[int]]:
        return [
            own().encode(t, add_special_tokens=False).ids if any(s in t for s in special) else fast.encode_ordinary(t)
            for t in texts
        ]

    return encode


def _width(path: str) -> str:
    from tokenizers import Tokenizer

    return "<u2" if max(Tokenizer.from_file(path).get_vocab().values()) < 1 << 16 else "<u4"


def _byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable ones for themselves."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


def encoded(documents: DataFrame, path: str, window: int = WINDOW) -> DataFrame:
    """``doc_id, task, n, rest, nth, nth_window, ids``: tokens of each document as little-endian numbers.

    ``rest`` is the length beyond full windows, ``nth`` the document's number among those of this length in
    its task and ``nth_window`` that of its first full window. Ids take 16 bits where the vocabulary allows.
    """
    width = _width(path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, task, seen, windows = _encoder(path), TaskContext.get().partitionId(), {}, 0
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.iloc[at : at + 256]
                rows = []
                for doc_id, ids in zip(part["doc_id"], encode([t or "" for t in part["text"]])):
                    n = len(ids) + 1
                    rest = n % window
                    nth = seen.get(rest, 0)
                    seen[rest] = nth + 1
                    rows.append((doc_id, task, n, rest, nth, windows, np.array([*ids, END], width).tobytes()))
                    windows += n // window
                yield pd.DataFrame(rows, columns=["doc_id", "task", "n", "rest", "nth", "nth_window", "ids"])

    texts = documents.select(documents["doc_id"].cast("string").alias("doc_id"), documents["text"].cast("string").alias("text"))
    return bounded_batches(texts).mapInPandas(run, _TOKENS)


# -- the plan -----------------------------------------------------------------------------------


@dataclass(frozen=True)
class Plan:
    """Where the remainders go. Combination ``i`` is laid ``times[i]`` times from sequence ``first[i]`` on.

    For length ``L`` the places are ``slots[starts[L]:starts[L + 1]]``: combination, offset, and how many
    remainders of this length come before it (``before``). ``planned[L]`` remainders have a place;
    the others are cut: ``piece_base[b, L]`` counts the pieces of 2**b tokens from shorter lengths, and
    ``address[b]`` is the first token of all pieces of that size behind ``tail``.
    """

    window: int
    first: np.ndarray
    starts: np.ndarray
    slot_combination: np.ndarray
    slot_offset: np.ndarray
    slot_before: np.ndarray
    planned: np.ndarray
    piece_base: np.ndarray
    address: np.ndarray
    tail: int
    total: int


def combinations(histogram: np.ndarray, limit: int = MAX_COMBINATIONS) -> np.ndarray:
    """Ascending triples of lengths that add up to a window; a pair begins with 0."""
    window = len(histogram)
    there = np.flatnonzero(histogram[1:]) + 1
    has = np.zeros(window + 1, bool)
    has[there] = True
    low = there[has[np.clip(window - there, 0, window)] & (2 * there <= window)]
    found = [np.stack([np.zeros_like(low), low, window - low], 1)]
    room = limit - len(low)
    # The commonest lengths are the ones that need most partners.
    for a in there[np.argsort(-histogram[there], kind="stable")]:
        if room <= 0:
            break
        b = there[there >= a]
        c = window - a - b
        ok = (c >= b) & has[np.clip(c, 0, window)] & (c > 0)
        found.append(np.stack([np.full(ok.sum(), a), b[ok], c[ok]], 1)[:room])
        room -= len(found[-1])
    return np.unique(np.concatenate(found), axis=0)


def least_squares(combos: np.ndarray, histogram: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """x >= 0 with the smallest squared difference of used and available lengths, by projected gradients."""
    if not len(combos):
        return np.zeros(0)
    want = histogram.astype(float).copy()
    want[0] = 0
    flat = combos.T.reshape(-1)
    k = len(combos)

    def used(x):
        out = np.bincount(flat, np.concatenate([x, x, x]), len(want))
        out[0] = 0
        return out

    def back(r):
        return r[combos].sum(axis=1)

    degree = np.bincount(flat, minlength=len(want)).astype(float)
    degree[0] = 0
    # A bound of the largest curvature per combination: the row sums of its normal matrix.
    rate = 1.0 / np.maximum(degree[combos].sum(axis=1), 1.0)
    x = np.zeros(k)
    y, t = x, 1.0
    for _ in range(steps):
        fresh = np.maximum(0.0, y - rate * back(used(y) - want))
        t_next = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = fresh + (t - 1) / t_next * (fresh - x)
        x, t = fresh, t_next
    return x


def rounded(combos: np.ndarray, x: np.ndarray, histogram: np.ndarray) -> np.ndarray:
    """Whole repeat counts that use no length more often than it is there."""
    left = histogram.astype(np.int64).copy()
    times = np.zeros(len(combos), np.int64)
    for whole in (True, False):  # the rounded solution first, then whatever still fits
        order = np.argsort(-x, kind="stable")
        for i in order:
            a, b, c = combos[i]
            parts = [p for p in (a, b, c) if p]
            most = min(left[p] // parts.count(p) for p in parts)
            n = min(int(np.floor(x[i] + 1e-6)), most) if whole else most
            if n > 0:
                times[i] += n
                for p in parts:
                    left[p] -= n
    return times


def make_plan(histogram: np.ndarray, full: int) -> Plan:
    """``histogram[L]`` remainders of length ``L`` in 1 to window - 1, behind ``full`` full windows."""
    window = len(histogram)
    histogram = histogram.astype(np.int64).copy()
    histogram[0] = 0
    combos = combinations(histogram)
    times = rounded(combos, least_squares(combos, histogram), histogram)
    combos, times = combos[times > 0], times[times > 0]
    first = full + np.concatenate([[0], np.cumsum(times)[:-1]]).astype(np.int64) if len(times) else np.zeros(0, np.int64)
    # Places by length, in the order of the combinations.
    lengths = combos.reshape(-1) if len(combos) else np.zeros(0, np.int64)
    offsets = np.concatenate([np.zeros((len(combos), 1), np.int64), np.cumsum(combos, axis=1)[:, :2]], 1).reshape(-1)
    owner = np.repeat(np.arange(len(combos)), 3)
    real = lengths > 0
    lengths, offsets, owner = lengths[real], offsets[real], owner[real]
    order = np.argsort(lengths, kind="stable")
    lengths, offsets, owner = lengths[order], offsets[order], owner[order]
    starts = np.searchsorted(lengths, np.arange(window + 1))
    running = np.concatenate([[0], np.cumsum(times[owner])]).astype(np.int64)
    before = running[:-1] - running[starts[lengths]] if len(lengths) else np.zeros(0, np.int64)
    planned = running[starts[1:]] - running[starts[:-1]]
    # The others, by the bits of their length.
    rest = histogram - planned
    bits = int(window).bit_length()
    pieces = np.stack([rest * ((np.arange(window) >> b) & 1) for b in range(bits)])
    piece_base = np.concatenate([np.zeros((bits, 1), np.int64), np.cumsum(pieces, axis=1)[:, :-1]], 1)
    size = pieces.sum(axis=1) << np.arange(bits)
    address = np.zeros(bits, np.int64)
    for b in reversed(range(bits - 1)):
        address[b] = address[b + 1] + size[b + 1]
    tail = full + int(times.sum())
    total = tail + int(-(-size.sum() // window))
    return Plan(window, first, starts, owner, offsets, before, planned, piece_base, address, tail, total)


def places(plan: Plan, rest: int, rank: int) -> list[tuple[int, int, int, int]]:
    """Start within the remainder, length, sequence and offset of the pieces of one remainder."""
    if rest == 0:
        return []
    if rank < plan.planned[rest]:
        lo, hi = plan.starts[rest], plan.starts[rest + 1]
        i = lo + int(np.searchsorted(plan.slot_before[lo:hi], rank, side="right")) - 1
        sequence = plan.first[plan.slot_combination[i]] + rank - plan.slot_before[i]
        return [(0, rest, int(sequence), int(plan.slot_offset[i]))]
    out, start, nth = [], 0, rank - int(plan.planned[rest])
    for b in reversed(range(len(plan.address))):
        if rest >> b & 1:
            at = int(plan.address[b]) + ((int(plan.piece_base[b, rest]) + nth) << b)
            out.append((start, 1 << b, plan.tail + at // plan.window, at % plan.window))
            start += 1 << b
    return out


# -- the job ------------------------------------------------------------------------------------


def pack(documents: DataFrame, path: str | None = None, window: int = WINDOW) -> DataFrame:
    """One row per piece: ``doc_id, start, length, doc_tokens, sequence_id, offset, ids``.

    ``ids`` are little-endian 32-bit numbers. ``window`` must be a power of two.
    """
    if window < 2 or window & (window - 1):
        raise ValueError("the window must be a power of two")
    spark = documents.sparkSession
    path = path or vocabulary_path()
    width = _width(path)
    tokens = materialize(encoded(documents, path, window), "tokens")
    counts = materialize(
        tokens.groupBy("task", "rest").agg(
            F.count("*").alias("docs"), F.sum(F.floor(F.col("n") / window)).cast("long").alias("windows")
        ),
        "lengths",
    )
    histogram = np.zeros(window, np.int64)
    for r in counts.groupBy("rest").agg(F.sum("docs").alias("docs")).collect():  # one row per length
        histogram[r["rest"]] = r["docs"]
    full = counts.agg(F.sum("windows")).first()[0] or 0
    plan = spark.sparkContext.broadcast(make_plan(histogram, full))
    # Ranks go on where the tasks before this one end; full windows are numbered likewise.
    by_task = W.partitionBy("rest").orderBy("task").rowsBetween(W.unboundedPreceding, -1)
    per_task = counts.groupBy("task").agg(F.sum("windows").alias("windows"))
    all_tasks = W.orderBy("task").rowsBetween(W.unboundedPreceding, -1)
    windows = per_task.select("task", F.coalesce(F.sum("windows").over(all_tasks), F.lit(0)).alias("first_window"))
    offsets = materialize(
        counts.select("task", "rest", F.coalesce(F.sum("docs").over(by_task), F.lit(0)).alias("base")).join(windows, "task"),
        "offsets",
    )
    few = counts.count() <= BROADCAST_ROWS
    placed = tokens.join(F.broadcast(offsets) if few else offsets, ["task", "rest"]).select(
        "doc_id", "n", "rest", (F.col("base") + F.col("nth")).alias("rank"),
        (F.col("first_window") + F.col("nth_window")).alias("sequence"), "ids",
    )

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        laid = plan.value
        for batch in batches:
            for at in range(0, len(batch), 512):
                rows = []
                for doc_id, n, rest, rank, sequence, ids in batch.iloc[at : at + 512].itertuples(index=False, name=None):
                    ids = np.frombuffer(ids, width).astype("<u4")
                    where = [(i * window, window, sequence + i, 0) for i in range(n // window)]
                    where += [(n - rest + s, size, q, o) for s, size, q, o in places(laid, rest, rank)]
                    rows += [(doc_id, s, size, n, q, o, ids[s : s + size].tobytes()) for s, size, q, o in where]
                yield pd.DataFrame(rows, columns=_PIECES.names)

    return placed.mapInPandas(cut, _PIECES).withColumn("doc_id", F.col("doc_id").cast("long"))
