"""Periodic runs (op12) against a plain version."""

import hashlib
import random
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

import brute
from lakeweave.llm import periods


def plain_runs(w):
    """Every maximal stretch of every distance, with its smallest period only."""
    found, n = {}, len(w)
    for q in range(1, n // 2 + 1):
        i = 0
        while i < n - q:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j < n - q and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(12, 2 * q):
                found.setdefault((i, j + q - i), q)  # periods ascend, so the first one is the smallest
            i = j
    return sorted(((s, length, q) for (s, length), q in found.items()), key=lambda r: (r[0], r[2]))


def plain_row(doc_id, text, plant):
    w = brute.words(text)
    n = len(w)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if plant and h % 10 == 0 and n > 0:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = plain_runs(w)
    copies = {i for s, length, q in found for i in range(s + q, s + length)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (
        doc_id, len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
        sha("".join(f"{s},{length},{q}\n" for s, length, q in found)), sha(" ".join(x for i, x in enumerate(w) if i not in copies)),
    )


def got(words):
    return [tuple(r) for r in periods.runs(np.array(words, np.int64)).tolist()]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(0, 1), max_size=60))
def test_two_words(words):
    assert got(words) == plain_runs(words)


_UNIT = st.lists(st.integers(0, 2), min_size=1, max_size=12)


@settings(max_examples=600, deadline=None)
@given(st.lists(st.tuples(_UNIT, st.integers(1, 12), st.integers(0, 5)), max_size=7))
def test_repeated_units(parts):
    """Stretches of small periods next to each other, in and out of step."""
    words = [x for unit, times, cut in parts for x in (unit * times)[cut:]]
    assert got(words) == plain_runs(words)


def test_stretches_out_of_step():
    for left in range(3, 40, 4):
        for right in range(3, 40, 5):
            for unit in ([0, 1], [0, 0, 1], [0]):
                for glue in ([], [0], [1], [2], [1, 1]):
                    words = (unit * 40)[:left] + glue + (unit * 40)[1 : 1 + right]
                    words = words + [9] + words
                    assert got(words) == plain_runs(words)


def test_random_walks():
    rng = random.Random(5)
    for _ in range(60):
        words = []
        for _ in range(rng.randint(1, 6)):
            at = rng.randint(0, max(0, len(words) - 30))
            words += [rng.randint(0, 3) for _ in range(rng.randint(0, 20))] + words[at : at + rng.randint(0, 90)] * rng.randint(1, 3)
        assert got(words) == plain_runs(words)


def test_fibonacci_word():
    a, b = [0], [0, 1]
    while len(b) < 700:
        a, b = b, b + a
    assert got(b) == plain_runs(b)


def rows(df):
    columns = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
    return sorted(map(repr, (tuple(r[c] for c in columns) for r in df.collect())))


def test_awkward_texts(documents, texts, empty):
    assert periods.detect(empty).count() == 0
    short = [(i, t) for i, t in texts if len(t or "") < 5000]
    want = sorted(repr(plain_row(i, t, False)) for i, t in short)
    assert rows(periods.detect(documents.where("coalesce(length(text), 0) < 5000"))) == want
    assert periods.detect(documents).count() == len(texts)


def test_long_periodic_text(spark):
    text = "the same " * 60_000 + "end"
    r = periods.detect(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (r.n_runs, r.start, r.length, r.period) == (1, 0, 120_000, 2)
    assert r.collapsed_sha256 == hashlib.sha256(b"the same end").hexdigest()


def test_query(spark, sf_dir):
    from lakeweave.llm.queries import QUERIES

    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    want = sorted(repr(plain_row(i, t, True)) for i, t in texts if len(brute.words(t)) < 1500)
    ids = {i for i, t in texts if len(brute.words(t)) < 1500}
    found = QUERIES["op12_periodic_runs"](spark, sf_dir)
    assert found.count() == len(texts)
    assert rows(found.where(found.doc_id.isin(list(ids)))) == want
