"""The classifier (op4) against plain versions: slow statistics, one matrix, isotonic regression by definition."""

import math
import zlib
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

import brute
from lakeweave.llm import classifier


def slow_statistics(text):
    t = text or ""
    words = brute.words(t)
    raw, n = t.encode(), len(words)
    lines = [x for x in t.split("\n") if brute.words(x)]
    lengths = [len(w.encode()) for w in words] or [0]
    counts = Counter(words)
    mean = sum(lengths) / len(lengths)
    chars, size = max(1, len(t)), max(1, len(raw))
    symbols = sum(c in "#*$%&|<>" for c in t)
    high = sum(b >= 128 for b in raw)
    upper, lower = sum("A" <= c <= "Z" for c in t), sum("a" <= c <= "z" for c in t)
    shares = [k / len(raw) for k in Counter(raw).values()] if raw else []
    return [
        math.log(1 + n),
        mean,
        math.sqrt(sum((x - mean) ** 2 for x in lengths) / len(lengths)),
        symbols / chars,
        min(1.0, symbols / max(1, n)),
        sum(c in ".,;:!?\"'()-" for c in t) / chars,
        sum("0" <= c <= "9" for c in t) / chars,
        upper / chars,
        high / size,
        1 - len(set(lines)) / len(lines) if lines else 0,
        brute.base_counts(t)["n_repeat_words"] / max(1, n),
        math.log(1 + len(counts)) / math.log(1 + max(1, n)) if n else 1.0,
        max(counts.values()) / n if n else 1.0,
        math.log(1 + n / max(1, len(lines))),
        sum(len(x) < 20 for x in lines) / max(1, len(lines)),
        (upper + lower + high) / size,
        -sum(s * math.log2(s) for s in shares),
    ]


def test_statistics(texts):
    got = classifier.statistics([t for _, t in texts])
    for row, (_, t) in zip(got, texts):
        if brute.words(t or ""):
            np.testing.assert_allclose(row, slow_statistics(t), rtol=1e-9, atol=1e-9)
        else:
            assert np.isfinite(row).all()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 9), st.integers(0, 9)), min_size=1, max_size=12))
def test_isotonic_by_definition(pairs):
    """The level at a place is the greatest, over starts up to it, of the least mean over ends from it on."""
    rows = np.array([float(n) for n, _ in pairs])
    hits = np.array([float(min(n, h)) for n, h in pairs])
    knots, levels = classifier.isotonic(np.arange(len(rows), dtype=float), rows, hits)
    mean = lambda a, b: hits[a : b + 1].sum() / rows[a : b + 1].sum()
    m = len(rows)
    want = [max(min(mean(a, b) for b in range(i, m)) for a in range(i + 1)) for i in range(m)]
    assert np.all(np.diff(knots) > 0)
    np.testing.assert_allclose(levels, sorted({round(w, 12) for w in want}), atol=1e-9)


def test_scores_from_one_matrix(spark):
    folder = "/root/testdata/sf0.01"
    documents, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    texts = {r.doc_id: r.text for r in documents.collect()}
    fold = lambda i: zlib.crc32(str(i).encode()) % 5
    known = [(r.doc_id, float(r.quality)) for r in labels.collect() if r.quality is not None and r.doc_id in texts]
    x = {i: row for i, row in zip(texts, classifier.statistics(list(texts.values())))}
    a = np.array([x[i] for i, _ in known if fold(i) > 1])
    y = np.array([q for i, q in known if fold(i) > 1])
    mean, spread = a.mean(0), a.std(0)
    spread[spread <= 1e-9] = 1.0
    z = lambda m: classifier.fourier((m - mean) / spread)
    penalty = np.eye(classifier.FEATURES + 1) * classifier.RIDGE
    penalty[-1, -1] = 0
    weights = np.linalg.solve(z(a).T @ z(a) + penalty, z(a).T @ y)
    step = 2 / classifier.BINS
    bins = {}
    for i, q in known:
        if fold(i) == 1:
            raw = np.clip(z(x[i][None])[0] @ weights, -0.5, 1.5)
            bins.setdefault(int(np.round((raw + 0.5) / step)), []).append(q)
    places = sorted(bins)
    knots, levels = classifier.isotonic(
        np.array(places) * step - 0.5, np.array([len(bins[p]) for p in places], float), np.array([sum(bins[p]) for p in places])
    )
    got = {r.doc_id: r for r in classifier.judge(documents, labels).collect()}
    assert set(got) == set(texts)
    for i, row in x.items():
        want = float(np.clip(np.interp(z(row[None])[0] @ weights, knots, levels), 0, 1))
        assert abs(got[i].score - want) < 1e-4
        assert got[i].held_out == (fold(i) == 0) and got[i].predicted == int(got[i].score >= 0.3)
