"""Toxicity behind a noisy channel (op11) against plain versions and held-out labels."""

import itertools
import random
import re
import unicodedata
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from brute import prose
from lakeweave.llm import toxicity as X


def plain_grams(texts):
    counts = Counter()
    for t in texts:
        word = []
        for c in X.plain(t) + "\n":
            k = X.class_of(c)
            if k:
                word.append(k)
            elif word:
                padded = [0, 0, 0, *word, 0]
                counts.update(tuple(padded[i : i + 4]) for i in range(len(padded) - 3))
                word = []
    return counts


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("ab1é ß.\n€", max_size=20), max_size=5))
def test_gram_counts(texts):
    got = X.gram_counts(texts).reshape((X.SIZE,) * 4)
    assert {tuple(map(int, k)): int(got[tuple(k)]) for k in np.argwhere(got)} == plain_grams(texts)


def test_smoothing():
    counts = X.gram_counts(["abc abd xyz", "abc"])
    model = np.exp(X.smoothed(counts).astype(float)).reshape((X.SIZE,) * 4)
    assert np.allclose(model.sum(-1), 1)
    assert model[1, 2, 3, 0] > 0.2 and model[0, 0, 0, 1] > model[0, 0, 0, 2]


CORPUS = ["you are an idiot and a clown with nothing to say about the weather today " * 3, prose(7, 3000)]


@pytest.fixture(scope="module")
def reader():
    return X.Reader(X.smoothed(X.gram_counts(CORPUS * 5)))


def every_reading(stretch, model):
    """The best of all paths, each of them tried."""
    runs = [(m[1], min(m.end() - m.start(), 4)) for m in X._RUNS.finditer(stretch)]
    best = None
    for path in itertools.product(*[X._arcs(c, n) for c, n in runs]):
        context, total = [0, 0, 0], 0.0
        for kinds, _, charge in path:
            total -= charge
            for kind in [0] if kinds is None else kinds:
                if kind == 0 and context[-1] == 0:
                    continue
                a, b, c = context
                total += model[((a * X.SIZE + b) * X.SIZE + c) * X.SIZE + kind]
                context = [b, c, kind] if kind else [0, 0, 0]
        if context[-1]:
            a, b, c = context
            total += model[((a * X.SIZE + b) * X.SIZE + c) * X.SIZE]
        if best is None or total > best[0] + 1e-9:
            best = (total, "".join(t for _, t, _ in path))
    return best


@settings(max_examples=150, deadline=None)
@given(st.text("idot10!.* ", max_size=7))
def test_viterbi_finds_the_best_path(reader, stretch):
    found = X.decode(stretch, reader.model)
    total, text = every_reading(stretch, reader.model)

    def worth(reading):
        return max((t for t, r in readings(stretch, reader.model) if r == reading), default=None)

    assert found == text or abs(worth(found) - total) < 1e-4


def readings(stretch, model):
    runs = [(m[1], min(m.end() - m.start(), 4)) for m in X._RUNS.finditer(stretch)]
    for path in itertools.product(*[X._arcs(c, n) for c, n in runs]):
        context, total = (0, 0, 0), 0.0
        for kinds, _, charge in path:
            total -= charge
            for kind in [0] if kinds is None else kinds:
                if kind or context[-1]:
                    a, b, c = context
                    total += model[((a * X.SIZE + b) * X.SIZE + c) * X.SIZE + kind]
                    context = (b, c, kind) if kind else (0, 0, 0)
        if context[-1]:
            a, b, c = context
            total += model[((a * X.SIZE + b) * X.SIZE + c) * X.SIZE]
        yield total, "".join(t for _, t, _ in path)


DISGUISES = ["1d10t", "i d i o t", "i.d.i.o.t", "idiooooot", "iiddiioott", "ídíöt", "id*ot", "c-l-o-w-n", "cl0wn", "c l 0 w n", "CL0WN!!", "i​diot"]


@pytest.mark.parametrize("disguise", DISGUISES)
def test_disguises(reader, disguise):
    assert reader.restore(f"you are {disguise} today") in ("you are idiot today", "you are clown today")


def test_plain_words_stay(reader):
    assert reader.restore("Nothing is hidden, here: worthless looser (2024) 你好 привет!") == "nothing is hidden here worthless looser 2024 你好 привет"


def labelled(spark, rows):
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y, 1) for i, _, y in rows], "doc_id long, toxic int, quality int")
    return docs, labels


def corpus(n, disguise):
    rng, rows = random.Random(3), []
    for i in range(n):
        words, toxic = prose(1000 + i, 60).split(), int(i % 4 == 0)
        if toxic:
            for _ in range(3):
                words[rng.randrange(len(words))] = rng.choice(["zblorf", "quimt", "vexnop", "drukkel"])
        rows.append((i, " ".join(words), toxic))
    hidden = [(n + k, prose(5000 + k, 50) + " " + disguise(w), 1) for k, w in enumerate(["zblorf", "quimt", "vexnop", "drukkel"])]
    return rows, hidden


def test_held_out_and_disguised(spark):
    rows, hidden = corpus(600, lambda w: w.replace("o", "0").replace("e", "3").replace("i", "1") + " " + " ".join(w))
    docs, labels = labelled(spark, rows)
    more = spark.createDataFrame([(i, t) for i, t, _ in hidden], "doc_id long, text string")
    found = {r.doc_id: r for r in X.judge(docs.union(more), labels).collect()}
    held = [(found[i].predicted, y) for i, _, y in rows if found[i].held_out]
    assert len(held) > 80 and sum(p == y for p, y in held) / len(held) > 0.97
    assert all(found[i].predicted == 1 for i, _, _ in hidden)


def test_plain_weights(spark):
    rows, _ = corpus(300, str)
    docs, labels = labelled(spark, rows)
    model = X.fit(docs, labels)
    import zlib

    reader, a, b = X.Reader(model.language), Counter(), Counter()
    learned = [(t, y) for i, t, y in rows if zlib.crc32(str(i).encode()) % 5]
    for t, y in learned:
        (a if y else b).update({f for w in reader.words(t)[0] for f in X.features(w)})
    n_a = sum(y for _, y in learned)
    n_b = len(learned) - n_a
    want = set()
    for f in a:
        odds, error = X.log_odds(a[f], b[f], n_a, n_b)
        if a[f] >= X.LEAST_TEXTS and odds / error >= X.LEAST_ERRORS:
            want.add(f)
    assert set(model.counts) == want and "zblorf" in want
    for f, (x, y) in model.counts.items():
        assert abs(x - a[f]) < 1e-9 and abs(y - b[f]) < 1e-9


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 9), st.integers(0, 9)), min_size=1, max_size=12))
def test_isotonic_levels(parts):
    """Against the definition: the level is the largest least mean over the ranges around a place."""
    n, h = np.array([p[0] for p in parts], float), np.array([min(p) for p in parts], float)
    knots, levels = X.rising(np.arange(len(parts), dtype=float), n, h)
    for i in range(len(parts)):
        want = max(min(h[a : b + 1].sum() / n[a : b + 1].sum() for b in range(i, len(parts))) for a in range(i + 1))
        assert abs(np.interp(i, knots, levels) - want) < 1e-9


def test_copies_count_once(spark):
    """A word of one text with a thousand copies is no evidence."""
    rows, _ = corpus(200, str)
    copied = prose(99, 40) + " wibbleword"
    rows += [(1000 + k, copied, 1) for k in range(300)]
    model = X.fit(*labelled(spark, rows))
    assert "wibbleword" not in model.counts and "zblorf" in model.counts


def test_awkward_texts(spark, documents, texts, empty):
    labels = spark.createDataFrame([(7, 1, 0), (8, 0, 1), (9, 1, None), (None, 1, 1), (6, 0, 1), (6, 0, 0)], "doc_id long, quality int, toxic int")
    found = X.judge(documents, labels).collect()
    assert Counter(r.doc_id for r in found) == Counter(i for i, _ in texts)
    assert all(0 <= r.score <= 1 for r in found)
    assert X.judge(empty, labels).count() == 0
    none = X.judge(documents, labels.where("false")).collect()
    assert {r.score for r in none} == {0.5}
    assert {r.score for r in X.judge(documents, labels.where("doc_id = 8")).collect()} == {1.0}
    read = {r.doc_id: r.restored for r in X.restored(documents, X.smoothed(X.gram_counts(CORPUS))).collect()}
    assert read[1] == "" and read[4] == "one two"


def test_given_tables():
    """Held-out labels, of which a tenth of the toxic ones don't show in the text."""
    import os

    from lakeweave.llm.queries import QUERIES
    from pyspark.sql import SparkSession

    folder = "/root/testdata/sf0.01"
    if not os.path.isdir(folder):
        pytest.skip("no such tables here")
    spark = SparkSession.getActiveSession()
    found = QUERIES["op11_toxicity"](spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id")
    counts = {(r.toxic, r.predicted): r["count"] for r in found.where("held_out").groupBy("toxic", "predicted").count().collect()}
    assert counts.get((0, 1), 0) <= 2 and counts[(1, 1)] >= 3


def test_only_texts_of_other_characters_take_the_long_way(monkeypatch):
    normalized = []

    class Recorded:
        @staticmethod
        def normalize(form, text):
            normalized.append(text)
            return unicodedata.normalize(form, text)

    texts = ["Plain words, and more", "ein schöner Tag", "", "ὈΔΥΣΣΕΎΣ", "́x Σ", "again plain"]
    apart = sum(X.gram_counts([t]) for t in texts)
    monkeypatch.setattr(X, "unicodedata", Recorded)
    assert (X.gram_counts(texts) == apart).all()
    assert sorted(normalized) == sorted(t for t in texts if not t.isascii())


def test_plain_tokens_are_told_by_their_signs(reader):
    signs = re.compile(r"[\"'(\[{#%&*~<>=/\\-]*([a-z]+)[.,;:!?\"')\]}#%&*~<>=/\\-]*")
    stretched = re.compile(r"(.)\1\1|(.)\2.*(.)\3")
    rnd = random.Random(5)
    for _ in range(5000):
        token = "".join(rnd.choices("aabbcez.-!\"'()1$ßé", k=rnd.randint(1, 7)))
        match = signs.fullmatch(token)
        if match and not stretched.search(match[1]):
            assert reader.interpret(token) == (match[1],)
        tokens = [c * rnd.choice((1, 1, 1, 300)) for c in token]
        assert X._three_single(tokens) == any(all(len(t) == 1 for t in tokens[i : i + 3]) for i in range(len(tokens) - 2))
