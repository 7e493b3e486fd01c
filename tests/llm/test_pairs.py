"""Decontamination (op1) and the Jaccard join (op7) against plain versions."""

import random
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import brute
from brute import prose
from lakeweave.llm import decontaminate, jaccard
from lakeweave.llm import shingle_sets as S
from lakeweave.llm.common import value_bytes, within
from lakeweave.llm.graph import components


def test_contained_items(spark, documents, texts, empty):
    body = texts[5][1].split()
    items = [
        (1, " ".join(body[20_000:20_030])),  # deep inside a long text
        (2, " ".join(body[100:120] + ["other"] * 3 + body[120:130])),
        (3, None),
        (4, ""),
        (5, "ONE two"),
        (6, prose(3, 60)),
        (6, prose(3, 60)),
        (None, prose(4, 50)),
        (7, prose(99, 40)),
    ]
    frame = spark.createDataFrame([(*x, "y") for x in items], "item_id long, text string, n_item string")
    got = decontaminate.search(documents, frame).select("doc_id", "item_id", "shared", "n_item").collect()
    want = brute.contained(texts, items)
    assert Counter(map(tuple, got)) == Counter(want) and (6, 1, 26, 26) in want
    clean = decontaminate.clean(documents, frame)
    flagged = {d for d, _, _, _ in want}
    assert Counter(r.doc_id for r in clean.collect() if r.doc_id) == Counter(
        i for i, _ in texts if i and i not in flagged
    )
    assert clean.columns == documents.columns
    assert decontaminate.search(empty, frame).count() == 0
    assert decontaminate.search(documents, frame.where("false")).count() == 0


def test_short_items_inside_long_texts(spark):
    body = prose(8, 104).split()
    rows = [
        (1, " ".join([*body[:50], "Alpha", "beta\ngamma", "delta", *body[50:]])),
        (2, " ".join([*body[:50], "alpha", "beta", "x", "gamma", "delta", *body[50:]])),
        (3, "alpha beta gamma delta"),
        (4, "alpha"),
        (5, prose(9, 5000) + " solo"),
        (6, None),
    ]
    items = [(1, "alpha beta gamma delta"), (2, "gamma delta"), (3, "solo"), (4, "beta alpha"), (5, "alpha"), (6, "")]
    got = decontaminate.search(
        spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    )
    got = {tuple(r) for r in got.select("doc_id", "item_id", "shared", "n_item").collect()}
    pairs = {(1, 1), (1, 2), (1, 5), (2, 2), (2, 5), (3, 1), (3, 2), (3, 5), (4, 5), (5, 3)}
    assert got == {(*p, 1, 1) for p in pairs} == brute.contained(rows, items)


def test_partitions_by_size(spark):
    """A text enters only the partitions of which it can hold an item, and none of its items is missed."""
    items = [(n, prose(200 + n, n, 10**6)) for n in (1, 5, 7, 12, 40, 41, 90, 300, 1000)]
    rows = [(n, f"{prose(n, 9)} {text} {prose(n + 1, 9)}") for n, text in items]
    rows += [(n + 1, text.rsplit(" ", max(1, n // 9))[0]) for n, text in items if n > 1]
    frame = spark.createDataFrame(items, "item_id long, text string")
    index = decontaminate.sketches(decontaminate.item_shingles(frame))
    floors = decontaminate.partitions(index).orderBy("part").collect()
    assert len(floors) >= 6 and [r.least for r in floors] == sorted(r.least for r in floors)
    reach = spark.range(2000).select("id", decontaminate._reach(F.col("id"), floors).alias("reach")).collect()
    for r in reach:
        assert r.reach == max((f.part for f in floors if f.least <= r.id), default=-1)
    got = decontaminate.search(spark.createDataFrame(rows, "doc_id long, text string"), frame)
    assert {tuple(r) for r in got.select("doc_id", "item_id", "shared", "n_item").collect()} == brute.contained(rows, items)


def test_broadcast_is_bounded_by_bytes(spark):
    frame = spark.createDataFrame([(i, "x" * 1000) for i in range(20)], "a long, t string")
    plan = lambda side: spark.range(5).withColumnRenamed("id", "a").join(side, "a")._jdf.queryExecution().logical().toString()
    assert value_bytes(frame) == 20 * 1008
    assert "broadcast" in plan(within(frame)) and "broadcast" not in plan(within(frame, size=10_000))


def test_sketch_reaches_every_threshold(spark):
    """Of an item's shingles any 80 percent meet its sketch."""
    r = random.Random(5)
    item = [f"v{i}" for i in range(30)]
    rows = []
    for i in range(200):
        words = item[:]
        for _ in range(r.randrange(3)):
            words[r.randrange(30)] = f"z{i}"
        rows.append((i, " ".join([*prose(i, 50).split(), *words, *prose(i + 1000, 50).split()])))
    documents = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    got = decontaminate.search(documents, items).select("doc_id", "item_id", "shared", "n_item").collect()
    assert set(map(tuple, got)) == brute.contained(rows, [(1, " ".join(item))])


@settings(max_examples=300, deadline=None)
@given(st.integers(1, 300), st.integers(0, 80), st.integers(0, 10**9))
def test_similar_sets_share_a_signature(size, edits, seed):
    r = np.random.default_rng(seed)
    a = np.unique(r.integers(0, 2**64 - 1, size, np.uint64))
    drop = r.integers(0, edits + 1)
    b = np.unique(np.concatenate([a[min(drop, len(a) - 1) :], r.integers(0, 2**64 - 1, edits - drop, np.uint64)]))
    assert S.may_be_similar(S.parity(a), len(a), S.parity(b), len(b)) or not S.similar(a, b)
    if S.similar(a, b) and not np.array_equal(a, b):
        (x, slack), (y, _) = S.signatures(a), S.signatures(b)
        shared = np.intersect1d(x, y)
        assert len(shared) > 0
        assert len(np.intersect1d(np.setdiff1d(x, shared[:slack]), y)) > 0  # it can do without that many


def near_copies(seed, copies, length, most):
    r = random.Random(seed)
    base = prose(seed, length, 3000).split()
    out = []
    for i in range(copies):
        words = base[:]
        for _ in range(r.randrange(most + 1)):
            words[r.randrange(length)] = f"e{r.randrange(10**6)}"
        out.append(" ".join(words))
    return out


def test_components_of_groups(spark, monkeypatch):
    """Groups of near copies about the threshold, short ones, and a passage that many texts share."""
    monkeypatch.setattr(jaccard, "BLOCK", 16)
    passage = prose(77, 60, 3000)
    texts = near_copies(1, 70, 120, 6) + near_copies(2, 60, 300, 14) + near_copies(3, 40, 14, 1) + near_copies(4, 40, 30, 2)
    texts += [f"{passage} {prose(500 + i, 25 + i % 30, 3000)}" for i in range(60)]
    texts += [prose(7, 40)] * 30 + [None, "", "a b", "a b", "A B", "a c"]
    rows = [(1000 - i, t) for i, t in enumerate(texts)]
    got = jaccard.linked(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    sets = [brute.shingles(brute.words(brute.lower_ascii(t))) for _, t in rows]
    labels = brute.components(sets)
    least = {}
    for (i, _), label in zip(rows, labels):
        least[label] = min(least.get(label, i), i)
    want = {(i, len(s), least[label]) for (i, _), s, label in zip(rows, sets, labels)}
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got} == want
    assert len(got) == len(rows)


def test_awkward_documents(documents, texts, empty):
    got = jaccard.linked(documents).select("doc_id", "n_shingles", "component_id").collect()
    by_id = {r.doc_id: r for r in got if r.doc_id}
    assert len(got) == len(texts)
    assert by_id[7].component_id == by_id[8].component_id == 7
    assert by_id[1].n_shingles == 0 and by_id[1].component_id == 1
    assert by_id[4].n_shingles == 1 and by_id[6].component_id == 6
    assert all(r.component_id is None for r in got if r.doc_id is None)
    assert jaccard.linked(empty).count() == 0


def test_one_of_each_component_stays(documents, texts):
    kept = jaccard.keep_one(documents)
    assert kept.columns == documents.columns
    rows = kept.collect()
    ids = Counter(r.doc_id for r in rows)
    assert ids[6] == 1 and ids[7] == 1 and ids[8] == 0 and ids[None] == 2 and ids[1] == 1
    assert all(r.rk == "x" for r in rows)


def test_chains_are_one_component(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (5, 5)], "a long, b long")
    got = {(r.node, r.component) for r in components(links).collect()}
    assert got == {(i, 0) for i in range(41)} | {(100, 100), (101, 100)}
    assert components(links.where("false")).count() == 0
