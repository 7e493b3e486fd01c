"""Quality rules (op5) and the classifier (op4)."""

from collections import Counter, defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

import brute
from lakeweave.llm import classifier, quality


def test_counts(documents, texts):
    judged = quality.judge(documents).select("row.doc_id", "row.text", "m.*", "base_failed", "kept").collect()
    assert Counter(r.doc_id for r in judged) == Counter(i for i, _ in texts)
    for r in judged:
        want = brute.base_counts(r.text)
        assert {k: r[k] for k in want} == want
        failed = want["n_words"] < 10 or 100 * want["n_repeat_words"] > 20 * want["n_words"]
        assert r.base_failed == failed and not (failed and r.kept)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text("ab \n#", max_size=60), max_size=6))
def test_counts_of_any_text(texts):
    got = quality.measure(texts, quality.vocabulary_path())
    for i, t in enumerate(texts):
        want = brute.base_counts(t)
        assert {k: int(got[k][i]) for k in want} == want


def test_repeated_windows_when_keys_collide(monkeypatch):
    ids = np.array([1, 2, 3, 4, 5, 6, 1, 2, 3, 4, 5, 9])
    doc = np.zeros(len(ids), np.int64)
    assert quality.repeated(ids, doc, 1).tolist() == [10]


def test_fertility():
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=quality.vocabulary_path())
    text = "Some words and \u4f60\u597d words \U0001f9ea"
    got = quality.measure([text], quality.vocabulary_path()).iloc[0]
    tokens = [t for w in text.split() for t in model.encode(w)]
    counts = np.array(list(Counter(tokens).values())) / len(tokens)
    assert got.n_tokens == len(tokens)
    assert abs(got.byte_share - sum(map(model.is_byte, tokens)) / len(tokens)) < 1e-12
    assert abs(got.token_entropy + (counts * np.log2(counts)).sum()) < 1e-8


def test_bands_by_definition(spark):
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    scored = quality.measured(documents)
    got = {(r.band, r["size"]): r for r in quality.bands(scored).collect()}
    classes = defaultdict(set)
    for r in scored.where("NOT base_failed").collect():
        bins = [int(np.floor(r.m[name] / width + 0.5)) for name, (width, _) in quality.BANDED.items()]
        classes[r.band, r["size"]].add((r.m.n_words, r.m.word_chars, r.m.n_tokens, *bins))
    assert set(got) == set(classes)
    for key, texts in classes.items():
        for i, (name, (width, _)) in enumerate(quality.BANDED.items()):
            values = sorted(t[3 + i] for t in texts)
            middle = values[(len(values) - 1) // 2]
            far = sorted(abs(v - middle) for v in values)[(len(values) - 1) // 2]
            assert abs(got[key][f"{name}_mid"] - middle * width) < 1e-9
            assert abs(got[key][f"{name}_dev"] - 1.4826 * far * width) < 1e-9
        assert got[key].n == len(texts)


def test_bands_alone_reject_junk(spark):
    documents = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    judged = quality.judge(documents, columns=["doc_id"]).where("NOT base_failed")
    junk = f"m.n_symbols > {quality.MAX_SYMBOLS_PER_WORD} * m.n_words"
    rows = judged.selectExpr(f"{junk} AS junk", "rejected_by").collect()
    by = Counter((r.junk, r.rejected_by) for r in rows)
    by_bands = sum(n for (is_junk, rule), n in by.items() if is_junk and rule != "symbols")
    assert by_bands >= 0.6 * sum(n for (is_junk, _), n in by.items() if is_junk)
    assert by_bands > by[True, "symbols"]
    clean = sum(n for (is_junk, _), n in by.items() if not is_junk)
    assert by[False, None] >= 0.998 * clean


def test_near_copies_do_not_close_a_band(spark):
    rows = [(i, brute.prose(i, 200), "en") for i in range(60)]
    copy = brute.prose(1000, 200).split(" ")
    rows += [(100 + i, " ".join([*copy[:i], "x" * (i % 7 + 1), *copy[i + 1 :]]), "en") for i in range(150)]
    rows += [(900, "zq|#&" * 300 + " xj" * 20, "en")]
    judged = quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    kept = {r.row.doc_id for r in judged.select("row", "kept").collect() if r.kept}
    assert set(range(60)) <= kept and 900 not in kept


def test_kept_documents_are_unchanged(documents, empty):
    kept = quality.keep(documents)
    assert kept.columns == documents.columns
    assert [(r.doc_id, r.rk) for r in kept.collect() if r.doc_id == 12] == [(12, "x")]
    assert quality.keep(empty).count() == 0


def test_held_out_accuracy(spark, sf_dir):
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = classifier.judge(documents, labels).join(labels, "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in rows]) >= 0.95
    assert all(0 <= r.score <= 1 for r in rows)


def test_awkward_labels(spark, documents, texts, empty):
    labels = spark.createDataFrame(
        [(None, 1, 0), (7, None, 0), (8, 1, 0), (8, 1, 0), (9, 0, 0), (12, 0, 0), (14, 1, 0), (99, 1, 0)],
        "doc_id long, quality int, toxic int",
    )
    rows = classifier.judge(documents, labels).collect()
    assert Counter(r.doc_id for r in rows) == Counter(i for i, _ in texts)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    none = classifier.judge(documents, labels.where("false")).collect()
    assert {r.score for r in none} == {0.5}
    assert classifier.judge(empty, labels).count() == 0


def test_pooling():
    knots, levels = classifier.isotonic(np.array([0.0, 0.5, 1.0]), np.array([2.0, 2, 2]), np.array([1.0, 0, 2]))
    assert levels.tolist() == [0.25, 1.0] and knots.tolist() == [0.25, 1.0]
