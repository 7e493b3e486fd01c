import math

import numpy as np
import pytest

from lakeweave import params as P
from lakeweave.operators import blocks, cascade, rules, terms, vectors
from lakeweave.session import materialize


def brute(points, tenants, k, theta=None):
    out = set()
    for q in points:
        scored = [
            (-round(float(np.dot(points[q], points[c])), 9), c)
            for c in points
            if c != q and tenants[c] == tenants[q]
        ]
        scored = [s for s in scored if theta is None or -s[0] > theta]
        out |= {(q, c, -s) for s, c in sorted(scored)[:k]}
    return out


@pytest.mark.parametrize("sizes", [{}, {"q_rows": 3, "c_rows": 4}, {"q_rows": 100, "c_rows": 1}])
def test_block_top_k_equals_brute_force(spark, sizes):
    """Two thirds of the vectors are one tenant's, and a third are copies, so ids break ties."""
    rng = np.random.default_rng(3)
    points = {f"v{i:02d}": rng.normal(size=4).round(2) for i in range(40)}
    points.update({f"w{i:02d}": points["v00"] for i in range(20)})
    tenants = {p: "small" if p.endswith("7") else "big" for p in points}
    df = spark.createDataFrame(
        [(p, tenants[p], "READY", [float(x) for x in v]) for p, v in points.items()],
        "table_id string, tenant_id string, status string, vector array<double>",
    )
    q = df.selectExpr("table_id AS query_id", "tenant_id", "vector")
    got = vectors.top_k(q, df, k=6, **sizes).collect()
    assert {(r.query_id, r.table_id, r.s2) for r in got} == brute(points, tenants, 6)


def test_threshold_and_k_per_query(spark):
    rows = [("a", [1.0, 0.0]), ("b", [0.8, 0.6]), ("c", [0.6, 0.8]), ("d", [0.0, 1.0])]
    c = spark.createDataFrame([(i, "t", v) for i, v in rows], "table_id string, tenant_id string, vector array<double>")
    q = c.selectExpr(
        "table_id AS query_id", "tenant_id", "if(table_id = 'a', 1, 9) AS k", "if(table_id = 'b', 0.8D, NULL) AS theta", "vector"
    )
    got = blocks.block_top_k(q, c, blocks.dense_scorer()).collect()
    by_query = {i: {r.table_id for r in got if r.query_id == i} for i, _ in rows}
    assert by_query["a"] == {"b"}
    # The threshold is strict: 0.8 itself does not pass.
    assert by_query["b"] == {"c"}
    assert by_query["d"] == {"a", "b", "c"}


def test_term_weights(spark):
    """Against the formula, with a rare, an ubiquitous and an unknown term."""
    texts = {1: "a_b x x y", 2: "x y Été", 3: "y été z", 4: "", 5: "y x été"}
    docs = spark.createDataFrame(list(texts.items()), "id int, text string")
    rows = terms.postings(terms.unit_terms(docs, "id", "text"), "id").collect()
    got = {(r.id, r.term): r.weight for r in rows}
    n, df = 5, {"x": 3, "y": 4, "été": 3}

    def raw(tf, t):
        return (1 + math.log(tf)) * (math.log((1 + n) / (1 + df[t])) + 1)

    x, y = raw(2, "x"), raw(1, "y")
    assert got[1, "x"] == pytest.approx(x / math.hypot(x, y))
    assert {t for _, t in got} == {"x", "y", "été"}
    assert not any(i == 4 for i, _ in got)


def test_tiny_corpus_keeps_single_occurrences(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "b c")], "id int, text string")
    model = terms.fit(docs, terms.term_counts(docs, "id", "text"))
    assert {r.term for r in model.collect()} == {"a", "c"}


def test_user_encoder(spark):
    docs = spark.createDataFrame([(i, "x" * (i + 1)) for i in range(10)], "id int, text string")

    def load():
        return lambda texts: [[len(t), 0.0, len(t)] for t in texts]

    got = vectors.encode(docs, "id", "text", load, batch=3).collect()
    assert len(got) == 10
    assert all(r.vector == pytest.approx([math.sqrt(0.5), 0, math.sqrt(0.5)]) for r in got)


def plan(spark, ids, subtask="JOIN", **overrides):
    q = spark.createDataFrame([(i, "t", subtask) for i in ids], "query_id string, tenant_id string, subtask string")
    if not overrides:
        return rules.plan_queries(q)
    names = [f"{v} AS {k}" for k, v in overrides.items()]
    return rules.plan_queries(q, q.selectExpr("query_id", *names))


def pairs(spark, rows, score):
    return spark.createDataFrame([("q", t, s) for t, s in rows], f"query_id string, table_id string, {score} double")


def test_layer_two_keeps_the_intersection(spark):
    c1 = pairs(spark, [("A", 0.8), ("B", 0.6), ("C", 0.5), ("D", 0.4), ("F", 0.3)], "s1")
    hits = pairs(spark, [("B", 0.7), ("E", 0.9), ("C", 0.6), ("D", 0.55), ("F", 0.56)], "s2")
    queries = plan(spark, ["q"])
    got = cascade.layer_two(queries, c1, hits, hits).collect()
    assert {(r.table_id, r.degraded) for r in got} == {("B", False), ("C", False), ("F", False)}


def test_layer_two_falls_back_to_three_and_says_so(spark):
    c1 = pairs(spark, [("A", 0.8), ("B", 0.6), ("C", 0.5)], "s1")
    hits = pairs(spark, [("B", 0.7), ("D", 0.9)], "s2")
    queries = plan(spark, ["q"])
    got = cascade.layer_two(queries, c1, hits, hits).collect()
    assert {(r.table_id, r.s1, r.s2) for r in got} == {("D", 0.0, 0.9), ("B", 0.6, 0.7), ("A", 0.8, 0.0)}
    assert all(r.degraded for r in got)


def test_layer_two_without_vector(spark):
    c1 = pairs(spark, [("A", 0.8), ("B", 0.6)], "s1")
    none = pairs(spark, [], "s2")
    got = cascade.layer_two(plan(spark, ["q"]), c1, none, none).collect()
    assert {(r.table_id, r.s2, r.degraded) for r in got} == {("A", 0.8, True), ("B", 0.6, True)}


def c2_frame(spark, rows):
    return spark.createDataFrame(
        [("q", t, a, b, False) for t, a, b in rows],
        "query_id string, table_id string, s1 double, s2 double, degraded boolean",
    )


def test_missing_verdict_excludes(spark):
    c2 = c2_frame(spark, [("A", 0.5, 0.6), ("B", 0.5, 0.6), ("C", 0.5, 0.6)])
    found = pairs(spark, [("A", 0.8), ("C", 0.5)], "s3")
    got = cascade.layer_three(plan(spark, ["q"]), c2, found).collect()
    assert [(r.table_id, r.degraded) for r in got] == [("A", False)]


def test_total_failure_of_the_judge_keeps_the_ranking(spark):
    c2 = c2_frame(spark, [("A", 0.5, 0.6), ("B", 0.9, 0.6)])
    queries = plan(spark, ["q"])
    got = cascade.rank(queries, cascade.layer_three(queries, c2, pairs(spark, [], "s3"))).collect()
    assert [(r.table_id, r.degraded) for r in sorted(got, key=lambda r: r["rank"])] == [("B", True), ("A", True)]


def test_ranking_order_and_range(spark):
    c3 = spark.createDataFrame(
        [("q", "A", 0.9, 0.6, 0.6, False), ("q", "B", 0.5, 0.9, 0.9, False), ("q", "C", 0.7, 0.7, 0.8, False)],
        "query_id string, table_id string, s1 double, s2 double, s3 double, degraded boolean",
    )
    queries = plan(spark, ["q"], w_1="0.2D", w_2="0.4D", w_3="0.4D")
    got = sorted(cascade.rank(queries, c3).collect(), key=lambda r: r["rank"])
    assert [r.table_id for r in got] == ["B", "C", "A"]
    assert all(0 <= r.score <= 1 for r in got)


def test_equal_scores_normalize_to_zero(spark):
    c3 = c2_frame(spark, [("A", 0.5, 0.5), ("B", 0.5, 0.5)]).selectExpr("*", "0.7D AS s3")
    got = sorted(cascade.rank(plan(spark, ["q"]), c3).collect(), key=lambda r: r["rank"])
    assert [(r.table_id, r.score) for r in got] == [("A", 0.0), ("B", 0.0)]


def test_plan_overrides(spark):
    q = spark.createDataFrame(
        [("a", "t", "JOIN"), ("b", "t", "UNION")], "query_id string, tenant_id string, subtask string"
    )
    o = spark.createDataFrame([("a", None, 5), ("b", 0.1, None)], "query_id string, theta_1 double, k_2 int")
    got = {r.query_id: r for r in rules.plan_queries(q, o).collect()}
    assert (got["a"].theta_1, got["a"].k_2, got["a"].w_3) == (P.JOIN_PLAN.theta_1, 5, 0.5)
    assert (got["b"].theta_1, got["b"].k_2, got["b"].w_3) == (0.1, 40, 0.2)


def test_literal_tenants_leave_no_nested_loops(spark, sf_dir):
    """Neither the vector table nor anything else is compared by a nested loop."""
    from suite import REGISTRY

    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    for limit in ("-1", threshold):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
        try:
            for name in ("vector_top_k", "vector_column_roll_up", "vector_top_k_filtered"):
                plan = REGISTRY[name].run(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
                assert "CartesianProduct" not in plan and "NestedLoop" not in plan, name
        finally:
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_containment_by_keys(spark):
    """Numbers and texts, a common value, and a column without values of the other."""
    from lakeweave.operators import profile, verdicts

    rows = [("q", 0, str(v)) for v in range(10)] + [("t", 1, str(v)) for v in range(5, 25)] + [("u", 0, "5"), ("u", 0, "x")]
    values = spark.createDataFrame(rows, "table_id string, ordinal int, value string")
    keys = values.select(profile.column_key().alias("c"), *profile.value_keys())
    pairs = spark.createDataFrame([("q", 0, "t", 1), ("q", 0, "u", 0), ("t", 1, "u", 0), ("q", 0, "w", 3)], "query_id string, src_idx int, table_id string, tgt_idx int")
    got = {(r.query_id, r.table_id): (r.n_shared, r.containment) for r in verdicts.containment(pairs, keys).collect()}
    assert got == {("q", "t"): (5, 0.5), ("q", "u"): (1, 0.5), ("t", "u"): (1, 0.5)}
    assert keys.dtypes == [("c", "bigint"), ("v1", "bigint"), ("v2", "bigint")]
    assert keys.select("v1").distinct().count() == keys.select("v1", "v2").distinct().count() == 26
    apart = keys.selectExpr("shiftright(v1, 1) = shiftright(v2, 1) AS alike").filter("alike").count()
    assert apart == 0


def test_containment_copies_classes_of_values(spark):
    """Values that the same columns hold are one class, whatever their number; a value that a column holds twice counts so."""
    from lakeweave.operators import profile, verdicts

    rows = [("q", 0, str(v)) for v in range(1000)] + [("t", 1, str(v)) for v in range(400, 2000)] + [("u", 0, "5")] * 2
    values = spark.createDataFrame(rows, "table_id string, ordinal int, value string")
    keys = values.select(profile.column_key().alias("c"), *profile.value_keys())
    pairs = spark.createDataFrame([("q", 0, "t", 1), ("t", 1, "q", 0), ("q", 0, "u", 0)], "query_id string, src_idx int, table_id string, tgt_idx int")
    kept = {}

    def keep(frame, name):
        kept[name] = frame.cache()
        return kept[name]

    got = {(r.query_id, r.table_id): (r.n_shared, r.containment) for r in verdicts.containment(pairs, keys, keep).collect()}
    assert got == {("q", "t"): (600, 0.6), ("t", "q"): (600, 0.6), ("q", "u"): (2, 1.0)}
    assert kept["value-classes"].count() == 4


def test_vocabulary_of_known_size(spark):
    """The model is written, so that a small one is not joined by shuffling all counts by term."""
    docs = spark.createDataFrame([(1, "a b c"), (2, "a b d"), (3, "b c"), (4, "d")], "id int, t string")
    names = []

    def keep(frame, name):
        names.append(name)
        return materialize(frame, name)

    plan = terms.unit_terms(docs, "id", "t", keep=keep)._jdf.queryExecution().executedPlan().toString()
    assert names == ["term-counts", "vocabulary"]
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_sparse_scores_of_coded_terms(spark):
    """Numbers stand for terms, beyond 2^53 too, next to texts without any; large inputs get large blocks of queries."""
    import pandas as pd

    big = 1 << 62
    frame = pd.DataFrame({"terms": [np.array([big, big + 1]), np.array([]), np.array([big + 1])], "weights": [[0.6, 0.8], [], [1.0]]})
    got = list(blocks.sparse_scorer(1.0, 0.0, [])(frame, frame))
    assert np.allclose(got, [[1.0, 0.0, 0.8], [0.0, 0.0, 0.0], [0.8, 0.0, 1.0]])
    assert [blocks.query_rows(n, 12) for n in (100, 48_000, 10_000_000)] == [1024, 2000, P.SCALE.block_candidates]


def test_blocks_of_neighbours_hold_numbers(spark, sf_dir, monkeypatch):
    from suite import REGISTRY

    seen = {}

    def block_top_k(q, c, scorer, **sizes):
        seen.update(q=dict(q.dtypes), c=dict(c.dtypes), **sizes)
        return q

    monkeypatch.setattr(blocks, "block_top_k", block_top_k)
    REGISTRY["document_neighbours"].run(spark, sf_dir)
    assert seen["q"]["terms"] == seen["c"]["terms"] == "array<bigint>" and seen["q_rows"] == 1024


@pytest.mark.parametrize("chunk", [1, 5, 2**20])
def test_texts_are_numbered_in_chunks(spark, monkeypatch, chunk):
    """A posting is not shuffled by its term; rows of one key (null too) are one text, whatever the chunks."""
    from dataclasses import replace

    monkeypatch.setattr(P, "SCALE", replace(P.SCALE, chunk_tokens=chunk))
    rows = [(1, "x x y"), (2, "x Été"), (None, "y z"), (2, "x y y"), (None, "z x z"), (3, "été w"), (4, None), (5, ""), (6, "- x")]
    docs = spark.createDataFrame(rows, "id int, text string")
    kept = {}

    def keep(frame, name):
        kept[name] = materialize(frame, name)
        return kept[name]

    got = {(r.id, r.term): r.weight for r in terms.postings(terms.unit_terms(docs, "id", "text", keep=keep), "id").collect()}
    tf = {1: {"x": 2, "y": 1}, 2: {"x": 2, "été": 1, "y": 2}, None: {"y": 1, "x": 1}, 3: {"été": 1}, 6: {"x": 1}}
    n, df = 9, {"x": 4, "y": 3, "été": 2}
    raw = {i: {t: (1 + math.log(c)) * (math.log((1 + n) / (1 + df[t])) + 1) for t, c in f.items()} for i, f in tf.items()}
    assert got == {(i, t): pytest.approx(w / math.hypot(*f.values())) for i, f in raw.items() for t, w in f.items()}
    chunks = kept["term-counts"].collect()
    assert sum(len(r["keys"]) for r in chunks) == 5 and all(list(r.names) == sorted(r.names) for r in chunks)
    assert kept["vocabulary"].count() == len(chunks)


def test_postings_are_not_shuffled(spark):
    """What is shuffled grows with the terms of a chunk and not with its postings."""
    docs = spark.createDataFrame([(i, "a b c d e" if i % 2 else "a c e") for i in range(4000)], "id int, text string")
    names, sent = [], []

    def keep(frame, name):
        names.append(name)
        frame = materialize(frame, name)
        sent.append(frame.count())
        return frame

    unit = terms.unit_terms(docs, "id", "text", keep=keep)
    assert unit.count() == 2000 and names == ["term-counts", "vocabulary"]
    assert max(sent) <= spark.sparkContext.defaultParallelism


def sparse_rows(n, rng):
    """Texts with numbered terms of which some are frequent, in one of them none, and copies."""
    rows = []
    for i in range(n):
        found = sorted({*rng.choice(5, 2), *(5 + rng.zipf(1.5, rng.integers(1, 9)) % 200)}) if i else []
        w = rng.random(len(found)).round(2) + 0.1
        rows.append((i, [int(t) - (1 << 61) for t in found], [float(x) for x in w / max(1e-9, np.sqrt((w * w).sum()))]))
    return [*rows, *((n + i, t, w) for i, t, w in rows[:7])]


@pytest.mark.parametrize("postings, size", [(2**21, 2**27), (1, 1), (300, 4000)])
def test_blocks_of_the_same_rows_are_paired(spark, monkeypatch, postings, size):
    """Blocks are written once and met in pairs, whatever their sizes, with the results of all pairs."""
    from dataclasses import replace

    monkeypatch.setattr(P, "SCALE", replace(P.SCALE, block_postings=postings, paired_bytes=size))
    rows = sparse_rows(700, np.random.default_rng(5))
    df = spark.createDataFrame(rows, "i long, terms array<bigint>, weights array<double>").repartition(2)
    df = materialize(df, "rows")
    q = df.selectExpr("i AS query_id", "'t' AS tenant_id", "3 AS k", "if(i % 2 = 0, 0.3D, NULL) AS theta", "terms", "weights")
    c = df.selectExpr("i AS table_id", "'t' AS tenant_id", "terms", "weights")
    packed = q.mapInArrow(blocks.pack(256), blocks.PACKED)
    plan = blocks.block_top_k(q, c, blocks.sparse_scorer(1.0, 0.0, []), packed=packed)
    text = plan._jdf.queryExecution().executedPlan().toString()
    got = {(r.query_id, r.table_id, r.score) for r in plan.collect()}
    m = np.zeros((len(rows), 210))
    for i, t, w in rows:
        m[i, np.array(t, "int64") + (1 << 61)] = w
    scores = np.round(m @ m.T, 9)
    want = set()
    for i in range(len(rows)):
        near = sorted((-scores[i, j], j) for j in range(len(rows)) if j != i and (i % 2 or scores[i, j] > 0.3))[:3]
        want |= {(i, j, -s) for s, j in near}
    assert {(i, j) for i, j, _ in got} == {(i, j) for i, j, _ in want}
    assert sorted(s for *_, s in got) == pytest.approx(sorted(s for *_, s in want), abs=1e-9)
    assert "FlatMapCoGroups" not in text and text.count("Exchange hashpartitioning") == 1


def test_sparse_scores_equal_the_plain_sum(spark, monkeypatch):
    """Frequent and rare terms, words or numbers, a few products or scores at a time, and kinds of columns beside them."""
    import pandas as pd

    rng = np.random.default_rng(8)
    rows = sparse_rows(90, rng)
    frame = pd.DataFrame({"terms": [np.array(t, "int64") for _, t, _ in rows], "weights": [np.array(w) for *_, w in rows]})
    frame["a"], frame["b"] = rng.integers(0, 3, len(rows)), rng.integers(0, 2, len(rows))
    words = frame.assign(terms=[np.array([f"t{x}" for x in t], object) for t in frame["terms"]])
    for name, most in (("_SCORES", 2**22), ("_PRODUCTS", 50), ("_SCORES", 500), ("_DENSE", 200), ("_DENSE", 0)):
        monkeypatch.setattr(blocks, name, most)
        for f in (frame, words):
            q = f[:40]
            got = list(blocks.sparse_scorer(0.7, 0.3, ["a", "b"])(q, f))
            for i, r in enumerate(got):
                for j in range(len(f)):
                    x, y = (dict(zip(f["terms"][k], f["weights"][k])) for k in (i, j))
                    low, high = (sum(g(f[c][i], f[c][j]) for c in "ab") for g in (min, max))
                    assert r[j] == pytest.approx(0.7 * sum(w * y.get(t, 0) for t, w in x.items()) + (0.3 * low / high if high else 0))


def test_neighbours_write_no_vectors(spark, sf_dir, monkeypatch):
    """The vectors are packed as they come, once, and a text without an id is nobody's neighbour."""
    from suite import REGISTRY
    from suite import common as C

    docs = spark.createDataFrame([(i if i < 6 else None, f"a{i % 3} b{i % 2} c{i}") for i in range(9)], "doc_id long, text string")
    monkeypatch.setattr(C, "table", lambda *_: docs)
    written, keep = [], blocks.materialize
    monkeypatch.setattr(blocks, "materialize", lambda frame, name, *how: written.append(name) or keep(frame, name, *how))
    rows = REGISTRY["document_neighbours"].run(spark, sf_dir).collect()
    assert written == ["blocks"] and rows and all(r.query_id != r.table_id for r in rows)
    assert {r.query_id for r in rows} | {r.table_id for r in rows} <= set(range(6))
