"""Vector search over cells against comparing everything."""

import numpy as np
import pytest

from lakeweave.operators import blocks, cells, vectors

SCHEMA = "table_id string, tenant_id string, status string, vector array<double>"


def brute(rows, k):
    out = set()
    for i, tenant, _, v in rows:
        scored = sorted((-round(float(np.dot(v, w)), 9), j) for j, t, _, w in rows if j != i and t == tenant)
        out |= {(i, j, -s) for s, j in scored[:k]}
    return out


def frame(spark, points, tenant=lambda i: "t"):
    rows = [(f"v{i:05d}", tenant(i), "READY", [float(x) for x in p]) for i, p in enumerate(points)]
    return rows, spark.createDataFrame(rows, SCHEMA)


def asked(df):
    return df.selectExpr("table_id AS query_id", "tenant_id", "vector")


@pytest.fixture(scope="module")
def gathered():
    """Eighty narrow bundles of directions, and a third of all points in one of them."""
    rng = np.random.default_rng(11)
    centres = rng.normal(size=(80, 24))
    of = np.where(rng.random(1200) < 1 / 3, 0, rng.integers(0, 80, 1200))
    points = centres[of] + rng.normal(size=(1200, 24)) * 0.08
    points[50:80] = points[49]  # copies, whose ids break ties
    return points / np.linalg.norm(points, axis=1, keepdims=True)


@pytest.mark.parametrize("size", [40, 300, 1200])
def test_gathered_points(spark, gathered, size):
    rows, df = frame(spark, gathered)
    got = vectors.top_k(asked(df), df, k=5, cell_vectors=size, q_rows=100, c_rows=90).collect()
    assert {(r.query_id, r.table_id, r.s2) for r in got} == brute(rows, 5)


def test_points_without_structure(spark):
    points = np.random.default_rng(2).normal(size=(300, 8))  # of any length
    rows, df = frame(spark, points, lambda i: "small" if i % 20 == 0 else "big")
    got = vectors.top_k(asked(df), df, k=4, cell_vectors=20).collect()
    assert {(r.query_id, r.table_id, r.s2) for r in got} == brute(rows, 4)


def test_queries_meet_few_cells(spark, gathered):
    """Copies of queries stay far below one per cell, or the cells would be of no use."""
    _, df = frame(spark, gathered)
    built = cells.build(df, 80)
    q = asked(df).selectExpr("*", "5 AS k", "double(NULL) AS theta")
    first = cells.route(q, built)
    hits = blocks.block_top_k(q, df, blocks.dense_scorer())
    floors = hits.groupBy("query_id").agg({"score": "min"}).toDF("query_id", "floor")
    others = cells.route(q, built, floors)
    n_cells = built.rows.select("cell").distinct().count()
    assert n_cells > 40
    assert first.count() + others.count() < 0.15 * 1200 * n_cells


def test_queries_are_copied_per_block_of_cells(spark):
    """Vectors without structure meet every cell, but a query has one copy per block of cells."""
    rows, df = frame(spark, np.random.default_rng(5).normal(size=(1500, 8)))
    built = cells.build(df, 30, block_rows=800)
    q = asked(df).selectExpr("*", "5 AS k", "double(NULL) AS theta")
    first, others = cells.route(q, built), cells.route(q, built, q.selectExpr("query_id", "double(NULL) AS floor"))
    n_blocks = built.groups.select("block").distinct().count()
    assert n_blocks == 2
    assert first.count() + others.count() <= 2 * 1500 * n_blocks
    met = first.unionByName(others).selectExpr("query_id", "explode(cells) AS cell")
    assert met.count() == met.distinct().count() == 1500 * built.rows.select("cell").distinct().count()


def test_single_precision_decides_nothing(spark):
    """Scores that differ by less than single precision, copies, long and short vectors, repeated ids and limits."""
    rng = np.random.default_rng(7)
    points = np.ones((400, 6)) + rng.normal(size=(400, 6)) * 1e-6
    points[100:130] = points[99]
    points[200:230] *= 1e4
    points[300:330] *= -1e-7
    points[399] = 1e17
    rows, _ = frame(spark, points[:399])
    df = spark.createDataFrame([*rows, ("v00007", "t", "READY", [0.5] * 6)], SCHEMA)
    huge = df.unionByName(spark.createDataFrame([("w", "t", "READY", points[399].tolist())], SCHEMA))
    theta = "IF(query_id < 'v00050', 6D, NULL) AS theta"
    for stored in (df, huge):
        q = asked(stored).selectExpr("*", "int(3 + hash(query_id) % 3) AS k", theta).dropDuplicates(["query_id"])
        want = blocks.block_top_k(q, stored, blocks.dense_scorer(), q_rows=150, c_rows=200).collect()
        got = blocks.dense_top_k(q, stored, q_rows=150, c_rows=200).collect()
        assert [(r.query_id, r.table_id) for r in sorted(got)] == [(r.query_id, r.table_id) for r in sorted(want)]
        assert np.allclose([r.score for r in sorted(got)], [r.score for r in sorted(want)], rtol=1e-12, atol=2e-9)


def test_thresholds_and_small_tenants(spark, gathered):
    """A tenant with fewer vectors than ``k``, a query of a tenant without any, and thresholds."""
    rows, df = frame(spark, gathered[:200], lambda i: "few" if i < 3 else "many")
    q = asked(df).selectExpr("*", "6 AS k", "IF(query_id < 'v00010', 0.9D, NULL) AS theta")
    lost = spark.createDataFrame([("x", "nobody", gathered[0].tolist(), 6, None)], "query_id string, tenant_id string, vector array<double>, k int, theta double")
    q = q.unionByName(lost)
    got = cells.top_k(q, cells.build(df, 12)).collect()
    want = blocks.block_top_k(q, df, blocks.dense_scorer()).collect()
    assert {tuple(r) for r in got} == {tuple(r) for r in want}
    assert not any(r.query_id == "x" for r in got)


def test_column_collection(spark):
    tables = spark.createDataFrame([("a", "t", "READY"), ("b", "t", "READY"), ("c", "t", "ARCHIVED"), ("d", "u", "READY")], "table_id string, tenant_id string, status string")
    texts = spark.createDataFrame(
        [(f"{t}{i}", t, n, "int", f"Column {n}") for t in "abcd" for i, n in enumerate(["order key", "price", "price net"])],
        "column_id string, table_id string, col_name string, col_type string, encoder_text string",
    )

    def encoder(frame):
        return frame.selectExpr("column_id", "IF(encoder_text LIKE '%price%', array(0.6D, 0.8D), array(1D, 0D)) AS vector")

    columns = vectors.column_collection(tables, texts, encoder)
    hits = vectors.column_top_k(columns, columns, 2).collect()
    by_query = {}
    for r in hits:
        by_query.setdefault(r.query_id, set()).add((r.column_id, round(r.score, 9)))
    # Neither the own table, nor an archived one, nor another tenant's.
    assert by_query == {
        "a0": {("b0", 1.0), ("b1", 0.6)}, "a1": {("b1", 1.0), ("b2", 1.0)}, "a2": {("b1", 1.0), ("b2", 1.0)},
        "b0": {("a0", 1.0), ("a1", 0.6)}, "b1": {("a1", 1.0), ("a2", 1.0)}, "b2": {("a1", 1.0), ("a2", 1.0)},
        "c0": {("a0", 1.0), ("b0", 1.0)}, "c1": {("a1", 1.0), ("a2", 1.0)}, "c2": {("a1", 1.0), ("a2", 1.0)},
    }
    ranked = vectors.tables_by_columns(vectors.column_top_k(columns, columns, 2), 1).collect()
    assert {(r.query_table_id, r.table_id, r.n_columns) for r in ranked} == {("a", "b", 3), ("b", "a", 3), ("c", "a", 3)}
