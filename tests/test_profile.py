import hashlib
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakeweave.operators import profile
from lakeweave.sources import lake as L


def cells_of(df, name="t"):
    groups = [L.single_table(df, name)]
    return L.lake_columns(groups), L.lake_cells(groups)


def test_bracketed_quartiles_equal_exact_ones(spark):
    """A third of the rows share one value; sizes differ; one column has a single row."""
    rng = np.random.default_rng(7)
    values = np.concatenate([np.full(5000, 17.25), rng.normal(0, 1e6, 10001).round(3)])
    df = spark.createDataFrame([(float(v), i) for i, v in enumerate(values)], "v double, i bigint")
    columns, cells = cells_of(df)
    counts = profile.value_counts(cells)
    got = {r.ordinal: r for r in profile.quartiles(counts.numeric, max_values=100).collect()}
    for ordinal, data in ((0, values), (1, np.arange(len(values)))):
        want = np.percentile(data, [25, 50, 75], method="linear")
        assert [got[ordinal].q25, got[ordinal].q50, got[ordinal].q75] == pytest.approx(list(want))


def test_small_and_large_columns_are_both_reported(spark):
    df = spark.range(1000).selectExpr("id AS many", "id % 5 AS few")
    _, cells = cells_of(df)
    got = profile.quartiles(profile.value_counts(cells).numeric, max_values=50)
    assert {(r.ordinal, r.q50) for r in got.collect()} == {(0, 499.5), (1, 2.0)}


@pytest.mark.parametrize("max_values", [1, 7, 60, 5000])
def test_quartiles_of_any_range_size(spark, max_values):
    """Heavy tails, ties, both infinities, whole numbers that are one double, single rows, nulls and an empty column."""
    rng = np.random.default_rng(11)
    tails = rng.standard_cauchy(3000) ** 3
    ties = rng.integers(0, 5, 3000).astype(float)
    ends = np.concatenate([[-np.inf] * 20, rng.normal(size=2960), [np.inf] * 20])
    close = (1 << 62) + np.arange(3000)
    rows = [
        (float(a), float(b), float(c), int(d), 4 if i == 5 else None, None)
        for i, (a, b, c, d) in enumerate(zip(tails, ties, ends, close))
    ]
    df = spark.createDataFrame(rows, "a double, b double, c double, d bigint, e int, f double")
    _, cells = cells_of(df)
    got = {r.ordinal: r for r in profile.quartiles(profile.value_counts(cells).numeric, None, max_values).collect()}
    assert sorted(got) == [0, 1, 2, 3, 4]
    for ordinal, data in enumerate((tails, ties, ends, close.astype(float), np.array([4.0]))):
        want = np.percentile(data, [25, 50, 75], method="linear")
        assert [got[ordinal].q25, got[ordinal].q50, got[ordinal].q75] == pytest.approx(list(want), rel=1e-12)


def test_quartiles_order_few_values(spark):
    """After two cuts a column of 200,000 different values keeps six small ranges, and counts below them are exact."""
    df = spark.range(200_000).selectExpr("id * id AS v")
    _, cells = cells_of(df)
    kept = []

    def keep(frame, name):
        kept.append(frame.cache())
        return kept[-1]

    numeric = profile.value_counts(cells).numeric.cache()
    got = profile.quartiles(numeric, None, 100, keep).first()
    want = np.percentile(np.arange(200_000, dtype=float) ** 2, [25, 50, 75], method="linear")
    assert [got.q25, got.q50, got.q75] == pytest.approx(list(want))
    sizes = [frame.agg(F.max("n_values"), F.sum("n_values")).first() for frame in kept]
    assert sizes[0][0] == 200_000 and sizes[1][0] < 200_000 / 100 and sizes[-1][1] <= 600
    assert len(kept) <= 4
    for r in kept[-1].collect():
        assert r.below == numeric.filter(F.col("value") < r.low).agg(F.sum("cnt")).first()[0]
    for frame in [*kept, numeric]:
        frame.unpersist()


def test_edge_cases_of_column_profiles(spark):
    df = spark.createDataFrame(
        [(1, float("nan"), None, "x", None), (1, 2.0, None, "x", True), (2, None, None, "y", True)],
        "i int, d double, nothing int, s string, b boolean",
    )
    columns, cells = cells_of(df)
    got = {r.col_name: r for r in profile.column_profiles(columns, cells, 3).collect()}
    assert got["i"].distinct_ratio == pytest.approx(2 / 3)
    assert got["i"].numeric_stats.std == pytest.approx(statistics.stdev([1, 1, 2]))
    assert got["d"].null_ratio == pytest.approx(2 / 3)
    assert (got["d"].numeric_stats.mean, got["d"].numeric_stats.std) == (2.0, 0.0)
    assert got["nothing"].null_ratio == 1.0 and got["nothing"].numeric_stats.q50 == 0.0
    assert [(v.value, round(v.freq, 3)) for v in got["s"].top_k] == [("x", 0.667), ("y", 0.333)]
    assert got["b"].top_k[0].value == "true" and got["b"].sample_values == ["true"]
    assert got["s"].numeric_stats is None and got["i"].top_k is None


def test_empty_table(spark):
    df = spark.createDataFrame([], "i int, s string")
    columns, cells = cells_of(df)
    got = profile.column_profiles(columns, cells, 0).collect()
    assert [(r.null_ratio, r.distinct_ratio, r.n_rows) for r in got] == [(1.0, 0.0, 0)] * 2


def test_sample_is_stable_under_partitioning(spark):
    df = spark.range(5000).selectExpr("id", "id % 7 AS k")
    one = profile.sample_rows(df.coalesce(1), 100).collect()
    many = profile.sample_rows(df.repartition(13), 100).collect()
    assert one == many and len(one) == 100
    assert profile.sample_rows(df, 9999).count() == 5000


def test_profiles_survive_storage(spark):
    df = spark.range(20).selectExpr("id", "string(id % 3) AS s")
    columns, cells = cells_of(df)
    profiles = profile.column_profiles(columns, cells, 20)
    loaded = profile.load_profiles(profile.store_profiles(profiles))
    key = ["col_name", "numeric_stats", "top_k", "null_ratio", "distinct_ratio"]
    assert sorted(map(str, loaded.select(*key).collect())) == sorted(map(str, profiles.select(*key).collect()))


def test_fingerprint_ignores_order_and_sees_changes(spark):
    df = spark.range(100).selectExpr("id", "if(id = 3, NULL, string(id)) AS s")
    changed = df.withColumn("s", F.coalesce("s", F.lit("")))
    frames = {"a": df, "b": df.orderBy(F.col("id").desc()).repartition(5), "c": changed}
    groups = [L.single_table(v, k) for k, v in frames.items()]
    got = {r.table_id: r.content_hash for r in L.table_fingerprints(groups).collect()}
    assert got["a"] == got["b"] != got["c"]


def test_schema_group_of_many_tables(spark):
    """One group, tables known only to Spark."""
    rows = spark.range(30).selectExpr("concat('t', id % 3) AS _table_id", "id", "string(id % 2) AS s")
    tables = rows.selectExpr("_table_id AS table_id", "_table_id AS table_name", "'x' AS tenant_id").distinct()
    group = L.SchemaGroup(rows, tables)
    assert L.lake_columns([group]).count() == 6
    catalog = {r.table_id: (r.row_count, r.col_count) for r in L.catalog([group]).collect()}
    assert catalog == {"t0": (10, 2), "t1": (10, 2), "t2": (10, 2)}


def test_refit_rule(spark):
    row = spark.range(1).select(
        profile.needs_refit(F.lit(100), F.lit(149)), profile.needs_refit(F.lit(100), F.lit(150))
    ).first()
    assert tuple(row) == (False, True)


def test_long_texts_are_not_shuffled_but_shown(spark):
    """Long texts with one beginning, short ones, copies, nulls: top values and samples are those of the texts themselves."""
    head = "the same long beginning of a text " * 4
    texts = [head + str(i % 60) for i in range(150)] + [f"w{i % 9}" for i in range(40)] + ["é" * 24, "é" * 23, "", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, s string")
    columns, cells = cells_of(df)
    keys = profile.key_counts(cells)
    assert keys.text.selectExpr("max(octet_length(value))").first()[0] == 48
    whole = profile.value_counts(cells)
    want = [(r["rank"], r.value, r.cnt) for r in profile.top_values(whole.text).orderBy("rank").collect()]
    got = [(r["rank"], r.value, r.cnt) for r in profile.top_texts(cells, keys.text).orderBy("rank").collect()]
    assert got == want and len(got) == 20
    plain = {(r.ordinal, r["rank"], r.value) for r in profile.sample_values(whole, columns).collect()}
    digests = sorted({t for t in texts if t is not None}, key=lambda t: hashlib.md5(t.encode()).hexdigest())[:5]
    assert {v for i, _, v in plain if i == 1} == set(digests)
    shown = {r.ordinal: r for r in profile.column_profiles(columns, cells, len(texts)).collect()}
    assert shown[1].sample_values == digests
    assert [v.value for v in shown[1].top_k] == [v for _, v, _ in want]
    assert shown[1].distinct_ratio == pytest.approx(len(set(texts) - {None}) / len(texts))


def test_samples_of_a_large_column(spark):
    """Bounds by lanes leave the values with the five smallest digests, of many values and of few."""
    df = spark.range(20_000).selectExpr("id", "id % 3 AS few")
    columns, cells = cells_of(df)
    counts, bounds = profile.value_counts(cells), []

    def keep(frame, name):
        bounds.append(frame)
        return frame

    got = {}
    for r in profile.sample_values(counts, columns, keep=keep).orderBy("rank").collect():
        got.setdefault(r.ordinal, []).append(r.value)
    for ordinal, n in ((0, 20_000), (1, 3)):
        assert got[ordinal] == sorted(map(str, range(n)), key=lambda t: hashlib.md5(t.encode()).hexdigest())[:5]
    assert len(bounds) == 1
    few = profile._sampled(counts, 5, keep).filter("ordinal = 0").count()
    assert few < 20


def test_cuts_leave_the_values_in_place(spark, monkeypatch):
    """Cutting ranges shuffles no values, whatever the size of the table they come from is taken for."""
    _, cells = cells_of(spark.range(1000).selectExpr("id AS v"))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        numeric = profile.value_counts(cells).numeric.localCheckpoint()
        plan = profile._cut(numeric, profile._whole_columns(numeric).localCheckpoint())
        text = plan._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert "salt" not in text and text.count("BroadcastHashJoin") >= 2


def test_samples_of_few_and_many_values(spark):
    """Those with the smallest digests, whether or not a column has values enough for a bound."""
    sizes = [1, 2, 5, 6, 40, 3000]
    rows = [("t", c, f"v{c}_{i}") for c, n in enumerate(sizes) for i in range(n)]
    text = spark.createDataFrame(rows, "table_id string, ordinal int, value string")
    counts = profile.key_counts(L.Cells(None, None, text))
    columns = text.select("table_id", "ordinal").distinct().selectExpr("*", "'str' AS col_type")
    bounded = profile._sampled(counts, 5, profile.materialize)
    assert bounded.filter("ordinal = 5").count() < 300
    got = {}
    for r in profile.sample_values(counts, columns, 5).orderBy("rank").collect():
        got.setdefault(r.ordinal, []).append(r.value)
    for c, n in enumerate(sizes):
        values = [f"v{c}_{i}" for i in range(n)]
        assert got[c] == sorted(values, key=lambda v: hashlib.md5(v.encode()).hexdigest())[:5]


def test_columns_of_many_values_are_counted_apart(spark, monkeypatch):
    """Not combined before the shuffle but dealt out, and counted as if they were: copies, one frequent value, nulls, zeros of both signs, NaN."""
    rows = [
        (
            i // 2 if i % 3 else 7,
            i % 4,
            (float(i // 2), -0.0, 0.0, float("nan"), None)[i % 5],
            None if i % 11 == 0 else f"text {i // 3} " * (1 + i % 9),
            "same",
        )
        for i in range(6000)
    ]
    df = spark.createDataFrame(rows, "a bigint, b int, c double, d string, e string")
    _, cells = cells_of(df)

    def shown(counts):
        plans = [d._jdf.queryExecution().executedPlan().toString() for d in (counts.numeric, counts.text)]
        found = [sorted(map(repr, d.collect())) for d in (counts.numeric, counts.text)]
        return found, [plan.count("hashpartitioning(slot") for plan in plans]

    for count in (profile.value_counts, profile.key_counts):
        want, apart = shown(count(cells, 6000))
        assert apart == [0, 0] and len(want[0]) > 2500
        with monkeypatch.context() as small:
            small.setattr(profile, "_HELD", 5999)
            small.setattr(profile, "_COMBINED", 500)
            small.setattr(profile, "_COUNTED", 100)
            many = profile._many_valued(cells.whole.filter("value IS NOT NULL")).collect()
            assert [r.ordinal for r in many] == [0]
            for largest in (6000, None):
                got, apart = shown(count(cells, largest))
                assert got == want
                # Whole numbers and doubles; texts.
                assert apart == [2, 1]
            assert count(cells, None).text.rdd.getNumPartitions() > 8


def test_columns_of_few_values_are_combined(spark, monkeypatch):
    """Large tables whose columns all have few values are combined before the shuffle, in one pass of counting."""
    monkeypatch.setattr(profile, "_HELD", 10)
    _, cells = cells_of(spark.range(5000).selectExpr("id % 7 AS a", "string(id % 5) AS b"))
    counts = profile.value_counts(cells, 5000)
    assert "slot" not in counts.numeric._jdf.queryExecution().executedPlan().toString()
    assert counts.numeric.selectExpr("count(*)", "sum(cnt)").first()[:] == (7, 5000)
    assert counts.text.selectExpr("count(*)", "sum(cnt)").first()[:] == (5, 5000)
