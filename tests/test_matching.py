import datetime
import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from lakeweave import params as P
from lakeweave.operators import evaluate, matching, verdicts
from lakeweave.plans import jobs
from lakeweave.plans.store import build_store
from lakeweave.sources import lake as L


def edges_frame(spark, rows):
    return spark.createDataFrame(
        rows, "source_table_id string, target_table_id string, src_idx int, tgt_idx int, confidence double"
    )


def best_total(edges):
    """Greatest total over all one-to-one subsets."""
    sources = sorted({s for s, _ in edges})
    targets = sorted({t for _, t in edges}) + [None] * len(sources)
    return max(
        sum(edges.get((s, t), 0.0) for s, t in zip(sources, choice))
        for choice in itertools.permutations(targets, len(sources))
    )


def test_assignment_is_optimal_and_injective(spark):
    rng = random.Random(5)
    groups = {}
    for g in range(60):
        n, m = rng.randint(1, 4), rng.randint(1, 5)
        groups[f"g{g}"] = {
            (s, t): round(rng.uniform(0.7, 1.0), 3) for s in range(n) for t in range(m) if rng.random() < 0.6
        }
    rows = [(g, "x", s, t, c) for g, e in groups.items() for (s, t), c in e.items()]
    got = matching.one_to_one(edges_frame(spark, rows)).collect()
    for g, edges in groups.items():
        mine = [r for r in got if r.source_table_id == g]
        assert len({r.src_idx for r in mine}) == len(mine) == len({r.tgt_idx for r in mine})
        if edges:
            assert sum(r.confidence for r in mine) == pytest.approx(best_total(edges))


def test_assignment_example(spark):
    rows = [("s", "t", 0, 0, 0.92), ("s", "t", 1, 0, 0.83), ("s", "t", 1, 1, 0.77)]
    got = matching.one_to_one(edges_frame(spark, rows)).collect()
    assert {(r.src_idx, r.tgt_idx) for r in got} == {(0, 0), (1, 1)}


def test_top_targets_keeps_ten_of_twelve(spark):
    rows = spark.range(12).selectExpr(
        "'s' AS source_table_id", "'t' AS target_table_id", "0 AS src_idx", "int(id) AS tgt_idx", "id / 20 AS m_score"
    )
    assert {r.tgt_idx for r in matching.top_targets(rows).collect()} == set(range(2, 12))


@pytest.fixture(scope="module")
def store(spark):
    patients = spark.range(100).selectExpr("id AS patient_id", "20 + id % 50 AS age", "concat('n', id) AS name")
    visits = spark.range(300).selectExpr("id AS visit_id", "id % 100 AS patient_id", "20 + id % 50 AS age")
    weather = spark.range(50).selectExpr("double(id) AS temperature", "timestamp_seconds(id * 1000) AS measured")
    # The same columns with other values: unionable, not joinable.
    clinic = patients.selectExpr("patient_id + 1000 AS patient_id", "age + 100 AS age", "concat('m', name) AS name")
    frames = {"patients": patients, "visits": visits, "weather": weather, "clinic": clinic}
    return build_store([L.single_table(df, n) for n, df in frames.items()])


def test_discover_and_match(spark, store):
    q = spark.createDataFrame(
        [("patients", "default", "JOIN"), ("patients", "other", "JOIN")],
        "query_id string, tenant_id string, subtask string",
    )
    found = jobs.discover(q, store)
    assert found.queries.count() == 1
    ranking = sorted(found.ranking.collect(), key=lambda r: r["rank"])
    assert ranking[0].table_id == "visits"
    assert not {"weather", "clinic"} & {r.table_id for r in ranking}
    c1 = {r.table_id for r in found.c1.collect()}
    assert "patients" not in c1 and "clinic" in c1


def test_smd_match_by_hint(spark, store):
    asked = spark.createDataFrame([("patients", "visits")], "source_table_id string, target_table_id string")
    maps = jobs.match(asked, store, hint="SMD").collect()
    assert {(r.source_column, r.target_column) for r in maps} == {("patient_id", "patient_id"), ("age", "age")}
    assert {r.scenario for r in maps} == {"SMD"}


def test_integrate_without_ranking_has_no_mappings(spark, store):
    q = spark.createDataFrame([("weather", "default", "JOIN")], "query_id string, tenant_id string, subtask string")

    def nothing_fits(queries, c2):
        return c2.selectExpr("query_id", "table_id", "0D AS s3")

    found, maps = jobs.integrate(q, store, judge=nothing_fits)
    assert found.ranking.isEmpty() and maps.isEmpty()


def test_targets_of_match(spark):
    queries = spark.createDataFrame(
        [("a", "x"), ("b", None), ("c", None)], "query_id string, target_id string"
    )
    ranking = spark.createDataFrame([("a", "r"), ("b", "r")], "query_id string, table_id string")
    pool = spark.createDataFrame([("b", "p"), ("c", "p")], "query_id string, table_id string")
    plain = matching.match_targets(queries, ranking, pool).collect()
    assert {tuple(r) for r in plain} == {("a", "x"), ("b", "r")}
    with_pool = matching.match_targets(queries, ranking, pool, fallback_to_pool=True).collect()
    assert {tuple(r) for r in with_pool} == {("a", "x"), ("b", "r"), ("c", "p")}


def test_verdict_contracts(spark):
    good = {"scores": [{"candidate_idx": 1, "score": 0.8, "reason": "ok"}, {"candidate_idx": 2, "score": 1, "reason": ""}]}
    bad = [
        {"scores": [{"candidate_idx": 1, "score": 1.2, "reason": "x"}]},
        {"scores": [{"candidate_idx": 0, "score": 0.2, "reason": "x"}]},
        {"scores": [{"candidate_idx": 1, "score": 0.2, "reason": "x" * 61}]},
        {"scores": [{"candidate_idx": 1, "score": 0.2}]},
        {"other": 1},
    ]
    content = [json.dumps(good), "not json", ""] + [json.dumps(b) for b in bad]
    rows = spark.createDataFrame([("q", i, c) for i, c in enumerate(content)], "query_id string, batch_no int, content string")
    scores, rejects = verdicts.parse_table_verdicts(rows)
    assert {(r.batch_no, r.candidate_idx, r.score) for r in scores.collect()} == {(0, 1, 0.8), (0, 2, 1.0)}
    assert rejects.count() == len(content) - 1


def test_second_batch_is_resolved(spark):
    c2 = spark.range(23).selectExpr("'q' AS query_id", "concat('t', lpad(id, 2, '0')) AS table_id", "1 - id / 100 AS s2")
    batches = verdicts.request_batches(c2)
    answers = batches.selectExpr("query_id", "batch_no", "candidate_idx", "s2 AS score")
    got = verdicts.resolve_verdicts(batches, answers)
    assert got.join(c2, ["query_id", "table_id"]).filter("s3 = s2").count() == 23


def test_scorer_seam_and_failures(spark):
    asked = spark.createDataFrame([(f"s{i}", "t", f"prompt {i}") for i in range(6)], "source_col_id string, target_col_id string, prompt string")

    def load():
        def answer(prompts):
            out = []
            for p in prompts:
                n = int(p.split()[1])
                ok = '{"reasoning": "r", "score": 0.%d, "is_equivalent": true}' % n
                out.append(None if n == 1 else "broken" if n == 2 else ok)
            return out

        return answer

    raw = verdicts.run_scorer(asked, load, ["source_col_id", "target_col_id"], "prompt", tasks=2)
    good, rejects = verdicts.parse_pair_verdicts(raw)
    assert rejects.count() == 2
    got = {r.source_col_id: (r.confidence, r.is_equivalent) for r in verdicts.attach_pair_verdicts(asked, good).collect()}
    assert got["s1"] == got["s2"] == (0.0, False)
    assert got["s5"] == (0.5, True)


def test_cache_age(spark):
    now = datetime.datetime(2024, 1, 10)
    cache = spark.createDataFrame(
        [("a", 0.1, now - datetime.timedelta(hours=200)), ("a", 0.2, now - datetime.timedelta(hours=5)),
         ("a", 0.3, now - datetime.timedelta(hours=6)), ("b", 0.4, now - datetime.timedelta(hours=168))],
        "k string, s3 double, ts timestamp",
    )
    pairs = spark.createDataFrame([("a",), ("b",), ("c",)], "k string")
    hits, misses = verdicts.split_by_cache(pairs, cache, ["k"], F.lit(now))
    assert [(r.k, r.s3) for r in hits.collect()] == [("a", 0.2)]
    assert {r.k for r in misses.collect()} == {"b", "c"}


def test_pair_prompt_by_scenario(spark, store):
    pairs = spark.createDataFrame([("patients", "visits")], "source_table_id string, target_table_id string")
    for scenario, shown, hidden in (("SMD", ["name_similarity"], ["samples", "statistics", "mixed_score"]),
                                    ("SSD", ["samples"], ["statistics", "mixed_score"]),
                                    ("SLD", ["samples", "statistics", "mixed_score"], [])):
        scored = matching.pair_scores(pairs.withColumn("scenario", F.lit(scenario)), matching.column_features(store.profiles))
        prompts = [r.prompt for r in verdicts.pair_prompts(scored, store.profiles).collect()]
        found = [json.loads(p) for p in prompts]
        fields = [{*d["source"], *d["target"], *d["scores"]} for d in found]
        assert found and all({d["scenario"]} == {scenario} for d in found)
        assert set(shown) <= set().union(*fields) and not any(h in f for f in fields for h in hidden)


def test_match_quality(spark):
    schema = "source_table_id string, source_column string, target_table_id string, target_column string"
    found = spark.createDataFrame([("s", "a", "t", "a"), ("s", "b", "t", "c")], schema)
    truth = spark.createDataFrame([("s", "a", "t", "a"), ("s", "b", "t", "b"), ("s", "d", "t", "d")], schema)
    r = evaluate.match_quality(found, truth).first()
    assert (r.precision, r.recall, r.f1) == (0.5, pytest.approx(1 / 3), pytest.approx(0.4))


def test_full_category_similarity_copies_only_shared_values(spark, monkeypatch):
    """Many columns with one common value and otherwise their own; the common one may be divided over tasks."""
    rows = [(f"t{t}", 0, "common", 0.5) for t in range(7)] + [(f"t{t}", 0, f"own {t} {i}", 0.1) for t in range(7) for i in range(5)]
    rows += [("t0", 0, "two", 0.25), ("t1", 0, "two", 0.5)]
    freqs = spark.createDataFrame(rows, "table_id string, ordinal int, value string, freq double")
    pairs = spark.createDataFrame(
        [(f"t{a}", 0, f"t{b}", 0) for a in range(7) for b in range(7) if a != b and (a, b) != (5, 6)],
        "source_table_id string, src_idx int, target_table_id string, tgt_idx int",
    )
    for at_once in (256, 3):
        monkeypatch.setattr(matching, "_COLUMNS_AT_ONCE", at_once)
        held = []

        def keep(frame, name):
            held.append(frame.cache())
            return held[-1]

        got = {(r.source_table_id, r.target_table_id): r for r in matching.full_category_similarity(pairs, freqs, keep).collect()}
        assert held[0].count() == 9
        assert len(got) == 41 and ("t5", "t6") not in got
        assert (got["t0", "t1"].n_shared, got["t0", "t1"].dot) == (2, 0.25 + 0.125)
        norm = (0.25 + 5 * 0.01) ** 0.5
        want = P.CATEGORY_WEIGHTS[0] * 1 / 11 + P.CATEGORY_WEIGHTS[1] * 0.25 / (norm * norm)
        assert got["t3", "t4"].sim_cat == pytest.approx(want)
