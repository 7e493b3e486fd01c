"""The three jobs: discover, match, integrate. Each takes any number of queries at once."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeweave.operators import cascade, matching, profile, rules, vectors, verdicts
from lakeweave.plans.store import ProfileStore
from lakeweave.session import materialize


@dataclass(frozen=True)
class Discovery:
    """The three candidate sets and the ranking of every query, and the column pairs of ``integrate``."""

    queries: DataFrame
    c1: DataFrame
    c2: DataFrame
    c3: DataFrame
    ranking: DataFrame
    pairs: DataFrame | None = None


def ready(queries: DataFrame, store: ProfileStore) -> DataFrame:
    """Queries whose table is READY and owned by the query's tenant."""
    known = store.tables.filter("status = 'READY'").selectExpr("table_id AS query_id", "tenant_id")
    return queries.join(known, ["query_id", "tenant_id"], "left_semi")


def built_in_judge(store: ProfileStore) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """Containment for JOIN queries and column coverage for UNION queries."""

    def judge(queries: DataFrame, c2: DataFrame) -> DataFrame:
        tasks = c2.join(queries.select("query_id", "subtask"), "query_id")
        joins = verdicts.judge_joins(tasks.filter("subtask = 'JOIN'"), store.features, store.value_keys)
        unions = verdicts.judge_unions(tasks.filter("subtask = 'UNION'"), store.features)
        return joins.unionByName(unions)

    return judge


def discover(
    queries: DataFrame,
    store: ProfileStore,
    judge: Callable[[DataFrame, DataFrame], DataFrame] | None = None,
    overrides: DataFrame | None = None,
    keep: Callable[[DataFrame, str], DataFrame] = materialize,
) -> Discovery:
    """Rank the tables that fit each ``(query_id, tenant_id, subtask)``.

    ``judge(queries, c2)`` gives ``query_id, table_id, s3``. C1 and C2 each feed two
    later steps and are small, so they are written once.
    """
    planned = rules.plan_queries(ready(queries, store), overrides)
    features = cascade.l1_features(store.tables, store.terms)
    c1 = keep(cascade.layer_one(planned, features), "c1")
    asked = store.vectors.selectExpr("table_id AS query_id", "vector").join(
        planned.selectExpr("query_id", "tenant_id", "k_2 AS k"), "query_id"
    )
    hits = vectors.top_k(asked, store.vectors)
    c2 = keep(cascade.layer_two(planned, c1, hits, asked), "c2")
    found = (judge or built_in_judge(store))(planned, c2)
    c3 = cascade.layer_three(planned, c2, found)
    return Discovery(planned, c1, c2, c3, cascade.rank(planned, c3))


def verified_pairs(
    pairs: DataFrame,
    store: ProfileStore,
    judge: Callable[[DataFrame], DataFrame] = verdicts.judge_pairs,
    hint: str | None = None,
) -> DataFrame:
    """The best column pairs of ``(source_table_id, target_table_id)`` pairs with their verdicts.

    The scenario comes from ``hint`` or from the data of the target. ``judge`` adds
    ``confidence, is_equivalent, reasoning`` to scored column pairs.
    """
    hinted = store.tables.select("table_id", "row_count", F.lit(hint).cast("string").alias("hint"))
    scenario = rules.detect_scenario(hinted, store.profiles).withColumnRenamed(
        "table_id", "target_table_id"
    )
    table_pairs = pairs.select(*matching.PAIR).distinct().join(scenario, "target_table_id")
    scored = matching.pair_scores(table_pairs, store.features)
    return judge(matching.top_targets(scored))


def match(
    pairs: DataFrame,
    store: ProfileStore,
    judge: Callable[[DataFrame], DataFrame] = verdicts.judge_pairs,
    hint: str | None = None,
    one_to_one: bool = True,
) -> DataFrame:
    """Column mappings of ``(source_table_id, target_table_id)`` pairs."""
    kept = matching.accepted(verified_pairs(pairs, store, judge, hint))
    if one_to_one:
        kept = matching.one_to_one(kept)
    return matching.mappings(kept)


def integrate(
    queries: DataFrame,
    store: ProfileStore,
    judge: Callable[[DataFrame, DataFrame], DataFrame] | None = None,
    pair_judge: Callable[[DataFrame], DataFrame] = verdicts.judge_pairs,
    hint: str | None = None,
    keep: Callable[[DataFrame, str], DataFrame] = materialize,
    overrides: DataFrame | None = None,
    fallback_to_pool: bool = False,
) -> tuple[Discovery, DataFrame]:
    """Discover, then match every query against its targets.

    A query's target is the one in its column ``target_id`` if it has one, else its ranked
    tables; with ``fallback_to_pool`` a query without either is matched against all tables of its
    tenant. The assignment is one-to-one for JOIN queries only. All pairs are scored together; those of
    both kinds of query part only afterwards. ``pairs`` of the result are the scored column pairs,
    cut to the best of each column, as written.
    """
    found = discover(queries, store, judge, overrides, keep)
    ranking = keep(found.ranking, "ranking")
    if "target_id" in queries.columns:
        targets = queries.select("query_id", "tenant_id", "target_id")
    else:
        targets = queries.selectExpr("query_id", "tenant_id", "string(NULL) AS target_id")
    asked = found.queries.select("query_id", "tenant_id", "subtask").join(targets, ["query_id", "tenant_id"])
    pool = profile.candidate_pool(store.tables, store.tables) if fallback_to_pool else None
    wanted = matching.match_targets(asked, ranking, pool, fallback_to_pool)
    kinds = asked.selectExpr("query_id AS source_table_id", "subtask = 'JOIN' AS exclusive").distinct()
    scored = keep(verified_pairs(wanted, store, pair_judge, hint), "pairs")
    kept = matching.accepted(scored).join(kinds, "source_table_id")
    free = kept.filter("NOT exclusive").drop("exclusive")
    one = matching.one_to_one(kept.filter("exclusive").drop("exclusive"))
    maps = matching.mappings(one).unionByName(matching.mappings(free))
    return Discovery(found.queries, found.c1, found.c2, found.c3, ranking, scored), maps
