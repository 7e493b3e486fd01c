"""The three candidate layers and the final ranking, for all queries at once.

``queries`` carries one row per query table: ``query_id, tenant_id`` and its plan
(``theta_1 .. w_3``); see ``rules.plan_queries``. Later stages see at most
``k_1 + k_2`` rows per query, so windows by query stay small.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from lakeweave import params as P
from lakeweave.operators import blocks

KINDS = [f"n_{k}" for k in P.LOGICAL_TYPES]


def l1_features(tables: DataFrame, term_vectors: DataFrame) -> DataFrame:
    """``table_id, tenant_id, status, terms, weights`` and five type counts.

    ``tables`` has ``type_multiset``; ``term_vectors`` has ``table_id, terms, weights``.
    """
    counts = [f"size(filter(type_multiset, t -> t = '{k}')) AS n_{k}" for k in P.LOGICAL_TYPES]
    return tables.join(term_vectors, "table_id", "left").selectExpr(
        "table_id",
        "tenant_id",
        "status",
        "coalesce(terms, array()) AS terms",
        "coalesce(weights, cast(array() AS array<double>)) AS weights",
        *counts,
    )


def layer_one(queries: DataFrame, features: DataFrame, **sizes) -> DataFrame:
    """C1: up to ``k_1`` READY tables of the tenant with S1 above ``theta_1``."""
    q = (
        features.withColumnRenamed("table_id", "query_id")
        .drop("status", "tenant_id")
        .join(queries.select("query_id", "tenant_id", "k_1", "theta_1"), "query_id")
        .selectExpr("query_id", "tenant_id", "k_1 AS k", "theta_1 AS theta", "terms", "weights", *KINDS)
    )
    c = features.filter("status = 'READY'").drop("status")
    scorer = blocks.sparse_scorer(P.OMEGA_TEXT, P.OMEGA_TYPE, KINDS)
    return blocks.block_top_k(q, c, scorer, **sizes).withColumnRenamed("score", "s1")


def layer_two(queries: DataFrame, c1: DataFrame, hits: DataFrame, with_vector: DataFrame) -> DataFrame:
    """C2: members of C1 among the vector hits with S2 above ``theta_2``.

    A query with fewer than three of them falls back to the best three of both sets
    and counts as degraded. So does a query without a vector (``with_vector`` lists
    those that have one), whose S2 is its S1.
    """
    return c1.sparkSession.sql(
        f"""
        WITH both AS (
          SELECT query_id, table_id, s1, s2 FROM {{c1}} FULL OUTER JOIN {{hits}} USING (query_id, table_id)),
        planned AS (
          SELECT b.*, q.theta_2, v.query_id IS NOT NULL AS has_vector
          FROM both b JOIN {{queries}} q USING (query_id) LEFT JOIN {{vectors}} v USING (query_id)),
        scored AS (
          SELECT query_id, table_id, coalesce(s1, 0D) AS s1, has_vector,
                 CASE WHEN has_vector THEN coalesce(s2, 0D) ELSE s1 END AS s2,
                 coalesce(s1 IS NOT NULL AND round(s2, 9) > theta_2, false) AS passes
          FROM planned),
        counted AS (
          SELECT *, count_if(passes) OVER (PARTITION BY query_id) AS n_pass,
                 row_number() OVER (PARTITION BY query_id ORDER BY round(s2, 9) DESC, table_id) AS place
          FROM scored)
        SELECT query_id, table_id, s1, s2, NOT has_vector OR n_pass < {P.MIN_SURVIVORS} AS degraded
        FROM counted
        WHERE NOT has_vector OR passes AND n_pass >= {P.MIN_SURVIVORS}
           OR n_pass < {P.MIN_SURVIVORS} AND place <= {P.MIN_SURVIVORS}
        """,
        c1=c1,
        hits=hits,
        queries=queries.select("query_id", "theta_2"),
        vectors=with_vector.select("query_id").distinct(),
    )


def enrich(candidates: DataFrame, profiles: DataFrame) -> DataFrame:
    """Candidates with the profile fields of their table."""
    return candidates.join(profiles, "table_id", "left")


def layer_three(queries: DataFrame, c2: DataFrame, verdicts: DataFrame) -> DataFrame:
    """C3: candidates whose verdict score is above ``theta_3``; a missing verdict counts 0.

    A query for which scoring gave nothing at all keeps C2 and is degraded, so it is
    still ranked on the first two layers.
    """
    return c2.sparkSession.sql(
        """
        WITH joined AS (
          SELECT c.query_id, c.table_id, c.s1, c.s2, c.degraded, v.s3, q.theta_3,
                 count(v.s3) OVER (PARTITION BY c.query_id) AS n_verdicts
          FROM {c2} c JOIN {queries} q USING (query_id) LEFT JOIN {verdicts} v USING (query_id, table_id))
        SELECT query_id, table_id, s1, s2, coalesce(s3, 0D) AS s3, degraded OR n_verdicts = 0 AS degraded
        FROM joined WHERE n_verdicts = 0 OR round(coalesce(s3, 0D), 9) > theta_3
        """,
        c2=c2,
        verdicts=verdicts.select("query_id", "table_id", "s3"),
        queries=queries.select("query_id", "theta_3"),
    )


def rank(queries: DataFrame, c3: DataFrame) -> DataFrame:
    """Weighted sum of the layer scores, each scaled to [0, 1] within C3 of its query."""

    def scaled(s: str) -> str:
        low, high = f"min({s}) OVER w", f"max({s}) OVER w"
        return f"({s} - {low}) / ({high} - {low} + {P.EPSILON}D) AS {s}_hat"

    return c3.sparkSession.sql(
        f"""
        WITH normal AS (
          SELECT *, {scaled('s1')}, {scaled('s2')}, {scaled('s3')} FROM {{c3}}
          WINDOW w AS (PARTITION BY query_id)),
        scored AS (
          SELECT n.*, q.w_1 * s1_hat + q.w_2 * s2_hat + q.w_3 * s3_hat AS score
          FROM normal n JOIN {{queries}} q USING (query_id))
        SELECT query_id,
               row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, table_id) AS rank,
               table_id, score,
               struct(s1, s2, s3) AS layer_scores, struct(s1_hat, s2_hat, s3_hat) AS normalized, degraded
        FROM scored
        """,
        c3=c3,
        queries=queries.select("query_id", "w_1", "w_2", "w_3"),
    )
