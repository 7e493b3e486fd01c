"""Quality and pruning figures of a run against known answers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_MATCH = ["source_table_id", "source_column", "target_table_id", "target_column"]


def recall_at_k(ranking: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """``query_id, n_true, n_found, recall`` of the first ``k`` ranked tables."""
    top = ranking.filter(F.col("rank") <= k).select("query_id", "table_id", F.lit(1).alias("hit"))
    return (
        truth.select("query_id", "table_id")
        .join(top, ["query_id", "table_id"], "left")
        .groupBy("query_id")
        .agg(F.count("*").alias("n_true"), F.count("hit").alias("n_found"))
        .withColumn("recall", F.col("n_found") / F.col("n_true"))
    )


def mean_recall(per_query: DataFrame) -> DataFrame:
    return per_query.agg(F.avg("recall").alias("recall"), F.count("*").alias("n_queries"))


def match_quality(mappings: DataFrame, truth: DataFrame, by: str | None = None) -> DataFrame:
    """Precision, recall and F1 of exact column pairs, over all or per ``by`` column of both sides."""
    group = [by] if by else []
    found = mappings.select(*group, *_MATCH, F.lit(1).alias("found"))
    known = truth.select(*group, *_MATCH, F.lit(1).alias("known"))
    return (
        found.join(known, [*group, *_MATCH], "full_outer")
        .groupBy(*group)
        .agg(
            F.count("found").alias("n_found"),
            F.count("known").alias("n_true"),
            F.sum(F.expr("int(found IS NOT NULL AND known IS NOT NULL)")).alias("n_right"),
        )
        .selectExpr(
            *group,
            "n_found",
            "n_true",
            "n_right",
            "coalesce(n_right / nullif(n_found, 0), 0D) AS precision",
            "coalesce(n_right / nullif(n_true, 0), 0D) AS recall",
            "coalesce(2 * n_right / nullif(n_found + n_true, 0), 0D) AS f1",
        )
    )


def layer_trace(pool: DataFrame, layers: list[DataFrame], truth: DataFrame) -> DataFrame:
    """``query_id, layer, input_size, output_size, recall_loss, pruning``.

    ``pool`` has ``query_id, pool_size``; ``layers`` are C1, C2, C3 in order. The loss
    of a layer is the share of true tables that it dropped, and pruning is cumulative.
    """
    tagged = [
        df.select("query_id", "table_id", F.lit(i).alias("layer")) for i, df in enumerate(layers, start=1)
    ]
    members = reduce(DataFrame.unionByName, tagged)
    return pool.sparkSession.sql(
        f"""
        WITH steps AS (SELECT query_id, pool_size, explode(sequence(1, {len(layers)})) AS layer FROM {{pool}}),
        kept AS (
          SELECT m.query_id, m.layer, count(*) AS n, count(t.table_id) AS n_true
          FROM {{members}} m LEFT JOIN {{truth}} t USING (query_id, table_id) GROUP BY m.query_id, m.layer),
        answers AS (SELECT query_id, count(*) AS n_answers FROM {{truth}} GROUP BY query_id),
        sized AS (
          SELECT s.query_id, s.layer, s.pool_size, coalesce(k.n, 0) AS output_size, coalesce(k.n_true, 0) AS n_true,
                 coalesce(a.n_answers, 0) AS n_answers
          FROM steps s LEFT JOIN kept k USING (query_id, layer) LEFT JOIN answers a USING (query_id))
        SELECT query_id, concat('L', layer) AS layer, lag(output_size, 1, pool_size) OVER w AS input_size, output_size,
               coalesce(((lag(n_true, 1, n_answers) OVER w) - n_true) / nullif(n_answers, 0), 0D) AS recall_loss,
               1 - coalesce(output_size / nullif(pool_size, 0), 0D) AS pruning
        FROM sized WINDOW w AS (PARTITION BY query_id, pool_size, n_answers ORDER BY layer)
        """,
        pool=pool,
        members=members,
        truth=truth.select("query_id", "table_id"),
    )
