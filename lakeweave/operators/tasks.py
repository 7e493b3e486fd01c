"""Tasks, their results, and the result graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def ranking_rows(ranking: DataFrame) -> DataFrame:
    """``task_id, rank, candidate_table, score, layer_scores`` (JSON) from scored candidates.

    ``ranking`` has ``task_id, table_id, score, layer_scores``; a task holds at most its
    few ranked tables.
    """
    w = Window.partitionBy("task_id").orderBy(F.round("score", 9).desc(), "table_id")
    return ranking.select(
        "task_id",
        F.row_number().over(w).alias("rank"),
        F.col("table_id").alias("candidate_table"),
        "score",
        F.to_json("layer_scores").alias("layer_scores"),
    )


RESULT_BUCKETS = 16


def _bucket(task_id: Column) -> Column:
    return F.pmod(F.xxhash64(task_id), F.lit(RESULT_BUCKETS)).cast("int")


def write_results(rows: DataFrame, path: str, batch: int) -> None:
    """Writes rankings, mappings or scored pairs of a batch of tasks.

    A batch has a folder of its own, so one that is replayed leaves one copy. Tasks share
    buckets, so their number doesn't become a number of folders.
    """
    rows.withColumn("bucket", _bucket(F.col("task_id"))).write.mode("overwrite").partitionBy("bucket").parquet(
        f"{path}/batch={batch}"
    )


def read_results(spark: SparkSession, path: str, task_id=None) -> DataFrame:
    """All written rows, or those of one task from its bucket alone."""
    rows = spark.read.parquet(path)
    if task_id is not None:
        wanted = F.lit(task_id).cast(rows.schema["task_id"].dataType)
        rows = rows.filter((F.col("bucket") == _bucket(wanted)) & (F.col("task_id") == wanted))
    return rows.drop("bucket", "batch")


def finish(tasks: DataFrame, ranking: DataFrame, mappings: DataFrame, failures: DataFrame) -> DataFrame:
    """Tasks with their final status, error and output size.

    ``failures`` has ``task_id, error_message``. Output counts ranked tables for a
    DISCOVER_ONLY task and mappings otherwise.
    """
    ranked = ranking.groupBy("task_id").agg(F.count("*").alias("n_ranked"))
    mapped = mappings.groupBy("task_id").agg(F.count("*").alias("n_mapped"))
    return (
        tasks.join(ranked, "task_id", "left")
        .join(mapped, "task_id", "left")
        .join(failures.select("task_id", "error_message"), "task_id", "left")
        .selectExpr(
            *[c for c in tasks.columns if c not in ("status", "error_message")],
            "if(error_message IS NULL, 'SUCCESS', 'FAILED') AS status",
            "error_message",
            """CASE WHEN error_message IS NOT NULL THEN 0
               WHEN task_type = 'DISCOVER_ONLY' THEN coalesce(n_ranked, 0) ELSE coalesce(n_mapped, 0) END AS output_size""",
        )
    )


def detail(tasks: DataFrame, steps: DataFrame, ranking: DataFrame, mappings: DataFrame) -> DataFrame:
    """One row per task with its steps, ranking and mappings as ordered arrays."""

    def nested(df: DataFrame, order: str, name: str) -> DataFrame:
        rest = [c for c in df.columns if c not in ("task_id", order)]
        return df.groupBy("task_id").agg(F.sort_array(F.collect_list(F.struct(order, *rest))).alias(name))

    scores = F.from_json("layer_scores", "struct<s1:double,s2:double,s3:double>")
    return (
        tasks.join(nested(steps, "step_id", "steps"), "task_id", "left")
        .join(nested(ranking.withColumn("layer_scores", scores), "rank", "ranking"), "task_id", "left")
        .join(nested(mappings, "mapping_id", "mappings"), "task_id", "left")
    )


def graph_nodes(tasks: DataFrame, ranking: DataFrame, mappings: DataFrame) -> DataFrame:
    """``task_id, id, kind, label, status``; a node seen in several roles keeps the last one."""
    return tasks.sparkSession.sql(
        """
        WITH seen AS (
          SELECT task_id, 'table' AS sort, query_table_id AS ref, 1 AS prio,
                 if(task_type = 'MATCH_ONLY', 'source_table', 'query_table') AS kind, 'normal' AS status
          FROM {tasks} WHERE query_table_id IS NOT NULL
          UNION ALL SELECT task_id, 'table', target_table_id, 2, 'target_table', 'normal'
          FROM {tasks} WHERE target_table_id IS NOT NULL
          UNION ALL SELECT task_id, 'table', candidate_table, 3, 'candidate_table', 'normal' FROM {ranking}
          UNION ALL SELECT task_id, 'column', x.ref, 4 + x.side, x.kind, if(is_matched, 'matched', 'normal')
          FROM (SELECT task_id, is_matched, inline(array(
                  named_struct('ref', src_column_id, 'side', 2 * mapping_id, 'kind', 'source_column'),
                  named_struct('ref', tgt_column_id, 'side', 2 * mapping_id + 1, 'kind', 'target_column')))
                FROM {mappings}) x)
        SELECT task_id, concat(sort, ':', ref) AS id, max_by(kind, prio) AS kind, ref AS label,
               max_by(status, prio) AS status
        FROM seen GROUP BY task_id, sort, ref
        """,
        tasks=tasks,
        ranking=ranking,
        mappings=mappings,
    )


def graph_edges(tasks: DataFrame, ranking: DataFrame, mappings: DataFrame) -> DataFrame:
    """``task_id, id, kind, source, target, label, weight, metrics, scenario, explanation``."""
    return tasks.sparkSession.sql(
        """
        SELECT r.task_id, concat('discovery:', t.query_table_id, ':', candidate_table) AS id, 'discovery' AS kind,
               concat('table:', t.query_table_id) AS source, concat('table:', candidate_table) AS target,
               concat('#', rank, ' ', format_string('%.3f', score)) AS label, score AS weight,
               from_json(layer_scores, 'map<string,double>') AS metrics,
               string(NULL) AS scenario, string(NULL) AS explanation
        FROM {ranking} r JOIN {tasks} t USING (task_id) WHERE t.query_table_id IS NOT NULL
        UNION ALL
        SELECT task_id, concat('mapping:', mapping_id), 'mapping', concat('column:', src_column_id),
               concat('column:', tgt_column_id), format_string('%.3f', confidence), confidence,
               cast(NULL AS map<string,double>), scenario, reasoning
        FROM {mappings}
        """,
        tasks=tasks,
        ranking=ranking,
        mappings=mappings,
    )
