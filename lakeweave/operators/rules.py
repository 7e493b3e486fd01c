"""Task and scenario rules, applied to all tables at once."""

from __future__ import annotations

from dataclasses import asdict

from pyspark.sql import DataFrame

from lakeweave import params as P


def _any(words: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains(lower(hint), '{w}')" for w in words) + ")"


def detect_subtask(queries: DataFrame, profiles: DataFrame, verdicts: DataFrame | None = None) -> DataFrame:
    """``query_id, subtask``: by hint, then by a key-like column, then by verdict, else JOIN.

    ``queries`` has ``query_id, hint``; ``profiles`` has ``table_id, col_type,
    distinct_ratio``; ``verdicts`` has ``query_id, subtask`` for undecided queries.
    """
    spark = queries.sparkSession
    if verdicts is None:
        verdicts = spark.createDataFrame([], "query_id string, subtask string")
    return spark.sql(
        f"""
        WITH keys AS (
          SELECT table_id, bool_or(distinct_ratio > {P.KEY_DISTINCT_RATIO}D AND col_type IN ('int', 'str')) AS has_key
          FROM {{profiles}} GROUP BY table_id)
        SELECT q.query_id,
               CASE WHEN {_any(P.JOIN_HINTS)} THEN 'JOIN' WHEN {_any(P.UNION_HINTS)} THEN 'UNION'
                    WHEN k.has_key THEN 'JOIN' ELSE coalesce(v.subtask, 'JOIN') END AS subtask
        FROM {{queries}} q LEFT JOIN keys k ON k.table_id = q.query_id
        LEFT JOIN {{verdicts}} v ON v.query_id = q.query_id
        """,
        queries=queries,
        profiles=profiles,
        verdicts=verdicts,
    )


def plan_queries(queries: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """Queries ``(query_id, tenant_id, subtask)`` with their plan.

    ``overrides`` may name any plan field per ``query_id``; a null keeps the default.
    """
    join, union = asdict(P.JOIN_PLAN), asdict(P.UNION_PLAN)
    given = set(overrides.columns) if overrides is not None else set()
    joined = queries.join(overrides, "query_id", "left") if overrides is not None else queries
    fields = []
    for name in join:
        cast = "int" if name.startswith("k_") else "double"
        default = f"CASE WHEN subtask = 'UNION' THEN {union[name]} ELSE {join[name]} END"
        value = f"coalesce({name}, {default})" if name in given else default
        fields.append(f"cast({value} AS {cast}) AS {name}")
    return joined.selectExpr(*queries.columns, *fields)


def detect_scenario(tables: DataFrame, profiles: DataFrame, mode: str = "target") -> DataFrame:
    """``table_id, scenario``.

    ``tables`` has ``table_id, row_count, hint`` and ``profiles`` one row per column.
    A valid hint wins. ``target`` judges by the values at hand: no samples or almost
    only nulls in every column is SMD, few rows SSD, else SLD. ``source`` judges by
    what was profiled: any statistics SLD, else any samples SSD, else SMD.
    """
    bare = f"size(sample_values) = 0 OR null_ratio > {P.SMD_NULL_RATIO}D"
    rule = {
        "target": f"""CASE WHEN coalesce(bare, true) THEN 'SMD'
                      WHEN row_count <= {P.SSD_MAX_ROWS} THEN 'SSD' ELSE 'SLD' END""",
        "source": "CASE WHEN stats THEN 'SLD' WHEN samples THEN 'SSD' ELSE 'SMD' END",
    }[mode]
    return tables.sparkSession.sql(
        f"""
        WITH rich AS (
          SELECT table_id, bool_and({bare}) AS bare, bool_or(size(sample_values) > 0) AS samples,
                 bool_or(numeric_stats IS NOT NULL OR top_k IS NOT NULL) AS stats
          FROM {{profiles}} GROUP BY table_id)
        SELECT t.table_id, CASE WHEN hint IN {tuple(P.SCENARIOS)} THEN hint ELSE {rule} END AS scenario
        FROM {{tables}} t LEFT JOIN rich USING (table_id)
        """,
        tables=tables,
        profiles=profiles,
    )
