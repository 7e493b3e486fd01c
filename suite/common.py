"""Inputs shared by the registered queries, and the SQL fragments that mirror them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeweave.plans.store import ProfileStore, build_store
from lakeweave.sources import benchlake
from lakeweave.sources.lake import SchemaGroup, single_table

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)
# Key by which a table is split into the parts of the benchmark lake.
SPLIT_KEYS = {
    "region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey",
    "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey",
    "lineitem": "l_orderkey", "events": "event_id", "documents": "doc_id",
    "embeddings": "vec_id", "pages": "page_id", "benchmark": "item_id",
    "labels": "doc_id", "conversations": "conv_id",
}


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


REGISTRY: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    """Register a query under ``name`` with the SQL that gives the same rows."""

    def add(fn):
        if name in REGISTRY:
            raise ValueError(f"query {name} is registered twice")
        REGISTRY[name] = Query(fn, sql)
        return fn

    return add


@lru_cache(maxsize=None)
def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table. Keeping the plan saves reading its footer for every query."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Vectors as whole millionths, which print alike everywhere, so that their column can be checked like any other.
SCALED = "transform(embedding, x -> cast(round(cast(x as double) * 1000000) as bigint))"
SQL_SCALED = "list_transform(embedding, lambda x: CAST(round(CAST(x AS DOUBLE) * 1000000) AS BIGINT))"


def lake_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = table(spark, sf_dir, name)
    return df.withColumn("embedding", F.expr(SCALED)) if name == "embeddings" else df


@lru_cache(maxsize=None)
def lake(spark: SparkSession, sf_dir: str) -> list[SchemaGroup]:
    """The given tables as a lake, one schema group each."""
    return [single_table(lake_table(spark, sf_dir, n), n) for n in TABLES]


@lru_cache(maxsize=None)
def bench_lake(spark: SparkSession, sf_dir: str) -> list[SchemaGroup]:
    """112 tables derived from the given ones."""
    return benchlake.split_lake(
        [benchlake.BaseTable(n, lake_table(spark, sf_dir, n), SPLIT_KEYS[n]) for n in TABLES]
    )


@lru_cache(maxsize=None)
def store(spark: SparkSession, sf_dir: str) -> ProfileStore:
    """The profiled benchmark lake, as ingest would have written it."""
    return build_store(bench_lake(spark, sf_dir))


@lru_cache(maxsize=None)
def base_store(spark: SparkSession, sf_dir: str) -> ProfileStore:
    """The profiled given tables."""
    return build_store(lake(spark, sf_dir))


def sql_list(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


# Catalog of the given tables: table_id, ordinal, col_name, col_type.
SQL_COLUMNS = f"""
cols AS (
  SELECT table_name AS table_id, CAST(column_index - 1 AS INTEGER) AS ordinal, column_name AS col_name,
         CASE WHEN data_type IN ('TINYINT','SMALLINT','INTEGER','BIGINT') THEN 'int'
              WHEN data_type IN ('FLOAT','DOUBLE') OR data_type LIKE 'DECIMAL%' THEN 'float'
              WHEN data_type LIKE 'TIMESTAMP%' OR data_type = 'DATE' THEN 'date'
              WHEN data_type = 'BOOLEAN' THEN 'bool'
              ELSE 'str' END AS col_type
  FROM duckdb_columns() WHERE table_name IN ({sql_list(TABLES)})
)"""

# The same for the benchmark lake: eight parts per table, published names as in its styles.
SQL_BENCH_COLUMNS = f"""{SQL_COLUMNS},
keys(base, key) AS (VALUES {", ".join(f"('{t}', '{k}')" for t, k in SPLIT_KEYS.items())}),
bcols AS (
  SELECT c.table_id || '_' || p.part AS table_id, c.table_id AS base, p.part, c.ordinal, c.col_type,
         CASE WHEN p.part IN (4, 5) THEN c.col_name || '_val'
              WHEN p.part = 6 THEN 'col_' || c.col_name
              ELSE c.col_name END AS col_name
  FROM cols c JOIN keys k ON k.base = c.table_id CROSS JOIN range(8) p(part)
  WHERE p.part <> 7 OR c.col_name = k.key OR c.ordinal % 2 = 0
)"""


def sql_cells(kinds: tuple[str, ...], bench: bool, schemas: dict[str, list[tuple[str, str]]]) -> str:
    """UNION ALL of every column of the wanted logical types as (table_id, ordinal, value)."""
    parts = []
    for name, cols in schemas.items():
        owner = f"'{name}_' || ({SPLIT_KEYS[name]} % 8)" if bench else f"'{name}'"
        for i, (col, kind) in enumerate(cols):
            if kind in kinds:
                if kind == "date":
                    value = f"CAST(epoch_us({col}) AS DOUBLE) / 1e6"
                elif kind in ("int", "float"):
                    value = f"CAST({col} AS DOUBLE)"
                elif (name, col) == ("embeddings", "embedding"):
                    value = f"CAST(CAST({SQL_SCALED} AS JSON) AS VARCHAR)"
                else:
                    value = f"CAST({col} AS VARCHAR)"
                parts.append(
                    f"SELECT {owner} AS table_id, CAST({i} AS INTEGER) AS ordinal, {value} AS value FROM {name}"
                )
    return "\nUNION ALL\n".join(parts)


# Columns of the given tables in order, with their logical types.
SCHEMAS: dict[str, list[tuple[str, str]]] = {
    "region": [("r_regionkey", "int"), ("r_name", "str")],
    "nation": [("n_nationkey", "int"), ("n_name", "str"), ("n_regionkey", "int")],
    "customer": [("c_custkey", "int"), ("c_name", "str"), ("c_nationkey", "int"),
                 ("c_acctbal", "float"), ("c_mktsegment", "str")],
    "supplier": [("s_suppkey", "int"), ("s_name", "str"), ("s_nationkey", "int"), ("s_acctbal", "float")],
    "part": [("p_partkey", "int"), ("p_name", "str"), ("p_brand", "str"), ("p_type", "str"),
             ("p_size", "int"), ("p_retailprice", "float")],
    "orders": [("o_orderkey", "int"), ("o_custkey", "int"), ("o_orderstatus", "str"),
               ("o_totalprice", "float"), ("o_orderdate", "date"), ("o_orderpriority", "str")],
    "lineitem": [("l_orderkey", "int"), ("l_partkey", "int"), ("l_suppkey", "int"), ("l_linenumber", "int"),
                 ("l_quantity", "float"), ("l_extendedprice", "float"), ("l_discount", "float"),
                 ("l_tax", "float"), ("l_returnflag", "str"), ("l_linestatus", "str"), ("l_shipdate", "date")],
    "events": [("event_id", "int"), ("ts", "date"), ("user_id", "int"), ("event_type", "str"),
               ("value", "float"), ("props", "str")],
    "documents": [("doc_id", "int"), ("text", "str"), ("lang", "str"), ("source", "str"), ("n_chars", "int")],
    "embeddings": [("vec_id", "int"), ("embedding", "str"), ("label", "int")],
    "pages": [("page_id", "int"), ("url", "str"), ("html", "str")],
    "benchmark": [("item_id", "int"), ("text", "str")],
    "labels": [("doc_id", "int"), ("quality", "int"), ("toxic", "int")],
    "conversations": [("conv_id", "int"), ("turn", "int"), ("role", "str"), ("text", "str")],
}
