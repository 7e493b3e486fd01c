"""A lake as groups of tables that share a schema, and its catalog and cells.

A schema group is one DataFrame holding the rows of any number of tables, told
apart by a ``_table_id`` column. A plan therefore grows with the number of
different schemas and not with the number of tables.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeweave.functions import ids, types
from lakeweave.session import literal_rows

TABLE_KEY = "_table_id"


_TABLES = "table_id string, table_name string, tenant_id string"
_COLUMNS = "table_id string, ordinal int, col_name string, col_type string, col_description string"

_SHAPE = ("ordinal", "col_name", "col_type", "col_description")
_SHAPE_TYPE = "array<struct<ordinal:int,col_name:string,col_type:string,col_description:string>>"


def tick(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def quoted(name: str) -> Column:
    return F.col(tick(name))


@dataclass(frozen=True)
class SchemaGroup:
    """Rows of tables with one schema.

    ``tables`` says which: rows ``(table_id, table_name, tenant_id)`` where they are
    known when the plan is made, or a DataFrame of these columns for any number of
    them. ``published`` replaces the columns taken from the schema by rows
    ``(table_id, ordinal, name, type)``, for tables that show other names or only
    some of their columns.
    """

    rows: DataFrame
    tables: DataFrame | list[tuple[str, str, str]]
    descriptions: dict[str, str] = field(default_factory=dict)
    published: list[tuple[str, int, str, str]] | None = None

    @cached_property
    def fields(self):
        return [f for f in self.rows.schema.fields if f.name != TABLE_KEY]

    def described(self) -> list[tuple[int, str, str, str | None]]:
        return [
            (i, f.name, types.logical_type(f.dataType), self.descriptions.get(f.name))
            for i, f in enumerate(self.fields)
        ]


def single_table(
    df: DataFrame,
    name: str,
    table_id: str | None = None,
    tenant: str = "default",
    descriptions: dict[str, str] | None = None,
) -> SchemaGroup:
    key = table_id or name
    return SchemaGroup(df.withColumn(TABLE_KEY, F.lit(key)), [(key, name, tenant)], descriptions or {})


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def lake_tables(groups: list[SchemaGroup]) -> DataFrame:
    known = [t for g in groups if isinstance(g.tables, list) for t in g.tables]
    frames = [
        g.tables.select("table_id", "table_name", "tenant_id")
        for g in groups
        if not isinstance(g.tables, list)
    ]
    if known:
        frames.append(literal_rows(groups[0].rows.sparkSession, _TABLES, known))
    return _union(frames)


def lake_columns(groups: list[SchemaGroup]) -> DataFrame:
    """``table_id, ordinal, col_name, col_type, col_description, column_id``."""
    spark, known, frames = groups[0].rows.sparkSession, [], []
    for g in groups:
        if g.published is not None:
            known += [(t, i, n, k, g.descriptions.get(n)) for t, i, n, k in g.published]
        elif isinstance(g.tables, list):
            known += [(t[0], *c) for t in g.tables for c in g.described()]
        else:
            shape = json.dumps([dict(zip(_SHAPE, c)) for c in g.described()])
            columns = F.from_json(F.lit(shape), _SHAPE_TYPE)
            frames.append(g.tables.select("table_id", F.inline(columns)))
    if known:
        frames.append(literal_rows(spark, _COLUMNS, known))
    return _union(frames).withColumn(
        "column_id", ids.column_id(F.col("table_id"), F.col("ordinal"), F.col("col_name"))
    )


@dataclass(frozen=True)
class Cells:
    """Long form ``table_id, ordinal, value``, one frame per value domain.

    ``whole`` holds integers, and dates as microseconds; ``real`` holds doubles;
    ``text`` holds everything categorical.
    """

    whole: DataFrame | None
    real: DataFrame | None
    text: DataFrame | None


_DOMAIN = {"int": "whole", "date": "whole", "float": "real", "str": "text", "bool": "text"}
_AS_VALUE = {"whole": types.as_integer, "real": types.as_float, "text": types.as_text}


def lake_cells(groups: list[SchemaGroup]) -> Cells:
    """Unpivot every table. Rows stream from the scan, which reads the domain's columns only."""
    spark = groups[0].rows.sparkSession
    parts: dict[str, list[str]] = {"whole": [], "real": [], "text": []}
    frames = {}
    for n, group in enumerate(groups):
        frames[f"rows{n}"] = group.rows
        wide: dict[str, dict[int, str]] = {k: {} for k in parts}
        for i, f in enumerate(group.fields):
            domain = _DOMAIN[types.logical_type(f.dataType)]
            wide[domain][i] = _AS_VALUE[domain](tick(f.name), f.dataType)
        for domain, values in wide.items():
            if values:
                shown = ", ".join(f"{v} AS c{i}" for i, v in values.items())
                names = ", ".join(f"c{i} AS `{i}`" for i in values)
                parts[domain].append(
                    f"SELECT {TABLE_KEY} AS table_id, CAST(ordinal AS int) AS ordinal, value "
                    f"FROM (SELECT {TABLE_KEY}, {shown} FROM {{rows{n}}}) "
                    f"UNPIVOT INCLUDE NULLS (value FOR ordinal IN ({names}))"
                )

    def union(domain: str) -> DataFrame | None:
        if not parts[domain]:
            return None
        return spark.sql(" UNION ALL ".join(parts[domain]), **frames)

    return Cells(whole=union("whole"), real=union("real"), text=union("text"))


def table_fingerprints(groups: list[SchemaGroup]) -> DataFrame:
    """Row count and an order-insensitive content hash per table."""
    frames = []
    for group in groups:
        digest = ids.row_digest([quoted(f.name) for f in group.fields])
        frames.append(
            group.rows.select(F.col(TABLE_KEY).alias("table_id"), digest.alias("digest"))
            .groupBy("table_id")
            .agg(F.count("*").alias("row_count"), F.sum("digest").alias("digest_sum"))
        )
    return _union(frames).withColumn(
        "content_hash",
        ids.short_hash(F.concat_ws(":", F.col("row_count").cast("string"), F.col("digest_sum").cast("string"))),
    )


def row_counts(groups: list[SchemaGroup]) -> DataFrame:
    """Rows per table; a table without rows is absent."""
    frames = {f"rows{n}": g.rows for n, g in enumerate(groups)}
    return groups[0].rows.sparkSession.sql(
        " UNION ALL ".join(
            f"SELECT {TABLE_KEY} AS table_id, count(*) AS row_count FROM {{{n}}} GROUP BY {TABLE_KEY}"
            for n in frames
        ),
        **frames,
    )


def largest_table(groups: list[SchemaGroup]) -> int:
    """An upper bound of the rows of any table, from file footers where the format has them."""
    frames = {f"rows{n}": g.rows for n, g in enumerate(groups)}
    counts = " UNION ALL ".join(f"SELECT count(*) AS n FROM {{{n}}}" for n in frames)
    return groups[0].rows.sparkSession.sql(f"SELECT max(n) FROM ({counts})", **frames).first()[0]


def catalog(groups: list[SchemaGroup]) -> DataFrame:
    """Tables with row and column counts and the schema fingerprint."""
    shape = lake_columns(groups).groupBy("table_id").agg(
        F.count("*").alias("col_count"),
        ids.schema_hash(F.collect_list(F.struct("ordinal", "col_name", "col_type"))).alias("schema_hash"),
    )
    return (
        lake_tables(groups)
        .join(shape, "table_id", "left")
        .join(row_counts(groups), "table_id", "left")
        .na.fill(0, ["row_count", "col_count"])
    )


def read_tables(spark: SparkSession, folder: str, names: list[str]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{folder}/{n}.parquet") for n in names}
