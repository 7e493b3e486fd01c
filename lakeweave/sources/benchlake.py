"""A benchmark lake derived from given tables, with known joins, unions and matches.

Every row of a base table goes to one of ``splits`` parts by its key, and each part
is a table of its own. Some parts publish renamed columns and some only a subset,
so parts of one base table are unionable and their columns correspond.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeweave.functions import types
from lakeweave.sources.lake import TABLE_KEY, SchemaGroup, lake_tables, quoted

# Style of part 0, 1, 2, ...; the list repeats for more than eight parts.
PART_STYLES = ("plain", "plain", "plain", "plain", "suffix", "suffix", "prefix", "subset")


@dataclass(frozen=True)
class BaseTable:
    name: str
    df: DataFrame
    key: str


def published_columns(base: BaseTable, style: str) -> list[tuple[int, str]]:
    """(ordinal, published name); a dropped column leaves a gap in the ordinals."""
    named = list(enumerate(base.df.columns))
    if style == "suffix":
        return [(i, f"{c}_val") for i, c in named]
    if style == "prefix":
        return [(i, f"col_{c}") for i, c in named]
    if style == "subset":
        return [(i, c) for i, c in named if c == base.key or i % 2 == 0]
    return named


def split_group(base: BaseTable, splits: int = 8, tenant: str = "default") -> SchemaGroup:
    part = F.pmod(quoted(base.key).cast("long"), F.lit(splits))
    names = [f"{base.name}_{p}" for p in range(splits)]
    kinds = [types.logical_type(f.dataType) for f in base.df.schema.fields]
    columns = [
        (names[p], i, name, kinds[i])
        for p in range(splits)
        for i, name in published_columns(base, PART_STYLES[p % len(PART_STYLES)])
    ]
    return SchemaGroup(
        rows=base.df.withColumn(
            TABLE_KEY, F.concat(F.lit(f"{base.name}_"), part.cast("string"))
        ),
        tables=[(n, n, tenant) for n in names],
        published=columns,
    )


def split_lake(bases: list[BaseTable], splits: int = 8, tenant: str = "default") -> list[SchemaGroup]:
    return [split_group(b, splits, tenant) for b in bases]


def base_of(groups: list[SchemaGroup]) -> DataFrame:
    """``table_id, base``: which table a part was taken from."""
    return lake_tables(groups).select(
        "table_id", F.regexp_extract("table_id", r"^(.*)_\d+$", 1).alias("base")
    )


def union_truth(groups: list[SchemaGroup]) -> DataFrame:
    """Ordered pairs of parts of one base table; a base has only ``splits`` parts."""
    parts = base_of(groups)
    left = parts.withColumnRenamed("table_id", "query_id")
    return left.join(parts, "base").filter("query_id <> table_id").select("query_id", "table_id")


def match_truth(groups: list[SchemaGroup], columns: DataFrame) -> DataFrame:
    """Column pairs of equal origin between unionable parts."""
    origin = columns.join(base_of(groups), "table_id").select("base", "ordinal", "table_id", "col_name")
    source = origin.select(
        "base", "ordinal", F.col("table_id").alias("source_table_id"), F.col("col_name").alias("source_column")
    )
    target = origin.select(
        "base", "ordinal", F.col("table_id").alias("target_table_id"), F.col("col_name").alias("target_column")
    )
    return (
        source.join(target, ["base", "ordinal"])
        .filter("source_table_id <> target_table_id")
        .drop("base", "ordinal")
    )
