"""The table registry: ingest decisions, listing, archiving, retention.

A registry row has ``table_id, tenant_id, source_system, source_uri, table_name,
row_count, col_count, schema_hash, content_hash, uploaded_by, uploaded_at,
updated_at, status``. Functions take and return whole registries; a caller writes
the result as the next version of the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeweave.functions import ids

LISTED = (
    "table_id",
    "table_name",
    "tenant_id",
    "status",
    "row_count",
    "col_count",
    "source_system",
    "uploaded_by",
    "uploaded_at",
    "updated_at",
)


def ingest(uploads: DataFrame, registry: DataFrame | None = None) -> DataFrame:
    """Uploads with ``table_id, status``: INGESTED, or REJECTED with the id of the table
    that already has this content.

    ``uploads`` has ``tenant_id, table_name, content_hash, uploaded_at, seq``. Content is
    unique per tenant, counting registered tables of any status; of equal uploads the
    first one wins. The winner of each content is found by an aggregation that combines
    before the shuffle, so any number of copies of one content is one row per task.
    """
    keyed = uploads.withColumn(
        "own_id", ids.table_id(F.col("tenant_id"), F.col("table_name"), F.col("content_hash"))
    )
    key = ["tenant_id", "content_hash"]
    order = F.struct("uploaded_at", "seq")
    winners = keyed.groupBy(*key).agg(
        F.min_by("own_id", order).alias("first_id"), F.min_by("seq", order).alias("first_seq")
    )
    if registry is not None:
        known = registry.groupBy(*key).agg(
            F.min_by("table_id", F.struct("uploaded_at", "table_id")).alias("known_id")
        )
        winners = winners.join(known, key, "left")
    else:
        winners = winners.withColumn("known_id", F.lit(None).cast("string"))
    return keyed.join(winners, key).selectExpr(
        *uploads.columns,
        "coalesce(known_id, first_id) AS table_id",
        "CASE WHEN known_id IS NULL AND seq = first_seq THEN 'INGESTED' ELSE 'REJECTED' END AS status",
    )


def new_rows(decided: DataFrame) -> DataFrame:
    """What the ingested uploads add to the registry."""
    return decided.filter("status = 'INGESTED'").withColumn("updated_at", F.col("uploaded_at"))


def register_external(tables: DataFrame, now: Column) -> DataFrame:
    """Registry rows of tables that stay where they are: ``tenant_id, table_name, source_uri``.

    The data is not read, so the address stands for the content.
    """
    return (
        tables.withColumn("source_system", F.lit("host_platform"))
        .withColumn("content_hash", ids.short_hash(F.col("source_uri")))
        .withColumn("table_id", ids.table_id(F.col("tenant_id"), F.col("table_name"), F.col("content_hash")))
        .withColumn("uploaded_at", now)
        .withColumn("updated_at", now)
        .withColumn("status", F.lit("INGESTED"))
    )


def apply_reuploads(registry: DataFrame, uploads: DataFrame, now: Column) -> DataFrame:
    """The registry after tables were uploaded again under their name.

    The same schema only updates the row count and the time. Another schema archives
    the old row and adds the new one. ``uploads`` has the registry's columns and one
    row per ``tenant_id, source_system, table_name``.
    """
    key = ["tenant_id", "source_system", "table_name"]
    live = "status NOT IN ('ARCHIVED', 'REJECTED')"
    new = uploads.selectExpr(*key, "schema_hash AS new_hash", "row_count AS new_rows")
    touched = f"{live} AND new_hash IS NOT NULL"
    kept = (
        registry.join(new, key, "left")
        .withColumn("row_count", F.expr(f"CASE WHEN {touched} AND new_hash = schema_hash THEN new_rows ELSE row_count END"))
        .withColumn("updated_at", F.when(F.expr(touched), now).otherwise(F.col("updated_at")))
        .withColumn("status", F.expr(f"CASE WHEN {touched} AND new_hash <> schema_hash THEN 'ARCHIVED' ELSE status END"))
        .select(*registry.columns)
    )
    current = registry.filter(live).select(*key, "schema_hash")
    added = uploads.join(current, [*key, "schema_hash"], "left_anti")
    return kept.unionByName(added.select(*registry.columns))


def page(
    registry: DataFrame, tenant: str, status: str | None = None, offset: int = 0, limit: int = 50
) -> DataFrame:
    """One page of a tenant's tables, newest first, with the total before paging."""
    mine = registry.filter(F.col("tenant_id") == tenant)
    if status is not None:
        mine = mine.filter(F.col("status") == status)
    total = mine.groupBy("tenant_id").agg(F.count("*").alias("total"))
    rows = mine.select(*LISTED).orderBy(F.col("uploaded_at").desc(), "table_id").offset(offset).limit(limit)
    return rows.join(total, "tenant_id")


def lookup(registry: DataFrame, tenant: str, table_id: str) -> DataFrame:
    """One table; empty if it belongs to another tenant."""
    return registry.filter((F.col("table_id") == table_id) & (F.col("tenant_id") == tenant))


def archive(registry: DataFrame, wanted: DataFrame, now: Column) -> DataFrame:
    """Archive ``(tenant_id, table_id)`` rows; archiving twice changes nothing."""
    marked = wanted.select("tenant_id", "table_id", F.lit(True).alias("hit")).distinct()
    change = F.coalesce(F.col("hit"), F.lit(False)) & (F.col("status") != "ARCHIVED")
    return (
        registry.join(marked, ["tenant_id", "table_id"], "left")
        .withColumn("updated_at", F.when(change, now).otherwise(F.col("updated_at")))
        .withColumn("status", F.when(change, F.lit("ARCHIVED")).otherwise(F.col("status")))
        .select(*registry.columns)
    )


def without_archived(vectors: DataFrame, registry: DataFrame) -> DataFrame:
    """Vectors whose table is not archived."""
    return vectors.join(registry.filter("status = 'ARCHIVED'").select("table_id"), "table_id", "left_anti")


def set_vector_status(vectors: DataFrame, tables: DataFrame, status: str) -> DataFrame:
    """Vectors with a new status for all vectors of the given tables."""
    hit = tables.select("table_id", F.lit(True).alias("hit")).distinct()
    return (
        vectors.join(hit, "table_id", "left")
        .withColumn("status", F.when(F.col("hit"), F.lit(status)).otherwise(F.col("status")))
        .select(*vectors.columns)
    )


def expired(registry: DataFrame, now: Column, days: int) -> DataFrame:
    """Archived rows past their retention."""
    return registry.filter(
        (F.col("status") == "ARCHIVED") & (F.col("updated_at") < now - F.make_interval(days=F.lit(days)))
    )


def collect_garbage(registry: DataFrame, now: Column, days: int) -> DataFrame:
    return registry.join(expired(registry, now, days).select("table_id"), "table_id", "left_anti")


def rejected_requests(requests: DataFrame, registry: DataFrame) -> DataFrame:
    """Requests ``(tenant_id, table_id, ...)`` whose table is missing, foreign or not READY."""
    good = registry.filter("status = 'READY'").select("tenant_id", "table_id")
    return requests.join(good, ["tenant_id", "table_id"], "left_anti")


def recover(registry: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The registry with interrupted profiling reset, and the tables to profile (again)."""
    reset = registry.withColumn(
        "status", F.when(F.col("status") == "PROFILING", F.lit("INGESTED")).otherwise(F.col("status"))
    )
    return reset, reset.filter("status = 'INGESTED'").select("table_id")
