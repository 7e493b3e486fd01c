"""Continuous ingest: new files become registered, profiled tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeweave.operators import profile
from lakeweave.session import materialize, scratch
from lakeweave.sources import files, folder as listings


def _read(spark: SparkSession, path: str, schema, batch_id: int) -> DataFrame:
    """What earlier batches wrote; a replayed batch does not see its own output."""
    return spark.read.schema(schema).parquet(path).filter(F.col("batch") != batch_id)


def stream_tables(
    spark: SparkSession, folder: str, store: str, checkpoint: str, tenant: str = "default", pattern: str = "*"
):
    """Watch a folder; every new content is registered and profiled once.

    Each batch writes ``registry`` and ``profiles`` under its own number with
    overwrite, so a batch replayed after a failure leaves one copy. A table is READY
    once its profile is written, FAILED if its file cannot be read, and REJECTED if
    the tenant has its content already.
    """
    arrivals = (
        spark.readStream.format("binaryFile")
        .schema("path string, modificationTime timestamp, length long, content binary")
        .option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", "true")
        .load(folder)
        .select("path", "modificationTime", "length")
    )
    registry_schema = (
        "table_id string, table_name string, tenant_id string, content_hash string, source_uri string, "
        "col_count bigint, schema_hash string, row_count bigint, status string, error string, "
        "uploaded_at timestamp, batch int"
    )

    def run(batch: DataFrame, batch_id: int) -> None:
        with scratch(batch.sparkSession):  # what a batch only needs itself goes with it
            write(batch, batch_id)

    def write(batch: DataFrame, batch_id: int) -> None:
        key = ["tenant_id", "content_hash"]
        session = batch.sparkSession
        # The stream tells names and lengths; a file of no bytes is only in the listing.
        empty = listings.listing(session, folder, pattern).filter("length = 0")
        if batch_id > 0:
            listed = _read(session, f"{store}/registry", registry_schema, batch_id).select(F.col("source_uri").alias("path"))
            empty = empty.join(listed, "path", "left_anti")
        arrived = batch.select("path", "length").unionByName(empty)
        times = batch.select("path", "modificationTime")
        hashed = materialize(
            listings.content_hashes(arrived).join(times, "path", "left").withColumn("tenant_id", F.lit(tenant)), "arrivals"
        )
        first = hashed.groupBy(*key).agg(F.min_by("path", F.struct("modificationTime", "path")).alias("path"))
        if batch_id > 0:
            known = _read(session, f"{store}/registry", registry_schema, batch_id).filter("status <> 'REJECTED'")
            first = first.join(known.select(*key), key, "left_anti")
        fresh = hashed.join(first.select("path"), "path", "left_semi").select("path", "length", "content_hash")
        tables, columns, cells = files.ingest_files(fresh, tenant, F.current_timestamp())
        largest = tables.agg(F.max("row_count")).first()[0] or 0
        profiles = profile.store_profiles(profile.column_profiles(columns, cells, largest))
        profiles.write.mode("overwrite").parquet(f"{store}/profiles/batch={batch_id}")
        repeated = hashed.join(first.select("path"), "path", "left_anti").select(
            F.col("path").alias("source_uri"), *key, F.lit("REJECTED").alias("status")
        )
        done = tables.withColumn("status", F.when(F.col("error").isNull(), "READY").otherwise("FAILED"))
        done.unionByName(repeated, allowMissingColumns=True).write.mode("overwrite").parquet(
            f"{store}/registry/batch={batch_id}"
        )

    return (
        arrivals.writeStream.foreachBatch(run)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
