"""Session settings and the shared work folder."""

from __future__ import annotations

import json
import re
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "lakeweave", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the jobs assume; cluster settings win over ours."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


# Folders that this process made, to be deleted by ``scratch`` or ``release``.
_MADE: list[str] = []


def work_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder under ``spark.checkpoint.dir``.

    Executors and driver must both see it, so a machine-local folder is only
    made up when driver and executors are one process and there is no such setting.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder shared by the cluster")
        base = tempfile.mkdtemp(prefix="lakeweave-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"
    _MADE.append(path)
    return path


def release(spark: SparkSession, since: int = 0) -> None:
    """Delete the folders made so far, or those after the first ``since``.

    Frames that read them can no longer be used.
    """
    paths = _MADE[since:]
    del _MADE[since:]
    for path in paths:
        found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(found, True)


@contextmanager
def scratch(spark: SparkSession):
    """Intermediate folders made inside are deleted at the end; write results elsewhere first."""
    since = len(_MADE)
    try:
        yield
    finally:
        release(spark, since)


def materialize(df: DataFrame, purpose: str, compression: str | None = None) -> DataFrame:
    """Cut the lineage by writing a table to the shared folder and reading it back.

    Used where one intermediate result feeds several later steps: it survives the
    loss of executors and its size is known to the optimizer afterwards.
    """
    spark = df.sparkSession
    path = work_dir(spark, purpose)
    df.write.mode("overwrite").parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, key: str) -> DataFrame:
    """Rows hashed over all cores where a scan has fewer splits than the session has cores.

    For work that is heavy per row. A table of many files already has enough splits and
    is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, key)


# Bytes of a batch that goes to Python, where the session doesn't set a bound of its own.
BATCH_BYTES = "8m"
_BATCH_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded_batches(df: DataFrame) -> DataFrame:
    """``df``, in a session whose batches for Python are bounded by bytes and not by rows alone."""
    conf = df.sparkSession.conf
    if conf.get(_BATCH_KEY, None) is None:
        conf.set(_BATCH_KEY, BATCH_BYTES)
    return df


def literal_rows(spark: SparkSession, schema: str, rows: list[tuple]) -> DataFrame:
    """Metadata rows as one literal, without Python tasks or a job."""
    names = [part.split()[0] for part in schema.split(",")]
    text = json.dumps([dict(zip(names, row)) for row in rows])
    struct = ", ".join(f"{n}: {part.split()[1]}" for n, part in zip(names, schema.split(",")))
    return spark.sql(
        f"SELECT inline(from_json(:rows, 'array<struct<{struct}>>'))", args={"rows": text}
    )
