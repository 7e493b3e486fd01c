"""Sharding by extendible hashing.

A directory is indexed by the leading bits of a hash of id and text. A bucket that fits its byte limit is a shard;
only an oversized one splits on another bit, until every shard fits. Sizes are summed per hash
prefix, so the documents themselves are not moved; a document larger than the limit is a shard of its own.

Only rows that are wholly alike share all 60 bits of the content hash. Should they alone exceed the
limit, further bits come from a row number that is written once before, so no group of copies is too
large to split.

Defined results: a null text has no bytes; null ids and repeated rows are sharded like any other; an empty table
gives an empty result; further columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeweave.llm.common import text_of, within
from lakeweave.session import materialize

SHARD_BYTES = 32 * 1024 * 1024
BITS = 60
# Bits that a round looks ahead beyond the depth at which shards would fit if all were equally large.
AHEAD = 6


def hashed_rows(documents: DataFrame, whole: bool = False) -> DataFrame:
    """``doc_id, bytes, hi, lo``: size and hash bits of every row, written once; ``whole`` adds ``row``."""
    row = [F.struct("*").alias("row")] if whole else []
    base = documents.select(documents["doc_id"].cast("long").alias("doc_id"), text_of(documents).alias("text"), *row)
    row = ["row"] if whole else []
    digest = F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("text")))
    number = F.md5(F.monotonically_increasing_id().cast("string"))
    bits = lambda c: F.conv(F.substring(c, 1, BITS // 4), 16, 10).cast("long")
    return materialize(
        base.select("doc_id", F.octet_length("text").cast("long").alias("bytes"), bits(digest).alias("hi"), bits(number).alias("lo"), *row),
        "hashes",
    )


def _prefix(depth: str) -> tuple[str, str]:
    """SQL for the first ``depth`` of 120 bits, as two numbers."""
    return (
        f"shiftright(hi, {BITS} - least({depth}, {BITS}))",
        f"CASE WHEN {depth} > {BITS} THEN shiftright(lo, {2 * BITS} - {depth}) ELSE 0L END",
    )


def directory(rows: DataFrame, limit: int) -> DataFrame:
    """``depth, p, q, bytes, docs``: the shards, by the number and value of their leading bits."""
    total = rows.agg(F.sum("bytes")).first()[0] or 0
    depth = 0
    end = min(BITS, max(0, math.ceil(math.log2(max(total, 1) / limit))) + AHEAD)
    pending, shards = rows, None
    while True:
        p, q = _prefix(str(end))
        cells = pending.groupBy(F.expr(p).alias("p"), F.expr(q).alias("q")).agg(
            F.sum("bytes").alias("bytes"), F.count("*").alias("docs")
        )
        # Sizes at all depths of this round, from those at its end.
        up = cells.select(F.explode(F.sequence(F.lit(depth), F.lit(end))).alias("depth"), "p", "q", "bytes", "docs")
        beyond = end > BITS
        at = up.select(
            "depth",
            (F.col("p") if beyond else F.expr(f"shiftright(p, {end} - depth)")).alias("p"),
            (F.expr(f"shiftright(q, {end} - depth)") if beyond else F.lit(0).cast("long")).alias("q"),
            "bytes",
            "docs",
        )
        sizes = materialize(
            at.groupBy("depth", "p", "q").agg(F.sum("bytes").alias("bytes"), F.sum("docs").alias("docs")).withColumn(
                "fits", (F.col("bytes") <= limit) | (F.col("docs") == 1)
            ),
            "sizes",
        )
        # A shard fits and what it was split from does not. The buckets that a later round begins with don't fit.
        over = sizes.where("NOT fits").select(
            (F.col("depth") + 1).alias("depth"), F.col("p").alias("over_p"), F.col("q").alias("over_q")
        )
        parent = (
            [F.expr("shiftright(p, 1)") == F.col("over_p")]
            if not beyond
            else [F.col("p") == F.col("over_p"), F.expr("shiftright(q, 1)") == F.col("over_q")]
        )
        child = sizes.alias("s").join(over.alias("o"), [F.col("s.depth") == F.col("o.depth"), *parent], "left_semi")
        leaves = child.where("fits")
        if depth == 0:
            leaves = leaves.unionByName(sizes.where("depth = 0 AND fits"))
        leaves = leaves.select("depth", "p", "q", "bytes", "docs")
        shards = leaves if shards is None else shards.unionByName(leaves)
        rest = sizes.where(f"depth = {end} AND NOT fits").select(F.col("p").alias("x"), F.col("q").alias("y"))
        if end >= 2 * BITS or rest.isEmpty():
            return materialize(shards, "directory")
        p, q = _prefix(str(end))
        pending = pending.join(within(rest), [F.expr(p) == F.col("x"), F.expr(q) == F.col("y")], "left_semi")
        depth, end = end, min(BITS if end < BITS else 2 * BITS, end + 2 * AHEAD)


def shard(documents: DataFrame, limit: int = SHARD_BYTES) -> DataFrame:
    """``doc_id, bytes, depth, prefix, shard_bytes, shard_docs`` per row; ``prefix`` is the shard's bits."""
    return _placed(hashed_rows(documents), limit)


def write(documents: DataFrame, folder: str, limit: int = SHARD_BYTES) -> None:
    """Writes the documents, with all their columns, as one folder ``_shard=b<prefix>`` per shard."""
    placed = _placed(hashed_rows(documents, whole=True), limit, ["row"])
    named = placed.select(F.concat(F.lit("b"), "prefix").alias("_shard"), "row.*")
    named.repartition("_shard").write.mode("overwrite").partitionBy("_shard").parquet(folder)


def _placed(rows: DataFrame, limit: int, keep: list[str] | None = None) -> DataFrame:
    shards = directory(rows, limit)
    depths = [r[0] for r in shards.select("depth").distinct().orderBy("depth").collect()]  # 121 at most
    # A row's shard is the one whose depth and leading bits it has: one probe per depth in use.
    probes = rows.withColumn("depth", F.explode(F.array(*[F.lit(d) for d in depths]))) if depths else rows.withColumn("depth", F.lit(0))
    p, q = _prefix("depth")
    probes = probes.withColumn("p", F.expr(p)).withColumn("q", F.expr(q))
    found = probes.join(
        within(shards.select("depth", "p", "q", F.col("bytes").alias("shard_bytes"), F.col("docs").alias("shard_docs"))),
        ["depth", "p", "q"],
    )
    bits = F.concat(F.lpad(F.bin("hi"), BITS, "0"), F.lpad(F.bin("lo"), BITS, "0"))
    return found.select(
        "doc_id", "bytes", "depth", F.substring(bits, F.lit(1), F.col("depth")).alias("prefix"), "shard_bytes", "shard_docs",
        *(keep or []),
    )
