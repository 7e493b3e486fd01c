"""Dense vectors of tables and columns: encoding, upsert, filtered top-k."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakeweave import params as P
from lakeweave.operators import blocks, cells, terms


def hashed_encoder(docs: DataFrame, key: str, text: str, dim: int = P.EMBEDDING_DIM) -> DataFrame:
    """``key, vector``: term weights summed into ``dim`` buckets by term digest, unit length.

    The offline stand-in for a sentence encoder. A text without known terms has no vector.
    """
    rows = terms.postings(terms.unit_terms(docs, key, text, "name"), key)
    bucket = f"int(pmod(conv(substr(md5(term), 1, 8), 16, 10), {dim}))"
    summed = rows.selectExpr(key, f"{bucket} AS i", "weight").groupBy(key, "i").agg(F.sum("weight").alias("w"))
    return (
        summed.groupBy(key)
        .agg(
            F.expr("map_from_entries(collect_list(struct(i, w)))").alias("m"),
            F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"),
        )
        .selectExpr(
            key,
            f"transform(sequence(0, {dim - 1}), i -> coalesce(try_element_at(m, i), 0D) / norm) AS vector",
        )
    )


def encode(
    docs: DataFrame,
    key: str,
    text: str,
    load: Callable[[], Callable],
    batch: int = P.ENCODE_BATCH,
) -> DataFrame:
    """``key, vector`` from a user's encoder.

    ``load()`` runs once per Python worker task and returns a function from a list
    of texts to a list of vectors, which are scaled to unit length here.
    """
    key_type = dict(docs.dtypes)[key]

    def run(frames):
        import numpy as np
        import pandas as pd

        encoder = load()
        for frame in frames:
            for start in range(0, len(frame), batch):
                part = frame.iloc[start : start + batch]
                matrix = np.asarray(encoder(part["text"].tolist()), dtype="float64")
                norms = np.linalg.norm(matrix, axis=1, keepdims=True)
                unit = matrix / np.where(norms > 0, norms, 1.0)
                yield pd.DataFrame({"key": part["key"].to_numpy(), "vector": list(unit)})

    return (
        docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
        .mapInPandas(run, f"key {key_type}, vector array<double>")
        .withColumnRenamed("key", key)
    )


def upsert(stored: DataFrame, incoming: DataFrame, key: str, version: str) -> DataFrame:
    """Last write per id wins. Both sides have the same columns.

    ``max_by`` combines versions before the shuffle, so an id that is written over
    and over never gathers in one task.
    """
    rest = [c for c in stored.columns if c != key]
    both = stored.unionByName(incoming)
    return (
        both.groupBy(key).agg(F.max_by(F.struct(*rest), version).alias("last")).select(key, "last.*")
    )


def top_k(
    queries: DataFrame, vectors: DataFrame, k: int = P.JOIN_PLAN.k_2, cell_vectors: int = P.SCALE.cell_vectors, **sizes
) -> DataFrame:
    """Best ``k`` READY vectors of the query's tenant by cosine, the query itself excluded.

    ``queries`` has ``query_id, tenant_id, vector`` and ``vectors`` has ``table_id,
    tenant_id, status, vector``; all vectors have unit length. More vectors than a cell should hold are
    divided into cells, of which a query meets those that can hold one of its best.
    """
    if "k" not in queries.columns:
        queries = queries.withColumn("k", F.lit(k))
    q = queries.selectExpr("query_id", "tenant_id", "int(k) AS k", "double(NULL) AS theta", "vector")
    c = vectors.filter("status = 'READY'").select("table_id", "tenant_id", "vector")
    n_cells = min(P.SCALE.max_cells, c.count() // cell_vectors)
    if n_cells > 1:
        hits = cells.top_k(q, cells.build(c, n_cells), **sizes)
    else:
        hits = blocks.dense_top_k(q, c, **sizes)
    return hits.withColumnRenamed("score", "s2")


def roll_up(hits: DataFrame, owners: DataFrame) -> DataFrame:
    """Column hits ``(query_id, table_id = column id, s2)`` summed up per owning table."""
    return (
        hits.join(owners, hits["table_id"] == owners["column_id"])
        .groupBy(hits["query_id"], owners["owner_id"])
        .agg(F.max("s2").alias("best"), F.count("*").alias("n_columns"))
    )


# -- columns ---------------------------------------------------------------------------------------


def column_collection(tables: DataFrame, texts: DataFrame, encoder: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """``column_id, table_id, tenant_id, status, col_name, col_type, vector``: one vector per column.

    ``texts`` has ``column_id, table_id, col_name, col_type, encoder_text``. ``encoder`` maps ``column_id, encoder_text`` to
    ``column_id, vector``; without one, the hashed terms of the texts are the vectors. A column
    without known terms has no vector and is absent.
    """
    if encoder is None:
        dense = hashed_encoder(texts, "column_id", "encoder_text")
    else:
        dense = encoder(texts.select("column_id", "encoder_text"))
    owned = texts.select("column_id", "table_id", "col_name", "col_type").join(
        tables.select("table_id", "tenant_id", "status"), "table_id"
    )
    return owned.join(dense, "column_id").select(
        "column_id", "table_id", "tenant_id", "status", "col_name", "col_type", "vector"
    )


def column_top_k(queries: DataFrame, columns: DataFrame, k: int = P.TOP_COLUMNS, **sizes) -> DataFrame:
    """``query_id, column_id, table_id, score``: the best ``k`` columns of other READY tables of the tenant.

    Both sides have the columns of a collection; ``query_id`` is the id of the asking column. Columns of the asking
    table can take up as many places as it has columns, so that many more are fetched and
    dropped afterwards, which leaves the ``k`` best of the others.
    """
    own = columns.groupBy("table_id").agg(F.count("*").alias("n_own"))
    asked = queries.join(own, "table_id", "left").selectExpr(
        "column_id AS query_id", "table_id AS asking", "tenant_id", f"int({k} + coalesce(n_own, 0)) AS k", "vector"
    )
    stored = columns.selectExpr("column_id AS table_id", "tenant_id", "status", "vector")
    hits = top_k(asked, stored, **sizes).withColumnsRenamed({"table_id": "column_id", "s2": "score"})
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "column_id")
    return (
        hits.join(columns.select("column_id", "table_id"), "column_id")
        .join(asked.select("query_id", "asking"), "query_id")
        .filter("table_id <> asking")
        .withColumn("place", F.row_number().over(w))
        .filter(F.col("place") <= k)
        .select("query_id", "asking", "column_id", "table_id", "score")
    )


def tables_by_columns(hits: DataFrame, k: int = P.TOP_TABLES_BY_COLUMNS) -> DataFrame:
    """``query_table_id, rank, table_id, n_columns, best, total`` from the hits of single columns.

    A table counts by the number of asking columns with a hit in it, then by the sum of their best scores.
    At most one row per asking column and table reaches the second aggregation.
    """
    per_column = hits.groupBy("asking", "table_id", "query_id").agg(F.max("score").alias("best"))
    per_table = per_column.groupBy(F.col("asking").alias("query_table_id"), "table_id").agg(
        F.count("*").alias("n_columns"), F.max("best").alias("best"), F.round(F.sum("best"), 6).alias("total")
    )
    w = Window.partitionBy("query_table_id").orderBy(F.col("n_columns").desc(), F.col("total").desc(), "table_id")
    return per_table.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
