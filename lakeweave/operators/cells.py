"""Exact vector search over coarse cells with bounds.

Candidates belong to the cell of the nearest of a few centroids, and a cell knows its widest angle and its longest and
shortest vector. The angle between a query and any vector of a cell is at least the angle to the centroid less the
cell's widest one, so no dot product of the cell can exceed a bound. A query first meets the cells nearest to it that
together hold more than ``k`` vectors; its ``k``-th best score there is one that it will reach at least, and it then is
compared only with those other cells whose bound is no lower. The result is that of comparing everything, whatever the
centroids are; how much is left out depends on how well the vectors gather. Vectors without any structure are all
compared.

Cells are searched in blocks of several, so a query is copied once per block and not once per cell. Within a block
of cells, blocks of queries meet blocks of candidates, so neither a popular cell nor a large tenant makes a large task.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakeweave import params as P
from lakeweave.operators import blocks
from lakeweave.session import materialize

# Room for rounding in angles and dot products.
SLACK = 1e-6
ROUNDS = 4
CHUNK = 1024
# Vectors of a block of cells at most, however short they are.
MOST_ROWS = 65536


@dataclass(frozen=True)
class Cells:
    """``rows``: ``table_id, tenant_id, vector, cell``. ``bounds``: per tenant arrays of what is known of its cells, at most
    as many as there are centroids. ``groups``: ``tenant_id, cell, block``, the neighbouring cells that are searched
    together, about ``block_rows`` vectors."""

    centroids: np.ndarray
    rows: DataFrame
    bounds: DataFrame
    groups: DataFrame
    block_rows: int


def _tools() -> tuple[Callable, Callable]:
    """Unit vectors with their lengths, and a matrix of a column, as functions that tasks get by value."""

    def unit(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        norms = np.linalg.norm(x, axis=1)
        return x / np.where(norms > 0, norms, 1.0)[:, None], norms

    def matrix(column) -> np.ndarray:
        return np.stack([np.asarray(v, dtype="float64") for v in column])

    return unit, matrix


def centroids_of(candidates: DataFrame, n_cells: int, sample: int = P.SCALE.centroid_sample) -> np.ndarray:
    """Means of a few rounds over at most ``sample`` vectors, those with the smallest hashes."""
    unit, matrix = _tools()
    chosen = candidates.orderBy(F.xxhash64("table_id"), "table_id").limit(sample).select("vector").toPandas()
    points, _ = unit(matrix(chosen["vector"]))
    centres = points[:n_cells]
    for _ in range(ROUNDS):
        nearest = (points @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, points)
        moved, lengths = unit(sums)
        centres = np.where(lengths[:, None] > 0, moved, centres)
    return centres


def build(
    candidates: DataFrame,
    n_cells: int,
    keep: Callable[[DataFrame, str], DataFrame] = materialize,
    block_rows: int | None = None,
) -> Cells:
    """Cells of ``table_id, tenant_id, vector``."""
    centres = centroids_of(candidates, n_cells)
    id_type = dict(candidates.dtypes)["table_id"]
    unit, matrix = _tools()

    def assign(frames):
        for frame in frames:
            for at in range(0, len(frame), CHUNK):
                part = frame.iloc[at : at + CHUNK].copy()
                units, norms = unit(matrix(part["vector"]))
                dots = units @ centres.T
                part["cell"] = dots.argmax(1).astype("int32")
                part["toward"] = dots.max(1)
                part["norm"] = norms
                yield part

    kind = _vector_type(candidates)
    rows = keep(
        candidates.select("table_id", "tenant_id", "vector").mapInPandas(
            assign, f"table_id {id_type}, tenant_id string, vector {kind}, cell int, toward double, norm double"
        ),
        "cells",
    )
    if block_rows is None:
        block_rows = min(MOST_ROWS, max(1024, P.SCALE.block_bytes // (4 * centres.shape[1])))
    before = Window.partitionBy("tenant_id").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    known = keep(
        rows.groupBy("tenant_id", "cell")
        .agg(F.count("*").alias("n"), F.min("toward").alias("toward"), F.min("norm").alias("low"), F.max("norm").alias("high"))
        .withColumn("block", F.floor(F.coalesce(F.sum("n").over(before), F.lit(0)) / block_rows).cast("int")),
        "cell-bounds",
    )
    listed = F.sort_array(F.collect_list(F.struct("cell", "n", "toward", "low", "high", "block"))).alias("c")
    fields = [F.col(f"c.{n}").alias(n) for n in ("cell", "n", "toward", "low", "high", "block")]
    bounds = known.groupBy("tenant_id").agg(listed).select("tenant_id", *fields)
    groups = known.select("tenant_id", "cell", "block")
    return Cells(centres, rows.drop("toward", "norm"), keep(bounds, "tenant-bounds"), groups, block_rows)


def _vector_type(df: DataFrame) -> str:
    """Single precision stays as it is."""
    return "array<float>" if dict(df.dtypes)["vector"] == "array<float>" else "array<double>"


def route(queries: DataFrame, cells: Cells, reached: DataFrame | None = None) -> DataFrame:
    """Queries copied to blocks of cells, as ``query_id, tenant_id, k, theta, floor, vector, block, cells``.

    Without ``reached``, the nearest cells that hold more than ``k`` vectors. With it (``query_id, floor``: the least
    score that still matters), all others that can hold such a score. A query has one copy per block, however many
    cells of the block it meets.
    """
    centres = cells.centroids
    id_type = dict(queries.dtypes)["query_id"]
    asked = queries.select("query_id", "tenant_id", "k", "theta", "vector")
    if reached is not None:
        asked = asked.join(reached, "query_id", "left")
    else:
        asked = asked.withColumn("floor", F.lit(None).cast("double"))
    rest = reached is not None
    unit, matrix = _tools()

    def picked_cells(part, rows, units, norms) -> tuple[np.ndarray, np.ndarray]:
        """Cells of the tenant of ``rows``, and which of them each row meets."""
        known = part.iloc[rows[0]]
        ids, held = np.asarray(known["cell"]), np.asarray(known["n"])
        dots = np.clip(units[rows] @ centres[ids].T, -1.0, 1.0)
        near = np.argsort(-dots, axis=1, kind="stable")
        # Those before the place where the number held first exceeds k, and that one.
        upto = np.cumsum(held[near], axis=1) - held[near] <= part["k"].to_numpy()[rows][:, None]
        first = np.zeros(dots.shape, dtype=bool)
        np.put_along_axis(first, near, upto, axis=1)
        if not rest:
            return ids, first
        toward = np.clip(np.asarray(known["toward"]), -1.0, 1.0)
        cosine = np.cos(np.maximum(0.0, np.arccos(dots) - np.arccos(toward) - SLACK))
        length = np.where(cosine > 0, np.asarray(known["high"]), np.asarray(known["low"]))
        bound = norms[rows][:, None] * length * cosine + SLACK
        floors = [part[c].to_numpy(dtype="float64", na_value=np.nan)[rows] for c in ("floor", "theta")]
        least = np.nan_to_num(np.fmax(*floors), nan=-np.inf)
        return ids, (bound >= least[:, None]) & ~first

    def run(frames):
        import pandas as pd

        for frame in frames:
            for at in range(0, len(frame), CHUNK):
                part = frame.iloc[at : at + CHUNK].reset_index(drop=True)
                units, norms = unit(matrix(part["vector"]))
                for rows in part.groupby("tenant_id").indices.values():
                    ids, picked = picked_cells(part, rows, units, norms)
                    of = np.asarray(part["block"].iloc[rows[0]])
                    for block in np.unique(of):
                        inside = np.flatnonzero(of == block)
                        owner = rows[picked[:, inside].any(1)]
                        if not len(owner):
                            continue
                        out = part.loc[owner, ["query_id", "tenant_id", "k", "theta", "floor", "vector"]].reset_index(drop=True)
                        out["block"] = pd.Series(block, index=out.index, dtype="int32")
                        met = picked[:, inside]
                        out["cells"] = [ids[inside[m]] for m in met[met.any(1)]]
                        yield out

    return asked.join(cells.bounds, "tenant_id").mapInPandas(
        run,
        f"query_id {id_type}, tenant_id string, k int, theta double, floor double, vector {_vector_type(queries)}, "
        "block int, cells array<int>",
    )


def _compare(routed: DataFrame, cells: Cells, q_rows: int, c_rows: int) -> DataFrame:
    """Best ``k`` of every query over the cells it was copied to; the tenant's block of cells plays the tenant."""
    own = F.concat_ws("#", F.col("block").cast("string"), "tenant_id")
    return blocks.dense_top_k(
        routed.withColumn("tenant_id", own).drop("block"),
        cells.rows.join(cells.groups, ["tenant_id", "cell"]).withColumn("tenant_id", own).drop("block"),
        q_rows,
        c_rows,
    )


def top_k(
    queries: DataFrame,
    cells: Cells,
    keep: Callable[[DataFrame, str], DataFrame] = materialize,
    q_rows: int | None = None,
    c_rows: int | None = None,
) -> DataFrame:
    """``query_id, table_id, score`` as ``blocks.block_top_k`` gives it for dot products.

    ``queries`` has ``query_id, tenant_id, k, theta, vector``, one row per query.
    """
    if q_rows is None:
        cores = queries.sparkSession.sparkContext.defaultParallelism
        q_rows = blocks.query_rows(queries.count(), cores, most=cells.block_rows)
    sizes = q_rows, c_rows or 2 * cells.block_rows
    first = keep(_compare(keep(route(queries, cells), "nearest"), cells, *sizes), "nearest-hits")
    reached = (
        first.groupBy("query_id")
        .agg(F.count("*").alias("n"), F.min("score").alias("least"))
        .join(queries.select("query_id", "k"), "query_id")
        .select("query_id", F.when(F.col("n") >= F.col("k"), F.col("least")).alias("floor"))
    )
    more = _compare(keep(route(queries, cells, reached), "others"), cells, *sizes)
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "table_id")
    return (
        first.unionByName(more)
        .join(queries.select("query_id", "k"), "query_id")
        .withColumn("rank", F.row_number().over(w))
        .filter("rank <= k")
        .select("query_id", "table_id", "score")
    )
