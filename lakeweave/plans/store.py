"""The profile store: what ingest writes once and discovery and matching read."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeweave.operators import matching, profile, terms, vectors
from lakeweave.session import materialize
from lakeweave.sources import lake as L


# Jobs of a store that run side by side.
AT_ONCE = 4


@dataclass(frozen=True)
class ProfileStore:
    """Tables written to the shared folder.

    ``tables``: catalog, texts, types and status. ``profiles``: one row per column.
    ``values``: different values per column as text, with counts; long texts by their stand-ins
    (``profile.stand_in``). ``value_keys``: the same as numbers. ``terms`` and
    ``vectors``: sparse and dense unit vectors per table. ``features``: what matching needs of
    the columns of a table, one row each. ``column_vectors``: one dense vector per column.
    """

    tables: DataFrame
    profiles: DataFrame
    values: DataFrame
    terms: DataFrame
    vectors: DataFrame
    features: DataFrame
    column_vectors: DataFrame
    value_keys: DataFrame


def column_values(counts: profile.ValueCounts) -> DataFrame:
    """Different values as text; numbers and categories are told apart by ``is_number``."""
    parts = []
    for df, is_number in ((counts.numeric, True), (counts.text, False)):
        if df is not None:
            text = F.col("value").cast("string").alias("value")
            parts.append(df.select(*profile.KEY, F.lit(is_number).alias("is_number"), text, "cnt"))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def value_keys(counts: profile.ValueCounts) -> DataFrame:
    """``c, v1, v2``: column and value of every different value as numbers, 24 bytes whatever the value."""
    parts = [
        df.select(profile.column_key().alias("c"), *profile.value_keys())
        for df in (counts.numeric, counts.text)
        if df is not None
    ]
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def build_store(
    groups: list[L.SchemaGroup],
    tokenizer: str = "name",
    encoder: Callable[[DataFrame], DataFrame] | None = None,
    keep: Callable[[DataFrame, str], DataFrame] = materialize,
    column_encoder: Callable[[DataFrame], DataFrame] | None = None,
) -> ProfileStore:
    """Profile a lake. ``encoder`` maps ``table_id, encoder_text`` to ``table_id, vector``, ``column_encoder`` the same
    with ``column_id``."""
    columns = keep(L.lake_columns(groups), "columns")
    cells = L.lake_cells(groups)

    def written_tables() -> DataFrame:
        catalog = L.lake_tables(groups).join(L.row_counts(groups), "table_id", "left").na.fill(0, ["row_count"])
        return keep(profile.table_profiles(catalog, columns).withColumn("status", F.lit("READY")), "tables")

    def written_vectors(tables: DataFrame) -> DataFrame:
        if encoder is None:
            dense = vectors.hashed_encoder(tables, "table_id", "encoder_text")
        else:
            dense = encoder(tables.select("table_id", "encoder_text"))
        return keep(dense.join(tables.select("table_id", "tenant_id", "status"), "table_id"), "vectors")

    # Jobs that don't need each other share the cluster.
    with ThreadPoolExecutor(AT_ONCE) as pool:
        asked = pool.submit(written_tables)
        summary = pool.submit(lambda: keep(profile.cell_summary(cells), "summary"))
        largest = pool.submit(L.largest_table, groups)
        counts = profile.key_counts(cells, largest.result()).kept(keep, columns, pool)
        tables = asked.result()
        unit = pool.submit(lambda: keep(terms.unit_terms(tables, "table_id", "text_blob", tokenizer), "terms"))
        dense = pool.submit(written_vectors, tables)
        texts = profile.column_texts(tables, columns)
        of_columns = pool.submit(lambda: keep(vectors.column_collection(tables, texts, column_encoder), "column-vectors"))
        keys = pool.submit(lambda: keep(value_keys(counts), "value-keys"))
        profiles = keep(
            profile.column_profiles(columns, cells, largest.result(), counts, summary.result(), keep), "profiles"
        )
        features = keep(matching.column_features(profiles), "features")
        return ProfileStore(
            tables=tables,
            profiles=profiles,
            values=column_values(counts),
            terms=unit.result(),
            vectors=dense.result(),
            features=features,
            column_vectors=of_columns.result(),
            value_keys=keys.result(),
        )
