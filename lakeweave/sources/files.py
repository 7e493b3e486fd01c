"""Files as tables: parquet and CSV scans, encodings, content hashes, bulk ingest, manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeweave.functions import ids
from lakeweave.session import materialize
from lakeweave.sources import folder
from lakeweave.sources.lake import Cells


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A parquet or CSV file (or folder of parts) with a header, by suffix; anything but parquet is CSV.

    Encoding, header and quoting come from one pass over the lines; types are those that all values have. Rows with
    more cells than the header are an error, as they have cells of no column.
    """
    if path.lower().rstrip("/").endswith(".parquet"):
        return spark.read.parquet(path)
    heads = folder.csv_heads(spark, [path])
    shape = heads.agg(
        F.bool_and("utf8").alias("utf8"), F.bool_or("multiline").alias("multiline"), F.min("path").alias("path"),
        F.min_by("head", "path").alias("head"), F.min_by("head_open", "path").alias("head_open"),
    ).first()
    if shape["head"] is None:
        raise ValueError(f"{path} is empty")
    names = folder.header_names(spark, shape)
    read = folder.read_csv(spark, [path], names, shape["utf8"], shape["multiline"])
    text = read.drop("longer")
    values = [F.when(~F.col(c).isin(*folder.MISSING), F.col(c)) for c in text.columns]
    cells = read.select(F.posexplode(F.array(*values, F.when(F.col("longer"), F.lit("x")))).alias("i", "value"))
    found = cells.groupBy("i").agg(folder.inferred_type().alias("kind"), F.count("value").alias("n")).collect()
    kinds = {r["i"]: r["kind"] for r in found}
    longer = sum(r["n"] for r in found if r["i"] == len(names))
    if longer:
        raise ValueError(f"{longer} rows of {path} have more cells than the header")
    cast = {"int": "bigint", "float": "double", "bool": "boolean"}
    return text.select(
        *[
            F.when(~F.col(c).isin(*folder.MISSING), F.col(c) if k == "str" else F.trim(c).cast(cast[k])).alias(n)
            for i, (c, n) in enumerate(zip(text.columns, names))
            for k in [kinds.get(i, "str")]
        ]
    )


def schema_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Tables that are known by their schema only.

    The file lists ``TableName, TableDesc, ColumnName, ColumnType, ColumnDesc, IsPK,
    IsFK``; the result has ``table_name, table_desc`` and the array ``columns``.
    Columns number in file order, which the row's place in its file gives.
    """
    raw = read_table(spark, path)
    raw = raw.select(
        *[F.trim(F.col(c).cast("string")).alias(c) for c in raw.columns],
        F.monotonically_increasing_id().alias("place"),
    )
    have = set(raw.columns)
    for name in ("TableDesc", "ColumnType", "ColumnDesc", "IsPK", "IsFK"):
        if name not in have:
            raw = raw.withColumn(name, F.lit(None).cast("string"))
    return (
        raw.filter("coalesce(TableName, '') <> ''")
        .groupBy(F.col("TableName").alias("table_name"))
        .agg(
            F.min_by("TableDesc", "place").alias("table_desc"),
            F.sort_array(
                F.collect_list(F.struct("place", "ColumnName", "ColumnType", "ColumnDesc", "IsPK", "IsFK"))
            ).alias("c"),
        )
        .selectExpr(
            "table_name",
            "coalesce(table_desc, '') AS table_desc",
            """transform(c, (x, i) -> struct(
                 i AS ordinal, x.ColumnName AS name, lower(coalesce(nullif(x.ColumnType, ''), 'str')) AS type,
                 nullif(x.ColumnDesc, '') AS description,
                 coalesce(upper(x.IsPK) = 'YES', false) AS is_pk, coalesce(upper(x.IsFK) = 'YES', false) AS is_fk)) AS columns""",
        )
    )


def file_hashes(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """``path, length, content_hash`` of all files below a folder."""
    return folder.content_hashes(folder.listing(spark, path, pattern))


def bulk_ingest(
    spark: SparkSession, path: str, tenant: str, now, known: DataFrame | None = None, pattern: str = "*"
) -> tuple[DataFrame, DataFrame, Cells]:
    """Tables, columns and cells of a folder of files of any size.

    Files that are empty or cannot be read stay in the first result with status FAILED.
    ``known`` lists table ids to skip, so a repeated run only takes new files.
    """
    return ingest_files(file_hashes(spark, path, pattern), tenant, now, known)


def ingest_files(
    files: DataFrame, tenant: str, now, known: DataFrame | None = None
) -> tuple[DataFrame, DataFrame, Cells]:
    """The same for files given by ``path, length, content_hash``."""
    name = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "")
    named = files.withColumns({"tenant_id": F.lit(tenant), "table_name": name}).withColumn(
        "table_id", ids.table_id(F.col("tenant_id"), F.col("table_name"), F.col("content_hash"))
    )
    if known is not None:
        named = named.join(known.select("table_id"), "table_id", "left_anti")
    named = materialize(named, "files")
    typed, values, errors = folder.read_folder(named)
    # Copies of a file under one name are one table, read from the first of them.
    keys = named.groupBy("table_id").agg(F.min("path").alias("path"))
    columns = typed.join(keys, "path").select(
        "table_id", "ordinal", "col_name", "col_type", F.lit(None).cast("string").alias("col_description")
    )
    columns = materialize(
        columns.withColumn("column_id", ids.column_id(F.col("table_id"), F.col("ordinal"), F.col("col_name"))), "columns"
    )
    rows = values.join(keys, "path").select("table_id", "ordinal", "value")
    shape = columns.groupBy("table_id").agg(
        F.count("*").alias("col_count"),
        ids.schema_hash(F.collect_list(F.struct("ordinal", "col_name", "col_type"))).alias("schema_hash"),
    )
    sizes = rows.filter("ordinal = 0").groupBy("table_id").agg(F.count("*").alias("row_count"))
    tables = (
        named.select("table_id", "table_name", "tenant_id", "content_hash", F.col("path").alias("source_uri"))
        .join(shape, "table_id", "left")
        .join(sizes, "table_id", "left")
        .join(errors.withColumnRenamed("path", "source_uri"), "source_uri", "left")
        .withColumn("status", F.when(F.col("error").isNull(), "INGESTED").otherwise("FAILED"))
        .withColumn("uploaded_at", now)
        .na.fill(0, ["row_count", "col_count"])
    )
    kinds = columns.select("table_id", "ordinal", "col_type")

    def cells(wanted: str, value: str) -> DataFrame:
        own = rows.join(kinds.filter(f"col_type IN ({wanted})"), ["table_id", "ordinal"])
        return own.select("table_id", "ordinal", F.expr(value).alias("value"))

    return (
        tables,
        columns,
        Cells(
            whole=cells("'int', 'date'", "try_cast(trim(value) as bigint)"),
            real=cells("'float'", "nullif(try_cast(trim(value) as double), double('NaN'))"),
            text=cells("'str', 'bool'", "if(col_type = 'bool', lower(value), value)"),
        ),
    )


def write_manifests(tables: DataFrame, columns: DataFrame, path: str) -> None:
    """One JSON document per table with its columns nested in order."""
    fields = [c for c in columns.columns if c not in ("table_id", "ordinal")]
    nested = columns.groupBy("table_id").agg(
        F.sort_array(F.collect_list(F.struct("ordinal", *fields))).alias("columns")
    )
    tables.join(nested, "table_id", "left").write.mode("overwrite").json(path)


def read_manifests(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Tables and columns back from manifests."""
    docs = spark.read.json(path)
    columns = docs.select("table_id", F.inline("columns"))
    return docs.drop("columns"), columns


def truth_by_name(pairs: DataFrame, tables: DataFrame) -> DataFrame:
    """Known pairs of table names, with or without ``.csv``, and their ids (null if unknown)."""
    out = pairs
    for side in ("query", "candidate"):
        name = F.regexp_replace(F.col(f"{side}_table"), r"\.csv$", "")
        ids_of = tables.select(
            F.col("table_name").alias(f"{side}_table_name"), F.col("table_id").alias(f"{side}_table_id")
        )
        out = out.withColumn(f"{side}_table_name", name).join(ids_of, f"{side}_table_name", "left")
    return out.drop("query_table", "candidate_table")


def pick_clean_pairs(pairs: DataFrame, columns: DataFrame, n: int | None = None) -> DataFrame:
    """Known pairs whose columns exist, one per pair of tables; the first ``n`` if given.

    ``pairs`` has ``seq, query_table, candidate_table, query_column, candidate_column``
    and ``columns`` has ``table_name, col_name``.
    """
    known = pairs
    for side in ("query", "candidate"):
        have = columns.select(
            F.col("table_name").alias(f"{side}_table"), F.col("col_name").alias(f"{side}_column")
        )
        known = known.join(have, [f"{side}_table", f"{side}_column"], "left_semi")
    rest = [c for c in pairs.columns if c not in ("query_table", "candidate_table")]
    picked = (
        known.groupBy("query_table", "candidate_table")
        .agg(F.min(F.struct("seq", *[c for c in rest if c != "seq"])).alias("first"))
        .select("query_table", "candidate_table", "first.*")
    )
    return picked if n is None else picked.orderBy("seq").limit(n)


def nested_matches(truth: DataFrame) -> DataFrame:
    """Column matches of truth documents as rows."""
    rest = [c for c in truth.columns if c != "column_matches"]
    return truth.select(*rest, F.inline("column_matches"))


__all__ = [
    "bulk_ingest",
    "file_hashes",
    "ingest_files",
    "nested_matches",
    "pick_clean_pairs",
    "read_manifests",
    "read_table",
    "schema_catalog",
    "truth_by_name",
    "write_manifests",
]
