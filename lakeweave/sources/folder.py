"""Folders of files as tables, by Spark's readers and without a limit of size.

Every file gets a row: empty ones are listed by the file system, broken ones keep their error. Files are
grouped by what their first line or footer says of their columns, and each group is one scan. A CSV file is
read as splits unless a quoted cell of it goes over several lines.
"""

from __future__ import annotations

import csv
from concurrent.futures import ThreadPoolExecutor
from fnmatch import fnmatch
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeweave.functions import types
from lakeweave.session import materialize, work_dir

BOM = "﻿"
# The most bytes of a file that are hashed as one value; larger ones are hashed by their lines, in splits.
WHOLE_FILE = 2**26
# Cells that mean a missing value.
MISSING = ("", "NA", "N/A", "NaN", "nan", "null", "NULL", "None", "n/a", "#N/A")
NANOS = "spark.sql.legacy.parquet.nanosAsLong"
LISTING = "path string, length bigint"
CELLS = "path string, ordinal int, value string"
COLUMNS = "path string, ordinal int, col_name string, col_type string"
# The ordinal under which a row with more cells than its header is noted.
LONGER = -1


def listing(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """``path, length`` of all files below a folder; those of zero bytes too, which no scan shows."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    root = hadoop.Path(folder)
    found = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(root, True)
    top = len(root.toUri().getPath().rstrip("/")) + 1
    rows = []
    while found.hasNext():
        status = found.next()
        inner = status.getPath().toUri().getPath()[top:].split("/")
        if not any(part[:1] in ("_", ".") for part in inner) and fnmatch(inner[-1], pattern):
            rows.append((status.getPath().toString(), status.getLen()))
    return spark.createDataFrame(rows, LISTING)


def source_path() -> Column:
    """The path of the file a row was read from, written as the listing writes it."""
    path = F.expr("url_decode(replace(_metadata.file_path, '+', '%2B'))")
    return F.regexp_replace(path, "^file:/+", "file:/")


def _paths(listed: DataFrame) -> list[str]:
    return [r.path for r in listed.select("path").orderBy("path").collect()]


def _escaped(paths: list[str]) -> list[str]:
    """Paths as literal ones, as readers take them for patterns."""
    special = str.maketrans({c: "\\" + c for c in "{}[]*?\\"})
    return [p.translate(special) for p in paths]


def line_hashes(spark: SparkSession, paths: list[str]) -> DataFrame:
    """``path, s``: what the bytes of each file are, from its lines and their numbers.

    Only a line feed ends a line, so other line ends stay part of it. The first pass counts the lines of every
    split, which gives the number of a split's first line; so the result doesn't depend on the splits.
    """
    lines = spark.read.option("lineSep", "\n").text(_escaped(paths)).select(
        source_path().alias("path"),
        F.col("_metadata.file_block_start").alias("at"),
        F.monotonically_increasing_id().alias("place"),
        F.col("value").cast("binary").alias("line"),
    )
    splits = lines.groupBy("path", "at").agg(F.count("*").alias("n"), F.min("place").alias("first"))
    before = Window.partitionBy("path").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    starts = splits.select("path", "at", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    starts = materialize(starts, "splits")
    number = F.col("place") - F.col("first") + F.col("start")
    hashed = lines.join(starts, ["path", "at"]).select(
        "path", F.xxhash64(number, "line").alias("a"), F.xxhash64("line", number, F.lit(1)).alias("b")
    )
    total = [F.sum(F.col(c).cast("decimal(38,0)")) for c in ("a", "b")]
    return hashed.groupBy("path").agg(F.concat_ws(":", F.count("*"), *total, F.bit_xor("a"), F.bit_xor("b")).alias("s"))


def content_hashes(listed: DataFrame) -> DataFrame:
    """``path, length, content_hash``: the SHA-256 of a file's bytes, shortened.

    That of a large file is taken of its length and the hashes of its numbered lines. Either way files have the
    same hash where all bytes are the same, in the same order.
    """
    spark = listed.sparkSession
    rows = listed.select("path", "length").collect()  # the listing, as the scan's own planning holds it
    whole = [r.path for r in rows if 0 < r.length <= WHOLE_FILE]
    large = [r.path for r in rows if r.length > WHOLE_FILE]
    none = [(r.path, r.length) for r in rows if r.length == 0]
    parts = [
        spark.createDataFrame(none, LISTING).withColumn("content_hash", F.substring(F.sha2(F.lit(b""), 256), 1, 16))
    ]
    if whole:
        scan = spark.read.format("binaryFile").load(_escaped(whole))
        parts.append(scan.select("path", "length", F.substring(F.sha2("content", 256), 1, 16).alias("content_hash")))
    if large:
        digest = F.sha2(F.concat_ws(":", "length", "s"), 256)
        hashed = listed.join(line_hashes(spark, large), "path")
        parts.append(hashed.select("path", "length", F.substring(digest, 1, 16).alias("content_hash")))
    return reduce(DataFrame.unionByName, parts)


def csv_heads(spark: SparkSession, paths: list[str]) -> DataFrame:
    """``path, head, head_open, utf8, multiline`` per CSV file, from one pass over its lines.

    ``head`` are the bytes of the first line, whose quotes don't close if ``head_open``. A file whose quotes don't close
    within each line has cells that go over several lines.
    """
    lines = spark.read.text(_escaped(paths)).select(
        source_path().alias("path"),
        F.col("_metadata.file_block_start").alias("at"),
        F.monotonically_increasing_id().alias("place"),
        F.col("value").cast("binary").alias("line"),
        F.expr("is_valid_utf8(value)").alias("ok"),
        F.expr("pmod(length(value) - length(replace(value, '\"', '')), 2) = 1").alias("open"),
    )
    return lines.groupBy("path").agg(
        F.expr("min_by(line, place) FILTER (WHERE at = 0)").alias("head"),
        F.expr("min_by(open, place) FILTER (WHERE at = 0)").alias("head_open"),
        F.bool_and("ok").alias("utf8"),
        F.bool_or("open").alias("multiline"),
    )


def header_names(spark: SparkSession, file) -> list[str]:
    """Column names of a CSV file, given as a row of ``csv_heads``; a repeated one gets a number.

    A header that goes over several lines is read as the first record by the reader of the rows.
    """
    if file["head_open"]:
        options = {"quote": '"', "escape": '"', "multiLine": True, "encoding": _encoding(file["utf8"])}
        record = [c or "" for c in spark.read.csv(_escaped([file["path"]]), header=False, **options).first() or []]
    else:
        line = bytes(file["head"] or b"").decode("utf-8" if file["utf8"] else "latin-1")
        record = next(csv.reader([line.removeprefix(BOM).removeprefix("ï»¿")]), [])
    names, seen = [], {}
    for name in record:
        name = name.removeprefix(BOM).strip()
        n = seen.get(name, 0)
        seen[name] = n + 1
        names.append(f"{name}.{n}" if n else name)
    return names


def header_keys(spark: SparkSession, paths: list[str]) -> DataFrame:
    """``path, key``: CSV files with the same key have the same first record, byte for byte, line breaks included.

    One pass over all the files, so that headers over several lines need not be read file by file.
    """
    rows = spark.read.csv(
        _escaped(paths), schema="first string, record string", header=False, quote='"', escape='"', multiLine=True,
        encoding=_encoding(False), columnNameOfCorruptRecord="record", enforceSchema=True,
    )
    # A record of other than one cell is kept as it is written.
    key = F.concat_ws(":", F.col("record").isNull(), F.sha2(F.coalesce("record", "first"), 256))
    keyed = rows.select(source_path().alias("path"), key.alias("key"), F.monotonically_increasing_id().alias("place"))
    return keyed.groupBy("path").agg(F.min_by("key", "place").alias("key"))


def _encoding(utf8: bool) -> str:
    return "UTF-8" if utf8 else "ISO-8859-1"


def read_csv(spark: SparkSession, paths: list[str], names: list[str], utf8: bool, multiline: bool) -> DataFrame:
    """CSV files with the same header as text columns ``c0, c1, ..`` and ``longer``.

    Shorter rows are filled up with nulls; a row is ``longer`` if it has more cells than the header, some of which no
    column shows.
    """
    fields = [T.StructField(f"c{i}", T.StringType()) for i in range(len(names))]
    rows = spark.read.csv(
        _escaped(paths), schema=T.StructType([*fields, T.StructField("record", T.StringType())]), header=True, quote='"',
        escape='"', multiLine=multiline, encoding=_encoding(utf8), columnNameOfCorruptRecord="record",
        enforceSchema=True,
    )
    # Only rows with another number of cells have a record; commas within quoted cells don't count.
    bare = F.regexp_replace("record", r'(^|,)\s*"(?:[^"]|"")*"\s*(?=,|$)', "$1")
    commas = F.length(bare) - F.length(F.replace(bare, F.lit(","), F.lit("")))
    return rows.withColumn("longer", F.coalesce(commas >= len(names), F.lit(False))).drop("record")


def _long(df: DataFrame, values: list[Column]) -> DataFrame:
    cells = F.posexplode(F.array(*values)).alias("ordinal", "value")
    return df.select(source_path().alias("path"), cells)


def inferred_type() -> Column:
    """int, float, bool or str from all values of a column; a column without values is float."""

    def all_are(condition: str) -> Column:
        return F.coalesce(F.expr(f"bool_and({condition}) FILTER (WHERE value IS NOT NULL)"), F.lit(False))

    number = r"trim(value) RLIKE '^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$'"
    whole = r"trim(value) RLIKE '^[+-]?[0-9]+$' AND try_cast(trim(value) AS bigint) IS NOT NULL"
    return (
        F.when(F.count("value") == 0, "float")
        .when(all_are(whole), "int")
        .when(all_are(number), "float")
        .when(all_are("lower(value) IN ('true', 'false')"), "bool")
        .otherwise("str")
    )


def nano_columns(spark: SparkSession, path: str) -> set[str]:
    """Columns of a parquet file that hold times in nanoseconds, which Spark reads as numbers.

    Only the footer is read, without what it says of row groups.
    """
    jvm = spark.sparkContext._jvm
    every = jvm.org.apache.parquet.format.converter.ParquetMetadataConverter.SKIP_ROW_GROUPS
    footer = jvm.org.apache.parquet.hadoop.ParquetFileReader.readFooter(
        spark.sparkContext._jsc.hadoopConfiguration(), jvm.org.apache.hadoop.fs.Path(path), every
    )
    kinds = {f.getName(): f.getLogicalTypeAnnotation() for f in footer.getFileMetaData().getSchema().getFields()}
    return {name for name, kind in kinds.items() if kind is not None and kind.toString().startswith("TIMESTAMP(NANOS")}


def format_error(error: Exception) -> bool:
    """Whether an error says that a parquet file is broken or holds what Spark cannot read.

    Anything else (storage, memory, a lost executor) says nothing of the file.
    """
    if isinstance(error, AnalysisException):
        return error.getCondition() != "PATH_NOT_FOUND"
    cause = error.java_exception if isinstance(error, Py4JJavaError) else None
    if cause is None:
        return False
    while cause.getCause() is not None:
        cause = cause.getCause()
    name, text = cause.getClass().getName(), cause.getMessage() or ""
    if name == "java.lang.RuntimeException":
        return "is not a Parquet file" in text or text.startswith("corrupted file")
    return name.startswith(("shaded.parquet.org.apache.thrift.", "org.apache.parquet.", "org.apache.spark.sql.AnalysisException"))


def read_folder(listed: DataFrame, threads: int = 8) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Columns, cells as text, and errors of all listed files.

    ``path, ordinal, col_name, col_type``; ``path, ordinal, value``; ``path, error``. Cells are written once per
    group of files with the same columns. Dates of parquet files become microseconds. A CSV file with a row that
    has more cells than the header is an error, with the number of such rows; nothing of it is kept.
    """
    spark = listed.sparkSession
    rows = listed.select("path", "length").collect()
    out = work_dir(spark, "cells")
    spark.createDataFrame([], CELLS).write.parquet(out)
    columns: list[tuple[str, int, str, str | None]] = []
    errors = [(r.path, "the file is empty") for r in rows if r.length == 0]
    full = sorted(r.path for r in rows if r.length)
    parquet = [p for p in full if p.lower().endswith(".parquet")]
    text = [p for p in full if not p.lower().endswith(".parquet")]
    groups: dict[tuple, list[str]] = {}
    if text:
        heads = csv_heads(spark, text).collect()  # one row per file
        opened = [r["path"] for r in heads if r["head_open"]]
        keys = dict(header_keys(spark, opened).collect()) if len(opened) > 1 else {}
        read: dict[tuple, list[str]] = {}
        for r in heads:
            # Headers over several lines take a job each, those that are alike one together.
            alike = (keys.get(r["path"], r["path"]), r["utf8"]) if r["head_open"] else None
            names = read.get(alike) if alike else None
            if names is None:
                names = header_names(spark, r)
            if alike:
                read[alike] = names
            if names:
                groups.setdefault((tuple(names), r["utf8"], r["multiline"]), []).append(r["path"])
            else:
                errors.append((r["path"], "the first line is empty"))
    for (names, utf8, multiline), paths in sorted(groups.items()):
        df = read_csv(spark, paths, list(names), utf8, multiline)
        values = [F.when(~F.col(f"c{i}").isin(*MISSING), F.col(f"c{i}")) for i in range(len(names))]
        # A longer row leaves a cell of its own, so that its file can be told.
        last = F.when(F.col("ordinal") == len(names), LONGER).otherwise(F.col("ordinal")).alias("ordinal")
        every = _long(df, [*values, F.when(F.col("longer"), F.lit(""))]).select("path", last, "value")
        every.filter(f"ordinal <> {LONGER} OR value IS NOT NULL").write.mode("append").parquet(out)
        columns += [(p, i, n, None) for p in paths for i, n in enumerate(names)]

    def schema_of(path: str):
        try:
            nanos = nano_columns(spark, path)
            return path, spark.read.parquet(*_escaped([path])).schema, nanos, None
        except Exception as e:
            if not format_error(e):
                raise
            return path, None, set(), str(e)  # a broken footer is an error of this file alone

    nanos_as_long = spark.conf.get(NANOS, "false")
    spark.conf.set(NANOS, "true")
    try:
        same: dict[tuple, tuple[T.StructType, list[str]]] = {}
        with ThreadPoolExecutor(threads) as pool:
            for path, schema, nanos, error in pool.map(schema_of, parquet):
                if schema is None or not schema.fields:
                    errors.append((path, error or "the file has no columns"))
                else:
                    same.setdefault((schema.json(), frozenset(nanos)), (schema, []))[1].append(path)
        for (_, nanos), (schema, paths) in same.items():
            values = []
            for i, f in enumerate(schema.fields):
                kind, name = types.logical_type(f.dataType), "`" + f.name.replace("`", "``") + "`"
                sql = {"int": types.as_integer, "date": types.as_integer, "float": types.as_float}.get(kind, types.as_text)
                value = sql(name, f.dataType)
                if f.name in nanos:
                    kind, value = "date", f"{name} div 1000"
                values.append(F.expr(f"cast({value} as string)"))
                columns += [(p, i, f.name, kind) for p in paths]
            _long(spark.read.schema(schema).parquet(*_escaped(paths)), values).write.mode("append").parquet(out)
    finally:
        spark.conf.set(NANOS, nanos_as_long)
    written = spark.read.schema(CELLS).parquet(out)
    # At most one row per file.
    ragged = materialize(written.filter(f"ordinal = {LONGER}").groupBy("path").agg(F.count("*").alias("n")), "ragged")
    cells = written.filter("ordinal >= 0").join(ragged, "path", "left_anti")
    known = spark.createDataFrame(columns, COLUMNS).join(ragged, "path", "left_anti")
    kinds = cells.groupBy("path", "ordinal").agg(inferred_type().alias("kind"))
    typed = known.join(kinds, ["path", "ordinal"]).select(
        "path", "ordinal", "col_name", F.coalesce("col_type", "kind").alias("col_type")
    )
    # A file with columns but without rows has no cells.
    empty = known.select("path").distinct().join(cells.select("path").distinct(), "path", "left_anti")
    failed = spark.createDataFrame(errors, "path string, error string").unionByName(
        empty.select("path", F.lit("no rows").alias("error"))
    ).unionByName(ragged.selectExpr("path", "concat(n, ' rows have more cells than the header') AS error"))
    return typed, cells, failed
