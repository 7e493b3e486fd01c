"""Helpers of the training-data operators.

Conventions of all of them: a null text is the empty text; only the columns an operator needs
are read, under names of its own, so further columns of any name do no harm; rows are
never identified by ``doc_id`` alone, as it may be null or repeated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeweave.session import bounded_batches, materialize  # noqa: F401

# What separates words everywhere: blank, tab, newline, vertical tab, form feed, return.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Rows and bytes that a broadcast side may have, counted before the hint is given. Beyond them the join shuffles.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 << 20
SHINGLE = 5


def text_of(df: DataFrame, column: str = "text") -> Column:
    return F.coalesce(df[column].cast("string"), F.lit(""))


def identified(documents: DataFrame, rest: bool = False) -> DataFrame:
    """``doc_id, text`` and ``rk``, a 64-bit key of both. Rows that are equal share a key.

    A key is only used to pass on what is true of a text; where two different rows collide
    both get the other's candidates too, and the verification sorts them out. With ``rest``, ``row``
    holds the other columns and whether there was a text at all.
    """
    columns = [documents["doc_id"].cast("long").alias("doc_id"), text_of(documents).alias("text")]
    if rest:
        others = [documents[c] for c in documents.columns if c != "text"]
        columns.append(F.struct(documents["text"].isNotNull().alias("was_text"), F.struct(*others).alias("rest")).alias("row"))
    base = documents.select(*columns)
    key = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "text")
    return base.select("*", key.alias("rk"))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def _runs(words_column: str, width: int, whole: str, run: str, kind: str) -> Column:
    """An array over all runs of words. Words are taken by index, as a slice would copy the whole array.

    ``words_column`` is named several times, so that the optimizer doesn't move the splitting into
    the lambda.
    """
    parts = ", ".join(f"{words_column}[i + {k}]" for k in range(width))
    return F.expr(
        f"CASE WHEN size({words_column}) = 0 THEN cast(array() AS array<{kind}>) "
        f"WHEN size({words_column}) < {width} THEN array({whole}) "
        f"ELSE transform(sequence(0, size({words_column}) - {width}), i -> {run.format(parts)}) END"
    )


def shingles(words_column: str, width: int = SHINGLE) -> Column:
    """Hashes of all runs of ``width`` words; a shorter text is one run."""
    return _runs(words_column, width, f"xxhash64({words_column})", "xxhash64({})", "bigint")


def shingle_texts(words_column: str, width: int = SHINGLE) -> Column:
    """The runs themselves, their words joined by a blank, which no word holds."""
    return _runs(words_column, width, f"array_join({words_column}, ' ')", "concat_ws(' ', {})", "string")


def runs_of(words_column: str, widths: list[int], texts: bool = False) -> Column:
    """The different runs of each of several widths, as hashes or as texts."""
    one = shingle_texts if texts else shingles
    return F.array_distinct(F.concat(*[one(words_column, width) for width in widths]))


def exploded(df: DataFrame, keep: list[str], array: str, name: str) -> DataFrame:
    """``keep`` and one row per element of an array without nulls.

    The outer form keeps the optimizer from computing the array a second time to filter empty ones;
    ``keep`` must hold columns only, as a function of the array beside it would carry the array along.
    """
    return df.select(*keep, F.explode_outer(array).alias(name)).where(F.col(name).isNotNull())


def within(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` written to the shared folder, with a broadcast hint if its counted rows are few and small.

    Without the hint the join shuffles both sides and adaptive execution splits skewed keys.
    """
    kept = materialize(df, "side")
    return F.broadcast(kept) if kept.count() <= rows and value_bytes(kept) <= size else kept


def value_bytes(df: DataFrame) -> int:
    """Bytes of all values: eight for one of fixed width, else those of its text form."""
    wide = ("string", "binary", "array", "struct", "map")
    each = [
        F.coalesce(F.octet_length(F.col(f"`{name}`") if kind == "binary" else F.col(f"`{name}`").cast("string")), F.lit(0))
        if kind.startswith(wide)
        else F.lit(8)
        for name, kind in df.dtypes
    ]
    return df.agg(F.sum(sum(each, F.lit(0)).cast("long")).alias("bytes")).first()["bytes"] or 0
