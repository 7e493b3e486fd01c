"""Texts built from the catalog, and their tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: a run of letters, digits of any kind, and underscores.
WORD_PATTERN = r"([\p{L}\p{N}_]+)"
# The same without underscores.
PART_PATTERN = r"([\p{L}\p{N}]+)"


def word_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD_PATTERN), 1)


def name_tokens(name: str) -> str:
    """SQL for the distinct lower-case parts of a snake, kebab, spaced or camel-case name."""
    spaced = f"lower(regexp_replace({name}, '([a-z0-9])(?=[A-Z])', '$1 '))"
    return rf"array_distinct(filter(split({spaced}, r'(?U)[_\s\-]+'), p -> p <> ''))"


def _described(description: Column) -> Column:
    return F.coalesce(description, F.lit("")) != ""


def text_blob(table_name: Column, columns: Column) -> Column:
    """Table name, then every column name and description in column order."""
    words = F.flatten(
        F.transform(
            F.sort_array(columns),
            lambda c: F.when(
                _described(c["col_description"]), F.array(c["col_name"], c["col_description"])
            ).otherwise(F.array(c["col_name"])),
        )
    )
    return F.lower(F.concat_ws(" ", F.concat(F.array(table_name), words)))


def table_text(table_name: Column, columns: Column) -> Column:
    """Encoder input for a table."""
    shown = F.transform(
        F.sort_array(columns),
        lambda c: F.concat(
            c["col_name"],
            F.lit(" ("),
            c["col_type"],
            F.lit(")"),
            F.when(
                _described(c["col_description"]), F.concat(F.lit(" - "), c["col_description"])
            ).otherwise(F.lit("")),
        ),
    )
    return F.concat(F.lit("Table: "), table_name, F.lit(". Columns: "), F.concat_ws(", ", shown))


def column_text(table_name: Column, name: Column, kind: Column, description: Column) -> Column:
    """Encoder input for a column."""
    return F.concat(
        F.lit("Column "),
        name,
        F.lit(" of type "),
        kind,
        F.when(_described(description), F.concat(F.lit(". Description: "), description)).otherwise(
            F.lit("")
        ),
        F.lit(". In table "),
        table_name,
        F.lit("."),
    )
