"""Places of regular expressions in texts, by SQL functions alone.

``split`` gives what lies between the matches and ``regexp_extract_all`` the matches, so
adding up their lengths gives each match's place in code points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CONTEXT = 32
TYPE = "array<struct<s: int, e: int, v: string, b: string, a: string>>"


def cut(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches ``v`` and what lies between them ``g``, for ``places``.

    The pattern must not match the empty string.
    """
    return F.struct(
        F.split(text, pattern, -1).alias("g"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("v")
    )


def places(column: str) -> Column:
    """Start, end (exclusive), value, text before and after each match of a column made by ``cut``.

    The text before a match reaches back to the match before it, ``CONTEXT`` code points at most;
    the text after it likewise. A null column has no matches.
    """
    start = F.struct(F.lit(0).alias("pos"), none().alias("out"))

    def step(acc, x):
        s = acc["pos"] + F.length(x["g"])
        e = s + F.length(x["v"])
        one = F.struct(
            s.alias("s"), e.alias("e"), x["v"].alias("v"),
            F.right(x["g"], F.lit(CONTEXT)).alias("b"), F.left(x["n"], F.lit(CONTEXT)).alias("a"),
        )
        return F.struct(e.alias("pos"), F.concat(acc["out"], F.array(one)).alias("out"))

    g, v = F.col(f"{column}.g"), F.col(f"{column}.v")
    parts = F.filter(
        F.arrays_zip(g.alias("g"), v.alias("v"), F.slice(g, 2, 2147483647).alias("n")), lambda x: x["v"].isNotNull()
    )
    return F.when(F.size(v) > 0, F.aggregate(parts, start, step, lambda acc: acc["out"])).otherwise(none())


def none() -> Column:
    return F.expr(f"cast(array() AS {TYPE})")


def labelled(spans: Column, order: int, kind: str) -> Column:
    """Spans with their kind and the kind's place in the list."""
    return F.transform(
        spans, lambda x: F.struct(x["s"].alias("s"), F.lit(order).alias("k"), x["e"].alias("e"), F.lit(kind).alias("kind"))
    )


def digest_text(spans: Column) -> Column:
    """kind:start:end, comma-joined, in the order of the array."""
    return F.array_join(
        F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ","
    )


def replaced(text: str, spans: str, mark: str) -> Column:
    """The text of column ``text`` with the sorted spans of column ``spans`` replaced by ``mark``."""
    return F.expr(
        f"""CASE WHEN size({spans}) = 0 THEN {text} ELSE aggregate({spans}, struct(0 AS pos, '' AS out),
        (acc, x) -> CASE WHEN x.s >= acc.pos
            THEN struct(x.e AS pos, concat(acc.out, substring({text}, acc.pos + 1, x.s - acc.pos), '{mark}') AS out)
            ELSE struct(greatest(acc.pos, x.e) AS pos, acc.out AS out) END,
        acc -> concat(acc.out, substring({text}, acc.pos + 1, length({text})))) END"""
    )


def rebuilt(out: DataFrame, documents: DataFrame) -> DataFrame:
    """The columns of ``documents`` from ``row, hits, text``; ``n_chars`` follows a text with hits."""
    changed, columns = F.col("hits") > 0, []
    for c in documents.columns:
        old = F.col("row")["rest"][c] if c != "text" else None
        if c == "text":
            columns.append(F.when(changed | F.col("row")["was_text"], F.col("text")).alias(c))
        elif c == "n_chars":
            new = F.length("text").cast(documents.schema[c].dataType)
            columns.append(F.when(changed, new).otherwise(old).alias(c))
        else:
            columns.append(old.alias(c))
    return out.select(*columns)
