"""Deterministic identifiers and fingerprints as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lakeweave.params import ID_NAMESPACE


def stable_id(*parts: Column, namespace: str = ID_NAMESPACE) -> Column:
    """UUIDv5 of the parts joined by ``:`` (RFC 9562, section 5.5)."""
    seed = F.concat_ws(":", *[p.cast("string") for p in parts])
    prefix = F.unhex(F.lit(namespace.replace("-", "")))
    return uuid_of_digest(F.sha1(F.concat(prefix, F.encode(seed, "UTF-8"))))


def uuid_of_digest(digest: Column) -> Column:
    """Version 5 and variant 1 set over the first 32 hex digits: the thirteenth
    digit becomes 5, and the seventeenth keeps its two low bits."""
    shaped = F.regexp_replace(
        digest, "^(.{8})(.{4}).(.{3})(.)(.{3})(.{12}).*$", "$1-$2-5$3-<$4>$5-$6"
    )
    for low in range(4):
        shaped = F.regexp_replace(
            shaped, "<[" + "".join(f"{d:x}" for d in range(low, 16, 4)) + "]>", "89ab"[low]
        )
    return shaped


def table_id(tenant: Column, name: Column, content_hash: Column) -> Column:
    return stable_id(tenant, name, content_hash)


def column_id(table: Column, ordinal: Column, name: Column) -> Column:
    return stable_id(table, ordinal, name)


def short_hash(value: Column) -> Column:
    """First 16 hex digits of SHA-256."""
    return F.substring(F.sha2(value, 256), 1, 16)


def schema_hash(columns: Column, with_ordinal: bool = True) -> Column:
    """Fingerprint of an array of ``struct(ordinal, col_name, col_type)``.

    ``with_ordinal=False`` gives the form used by prepared benchmark tables.
    """
    def part(c: Column) -> Column:
        named = [c["col_name"], c["col_type"]]
        if with_ordinal:
            named.insert(0, c["ordinal"].cast("string"))
        return F.concat_ws(":", *named)

    ordered = F.sort_array(columns)
    return short_hash(F.concat_ws("|", F.transform(ordered, part)))


def row_digest(columns: list[Column]) -> Column:
    """60 bits of a row as a decimal, so that a sum over rows cannot overflow.

    Every value is preceded by its length, and null differs from the empty
    string, so no two different rows share one text.
    """
    def tagged(c: Column) -> Column:
        text = c.cast("string")
        return F.when(c.isNull(), F.lit("-")).otherwise(
            F.concat(F.length(text).cast("string"), F.lit(":"), text)
        )

    digest = F.md5(F.concat(*[tagged(c) for c in columns]))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("decimal(38,0)")
