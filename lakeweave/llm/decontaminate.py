"""Benchmark decontamination by size-partitioned MinHash containment search.

An item of ``q`` different shingles counts as contained in a text that holds at least ``need`` of them,
``need`` being 80 percent rounded up. Whichever they are, one of the item's ``q - need + 1`` smallest
MinHash values is among them. So items are partitioned by size, half a power of two of shingles to a partition. A
partition's sketches have the length its sizes call for, and a text looks its hashes up only in the partitions of which it
can hold the smallest item: ``reach`` is the last of them. No contained item is missed, however long the text. The pairs
found are verified by counting the shingles themselves.

The usual banding loses short items inside long texts, as their Jaccard similarity is near zero; sketches
whose length follows the size do not. An item of one to four words is one shingle of that many words. Texts are
shingled at five words and at the lengths of the short items that there are, so these are found inside long texts too.

Defined results: null and empty texts hold nothing and are contained in nothing; repeated rows of either table count
once (a pair of ids with equal texts is one row); null ids are kept as null; empty tables give an empty
result; further columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeweave.llm import spans as S
from lakeweave.llm.common import SHINGLE, exploded, identified, runs_of, shingle_texts, text_of, within, words
from lakeweave.session import materialize

PERCENT = 80


def _words(df: DataFrame, *keep: str) -> DataFrame:
    return df.select(*keep, words(F.lower("text")).alias("w"))


def item_shingles(items: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``item_id, ik, width, sh, h, n_item, need, place`` per different shingle; ``place`` orders by hash."""
    texts = items.select(F.col("item_id").cast("long").alias("item_id"), text_of(items).alias("text")).select(
        "item_id", "text", F.xxhash64(F.coalesce(F.col("item_id").cast("string"), F.lit("null")), "text").alias("ik")
    )
    sets = _words(texts.dropDuplicates(["ik"]), "item_id", "ik").select(
        "item_id", "ik", F.least(F.size("w"), F.lit(SHINGLE)).alias("width"), F.array_distinct(shingle_texts("w")).alias("sh")
    )
    hashed = sets.select(
        "item_id",
        "ik",
        "width",
        F.array_sort(F.transform("sh", lambda s: F.struct(F.xxhash64(F.split(s, " ")).alias("h"), s.alias("sh")))).alias("x"),
    ).select("*", F.size("x").cast("long").alias("n_item"))
    return hashed.select(
        "item_id", "ik", "width", "n_item", F.expr(f"(n_item * {percent} + 99) DIV 100").alias("need"), F.posexplode("x").alias("place", "x")
    ).select("item_id", "ik", "width", "n_item", "need", "place", "x.h", "x.sh")


def part_of(size: Column) -> Column:
    """The partition of a number of shingles."""
    return F.floor(2 * F.log2(size))


def sketches(shingled: DataFrame) -> DataFrame:
    """``part, ik, need, h``: the sketch of each item, in the partition of its size."""
    return shingled.where("place <= n_item - need").select(part_of(F.col("n_item")).alias("part"), "ik", "need", "h")


def partitions(index: DataFrame) -> DataFrame:
    """``part, least``: the partitions there are and the fewest shingles that one of their items asks for."""
    return index.groupBy("part").agg(F.min("need").alias("least"))


def _reach(n: Column, floors: list) -> Column:
    """The last partition that a text of ``n`` shingles can hold an item of; -1 if there is none."""
    out = F.lit(-1).cast("long")
    for r in floors:
        out = F.when(n >= r["least"], F.lit(r["part"])).otherwise(out)
    return out


def search(documents: DataFrame, items: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``doc_id, item_id, shared, n_item`` for every item contained in a document, and the row key ``rk``."""
    texts = identified(documents)
    shingled = materialize(item_shingles(items, percent), "items")
    # Five values at most.
    widths = sorted({SHINGLE, *(r["width"] for r in shingled.select("width").distinct().collect())})
    index = within(sketches(shingled))
    # Two per power of two: some sixty rows at most.
    floors = partitions(index).orderBy("part").collect()
    sets = _words(texts, "rk").select("rk", runs_of("w", widths).alias("hs"))
    # The size is taken first: beside explode() it would carry the whole array along with every element.
    probes = exploded(sets.select("rk", "hs", F.size("hs").alias("n")), ["rk", "n"], "hs", "h")
    # A filter of the texts by their reach would be moved below the shingling and split every text once per shingle.
    fits = (F.col("part") <= _reach(F.col("n"), floors)) & (F.col("n") >= F.col("need"))
    found = probes.join(index, "h").where(fits).groupBy("rk", "ik").agg(F.first("need").alias("need"))
    pairs = within(found)
    # Verification: the shingles themselves, of the texts in question and the items they are in question for.
    likely = texts.join(pairs.select("rk"), "rk", "left_semi")
    lists = _words(likely.dropDuplicates(["rk"]), "doc_id", "rk").select(
        "doc_id", "rk", runs_of("w", widths, texts=True).alias("list")
    )
    held = exploded(lists, ["doc_id", "rk"], "list", "sh")
    shared = (
        held.join(within(shingled.select("item_id", "ik", "n_item", "need", "sh")), "sh")
        .join(pairs.select("rk", "ik"), ["rk", "ik"])
        .groupBy("rk", "ik")
        .agg(
            F.first("doc_id").alias("doc_id"),
            F.first("item_id").alias("item_id"),
            F.count("*").alias("shared"),
            F.first("n_item").alias("n_item"),
            F.first("need").alias("need"),
        )
    )
    return shared.where("shared >= need").select("doc_id", "item_id", "shared", "n_item", "rk")


def clean(documents: DataFrame, items: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The documents that contain no item, as they are."""
    flagged = within(search(documents, items, percent).select("rk").distinct())
    rows = identified(documents, rest=True).select("rk", "text", "row", F.lit(0).alias("hits"))
    return S.rebuilt(rows.join(flagged, "rk", "left_anti"), documents)
