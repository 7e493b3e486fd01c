"""Near-duplicate join by universe partitioning.

Documents with equal shingle sets form a class; one set per class goes on. By size band the universe of
hashes is cut into so many segments that similar sets must share one (or, in the bands of small sets,
share one up to a deletion), and every set is indexed by the contents of its segments. A
segment costs what its content is common: contents that more than ``POPULAR`` sets share are left out wherever
the set has other segments to spare, so passages that many documents share join nothing. What remains:

* pairs from rare contents, filtered by parity bitmaps and verified set against set;
* sets that consist of popular contents (groups of near copies): they are connected by these
  contents, and each connected group is compared block against block, by size, in tasks of
  bounded size that return a spanning forest of the verified links, not all pairs.

Both steps lose no link, so the components are exact. Sets are compared as 64-bit hashes of shingles.

Defined results: null and empty texts have no shingles and no links, and are components of their own; fewer
than five words are one shingle; repeated rows form a class and share a component; a null id takes part like
any other, but a component is named after the smallest id that is not null; an empty table gives an empty
result; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeweave.llm import shingle_sets as S
from lakeweave.llm import spans
from lakeweave.llm.common import bounded_batches, identified, within
from lakeweave.llm.graph import components
from lakeweave.session import materialize

# Sets that may share a content before it counts as popular. Costs only; the result doesn't depend on it.
POPULAR = 8
# Sets per block of a connected group; a task holds two blocks.
BLOCK = 512
TEXTS = 128
MEMORY_CLASSES = 100_000


def classes_of(texts: DataFrame) -> DataFrame:
    """``rk, doc_id, k, n, bits`` per row: the key, size and parity bitmap of its set."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), TEXTS):
                part = batch.iloc[at : at + TEXTS]
                sets = S.sets_of(part["text"].tolist())
                yield pd.DataFrame(
                    {
                        "rk": part["rk"].to_numpy(),
                        "doc_id": part["doc_id"].to_numpy(),
                        "k": [S.key_of(s) for s in sets],
                        "n": [len(s) for s in sets],
                        "bits": [S.parity(s) if len(s) else b"" for s in sets],
                    }
                )

    strings = texts.select("rk", F.col("doc_id").cast("string").alias("doc_id"), "text")
    return strings.mapInPandas(run, "rk long, doc_id string, k long, n long, bits binary").withColumn(
        "doc_id", F.col("doc_id").cast("long")
    )


def signature_rows(texts: DataFrame) -> DataFrame:
    """``sig, k, slack``: the index, from one text of each class that a task sees."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[int] = set()
        for batch in batches:
            for at in range(0, len(batch), TEXTS):
                keys, slacks, sigs = [], [], []
                for s in S.sets_of(batch["text"].iloc[at : at + TEXTS].tolist()):
                    if not len(s) or (k := S.key_of(s)) in seen:
                        continue
                    if len(seen) >= MEMORY_CLASSES:
                        seen.clear()
                    seen.add(k)
                    sig, slack = S.signatures(s)
                    keys.append(k)
                    slacks.append(slack)
                    sigs.append(sig)
                if sigs:
                    times = [len(x) for x in sigs]
                    yield pd.DataFrame(
                        {
                            "sig": np.concatenate(sigs).view(np.int64),
                            "k": np.repeat(np.array(keys, np.int64), times),
                            "slack": np.repeat(np.array(slacks, np.int32), times),
                        }
                    )

    return texts.select("text").mapInPandas(run, "sig long, k long, slack int")


_SHARED = "sig long, a long, b long, slack int, rare boolean"


def _group_rows(sig, k, slack) -> tuple[pd.DataFrame, int]:
    """Pairs of rare contents and members of popular ones, from rows sorted by ``sig, k``; size of the last group."""
    starts = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]])) if len(sig) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(starts, len(sig)))
    size = np.repeat(sizes, sizes)
    parts = [(sig[size > POPULAR], k[size > POPULAR], k[size > POPULAR], slack[size > POPULAR], False)]
    rare = (size > 1) & (size <= POPULAR)
    s, m = sig[rare], k[rare]
    for d in range(1, POPULAR):
        same = np.flatnonzero(s[d:] == s[:-d]) if len(s) > d else np.zeros(0, np.int64)
        parts.append((s[same], m[same], m[same + d], np.zeros(len(same), np.int32), True))
    out = pd.concat(
        [pd.DataFrame({"sig": a, "a": b, "b": c, "slack": d, "rare": e}) for a, b, c, d, e in parts if len(a)]
        or [pd.DataFrame({"sig": sig[:0], "a": k[:0], "b": k[:0], "slack": slack[:0], "rare": np.zeros(0, bool)})]
    )
    return out, int(sizes[-1]) if len(sizes) else 0


def shared_contents(index: DataFrame) -> DataFrame:
    """One pass over the index in the order of its contents; holds back no more than ``POPULAR`` rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, popular = None, None
        for batch in batches:
            if held is not None:
                batch = pd.concat([held, batch], ignore_index=True)
            sig, k, slack = (batch[c].to_numpy() for c in ("sig", "k", "slack"))
            fresh = np.concatenate([[True], (sig[1:] != sig[:-1]) | (k[1:] != k[:-1])]) if len(sig) else np.zeros(0, bool)
            sig, k, slack = sig[fresh], k[fresh], slack[fresh]
            if popular is not None and len(sig):  # goes on from the batch before
                on = int(np.searchsorted(sig, popular, side="right"))
                if on:
                    yield pd.DataFrame({"sig": sig[:on], "a": k[:on], "b": k[:on], "slack": slack[:on], "rare": False})
                    sig, k, slack = sig[on:], k[on:], slack[on:]
                if len(sig):
                    popular = None
            held = None
            if not len(sig):
                continue
            last = int(np.searchsorted(sig, sig[-1], side="left"))
            if len(sig) - last <= POPULAR:
                held = pd.DataFrame({"sig": sig[last:], "k": k[last:], "slack": slack[last:]})
                sig, k, slack = sig[:last], k[:last], slack[:last]
            else:
                popular = sig[-1]
            yield _group_rows(sig, k, slack)[0]
        if held is not None:
            yield _group_rows(*(held[c].to_numpy() for c in ("sig", "k", "slack")))[0]

    return index.repartition("sig").sortWithinPartitions("sig", "k").mapInPandas(run, _SHARED)


def _sets(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """``k, hashes`` for the rows whose ``rk`` is wanted."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), TEXTS):
                sets = S.sets_of(batch["text"].iloc[at : at + TEXTS].tolist())
                yield pd.DataFrame({"k": [S.key_of(s) for s in sets], "hashes": [s.tobytes() for s in sets]})

    found = texts.join(within(wanted), "rk", "left_semi").select("text")
    return found.mapInPandas(run, "k long, hashes binary").groupBy("k").agg(F.first("hashes").alias("hashes"))


def _forest(pairs, count: int) -> list[tuple[int, int]]:
    """The links that connect what was not connected yet."""
    parent = list(range(count))

    def top(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for a, b in pairs:
        x, y = top(a), top(b)
        if x != y:
            parent[x] = y
            out.append((a, b))
    return out


def _block_links(sets: list[np.ndarray], left: np.ndarray) -> list[tuple[int, int]]:
    """Links between the sets marked ``left`` and the others, or among all if none is unmarked."""
    n = np.array([len(s) for s in sets])
    tokens, place, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), n)
    common = np.flatnonzero(times > 1)
    column = np.full(len(tokens), -1)
    column[common] = np.arange(len(common))
    at = column[place]
    owner, at = owner[at >= 0], at[at >= 0]
    order = np.argsort(at, kind="stable")
    owner, at = owner[order], at[order]
    a = np.flatnonzero(left)
    b = np.flatnonzero(~left) if (~left).any() else a
    shared = np.zeros((len(a), len(b)), np.float64)
    width = 4096
    for lo in range(0, len(common), width):
        i, j = np.searchsorted(at, [lo, lo + width])
        has = np.zeros((len(sets), width), np.float32)
        has[owner[i:j], at[i:j] - lo] = 1
        shared += has[a] @ has[b].T
    linked = S.DENOMINATOR * shared >= S.NUMERATOR * (n[a][:, None] + n[b][None, :] - shared)
    x, y = np.nonzero(linked)
    x, y = a[x], b[y]
    return _forest(zip(x[x != y].tolist(), y[x != y].tolist()), len(sets))


def group_links(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Verified links ``a, b`` within connected groups. ``members``: ``k, n, component``."""
    # Similar sets lie in the same size class or in neighbouring ones.
    sized = members.withColumn("q", F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(1.25))).cast("int"))
    blocks = sized.groupBy("component", "q").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("blocks"))
    own = materialize(
        sized.join(blocks, ["component", "q"]).withColumn("block", F.pmod(F.xxhash64("k"), F.col("blocks")).cast("int")),
        "blocks",
    )
    beside = blocks.select("component", (F.col("q") - 1).alias("q"), F.col("blocks").alias("next"))
    before = blocks.select("component", (F.col("q") + 1).alias("q"), F.col("blocks").alias("prior"))
    cells = own.join(beside, ["component", "q"], "left").join(before, ["component", "q"], "left").select(
        "k", "component", "q", "block",
        F.expr(
            """flatten(array(
            transform(sequence(0, blocks - 1), j -> struct(q AS q1, least(block, j) AS b1, q AS q2, greatest(block, j) AS b2)),
            CASE WHEN next > 0 THEN transform(sequence(0, next - 1), j -> struct(q AS q1, block AS b1, q + 1 AS q2, j AS b2)) ELSE array() END,
            CASE WHEN prior > 0 THEN transform(sequence(0, prior - 1), j -> struct(q - 1 AS q1, j AS b1, q AS q2, block AS b2)) ELSE array() END
            ))"""
        ).alias("cells"),
    )
    spread = cells.select("k", "component", "q", "block", F.explode_outer("cells").alias("c")).select(
        "k", "component", "c.*", ((F.col("q") == F.col("c.q1")) & (F.col("block") == F.col("c.b1"))).alias("first")
    )

    def links(cell: pd.DataFrame) -> pd.DataFrame:
        found = _block_links([np.frombuffer(h, np.uint64) for h in cell["hashes"]], cell["first"].to_numpy(bool))
        k = cell["k"].to_numpy()
        return pd.DataFrame({"a": [k[i] for i, _ in found], "b": [k[j] for _, j in found]}, dtype="int64")

    return (
        spread.join(sets, "k").groupBy("component", "q1", "b1", "q2", "b2").applyInPandas(links, "a long, b long")
    )


@F.pandas_udf(T.BooleanType())
def _may(a: pd.Series, n: pd.Series, b: pd.Series, m: pd.Series) -> pd.Series:
    return pd.Series([S.may_be_similar(*x) for x in zip(a, n, b, m)], dtype=bool)


@F.pandas_udf(T.BooleanType())
def _is(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([S.similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in zip(a, b)], dtype=bool)


def linked(documents: DataFrame) -> DataFrame:
    """``rk, doc_id, n_shingles, component, component_id`` per row of ``documents``.

    ``component`` is a key that is there without ids too, and null where there are no shingles.
    """
    texts = identified(bounded_batches(documents))
    rows = materialize(classes_of(texts), "classes")
    classes = materialize(
        rows.where("n > 0").groupBy("k").agg(F.first("n").alias("n"), F.first("bits").alias("bits"), F.min("rk").alias("rk")),
        "classes",
    )
    shared = materialize(shared_contents(signature_rows(texts)), "contents")
    # Pairs of rare contents.
    a, b = (classes.select(F.col("k").alias(x), F.col("n").alias(f"n{x}"), F.col("bits").alias(f"bits{x}")) for x in "ab")
    pairs = shared.where("rare").select("a", "b").distinct().join(a, "a").join(b, "b")
    pairs = materialize(pairs.where(_may("bitsa", "na", "bitsb", "nb")).select("a", "b"), "pairs")
    # Sets that cannot do without their popular contents.
    popular = shared.where("NOT rare").select("sig", F.col("a").alias("k"), "slack")
    bound = popular.groupBy("k").agg(F.count("*").alias("c"), F.max("slack").alias("slack")).where("c > slack").select("k")
    held = materialize(popular.join(within(bound), "k", "left_semi").select("sig", "k"), "popular")
    hubs = held.groupBy("sig").agg(F.min("k").alias("hub"))
    groups = components(held.join(hubs, "sig").select(F.col("k").alias("a"), F.col("hub").alias("b")))
    members = materialize(groups.withColumnRenamed("node", "k").join(classes.select("k", "n"), "k"), "members")
    # The sets in question, and their links.
    keys = members.select("k").unionByName(pairs.select(F.col("a").alias("k"))).unionByName(pairs.select(F.col("b").alias("k")))
    sets = materialize(_sets(texts, keys.distinct().join(classes.select("k", "rk"), "k").select("rk")), "sets")
    ha, hb = (sets.select(F.col("k").alias(x), F.col("hashes").alias(f"h{x}")) for x in "ab")
    rare_links = pairs.join(ha, "a").join(hb, "b").where(_is("ha", "hb")).select("a", "b")
    labels = components(rare_links.unionByName(group_links(members, sets)))
    # Components are named after their smallest document. Empty sets are not looked up: each is its own.
    named = rows.join(labels.withColumnRenamed("node", "k"), "k", "left").select(
        "rk", "doc_id", "n", F.when(F.col("n") > 0, F.coalesce("component", "k")).alias("component")
    )
    smallest = named.where("component IS NOT NULL").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return named.join(smallest, "component", "left").select(
        "rk", "doc_id", F.col("n").alias("n_shingles"), "component",
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
    )


def keep_one(documents: DataFrame) -> DataFrame:
    """One document of each component, that with the smallest id (and of repeated rows one); others as they are.

    Documents without words are no duplicates of anything and stay. Texts are moved only where a kept row is
    repeated.
    """
    found = linked(documents).where("component IS NOT NULL")
    copies = materialize(
        found.groupBy("component", "rk", "doc_id").agg(F.count("*").alias("rows")), "copies"
    )
    best = copies.groupBy("component").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "rk")).alias("best")
    )
    marked = materialize(
        copies.join(best, "component").select("rk", "rows", (F.col("rk") == F.col("best.rk")).alias("kept")), "marked"
    )
    apart = within(marked.where("NOT kept OR rows > 1").select("rk"))
    repeated = within(marked.where("kept AND rows > 1").select("rk"))
    rows = identified(documents, rest=True).select("rk", "text", "row", F.lit(0).alias("hits"))
    single = rows.join(apart, "rk", "left_anti")
    once = rows.join(repeated, "rk", "left_semi").dropDuplicates(["rk"])
    return spans.rebuilt(single.unionByName(once), documents)
