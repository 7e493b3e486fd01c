"""URL filters on a sorted digest array.

Rules are kept as one sorted array of 64-bit xxhash keys with their full strings behind it. A task maps the array
from a file of its own, looks up all candidate prefixes of a batch of addresses by one vectorised binary
search, and confirms every hit against the stored string, so a collision of keys decides nothing.

A rule is a host and a path. It fits its host and all subdomains if the address's path starts with its path;
the longest rule wins (of equally long ones the one with the longer host, then the smaller text). An array holds at
most ``MAX_BYTES``; more rules are split into several arrays, probed one after another, of which the best hit wins.

Defined results: an address that is null or has no ``://`` has an empty host and path, fits no rule and is blocked,
as nothing can be fetched from it; any other address that fits no rule is allowed; repeated rows are judged
alike; of repeated rules the blocking one counts; empty tables give an empty result or no rules; further
columns are not read.
"""

from __future__ import annotations

import mmap
import os
import tempfile
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeweave.llm.common import LOWER, UPPER, bounded_batches

MAX_BYTES = 64 * 1024 * 1024
_ADDRESS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
# Seed of Spark's xxhash64 function, so that keys made by either side are the same.
SEED = 42


def host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _ADDRESS, 1), F.lit("")), UPPER, LOWER)


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _ADDRESS, 2), F.lit(""))


class DigestArray:
    """Sorted keys, verdicts and strings of some rules, as one block of bytes that can be mapped."""

    def __init__(self, block):
        n = int(np.frombuffer(block, np.int64, 1)[0])
        self.keys = np.frombuffer(block, np.uint64, n, 8)
        self.starts = np.frombuffer(block, np.int64, n + 1, 8 + 8 * n)
        self.blocks = np.frombuffer(block, np.uint8, n, 16 + 16 * n)
        self.cuts = np.frombuffer(block, np.int32, n, 16 + 17 * n + (-n) % 4)
        self.text = memoryview(block)[16 + 21 * n + (-n) % 4 :]

    @staticmethod
    def pack(rules: list[tuple[str, str, bool]]) -> bytes:
        """``rules``: host, path, whether it blocks."""
        coded = sorted((xxhash.xxh64_intdigest((h + p).encode(), SEED), (h + p).encode(), len(h.encode()), b) for h, p, b in rules)
        n = len(coded)
        starts = np.concatenate([[0], np.cumsum([len(s) for _, s, _, _ in coded])]).astype(np.int64)
        return b"".join(
            [
                np.int64(n).tobytes(),
                np.array([k for k, _, _, _ in coded], np.uint64).tobytes(),
                starts.tobytes(),
                np.array([b for _, _, _, b in coded], np.uint8).tobytes(),
                bytes((-n) % 4),
                np.array([c for _, _, c, _ in coded], np.int32).tobytes(),
                *[s for _, s, _, _ in coded],
            ]
        )

    def lengths(self) -> list[int]:
        """The different lengths of the rules' paths, in bytes."""
        return np.unique(np.diff(self.starts) - self.cuts).tolist()

    def find(self, hosts: list[bytes], paths: list[bytes]) -> list[tuple[bytes, int, bool] | None]:
        """The winning rule of each address: its text, length of its host, whether it blocks."""
        lengths = self.lengths()
        owner, texts, cuts = [], [], []
        for i, (h, p) in enumerate(zip(hosts, paths)):
            tails, at = [h] if h else [], h.find(b".")
            while at >= 0:
                tails.append(h[at + 1 :])
                at = h.find(b".", at + 1)
            for n in lengths:
                if n <= len(p):
                    for t in tails:
                        owner.append(i)
                        texts.append(t + p[:n])
                        cuts.append(len(t))
        out: list[tuple[bytes, int, bool] | None] = [None] * len(hosts)
        keys = np.fromiter((xxhash.xxh64_intdigest(t, SEED) for t in texts), np.uint64, len(texts))
        first = np.searchsorted(self.keys, keys, side="left")
        last = np.searchsorted(self.keys, keys, side="right")
        for j in np.flatnonzero(last > first):
            for r in range(first[j], last[j]):  # more than one only where keys collide or a text has several cuts
                stored = bytes(self.text[self.starts[r] : self.starts[r + 1]])
                if stored == texts[j] and self.cuts[r] == cuts[j]:
                    out[owner[j]] = better(out[owner[j]], (stored, int(self.cuts[r]), bool(self.blocks[r])))
        return out


def better(a, b):
    """Of two hits the longer one, then that with the longer host, then the smaller text."""
    if a is None or b is None:
        return a or b
    return min(a, b, key=lambda x: (-len(x[0]), -x[1], x[0], not x[2]))


@lru_cache(maxsize=4)
def _mapped(name: str) -> DigestArray:
    with open(name, "rb") as f:
        return DigestArray(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))


_FILES: dict[str, str] = {}


def _array(shared, digest: str) -> DigestArray:
    """The broadcast array, from a file that this worker writes once and maps."""
    if digest not in _FILES or not os.path.exists(_FILES[digest]):
        handle, name = tempfile.mkstemp(suffix=".digests")
        with os.fdopen(handle, "wb") as f:
            f.write(shared.value)
        _FILES[digest] = name
    return _mapped(_FILES[digest])


def arrays(rules: DataFrame, max_bytes: int = MAX_BYTES) -> Iterator[bytes]:
    """Digest arrays of the rules (``host, path, verdict``), each within the bound.

    Spark sorts the rules by key; the driver holds one array at a time.
    """
    ordered = rules.select(
        F.translate(F.coalesce("host", F.lit("")), UPPER, LOWER).alias("host"),
        F.coalesce("path", F.lit("")).alias("path"),
        (F.col("verdict") == "block").alias("blocks"),
    ).groupBy("host", "path").agg(F.max("blocks").alias("blocks"))
    part, held = [], 0
    for r in ordered.orderBy(F.xxhash64(F.concat("host", "path"))).toLocalIterator():
        size = len((r["host"] + r["path"]).encode()) + 21
        if part and held + size > max_bytes:
            yield DigestArray.pack(part)
            part, held = [], 0
        part.append((r["host"], r["path"], bool(r["blocks"])))
        held += size
    yield DigestArray.pack(part)


def judge(pages: DataFrame, rules: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """``page_id, host, path, rule, verdict`` per page."""
    spark = pages.sparkSession
    url = pages["url"].cast("string")
    out = bounded_batches(pages).select(
        pages["page_id"].cast("long").alias("page_id"), host(url).alias("host"), path(url).alias("path"),
        F.lit(None).cast("string").alias("rule"), F.lit(0).alias("cut"), F.lit(False).alias("blocks"),
    )
    for block in arrays(rules, max_bytes):
        out = _probed(out, spark.sparkContext.broadcast(block), xxhash.xxh128_hexdigest(block))
    verdict = F.when(F.col("rule").isNull(), F.when(F.col("host") == "", "block").otherwise("allow")).otherwise(
        F.when(F.col("blocks"), "block").otherwise("allow")
    )
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"))


def _probed(pages: DataFrame, shared, digest: str) -> DataFrame:
    """One pass over the pages with one array. Ids pass through as text, as nulls would make them floats."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = _array(shared, digest)
        for batch in batches:
            hits = index.find([h.encode() for h in batch["host"]], [p.encode() for p in batch["path"]])
            old = [
                None if r is None else (r.encode(), c, b) for r, c, b in zip(batch["rule"], batch["cut"], batch["blocks"])
            ]
            best = [better(a, b) for a, b in zip(old, hits)]
            yield batch.assign(
                rule=[None if x is None else x[0].decode() for x in best],
                cut=[0 if x is None else x[1] for x in best],
                blocks=[x is not None and x[2] for x in best],
            )

    schema = "page_id string, host string, path string, rule string, cut int, blocks boolean"
    found = pages.withColumn("page_id", F.col("page_id").cast("string")).mapInPandas(run, schema)
    return found.withColumn("page_id", F.col("page_id").cast("long"))
