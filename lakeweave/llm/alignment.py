"""Alignment of two tokenizers, with an identity map as the fast path.

A text is encoded by both; byte offsets at which a token of either ends cut it into groups, and the two tokens
that end a group are linked. Nearly all groups hold one token of each side with the same bytes: for these the
id of one side gives that of the other through an array made once from the two vocabularies, and their links
are counted in one vector of vocabulary length per task. Only the links of the other, irregular
groups are counted by a shuffle of id pairs, added up within each document and each task first.

The texts are encoded once: per document the counts of its identity ids and of its irregular pairs are written to
the shared folder, together with the finished columns. The second pass looks up the counts of the commonest
``HELD`` pairs in sorted arrays, which every task holds; the rest, each of them rare by construction, is joined by
a shuffle. So no key of that join is hot, and the arrays have a fixed bound.

Defined results: a null or empty text, and one that the tokens of either side don't give back byte by byte,
has no tokens: all numbers are 0 and the groups' text is empty. Repeated rows and null ids are aligned like any
other; an empty table gives an empty result; further columns are not read; a text of any length is encoded whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeweave.llm.common import bounded_batches, exploded
from lakeweave.llm.packing import _byte_letters, _encoder
from lakeweave.llm.vectors import summed
from lakeweave.session import materialize

# Pairs whose counts every task holds: 16 bytes each.
HELD = 500_000
CHUNK = 64

_ALIGNED = (
    "row long, doc_id string, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
    "same array<int>, same_n array<int>, pairs array<long>, pairs_n array<int>"
)


def vocabulary_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@dataclass(frozen=True)
class Vocabularies:
    """The bytes of every id of both sides, and for ids of A the id of B with the same bytes, or -1."""

    a: list[bytes]
    b: list[bytes]
    same: np.ndarray


def _bytes_a(path: str) -> list[bytes]:
    from tokenizers import Tokenizer

    letters = _byte_letters()
    words = Tokenizer.from_file(path).get_vocab()
    out = [b""] * (max(words.values()) + 1)
    for word, i in words.items():
        known = all(c in letters for c in word)
        out[i] = bytes(letters[c] for c in word) if known else word.encode()
    return out


def _bytes_b(path: str) -> list[bytes]:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    return [
        bytes([int(model.id_to_piece(i)[3:5], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace("▁", " ").encode()
        for i in range(n)
    ]


@lru_cache(maxsize=2)
def vocabularies(path_a: str, path_b: str) -> Vocabularies:
    a, b = _bytes_a(path_a), _bytes_b(path_b)
    # A letter that has a piece of its own is not written as a byte, so pieces that are no bytes come last and win.
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path_b)
    known = {b[i]: i for i in sorted(range(len(b)), key=lambda i: not model.is_byte(i))}
    return Vocabularies(a, b, np.array([known.get(x, -1) for x in a], np.int64))


@lru_cache(maxsize=2)
def _tools(path_a: str, path_b: str):
    """What a worker needs: both encoders, the vocabularies with lengths, and ids written with what may follow them."""
    import sentencepiece

    v = vocabularies(path_a, path_b)
    model = sentencepiece.SentencePieceProcessor(model_file=path_b)
    n = max(len(v.a), len(v.b))
    inner = np.array([f"{i}," for i in range(n)], object)
    last = {"a": np.array([f"{i}|" for i in range(n)], object), "b": np.array([f"{i};" for i in range(n)], object)}
    sizes = np.array([len(x) for x in v.a], np.int64), np.array([len(x) for x in v.b], np.int64)
    return _plain_encoder(path_a), model, v, sizes, inner, last


def _plain_encoder(path: str):
    """Encodes texts; names of special tokens in them are plain text."""
    from tokenizers import Tokenizer

    fast = _encoder(path)
    specials = [t.content for t in Tokenizer.from_file(path).get_added_tokens_decoder().values()]
    own = lru_cache(maxsize=1)(lambda: _literal(path))

    def encode(texts: list[str]) -> list[list[int]]:
        rare = {i for i, t in enumerate(texts) if any(s in t for s in specials)}
        out = fast(["" if i in rare else t for i, t in enumerate(texts)])
        for i in rare:
            out[i] = own().encode(texts[i], add_special_tokens=False).ids
        return out

    return encode


def _literal(path: str):
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.encode_special_tokens = True
    return found


def align(texts: list[str], path_a: str, path_b: str) -> list[tuple]:
    """Per text the columns of ``_ALIGNED`` from ``n_a`` on."""
    encode, model, v, (size_a, size_b), inner, last = _tools(path_a, path_b)
    spaced = [" " + t for t in texts]
    out = []
    for text, full, a, b in zip(texts, spaced, encode(spaced), model.encode(texts, num_threads=1)):
        raw = full.encode()
        whole = text and b"".join(map(v.a.__getitem__, a)) == raw and b"".join(map(v.b.__getitem__, b)) == raw
        out.append(_groups(np.array(a, np.int64), np.array(b, np.int64), size_a, size_b, v.same, inner, last) if whole else _NOTHING)
    return out


_NOTHING = (0, 0, 0, 0, "", [], [], [], [])


def _groups(a, b, size_a, size_b, same, inner, last) -> tuple:
    end_a, end_b = np.cumsum(size_a[a]), np.cumsum(size_b[b])
    # No token is empty, so ends are different and ascending on each side.
    _, at_a, at_b = np.intersect1d(end_a, end_b, assume_unique=True, return_indices=True)
    count_a, count_b = np.diff(at_a, prepend=-1), np.diff(at_b, prepend=-1)
    single = (count_a == 1) & (count_b == 1)
    last_a, last_b = a[at_a], b[at_b]
    # Two ids of B can have the same bytes; only the one of the array is counted by it.
    single &= same[last_a] == last_b
    ids, ids_n = np.unique(last_a[single], return_counts=True)
    pairs, pairs_n = np.unique(last_a[~single] * len(size_b) + last_b[~single], return_counts=True)
    n, groups = len(a) + len(b), len(at_a)
    # Tokens of A move back by the tokens of B in the groups before, those of B by the tokens of A up to their group.
    text_a, text_b = inner[a], inner[b]
    text_a[at_a], text_b[at_b] = last["a"][last_a], last["b"][last_b]
    line = np.empty(n, object)
    before_b = np.concatenate(([0], at_b[:-1] + 1))
    line[np.arange(len(a)) + np.repeat(before_b, count_a)] = text_a
    line[np.arange(len(b)) + np.repeat(at_a + 1, count_b)] = text_b
    digest = hashlib.sha256("".join(line.tolist())[:-1].encode()).hexdigest()
    return len(a), len(b), groups, groups, digest, ids, ids_n, pairs, pairs_n


def aligned(documents: DataFrame, paths: tuple[str, str] | None = None) -> DataFrame:
    """Per document its numbers, identity ids and irregular pairs with their counts, written to the shared folder."""
    path_a, path_b = paths or vocabulary_paths()
    names = [x.split()[0] for x in _ALIGNED.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        row = TaskContext.get().partitionId() << 36
        for batch in batches:
            for at in range(0, len(batch), CHUNK):
                part = batch.iloc[at : at + CHUNK]
                found = align([t or "" for t in part["text"]], path_a, path_b)
                yield pd.DataFrame(
                    [(row + i, d, *x) for i, (d, x) in enumerate(zip(part["doc_id"], found))], columns=names
                )
                row += len(part)

    texts = documents.select(documents["doc_id"].cast("string").alias("doc_id"), documents["text"].cast("string").alias("text"))
    # ``row`` numbers the rows of this one run of the tasks: what is written is what all later steps read.
    return materialize(bounded_batches(texts).mapInPandas(run, _ALIGNED), "aligned")


def identity_counts(rows: DataFrame, size: int) -> np.ndarray:
    """How many one-to-one links of the same bytes each id of A has, from one vector per task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[np.ndarray]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            if len(batch):
                ids, n = np.concatenate(batch["same"].tolist()), np.concatenate(batch["same_n"].tolist())
                total += np.bincount(ids.astype(np.int64), weights=n, minlength=size).astype(np.int64)
        yield total

    return summed(rows.select("same", "same_n"), run, size)


def pair_counts(rows: DataFrame) -> DataFrame:
    """``pair, n`` of the irregular links."""
    each = exploded(rows.select(F.arrays_zip("pairs", "pairs_n").alias("of")), [], "of", "x")
    return each.groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.pairs_n").alias("n"))


def aligned_counts(documents: DataFrame, paths: tuple[str, str] | None = None, held: int = HELD) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` per document."""
    spark = documents.sparkSession
    path_a, path_b = paths or vocabulary_paths()
    v = vocabularies(path_a, path_b)
    width = len(v.b)
    rows = aligned(documents, (path_a, path_b))
    identity = identity_counts(rows, len(v.a))
    pairs = materialize(pair_counts(rows), "pairs")

    # The highest count of each id of B: one row per id of the vocabulary at most.
    top = np.zeros(width, np.int64)
    used = np.flatnonzero((v.same >= 0) & (identity > 0))
    np.maximum.at(top, v.same[used], identity[used])
    highest = pairs.groupBy((F.col("pair") % width).cast("int").alias("b")).agg(F.max("n").alias("n")).toPandas()
    np.maximum.at(top, highest["b"].to_numpy(np.int64), highest["n"].to_numpy(np.int64))
    identity_best = np.where(v.same >= 0, identity == top[v.same], False)

    commonest = pairs.orderBy(F.desc("n"), "pair").limit(held).toPandas().sort_values("pair")
    keys, counts = commonest["pair"].to_numpy(np.int64), commonest["n"].to_numpy(np.int64)
    best = counts == top[keys % width]

    def look_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row, same, same_n, pair, n in zip(batch["row"], batch["same"], batch["same_n"], batch["pairs"], batch["pairs_n"]):
                same_n, n = np.asarray(same_n, np.int64), np.asarray(n, np.int64)
                total, hits = int(identity[same] @ same_n), int(same_n[identity_best[same]].sum())
                if len(pair) and len(keys):
                    at = np.minimum(np.searchsorted(keys, pair), len(keys) - 1)
                    known = keys[at] == pair
                    total += int(counts[at[known]] @ n[known])
                    hits += int(n[known][best[at[known]]].sum())
                    pair, n = pair[~known], n[~known]
                out.append((row, total, hits, pair, n))
            yield pd.DataFrame(out, columns=["row", "count_sum", "n_best", "rest", "rest_n"])

    found = rows.select("row", "same", "same_n", "pairs", "pairs_n").mapInPandas(
        look_up, "row long, count_sum long, n_best long, rest array<long>, rest_n array<int>"
    )
    found = materialize(found, "counted")
    rare = exploded(found.select("row", F.arrays_zip("rest", "rest_n").alias("of")), ["row"], "of", "x")
    tops = spark.createDataFrame(pd.DataFrame({"b": np.arange(width), "top": top}))  # one row per id of the vocabulary
    joined = (
        rare.select("row", F.col("x.rest").alias("pair"), F.col("x.rest_n").alias("links"))
        .join(pairs, "pair")
        .join(F.broadcast(tops), F.col("pair") % width == F.col("b"))
    )
    added = joined.groupBy("row").agg(
        F.sum(F.col("n") * F.col("links")).alias("more"),
        F.sum(F.when(F.col("n") == F.col("top"), F.col("links")).otherwise(0)).alias("more_best"),
    )
    kept = rows.select("row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    whole = kept.join(found.select("row", "count_sum", "n_best"), "row").join(added, "row", "left")
    return whole.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        *["n_a", "n_b", "n_groups", "n_links"],
        (F.col("n_best") + F.coalesce("more_best", F.lit(0))).alias("n_best"),
        (F.col("count_sum") + F.coalesce("more", F.lit(0))).alias("count_sum"),
        "groups_sha256",
    )
