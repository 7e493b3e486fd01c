"""Quality rules with tokeniser fertility.

Words are encoded on their own with a public vocabulary that falls back to bytes. Characters per token,
the share of byte tokens and the entropy of a text's tokens are held against bands of its
language, or of its main script where it has none. Texts with too few words or too many
repeated ones fail before that.

The bands are fitted to all texts that didn't fail. Both metrics of a text change with its length, so a language has a band
per size class (half a power of two of characters): the median, and ``WIDTH`` robust deviations to both sides. The
deviation is 1.4826 times the median distance from the median, at least what chance alone gives to a text of that many
tokens, so a class full of near copies doesn't close its band around them; a class of ``n`` texts widens its band by
``1 + 4 / sqrt(n)``. Texts that are low in characters per token and in entropy at once are held against a band of
their mean deviation too. Medians come from counts of rounded metrics, so they are exact for these, don't depend on
partitions and take as many rows as there are bins. Texts with equal metrics count once per class. The bands hold as long as
more than half of the different texts of a class are prose.

Texts inside the bands with more than ``MAX_SYMBOLS_PER_WORD`` symbols a word go as well; ``rejected_by`` tells which rule
decided.

Every text is measured whole. A worker remembers how it encoded a word, up to ``MEMORY_WORDS``
words, then starts over; results don't depend on it.

Defined results: null and empty texts have zero words and fail; texts without a token have no fertility;
a null language takes the script's band; repeated rows are judged alike; an empty table gives
an empty result; further columns are passed on as they are.
"""

from __future__ import annotations

from collections import Counter
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeweave.llm.common import bounded_batches, within
from lakeweave.session import materialize

MIN_WORDS = 10
MAX_REPEATED_PERCENT = 20
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
WINDOW = 5
MEMORY_WORDS = 100_000
CHUNK_WORDS = 100_000

# How many robust deviations a band reaches to either side.
WIDTH = 5.0
# Metrics with bands: the width of a bin, and the least deviation of a text of one token (it falls with the root of the tokens).
BANDED = {"chars_per_token": (0.01, 0.6), "token_entropy": (0.02, 1.0), "byte_share": (0.005, 0.5)}
# A document's symbols per word beyond which it is no prose, whatever its band.
MAX_SYMBOLS_PER_WORD = 0.30

METRICS = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "n_tokens long, chars_per_token double, byte_share double, token_entropy double, script string"
)


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class _Numbered(dict):
    """Gives each new key the next number."""

    def __missing__(self, key):
        self[key] = number = len(self)
        return number


class WordMemory:
    """Words seen by this worker: an id each, and for each id its tokens."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = self.model.get_piece_size()
        self.is_byte = np.array([self.model.is_byte(i) for i in range(size)])
        self.size = size
        self.clear()

    def clear(self) -> None:
        self.ids = _Numbered()
        self.starts = np.zeros(1, np.int64)
        self.tokens = np.zeros(0, np.int32)

    def look_up(self, words: list[bytes]) -> np.ndarray:
        ids = self.ids
        known = len(ids)
        out = np.fromiter(map(ids.__getitem__, words), np.int64, len(words))
        if len(ids) > known:
            fresh = [w.decode() for w in list(ids)[known:]]
            coded = self.model.encode(fresh, num_threads=1)
            lengths = np.fromiter(map(len, coded), np.int64, len(coded))
            flat = np.fromiter((t for c in coded for t in c), np.int32, int(lengths.sum()))
            self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(lengths)])
            self.tokens = np.concatenate([self.tokens, flat])
        return out


@lru_cache(maxsize=2)
def _memory(path: str) -> WordMemory:
    return WordMemory(path)


def repeated(ids: np.ndarray, doc: np.ndarray, docs: int) -> np.ndarray:
    """Per document: words in windows of ``WINDOW`` words that the document holds twice or more."""
    n = len(ids) - WINDOW + 1
    if n <= 0:
        return np.zeros(docs, np.int64)
    with np.errstate(over="ignore"):
        mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        key = doc[:n].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        for i in range(WINDOW):
            key = (key ^ mixed[i : i + n]) * np.uint64(0xBF58476D1CE4E5B9)
            key ^= key >> np.uint64(31)
    inside = np.flatnonzero(doc[:n] == doc[WINDOW - 1 :])
    order = inside[np.argsort(key[inside], kind="stable")]
    a, b = order[:-1], order[1:]
    same = key[a] == key[b]
    equal = doc[a] == doc[b]
    for i in range(WINDOW):
        equal &= ids[a + i] == ids[b + i]
    if (same & ~equal).any():  # two different windows with one key: compare the windows themselves
        seen = Counter((doc[i], *ids[i : i + WINDOW]) for i in inside)
        hits = np.array([i for i in inside if seen[(doc[i], *ids[i : i + WINDOW])] > 1], np.int64)
    else:
        hits = np.concatenate([a[same], b[same]])
    edge = np.zeros(len(ids) + 1, np.int64)
    hits = np.unique(hits)
    np.add.at(edge, hits, 1)
    np.add.at(edge, hits + WINDOW, -1)
    covered = np.cumsum(edge[:-1]) > 0
    return np.bincount(doc[covered], minlength=docs)


def script_of(text: str) -> str:
    if text.isascii():
        return "latin"
    counts = Counter()
    for ch, n in Counter(text).items():
        if ch.isalpha():
            c = ord(ch)
            if c < 0x250 or 0x1E00 <= c < 0x1F00:
                counts["latin"] += n
            elif 0x400 <= c < 0x530:
                counts["cyrillic"] += n
            elif 0x2E80 <= c < 0xA4D0 or 0xAC00 <= c < 0xD7B0 or 0xF900 <= c < 0xFB00 or c >= 0x20000:
                counts["cjk"] += n
            else:
                counts["other"] += n
    return max(sorted(counts), key=counts.get, default="other")


def _fertility(memory: WordMemory, ids: np.ndarray, doc: np.ndarray, docs: int):
    """Tokens, byte tokens and entropy in bits per document."""
    width = len(memory.starts)
    pairs, times = np.unique(doc * width + ids, return_counts=True)
    d, w = pairs // width, pairs % width
    lengths = memory.starts[w + 1] - memory.starts[w]
    first = np.repeat(memory.starts[w] - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths)
    tokens = memory.tokens[first + np.arange(len(first))]
    key = np.repeat(d, lengths) * memory.size + tokens
    weight = np.repeat(times, lengths)
    order = np.argsort(key, kind="stable")
    key, weight = key[order], weight[order]
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    n = np.add.reduceat(weight, starts) if len(starts) else np.zeros(0, np.int64)
    d, t = key[starts] // memory.size, key[starts] % memory.size
    total = np.bincount(d, n, docs)
    in_bytes = np.bincount(d, n * memory.is_byte[t], docs)
    sums = np.bincount(d, n * np.log2(n), docs) if len(n) else np.zeros(docs)
    with np.errstate(divide="ignore", invalid="ignore"):
        entropy = np.where(total > 0, np.log2(total) - sums / total, 0.0)
    return total.astype(np.int64), in_bytes, entropy


def _measure_chunk(texts: list[str], split: list[list[bytes]], path: str) -> pd.DataFrame:
    memory = _memory(path)
    if len(memory.ids) > MEMORY_WORDS:
        memory.clear()
    docs = len(texts)
    n_words = np.fromiter(map(len, split), np.int64, docs)
    ids = memory.look_up([w for words in split for w in words])
    doc = np.repeat(np.arange(docs), n_words)
    tokens, in_bytes, entropy = _fertility(memory, ids, doc, docs)
    chars = np.array([len(t) - sum(map(t.count, SPACES)) for t in texts], np.int64)
    dup = np.zeros(docs, np.int64)
    for i, t in enumerate(texts):
        full = [x for x in t.split("\n") if x.strip(SPACES)]
        dup[i] = len(full) - len(set(full))
    some = np.maximum(tokens, 1)
    return pd.DataFrame(
        {
            "n_words": n_words,
            "word_chars": chars,
            "n_symbols": [sum(map(t.count, SYMBOLS)) for t in texts],
            "n_dup_lines": dup,
            "n_repeat_words": repeated(ids, doc, docs),
            "n_tokens": tokens,
            "chars_per_token": np.where(tokens > 0, chars / some, 0.0),
            "byte_share": np.where(tokens > 0, in_bytes / some, 0.0),
            "token_entropy": np.round(entropy, 9),
            "script": [script_of(t) for t in texts],
        }
    )


def measure(texts, path: str) -> pd.DataFrame:
    """The metrics of some texts, a bounded number of words at a time."""
    out, part, split, held = [], [], [], 0
    for t in texts:
        t = t or ""
        words = t.encode().split()
        part.append(t)
        split.append(words)
        held += len(words)
        if held >= CHUNK_WORDS:
            out.append(_measure_chunk(part, split, path))
            part, split, held = [], [], 0
    if part or not out:
        out.append(_measure_chunk(part, split, path))
    return pd.concat(out, ignore_index=True)


def measured(documents: DataFrame, path: str | None = None, columns: list[str] | None = None) -> DataFrame:
    """``row`` (``columns``, else all) and ``m`` (the metrics) per document."""
    path = path or vocabulary_path()

    @F.pandas_udf(METRICS)
    def metrics(texts: pd.Series) -> pd.DataFrame:
        return measure(texts, path)

    kept = F.struct(*[documents[c] for c in (documents.columns if columns is None else columns)])
    rows = bounded_batches(documents).select(kept.alias("row"), documents["text"].cast("string").alias("text"), _language(documents))
    return rows.select("row", metrics("text").alias("m"), "lang").select(
        "row",
        "m",
        F.coalesce("lang", F.concat(F.lit("script "), F.col("m.script"))).alias("band"),
        F.floor(2 * F.log2(F.greatest(F.col("m.word_chars"), F.lit(1)))).alias("size"),
        (
            (F.col("m.n_words") < MIN_WORDS) | (100 * F.col("m.n_repeat_words") > MAX_REPEATED_PERCENT * F.col("m.n_words"))
        ).alias("base_failed"),
    )


def _language(documents: DataFrame) -> Column:
    known = documents["lang"].cast("string") if "lang" in documents.columns else F.lit(None).cast("string")
    return known.alias("lang")


def _weighted_median(keys: list[str], value: str) -> Column:
    """The smallest value that half of the counted texts of a group don't exceed, of a table of counts ``cnt``."""
    upto = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(*keys)
    reached = F.when(2 * F.sum("cnt").over(upto) >= F.sum("cnt").over(whole), F.col(value))
    return reached


def bands(scored: DataFrame) -> DataFrame:
    """``band, size`` and per metric its median, deviation and number of different texts.

    ``scored`` is the result of ``measured``. The windows run over counts per bin, whose number doesn't grow with the texts.
    """
    bins = [F.round(F.col(f"m.{name}") / width).cast("long").alias(name) for name, (width, _) in BANDED.items()]
    texts = scored.where("NOT base_failed").select("band", "size", "m.n_words", "m.word_chars", "m.n_tokens", *bins).distinct()
    each = ", ".join(f"'{name}', {name}" for name in BANDED)
    keys = ["band", "size", "metric"]
    counts = texts.selectExpr("band", "size", f"stack({len(BANDED)}, {each}) AS (metric, bin)").groupBy(*keys, "bin").agg(
        F.count("*").alias("cnt")
    )
    centred = counts.withColumn("reached", _weighted_median(keys, "bin")).withColumn(
        "mid", F.min("reached").over(Window.partitionBy(*keys))
    )
    spread = centred.groupBy(*keys, "mid", F.abs(F.col("bin") - F.col("mid")).alias("far")).agg(F.sum("cnt").alias("cnt"))
    found = spread.withColumn("reached", _weighted_median(keys, "far")).groupBy(*keys, "mid").agg(
        F.min("reached").alias("far"), F.sum("cnt").alias("n")
    )
    columns = []
    for name, (width, _) in BANDED.items():
        here = F.col("metric") == name
        columns += [
            F.max(F.when(here, F.col("mid") * width)).alias(f"{name}_mid"),
            F.max(F.when(here, 1.4826 * F.col("far") * width)).alias(f"{name}_dev"),
        ]
    return found.groupBy("band", "size").agg(*columns, F.max("n").alias("n"))


def judge(documents: DataFrame, path: str | None = None, columns: list[str] | None = None) -> DataFrame:
    """``row, m, base_failed, rejected_by, kept`` per document; ``row`` holds ``columns``, else all of them.

    ``rejected_by`` is ``base``, the first metric that lies outside its band, ``both`` for their mean, ``symbols``, or null.
    """
    scored = materialize(measured(documents, path, columns), "metrics")
    joined = scored.join(within(bands(scored)), ["band", "size"], "left")
    wide = WIDTH * (1 + 4 / F.sqrt("n"))

    def deviation(name: str) -> Column:
        least = F.lit(BANDED[name][1]) / F.sqrt(F.greatest(F.col("m.n_tokens"), F.lit(1)))
        return (F.col(f"m.{name}") - F.col(f"{name}_mid")) / F.greatest(F.col(f"{name}_dev"), least)

    outside = F.when(F.col("base_failed"), "base")
    for name in BANDED:
        outside = outside.when(F.abs(deviation(name)) > wide, name)
    both = (deviation("chars_per_token") + deviation("token_entropy")) / F.sqrt(F.lit(2.0))
    outside = outside.when(both < -wide, "both").when(
        F.col("m.n_symbols") > MAX_SYMBOLS_PER_WORD * F.col("m.n_words"), "symbols"
    )
    return joined.select("row", "m", "base_failed", outside.alias("rejected_by")).withColumn(
        "kept", F.col("rejected_by").isNull()
    )


def keep(documents: DataFrame, path: str | None = None) -> DataFrame:
    """The documents that the rules keep, as they are."""
    return judge(documents, path).where("kept").select("row.*")
