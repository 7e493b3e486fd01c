"""Toxicity of texts, read through a noisy channel.

Writers hide words by look-alike digits and signs, by blanks or points between letters, and by repeated letters.
Each disguised stretch becomes a lattice of characters, each arc with what the channel charges for it, and Viterbi
decoding finds the reading that a character language model and the channel together like best. The model is of
four-grams of characters, counted over all documents. Words of plain letters have one reading and need no
search. The restored words, and the stems of the longer ones, are then scored.

Weights are learned from labelled rows, at most ``MAX_ROWS``, chosen by a hash of the id, and none of which crc32 of the
id modulo 5 is 0: the log odds of a word with its standard error, of which only those well beyond it
are kept, at most ``MAX_FEATURES`` of at most ``MAX_CANDIDATES``. Texts that are copies of each other count as one, or a word of theirs would
look like many. A text's sum is divided by the root of its number of different tokens; every labelled row's sum is taken
with weights that its own copies had no part in, and isotonic regression turns sums into probabilities.

Defined results: null and empty texts have a score too; a null label is no label; a document with several labels has
their mean; rows with a null id are scored, held out as the empty id is; repeated rows get one score; without any label,
or with one value only, all scores are that value or 0.5; an empty table gives an empty result;
further columns are not read; a text of any length is read whole.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeweave.llm.classifier import remainder
from lakeweave.llm.common import bounded_batches, exploded, lower_ascii, shingles, within, words
from lakeweave.llm.vectors import summed
from lakeweave.session import materialize

MAX_ROWS = 200_000
MAX_CANDIDATES = 200_000  # features of toxic texts that others are searched for
MAX_FEATURES = 50_000
THRESHOLD = 0.5
LEAST_ERRORS = 3.5  # standard errors by which the log odds of a feature must exceed 0
LEAST_TEXTS = 3
STEMS = (4, 5, 6)
BINS = 1000
MEMORY = 200_000  # tokens whose reading a worker remembers
CHUNK = 256

# What a sign may stand for.
LOOKS = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¥": "y", "*": "aeiou",
}
# What the channel charges, in nats.
SUBSTITUTED = 1.0
MASKED = 2.0  # a star for some vowel
DROPPED = 2.5  # a sign between the letters of a word
JOINED = 1.0  # a blank between single letters
DOUBLED = 2.0  # two letters for one
STRETCHED = 0.5  # three or more letters for one or two

# Classes of characters: the border of a word, 26 letters, digits, letters of other kinds.
BORDER, DIGIT, OTHER, SIZE = 0, 27, 28, 29
_MARKS = re.compile("[̀-ͯ­​-‍⁠﻿]")
_SPACED = re.compile(r"(?<!\S)\S(?:[ \t]{1,3}\S){2,}(?!\S)")
# Signs at the ends of a word are borders unless they are ones that stand for a letter there.
_BEFORE, _AFTER = "\"'([{#%&*~<>=/\\-", ".,;:!?\"')]}#%&*~<>=/\\-"
# One doubled letter is usual spelling; two of them, or three letters in a row, may be a disguise.
_STRETCHED = re.compile(r"(.)\1(?:\1|.*(.)\2)")
_RUNS = re.compile(r"(.)\1*", re.S)
_WORDS = re.compile(r"[^\W_]+")


def plain(text: str) -> str:
    """Lower case, compatible forms, no accents, nothing invisible."""
    return _MARKS.sub("", unicodedata.normalize("NFKD", text).lower()) if not text.isascii() else text.lower()


# -- character language model ---------------------------------------------------------------------


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """The class of every code point, by what Python calls a letter or a digit."""
    out = np.zeros(0x110000, np.uint8)
    for c in range(0x80, 0x110000):
        if chr(c).isalpha():
            out[c] = OTHER
    out[ord("a") : ord("z") + 1] = np.arange(1, 27)
    out[ord("0") : ord("9") + 1] = DIGIT
    return out


def class_of(c: str) -> int:
    return int(_classes()[ord(c)])


def gram_counts(texts: list[str]) -> np.ndarray:
    """Counts of four-grams of classes, each word on its own between borders."""
    read = [plain(t) for t in texts]
    # Texts of other characters take four bytes for each, so they are counted on their own.
    kinds = [t for t in read if t.isascii()], [t for t in read if not t.isascii()]
    return sum(_gram_counts("\n" + "\n".join(kind) + "\n") for kind in kinds)


def _gram_counts(joined: str) -> np.ndarray:
    if joined.isascii():
        c = _classes()[np.frombuffer(joined.encode(), np.uint8)]
    else:
        c = _classes()[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)]
    letter = c > 0
    c = c[1:][letter[1:] | letter[:-1]]  # one border between words, the first one aside
    before = np.concatenate((np.zeros(3, np.uint8), c))
    one, two, three = before[2:-1], before[1:-2], before[:-3]
    two = two * (one > 0)
    three = three * (two > 0)
    codes = (three.astype(np.int32) * SIZE + two) * (SIZE * SIZE) + one.astype(np.int32) * SIZE + c
    return np.bincount(codes, minlength=SIZE**4)


def language_model(documents: DataFrame) -> np.ndarray:
    """Log probabilities of a class after three others, from the counts of all documents."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[np.ndarray]:
        total, held, size = np.zeros(SIZE**4, np.int64), [], 0
        for batch in batches:
            for text in batch["text"]:
                held.append(text or "")
                size += len(held[-1])
                if size > 2_000_000:
                    total += gram_counts(held)
                    held, size = [], 0
        yield total + gram_counts(held)

    texts = documents.select(documents["text"].cast("string").alias("text"))
    return smoothed(summed(bounded_batches(texts), run, SIZE**4))


def smoothed(counts: np.ndarray, strength: float = 4.0) -> np.ndarray:
    """Each order leans on the next lower one by ``strength`` counts."""
    four = counts.reshape((SIZE,) * 4).astype(float)
    share = np.full(SIZE, 1 / SIZE)
    for n in (four.sum((0, 1, 2)), four.sum((0, 1)), four.sum(0), four):
        share = (n + strength * share) / (n.sum(-1, keepdims=True) + strength)
    return np.log(share).astype(np.float32).ravel()


# -- decoding --------------------------------------------------------------------------------------


@lru_cache(maxsize=20_000)
def _arcs(c: str, times: int) -> tuple[tuple[tuple[int, ...] | None, str, float], ...]:
    """What a run of one character may stand for: classes (None for a border), text, charge."""
    kind = class_of(c)
    if kind not in (BORDER, DIGIT):
        if times == 1:
            return (((kind,), c, 0.0),)
        if times == 2:
            return (((kind, kind), c * 2, 0.0), ((kind,), c, DOUBLED))
        literal = (((kind,) * 3, c * 3, 0.0),) if times == 3 else ()
        return (((kind,), c, STRETCHED), ((kind, kind), c * 2, STRETCHED), *literal)
    arcs = [((DIGIT,) * min(times, 3), c * min(times, 3), 0.0)] if kind == DIGIT else [(None, " ", 0.0)]
    charge = MASKED if c == "*" else SUBSTITUTED
    for letter in LOOKS.get(c, ""):
        arcs.append(((class_of(letter),), letter, charge))
        if times > 1:
            arcs.append(((class_of(letter),) * 2, letter * 2, charge))
    if kind == BORDER:
        arcs.append(((), "", JOINED if c in " \t" else DROPPED))
    return tuple(arcs)


def decode(stretch: str, model) -> str:
    """The best reading of a stretch, its words between blanks."""
    states: dict[int, tuple[float, tuple | None]] = {0: (0.0, None)}
    for run in _RUNS.finditer(stretch):
        arcs = _arcs(run[1], min(run.end() - run.start(), 4))
        reached: dict[int, tuple[float, tuple | None]] = {}
        for state, (score, back) in states.items():
            for kinds, text, charge in arcs:
                at, total = state, score - charge
                if kinds is None:
                    if at:
                        total += model[at * SIZE]
                        at = 0
                else:
                    for kind in kinds:
                        total += model[at * SIZE + kind]
                        at = at % (SIZE * SIZE) * SIZE + kind
                if at not in reached or total > reached[at][0]:
                    reached[at] = (total, (back, text) if text else back)
        states = reached
    back = max(((score + (model[at * SIZE] if at else 0.0), at) for at, (score, _) in states.items()), default=(0, 0))[1]
    back = states[back][1] if states else None
    parts = []
    while back is not None:
        parts.append(back[1])
        back = back[0]
    return "".join(reversed(parts))


def _three_single(tokens: list[str]) -> bool:
    """Are three tokens in a row of one character each?"""
    try:
        lengths = bytes(map(len, tokens))
    except ValueError:  # one is longer than a byte can say
        lengths = bytes([min(len(t), 2) for t in tokens])
    return b"\1\1\1" in lengths


class Reader:
    """Reads texts through the channel; remembers the words of tokens."""

    def __init__(self, model: np.ndarray):
        self.model = memoryview(np.ascontiguousarray(model))
        self.memory: dict[str, tuple[str, ...]] = {}

    def tokens(self, text: str) -> list[str]:
        """Tokens of a text, single letters between blanks already joined as the model likes."""
        text = plain(text)
        found = text.split()
        if _three_single(found):
            found = _SPACED.sub(lambda m: decode(re.sub(r"\s+", " ", m[0]), self.model), text).split()
        return found

    def interpret(self, token: str) -> tuple[str, ...]:
        """The words of a token."""
        word = token if token.isalpha() else token.lstrip(_BEFORE).rstrip(_AFTER)
        if word.isascii() and word.isalpha() and word.islower() and not _STRETCHED.search(word):
            return (word,)
        disguised = any("a" <= c <= "z" for c in token)
        return tuple(_WORDS.findall(decode(token, self.model) if disguised else token))

    def read(self, token: str) -> tuple[str, ...]:
        """The same, remembered."""
        found = self.memory.get(token)
        if found is None:
            if len(self.memory) >= MEMORY:
                self.memory.clear()
            found = self.memory[token] = self.interpret(token)
        return found

    def restore(self, text: str) -> str:
        """The text as it is read, in plain lower-case words."""
        return " ".join(w for t in self.tokens(text) for w in self.read(t))

    def words(self, text: str) -> tuple[set[str], int]:
        """The different words of a text, and how many different tokens they came from."""
        out: set[str] = set()
        known, tokens = self.memory.get, set(self.tokens(text))
        for token in tokens:
            out.update(known(token) or self.read(token))
        return out, len(tokens)


class Finder:
    """Finds features in texts; remembers those of tokens or words, most of which have none."""

    def __init__(self, wanted, read=lambda word: (word,)):
        self.wanted, self.read = wanted, read
        self.heads = {f[: STEMS[0]] for f in wanted}  # most words begin like none of them
        self.memory: dict[str, tuple[str, ...]] = {}

    def __call__(self, parts) -> set[str]:
        parts = list(parts)
        known = list(map(self.memory.get, parts))
        out = set().union(*filter(None, known))
        for part in [part for part, hits in zip(parts, known) if hits is None]:
            if len(self.memory) >= MEMORY:
                self.memory.clear()
            hits = ()
            likely = [w for w in self.read(part) if w[: STEMS[0]] in self.heads]
            if likely:
                hits = tuple([f for w in likely for f in features(w) if f in self.wanted])
                out.update(hits)
            self.memory[part] = hits
        return out


def restored(documents: DataFrame, model: np.ndarray) -> DataFrame:
    """``doc_id, restored``: every text as the channel is read."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = Reader(model)
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "restored": [reader.restore(t or "") for t in batch["text"]]})

    read = bounded_batches(_texts(documents)).mapInPandas(run, "doc_id string, restored string")
    return read.withColumn("doc_id", F.col("doc_id").cast("long"))


def _texts(documents: DataFrame) -> DataFrame:
    return documents.select(documents["doc_id"].cast("string").alias("doc_id"), documents["text"].cast("string").alias("text"))


# -- learning --------------------------------------------------------------------------------------


def features(word: str) -> list[str]:
    """The word and the stems of a longer one."""
    return [word, *[word[:k] + "*" for k in STEMS if len(word) > k]]


def log_odds(a, b, n_a, n_b):
    """Of texts with a feature, toxic ones and others; returns the log odds ratio and its standard error."""
    odds = np.log((a + 0.5) / (n_a - a + 0.5)) - np.log((b + 0.5) / (n_b - b + 0.5))
    return odds, np.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))


@dataclass(frozen=True)
class Model:
    language: np.ndarray
    counts: dict[str, tuple[float, float]]  # feature: toxic texts and others that hold it
    toxic: float
    others: float
    knots: np.ndarray
    levels: np.ndarray

    def weights(self) -> dict[str, float]:
        return {f: float(log_odds(a, b, self.toxic, self.others)[0]) for f, (a, b) in self.counts.items()}

    def score(self, raw: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(raw, self.knots, self.levels), 0.0, 1.0)


def labelled_words(documents: DataFrame, labels: DataFrame, language: np.ndarray, max_rows: int) -> DataFrame:
    """``y, share, tokens, words`` (between blanks) of the labelled texts; ``share`` is 1 over the number of copies of a text among them."""
    known = (
        labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels["toxic"].cast("double").alias("y"))
        .where("doc_id IS NOT NULL AND y IS NOT NULL")
        .groupBy("doc_id")
        .agg(F.avg("y").alias("y"))
        .where(remainder(F.col("doc_id")) != 0)
    )
    known = materialize(known, "labels")
    count = known.count()
    if count > max_rows:
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * max_rows / count))
    texts = documents.select(documents["doc_id"].cast("long").alias("doc_id"), documents["text"].cast("string").alias("text"))
    joined = texts.join(within(known), "doc_id").select("y", F.coalesce("text", F.lit("")).alias("text"))
    # Exact copies share the least hash of their word runs, near copies nearly always.
    split = joined.select("y", "text", words(lower_ascii(F.col("text"))).alias("w"))
    family = split.select("y", "text", F.coalesce(F.array_min(shingles("w")), F.lit(0)).alias("family"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = Reader(language)
        for batch in batches:
            found = [reader.words(t) for t in batch["text"]]
            yield pd.DataFrame({"y": batch["y"], "family": batch["family"], "tokens": [n for _, n in found], "words": [" ".join(sorted(w)) for w, _ in found]})

    schema = "y double, family long, tokens int, words string"
    read = materialize(bounded_batches(family).mapInPandas(run, schema), "labelled")
    copies = within(read.groupBy("family").agg((1 / F.count("*")).alias("share")))  # of the bounded sample
    return read.join(copies, "family").select("y", "share", "tokens", "words")


def fit(documents: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Model:
    language = language_model(documents)
    rows = labelled_words(documents, labels, language, max_rows)
    totals = rows.agg(F.sum(F.col("share") * F.col("y")).alias("toxic"), F.sum("share").alias("all")).first()
    toxic, every = totals["toxic"] or 0.0, totals["all"] or 0.0
    others = every - toxic
    if min(toxic, others) <= 1e-9:
        level = 0.5 if every == 0 else float(toxic > 0)
        return Model(language, {}, toxic, others, np.zeros(1), np.full(1, level))

    def of_toxic(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), CHUNK):
                part, a = batch.iloc[at : at + CHUNK], Counter()
                for y, share, held in zip(part["y"], part["share"], part["words"]):
                    for f in {f for w in held.split(" ") if w for f in features(w)}:
                        a[f] += share * y
                if a:
                    yield pd.DataFrame({"f": list(a), "a": list(a.values())})

    # The evidence for a feature is greatest if no other text holds it, so this leaves out none that counts.
    a = F.col("a") + 0.5
    most = (F.log(a / (toxic + 1 - a)) + np.log((others + 0.5) / 0.5)) / F.sqrt(1 / a + 2)
    in_toxic = rows.where("y > 0").mapInPandas(of_toxic, "f string, a double").groupBy("f").agg(F.sum("a").alias("a"))
    likely = in_toxic.where(F.col("a") >= LEAST_TEXTS).withColumn("most", most).where(F.col("most") >= LEAST_ERRORS)
    likely = {r["f"]: r["a"] for r in likely.orderBy(F.desc("most"), "f").limit(MAX_CANDIDATES).collect()}

    # From here on only the likely features of each row matter.
    def likely_ones(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        find = Finder(likely)
        for batch in batches:
            rest = batch[["y", "share", "tokens"]].copy()
            rest["found"] = [sorted(find(held.split(" "))) for held in batch["words"]]
            yield rest

    rows = materialize(rows.mapInPandas(likely_ones, "y double, share double, tokens int, found array<string>"), "likely")
    each = exploded(rows.where("y < 1").withColumn("b", F.expr("share * (1 - y)")), ["b"], "found", "f")
    in_others = {r["f"]: r["b"] for r in each.groupBy("f").agg(F.sum("b").alias("b")).collect()}  # MAX_CANDIDATES rows at most
    evidence = []
    for f, n in likely.items():
        odds, error = log_odds(n, in_others.get(f, 0.0), toxic, others)
        if odds >= LEAST_ERRORS * error:
            evidence.append((-odds / error, f))
    counts = {f: (likely[f], in_others.get(f, 0.0)) for _, f in sorted(evidence)[:MAX_FEATURES]}

    def without_own(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [{f for f in held if f in counts} for held in batch["found"]]
            raw = [_own_sum(held, n, y, counts, toxic, others) for held, n, y in zip(found, batch["tokens"], batch["y"])]
            bins = np.minimum(np.round(np.array(raw, float) * BINS / 10), BINS).astype(np.int64)
            yield pd.DataFrame({"bin": bins, "n": batch["share"], "h": batch["share"] * batch["y"]})

    binned = (
        rows.mapInPandas(without_own, "bin long, n double, h double")
        .groupBy("bin").agg(F.sum("n").alias("n"), F.sum("h").alias("h")).orderBy("bin").collect()  # BINS + 1 rows at most
    )
    knots, levels = rising(*(np.array([r[c] for r in binned], float) for c in ("bin", "n", "h")))
    return Model(language, counts, toxic, others, knots * 10 / BINS, levels)


def rising(score: np.ndarray, rows: np.ndarray, hits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic regression: both ends of each pooled block, at its level; straight lines join the blocks."""
    pools: list[list[float]] = []
    for i, (n, h) in enumerate(zip(rows, hits)):
        pools.append([i, n, h])
        while len(pools) > 1 and pools[-2][2] * pools[-1][1] >= pools[-1][2] * pools[-2][1]:
            _, n, h = pools.pop()
            pools[-1] = [pools[-1][0], pools[-1][1] + n, pools[-1][2] + h]
    first = [p[0] for p in pools]
    last = [x - 1 for x in first[1:]] + [len(score) - 1]
    knots = np.array([score[x] for pair in zip(first, last) for x in pair])
    return knots, np.repeat([p[2] / p[1] for p in pools], 2)


def _own_sum(found: set[str], tokens: int, y: float, counts: dict, toxic: float, others: float) -> float:
    """A labelled text's sum by weights that it and its copies had no part in."""
    if not found:
        return 0.0
    a, b = np.array([counts[f] for f in sorted(found)]).T
    n_a, n_b = max(toxic - y, 0.0), max(others - (1 - y), 0.0)
    a, b = np.clip(a - y, 0, n_a), np.clip(b - (1 - y), 0, n_b)
    odds, error = log_odds(a, b, n_a, n_b)
    return float(odds[odds >= LEAST_ERRORS * error].sum()) / np.sqrt(tokens + 20)


def score(documents: DataFrame, model: Model) -> DataFrame:
    """``doc_id, score`` per row."""
    weights = model.weights()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = Reader(model.language)
        find = Finder(weights, reader.interpret)
        for batch in batches:
            raw = []
            for text in batch["text"]:
                tokens = set(reader.tokens(text or ""))
                raw.append(sum(weights[f] for f in sorted(find(tokens))) / np.sqrt(len(tokens) + 20))
            yield pd.DataFrame({"doc_id": batch["doc_id"], "score": model.score(np.array(raw, float))})

    scored = bounded_batches(_texts(documents)).mapInPandas(run, "doc_id string, score double")
    return scored.withColumn("doc_id", F.col("doc_id").cast("long"))


def judge(documents: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """``doc_id, held_out, score, predicted`` per document."""
    scored = score(documents, fit(documents, labels, max_rows))
    return scored.select(
        "doc_id", (remainder(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
