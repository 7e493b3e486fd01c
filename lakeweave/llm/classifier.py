"""Quality scores: ridge regression on random Fourier features, calibrated by isotonic regression.

Statistics of a text, standardised, are mapped to random Fourier features, which approximate a Gaussian
kernel. Each task sums its part of the normal equations, so one small matrix is solved on the
driver whatever the size of the corpus. A fold that the ridge fit has not seen is counted by score bins, and
pooling adjacent violators turns raw scores into probabilities, joined by straight lines.

Fitting takes at most ``MAX_ROWS`` labelled rows, chosen by a hash of the id; every row is scored. Ids of
which crc32 modulo 5 is 0 are never learned from, those of remainder 1 calibrate, the others fit.

Defined results: null and empty texts have a score too; a null label is no label; a document with several labels
has their mean; rows with a null id are scored, held out as the empty id is; repeated rows get one score; without
any label, or with one value only, all scores are that value or 0.5; an empty table gives an empty
result; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeweave.llm.common import bounded_batches, within
from lakeweave.llm.quality import SPACES, SYMBOLS, _Numbered, repeated
from lakeweave.session import materialize

MAX_ROWS = 200_000
FEATURES = 384
WIDTH = 3.0  # of the Gaussian kernel, in standard deviations
RIDGE = 1.0
SEED = 20240229
BINS = 2000
THRESHOLD = 0.3
CHUNK = 256

STATISTICS = (
    "log_words", "word_length", "word_spread", "symbols", "symbol_words", "points", "digits", "capitals", "foreign",
    "dup_lines", "repeated", "distinct", "commonest", "line_words", "short_lines", "letters", "entropy",
)
_POINTS = ".,;:!?\"'()-"


def statistics(texts: list[str | None]) -> np.ndarray:
    """One row of ``STATISTICS`` per text."""
    out = np.zeros((len(texts), len(STATISTICS)))
    number, all_ids, sizes = _Numbered(), [], []
    for i, t in enumerate(texts):
        t = t or ""
        raw = t.encode()
        words = raw.split()
        n = len(words)
        ids = list(map(number.__getitem__, words))
        all_ids += ids
        sizes.append(n)
        chars = max(1, len(t))
        counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
        lines = [x for x in t.split("\n") if x.strip(SPACES)]
        lengths = np.fromiter(map(len, words), float, n) if n else np.zeros(1)
        of = np.unique(np.array(ids), return_counts=True)[1] if n else np.zeros(1)
        share = counts[counts > 0] / max(1, len(raw))
        at = lambda s: counts[np.frombuffer(s.encode(), np.uint8)].sum()
        symbols = at(SYMBOLS)
        out[i] = (
            np.log1p(n),
            lengths.mean(),
            lengths.std(),
            symbols / chars,
            min(1.0, symbols / max(1, n)),
            at(_POINTS) / chars,
            counts[48:58].sum() / chars,
            counts[65:91].sum() / chars,
            counts[128:].sum() / max(1, len(raw)),
            1 - len(set(lines)) / max(1, len(lines)) if lines else 0,
            0.0,
            np.log1p(len(of)) / np.log1p(max(1, n)),
            of.max() / max(1, n),
            np.log1p(n / max(1, len(lines))),
            sum(len(x) < 20 for x in lines) / max(1, len(lines)),
            (counts[65:91].sum() + counts[97:123].sum() + counts[128:].sum()) / max(1, len(raw)),
            -(share * np.log2(share)).sum() if len(raw) else 0.0,
        )
    sizes = np.array(sizes, np.int64)
    doc = np.repeat(np.arange(len(texts)), sizes)
    out[:, STATISTICS.index("repeated")] = repeated(np.array(all_ids, np.int64), doc, len(texts)) / np.maximum(sizes, 1)
    return out


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    knots: np.ndarray  # raw scores, ascending
    levels: np.ndarray  # calibrated scores at the knots

    def raw(self, x: np.ndarray) -> np.ndarray:
        return fourier((x - self.mean) / self.spread) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(x), self.knots, self.levels), 0.0, 1.0)


def fourier(z: np.ndarray) -> np.ndarray:
    """Random Fourier features of standardised rows, and a constant."""
    random = np.random.default_rng(SEED)
    directions = random.normal(0, 1 / WIDTH, (z.shape[1], FEATURES))
    phase = random.uniform(0, 2 * np.pi, FEATURES)
    return np.hstack([np.sqrt(2 / FEATURES) * np.cos(np.clip(z, -8, 8) @ directions + phase), np.ones((len(z), 1))])


def remainder(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(5))


def training_rows(documents: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """``fold, y, x``: statistics of the labelled rows to learn from."""
    known = (
        labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels["quality"].cast("double").alias("y"))
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
    joined = texts.join(within(known), "doc_id").select(remainder(F.col("doc_id")).cast("int").alias("fold"), "y", "text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), CHUNK):
                part = batch.iloc[at : at + CHUNK]
                x = statistics(part["text"].tolist())
                yield pd.DataFrame({"fold": part["fold"].to_numpy(), "y": part["y"].to_numpy(), "x": list(x)})

    return materialize(bounded_batches(joined).mapInPandas(run, "fold int, y double, x array<double>"), "statistics")


def _summed(rows: DataFrame, part) -> dict[int, np.ndarray]:
    """``part(x, y)`` is a matrix; the matrices of all tasks are added up row by row in Spark."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for batch in batches:
            if len(batch):
                one = part(np.array(batch["x"].tolist()), batch["y"].to_numpy())
                total = one if total is None else total + one
        if total is not None:
            yield pd.DataFrame({"i": range(len(total)), "v": list(total)})

    def add(key, group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"i": [key[0]], "v": [np.sum(np.array(group["v"].tolist()), axis=0)]})

    sums = rows.select("x", "y").mapInPandas(run, "i int, v array<double>").groupBy("i").applyInPandas(add, "i int, v array<double>")
    return {r["i"]: np.array(r["v"]) for r in sums.collect()}  # a matrix of fixed size


def isotonic(score: np.ndarray, rows: np.ndarray, hits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pools adjacent violators; returns the blocks' mean scores and their levels."""
    blocks: list[list[float]] = []
    for s, n, h in zip(score, rows, hits):
        blocks.append([s * n, n, h])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][1] >= blocks[-1][2] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    return np.array([b[0] / b[1] for b in blocks]), np.array([b[2] / b[1] for b in blocks])


def fit(documents: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Model:
    rows = training_rows(documents, labels, max_rows)
    width = len(STATISTICS)
    moments = _summed(rows.where("fold > 1"), lambda x, y: np.vstack([x.sum(0), (x**2).sum(0), np.full(x.shape[1], len(x)), np.full(x.shape[1], y.sum())]))
    if not moments:
        return Model(np.zeros(width), np.ones(width), np.zeros(FEATURES + 1), np.zeros(1), np.full(1, 0.5))
    n, positive = moments[2][0], moments[3][0]
    mean = moments[0] / n
    spread = np.sqrt(np.maximum(moments[1] / n - mean**2, 0))
    spread = np.where(spread > 1e-9, spread, 1.0)
    if positive <= 0 or positive >= n:
        return Model(mean, spread, np.zeros(FEATURES + 1), np.zeros(1), np.full(1, float(positive > 0)))

    def equations(x, y):
        z = fourier((x - mean) / spread)
        return np.hstack([z.T @ z, (z.T @ y)[:, None]])

    sums = _summed(rows.where("fold > 1"), equations)
    system = np.array([sums[i] for i in range(FEATURES + 1)])
    penalty = np.eye(FEATURES + 1) * RIDGE
    penalty[-1, -1] = 0
    weights = np.linalg.solve(system[:, :-1] + penalty, system[:, -1])
    model = Model(mean, spread, weights, np.zeros(1), np.zeros(1))

    def binned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                raw = np.clip(model.raw(np.array(batch["x"].tolist())), -0.5, 1.5)
                yield pd.DataFrame({"bin": np.round((raw + 0.5) / 2 * BINS).astype(int), "y": batch["y"].to_numpy()})

    counted = (
        rows.where("fold = 1").select("x", "y").mapInPandas(binned, "bin int, y double")
        .groupBy("bin").agg(F.count("*").alias("n"), F.sum("y").alias("h")).orderBy("bin").collect()  # BINS + 1 rows at most
    )
    if not counted:
        return Model(mean, spread, weights, np.array([0.0, 1.0]), np.array([0.0, 1.0]))
    scores = np.array([r["bin"] for r in counted]) * 2 / BINS - 0.5
    knots, levels = isotonic(scores, np.array([r["n"] for r in counted], float), np.array([r["h"] for r in counted], float))
    return Model(mean, spread, weights, knots, levels)


def score(documents: DataFrame, model: Model) -> DataFrame:
    """``doc_id, score`` per row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), CHUNK):
                part = batch.iloc[at : at + CHUNK]
                yield pd.DataFrame({"doc_id": part["doc_id"].to_numpy(), "score": model.score(statistics(part["text"].tolist()))})

    texts = documents.select(documents["doc_id"].cast("string").alias("doc_id"), documents["text"].cast("string").alias("text"))
    return bounded_batches(texts).mapInPandas(run, "doc_id string, score double").withColumn("doc_id", F.col("doc_id").cast("long"))


def judge(documents: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """``doc_id, held_out, score, predicted`` per document."""
    scored = score(documents, fit(documents, labels, max_rows))
    return scored.select(
        "doc_id", (remainder(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
