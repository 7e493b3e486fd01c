"""Gradient boosting of shallow trees on binned features, fitted from counts per cell.

A cell is a combination of bins, so Spark counts all rows of the corpus into a table whose size the
bins bound, and the trees are fitted on that table. The model is an SQL expression.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Tree:
    """Split ``feature <= value`` at the root and in both halves, with four leaf scores."""

    root: tuple[int, int]
    left: tuple[int, int]
    right: tuple[int, int]
    leaves: tuple[float, float, float, float]


@dataclass(frozen=True)
class Model:
    bias: float
    trees: tuple[Tree, ...]

    def margin(self, cells: np.ndarray) -> np.ndarray:
        out = np.full(len(cells), self.bias)
        for t in self.trees:
            at = lambda split: cells[:, split[0]] <= split[1]
            out += np.where(
                at(t.root), np.where(at(t.left), *t.leaves[:2]), np.where(at(t.right), *t.leaves[2:])
            )
        return out

    def sql(self, names: list[str]) -> str:
        """The margin as SQL over the features' names."""

        def branch(split, yes, no):
            return f"CASE WHEN {names[split[0]]} <= {split[1]} THEN {yes} ELSE {no} END"

        number = lambda v: f"{v!r}D"
        parts = [number(float(self.bias))]
        for t in self.trees:
            a, b, c, d = (number(float(v)) for v in t.leaves)
            parts.append(branch(t.root, branch(t.left, a, b), branch(t.right, c, d)))
        return "(" + " + ".join(parts) + ")"


def fit(cells: np.ndarray, rows: np.ndarray, positive: np.ndarray, rounds: int = 24, rate: float = 0.4, ridge: float = 1.0) -> Model:
    """Newton boosting of the logistic loss; ``rows`` and ``positive`` count the rows of each cell."""
    total, hits = rows.sum(), positive.sum()
    if total == 0 or hits == 0 or hits == total:
        return Model(-20.0 if hits == 0 else 20.0, ())
    bias = float(np.log(hits / (total - hits)))
    margin, trees = np.full(len(cells), bias), []
    splits = [(f, int(v)) for f in range(cells.shape[1]) for v in np.unique(cells[:, f])[:-1]] or [(0, 0)]
    masks = np.array([cells[:, f] <= v for f, v in splits])

    def best(g, h, inside):
        gl, hl = masks @ (g * inside), masks @ (h * inside)
        gt, ht = (g * inside).sum(), (h * inside).sum()
        gain = gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge)
        return int(np.argmax(np.round(gain, 9)))

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = positive - rows * p, rows * p * (1 - p)
        root = best(g, h, np.ones(len(cells)))
        halves = [masks[root], ~masks[root]]
        inner = [best(g, h, half) for half in halves]
        leaves = []
        for half, i in zip(halves, inner):
            for part in (half & masks[i], half & ~masks[i]):
                leaf = rate * float((g * part).sum() / ((h * part).sum() + ridge))
                leaves.append(round(leaf, 6))
                margin = margin + part * leaves[-1]
        trees.append(Tree(splits[root], splits[inner[0]], splits[inner[1]], tuple(leaves)))
    return Model(bias, tuple(trees))


def threshold(margin: np.ndarray, rows: np.ndarray, positive: np.ndarray, precision: float) -> float:
    """The smallest margin at which the rows of that score reach the precision; infinite if none does.

    Rows of higher scores don't vouch for those of lower ones: a score counts by its own rows, and only
    neighbours whose shares contradict the order are pooled (isotonic regression).
    """
    blocks: list[list[float]] = []  # smallest margin, rows, positive rows
    for m in np.unique(margin[rows > 0]):
        at = margin == m
        blocks.append([float(m), float(rows[at].sum()), float(positive[at].sum())])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][1] >= blocks[-1][2] * blocks[-2][1]:
            _, n, y = blocks.pop()
            blocks[-1][1] += n
            blocks[-1][2] += y
    return next((m for m, n, y in blocks if y >= precision * n), float("inf"))
