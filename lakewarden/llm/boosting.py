"""Gradient-boosted trees of depth two, trained with numpy and scored as SQL expressions."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Tree:
    """``feature < cut`` at the root, then one split (or none) on either side."""

    feature: int
    cut: float
    sides: tuple[tuple[int, float, float, float], tuple[int, float, float, float]]  # feature, cut, below, above


@dataclass(frozen=True)
class Boosted:
    bias: float
    trees: tuple[Tree, ...]

    def margin(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.bias)
        for tree in self.trees:
            below = x[:, tree.feature] < tree.cut
            for side, rows in zip(tree.sides, (below, ~below), strict=True):
                feature, cut, low, high = side
                total[rows] += np.where(x[rows, feature] < cut, low, high)
        return total

    def column(self, features: list[Column]) -> Column:
        """The margin over feature columns, added up in the order of ``margin``."""
        total = F.lit(self.bias)
        for tree in self.trees:
            leaves = [
                F.when(features[f] < F.lit(cut), F.lit(low)).otherwise(F.lit(high)) if low != high else F.lit(low)
                for f, cut, low, high in tree.sides
            ]
            total = total + F.when(features[tree.feature] < F.lit(tree.cut), leaves[0]).otherwise(leaves[1])
        return total


def _cuts(values: np.ndarray) -> np.ndarray:
    seen = np.unique(values)
    return (seen[1:] + seen[:-1]) / 2


def _best(x: np.ndarray, gradient: np.ndarray, weight: np.ndarray, ridge: float) -> tuple[float, int, float]:
    whole = gradient.sum() ** 2 / (weight.sum() + ridge)
    best = (1e-9, 0, np.inf)
    for f in range(x.shape[1]):
        for cut in _cuts(x[:, f]):
            low = x[:, f] < cut
            g, w = gradient[low].sum(), weight[low].sum()
            gain = g * g / (w + ridge) + (gradient.sum() - g) ** 2 / (weight.sum() - w + ridge) - whole
            if gain > best[0]:
                best = (gain, f, float(cut))
    return best


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 60, rate: float = 0.3, ridge: float = 1.0) -> Boosted:
    """Newton boosting of the logistic loss."""
    bias = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    margin, trees = np.full(len(y), bias), []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        gradient, weight = y - p, p * (1 - p)
        _, feature, cut = _best(x, gradient, weight, ridge)
        if not np.isfinite(cut):
            break
        below, sides = x[:, feature] < cut, []
        for rows in (below, ~below):
            gain, f, c = _best(x[rows], gradient[rows], weight[rows], ridge)
            low = x[rows, f] < c
            leaf = [float(rate * gradient[rows][m].sum() / (weight[rows][m].sum() + ridge)) for m in (low, ~low)]
            sides.append((f, c if np.isfinite(c) else 0.0, *(leaf if np.isfinite(c) else [leaf[0]] * 2)))
        tree = Tree(feature, cut, tuple(sides))
        trees.append(tree)
        margin = Boosted(bias, tuple(trees)).margin(x)
    return Boosted(bias, tuple(trees))
