"""Small gradient-boosted trees: fitted with numpy on a bounded sample, applied as a DataFrame expression."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

Tree = tuple  # (feature, cut, left, right) or (value,)


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 20, depth: int = 3, rate: float = 0.3, least: float = 1.0) -> list[Tree]:
    """Trees for the log odds by Newton steps; the first tree is the prior."""
    prior = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    trees: list[Tree] = [(float(np.log(prior / (1 - prior))),)]
    score = np.full(len(y), trees[0][0])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        t = _grow(x, y - p, p * (1 - p), np.arange(len(y)), depth, rate, least)
        trees.append(t)
        score += apply(t, x)
    return trees


def _grow(x, g, h, rows, depth, rate, least) -> Tree:
    leaf = (float(rate * g[rows].sum() / (h[rows].sum() + least)),)
    if depth == 0 or len(rows) < 2:
        return leaf
    best, base = None, g[rows].sum() ** 2 / (h[rows].sum() + least)
    for f in range(x.shape[1]):
        v = x[rows, f]
        for c in np.unique(np.quantile(v, np.linspace(0, 1, 17)[1:-1], method="nearest")):
            low = v <= c
            if low.all():
                continue
            gain = sum(g[rows[s]].sum() ** 2 / (h[rows[s]].sum() + least) for s in (low, ~low)) - base
            if best is None or gain > best[0] + 1e-9:
                best = (gain, f, float(c), low)
    if best is None or best[0] <= 1e-6:
        return leaf
    _, f, c, low = best
    return (f, c, _grow(x, g, h, rows[low], depth - 1, rate, least), _grow(x, g, h, rows[~low], depth - 1, rate, least))


def apply(t: Tree, x: np.ndarray) -> np.ndarray:
    if len(t) == 1:
        return np.full(len(x), t[0])
    f, c, a, b = t
    return np.where(x[:, f] <= c, apply(a, x), apply(b, x))


def predict(trees: list[Tree], x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-sum(apply(t, x) for t in trees)))


def expression(trees: list[Tree], feature: Callable[[int], Column]) -> Column:
    """The probability as nested CASE expressions over the features."""

    def one(t: Tree) -> Column:
        return F.lit(t[0]) if len(t) == 1 else F.when(feature(t[0]) <= t[1], one(t[2])).otherwise(one(t[3]))

    total = F.lit(0.0)
    for t in trees:
        total = total + one(t)
    return 1 / (1 + F.exp(-total))
