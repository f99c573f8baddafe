"""Gradient boosting of two-level trees on a table of counted feature vectors.

The training data of an operator whose features are all categorical with few levels is a contingency table: a row per
distinct feature vector with its count and positives, aggregated by Spark over every document. Its size is bounded by the
product of the levels, whatever the corpus, so the trees are fitted on the driver. The fitted model is a Spark
expression, so scoring stays in the JVM.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, functions as F


@dataclass
class Boosted:
    features: list[str]
    base: float
    #: (feature, level, weight if equal, (feature, level, weight if equal, weight if not) for the rest)
    trees: list[tuple] = field(default_factory=list)

    def margin(self, value: dict) -> float:
        total = self.base
        for f, v, hit, (g, u, yes, no) in self.trees:
            total += hit if value[f] == v else yes if value[g] == u else no
        return total

    def expression(self, of) -> Column:
        """Probability, given ``of(feature)`` as a column of each feature."""
        total = F.lit(self.base)
        for f, v, hit, (g, u, yes, no) in self.trees:
            total = total + F.when(of(f) == v, hit).when(of(g) == u, yes).otherwise(no)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))

    def probability(self, value: dict) -> float:
        return 1 / (1 + math.exp(-self.margin(value)))


def fit(table: list[dict], features: list[str], rounds: int = 12, rate: float = 0.4, l2: float = 1.0) -> Boosted:
    """``table``: dicts with the features, ``n`` (rows) and ``pos`` (positive rows)."""
    n, pos = sum(r["n"] for r in table), sum(r["pos"] for r in table)
    prior = math.log((pos + 0.5) / (n - pos + 0.5))
    model = Boosted(features, prior)
    margins = [prior] * len(table)

    def best(rows: list[int], grads: list[float], hess: list[float]):
        g, h = sum(grads[i] for i in rows), sum(hess[i] for i in rows)
        found = (-1.0, features[0], None)
        for f in features:
            by: dict = {}
            for i in rows:
                a = by.setdefault(table[i][f], [0.0, 0.0])
                a[0] += grads[i]
                a[1] += hess[i]
            for v, (a, b) in sorted(by.items(), key=lambda x: str(x[0])):
                gain = a * a / (b + l2) + (g - a) ** 2 / (h - b + l2) - g * g / (h + l2)
                if gain > found[0] + 1e-12:
                    found = (gain, f, v)
        return found

    for _ in range(rounds if table else 0):
        probs = [1 / (1 + math.exp(-m)) for m in margins]
        grads = [r["pos"] - r["n"] * p for r, p in zip(table, probs, strict=True)]
        hess = [r["n"] * p * (1 - p) for r, p in zip(table, probs, strict=True)]
        everything = list(range(len(table)))
        leaf = lambda rows: rate * sum(grads[i] for i in rows) / (sum(hess[i] for i in rows) + l2)
        _, f, v = best(everything, grads, hess)
        rest = [i for i in everything if table[i][f] != v]
        _, g, u = best(rest, grads, hess) if rest else (0, f, v)
        hit = leaf([i for i in everything if table[i][f] == v])
        yes, no = leaf([i for i in rest if table[i][g] == u]), leaf([i for i in rest if table[i][g] != u])
        model.trees.append((f, v, hit, (g, u, yes, no)))
        for i, r in enumerate(table):
            margins[i] += hit if r[f] == v else yes if r[g] == u else no
    return model


def threshold(model: Boosted, table: list[dict], precision: float) -> float:
    """The lowest score at and above which the counted precision, smoothed, reaches ``precision``; above 1 if none does."""
    scored: dict[float, list[int]] = {}
    for r in table:
        a = scored.setdefault(model.probability(r), [0, 0])
        a[0] += r["n"]
        a[1] += r["pos"]
    n = pos = 0
    found = 1.1
    for score in sorted(scored, reverse=True):
        n, pos = n + scored[score][0], pos + scored[score][1]
        if (pos + 0.5) / (n + 1) >= precision:
            found = score
    return found
