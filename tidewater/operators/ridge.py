"""Ridge regression on standardised features, its penalty chosen by leave-one-out errors.

One pass sums the Gram matrix of features and label about a pivot row; means, deviations and the standardised matrix follow
from it, and one eigendecomposition serves all penalties. A second pass over the rows sums each penalty's squared
leave-one-out errors by the closed form, so no row is left out in fact. Matrices of the number of features squared reach the
driver, rows never.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

#: The penalties that are tried.
ALPHAS = tuple(np.logspace(-3, 3, 10).tolist())


@dataclass
class Ridge:
    weights: np.ndarray
    base: float
    alpha: float
    #: Mean squared leave-one-out error of each penalty.
    errors: dict[float, float]

    def score(self, features: str) -> Column:
        weights = F.array(*(F.lit(float(v)) for v in self.weights))
        return F.aggregate(F.zip_with(features, weights, lambda x, w: x * w), F.lit(float(self.base)), lambda s, v: s + v)


def gram(rows: DataFrame, features: str, label: str, pivot: np.ndarray) -> np.ndarray:
    """Sum over rows of v v', v = (features - pivot, y, 1), y the label as -1 and 1."""
    width = len(pivot) + 2
    upper = np.triu_indices(width)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((width, width))
        for batch in batches:
            if len(batch):
                v = np.column_stack([np.stack(batch["x"]) - pivot, batch["y"], np.ones(len(batch))])
                total += v.T @ v
        yield pd.DataFrame({"cell": np.arange(len(upper[0])), "v": total[upper]})

    cells = rows.select(F.col(features).alias("x"), (2.0 * F.col(label) - 1).alias("y")).mapInPandas(partial, "cell int, v double")
    found = cells.groupBy("cell").agg(F.sum("v").alias("v")).toArrow()  # half a matrix
    out, at = np.zeros((width, width)), found.column("cell").to_numpy()
    out[upper[0][at], upper[1][at]] = found.column("v").to_numpy()
    return np.triu(out) + np.triu(out, 1).T


@dataclass
class _Path:
    """The regressions of all penalties, along the eigenvectors of the standardised features, from a Gram matrix about ``pivot``."""

    g: np.ndarray
    pivot: np.ndarray
    alphas: tuple[float, ...]

    def __post_init__(self) -> None:
        self.n, sums = self.g[-1, -1], self.g[-1, :-1] / self.g[-1, -1]
        cov = self.g[:-1, :-1] / self.n - np.outer(sums, sums)
        self.mean, self.middle = self.pivot + sums[:-1], sums[-1]
        spread = np.sqrt(np.maximum(np.diag(cov)[:-1], 0))
        flat = spread <= 1e-12 * (1 + np.abs(self.mean))
        scale = np.where(flat, 1.0, spread)
        self.keep = np.where(flat, 0.0, 1.0) / scale
        values, self.vectors = np.linalg.eigh(self.n * cov[:-1, :-1] * np.outer(self.keep, self.keep))
        shadow = self.vectors.T @ (self.n * cov[:-1, -1] * self.keep)
        # A column for each penalty.
        self.shrunk = np.maximum(values, 0)[:, None] + np.array(self.alphas)
        self.along = shadow[:, None] / self.shrunk
        self.g = None

    def squares(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Sum of each penalty's squared leave-one-out errors over rows that were learned from."""
        z = ((x - self.mean) * self.keep) @ self.vectors
        leverage = 1 / self.n + (z * z) @ (1 / self.shrunk)
        rest = y[:, None] - self.middle - z @ self.along
        return ((rest / np.maximum(1 - leverage, 1e-12)) ** 2).sum(axis=0)

    def best(self, squares: dict[int, float]) -> Ridge:
        by = {a: squares[i] / self.n for i, a in enumerate(self.alphas)}
        alpha = min(self.alphas, key=lambda a: (by[a], a))
        weights = (self.vectors @ self.along[:, self.alphas.index(alpha)]) * self.keep
        return Ridge(weights, float(self.middle - self.mean @ weights), alpha, by)


def fit(rows: DataFrame, features: str, label: str, alphas: tuple[float, ...] = ALPHAS) -> Ridge | None:
    """The regression on labels 0 and 1 (as -1 and 1); None without rows. Features without variance get no weight."""
    rows = rows.filter(F.col(label).isNotNull())
    first = rows.select(features).first()
    if first is None:
        return None
    pivot = np.asarray(first[0], float)
    path = _Path(gram(rows, features, label, pivot), pivot, alphas)

    def errors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(len(alphas))
        for batch in batches:
            if len(batch):
                total += path.squares(np.stack(batch["x"]), batch["y"].to_numpy())
        yield pd.DataFrame({"i": np.arange(len(alphas)), "e": total})

    found = rows.select(F.col(features).alias("x"), (2.0 * F.col(label) - 1).alias("y")).mapInPandas(errors, "i int, e double").groupBy("i").agg(F.sum("e").alias("e"))
    return path.best({r["i"]: r["e"] for r in found.collect()})  # one row for each penalty


@dataclass
class Model:
    """One of several regressions: it learns from the rows whose ``fold`` is another, and makes its features from their column."""

    fold: int
    features: Callable[[pd.Series], np.ndarray]
    #: A row of features to sum about.
    pivot: np.ndarray


def fit_together(rows: DataFrame, models: list[Model], x: str, fold: str, label: str, alphas: tuple[float, ...] = ALPHAS) -> list[Ridge | None]:
    """The ``fit`` of every model, all in two passes over ``rows``. Features are made when they are needed and stored nowhere."""
    known = rows.filter(F.col(label).isNotNull()).select(F.col(x).alias("x"), F.col(fold).cast("long").alias("fold"), (2.0 * F.col(label) - 1).alias("y"))
    shared = rows.sparkSession.sparkContext.broadcast(models)

    def each(batch: pd.DataFrame) -> Iterator[tuple[int, Model, np.ndarray, np.ndarray]]:
        for m, model in enumerate(shared.value):
            some = batch[(batch["fold"] != model.fold).to_numpy()]
            if len(some):
                yield m, model, model.features(some["x"]), some["y"].to_numpy()

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for m, model, found, y in each(batch):
                v = np.column_stack([found - model.pivot, y, np.ones(len(y))])
                totals[m] = totals.get(m, 0.0) + v.T @ v
        for m, total in totals.items():
            cells = total[np.triu_indices(len(total))]
            yield pd.DataFrame({"model": m, "cell": np.arange(len(cells)), "v": cells})

    sums = known.mapInPandas(partial, "model int, cell int, v double").groupBy("model", "cell").agg(F.sum("v").alias("v")).toArrow()  # half a matrix for each model
    of, cell, value = (sums.column(c).to_numpy() for c in ("model", "cell", "v"))
    paths: dict[int, _Path] = {}
    for m in np.unique(of).tolist():
        width = len(models[m].pivot) + 2
        upper, g, mine = np.triu_indices(width), np.zeros((width, width)), of == m
        g[upper[0][cell[mine]], upper[1][cell[mine]]] = value[mine]
        paths[m] = _Path(np.triu(g) + np.triu(g, 1).T, models[m].pivot, alphas)
    ways = rows.sparkSession.sparkContext.broadcast(paths)

    def errors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for m, _, found, y in each(batch):
                totals[m] = totals.get(m, 0.0) + ways.value[m].squares(found, y)
        for m, total in totals.items():
            yield pd.DataFrame({"model": m, "i": np.arange(len(alphas)), "e": total})

    squares: dict[int, dict[int, float]] = {}
    for r in known.mapInPandas(errors, "model int, i int, e double").groupBy("model", "i").agg(F.sum("e").alias("e")).collect():  # a row for each model and penalty
        squares.setdefault(r["model"], {})[r["i"]] = r["e"]
    return [paths[m].best(squares[m]) if m in paths else None for m in range(len(models))]
