"""Predictions out of fold and for a hold-out split, with every transform fitted per fold.

``expanded`` gives each row once for each model (a seed and a fold): in the role ``train`` where the model may learn from it,
``oof`` where the model's fold is the row's own, and ``sub`` for the rows of the hold-out split. A transform learns from the
training rows of all models at once; what it learned is a table keyed by the model, which ``apply`` joins to all rows. A
learner takes the same table and returns the rows of the roles ``oof`` and ``sub`` with ``p``. So the number of jobs does not
grow with the number of folds and seeds, and no row is seen by a model that predicts it.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from tidewater.functions.scalars import clip
from tidewater.sources.scratch import written

from .ranks import percentiles

#: What a model is keyed by.
MODEL = ["seed", "model"]
Learner = Callable[[DataFrame, list[str], str], DataFrame]


def expanded(train: DataFrame, sub: DataFrame, folds: int, seeds: Sequence[int], fold: Callable[[int], Column]) -> DataFrame:
    """All rows of both tables for each model, with seed, model and role. ``fold(seed)`` is a training row's fold, 0 to ``folds`` - 1."""
    models = F.explode(F.array(*(F.struct(F.lit(s).alias("seed"), F.lit(m).alias("model")) for s in seeds for m in range(folds))))
    each = lambda df: df.withColumn("__m", models).select("*", "__m.seed", "__m.model").drop("__m")
    own = reduce(lambda out, s: F.when(F.col("seed") == s, fold(s)).otherwise(out), seeds, F.lit(None).cast("int"))
    a = each(train).withColumn("role", F.when(own == F.col("model"), "oof").otherwise("train"))
    return a.unionByName(each(sub).withColumn("role", F.lit("sub")), allowMissingColumns=True)


def training(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("role") == "train")


def _long(rows: DataFrame, columns: Sequence[str], *keys: str) -> DataFrame:
    """A row for each cell: keys, column, v."""
    return rows.select(*MODEL, *keys, F.inline(F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("double").alias("v")) for c in columns))))


def _by_column(cells: DataFrame, *keys: str, value: str = "p", name: str = "state") -> DataFrame:
    """A map from column to value for each model (and key)."""
    return cells.groupBy(*MODEL, *keys).agg(F.map_from_entries(F.collect_list(F.struct("column", value))).alias(name))


@dataclass
class Imputed:
    """Missing values become the median of the model's training rows, or 0 without one."""

    columns: Sequence[str]

    def fit(self, rows: DataFrame) -> DataFrame:
        return _by_column(percentiles(_long(rows, self.columns), [*MODEL, "column"], "v", 0.5))

    def apply(self, rows: DataFrame, state: DataFrame) -> DataFrame:
        fill = {c: F.coalesce(F.col(c).cast("double"), F.try_element_at("state", F.lit(c)), F.lit(0.0)) for c in self.columns}
        return rows.join(state, MODEL, "left").withColumns(fill).drop("state")


@dataclass
class Scaled:
    """(x - mean) / population deviation of the model's training rows; a column without variance becomes 0."""

    columns: Sequence[str]

    def fit(self, rows: DataFrame) -> DataFrame:
        moments = _long(rows, self.columns).groupBy(*MODEL, "column").agg(F.struct(F.avg("v").alias("m"), F.stddev_pop("v").alias("s")).alias("p"))
        return _by_column(moments)

    def apply(self, rows: DataFrame, state: DataFrame) -> DataFrame:
        of = lambda c: F.try_element_at("state", F.lit(c))
        scaled = {c: F.when(of(c)["s"] > 0, (F.col(c).cast("double") - of(c)["m"]) / of(c)["s"]).when(F.col(c).isNotNull(), 0.0) for c in self.columns}
        return rows.join(state, MODEL, "left").withColumns(scaled).drop("state")


@dataclass
class Mundlak:
    """Adds each column as its subject's mean over the model's training rows (``_b``) and the deviation from it (``_w``).

    Missing values count as the training median in the means and as the subject's mean in the deviation; a subject without
    training rows has the median as its mean.
    """

    columns: Sequence[str]
    subject: str

    @property
    def added(self) -> list[str]:
        return [*(f"{c}_w" for c in self.columns), *(f"{c}_b" for c in self.columns)]

    def fit(self, rows: DataFrame) -> DataFrame:
        """A row for each model and subject, and one with a null subject and ``every`` for the medians."""
        middle = percentiles(_long(rows, self.columns), [*MODEL, "column"], "v", 0.5)
        cells = _long(rows, self.columns, self.subject).join(middle, [*MODEL, "column"], "left")
        means = cells.groupBy(*MODEL, self.subject, "column").agg(F.avg(F.coalesce("v", "p", F.lit(0.0))).alias("p"))
        own = _by_column(means, self.subject).withColumn("every", F.lit(False))
        return own.unionByName(_by_column(middle).withColumn("every", F.lit(True)), allowMissingColumns=True)

    def apply(self, rows: DataFrame, state: DataFrame) -> DataFrame:
        own = state.filter(~F.col("every")).select(*(F.col(c).alias(f"__{c}") for c in (*MODEL, self.subject)), F.col("state").alias("__own"))
        every = state.filter("every").select(*MODEL, F.col("state").alias("__every"))
        same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in (*MODEL, self.subject)]
        joined = rows.join(own, same, "left").drop(*(f"__{c}" for c in (*MODEL, self.subject))).join(every, MODEL, "left")
        of = lambda c: F.coalesce(F.try_element_at("__own", F.lit(c)), F.try_element_at("__every", F.lit(c)), F.lit(0.0))
        between = {f"{c}_b": of(c) for c in self.columns}
        within = {f"{c}_w": F.coalesce(F.col(c).cast("double"), of(c)) - of(c) for c in self.columns}
        return joined.withColumns({**between, **within}).drop("__own", "__every")


def transformed(rows: DataFrame, steps: Sequence) -> DataFrame:
    """``rows`` after each step, fitted on the training rows as the steps before left them."""
    for step in steps:
        rows = written(rows)
        rows = step.apply(rows, written(step.fit(training(rows))))
    return rows


def base_rate(subject: str) -> Learner:
    """The subject's rate of the label, or that of all, or 0.5."""

    def learn(rows: DataFrame, features: list[str], label: str) -> DataFrame:
        known = training(rows).filter(F.col(label).isNotNull())
        own = known.groupBy(*MODEL, subject).agg(F.avg(label).alias("__own"))
        every = known.groupBy(*MODEL).agg(F.avg(label).alias("__every"))
        asked = rows.filter("role <> 'train'").join(own, [*MODEL, subject], "left").join(every, MODEL, "left")
        return asked.withColumn("p", F.coalesce("__own", "__every", F.lit(0.5))).drop("__own", "__every")

    return learn


def least_squares(penalty: float = 0.0, eps: float = 1e-6) -> Learner:
    """Linear regression on the label, kept within (0, 1); missing values are 0.

    The normal equations of all models are one aggregate; a matrix of the number of features squared for each is collected.
    """

    def learn(rows: DataFrame, features: list[str], label: str) -> DataFrame:
        x = [F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)) for c in features] + [F.lit(1.0)]
        y, d = F.col(label).cast("double"), len(features) + 1
        sums = [F.sum(x[i] * (x[j] if j < d else y)) for i in range(d) for j in range(i, d + 1)]
        found = []
        for r in training(rows).filter(y.isNotNull()).groupBy(*MODEL).agg(F.array(*sums).alias("s")).collect():
            cells, a, b = iter(r["s"]), np.zeros((d, d)), np.zeros(d)
            for i in range(d):
                for j in range(i, d):
                    a[i, j] = a[j, i] = next(cells)
                b[i] = next(cells)
            a[np.arange(d - 1), np.arange(d - 1)] += penalty
            found.append((r["seed"], r["model"], [float(v) for v in np.linalg.lstsq(a, b, rcond=None)[0]]))
        state = rows.sparkSession.createDataFrame(found, "seed int, model int, __w array<double>")
        score = reduce(lambda s, i: s + F.get("__w", i) * x[i], range(1, d), F.get("__w", 0) * x[0])
        asked = rows.filter("role <> 'train'").join(F.broadcast(state), MODEL, "left")
        return asked.withColumn("p", clip(F.coalesce(score, F.lit(0.5)), eps, 1 - eps)).drop("__w")

    return learn


def averaged(predicted: DataFrame, keys: list[str]) -> DataFrame:
    """keys, role, p: of training rows the mean over seeds, each by the one model that did not see it; of others that over all models."""
    return predicted.groupBy(*keys, "role").agg(F.avg("p").alias("p"))


def run(rows: DataFrame, learner: Learner, features: list[str], labels: Sequence[str], keys: list[str]) -> DataFrame:
    """keys, label, role (oof or sub) and p for every label; ``rows`` as ``expanded`` and ``transformed`` leave them."""
    found = [averaged(learner(rows, features, label), keys).withColumn("label", F.lit(label)) for label in labels]
    return reduce(DataFrame.unionByName, found)
