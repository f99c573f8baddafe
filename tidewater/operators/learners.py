"""Learners behind one interface, and out-of-fold prediction. All fit on Spark with its ML library.

``fit_predict(kind, train, rows, features, label)`` adds column ``p`` to ``rows``. Folds are a column of the data; each
fold's model is fitted on the rows of the others. Differences from the reference's learners: boosted trees grow by depth,
and extremely randomised trees are a random forest.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from tidewater.functions.scalars import clip, logit

from .ranks import column_percentiles
from .ridge import ALPHAS, fit as fit_ridge
from .stats import calibrated_by, standardised


@dataclass
class Settings:
    """Parameters of the learners; defaults are for quick fits."""

    trees: int = 20
    depth: int = 4
    rate: float = 0.1
    rows_share: float = 0.8
    inverse_penalty: float = 0.2
    l1_share: float = 0.5
    iterations: int = 50
    seeds: tuple[int, ...] = field(default_factory=lambda: (42,))
    top_features: int = 0
    #: Share of the training rows, drawn by hash, on which boosting stops early, and the gain that goes on.
    held_share: float = 0.15
    least_gain: float = 0.001


def _imputed(train: DataFrame, rows: DataFrame, features: list[str]) -> tuple[DataFrame, DataFrame]:
    """Missing values become the training median, or 0 without one; columns without variance need no care here."""
    middle = column_percentiles(train, features, 0.5)
    fill = {c: F.coalesce(F.col(c).cast("double"), F.lit(float(middle[c] or 0.0))) for c in features}
    return train.withColumns(fill), rows.withColumns(fill)


def _scaled(train: DataFrame, rows: DataFrame, features: list[str]) -> tuple[DataFrame, DataFrame]:
    s = train.agg(*(F.avg(c).alias(f"m_{c}") for c in features), *(F.stddev_pop(c).alias(f"s_{c}") for c in features)).first()
    by = {c: (F.col(c) - F.lit(s[f"m_{c}"])) / F.lit(s[f"s_{c}"] or 1.0) for c in features}
    return train.withColumns(by), rows.withColumns(by)


def make(kind: str, s: Settings, n: int, seed: int):
    """A classifier by name: boosted, linear (elastic net), forest or platt (nearly unpenalised logistic)."""
    common = {"featuresCol": "__x", "labelCol": "__y", "probabilityCol": "__p"}
    if kind == "boosted":
        return GBTClassifier(**{k: v for k, v in common.items() if k != "probabilityCol"}, maxIter=s.trees, maxDepth=s.depth, stepSize=s.rate, subsamplingRate=s.rows_share, seed=seed, validationIndicatorCol="__held", validationTol=s.least_gain)
    if kind == "forest":
        return RandomForestClassifier(**common, numTrees=s.trees, maxDepth=s.depth, seed=seed)
    if kind == "linear":
        return LogisticRegression(**common, regParam=1 / (s.inverse_penalty * n), elasticNetParam=s.l1_share, maxIter=s.iterations, standardization=False)
    if kind == "platt":
        return LogisticRegression(**common, regParam=1 / (1e6 * n), elasticNetParam=0.0, maxIter=s.iterations, standardization=False)
    raise ValueError(f"no learner {kind}")


def fit_predict(kind: str, train: DataFrame, rows: DataFrame, features: list[str], label: str, settings: Settings | None = None, seed: int = 42, by: str | None = None) -> DataFrame:
    """``rows`` with ``p``. With one class, or nothing, to learn from, ``p`` is the base rate (0.5 for nothing).

    With ``by``, Platt's fits of all its groups are made together, each from its group's ``p``, the only feature.
    """
    if by is not None:
        if kind != "platt" or features != ["p"]:
            raise ValueError("only Platt's fit of p goes by groups")
        return calibrated_by(rows, by, "p", label, train=train)
    s = settings or Settings()
    known = train.filter(F.col(label).isNotNull()).withColumn("__y", F.col(label).cast("double"))
    base = known.agg(F.count(F.lit(1)).alias("n"), F.avg("__y").alias("p")).first()
    if not base["n"] or base["p"] in (0.0, 1.0):
        return rows.withColumn("p", F.lit(float(base["p"] if base["n"] else 0.5)))
    # Filled and scaled copies, so the columns of ``rows`` stay as they are.
    copies = [f"__f{i}" for i in range(len(features))]
    copy = dict(zip(copies, (F.col(c) for c in features), strict=True))
    a, b = _imputed(known.withColumns(copy), rows.withColumns(copy), copies)
    if kind in ("linear", "platt"):
        a, b = _scaled(a, b, copies)
    if kind == "boosted":
        a = a.withColumn("__held", F.pmod(F.xxhash64(*copies, F.lit(seed)), F.lit(1000)) < int(1000 * s.held_share))
    if s.top_features and s.top_features < len(copies) and kind == "boosted":
        quick = make(kind, Settings(trees=5, depth=s.depth, rate=0.3), base["n"], seed).fit(VectorAssembler(inputCols=copies, outputCol="__x").transform(a))
        order = np.argsort(-quick.featureImportances.toArray(), kind="stable")[: s.top_features]
        chosen = [copies[i] for i in sorted(order)]
    else:
        chosen = copies
    vectors = VectorAssembler(inputCols=chosen, outputCol="__x")
    model = make(kind, s, base["n"], seed).fit(vectors.transform(a))
    out = model.transform(vectors.transform(b))
    column = "probability" if kind == "boosted" else "__p"
    return out.select(*rows.columns, vector_to_array(column)[1].alias("p"))


def out_of_fold(kind: str, df: DataFrame, fold: str, folds: int, features: list[str], label: str, settings: Settings | None = None) -> DataFrame:
    """Prediction of every row by models that saw none of its fold, averaged over seeds by the columns of ``df``."""
    s = settings or Settings()
    found = None
    for i in range(folds):
        rows = df.filter(F.col(fold) == i)
        for seed in s.seeds:
            one = fit_predict(kind, df.filter(F.col(fold) != i), rows, features, label, s, seed)
            found = one if found is None else found.unionByName(one)
    return found if len(s.seeds) == 1 else found.groupBy(*df.columns).agg(F.avg("p").alias("p"))


def calibrated(train: DataFrame, rows: DataFrame, p: str, label: str, eps: float = 1e-6) -> DataFrame:
    """``rows`` with ``p`` replaced by Platt's fit on the logit of the training rows' ``p``."""
    score = lambda df: df.withColumn("__score", logit(clip(F.col(p), eps, 1 - eps)))
    return fit_predict("platt", score(train), score(rows).drop(*(["p"] if p == "p" else [])), ["__score"], label).drop("__score")


def ridge_scores(train: DataFrame, rows: DataFrame, features: str, label: str, alphas: tuple[float, ...] = ALPHAS) -> DataFrame:
    """``rows`` with ``score``: ridge regression on a feature array, standardised, the penalty chosen by leave-one-out errors."""
    model = fit_ridge(train, features, label, alphas)
    return rows.withColumn("score", model.score(features) if model else F.lit(0.0))


__all__ = ["Settings", "calibrated", "fit_predict", "make", "out_of_fold", "ridge_scores", "standardised"]
