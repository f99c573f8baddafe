"""Signal kernels and learners; SQL can't express them, so tests compare them with plain NumPy."""

from __future__ import annotations

from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F

from tidewater.functions.scalars import sigmoid
from tidewater.operators import folds as M, learners as L, ridge as R, signal as S, tensors as X, trees as T, windows as V
from tidewater.operators.windows import hashed_folds
from tidewater.sources.scratch import written
from tidewater.sources.tables import read, sensor

from .common import DAY, KEYS, SENSOR, shown, with_split
from .registry import query

_BANDS = {"lf": (0.04, 0.15), "hf": (0.15, 0.4)}


def _series(spark, sf_dir):
    return read(spark, sf_dir, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("x"))


@query("q_M1_band_powers")
def band_powers(spark, sf_dir):
    found = _series(spark, sf_dir).select("vec_id", S.bands_of(F.col("x"), _BANDS).alias("b"))
    return shown(found.select("vec_id", F.log1p("b.lf").alias("lf"), F.log1p("b.hf").alias("hf"), (F.col("b.lf") / (F.col("b.hf") + 1e-9)).alias("ratio")))


@query("q_M6_sample_entropy", """
WITH s AS (SELECT vec_id, unnest(range(len(embedding))) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings), t AS (SELECT vec_id, 0.2 * stddev_pop(v) AS r FROM s GROUP BY vec_id),
d AS (SELECT vec_id, b.i - a.i AS lag, a.i, abs(a.v - b.v) <= r AS near FROM s a JOIN s b USING (vec_id) JOIN t USING (vec_id) WHERE a.i < b.i),
w AS (SELECT vec_id, near, lead(near, 1) OVER o AS near1, lead(near, 2) OVER o AS near2 FROM d WINDOW o AS (PARTITION BY vec_id, lag ORDER BY i)),
c AS (SELECT vec_id, count_if(near AND near1) AS b, count_if(near AND near1 AND near2) AS a FROM w GROUP BY vec_id)
SELECT vec_id, round(CASE WHEN a > 0 AND b > 0 THEN -ln(a / b::DOUBLE) END, 6) AS entropy FROM embeddings LEFT JOIN c USING (vec_id)""")
def sample_entropy(spark, sf_dir):
    return shown(_series(spark, sf_dir).select("vec_id", S.on_series(S.sample_entropy, F.col("x")).alias("entropy")))


@query("q_M7_fluctuation_exponent", """
WITH s AS (SELECT vec_id, unnest(range(len(embedding))) AS i, unnest(embedding)::DOUBLE AS v, len(embedding) AS size FROM embeddings),
w AS (SELECT vec_id, i, size, sum(v - m) OVER (PARTITION BY vec_id ORDER BY i) AS walk FROM s JOIN (SELECT vec_id, avg(v) AS m FROM s GROUP BY vec_id) USING (vec_id)),
n AS (SELECT unnest([4, 5, 7, 9, 12, 16]) AS n),
g AS (SELECT vec_id, n, i // n AS part, var_pop(walk) - pow(covar_pop(walk, i), 2) / var_pop(i) AS rest FROM w, n WHERE i < size // n * n GROUP BY ALL),
f AS (SELECT vec_id, n, avg(sqrt(greatest(rest, 0))) AS f FROM g GROUP BY ALL)
SELECT vec_id, round(regr_slope(log10(f), log10(n)), 6) AS alpha FROM f GROUP BY vec_id""")
def fluctuation_exponent(spark, sf_dir):
    return shown(_series(spark, sf_dir).select("vec_id", S.on_series(S.fluctuation_exponent, F.col("x")).alias("alpha")))


def _table(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select(
        "doc_id", F.length("text").cast("double").alias("chars"), F.size(F.split("text", r"\s+")).cast("double").alias("words"),
        F.length(F.regexp_replace("text", "[^0-9]", "")).cast("double").alias("digits"), F.length(F.regexp_replace("text", r"[\p{L}\p{N}\s]", "")).cast("double").alias("marks"),
    )
    return written(docs.join(read(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id").withColumn("fold", hashed_folds("doc_id", 3)))


_COLUMNS = ["chars", "words", "digits", "marks"]


@query("q_M13_boosted_out_of_fold")
def boosted(spark, sf_dir):
    found = L.out_of_fold("boosted", _table(spark, sf_dir), "fold", 3, _COLUMNS, "quality", L.Settings(trees=8, depth=3, top_features=3))
    return shown(found.select("doc_id", "fold", "p"))


@query("q_M14_M17_linear_out_of_fold")
def linear(spark, sf_dir):
    return shown(L.out_of_fold("linear", _table(spark, sf_dir), "fold", 3, _COLUMNS, "quality").select("doc_id", "fold", "p"))


@query("q_M15_M16_forest_out_of_fold")
def forest(spark, sf_dir):
    return shown(L.out_of_fold("forest", _table(spark, sf_dir), "fold", 3, _COLUMNS, "quality", L.Settings(trees=10, depth=3)).select("doc_id", "fold", "p"))


@query("q_M21_platt")
def platt(spark, sf_dir):
    table = _table(spark, sf_dir).withColumn("raw", F.least(F.col("marks") / F.greatest("chars", F.lit(1.0)), F.lit(1.0)))
    return shown(L.calibrated(table.filter("fold > 0"), table.filter("fold = 0"), "raw", "quality").select("doc_id", "raw", "p"))


SEEDS = (42, 43, 44, 45, 46)


class _Features:
    """Features of a column of series by random convolutions."""

    def __init__(self, model: S.RandomConvolutions) -> None:
        self.model = model

    def __call__(self, x: pd.Series) -> np.ndarray:
        return self.model.many(S.series_of(x))


def _scores(spark, models: list[R.Model], fits: list[R.Ridge | None], x: Column) -> Column:
    """Every model's score of a series, in order."""
    shared = spark.sparkContext.broadcast([(m.features, f and (f.weights, f.base)) for m, f in zip(models, fits, strict=True)])

    @F.pandas_udf("array<double>")
    def run(s: pd.Series) -> pd.Series:
        columns = [features(s) @ fit[0] + fit[1] if fit else np.zeros(len(s)) for features, fit in shared.value]
        return pd.Series(list(np.column_stack(columns)), dtype=object)

    return run(x)


def _convolutions(rows, folds: int, seeds: tuple[int, ...], features: int, keys: list[str]):
    """keys, fold, p: mean over seeds of ridge scores of random convolutions, calibrated, by models that saw no row of the fold.

    The models of all folds and seeds are fitted and score together; the calibrations of a fold's models are fitted together.
    """
    # Series are few bytes and much work, so they are dealt out however small their files are.
    spark, models, found = rows.sparkSession, [], None
    rows = written(rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *keys))
    for fold in range(folds):
        # The biases are drawn from at most 200 training series.
        drawn = rows.filter(F.col("fold") != fold).orderBy(F.xxhash64(*keys)).limit(200).select("x").collect()
        sample = S.series_of(pd.Series([r["x"] for r in drawn], dtype=object))
        for seed in seeds if sample else ():
            made = S.RandomConvolutions(sample, features=features, seed=seed)
            models.append(R.Model(fold, _Features(made), made(sample[0])))
    if models:
        fits = R.fit_together(rows, models, "x", "fold", "y")
        each = rows.select(*keys, "y", "fold", F.posexplode(_scores(spark, models, fits, F.col("x"))).alias("model", "score"))
        scores = written(each.select(*keys, "y", "fold", "model", F.get(F.array(*(F.lit(m.fold) for m in models)), F.col("model")).alias("of"), sigmoid(F.col("score")).alias("p")))
    for fold in range(folds):
        if any(m.fold == fold for m in models):
            scored = scores.filter(F.col("of") == fold)
            one = L.fit_predict("platt", scored.filter(F.col("fold") != fold), scored.filter(F.col("fold") == fold), ["p"], "y", by="model").select(*keys, "fold", "p")
        else:
            one = rows.filter(F.col("fold") == fold).select(*keys, "fold", F.lit(0.5).alias("p"))
        found = one if found is None else found.unionByName(one)
    return found.groupBy(*keys, "fold").agg(F.avg("p").alias("p"))


@query("q_M22_convolutions_ridge_platt")
def convolutions(spark, sf_dir, folds=6, seeds=SEEDS, features=168):
    """Random convolution features of each series, ridge scores, and their calibration, for label 0 against the rest."""
    rows = written(_series(spark, sf_dir).withColumn("y", (F.col("label") == 0).cast("int")).withColumn("fold", hashed_folds("vec_id", folds)))
    return shown(_convolutions(rows, folds, seeds, features, ["vec_id"]))


@query("q_M22_channels_leave_one_out")
def channels(spark, sf_dir, folds=6, seeds=(42,), features=168):
    """The night's tensor of each day, two channels of 108 bins, predicts the day's label; folds are blocks of time."""
    events = read(spark, sf_dir, "events")
    bins = {"level": X.binned(events, "user_id", "ts", "value"), "rows": X.binned(events, "user_id", "ts", "value", "count")}
    days = sensor(spark, sf_dir).groupBy(*KEYS).agg((F.avg("value") > 12).cast("int").alias("y"))
    rows = V.blocked_folds(X.tensor(days, KEYS, bins).join(days, KEYS), "user_id", ["day"], folds)
    rows = rows.select(*KEYS, "y", "fold", F.array(*(F.transform(c, lambda v: v.cast("double")) for c in bins)).alias("x"))
    return shown(_convolutions(written(rows), folds, seeds, features, KEYS))


_FOLD_ROWS = """d AS (SELECT user_id, day, (avg(value) > 12)::INT AS y, (count(*) > 2)::INT AS many, count(*)::DOUBLE AS n, CASE WHEN max(h) % 5 > 0 THEN avg(k)::DOUBLE END AS k_mean, day <= DATE '2024-01-20' AS train, (user_id + dayofyear(day))::INT AS turn FROM s GROUP BY ALL),
m AS (SELECT unnest([42, 43]) AS seed), f AS (SELECT unnest(range(5)) AS model),
e AS (SELECT d.*, seed, model, CASE WHEN NOT train THEN 'sub' WHEN turn * (seed - 41) % 5 = model THEN 'oof' ELSE 'train' END AS role FROM d, m, f)"""


def _fold_rows(spark, sf_dir):
    days = sensor(spark, sf_dir).groupBy(*KEYS).agg(
        (F.avg("value") > 12).cast("int").alias("y"), (F.count(F.lit(1)) > 2).cast("int").alias("many"), F.count(F.lit(1)).cast("double").alias("n"),
        F.when(F.max("h") % 5 > 0, F.avg("k")).alias("k_mean"),
    )
    days = written(with_split(days).withColumn("turn", (F.col("user_id") + F.dayofyear("day")).cast("int")))
    train, sub = (days.filter(F.col("split") == s).drop("split") for s in ("train", "sub"))
    return M.expanded(train, sub.withColumns({c: F.lit(None).cast("int") for c in ("y", "many")}), 5, (42, 43), lambda s: F.col("turn") * (s - 41) % 5)


@query("q_M17_base_rate_out_of_fold", f"""
WITH {SENSOR}, {_FOLD_ROWS}, l AS (SELECT *, 'y' AS label, y AS v FROM e UNION ALL SELECT *, 'many', many FROM e),
o AS (SELECT seed, model, label, user_id, avg(v) AS own FROM l WHERE role = 'train' GROUP BY ALL), a AS (SELECT seed, model, label, avg(v) AS every FROM l WHERE role = 'train' GROUP BY ALL)
SELECT user_id, {DAY}, label, role, round(avg(coalesce(own, every)), 6) AS p FROM l LEFT JOIN o USING (seed, model, label, user_id) JOIN a USING (seed, model, label) WHERE role <> 'train' GROUP BY user_id, day, label, role""")
def base_rate_out_of_fold(spark, sf_dir):
    """Two labels, two seeds, five folds: training rows by the models that did not see them, the later days by all."""
    return shown(M.run(written(_fold_rows(spark, sf_dir)), M.base_rate("user_id"), [], ["y", "many"], KEYS))


@query("q_M17_transforms_per_fold", f"""
WITH {SENSOR}, {_FOLD_ROWS}, q AS (SELECT seed, model, quantile_cont(k_mean, 0.5) AS mid FROM e WHERE role = 'train' GROUP BY ALL),
b AS (SELECT seed, model, user_id, avg(coalesce(k_mean, mid)) AS own FROM e JOIN q USING (seed, model) WHERE role = 'train' GROUP BY ALL),
w AS (SELECT e.*, coalesce(own, mid) AS kb, coalesce(k_mean, own, mid) - coalesce(own, mid) AS kw FROM e JOIN q USING (seed, model) LEFT JOIN b USING (seed, model, user_id)),
z AS (SELECT seed, model, avg(kw) AS m, stddev_pop(kw) AS sd FROM w WHERE role = 'train' GROUP BY ALL),
x AS (SELECT w.*, (kw - m) / sd AS kz FROM w JOIN z USING (seed, model)),
g AS (SELECT seed, model, regr_slope(y, kz) AS slope, regr_intercept(y, kz) AS base FROM x WHERE role = 'train' GROUP BY ALL)
SELECT user_id, {DAY}, 'y' AS label, role, round(avg(least(greatest(base + slope * kz, 0.000001), 0.999999)), 6) AS p FROM x JOIN g USING (seed, model) WHERE role <> 'train' GROUP BY user_id, day, role""")
def transforms_per_fold(spark, sf_dir):
    """Means within and between subjects and scaling, each fitted on a model's training rows, then a regression."""
    rows = M.transformed(_fold_rows(spark, sf_dir), [M.Mundlak(["k_mean"], "user_id"), M.Scaled(["k_mean_w"])])
    return shown(M.run(written(rows), M.least_squares(), ["k_mean_w"], ["y"], KEYS))


def _labelled(spark, sf_dir, folds, seeds):
    """Labelled documents, those of the last source as the hold-out split."""
    table = _table(spark, sf_dir).drop("fold").join(read(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    table = written(table.withColumn("digits", F.when(F.col("doc_id") % 7 > 0, F.col("digits"))))
    apart = F.col("source") == "src9"
    fold = lambda s: F.pmod(F.xxhash64("doc_id", F.lit(s)), F.lit(folds)).cast("int")
    return M.expanded(table.filter(~apart), table.filter(apart).withColumn("quality", F.lit(None).cast("int")), folds, seeds, fold)


@query("q_M13_leafwise_out_of_fold")
def leafwise(spark, sf_dir, folds=5, seeds=(42,), trees=3):
    """Boosting by leaves in two stages: a quick fit selects among the counts, the full one stops by the held rows' loss."""
    rows = _labelled(spark, sf_dir, folds, seeds)
    fast, full = (replace(s, trees=trees, leaves=6, rate=0.2) for s in (T.FAST, T.FULL))
    return shown(M.run(rows, T.boosted_in_two_stages(["chars", "words"], 1, fast, full), _COLUMNS, ["quality"], ["doc_id"]))


@query("q_M15_extra_trees_out_of_fold")
def extra_trees(spark, sf_dir, folds=5, seeds=(42,), trees=20):
    """Extremely randomised trees on medians filled per fold."""
    rows = M.transformed(_labelled(spark, sf_dir, folds, seeds), [M.Imputed(_COLUMNS)])
    return shown(M.run(rows, T.extra_trees(T.Extra(trees=trees, depth=6)), _COLUMNS, ["quality"], ["doc_id"]))
