"""Statistics across subjects, blends of predictions, neighbour smoothing."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from tidewater.functions.scalars import clip, logit, sigmoid
from tidewater.sources.scratch import written

from .joins import nearest
from .neighbours import nearest_of_all, nearest_stated
from .ranks import column_percentiles, spearman


def pairwise(df: DataFrame, columns: list[str]) -> DataFrame:
    """Products (a_x_b) and differences (a_d_b) of every two columns."""
    pairs = list(combinations(columns, 2))
    return df.withColumns({f"{a}_x_{b}": F.col(a) * F.col(b) for a, b in pairs} | {f"{a}_d_{b}": F.col(a) - F.col(b) for a, b in pairs})


def cross_bucket(df: DataFrame, by_bucket: dict[str, dict[str, str]]) -> DataFrame:
    """Products of different sensors in different parts of the day, and one sensor's differences between parts.

    ``by_bucket``: sensor -> part -> column.
    """
    out = {}
    for (s, own), (t, other) in combinations(by_bucket.items(), 2):
        out |= {f"{s}_{a}_x_{t}_{b}": F.col(x) * F.col(y) for a, x in own.items() for b, y in other.items() if a != b}
    for s, own in by_bucket.items():
        out |= {f"{s}_{a}_d_{b}": F.col(x) - F.col(y) for (a, x), (b, y) in combinations(own.items(), 2)}
    return df.withColumns(out)


def within_between(long: DataFrame, subject: str, feature: str, x: str, y: str, least: float = 0.1, rich: float = 0.7, between: float = 0.3) -> DataFrame:
    """Raw and subject-demeaned rank correlation of each feature with the label, and the class they put it in.

    ``long``: a row per subject, day and feature.
    """
    both = long.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    means = both.groupBy(subject, feature).agg(F.avg(x).alias("__x"), F.avg(y).alias("__y"))
    # Rounded, so that values that differ by arithmetic noise only tie.
    inner = both.join(means, [subject, feature]).select(feature, F.round(F.col(x) - F.col("__x"), 9).alias(x), F.round(F.col(y) - F.col("__y"), 9).alias(y))
    # Both correlations from one table, told apart by a flag.
    rows = both.select(feature, x, y, F.lit(False).alias("__inner")).unionByName(inner.withColumn("__inner", F.lit(True)))
    found = spearman(rows, [feature, "__inner"], x, y).groupBy(feature).agg(
        F.max(F.when(~F.col("__inner"), F.col("r"))).alias("raw"), F.max(F.when(~F.col("__inner"), F.col("n"))).alias("n"), F.max(F.when(F.col("__inner"), F.col("r"))).alias("within")
    )
    r, w = F.abs(F.col("raw")), F.abs(F.coalesce("within", F.lit(0.0)))
    kind = F.when(F.col("raw").isNull() | (r < least), "weak").when(w >= rich * r, "day_rich").when(w <= between * r, "between_only").otherwise("mixed")
    return found.withColumn("kind", kind)


def mundlak(train: DataFrame, df: DataFrame, subject: str, columns: list[str]) -> DataFrame:
    """Each column as its subject's training mean (the training median for new subjects) and the deviation from it."""
    means = train.groupBy(subject).agg(*(F.avg(c).alias(f"{c}_b") for c in columns))
    middle = column_percentiles(train, columns, 0.5)
    joined = df.join(means, subject, "left").withColumns({f"{c}_b": F.coalesce(f"{c}_b", F.lit(middle[c])) for c in columns})
    return joined.withColumns({f"{c}_w": F.col(c) - F.col(f"{c}_b") for c in columns})


def sign_stability(long: DataFrame, fold: str, feature: str, x: str, y: str) -> DataFrame:
    """Median correlation over folds, and the share of folds that agree with its sign."""
    per = spearman(long, [feature, fold], x, y)
    mid = per.groupBy(feature).agg(F.percentile("r", 0.5).alias("median_r"))
    return per.join(mid, feature).groupBy(feature).agg(
        F.max("median_r").alias("median_r"), F.avg(F.coalesce(F.signum("r") == F.signum("median_r"), F.lit(False)).cast("double")).alias("agree")
    )


def log_loss(y: Column, p: Column, eps: float = 1e-15) -> Column:
    """Aggregate: mean log-loss of clipped probabilities."""
    q = clip(p, eps, 1 - eps)
    return -F.avg(y * F.log(q) + (1 - y) * F.log(1 - q))


def blend_weight(m: Column, n: Column, y: Column, eps: float = 1e-12) -> Column:
    """Aggregate: weight of ``n`` in the convex blend with ``m`` that has the least error variance, within [0, 1]."""
    a, b = m - y, n - y
    va, vb, c = F.var_pop(a), F.var_pop(b), F.covar_pop(a, b)
    return clip((va - c) / (va + vb - 2 * c + eps), 0.0, 1.0)


def blend_out_of_fold(df: DataFrame, fold: str, label: str, m: str, n: str, y: str) -> DataFrame:
    """Blend in which each fold's weight comes from the other folds, and that of rows without a fold from all.

    Moments are summed once per (label, fold), of rows that have a fold; a fold's own are taken off the total, so data are read once.
    """
    a, b = F.col(m) - F.col(y), F.col(n) - F.col(y)
    parts = {"k": F.lit(1.0), "a": a, "b": b, "aa": a * a, "bb": b * b, "ab": a * b}
    per = df.filter(F.col(fold).isNotNull()).groupBy(label, fold).agg(*(F.sum(v).alias(f"f_{k}") for k, v in parts.items()))
    whole = per.groupBy(label).agg(*(F.sum(f"f_{k}").alias(f"t_{k}") for k in parts))
    none = whole.select(label, F.lit(None).cast(dict(df.dtypes)[fold]).alias(fold), *(F.lit(0.0).alias(f"f_{k}") for k in parts))
    per = per.unionByName(none)
    rest = {k: F.col(f"t_{k}") - F.col(f"f_{k}") for k in parts}
    va, vb = rest["aa"] / rest["k"] - (rest["a"] / rest["k"]) ** 2, rest["bb"] / rest["k"] - (rest["b"] / rest["k"]) ** 2
    cov = rest["ab"] / rest["k"] - rest["a"] * rest["b"] / rest["k"] / rest["k"]
    weight = F.when(rest["k"] > 0, clip((va - cov) / (va + vb - 2 * cov + 1e-12), 0.0, 1.0)).otherwise(0.0)
    weights = per.join(whole, label).select(F.col(label).alias("__label"), F.col(fold).alias("__fold"), weight.alias("alpha"))
    same = F.col(label).eqNullSafe(F.col("__label")) & F.col(fold).eqNullSafe(F.col("__fold"))
    joined = df.join(weights, same, "left").drop("__label", "__fold").withColumn("alpha", F.coalesce("alpha", F.lit(0.0)))
    return joined.withColumn("blend", (1 - F.col("alpha")) * F.col(m) + F.col("alpha") * F.col(n))


def error_moments(df: DataFrame, views: list[str], y: str) -> tuple[int, np.ndarray, float]:
    """Rows, population covariance of the views' errors, and the sum of squared sample deviations that shrinking needs.

    One pass for second moments and one for the fourth: a few numbers reach the driver.
    """
    errors = df.select(*((F.col(v) - F.col(y)).alias(v) for v in views))
    m = len(views)
    first = errors.agg(F.count(F.lit(1)).alias("n"), *(F.avg(v).alias(f"m{i}") for i, v in enumerate(views)), *(F.covar_pop(a, b).alias(f"c{i}_{j}") for i, a in enumerate(views) for j, b in enumerate(views) if i <= j)).first()
    cov = np.array([[first[f"c{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(m)] for i in range(m)])
    centred = [F.col(v) - F.lit(first[f"m{i}"] or 0.0) for i, v in enumerate(views)]
    # sum over rows of |x x' - S|^2 = sum |x|^4 - n |S|^2
    square = sum((c * c for c in centred), F.lit(0.0))
    fourth = errors.agg(F.sum(square * square).alias("q")).first()["q"] or 0.0
    return first["n"], cov, fourth - first["n"] * float((cov**2).sum())


def simplex_weights(df: DataFrame, views: list[str], y: str, shrink: bool = True) -> np.ndarray:
    """Convex weights of views from their (Ledoit-Wolf shrunk) error covariance: solve S q = 1, drop negatives, normalise."""
    m = len(views)
    if m == 1:
        return np.ones(1)
    n, cov, spread = error_moments(df, views, y)
    if shrink and n:
        mu = np.trace(cov) / m
        target = mu * np.eye(m)
        distance = float(((cov - target) ** 2).sum())
        share = min(1.0, max(0.0, spread / n / n / distance)) if distance > 0 else 0.0
        cov = (1 - share) * cov + share * target
    q = np.maximum(np.linalg.lstsq(cov, np.ones(m), rcond=None)[0], 0)
    return q / q.sum() if q.sum() > 0 else np.full(m, 1 / m)


def blend_with_prior(p: Column, prior: Column, weight: float | Column) -> Column:
    """Mix with the temporal prior; rows without one keep the model's value."""
    w = F.lit(weight) if isinstance(weight, float) else weight
    return F.when(prior.isNull(), p).otherwise((1 - w) * p + w * prior)


def platt(p: Column, a: float, b: float, eps: float = 1e-6) -> Column:
    return sigmoid(F.lit(a) * logit(clip(p, eps, 1 - eps)) + F.lit(b))


def standardised(df: DataFrame, columns: list[str], bound: float = 3.0) -> DataFrame:
    """(x - mean) / population deviation within ``bound``; missing values are 0 before, columns without variance 0 after."""
    filled = df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns})
    s = filled.agg(*(F.avg(c).alias(f"m_{c}") for c in columns), *(F.stddev_pop(c).alias(f"s_{c}") for c in columns)).first()
    return filled.withColumns({
        c: clip((F.col(c) - F.lit(s[f"m_{c}"])) / F.lit(s[f"s_{c}"]), -bound, bound) if s[f"s_{c}"] else F.lit(0.0) for c in columns
    })


def borrow(queries: DataFrame, known: DataFrame, k: int, value: str, weighting: str = "uniform", metric: str = "manhattan", search: Callable[..., DataFrame] = nearest) -> DataFrame:
    """Mean of ``value`` over the ``k`` nearest known rows: query, borrowed. Both have id and x (array).

    ``search`` is ``nearest`` for a stated set of queries, or ``all_rows`` for any number of them.
    """
    near = search(queries, known.select("id", "x"), k, metric).join(known.select(F.col("id").alias("item"), value), "item")
    w = F.lit(1.0) if weighting == "uniform" else 1 / F.pow(F.col("distance") + 1e-6, F.lit(2.0))
    return near.groupBy("query").agg((F.sum(w * F.col(value)) / F.sum(w)).alias("borrowed"))


def all_rows(queries: DataFrame, items: DataFrame, k: int, metric: str = "manhattan") -> DataFrame:
    if metric != "manhattan":
        raise ValueError("neighbours of all rows are found by Manhattan distance")
    return nearest_of_all(queries, items, k)


def random_subsets(width: int, members: int = 50, share: float = 0.8, seed: int = 0) -> list[list[int]]:
    """Sorted random subsets of ``width`` coordinates, a share of them and at least five."""
    rng = np.random.default_rng(seed)
    size = min(width, max(5, int(share * width)))
    return [sorted(int(i) for i in rng.choice(width, size, replace=False)) for _ in range(members)]


def _cut(df: DataFrame, subset: list[int] | None) -> DataFrame:
    return df if subset is None else df.withColumn("x", F.array(*(F.get("x", i) for i in subset)))


def _mean_borrowed(parts: Iterable[DataFrame], *keys: str | Column) -> DataFrame:
    return reduce(DataFrame.unionByName, parts).groupBy(*keys).agg(F.avg("borrowed").alias("borrowed"))


def subspace_borrow(queries: DataFrame, known: DataFrame, width: int, value: str, k: int = 2, members: int = 50, share: float = 0.8, seed: int = 0) -> DataFrame:
    """Mean of ``borrow`` over random subsets of the ``width`` features (at least five), all searched in one pass over ``known``."""
    near = nearest_stated(queries, known.select("id", "x"), k, subsets=random_subsets(width, members, share, seed))
    own = near.join(known.select(F.col("id").alias("item"), value), "item").groupBy("query", "member").agg(F.avg(value).alias("borrowed"))
    return _mean_borrowed([own], "query")


def _filled(df: DataFrame) -> DataFrame:
    return df.withColumn("x", F.transform("x", lambda v: F.coalesce(v.cast("double"), F.lit(0.0))))


def _coordinate_moments(df: DataFrame, by: str) -> dict[int | None, np.ndarray]:
    """(rows, mean, population variance) of each coordinate of x for each value of ``by``; folds times coordinates are collected."""
    cells = df.select(by, F.posexplode("x").alias("i", "v")).groupBy(by, "i").agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("m"), F.var_pop("v").alias("s"))
    found: dict = {}
    for r in cells.collect():
        found.setdefault(r[by], {})[r["i"]] = (r["n"], r["m"], r["s"])
    return {f: np.array([v[i] for i in sorted(v)], float).reshape(-1, 3) for f, v in found.items()}


def _merged(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation of all parts together, from distances of their means, so nothing large cancels."""
    if not parts:
        return np.zeros(0), np.zeros(0)
    n, m, s = (np.stack([p[:, i] for p in parts]) for i in range(3))
    mean = (n * m).sum(axis=0) / n.sum(axis=0)
    return mean, np.sqrt((n * (s + (m - mean) ** 2)).sum(axis=0) / n.sum(axis=0)) + 1e-6


def _scaled(df: DataFrame, mean: np.ndarray, spread: np.ndarray, bound: float) -> DataFrame:
    means, spreads = (F.array(*(F.lit(float(v)) for v in a)) for a in (mean, spread))
    return df.withColumn("x", F.zip_with(F.zip_with("x", means, lambda x, m: x - m), spreads, lambda d, s: F.least(F.greatest(d / s, F.lit(-bound)), F.lit(bound))))


def leak_free_borrow(
    df: DataFrame, fold: str, folds: int, queries: Column, k: int, value: str, weighting: str = "inverse square", metric: str = "manhattan", bound: float = 3.0, search: Callable[..., DataFrame] = nearest
) -> DataFrame:
    """query, fold, borrowed: mean of ``value`` over the ``k`` nearest rows of the other folds, for the rows where ``queries`` holds.

    ``df`` has id, x (array) and fold. Nulls in x are 0; each coordinate is standardised by the other folds' mean and
    population deviation and kept within ``bound``. Moments of a coordinate are taken once per fold and merged.
    """
    filled = _filled(df)
    moments = _coordinate_moments(filled, fold)
    found = None
    for f in range(folds):
        rows = _scaled(filled, *_merged([v for g, v in moments.items() if g != f]), bound)
        one = borrow(rows.filter((F.col(fold) == f) & queries), rows.filter(F.col(fold) != f), k, value, weighting, metric, search).withColumn(fold, F.lit(f))
        found = one if found is None else found.unionByName(one)
    return found


def neighbour_blend(
    train: DataFrame, sub: DataFrame, fold: str, folds: int, k: int, p: str, y: str, weighting: str = "uniform", bound: float = 3.0, eps: float = 1e-12, subsets: list[list[int]] | None = None
) -> DataFrame:
    """id, fold (null for ``sub``), p, borrowed, alpha and blend of all rows of both tables (id, x, ``p``; ``train`` also fold and ``y``).

    A training row borrows from the other folds, standardised by them, and its weight comes from them; a row of ``sub``
    borrows from all training rows, standardised by these, with the weight that all of them give. With ``subsets`` of the
    coordinates what is borrowed is the mean over them.
    """
    train, sub, ways = written(_filled(train)), written(_filled(sub)), subsets or [None]
    own = _mean_borrowed((written(leak_free_borrow(_cut(train, s), fold, folds, F.lit(True), k, p, weighting, bound=bound, search=all_rows)) for s in ways), F.col("query").alias("id"))
    every = _merged(list(_coordinate_moments(train, fold).values()))
    a, b = _scaled(train, *every, bound), _scaled(sub, *every, bound)
    other = _mean_borrowed((written(borrow(_cut(b, s), _cut(a, s), k, p, weighting, search=all_rows)) for s in ways), F.col("query").alias("id"))
    rows = train.select("id", fold, p, y).join(own, "id", "left").unionByName(sub.select("id", p).join(other, "id", "left"), allowMissingColumns=True)
    rows = rows.withColumns({"borrowed": F.coalesce("borrowed", F.col(p)), "__one": F.lit(1)})
    blended = blend_out_of_fold(rows, fold, "__one", p, "borrowed", y)
    return blended.select("id", fold, p, "borrowed", "alpha", clip(F.col("blend"), eps, 1 - eps).alias("blend"))


def fused(df: DataFrame, fold: str, label: str, tree: str | tuple, y: str, name: str = "fused") -> DataFrame:
    """``df`` with a tree of pairwise out-of-fold blends: a node is a column or a pair of nodes."""

    def node(df: DataFrame, at: str | tuple, to: str) -> tuple[DataFrame, str]:
        if isinstance(at, str):
            return df, at
        (df, m), own = node(df, at[0], f"{to}0"), f"__{to}"
        df, n = node(df, at[1], f"{to}1")
        return blend_out_of_fold(df, fold, label, m, n, y).withColumnRenamed("blend", own).drop("alpha"), own

    out, top = node(df, tree, "t")
    return out.select(*df.columns, F.col(top).alias(name))


def platt_by(df: DataFrame, by: str, p: str, y: str, penalty: float = 1e-6, eps: float = 1e-12, rounds: int = 30) -> DataFrame:
    """by, a, b of Platt's fit sigmoid(a * logit(p) + b) for each group, from the rows that have ``y``.

    Newton's method for all groups at once: a step is one aggregate of five sums for each group.
    """
    rows = df.filter(F.col(y).isNotNull()).select(F.col(by).alias("__g"), logit(clip(F.col(p), eps, 1 - eps)).alias("__z"), F.col(y).cast("double").alias("__y"))
    rows, spark = written(rows), df.sparkSession
    schema = f"__k {dict(df.dtypes)[by]}, a double, b double"
    fits = {r["__g"]: np.zeros(2) for r in rows.select("__g").distinct().collect()}  # a row for each label
    for _ in range(rounds):
        table = spark.createDataFrame([(g, *map(float, w)) for g, w in fits.items()], schema)
        q = sigmoid(F.col("a") * F.col("__z") + F.col("b"))
        d, h, z = F.col("__y") - F.col("q"), F.col("q") * (1 - F.col("q")), F.col("__z")
        sums = rows.join(F.broadcast(table), F.col("__g").eqNullSafe(F.col("__k"))).select("__g", "__z", "__y", q.alias("q")).groupBy("__g").agg(
            *(F.sum(v).alias(n) for n, v in (("da", d * z), ("db", d), ("aa", h * z * z), ("ab", h * z), ("bb", h)))
        )
        moved = 0.0
        for r in sums.collect():
            w = fits[r["__g"]]
            step = np.linalg.solve([[r["aa"] + penalty, r["ab"]], [r["ab"], r["bb"] + 1e-12]], [r["da"] - penalty * w[0], r["db"]])
            # A long step is cut, so that separable labels end in a steep but finite fit.
            step *= min(1.0, 20.0 / max(np.abs(step).max(), 1e-12))
            fits[r["__g"]] = w + step
            moved = max(moved, float(np.abs(step).max()))
        if moved < 1e-9:
            break
    return spark.createDataFrame([(g, *map(float, w)) for g, w in fits.items()], schema).withColumnRenamed("__k", by)


def calibrated_by(df: DataFrame, by: str, p: str, y: str, eps: float = 1e-12, train: DataFrame | None = None) -> DataFrame:
    """``df`` with ``p`` calibrated by its group's fit, for rows with and without ``y``; the fit is that of ``train``, or of ``df`` itself."""
    fits = platt_by(df if train is None else train, by, p, y, eps=eps).withColumnRenamed(by, "__by")
    q = sigmoid(F.col("a") * logit(clip(F.col(p), eps, 1 - eps)) + F.col("b"))
    return df.join(F.broadcast(fits), F.col(by).eqNullSafe(F.col("__by")), "left").withColumn(p, clip(F.coalesce(q, F.col(p)), eps, 1 - eps)).drop("__by", "a", "b")


def weighted_by(df: DataFrame, by: str, views: list[str], y: str, name: str = "p", eps: float = 1e-12) -> DataFrame:
    """``df`` with the mix of the views by each group's shrunk simplex weights, which come from the rows that have ``y``."""
    known = written(df.filter(F.col(y).isNotNull()).select(by, *views, y))
    groups = [r[by] for r in known.select(by).distinct().collect()]  # a row for each label
    rows = [(g, *map(float, simplex_weights(known.filter(F.col(by).eqNullSafe(F.lit(g))), views, y))) for g in groups]
    table = df.sparkSession.createDataFrame(rows, f"__by {dict(df.dtypes)[by]}, " + ", ".join(f"__w{i} double" for i in range(len(views))))
    mix = sum((F.coalesce(f"__w{i}", F.lit(1 / len(views))) * F.col(v) for i, v in enumerate(views)), F.lit(0.0))
    return df.join(F.broadcast(table), F.col(by).eqNullSafe(F.col("__by")), "left").withColumn(name, clip(mix, eps, 1 - eps)).drop("__by", *(f"__w{i}" for i in range(len(views))))


def composed(df: DataFrame, fold: str, label: str, tree: str | tuple, context: str, y: str) -> DataFrame:
    """``df`` with ``p``: a tree of pairwise blends, calibrated for each label, mixed with the context view by simplex weights.

    Rows with a fold and ``y`` are out of fold, rows without are the hold-out split; every weight comes from the former.
    """
    blended = written(fused(df, fold, label, tree, y, "__tree"))
    mixed = weighted_by(calibrated_by(blended, label, "__tree", y), label, ["__tree", context], y)
    return mixed.drop("__tree")


def compared(a: DataFrame, b: DataFrame, keys: list[str], p: str) -> DataFrame:
    """Largest difference of two tables of probabilities, and the bound it sets on the difference of their log-losses."""
    both = a.select(*keys, F.col(p).alias("__a")).join(b.select(*keys, F.col(p).alias("__b")), keys)
    d = F.abs(F.col("__a") - F.col("__b"))
    return both.agg(F.count(F.lit(1)).alias("n"), F.max(d).alias("max_delta"), F.avg(d / F.least(F.col("__b"), 1 - F.col("__b"))).alias("loss_bound"))
