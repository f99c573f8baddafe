"""Trees grown from aggregates over all rows, for many models at once.

Both learners take the table of ``folds.expanded`` and grow the trees of all models (seed and fold) together: a pass sums
what the open nodes of every tree need, Spark finds the best split of each, and one row for each node reaches the driver.
Trees, never rows, are broadcast. Jobs grow with the depth and number of trees, not with folds, seeds or rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidewater.functions.scalars import sigmoid
from tidewater.sources.scratch import scratch, written

from .folds import MODEL, Learner, training

KEY = tuple[int, int]


def draw(*what: str | Column) -> Column:
    """A number from 0 to 1 (excluded) that only its arguments decide."""
    return F.pmod(F.xxhash64(*what), F.lit(1 << 52)) / F.lit(float(1 << 52))


# Leaf-wise boosting


@dataclass
class Boosting:
    leaves: int = 15
    trees: int = 2000
    rate: float = 0.02
    least: int = 15
    l2: float = 1.0
    l1: float = 0.1
    feature_share: float = 1.0
    row_share: float = 1.0
    #: Rows are drawn anew after so many trees.
    every: int = 1
    bins: int = 255
    #: Share of the training rows on which boosting stops, after so many trees without a lesser loss.
    held: float = 0.15
    patience: int = 100


#: Settings of the quick fit that selects features, and of the full one.
FAST = Boosting(trees=200, rate=0.05)
FULL = Boosting(feature_share=0.8, row_share=0.8, every=5)


def _bounds(rows: DataFrame, features: list[str], bins: int) -> DataFrame:
    """For each model an array of each feature's bin bounds, quantiles of the training rows; every value where there are few."""
    shares = [i / bins for i in range(1, bins)]
    return training(rows).groupBy(*MODEL).agg(F.array(*(F.coalesce(F.array_distinct(F.percentile_approx(F.col(f"`{c}`").cast("double"), shares, 100 * bins)), F.array().cast("array<double>")) for c in features)).alias("__bounds"))


def _binned(features: list[str]) -> Column:
    """Number of bounds below each value; missing values are in the first bin."""

    def cell(i: int, v: Column) -> Column:
        return F.when(v.isNull(), 0).otherwise(F.size(F.filter(F.get("__bounds", i), lambda b: b < v)) + 1)

    return F.array(*(cell(i, F.col(f"`{c}`").cast("double")) for i, c in enumerate(features)))


class _Tree:
    """Nodes of a growing tree: best splits as far as known, and the order in which leaves split."""

    def __init__(self) -> None:
        self.split: dict[int, tuple] = {}
        self.known: set[int] = set()
        self.stats: dict[int, tuple[float, float]] = {}
        self.children: dict[int, tuple[int, int]] = {}
        self.next = 1

    def grown(self, leaves: int) -> tuple[list[int], bool]:
        """Leaves when the largest gain always splits first; whether a needed split is not known yet."""
        open_, done, n = [], [], 1
        at = [0]
        while True:
            for node in at:
                if node not in self.known:
                    return [], True
                gain = self.split[node][0] if node in self.split else 0.0
                heapq.heappush(open_, (-gain, node))
            if n >= leaves or not open_ or open_[0][0] >= 0:
                return sorted([*done, *(node for _, node in open_)]), False
            node = heapq.heappop(open_)[1]
            at, n = list(self.children[node]), n + 1

    def answer(self, node: int, row) -> None:
        """What a pass has found for a node: its sums, and its best split if it has one."""
        self.known.add(node)
        self.stats.setdefault(node, (row["g"], row["h"]))
        if row["gain"] is not None and row["gain"] > 0:
            left, right = self.next, self.next + 1
            self.next += 2
            self.split[node], self.children[node] = (row["gain"], row["feature"], row["bin"]), (left, right)
            self.stats[left], self.stats[right] = (row["gl"], row["hl"]), (row["g"] - row["gl"], row["h"] - row["hl"])


def _best_splits(cells: DataFrame, s: Boosting) -> DataFrame:
    """seed, model, node, g, h, gain, feature, bin, gl, hl: of all bins of all features the one with the largest gain."""
    by = W.partitionBy(*MODEL, "node", "feature")
    upto = by.orderBy("bin").rowsBetween(W.unboundedPreceding, 0)
    sums = cells.groupBy(*MODEL, "node", "feature", "bin").agg(*(F.sum(c).alias(c) for c in ("g", "h", "n")))
    sums = sums.select(*MODEL, "node", "feature", "bin", *(F.sum(c).over(upto).alias(f"{c}l") for c in ("g", "h", "n")), *(F.sum(c).over(by).alias(c) for c in ("g", "h", "n")))

    def score(g: Column, h: Column) -> Column:
        return F.pow(F.greatest(F.abs(g) - s.l1, F.lit(0.0)), F.lit(2.0)) / (h + s.l2)

    g, h, n = (F.col(c) - F.col(f"{c}l") for c in ("g", "h", "n"))
    gain = score(F.col("gl"), F.col("hl")) + score(g, h) - score(F.col("g"), F.col("h"))
    gain = F.when((F.col("nl") >= s.least) & (n >= s.least) & (F.col("hl") >= 1e-3) & (h >= 1e-3), gain)
    first = F.struct(F.round(gain, 12).alias("gain"), (-F.col("feature")).alias("f"), (-F.col("bin")).alias("b"), "gl", "hl")
    best = sums.groupBy(*MODEL, "node").agg(F.max(first).alias("s"), F.max("g").alias("g"), F.max("h").alias("h"))
    return best.select(*MODEL, "node", "g", "h", "s.gain", (-F.col("s.f")).alias("feature"), (-F.col("s.b")).alias("bin"), "s.gl", "s.hl")


def _table(spark, rows: list[tuple], schema: str) -> DataFrame:
    return F.broadcast(spark.createDataFrame(rows, schema))


def fit_boosted(rows: DataFrame, features: list[str], label: str, s: Boosting, allowed: dict[KEY, set[int]] | None = None) -> tuple[DataFrame, dict[KEY, list[dict]], dict[KEY, int]]:
    """Rows of the roles oof and sub with ``p``; each model's trees as (node -> (feature, bin, left, right) or value); the
    number of trees that its prediction has. ``allowed``: the features (by number) that a model may use."""
    spark = rows.sparkSession
    known = written(rows.filter((F.col("role") != "train") | F.col(label).isNotNull()).withColumn("__row", F.monotonically_increasing_id()))
    what = [*(F.col(f"`{c}`") for c in features), F.col(label), F.col("seed")]
    state = known.join(_bounds(known, features, s.bins), MODEL, "left").select(
        *MODEL, "__row", _binned(features).alias("__x"), F.col(label).cast("double").alias("__y"), F.xxhash64(*what).alias("__draw"),
        F.when(F.col("role") != "train", "asked").when(draw(*what) < s.held, "held").otherwise("fit").alias("__part"),
    )
    base = written(state.filter("__part = 'fit'").groupBy(*MODEL).agg(F.count(F.lit(1)).alias("n"), F.avg("__y").alias("rate")))
    start = {(r["seed"], r["model"]): r["rate"] for r in base.collect()}
    live = {k for k, r in start.items() if 0 < r < 1}
    rate = F.coalesce("rate", F.lit(0.5))
    margin = F.when((rate > 0) & (rate < 1), F.log(rate / (1 - rate))).otherwise(0.0)
    state = written(state.join(F.broadcast(base.drop("n")), MODEL, "left").withColumns({"__margin": margin, "__best": margin}))
    forest: dict[KEY, list[dict]] = {k: [] for k in start}
    best: dict[KEY, tuple[float, int]] = {}
    for r in _held_loss(state).collect():
        best[r["seed"], r["model"]] = (r["loss"], 0)
    p = sigmoid(F.col("__margin"))
    for t in range(s.trees):
        if not live:
            break
        chosen = {k: _chosen(k, t, len(features), s.feature_share, (allowed or {}).get(k)) for k in live}
        uses = _table(spark, [(*k, [i in c for i in range(len(features))]) for k, c in chosen.items()], "seed int, model int, uses array<boolean>")
        taken = F.pmod(F.xxhash64("__draw", F.lit(t // s.every)), F.lit(1 << 20)) < int(s.row_share * (1 << 20))
        fit = state.filter("__part = 'fit'").join(uses, MODEL).filter(taken)
        at = fit.withColumns({"node": F.lit(0), "g": p - F.col("__y"), "h": p * (1 - p)})
        trees = {k: _Tree() for k in live}
        asked = [(*k, 0) for k in live]
        while asked:
            open_ = at.join(_table(spark, asked, "seed int, model int, node int"), [*MODEL, "node"])
            cells = open_.select(*MODEL, "node", "g", "h", F.lit(1).alias("n"), "uses", F.posexplode("__x").alias("feature", "bin")).filter(F.get("uses", F.col("feature")))
            for r in _best_splits(cells, s).collect():  # a row for each open node
                trees[r["seed"], r["model"]].answer(r["node"], r)
            splits, asked = [], []
            for k, tree in trees.items():
                if tree.grown(s.leaves)[1]:
                    # All children that may split in time are asked for at once.
                    fresh = sorted((n for n in tree.split if tree.children[n][0] not in tree.known), key=lambda n: -tree.split[n][0])[: s.leaves - 1]
                    splits += [(*k, n, *tree.split[n][1:], *tree.children[n]) for n in fresh]
                    asked += [(*k, c) for n in fresh for c in tree.children[n]]
            if asked:
                at = _moved(at, spark, splits)
        values, every = [], []
        for k, tree in trees.items():
            leaves = set(tree.grown(s.leaves)[0])
            forest[k].append(_finished(tree, leaves, s))
            every += [(*k, n, *tree.split[n][1:], *tree.children[n]) for n in forest[k][-1] if n not in leaves]
            values += [(*k, n, forest[k][-1][n]) for n in leaves]
        state = written(_updated(state, spark, every, values, _depth(forest, live), [k for k in best if best[k][1] == t]))
        losses = {(r["seed"], r["model"]): r["loss"] for r in _held_loss(state).collect()}
        for k in sorted(live):
            if k not in losses:
                best[k] = (0.0, t + 1)
            elif losses[k] < best.get(k, (np.inf, 0))[0]:
                best[k] = (losses[k], t + 1)
            elif t + 1 - best[k][1] >= s.patience:
                live.discard(k)
    last = _table(spark, [(*k, best.get(k, (0, 0))[1] == len(forest[k])) for k in forest], "seed int, model int, last boolean")
    shown = F.when(F.col("last"), F.col("__margin")).otherwise(F.col("__best"))
    p = F.when((rate > 0) & (rate < 1), sigmoid(shown)).otherwise(rate)
    found = state.filter("__part = 'asked'").join(last, MODEL, "left").select("__row", p.alias("p"))
    return known.join(found, "__row").select(*rows.columns, "p"), forest, {k: best.get(k, (0, 0))[1] for k in forest}


def _held_loss(state: DataFrame) -> DataFrame:
    q = F.least(F.greatest(sigmoid(F.col("__margin")), F.lit(1e-15)), F.lit(1 - 1e-15))
    loss = -F.avg(F.col("__y") * F.log(q) + (1 - F.col("__y")) * F.log(1 - q))
    return state.filter("__part = 'held'").groupBy(*MODEL).agg(loss.alias("loss"))


def _chosen(key: KEY, tree: int, n: int, share: float, allowed: set[int] | None) -> set[int]:
    able = sorted(allowed) if allowed is not None else list(range(n))
    rng = np.random.default_rng([*key, tree])
    return set(rng.permutation(able)[: max(1, int(round(share * len(able))))].tolist())


def _moved(at: DataFrame, spark, splits: list[tuple]) -> DataFrame:
    """Rows of nodes that split go to the children."""
    table = _table(spark, splits, "seed int, model int, node int, f int, b int, l int, r int")
    side = F.when(F.get("__x", F.col("f")) <= F.col("b"), F.col("l")).otherwise(F.col("r"))
    return at.join(table, [*MODEL, "node"], "left").withColumn("node", F.when(F.col("f").isNull(), F.col("node")).otherwise(side)).drop("f", "b", "l", "r")


def _finished(tree: _Tree, leaves: set[int], s: Boosting) -> dict:
    """node -> (feature, bin, left, right), or its value."""
    out, todo = {}, [0]
    while todo:
        node = todo.pop()
        if node in leaves:
            g, h = tree.stats[node]
            out[node] = float(-np.sign(g) * max(abs(g) - s.l1, 0) / (h + s.l2) * s.rate)
        else:
            out[node] = (*tree.split[node][1:], *tree.children[node])
            todo += tree.children[node]
    return out


def _depth(forest: dict[KEY, list[dict]], live: set[KEY]) -> int:
    def deep(tree: dict, node: int) -> int:
        return 0 if not isinstance(tree[node], tuple) else 1 + max(deep(tree, c) for c in tree[node][2:])

    return max((deep(forest[k][-1], 0) for k in live), default=0)


def _updated(state: DataFrame, spark, splits: list[tuple], values: list[tuple], depth: int, improved: list[KEY]) -> DataFrame:
    """Margins after the new trees; for models whose loss was the least before them, those margins are kept as the best."""
    at = state.withColumn("node", F.lit(0))
    for _ in range(depth):
        at = _moved(at, spark, splits)
    better = _table(spark, [(*k, True) for k in improved], "seed int, model int, better boolean")
    add = _table(spark, values, "seed int, model int, node int, value double")
    out = at.join(add, [*MODEL, "node"], "left").join(better, MODEL, "left")
    return out.withColumns({"__best": F.when(F.col("better"), F.col("__margin")).otherwise(F.col("__best")), "__margin": F.col("__margin") + F.coalesce("value", F.lit(0.0))}).drop("node", "value", "better")


def boosted(s: Boosting = FULL) -> Learner:
    return lambda rows, features, label: fit_boosted(rows, features, label, s)[0]


def importances(forest: dict[KEY, list[dict]], n: int) -> dict[KEY, np.ndarray]:
    """Number of splits of each feature."""
    return {k: np.bincount([node[0] for tree in trees for node in tree.values() if isinstance(node, tuple)], minlength=n) for k, trees in forest.items()}


def boosted_in_two_stages(base: list[str], top: int, fast: Boosting = FAST, full: Boosting = FULL) -> Learner:
    """A quick fit on all features; then a full one on ``base`` and, for each model, the ``top`` others that it split on most."""

    def learn(rows: DataFrame, features: list[str], label: str) -> DataFrame:
        _, quick, _ = fit_boosted(rows, features, label, fast)
        allowed = {}
        for k, counts in importances(quick, len(features)).items():
            others = sorted((i for i, c in enumerate(features) if c not in base), key=lambda i: (-counts[i], i))[:top]
            allowed[k] = {i for i, c in enumerate(features) if c in base} | set(others)
        return fit_boosted(rows, features, label, full, allowed)[0]

    return learn


# Extremely randomised trees


@dataclass
class Extra:
    trees: int = 400
    least: int = 3
    depth: int = 12
    #: Trees that grow together; the driver holds the candidates of their open nodes.
    chunk: int = 25


_FOREST = "seed int, model int, tree int, node long"


def _walked(x: np.ndarray, tree: dict[int, tuple[int, float]]) -> np.ndarray:
    """Leaf of each row; children of node i are 2 i and 2 i + 1, the root is 1."""
    node = np.ones(len(x), np.int64)
    todo = np.arange(len(x)) if 1 in tree else np.zeros(0, np.int64)
    while len(todo):
        f, t = (np.array(v) for v in zip(*(tree[i] for i in node[todo].tolist()), strict=True))
        node[todo] = 2 * node[todo] + (x[todo, f] > t)
        todo = todo[[i in tree for i in node[todo].tolist()]]
    return node


def _pass(data: DataFrame, forest: dict, open_: dict, summed, schema: str) -> DataFrame:
    """``summed(x, y, node, candidates)`` of the rows in open nodes, for each model and tree, as pandas frames."""
    shared = data.sparkSession.sparkContext.broadcast((forest, open_))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forest, open_ = shared.value
        for batch in batches:
            for (seed, model), part in batch.groupby(MODEL):
                x, y = np.stack(part["x"]), part["y"].to_numpy()
                for tree in sorted({t for s, m, t in open_ if (s, m) == (seed, model)}):
                    node = _walked(x, forest[seed, model, tree])
                    found = summed(x, y, node, open_[seed, model, tree])
                    if len(found):
                        yield found.assign(seed=seed, model=model, tree=tree)

    return data.mapInPandas(run, schema)


def _ranges(x: np.ndarray, y: np.ndarray, node: np.ndarray, candidates: set[int]) -> pd.DataFrame:
    inside = np.isin(node, list(candidates))
    ids, at = np.unique(node[inside], return_inverse=True)
    low, high = np.full((len(ids), x.shape[1]), np.inf), np.full((len(ids), x.shape[1]), -np.inf)
    np.minimum.at(low, at, x[inside])
    np.maximum.at(high, at, x[inside])
    return pd.DataFrame({"node": np.repeat(ids, x.shape[1]), "feature": np.tile(np.arange(x.shape[1]), len(ids)), "low": low.ravel(), "high": high.ravel()})


def _counts(x: np.ndarray, y: np.ndarray, node: np.ndarray, candidates: dict[int, list[tuple[int, float]]]) -> pd.DataFrame:
    out = []
    for i in np.unique(node[np.isin(node, list(candidates))]).tolist():
        own = node == i
        for f, t in candidates[i]:
            left = x[own, f] <= t
            out.append((i, f, t, int(left.sum()), float(y[own][left].sum()), int(own.sum()), float(y[own].sum())))
    return pd.DataFrame(out, columns=["node", "feature", "threshold", "nl", "sl", "n", "s"])


def extra_draws(nodes: DataFrame) -> DataFrame:
    """``nodes`` (seed, model, tree, node, feature) with ``turn``, by which a node's features are tried, and ``share``, where
    between the least and largest value its threshold lies."""
    what = [*MODEL, "tree", "node", "feature"]
    return nodes.withColumns({"turn": draw(*what, F.lit("turn")), "share": draw(*what, F.lit("share"))})


def _grown(data: DataFrame, stats: dict[KEY, tuple[int, float]], trees: range, width: int, s: Extra) -> tuple[dict, dict]:
    """(splits, leaf rates) of each (seed, model, tree), level by level."""
    most = max(1, int(width**0.5))
    forest: dict = {(*k, t): {} for k in stats for t in trees}
    sums = {(*k, t): {1: v} for k, v in stats.items() for t in trees}
    open_ = {k: {1} for k, v in sums.items() if v[1][0] >= 2 * s.least and 0 < v[1][1] < v[1][0]}
    for _ in range(s.depth):
        if not open_:
            break
        ranges = _pass(data, forest, open_, _ranges, f"{_FOREST}, feature int, low double, high double").groupBy(*MODEL, "tree", "node", "feature").agg(F.min("low").alias("low"), F.max("high").alias("high"))
        tried = extra_draws(ranges.filter("low < high"))
        first = F.row_number().over(W.partitionBy(*MODEL, "tree", "node").orderBy("turn", "feature"))
        tried = tried.withColumn("place", first).filter(F.col("place") <= most).withColumn("threshold", F.col("low") + F.col("share") * (F.col("high") - F.col("low")))
        candidates: dict = {}
        for r in tried.select(*MODEL, "tree", "node", "feature", "threshold").collect():  # candidates of the open nodes
            candidates.setdefault((r["seed"], r["model"], r["tree"]), {}).setdefault(r["node"], []).append((r["feature"], r["threshold"]))
        if not candidates:
            break
        cells = _pass(data, forest, candidates, _counts, f"{_FOREST}, feature int, threshold double, nl long, sl double, n long, s double")
        cells = cells.groupBy(*MODEL, "tree", "node", "feature", "threshold").agg(*(F.sum(c).alias(c) for c in ("nl", "sl", "n", "s")))
        nr, sr = F.col("n") - F.col("nl"), F.col("s") - F.col("sl")
        # Twice the sum over both sides of rows times Gini impurity, less what is the same for all splits of a node.
        worth = F.when((F.col("nl") >= s.least) & (nr >= s.least), F.col("sl") * F.col("sl") / F.col("nl") + (F.col("nl") - F.col("sl")) ** 2 / F.col("nl") + sr * sr / nr + (nr - sr) ** 2 / nr)
        best = cells.withColumn("worth", F.round(worth, 9)).filter("worth is not null").groupBy(*MODEL, "tree", "node").agg(
            F.max(F.struct("worth", (-F.col("feature")).alias("f"), "threshold", "nl", "sl", "n", "s")).alias("b")
        )
        open_ = {}
        for r in best.collect():  # a row for each open node
            key, b, node = (r["seed"], r["model"], r["tree"]), r["b"], r["node"]
            forest[key][node] = (-b["f"], b["threshold"])
            for child, (n, hits) in ((2 * node, (b["nl"], b["sl"])), (2 * node + 1, (b["n"] - b["nl"], b["s"] - b["sl"]))):
                sums[key][child] = (n, hits)
                if n >= 2 * s.least and 0 < hits < n:
                    open_.setdefault(key, set()).add(child)
    return forest, {k: {i: hits / n for i, (n, hits) in v.items() if i not in forest[k]} for k, v in sums.items()}


def extra_trees(s: Extra | None = None) -> Learner:
    """Trees whose thresholds are drawn between the least and largest value of a node, for the root of the number of
    features drawn anew for each node (those that vary there), on all training rows. Missing values must be filled."""
    s = s or Extra()

    def learn(rows: DataFrame, features: list[str], label: str) -> DataFrame:
        x = F.array(*(F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)) for c in features)).alias("x")
        with scratch():
            data = written(training(rows).filter(F.col(label).isNotNull()).select(*MODEL, x, F.col(label).cast("double").alias("y")))
            stats = {(r["seed"], r["model"]): (r["n"], r["s"]) for r in data.groupBy(*MODEL).agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("s")).collect()}
            asked = rows.filter("role <> 'train'").select("*", F.monotonically_increasing_id().alias("__row"), x)
            asked = written(asked, keep=True)
            found = None
            for at in range(0, s.trees, s.chunk):
                grown = _grown(data, stats, range(at, min(at + s.chunk, s.trees)), len(features), s)
                one = written(_voted(asked.select(*MODEL, "__row", "x"), *grown), keep=True)
                found = one if found is None else found.unionByName(one)
        votes = found.groupBy("__row").agg((F.sum("total") / F.sum("votes")).alias("p"))
        return asked.join(votes, "__row", "left").withColumn("p", F.coalesce("p", F.lit(0.5))).drop("__row", "x")

    return learn


def _voted(asked: DataFrame, forest: dict, rates: dict) -> DataFrame:
    shared = asked.sparkSession.sparkContext.broadcast((forest, rates))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forest, rates = shared.value
        for batch in batches:
            for (seed, model), part in batch.groupby(MODEL):
                own, x = [k for k in forest if k[:2] == (seed, model)], np.stack(part["x"])
                if own:
                    total = sum(np.array([rates[k][i] for i in _walked(x, forest[k]).tolist()]) for k in own)
                    yield pd.DataFrame({"__row": part["__row"].to_numpy(), "total": total, "votes": len(own)})

    return asked.mapInPandas(run, "__row long, total double, votes long")
