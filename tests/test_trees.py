"""Trees grown by Spark's aggregates against plain loops."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewater.operators import folds as M, trees as T


def rows(spark, n=400, seed=0, sub=40):
    r = np.random.default_rng(seed)
    x = np.round(r.normal(size=(n + sub, 3)), 1)
    y = (x[:, 0] + 0.5 * x[:, 1] ** 2 + r.normal(0, 0.5, n + sub) > 0.3).astype(int)
    data = [(i, *map(float, v), int(k), i % 4) for i, (v, k) in enumerate(zip(x, y, strict=True))]
    df = spark.createDataFrame(data, "id int, a double, b double, c double, y int, fold int")
    return x, y, M.expanded(df.filter(f"id < {n}"), df.filter(f"id >= {n}").drop("y"), 4, (7,), lambda s: F.col("fold"))


def sigmoid(v):
    return 1 / (1 + np.exp(-v))


def boosted_by_loop(x, y, asked, s):
    """Leaf-wise boosting with every value as a bound."""
    start = np.log(y.mean() / (1 - y.mean()))
    margin, out = np.full(len(y), start), np.full(len(asked), start)

    def score(g, h):
        return max(abs(g) - s.l1, 0) ** 2 / (h + s.l2)

    for _ in range(s.trees):
        p = sigmoid(margin)
        g, h = p - y, p * (1 - p)

        def best(own, g=g, h=h):
            found = (0.0,)
            for f in range(x.shape[1]):
                for b in np.unique(x[own, f]):
                    left = own & (x[:, f] <= b)
                    right = own & ~left
                    if min(left.sum(), right.sum()) >= s.least:
                        gain = score(g[left].sum(), h[left].sum()) + score(g[right].sum(), h[right].sum()) - score(g[own].sum(), h[own].sum())
                        if gain > found[0] + 1e-9:
                            found = (gain, f, b)
            return found

        leaves = [(best(np.ones(len(y), bool)), np.ones(len(y), bool), np.ones(len(asked), bool))]
        while len(leaves) < s.leaves and max(v[0][0] for v in leaves) > 0:
            i = max(range(len(leaves)), key=lambda i: leaves[i][0][0])
            (_, f, b), own, other = leaves.pop(i)
            for side in (True, False):
                a, c = own & ((x[:, f] <= b) == side), other & ((asked[:, f] <= b) == side)
                leaves.append((best(a), a, c))
        for _, own, other in leaves:
            value = -np.sign(g[own].sum()) * max(abs(g[own].sum()) - s.l1, 0) / (h[own].sum() + s.l2) * s.rate
            margin[own] += value
            out[other] += value
    return sigmoid(out)


def test_leafwise_boosting_equals_a_loop(spark):
    x, y, df = rows(spark)
    s = T.Boosting(leaves=6, trees=3, rate=0.3, held=0.0, least=10)
    got, forest, used = T.fit_boosted(df, ["a", "b", "c"], "y", s)
    p = {(r["model"], r["id"]): r["p"] for r in got.collect()}
    assert len(p) == 400 + 4 * 40 and set(used.values()) == {3}
    for m in range(4):
        fit = (np.arange(440) < 400) & (np.arange(440) % 4 != m)
        asked = [i for i in range(440) if (m, i) in p]
        want = boosted_by_loop(x[fit], y[fit], x[asked], s)
        assert np.allclose([p[m, i] for i in asked], want, atol=1e-9)
        assert all(sum(not isinstance(v, tuple) for v in tree.values()) <= 6 for tree in forest[7, m])


def test_boosting_stops_by_the_held_loss(spark):
    r = np.random.default_rng(5)
    data = [(i, *map(float, r.normal(size=3)), int(r.integers(0, 2)), i % 4) for i in range(240)]
    df = spark.createDataFrame(data, "id int, a double, b double, c double, y int, fold int")
    df = M.expanded(df.filter("id < 200"), df.filter("id >= 200").drop("y"), 2, (7,), lambda s: F.col("fold") % 2)
    got, forest, used = T.fit_boosted(df, ["a", "b", "c"], "y", T.Boosting(leaves=8, trees=12, rate=1.0, least=3, held=0.3, patience=2, feature_share=0.7, row_share=0.8, every=2))
    assert all(len(forest[k]) <= used[k] + 2 and len(forest[k]) < 12 for k in forest)
    assert got.filter("p <= 0 or p >= 1 or p is null").count() == 0


def test_two_stages_split_only_on_what_the_quick_fit_chose(spark):
    _, _, df = rows(spark)
    quick = T.fit_boosted(df, ["a", "b", "c"], "y", T.Boosting(trees=1, leaves=4))[1]
    counts = T.importances(quick, 3)
    forest = T.fit_boosted(df, ["a", "b", "c"], "y", T.Boosting(trees=2, leaves=4), {k: {2, int(v[:2].argmax())} for k, v in counts.items()})[1]
    for k, trees in forest.items():
        assert {v[0] for tree in trees for v in tree.values() if isinstance(v, tuple)} <= {2, int(counts[k][:2].argmax())}


def extra_by_loop(x, y, asked, draws, trees, s):
    most, votes = max(1, int(x.shape[1] ** 0.5)), np.zeros(len(asked))
    for t in range(trees):

        def grow(own, other, node, depth, t=t):
            n, hits = own.sum(), y[own].sum()
            options = [f for f in range(x.shape[1]) if x[own, f].min() < x[own, f].max()] if n else []
            if depth == 0 or n < 2 * s.least or not 0 < hits < n or not options:
                votes[other] += hits / n
                return
            found = None
            for f in sorted(options, key=lambda f: draws[t, node, f][0])[:most]:
                cut = x[own, f].min() + draws[t, node, f][1] * (x[own, f].max() - x[own, f].min())
                left = own & (x[:, f] <= cut)
                right = own & ~left
                if min(left.sum(), right.sum()) >= s.least:
                    worth = sum(c.sum() * ((y[c].mean()) ** 2 + (1 - y[c].mean()) ** 2) for c in (left, right))
                    if found is None or worth > found[0] + 1e-9:
                        found = (worth, f, cut, left, right)
            if found is None:
                votes[other] += hits / n
                return
            _, f, cut, left, right = found
            grow(left, other & (asked[:, f] <= cut), 2 * node, depth - 1)
            grow(right, other & (asked[:, f] > cut), 2 * node + 1, depth - 1)

        grow(np.ones(len(y), bool), np.ones(len(asked), bool), 1, s.depth)
    return votes / trees


@pytest.mark.parametrize("chunk", [2, 5])
def test_extra_trees_equal_a_loop_with_the_same_draws(spark, chunk):
    x, y, df = rows(spark, seed=3)
    s = T.Extra(trees=4, depth=4, least=5, chunk=chunk)
    p = {(r["model"], r["id"]): r["p"] for r in T.extra_trees(s)(df, ["a", "b", "c"], "y").collect()}
    assert len(p) == 400 + 4 * 40
    grid = spark.createDataFrame([(7, m, t, n, f) for m in range(4) for t in range(4) for n in range(1, 16) for f in range(3)], "seed int, model int, tree int, node long, feature int")
    drawn = {(r["model"], r["tree"], r["node"], r["feature"]): (r["turn"], r["share"]) for r in T.extra_draws(grid).collect()}
    for m in range(4):
        fit = (np.arange(440) < 400) & (np.arange(440) % 4 != m)
        asked = [i for i in range(440) if (m, i) in p]
        want = extra_by_loop(x[fit], y[fit], x[asked], {k[1:]: v for k, v in drawn.items() if k[0] == m}, 4, s)
        assert np.allclose([p[m, i] for i in asked], want, atol=1e-9)


def test_no_row_is_seen_by_its_own_model(spark):
    _, _, df = rows(spark)
    seen = df.groupBy("id").agg(F.count_if(F.col("role") == "train").alias("t"), F.count_if(F.col("role") == "oof").alias("o"), F.count_if(F.col("role") == "sub").alias("s")).collect()
    assert {(r["t"], r["o"], r["s"]) for r in seen} == {(3, 1, 0), (0, 0, 4)}
    # With every label of one fold turned, what its own model says of it stays.
    turned = df.withColumn("y", F.when(F.col("fold") == 1, 1 - F.col("y")).otherwise(F.col("y")))
    both = [{r["id"]: r["p"] for r in M.run(d, M.least_squares(), ["a", "b"], ["y"], ["id"]).filter("role = 'oof' and id % 4 = 1").collect()} for d in (df, turned)]
    assert both[0] == both[1] and len(both[0]) == 100
