"""Small cases worked out by hand, and kernels against plain NumPy."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewater.functions import scalars as S
from tidewater.operators import day, episodes, joins, signal, stats, tensors, windows
from tidewater.sources import tables
from tidewater.sources.scratch import shared_folder


def at(h, m=0, s=0, d=1):
    return dt.datetime(2024, 1, d, h, m, s)


def test_as_of_limit_counts_grid_rows_not_time(spark):
    obs = spark.createDataFrame([("a", at(12), 1.0), ("a", at(18, 20, 30), 2.0)], "u string, ts timestamp_ntz, v double")
    grid = spark.createDataFrame([("a", at(18, m)) for m in range(41)], "u string, ts timestamp_ntz")
    out = joins.as_of_steps(grid, obs, ["u"], "ts", "v", 10).collect()
    filled = {r["ts"].minute: r["v"] for r in out if r["v"] is not None}
    assert filled == {**{m: 1.0 for m in range(10)}, **{m: 2.0 for m in range(21, 31)}}


def test_as_of_crosses_chunks_and_keeps_null_observations(spark):
    obs = spark.createDataFrame([("a", at(1), 1.0), ("a", at(1, d=4), None), ("b", at(5), 7.0)], "u string, ts timestamp_ntz, v double")
    left = spark.createDataFrame([("a", at(0)), ("a", at(9, d=3)), ("a", at(9, d=9)), ("b", at(5)), ("c", at(5))], "u string, ts timestamp_ntz")
    out = {(r["u"], r["ts"].day, r["ts"].hour): (r["v"], r["v_at"]) for r in joins.as_of(left, obs, ["u"], "ts", "ts", "v").collect()}
    assert out == {("a", 1, 0): (None, None), ("a", 3, 9): (1.0, at(1)), ("a", 9, 9): (None, at(1, d=4)), ("b", 1, 5): (7.0, at(5)), ("c", 1, 5): (None, None)}


def test_episode_merges_forward_only_below_the_gap(spark):
    spans, t = [], 0
    for length, gap in ((40, 20), (35, 45), (30, 0)):
        spans.append(("n", t, t + length - 1, length))
        t += length + gap
    found = spark.createDataFrame(spans, "k string, start int, stop int, length int")
    row = episodes.merged(found, ["k"]).first()
    assert (row["bed"], row["wake"], row["runs"]) == (0, 95, 3)


def test_runs_and_bouts(spark):
    df = spark.createDataFrame([("a", i, c) for i, c in enumerate([3, 3, 7, 7, 7, 3, 0, 3, 3, 3])], "u string, i int, c int")
    row = windows.bouts(df, ["u"], ["i"], "c", [3]).first()
    assert (row["transitions"], row["max_3"], row["median_3"]) == (4, 3, 2.0)
    assert windows.bouts(df.filter("i < 9"), ["u"], ["i"], "c", [3]).first()["transitions"] is None


def test_on_off(spark):
    df = spark.createDataFrame([("a", i, o) for i, o in enumerate([0, 1, 1, 0, 0, 1])], "u string, i int, o int")
    row = windows.on_off(df, ["u"], ["i"], "o", "i").first()
    assert (row["edges"], row["on_rows"], row["max_off"], row["first_on"], row["last_on"]) == (2, 3, 2, 1, 5)
    off = windows.on_off(df.withColumn("o", F.lit(0)), ["u"], ["i"], "o", "i").first()
    assert (off["first_on"], off["last_on"], off["max_off"]) == (720, 0, 6)


def test_anchor_takes_the_smaller_key_on_ties(spark):
    df = spark.createDataFrame([("a", 1), ("a", 0), ("a", 1), ("a", 0), ("a", None)], "u string, k int")
    assert day.anchor(df, "u", "k").first()["anchor"] == 0


def test_quartile_and_nan(spark):
    df = spark.createDataFrame([("a", v, "morning") for v in (1.0, 2.0, 3.0, 4.0, math.nan)], "u string, x double, bucket string")
    row = day.scalar_stats(df.withColumn("x", S.no_nan(F.col("x"))), ["u"], "x", "x").first()
    assert (row["x_p25"], row["x_mean"], row["x_max"], row["x_morning"]) == (1.75, 2.5, 4.0, 2.5)


def test_expanding(spark):
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate([1.0, None, 3.0, 8.0])], "u string, i int, v double")
    out = windows.expanding_z(df, ["u"], ["i"], "v").orderBy("i").collect()
    assert [r["prior_mean"] for r in out] == [None, 1.0, 1.0, 2.0]
    assert [r["prior_std"] for r in out][:3] == [None] * 3 and math.isclose(out[3]["prior_std"], 2**0.5)


def test_blend_of_a_perfect_view(spark):
    df = spark.createDataFrame([(0.0, 0.3, 0), (1.0, 0.6, 1), (0.0, 0.2, 0)], "m double, n double, y int")
    assert df.agg(stats.blend_weight(F.col("m"), F.col("n"), F.col("y")).alias("a")).first()["a"] == 0.0


def test_temporal_prior(spark):
    df = spark.createDataFrame([("a", dt.date(2024, 1, 1), None), ("a", dt.date(2024, 1, 2), 1), ("a", dt.date(2024, 1, 4), 0)], "u string, d date, y int")
    out = joins.temporal_prior(df, df, "u", "d", "y").filter("y is null").first()
    assert math.isclose(out["prior"], 0.8)


def test_blocked_folds(spark):
    df = spark.createDataFrame([("a", i) for i in range(8)], "u string, d int")
    sizes = {r["block"]: r["count"] for r in windows.blocked_folds(df, "u", ["d"], 6).groupBy("block").count().collect()}
    assert sizes == {0: 2, 1: 2, 2: 1, 3: 1, 4: 1, 5: 1}


def test_simplex_weights_equal_numpy(spark):
    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, 300)
    p = np.clip(y[:, None] * 0.6 + 0.2 + rng.normal(size=(300, 3)) * [0.1, 0.2, 0.3], 0.01, 0.99)
    df = spark.createDataFrame([(*map(float, r), int(v)) for r, v in zip(p, y)], "a double, b double, c double, y int")
    x = p - y[:, None]
    x = x - x.mean(axis=0)
    cov = x.T @ x / len(x)
    mu = np.trace(cov) / 3
    d2 = ((cov - mu * np.eye(3)) ** 2).sum()
    b2 = min(d2, sum(((np.outer(r, r) - cov) ** 2).sum() for r in x) / len(x) ** 2)
    s = b2 / d2 * mu * np.eye(3) + (1 - b2 / d2) * cov
    q = np.maximum(np.linalg.solve(s, np.ones(3)), 0)
    assert np.allclose(stats.simplex_weights(df, ["a", "b", "c"], "y"), q / q.sum(), atol=1e-9)


def test_sample_entropy_equals_a_loop():
    x = np.random.default_rng(1).normal(size=60)
    r = 0.2 * x.std()

    def pairs(m):
        t = [x[i : i + m] for i in range(len(x) - m + 1)]
        return sum(max(abs(a - b)) <= r for i, a in enumerate(t) for b in t[:i])

    assert math.isclose(signal.sample_entropy(x), -math.log(pairs(3) / pairs(2)))
    assert signal.sample_entropy(np.ones(9)) is None


def test_fluctuation_exponent_equals_polyfit():
    x = np.random.default_rng(2).normal(size=64)
    y, points = np.cumsum(x - x.mean()), []
    for n in np.unique(np.round(np.logspace(np.log10(4), np.log10(16), 6)).astype(int)):
        segments = [y[i * n : (i + 1) * n] for i in range(len(x) // n)]
        points.append((n, np.mean([np.sqrt(np.mean((s - np.polyval(np.polyfit(np.arange(n), s, 1), np.arange(n))) ** 2)) for s in segments])))
    want = np.polyfit(*np.log10(np.array(points)).T, 1)[0]
    assert math.isclose(signal.fluctuation_exponent(x), want, rel_tol=1e-9)
    assert signal.fluctuation_exponent(x[:31]) is None


def test_band_powers_find_a_sine():
    t = np.arange(240)
    p = signal.band_powers(np.sin(2 * np.pi * 0.1 * t), {"lf": (0.04, 0.15), "hf": (0.15, 0.4)})
    # The density summed over bins of width 1/120 times that width is the power, a half.
    assert math.isclose(p["lf"] / 120, 0.5, rel_tol=0.02) and p["hf"] < 1e-3
    assert signal.band_powers(np.ones(59), {"lf": (0, 1)}) == {"lf": None}


def test_convolution_features():
    rng = np.random.default_rng(3)
    series = [rng.normal(size=64) for _ in range(5)]
    model = signal.RandomConvolutions(series, features=168)
    x = model(series[0])
    assert len(x) >= 84 and (0 <= x).all() and (x <= 1).all() and (model(series[0]) == x).all()


def test_dense_pool_and_norm(spark):
    cells = spark.createDataFrame([("a", 0, 2.0), ("a", 4, 4.0), ("a", 5, None)], "k string, bin int, x double")
    df = tensors.dense(cells, ["k"], bins=6)
    row = df.select("x", "x_mask", tensors.pooled(F.col("x"), 3).alias("p")).first()
    assert (row["x"], row["x_mask"]) == ([2.0, 0, 0, 0, 4.0, 0], [1, 0, 0, 0, 1, 0]) and np.allclose(row["p"], [2 / 3, 4 / 3])
    share, mean, std = tensors.masked_moments(df, "x", "x_mask")
    assert (round(share, 6), mean, std) == (round(1 / 3, 6), 3.0, 1.0)
    z = df.select(tensors.normalised("x", "x_mask", mean, std).alias("z")).first()["z"]
    assert np.allclose(z, [-1, 0, 0, 0, 1, 0], atol=1e-5)


def test_nearest_in_blocks_equals_numpy(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(40, 5))
    items = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>")
    for block in (20_000, 3):
        out = joins.nearest(items.filter("id % 4 = 0"), items, 2, block=block).orderBy("query", "rank").collect()
        for q in range(0, 40, 4):
            d = np.abs(x - x[q]).sum(axis=1)
            d[q] = np.inf
            assert [r["item"] for r in out if r["query"] == q] == np.argsort(d)[:2].tolist()


def test_sources(spark):
    folder = shared_folder(spark)
    df = spark.createDataFrame([(1, "train"), (2, "sub")], "id int, split string")
    again = tables.write_checked(df, folder, ["split"])
    assert sorted(map(tuple, again.collect())) == [(1, "train"), (2, "sub")]
    kept = tables.write_checked(df.filter("id = 1"), folder, ["split"], reuse=True)
    assert kept.count() == 2
    with pytest.raises(ValueError, match="not unique"):
        tables.key_spine(df, df, ["id"])
    with pytest.raises(ValueError, match="missing"):
        tables.require_columns(df, ["x"])
    with pytest.raises(ValueError, match="probability"):
        tables.require_probabilities(df, ["id"])


def test_convolutions_predict_rows_out_of_fold(spark, monkeypatch):
    from tidewater.plans import learners

    folds = []
    plain = learners.L.fit_predict

    def watched(kind, train, rows, *args, **options):
        folds.append(({r["fold"] for r in train.select("fold").distinct().collect()}, {r["fold"] for r in rows.select("fold").distinct().collect()}))
        return plain(kind, train, rows, *args, **options)

    monkeypatch.setattr(learners.L, "fit_predict", watched)
    sf = "/root/testdata/sf0.001"
    out = learners.convolutions(spark, sf, seeds=(42,)).collect()
    assert all(not a & b for a, b in folds) and set().union(*(b for _, b in folds)) == set(range(6)) == {r["fold"] for r in out}
    assert len(out) == spark.read.parquet(f"{sf}/embeddings.parquet").count()


def test_exact_percentiles_of_columns_and_groups(spark):
    from tidewater.operators.ranks import column_percentiles, percentiles

    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(size=3000), np.repeat(0.25, 1500), rng.integers(0, 5, 500)])
    y = np.where(rng.random(5000) < 0.3, np.nan, 1e6 + np.round(x))
    df = spark.createDataFrame([(float(a), None if np.isnan(b) else float(b), None, i % 3 or None) for i, (a, b) in enumerate(zip(x, y, strict=True))], "v double, w double, none double, g int")
    for share in (0.0, 0.1, 0.5, 0.999, 1.0):
        got = column_percentiles(df, ["v", "w", "none"], share)
        assert np.isclose(got["v"], np.quantile(x, share)) and np.isclose(got["w"], np.nanquantile(y, share)) and got["none"] is None
    own = {r["g"]: r["p"] for r in percentiles(df, ["g"], "v", 0.4).collect()}
    assert all(np.isclose(own[g or None], np.quantile(x[np.arange(5000) % 3 == g], 0.4)) for g in range(3))
    assert column_percentiles(df.limit(0), ["v"], 0.5) == {"v": None}


def test_rank_correlation_equals_that_of_average_ranks(spark):
    from tidewater.operators.ranks import spearman

    rng = np.random.default_rng(3)
    g, x, y = rng.integers(0, 4, 2000), np.round(rng.normal(size=2000), 1), np.round(rng.normal(size=2000) * 1e9)
    y = np.where(g == 1, x * 3, y)
    x = np.where(g == 2, 7.0, x)
    rows = [(int(k) or None, float(a), float(b)) for k, a, b in zip(g, x, y, strict=True)] + [(1, None, 2.0), (1, 3.0, None)]
    got = {r["g"]: (r["r"], r["n"]) for r in spearman(spark.createDataFrame(rows, "g int, x double, y double"), ["g"], "x", "y").collect()}

    def ranks(v):
        return np.array([(v < a).sum() + ((v == a).sum() + 1) / 2 for a in v])

    for k in range(4):
        r, n = got[k or None]
        assert n == (g == k).sum()
        assert r is None if k == 2 else np.isclose(r, np.corrcoef(ranks(x[g == k]), ranks(y[g == k]))[0, 1])


def test_a_query_of_rank_correlations_has_few_shuffles(spark):
    from tidewater.plans.registry import queries

    df = queries()["q_M8_within_between"](spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    executed = df._jdf.queryExecution().executedPlan().toString()
    assert executed.count("Exchange hashpartitioning") <= 9 and plan.count("Relation ") <= 3


def test_values_while_in_a_state(spark):
    from tidewater.operators.joins import while_in_state

    at = "2024-01-01 10:{:02d}:{:02d}"
    values = spark.createDataFrame([(1, at.format(m, 5), float(m)) for m in range(8)] + [(2, at.format(1, 0), 9.0)], "u long, t string, v double")
    states = spark.createDataFrame([(1, at.format(m, 40), m % 2) for m in range(8)], "u long, t string, s int")
    stamp = lambda df: df.selectExpr("*", "to_timestamp_ntz(t) AS ts")
    out = {r["u"]: (r["mean"], r["std"]) for r in while_in_state(stamp(values), stamp(states), ["u"], "ts", "v", "s", 1).collect()}
    assert out[1][0] == 4.0 and abs(out[1][1] - 2.581988897) < 1e-6 and out[2] == (None, None)


def test_ridge_leave_one_out_errors_equal_refits(spark):
    from tidewater.operators.ridge import fit

    rng = np.random.default_rng(4)
    x = rng.normal(size=(60, 5)) * [1, 3, 0.1, 1, 0] + [1e6, 0, 5, 0, 2]
    x[:, 3] = x[:, 1] * 2
    y = (x[:, 1] + rng.normal(size=60) > 0).astype(int)
    df = spark.createDataFrame([(r.tolist(), int(k)) for r, k in zip(x, y, strict=True)], "x array<double>, y int")
    alphas = (0.01, 1.0, 100.0)
    model = fit(df, "x", "y", alphas)
    sd = np.where(x.std(axis=0) > 0, x.std(axis=0), 1)
    z, t = (x - x.mean(axis=0)) / sd, 2.0 * y - 1
    for a in alphas:
        errors = []
        for i in range(60):
            rest = np.arange(60) != i
            zm, tm = z[rest].mean(axis=0), t[rest].mean()
            w = np.linalg.solve((z[rest] - zm).T @ (z[rest] - zm) + a * np.eye(5), (z[rest] - zm).T @ (t[rest] - tm))
            errors.append((t[i] - tm - (z[i] - zm) @ w) ** 2)
        assert np.isclose(model.errors[a], np.mean(errors), rtol=1e-6)
    assert model.alpha == min(alphas, key=model.errors.get)
    w = np.linalg.solve(z.T @ z + model.alpha * np.eye(5), z.T @ (t - t.mean()))
    got = [r["s"] for r in df.select(model.score("x").alias("s")).collect()]
    assert np.allclose(got, z @ w + t.mean(), atol=1e-6) and fit(df.limit(0), "x", "y") is None


def test_convolutions_of_several_channels(spark):
    rng = np.random.default_rng(6)
    series = [rng.normal(size=(3, 64)) for _ in range(8)]
    model = signal.RandomConvolutions(series, features=168, seed=3)
    sizes = {len(chosen) for _, _, chosen, _, _ in model.plan}
    assert sizes == {1, 2, 3}
    df = spark.createDataFrame([(s.tolist(),) for s in series], "x array<array<double>>")
    got = np.array([r["f"] for r in df.select(signal.convolved(F.col("x"), model).alias("f")).collect()])
    at = 0
    for d, k, chosen, biases, padded in model.plan:
        weights = np.where(np.isin(np.arange(9), signal.KERNELS[k]), 2.0, -1.0)
        for n, s in enumerate(series):
            total = np.zeros(64)
            for c in chosen:
                for j in range(9):
                    source = np.arange(64) + (j - 4) * d
                    total += weights[j] * np.where((source >= 0) & (source < 64), s[c, np.clip(source, 0, 63)], 0)
            total = total if padded or 64 <= 8 * d else total[4 * d : -4 * d]
            assert np.allclose(got[n, at : at + len(biases)], [(total > b).mean() for b in biases])
        at += len(biases)
    assert at == got.shape[1]


def test_neighbours_of_all_rows_equal_brute_force(spark):
    from tidewater.operators.neighbours import compared_pairs, nearest_of_all

    rng = np.random.default_rng(8)
    centres = rng.normal(size=(12, 6)) * 20
    x = np.round(centres[rng.integers(0, 12, 900)] + rng.normal(size=(900, 6)), 1)
    x[5] = x[6] = x[7]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>")
    queries, items = df.filter("id % 3 = 0"), df
    got = {}
    for r in nearest_of_all(queries, items, 4, pivots=16, block=100).collect():
        got.setdefault(r["query"], {})[r["rank"]] = (r["item"], r["distance"])
    assert len(got) == 300
    for q, own in got.items():
        far = np.abs(x - x[q]).sum(axis=1)
        far[q] = np.inf
        want = far.argsort(kind="stable")[:4]
        assert np.allclose([own[i][1] for i in range(1, 5)], far[want]) and [own[i][0] for i in range(1, 5)] == want.tolist()
    assert compared_pairs(queries, items, 4, pivots=48, block=100) < 0.3 * 300 * 900
    assert nearest_of_all(queries, items.limit(0), 4).count() == 0


def test_moving_all_coordinates_changes_no_neighbour(spark):
    rng = np.random.default_rng(9)
    x = np.round(rng.normal(size=(60, 3)), 2)
    found = []
    for shift in (0.0, 1e8):
        df = spark.createDataFrame([(i, (v + shift).tolist(), i % 3, float(i % 7)) for i, v in enumerate(x)], "id long, x array<double>, fold int, p double")
        found.append({r["query"]: r["borrowed"] for r in stats.leak_free_borrow(df, "fold", 3, F.lit(True), 2, "p", "uniform", search=stats.all_rows).collect()})
    assert len(found[0]) == 60 and sum(found[0][q] != found[1][q] for q in found[0]) <= 3


def test_platt_of_every_group_equals_newton(spark):
    rng = np.random.default_rng(10)
    rows = []
    for g in ("a", "b", None):
        p = rng.uniform(0.05, 0.95, 200)
        y = (rng.random(200) < p**2).astype(int)
        rows += [(g, float(a), int(b)) for a, b in zip(p, y, strict=True)]
    rows += [("a", 0.3, None), ("one", 0.4, 1), ("one", 0.6, 1)]
    df = spark.createDataFrame(rows, "g string, p double, y int")
    got = {r["g"]: (r["a"], r["b"]) for r in stats.platt_by(df, "g", "p", "y").collect()}
    for g in ("a", "b", None):
        z = np.array([np.log(p / (1 - p)) for k, p, y in rows if k == g and y is not None])
        y = np.array([y for k, _, y in rows if k == g and y is not None], float)
        w, x = np.zeros(2), np.column_stack([z, np.ones(len(z))])
        for _ in range(30):
            q = 1 / (1 + np.exp(-x @ w))
            w += np.linalg.solve((x.T * (q * (1 - q))) @ x + np.diag([1e-6, 1e-12]), x.T @ (y - q) - [1e-6 * w[0], 0])
        assert np.allclose(got[g], w, atol=1e-6)
    out = stats.calibrated_by(df, "g", "p", "y").collect()
    assert all(0 < r["p"] < 1 for r in out) and sum(r["y"] is None for r in out) == 1


def test_a_contract_finds_planted_violations(spark):
    from tidewater.sources import contract as C

    rows = [
        (1, "train", 0.5, [1.0, 0.0], [1, 0], 1), (2, "train", 1.0, [1.0, 2.0], [1, 0], None), (2, "sub", float("nan"), [float("inf"), 0.0], [1, 1], None),
        (None, "sub", None, [1.0], [1, 2], 3), (None, "odd", -1.0, None, None, None),
    ]
    df = spark.createDataFrame(rows, "id int, split string, p double, x array<double>, m array<int>, y int")
    rules = [
        C.Rows(2, 2, "split = 'train'"), C.Rows(9), C.Unique(["id"]), C.Known(["y"], "split = 'train'"), C.Unknown(["y"], "split = 'sub'"), C.Between(["p"], 0, 1, strict=True),
        C.OneOf("split", ["train", "sub"]), C.Shape("x", 2), C.Mask("m", "x"),
    ]
    got = {r["rule"]: (r["violations"], r["ok"]) for r in C.report(df, C.Contract("t", rules, ["id"])).collect()}
    want = [0, 4, 2, 1, 1, 4, 1, 3, 3]
    assert got == {"columns": (0, True)} | {r.name: (n, n == 0) for r, n in zip(rules, want, strict=True)}
    assert sorted(repr(r["id"]) for r in C.violations(df, rules[7]).collect()) == ["2", "None", "None"]
    with pytest.raises(ValueError, match="unique id"):
        C.require(df, C.Contract("t", rules))
    assert C.report(df, C.Contract("t", rules, ["id", "gone"])).collect()[0]["violations"] == 1
    nested = spark.createDataFrame([(1, [[1.0, 2.0]]), (2, [[1.0]]), (3, [[None, 1.0]])], "id int, x array<array<double>>")
    assert C.violations(nested, C.Shape("x", 1, 2)).count() == 2


def test_columns_take_the_class_of_the_first_rule(spark):
    from tidewater.sources import catalogue as G

    a = spark.createDataFrame([], "user int, sleep_hr_mean double, cal_month int, x_missing int, sleep_missing int, odd int")
    b = spark.createDataFrame([], "sleep_hr_mean double, cal_month int")
    rules = [("prefix", "sleep_", "night"), ("prefix", "cal_", "shared"), ("suffix", "_missing", "shared"), ("name", "user", "key")]
    found = G.catalogue(spark, {"a": a, "b": b}, rules)
    got = {r["column"]: (r["class"], r["rule"]) for r in found.filter("table = 'a'").collect()}
    assert got == {"user": ("key", "user"), "sleep_hr_mean": ("night", "sleep_"), "cal_month": ("shared", "cal_"), "x_missing": ("shared", "_missing"), "sleep_missing": ("night", "sleep_"), "odd": ("unclassified", None)}
    assert G.columns_of(found, "a", ["shared", "night"]) == ["sleep_hr_mean", "cal_month", "x_missing", "sleep_missing"]
    assert G.projected(a, found, "a", ["shared"], ["user"]).columns == ["user", "cal_month", "x_missing"]
    over = {(r["a"], r["b"]): (r["shared"], r["jaccard"]) for r in G.overlap(found.filter("table = 'a'"), found.filter("table = 'b'")).collect()}
    assert over == {("night", "night"): (1, 0.5), ("shared", "shared"): (1, 0.5)}
    with pytest.raises(ValueError):
        G.rules_table(spark, [("infix", "x", "y")])


def test_interactions_are_found_and_applied_to_other_rows(spark):
    from tidewater.operators.interactions import Interactions

    rng = np.random.default_rng(12)
    x = rng.normal(size=(600, 4))
    y = (x[:, 0] * x[:, 1] + 0.5 * x[:, 0] + 0.5 * x[:, 1] > 0).astype(int)
    rows = [(i % 5, *(None if i % 50 == j else float(v) for j, v in enumerate(r)), int(k)) for i, (r, k) in enumerate(zip(x, y, strict=True))]
    df = spark.createDataFrame(rows, "u int, a double, b double, c double, d double, y int")
    built = Interactions(["y"], "u", pool=2, best=1)
    kept = built.fit(df, ["a", "b", "c", "d"]).collect()
    assert sorted(built.pooled) == ["a", "b"] and len(kept) == 1 and kept[0]["raw"] > 0.3
    name = built.added[0]
    out = built.transform(spark.createDataFrame([(9, 2.0, None, 1.0, 1.0)], "u int, a double, b double, c double, d double")).first()
    (ma, aa, sa), (mb, ab, sb) = built.state["a"], built.state["b"]
    assert np.isclose(out[name], (2.0 - aa) / sa * (mb - ab) / sb)
    assert Interactions(["y"], "u").fit(df.limit(0), ["a", "b"]).count() == 0
