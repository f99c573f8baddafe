"""Cases that fail where rows meet in another order, or where work grows faster than its input."""

import datetime as dt
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewater.functions import scalars as S
from tidewater.operators import episodes, joins, ridge, signal, stats
from tidewater.plans import registry


def test_mean_above_a_bound_does_not_depend_on_the_order(spark):
    # 33.67 + 1.88 + 0.45 is 36 or 36.00000000000001.
    groups = [(g, 3 * i, v) for g, p in enumerate(permutations([1.88, 0.45, 33.67])) for i, v in enumerate(p)] + [(6, 0, 12.01), (6, 1, 12.0), (7, 0, None), (8, 0, 12.0 + 2**-40), (9, 0, float("inf"))]
    rows = spark.createDataFrame(groups, "g int, i int, v double").coalesce(1).sortWithinPartitions("g", "i")
    found = {r["g"]: r["y"] for r in rows.groupBy("g").agg(S.mean_above(F.col("v"), 12).alias("y")).collect()}
    assert found == {**dict.fromkeys(range(6), False), 6: True, 7: None, 8: True, 9: True}


def _observations(spark, nights=40, seed=3):
    """Nights of 0 to 400 observations: on the minute and between, twice at a time, before and after the grid, null values."""
    rng, rows = np.random.default_rng(seed), []
    for n in range(nights):
        base = dt.datetime(2024, 1, 2 + n % 5)
        for _ in range(1 + int(rng.integers(0, 400) * rng.random() ** 3)):
            second = int(rng.integers(0, 30 * 60)) * 60 + int(rng.choice([0, 0, 30, 59]))
            ts = base + dt.timedelta(seconds=second, microseconds=int(rng.choice([0, 0, 1])))
            rows += [(n // 5, base.date(), ts, None if rng.random() < 0.05 else float(rng.choice([0.5, 1.0, 5.0, 8.0, 9.0, 15.0, 40.0])))] * int(rng.integers(1, 3))
            if rng.random() < 0.2:
                rows.append((n // 5, base.date(), ts, 3.0))
    rows += [(99, dt.date(2024, 1, 9), dt.datetime(2024, 1, 10, 5), 2.0), (98, dt.date(2024, 1, 9), None, 2.0)]
    return spark.createDataFrame(rows, "u int, day date, ts timestamp_ntz, v double")


def _minutes(obs, limit, start, rows):
    nights = obs.select("u", "day").distinct()
    return episodes.nights(nights, {"v": (obs, limit)}, ["u", "day"], "day", start, rows)


def test_spans_fill_the_minutes_that_a_grid_would(spark):
    obs = _observations(spark)
    for limit, start, rows in ((30, 60, 300), (7, 0, 1500)):
        spans = joins.filled_spans(obs, ["u", "day"], "day", "ts", "v", limit, start, rows).collect()
        got = {(r["u"], r["day"], m): r["v"] for r in spans for m in range(r["start"], r["stop"]) if r["v"] is not None}
        want = {(r["u"], r["day"], r["minute"]): r["v"] for r in _minutes(obs, limit, start, rows).collect() if r["v"] is not None}
        assert got == want and {(r["u"], r["day"]) for r in spans} == {(r["u"], r["day"]) for r in obs.collect()}


def test_spans_are_far_fewer_than_minutes(spark):
    obs = _observations(spark)
    assert joins.filled_spans(obs, ["u", "day"], "day", "ts", "v", 30, 0, 1500).count() <= obs.select("u", "day", "ts").distinct().count()
    assert "Generate" not in joins.filled_spans(obs, ["u", "day"], "day", "ts", "v", 30, 0, 1500)._jdf.queryExecution().executedPlan().toString()


def test_onsets_of_spans_are_those_of_minutes(spark):
    obs, v, by = _observations(spark), F.col("v"), ["u", "day"]
    flags = [v < 10, v > 1, v < 9]
    got = episodes.onset_of_spans(joins.filled_spans(obs, by, "day", "ts", "v", 20, 60, 900), by, flags).collect()
    want = episodes.onset(_minutes(obs, 20, 60, 900), by, flags).collect()
    assert {tuple(r) for r in got} == {tuple(r) for r in want} and sum(r["found"] for r in got) > 5


def test_episodes_of_spans_are_those_of_minutes(spark):
    obs, v, by = _observations(spark), F.col("v"), ["u", "day"]
    score = episodes.evidence([v < 10, v < 30, v < 6])
    for rows, nights in ((900, 7), (900, 512), (1, 512), (5, 512)):
        got = episodes.episodes_of_spans(joins.filled_spans(obs, by, "day", "ts", "v", 40, 60, rows), by, score, rows, 0.7, min(rows, 20), 15, rows - 1, nights).collect()
        want = episodes.episodes(_minutes(obs, 40, 60, rows).withColumn("s", score), by, "s", 0.7, min(rows, 20), 15, rows - 1).collect()
        assert {tuple(r) for r in got} == {tuple(r) for r in want} and (got or rows == 1)


def _vectors(spark, n=300, seed=5):
    """Rounded vectors, so many distances tie, some far from the origin; one id without a vector."""
    x = np.random.default_rng(seed).integers(0, 4, (n, 12)) / 4 + np.where(np.arange(n) % 5 == 0, 1000.0, 0.0)[:, None]
    rows = [(i, [float(v) for v in r], i % 7) for i, r in enumerate(x)] + [(n, None, 3)]
    return x, spark.createDataFrame(rows, "id long, x array<float>, v int")


def test_stated_neighbours_equal_a_loop_where_distances_tie(spark):
    x, items = _vectors(spark)
    for metric, far in (("manhattan", lambda d: np.abs(d).sum(axis=1)), ("euclidean", lambda d: np.sqrt((d * d).sum(axis=1)))):
        found = {(r["query"], r["rank"]): (r["item"], r["distance"]) for r in joins.nearest(items.filter("id % 3 = 0"), items, 4, metric, block=40).collect()}
        want = {}
        for q in range(0, len(x), 3):
            d = far(x - x[q])
            best = [i for i in np.lexsort((np.arange(len(x)), d)) if i != q][:4]
            want |= {(q, r + 1): (i, d[i]) for r, i in enumerate(best)}
        assert found == want


def test_subspaces_are_searched_together(spark):
    x, items = _vectors(spark)
    out = stats.subspace_borrow(items.filter("id % 10 = 0"), items, 12, "v", members=9)
    want = {}
    for q in range(0, len(x), 10):
        means = []
        for s in stats.random_subsets(12, 9):
            d = np.abs(x[:, s] - x[q, s]).sum(axis=1)
            means.append(np.mean([i % 7 for i in [i for i in np.lexsort((np.arange(len(x)), d)) if i != q][:2]]))
        want[q] = np.mean(means)
    assert {r["query"]: r["borrowed"] for r in out.collect()} == pytest.approx(want)
    # One search, not one for each member.
    assert out._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    assert joins.nearest(items.limit(0), items, 2).count() == 0 == joins.nearest(items.limit(3), items.limit(0), 2).count()


def test_features_of_many_series_are_those_of_each():
    rng = np.random.default_rng(8)
    for shape in ((64,), (2, 40)):
        model = signal.RandomConvolutions([rng.normal(size=shape) for _ in range(6)], features=168, seed=1)
        series = [rng.normal(size=(*shape[:-1], n)) for n in (shape[-1], 30, shape[-1], 9)]
        found, wide = model.many(series, block=1), [np.atleast_2d(s) for s in series]
        assert (found == model.many(series)).all()
        for row, x in zip(found, wide, strict=True):
            at = 0
            for d, k, chosen, biases, padded in model.plan:
                c = model._convolved(x[chosen].sum(axis=0), d, k)
                c = c if padded or len(c) <= 8 * d else c[4 * d : -4 * d]
                assert (row[at : at + len(biases)] == (c[:, None] > biases).mean(axis=0)).all()
                at += len(biases)


def test_ridges_fitted_together_are_those_fitted_alone(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(120, 4)) + 50
    rows = spark.createDataFrame([(v.tolist(), int(v[0] + v[1] > 100) if i % 9 else None, i % 3) for i, v in enumerate(x)], "x array<double>, y int, fold int")
    together = ridge.fit_together(rows, [ridge.Model(f, np.stack, x[0]) for f in (0, 1, 2, 7)], "x", "fold", "y")
    for f, found in zip((0, 1, 2, 7), together, strict=True):
        alone = ridge.fit(rows.filter(F.col("fold") != f), "x", "y")
        assert found.alpha == alone.alpha and np.allclose(found.weights, alone.weights) and np.isclose(found.base, alone.base)
    assert ridge.fit_together(rows.filter("fold = 1"), [ridge.Model(1, np.stack, x[0])], "x", "fold", "y") == [None]


def test_convolutions_make_one_table_for_all_models(spark, monkeypatch):
    from tidewater.plans import learners

    tables, plain = [], learners.written
    monkeypatch.setattr(learners, "written", lambda df: tables.append(df.columns) or plain(df))
    rows = spark.createDataFrame([(i, [float((i * 7 + j) % 11) for j in range(20)], i % 2, i % 3) for i in range(30)], "id long, x array<double>, y int, fold int")
    out = learners._convolutions(rows, 3, (1, 2), 84, ["id"])
    assert len(tables) == 2 and out.count() == 30


@pytest.mark.parametrize("name", ["q_W1_lag", "q_J12_M20_temporal_prior"])
def test_labels_of_days_whose_mean_is_the_bound(spark, tmp_path, name):
    # Two days of 12 on average, whose floating sums are 36.00000000000001 and 36.
    rows = [(i, dt.datetime(2024, 1, 1 + i // 3, i % 3), 1, "view", v, '{"k": 1}') for i, v in enumerate([1.88, 33.67, 0.45, 1.88, 0.45, 33.67, 13.0, 12.0, 12.0])]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    found = {r["day"]: r for r in registry.queries()[name](spark, str(tmp_path)).collect()}
    assert [found[f"2024-01-0{d}"]["y"] for d in (1, 2, 3)] == [0, 0, 1]
    if name == "q_J12_M20_temporal_prior":
        assert found["2024-01-03"]["prior"] == 0.0 and found["2024-01-01"]["prior"] == round((1 / 9) / (1 / 4 + 1 / 9), 6)
