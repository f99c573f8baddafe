import math

import numpy as np
import pytest

from tidewater.llm.embedding_dedup import near_components, op4_embedding_dedup

SCHEMA = "vec_id long, embedding array<float>, label int, row string"


def brute(rows, threshold=0.9):
    ok = []
    for i, (_, v) in enumerate(rows):
        x = None if v is None or any(c is None for c in v) else np.array(v, np.float32).astype(float)
        ok.append(x if x is not None and len(x) and np.isfinite(x).all() and x.any() else None)
    links, comp = [0] * len(rows), list(range(len(rows)))

    def root(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            a, b = ok[i], ok[j]
            if a is not None and b is not None and len(a) == len(b) and a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= threshold:
                links[i] += 1
                links[j] += 1
                p, q = root(i), root(j)
                comp[max(p, q)] = min(p, q)
    ids = {}
    for i, (d, _) in enumerate(rows):
        ids.setdefault(root(i), []).append(d)
    least = {r: min([d for d in v if d is not None], default=None) for r, v in ids.items()}
    return sorted(((d, n, least[root(i)]) for i, ((d, _), n) in enumerate(zip(rows, links))), key=str)


def run(spark, rows, **options):
    df = spark.createDataFrame([(d, v, 0, "x") for d, v in rows], SCHEMA).repartition(3)
    out = near_components(df, **options).collect()
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in out)
    return sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in out), key=str)


def test_families_and_hot_cells_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=16).tolist()) for i in range(300)]
    base = rng.normal(size=16)
    rows += [(1000 + i, (base + rng.normal(size=16) * rng.choice([0.02, 0.2])).tolist()) for i in range(250)]
    rows += [(2000 + i, base.tolist()) for i in range(60)]
    rows += [(3000 + i, (3 * base).tolist()) for i in range(3)]
    got, want = run(spark, rows, recall=1.0, block=32), brute(rows)
    linked = sum(n for _, n, _ in want)
    assert sum(n for _, n, _ in got) >= 0.999 * linked
    assert sum(a == b for a, b in zip(got, want)) >= 0.98 * len(want)


def test_verified_pairs_with_unlike_sketches_count_once(spark, monkeypatch):
    from tidewater.llm import embedding_dedup as E

    usual = E.MultiIndex.__init__

    def narrow(self, *args):
        usual(self, *args)
        self.bound //= 3

    monkeypatch.setattr(E.MultiIndex, "__init__", narrow)
    rng = np.random.default_rng(3)
    base = rng.normal(size=16)
    rows = [(i, (base + rng.normal(size=16) * 0.2).tolist()) for i in range(200)] + [(500 + i, base.tolist()) for i in range(5)]
    got, want = run(spark, rows, recall=1.0, block=32), brute(rows)
    assert all(a[1] <= b[1] for a, b in zip(got, want, strict=True)) and sum(n for _, n, _ in got) >= 0.97 * sum(n for _, n, _ in want)


def test_recall_of_random_partners(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(1200, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    away = rng.normal(size=x.shape)
    away -= (away * x).sum(axis=1, keepdims=True) * x
    y = 0.92 * x + (1 - 0.92**2) ** 0.5 * away / np.linalg.norm(away, axis=1, keepdims=True)
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([x, y]))]
    out = run(spark, rows)
    assert sum(n for _, n, _ in out) / 2400 >= 0.95
    assert all(c in (i, i - 1200) for i, _, c in out)


def test_edges(spark):
    nan, one = math.nan, [1.0, 2.0, 3.0]
    rows = [(1, None), (2, []), (3, [0.0, 0.0, 0.0]), (4, [1.0, None, 2.0]), (5, [nan, 1.0, 1.0]), (6, [math.inf, 1.0, 1.0]), (7, one), (None, one), (7, one), (9, [2.0, 4.0]), (10, [1.0, 2.0]), (11, [-1.0, -2.0, -3.0]), (2**53 + 1, [5.0, -1.0, 0.0]), (2**53 + 2, [5.0, -1.0, 0.0])]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []
    assert run(spark, [(1, None)]) == [(1, 0, 1)]


def test_recall_where_the_first_rows_are_tight_topics(spark):
    rng = np.random.default_rng(6)
    topics = rng.normal(size=(15, 64))
    tight = topics[np.arange(1500) // 100] + 0.02 * rng.normal(size=(1500, 64))
    x = rng.normal(size=(1500, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    away = rng.normal(size=x.shape)
    away -= (away * x).sum(axis=1, keepdims=True) * x
    y = 0.905 * x + (1 - 0.905**2) ** 0.5 * away / np.linalg.norm(away, axis=1, keepdims=True)
    table = [(i, v.tolist(), 0, "x") for i, v in enumerate(np.concatenate([tight, x, y]))]
    out = near_components(spark.createDataFrame(table, SCHEMA).coalesce(1)).filter("vec_id >= 1500").collect()
    assert sum(r["n_links"] for r in out) / 3000 >= 0.95


def test_query_finds_planted_links(spark, tmp_path):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(900, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    away = rng.normal(size=x.shape)
    away -= (away * x).sum(axis=1, keepdims=True) * x
    away /= np.linalg.norm(away, axis=1, keepdims=True)
    cosine = rng.uniform(0.86, 0.99, size=(900, 1))
    y = cosine * x + (1 - cosine**2) ** 0.5 * away
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([x, y, x[:30]]))]
    spark.createDataFrame([(d, v, 0, "x") for d, v in rows], SCHEMA).write.parquet(f"{tmp_path}/embeddings.parquet")
    out = op4_embedding_dedup(spark, str(tmp_path))
    assert out.columns == ["vec_id", "n_links", "component_id", "kept"]
    got, want = {r["vec_id"]: r for r in out.collect()}, {d: (n, c) for d, n, c in brute(rows)}
    assert all(r["n_links"] <= want[d][0] and r["kept"] == (r["component_id"] == d) for d, r in got.items())
    assert sum(r["n_links"] for r in got.values()) >= 0.95 * sum(n for n, _ in want.values())
    assert sum(r["component_id"] == want[d][1] for d, r in got.items()) >= 0.95 * len(want)
