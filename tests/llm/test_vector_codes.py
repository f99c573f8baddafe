import hashlib
import math

import numpy as np
import pytest

from tidewater.llm.common import read, scratch
from tidewater.llm.vector_codes import Searcher, codebooks, encoded, op12_vector_codes, quantised

SCHEMA = "vec_id long, embedding array<double>, label int, ints string, code int"


def brute(rows):
    """(vec_id, code, error, label_error, codebooks_sha256), all distances in full."""
    kept = [r for r in rows if r[1] and all(v is not None and math.isfinite(v) for v in r[1])]
    kept = sorted((([math.floor(256 * v) for v in r[1]], r[0], r[2]) for r in kept), key=lambda r: (r[1] is None, r[1] or 0, r[0]))
    width = len(kept[0][0]) // 16
    part = lambda v, p: v[p * width : p * width + width]
    books = [[list(part(v, p)) for v, _, _ in kept[:64]] for p in range(16)]
    distance = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda x, book: min(range(len(book)), key=lambda e: (distance(x, book[e]), e))
    for _ in range(2):
        for p in range(16):
            own = {}
            for v, _, _ in kept:
                own.setdefault(nearest(part(v, p), books[p]), []).append(part(v, p))
            for e, parts in own.items():
                books[p][e] = [sum(c) // len(parts) for c in zip(*parts, strict=True)]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    codes = [[nearest(part(v, p), books[p]) for p in range(16)] for v, _, _ in kept]
    errors = [sum(distance(part(v, p), books[p][c[p]]) for p in range(16)) for (v, _, _), c in zip(kept, codes, strict=True)]
    labels = {}
    for (_, _, label), e in zip(kept, errors, strict=True):
        labels[label] = labels.get(label, 0) + e
    return [(i, "".join(f"{x:02x}" for x in c), e, labels[label], digest) for (_, i, label), c, e in zip(kept, codes, errors, strict=True)]


@pytest.mark.parametrize(("n", "width", "spread"), [(300, 2, 2.0), (40, 1, 0.02), (200, 3, 0.01)])
def test_query_equals_brute_force(spark, tmp_path, n, width, spread):
    """Also with ties and entries that stay unused, as narrow vectors have them, and fewer rows than entries."""
    r = np.random.default_rng(n)
    rows = [(2**53 + 1 + i if i % 9 else -i, r.normal(0, spread, 16 * width).tolist(), int(r.integers(0, 4)) if i % 5 else None, "x", 1) for i in range(n)]
    rows += [rows[3], rows[7], (None, rows[5][1], None, None, None)]
    rows += [(900, None, 1, "x", 1), (901, [], 1, "x", 1), (902, [None] * 16 * width, 1, "x", 1), (903, [math.nan] * 16 * width, 1, "x", 1), (904, [math.inf] + [0.0] * (16 * width - 1), 1, "x", 1)]
    spark.createDataFrame(rows, SCHEMA).repartition(5).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = [tuple(x) for x in op12_vector_codes(spark, str(tmp_path)).collect()]
    assert sorted(got, key=repr) == sorted(brute(rows), key=repr) and len(got) == n + 3


def test_query_on_the_given_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in read(spark, sf, "embeddings").collect()]
    assert sorted(tuple(x) for x in op12_vector_codes(spark, sf).collect()) == sorted(brute(rows)) and len(rows) > 100


def test_partial_distances_are_exact_and_drop_entries():
    r = np.random.default_rng(2)
    for scale, width in ((2, 3), (300, 4), (1 << 24, 8)):
        book, x = (np.floor(r.normal(0, scale, (k, width))).astype(np.int64) for k in (64, 500))
        search = Searcher(book)
        entry, distance = search(x)
        full = ((x[:, None, :] - book) ** 2).sum(axis=2)
        assert (entry == full.argmin(axis=1)).all() and (distance == full.min(axis=1)).all()
        spread = book.astype(float).var(axis=0)
        assert all(spread[a] >= spread[b] * (1 - 1e-9) for a, b in zip(search.order, search.order[1:], strict=False))
        assert search.worked < search.whole if scale < 3 else search.worked < 0.6 * search.whole


def test_edges(spark):
    with scratch():
        assert codebooks(quantised(spark.createDataFrame([], SCHEMA))) is None
        assert codebooks(quantised(spark.createDataFrame([(1, [1.0] * 15, 1, "x", 1)], SCHEMA))) is None
        # Lengths that differ from the first vector's go, huge components count as the bound.
        rows = [(1, [0.5] * 16, 1, "x", 1), (2, [1e300] * 16, 1, "x", 1), (3, [0.5] * 32, 1, "x", 1)]
        vectors = quantised(spark.createDataFrame(rows, SCHEMA).select("vec_id", "embedding", "label"))
        got = encoded(vectors, codebooks(vectors)).collect()
        assert sorted((r["vec_id"], r["error"]) for r in got) == [(1, 0), (2, 0)]
