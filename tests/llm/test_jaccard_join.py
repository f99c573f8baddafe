import random
from collections import defaultdict

import duckdb
import pytest

from tidewater.llm.jaccard_join import OP5_SQL, jaccard_components, op5_jaccard_join

SCHEMA = "doc_id long, text string, h string, row long"


def brute(rows, k, num, den):
    sets = []
    for _, text in rows:
        words = (text or "").encode().lower().split()
        width = min(k, len(words))
        sets.append({tuple(words[i : i + width]) for i in range(len(words) - width + 1)} if words else set())
    comp = list(range(len(rows)))
    links = [0] * len(rows)

    def root(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and den * len(a & b) >= num * len(a | b):
                links[i] += 1
                links[j] += 1
                p, q = root(i), root(j)
                comp[max(p, q)] = min(p, q)
    ids = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        ids[root(i)].append(d)
    least = {r: min([d for d in v if d is not None], default=None) for r, v in ids.items()}
    return sorted(((d, len(s), n, least[root(i)]) for i, ((d, _), s, n) in enumerate(zip(rows, sets, links))), key=str)


def run(spark, rows, **options):
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], SCHEMA).repartition(3)
    out = sorted(map(tuple, jaccard_components(df, links=True, **options).select("doc_id", "n_shingles", "n_links", "component_id").collect()), key=str)
    return out


def run_short(spark, rows, **options):
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], SCHEMA).repartition(3)
    return sorted(map(tuple, jaccard_components(df, **options).select("doc_id", "n_shingles", "component_id").collect()), key=str)


def near_copies(seed):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = r.choices(vocabulary, k=60)
    rows = [(1000 + i, " ".join(r.choices(vocabulary, k=r.randint(1, 60)) + (passage if i % 3 == 0 else []))) for i in range(60)]
    for family, n in enumerate((150, 90, 40, 12, 5)):
        base = r.choices(vocabulary, k=n)
        rows.append((2000 + 100 * family, " ".join(base)))
        for i in range(40):
            words = list(base)
            for _ in range(r.randint(0, max(1, n // 40))):
                at = r.randrange(len(words))
                words[at : at + 1] = r.choice(([], ["new" + str(r.randrange(99))], [words[at], "more"]))
            rows.append((2001 + 100 * family + i, " ".join(words)))
    return rows


@pytest.mark.parametrize("options", [dict(k=3, num=90, den=100, group_tokens=2000, slice_tokens=5000), dict(), dict(k=2, num=95, den=100, group_tokens=500), dict(k=3, num=70, den=100, group_tokens=900, slice_tokens=900), dict(k=1, num=60, den=100, group_tokens=300, slice_tokens=300)])
def test_equals_brute_force_on_families_of_near_copies(spark, options):
    rows = near_copies(1)
    wanted = brute(rows, options.get("k", 5), options.get("num", 80), options.get("den", 100))
    assert run_short(spark, rows, **options) == sorted(((d, n, c) for d, n, _, c in wanted), key=str)
    if options.get("k") in (1, 3):
        assert run(spark, rows, **options) == wanted


def test_edges(spark):
    rows = [(None, "a b c d"), (2**53 + 1, "z"), (2**53 + 2, "Z"), (3, "A B c d"), (1, None), (2, ""), (4, " \t\n"), (5, "x"), (6, "X"), (7, "x y"), (8, "y x"), (9, "a b c d"), (9, "a b c d"), (9, "q"), (None, "zz")]
    assert run(spark, rows, k=3, num=90, den=100) == brute(rows, 3, 90, 100)
    assert run_short(spark, [], k=3) == []


def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM read_parquet('/root/testdata/sf0.01/documents.parquet')")
    result = con.execute(OP5_SQL)
    columns = [d[0] for d in result.description]
    got = sorted(tuple(r[c] for c in columns) for r in op5_jaccard_join(spark, "/root/testdata/sf0.01").collect())
    assert got == sorted(result.fetchall())
