import hashlib
import zlib

from pyspark.sql import functions as F

from tidewater.llm.common import scratch
from tidewater.llm.merkle_manifest import PROOF, _grown, fold, leaf_digest, manifest, op11_merkle, paths

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tree string, proof int, root string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    d, _, lang, source, n, *_ = row
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (d, source, lang, n, text)))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i : i + 16]) for i in range(0, len(out[-1]), 16)])
    return out


def siblings(tree, at):
    for nodes in tree[:-1]:
        run = nodes[at // 16 * 16 : at // 16 * 16 + 16]
        yield "".join(run[: at % 16]), "".join(run[at % 16 + 1 :])
        at //= 16


def brute(rows):
    by = {}
    for r in rows:
        by.setdefault(r[3], []).append(r)
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: levels([leaf(r, r[1]) for r in sorted(by[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1])))]) for s in sources}
    top = levels([trees[s][-1][0] for s in sources])
    for s in sources:
        for i, r in enumerate(sorted(by[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1])))):
            steps = [*siblings(trees[s], i), *siblings(top, sources.index(s))]
            struck = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[1] is not None
            at = leaf(r, r[1].translate({c: c + 32 for c in range(65, 91)})) if struck else leaf(r, r[1])
            for low, high in steps:
                at = h(low, at, high)
            yield r[0], leaf(r, r[1]), trees[s][-1][0], top[-1][0], h(*(a + b for a, b in steps)), at, at == top[-1][0]


def table():
    hot = [(i, f"Text {i}", "en", "hot", i, "x", 1, "y") for i in range(700)]
    many = [(1000 + i, None if i % 9 == 0 else "É Ab" * (i % 3), None, f"s{i % 40}", None, "x", 1, "y") for i in range(120)]
    odd = [(None, "A", "en", None, 1, None, None, None), (None, None, None, None, None, "a", 2, "b"), (2**53 + 1, "Zz" * 50_000, "de", "one", 2**53 + 1, "x", 1, "y")]
    return hot + many + odd + [hot[3], hot[3], odd[0]]


def test_query_equals_brute_force(spark, tmp_path):
    rows = table()
    spark.createDataFrame(rows, SCHEMA).repartition(7).write.parquet(f"{tmp_path}/documents.parquet")
    out = [tuple(r) for r in op11_merkle(spark, str(tmp_path)).collect()]
    assert sorted(out, key=repr) == sorted(brute(rows), key=repr)
    assert sum(not r[-1] for r in out) > 50 and sum(r[-1] for r in out) > 500


def test_blocks_of_every_height_give_the_same_proofs(spark):
    rows = table()
    leaves = spark.createDataFrame(rows, SCHEMA).withColumn("leaf", leaf_digest("doc_id", "source", "lang", "n_chars", "text"))
    found = []
    for height in (1, 2, 3):
        with scratch():
            got = manifest(leaves, height=height)
            assert set(got.columns) == {*leaves.columns, "position", "subroot"} and dict(got.dtypes)["proof"] == PROOF
            got = got.withColumn("ok", fold(F.col("leaf"), F.col("proof")) == F.col("root"))
            found.append(sorted((repr(r["doc_id"]), r["leaf"], r["source"] or "", r["position"], h(*(s["left"] + s["right"] for s in r["proof"])), r["ok"]) for r in got.collect()))
    assert found[0] == found[1] == found[2] and len(found[0]) == len(rows) and all(r[-1] for r in found[0])


def test_paths_are_those_of_the_whole_tree_and_memory_is_bounded():
    nodes = [h(str(i)) for i in range(16**3 - 5)]
    tree = levels(nodes)
    for i, path in enumerate(paths(nodes, 3)):
        if i % 37 == 0 or i > 4000:
            assert path == list(siblings(tree, i))
    work, most = _grown(nodes, 0, 3), 0
    for _ in work:
        most = max(most, sum(len(x) for x in work.gi_frame.f_locals["stack"]))
    assert most <= 16 * 4


def test_empty_table(spark):
    with scratch():
        assert manifest(spark.createDataFrame([], "doc_id long, source string, leaf string")).collect() == []
