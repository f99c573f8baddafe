import re
from collections import defaultdict

from tidewater.llm.mixing import golden_point, mix, op2_mixing, taken_words
from tidewater.llm.common import read

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, source string, target int, start string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def water_level(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: 1 + i % 3 for i, s in enumerate(order)}
    total, capped = float(sum(sizes.values())), {}
    while True:
        free = [s for s in order if s not in capped]
        rest = total - sum(capped.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s]]
        if not over:
            return capped | share
        capped |= {s: 3.0 * sizes[s] for s in over}


def check(rows, texts):
    sizes = defaultdict(int)
    for source, text in texts:
        sizes[source] += len(WORD.findall(text or ""))
    targets = water_level(sizes)
    taken = defaultdict(int)
    for r in rows:
        assert abs(r["target"] - targets[r["source"]]) < 1e-6 and r["source_size"] == sizes[r["source"]]
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    for s, t in targets.items():
        assert abs(taken[s] - t) <= 1


def test_targets_are_met(spark):
    docs = read(spark, SF, "documents")
    texts = {r["doc_id"]: (r["source"], r["text"]) for r in docs.collect()}
    rows = taken_words(docs).collect()
    check(rows, texts.values())
    assert {r["doc_id"]: r["size"] for r in rows} == {d: len(WORD.findall(t or "")) for d, (_, t) in texts.items()}
    again = {r["doc_id"]: r["taken"] for r in op2_mixing(spark, SF).collect()}
    assert again == {r["doc_id"]: r["taken"] for r in rows}


def test_small_sources_are_capped_and_nulls_are_kept(spark):
    data = [(i, "w " * 40, "big") for i in range(60)] + [(100, "one two", "a"), (101, None, "a"), (102, "x y z", None), (102, "x y z", None), (103, "", "b"), (None, "q r s", "b")]
    df = spark.createDataFrame([(*d, 1, "x") for d in data], SCHEMA)
    rows = taken_words(df, block_words=8).collect()
    assert len(rows) == len(data)
    check(rows, [(s, t) for _, t, s in data])
    assert taken_words(spark.createDataFrame([], SCHEMA)).count() == 0
    assert [r["taken"] for r in taken_words(spark.createDataFrame([(1, None, "a", 1, "x")], SCHEMA)).collect()] == [0]


def test_schedule_is_even(spark):
    docs = spark.createDataFrame([(i, "w " * 64, f"s{i % 3}", 1, "x") for i in range(300)], SCHEMA)
    *_, mixed = mix(docs, block_words=64)
    slots = sorted((r["slot"], r["sid"]) for r in mixed.select("slot", "sid").distinct().collect())
    want = {1: 1 / 6, 2: 2 / 6, 3: 3 / 6}
    half = slots[: len(slots) // 2]
    for sid, share in want.items():
        assert abs(sum(s == sid for _, s in half) / len(half) - share) < 0.03


def test_golden_points_equal_whole_numbers(spark):
    from tidewater.llm.mixing import BITS, GOLDEN
    from pyspark.sql import functions as F

    ids = [0, 1, 2, 12345, (1 << 20) - 1, 1 << 20, (1 << 40) + 12345, (1 << 41) - 1]
    df = spark.createDataFrame([(i,) for i in ids], "i long").select("i", golden_point(F.col("i")).alias("u"))
    assert all(r["u"] == (r["i"] * GOLDEN % (1 << BITS)) / (1 << BITS) for r in df.collect())
