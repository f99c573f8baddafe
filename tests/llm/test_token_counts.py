import base64

import tiktoken

from tidewater.llm.common import read, shared_folder
from tidewater.llm.token_counts import PATTERN, VOCABULARY, Rollup, bpe_counter, counted, deletes, inserts, op9_token_counts

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, source string, lang string, tokens int, docs string"


def encoding():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(VOCABULARY, "rb"))}
    return tiktoken.Encoding("t", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_query_equals_brute_force(spark):
    bpe, totals, seen = encoding(), {}, {}
    rows = sorted(read(spark, SF, "documents").collect(), key=lambda r: r["doc_id"])
    for r in rows:
        seen.setdefault(r["text"], r)
    for r in seen.values():
        a = totals.setdefault((r["source"], r["lang"]), [0, 0])
        a[0] += 1
        a[1] += len(bpe.encode_ordinary(r["text"]))
    out = op9_token_counts(spark, SF).collect()
    got = {(r["source"], r["lang"]): [r["docs"], r["tokens"]] for r in out if r["tokenizer"] == "byte_bpe_50k" and r["docs"]}
    assert got == totals
    assert all(r["docs"] == r["tokens"] == 0 for r in out if r["tokenizer"] == "words")


def test_batches_count_once_and_are_undone(spark):
    rollup = Rollup(spark, shared_folder(spark))
    assert rollup.totals().count() == 0
    rows = spark.createDataFrame([(1, "a b", "s", "en", 2, "x"), (1, "a b", "s", "en", 2, "x"), (2, None, None, None, 0, "x")], SCHEMA)
    assert rollup.commit("a", inserts(rows, "v1")) and not rollup.commit("a", inserts(rows, "v1"))
    rollup.commit("b", deletes(rows.limit(1), "v1"))
    out = {(r["source"], r["lang"]): (r["docs"], r["tokens"]) for r in rollup.totals().collect()}
    assert out == {("s", "en"): (1, 2), (None, None): (1, 0)}
    again = {(r["source"], r["lang"]): (r["docs"], r["tokens"]) for r in rollup.compact(shared_folder(spark)).totals().collect()}
    assert again == out


def test_counts_of_edge_texts(spark):
    long = "ab cd " * 40_000
    rows = [(1, None, "s", "en", 0, "x"), (2, "", "s", "en", 0, "x"), (3, "<|endoftext|>", "s", "en", 0, "x"), (4, long, "s", "en", 0, "x")]
    out = {r["doc_id"]: r["tokens"] for r in counted(spark.createDataFrame(rows, SCHEMA).drop("tokens"), bpe_counter(spark)).collect()}
    assert out[1] == out[2] == 0 and out[3] == len(encoding().encode_ordinary("<|endoftext|>")) > 1
    assert out[4] == len(encoding().encode_ordinary(long))
    assert counted(spark.createDataFrame([], SCHEMA).drop("tokens"), bpe_counter(spark)).count() == 0


def test_long_texts_count_as_whole(spark):
    import random

    r = random.Random(3)
    odd = "".join(r.choice(("  ", "\n\n", " a", "b's", "'re", "12", "½", "漢字", "。", ". ", "Ж", "\x1c", "\u00a0", "-")) for _ in range(3000))
    texts = [odd, "x" * 300_000, "漢" * 3000 + ",", "  " * 2000 + "a", "ab" * 1500 + " " + "cd" * 1500]
    df = spark.createDataFrame([(2**53 + 1 + i, t) for i, t in enumerate(texts)] + [(None, "a b")], "doc_id long, text string")
    for piece in (10, 1000):
        out = {x["doc_id"]: x["tokens"] for x in counted(df, bpe_counter(spark), piece).collect()}
        assert out == {2**53 + 1 + i: len(encoding().encode_ordinary(t)) for i, t in enumerate(texts)} | {None: 2}


def test_repeated_null_texts_count_once(spark, tmp_path):
    rows = [(1, None, "s", "en"), (2, None, "s", "en"), (3, None, "t", "en"), (4, "a b", "s", "en"), (5, "a b", "s", "en"), (6, "", "s", "en")]
    spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    out = op9_token_counts(spark, str(tmp_path)).filter("tokenizer = 'byte_bpe_50k'").collect()
    assert {(r["source"], r["docs"]) for r in out} == {("s", 3), ("t", 0)}
