import zlib

import numpy as np

from tidewater.llm.common import read, scratch
from tidewater.llm.toxicity import Trie, features, fit, op6_toxicity, score

SF = "/root/testdata/sf0.1"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_automaton_equals_edit_distance():
    import random

    r = random.Random(0)
    lexicon = {"".join(r.choices("abc", k=r.randint(5, 7))): 1.0 for _ in range(40)}
    for edits in (1, 2):
        trie = Trie(lexicon, edits)
        for _ in range(400):
            w = "".join(r.choices("abcd", k=r.randint(4, 9)))
            found = trie.near(w)
            want = any(distance(w, x) <= edits for x in lexicon) and len(w) >= 5
            assert bool(found) == want and (not found or found[1] == (w in lexicon))


def test_the_largest_weight_in_reach_counts():
    for words in ({"stupad": 1.0, "stupid": 5.0, "scum": 2.0, "scam": 4.0}, {"scam": 4.0, "scum": 2.0, "stupid": 5.0, "stupad": 1.0}):
        trie = Trie(words, swaps=True)
        assert trie.near("stupod") == (5.0, False) and trie.near("scim") == (4.0, False) and trie.near("stupad") == (1.0, True)


def test_large_and_null_ids_and_no_rows(spark):
    docs = spark.createDataFrame([(2**53 + 1, "you horrid fool", 1), (None, "fine words", 1), (3, None, 1)], "doc_id long, text string, score int")
    trie = Trie({"horrid": 3.0})
    weights = np.array([1.0] * 8 + [-2.0])
    out = {r["doc_id"]: r["score"] for r in score(docs, trie, weights).collect()}
    assert set(out) == {2**53 + 1, None, 3} and out[2**53 + 1] > 0.5 > out[None] == out[3]
    none = docs.limit(0)
    with scratch():
        model = fit(none, spark.createDataFrame([], "doc_id long, toxic int"))
    assert score(none, *model).collect() == []


def test_quotation_is_told_apart():
    trie = Trie({"horrid": 3.0})
    plain, quoted, wrong = (features(t, trie, {}) for t in ("you horrid fool", 'the word "horrid" is old', "you horird horrrid fool"))
    assert plain[0] > 0 and plain[4] == 0 and quoted[0] == 0 and quoted[4] > 0 and wrong[2] > 0 and wrong[0] == 0


def test_held_out_ranking(spark):
    toxic = {r["doc_id"]: r["toxic"] for r in read(spark, SF, "labels").collect()}
    out = [r for r in op6_toxicity(spark, SF).collect() if r["doc_id"] in toxic]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and r["predicted"] == (r["score"] >= 0.5) for r in out)
    held = [r for r in out if r["held_out"]]
    pos, neg = ([r["score"] for r in held if toxic[r["doc_id"]] == y] for y in (1, 0))
    auc = sum((p > n) + (p == n) / 2 for p in pos for n in neg) / len(pos) / len(neg)
    right = sum(r["predicted"] == toxic[r["doc_id"]] for r in held) / len(held)
    print("auc", auc, "accuracy", right, len(pos), len(neg))
    assert auc >= 0.9 and right >= 0.9


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "bad bad", "x"), (3, "bad bad", "x"), (4, "word " * 200_000, "x")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in score(docs, *fit(docs, labels)).collect()} == {0.0}
    some = spark.createDataFrame([(i, 1, int(i % 2)) for i in range(200)] + [(3, None, None)], labels.schema)
    texts = spark.createDataFrame([(i, "awful thing" if i % 2 else "nice thing", "x") for i in range(200)], docs.schema)
    trie, w = fit(texts, some)
    out = {r["doc_id"]: r["score"] for r in score(texts, trie, w).collect()}
    assert all((s > 0.5) == bool(i % 2) for i, s in out.items())
    assert score(docs, trie, w).count() == 5


def test_disguised_words_are_found():
    trie = Trie({"idiot": 3.0, "stupid": 3.0, "loser": 3.0, "scum": 3.0, "ass": 3.0}, swaps=True)
    for text in ("an id1ot here", "so st*pid!", "a l0ser.", "such scvm", "you idoit", "a socum-less scmu", "$tupid one"):
        assert features(text, trie, {})[2] > 0, text
    assert features("idiot-like", trie, {})[0] > 0 and features("idiot!", trie, {})[0] > 0
    for text in ("a lesser man", "an as", "the sum of 12.5", "scu"):
        assert features(text, trie, {}) == (0.0,) * 8, text
