import itertools
import math
import zlib

import numpy as np

from tidewater.llm.common import read
from tidewater.llm.language_id import Pieces, fit, identify, learned, log_long, of_stated_language, op7_language_id, pieces_of, word_scores

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, lang_pred int, score string"


def test_forward_sums_all_segmentations():
    vocabulary = sorted([b"a", b"b", b"c", b"ab", b"bc", b"abc", b"ca"])
    probs = np.vstack([np.random.default_rng(0).dirichlet(np.ones(7), 2).T, np.zeros(2)])
    of = dict(zip(vocabulary, probs))

    def total(word, lang):
        found = 0.0
        for cuts in itertools.product((0, 1), repeat=len(word) - 1):
            parts, start = [], 0
            for i, c in enumerate((*cuts, 1)):
                if c:
                    parts.append(word[start : i + 1])
                    start = i + 1
            found += math.prod(of[p][lang] if p in of else 0.0 for p in parts)
        return found

    words = ["a", "abc", "cabca", "bbb", "abcabcab"]
    scores = word_scores(words, Pieces(vocabulary), probs)
    for w, s in zip(words, scores):
        assert np.allclose(s, [math.log(max(total(w.encode(), j), 1e-300)) for j in range(2)])


def test_long_words_and_long_pieces_are_whole():
    # A word of any length: the sum over all segmentations by the recursion over prefixes, in exact fractions.
    from fractions import Fraction

    vocabulary = sorted([b"a", b"b", b"ab", b"aab", b"abababababab", b"ba" * 11])
    raw = np.random.default_rng(1).dirichlet(np.ones(6), 3).T
    probs = np.vstack([raw, np.zeros(3)])
    word = "ab" * 45 + "ba" * 30 + "b"
    for lang in range(3):
        of = {p: Fraction(raw[i, lang]) for i, p in enumerate(vocabulary)}
        alpha = [Fraction(1)]
        for end in range(1, len(word) + 1):
            alpha.append(sum(p * alpha[end - len(k)] for k, p in of.items() if len(k) <= end and word[end - len(k) : end].encode() == k))
        exact = math.log(alpha[-1].numerator) - math.log(alpha[-1].denominator)
        pieces = Pieces(vocabulary)
        with np.errstate(divide="ignore"):
            logs = np.log(probs)
        assert np.isclose(word_scores([word], pieces, probs)[0, lang], exact)
        assert all(np.isclose(log_long(word.encode(), pieces, logs, chunk)[lang], exact) for chunk in (1, 7, 50, 1000))


def test_every_letter_piece_of_the_vocabulary_is_found():
    vocabulary = pieces_of()
    pieces = Pieces(vocabulary)
    assert pieces.longest > 16
    for length in (1, 2, 9, 13, pieces.longest):
        own = [p for p in vocabulary if len(p) == length]
        found = pieces.substrings(np.frombuffer(b"".join(own), np.uint8).reshape(len(own), length).astype(np.uint64))
        assert [vocabulary[i] for i in found[length][:, 0]] == own


def test_held_out_accuracy(spark):
    lang = {r["doc_id"]: r["lang"] for r in read(spark, SF, "documents").select("doc_id", "lang").collect()}
    out = op7_language_id(spark, SF).collect()
    assert len(out) == len(lang)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 for r in out)
    held = [r for r in out if r["held_out"]]
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) >= 0.98 * len(held)


def test_edges(spark):
    docs = read(spark, SF, "documents").limit(200)
    model = learned(docs)
    rows = [(1, None, "en", 1, "x"), (2, "", None, 1, "x"), (3, "12 $% 45", "en", 1, "x"), (4, "the " * 300_000, "en", 1, "x"), (5, "the and", "en", 1, "x"), (5, "the and", "en", 1, "x"), (6, "x" * 5000, None, 1, "x"), (None, "", None, 1, "x"), (2**53 + 1, "the and", None, 1, "x")]
    df = spark.createDataFrame(rows, SCHEMA)
    plain = df.select("doc_id", "text")
    out = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in identify(plain, *model).collect()}
    assert out[1] == out[2] == out[3] == ("und", 0.0)
    assert out[4][0] == out[5][0] == "en" and out[6][0] != "und"
    none = learned(df.limit(0))
    assert {r["lang_pred"] for r in identify(plain, *none).collect()} == {"und"}
    assert identify(plain.limit(0), *model).count() == 0
    kept = of_stated_language(df)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == {4, 5, 6, 2**53 + 1}


def test_stage_rejects_other_languages_but_not_quotations(spark):
    docs = read(spark, SF, "documents").limit(400)
    en, fr = (docs.filter(f"lang = '{x}' and n_chars > 500").first()["text"][:500] for x in ("en", "fr"))
    rows = [(-1, fr, "en", "s", 500), (-2, en + " " + fr + " " + fr, "en", "s", 1500), (-3, fr, None, "s", 500), (-5, "$$ 12", "en", "s", 5)]
    gone = {r["doc_id"] for r in docs.unionByName(spark.createDataFrame(rows, docs.schema)).select("doc_id").subtract(
        of_stated_language(docs.unionByName(spark.createDataFrame(rows, docs.schema))).select("doc_id")).collect()}
    assert gone == {-1, -5}


def test_rare_languages_are_learned(spark):
    rows = [(i, "the cat and the dog", "en") for i in range(3000)] + [(5000 + i, "kissa ja koira", "fi") for i in range(2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    languages, _ = fit(df, sorted(bytes([b]) for b in range(256)), train_docs=60)
    assert languages == ["en", "fi"]
