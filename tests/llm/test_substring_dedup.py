import hashlib
import random
import re

import numpy as np
import pytest

from tidewater.llm.common import read, scratch
from tidewater.llm.fm_index import FMIndex
from tidewater.llm.substring_dedup import op13_substring_dedup, without_repeats

SCHEMA = "doc_id long, text string, id int, h string, marks string, none int"


def brute(rows, window=20):
    """Rows in their order; a tuple (doc_id, n_words, n_removed, kept) each."""
    seen, found = {}, []
    for r in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")
        gone = [False] * len(words)
        for i in range(len(words) - window + 1):
            if seen.setdefault(tuple(words[i : i + window]), (r, i)) != (r, i) or seen.get(("again", id(r), i)):
                gone[i : i + window] = [True] * window
        found.append((r[0], len(words), sum(gone), " ".join(w for w, g in zip(words, gone, strict=True) if not g)))
    return found


def texts(seed, n):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)] + ["É", "Ab", "aB", "漢字"]
    common = [" ".join(r.choices(vocabulary, k=k)) for k in (8, 19, 20, 21, 60, 300)]
    out = []
    for i in range(n):
        parts = [" ".join(r.choices(vocabulary, k=r.randint(0, 60)))]
        for _ in range(r.randint(0, 3)):
            parts += [r.choice(common), " ".join(r.choices(vocabulary, k=r.randint(0, 40)))]
        text = r.choice([" ", "\n", "\t  "]).join(parts)
        if out and r.random() < 0.2:
            words = r.choice(out).split()
            if words:
                words[r.randrange(len(words))] = "changed"
            text = " ".join(words)
        out.append(text)
    return out


def table():
    rows = [(10 + i, t, 1, "x", "y", 2) for i, t in enumerate(texts(3, 250))]
    rows += [(1, None, 1, "x", "y", 2), (2, "", 1, "x", "y", 2), (3, " \n ", 1, "x", "y", 2), (4, "one two", 1, "x", "y", 2), (5, "same " * 500, 1, "x", "y", 2), (6, "a b " * 2000, 1, "x", "y", 2), (2**53 + 1, rows[5][1], 1, "x", "y", 2)]
    return rows


def sorted_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("settings", [{}, {"shard_words": 600}, {"shard_words": 100, "broadcast": 0}, {"gram": 1}])
def test_equals_brute_force(spark, settings):
    """Also with many shards, anchors beyond a shard, and the join instead of a broadcast."""
    rows = table()
    want = sorted(brute(sorted(rows, key=lambda r: r[0])), key=repr)
    with scratch():
        got = sorted_rows(without_repeats(spark.createDataFrame(rows, SCHEMA).repartition(5), **settings))
    assert got == want and sum(r[2] > 0 for r in got) > 100 and sum(r[2] == 0 for r in got) > 20


def test_repeated_rows_and_null_ids(spark):
    text = texts(8, 1)[0] + " " + " ".join(f"own{i}" for i in range(40))
    rows = [(7, text, 1, "x", "y", 2)] * 3 + [(None, text, 1, "x", "y", 2)] * 2 + [(None, "few words", 1, "x", "y", 2)] * 2 + [(9, None, 1, "x", "y", 2)] * 2
    with scratch():
        got = sorted_rows(without_repeats(spark.createDataFrame(rows, SCHEMA)))
    n, kept = len(text.split()), " ".join(text.split())
    assert got == sorted([(7, n, 0, kept), (7, n, n, ""), (7, n, n, ""), (None, n, n, ""), (None, n, n, ""), (None, 2, 0, "few words"), (None, 2, 0, "few words"), (9, 0, 0, ""), (9, 0, 0, "")], key=repr)
    with scratch():
        assert without_repeats(spark.createDataFrame([], SCHEMA)).collect() == []


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    rows = sorted((r["doc_id"], r["text"]) for r in read(spark, sf, "documents").select("doc_id", "text").collect())
    want = [(d, n, g, hashlib.sha256(k.encode()).hexdigest()) for d, n, g, k in brute(rows)]
    got = sorted(tuple(r) for r in op13_substring_dedup(spark, sf).collect())
    assert got == want and sum(r[2] > 0 for r in got) > 50


def test_matching_statistics_of_an_index():
    r = np.random.default_rng(1)
    for _ in range(40):
        depth, symbols = int(r.integers(1, 8)), int(r.integers(1, 5))
        lengths, others = r.integers(0, 15, 6), r.integers(0, 20, 5)
        lengths[0] += 1
        words, more = (r.integers(9, 10 + symbols, x.sum()).astype(np.uint64) for x in (lengths, others))
        index = FMIndex(words, lengths, depth)
        text = index.text(words, lengths)
        for query in (text, index.text(more, others)):
            size, row = index.matching_statistics(query)
            for p in range(len(query)):
                best, place = 0, None
                for t in range(len(text)):
                    n = 0
                    while n < depth and t + n < len(text) and p + n < len(query) and text[t + n] == query[p + n] > 0:
                        n += 1
                    best, place = max((best, place), (n, t), key=lambda x: x[0])
                assert size[p] == best and (best < depth or index.places[row[p]] == place)
