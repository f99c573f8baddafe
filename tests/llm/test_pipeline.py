import re

import corpus_pipeline
from tidewater.llm.common import read
from tidewater.llm.jaccard_join import without_near_copies

SF = "/root/testdata/sf0.001"


def sets(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_every_stage_keeps_what_it_should(spark):
    docs = read(spark, SF, "documents")
    columns, stages = docs.columns, dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "jaccard_join", "decontaminate", "pii", "mixing"]
    # Near copies: brute force.
    out = stages["jaccard_join"](spark, docs, SF)
    assert out.columns == columns
    rows = sorted((r["doc_id"], sets(r["text"])) for r in docs.collect())
    comp = {d: d for d, _ in rows}

    def root(d):
        while comp[d] != d:
            d = comp[d]
        return d

    for i, (d, a) in enumerate(rows):
        for e, b in rows[:i]:
            if a and b and 5 * len(a & b) >= 4 * len(a | b):
                p, q = root(d), root(e)
                comp[max(p, q)] = min(p, q)
    assert {r["doc_id"] for r in out.collect()} == {d for d in comp if root(d) == d}


def test_run(spark):
    docs = {r["doc_id"]: r for r in read(spark, SF, "documents").collect()}
    out = corpus_pipeline.run(spark, SF).collect()
    ids = [r["doc_id"] for r in out]
    assert ids and len(set(ids)) == len(ids) and set(ids) <= set(docs)
    for r in out:
        assert r["taken"] >= 1 and not re.search(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r["text"])
        assert r["n_chars"] == len(r["text"])
        if "[" not in r["text"]:
            assert r["text"] == docs[r["doc_id"]]["text"]


def test_stages_keep_ids_and_columns_of_any_name(spark):
    near = " ".join(f"the word{i} and the other{i} of it" for i in range(12))
    rows = [(2**53 + 1, near, "en", "s", 5, 1), (None, near + " end", "en", "s", 5, 2), (2**53 + 2, "the cat and the dog are here", None, None, 5, 3), (2**53 + 4, "", "en", "s", 0, 4), (2**53 + 5, None, "en", "s", None, 5), (3, "the very long text of one word " * 30_000, "en", "t", 9, 6)]
    names = ["c0", "h", "__h", "__doc", "__text", "__row", "__fold", "candidates", "base", "lang_pred", "__lang_pred", "votes", "score", "size", "sid", "row", "node", "tokens"]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, mark int")
    df = df.selectExpr("*", *(f"mark as `{n}`" for n in names))
    kept = {"language_id": {1, 2, 3, 6}, "jaccard_join": {1, 3, 4, 5, 6}, "decontaminate": {1, 2, 3, 4, 5, 6}, "pii": {1, 2, 3, 4, 5, 6}, "mixing": {1, 2, 3, 6}}
    ids = {mark: doc_id for doc_id, *_, mark in rows}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, df, SF)
        found = out.collect()
        assert out.columns == df.columns + ["taken", "target"] * (name == "mixing"), name
        assert {r["mark"] for r in found} <= kept[name] and len(found) >= 2, name
        assert name == "mixing" or {r["mark"] for r in found} == kept[name], name
        assert all(r["doc_id"] == ids[r["mark"]] and all(r[n] == r["mark"] for n in names) for r in found), name
        assert stage(spark, df.limit(0), SF).count() == 0


def test_run_with_empty_and_odd_tables(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    near = " ".join(f"the word{i} and the other{i} of it" for i in range(12))
    odd = [(2**53 + 1, near, "en", "s", 5), (2**53 + 1, near, "en", "s", 5), (None, None, None, None, None), (1, "", "en", "s", 0), (4, "write to a.b@c.de now and then", "en", None, 5)]
    for name, rows in (("empty", []), ("odd", odd)):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/empty").count() == 0
    out = {(r["doc_id"], r["text"]) for r in corpus_pipeline.run(spark, f"{tmp_path}/odd").collect()}
    assert out and out <= {(2**53 + 1, near), (4, "write to [EMAIL] now and then")}


def test_near_copies_of_odd_rows(spark):
    schema = "doc_id long, text string, h long, __x int"
    df = spark.createDataFrame([(1, None, 1, 1), (2, "", 1, 1), (3, "a b", 1, 1), (4, "A  b", 1, 1), (5, "c", 1, 1), (5, "c", 1, 1)], schema)
    out = without_near_copies(df)
    assert out.columns == df.columns and sorted(r["doc_id"] for r in out.collect()) == [1, 2, 3, 5]
    assert without_near_copies(df.limit(0)).count() == 0


def test_one_row_of_each_group_stays_whatever_the_ids_are(spark):
    schema = "doc_id long, text string, h long, __x int"
    near = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty"
    rows = [(5, "c", 1, 1), (5, "c", 1, 2), (None, "d e", 1, 1), (None, "D e", 1, 1), (None, "d e", 1, 1), (7, near, 1, 1), (7, near + " more", 1, 1), (8, "f", 1, 1), (None, "f", 1, 1), (9, "", 1, 1)]
    stage = dict(corpus_pipeline.STAGES)["jaccard_join"]
    out = stage(spark, spark.createDataFrame(rows, schema), SF).collect()
    assert sorted((r["doc_id"] or 0) for r in out) == [0, 5, 7, 8, 9]
