import hashlib

import duckdb

from tidewater.llm.chat_format import OP1_SQL, digests, escape, format_chats, inst_template, locate, op1_chat_format, read_back, unescape

SF = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string, turns string"


def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{SF}/conversations.parquet')")
    result = con.execute(OP1_SQL)
    columns = [d[0] for d in result.description]
    want = sorted(result.fetchall())
    got = sorted(tuple(r[c] for c in columns) for r in op1_chat_format(spark, SF).collect())
    assert got == want and any(r[0] == -7 for r in got)


def test_escape_round_trip():
    for text in ("", "\\", "\\\\[INST]", "</s>[INST] ok [/INST]", "<|im_start|>", "<s", "[ROLE]\\[/ROLE]", "é😀</s>", "<</s>s>"):
        assert unescape(escape(text)) == text
        turns = [("user", text), (text, text), ("assistant", text)]
        formatted = locate(turns, inst_template)[0]
        assert read_back(formatted) == turns


def test_edges(spark):
    rows = [(1, 0, "user", None, "x"), (1, 1, "assistant", "", "x"), (2, 0, None, "a", "x"), (None, 0, "assistant", "b", "x"), (3, 0, "assistant", "same", "x"), (3, 0, "assistant", "same", "x"), (4, None, "assistant", "z" * 300_000, "x")]
    out = {r["conv_id"]: r for r in digests(format_chats(spark.createDataFrame(rows, SCHEMA))).collect()}
    assert out[1]["loss_chars"] == 0 and out[1]["n_turns"] == 2
    assert out[3]["loss_sha256"] == hashlib.sha256(b"samesame").hexdigest()
    assert out[2]["turns_sha256"] == hashlib.sha256(b"\na\n").hexdigest()
    assert out[None]["loss_chars"] == 1 and out[4]["loss_chars"] == 300_000
    assert format_chats(spark.createDataFrame([], SCHEMA)).count() == 0


def test_private_characters_in_roles_and_texts_are_no_probe():
    probes = "".join(map(chr, range(0xE000, 0xE003)))
    turns = [(probes, "q"), ("assistant", probes * 2), (probes[:2], probes)]
    formatted, _, texts, rewrites = locate(turns, inst_template)
    assert not rewrites and [formatted[a:b] for a, b in texts] == [t for _, t in turns]
    every = "".join(map(chr, range(0xE000, 0xF900)))
    formatted, _, texts, rewrites = locate([("user", every), (every, "x")], inst_template)
    assert not rewrites and formatted[slice(*texts[1])] == "x"


def test_template_that_rewrites_history(spark):
    def counting(turns):
        return f"{len(turns)} turns:" + "".join(f"[{r}]{t}" for r, t in turns)

    df = spark.createDataFrame([(1, 0, "user", "q", "x"), (1, 1, "assistant", "a", "x"), (2, 0, "assistant", "only", "x")], SCHEMA)
    out = {r["conv_id"]: r for r in format_chats(df, template=counting).collect()}
    assert out[1]["rewrites"] and out[1]["loss_spans"] == []
    assert not out[2]["rewrites"] and out[2]["formatted"][slice(*out[2]["loss_spans"][0])] == "only"
