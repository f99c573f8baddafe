import hashlib
import random
import re

from tidewater.llm.common import read
from tidewater.llm.pii import op3_pii, find, redact, _listed, KINDS
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, candidates int, base string"


def luhn(v):
    d = [int(c) for c in v if c.isdigit()][::-1]
    return sum(x if i % 2 == 0 else (x * 2 - 9 if x > 4 else x * 2) for i, x in enumerate(d)) % 10 == 0


def digits(v):
    return len(re.sub("[^0-9]", "", v))


BASE = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda v: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda v: all(int(p) <= 255 for p in v.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda v: 13 <= digits(v) <= 19 and luhn(v)),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda v: 9 <= digits(v) <= 15),
}


def brute(text):
    return [f"{k}:{m.start()}:{m.end()}" for k, (p, ok) in BASE.items() for m in re.finditer(p, text or "") if ok(m[0])]


def noise(seed, n):
    r = random.Random(seed)
    pieces = ["a", "B9", "@", ".", "..", "-", "+", " ", "  ", "(", ")", "1", "42", "255", "256", "192.168.0.1", "4111 1111 1111 1111", "+1 (555) 010-9999", "x@y.zz", "é", "😀", "%", "_", "\n", "[at]", "[dot]", "555-123-4567", "4111-1111-1111-1112"]
    return [(i, "".join(r.choices(pieces, k=r.randint(0, 40)))) for i in range(n)]


def test_base_spans_equal_brute_force(spark):
    rows = noise(1, 1500) + [(-1, None), (-2, ""), (-3, "7" * 50_000), (-4, "a." * 20_000 + "@"), (-5, "+1" + " 2" * 20_000), (-6, "1." * 30_000), (-7, "4111111111111111" * 3000), (-8, "0" * 12 + " a@b.c.d.e@f.g")]
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], SCHEMA).repartition(4)
    out = {r["doc_id"]: r for r in find(df).select("doc_id", _listed("base").alias("b"), _listed("base", "added").alias("s")).collect()}
    for d, t in rows:
        assert out[d]["b"] == ",".join(brute(t)), (t or "")[:200]
        assert set(filter(None, out[d]["b"].split(","))) <= set(out[d]["s"].split(","))


def test_query(spark):
    texts = {r["doc_id"]: r["text"] for r in read(spark, SF, "documents").collect()}
    out = op3_pii(spark, SF).collect()
    assert len(out) == len(texts)
    for r in out:
        want = brute(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in KINDS] == [sum(s.startswith(k + ":") for s in want) for k in KINDS]


def test_redact_removes_all_base_spans_and_nothing_else(spark):
    rows = noise(2, 300) + [(-1, None), (-2, "")]
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], SCHEMA)
    spans = {r["doc_id"]: r["s"] for r in find(df).select("doc_id", _listed("base", "added").alias("s")).collect()}
    out = {r["doc_id"]: r["text"] for r in redact(df).collect()}
    for d, t in rows:
        if t is None:
            assert out[d] is None
            continue
        found = sorted((int(a), int(b), k) for k, a, b in (s.split(":") for s in spans[d].split(",") if s))
        merged = []
        for a, b, k in found:
            if merged and a < merged[-1][1]:
                merged[-1][1] = max(b, merged[-1][1])
            else:
                merged.append([a, b, k])
        want, at = "", 0
        for a, b, k in merged:
            want, at = want + t[at:a] + f"[{k.upper()}]", b
        assert out[d] == want + t[at:], t
    assert redact(df).columns == df.columns and redact(df.limit(0)).count() == 0


def test_planted_data_that_no_base_pattern_sees_is_added_and_refuted_candidates_are_not(spark):
    r = random.Random(5)
    n = lambda k: "".join(r.choice("0123456789") for _ in range(k))

    def card(mark):
        body = "4" + n(14)
        last = next(str(d) for d in range(10) if luhn(body + str(d)))
        whole = body + last
        return mark.join(whole[i : i + 4] for i in range(0, 16, 4))

    rows, added, refuted = [], {}, {}
    for i in range(300):
        planted = [
            ("email", f"ann{i} [at] mail{i % 9} [dot] org"), ("phone", f"(3{n(2)}) 5{n(2)}-{n(4)}"), ("card", card(".")), ("phone", f"0044 {n(3)} {n(3)} {n(2)}"),
        ]
        wrong = ["4111 1111 1111 1112", "300.12.14.9", "+12 34 5"]
        kind, value = planted[i % 4]
        bad = wrong[i % 3]
        head = f"words of text number x write to me {('e-mail', 'tel', 'card', 'phone')[i % 4]}: "
        middle = f" and then some more of it, {bad} is none; also a.b{i}@c.de "
        rows.append((i, head + value + middle))
        added[i] = f"{kind}:{len(head)}:{len(head) + len(value)}"
        at = len(head + value) + middle.index(bad)
        refuted[i] = (at, at + len(bad))
    out = {x["doc_id"]: x["s"].split(",") for x in find(spark.createDataFrame([(d, t, 1, "x") for d, t in rows], SCHEMA)).select("doc_id", _listed("base", "added").alias("s")).collect()}
    assert {i: (rows[i][1], out[i]) for i in added if added[i] not in out[i]} == {}
    spans = {i: [tuple(map(int, x.split(":")[1:])) for x in out[i]] for i in out}
    assert not any(a < refuted[i][1] and refuted[i][0] < b for i in out for a, b in spans[i])
    assert all(len(set(x)) == len(x) == sum(1 for _ in x) and all(b <= c for (_, b), (c, _) in zip(sorted(x), sorted(x)[1:])) for x in spans.values())


def test_many_matches_in_a_long_text(spark):
    text = "".join(f"x{i}@y.zz, " for i in range(3000)) + "é" * 70_000 + " +1 (555) 010-9999 " + "z" * 70_000
    out = find(spark.createDataFrame([(2**53 + 1, text, 1, "x"), (None, "a@b.cd", 1, "x")], SCHEMA)).select("doc_id", _listed("base").alias("b")).collect()
    assert {x["doc_id"]: x["b"] for x in out} == {2**53 + 1: ",".join(brute(text)), None: "email:0:6"}
    clean = redact(spark.createDataFrame([(1, text, 1, "x")], SCHEMA)).first()["text"]
    assert clean == "[EMAIL], " * 3000 + "é" * 70_000 + " [PHONE] " + "z" * 70_000


def test_only_native_operators(spark):
    plan = find(spark.createDataFrame([(1, "a@b.c", 1, "x")], SCHEMA))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|ArrowEval", plan)


def test_spelt_addresses_of_any_length(spark):
    from tidewater.llm.pii import candidates

    text = "me (at) a" + " (dot) b" * 20_000
    got = candidates(spark.createDataFrame([(1, f"write to {text}, please")], "doc_id long, text string")).first()["candidates"]
    assert [(c["generator"], c["start"], c["end"]) for c in got] == [("spelt", 9, 9 + len(text))]
