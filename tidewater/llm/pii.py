"""Personal data by candidate gradient boosting, on DataFrame functions only.

High-recall generators propose spans that may overlap. Candidates of the base patterns are verified or refuted for good by
their format (Luhn's sum, parts of an address); the other generators propose spans that no format settles. Each candidate
has format and context features with few levels, and a label by votes: its check or weak form rule, and the words before
it, speak for or against it; a tie is no label. Boosted trees are fitted on the counts of all labelled feature vectors of
the corpus, but for a quarter of the documents, drawn by a hash of the text; on those each generator's threshold is
calibrated to the wanted precision. Unsettled candidates at or above it join the base spans, unless they touch one or a
candidate of a higher score.

Positions of matches: the text is split at the pattern, and lengths of gaps and matches are summed up in blocks, so time
stays nearly linear in the matches of a text; all lengths are code points. Patterns are possessive where that changes no
match. ``redact`` cuts its pieces out of chunks of the text, so it is linear too.

Defined results: null text is empty; empty texts have no spans; repeated rows give repeated results; other columns,
whatever their names, are kept by ``redact`` and ignored by ``find``. A very long text is one row in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .boosting import fit, threshold
from .common import read, scratch, written

KINDS = ("email", "ip", "card", "phone")

_LOCAL, _LABEL = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
EMAIL = rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@{_LABEL}++(?:\.{_LABEL}++)++"
IP = r"[0-9](?<![0-9][0-9])[0-9]*+(?:\.[0-9]++){3}"
#: Whole runs of 13 to 19 digits with single separators.
CARD = r"[0-9](?<![0-9][0-9])(?<![0-9][\x20-][0-9])(?:[\x20-]?[0-9]){12,18}+(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Generators beyond the base patterns.
SPELT_EMAIL = rf"(?<!{_LOCAL}){_LOCAL}++ ?[\[(](?:at|AT)[\])] ?{_LABEL}++(?: ?(?:[\[(](?:dot|DOT)[\])]|\.) ?{_LABEL}++)++"
LOCAL_PHONE = r"(?<![0-9+])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])"
ZERO_PHONE = r"(?<![0-9])00[1-9][0-9](?:[ .-]?[0-9]){7,11}(?![0-9])"
MARKED_CARD = r"(?<![0-9._/])[0-9]{4}([._/])[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?![0-9])"

#: Cue words just before a candidate that speak for and against personal data.
CUES = r"(?i)(?:e-?mail|mailto|contact|write to|phone|tel|call|mobile|fax|card|visa|account|pay|ip|host|address)\W{0,3}$"
ANTI = r"(?i)(?:version|order|invoice|isbn|issn|ref|figure|table|page|no|id)\W{0,3}$"
FEATURES = ["generator", "digits", "marks", "before", "after", "cue", "crowd"]
PRECISION = 0.9
#: Matches that are summed up at once, and characters of a chunk of a text.
BLOCK, CHUNK = 256, 1 << 16


def _with_positions(df: DataFrame, text: str, found: str, pattern: str) -> DataFrame:
    """``df`` with the column ``found`` (matches of the pattern in ``text``) as array<struct<start, end, value, head, next>>;
    head are up to 24 characters before the match, and next is the one after it, both as far as no other match goes."""
    gaps, items, offsets = f"{found}_gaps", f"{found}_items", f"{found}_offsets"
    length = lambda x: F.length(x["gap"]) + F.length(x["value"])
    blocks = F.sequence(F.lit(0), F.floor((F.size(items) - 1) / BLOCK).cast("int"))
    part = lambda b: F.slice(F.col(items), b * BLOCK + 1, F.lit(BLOCK))
    totals = F.transform(blocks, lambda b: F.aggregate(part(b), F.lit(0), lambda a, x: a + length(x)))
    summed = F.aggregate(totals, F.array(F.lit(0)), lambda a, t: F.concat(a, F.array(F.element_at(a, -1) + t)))
    empty = F.array().cast("array<struct<start:int,end:int,value:string,head:string,next:string>>")

    def step(acc: Column, x: Column) -> Column:
        start, end = acc["at"] + F.length(x["gap"]), acc["at"] + length(x)
        head, after = F.right(x["gap"], F.lit(24)), x["next"]
        one = F.struct(start.alias("start"), end.alias("end"), x["value"].alias("value"), head.alias("head"), after.alias("next"))
        return F.struct(end.alias("at"), F.concat(acc["spans"], F.array(one)).alias("spans"))

    spans = F.flatten(F.transform(blocks, lambda b: F.aggregate(part(b), F.struct(F.get(F.col(offsets), b).alias("at"), empty.alias("spans")), step)["spans"]))
    some = F.size(found) > 0
    df = df.withColumn(gaps, F.when(some, F.split(text, pattern, -1)))
    df = df.withColumn(items, F.when(some, F.transform(found, lambda v, i: F.struct(
        v.alias("value"), F.get(F.col(gaps), i).alias("gap"), F.substring(F.get(F.col(gaps), i + 1), 1, 1).alias("next")
    ))))
    return df.withColumn(offsets, F.when(some, summed)).withColumn(found, F.when(some, spans).otherwise(empty)).drop(gaps, items, offsets)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    """Whether the digits of ``value`` pass Luhn's sum."""
    back = F.reverse(_digits(value))
    every = F.split(back, "(?<=[0-9])(?=[0-9])")
    doubled = F.transform(every, lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(F.translate(d, "0123456789", "0246813579").cast("int")))
    return F.aggregate(doubled, F.lit(0), lambda a, b: a + b) % 10 == 0


def _octets(value: Column) -> Column:
    return value.rlike(r"^(?:0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?:\.|$)){4}")


#: generator: (kind, pattern, cheap test of the text, check, whether the check settles it: base span or none)
GENERATORS = {
    "email": ("email", EMAIL, lambda t: F.instr(t, "@") > 0, lambda v: F.lit(True), True),
    "ip": ("ip", IP, lambda t: t.rlike("[0-9]"), _octets, True),
    "card": ("card", CARD, lambda t: t.rlike("[0-9]"), luhn, True),
    "phone": ("phone", PHONE, lambda t: F.instr(t, "+") > 0, lambda v: F.length(_digits(v)).between(9, 15), True),
    "spelt": ("email", SPELT_EMAIL, lambda t: t.rlike(r"[\[(](?:at|AT)[\])]"), lambda v: v.rlike("[A-Za-z]{2,}$"), False),
    "local": ("phone", LOCAL_PHONE, lambda t: t.rlike("[0-9]{4}"), lambda v: v.rlike(r"^\(?[2-9][0-9]{2}\D{1,2}[2-9]"), False),
    "zero": ("phone", ZERO_PHONE, lambda t: F.instr(t, "00") > 0, lambda v: v.rlike("[ .-]"), False),
    "marked": ("card", MARKED_CARD, lambda t: t.rlike("[0-9]{4}[._/][0-9]{4}"), luhn, False),
}


def candidates(docs: DataFrame) -> DataFrame:
    """All columns of ``docs`` with ``candidates``: kind, generator, start, end, base, settled, vote, and the other features."""
    df = docs.withColumn("__text", F.coalesce("text", F.lit("")))
    none = F.array().cast("array<string>")
    df = df.withColumns({
        f"__{g}": F.when(test(F.col("__text")), F.regexp_extract_all("__text", F.lit(pattern), F.lit(0))).otherwise(none)
        for g, (_, pattern, test, _, _) in GENERATORS.items()
    })
    crowd = sum((F.size(f"__{g}") for g in GENERATORS), F.lit(0))
    df = df.withColumn("__crowd", F.when(crowd < 3, "few").when(crowd < 20, "some").otherwise("many"))
    for g, x in GENERATORS.items():
        df = _with_positions(df, "__text", f"__{g}", x[1])

    def described(g: str) -> Column:
        kind, _, _, check, settled = GENERATORS[g]

        def one(s: Column) -> Column:
            value, head, good = s["value"], s["head"], check(s["value"])
            n = F.length(_digits(value))
            cue = F.when(head.rlike(CUES), "for").when(head.rlike(ANTI), "against").otherwise("none")
            vote = F.when(good, 1).otherwise(-1) + F.when(cue == "for", 1).when(cue == "against", -1).otherwise(0)
            return F.struct(
                F.lit(kind).alias("kind"), F.lit(g).alias("generator"), s["start"].alias("start"), s["end"].alias("end"),
                (good if settled else F.lit(False)).alias("base"), F.lit(settled).alias("settled"), vote.alias("vote"),
                F.when(n < 4, "0").when(n < 9, "4").when(n < 11, "9").when(n < 13, "11").when(n < 16, "13").when(n == 16, "16").otherwise("17").alias("digits"),
                F.when(value.rlike(r"[()\[]"), "bracket").when(value.rlike(r"[0-9][\x20-][0-9]"), "gap").when(F.instr(value, ".") > 0, "dot").otherwise("none").alias("marks"),
                F.when(head == "", "start").when(head.rlike("[0-9A-Za-z.+-]$"), "joined").when(head.rlike(r"\s$"), "space").otherwise("mark").alias("before"),
                F.when(s["next"] == "", "end").when(s["next"].rlike(r"[\p{L}\p{N}_]"), "joined").otherwise("apart").alias("after"),
                cue.alias("cue"), F.col("__crowd").alias("crowd"),
            )

        return F.transform(f"__{g}", one)

    every = F.concat(*(described(g) for g in GENERATORS))
    return df.select(*docs.columns, every.alias("candidates"), F.pmod(F.xxhash64("__text"), F.lit(4)).alias("__fold"))


def model(found: DataFrame, precision: float = PRECISION):
    """Boosted trees and a threshold per generator from the counts of all labelled feature vectors, of which those of a
    quarter of the texts calibrate.

    At most 8 * 7 * 4 * 4 * 3 * 3 * 3 distinct vectors of each part reach the driver.
    """
    rows = (
        found.select(F.explode("candidates").alias("c"), (F.col("__fold") == 0).alias("held"))
        .filter("c.vote <> 0")
        .groupBy("held", *(F.col(f"c.{f}").alias(f) for f in FEATURES))
        .agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("c.vote") > 0).alias("pos"))
    )
    table = sorted((r.asDict() for r in rows.collect()), key=str)
    trees = fit([r for r in table if not r["held"]], FEATURES)
    return trees, {g: threshold(trees, [r for r in table if r["held"] and r["generator"] == g], precision) for g in GENERATORS}


def _judged(found: DataFrame, trees, least: dict[str, float]) -> DataFrame:
    """``found`` with base and added: arrays of (kind, start, end)."""
    limit = F.create_map(*(x for g, t in least.items() for x in (F.lit(g), F.lit(float(t)))))
    scored = lambda c: F.struct((-trees.expression(lambda f: c[f])).alias("rank"), c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end"), c["generator"].alias("generator"))
    df = found.withColumn("base", F.filter("candidates", lambda c: c["base"]))
    df = df.withColumn("more", F.transform(F.filter("candidates", lambda c: ~c["settled"]), scored))
    df = df.withColumn("more", F.filter("more", lambda c: -c["rank"] >= F.element_at(limit, c["generator"])))
    touch = lambda a, b: (a["start"] < b["end"]) & (b["start"] < a["end"])
    apart = F.filter("more", lambda c: ~F.exists("base", lambda b: touch(b, c)) & ~F.exists("more", lambda b: touch(b, c) & (b < c)))
    slim = lambda a: F.transform(a, lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end")))
    return df.withColumn("added", slim(apart)).withColumn("base", slim(F.col("base"))).drop("more", "candidates")


def find(docs: DataFrame, precision: float = PRECISION) -> DataFrame:
    """doc_id, base and added: arrays of (kind, start, end), in order of kind, then start."""
    found = written(candidates(docs.select("doc_id", "text")).select("doc_id", "candidates", "__fold"))
    return _judged(found, *model(found, precision)).select("doc_id", "base", "added")


def _of_kind(spans: str, kind: str) -> Column:
    return F.array_sort(F.transform(F.filter(spans, lambda s: s["kind"] == kind), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))


def _listed(*spans: str) -> Column:
    ordered = [F.array_sort(F.concat(*(_of_kind(s, k) for s in spans))) for k in KINDS]
    return F.array_join(F.transform(F.concat(*ordered), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(docs: DataFrame, precision: float = PRECISION) -> DataFrame:
    """``docs`` with every span replaced by its kind in square brackets; touching and overlapping spans become one.

    The model is fitted on all of ``docs`` first; spans are found again beside the text, so no text is shuffled.
    """
    with scratch():
        fitted = model(written(candidates(docs.select("text")).select("candidates", "__fold")), precision)
    # All columns stand in one struct, so their names can't clash with those used here.
    rows = docs.select("text", F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__row"))
    spans = F.array_sort(F.transform(F.concat("base", "added"), lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), c["kind"].alias("kind"))))
    # Base spans of two kinds may overlap; one that another covers from before is a part of it.
    merge = lambda acc, s: F.when(
        (F.size(acc) > 0) & (F.element_at(acc, -1)["end"] > s["start"]),
        F.concat(
            F.slice(acc, F.lit(1), F.size(acc) - 1),
            F.array(F.struct(F.element_at(acc, -1)["start"].alias("start"), F.greatest(F.element_at(acc, -1)["end"], s["end"]).alias("end"), F.element_at(acc, -1)["kind"].alias("kind"))),
        ),
    ).otherwise(F.concat(acc, F.array(s)))
    empty = F.array().cast("array<struct<start:int,end:int,kind:string>>")
    some = F.size("__spans") > 0
    df = _judged(candidates(rows), *fitted).withColumn("__spans", spans)
    df = df.withColumn("__spans", F.when(some, F.aggregate("__spans", empty, merge)).otherwise(empty))
    starts = F.sequence(F.lit(0), F.floor(F.length("text") / CHUNK).cast("int"))
    df = df.withColumn("__chunks", F.when(some, F.transform(starts, lambda c: F.substring(F.col("text"), c * CHUNK + 1, F.lit(CHUNK)))))

    def cut(start: Column, end: Column) -> Column:
        one = lambda c: F.substring(F.get("__chunks", c), F.greatest(start - c * CHUNK, F.lit(0)) + 1, end - F.greatest(start, c * CHUNK))
        whole = F.array_join(F.transform(F.sequence(F.floor(start / CHUNK).cast("int"), F.floor((end - 1) / CHUNK).cast("int")), one), "")
        return F.when(end > start, whole).otherwise("")

    before = lambda i: F.when(i > 0, F.get("__spans", i - 1)["end"]).otherwise(0)
    pieces = F.transform("__spans", lambda s, i: F.concat(cut(before(i), s["start"]), F.lit("["), F.upper(s["kind"]), F.lit("]")))
    clean = F.when(some, F.concat(F.array_join(pieces, ""), cut(F.element_at("__spans", -1)["end"], F.length("text")))).otherwise(F.col("text"))
    return df.select(*(clean.alias(c) if c == "text" else F.col("__row").getField(c).alias(c) for c in docs.columns))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    with scratch():
        found = find(read(spark, sf_dir, "documents"))
        counts = [F.size(_of_kind("base", k)).cast("long").alias(f"n_{k}") for k in KINDS]
        out = found.select("doc_id", *counts, F.sha2(_listed("base"), 256).alias("base_sha256"), _listed("base", "added").alias("spans"))
        return written(out, keep=True)
