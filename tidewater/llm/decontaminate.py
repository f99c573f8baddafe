"""Benchmark decontamination by template canonicalisation, on DataFrame functions only.

Numbers, names and units become typed placeholders, punctuation and case go, and texts become sequences of template
words. Windows of five template words of the benchmark are hash-joined with those of the documents. A document holds an
item if it has at least ``least`` (0.8) of the item's distinct windows, or covers as large a share of the item's words (8 or
more) with them, or holds ``RUN`` (13) template words of it in a row; and the slots agree: along each alignment of the
two sequences, an item's value of a type always meets one and the same value of the document, and no other item's value
meets that.
So a question with other numbers, one with an edited word and a long part of one are found, and a mere likeness in form is
not.

All that is done twice, and a pair of either is found: with names as placeholders, and with names as words like others,
in lower case. Names are capitalised words wherever they stand, the first of a sentence too; several in a row are one
placeholder. So exchanged names are found, and copies in another case or context don't depend on what is a name. Names
that are exchanged in a text without capitals are not seen: they count as edited words.

Windows without two literal words carry no evidence and are not built. An item with fewer than five template words is one
window of its own length. An item without any usable window is looked for word by word and then, without white space and
case, as it stands; one of fewer than three words must be the whole document.

Values are looked up again only in documents that hold enough windows. The benchmark's windows are broadcast when their
counted number is within the bound, else Spark shuffles both sides by hash; documents emit one row per matching window.

Defined results: null and empty texts match nothing, nor do items without letter and digit; rows with one doc_id count as
one document, and a null doc_id is one; repeated items match alike; empty tables give no rows; other columns,
whatever their names, are ignored here and kept by ``without_benchmark``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import read, scratch, small, written

WINDOW = 5
LEAST = 0.8
#: Words of an item that must be covered at least for a share of words to count, and template words in a row that suffice.
COVERED = 8
RUN = 13
#: Groups are possessive: nothing follows them, so they match the same, and a run of any length needs no stack.
NUMBER = r"[0-9]+(?:[.,:/][0-9]+)*+"
#: Capitalised words, also the first of a sentence, with single spaces between them.
NAME = r"(?=\p{Lu})(?<![\p{L}\p{N}])\p{Lu}\p{Ll}\p{L}*(?:[ ]\p{Lu}\p{Ll}\p{L}*)*+"
#: Units (the second group) that follow a number.
UNITS = "km kg mg cm mm m g l ml s ms h min hours hour minutes minute seconds days day weeks week months month years year miles mile feet foot inches inch pounds pound dollars dollar euros euro cents percent degrees litres liters meters metres grams usd eur"
UNIT = rf"(?i)(qnumq )(\s*(?:{'|'.join(UNITS.split())})(?![\p{{L}}\p{{N}}])|\s*[%$€£°])"
SLOTS = ("qnumq", "qnameq", "qunitq")
#: What becomes a placeholder: numbers, units and names; numbers and units; nothing.
NAMES, CASELESS, PLAIN = "names", "caseless", "plain"


def _without_numbers(text: Column) -> Column:
    return F.when(text.rlike("[0-9]"), F.regexp_replace(text, NUMBER, " qnumq ")).otherwise(text)


def _without_units(text: Column) -> Column:
    units = F.regexp_replace(F.regexp_replace(text, NUMBER, " qnumq "), UNIT, "$1 qunitq ")
    return F.when(text.rlike("[0-9]") | (F.instr(text, "qnumq") > 0), units).otherwise(text)


def template_words(text: Column, kind: str = NAMES) -> Column:
    """Array of template words; placeholders are ``qnumq``, ``qnameq`` and ``qunitq``."""
    canonical = text if kind == PLAIN else _without_units(text)
    canonical = F.regexp_replace(canonical, NAME, " qnameq ") if kind == NAMES else canonical
    return F.array_remove(F.split(F.lower(canonical), r"[^\p{L}\p{N}]+"), "")


def slot_values(text: Column, kind: str = NAMES) -> dict[str, Column]:
    """Values of each placeholder, in order of the text."""
    found = {
        "qnumq": F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0)),
        "qunitq": F.transform(F.regexp_extract_all(_without_numbers(text), F.lit(UNIT), F.lit(2)), lambda u: F.lower(F.btrim(u))),
    }
    return found | ({"qnameq": F.regexp_extract_all(_without_units(text), F.lit(NAME), F.lit(0))} if kind == NAMES else {})


def windows(df: DataFrame, key: str, sizes: list[int], kind: str = NAMES) -> DataFrame:
    """key, size, pos, hash for every window of the texts that has two literal words (one if it is that short).

    Only places are exploded; a window's hash comes from its words' hashes in the compiled projection above.
    """
    words = df.select(key, F.transform(template_words(F.coalesce("text", F.lit("")), kind), lambda w: F.xxhash64(w)).alias("words"))
    slots, out = [F.xxhash64(F.lit(s)) for s in SLOTS], None
    for n in sizes:
        last = F.size("words") - n
        placed = words.select(key, "words", F.explode(F.when(last >= 0, F.sequence(F.lit(0), last))).alias("pos"))
        own = [F.get("words", F.col("pos") + k) for k in range(n)]
        literal = sum((F.when(w.isin(slots), 0).otherwise(1) for w in own), F.lit(0))
        part = placed.filter(literal >= min(2, n)).select(key, F.lit(n).alias("size"), "pos", F.xxhash64(*own).alias("hash"))
        out = part if out is None else out.unionByName(part)
    return out


def wanted_windows(items: DataFrame, window: int, kind: str = NAMES) -> tuple[DataFrame, list[int]]:
    """item_id, size, words (their number in the item), hash, item_pos (places) of the items' windows, and the sizes."""
    n = F.size(template_words(F.coalesce("text", F.lit("")), kind))
    own = items.select("item_id", n.alias("words"), F.least(n, F.lit(window)).alias("size")).filter("words > 0")
    sizes = sorted(own.agg(F.collect_set("size").alias("sizes")).first()["sizes"])  # at most ``window`` values
    if not sizes:
        return items.sparkSession.createDataFrame([], "item_id long, size int, words int, hash long, item_pos array<int>"), sizes
    found = windows(items, "item_id", sizes, kind).join(own, ["item_id", "size"])
    return written(found.groupBy("item_id", "size", "hash").agg(F.max("words").alias("words"), F.sort_array(F.collect_set("pos")).alias("item_pos"))), sizes


def _longest(places: str) -> Column:
    """Largest number of consecutive numbers in a sorted array."""
    now = "IF(p = a.last + 1, a.now + 1, 1)"
    start = "named_struct('last', -2, 'now', 0, 'best', 0)"
    return F.expr(f"aggregate({places}, {start}, (a, p) -> named_struct('last', p, 'now', {now}, 'best', greatest(a.best, {now})), a -> a.best)")


def _slots(df: DataFrame, key: str, kind: str) -> DataFrame:
    """key, at (place in the template), type, value: a row per placeholder."""
    text = F.coalesce("text", F.lit(""))
    values = slot_values(text, kind)
    rows = df.select(key, template_words(text, kind).alias("words"), *(v.alias(f"v_{k}") for k, v in values.items()))
    placed = []
    for slot in values:
        both = rows.select(key, _places("words", slot).alias("at"), F.col(f"v_{slot}").alias("value"))
        placed.append(both.select(key, F.lit(slot).alias("type"), F.explode(F.arrays_zip("at", "value")).alias("s")))
    out = placed[0]
    for p in placed[1:]:
        out = out.unionByName(p)
    return out.select(key, F.col("s.at").alias("at"), "type", F.col("s.value").alias("value")).filter(F.col("at").isNotNull())


def _places(words: str, kind: str) -> Column:
    every = F.transform(F.col(words), lambda w, i: F.when(w == kind, i))
    return F.filter(every, lambda i: i.isNotNull())


def _matches(docs: DataFrame, wanted: DataFrame, sizes: list[int], kind: str = NAMES) -> tuple[DataFrame, DataFrame]:
    """A row per window of a document that an item has; and per pair its matched windows and their places in the item."""
    n, places = wanted.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("item_pos")), F.lit(0))).first()
    row_bytes = 64 + 4 * places // max(n, 1)
    totals = wanted.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_windows"), F.max("words").alias("words"))
    hits = windows(docs.select("doc_id", "text"), "doc_id", sizes, kind).join(small(wanted.drop("words"), n, row_bytes), ["size", "hash"])
    hits = written(hits.select("doc_id", "item_id", "size", "hash", "pos", "item_pos"))
    per = hits.groupBy("doc_id", "item_id", "size", "hash").agg(F.first("item_pos").alias("item_pos")).groupBy("doc_id", "item_id").agg(
        F.count(F.lit(1)).alias("matched"), F.max("size").alias("size"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("item_pos")))).alias("places")
    )  # no more places than the item has words
    return hits, per.join(small(totals, n), "item_id")


def _templates(docs: DataFrame, items: DataFrame, wanted: DataFrame, sizes: list[int], least: float, window: int, kind: str) -> DataFrame:
    """Documents and the items of which they hold enough windows, with agreeing slots."""
    hits, per = _matches(docs, wanted, sizes, kind)
    covered = F.size(F.array_distinct(F.flatten(F.transform("places", lambda p: F.sequence(p, p + F.col("size") - 1)))))
    whole = (F.col("matched") >= least * F.col("n_windows")) | ((covered >= least * F.col("words")) & (covered >= COVERED))
    in_a_row = RUN - window + 1
    held = written(per.withColumn("whole", whole).filter(F.col("whole") | (_longest("places") >= in_a_row)).select("doc_id", "item_id", "matched", "n_windows", "whole"))

    # Alignments, only of the pairs that may hold enough.
    n_held = held.count()
    pairs = small(held.withColumnsRenamed({"doc_id": "d", "item_id": "i"}), n_held)
    keys = ["doc_id", "item_id", "matched", "n_windows", "whole"]
    lines = hits.join(pairs, hits.doc_id.eqNullSafe(F.col("d")) & (hits.item_id == F.col("i"))).select(*keys, "pos", F.explode("item_pos").alias("ipos"))
    lines = lines.withColumn("shift", F.col("pos") - F.col("ipos")).groupBy(*keys, "shift").agg(
        F.min("ipos").alias("first"), (F.max("ipos") + window).alias("last"), F.sort_array(F.collect_set("ipos")).alias("places")
    )
    lines = written(lines.filter(F.col("whole") | (_longest("places") >= in_a_row)).drop("places"))
    held = lines.select(*keys).distinct()
    item_slots = _slots(items, "item_id", kind).withColumnsRenamed({"value": "item_value"})
    aligned = lines.join(item_slots, "item_id").filter((F.col("at") >= F.col("first")) & (F.col("at") < F.col("last")))
    aligned = aligned.withColumn("at", F.col("at") + F.col("shift"))
    ids = lines.select("doc_id").distinct()
    texts = docs.select("doc_id", "text").join(small(ids, n_held), "doc_id", "left_semi")
    bound = aligned.join(_slots(texts, "doc_id", kind), ["doc_id", "at", "type"])
    by = ["doc_id", "item_id", "shift", "type"]
    forth = bound.groupBy(*by, "item_value").agg(F.min("value").alias("value"), F.count_distinct("value").alias("n"))
    # Of values that meet one each, none may be met by two.
    back = forth.groupBy(*by, "value").agg(F.max("n").alias("n"), F.count(F.lit(1)).alias("m"))
    agree = back.groupBy("doc_id", "item_id", "shift").agg(F.max(F.greatest("n", "m")).alias("most"), F.sum("m").alias("slots"))
    # A pair stands if one alignment with slots agrees, or no alignment has any.
    judged = agree.groupBy("doc_id", "item_id").agg(F.min("most").alias("most"), F.max(F.when(F.col("most") == 1, F.col("slots"))).alias("slots"))
    return (
        held.join(judged, ["doc_id", "item_id"], "left")
        .filter(F.col("most").isNull() | (F.col("most") == 1))
        .select("doc_id", "item_id", F.col("matched").cast("long"), F.col("n_windows").cast("long"), F.coalesce("slots", F.lit(0)).cast("long").alias("slots"))
    )


def _exact(docs: DataFrame, items: DataFrame, window: int) -> DataFrame:
    """Documents and the items that they hold as they stand, white space and case aside."""
    wanted, sizes = wanted_windows(items, window, PLAIN)
    _, per = _matches(docs, wanted, sizes, PLAIN)
    pairs = written(per.filter("matched = n_windows").select("doc_id", "item_id", "matched", "n_windows", "words"))
    bare = lambda text: F.lower(F.regexp_replace(text, r"\s+", ""))
    own = pairs.join(items.select("item_id", bare(F.col("text")).alias("item")), "item_id").withColumnsRenamed({"doc_id": "d"})
    longest = items.agg(F.coalesce(F.max(F.length("text")), F.lit(0))).first()[0]
    both = docs.select("doc_id", "text").join(small(own, pairs.count(), 64 + 4 * longest), F.col("doc_id").eqNullSafe(F.col("d")))
    text = bare(F.col("text"))
    held = both.filter(F.when(F.col("words") < 3, text == F.col("item")).otherwise(F.contains(text, F.col("item"))))
    return held.select("doc_id", "item_id", F.col("matched").cast("long"), F.col("n_windows").cast("long"), F.lit(0).cast("long").alias("slots")).distinct()


def contamination(docs: DataFrame, benchmark: DataFrame, least: float = LEAST, window: int = WINDOW) -> DataFrame:
    """doc_id, item_id, matched (distinct item windows in the document), n_windows, slots (agreeing bindings)."""
    items = benchmark.select("item_id", "text").distinct()
    found = docs.sparkSession.createDataFrame([], "doc_id long, item_id long, matched long, n_windows long, slots long")
    for kind in (NAMES, CASELESS):
        wanted, sizes = wanted_windows(items, window, kind)
        if sizes:
            found = found.unionByName(_templates(docs, items, wanted, sizes, least, window, kind))
    # ``wanted`` is the caseless one.
    words = F.size(template_words(F.coalesce("text", F.lit("")), PLAIN))
    bare = written(items.join(wanted.select("item_id"), "item_id", "left_anti").filter(words > 0))
    found = found.unionByName(_exact(docs, bare, window)) if bare.limit(1).count() else found
    best = F.max(F.struct("matched", "n_windows", "slots")).alias("best")
    return found.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.*")


def without_benchmark(docs: DataFrame, benchmark: DataFrame, least: float = LEAST, window: int = WINDOW) -> DataFrame:
    """``docs`` without the documents that hold an item."""
    with scratch():
        found = written(contamination(docs, benchmark, least, window).select("doc_id").distinct(), keep=True)
        n = found.count()
    # Columns go by number, so that their names can't clash.
    plain, at = docs.toDF(*(f"c{i}" for i in range(len(docs.columns)))), docs.columns.index("doc_id")
    left = plain.join(small(found, n), F.col(f"c{at}").eqNullSafe(F.col("doc_id")), "left_anti")
    return left.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    with scratch():
        return written(contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")), keep=True)
