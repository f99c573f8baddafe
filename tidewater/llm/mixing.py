"""Mixing sources to target weights with a low-discrepancy schedule.

1. Each source's documents are shuffled by a seeded hash into one stream of words, which is cut into blocks of
   ``block_words``. Positions come from two-level running sums over (source, bucket), so a source that holds a third of
   all rows is still spread over many tasks.
2. Targets are the water level: weights share all words, and no source may exceed ``max_epochs`` times its own.
3. Point i of the golden-ratio sequence falls into one source's part of [0, 1), cut in proportion to the blocks each
   source needs; i is a slot of that source. Slots are ranked within their source (again in two levels), and rank r takes
   block r mod n, cut at the target, so a source gives its target to the word. Twice as many points as slots needed are
   drawn, as the largest gap between M golden points is below 1.9 / M; what a source no longer needs is passed over.
4. Slots join blocks on (source, block).

Windows over all sources have a row per source, so a million sources are still one small task.

Defined results: null text counts no words and is never taken; null source is a source, last in order; repeated rows and
repeated doc_ids are documents of their own; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from .common import read, scratch, small, word_count, written

#: Golden ratio's fraction in units of 2**-42; points are i * GOLDEN mod 2**42.
BITS = 42
GOLDEN = round((5**0.5 - 1) / 2 * 2**BITS) | 1
WEIGHTS = (1.0, 2.0, 3.0)


def golden_point(i: Column) -> Column:
    """Fraction of i times the golden ratio, in whole numbers below 2**63; i below 2**41."""
    mask, low = (1 << BITS) - 1, (1 << 20) - 1
    high = F.shiftright(i, 20) * F.lit((GOLDEN << 20) & mask)
    return ((high.bitwiseAND(F.lit(mask)) + (i.bitwiseAND(F.lit(low)) * F.lit(GOLDEN)).bitwiseAND(F.lit(mask))).bitwiseAND(F.lit(mask))) / F.lit(float(1 << BITS))


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_epochs: int = 3) -> DataFrame:
    """sid, source, weight, source_size, n_docs, target for rows of (source, size). One row per source throughout."""
    order = W.orderBy(F.col("source").isNull(), "source")
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    pick = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("sid") - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = by.withColumn("sid", F.row_number().over(order).cast("long")).withColumn("weight", pick)
    ranked = ranked.withColumn("cap", F.lit(float(max_epochs)) * F.col("source_size"))
    before = W.orderBy(F.col("cap") / F.col("weight"), "sid").rowsBetween(W.unboundedPreceding, -1)
    whole = W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    level = (F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (
        F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    )
    levels = ranked.withColumn("level", level).withColumn("free", F.col("cap") > F.col("level") * F.col("weight"))
    first_free = F.when(F.col("free"), F.struct((F.col("cap") / F.col("weight")).alias("ratio"), "sid", "level"))
    final = F.min(first_free).over(whole)["level"]
    share = F.coalesce(F.least("cap", final * F.col("weight")), F.col("cap"))
    return levels.select("sid", "source", "weight", "source_size", "n_docs", share.alias("target"))


def place(docs: DataFrame, targets: DataFrame, n_sources: int, n_docs: int, seed: int) -> DataFrame:
    """doc_id, sid, size and start (first word's place in the source's shuffled stream)."""
    buckets = 256
    while buckets < n_docs / 100_000:
        buckets *= 2
    key = F.xxhash64(F.col("doc_id"), F.lit(seed))
    rows = (
        docs.join(small(targets.select("sid", F.col("source").alias("s")), n_sources), F.col("source").eqNullSafe(F.col("s")))
        .select("doc_id", "sid", "size", key.alias("key"))
        .withColumn("bucket", F.pmod(F.shiftright("key", 8), F.lit(buckets)))
    )
    sums = rows.groupBy("sid", "bucket").agg(F.sum("size").alias("words"))
    ahead = F.sum("words").over(W.partitionBy("sid").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1))
    offsets = sums.select(F.col("sid"), "bucket", F.coalesce(ahead, F.lit(0)).alias("offset"))
    inside = F.sum("size").over(W.partitionBy("sid", "bucket").orderBy("key", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1))
    return (
        rows.withColumn("inside", F.coalesce(inside, F.lit(0)))
        .join(offsets, ["sid", "bucket"])
        .select("doc_id", "sid", "size", (F.col("offset") + F.col("inside")).alias("start"))
    )


def schedule(targets: DataFrame, block_words: int, n_sources: int) -> DataFrame:
    """slot, sid, block, take: the mix in slot order; ``take`` words from the start of that block."""
    spark = targets.sparkSession
    words = F.floor("target").cast("long")
    need = targets.filter((F.col("source_size") > 0) & (words > 0)).select(
        "sid", F.col("source_size").alias("size"), words.alias("words"), F.ceil(F.col("source_size") / block_words).cast("long").alias("blocks")
    )
    need = need.withColumn(
        "slots", F.expr("words div size") * F.col("blocks") + F.ceil((F.col("words") % F.col("size")) / block_words).cast("long")
    )
    # One row per source.
    total = need.agg(F.coalesce(F.sum("slots"), F.lit(0)).alias("n")).first()["n"]
    cells = 1 << max(10, (4 * n_sources).bit_length())
    upto = F.sum("slots").over(W.orderBy("sid").rowsBetween(W.unboundedPreceding, 0))
    parts = need.withColumn("hi", upto / F.lit(float(max(total, 1)))).withColumn("lo", (upto - F.col("slots")) / F.lit(float(max(total, 1))))
    parts = parts.withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") * cells), F.least(F.floor(F.col("hi") * cells), F.lit(cells - 1)))))
    points = spark.range(0, 2 * total + 2 if total else 0).withColumn("u", golden_point(F.col("id")))
    slots = points.withColumn("cell", F.floor(F.col("u") * cells)).join(
        small(parts, n_sources + cells), ["cell"]
    ).filter((F.col("u") >= F.col("lo")) & (F.col("u") < F.col("hi")))
    chunk = max(64, int((2 * total) ** 0.5))
    slots = slots.withColumn("chunk", F.expr(f"id div {chunk}"))
    counts = slots.groupBy("sid", "chunk").agg(F.count(F.lit(1)).alias("n"))
    ahead = F.sum("n").over(W.partitionBy("sid").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1))
    offsets = counts.select("sid", "chunk", F.coalesce(ahead, F.lit(0)).alias("offset"))
    ranked = slots.withColumn("inside", F.row_number().over(W.partitionBy("sid", "chunk").orderBy("id")) - 1).join(offsets, ["sid", "chunk"])
    ranked = ranked.withColumn("rank", F.col("offset") + F.col("inside")).filter(F.col("rank") < F.col("slots"))
    block, epoch = F.col("rank") % F.col("blocks"), F.expr("rank div blocks")
    ends = F.least((block + 1) * block_words, F.col("size")) + epoch * F.col("size")
    return ranked.select(
        F.col("id").alias("slot"), "sid", block.alias("block"),
        (F.least(ends, F.col("words")) - epoch * F.col("size") - block * block_words).alias("take"),
    )


def mix(docs: DataFrame, block_words: int = 256, seed: int = 17, weights: tuple[float, ...] = WEIGHTS, max_epochs: int = 3):
    """(placed documents, targets, mix). The mix has a row per slot and document part: slot, doc_id, sid, start (the
    document's place), from_word, to_word within the document.

    ``docs`` needs doc_id, text, source. Blocks are equal in words but for a source's last one.
    """
    sized = written(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")))
    targets = written(source_targets(sized, weights, max_epochs))
    counted = targets.agg(F.count(F.lit(1)).alias("s"), F.coalesce(F.sum("n_docs"), F.lit(0)).alias("d")).first()
    placed = written(place(sized, targets, counted["s"], counted["d"], seed))
    first, last = F.expr(f"start div {block_words}"), F.expr(f"(start + size - 1) div {block_words}")
    parts = placed.filter("size > 0").withColumn("block", F.explode(F.sequence(first, last)))
    slots = schedule(targets, block_words, counted["s"])
    base = F.col("block") * block_words
    begin, end = F.greatest(base, F.col("start")), F.least(base + F.col("take"), F.col("start") + F.col("size"))
    mixed = slots.join(parts, ["sid", "block"]).filter(begin < end)
    return placed, targets, counted["s"], mixed.select(
        "slot", "doc_id", "sid", "start", (begin - F.col("start")).alias("from_word"), (end - F.col("start")).alias("to_word")
    )


def taken_words(docs: DataFrame, **options) -> DataFrame:
    """doc_id, source, size, source_size, target, taken: one row per row of ``docs``."""
    placed, targets, n_sources, mixed = mix(docs, **options)
    # A start is one document's alone, as all documents in the mix have words.
    took = mixed.groupBy("sid", "start").agg(F.sum(F.col("to_word") - F.col("from_word")).alias("taken"))
    rows = placed.filter("size > 0").join(took, ["sid", "start"], "left").unionByName(placed.filter("size = 0").withColumn("taken", F.lit(0).cast("long")))
    return rows.join(small(targets, n_sources), ["sid"]).select(
        "doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken")
    )


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents of which the mix takes any word, with ``taken`` (words, repeats counted) and their source's ``target``.

    A document is its doc_id: rows that share one get the sum. Columns of ``docs`` with these two names are replaced; all
    others, whatever their names, are kept.
    """
    with scratch():
        took = taken_words(docs.select("doc_id", "text", "source"), **options).filter("taken > 0").groupBy("doc_id")
        took = written(took.agg(F.sum("taken").alias("taken"), F.max("target").alias("target")), keep=True)
        n = took.count()
    kept = [c for c in docs.columns if c not in ("taken", "target")]
    # Columns go by number, so that their names can't clash.
    plain = docs.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept)))
    joined = plain.join(small(took, n), F.col(f"c{kept.index('doc_id')}").eqNullSafe(F.col("doc_id")))
    return joined.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(kept)), "taken", "target")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    with scratch():
        return written(taken_words(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken"), keep=True)
