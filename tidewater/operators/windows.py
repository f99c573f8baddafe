"""Window functions over a subject's ordered rows, runs, ranks and folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def expanding_z(df: DataFrame, by: list[str], order: list[str], value: str, eps: float = 1e-6) -> DataFrame:
    """Mean and deviation of all earlier rows, today's excluded, and today's distance from them."""
    prior = W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    df = df.withColumn("prior_mean", F.avg(value).over(prior)).withColumn("prior_std", F.stddev_samp(value).over(prior))
    return df.withColumn("z", (F.col(value) - F.col("prior_mean")) / (F.col("prior_std") + eps))


def trailing_mean(value: str, by: list[str], order: list[str], rows: int = 7) -> Column:
    """Mean of up to ``rows`` rows before this one."""
    return F.avg(value).over(W.partitionBy(*by).orderBy(*order).rowsBetween(-rows, -1))


def centred_mean(value: str, by: list[str], order: list[str], rows: int = 7, least: int = 2) -> Column:
    """Mean of the rows around this one, if at least ``least`` of them have a value."""
    w = W.partitionBy(*by).orderBy(*order).rowsBetween(-(rows // 2), rows // 2)
    return F.when(F.count(value).over(w) >= least, F.avg(value).over(w))


def rmssd(df: DataFrame, by: list[str], order: list[str], value: str, name: str = "rmssd") -> DataFrame:
    """Root mean square of successive differences; null values are left out first."""
    known = df.filter(F.col(value).isNotNull())
    step = F.col(value) - F.lag(value).over(W.partitionBy(*by).orderBy(*order))
    return known.withColumn("__d", step).groupBy(*by).agg(F.sqrt(F.avg(F.col("__d") * F.col("__d"))).alias(name), F.count(F.lit(1)).alias("n"))


def runs(df: DataFrame, by: list[str], order: list[str], state: str, keep: list[Column] | None = None) -> DataFrame:
    """Runs of equal states: by, run (from 1), state, length, first and last of the first order column."""
    w = W.partitionBy(*by).orderBy(*order)
    change = F.when(F.col(state).eqNullSafe(F.lag(state).over(w)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    marked = df.withColumn("__new", change).withColumn("run", F.sum("__new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return marked.groupBy(*by, "run", state).agg(
        F.count(F.lit(1)).alias("length"), F.min(order[0]).alias("start"), F.max(order[0]).alias("stop"), *(keep or [])
    )


def bouts(df: DataFrame, by: list[str], order: list[str], state: str, of: list, least_rows: int = 10) -> DataFrame:
    """Transitions, and the longest and median run of each state; null for groups of fewer rows."""
    every = runs(df, by, order, state)
    enough = F.sum("length") >= least_rows
    aggs = [F.when(enough, F.count(F.lit(1)) - 1).alias("transitions")]
    for s in of:
        own = F.when(F.col(state) == s, F.col("length"))
        aggs += [F.when(enough, F.coalesce(F.max(own), F.lit(0))).alias(f"max_{s}"), F.when(enough, F.coalesce(F.percentile(own, 0.5), F.lit(0.0))).alias(f"median_{s}")]
    return every.groupBy(*by).agg(*aggs)


def on_off(df: DataFrame, by: list[str], order: list[str], on: str, minute: str, early: int = 180, mid: int = 540, window: int = 720) -> DataFrame:
    """Events of a night: rising edges, rows on, first and last minute on, longest run of rows off, early and middle rows on."""
    w = W.partitionBy(*by).orderBy(*order)
    marked = df.withColumn("__edge", ((F.col(on) == 1) & (F.coalesce(F.lag(on).over(w), F.lit(0)) == 0)).cast("int"))
    marked = marked.withColumn("__island", F.sum(on).over(w.rowsBetween(W.unboundedPreceding, 0)))
    is_on = F.col(on) == 1
    islands = marked.groupBy(*by, "__island").agg(
        F.sum("__edge").alias("edges"), F.sum(on).alias("on"), F.sum(1 - F.col(on)).alias("off"),
        F.min(F.when(is_on, F.col(minute))).alias("first"), F.max(F.when(is_on, F.col(minute))).alias("last"),
        F.count_if(is_on & (F.col(minute) < early)).alias("early"), F.count_if(is_on & (F.col(minute) >= early) & (F.col(minute) < mid)).alias("middle"),
    )
    return islands.groupBy(*by).agg(
        F.sum("edges").alias("edges"), F.sum("on").alias("on_rows"), F.coalesce(F.min("first"), F.lit(window)).alias("first_on"),
        F.coalesce(F.max("last"), F.lit(0)).alias("last_on"), F.max("off").alias("max_off"), F.sum("early").alias("early"), F.sum("middle").alias("middle"),
    )


def _part(key: str, bounds: list) -> Column:
    """Number of sorted ``bounds`` at or below the key, by halving; null comes first."""

    def tree(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        return F.when(F.col(key) < F.lit(bounds[mid]), tree(low, mid)).otherwise(tree(mid + 1, high))

    return F.when(F.col(key).isNull(), F.lit(-1)).otherwise(tree(0, len(bounds)))


def _cuts(df: DataFrame) -> int:
    """Ranges to cut keys into: they grow with the session's shuffle partitions, as these do with the data."""
    return min(1024, max(16, 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))


def numbered(df: DataFrame, key: str, name: str = "ordinal") -> DataFrame:
    """Rows of a unique, orderable ``key`` numbered from 1 in its order, without a window over all rows.

    Keys picked by hash cut the keys into ranges; numbers run within a range, and one row per range gives what lies ahead of it.
    """
    bounds = sorted(r[0] for r in df.select(key).orderBy(F.xxhash64(key), key).limit(_cuts(df)).collect() if r[0] is not None)
    parted = df.withColumn("__part", _part(key, bounds))
    sizes = parted.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    ahead = F.coalesce(F.sum("__n").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    within = F.row_number().over(W.partitionBy("__part").orderBy(F.col(key).asc_nulls_first()))
    return parted.withColumn("__r", within).join(F.broadcast(sizes.select("__part", ahead.alias("__ahead"))), "__part").select(
        *df.columns, (F.col("__r") + F.col("__ahead")).alias(name)
    )


def blocked_folds(df: DataFrame, subject: str, order: list[str], k: int) -> DataFrame:
    """``k`` contiguous blocks of each subject's rows, dealt to folds that rotate from subject to subject."""
    block = F.ntile(k).over(W.partitionBy(subject).orderBy(*order)) - 1
    turn = numbered(df.select(subject).distinct(), subject, "__turn")
    turned = df.withColumn("block", block).join(turn, subject)
    return turned.withColumn("fold", F.pmod(F.col("block") + F.col("__turn") - 1, F.lit(k))).drop("__turn")


def hashed_folds(key: str, k: int) -> Column:
    """Fold of a key by hash, the same in every run."""
    return F.pmod(F.xxhash64(key), F.lit(k)).cast("int")
