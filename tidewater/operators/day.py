"""Aggregates of irregular sensor rows by key, usually subject and day.

All are one ``groupBy`` with conditional aggregates where the reference value allows, so each sensor is shuffled once by
its key; two-level aggregates shuffle partial results by the finer key first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidewater.functions.scalars import BUCKETS

from .ranks import column_percentiles

Keys = list[str]


def scalar_stats(df: DataFrame, keys: Keys, value: str, prefix: str, bucket: str | None = "bucket") -> DataFrame:
    """Mean, sample deviation, range, exact quartiles, and the mean of each part of the day."""
    x = F.col(value)
    aggs = [F.avg(x).alias(f"{prefix}_mean"), F.stddev_samp(x).alias(f"{prefix}_std"), F.min(x).alias(f"{prefix}_min"), F.max(x).alias(f"{prefix}_max")]
    aggs += [F.percentile(x, p / 100).alias(f"{prefix}_p{p}") for p in (25, 50, 75)]
    if bucket:
        aggs += [F.avg(F.when(F.col(bucket) == b, x)).alias(f"{prefix}_{b}") for b, _, _ in BUCKETS]
    return df.groupBy(*keys).agg(*aggs)


def ratios(df: DataFrame, keys: Keys, condition: Column, prefix: str, bucket: str | None = "bucket") -> DataFrame:
    """Share of rows that meet a condition, by day and by part of the day. An unknown condition counts as not met."""
    x = F.coalesce(condition, F.lit(False)).cast("double")
    aggs = [F.avg(x).alias(f"{prefix}_ratio")]
    if bucket:
        aggs += [F.avg(F.when(F.col(bucket) == b, x)).alias(f"{prefix}_ratio_{b}") for b, _, _ in BUCKETS]
    return df.groupBy(*keys).agg(*aggs)


def shares(df: DataFrame, keys: Keys, label: str, values: list[str], prefix: str) -> DataFrame:
    """Share of each stated value among all rows, others included in the denominator; 0 where absent."""
    return df.groupBy(*keys).agg(*(F.avg(F.coalesce(F.col(label) == v, F.lit(False)).cast("double")).alias(f"{prefix}_{v}") for v in values))


def sums(df: DataFrame, keys: Keys, value: str, prefix: str, active_from: float, bucket: str = "bucket") -> DataFrame:
    """Sum (0 if all are null), mean, maximum, number of active rows, and sums by part of the day."""
    x = F.col(value)
    return df.groupBy(*keys).agg(
        F.coalesce(F.sum(x), F.lit(0.0)).alias(f"{prefix}_sum"), F.avg(x).alias(f"{prefix}_mean"), F.max(x).alias(f"{prefix}_max"),
        F.count_if(x >= active_from).alias(f"{prefix}_active"),
        *(F.coalesce(F.sum(F.when(F.col(bucket) == b, x)), F.lit(0.0)).alias(f"{prefix}_sum_{b}") for b, _, _ in BUCKETS),
    )


def group_score(df: DataFrame, keys: Keys, row: str, group: str, score: str, groups: list[str], prefix: str, bucket: str | None = None) -> DataFrame:
    """Largest score per row and group (0 for a group absent from the row), then its mean over the rows that have any group."""
    known = df.filter(F.col(group).isin(groups))
    wide = known.groupBy(*keys, row, *([bucket] if bucket else [])).agg(
        *(F.coalesce(F.max(F.when(F.col(group) == g, F.col(score))), F.lit(0.0)).alias(g) for g in groups)
    )
    if not bucket:
        return wide.groupBy(*keys).agg(*(F.avg(g).alias(f"{prefix}_{g}") for g in groups))
    return wide.groupBy(*keys).agg(*(F.avg(F.when(F.col(bucket) == b, F.col(g))).alias(f"{prefix}_{g}_{b}") for b, _, _ in BUCKETS for g in groups))


def entropy(df: DataFrame, keys: Keys, label: str, weight: str | None = None) -> DataFrame:
    """Shannon entropy (natural logarithm) of counts or weights of labels, the top label's share, and the number of labels."""
    n = F.sum(F.col(weight)) if weight else F.count(F.lit(1)).cast("double")
    by = df.groupBy(*keys, label).agg(n.alias("n")).filter("n > 0")
    # H = ln(N) - sum(n ln n) / N needs no second pass over the labels.
    total = F.sum("n")
    return by.groupBy(*keys).agg(
        (F.log(total) - F.sum(F.col("n") * F.log("n")) / total).alias("entropy"), (F.max("n") / total).alias("top_share"),
        F.count(F.lit(1)).alias("n_labels"),
    )


def anchor(df: DataFrame, subject: str, item: str) -> DataFrame:
    """Most frequent item per subject; the smallest on ties. Counts are combined before the shuffle by subject."""
    counts = df.filter(F.col(item).isNotNull()).groupBy(subject, item).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(subject).agg(F.min_by(item, F.struct(-F.col("n"), F.col(item))).alias("anchor"), F.max("n").alias("n"))


def at_anchor(df: DataFrame, keys: Keys, subject: str, item: str, home: DataFrame, bucket: str = "bucket") -> DataFrame:
    """Share of rows at the subject's anchor; rows elsewhere, and those of subjects without one, count as away."""
    here = F.coalesce(F.col(item) == F.col("anchor"), F.lit(False)).cast("double")
    joined = df.join(home.select(subject, "anchor"), subject, "left")
    return joined.groupBy(*keys).agg(
        F.avg(here).alias("home_ratio"), F.avg(F.when(F.col(bucket) == "evening", here)).alias("home_evening"),
        F.avg(F.when(F.col(bucket) == "overnight", here)).alias("home_overnight"),
    )


def scan_at_anchor(df: DataFrame, keys: Keys, subject: str, scan: str, item: str, home: DataFrame) -> DataFrame:
    """Share of scans of which any item is the subject's anchor."""
    here = F.coalesce(F.col(item) == F.col("anchor"), F.lit(False)).cast("double")
    scans = df.join(home.select(subject, "anchor"), subject, "left").groupBy(*keys, scan).agg(F.max(here).alias("here"))
    return scans.groupBy(*keys).agg(F.avg("here").alias("home_ratio"), F.count(F.lit(1)).alias("n_scans"))


def split_stats(df: DataFrame, keys: Keys, hour: str, value: str, spans: dict[str, tuple[int, int]]) -> DataFrame:
    """Mean and maximum within spans of hours, both ends included."""
    aggs = []
    for name, (low, high) in spans.items():
        x = F.when(F.col(hour).between(low, high), F.col(value))
        aggs += [F.avg(x).alias(f"{name}_mean"), F.max(x).alias(f"{name}_max")]
    return df.groupBy(*keys).agg(*aggs)


def gated(df: DataFrame, keys: Keys, value: str, more_than: int) -> DataFrame:
    """Mean, deviation and range of groups with more than so many rows; null for the others."""
    x, enough = F.col(value), F.count(value) > more_than
    return df.groupBy(*keys).agg(
        F.count(value).alias("n"), F.when(enough, F.avg(x)).alias("mean"), F.when(enough, F.stddev_samp(x)).alias("std"),
        F.when(enough, F.min(x)).alias("min"), F.when(enough, F.max(x)).alias("max"),
    )


def on_spine(spine: DataFrame, keys: Keys, *blocks: DataFrame) -> DataFrame:
    """The spine with every block's columns, null where a block has no row."""
    out = spine
    for block in blocks:
        out = out.join(block, keys, "left")
    return out


def missing_flag(spine: DataFrame, df: DataFrame, keys: Keys, name: str) -> DataFrame:
    """1 for keys of the spine without a row in ``df``."""
    seen = df.select(*keys).distinct().withColumn("__seen", F.lit(1))
    return spine.join(seen, keys, "left").withColumn(name, F.col("__seen").isNull().cast("int")).drop("__seen")


def demeaned(df: DataFrame, subject: str, columns: list[str]) -> DataFrame:
    """Each column less its subject's mean. Means are joined, so a subject's rows need not be in one task."""
    means = df.groupBy(subject).agg(*(F.avg(c).alias(f"__{c}") for c in columns))
    joined = df.join(means, subject, "left")
    return joined.withColumns({f"{c}_w": F.col(c) - F.col(f"__{c}") for c in columns}).drop(*(f"__{c}" for c in columns))


def missing_rates(df: DataFrame, subject: str, columns: list[str]) -> DataFrame:
    """Share of nulls by subject and column, one row each."""
    return df.groupBy(subject).agg(*(F.avg(F.col(c).isNull().cast("double")).alias(c) for c in columns)).unpivot(subject, columns, "column", "missing")


def described(df: DataFrame, columns: list[str]) -> DataFrame:
    """Coverage and distribution of each column, one row each: one pass, and that of all exact medians."""
    middle = column_percentiles(df, columns, 0.5)
    stats = [
        F.struct(
            F.lit(c).alias("column"), F.count(c).alias("n"), F.count_if(F.col(c).isNull()).alias("nulls"), F.avg(c).cast("double").alias("mean"),
            F.stddev_samp(c).alias("std"), F.min(c).cast("double").alias("min"), F.lit(middle[c]).cast("double").alias("p50"), F.max(c).cast("double").alias("max"),
        )
        for c in columns
    ]
    return df.agg(F.array(*stats).alias("s")).select(F.inline("s"))


def top_per_group(df: DataFrame, by: Keys, order: list[Column], k: int) -> DataFrame:
    """First ``k`` rows of each group; the order must be total."""
    return df.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(*order))).filter(F.col("rank") <= k)
