"""Ranks, rank correlations and exact percentiles from counts of distinct values.

Rows are counted by (group, value) first, so what is ranked are distinct values with their numbers of rows. Quantiles of each
group cut its values into ranges; places run within a range, and one row per group and range gives what lies ahead of it. No
task has all of a group, whatever its size, no value reaches the driver, and any number of columns or groups is one plan of a
fixed number of shuffles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from tidewater.sources.scratch import written


def places(counts: DataFrame, by: list[str], value: str, n: str = "n") -> DataFrame:
    """``counts`` (a row per group and value, ``n`` rows each) with ``ahead``, rows of the group with lesser values, and ``total``.

    Groups may be null; rows with null values are left out.
    """
    cuts = min(256, max(16, int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    keys = [f"__k{i}" for i in range(len(by))]
    known = counts.filter(F.col(value).isNotNull())
    bounds = known.groupBy(*(F.col(c).alias(k) for c, k in zip(by, keys, strict=True))).agg(
        F.percentile_approx(value, [i / cuts for i in range(1, cuts)], 20 * cuts).alias("__bounds")
    )
    same = [F.col(c).eqNullSafe(F.col(k)) for c, k in zip(by, keys, strict=True)]
    part = F.size(F.filter("__bounds", lambda b: b <= F.col(value)))
    parted = known.join(bounds, same).drop(*keys).withColumn("__part", part).drop("__bounds")
    sums = parted.groupBy(*by, "__part").agg(F.sum(n).alias("__m"))
    group, range_ = W.partitionBy(*by), W.partitionBy(*by, "__part").orderBy(value).rowsBetween(W.unboundedPreceding, -1)
    ahead = F.coalesce(F.sum("__m").over(group.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select(*(F.col(c).alias(k) for c, k in zip(by, keys, strict=True)), F.col("__part").alias("__p"), ahead.alias("__ahead"), F.sum("__m").over(group).alias("total"))
    placed = parted.withColumn("__within", F.coalesce(F.sum(n).over(range_), F.lit(0)))
    found = placed.join(sums, [*same, F.col("__part") == F.col("__p")])
    return found.withColumn("ahead", F.col("__within") + F.col("__ahead")).select(*counts.columns, "ahead", "total")


def spearman(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """by, r (rank correlation, ties share the mean of their places; null without variance) and n, over rows that have both."""
    both = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    joint = written(both.groupBy(*by, F.col(x).cast("double").alias("__x"), F.col(y).cast("double").alias("__y")).agg(F.count(F.lit(1)).alias("__n")))
    axes = joint.select(*by, F.inline(F.array(*(F.struct(F.lit(a).alias("__axis"), F.col(a).alias("__v"), "__n") for a in ("__x", "__y")))))
    counts = axes.groupBy(*by, "__axis", "__v").agg(F.sum("__n").alias("__n"))
    # Distances from the mean rank, which only the number of rows decides.
    ranks = places(counts, [*by, "__axis"], "__v", "__n").withColumn("__d", F.col("ahead") + (F.col("__n") + 1) / 2.0 - (F.col("total") + 1) / 2.0)
    ranks = written(ranks)
    found = joint
    for a in ("__x", "__y"):
        one = ranks.filter(F.col("__axis") == a).select(*(F.col(c).alias(f"__{i}{a}") for i, c in enumerate(by)), F.col("__v").alias(f"__v{a}"), F.col("__d").alias(f"__d{a}"))
        found = found.join(one, [*(F.col(c).eqNullSafe(F.col(f"__{i}{a}")) for i, c in enumerate(by)), F.col(a) == F.col(f"__v{a}")])
    dx, dy, n = F.col("__d__x"), F.col("__d__y"), F.col("__n")
    r = F.try_divide(F.sum(n * dx * dy), F.sqrt(F.sum(n * dx * dx)) * F.sqrt(F.sum(n * dy * dy)))
    return found.groupBy(*by).agg(r.alias("r"), F.sum("__n").alias("n"))


def percentiles(long: DataFrame, by: list[str], value: str, share: float, name: str = "p", n: str | None = None) -> DataFrame:
    """by and the interpolated percentile of ``value`` in each group that has values; with ``n`` a row stands for that many."""
    rows = F.sum(n) if n else F.count(F.lit(1))
    counts = long.filter(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("__v")).agg(rows.alias("__n")).filter("__n > 0")
    at = F.lit(share) * (F.col("total") - 1)
    low, high = F.floor(at), F.least(F.floor(at) + 1, F.col("total") - 1)
    holds = lambda place: (F.col("ahead") <= place) & (place < F.col("ahead") + F.col("__n"))
    found = places(counts, by, "__v", "__n").filter(holds(low) | holds(high)).groupBy(*by).agg(
        F.max(F.when(holds(low), F.col("__v"))).alias("__low"), F.max(F.when(holds(high), F.col("__v"))).alias("__high"), F.max(at - low).alias("__rest")
    )
    return found.select(*by, (F.col("__low") + F.col("__rest") * (F.col("__high") - F.col("__low"))).alias(name))


def column_percentiles(df: DataFrame, columns: list[str], share: float) -> dict[str, float | None]:
    """The percentile of each whole column, all in one job; None without values. A row for each column reaches the driver."""
    cells = F.array(*(F.struct(F.lit(i).alias("__c"), F.col(f"`{c}`").cast("double").alias("__v")) for i, c in enumerate(columns)))
    found = {r["__c"]: r["p"] for r in percentiles(df.select(F.inline(cells)), ["__c"], "__v", share).collect()}
    return {c: found.get(i) for i, c in enumerate(columns)}
