"""Fixed-width series per key: binning, dense vectors with masks, pooling, normalisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidewater.functions.scalars import minute_of_day, morning_after

BINS = 108


def binned(df: DataFrame, subject: str, ts: str, value: str, how: str = "avg", minutes: int = 5) -> DataFrame:
    """Mean, sum or row count per (subject, day, bin) of the hours 00-09, which belong to the day before."""
    rows = df.withColumn("day", morning_after(F.col(ts))).filter("day is not null").withColumn("bin", F.floor(minute_of_day(F.col(ts)) / minutes).cast("int"))
    agg = F.count(F.lit(1)).cast("double") if how == "count" else {"avg": F.avg, "sum": F.sum}[how](value)
    return rows.groupBy(subject, "day", "bin").agg(agg.alias("x"))


def dense(cells: DataFrame, keys: list[str], bins: int = BINS, name: str = "x") -> DataFrame:
    """Vector of ``bins`` values (0 where nothing was seen) and the mask of what was, per key; null is not seen."""
    seen = cells.filter(F.col("x").isNotNull()).groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("bin", "x"))).alias("__m"))
    spots = F.sequence(F.lit(0), F.lit(bins - 1))
    return seen.select(
        *keys, F.transform(spots, lambda i: F.coalesce(F.element_at("__m", i), F.lit(0.0)).cast("float")).alias(name),
        F.transform(spots, lambda i: F.map_contains_key("__m", i).cast("tinyint")).alias(f"{name}_mask"),
    )


def zeros(bins: int = BINS) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda i: F.lit(0.0).cast("float"))


def tensor(spine: DataFrame, keys: list[str], channels: dict[str, DataFrame], bins: int = BINS) -> DataFrame:
    """Every channel's vector and mask for each key of the spine; all zero for keys without rows."""
    out = spine.select(*keys)
    for name, cells in channels.items():
        out = out.join(dense(cells, keys, bins, name), keys, "left")
        none = F.transform(zeros(bins), lambda _: F.lit(0).cast("tinyint"))
        out = out.withColumns({name: F.coalesce(name, zeros(bins)), f"{name}_mask": F.coalesce(f"{name}_mask", none)})
    return out


def pooled(x: Column, factor: int) -> Column:
    """Mean of every ``factor`` neighbours; a shorter rest is dropped."""
    n = F.floor(F.size(x) / factor).cast("int")
    return F.transform(
        F.sequence(F.lit(0), n - 1), lambda i: F.aggregate(F.slice(x, i * factor + 1, factor), F.lit(0.0), lambda a, v: a + v.cast("double")) / factor
    )


def masked_moments(df: DataFrame, x: str, mask: str) -> tuple[float, float, float]:
    """Coverage, mean and population deviation over the seen cells of all rows."""
    cells = df.select(F.explode(F.arrays_zip(F.col(x).alias("x"), F.col(mask).alias("m"))).alias("c"))
    seen = F.when(F.col("c.m") == 1, F.col("c.x").cast("double"))
    s = cells.agg(F.avg((F.col("c.m") == 1).cast("double")).alias("share"), F.avg(seen).alias("mean"), F.stddev_pop(seen).alias("std")).first()
    return s["share"] or 0.0, s["mean"] or 0.0, s["std"] or 0.0


def normalised(x: str, mask: str, mean: float, std: float) -> Column:
    """Seen cells in units of the deviation; unseen cells are 0."""
    return F.zip_with(x, mask, lambda v, m: F.when(m == 1, (v.cast("double") - mean) / (std + 1e-6)).otherwise(0.0))
