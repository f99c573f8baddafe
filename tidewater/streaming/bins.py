"""Streaming forms of the binning and session operators. Both work alike on batch and streaming DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def binned(df: DataFrame, subject: str, ts: str, value: str, minutes: int = 5, late: str = "10 minutes") -> DataFrame:
    """Mean and rows per subject and tumbling window; rows later than ``late`` behind the newest are dropped in a stream.

    Aggregates are keyed by (subject, window) and state older than the watermark is let go, so state is bounded by what
    arrives within ``late``. Null values count as rows but not in the mean; rows without a time are dropped.
    """
    rows = df.filter(F.col(ts).isNotNull()).withColumn("__ts", F.col(ts).cast("timestamp")).withWatermark("__ts", late)
    by = rows.groupBy(F.col(subject), F.window("__ts", f"{minutes} minutes").alias("w")).agg(F.avg(value).alias("x"), F.count(F.lit(1)).alias("n"))
    return by.select(subject, F.col("w.start").alias("start"), "x", "n")


def sessions(df: DataFrame, subject: str, ts: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of a subject's rows with pauses below ``gap``: start, end of the last row's gap, rows."""
    rows = df.filter(F.col(ts).isNotNull()).withColumn("__ts", F.col(ts).cast("timestamp")).withWatermark("__ts", late)
    by = rows.groupBy(F.col(subject), F.session_window("__ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return by.select(subject, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
