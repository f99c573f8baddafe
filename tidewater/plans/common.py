"""What the queries share: the mapping of sensor concepts to the event table, and its statement in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidewater.sources.tables import sensor

KEYS = ["user_id", "day"]
TYPES = ["click", "error", "purchase", "signup", "view"]

#: The sensor rows: subject, time, day, hour, part of the day, class, value and a number ``k``.
SENSOR = """s AS (
  SELECT user_id, ts, CAST(ts AS DATE) AS day, hour(ts)::INT AS h, event_type, value, event_id,
         CASE WHEN hour(ts) < 6 THEN 'overnight' WHEN hour(ts) < 12 THEN 'morning' WHEN hour(ts) < 18 THEN 'afternoon' ELSE 'evening' END AS bucket,
         CAST(json_extract_string(props, '$.k') AS INT) AS k
  FROM events)"""
SPINE = """spine AS (
  SELECT DISTINCT user_id, day, CASE WHEN day <= DATE '2024-01-20' THEN 'train' ELSE 'sub' END AS split FROM s)"""
DAY = "strftime(day, '%Y-%m-%d') AS day"


def with_split(days: DataFrame) -> DataFrame:
    """The first 20 days are for training."""
    return days.withColumn("split", F.when(F.col("day") <= F.lit("2024-01-20").cast("date"), "train").otherwise("sub"))


def spine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subject and day of every day with rows, and its split."""
    return with_split(sensor(spark, sf_dir).select(*KEYS).distinct())


def shown(df: DataFrame, digits: int = 6) -> DataFrame:
    """Dates as text, counts as longs, floating values rounded: what both engines agree on."""
    out = []
    for c, t in df.dtypes:
        x = F.col(f"`{c}`")
        if t == "date":
            x = F.date_format(x, "yyyy-MM-dd")
        elif t in ("timestamp", "timestamp_ntz"):
            x = F.date_format(x, "yyyy-MM-dd HH:mm:ss.SSSSSS")
        elif t in ("double", "float"):
            x = F.round(x.cast("double"), digits) + F.lit(0.0)
        elif t in ("int", "smallint", "tinyint"):
            x = x.cast("long")
        out.append(x.alias(c))
    return df.select(*out)


def means_by_bucket(x: str, prefix: str) -> str:
    """SQL for the mean of ``x`` in each part of the day."""
    return ", ".join(f"round(avg({x}) FILTER (bucket = '{b}'), 6) AS {prefix}_{b}" for b in ("overnight", "morning", "afternoon", "evening"))
