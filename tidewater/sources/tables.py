"""Readers, writers and checks of tables. Everything is lazy but the checks and the writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidewater.functions.scalars import bucket, no_nan


def read(spark: SparkSession, sf_dir: str, table: str, where: str | None = None) -> DataFrame:
    """A Parquet table with NaN as null in its floating columns.

    ``where`` is applied to the stored columns, so that the scan gets it, and again without NaN, which Spark takes for the
    largest number.
    """
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    floats = [c for c, t in df.dtypes if t in ("double", "float")]
    df = df.filter(where) if where else df
    df = df.withColumns({c: no_nan(F.col(c)) for c in floats}) if floats else df
    return df.filter(where) if where and floats else df


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header and a stated schema, so nothing is inferred by a second pass."""
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)


def sensor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event stream with its day, hour, part of the day and the number in ``props``."""
    df = read(spark, sf_dir, "events")
    return df.select(
        "user_id", "ts", F.to_date("ts").alias("day"), F.hour("ts").alias("h"), bucket(F.col("ts")).alias("bucket"),
        "event_type", "value", F.from_json("props", "k INT")["k"].alias("k"), "event_id",
    )


def key_spine(train: DataFrame, rest: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of both tables tagged with their split. A key that stands in both, or twice, is an error."""
    spine = train.select(*keys, F.lit("train").alias("split")).unionByName(rest.select(*keys, F.lit("sub").alias("split")))
    require_unique(spine, keys)
    return spine


def require_unique(df: DataFrame, keys: list[str]) -> None:
    twice = df.groupBy(*keys).count().filter("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"key {twice[0].asDict()} is not unique")


def require_columns(df: DataFrame, columns: list[str]) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")


def require_probabilities(df: DataFrame, columns: list[str]) -> None:
    """Every value is strictly between 0 and 1; null is an error."""
    bad = df.filter(" or ".join(f"`{c}` is null or `{c}` <= 0 or `{c}` >= 1" for c in columns)).limit(1).collect()
    if bad:
        raise ValueError(f"not a probability: {bad[0].asDict()}")


def preflight(spark: SparkSession, sf_dir: str, tables: dict[str, list[str]]) -> None:
    """Every table can be read and has its columns."""
    for table, columns in tables.items():
        require_columns(spark.read.parquet(f"{sf_dir}/{table}.parquet"), columns)


def write_checked(df: DataFrame, path: str, partition_by: list[str] | None = None, reuse: bool = False) -> DataFrame:
    """Write Parquet and read it back; with ``reuse`` a finished table at ``path`` stays as it is."""
    spark = df.sparkSession
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    done = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)
    if not (reuse and done):
        writer = df.write.mode("overwrite")
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    back = spark.read.parquet(path)
    require_columns(back, df.columns)
    return back.select(df.columns)


def write_csv(df: DataFrame, path: str, order: list[str]) -> None:
    """One CSV file in a fixed order of rows and columns, lines ended by a line feed; for small results."""
    df.orderBy(*order).coalesce(1).write.mode("overwrite").option("header", True).option("lineSep", "\n").csv(path)


def write_groups(spark: SparkSession, columns: dict[str, list[str]], path: str) -> None:
    """Sidecar beside a table that lists its columns by group, a JSON line each, written by Spark's file system."""
    rows = [(group, names) for group, names in sorted(columns.items())]
    spark.createDataFrame(rows, "grp string, cols array<string>").coalesce(1).write.mode("overwrite").json(path)


def read_groups(spark: SparkSession, path: str) -> dict[str, list[str]]:
    """The sidecar again: a row per group."""
    return {r["grp"]: list(r["cols"]) for r in spark.read.schema("grp string, cols array<string>").json(path).collect()}


def read_features(df: DataFrame, keys: list[str], labels: list[str]) -> tuple[DataFrame, DataFrame, list[str]]:
    """Rows of the two splits, and the columns that are features."""
    features = [c for c in df.columns if c not in {*keys, *labels, "split"}]
    return df.filter("split = 'train'"), df.filter("split = 'sub'"), features
