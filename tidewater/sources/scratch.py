"""Folders that the driver and all executors share, and tables in them that live as long as they are needed."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

#: Paths of the tables that belong to each open ``scratch``.
_OPEN: list[list[tuple[SparkSession, str]]] = []


def shared_folder(spark: SparkSession) -> str:
    """A new name below ``spark.checkpoint.dir``. Only a local master, as in tests, may go without that setting."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/table-{uuid.uuid4().hex}"


def forget(spark: SparkSession, path: str) -> None:
    """Remove a folder; one that is gone is fine."""
    with contextlib.suppress(Exception):
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@contextlib.contextmanager
def scratch() -> Iterator[None]:
    """Tables that ``written`` makes within are removed at the end, but those it is told to keep."""
    _OPEN.append([])
    try:
        yield
    finally:
        for spark, path in _OPEN.pop():
            forget(spark, path)


def owned(spark: SparkSession, path: str, keep: bool = False) -> None:
    """Remove ``path`` with the innermost open ``scratch``; with ``keep`` with the next one outside, or when Python ends."""
    if len(_OPEN) > keep:
        _OPEN[-1 - keep].append((spark, path))
    else:
        atexit.register(forget, spark, path)


def written(df: DataFrame, keep: bool = False) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: lineage ends here and the rows survive lost executors."""
    spark = df.sparkSession
    path = shared_folder(spark)
    owned(spark, path, keep)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
