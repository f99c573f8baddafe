"""Shared helpers of the corpus operators."""

from __future__ import annotations

import contextlib
from collections.abc import Callable, Iterator
from itertools import chain, pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from tidewater.sources.scratch import forget, owned, scratch, shared_folder, written

__all__ = ["appended", "arrow_rows", "forget", "owned", "per_group", "read", "scratch", "shared_folder", "sliced", "small", "word_count", "written"]

WHITESPACE = " \t\n\x0b\x0c\r"
#: Bytes up to which a side whose rows were counted beforehand is broadcast.
BROADCAST_BYTES = 16 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def small(df: DataFrame, rows: int, row_bytes: int = 64) -> DataFrame:
    """Mark ``df`` for broadcast when its counted ``rows`` of ``row_bytes`` at most are within the bound; else the join is Spark's."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """Batches of at most ``rows`` rows, so that a worker holds few texts as Python objects at once; empty ones are left out.

    Workers are used again, so what Arrow keeps for later goes back at the end of a task.
    """
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    del batches
    pa.default_memory_pool().release_unused()


@contextlib.contextmanager
def arrow_rows(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """Jobs that run within hand at most ``rows`` rows at once to Python, where rows hold whole texts; the setting is put back."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def appended(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], list[pa.Array]]], schema: str, drop: tuple[str, ...] = ()) -> DataFrame:
    """``df`` without the columns ``drop``, and with those of ``schema`` after them.

    ``make`` is called once in a task; what it returns takes a batch of all columns of ``df`` and gives an array for each new
    column. The other columns pass as they are, so integers keep their type beside nulls, whatever their size.
    """
    keep = [i for i, c in enumerate(df.columns) if c not in drop]
    out = StructType([df.schema[i] for i in keep] + StructType.fromDDL(schema).fields)
    names = out.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        added = make()
        for batch in sliced(batches):
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), *added(batch)], names=names)

    return df.mapInArrow(run, out)


def per_group(df: DataFrame, keys: list[str], function: Callable[[pd.DataFrame], pd.DataFrame], schema: str, rows: int = 2000) -> DataFrame:
    """``function`` of each group's rows, for very many small groups of bounded size; ``keys`` are whole numbers without null.

    Partitions are sorted by the keys and handed over in batches, so a group costs no job of its own; results go back together.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest, out, size = None, [], 0
        for batch in chain(batches, [None]):
            frame = rest if batch is None else batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            if frame is None or not len(frame):
                continue
            k = frame[keys].to_numpy()
            cuts = [0, *(np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1).tolist(), len(frame)]
            # The last group may go on in the next batch.
            for a, b in pairwise(cuts if batch is None else cuts[:-1]):
                found = function(frame.iloc[a:b])
                if len(found):
                    out.append(found)
                    size += len(found)
                if size >= rows:
                    yield pd.concat(out, ignore_index=True)
                    out, size = [], 0
            rest = frame.iloc[cuts[-2] :]
        if out:
            yield pd.concat(out, ignore_index=True)

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(run, schema)


def word_count(text: Column) -> Column:
    """Number of runs of characters other than the six ASCII white-space characters; 0 for null."""
    trimmed = F.btrim(text, F.lit(WHITESPACE))
    n = F.size(F.split(trimmed, r"[\x20\x09-\x0D]+"))
    return F.when(text.isNull() | (trimmed == ""), F.lit(0)).otherwise(n).cast("long")

