"""Sleep-like episodes on per-night minute grids."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .joins import as_of_steps
from .ranks import column_percentiles
from .windows import centred_mean, runs


def grid(nights: DataFrame, day: str, start_minute: int, rows: int, name: str = "ts") -> DataFrame:
    """``rows`` minutes per row of ``nights`` from ``start_minute`` of its day on."""
    first = F.expr(f"timestampadd(MINUTE, {start_minute}, cast({day} as timestamp_ntz))")
    minutes = nights.withColumn("minute", F.explode(F.sequence(F.lit(0), F.lit(rows - 1)))).withColumn("__first", first)
    return minutes.withColumn(name, F.expr("timestampadd(MINUTE, minute, __first)")).drop("__first")


def evidence(flags: list[Column]) -> Column:
    """Share of the known flags that agree; 0 where none is known."""
    known = sum((F.when(f.isNotNull(), 1).otherwise(0) for f in flags), F.lit(0))
    agree = sum((F.coalesce(f.cast("int"), F.lit(0)) for f in flags), F.lit(0))
    return F.when(known > 0, agree / known).otherwise(0.0)


def episodes(minutes: DataFrame, by: list[str], score: str, threshold: float = 0.75, least: int = 30, gap: int = 30, last: int | None = None) -> DataFrame:
    """Main episode of each night: by, bed, wake (minute after the last, at most minute ``last`` of the grid), runs.

    Scores are smoothed over seven rows; minutes at or above the threshold are asleep. Of the runs of at least ``least``
    minutes the longest (first on ties) is the anchor; later runs are merged one after the other while the gap before the
    next is below ``gap``. The fold over a night's runs is bounded by the night.
    """
    smooth = minutes.withColumn("__s", centred_mean(score, by, ["minute"]))
    smooth = smooth.withColumn("__asleep", (F.coalesce("__s", F.lit(0.0)) >= threshold).cast("int"))
    return merged(runs(smooth, by, ["minute"], "__asleep").filter("__asleep = 1"), by, least, gap, last)


def merged(found: DataFrame, by: list[str], least: int = 30, gap: int = 30, last: int | None = None) -> DataFrame:
    """Episodes from runs with start, stop and length."""
    long = found.filter(F.col("length") >= least).groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("start", "stop", "length"))).alias("r"))
    lengths = F.transform("r", lambda x: x["length"])
    at = F.array_position(lengths, F.array_max(lengths)).cast("int")
    main = F.element_at("r", at)
    rest = F.slice("r", at + 1, F.size("r"))
    state = F.struct(main["stop"].alias("stop"), F.lit(False).alias("done"))
    fold = F.aggregate(
        rest, state,
        lambda a, x: F.struct(
            F.when(~a["done"] & (x["start"] - a["stop"] - 1 < gap), x["stop"]).otherwise(a["stop"]).alias("stop"),
            (a["done"] | (x["start"] - a["stop"] - 1 >= gap)).alias("done"),
        ),
    )
    wake = fold["stop"] + 1 if last is None else F.least(fold["stop"] + 1, F.lit(last))
    return long.select(*by, main["start"].alias("bed"), wake.alias("wake"), F.size("r").alias("runs"))


def onset(minutes: DataFrame, by: list[str], flags: list[Column], least_flags: int = 3, least_run: int = 5) -> DataFrame:
    """First run of at least ``least_run`` minutes with ``least_flags`` agreeing flags; a missing flag does not agree."""
    agree = sum((F.coalesce(f.cast("int"), F.lit(0)) for f in flags), F.lit(0))
    marked = minutes.withColumn("__asleep", (agree >= least_flags).cast("int"))
    every = runs(marked, by, ["minute"], "__asleep")
    own = (F.col("__asleep") == 1) & (F.col("length") >= least_run)
    return every.groupBy(*by).agg(
        F.min(F.when(own, F.col("start"))).alias("onset"), F.count_if(own).alias("runs"), F.max(F.when(own, F.col("length"))).alias("longest"),
        F.max(own.cast("int")).alias("found"),
    )


def onset_of_spans(spans: DataFrame, by: list[str], flags: list[Column], least_flags: int = 3, least_run: int = 5) -> DataFrame:
    """``onset`` of the minutes that ``joins.filled_spans`` tells of; minutes in no span have no flag."""
    if least_flags < 1:
        raise ValueError("minutes without values would agree")
    agree = sum((F.coalesce(f.cast("int"), F.lit(0)) for f in flags), F.lit(0))
    marked = spans.withColumn("__asleep", (agree >= least_flags) & (F.col("stop") > F.col("start")))
    w = W.partitionBy(*by).orderBy("start")
    goes_on = F.col("__asleep") & F.coalesce(F.lag("__asleep").over(w) & (F.lag("stop").over(w) == F.col("start")), F.lit(False))
    marked = marked.withColumn("__new", F.when(goes_on, 0).otherwise(1)).withColumn("__run", F.sum("__new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    every = marked.groupBy(*by, "__run").agg(F.bool_or("__asleep").alias("__asleep"), F.min("start").alias("start"), (F.max("stop") - F.min("start")).cast("long").alias("length"))
    own = F.col("__asleep") & (F.col("length") >= least_run)
    return every.groupBy(*by).agg(
        F.min(F.when(own, F.col("start"))).alias("onset"), F.count_if(own).alias("runs"), F.max(F.when(own, F.col("length"))).alias("longest"),
        F.max(own.cast("int")).alias("found"),
    )


def _runs_above(scores: np.ndarray, threshold: float, half: int = 3, least: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first and last place of every run of places whose mean with ``half`` neighbours on each side is at or above the threshold."""
    count, width = scores.shape
    padded, total = np.pad(scores, ((0, 0), (half, half))), np.zeros_like(scores)
    for i in range(2 * half + 1):
        total += padded[:, i : i + width]
    place = np.arange(width)
    known = np.minimum(place + half, width - 1) - np.maximum(place - half, 0) + 1
    above = np.zeros((count, width + 2), np.int8)
    above[:, 1:-1] = (total / known >= threshold) & (known >= least)
    change = np.diff(above, axis=1)
    (row, start), (_, stop) = np.nonzero(change == 1), np.nonzero(change == -1)
    return row, start, stop - 1


def episodes_of_spans(spans: DataFrame, by: list[str], score: Column, rows: int, threshold: float = 0.75, least: int = 30, gap: int = 30, last: int | None = None, nights: int = 512) -> DataFrame:
    """``episodes`` of the minutes that ``joins.filled_spans`` tells of; minutes in no span score 0.

    One row for each night goes to Python; its minutes exist there only, for ``nights`` nights at once.
    """
    if threshold <= 0:
        raise ValueError("minutes without values would be asleep")
    scored = spans.filter("stop > start").withColumn("__score", score.cast("double")).filter(F.col("__score") > 0)
    listed = scored.groupBy(*by).agg(F.collect_list(F.struct("start", "stop", "__score")).alias("__spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, nights):
                part = batch.slice(at, nights)
                spans = part.column("__spans")
                size = spans.value_lengths().to_numpy(zero_copy_only=False)
                start, stop, value = (spans.flatten().field(i).to_numpy(zero_copy_only=False) for i in range(3))
                length = stop - start
                ends = np.cumsum(length)
                cells = np.repeat(np.repeat(np.arange(len(size)), size) * rows + start - (ends - length), length) + np.arange(ends[-1] if len(ends) else 0)
                scores = np.zeros((len(size), rows))
                scores.reshape(-1)[cells] = np.repeat(value, length)
                night, first, final = _runs_above(scores, threshold)
                long = final - first + 1 >= least
                kept = part.select(by).take(pa.array(night[long]))
                columns = [*kept.columns, *(pa.array(v[long].astype(t)) for v, t in ((first, np.int32), (final, np.int32), (final - first + 1, np.int64)))]
                yield pa.RecordBatch.from_arrays(columns, names=[*by, "start", "stop", "length"])

    keys = ", ".join(f"`{c}` {t}" for c, t in listed.select(*by).dtypes)
    return merged(listed.mapInArrow(run, f"{keys}, start int, stop int, length long"), by, least, gap, last)


def nights(spine: DataFrame, signals: dict[str, tuple[DataFrame, int]], by: list[str], day: str, start_minute: int, rows: int) -> DataFrame:
    """Minute grid of every night with each signal filled as of the minute within its own limit of steps.

    ``signals``: name -> (rows with ``by``, ts and the value under that name, limit).
    """
    out = grid(spine.select(*by), day, start_minute, rows)
    for name, (obs, limit) in signals.items():
        out = as_of_steps(out, obs.select(*by, "ts", name), by, "ts", name, limit)
    return out


def with_fallback(spine: DataFrame, found: DataFrame, by: list[str], subject: str, columns: list[str]) -> DataFrame:
    """Missing episodes take the subject's median, then the median of all; ``fallback`` tells."""
    joined = spine.join(found, by, "left").withColumn("fallback", F.col(columns[0]).isNull().cast("int"))
    own = joined.groupBy(subject).agg(*(F.percentile(c, 0.5).alias(f"__own_{c}") for c in columns))
    every = column_percentiles(joined, columns, 0.5)
    filled = joined.join(own, subject, "left")
    return filled.withColumns({c: F.coalesce(F.col(c).cast("double"), f"__own_{c}", F.lit(every[c])) for c in columns}).drop(
        *(f"__own_{c}" for c in columns)
    )


def rhythm(df: DataFrame, subject: str, bed: str, wake: str, train: Column, least: int = 3) -> DataFrame:
    """Regularity of each subject's nights from its training rows, and every night's distance from the subject's median."""
    mid = (F.col(bed) + F.col(wake)) / 2
    rows = df.withColumn("midsleep", mid).withColumn("tib", F.col(wake) - F.col(bed))
    own = rows.filter(train).groupBy(subject)
    columns = [bed, wake, "midsleep", "tib"]
    stats = own.agg(
        *(F.when(F.count(c) >= least, F.stddev_samp(c)).alias(f"{c}_std") for c in columns), *(F.percentile(c, 0.5).alias(f"__{c}") for c in columns)
    )
    return rows.join(stats, subject, "left").withColumns({f"{c}_dev": F.col(c) - F.col(f"__{c}") for c in columns}).drop(*(f"__{c}" for c in columns))
