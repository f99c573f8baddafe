"""Column functions: keys from time stamps, clamps, probabilities."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Hours at which the four parts of a day begin, and their names.
BUCKETS = (("overnight", 0, 6), ("morning", 6, 12), ("afternoon", 12, 18), ("evening", 18, 24))


def no_nan(x: Column) -> Column:
    """NaN as null; aggregates skip only null."""
    return F.nanvl(x, F.lit(None).cast("double"))


def bucket(ts: Column) -> Column:
    """Part of the day, or 'unknown' without a time stamp."""
    out = F.lit("unknown")
    for name, low, high in reversed(BUCKETS):
        out = F.when((F.hour(ts) >= low) & (F.hour(ts) < high), name).otherwise(out)
    return out


def minute_of_day(ts: Column) -> Column:
    return F.hour(ts) * 60 + F.minute(ts)


def floor_minute(ts: Column) -> Column:
    """Whole minutes since 1970, for joins by minute."""
    return F.floor(F.unix_micros(ts.cast("timestamp")) / F.lit(60_000_000)).cast("long")


def night(ts: Column) -> Column:
    """Date of the night that a time from 21:00 to 09:00 belongs to (that of its evening), else null."""
    return F.when(F.hour(ts) >= 21, F.to_date(ts)).when(F.hour(ts) < 9, F.date_sub(F.to_date(ts), 1))


def minute_of_night(ts: Column) -> Column:
    """Minutes since 21:00, from 0 to 719, for times of a night."""
    return F.pmod(minute_of_day(ts) - 21 * 60, F.lit(24 * 60))


def morning_after(ts: Column) -> Column:
    """The day before, for times from 00:00 to 09:00: the day whose night they end. Null for other times."""
    return F.when(F.hour(ts) < 9, F.date_sub(F.to_date(ts), 1))


def clip(x: Column, low: float, high: float) -> Column:
    """``x`` within bounds; null stays null (``least`` and ``greatest`` alone would skip it)."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def log1p_positive(x: Column) -> Column:
    return F.when(x.isNotNull(), F.log1p(F.greatest(x, F.lit(0.0))))


def grid_cell(x: Column, step: float) -> Column:
    """Number of the grid line next to ``x``; halves go to the even line."""
    return F.rint(x / F.lit(step)).cast("long")


def clean(values: Column, low: float, high: float) -> Column:
    """Elements of an array within physiological bounds."""
    return F.filter(values, lambda x: x.between(low, high))


def array_mean(values: Column, least: int = 1) -> Column:
    """Mean of an array with at least ``least`` elements, else null."""
    total = F.aggregate(values, F.lit(0.0), lambda a, x: a + x.cast("double"))
    return F.when(F.size(values) >= least, total / F.size(values))


def mean_above(value: Column, bound: float) -> Column:
    """Aggregate: whether the mean of ``value`` is above ``bound``, whatever the order of the rows; null without values.

    A sum of floating numbers depends on their order in its last bits. So where the mean is that near the bound, and no value
    has more than ten decimals, the values are summed as decimals.
    """
    exact = value.try_cast("decimal(28,10)")
    total, limit = F.try_sum(exact), F.lit(bound).cast("decimal(18,10)") * F.count(value).cast("decimal(19,0)")
    tied = (F.abs(F.avg(value) - bound) <= 1e-9 * (1 + abs(bound))) & (F.count_if(exact.cast("double") == value) == F.count(value)) & total.isNotNull()
    return F.when(tied, total > limit).otherwise(F.avg(value) > bound)


def lookup(x: Column, table: dict, other=None) -> Column:
    """``table[x]``, or ``other``."""
    pairs = F.create_map(*(F.lit(v) for kv in table.items() for v in kv))
    return F.coalesce(F.element_at(pairs, x), F.lit(other))
