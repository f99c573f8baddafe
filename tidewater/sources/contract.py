"""A table's contract as data: rules compiled into one aggregate, a report row for each.

A rule names what must hold and gives, for a table, the number of its violations as one aggregate column; ``report`` puts all
rules of a table into one job, and ``violations`` shows the rows that break a rule that speaks of rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F


class Rule:
    """``name``; ``broken`` is true for rows that break it (None if it speaks of the whole table)."""

    name: str

    def broken(self) -> Column | None:
        return None

    def count(self) -> Column:
        """Aggregate: number of violations."""
        return F.count_if(F.coalesce(self.broken(), F.lit(True)))


def _within(where: str | None, column: Column) -> Column:
    """Broken only where the condition holds."""
    return column if where is None else F.coalesce(F.expr(where), F.lit(False)) & column


@dataclass
class Rows(Rule):
    """So many rows at least and at most, of those where the condition holds."""

    least: int
    most: int | None = None
    where: str | None = None

    @property
    def name(self) -> str:
        return f"rows {self.where or 'in all'}"

    def count(self) -> Column:
        n = F.count(F.lit(1)) if self.where is None else F.count_if(F.expr(self.where))
        over = F.lit(0) if self.most is None else F.greatest(n - self.most, F.lit(0))
        return F.greatest(F.lit(self.least) - n, F.lit(0)) + over


@dataclass
class Unique(Rule):
    """No two rows agree in the keys; nulls agree with each other."""

    keys: Sequence[str]

    @property
    def name(self) -> str:
        return f"unique {', '.join(self.keys)}"

    def count(self) -> Column:
        return F.count(F.lit(1)) - F.count_distinct(F.struct(*self.keys))


@dataclass
class Known(Rule):
    """No null in the columns, where the condition holds."""

    columns: Sequence[str]
    where: str | None = None

    @property
    def name(self) -> str:
        return f"known {', '.join(self.columns)}"

    def broken(self) -> Column:
        return _within(self.where, F.array_contains(F.array(*(F.col(c).isNull() for c in self.columns)), True))


@dataclass
class Unknown(Rule):
    """Nothing but null in the columns, where the condition holds."""

    columns: Sequence[str]
    where: str | None = None

    @property
    def name(self) -> str:
        return f"unknown {', '.join(self.columns)}"

    def broken(self) -> Column:
        return _within(self.where, F.array_contains(F.array(*(F.col(c).isNotNull() for c in self.columns)), True))


@dataclass
class Between(Rule):
    """Values within bounds, or strictly within; null, NaN and infinity break it."""

    columns: Sequence[str]
    low: float
    high: float
    strict: bool = False

    @property
    def name(self) -> str:
        return f"between {', '.join(self.columns)}"

    def broken(self) -> Column:
        def fine(c: str) -> Column:
            x = F.col(c).cast("double")
            return F.coalesce((x > self.low) & (x < self.high) if self.strict else x.between(self.low, self.high), F.lit(False))

        return F.array_contains(F.array(*(~fine(c) for c in self.columns)), True)


@dataclass
class OneOf(Rule):
    """One of the values, or null where that is allowed."""

    column: str
    values: Sequence
    null: bool = False

    @property
    def name(self) -> str:
        return f"one of {self.column}"

    def broken(self) -> Column:
        return F.coalesce(~F.col(self.column).isin(list(self.values)), F.lit(not self.null))


@dataclass
class Shape(Rule):
    """Arrays of so many elements, none of them null, NaN or infinite; of arrays of arrays the inner length too."""

    column: str
    length: int
    inner: int | None = None

    @property
    def name(self) -> str:
        return f"shape {self.column}"

    def broken(self) -> Column:
        def bad(v: Column) -> Column:
            x = v.cast("double")
            return x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))

        def wrong(v: Column) -> Column:
            return F.coalesce((F.size(v) != self.inner) | F.exists(v, bad), F.lit(True))

        return F.coalesce((F.size(self.column) != self.length) | F.exists(self.column, bad if self.inner is None else wrong), F.lit(True))


@dataclass
class Mask(Rule):
    """A mask of zeros and ones as long as its array, whose unseen cells are 0."""

    mask: str
    array: str

    @property
    def name(self) -> str:
        return f"mask {self.mask}"

    def broken(self) -> Column:
        pairs = F.arrays_zip(F.col(self.mask).alias("m"), F.col(self.array).alias("x"))
        wrong = F.exists(pairs, lambda p: F.coalesce(~p["m"].isin(0, 1) | ((p["m"] == 0) & (p["x"] != 0)), F.lit(True)))
        return F.coalesce((F.size(self.mask) != F.size(self.array)) | wrong, F.lit(True))


@dataclass
class Contract:
    """Rules of one table, and the columns that it must have."""

    table: str
    rules: Sequence[Rule]
    columns: Sequence[str] = field(default_factory=tuple)


def report(df: DataFrame, contract: Contract) -> DataFrame:
    """table, rule, violations, ok: a row for each rule, and one for the columns; rules on missing columns are not run."""
    missing = sorted(set(contract.columns) - set(df.columns))
    twice = len(df.columns) - len(set(df.columns))
    rows = [F.struct(F.lit("columns").alias("rule"), F.lit(len(missing) + twice).cast("long").alias("violations"))]
    rules = contract.rules if not missing and not twice else ()
    rows += [F.struct(F.lit(r.name).alias("rule"), r.count().cast("long").alias("violations")) for r in rules]
    found = df.agg(F.array(*rows).alias("r")).select(F.inline("r"))
    return found.select(F.lit(contract.table).alias("table"), "rule", "violations", (F.col("violations") == 0).alias("ok"))


def violations(df: DataFrame, rule: Rule) -> DataFrame:
    """The rows that break a rule, whole."""
    broken = rule.broken()
    if broken is None:
        raise ValueError(f"{rule.name} speaks of the whole table")
    return df.filter(F.coalesce(broken, F.lit(True)))


def require(df: DataFrame, contract: Contract) -> None:
    """An error that names all broken rules."""
    bad = report(df, contract).filter(~F.col("ok")).collect()
    if bad:
        raise ValueError(f"{contract.table}: " + "; ".join(f"{r['rule']} ({r['violations']})" for r in bad))
