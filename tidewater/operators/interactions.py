"""Products of features that tell days apart: selected on training rows, applied to any rows.

A feature gets a vote from each label for which it is among the first by rank correlation and holds within subjects. The
features with most votes are filled by their medians and standardised; the products of every two are judged against every label, raw and within
subjects, from one long table; the best of each label that hold within subjects are kept.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from itertools import combinations

from pyspark.sql import Column, DataFrame, functions as F

from tidewater.sources.scratch import written

from .day import top_per_group
from .ranks import column_percentiles
from .stats import within_between

_APART = "\x01"


@dataclass
class Interactions:
    labels: Sequence[str]
    subject: str
    first: int = 20
    pool: int = 30
    best: int = 5
    least: float = 0.1
    rich: float = 0.7
    between: float = 0.3
    pooled: list[str] = field(default_factory=list)
    selected: list[tuple[str, str]] = field(default_factory=list)
    state: dict[str, tuple[float, float, float]] = field(default_factory=dict)

    def _judged(self, rows: DataFrame, values: dict[str, Column]) -> DataFrame:
        """label, feature, raw, within, n, kind of every value against every label."""
        cells = F.array(*(F.struct(F.lit(n).alias("feature"), v.cast("double").alias("x")) for n, v in values.items()))
        marks = F.array(*(F.struct(F.lit(y).alias("label"), F.col(y).cast("double").alias("y")) for y in self.labels))
        long = rows.select(self.subject, F.inline(cells), marks.alias("m")).select(self.subject, "feature", "x", F.inline("m"))
        long = written(long.select(self.subject, F.concat_ws(_APART, "label", "feature").alias("key"), "x", "y"))
        found = within_between(long, self.subject, "key", "x", "y", self.least, self.rich, self.between)
        parts = F.split("key", _APART)
        return written(found.select(parts[0].alias("label"), parts[1].alias("feature"), "raw", "within", "n", "kind"))

    def _first(self, judged: DataFrame, n: int) -> DataFrame:
        rich = judged.filter("kind = 'day_rich'")
        return top_per_group(rich, ["label"], [F.desc(F.abs("raw")), F.col("feature")], n)

    def _value(self, c: str) -> Column:
        middle, mean, spread = self.state[c]
        return (F.coalesce(F.col(c).cast("double"), F.lit(middle)) - F.lit(mean)) / F.lit(spread)

    def _product(self, a: str, b: str) -> Column:
        return self._value(a) * self._value(b)

    def fit(self, train: DataFrame, features: Sequence[str]) -> DataFrame:
        """What the kept products were judged by: label, feature (a__x__b), raw, within, n, kind, rank."""
        votes = self._first(self._judged(train, {c: F.col(c) for c in features}), self.first)
        order = votes.groupBy("feature").agg(F.count(F.lit(1)).alias("votes"), F.max(F.abs("raw")).alias("r")).orderBy(F.desc("votes"), F.desc("r"), "feature")
        self.pooled = [r["feature"] for r in order.limit(self.pool).collect()]
        if len(self.pooled) < 2:
            self.selected = []
            return votes.limit(0)
        middle = {c: v or 0.0 for c, v in column_percentiles(train, self.pooled, 0.5).items()}
        filled = {c: F.coalesce(F.col(c).cast("double"), F.lit(middle[c])) for c in self.pooled}
        s = train.agg(*(F.avg(v).alias(f"m{i}") for i, v in enumerate(filled.values())), *(F.stddev_pop(v).alias(f"s{i}") for i, v in enumerate(filled.values()))).first()
        self.state = {c: (middle[c], s[f"m{i}"], s[f"s{i}"] or 1.0) for i, c in enumerate(self.pooled)}
        # Rounded, so that products that differ by arithmetic noise only tie.
        pairs = {f"{a}__x__{b}": F.round(self._product(a, b), 9) for a, b in combinations(self.pooled, 2)}
        kept = written(self._first(self._judged(train, pairs), self.best))
        names = sorted({r["feature"] for r in kept.select("feature").distinct().collect()})
        self.selected = [tuple(n.split("__x__")) for n in names]
        return kept

    @property
    def added(self) -> list[str]:
        return [f"{a}__x__{b}" for a, b in self.selected]

    def transform(self, rows: DataFrame) -> DataFrame:
        """``rows`` with the kept products, by what the training rows gave."""
        return rows.withColumns({f"{a}__x__{b}": self._product(a, b) for a, b in self.selected}) if self.selected else rows
