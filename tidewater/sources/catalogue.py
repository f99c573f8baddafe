"""A catalogue of columns: classes by ordered prefix and suffix rules, and projections by class.

Rules are a table (place, kind, pattern, class): a column's class is that of the first rule that its name begins or ends with.
Set operations on classes are joins of the catalogue, and a projection takes the columns of the classes that it names.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

Rule = tuple[str, str, str]


def rules_table(spark: SparkSession, rules: Sequence[Rule]) -> DataFrame:
    """place, kind (prefix, suffix or name), pattern, class."""
    bad = [r for r in rules if r[0] not in ("prefix", "suffix", "name")]
    if bad:
        raise ValueError(f"no such kind of rule: {bad[0]}")
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rules)], "place int, kind string, pattern string, class string")


def _holds() -> Column:
    name, pattern = F.col("column"), F.col("pattern")
    return F.when(F.col("kind") == "prefix", name.startswith(pattern)).when(F.col("kind") == "suffix", name.endswith(pattern)).otherwise(name == pattern)


def catalogue(spark: SparkSession, tables: dict[str, DataFrame], rules: Sequence[Rule], other: str = "unclassified") -> DataFrame:
    """table, place (of the column), column, class and rule (null without one)."""
    names = [(t, i, c) for t, df in tables.items() for i, c in enumerate(df.columns)]
    columns = spark.createDataFrame(names, "table string, at int, column string")
    hits = columns.join(F.broadcast(rules_table(spark, rules)), _holds(), "left")
    first = hits.groupBy("table", "at", "column").agg(F.min(F.when(F.col("place").isNotNull(), F.struct("place", "class", "pattern"))).alias("hit"))
    return first.select("table", F.col("at").alias("place"), "column", F.coalesce("hit.class", F.lit(other)).alias("class"), F.col("hit.pattern").alias("rule"))


def columns_of(found: DataFrame, table: str, classes: Iterable[str]) -> list[str]:
    """Names of a table's columns of these classes, in the table's order."""
    rows = found.filter((F.col("table") == table) & F.col("class").isin(list(classes))).orderBy("place").collect()
    return [r["column"] for r in rows]


def projected(df: DataFrame, found: DataFrame, table: str, classes: Iterable[str], keys: Sequence[str] = ()) -> DataFrame:
    """The keys and the columns of these classes; the scan reads no other."""
    return df.select(*keys, *(c for c in columns_of(found, table, classes) if c not in keys))


def overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """a, b, shared, jaccard: column names of every class of one catalogue that those of the other have too."""
    x, y = (d.select(F.col("class").alias(n), "column").distinct() for d, n in ((a, "a"), (b, "b")))
    sizes = [d.groupBy(n).agg(F.count(F.lit(1)).alias(f"n_{n}")) for d, n in ((x, "a"), (y, "b"))]
    shared = x.join(y, "column").groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"))
    return shared.join(sizes[0], "a").join(sizes[1], "b").select("a", "b", "shared", (F.col("shared") / (F.col("n_a") + F.col("n_b") - F.col("shared"))).alias("jaccard"))
