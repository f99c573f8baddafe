"""Secret scans with corpus-wide ownership frequency.

Each text is scanned once. Base patterns give the spans that are always reported; a generator of long mixed tokens adds
candidates. The hash of every candidate's value is counted over the whole corpus by distinct repositories (documents) and
owners (sources): a value that ``copied_owners`` or more owners share, or that stands in ``copied_repositories`` or more
repositories, is a widely copied example; any other is live-looking. Live-looking candidates outside the base spans are
added as ``generic`` spans: long mixed tokens, tokens with a known prefix, passwords within addresses, and private keys.

Counting is by (value, owner) first, so that a value found in a third of all rows meets in one row per owner.

Defined results: null text is empty; a null owner is an owner; repeated rows give repeated results and count as one
repository; other columns are ignored. Values leave the scanning task only as hashes.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from itertools import accumulate

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import appended, read, scratch, written

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""((?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
GENERIC = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}")
#: Public prefixes of access tokens, passwords in addresses, heads of private keys.
KNOWN = re.compile(r"\bgh[opsu]_[A-Za-z0-9]{20,}|\bxox[abprs]-[A-Za-z0-9-]{10,}|\beyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+|(?<=://)[^\s:/@]+:[^\s:/@]{6,}(?=@)|-----BEGIN [A-Z ]*PRIVATE KEY-----\s*[A-Za-z0-9+/=]{40,}(?:\s[A-Za-z0-9+/=]{40,})*")
_CUE = re.compile(r"passw|secret|token|api_?key", re.I | re.A)
_SIGN = re.compile(r"gh[opsu]_|xox|eyJ|://|PRIVATE KEY")

SCHEMA = "base array<struct<kind:string,start:int,end:int>>, found array<struct<hash:long,kind:string,start:int,end:int>>"
_TYPES = {"hash": pa.int64(), "kind": pa.string(), "start": pa.int32(), "end": pa.int32()}


def entropy(value: str) -> float:
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values())


def scan(text: str, bits: float = 3.5) -> tuple[list, list]:
    """Base spans by start, then kind as listed; candidates with the hash of their value."""
    base, found = [], []

    def take(kind: int, start: int, end: int, value: str) -> None:
        base.append((start, kind, end))
        found.append((xxhash.xxh64_intdigest(value.encode()) - (1 << 63), KINDS[kind], start, end))

    if _CUE.search(text):
        for m in ASSIGN.finditer(text):
            if len(m[2]) >= 8:
                take(0, m.start(), m.end(), m[2])
    if "AKIA" in text:
        for m in ACCESS.finditer(text):
            if len(m[0]) >= 16:
                take(1, m.start(), m.end(), m[0])
    for m in HEX.finditer(text):
        take(2, m.start(), m.end(), m[0])
    base.sort()
    # Spans so far by start, and the furthest end up to each, so that a candidate is tested by one search.
    taken, ends = [s for s, _, _ in base], list(accumulate((e for _, _, e in base), max))

    def mixed(v: str) -> bool:
        return any(c.isdigit() for c in v) and any(c.isalpha() for c in v) and entropy(v) >= bits

    more = [(m.start(), m.end(), m[0]) for m in KNOWN.finditer(text)] if _SIGN.search(text) else []
    more += [(m.start(), m.end(), m[0]) for m in GENERIC.finditer(text) if mixed(m[0])]
    last = 0
    for start, end, v in sorted(more, key=lambda x: (x[0], -x[1])):
        at = bisect_left(taken, end)
        if start >= last and not (at and ends[at - 1] > start):
            found.append((xxhash.xxh64_intdigest(v.encode("utf-8", "surrogatepass")) - (1 << 63), "generic", start, end))
            last = end
    return [(KINDS[k], s, e) for s, k, e in base], found


def scanned(docs: DataFrame, owner: str = "source", bits: float = 3.5) -> DataFrame:
    """row, doc_id, owner, base spans and candidates of every document; ``row`` tells repeated rows apart."""

    def make():
        def run(batch: pa.RecordBatch) -> list[pa.Array]:
            out = [scan(t, bits) for t in batch.column("text").to_pylist()]
            return [
                pa.array([[dict(zip(names, s, strict=True)) for s in x[i]] for x in out], pa.list_(pa.struct([(n, _TYPES[n]) for n in names])))
                for i, names in enumerate((("kind", "start", "end"), ("hash", "kind", "start", "end")))
            ]

        return run

    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"),
        F.col(owner).cast("string").alias("owner"), F.coalesce("text", F.lit("")).alias("text"),
    )
    return appended(rows, make, SCHEMA, drop=("text",))


def ownership(found: DataFrame, copied_owners: int = 3, copied_repositories: int = 20) -> DataFrame:
    """hash, repositories, owners, live for every candidate value of the corpus."""
    cands = found.select("doc_id", "owner", F.explode("found").alias("c")).select("doc_id", "owner", F.col("c.hash").alias("hash"))
    by_doc = cands.groupBy("hash", "owner", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    by_owner = by_doc.groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("docs"))
    by_value = by_owner.groupBy("hash").agg(F.sum("docs").alias("repositories"), F.count(F.lit(1)).alias("owners"))
    return by_value.withColumn("live", (F.col("owners") < copied_owners) & (F.col("repositories") < copied_repositories))


def secrets(docs: DataFrame, owner: str = "source", bits: float = 3.5, copied_owners: int = 3, copied_repositories: int = 20) -> DataFrame:
    """doc_id, base, added (arrays of kind, start, end), n_live and n_copied: one row per row of ``docs``.

    A live-looking value stands in few repositories, so those alone are joined back to their candidates; the rest are copied.
    """
    found = written(scanned(docs, owner, bits))
    live = written(ownership(found, copied_owners, copied_repositories).filter("live").select("hash"))
    cands = found.select("row", F.explode("found").alias("c")).select("row", F.col("c.hash").alias("hash"), "c.kind", "c.start", "c.end")
    judged = cands.join(live, "hash", "left_semi").groupBy("row").agg(
        F.collect_list(F.when(F.col("kind") == "generic", F.struct("kind", "start", "end"))).alias("added"), F.count(F.lit(1)).alias("n_live")
    )
    none = F.array().cast("array<struct<kind:string,start:int,end:int>>")
    n_live = F.coalesce("n_live", F.lit(0)).cast("long")
    return found.join(judged, "row", "left").select(
        "doc_id", "base", F.coalesce("added", none).alias("added"), n_live.alias("n_live"), (F.size("found") - n_live).alias("n_copied")
    )


def _listed(spans: Column) -> Column:
    order = lambda s: F.struct(
        s["start"].alias("start"),
        F.when(s["kind"] == "assign", 1).when(s["kind"] == "access", 2).when(s["kind"] == "hex", 3).otherwise(4).alias("rank"),
        s["end"].alias("end"), s["kind"].alias("kind"),
    )
    return F.array_join(F.transform(F.array_sort(F.transform(spans, order)), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _of_kind(kind: str):
    # A lambda with a second parameter would get the element's index there.
    return lambda s: s["kind"] == F.lit(kind)


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    with scratch():
        found = secrets(read(spark, sf_dir, "documents"))
        of = {k: F.filter("base", _of_kind(k)) for k in KINDS}
        out = found.select(
            "doc_id", *(F.size(x).cast("long").alias(f"n_{k}") for k, x in of.items()),
            F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(F.concat("base", "added")).alias("spans"), "n_live", "n_copied",
        )
        return written(out, keep=True)
