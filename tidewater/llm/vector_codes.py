"""Vector codes: a codebook for each part of the vectors, and partial-distance search for the nearest entries.

Components become whole numbers, floor(``scale`` * x), so distances are exact and no order of summing matters. Vectors are cut into ``parts``
equal parts, each with a codebook of its own. Encoding searches all entries at once, in batches of rows:

- Dimensions are processed in descending variance of the codebook's entries, where entries differ most.
- Each row has a best complete distance, first that of the entry nearest in the first dimension, then that of the nearest
  so far after each dimension. A mask drops the entries whose sum so far strictly exceeds it, so those that tie stay.
- What is left after the last dimension has complete distances; ties go to the lower index.

Codebooks start as parts of the first vectors by id. A round sums parts by (part, entry) in the tasks, one row each, and
the sums of all tasks by Spark; only the codebooks, ``entries`` times the vectors' length in numbers, reach the driver and are
broadcast. Vectors are never shuffled.

Defined results: vectors that are null, empty or hold null or non-finite components go, and so do those whose length is
not that of the first vector by id, or no multiple of ``parts``; scaled components beyond +-2**25 count as +-2**25, so
sums stay exact up to 1024 components; rows that agree in their id are ordered by their vectors' bytes; a null id comes last; with
fewer vectors than ``entries`` codebooks are smaller, repeated entries stay unused; an empty table gives no rows; other
columns pass, but those named like the new ones (``ints``, ``code``, ``error``).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import appended, read, scratch, sliced, written

BOUND = 1 << 25


def quantised(df: DataFrame, scale: int = 256) -> DataFrame:
    """``df`` with ``embedding`` replaced by ``ints`` (bytes of 32-bit numbers), without the rows that have none."""

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        out = []
        for row in batch.column("embedding"):
            v = None if not row.is_valid or row.values.null_count else row.values.to_numpy()
            fine = v is not None and len(v) and np.isfinite(v).all()
            out.append(np.clip(np.floor(v * float(scale)), -BOUND, BOUND).astype(np.int32).tobytes() if fine else None)
        return [pa.array(out, pa.binary())]

    rows = df.drop("ints", "code", "error").withColumn("embedding", F.col("embedding").cast("array<double>"))
    return appended(rows, lambda: run, "ints binary", drop=("embedding",)).filter("ints is not null")


class Searcher:
    """Nearest entries of one codebook (entries, dimensions) by partial distances."""

    def __init__(self, book: np.ndarray) -> None:
        # Whole numbers times the number of entries squared, so that the order needs no fractions.
        n, exact = len(book), book.astype(object)
        spread = n * (exact**2).sum(axis=0) - exact.sum(axis=0) ** 2
        self.order = sorted(range(book.shape[1]), key=lambda d: (-spread[d], d))
        self.book = book.astype(np.int64)
        #: Entries completed, and entries that all rows had, to see what the masks save.
        self.worked = self.whole = 0

    def __call__(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index and squared distance of the nearest entry for each row of ``x``."""
        n, k = len(x), len(self.book)
        x, at = x.astype(np.int64), np.arange(n)
        first = self.order[0]
        sums = (x[:, first, None] - self.book[:, first]) ** 2
        row, entry, sums, best = np.repeat(at, k), np.tile(np.arange(k), n), sums.ravel(), self._complete(x, sums.argmin(axis=1))
        for d in self.order[1:]:
            left = sums <= best[row]
            row, entry, sums = row[left], entry[left], sums[left]
            self.worked, self.whole = self.worked + len(row), self.whole + n * k
            sums = sums + (x[row, d] - self.book[entry, d]) ** 2
            # The nearest so far of each row may be nearer in the end than the best complete one.
            best = np.minimum(best, self._complete(x, entry[self._least(row, sums)]))
        left = sums <= best[row]
        row, entry, sums = row[left], entry[left], sums[left]
        found = self._least(row, sums)
        return entry[found], sums[found]

    def _complete(self, x: np.ndarray, entry: np.ndarray) -> np.ndarray:
        return ((x - self.book[entry]) ** 2).sum(axis=1)

    @staticmethod
    def _least(row: np.ndarray, sums: np.ndarray) -> np.ndarray:
        """Place of each row's least sum, the first on ties; every row has one, and rows ascend."""
        starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        least = np.minimum.reduceat(sums, starts)
        hits = np.flatnonzero(sums == least[row])
        return hits[np.r_[True, row[hits][1:] != row[hits][:-1]]]


class Encoder:
    """Codebooks (parts, entries, dimensions) and their searchers."""

    def __init__(self, books: np.ndarray) -> None:
        self.books, self.searchers = books, [Searcher(b) for b in books]

    def __call__(self, ints: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Vectors (rows, parts, dimensions), codes and errors (rows, parts)."""
        parts, _, width = self.books.shape
        x = np.frombuffer(b"".join(ints), np.int32).reshape(len(ints), parts, width)
        found = [s(x[:, p]) for p, s in enumerate(self.searchers)]
        return x, np.stack([f[0] for f in found], axis=1), np.stack([f[1] for f in found], axis=1)


def _round(vectors: DataFrame, books: np.ndarray) -> np.ndarray:
    """Codebooks whose entries are the floors of the means of their parts."""
    shared = vectors.sparkSession.sparkContext.broadcast(books)
    parts, entries, width = books.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(shared.value)
        total, count = np.zeros(books.shape, np.int64), np.zeros((parts, entries), np.int64)
        for batch in sliced(batches, 2000):
            x, codes, _ = encode(batch.column("ints").to_pylist())
            for p in range(parts):
                np.add.at(total[p], codes[:, p], x[:, p])
                count[p] += np.bincount(codes[:, p], minlength=entries)
        p, e = np.nonzero(count)
        cells = pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1) * width, pa.int32()), pa.array(total[p, e].ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(p.astype(np.int32)), pa.array(e.astype(np.int32)), pa.array(count[p, e]), cells], names=["part", "entry", "n", "sums"])

    found = vectors.select("ints").mapInArrow(sums, "part int, entry int, n long, sums array<long>").groupBy("part", "entry").agg(
        F.sum("n").alias("n"), F.array(*(F.sum(F.get("sums", i)) for i in range(width))).alias("sums")
    )
    out = books.copy()
    for r in found.collect():  # the codebooks' size at most
        out[r["part"], r["entry"]] = [s // r["n"] for s in r["sums"]]
    shared.unpersist()
    return out


def codebooks(vectors: DataFrame, order: str = "vec_id", parts: int = 16, entries: int = 64, rounds: int = 2) -> np.ndarray | None:
    """Codebooks (parts, entries, dimensions) fitted on all ``vectors``; None if the first of them can't be cut."""
    by = [F.col(order).asc_nulls_last(), F.col("ints")]
    length = vectors.orderBy(*by).select(F.length("ints").alias("n")).first()
    if length is None or length["n"] % (4 * parts):
        return None
    alike = vectors.filter(F.length("ints") == length["n"])
    first = alike.orderBy(*by).limit(entries).select("ints").collect()
    books = np.stack([np.frombuffer(r["ints"], np.int32).reshape(parts, -1) for r in first], axis=1).astype(np.int64)
    for _ in range(rounds):
        books = _round(alike, books)
    return books


def encoded(vectors: DataFrame, books: np.ndarray) -> DataFrame:
    """``vectors`` of the codebooks' length with ``code`` (an index of a byte for each part) and ``error``, without ``ints``."""
    shared = vectors.sparkSession.sparkContext.broadcast(books)

    def make():
        encode = Encoder(shared.value)

        def run(batch: pa.RecordBatch) -> list[pa.Array]:
            _, codes, errors = encode(batch.column("ints").to_pylist())
            return [pa.array([c.tobytes() for c in codes.astype(np.uint8)], pa.binary()), pa.array(errors.sum(axis=1))]

        return run

    return appended(vectors.filter(F.length("ints") == 4 * books.shape[0] * books.shape[2]), make, "code binary, error long", drop=("ints",))


def books_digest(books: np.ndarray) -> str:
    """Hash of all components by part, entry and position, decimal, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = read(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("vec_id"), "label", "embedding")
    with scratch():
        vectors = written(quantised(table))
        books = codebooks(vectors)
        if books is None:
            return spark.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
        found = written(encoded(vectors, books))
        sums = written(found.groupBy("label").agg(F.sum("error").alias("label_error")))
        out = found.alias("a").join(sums.alias("b"), F.col("a.label").eqNullSafe(F.col("b.label"))).select(
            "vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256")
        )
        return written(out, keep=True)


def _assigned(name: str, books: str) -> str:
    return f"""d_{name} AS (SELECT x.vec_id, x.part, b.entry, sum((x.v - b.v) * (x.v - b.v)) AS d FROM x JOIN {books} b USING (part, pos) GROUP BY ALL),
{name} AS MATERIALIZED (SELECT vec_id, part, entry, d FROM d_{name} QUALIFY row_number() OVER (PARTITION BY vec_id, part ORDER BY d, entry) = 1)"""


def _moved(name: str, books: str, assigned: str) -> str:
    return f"""m_{name} AS (SELECT a.part, a.entry, x.pos, floor(sum(x.v)::DOUBLE / count(*))::BIGINT AS v FROM {assigned} a JOIN x USING (vec_id, part) GROUP BY ALL),
{name} AS MATERIALIZED (SELECT b.part, b.entry, b.pos, coalesce(m.v, b.v) AS v FROM {books} b LEFT JOIN m_{name} m USING (part, entry, pos))"""


OP12_SQL = f"""
WITH k AS (SELECT vec_id, label, embedding FROM embeddings WHERE len(embedding) > 0 AND list_bool_and(list_transform(embedding, lambda v: v IS NOT NULL AND isfinite(v)))),
f AS (SELECT vec_id, embedding, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM k),
u AS (SELECT vec_id, entry, unnest(embedding) AS e, unnest(range(len(embedding))) AS i, len(embedding) // 16 AS w FROM f),
x AS MATERIALIZED (SELECT vec_id, entry, (i // w) AS part, i % w AS pos, floor(256 * e::DOUBLE)::BIGINT AS v FROM u),
b0 AS (SELECT part, entry, pos, v FROM x WHERE entry < 64),
{_assigned('a0', 'b0')}, {_moved('b1', 'b0', 'a0')}, {_assigned('a1', 'b1')}, {_moved('b2', 'b1', 'a1')}, {_assigned('a2', 'b2')},
c AS (SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a2 GROUP BY vec_id)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
       (SELECT sha256(string_agg(v::VARCHAR, ',' ORDER BY part, entry, pos)) FROM b2) AS codebooks_sha256
FROM c JOIN k USING (vec_id)
"""
