"""Embedding near-dedup with an inverted multi-index.

Vectors with the same components form a class; one row of each is indexed. The two halves of the vectors have codebooks
of their own, fitted on a sample of about ``sample_rows`` classes, or eight for each code if that is more, and the product of the codebooks is a grid of
cells, about one for four classes. Every class is in the cell of its nearest centroids. As a query it traverses the cells in
order of the sum of its squared distances to the cells' two centroids (the multi-sequence order) and visits the first T; T is
calibrated on the whole sample so that for partners made up at exactly the wanted cosine the target recall is reached.

Vectors don't travel to the cells that they visit. Queries go there with sketches, 256 signs of random projections: one
row for each row of the grid that they visit, with its cells. What comes back are the queries and members that have any
partner within the bound of Hamming distances, four deviations above what the wanted cosine gives. Only their vectors are then
sent, to those cells only, and verified by cosine in double precision, so no link below the threshold is reported; links
are missed only where neither of the two visits the other's cell, or (three in 100,000) where sketches are too unlike and
neither has another partner there. A pair that was verified always counts.

A pair is counted once: in the cell of one if only that one is visited, else in the larger cell. Rows of the grid and cells
are worked on in blocks of bounded members and queries; a cell with thousands of near copies becomes many blocks. Tasks
return nodes, local roots and numbers of links, never pairs.

Defined results: vectors that are null, zero, empty or hold null or non-finite components link with nothing; vectors of
different lengths do not link; repeated rows link with each other; a null vec_id takes part, and its component has the
smallest vec_id of the rest (null if all are null); an empty table gives no rows; other columns, labels among them, are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import appended, per_group, read, scratch, small, written
from .components import components


def vectors(df: DataFrame) -> DataFrame:
    """row, vec_id, size, d1, d2, vector (bytes of doubles; null if it links with nothing)."""

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        data = []
        for row in batch.column("embedding"):
            v = None if not row.is_valid or row.values.null_count else row.values.to_numpy()
            fine = v is not None and len(v) and np.isfinite(v).all() and np.isfinite(v @ v) and v @ v > 0
            data.append(v.tobytes() if fine else None)
        digests = [0 if x is None else xxhash.xxh3_128_intdigest(x) for x in data]
        two = (pa.array([f(d) - (1 << 63) for d in digests], pa.int64()) for f in (lambda d: d >> 64, lambda d: d & (1 << 64) - 1))
        return [pa.array([0 if x is None else len(x) // 8 for x in data], pa.int32()), *two, pa.array(data, pa.binary())]

    rows = df.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return appended(rows, lambda: run, "size int, d1 long, d2 long, vector binary", drop=("embedding",))


def _unit(data, width: int) -> np.ndarray:
    """Rows of length 1, filled up with zeros to ``width``."""
    data = list(data)
    if all(len(x) == 8 * width for x in data):
        out = np.frombuffer(b"".join(data)).reshape(len(data), width)
    else:
        out = np.zeros((len(data), width))
        for i, x in enumerate(data):
            out[i, : len(x) // 8] = np.frombuffer(x)
    return out / np.linalg.norm(out, axis=1, keepdims=True)


def _distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(axis=1)[:, None] + (centroids * centroids).sum(axis=1) - 2 * x @ centroids.T, 0)


#: Signs in a sketch.
BITS = 256


class MultiIndex:
    """Two codebooks, the number of cells that a query visits, and sketches with their bound."""

    def __init__(self, sample: np.ndarray, codes: int, threshold: float, recall: float, seed: int = 5) -> None:
        rng = np.random.default_rng(seed)
        self.half = (sample.shape[1] + 1) // 2
        self.books = [self._book(h, codes, rng) for h in self._halves(sample)]
        self.visits = self._calibrate(sample, threshold, recall, rng)
        self.planes = rng.normal(size=(sample.shape[1], BITS))
        unlike = np.arccos(threshold) / np.pi
        self.bound = int(np.ceil(BITS * unlike + 4 * np.sqrt(BITS * unlike * (1 - unlike))))

    def sketch(self, x: np.ndarray) -> np.ndarray:
        return np.packbits(x @ self.planes > 0, axis=1)

    def _halves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return x[:, : self.half], x[:, self.half :]

    @staticmethod
    def _book(x: np.ndarray, codes: int, rng: np.random.Generator) -> np.ndarray:
        distinct = np.unique(x, axis=0)
        book = distinct[rng.permutation(len(distinct))[:codes]].copy()
        for _ in range(8):
            nearest = np.concatenate([_distances(x[at : at + 1024], book).argmin(axis=1) for at in range(0, len(x), 1024)])
            sums, counts = np.zeros_like(book), np.bincount(nearest, minlength=len(book))
            np.add.at(sums, nearest, x)
            book[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
        return book

    def _calibrate(self, sample: np.ndarray, threshold: float, recall: float, rng: np.random.Generator) -> int:
        """Number of cells, from all rows of the sample."""
        ranks = [self._ranks(sample[at : at + 1024], threshold, rng) for at in range(0, len(sample), 1024)]
        return max(1, int(np.quantile(np.concatenate(ranks), recall, method="higher")))

    def _ranks(self, x: np.ndarray, threshold: float, rng: np.random.Generator) -> np.ndarray:
        """For each row and a partner made up at ``threshold``: cells that the one of the two that is nearer has to visit."""
        away = rng.normal(size=x.shape)
        away -= (away * x).sum(axis=1, keepdims=True) * x
        y = threshold * x + (1 - threshold**2) ** 0.5 * away / np.maximum(np.linalg.norm(away, axis=1, keepdims=True), 1e-12)

        def rank(query: np.ndarray, partner: np.ndarray) -> np.ndarray:
            a, b = (_distances(h, c) for h, c in zip(self._halves(query), self.books, strict=True))
            i, j = (_distances(h, c).argmin(axis=1) for h, c in zip(self._halves(partner), self.books, strict=True))
            at = np.arange(len(query))
            last = a[at, i] + b[at, j]
            # Sorted, so that a row costs the logarithm of the codes, not their square.
            b.sort(axis=1)
            return np.array([np.searchsorted(b[k], last[k] - a[k] + 1e-12, side="right").sum() for k in at])

        return np.minimum(rank(x, y), rank(y, x))

    def traverse(self, x: np.ndarray) -> np.ndarray:
        """(rows, visits): cells in multi-sequence order, the own cell first."""
        a, b = (_distances(h, c) for h, c in zip(self._halves(x), self.books, strict=True))
        n = min(self.visits, a.shape[1] * b.shape[1])
        # The first n cells have ranks i, j with (i + 1) * (j + 1) <= n.
        pairs = np.array([(i, j) for i in range(min(n, a.shape[1])) for j in range(min(n // (i + 1), b.shape[1]))])
        (i, a), (j, b2) = (self._nearest(d, n) for d in (a, b))
        sums = a[:, pairs[:, 0]] + b2[:, pairs[:, 1]]
        first = sums.argsort(axis=1, kind="stable")[:, :n]
        at = np.arange(len(x))[:, None]
        return i[at, pairs[first, 0]] * b.shape[1] + j[at, pairs[first, 1]]

    @staticmethod
    def _nearest(d: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``n`` nearest centroids in order, and their distances."""
        at = np.arange(len(d))[:, None]
        some = np.argpartition(d, n - 1, axis=1)[:, :n] if n < d.shape[1] else np.tile(np.arange(d.shape[1]), (len(d), 1))
        some.sort(axis=1)
        some = some[at, d[at, some].argsort(axis=1, kind="stable")]
        return some, d[at, some]


def _sketches(data) -> np.ndarray:
    data = list(data)
    return np.frombuffer(b"".join(data), np.uint64).reshape(len(data), BITS // 64)


def _plausible(bound: int, pairs: int = 1 << 20):
    """Queries (role 1) and members (role 0) of a block that have a partner within the bound, and the cell where."""

    def run(block: pd.DataFrame) -> pd.DataFrame:
        m, q = block[block["role"] == 0], block[block["role"] == 1]
        cells = np.array([c[0] for c in m["cells"]], np.int64)
        order = cells.argsort(kind="stable")
        cells, nodes, sketches = cells[order], m["node"].to_numpy()[order], _sketches(m["sketch"])[order]
        asked = np.concatenate([*q["cells"], np.zeros(0, np.int64)]).astype(np.int64)
        who = np.repeat(np.arange(len(q)), [len(c) for c in q["cells"]]).astype(np.int64)
        theirs, names = _sketches(q["sketch"]), q["node"].to_numpy()
        low, high = np.searchsorted(cells, asked), np.searchsorted(cells, asked, "right")
        some = np.flatnonzero(high > low)
        low, many, found, met = low[some], (high - low)[some], np.zeros(len(some), bool), np.zeros(len(m), bool)
        ends, at = many.cumsum(), 0
        while at < len(some):
            # As many of the asked cells as hold ``pairs`` pairs, one at least.
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + pairs, "right")))
            own = np.repeat(np.arange(at, to), many[at:to])
            member = np.arange(len(own)) - np.repeat(ends[at:to] - many[at:to] - (ends[at] - many[at]), many[at:to]) + low[own]
            asker = who[some[own]]
            near = np.bitwise_count(theirs[asker] ^ sketches[member]).sum(axis=1) <= bound
            near &= names[asker] != nodes[member]
            found[own[near]] = True
            met[member[near]] = True
            at = to
        rows = {
            "node": np.concatenate([names[who[some[found]]], nodes[met]]), "cell": np.concatenate([asked[some[found]], cells[met]]),
            "role": np.repeat([1, 0], [found.sum(), met.sum()]),
        }
        return pd.DataFrame(rows)

    return run


#: A node and a smaller one of its component, and its links; or, if ``pair`` is 1, two nodes and what each adds to the other's links.
_FOUND = ["node", "root", "links", "back", "pair"]


def _compared(width: int, threshold: float, bound: int):
    """Nodes with their links, and edges to smaller nodes of their components, of one block: members (role 0) among themselves and with the queries (role 1)."""

    def run(block: pd.DataFrame) -> pd.DataFrame:
        m, q = block[block["role"] == 0], block[block["role"] == 1]
        cell = int(block["cell"].iloc[0])
        if m.empty:
            return pd.DataFrame({c: [] for c in _FOUND}).astype("int64")
        x, nodes, w, sizes, sketches = _unit(m["vector"], width), m["node"].to_numpy(), m["w"].to_numpy(), m["size"].to_numpy(), _sketches(m["sketch"])
        visits = np.stack([np.asarray(v) for v in m["visits"]])
        label = dict(zip(nodes.tolist(), nodes.tolist(), strict=True))
        links = dict.fromkeys(label, 0)
        edges: set[tuple[int, int]] = set()

        pairs: list[tuple[int, int, int, int]] = []

        def near(y: np.ndarray, left: np.ndarray, left_w: np.ndarray, y_sizes: np.ndarray, y_sketches: np.ndarray) -> np.ndarray:
            """Links of other nodes (rows) with members (columns) whose sketches are alike, so that every cell where the two
            may meet has both. The few whose sketches are not alike go into ``pairs``, one by one."""
            hit = (y @ x.T >= threshold) & (y_sizes[:, None] == sizes)
            rows, cols = np.nonzero(hit)
            unlike = np.bitwise_count(y_sketches[rows] ^ sketches[cols]).sum(axis=1) > bound
            rows, cols = rows[unlike], cols[unlike]
            hit[rows, cols] = False
            for a, aw, b, bw in zip(left[rows].tolist(), left_w[rows].tolist(), nodes[cols].tolist(), w[cols].tolist(), strict=True):
                if a != b:
                    pairs.append((a, b, bw, aw) if a < b else (b, a, aw, bw))
            return hit

        def join(hit: np.ndarray, left: np.ndarray, left_w: np.ndarray) -> None:
            """``hit``: links of other nodes (rows) with members (columns)."""
            rows, cols = np.flatnonzero(hit.any(axis=1)), np.flatnonzero(hit.any(axis=0))
            if not len(rows):
                return
            hit = hit[np.ix_(rows, cols)]
            for n, c in zip(left[rows].tolist(), (hit @ w[cols]).tolist(), strict=True):
                links[n] = links.get(n, 0) + c
            for n, c in zip(nodes[cols].tolist(), (left_w[rows] @ hit).tolist(), strict=True):
                links[n] += c
            own = np.array([label.get(n, n) for n in left[rows].tolist()])
            theirs = np.array([label[n] for n in nodes[cols].tolist()])
            far = np.iinfo(np.int64).max
            while True:
                a = np.minimum(own, np.where(hit, theirs, far).min(axis=1))
                b = np.minimum(theirs, np.where(hit, a[:, None], far).min(axis=0))
                if (a == own).all() and (b == theirs).all():
                    break
                own, theirs = a, b
            for ids, now in ((left[rows].tolist(), own.tolist()), (nodes[cols].tolist(), theirs.tolist())):
                # The old label and the new one are in one component.
                edges.update((label.get(i, i), b) for i, b in zip(ids, now, strict=True))
                label.update(zip(ids, now, strict=True))

        if block["qslice"].iloc[0] == 0:
            for at in range(0, len(m), 512):
                part = slice(at, at + 512)
                hit = near(x[part], nodes[part], w[part], sizes[part], sketches[part])
                join(hit & (np.arange(len(m)) > np.arange(len(m))[part, None]), nodes[part], w[part])
        for at in range(0, len(q), 512):
            part = q[at : at + 512]
            home = part["home"].to_numpy()[:, None]
            hit = near(_unit(part["vector"], width), part["node"].to_numpy(), part["w"].to_numpy(), part["size"].to_numpy(), _sketches(part["sketch"]))
            back = np.array([(visits == h).any(axis=1) for h in home[:, 0]])
            # Counted here unless the pair is also met, and counted, in the query's own, larger cell.
            join(hit & ((home <= cell) | ~back), part["node"].to_numpy(), part["w"].to_numpy())
        rows = [(n, n, c, 0, 0) for n, c in links.items() if c] + [(a, b, 0, 0, 0) for a, b in edges if a != b]
        return pd.DataFrame(rows + [(a, b, c, d, 1) for a, b, c, d in set(pairs)], columns=_FOUND).astype("int64")

    return run


def near_components(df: DataFrame, threshold: float = 0.9, recall: float = 0.97, sample_rows: int = 20_000, most_codes: int = 1 << 16, block: int = 1024):
    """row, vec_id, n_links, component_id, kept for each row of ``df`` (vec_id, embedding)."""
    rows = written(vectors(df))
    usable = rows.filter("vector is not null")
    classes = written(usable.groupBy("size", "d1", "d2").agg(F.min("row").alias("node"), F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("w")))
    totals = classes.agg(F.count(F.lit(1)).alias("n"), F.max("size").alias("width")).first()
    n, width = totals["n"], totals["width"]
    if not n:
        return rows.select("row", "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    heads = usable.select(F.col("row").alias("node"), "size", "vector").join(small(classes.select("node", "w"), n), "node")
    codes = int(min(most_codes, max(4, 2 ** round(np.log2(max(n / 4, 1)) / 2))))
    share = min(1.0, max(sample_rows, 8 * codes) / n)
    sample = heads.filter(F.pmod(F.xxhash64("node", F.lit(11)), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).select("node", "vector").toPandas()
    sample = sample.sort_values("node")
    index = MultiIndex(_unit(sample["vector"], width), codes, threshold, recall)
    shared = df.sparkSession.sparkContext.broadcast(index)
    columns = len(index.books[1])

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 512):
                part = batch[at : at + 512]
                x = _unit(part["vector"], width)
                cells = shared.value.traverse(x)
                yield part.assign(home=cells[:, 0], visits=list(cells), sketch=[y.tobytes() for y in shared.value.sketch(x)])

    placed = written(heads.mapInPandas(place, "node long, size int, vector binary, w long, home long, visits array<long>, sketch binary"))
    key = F.xxhash64("node")

    def slices(counted: DataFrame, by: str, name: str, rows: int) -> DataFrame:
        return counted.groupBy(by).agg(F.ceil(F.count(F.lit(1)) / rows).cast("int").alias(name))

    # Queries and members with a partner that may be near, by their sketches, in blocks of a row of the grid.
    line = lambda c: F.expr(f"{c} div {columns}")
    asks = placed.withColumn("line", F.explode(F.expr(f"array_distinct(transform(visits, v -> v div {columns}))")))
    asks = asks.select("node", "line", F.expr(f"filter(visits, v -> v div {columns} = line)").alias("cells"), "sketch")
    members = placed.select("node", line("home").alias("line"), F.array("home").alias("cells"), "sketch")
    sizes = written(slices(members, "line", "mslices", block).join(slices(asks, "line", "qslices", 4 * block), "line"))
    here, there = (x.join(small(sizes, columns), "line") for x in (members, asks))
    each = lambda n: F.explode(F.expr(f"sequence(0, {n} - 1)"))
    here = here.withColumn("mslice", F.pmod(key, "mslices").cast("int")).withColumn("qslice", each("qslices")).withColumn("role", F.lit(0))
    there = there.withColumn("qslice", F.pmod(F.shiftright(key, 20), "qslices").cast("int")).withColumn("mslice", each("mslices")).withColumn("role", F.lit(1))
    names = ["line", "mslice", "qslice", "role", "node", "cells", "sketch"]
    blocks = here.select(names).unionByName(there.select(names))
    near = written(per_group(blocks, ["line", "mslice", "qslice"], _plausible(index.bound), "node long, cell long, role int").distinct())

    # Their vectors, in blocks of a cell.
    inside = written(placed.join(near.filter("role = 0").select("node").distinct(), "node", "left_semi").withColumn("cell", F.col("home")))
    outside = placed.join(near.filter("role = 1").select("node", "cell"), "node").filter("cell <> home")
    sizes = written(slices(inside, "cell", "mslices", block).join(slices(near.filter("role = 1"), "cell", "qslices", 4 * block), "cell"))
    columns = ["cell", "mslice", "qslice", "role", "node", "w", "size", "home", "vector", "visits", "sketch"]
    own = inside.join(sizes, "cell").withColumn("mslice", F.pmod(key, "mslices").cast("int"))
    members = own.withColumn("qslice", each("qslices")).withColumn("role", F.lit(0))
    across = own.filter("mslice > 0").withColumn("mslice", each("mslice"))
    others = outside.join(sizes, "cell").withColumn("mslice", each("mslices"))
    queries = across.select(others.columns).unionByName(others).withColumn("qslice", F.pmod(F.shiftright(key, 20), "qslices").cast("int"))
    queries = queries.withColumn("role", F.lit(1)).withColumn("visits", F.lit(None).cast("array<long>"))
    blocks = members.select(columns).unionByName(queries.select(columns))
    found = written(per_group(blocks, ["cell", "mslice", "qslice"], _compared(width, threshold, index.bound), ", ".join(f"{c} long" for c in _FOUND)))
    # Pairs whose sketches are not alike may be seen in two cells.
    single = found.filter("pair = 1").distinct()
    both = single.select("node", "root", "links").unionByName(single.select(F.col("root").alias("node"), F.col("node").alias("root"), F.col("back").alias("links")))
    found = found.filter("pair = 0").select("node", "root", "links").unionByName(both)

    linked = components(found.select(F.col("node").alias("u"), F.col("root").alias("v")))
    labels = written(classes.join(linked, "node", "left").withColumn("component", F.coalesce("component", "node")))
    least = labels.groupBy("component").agg(F.min("first").alias("component_id"))
    degree = found.groupBy("node").agg(F.sum("links").alias("links"))
    named = written(
        labels.join(degree, "node", "left").withColumn("n_links", F.coalesce("links", F.lit(0)) + F.col("w") - 1)
        .filter("n_links > 0").join(least, "component").select("size", "d1", "d2", "n_links", "component_id")
    )
    out = rows.join(small(named, named.count()), ["size", "d1", "d2"], "left")
    component = F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select(
        "row", "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.col("vec_id").eqNullSafe(component).alias("kept"),
    )


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    with scratch():
        return written(near_components(read(spark, sf_dir, "embeddings").select("vec_id", "embedding")).drop("row"), keep=True)
