"""N-gram Jaccard join by a token-group matrix.

Documents with the same set of shingles form a class; only one row of each class is compared. The matrix says which of the
shingles that lead a set stand in which group of classes:

- Linked sets share at least ``SHARED`` of their first n - ceil(threshold * n) + ``SHARED`` shingles in any fixed order. The
  order puts frequent shingles last, by a count-min sketch of one row over all documents (2**22 counters at most; their
  levels, a byte each, are broadcast). With T shingles in all, those in more than about 4 * sqrt(T / 2**22) documents more
  than chance explains stand last, so passages that very many documents share hardly ever lead, at any size.
- Classes that share leading shingles are put into groups, by the one that most classes share; a group beyond
  ``group_tokens`` is dealt into blocks, each of which also meets a few anchors of the whole. Each group stores the union
  of its members' shingles, and which of these each member has; its members are compared as it is built.
- The links found so far give first components. A query, which is a class, asks a group only if the leading shingles that it
  shares with the group's are enough, if it is not in one component with those members that have them, and if sizes and
  counts of shingles in 128 buckets allow a link. It is compared with the group's union; only if it shares enough of that,
  the group is opened and the query is verified against every member.

All this is exact. A family of near copies is one component after the first step, so its blocks never meet each other: work
is linear in it. With ``links`` every pair of linked classes is counted instead, whatever their components.

Tasks return only nodes and their local roots. Of a block, queries are worked on in slices.

Defined results: null, empty or blank texts have an empty set and link with nothing; fewer than ``k`` words make one
shingle; repeated rows are documents of their own; rows with a null doc_id take part and get the smallest doc_id of
their component (null if all are null); an empty table gives no rows; other columns, whatever their names, are ignored
here and kept by ``without_near_copies``. Shingles are 64-bit hashes. A very long text is one row in one task.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import appended, arrow_rows, per_group, read, scratch, sliced, written
from .components import components

_HASH = "xxhash64(cast(doc_id as long), text)"
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _M1
    x = (x ^ (x >> np.uint64(29))) * _M2
    return x ^ (x >> np.uint64(32))


class Shingler:
    """Sorted distinct hashes of a text's ``k``-word shingles; A-Z are lower-cased, words part at ASCII white space.

    A word's hash is a polynomial of its bytes, a difference of running sums, so a text costs a few array operations.
    Long texts are worked on in pieces of about ``piece`` bytes, cut at white space. Without ``folded`` words stay as they are.
    """

    BYTE = _mix(np.arange(1, 257, dtype=np.uint64) * _M3)
    SPACE = np.isin(np.arange(256), [0x20, 9, 10, 11, 12, 13])

    def __init__(self, k: int, piece: int = 1 << 20, folded: bool = True) -> None:
        self.k, self.piece, self.folded, self.powers = k, piece, folded, np.zeros((2, 0), np.uint64)

    def _words(self, raw: bytes) -> np.ndarray:
        a = np.frombuffer(raw, np.uint8)
        if len(a) > self.powers.shape[1]:
            n = max(len(a), 1 << 17)
            steps = [np.full(n, x, np.uint64) for x in (int(_M1), pow(int(_M1), -1, 1 << 64))]
            self.powers = np.stack([np.cumprod(np.concatenate([[np.uint64(1)], x]), dtype=np.uint64) for x in steps])
        space = np.ones(len(a) + 2, bool)
        space[1:-1] = self.SPACE[a]
        turns = np.flatnonzero(space[1:] != space[:-1])
        start, end = turns[::2], turns[1::2]
        sums = np.zeros(len(a) + 1, np.uint64)
        np.cumsum(self.BYTE[a] * self.powers[0, : len(a)], out=sums[1:], dtype=np.uint64)
        return _mix((sums[end] - sums[start]) * self.powers[1, start])

    def words(self, text: str | None) -> np.ndarray:
        raw = (text or "").encode("utf-8", "surrogatepass")
        raw = raw.lower() if self.folded else raw
        if len(raw) <= self.piece:
            return self._words(raw)
        found, at = [], 0
        while at < len(raw):
            cut = min(at + self.piece, len(raw))
            while cut < len(raw) and not self.SPACE[raw[cut]]:
                cut += 1
            found.append(self._words(raw[at:cut]))
            at = cut
        return np.concatenate(found)

    def __call__(self, text: str | None) -> np.ndarray:
        ids = self.words(text)
        if not len(ids):
            return ids
        width = min(self.k, len(ids))
        h = np.full(len(ids) - width + 1, width, np.uint64)
        for i in range(width):
            h = (h * _M3 + ids[i : len(ids) - width + 1 + i]) * _M1
            h ^= h >> np.uint64(29)
        h = np.sort(_mix(h))
        return h[np.concatenate([[True], h[1:] != h[:-1]])]


#: Leading shingles that linked sets share.
SHARED = 6


class Leading:
    """48 bits of the first n - ceil(num/den * n) + ``SHARED`` shingles of a set in the order of level, then hash."""

    def __init__(self, num: int, den: int, level: np.ndarray) -> None:
        self.num, self.den, self.level = num, den, level
        self.shift = np.uint64(64 - (len(level).bit_length() - 1))

    def __call__(self, tokens: np.ndarray) -> np.ndarray:
        n, least = len(tokens), -(-self.num * len(tokens) // self.den)
        own = self.level[(tokens >> self.shift).astype(np.int64)]
        # Fewer bits are less to shuffle; shingles that agree in them by chance only make a pair a candidate.
        return np.unique(tokens[own.argsort(kind="stable")[: n - least + min(SHARED, least)]] >> np.uint64(16)).view(np.int64)

    def need(self, n: int) -> int:
        """Leading shingles that a set of ``n`` shares with every set it links with; those may be smaller."""
        return SHARED if n * self.num**2 >= SHARED * self.den**2 else 1


BUCKETS = 128


def counts(tokens: np.ndarray) -> bytes | None:
    """Shingles in each bucket, a byte each; None, which is never refuted, if one holds more than 255."""
    c = np.bincount((tokens >> np.uint64(5)).astype(np.int64) & BUCKETS - 1, minlength=BUCKETS)
    return None if c.max() > 255 else c.astype(np.uint8).tobytes()


def bits_for(n_docs: int) -> int:
    return min(22, max(12, n_docs.bit_length() + 3))


def levels(docs: DataFrame, k: int, bits: int) -> np.ndarray:
    """Level of each counter of the sketch: in quarters of what chance explains, then by powers of two."""
    block = min(bits, 16)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, total = Shingler(k), np.zeros(1 << bits, np.uint32)
        for batch in sliced(batches):
            for text in batch.column("text"):
                at, n = np.unique(of(text.as_py()) >> np.uint64(64 - bits), return_counts=True)
                total[at.astype(np.int64)] += n.astype(np.uint32)
        parts = total.reshape(-1, 1 << block)
        packed = [zlib.compress(p.tobytes(), 1) for p in parts]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array(packed, pa.binary())], names=["block", "counts"])

    def add(key: tuple, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(1 << block, np.uint64)
        for batch in batches:
            for c in batch["counts"]:
                total += np.frombuffer(zlib.decompress(c), np.uint32)
        yield pd.DataFrame({"block": [key[0]], "counts": [total.tobytes()]})

    partial = docs.select("text").mapInArrow(count, "block int, counts binary")
    rows = partial.groupBy("block").applyInPandas(add, "block int, counts binary").collect()  # 2**bits counters
    total = np.zeros(1 << bits)
    for r in rows:
        total[r["block"] << block : r["block"] + 1 << block] = np.frombuffer(r["counts"], np.uint64)
    usual = np.median(total)
    z = (total - usual) / np.sqrt(usual + 1)
    return np.clip(np.where(z < 16, 64 + 4 * z, 128 + 8 * np.log2(np.maximum(z, 16) / 16)), 0, 255).astype(np.uint8)


def described(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """row, doc_id, h (finds the text again), n (size of the set), d1, d2 (its digest), need, tokens (those that lead), counts."""
    level = docs.sparkSession.sparkContext.broadcast(levels(docs, k, bits_for(docs.count())))

    def make():
        of, leading = Shingler(k), Leading(num, den, level.value)

        def run(batch: pa.RecordBatch) -> list[pa.Array]:
            n, d1, d2, need, tokens, most = [], [], [], [], [], []
            for text in batch.column("text"):
                found = of(text.as_py())
                digest = xxhash.xxh3_128_intdigest(found.tobytes())
                n.append(len(found))
                d1.append((digest >> 64) - (1 << 63))
                d2.append((digest & (1 << 64) - 1) - (1 << 63))
                need.append(leading.need(len(found)))
                tokens.append(leading(found))
                most.append(counts(found))
            long = pa.int64()
            return [pa.array(n, long), pa.array(d1, long), pa.array(d2, long), pa.array(need, pa.int32()), pa.array(tokens, pa.list_(long)), pa.array(most, pa.binary())]

        return run

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text", F.expr(_HASH).alias("h"))
    return appended(rows, make, "n long, d1 long, d2 long, need int, tokens array<long>, counts binary", drop=("text",))


def _possible(num: int, den: int):
    """Queries (role 1) and the groups of those members of a block (role 0) whose sizes and bucket counts allow a link with
    them, and that are in another component."""

    def run(block: pd.DataFrame) -> pd.DataFrame:
        n = block["n"].to_numpy()
        c = np.frombuffer(b"".join(x or b"\xff" * BUCKETS for x in block["counts"]), np.uint8).reshape(len(block), BUCKETS)
        unbounded, comp = block["counts"].isna().to_numpy(), block["comp"].to_numpy()
        own, asks = (np.flatnonzero(block["role"].to_numpy() == r) for r in (0, 1))
        node, group = block["node"].to_numpy(), block["group"].to_numpy()
        found = []
        for i in asks:
            shared = np.minimum(c[own], c[i]).sum(axis=1, dtype=np.int64)
            ok = (den * shared >= num * (n[own] + n[i] - shared)) | unbounded[own] | unbounded[i]
            ok &= (den * n[own] >= num * n[i]) & (den * n[i] >= num * n[own]) & (comp[own] != comp[i])
            found += [(node[i], g, n[i]) for g in np.unique(group[own[ok]])]
        return pd.DataFrame(found, columns=["node", "target", "n"]).astype("int64")

    return run


def _alike(num: int, den: int):
    """Members of a block that sizes and bucket counts allow a link with another one, or with a guest."""

    def run(block: pd.DataFrame) -> pd.DataFrame:
        n = block["n"].to_numpy()
        c = np.frombuffer(b"".join(x or b"\xff" * BUCKETS for x in block["counts"]), np.uint8).reshape(len(block), BUCKETS)
        unbounded = block["counts"].isna().to_numpy()
        found = np.zeros(len(block), bool)
        for i in range(len(block)):
            shared = np.minimum(c, c[i]).sum(axis=1, dtype=np.int64)
            ok = (den * shared >= num * (n + n[i] - shared)) | unbounded | unbounded[i]
            ok &= (den * n >= num * n[i]) & (den * n[i] >= num * n)
            found[i] = ok.sum() > 1
        return block.loc[found & ~block["guest"].to_numpy(bool), ["node", "group"]]

    return run


class _Links:
    """Roots of nodes, and, if wanted, numbers of links."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}
        self.links: dict[int, int] = {}

    def root(self, x: int) -> int:
        while self.parent.setdefault(x, x) != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def join(self, a: int, wa: int, b: int, wb: int) -> None:
        self.links[a] = self.links.get(a, 0) + wb
        self.links[b] = self.links.get(b, 0) + wa
        p, q = self.root(a), self.root(b)
        self.parent[max(p, q)] = min(p, q)

    def edges(self) -> list[tuple[int, int, int]]:
        return [(x, self.root(x), n) for x, n in self.links.items()]


class _Group:
    """A group's union and a matrix that says which of it each member has."""

    def __init__(self, num: int, den: int, union: np.ndarray, sizes: np.ndarray, places: np.ndarray, nodes: np.ndarray, weights: np.ndarray) -> None:
        self.num, self.den, self.union, self.sizes, self.nodes, self.weights = num, den, union, sizes, nodes, weights
        self.matrix = np.zeros((len(union), len(sizes)), np.uint8)
        self.matrix[places, np.repeat(np.arange(len(sizes)), sizes)] = 1

    def ask(self, node: int, weight: int, tokens: np.ndarray, links: _Links, first: int = 0) -> None:
        """Join ``node`` with the members from ``first`` on that it links with."""
        at = np.minimum(np.searchsorted(self.union, tokens), len(self.union) - 1)
        at = at[self.union[at] == tokens]
        # At most len(at) shingles are shared with any member, and a link needs num/den of the query's.
        if not len(at) or self.den * len(at) < self.num * len(tokens):
            return
        shared = self.matrix[at, first:].sum(axis=0, dtype=np.int64)
        enough = self.den * shared >= self.num * (len(tokens) + self.sizes[first:] - shared)
        for j in np.flatnonzero(enough) + first:
            links.join(node, weight, int(self.nodes[j]), int(self.weights[j]))


STORED = "group long, union binary, nodes array<long>, weights array<long>, sizes array<long>, places binary, edges array<struct<u:long,v:long,links:long>>"


def _stored(num: int, den: int):
    """A group as it is stored, and the links among its members and of these with its guests."""

    def run(block: pd.DataFrame) -> pd.DataFrame:
        own = block[~block["guest"].to_numpy(bool)]
        if own.empty:
            return pd.DataFrame({c.split()[0]: [] for c in ("group", "union", "nodes", "weights", "sizes", "places", "edges")})
        sets = [np.frombuffer(t, np.uint64) for t in own["tokens"]]
        sizes, nodes, weights = np.array([len(x) for x in sets]), own["node"].to_numpy(), own["w"].to_numpy()
        union, places = np.unique(np.concatenate(sets), return_inverse=True)
        group, links = _Group(num, den, union, sizes, places.ravel(), nodes, weights), _Links()
        for i in range(len(sets)):
            group.ask(int(nodes[i]), int(weights[i]), sets[i], links, i + 1)
        for node, w, t in block.loc[block["guest"].to_numpy(bool), ["node", "w", "tokens"]].itertuples(index=False):
            group.ask(int(node), int(w), np.frombuffer(t, np.uint64), links)
        edges = [{"u": u, "v": v, "links": n} for u, v, n in links.edges()]
        return pd.DataFrame({
            "group": [own["group"].iloc[0]], "union": [union.tobytes()], "nodes": [nodes], "weights": [weights], "sizes": [sizes],
            "places": [places.astype(np.int32).tobytes()], "edges": [edges],
        })

    return run


def _opened(num: int, den: int):
    """Links of the queries of a slice with the members of the group stored in its one row of role 0."""

    def run(block: pd.DataFrame) -> pd.DataFrame:
        kept, links = block[block["role"] == 0].iloc[0], _Links()
        union, sizes, nodes, weights = np.frombuffer(kept["tokens"], np.uint64), *(np.asarray(kept[c]) for c in ("sizes", "nodes", "weights"))
        # A group of one is not stored: its union is its only member.
        places = np.arange(len(union)) if kept["places"] is None else np.frombuffer(kept["places"], np.int32)
        group = _Group(num, den, union, sizes, places, nodes, weights)
        for node, w, t in block.loc[block["role"] == 1, ["node", "w", "tokens"]].itertuples(index=False):
            group.ask(int(node), int(w), np.frombuffer(t, np.uint64), links)
        return pd.DataFrame(links.edges(), columns=["u", "v", "links"]).astype("int64")

    return run


#: Bits of the bitmap that finds documents again: 4 MB, whatever the corpus; with more documents it lets more pass.
BITMAP = 25


def _bitmap(df: DataFrame, column: str) -> np.ndarray:
    """Bytes in which the bit of each value's lowest ``BITMAP`` bits is set. 1024 rows of 4 kB reach the driver at most."""
    at = F.col(column).bitwiseAND(F.lit((1 << BITMAP) - 1))
    rows = df.groupBy(F.shiftright(at, 15).alias("block")).agg(F.bitmap_construct_agg(at.bitwiseAND(F.lit(32767))).alias("bits")).collect()
    out = np.zeros(1 << BITMAP - 3, np.uint8)
    for r in rows:
        out[r["block"] * 4096 : r["block"] * 4096 + 4096] = np.frombuffer(r["bits"], np.uint8)
    return out


def _sets(docs: DataFrame, chosen: DataFrame, k: int, repeated: bool) -> DataFrame:
    """``chosen`` (h and other columns) with ``tokens``, all shingles of its text again; no text is shuffled."""
    chosen = written(chosen)
    known = docs.sparkSession.sparkContext.broadcast(_bitmap(chosen, "h"))

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Shingler(k)
        for batch in sliced(batches):
            at = batch.column("h").to_numpy() & (1 << BITMAP) - 1
            some = np.flatnonzero(known.value[at >> 3] >> (at & 7).astype(np.uint8) & 1)
            if len(some):
                tokens = [of(batch.column("text")[i].as_py()).tobytes() for i in some.tolist()]
                yield pa.RecordBatch.from_arrays([batch.column("h").take(pa.array(some)), pa.array(tokens, pa.binary())], names=["h", "tokens"])

    found = docs.select(F.expr(_HASH).alias("h"), "text").mapInArrow(again, "h long, tokens binary").join(chosen, "h").drop("h")
    # Rows that repeat in doc_id and text would bring their class again.
    return written(found.dropDuplicates(["node"]) if repeated else found)


def _groups(heads: DataFrame, met: DataFrame, group_tokens: int) -> tuple[DataFrame, DataFrame]:
    """(node, n, w, need, h, counts, group of every class that shares as many leading shingles as a link needs; node, group
    of the anchors that visit other blocks)."""
    keys = met.groupBy("node").agg(F.max(F.struct("times", "token"))["token"].alias("key"), F.count(F.lit(1)).alias("c"))
    keyed = written(heads.select("node", "n", "w", "need", "h", "counts").join(keys, "node").filter("c >= need").drop("c"))
    tries = [F.min(F.struct(F.xxhash64("node", F.lit(i)).alias("x"), "node"))["node"] for i in range(8)]
    load = keyed.groupBy("key").agg(F.sum("n").alias("tokens"), F.count(F.lit(1)).alias("members"), F.array_distinct(F.array(*tries)).alias("anchors"))
    blocks = F.ceil(F.greatest(F.col("tokens") / group_tokens, F.col("members") / 512)).cast("long")
    dealt = written(load.select("key", blocks.alias("blocks"), "anchors").filter("blocks > 1"))
    home = lambda node: F.pmod(F.xxhash64(node), F.coalesce("blocks", F.lit(1)).cast("long"))
    grouped = keyed.join(dealt.drop("anchors"), "key", "left").withColumn("group", F.xxhash64("key", home("node"))).drop("key", "blocks")
    sent = dealt.select("key", "blocks", F.explode("anchors").alias("node")).withColumn("block", F.explode(F.expr("sequence(0L, blocks - 1)")))
    return written(grouped), sent.filter(F.col("block") != home("node")).select("node", F.xxhash64("key", "block").alias("group"))


def _asked(met: DataFrame, grouped: DataFrame, comp: DataFrame | None, num: int, den: int, slice_queries: int = 4096) -> DataFrame:
    """node, target, n: queries and the groups that they ask.

    Queries ask blocks first, the ones where enough of their leading shingles stand; which of a block's groups they ask, its
    members' sizes and bucket counts say. Of two blocks the one with fewer shingles asks. With components, only classes of
    different ones meet, and the smaller component asks: the largest of a leading shingle is only asked, and one whose classes
    are all in one is done with.
    """
    nodes = grouped.select("node", "block", "group", "n", "need", "counts")
    if comp is None:
        sums = grouped.groupBy("block").agg(F.sum("n").alias("t"))
        nodes = nodes.join(sums, "block").withColumns({"comp": F.col("node"), "c": F.struct("t", "block")}).drop("t")
    else:
        nodes = nodes.join(comp.join(comp.groupBy("comp").agg(F.count(F.lit(1)).alias("nodes")), "comp"), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        nodes = nodes.withColumn("c", F.struct(F.coalesce("nodes", F.lit(1)).cast("long").alias("nodes"), "comp")).drop("nodes")
    nodes = written(nodes)
    every, queries = met.select("token", "node").join(nodes.select("node", "block", "c"), "node"), None
    if comp is not None:
        every = written(every)
        mixed = every.groupBy("token").agg(F.max("c").alias("top"), F.min("c").alias("low")).filter("low < top").select("token", "top")
        every = written(every.join(mixed, "token"))
        queries = every.filter("c < top").drop("top")
    # Shingles that stand in the same blocks are one set of blocks, so a class meets a set once, not once for each of them.
    blocks = written(every.groupBy("token", "block").agg(F.max("c").alias("c")))
    marks = [F.bit_xor(F.xxhash64("block", "c", F.lit(i))).alias(f"x{i}") for i in range(2)]
    alike = written(blocks.groupBy("token").agg(F.count(F.lit(1)).alias("k"), *marks))
    same = written(alike.groupBy("k", "x0", "x1").agg(F.min("token").alias("set")))
    of = alike.join(same, ["k", "x0", "x1"]).select("token", "set")
    members = blocks.join(same.select(F.col("set").alias("token")), "token").withColumnRenamed("token", "set")
    own = (queries or every).join(of, "token").groupBy("node", "block", "c", "set").agg(F.count(F.lit(1)).alias("times"))
    wanted = (F.col("q.block") != F.col("g.block")) & (F.col("q.c") < F.col("g.c"))
    pairs = own.alias("q").join(members.alias("g"), "set").filter(wanted).groupBy("q.node", F.col("g.block").alias("block")).agg(F.sum("times").alias("shared"))
    pairs = written(pairs).join(nodes.select("node", "n", "need", "counts", "comp"), "node").filter("shared >= need")
    sizes = grouped.groupBy("block").agg(F.min("n").alias("small"), F.max("n").alias("big"))
    pairs = written(pairs.join(sizes, "block").filter((den * F.col("big") >= num * F.col("n")) & (den * F.col("n") >= num * F.col("small"))))
    slices = written(pairs.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / slice_queries).cast("long").alias("slices")))
    columns = ["block", "slice", "role", "node", "n", "counts", "comp", "group"]
    asks = pairs.join(slices, "block").withColumns({"slice": F.pmod(F.xxhash64("node"), F.col("slices")), "role": F.lit(1), "group": F.lit(0).cast("long")})
    kept = nodes.join(slices, "block").withColumns({"slice": F.explode(F.expr("sequence(0L, slices - 1)")), "role": F.lit(0)})
    return written(per_group(asks.select(columns).unionByName(kept.select(columns)), ["block", "slice"], _possible(num, den), "node long, target long, n long"))


def _labelled(edges: DataFrame) -> DataFrame:
    """node, comp: a node that is surely in one component with it, the same one for nodes whose blocks share an anchor.

    Three times each node takes the least label of those it has an edge with; that is no whole component, and need not be.
    """
    both = edges.select("u", "v").union(edges.select("v", "u")).distinct()
    labels = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("comp"))
    for _ in range(2):
        near = both.join(labels, both.v == labels.node).groupBy("u").agg(F.min("comp").alias("m"))
        labels = labels.join(near, F.col("node") == F.col("u")).select("node", F.least("comp", "m").alias("comp"))
    return labels


def jaccard_components(
    docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, group_tokens: int = 32_768, slice_tokens: int = 262_144, links: bool = False
) -> DataFrame:
    """row, doc_id, h, n_shingles, component_id for each row of ``docs``, and component, a number of its component (null
    without links); with ``links`` also n_links (other documents linked directly).

    ``h`` is a hash of doc_id and text that finds a row's text again. Two documents link when den * shared >= num * union
    of their distinct ``k``-word shingles. ``group_tokens`` and ``slice_tokens`` bound a block's members and queries.
    """
    rows = written(described(docs, k, num, den))
    classes = written(
        rows.filter("n > 0").groupBy("d1", "d2", "n").agg(F.min("row").alias("node"), F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("w"))
    )
    # All rows but the copies. Spark broadcasts a side that it knows to be small; nothing here turns on a count.
    copies = written(
        rows.filter("n > 0").select("d1", "d2", "n", "row").join(classes.filter("w > 1").select("d1", "d2", "n", "node"), ["d1", "d2", "n"]).filter("row <> node").select("row")
    )
    heads = rows.filter("n > 0").join(copies, "row", "left_anti").withColumnRenamed("row", "node")

    # Leading shingles that at least two classes share.
    every = heads.select("node", F.explode("tokens").alias("token"))
    shared = written(every.groupBy("token").agg(F.count(F.lit(1)).alias("times")).filter("times > 1"))
    met = written(every.join(shared, "token"))
    grouped, guests = _groups(heads.join(classes.select("node", "w"), "node"), met, group_tokens)
    repeated = rows.groupBy("h").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").limit(1).count() > 0
    # Members that no other of their block can link with become groups of one.
    whole = grouped.groupBy("group").agg(F.count(F.lit(1)).alias("members")).filter("members > 1").select("group")
    blocks = grouped.select("node", "n", "counts", "group").join(written(whole), "group", "left_semi").withColumn("guest", F.lit(False))
    away = guests.join(grouped.select("node", "n", "counts"), "node").select("node", "n", "counts", "group", F.lit(True).alias("guest"))
    alike = written(per_group(blocks.select(away.columns).unionByName(away), ["group"], _alike(num, den), "node long, group long"))
    grouped = grouped.withColumnRenamed("group", "block").join(alike, "node", "left").withColumn("group", F.coalesce("group", F.xxhash64("node", F.lit("alone"))))
    grouped = written(grouped)

    # Groups of several: stored and compared within.
    several = written(grouped.groupBy("group").agg(F.count(F.lit(1)).alias("members")).filter("members > 1").select("group"))
    among = grouped.select("h", "node", "w", "group").join(several, "group", "left_semi")
    sets = _sets(docs, among, k, repeated)
    blocks = sets.withColumn("guest", F.lit(False))
    if not links:
        visits = sets.drop("group").join(guests, "node").join(several, "group", "left_semi")
        blocks = blocks.unionByName(visits.withColumn("guest", F.lit(True)))
    stored = written(per_group(blocks, ["group"], _stored(num, den), STORED, rows=50))
    edges = stored.select(F.explode("edges").alias("e")).select("e.*")

    # Queries of other groups.
    comp = None if links else written(_labelled(edges.select("u", "v")))
    asked = _asked(met, grouped, comp, num, den)
    slices = asked.groupBy("target").agg(F.ceil(F.sum("n") / slice_tokens).cast("long").alias("slices"))
    chosen = asked.select("node").union(slices.join(several.withColumnRenamed("group", "target"), "target", "left_anti").join(
        grouped.select(F.col("group").alias("target"), "node"), "target").select("node")).distinct()
    sets = _sets(docs, grouped.join(chosen, "node", "left_semi").select("h", "node", "w", "group"), k, repeated)
    single = sets.withColumnRenamed("group", "target").join(several.withColumnRenamed("group", "target"), "target", "left_anti").select(
        "target", "tokens", F.array("node").alias("nodes"), F.array("w").alias("weights"), F.array((F.length("tokens") / 8).cast("long")).alias("sizes"), F.lit(None).cast("binary").alias("places"),
    )
    kept = stored.select(F.col("group").alias("target"), F.col("union").alias("tokens"), "nodes", "weights", "sizes", "places").unionByName(single)
    kept = kept.join(slices, "target").withColumn("slice", F.explode(F.expr("sequence(0L, slices - 1)"))).withColumns({"role": F.lit(0), "node": F.lit(0).cast("long"), "w": F.lit(0).cast("long")})
    queries = asked.select("node", "target").join(sets.drop("group"), "node").join(slices, "target").withColumn("slice", F.pmod(F.xxhash64("node"), F.col("slices")))
    nothing = {"nodes": F.lit(None).cast("array<long>"), "weights": F.lit(None).cast("array<long>"), "sizes": F.lit(None).cast("array<long>"), "places": F.lit(None).cast("binary"), "role": F.lit(1)}
    columns = ["target", "slice", "role", "node", "w", "tokens", "nodes", "weights", "sizes", "places"]
    blocks = kept.select(columns).unionByName(queries.withColumns(nothing).select(columns))
    found = written(per_group(blocks, ["target", "slice"], _opened(num, den), "u long, v long, links long").unionByName(edges))

    linked = written(components(found.select("u", "v")))
    of = classes.select("d1", "d2", "n", "node", "first", "w")
    labels = written(of.join(linked, "node", "left").filter("w > 1 or component is not null").withColumn("component", F.coalesce("component", "node")))
    least = labels.groupBy("component").agg(F.min("first").alias("component_id"))
    named = labels.join(least, "component").withColumn("n_links", F.col("w") - 1)
    if links:
        named = named.join(found.groupBy(F.col("u").alias("node")).agg(F.sum("links").alias("links")), "node", "left").withColumn("n_links", F.coalesce("links", F.lit(0)) + F.col("w") - 1)
    named = written(named.select("d1", "d2", "n", "component", "component_id", "n_links"))
    out = rows.join(named, ["d1", "d2", "n"], "left")
    degree = [F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")] if links else []
    return out.select(
        "row", "doc_id", "h", F.col("n").alias("n_shingles"), *degree,
        F.when(F.col("component").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), "component",
    )


def without_near_copies(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``docs`` with one row of each component, whatever the doc_ids are: one with the smallest doc_id (null only if all
    are); of rows that agree in doc_id and text any one."""
    with scratch(), arrow_rows(docs.sparkSession):
        linked = jaccard_components(docs, k, num, den).filter("component is not null")
        linked = written(linked.groupBy("component", "doc_id", "h").agg(F.count(F.lit(1)).alias("times"), F.min("row").alias("row")))
        first = linked.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row", "h")).alias("first"))
        kept = written(first.select(F.col("first.h").alias("h")))
        gone = written(linked.join(kept, "h", "left_anti").select("h"), keep=True)
        again = written(linked.filter("times > 1").join(kept, "h", "left_semi").select("h"), keep=True)
        repeats = again.limit(1).count() > 0
    # All columns under other names, so that theirs can't clash with the hash.
    plain = docs.select(F.expr(_HASH).alias("h"), *(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)))
    left = plain.join(gone, "h", "left_anti")
    if repeats:
        left = left.join(again, "h", "left_anti").unionByName(left.join(again, "h", "left_semi").dropDuplicates(["h"]))
    return left.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word 3-gram sets at a Jaccard similarity of 0.9."""
    with scratch(), arrow_rows(spark):
        found = jaccard_components(read(spark, sf_dir, "documents"), k=3, num=90, den=100)
        return written(found.select("doc_id", "n_shingles", "component_id"), keep=True)


OP5_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(CASE WHEN len(ws) < 3 THEN ws ELSE ws[i:i + 2] END, ' ') AS g
      FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 90 * (na.n + nb.n - c)),
u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id, doc_id AS m FROM documents UNION SELECT u.b, r.m FROM r JOIN u ON u.a = r.doc_id),
m AS (SELECT doc_id, min(m) AS component_id FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)
"""
