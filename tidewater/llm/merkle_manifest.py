"""Merkle manifest of a dataset: authentication paths by fractal traversal, upper proofs by joins.

Every row is a leaf, every tree key (a source) a tree of ``ARITY`` children a node over its leaves in order, and the trees'
roots, in the order of their keys, are the leaves of the tree above. Digests are hex texts; a node is the hash of its
children's texts. The last run of a level may be short, and even one node becomes its hash, until one node remains.

- Leaves are numbered in two levels, within ranges of (key, order) and over one row per key and range.
- Aligned blocks of ``ARITY ** height`` leaves are the units of work. Their roots come first, by a stack of unfinished runs.
- Nodes above blocks are grouped level by level, a row per node, and each gets its upper proof from its parent's by joins.
- A block's paths are emitted leaf by leaf. At each height one *existing* subtree, the run of nodes that holds the present
  leaf's ancestor, is kept, and a *desired* one, the next run, which grows by two steps a leaf, so it is there when the
  present one is left. That is a few runs for each height, and the block's digests. The upper proof follows each path.

No tree, key or level is ever in one task; a key with a third of all rows is many blocks.

Defined results: null keys are one tree, which comes first; rows that agree in key and order stand in the order of their
digests, null first; repeated rows are leaves of their own, next to each other; an empty table gives no rows; all columns
pass, those that clash with the new ones (``proof``, ``subroot``, ``root``) are replaced.
"""

from __future__ import annotations

from collections.abc import Generator, Iterator
from hashlib import sha256
from itertools import islice, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F
from pyspark.sql.types import StructType

from tidewater.operators.windows import numbered

from .common import read, scratch, written

ARITY = 16
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
PROOF = "array<struct<left:string,right:string>>"


def leaf_digest(*columns: str | Column) -> Column:
    """Hash of the columns, each as its UTF-8 byte count, a colon and its value, or '-' if null."""
    values = [(F.col(c) if isinstance(c, str) else c).cast("string") for c in columns]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in values)), 256)


def fold(digest: Column, proof: Column) -> Column:
    """The root that a digest and the siblings of its path lead to."""
    return F.aggregate(proof, digest, lambda node, s: F.sha2(F.concat(s["left"], node, s["right"]), 256))


def siblings_digest(proof: Column) -> Column:
    """Hash of all siblings of a proof, from the leaf up, left to right."""
    return F.sha2(F.array_join(F.transform(proof, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def _node(children: list[str]) -> str:
    return sha256("".join(children).encode()).hexdigest()


def _grown(leaves: list[str], first: int, height: int) -> Generator[None, None, list[str]]:
    """The run of nodes at ``height`` whose leaves begin at ``first``; one leaf or node is dealt with a step."""
    stack: list[list[str]] = [[] for _ in range(height + 1)]
    for leaf in leaves[first : first + ARITY ** (height + 1)]:
        stack[0].append(leaf)
        yield
        for h in range(height):
            if len(stack[h]) < ARITY:
                break
            stack[h + 1].append(_node(stack[h]))
            stack[h].clear()
            yield
    for h in range(height):
        if stack[h]:
            stack[h + 1].append(_node(stack[h]))
            yield
    return stack[height]


def _finish(work: Generator[None, None, list[str]]) -> list[str]:
    while True:
        try:
            next(work)
        except StopIteration as end:
            return end.value


def block_root(leaves: list[str], height: int) -> str:
    return _finish(_grown(leaves, 0, height))[0]


class _Level:
    """The existing and the desired subtree of one height."""

    def __init__(self, leaves: list[str], height: int) -> None:
        self.leaves, self.height, self.span = leaves, height, ARITY ** (height + 1)
        self.existing, self.at = _finish(_grown(leaves, 0, height)), 0
        self._ask()

    def _ask(self) -> None:
        self.growing, self.desired = _grown(self.leaves, self.at + self.span, self.height), None

    def spend(self, steps: int) -> None:
        """Let the desired subtree grow."""
        for _ in range(steps):
            if self.desired is not None:
                return
            try:
                next(self.growing)
            except StopIteration as end:
                self.desired = end.value

    def enter(self, leaf: int) -> None:
        """At the first leaf of the next run, what was desired exists."""
        if leaf == self.at + self.span:
            self.existing = _finish(self.growing) if self.desired is None else self.desired
            self.at = leaf
            self._ask()


def paths(leaves: list[str], height: int) -> Iterator[list[tuple[str, str]]]:
    """For each leaf of a block the siblings of its path, (left, right) for each height below ``height``."""
    levels = [_Level(leaves, h) for h in range(height)]
    for i in range(len(leaves)):
        path = []
        for h, level in enumerate(levels):
            level.enter(i)
            own = i // ARITY**h % ARITY
            path.append(("".join(level.existing[:own]), "".join(level.existing[own + 1 :])))
            level.spend(2)
        yield path


def _positions(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """``rows`` with ``tree`` (number of the key in order), ``position`` from 0 in the tree, and ``size`` of the tree.

    Rows are sorted in ranges of the whole (key, order); counts of (key, range), no more than keys and ranges together, say
    what lies ahead. No window runs over rows.
    """
    cuts = max(8, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    by = [F.col(c).asc_nulls_first() for c in (key, *order)]
    ranged = written(rows.repartitionByRange(cuts, *by).sortWithinPartitions(*by).withColumn("__at", F.monotonically_increasing_id()))
    # The upper bits of the id are the partition's number, the lower ones the row's place in it.
    ranged = ranged.withColumn("__range", F.shiftright("__at", 33))
    counts = written(ranged.groupBy(key, "__range").agg(F.count(F.lit(1)).alias("__n"), F.min("__at").alias("__first")))
    trees = numbered(counts.select(key).distinct(), key, "tree")
    w = W.partitionBy("tree")
    ahead = F.coalesce(F.sum("__n").over(w.orderBy("__range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    counts = counts.alias("a").join(trees.alias("b"), F.col(f"a.{key}").eqNullSafe(F.col(f"b.{key}"))).select(
        F.col(f"a.{key}").alias("__key"), F.col("__range").alias("__r"), (ahead - F.col("__first")).alias("__shift"), "tree", F.sum("__n").over(w).alias("size")
    )
    found = ranged.join(written(counts), ranged[key].eqNullSafe(F.col("__key")) & (F.col("__range") == F.col("__r")))
    return found.select(*rows.columns, F.col("tree").cast("long").alias("tree"), (F.col("__at") + F.col("__shift")).alias("position"), "size")


def upper_proofs(nodes: DataFrame) -> DataFrame:
    """tree, position, upper (siblings from this node up), top (the root) for nodes (tree, position, size of the level, digest).

    Each level is grouped from the one below until every tree has come to one node; a run is one row of the next level.
    """
    levels = [written(nodes.select("tree", "position", "size", "digest"))]
    run = F.array_sort(F.collect_list(F.struct("position", "digest")))
    up = lambda c: F.ceil(F.col(c) / ARITY).cast("long")
    while levels[-1].filter("size > 1").limit(1).count():
        grouped = levels[-1].filter("size > 1").groupBy("tree", F.floor(F.col("position") / ARITY).cast("long").alias("position")).agg(run.alias("children"), F.max(up("size")).alias("size"))
        levels.append(written(grouped.withColumn("digest", F.sha2(F.array_join(F.col("children.digest"), ""), 256))))
    alone = lambda level: level.filter("size = 1").select("tree", "position", F.array().cast(PROOF).alias("upper"), F.col("digest").alias("top"))
    side = lambda keep: F.array_join(F.transform(F.filter("children", keep), lambda c: c["digest"]), "")
    own = F.col("child.position")
    step = F.struct(side(lambda c: c["position"] < own).alias("left"), side(lambda c: c["position"] > own).alias("right"))
    found = alone(levels[-1])
    for below, above in zip(levels[-2::-1], levels[:0:-1], strict=True):
        parents = above.select("tree", "position", "children").join(found, ["tree", "position"]).withColumn("child", F.explode("children"))
        found = written(parents.select("tree", own.alias("position"), F.concat(F.array(step), "upper").alias("upper"), "top").unionByName(alone(below)))
    return found


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All rows of a (tree, block) at once; partitions are sorted by them."""
    parts, last = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = np.stack([batch.column(c).to_numpy() for c in ("tree", "block")])
        cuts = [0, *(np.flatnonzero((ids[:, 1:] != ids[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
        for a, b in pairwise(cuts):
            if parts and tuple(ids[:, a]) != last:
                yield pa.concat_batches(parts)
                parts = []
            parts.append(batch.slice(a, b - a))
            last = tuple(ids[:, a])
    if parts:
        yield pa.concat_batches(parts)


def _roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block in _blocks(batches):
        root = block_root(block.column("digest").to_pylist(), block.column("height")[0].as_py())
        yield pa.RecordBatch.from_arrays([*(block.column(c).slice(0, 1) for c in ("tree", "block", "size")), pa.array([root])], names=["tree", "position", "size", "digest"])


def _emitted(columns: list[str], digest: str):
    """Rows of a block with their proofs; the block's first row, at position -1, has its upper proof."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            upper = [(s["left"], s["right"]) for s in block.column("upper")[0].as_py()]
            rows = block.slice(1)
            at, found = 0, paths(rows.column(digest).to_pylist(), rows.column("height")[0].as_py())
            while at < rows.num_rows:
                part = rows.slice(at, 256)
                steps = [[*path, *upper] for path in islice(found, part.num_rows)]
                flat = [s for path in steps for s in path]
                ends = np.cumsum([0, *map(len, steps)])
                pairs = pa.StructArray.from_arrays([pa.array([s[i] for s in flat], pa.string()) for i in (0, 1)], names=["left", "right"])
                same = [pa.repeat(block.column(c)[0], part.num_rows) for c in ("subroot", "root")]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in columns), part.column("tree"), part.column("position"), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs), *same],
                    names=[*columns, "tree", "position", "proof", "subroot", "root"],
                )
                at += part.num_rows

    return run


def manifest(leaves: DataFrame, key: str = "source", order: str = "doc_id", digest: str = "leaf", height: int = 3) -> DataFrame:
    """``leaves`` with tree, position, proof (siblings by height, up to the root of all), subroot and root."""
    kept = leaves.select([c for c in leaves.columns if c not in ("tree", "position", "proof", "subroot", "root")])
    # Own names for all columns, so that none clashes.
    names = {c: f"c{i}" for i, c in enumerate(kept.columns)}
    rows = written(kept.select(*(F.col(f"`{c}`").alias(n) for c, n in names.items())))
    placed = _positions(rows, names[key], [names[order], names[digest]])
    levels = sum(((F.col("size") > ARITY**h).cast("int") for h in range(height)), F.lit(0))
    placed = written(placed.withColumns({"block": F.floor(F.col("position") / ARITY**height).cast("long"), "height": levels}))
    blocks = F.ceil(F.col("size") / ARITY**height).cast("long").alias("size")
    dealt = placed.select("tree", "block", "position", "height", blocks, F.col(names[digest]).alias("digest")).repartition("tree", "block").sortWithinPartitions("tree", "block", "position")
    roots = written(dealt.mapInArrow(_roots, "tree long, position long, size long, digest string"))
    inner = upper_proofs(roots)
    trees = inner.filter("position = 0").select("tree", "top")
    above = upper_proofs(trees.select(F.lit(0).cast("long").alias("tree"), (F.col("tree") - 1).alias("position"), F.lit(trees.count()).cast("long").alias("size"), F.col("top").alias("digest")))
    above = above.select((F.col("position") + 1).alias("tree"), F.col("upper").alias("more"), F.col("top").alias("root"))
    proofs = inner.join(above, "tree").select("tree", F.col("position").alias("block"), F.lit(-1).cast("long").alias("position"), F.concat("upper", "more").alias("upper"), F.col("top").alias("subroot"), "root")
    both = placed.drop("size").unionByName(proofs, allowMissingColumns=True).repartition("tree", "block").sortWithinPartitions("tree", "block", "position")
    schema = StructType([*rows.schema.fields, *StructType.fromDDL(f"tree long, position long, proof {PROOF}, subroot string, root string").fields])
    found = both.mapInArrow(_emitted(rows.columns, names[digest]), schema)
    return found.withColumnsRenamed({n: c for c, n in names.items()})


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    with scratch():
        changed = leaf_digest("doc_id", "source", "lang", "n_chars", F.translate("text", UPPER, UPPER.lower()))
        struck = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
        leaves = docs.select("doc_id", "source", leaf_digest("doc_id", "source", "lang", "n_chars", "text").alias("leaf"), F.when(struck, changed).alias("tampered"))
        found = manifest(leaves).withColumn("folded_root", fold(F.coalesce("tampered", "leaf"), F.col("proof")))
        out = found.select("doc_id", "leaf", "subroot", "root", siblings_digest(F.col("proof")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
        return written(out, keep=True)


#: Unsigned CRC-32 of the decimal doc_id: a step for each bit of its bytes.
_CRC = "xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), lambda a, b: list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)))"


def _field(c: str) -> str:
    return f"coalesce(octet_length(encode({c}::VARCHAR))::VARCHAR || ':' || {c}::VARCHAR, '-')"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(_field(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


OP11_SQL = f"""
WITH RECURSIVE l AS (
  SELECT doc_id, source, {_leaf('text')} AS leaf,
         CASE WHEN {_CRC} % 5 = 0 THEN {_leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} ELSE {_leaf('text')} END AS shown
  FROM documents),
p AS (SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) AS tree, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS position FROM l),
t AS (
  SELECT tree, 0 AS h, position, leaf AS digest, count(*) OVER (PARTITION BY tree) AS size FROM p
  UNION ALL
  SELECT tree, max(h) + 1, position // 16, sha256(string_agg(digest, '' ORDER BY position)), max((size + 15) // 16) FROM t WHERE size > 1 GROUP BY tree, position // 16),
s AS (SELECT tree, digest AS subroot FROM t WHERE size = 1),
u AS (
  SELECT 0 AS h, tree - 1 AS position, subroot AS digest, count(*) OVER () AS size FROM s
  UNION ALL
  SELECT max(h) + 1, position // 16, sha256(string_agg(digest, '' ORDER BY position)), max((size + 15) // 16) FROM u WHERE size > 1 GROUP BY position // 16),
n AS (SELECT tree, h, position, digest, size FROM t WHERE size > 1),
i AS (
  SELECT a.tree, a.h, a.position, coalesce(string_agg(b.digest, '' ORDER BY b.position) FILTER (b.position < a.position), '') AS low, coalesce(string_agg(b.digest, '' ORDER BY b.position) FILTER (b.position > a.position), '') AS high
  FROM n a JOIN n b ON a.tree = b.tree AND a.h = b.h AND a.position // 16 = b.position // 16 GROUP BY ALL),
j AS (
  SELECT a.h, a.position, coalesce(string_agg(b.digest, '' ORDER BY b.position) FILTER (b.position < a.position), '') AS low, coalesce(string_agg(b.digest, '' ORDER BY b.position) FILTER (b.position > a.position), '') AS high
  FROM u a JOIN u b ON a.h = b.h AND a.position // 16 = b.position // 16 WHERE a.size > 1 GROUP BY ALL),
m AS (SELECT tree, max(h) + 1 AS levels FROM i GROUP BY tree),
q AS (
  SELECT p.tree, p.position, i.h, low, high FROM p JOIN i ON i.tree = p.tree AND i.position = p.position // (16::BIGINT ** i.h)::BIGINT
  UNION ALL
  SELECT p.tree, p.position, coalesce(levels, 0) + j.h, low, high FROM p LEFT JOIN m USING (tree) JOIN j ON j.position = (p.tree - 1) // (16::BIGINT ** j.h)::BIGINT),
f AS (
  SELECT tree, position, 0 AS h, shown AS digest FROM p
  UNION ALL
  SELECT f.tree, f.position, f.h + 1, sha256(low || digest || high) FROM f JOIN q ON q.tree = f.tree AND q.position = f.position AND q.h = f.h),
z AS (SELECT tree, position, arg_max(digest, h) AS folded_root FROM f GROUP BY ALL),
y AS (SELECT tree, position, sha256(string_agg(low || high, '' ORDER BY h)) AS proof_sha256 FROM q GROUP BY ALL)
SELECT doc_id, leaf, subroot, root, coalesce(proof_sha256, sha256('')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM p JOIN s USING (tree) CROSS JOIN (SELECT digest AS root FROM u WHERE size = 1) JOIN z USING (tree, position) LEFT JOIN y USING (tree, position)
"""
