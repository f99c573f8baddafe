"""Substring dedup: words covered by a window of ``window`` words that starts earlier elsewhere are removed.

Equal windows meet in one shard, whatever documents they stand in, because shards are chosen by content:

- A window's anchor is the least hash of the ``gram``-word runs in it, the first on ties. Consecutive windows with the anchor
  in one place form a segment, the words that they cover together, and no two of them are equal. So a window that is repeated
  has an anchor of several segments, and only segments of repeated anchors go on.
- Copies of a segment are counted by (anchor, digest) before anything is dealt out: the earliest stands for all, and in the
  others every window is repeated. So a passage or text with millions of copies is one row.
- The distinct segments of an anchor go to one shard, in bounded numbers of words. A shard builds a compressed FM-index of its segments in document
  order and streams them through it: backward search over the wavelet matrix gives the matching statistics, and every
  match as long as the window an interval of suffixes, whose first place says whether the window starts earlier.
- An anchor with more distinct segments than a shard takes (a common phrase in ever other surroundings) is dealt out window
  by window instead, by the window's hash of 128 bits, and the earliest of each is found by a minimum; nothing is left out.
- Each document gets its repeated windows back, and the words that they cover go.

Windows are judged on the input. Documents are in the order of doc_id, null last, then of a hash of their text; of rows that
agree in both the first is kept like a document, and in the others all windows are repeated.

Defined results: null, empty or blank texts have no words; with fewer than ``window`` words nothing is removed; an empty
table gives no rows; a very long text is one row in one task, worked on in pieces; other columns are ignored. Words are
compared by hashes of 64 bits, segments by 112 and their length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import BROADCAST_BYTES, arrow_rows, per_group, read, scratch, sliced, written
from .fm_index import FMIndex
from .jaccard_join import _HASH, _M1, _M3, Shingler, _mix

WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: A document, in document order: doc_id is null, doc_id or 0, hash of doc_id and text.
DOC = ["none", "id", "h"]
_DOC = "none boolean, id long, h long"
#: Windows of a text that are cut into segments at once.
PIECE = 1 << 15


class Cutter(Shingler):
    """Words of a text and its segments."""

    def __init__(self, window: int, gram: int) -> None:
        super().__init__(gram, folded=False)
        self.window = window

    def _running(self, ids: np.ndarray) -> np.ndarray:
        """Sums over words and powers, so that a run's hash is a difference."""
        if len(ids) > self.powers.shape[1]:
            self._words(b" " * len(ids))  # lets the powers grow
        sums = np.zeros(len(ids) + 1, np.uint64)
        np.cumsum(ids * self.powers[0, : len(ids)], out=sums[1:], dtype=np.uint64)
        return sums

    def _spans(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((sums[end] - sums[start]) * self.powers[1, start] + (end - start).astype(np.uint64) * _M3)

    def _least(self, sums: np.ndarray, first: int, last: int) -> np.ndarray:
        """48 bits of the least run of each window from ``first`` to ``last``, and its place; the first one on ties."""
        width = self.window - self.k + 1
        at = np.arange(first, last + width - 1)
        least = self._spans(sums, at, at + self.k) & ~np.uint64(0xFFFF) | (at - first).astype(np.uint64)
        wide = 1
        while wide * 2 <= width:
            least, wide = np.minimum(least[:-wide], least[wide:]), wide * 2
        return np.minimum(least[: last - first], least[width - wide :])

    def segments(self, text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Words; and of each segment the first word, the number of windows, the anchor and the digest."""
        ids = self.words(text)
        windows = len(ids) - self.window + 1
        if windows < 1:
            none = np.zeros(0, np.int64)
            return ids, none, none, none, none
        sums = self._running(ids)
        least = np.concatenate([self._least(sums, at, min(at + PIECE, windows)) for at in range(0, windows, PIECE)])
        start = np.flatnonzero(np.concatenate([[True], (least[1:] != least[:-1]) | (np.arange(1, windows) % PIECE == 0)]))
        n = np.diff(np.append(start, windows))
        digest = self._spans(sums, start, start + n + self.window - 1)
        return ids, start, n, (least[start] >> np.uint64(16)).astype(np.int64), digest.view(np.int64)

    def hashes(self, ids: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two hashes of each window that begins at ``start``."""
        again = _mix(ids * _M3 + _M1)
        return tuple(self._spans(self._running(x), start, start + self.window).view(np.int64) for x in (ids, again))


def _document() -> list[Column]:
    return [F.col("doc_id").isNull().alias("none"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).cast("long").alias("id"), F.expr(_HASH).alias("h")]


def _rows(batch: pa.RecordBatch, lengths: list[int]) -> list[pa.Array]:
    """The documents of a batch, each as often as it has rows."""
    at = pa.array(np.repeat(np.arange(batch.num_rows), lengths))
    return [batch.column(c).take(at) for c in DOC]


def _segments(docs: DataFrame, window: int, gram: int, known: np.ndarray | None = None) -> DataFrame:
    """none, id, h, start, n, anchor, digest of every segment, or of those whose anchor is among the sorted ``known``."""
    shared = None if known is None else docs.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = Cutter(window, gram)
        for batch in sliced(batches, 200):
            found = [cut.segments(t.as_py())[1:] for t in batch.column("text")]
            if shared is not None:
                some = [shared.value[np.minimum(np.searchsorted(shared.value, x[2]), len(shared.value) - 1)] == x[2] for x in found]
                found = [tuple(v[s] for v in x) for x, s in zip(found, some, strict=True)]
            start, n, anchor, digest = (np.concatenate(x) for x in zip(*found, strict=True))
            columns = [pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(anchor), pa.array(digest)]
            yield pa.RecordBatch.from_arrays([*_rows(batch, [len(x[0]) for x in found]), *columns], names=[*DOC, "start", "n", "anchor", "digest"])

    return docs.select(*_document(), "text").mapInArrow(run, f"{_DOC}, start int, n int, anchor long, digest long")


def _anchors(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """The anchor of every segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = Cutter(window, gram)
        for batch in sliced(batches, 200):
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([cut.segments(t.as_py())[3] for t in batch.column("text")]))], names=["anchor"])

    return docs.select("text").mapInArrow(run, "anchor long")


def _candidates(docs: DataFrame, window: int, gram: int, broadcast: int) -> DataFrame:
    """Segments whose anchor stands elsewhere too."""
    repeated = written(_anchors(docs, window, gram).groupBy("anchor").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("anchor"))
    count = repeated.count()
    if count * 8 > broadcast:
        return _segments(docs, window, gram).join(repeated, "anchor", "left_semi")
    # As Arrow arrays, so the driver holds little more than the numbers.
    known = np.sort(repeated.toArrow().column("anchor").to_numpy()) if count else np.array([-1])
    return _segments(docs, window, gram, known)


_FETCHED = f"{_DOC}, start int, n int, shard long, words binary, w1 long, w2 long"


def _fetched(docs: DataFrame, asked: DataFrame, window: int, gram: int) -> DataFrame:
    """Words of the asked segments; of those without a shard a row for each window, with its hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = Cutter(window, gram)
        for batch in sliced(batches, 200):
            out: list[tuple] = []
            for i in range(batch.num_rows):
                ids = cut.words(batch.column("text")[i].as_py())
                for a in batch.column("asked")[i].as_py():
                    if a["shard"] is None:
                        at = np.arange(a["start"], a["start"] + a["n"])
                        out += [(i, int(s), 1, None, None, int(x), int(y)) for s, x, y in zip(at, *cut.hashes(ids, at), strict=True)]
                    else:
                        out.append((i, a["start"], a["n"], a["shard"], ids[a["start"] : a["start"] + a["n"] + window - 1].tobytes(), None, None))
            if out:
                at, *columns = zip(*out, strict=True)
                kinds = (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.int64())
                whom = [batch.column(c).take(pa.array(at)) for c in DOC]
                yield pa.RecordBatch.from_arrays([*whom, *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=[*DOC, "start", "n", "shard", "words", "w1", "w2"])

    whom = docs.select(*_document(), "text").dropDuplicates(DOC) if _repeats(docs) else docs.select(*_document(), "text")
    return whom.join(asked, DOC).mapInArrow(run, _FETCHED)


def _repeats(docs: DataFrame) -> bool:
    return docs.select(*_document()).groupBy(*DOC).agg(F.count(F.lit(1)).alias("c")).filter("c > 1").limit(1).count() > 0


def _searched(window: int):
    """Which windows of a shard's segments start earlier, by matching statistics against the shard's index."""

    def run(shard: pd.DataFrame) -> pd.DataFrame:
        shard = shard.sort_values([*DOC, "start"], kind="stable")
        words = [np.frombuffer(w, np.uint64) for w in shard["words"]]
        lengths = np.array([len(w) for w in words])
        index = FMIndex(np.concatenate(words), lengths, window)
        text = index.text(np.concatenate(words), lengths)
        size, row = index.matching_statistics(text)
        # Windows whose interval holds an earlier place; segments are in document order.
        earlier = (size == window) & (index.places[row] < np.arange(len(text)))
        first = np.cumsum(lengths + 1) - lengths - 1
        n = shard["n"].to_numpy()
        of = np.repeat(np.arange(len(n)), n)
        place = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
        mask = np.bincount(of, weights=earlier[first[of] + place] * 2.0**place, minlength=len(n)).astype(np.int64)
        return shard[[*DOC, "start", "n"]].assign(mask=mask, kind=1)

    return run


_MARKS = f"{_DOC}, start int, n int, mask long, kind int"


def repeated_windows(docs: DataFrame, window: int = 20, gram: int = 6, shard_words: int = 400_000, broadcast: int = BROADCAST_BYTES) -> DataFrame:
    """none, id, h and marks (start, n, mask, kind) of each document with windows that may be repeated.

    Kind 0: a copy of a segment, all of whose ``n`` windows are repeated unless a mark of kind 1 has the same start; kind 1: those
    whose bit is set in ``mask``; kind 2: one repeated window.
    """
    found = written(_candidates(docs, window, gram, broadcast))
    first = F.min(F.struct(*DOC, "start", "n")).alias("first")
    distinct = written(found.groupBy("anchor", "digest").agg(first).select("anchor", "first.*"))
    sizes = written(distinct.groupBy("anchor").agg(F.count(F.lit(1)).alias("segments"), F.sum(F.col("n") + window - 1).alias("words")))
    total = sizes.filter("segments > 1").agg(F.coalesce(F.sum("words"), F.lit(0))).first()[0]
    shards = total // shard_words + 1
    # Nothing is to be searched for where an anchor has one distinct segment: its copies are all there is.
    shard = F.when(F.col("words") <= shard_words // 4, F.pmod(F.xxhash64("anchor"), F.lit(shards)))
    joined = distinct.join(sizes, "anchor").withColumn("shard", shard)
    asked = joined.filter("segments > 1").groupBy(*DOC).agg(F.collect_list(F.struct("start", "n", "shard")).alias("asked"))
    fetched = written(_fetched(docs, asked, window, gram))
    kind = lambda mask, kind: (mask.cast("long").alias("mask"), F.lit(kind).alias("kind"))
    searched = per_group(fetched.filter("shard is not null").select("shard", *DOC, "start", "n", "words"), ["shard"], _searched(window), _MARKS)
    alone = joined.filter("segments = 1 or shard is null").select(*DOC, "start", "n", *kind(F.lit(0), 1))
    single = fetched.filter("shard is null")
    firsts = single.groupBy("w1", "w2").agg(F.min(F.struct(*DOC, "start")).alias("first")).select("first.*")
    later = single.join(firsts, [*DOC, "start"], "left_anti").select(*DOC, "start", "n", *kind(F.lit(1), 2))
    marks = found.select(*DOC, "start", "n", *kind(F.lit(-1), 0)).unionByName(written(searched.unionByName(alone).unionByName(later)))
    return marks.groupBy(*DOC).agg(F.collect_list(F.struct("start", "n", "mask", "kind")).alias("marks"))


def _covered(words: int, marks: list[dict] | None, window: int) -> np.ndarray:
    """Which of a document's words go."""
    bad = np.zeros(max(words - window + 1, 0), bool)
    own = {m["start"] for m in marks or () if m["kind"] == 1}
    for m in marks or ():
        start, n, kind = m["start"], m["n"], m["kind"]
        if kind == 1:
            bad[start : start + n] = m["mask"] >> np.arange(n) & 1
    for m in marks or ():
        if m["kind"] == 2 or m["kind"] == 0 and m["start"] not in own:
            bad[m["start"] : m["start"] + m["n"]] = True
    edge = np.zeros(words + 1, np.int64)
    at = np.flatnonzero(bad)
    edge[at] += 1
    edge[at + window] -= 1
    return np.cumsum(edge[:-1]) > 0




def _cleaned(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 200):
            total, gone, kept = [], [], []
            for text, marks, again in zip(*(batch.column(c) for c in ("text", "marks", "again")), strict=True):
                words = WORD.findall(text.as_py() or "")
                every = again.as_py() and len(words) >= window
                out = np.ones(len(words), bool) if every else _covered(len(words), marks.as_py(), window)
                total.append(len(words))
                gone.append(int(out.sum()))
                kept.append(" ".join(words if not gone[-1] else [w for w, o in zip(words, out.tolist(), strict=True) if not o]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])

    return run


def without_repeats(docs: DataFrame, window: int = 20, **settings: int) -> DataFrame:
    """doc_id, n_words, n_removed and kept (the words that stay, joined by one space): one row per row of ``docs``."""
    marks = written(repeated_windows(docs, window, **settings))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *_document(), "text")
    once = F.lit(False).alias("again")
    if _repeats(docs):
        # One row of those that agree stands first; the others, which are as many less one, lose every window.
        times = written(rows.groupBy(*DOC).agg(F.count(F.lit(1)).alias("times")).filter("times > 1"))
        single = rows.join(times, DOC, "left_anti").select("*", once)
        several = rows.join(times.select(*DOC), DOC, "left_semi").dropDuplicates(DOC).join(times, DOC)
        rows = single.unionByName(several.select(*rows.columns, F.explode(F.transform(F.sequence(F.lit(1), "times"), lambda i: i > 1)).alias("again")))
    else:
        rows = rows.select("*", once)
    return rows.join(marks, DOC, "left").select("doc_id", "text", "marks", "again").mapInArrow(_cleaned(window), "doc_id long, n_words long, n_removed long, kept string")


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    with scratch(), arrow_rows(spark):
        found = without_repeats(read(spark, sf_dir, "documents"))
        return written(found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256")), keep=True)
