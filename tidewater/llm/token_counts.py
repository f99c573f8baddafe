"""Token counts kept as delta-maintained rollups.

A batch is a table of signed facts (source, lang, tokenizer, docs, tokens): +1 and the count for an insert, -1 and minus
the count for a delete, and both for a revision. Its sums by source, language and tokenizer version are written as one
Parquet folder named after the batch below ``commits/``; Spark's committer shows the folder's _SUCCESS file only when all
of it is there. A batch whose _SUCCESS exists is not applied again, one without is overwritten, so a retried or repeated
batch counts once. Totals are sums over all committed batches; ``compact`` folds them into one.

Facts are summed by (source, lang, tokenizer) with partial sums on the map side, so a source with a third of all rows
costs a row per task.

Defined results: null text has 0 tokens; null source and lang are groups of their own; repeated rows count each time;
groups that come to 0 documents and 0 tokens stay in the totals; other columns are ignored.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import appended, owned, read, scratch, shared_folder, word_count, written

KEYS = ("source", "lang", "tokenizer")
FACTS = "source string, lang string, tokenizer string, docs long, tokens long"
#: The split pattern of the byte-level vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Where the vocabulary lies, unless the session's ``spark.tidewater.tokens.vocabulary`` says otherwise.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Between a letter and an ASCII character that is none, the pattern always ends a match, so counts add up across.
CUT = re.compile(r"(?<=[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f\u0400-\u0481\u048a-\u052f\u3041-\u3096\u4e00-\u9fa5\uac00-\ud7a3])(?=[\x00-@\[-`{-\x7f])")


def bpe_counter(spark: SparkSession, path: str | None = None) -> Callable[[], Callable[[str], int]]:
    """A factory of counters of byte-level BPE tokens. The vocabulary file is read on the driver, once, and broadcast."""
    with open(path or spark.conf.get("spark.tidewater.tokens.vocabulary", VOCABULARY), "rb") as f:
        shared = spark.sparkContext.broadcast(f.read())

    def make() -> Callable[[str], int]:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, shared.value.splitlines())}
        encoding = tiktoken.Encoding("bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        return lambda text: len(encoding.encode_ordinary(text))

    return make


def counted(docs: DataFrame, make: Callable[[], Callable[[str], int]], piece: int = 100_000) -> DataFrame:
    """``docs`` without its text, with ``tokens``.

    Long texts are counted in parts of ``piece`` characters or more, for bounded memory. They are cut only where the split
    pattern cuts, so counts are those of whole texts; a text without such a place is counted as one.
    """
    where = docs.columns.index("text")

    def parts(text: str) -> Iterator[str]:
        start = 0
        while len(text) - start > piece and (at := CUT.search(text, start + piece)):
            yield text[start : at.start()]
            start = at.start()
        yield text[start:]

    def per_task():
        count = make()
        return lambda batch: [pa.array([0 if t is None else sum(map(count, parts(t))) for t in batch.column(where).to_pylist()], pa.int64())]

    return appended(docs, per_task, "tokens long", drop=("text",))


class Rollup:
    """Additive totals below ``path``, a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def _exists(self, path: str) -> bool:
        target = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(target)

    def committed(self, batch: str) -> bool:
        return self._exists(f"{self.path}/commits/batch={batch}/_SUCCESS")

    def commit(self, batch: str, facts: DataFrame) -> bool:
        """Apply a batch of signed facts once; False if it was committed before."""
        if self.committed(batch):
            return False
        sums = facts.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        sums.write.mode("overwrite").parquet(f"{self.path}/commits/batch={batch}")
        return True

    def batches(self) -> DataFrame:
        if not self._exists(f"{self.path}/commits"):
            return self.spark.createDataFrame([], FACTS + ", batch string")
        return self.spark.read.schema(FACTS + ", batch string").parquet(f"{self.path}/commits")

    def totals(self) -> DataFrame:
        return self.batches().groupBy(*KEYS).agg(
            F.sum("docs").cast("long").alias("docs"), F.sum("tokens").cast("long").alias("tokens"), F.count_distinct("batch").alias("batches")
        )

    def compact(self, to: str) -> Rollup:
        """All batches as one in a new folder. The names of batches are not kept, so start it between runs of feeders."""
        new = Rollup(self.spark, to)
        new.commit("compacted", self.batches().select(*KEYS, "docs", "tokens"))
        return new


def inserts(rows: DataFrame, tokenizer: str, tokens: str = "tokens") -> DataFrame:
    return rows.select("source", "lang", F.lit(tokenizer).alias("tokenizer"), F.lit(1).cast("long").alias("docs"), F.col(tokens).alias("tokens"))


def deletes(rows: DataFrame, tokenizer: str, tokens: str = "tokens") -> DataFrame:
    return inserts(rows, tokenizer, tokens).withColumns({"docs": -F.col("docs"), "tokens": -F.col("tokens")})


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents are inserted with word counts, recounted by byte-level BPE in a batch that arrives twice, and their
    exact repetitions are deleted in a third. The totals are those of the distinct documents under BPE."""
    docs = read(spark, sf_dir, "documents").select(
        "doc_id", "text", "source", "lang", F.xxhash64("text").alias("hash"), F.coalesce(F.length("text"), F.lit(-1)).alias("chars"), word_count(F.col("text")).alias("words")
    )
    path = shared_folder(spark)
    owned(spark, path)
    with scratch():
        return _rollup(Rollup(spark, path), written(counted(docs, bpe_counter(spark)))).totals()


def _rollup(rollup: Rollup, rows: DataFrame) -> Rollup:
    rollup.commit("0-insert", inserts(rows, "words", "words"))
    for _ in range(2):
        rollup.commit("1-recount", deletes(rows, "words", "words").unionByName(inserts(rows, "byte_bpe_50k")))
    # A repetition is any row but the first of its text; counts are per (text, source, lang), so a hot text stays small.
    same = rows.groupBy("hash", "chars", "source", "lang").agg(
        F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("doc_id"), F.max("tokens").alias("tokens")
    )
    first = same.groupBy("hash", "chars").agg(F.min(F.struct("doc_id", "source", "lang")).alias("first"))
    extra = same.join(first, ["hash", "chars"]).withColumn(
        "n", F.col("n") - (F.struct("doc_id", "source", "lang").eqNullSafe(F.col("first"))).cast("long")
    )
    gone = extra.select(
        "source", "lang", F.lit("byte_bpe_50k").alias("tokenizer"), (-F.col("n")).alias("docs"), (-F.col("n") * F.col("tokens")).alias("tokens")
    )
    rollup.commit("2-repetitions", gone)
    return rollup
