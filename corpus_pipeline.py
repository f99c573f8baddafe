"""A corpus pipeline of five stages: raw documents in, a deduplicated, decontaminated, redacted and weighted mix out.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept. ``run`` writes each stage's result as
Parquet to the shared folder of the session and reads it back, so that a lost executor costs at most one stage; what a
stage wrote for itself goes with it, and its predecessor's result too.

Results of every stage: all but the last return the columns of ``docs``, whatever their names, with null doc_ids and ids of
any size as they are. Null and empty texts have no letter, so the first stage drops them; on their own, the other stages
keep them, but the last, which takes no words of them. Of repeated rows the second stage keeps one. Ties go to the smallest doc_id. An
empty table gives an empty result, an empty benchmark drops nothing. The last stage replaces columns named ``taken`` and
``target``. A very long text is one row in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidewater.llm.common import forget, owned, read, scratch, shared_folder
from tidewater.llm.decontaminate import without_benchmark
from tidewater.llm.jaccard_join import without_near_copies
from tidewater.llm.language_id import of_stated_language
from tidewater.llm.mixing import mixed_documents
from tidewater.llm.pii import redact


#: Rows of whole texts that go to Python at once.
BATCH_ROWS = 1000


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters or surely of another language than stated go.

    The result is lazy and whole texts pass Python, so batches of Arrow stay at 1,000 rows at most from here on.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name))
    spark.conf.set(name, str(min(now, BATCH_ROWS) if now > 0 else BATCH_ROWS))
    return of_stated_language(docs)


def near_copies_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies stays: five-word shingles, Jaccard similarity of 0.8 or more."""
    return without_near_copies(docs, k=5, num=80, den=100)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return without_benchmark(docs, read(spark, sf_dir, "benchmark"))


def personal_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; n_chars is that of the new text."""
    clean = redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast("long"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix of sources takes, with the number of words it takes of each."""
    return mixed_documents(docs)


STAGES = [
    ("language_id", language_stage),
    ("jaccard_join", near_copies_stage),
    ("decontaminate", benchmark_stage),
    ("pii", personal_data_stage),
    ("mixing", mixing_stage),
]

#: Language identification is not expressible in SQL; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = read(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        path = shared_folder(spark)
        owned(spark, path)
        with scratch():
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            forget(spark, before)
        before = path
    return docs
