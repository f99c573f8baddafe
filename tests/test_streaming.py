"""A stream of the event table gives what the batch gives for closed windows."""

from pyspark.sql import functions as F

from tidewater.plans import registry
from tidewater.streaming.bins import binned, sessions

SF = "/root/testdata/sf0.001"


def drained(df, name, mode="append"):
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    try:
        query.processAllAvailable()
        return {tuple(r) for r in df.sparkSession.table(name).collect()}
    finally:
        query.stop()


def test_stream_equals_batch(spark):
    batch = spark.read.parquet(f"{SF}/events.parquet")
    stream = spark.readStream.schema(batch.schema).option("pathGlobFilter", "events.parquet").parquet(SF)
    for name, of in (("bins", lambda df: binned(df, "user_id", "ts", "value")), ("visits", lambda df: sessions(df, "user_id", "ts"))):
        want = {tuple(r) for r in of(batch).collect()}
        got = drained(of(stream), name)
        assert got <= want and len(got) >= 0.9 * len(want)


def test_queries_equal_plain_windows(spark):
    n = registry.queries()["q_A24_streaming_bins"](spark, SF).agg(F.sum("n")).first()[0]
    assert n == spark.read.parquet(f"{SF}/events.parquet").count()
