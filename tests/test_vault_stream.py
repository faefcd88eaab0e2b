import os

import pytest
from pyspark.sql import functions as F

from cloakwork.streaming import vault as K

ENTRY = "array<struct<surrogate:string,original:string>>"


@pytest.fixture
def stored(spark):
    for k, v in K.PROVIDER.items():
        spark.conf.set(k, v)
    yield spark
    for k in K.PROVIDER:
        spark.conf.unset(k)


def at(seconds):
    return F.timestamp_seconds(F.lit(1_700_000_000) + seconds)


def test_reads_repeat_and_expire(stored, tmp_path):
    """Three batches: put and read, read again and put anew, read too late; a call without a put; rows of no call."""
    spark = stored
    entry = lambda x: [(f"[{x}]", x)]
    batches = [
        ([(1, entry("a"), 0), (1, entry("b"), 5), (2, entry("c"), 0), (None, entry("d"), 0), (3, [], 0)], [(1, 1, 3), (1, 2, 5), (1, 2, 5), (9, 3, 5), (None, 4, 5), (3, 5, 6)]),
        ([(2, entry("e"), 70)], [(1, 6, 60), (2, 7, 60), (2, 8, 80)]),
        ([], [(1, 9, 300), (2, 10, 301)]),
    ]
    puts_at, asked_at = f"{tmp_path}/puts", f"{tmp_path}/asked"
    for p in (puts_at, asked_at):
        os.makedirs(p)
    puts = spark.readStream.schema(f"call_id bigint, entries {ENTRY}, put_ts timestamp").parquet(puts_at)
    asked = spark.readStream.schema("call_id bigint, n int, ts timestamp").parquet(asked_at)
    for p, a in batches:
        spark.createDataFrame(p, f"call_id bigint, entries {ENTRY}, t int").select("call_id", "entries", at(F.col("t")).alias("put_ts")).write.mode("append").parquet(puts_at)
        spark.createDataFrame(a, "call_id bigint, n int, t int").select("call_id", "n", at(F.col("t")).alias("ts")).write.mode("append").parquet(asked_at)
        q = K.restore_stream(asked, puts).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/progress").trigger(availableNow=True).start()
        assert q.awaitTermination(120)
    got = sorted((r.n, r.entries[0].original if r.entries else None) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == [(1, "a"), (2, "b"), (2, "b"), (3, None), (4, None), (5, None), (6, "b"), (7, "c"), (8, "e"), (9, None), (10, None)]
