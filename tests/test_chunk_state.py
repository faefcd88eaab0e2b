"""Chunks as a list in keyed state: over batches, what the table gives."""

import os
import time

import pytest

from cloakwork.streaming import chunks as C
from cloakwork.streaming import gate as G
from cloakwork.streaming import vault as K


@pytest.fixture
def stored(spark):
    for k, v in K.PROVIDER.items():
        spark.conf.set(k, v)
    yield spark
    for k in K.PROVIDER:
        spark.conf.unset(k)


def run(spark, tmp_path, batches, **options):
    source = f"{tmp_path}/chunks"
    os.makedirs(source)
    stream = spark.readStream.schema(G.CHUNKS).parquet(source)
    for batch in batches:
        spark.createDataFrame(batch, G.CHUNKS).coalesce(1).write.mode("append").parquet(source)
        q = C.accumulate(stream, **options).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/progress").trigger(availableNow=True).start()
        assert q.awaitTermination(120)
    return sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").collect()), key=str)


def test_over_batches(stored, tmp_path):
    """Chunks in the wrong order within a batch, null and empty ones, a call behind its final chunk, and a call that comes once."""
    batches = [
        [("a", 1, "two ", False), ("a", 0, "one ", False), ("b", 0, None, False)],
        [("a", 2, "", False), ("b", 1, "é", False), ("c", 0, "all", True)],
        [("a", 3, "three", True), ("b", 2, "x" * 50_000, True), ("b", 3, "behind", False)],
    ]
    rows = [r for b in batches for r in b]
    table = G.accumulate(stored.createDataFrame(rows, G.CHUNKS)).select("call_id", "chunk_idx", "accumulated", "is_final")
    assert run(stored, tmp_path, batches, idle_seconds=None) == sorted(map(tuple, table.collect()), key=str)


def test_idle_calls_go(stored, tmp_path):
    """A call without a chunk for two seconds begins anew. Such a query doesn't end by itself, so it is watched and stopped."""
    source, out = f"{tmp_path}/chunks", f"{tmp_path}/out"
    os.makedirs(source)
    stream = stored.readStream.schema(G.CHUNKS).parquet(source)
    q = C.accumulate(stream, idle_seconds=2).writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{tmp_path}/progress").start()
    schema = "call_id string, chunk_idx int, accumulated string, is_final boolean"
    try:
        for n, row in enumerate([("a", 0, "one ", False), ("a", 1, "two", True)], 1):
            stored.createDataFrame([row], G.CHUNKS).coalesce(1).write.mode("append").parquet(source)
            until = time.time() + 60
            while time.time() < until and (not os.path.isdir(f"{out}/_spark_metadata") or stored.read.schema(schema).parquet(out).count() < n):
                time.sleep(0.5)
            time.sleep(6)
    finally:
        q.stop()
    assert sorted(map(tuple, stored.read.schema(schema).parquet(out).collect())) == [("a", 0, "one ", False), ("a", 1, "two", True)]
