import os

from pyspark.sql import functions as F

from cloakwork.operators.storage import TableStore

SCHEMA = "k int, v string, put_ts timestamp"


def rows(spark, *listed):
    return spark.createDataFrame(list(listed), "k int, v string, t int").select("k", "v", F.timestamp_seconds("t").alias("put_ts"))


def held(df):
    return sorted((r.k, r.v) for r in df.collect())


def test_versions(spark, tmp_path):
    s = TableStore(spark, f"file://{tmp_path}/s", SCHEMA, ["k"])
    assert held(s.rows()) == []
    s.put(rows(spark, (1, "a", 1), (2, "b", 1)))
    s.put(rows(spark, (1, "c", 2), (3, "d", 0)))
    before = s.rows()
    s.compact()
    s.put(rows(spark, (2, "e", 5)))
    assert held(before) == [(1, "c"), (2, "b"), (3, "d")]  # a reader across compaction keeps its version
    assert held(s.rows()) == [(1, "c"), (2, "e"), (3, "d")] and len(s.version()[1]["folders"]) == 2
    s.compact()
    s.vacuum()
    assert held(s.rows()) == [(1, "c"), (2, "e"), (3, "d")] and len(os.listdir(tmp_path / "s" / "data")) == 1


def test_pop_takes_each_row_once(spark, tmp_path):
    s = TableStore(spark, f"file://{tmp_path}/s", SCHEMA, ["k"])
    s.put(rows(spark, (1, "a", 1), (2, "b", 1), (3, "c", 1)))
    asked = spark.createDataFrame([(1,), (3,), (3,), (9,)], "k int")
    commit, met = s._commit, []

    def raced(number, content):
        if not met:  # another writer is first
            met.append(number)
            TableStore.put(other, rows(spark, (3, "z", 7), (4, "d", 1)))
        return commit(number, content)

    other = TableStore(spark, f"file://{tmp_path}/s", SCHEMA, ["k"])
    s._commit = raced
    assert held(s.pop(asked)) == [(1, "a"), (3, "z")] and held(s.rows()) == [(2, "b"), (4, "d")]
    assert held(s.pop(asked)) == []


def test_a_batch_counts_once(spark, tmp_path):
    """A stream whose progress is lost runs its batches again; after compaction too, nothing changes."""
    source, s = f"{tmp_path}/in", TableStore(spark, f"file://{tmp_path}/s", SCHEMA, ["k"])
    for i in range(3):
        rows(spark, (i, "a", i), (7, f"v{i}", i)).coalesce(1).write.mode("append").parquet(source)

    def drain(progress):
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
        q = stream.writeStream.foreachBatch(s.sink("calls")).option("checkpointLocation", f"{tmp_path}/{progress}").trigger(availableNow=True).start()
        assert q.awaitTermination(120)

    drain("one")
    first = held(s.rows())
    assert len(first) == 4 and len(s.version()[1]["folders"]) == 3 and s.version()[1]["streams"] == {"calls": 2}
    drain("two")
    assert held(s.rows()) == first and len(s.version()[1]["folders"]) == 3
    s.compact()
    drain("three")
    assert held(s.rows()) == first and len(s.version()[1]["folders"]) == 1
    s.put(rows(spark, (7, "late", 99)), "other", 0)
    assert (7, "late") in held(s.rows())
