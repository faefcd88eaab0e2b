"""Dealing out tables that their reader can't split."""

from pyspark.sql import functions as F

from cloakwork.session import spread


def shares(df):
    return [r["n"] for r in df.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]


def test_one_row_group_is_dealt_out(spark, tmp_path):
    """One file of one row group that is cut into several pieces of which one has all rows."""
    path = f"{tmp_path}/t"
    spark.range(4_000_000).select("id", F.rand(1).alias("x")).coalesce(1).write.option("parquet.block.size", 1 << 30).parquet(path)
    df = spark.read.parquet(path)
    cores = spark.sparkContext.defaultParallelism
    assert df.rdd.getNumPartitions() > 1 and len(shares(df)) == 1
    dealt = shares(spread(df))
    assert len(dealt) == cores and max(dealt) < 1.1 * 4_000_000 / cores


def test_many_files_are_left_alone(spark, tmp_path):
    path = f"{tmp_path}/t"
    spark.range(1000).repartition(8).write.parquet(path)
    df = spark.read.option("maxPartitionBytes", "1k").parquet(path)
    assert (spread(df) is df) == (2 * df.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism)
    assert spread(df).count() == 1000 and spread(spark.range(10)).count() == 10
