"""Scores of detectors against labelled corpora, and the arithmetic of benchmarks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MIXES = ["regex", "gliner_pii", "privacy_filter", "regex,gliner_pii", "regex,gliner_pii,privacy_filter"]
TOKEN = r"\[([A-Z][A-Z0-9_]*)_([0-9A-F]{8,})\]"


def active_cases(cases: DataFrame, active: list[str]) -> DataFrame:
    """Cases all of whose required detectors are active."""
    return cases.where(F.size(F.array_except("requires", F.array(*[F.lit(d) for d in active]).cast("array<string>"))) == 0)


def scored(results: DataFrame) -> DataFrame:
    """Results of cases that were neither skipped nor blocked; only these count."""
    return results.where(~F.coalesce("skipped", F.lit(False)) & ~F.coalesce("blocked", F.lit(False)))


def types_in(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(1))


def score_cases(cases: DataFrame, output: str = "output") -> DataFrame:
    """A1 to A4 for each case (case_id, expect, must_keep and the text after anonymising): counts, in the row."""
    out, types = F.col(output), F.array_distinct(F.transform("expect", lambda e: e["type"]))
    gone = lambda e: ~F.contains(out, e["text"])
    many = lambda t: F.least(F.size(F.filter("expect", lambda e: e["type"] == t)), F.size(F.filter(types_in(out), lambda x: x == t)))
    size = lambda c: F.size(c).cast("bigint")
    return cases.select(
        "case_id",
        size(F.col("expect")).alias("expected"),
        size(F.filter("expect", gone)).alias("redacted"),
        size(F.filter("expect", lambda e: ~e["tolerated_miss"])).alias("strict_expected"),
        size(F.filter("expect", lambda e: ~e["tolerated_miss"] & gone(e))).alias("strict_redacted"),
        F.aggregate(types, F.lit(0).cast("bigint"), lambda a, t: a + many(t).cast("bigint")).alias("type_correct"),
        size(F.col("must_keep")).alias("must_keep"),
        size(F.filter("must_keep", lambda k: F.contains(out, k))).alias("kept"),
    )


def summary(scored: DataFrame, by: list[str] | None = None) -> DataFrame:
    """A1 to A4: ratios, null where there is nothing to count."""
    ratio = lambda a, b: F.round(F.try_divide(F.sum(a), F.sum(b)), 6)
    return scored.groupBy(*(by or [])).agg(
        ratio("redacted", "expected").alias("recall"),
        ratio("strict_redacted", "strict_expected").alias("strict_recall"),
        ratio("type_correct", "expected").alias("type_accuracy"),
        ratio("kept", "must_keep").alias("precision"),
    )


def cache_growth(turns: DataFrame, key: str = "conv_id") -> DataFrame:
    """Lookups, misses and hits of a pipeline cache over conversations whose turn t sends all texts so far.

    Turn t (from 1) looks up 2t - 1 texts, of which its own is new; restored answers are in the cache already.
    """
    n = turns.groupBy(key).agg(F.count("*").alias("turns"))
    return n.select(key, "turns", (F.col("turns") * F.col("turns")).alias("lookups"), F.col("turns").alias("misses"), (F.col("turns") * F.col("turns") - F.col("turns")).alias("hits"))


def history(turns: DataFrame, key: str = "conv_id", order: str = "turn", text: str = "text") -> DataFrame:
    """The texts that each turn sends."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return turns.withColumn("sent", F.collect_list(text).over(w))


def speedups(runs: DataFrame) -> DataFrame:
    """Median of repeats of each cell, and how many times faster it is than the same mix without a cache."""
    cell = runs.groupBy("mix", "overrides", "cache", "backend").agg(F.median("ms").alias("median_ms"), F.avg("ms").alias("mean_ms"))
    base = cell.where("cache = 'none'").select("mix", "overrides", F.col("median_ms").alias("base_ms"))
    return cell.join(base, ["mix", "overrides"]).select("mix", "overrides", "cache", "backend", F.round("median_ms", 6).alias("median_ms"), F.round("mean_ms", 6).alias("mean_ms"), F.round(F.col("base_ms") / F.col("median_ms"), 6).alias("speedup"))


def deltas(snapshots: DataFrame, by: str, order: str, columns: list[str]) -> DataFrame:
    """Differences to the snapshot before; the first counts from zero."""
    w = Window.partitionBy(by).orderBy(order)
    return snapshots.select(by, order, *[(F.col(c) - F.coalesce(F.lag(c).over(w), F.lit(0))).alias(c) for c in columns])


def bench_matrix(runs: DataFrame) -> DataFrame:
    """5 mixes, 2 override modes, and no cache or each of 3 caches on 2 backends, each cell with the number of its runs and their median.

    runs: mix, overrides, cache, backend, ms. Cells without runs are there too; runs outside of the matrix aren't.
    """
    spark = runs.sparkSession
    values = lambda column, rows: spark.createDataFrame([(r,) for r in rows], f"{column} string")
    cells = values("mix", MIXES).crossJoin(values("overrides", ["none", "varied"]))  # ten literal rows
    caches = spark.createDataFrame([("none", "memory"), *((c, b) for c in ("detector", "pipeline", "both") for b in ("memory", "redis"))], "cache string, backend string")
    keys = ["mix", "overrides", "cache", "backend"]
    seen = runs.groupBy(*keys).agg(F.count("*").alias("runs"), F.median("ms").alias("median_ms"))
    return cells.crossJoin(F.broadcast(caches)).join(seen, keys, "left").select(*keys, F.coalesce("runs", F.lit(0)).alias("runs"), F.round("median_ms", 6).alias("median_ms"))


def latency(calls: DataFrame) -> DataFrame:
    """A13, A5."""
    return calls.groupBy("mode", "service", "size").agg(
        F.count("*").alias("calls"), F.sum("ms").alias("total_ms"), F.round(F.avg("ms"), 6).alias("avg_ms"), F.min("ms").alias("min_ms"), F.max("ms").alias("max_ms"), F.count_if("ok").alias("n_ok"), F.count_if(~F.col("ok")).alias("n_err")
    )
