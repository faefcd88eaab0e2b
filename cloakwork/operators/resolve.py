"""Deduplication with sources, unions over the texts of a call, and lookups of memoised results.

The array forms work inside a row (a text, or a whole call) and need no shuffle; the row forms group matches that already
are rows.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cloakwork.functions.arrays import let, record, runs
from cloakwork.model import ATTRIBUTED
from cloakwork.session import written


def tag(matches: Column, detector: str) -> Column:
    """Matches with their detector as only source."""
    return F.transform(matches, lambda m: F.struct(m["text"].alias("text"), m["entity_type"].alias("entity_type"), F.array(F.lit(detector)).alias("source_detectors"))).cast(ATTRIBUTED)


def dedup(attributed: Column) -> Column:
    """One entry for each text, in order of first appearance; its first type, and all its sources in order.

    Empty texts are dropped.
    """


    # Sorted by text and place, equal texts stand together; groups go back to the order of their first place.
    def grouped(v: Column) -> Column:
        return runs(v, lambda m, i: m["text"] != F.get(v, i - 1)["text"])

    def one(group: Column) -> Column:
        sources = F.array_distinct(F.flatten(F.transform(group, lambda m: m["source_detectors"])))
        return record(i=F.get(group, 0)["i"], text=F.get(group, 0)["text"], entity_type=F.get(group, 0)["entity_type"], source_detectors=sources)

    numbered = F.transform(F.filter(attributed, lambda m: m["text"] != ""), lambda m, i: record(text=m["text"], i=i, entity_type=m["entity_type"], source_detectors=m["source_detectors"]))
    first = F.sort_array(F.transform(let(F.sort_array(numbered), grouped), one))
    return F.transform(first, lambda m: record(text=m["text"], entity_type=m["entity_type"], source_detectors=m["source_detectors"])).cast(ATTRIBUTED)


def dedup_rows(matches: DataFrame, keys: list[str], order: list[str], text: str = "text", entity_type: str = "entity_type", detector: str = "detector") -> DataFrame:
    """R4, R5 on rows: for each key and text the type of the first row by ``order``, and the sources in that order.

    One shuffle; the partial aggregation keeps at most one row for each key, text and detector.
    """
    first = matches.where(F.col(text) != "").groupBy(*keys, text, detector).agg(F.min(F.struct(*order, F.col(entity_type).alias("__t"))).alias("__f"))
    return first.groupBy(*keys, text).agg(F.min("__f")["__t"].alias("entity_type"), F.transform(F.array_sort(F.collect_list(F.struct("__f", F.col(detector).alias("__d")))), lambda x: x["__d"]).alias("source_detectors"))


def active_detectors(wanted: Column, configured: list[str]) -> Column:
    """An override narrows the configured detectors, in its own order; if nothing is left, all are active."""
    mine = F.array(*[F.lit(d) for d in configured])
    kept = F.array_distinct(F.filter(wanted, lambda d: F.array_contains(mine, d)))
    return F.when(F.size(kept) > 0, kept).otherwise(mine)


def unknown_detectors(wanted: Column, configured: list[str]) -> Column:
    """J7."""
    return F.array_except(wanted, F.array(*[F.lit(d) for d in configured]))


def lookup_or_compute(wanted: DataFrame, cache: DataFrame, keys: list[str], compute) -> tuple[DataFrame, DataFrame]:
    """Results for every wanted row, and the rows to append to the cache.

    Each missing key is computed once, however often it is wanted: what is computed is written to the shared folder, and both
    results read it. Null keys are keys like others.
    """
    same = lambda other: reduce(and_, [F.col(f"w.{k}").eqNullSafe(F.col(f"{other}.{k}")) for k in keys])
    missing = wanted.select(*keys).distinct().alias("w").join(cache.alias("c"), same("c"), "left_anti")
    fresh = written(compute(missing), "computed")
    results = cache.unionByName(fresh)
    others = [F.col(f"r.{c}") for c in results.columns if c not in keys]
    return wanted.alias("w").join(results.alias("r"), same("r"), "left").select("w.*", *others), fresh


def first_rule(rows: DataFrame, by: list[str], order: str) -> DataFrame:
    """The first of the rules that fit each row."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*by).orderBy(order))).where("__n = 1").drop("__n")


def evict(cache: DataFrame, used: str, keep: int, by: list[str] | None = None) -> DataFrame:
    """L2: the ``keep`` most recently used rows, of all or of each group. Ties go by all columns, so the result is stable."""
    ties = [c for c in cache.columns if c != used]
    if by is None:
        return cache.orderBy(F.desc(used), *ties).limit(keep)  # a bounded heap in each task, not one sort
    w = Window.partitionBy(*by).orderBy(F.desc(used), *ties)
    return cache.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= keep).drop("__n")
