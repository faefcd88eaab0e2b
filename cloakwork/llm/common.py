"""What the operators of this subpackage share: the shared folder, written tables, tokenisation columns, helpers for nulls."""

from __future__ import annotations

import re
import sys
import types
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakwork.session import shared_dir, spread, written

__all__ = ["ascii_lower", "commonest_length", "finite", "free_name", "shared_dir", "small_batches", "table", "table_schema", "text_key", "worker_cache", "written"]

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Bounds what a Python worker holds at once: batches of at most ``rows`` rows and 32 MB."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", 32 << 20)):
        now = int(re.sub(r"\D", "", spark.conf.get(key)) or 0)
        if not 0 < now <= most:
            spark.conf.set(key, str(most))


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else. Plain ASCII texts take the fast path of ``lower``; others are translated."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def free_name(df: DataFrame, name: str) -> str:
    """name, or with the first number behind it under which df has no column yet."""
    return next(x for x in (name, *(f"{name}_{i}" for i in range(1, len(df.columns) + 2))) if x not in df.columns)


def text_key(text: Column) -> Column:
    """64 bits that tell texts of one doc_id apart, null included."""
    return F.xxhash64(F.coalesce(text, F.lit("")), text.isNull())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def worker_cache(key: tuple, make: Callable):
    """What ``make`` gives, once for each Python process: tasks that reuse a worker find it again."""
    kept = sys.modules.setdefault("_cloakwork_worker", types.ModuleType("_cloakwork_worker")).__dict__
    if key not in kept:
        kept[key] = make()
    return kept[key]


def table_schema(df: DataFrame) -> str:
    """The columns of df as a schema string."""
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def finite(vector: Column) -> Column:
    """Whether a vector is there and none of its entries is null, infinite or no number."""
    return vector.isNotNull() & F.forall(vector, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False)))


def commonest_length(df: DataFrame, vector: str) -> int:
    """The length that most of the finite vectors have, the greatest of equally common ones; 0 if there is none."""
    lengths = df.where(finite(F.col(vector))).groupBy(F.size(vector).alias("d")).count()
    found = lengths.orderBy(F.desc("count"), F.desc("d")).first()
    return found.d if found else 0
