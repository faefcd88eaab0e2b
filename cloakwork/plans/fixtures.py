"""Inline inputs that Spark and DuckDB both read: rows of literals as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def quote(x: object) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, bool):
        return "true" if x else "false"
    if isinstance(x, (int, float)):
        return repr(x)
    return "'" + str(x).replace("'", "''") + "'"


def values(rows: list[tuple], columns: list[str]) -> str:
    """A DuckDB relation."""
    return "(VALUES " + ", ".join("(" + ", ".join(quote(x) for x in r) + ")" for r in rows) + ") AS v(" + ", ".join(columns) + ")"


def frame(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)
