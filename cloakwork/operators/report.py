"""K5, L4: reports of benchmarks: rows sorted for reading, as JSON lines or as a Markdown table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_ROWS = 1000


def headline(speedups: DataFrame) -> DataFrame:
    """The fastest cells first, cells without a cache last among equals."""
    return speedups.orderBy(F.desc("speedup"), "mix", "overrides", F.col("cache") == "none", "cache", "backend")


def write_json(report: DataFrame, path: str) -> None:
    report.write.mode("overwrite").json(path)


def markdown(report: DataFrame, most: int = MOST_ROWS) -> str:
    """A table of at most ``most`` rows; a report is small by nature, and a larger one is refused, not cut."""
    rows = report.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows; write them with write_json")
    cell = lambda x: "" if x is None else str(x).replace("|", "\\|").replace("\n", " ")
    lines = ["| " + " | ".join(report.columns) + " |", "|" + "-|" * len(report.columns)]
    return "\n".join(lines + ["| " + " | ".join(cell(x) for x in r) + " |" for r in rows])
