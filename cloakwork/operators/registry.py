"""Detectors as plug-ins: what one is, how it fails, and in which order they count."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakwork.functions import spans as S
from cloakwork.model import ATTRIBUTED, DETECTORS, MOST_LLM_CHARS
from cloakwork.operators import detect as D
from cloakwork.operators import resolve as R
from cloakwork.sources.rules import Literal, Rule


class Detector(Protocol):
    """an expression from a text to matches (text, entity_type)."""

    name: str

    def matches(self, text: Column) -> Column: ...


@dataclass(frozen=True)
class RuleDetector:
    rules: tuple[Rule, ...]
    strategy: str = "longest"
    name: str = "regex"

    def matches(self, text: Column) -> Column:
        return D.normalized(S.greedy(D.rule_candidates(text, list(self.rules)), self.strategy))


@dataclass(frozen=True)
class DenylistDetector:
    entries: tuple[Literal, ...]
    name: str = "denylist"

    def matches(self, text: Column) -> Column:
        return D.normalized(S.greedy(D.denylist_candidates(text, list(self.entries))))


@dataclass(frozen=True)
class RecordedDetector:
    """A detector whose results come with the rows: ``column`` maps a text's matches out of what was recorded."""

    name: str
    column: Callable[[Column], Column]

    def matches(self, text: Column) -> Column:
        return self.column(text)


@dataclass(frozen=True)
class DetectorSpec:
    """how a detector is treated. Detectors that can't be unavailable give no matches instead of blocking."""

    name: str
    can_be_unavailable: bool = False
    fail_closed: bool = True
    has_cache: bool = False
    at_once: int | None = None
    blocked_reason: str = ""

    def __post_init__(self) -> None:
        if self.name not in DETECTORS:
            raise ValueError(f"unknown detector {self.name!r}")
        if self.can_be_unavailable and not self.blocked_reason:
            raise ValueError(f"{self.name}: a detector that can be unavailable needs a reason to block with")


#: In order of priority.
REGISTRY = [
    DetectorSpec("regex"),
    DetectorSpec("denylist"),
    DetectorSpec("privacy_filter", True, True, True, 10, "privacy filter detector is unavailable; request blocked."),
    DetectorSpec("gliner_pii", True, True, True, 10, "zero-shot detector is unavailable; request blocked."),
    DetectorSpec("llm", True, True, True, 10, "LLM detector is unavailable; request blocked."),
]


def specs_frame(spark: SparkSession) -> DataFrame:
    """F2, F3 as a table, by rank."""
    rows = [(i, s.name, s.can_be_unavailable, s.fail_closed, s.has_cache, s.at_once, s.blocked_reason or None) for i, s in enumerate(REGISTRY)]
    return spark.createDataFrame(rows, "rank int, name string, can_be_unavailable boolean, fail_closed boolean, has_cache boolean, at_once int, blocked_reason string")


def blocked(runs: DataFrame, specs: DataFrame) -> DataFrame:
    """call_id and the reason of the first detector by rank that was unavailable and must not be; no row if none.

    runs: call_id, detector, status. Detectors that no spec knows don't block.
    """
    failed = runs.where("status <> 'ok'").join(F.broadcast(specs.where("can_be_unavailable and fail_closed")), F.col("detector") == F.col("name"))
    return failed.groupBy("call_id").agg(F.min(F.struct("rank", "blocked_reason")).alias("first")).select("call_id", F.col("first.blocked_reason").alias("blocked_reason"))


def ranked(detectors: list) -> list:
    """Detectors in order of priority, each name once."""
    rank = {s.name: i for i, s in enumerate(REGISTRY)}
    by_name = {}
    for d in detectors:
        if d.name not in rank:
            raise ValueError(f"unknown detector {d.name!r}")
        by_name.setdefault(d.name, d)
    return sorted(by_name.values(), key=lambda d: rank[d.name])


def found_in(text: Column, detectors: list, wanted: Column | None = None) -> Column:
    """What the detectors find in one text, by rank, with their names as sources; ``wanted`` narrows them for each row."""
    active = ranked(detectors)
    each = [R.tag(d.matches(text), d.name) for d in active]
    if wanted is not None:
        chosen, none = R.active_detectors(wanted, [d.name for d in active]), F.array().cast(ATTRIBUTED)
        each = [F.when(F.array_contains(chosen, F.lit(d.name)), e).otherwise(none) for d, e in zip(active, each)]
    return F.concat(*each)


def in_texts(texts: Column, detectors: list, wanted: Column | None = None) -> Column:
    """What the detectors find in the texts of a call, text after text."""
    return F.flatten(F.transform(F.filter(texts, lambda t: t.isNotNull() & (t != "")), lambda t: found_in(t, detectors, wanted)))


def detect_calls(calls: DataFrame, detectors: list, into: str = "entities") -> DataFrame:
    """Adds the entities of each call, united; a column detector_mode narrows the detectors row by row.

    Finding and uniting are columns of their own: the analyzer resolves one level of nested functions in each of its rounds, and stops
    with an error after a hundred.
    """
    wanted = F.col("detector_mode") if "detector_mode" in calls.columns else None
    return calls.withColumn(into, in_texts(F.col("texts"), detectors, wanted)).withColumn(into, R.dedup(F.col(into)))


def detect_merged(calls: DataFrame, detector, most_chars: int = MOST_LLM_CHARS, into: str = "entities") -> DataFrame:
    """One look at all texts of a call, joined by the sentinel; longer calls are looked at text by text.

    Matches that hold the sentinel are dropped. As above, finding and uniting are columns of their own.
    """
    blob = D.merged_text(F.filter("texts", lambda t: t.isNotNull()))
    whole = R.tag(D.without_sentinel(detector.matches(blob)), detector.name)
    found = F.when(F.length(blob) > most_chars, in_texts(F.col("texts"), [detector])).otherwise(whole)
    return calls.withColumn(into, found).withColumn(into, R.dedup(F.col(into)))
