"""Anonymising and restoring calls.

A call is a row with an array of texts. Detection, resolution, surrogates and replacement are array expressions of that row,
so anonymising has no shuffle at all; restoring has one, the join with the vault. Replacement is by value and over the whole
call: an entity found in one text is replaced in all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakwork.functions import spans as S
from cloakwork.operators import detect as D
from cloakwork.operators import resolve as R
from cloakwork.operators import surrogate as X
from cloakwork.sources.rules import Rule


def rule_matches(text: Column, rules: list[Rule], strategy: str = "longest") -> Column:
    """Accepted rule matches of one text, as (text, entity_type)."""
    return D.normalized(S.greedy(D.rule_candidates(text, rules), strategy))


def detect_call(texts: Column, rules: list[Rule], strategy: str = "longest", detector: str = "regex") -> Column:
    """D20, R4, R5 for rules: the entities of all texts of a call."""
    per_text = F.transform(F.filter(texts, lambda t: t.isNotNull() & (t != "")), lambda t: R.tag(rule_matches(t, rules, strategy), detector))
    return R.dedup(F.flatten(per_text))


def anonymize(calls: DataFrame, entities: Column, salt: str, use_realistic: bool = False, locale: str = "en_US", texts: str = "texts") -> DataFrame:
    """Adds ``entries`` (surrogate, original, entity_type, source_detectors) and ``anonymized`` (the new texts)."""
    found = calls.withColumn("__entities", entities)
    found = found.withColumn("entries", X.assign(F.col("__entities"), salt, use_realistic, locale)).drop("__entities")
    return found.withColumn("anonymized", F.transform(texts, lambda t: S.replace_all(t, F.col("entries"), "original", "surrogate")))


def anonymize_rules(calls: DataFrame, rules: list[Rule], salt: str, strategy: str = "longest", **parameters) -> DataFrame:
    return anonymize(calls, detect_call(F.col("texts"), rules, strategy), salt, **parameters)


def restore(responses: DataFrame, vault: DataFrame, ttl_seconds: int = 120, substitute: bool = True, texts: str = "texts", at: str = "ts") -> DataFrame:
    """Adds ``restored`` and ``late`` (no entry for the call, or one too old; texts then stay as they are).

    The vault has call_id, entries and put_ts, one row a call. An entry counts for ttl_seconds from its put.
    """
    kept = vault.select(F.col("call_id").alias("__call"), "entries", "put_ts")
    # The put may be recorded with the response's own time, so only the age is bounded.
    joined = responses.join(kept, (F.col("call_id") == F.col("__call")) & (F.unix_micros(at) - F.unix_micros("put_ts") <= ttl_seconds * 1_000_000), "left")
    swapped = F.transform(texts, lambda t: S.replace_all(t, F.col("entries"), "surrogate", "original")) if substitute else F.col(texts)
    out = joined.withColumn("restored", F.when(F.col("entries").isNull(), F.col(texts)).otherwise(swapped)).withColumn("late", F.col("entries").isNull())
    return out.drop("__call", "entries", "put_ts")
