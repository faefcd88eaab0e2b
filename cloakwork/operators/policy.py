"""Request handling as columns: overrides, size caps, fail policy, actions, the wait gate, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakwork.functions import text as T
from cloakwork.model import MOST_BODY_BYTES, MOST_LLM_CHARS

#: How many items an override's list may have.
LIST_CAPS = {"faker_locale": 3, "detector_mode": 5, "gliner_labels": 50}
NAME_FIELDS = ["regex_patterns", "llm_model", "llm_prompt", "denylist"]
STRATEGIES = ["longest", "priority"]


def body_ok(body: Column, most: int = MOST_BODY_BYTES) -> Column:
    """S3: a request whose JSON is larger is refused."""
    return F.octet_length(body) <= most


def too_long_for_llm(text: Column, most: int = MOST_LLM_CHARS) -> Column:
    """P20: longer texts are an availability error, never cut."""
    return F.length(text) > most


def parse_override(key: Column, value: Column) -> Column:
    """One override, from its JSON value, as canonical JSON; null if it is unknown, malformed or none.

    Lists may be given as comma-separated text; items are stripped and empty ones dropped. Booleans and numbers are strict.
    """
    v = F.try_parse_json(value)
    kind = F.schema_of_variant(v)
    said = F.try_variant_get(v, "$", "string")
    stripped = T.strip(said)
    listed = F.when(kind == "STRING", F.split(said, ",")).when(kind.isin("ARRAY<STRING>", "ARRAY<VOID>", "ARRAY<>"), F.try_variant_get(v, "$", "array<string>"))
    items = F.filter(F.transform(listed, T.strip), lambda x: x != "")
    out = F.lit(None).cast("string")
    for name, most in LIST_CAPS.items():
        out = F.when(key == name, F.when((F.size(items) > 0) & (F.size(items) <= most), F.to_json(items))).otherwise(out)
    for name in NAME_FIELDS:
        out = F.when(key == name, F.when((kind == "STRING") & (stripped != ""), stripped)).otherwise(out)
    number = F.try_variant_get(v, "$", "double")
    out = F.when(key == "use_faker", F.when(kind == "BOOLEAN", said)).otherwise(out)
    out = F.when(key == "gliner_threshold", F.when(kind.rlike("^(BIGINT|DOUBLE|DECIMAL|INT|SMALLINT|TINYINT|FLOAT)") & number.between(0, 1), number.cast("string"))).otherwise(out)
    return F.when(key == "regex_overlap_strategy", F.when((kind == "STRING") & F.lower(stripped).isin(STRATEGIES), F.lower(stripped))).otherwise(out)


KNOWN_OVERRIDES = ["use_faker", "detector_mode", "faker_locale", "gliner_labels", "gliner_threshold", "regex_overlap_strategy", *NAME_FIELDS]


def override_problem(key: Column, value: Column) -> Column:
    """L3: the first thing wrong with an override, or null. Blank names and empty lists are no override, not wrong."""
    v = F.try_parse_json(value)
    kind = F.schema_of_variant(v)
    size = F.when(kind == "STRING", F.size(F.filter(F.transform(F.split(F.try_variant_get(v, "$", "string"), ","), T.strip), lambda x: x != ""))).when(kind.startswith("ARRAY"), F.size(F.try_variant_get(v, "$", "array<variant>")))
    most = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for k, n in LIST_CAPS.items() for x in (k, n)]), key), F.lit(1 << 30))
    blank = (kind == "STRING") & (T.strip(F.try_variant_get(v, "$", "string")) == "")
    empty = key.isin([*LIST_CAPS, *NAME_FIELDS]) & (blank | (kind.startswith("ARRAY") & (size == 0)))
    wrong = F.array(
        F.when(~key.isin(KNOWN_OVERRIDES), "unknown override"),
        F.when(v.isNull(), "not JSON"),
        F.when(size > most, F.concat(F.lit("length "), size.cast("string"), F.lit(" exceeds cap of "), most.cast("string"))),
        F.when(parse_override(key, value).isNull() & ~empty, "wrong type or value"),
    )
    return F.get(F.filter(wrong, lambda x: x.isNotNull()), 0)


def wait(texts: Column, is_final: Column, use_realistic: Column, mode: Column) -> Column:
    """A chunk that isn't the last waits if realistic values are buffered, or if any text ends inside a token."""
    return F.coalesce(is_final == F.lit(False), F.lit(False)) & ((use_realistic & (mode == "buffer")) | F.exists(texts, T.partial_token))


def action(input_type: Column, texts: Column, n_entities: Column, changed: Column, waits: Column, blocked: Column) -> Column:
    """K1 and F6."""
    return (
        F.when(F.coalesce(F.size(texts), F.lit(0)) <= 0, "NONE")
        .when(blocked, "BLOCKED")
        .when(input_type == "request", F.when(n_entities > 0, "GUARDRAIL_INTERVENED").otherwise("NONE"))
        .when(waits, "WAIT")
        .otherwise(F.when(changed, "GUARDRAIL_INTERVENED").otherwise("NONE"))
    )


def fail_policy(runs: DataFrame, always_open: list[str] | None = None) -> DataFrame:
    """per call, from runs (call_id, detector, status, fail_closed): blocked, and by which detector first.

    A detector that isn't ok blocks the call if it is closed; rule and denylist detectors always give no matches instead.
    """
    soft = always_open or ["regex", "denylist"]
    bad = (F.col("status") != "ok") & F.col("fail_closed") & ~F.col("detector").isin(soft)
    return runs.groupBy("call_id").agg(F.coalesce(F.bool_or(bad), F.lit(False)).alias("blocked"), F.min(F.when(bad, F.concat(F.col("detector"), F.lit(" detector is unavailable; request blocked.")))).alias("blocked_reason"))


def stats(events: DataFrame, detectors: list[str]) -> DataFrame:
    """Hits, misses and in-flight calls of each detector, with zeros for those without events."""
    names = events.sparkSession.createDataFrame([(d,) for d in detectors], "detector string")
    seen = events.groupBy("detector").agg(F.count_if(F.col("kind") == "hit").alias("hits"), F.count_if(F.col("kind") == "miss").alias("misses"), (F.count_if(F.col("kind") == "start") - F.count_if(F.col("kind") == "end")).alias("in_flight"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return names.join(seen, "detector", "left").select("detector", zero("hits"), zero("misses"), zero("in_flight"))
