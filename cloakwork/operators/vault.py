"""The vault and the caches as tables: put, peek, pop, expiry, eviction, warming."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TTL_SECONDS = 120


def put(anonymized: DataFrame, put_ts: str = "ts", detector_mode: list[str] | None = None, kwargs: str = "{}") -> DataFrame:
    """K2: vault rows of calls that have an id and an entry; the last put of a call counts.

    Of puts at the same time the one whose entries are greatest as JSON counts, so the result doesn't depend on row order.
    """
    rows = anonymized.where(F.col("call_id").isNotNull() & (F.col("call_id").cast("string") != "") & (F.size("entries") > 0))
    mode = F.array(*[F.lit(d) for d in detector_mode or ["regex"]])
    rows = rows.select("call_id", "entries", mode.alias("detector_mode"), F.lit(kwargs).alias("kwargs"), F.col(put_ts).alias("put_ts"))
    last = Window.partitionBy("call_id").orderBy(F.desc("put_ts"), F.desc(F.to_json("entries")))
    return rows.withColumn("__n", F.row_number().over(last)).where("__n = 1").drop("__n")


def wire(vault: DataFrame) -> DataFrame:
    """K3: key and JSON value of each entry, as a key-value store would hold it."""
    surrogates = F.map_from_arrays(F.transform("entries", lambda e: e["surrogate"]), F.transform("entries", lambda e: F.struct(e["original"].alias("original"), e["entity_type"].alias("entity_type"), e["source_detectors"].alias("source_detectors"))))
    return vault.select(F.concat(F.lit("vault:"), F.col("call_id").cast("string")).alias("key"), F.to_json(F.struct(surrogates.alias("surrogates"), "detector_mode", "kwargs")).alias("value"), "put_ts")


def peek(asked: DataFrame, vault: DataFrame, ttl_seconds: int = TTL_SECONDS) -> DataFrame:
    """Entries (exploded) for asked (call_id, ts); nothing for unknown or expired calls."""
    live = asked.join(vault, "call_id").where(F.unix_micros("ts") - F.unix_micros("put_ts") <= ttl_seconds * 1_000_000)
    return live.select("call_id", F.inline("entries"))


def pop(asked: DataFrame, vault: DataFrame, ttl_seconds: int = TTL_SECONDS) -> tuple[DataFrame, DataFrame]:
    """What peek gives, and the vault without the asked calls."""
    return peek(asked, vault, ttl_seconds), vault.join(asked.select("call_id").distinct(), "call_id", "left_anti")


def sweep(vault: DataFrame, now, ttl_seconds: int = TTL_SECONDS, most: int | None = None) -> DataFrame:
    """Without expired rows, and at most the ``most`` last ones put."""
    live = vault.where(F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros("put_ts") <= ttl_seconds * 1_000_000)
    return live if most is None else live.orderBy(F.desc("put_ts"), "call_id").limit(most)


def warm(texts: DataFrame, vault: DataFrame, detectors: list[str]) -> DataFrame:
    """Cache rows (slot, text, matches) for texts (call_id, text) that went out.

    The slot ``pipeline`` gets the entries whose original occurs in the text; the slot of a detector those of them that it
    found itself. Empty results are rows too. Blank texts have no slot.
    """
    sent = texts.where(F.btrim("text", F.lit(" \t\n\r\x0b\x0c")) != "").join(vault.select("call_id", "entries"), "call_id").where(F.size("entries") > 0)
    present = F.filter("entries", lambda e: F.contains(F.col("text"), e["original"]))
    slots = [F.struct(F.lit("pipeline").alias("slot"), F.col("present").alias("m"))]
    own = lambda d: F.filter("present", lambda e: F.array_contains(e["source_detectors"], F.lit(d)))
    slots += [F.struct(F.lit(d).alias("slot"), own(d).alias("m")) for d in detectors]
    out = sent.withColumn("present", present).select("call_id", "text", F.explode(F.array(*slots)).alias("s"))
    return out.select("call_id", "text", "s.slot", F.transform("s.m", lambda e: F.struct(e["original"].alias("text"), e["entity_type"].alias("entity_type"))).alias("matches"))


def append_new(cache: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """K4: rows of fresh whose key isn't cached yet; the first writer wins."""
    return fresh.dropDuplicates(keys).join(cache.select(*keys), keys, "left_anti")
