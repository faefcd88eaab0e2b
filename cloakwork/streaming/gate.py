"""Answers that come in chunks: accumulation, the wait gate, and restoring against a time-limited vault, as streams.

The stateless gate works on any DataFrame. Accumulation keeps one text per call as keyed state; restoring is a join of two
streams by call within the time to live.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cloakwork.operators import policy

CHUNKS = "call_id string, chunk_idx int, chunk string, is_final boolean"


def gate(chunks: DataFrame, texts: str = "texts", use_realistic: bool = False, mode: str = "buffer") -> DataFrame:
    """Adds action: WAIT, or CHECK for chunks that are to be restored now. Works on streams and tables."""
    waits = policy.wait(F.col(texts), F.col("is_final"), F.lit(use_realistic), F.lit(mode))
    return chunks.withColumn("action", F.when(waits, "WAIT").otherwise("CHECK"))


def accumulate(chunks: DataFrame) -> DataFrame:
    """T4 on tables: what each chunk's call carries so far."""
    w = Window.partitionBy("call_id").orderBy("chunk_idx").rowsBetween(Window.unboundedPreceding, 0)
    return chunks.withColumn("accumulated", F.array_join(F.collect_list("chunk").over(w), ""))


def accumulate_stream(chunks: DataFrame, idle_seconds: int | None = 3600) -> DataFrame:
    """T4 on streams: call_id, chunk_idx, accumulated, is_final. Chunks of a batch are taken in order.

    A call's text is kept until nothing came for ``idle_seconds``, final chunk or not: so a call that never ends doesn't stay,
    and a chunk behind the final one still carries all that came before, as in a table. None keeps it for good, for queries
    that end by themselves: one that waits for time to pass doesn't.
    """
    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    names = ["call_id", "chunk_idx", "accumulated", "is_final"]

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        text = state.get[0] if state.exists else ""
        rows = []
        for r in pd.concat(list(frames)).sort_values("chunk_idx").itertuples():
            text += r.chunk or ""
            rows.append((key[0], r.chunk_idx, text, r.is_final))
        state.update((text,))
        if idle_seconds is not None:
            state.setTimeoutDuration(idle_seconds * 1000)
        yield pd.DataFrame(rows, columns=names)

    return chunks.groupBy("call_id").applyInPandasWithState(run, "call_id string, chunk_idx int, accumulated string, is_final boolean", "text string", "append", GroupStateTimeout.NoTimeout if idle_seconds is None else GroupStateTimeout.ProcessingTimeTimeout)


def restore_stream(responses: DataFrame, puts: DataFrame, ttl_seconds: int = 120, lateness: str = "10 seconds") -> DataFrame:
    """Responses (call_id, texts, ts) joined with vault puts (call_id, entries, put_ts) within the time to live.

    A response without a put in that time comes out with null entries once the watermark has passed it.
    """
    a = responses.withWatermark("ts", lateness)
    b = puts.withWatermark("put_ts", lateness).select(F.col("call_id").alias("put_call"), "entries", "put_ts")
    live = (F.col("call_id") == F.col("put_call")) & (F.col("put_ts") <= F.col("ts")) & (F.col("ts") <= F.col("put_ts") + F.expr(f"interval {ttl_seconds} seconds"))
    return a.join(b, live, "leftOuter").drop("put_call")


def entity_rates(events: DataFrame, width: str = "1 hour") -> DataFrame:
    """An addition of ours: events and distinct users by type in tumbling windows; works on streams with a watermark."""
    return events.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), "event_type", "n")
