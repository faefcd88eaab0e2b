"""The vault as keyed state of a stream: what was put for a call is kept for its time to live and read any number of times.

Puts and responses are one stream, grouped by call. A put replaces what the call has; a response gets the entries that were put up to its own time, if they
are no older than the time to live. Reading consumes nothing, so a response that comes twice gets the same answer twice. A timer at the
end of the time to live clears the state once the watermark has passed it, so state follows the puts of that time, not of all times.

Rows of a call in one batch are taken in order of their time, a put before a response of the same time; of puts at the same time the one whose entries are
greatest as JSON counts. A response without an entry comes out at once, with null entries: unlike in ``gate.restore_stream`` nothing waits for a
put that might follow in a later batch. Rows that come later than the watermark allows are dropped, and puts of calls without an
id or without an entry are no puts. The session needs the state store of RocksDB (``PROVIDER``).
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


class Vault(StatefulProcessor):
    """State of a call: what was put last, and when (milliseconds)."""

    def __init__(self, ttl_seconds: int):
        self.ttl = ttl_seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.kept = handle, handle.getValueState("kept", "entries string, at bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        for r in sorted(rows, key=lambda r: (r.at, r.entries is None, r.entries or "")):
            if r.entries is not None:
                for t in list(self.handle.listTimers()):
                    self.handle.deleteTimer(t)
                self.kept.update((r.entries, r.at))
                self.handle.registerTimer(r.at + self.ttl + 1)
                continue
            found = self.kept.get() if self.kept.exists() else None
            live = found is not None and 0 <= r.at - found[1] <= self.ttl
            yield Row(call_id=key[0], response=r.response, entries=found[0] if live else None)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.kept.clear()
        return iter(())

    def close(self) -> None:
        pass


def restore_stream(responses: DataFrame, puts: DataFrame, ttl_seconds: int = 120, lateness: str = "10 seconds") -> DataFrame:
    """The columns of responses (call_id, ts, and others) with ``entries``, null where none is live. puts has call_id, entries, put_ts."""
    kind, call = puts.schema["entries"].dataType, responses.schema["call_id"].dataType.simpleString()
    asked = responses.select("call_id", F.col("ts").alias("time"), F.to_json(F.struct(*responses.columns)).alias("response"), F.lit(None).cast("string").alias("entries"))
    put = puts.where(F.col("call_id").isNotNull() & (F.size("entries") > 0)).select("call_id", F.col("put_ts").alias("time"), F.lit(None).cast("string").alias("response"), F.to_json("entries").alias("entries"))
    both = asked.unionByName(put).withWatermark("time", lateness).withColumn("at", F.unix_millis("time"))
    done = both.groupBy("call_id").transformWithState(Vault(ttl_seconds), f"call_id {call}, response string, entries string", "Append", "EventTime")
    back = F.from_json("response", responses.schema)
    return done.select(*[F.col("call_id") if c == "call_id" else back[c].alias(c) for c in responses.columns], F.from_json("entries", kind).alias("entries"))
