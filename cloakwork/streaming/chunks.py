"""T4: chunks of a call as a list in keyed state, so a batch writes the chunks that it brings and not the whole text anew.

``gate.accumulate_stream`` keeps one text for each call and rewrites it with each batch. Here a chunk is appended to the call's list; what came before is read
once a batch. The session needs the state store of RocksDB (``vault.PROVIDER``).
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


class Chunks(StatefulProcessor):
    """State of a call: its chunks in the order they came."""

    def __init__(self, idle_seconds: int | None):
        self.idle = idle_seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.kept = handle, handle.getListState("kept", "chunk string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        text = "".join(x[0] for x in self.kept.get()) if self.kept.exists() else ""
        fresh = []
        for r in sorted(rows, key=lambda r: (r.chunk_idx is not None, r.chunk_idx or 0)):
            text += r.chunk or ""
            if r.chunk:
                fresh.append((r.chunk,))
            yield Row(call_id=key[0], chunk_idx=r.chunk_idx, accumulated=text, is_final=r.is_final)
        if fresh:
            self.kept.appendList(fresh)
        if self.idle is not None:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle * 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.kept.clear()
        return iter(())

    def close(self) -> None:
        pass


def accumulate(chunks: DataFrame, idle_seconds: int | None = 3600) -> DataFrame:
    """call_id, chunk_idx, accumulated, is_final: what each chunk's call carries so far. Chunks of a batch are taken in order, null places first.

    A call's chunks go when nothing came for ``idle_seconds``, final chunk or not; None keeps them for good, for queries that
    end by themselves: one that waits for time to pass doesn't. Null and empty chunks add nothing, but come out.
    """
    call = chunks.schema["call_id"].dataType.simpleString()
    mine = chunks.select("call_id", "chunk_idx", "chunk", "is_final")
    out = f"call_id {call}, chunk_idx {chunks.schema['chunk_idx'].dataType.simpleString()}, accumulated string, is_final boolean"
    return mine.groupBy("call_id").transformWithState(Chunks(idle_seconds), out, "Append", "None" if idle_seconds is None else "ProcessingTime")
