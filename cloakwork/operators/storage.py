"""where the vault and the caches are kept: one interface, and its form over tables of the shared folder.

A store holds rows under keys. Its versions are numbered files, each of which lists the folders with the rows of that version; a version is made by
creating the file of the next number, which succeeds for one writer only, and the others try again behind it. So a put counts whole or not at all, a
reader keeps the version that it began with, and ``compact`` and ``pop`` replace folders for later readers only. ``vacuum`` deletes what
the last version doesn't list.

Puts of a stream carry the stream's name and the batch's number, and versions hold the last number of each stream, so a batch that is run again changes nothing.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cloakwork.session import remove


class Store(Protocol):
    """What operators ask of a vault or a cache."""

    def put(self, rows: DataFrame) -> None: ...

    def rows(self) -> DataFrame: ...


class TableStore:
    """Rows as Parquet files. Of rows with the same keys the last put counts (``first_wins``: the first one).

    at: the column with the time of the put. ttl_seconds: rows older than that at the time ``now`` of reading don't count. Ties go
    by all other columns, so that a result doesn't depend on the order of rows.
    """

    def __init__(self, spark: SparkSession, path: str, schema: StructType | str, keys: list[str], at: str = "put_ts", ttl_seconds: int | None = None, first_wins: bool = False):
        self.spark, self.path, self.schema, self.keys, self.at, self.ttl_seconds, self.first_wins = spark, path.rstrip("/"), schema, keys, at, ttl_seconds, first_wins

    # ---- versions

    def _files(self, *below: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *below]))
        return at, at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, *below: str) -> list[str]:
        at, files = self._files(*below)
        return sorted(x.getPath().getName() for x in files.listStatus(at)) if files.exists(at) else []

    def version(self) -> tuple[int, dict]:
        """Number and content of the last version: folders, and the last batch of each stream."""
        numbers = [n for n in self._names("versions") if n.isdigit()]
        if not numbers:
            return 0, {"folders": [], "streams": {}}
        at, files = self._files("versions", numbers[-1])
        stream = files.open(at)
        try:
            return int(numbers[-1]), json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _commit(self, number: int, content: dict) -> bool:
        """Makes a version, whole at once, unless there is one of that number."""
        jvm = self.spark._jvm
        draft, files = self._files("versions", f".{uuid.uuid4().hex}")
        out = files.create(draft, False)
        out.write(bytearray(json.dumps(content).encode()))
        out.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), self.spark._jsc.hadoopConfiguration())
        keep = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            context.rename(draft, self._files("versions", f"{number:020d}")[0], keep)
            return True
        except Exception as x:
            if "already exist" not in str(x).lower() and "FileAlreadyExists" not in str(x):
                raise
            files.delete(draft, False)
            return False

    def _write(self, rows: DataFrame) -> str:
        columns = self.spark.createDataFrame([], self.schema).columns
        folder = f"data/{uuid.uuid4().hex}"
        rows.select(*columns).write.parquet(f"{self.path}/{folder}")
        return folder

    def _drop(self, folders: list[str]) -> None:
        for f in folders:
            remove(self.spark, f"{self.path}/{f}")

    # ---- rows

    def put(self, rows: DataFrame, stream: str | None = None, batch: int = 0) -> None:
        """Appends. A batch of a stream counts once, whatever comes of its first run."""
        done = lambda content: stream is not None and batch <= content["streams"].get(stream, -1)
        if done(self.version()[1]):
            return
        folder = self._write(rows)
        while True:
            number, content = self.version()
            if done(content):
                return self._drop([folder])
            content["folders"].append(folder)
            if stream is not None:
                content["streams"][stream] = batch
            if self._commit(number + 1, content):
                return None

    def sink(self, stream: str) -> Callable[[DataFrame, int], None]:
        """For ``foreachBatch``: a batch that the stream runs again after a failure is put once."""
        return lambda rows, batch: self.put(rows, stream, batch)

    def _read(self, folders: list[str], now: str | None) -> DataFrame:
        every = self.spark.read.schema(self.schema).parquet(*[f"{self.path}/{f}" for f in folders]) if folders else self.spark.createDataFrame([], self.schema)
        if now is not None and self.ttl_seconds is not None:
            every = every.where(F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(self.at) <= self.ttl_seconds * 1_000_000)
        ties = F.to_json(F.struct(*[c for c in every.columns if c not in (*self.keys, self.at)]))
        order = [F.asc(self.at), ties.asc()] if self.first_wins else [F.desc(self.at), ties.desc()]
        return every.withColumn("__n", F.row_number().over(Window.partitionBy(*self.keys).orderBy(*order))).where("__n = 1").drop("__n")

    def rows(self, now: str | None = None) -> DataFrame:
        """The row that counts for each key, of those that are not too old at ``now``, in the version of this moment."""
        return self._read(self.version()[1]["folders"], now)

    def compact(self, now: str | None = None) -> None:
        """Keeps only what counts, in one folder. Puts that come meanwhile are kept; of two compactions at a time one counts."""
        old = self.version()[1]["folders"]
        folder = self._write(self._read(old, now))
        while True:
            number, content = self.version()
            if not set(old) <= set(content["folders"]):
                return self._drop([folder])
            content["folders"] = [folder, *(f for f in content["folders"] if f not in old)]
            if self._commit(number + 1, content):
                return None

    def pop(self, asked: DataFrame, now: str | None = None) -> DataFrame:
        """The rows of the asked keys, which the next version has no more. Each row goes to one caller: if another version came meanwhile,
        all is done again from that one. Costs as much as ``compact``, so it is for many keys at once."""
        keys = asked.select(*self.keys).distinct()
        while True:
            number, content = self.version()
            every = self._read(content["folders"], None)
            taken, left = self._write(every.join(keys, self.keys, "left_semi")), self._write(every.join(keys, self.keys, "left_anti"))
            if self._commit(number + 1, content | {"folders": [left]}):
                return self._read([taken], now)
            self._drop([taken, left])

    def vacuum(self) -> None:
        """Deletes the folders and versions before the last one. No reader may hold rows of them, nor a writer or popper be at work."""
        number, content = self.version()
        self._drop([f"data/{n}" for n in self._names("data") if f"data/{n}" not in content["folders"]])
        self._drop([f"versions/{n}" for n in self._names("versions") if n != f"{number:020d}"])
