"""D5 to D8 for denylists of any size: entries are a table, and detection is a join.

No pattern and no entry is in the plan. Entries are sorted by levels: that of an entry is the greatest power of two up to its length. Two bit maps
say which hashes occur: of the entries' beginnings, as long as their level, and of whole entries. A task goes over a text once a
level with rolling hashes (a difference of running sums of code points times powers, so all windows of a length are one array
operation), and looks up whole lengths only where a beginning may be one. What passes is joined with the entries by value, which
decides: broadcast if the entries have at most ``most_bytes``, which are counted, by a shuffle otherwise. So a task holds the bit maps, which have
``BITS`` bits each at most; beyond that more windows pass them, and the join still decides.

The spans are those of the automaton: all occurrences of all entries, overlapping ones too, whose word boundaries hold, and of these greedily the longest, then
the earliest; case-sensitive entries come before others at ties.

Entries have value, entity_type, case_sensitive and word_boundary (null counts as true). Of entries with the same value (but for case, where case
doesn't matter) one without word boundaries counts, else the one whose type comes first. Entries without a value or type are left out. Folding case is
one character to one; others stay as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloakwork.functions import spans as S
from cloakwork.model import CANDIDATES

BITS = 1 << 28
#: An odd factor has an inverse modulo 2^64, so windows are hashed alike wherever they begin.
FACTOR, INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
HITS = "array<struct<start:int,exact:boolean,needle:string,value:string,left:boolean,right:boolean>>"
HIT = pa.list_(pa.struct([("start", pa.int32()), ("exact", pa.bool_()), ("needle", pa.string()), ("value", pa.string()), ("left", pa.bool_()), ("right", pa.bool_())]))


def level(length: int) -> int:
    return 1 << (length.bit_length() - 1)


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def folded(text: str) -> str:
    """Lower case, one character for each."""
    low = text.lower()
    return low if len(low) == len(text) and text.isascii() else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def _edge(c: str) -> bool:
    return c.isalnum() or c == "_"


@dataclass
class Windows:
    """Hashes of the windows of texts; keeps the powers of the factor."""

    powers: list[np.ndarray] = field(default_factory=lambda: [np.ones(1, np.uint64)] * 2)

    def sums(self, text: str) -> np.ndarray:
        points = codes(text).astype(np.uint64) + np.uint64(1)
        if len(points) > len(self.powers[0]):
            of = lambda f: np.multiply.accumulate(np.concatenate(([np.uint64(1)], np.full(2 * len(points), f, np.uint64))))
            self.powers = [of(FACTOR), of(INVERSE)]
        return np.concatenate((np.zeros(1, np.uint64), np.cumsum(points * self.powers[0][: len(points)], dtype=np.uint64)))

    def hashes(self, sums: np.ndarray, at: np.ndarray, length: int | np.ndarray) -> np.ndarray:
        h = (sums[at + length] - sums[at]) * self.powers[1][at] + np.asarray([length], np.uint64).ravel() * np.uint64(FACTOR)
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        return (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)


def probes(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Two places in a bit map, whose size is a power of two."""
    return h & np.uint64(bits - 1), (h >> np.uint64(35)) & np.uint64(bits - 1)


@dataclass
class Filter:
    """bits: how many each map has; maps: of beginnings and whole entries, for exact and folded ones; lengths: by (exact, level)."""

    bits: int
    maps: dict[tuple[bool, bool], np.ndarray]
    lengths: dict[tuple[bool, int], list[int]]

    def passes(self, exact: bool, whole: bool, h: np.ndarray) -> np.ndarray:
        found = self.maps.get((exact, whole))
        if found is None:
            return np.zeros(len(h), bool)
        a, b = ((found[p >> np.uint64(3)] >> (p & np.uint64(7)).astype(np.uint8)) & 1 for p in probes(h, self.bits))
        return (a & b).astype(bool)

    def find(self, text: str, w: Windows) -> list[dict]:
        """Windows of the text that may be entries."""
        out = []
        for exact in (True, False):
            mine = {k[1]: v for k, v in self.lengths.items() if k[0] is exact}
            body = text if exact else folded(text)
            sums = w.sums(body) if mine else None
            for step, lengths in mine.items():
                starts = np.arange(max(0, len(text) - step + 1))
                starts = starts[self.passes(exact, False, w.hashes(sums, starts, step))]
                for n in lengths:
                    at = starts[starts + n <= len(text)]
                    for i in at[self.passes(exact, True, w.hashes(sums, at, n))].tolist():
                        left = not (i and _edge(text[i]) and _edge(text[i - 1]))
                        right = not (i + n < len(text) and _edge(text[i + n - 1]) and _edge(text[i + n]))
                        out.append({"start": i, "exact": exact, "needle": body[i : i + n], "value": text[i : i + n], "left": left, "right": right})
        return out


def prepared(entries: DataFrame) -> DataFrame:
    """exact, needle, word_boundary, entity_type: one row for each needle."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            needles = [v if e else folded(v) for v, e in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(needles, pa.string()), b.column(2), b.column(3)], names=["exact", "needle", "word_boundary", "entity_type"])

    told = entries.where(F.col("value").isNotNull() & (F.col("value") != "") & F.col("entity_type").isNotNull())
    told = told.select("value", F.coalesce("case_sensitive", F.lit(True)).alias("exact"), F.coalesce("word_boundary", F.lit(True)).alias("word_boundary"), "entity_type").distinct()
    rows = told.mapInArrow(fold, "exact boolean, needle string, word_boundary boolean, entity_type string")
    return rows.groupBy("exact", "needle").agg(F.min(F.struct("word_boundary", "entity_type")).alias("s")).select("exact", "needle", "s.*")


def make_filter(needles: DataFrame, count: int) -> Filter:
    """The bit maps, put together in the JVM in pieces of 4 KB; what comes to the driver is bounded by BITS."""
    bits = min(BITS, max(1 << 15, 1 << (16 * count - 1).bit_length()))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = Windows()
        for b in batches:
            texts, n = b.column(1).to_pylist(), b.num_rows
            if not n:
                continue
            whole = np.array([len(t) for t in texts])
            first = np.array([level(k) for k in whole.tolist()])
            sums, at = w.sums("".join(texts)), np.cumsum(whole) - whole
            found = [p for size in (first, whole) for p in probes(w.hashes(sums, at, size), bits)]
            exact = pa.concat_arrays([b.column(0)] * 4)
            yield pa.RecordBatch.from_arrays([exact, pa.array(np.repeat([False, True], 2 * n)), pa.array(np.concatenate(found).astype(np.int64))], names=["exact", "whole", "place"])

    places = needles.select("exact", "needle").mapInArrow(hashed, "exact boolean, whole boolean, place bigint")
    parts = places.groupBy("exact", "whole", F.floor(F.col("place") / 32768).alias("part")).agg(F.bitmap_construct_agg(F.col("place") % 32768).alias("set"))
    maps: dict[tuple[bool, bool], np.ndarray] = {}
    for r in parts.toLocalIterator():
        into = maps.setdefault((r.exact, r.whole), np.zeros(bits // 8, np.uint8))
        into[r.part * 4096 : (r.part + 1) * 4096] = np.frombuffer(bytes(r.set), np.uint8)
    lengths: dict[tuple[bool, int], list[int]] = {}
    for r in needles.select("exact", F.length("needle").alias("n")).distinct().orderBy("n").collect():
        lengths.setdefault((r.exact, level(r.n)), []).append(r.n)
    return Filter(bits, maps, lengths)


def detect(df: DataFrame, entries: DataFrame, key: list[str], text: str = "text", into: str = "candidates", most_bytes: int = 64 << 20) -> DataFrame:
    """Adds the accepted spans of the entries. ``key``: columns that, together with the text, tell rows apart; rows that they don't get the same spans."""
    needles = prepared(entries)
    count, size = needles.agg(F.count("*"), F.sum(F.octet_length("needle") + F.octet_length("entity_type") + 32)).first()
    if not count:
        return df.withColumn(into, S.no_candidates())
    found = make_filter(needles, count)
    names = [f"__k{i}" for i in range(len(key) + 1)]
    body = F.coalesce(F.col(text), F.lit(""))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = Windows()
        for b in batches:
            hits = [found.find(t, w) for t in b.column(len(names)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], pa.array(hits, HIT)], names=[*names, "hits"])

    sent = df.select(*[F.col(k).alias(n) for k, n in zip([*key], names)], F.xxhash64(body).alias(names[-1]), body.alias("__text"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in sent.schema.fields[:-1]), f"hits {HITS}"])
    hits = sent.mapInArrow(scan, schema).select(*names, F.inline("hits"))
    known = (F.broadcast(needles) if size <= most_bytes else needles).withColumnsRenamed({"exact": "__exact", "needle": "__needle"})
    # The text's boundaries are looked at here, since an entry says whether it needs them.
    true = hits.join(known, (F.col("needle") == F.col("__needle")) & (F.col("exact") == F.col("__exact"))).where(~F.col("word_boundary") | (F.col("left") & F.col("right")))
    span = F.struct("start", (F.col("start") + F.length("value")).alias("end"), "value", "entity_type", F.when(F.col("exact"), 0).otherwise(1).alias("ord"))
    listed = true.groupBy(*names).agg(F.collect_set(span).cast(CANDIDATES).alias("__found")).withColumn("__found", S.greedy(F.col("__found"), "longest"))
    marked = df.withColumn("__own", F.xxhash64(F.coalesce(F.col(text), F.lit(""))))
    same = [F.col(k).eqNullSafe(F.col(n)) for k, n in zip([*key, "__own"], names)]
    on = same[0]
    for s in same[1:]:
        on = on & s
    return marked.join(listed, on, "left").withColumn(into, F.coalesce("__found", S.no_candidates())).drop("__found", "__own", *names)
