"""Hard negatives: for anchors and their positives, the nearest rows of other labels within a share of the positive's score.

Scores are inner products of integer vectors. All vectors are turned by the eigenvectors of their second moments (an orthogonal
rotation, so inner products stay), which puts most of their length into the leading components. A task holds a block of anchors
and goes through its rows in batches: it adds up partial products over the leading components, cut by cut; what is left of a
product is at most the product of the two residual norms, plus a slack for rounding. A pair whose sum and bound tell that it can't
be among those asked for is discarded; survivors of the last cut are scored by integer products, which alone decide.

One pass finds the positives of a block of anchors, a second one its negatives; each task returns its own first ones, which are
merged by a window over the anchor, so the shuffle has a few rows for each anchor and task, whatever the rows' number. Blocks are of
``block`` anchors; so many vectors and positives come to the driver and go to a task at once. The rotation comes from sums over
all rows; it decides speed only, never a result.

Defined results: rows whose id, label or vector is null, whose vector holds null or non-finite entries, or has another length than
most vectors have, take no part. Ties go to the smaller id. Rows that repeat id and score count once for an anchor; of anchor
rows with the same id the one with the least label and vector counts, and rows with the anchor's own id are never its
partners. An anchor without a positive, and a positive without a negative, give no rows; an empty table gives none.
Scores have to stay below 2^53, as those of entries below 2^15 at 64 dimensions and scale 256 do; larger ones raise an error. Other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cloakwork.llm.common import commonest_length, finite, small_batches

OUT = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
LISTED = pa.schema([("anchor_id", pa.int64()), ("slot", pa.int32()), ("id", pa.int64()), ("score", pa.int64())])
LISTED_SQL = "anchor_id bigint, slot int, id bigint, score bigint"
ROWS = 1024


@dataclass
class Rotation:
    """``axes``: orthonormal columns, the strongest first. ``cuts``: after how many components sums are compared with bounds."""

    axes: np.ndarray
    cuts: list[int]


def rotation(rows: DataFrame, d: int, shares: tuple[float, ...] = (0.5, 0.75, 0.9)) -> Rotation:
    """Cuts fall where the leading components first hold such shares of all squared lengths."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d))
        for batch in batches:
            x = np.asarray(batch.column(0).flatten(), float).reshape(batch.num_rows, d)
            total += x.T @ x
        yield pa.RecordBatch.from_pydict({"at": pa.array(range(d * d), pa.int32()), "s": total.ravel()})

    moments = np.zeros(d * d)
    for r in rows.select("x").mapInArrow(summed, "at int, s double").groupBy("at").agg(F.sum("s").alias("s")).collect():
        moments[r.at] = r.s
    values, vectors = np.linalg.eigh(moments.reshape(d, d))
    held = np.cumsum(np.maximum(values[::-1], 0.0))
    cuts = {int(np.searchsorted(held, s * held[-1])) + 1 for s in shares} if held[-1] > 0 else set()
    return Rotation(np.ascontiguousarray(vectors[:, ::-1]), sorted(c for c in cuts if c < d))


@dataclass
class Asked:
    """Anchors with their labels, whole vectors, and for each (row) and slot the scores asked for, from low to high.

    ``same``: partners are of the anchor's label, else of other ones. Slots without a range have low above high.
    """

    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    low: np.ndarray
    high: np.ndarray
    same: bool
    first: int


class Search:
    """What one task has found so far: for each anchor and slot the first partners, by falling score, then by id."""

    def __init__(self, asked: Asked, turn: Rotation):
        self.a, self.r = asked, turn
        self.exact = asked.vectors.astype(np.int64)
        self.turned = asked.vectors @ turn.axes
        self.ends = [*turn.cuts, asked.vectors.shape[1]]
        self.rest = self.residuals(self.turned)
        self.found: list[list[list[tuple[int, int]]]] = [[[] for _ in range(asked.low.shape[1])] for _ in asked.ids]
        # Of all slots together: below floor nothing counts any more, nor above ceiling.
        live = asked.low <= asked.high
        self.floor = np.where(live, asked.low, np.inf).min(1, initial=np.inf)
        self.ceiling = np.where(live, asked.high, -np.inf).max(1, initial=-np.inf)
        self.slot_floor = np.where(live, asked.low, np.inf)

    def residuals(self, turned: np.ndarray) -> list[np.ndarray]:
        """Norms of what follows each cut; the last one is the slack's share: rounding is far below eps * d * norm * norm * 8."""
        left = np.square(turned)[:, ::-1].cumsum(1)[:, ::-1]
        return [np.sqrt(left[:, c]) for c in self.ends[:-1]] + [np.sqrt(left[:, 0])]

    def candidates(self, labels: np.ndarray, floats: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (anchor, row) that bounds leave open."""
        turned = floats @ self.r.axes
        rest = self.residuals(turned)
        if len(self.a.ids) and float(self.rest[-1].max()) * float(rest[-1].max(initial=0.0)) >= 2.0**53:
            raise ValueError("scores beyond 2^53 can't be compared exactly")
        open_ = (labels[None, :] == self.a.labels[:, None]) == self.a.same
        rows, sums, at = np.arange(len(labels)), np.zeros(open_.shape), 0
        slack = 8 * np.finfo(float).eps * floats.shape[1] * np.outer(self.rest[-1], rest[-1])
        for k, end in enumerate(self.ends):
            sums += self.turned[:, at:end] @ turned[rows, at:end].T
            bound = slack[:, rows] + (np.outer(self.rest[k], rest[k][rows]) if k < len(self.r.cuts) else 0.0)
            open_ &= (sums + bound >= self.floor[:, None]) & (sums - bound <= self.ceiling[:, None])
            at, some = end, open_.any(0)
            if not some.all():
                rows, sums, open_ = rows[some], sums[:, some], open_[:, some]
        i, j = np.nonzero(open_)
        return i, rows[j]

    def add(self, ids: np.ndarray, labels: np.ndarray, floats: np.ndarray) -> None:
        i, j = self.candidates(labels, floats)
        if not len(i):
            return
        keep = ids[j] != self.a.ids[i]
        i, j = i[keep], j[keep]
        scores, partner = np.einsum("ij,ij->i", self.exact[i], floats.astype(np.int64)[j]), ids[j]
        for s in range(self.a.low.shape[1]):
            inside = (scores >= self.slot_floor[i, s]) & (scores <= self.a.high[i, s])
            whose, who, points = i[inside], partner[inside], scores[inside]
            order = np.lexsort((who, -points, whose))
            whose, who, points = whose[order], who[order], points[order]
            again = (np.diff(whose, prepend=-1) == 0) & (np.diff(points, prepend=0) == 0) & (np.diff(who, prepend=0) == 0)
            whose, who, points = whose[~again], who[~again], points[~again]
            starts = np.flatnonzero(np.diff(whose, prepend=-1))
            for b, e in zip(starts.tolist(), [*starts[1:].tolist(), len(whose)]):
                k, e = whose[b], min(e, b + self.a.first)
                found = self.found[k][s] = sorted({*self.found[k][s], *zip((-points[b:e]).tolist(), who[b:e].tolist())})[: self.a.first]
                if len(found) == self.a.first:
                    self.slot_floor[k, s] = -found[-1][0]
        self.floor = self.slot_floor.min(1, initial=np.inf)

    def batch(self) -> pa.RecordBatch:
        rows = [(int(self.a.ids[k]), s, w, -p) for k, slots in enumerate(self.found) for s, slot in enumerate(slots) for p, w in slot]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else ([],) * 4, LISTED.types)], schema=LISTED)


def _first(rows: DataFrame, asked: Asked, turn: Rotation) -> DataFrame:
    """anchor_id, slot, id, score and place: the first partners of each anchor and slot over all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(asked, turn)
        for batch in batches:
            for b in range(0, batch.num_rows, ROWS):
                ids, labels, vectors = batch.slice(b, ROWS).columns
                floats = np.asarray(vectors.flatten(), float).reshape(len(ids), asked.vectors.shape[1])
                search.add(np.asarray(ids, np.int64), np.asarray(labels, np.int64), floats)
        yield search.batch()

    order = Window.partitionBy("anchor_id", "slot").orderBy(F.desc("score"), "id")
    every = rows.mapInArrow(run, LISTED_SQL).repartition("anchor_id", "slot").distinct()
    return every.withColumn("place", F.row_number().over(order)).where(F.col("place") <= asked.first)


def _blocks(anchors: DataFrame, block: int) -> Iterator[list]:
    """Anchors in order of their ids, each id once, ``block`` at a time."""
    last, n = None, block
    while n == block:
        rows = (anchors if last is None else anchors.where(F.col("id") > last)).groupBy("id").agg(F.min(F.struct("label", "x")).alias("s")).orderBy("id").limit(block).collect()
        n = len(rows)
        if n:
            last = rows[-1].id
            yield rows


def mine(
    df: DataFrame, anchor: Column, key: str = "vec_id", label: str | Column = "label", vector: str = "embedding", scale: int = 256,
    positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, block: int = 4096,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Entries become floor(scale * entry). The rows for which ``anchor`` holds are anchors. An anchor's positives are its first ``positives`` other
    rows of its label; for each, the first ``negatives`` rows of other labels whose score is from low to high hundredths of the positive's.
    """
    spark = df.sparkSession
    small_batches(spark, ROWS)
    label = F.col(label) if isinstance(label, str) else label
    d = commonest_length(df, vector)
    told = df.where(finite(F.col(vector)) & (F.size(vector) == d) & F.col(key).isNotNull() & label.isNotNull())
    x = F.transform(vector, lambda v: F.floor(v.cast("double") * scale).cast("double"))
    rows = told.select(F.col(key).cast("long").alias("id"), label.cast("long").alias("label"), x.alias("x"))
    anchors = told.where(anchor).select(F.col(key).cast("long").alias("id"), label.cast("long").alias("label"), x.alias("x"))
    turn, out = None, []
    for found in _blocks(anchors, block) if d else ():
        turn = turn or rotation(rows, d)
        ids, labels = np.array([r.id for r in found], np.int64), np.array([r.s.label for r in found], np.int64)
        vectors = np.array([r.s.x for r in found], float)
        whole = np.ones((len(ids), 1))
        near = _first(rows, Asked(ids, labels, vectors, -np.inf * whole, np.inf * whole, True, positives), turn)
        place = {int(i): k for k, i in enumerate(ids)}
        least, most = np.ones((len(ids), positives)), np.zeros((len(ids), positives))
        pairs = near.select("anchor_id", F.col("place").alias("slot"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")).collect()
        for p in pairs:  # whole numbers from low to high hundredths
            least[place[p.anchor_id], p.slot - 1], most[place[p.anchor_id], p.slot - 1] = -(-low * p.positive_score // 100), high * p.positive_score // 100
        kept = F.broadcast(spark.createDataFrame(pairs, "anchor_id bigint, slot int, positive_id bigint, positive_score bigint"))
        far = _first(rows, Asked(ids, labels, vectors, least, most, False, negatives), turn).withColumn("slot", F.col("slot") + 1)
        out.append(far.join(kept, ["anchor_id", "slot"]).select("anchor_id", "positive_id", F.col("place").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")))
    result = spark.createDataFrame([], OUT) if not out else out[0]
    for part in out[1:]:
        result = result.unionByName(part)
    return result
