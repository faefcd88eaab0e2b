"""Embedding whitening: the covariance from generated SQL sums over all pairs of dimensions, decomposed by LAPACK.

Vectors become columns; for each pair i <= j of them one expression sums the product of the two centred columns, and all of
these expressions (2,080 for 64 dimensions) are one aggregation, summed in each partition before anything is shuffled. The
driver gets one row of sums, assembles the matrix and has LAPACK decompose it. Projections are matrix products over Arrow
batches; the covariance of what comes out is summed by the same expressions and compared with the identity.

x = floor(scale * entry) + shift are integers, so their sums S are exact, and n * x - S is so too: centring loses nothing
however far the mean is from 0. Sums are doubles. The input is read once for the length of the vectors, once for S, once for
the products, once to measure the outcome and once for the result; nothing is written.

Defined results: rows whose vector is null, holds null or non-finite entries, or has another length than most vectors have (the
longest of the commonest lengths) are left out of the fit and the result. Other columns may be null; a null id stays.
Repeated rows count and are returned each for itself. A direction without variance (by its eigenvalue against rounding) can't be
whitened and is no component, so a table of one row, or of equal rows, gives no rows, as does an empty one. ``deviation`` is
null where it doesn't fit into a long. Columns other than the id and the vector are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakwork.llm.common import commonest_length, finite, small_batches, table_schema

OUT = "component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"


def products(df: DataFrame, columns: list[Column], most: int = 10_000) -> np.ndarray:
    """The sums of the products of all pairs of columns, in one aggregation; beyond ``most`` pairs, in one for each ``most``.

    Columns that are already centred give covariances times the number of rows. No rows give zeros.
    """
    d = len(columns)
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    named = df.select(*[F.coalesce(c, F.lit(0.0)).alias(f"c{i}") for i, c in enumerate(columns)])  # sums of what can't be null are cheaper
    out = np.zeros((d, d))
    for k in range(0, len(pairs), most):
        sums = named.selectExpr(*[f"sum(c{i} * c{j}) AS s{i}_{j}" for i, j in pairs[k : k + most]]).first()
        for (i, j), s in zip(pairs[k : k + most], sums):
            out[i, j] = out[j, i] = s or 0.0
    return out


@dataclass
class Whitening:
    """n vectors with sums S; unit eigenvectors of their covariance as rows, by falling eigenvalue; the trace of the covariance."""

    n: int
    sums: np.ndarray
    vectors: np.ndarray
    values: np.ndarray
    trace: float
    identity_error: float = 0.0


def integers(vector: Column, scale: int, shift: int) -> Column:
    return F.transform(vector, lambda v: F.floor(v.cast("double") * scale) + shift)


def fit(x: DataFrame, d: int, components: int) -> Whitening | None:
    """From a column x of d longs a row; None without rows. Components that rounding can't tell from none are left out."""
    first = x.agg(F.count("*"), *[F.sum(F.get("x", i)) for i in range(d)]).first()
    n, sums = first[0], list(first[1:])
    if not n:
        return None
    centred = [((F.get("x", i) * F.lit(n) - F.lit(s)) / F.lit(float(n))).cast("double") for i, s in enumerate(sums)]
    covariance = products(x, centred) / n
    values, vectors = np.linalg.eigh(covariance)
    told = values[::-1] > d * np.finfo(float).eps * max(values[-1], 0.0)
    kept = np.flatnonzero(told)[:components]
    return Whitening(n, np.array(sums, np.int64), np.ascontiguousarray(vectors.T[::-1][kept]), values[::-1][kept], float(np.trace(covariance)))


def _projected(x: DataFrame, m: Whitening) -> DataFrame:
    """x with the columns deviation and ws (one entry a component) in place of x."""
    weights = (m.vectors / np.sqrt(m.values)[:, None]).T
    at = x.columns.index("x")
    kept = [c for c in x.columns if c != "x"]
    small_batches(x.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.asarray(batch.column(at).flatten(), np.int64).reshape(batch.num_rows, len(m.sums))
            exact = rows * m.n - m.sums
            size = np.square(exact.astype(float)).sum(1)
            deviation = pa.array((exact * exact).sum(1), pa.int64(), mask=size >= 2.0**63)
            ws = exact / m.n @ weights
            offsets = pa.array(np.arange(batch.num_rows + 1) * weights.shape[1], pa.int32())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), deviation, pa.ListArray.from_arrays(offsets, pa.array(ws.ravel()))], names=[*kept, "deviation", "ws"])

    fields = [table_schema(x.select(*kept)), "deviation bigint, ws array<double>"]
    return x.mapInArrow(run, ", ".join(f for f in fields if f))


def whiten(df: DataFrame, key: str = "vec_id", vector: str = "embedding", scale: int = 64, shift: int = 1_000_000, components: int = 32) -> DataFrame:
    """A row for each vector and component: the key, component (from 1), n, deviation, whitened, explained, identity_error."""
    d = commonest_length(df, vector)
    x = df.where(finite(F.col(vector)) & (F.size(vector) == d)).select(F.col(key).alias("key"), integers(F.col(vector), scale, shift).alias("x"))
    m = fit(x.select("x"), d, components) if d else None
    if m is None or not len(m.values):
        return df.sparkSession.createDataFrame([], f"`{key}` {df.schema[key].dataType.simpleString()}, {OUT}")
    outcome = products(_projected(x.select("x"), m), [F.get("ws", i) for i in range(len(m.values))]) / m.n
    m.identity_error = float(np.abs(outcome - np.eye(len(m.values))).max())
    explained = F.array(*[F.lit(float(v / m.trace)) for v in m.values])
    rows = _projected(x, m).select("key", "deviation", F.posexplode("ws").alias("at", "whitened"))
    return rows.select(
        F.col("key").alias(key), (F.col("at") + 1).cast("int").alias("component"), F.lit(m.n).cast("bigint").alias("n"), "deviation", "whitened",
        F.get(explained, F.col("at")).alias("explained"), F.lit(m.identity_error).alias("identity_error"),
    )
