import math

import numpy as np
from pyspark.sql import functions as F

from cloakwork.llm import whitening as W

VECTORS = "vec_id bigint, embedding array<float>, label int"


def brute(rows, scale=64, shift=1_000_000, most=32):
    x = np.array([[math.floor(float(np.float32(c)) * scale) + shift for c in v] for _, v in rows], dtype=object)
    n, s = len(x), x.sum(0)
    exact = x * n - s
    centred = exact.astype(float) / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-values)[:most]
    return n, (exact * exact).sum(1), centred @ vectors[:, order] / np.sqrt(values[order]), values[order] / values.sum()


def table(spark, n=300, d=6, seed=3):
    rnd = np.random.default_rng(seed)
    mixed = rnd.normal(size=(n, d)) @ rnd.normal(size=(d, d)) + rnd.normal(size=d)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(mixed.astype(np.float32))]
    return rows, spark.createDataFrame([(i, v, None) for i, v in rows], VECTORS)


def test_equals_numpy(spark):
    rows, df = table(spark)
    n, deviation, whitened, explained = brute(rows)
    got = {(r.vec_id, r.component): r for r in W.whiten(df.repartition(5), components=4).collect()}
    assert len(got) == 4 * n
    for k in range(4):
        mine = np.array([got[i, k + 1].whitened for i in range(n)])
        sign = np.sign(mine @ whitened[:, k])
        assert np.allclose(mine * sign, whitened[:, k], atol=1e-9)
        assert abs(got[0, k + 1].explained / explained[k] - 1) < 1e-12
    assert [got[i, 1].deviation for i in range(n)] == list(deviation) and {r.n for r in got.values()} == {n}
    error = {r.identity_error for r in got.values()}
    assert len(error) == 1 and error.pop() < 1e-10


def test_awkward_rows(spark):
    rows, df = table(spark, n=40, d=3)
    odd = [(100, None), (101, []), (102, [1.0, None, 1.0]), (103, [1.0, float("nan"), 0.0]), (104, [float("inf"), 0.0, 0.0]), (105, [1.0, 2.0]), (None, rows[0][1]), (7, rows[7][1])]
    more = df.unionByName(spark.createDataFrame([(i, v, 1) for i, v in odd], VECTORS)).withColumns({"component": F.lit("clash"), "x": F.lit(1), "key": F.lit(2)})
    n, deviation, *_ = brute([*rows, rows[0], rows[7]])
    got = W.whiten(more).collect()
    assert len(got) == 42 * 3 and {r.n for r in got} == {42}
    assert sorted(r.vec_id for r in got if r.component == 1 and r.vec_id is not None) == sorted([*range(40), 7])
    assert [r.deviation for r in got if r.vec_id is None] == [deviation[0]] * 3


def test_no_variance(spark):
    columns = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    for rows in ([], [(1, [1.0, 2.0])], [(1, [1.0, 2.0])] * 5, [(1, None)]):
        out = W.whiten(spark.createDataFrame([(*r, 0) for r in rows], VECTORS))
        assert out.columns == columns and out.count() == 0
    flat = W.whiten(spark.createDataFrame([(i, [float(i % 5), 3.0, float(i % 5)], 0) for i in range(20)], VECTORS)).collect()
    assert {r.component for r in flat} == {1} and abs(flat[0].explained - 1) < 1e-12


def test_pairs_over_several_aggregations(spark):
    rows, df = table(spark, n=50, d=5)
    columns = [F.get("embedding", i).cast("double") for i in range(5)]
    x = np.array([v for _, v in rows])
    for most in (4, 15):
        assert np.allclose(W.products(df, columns, most), x.T @ x, atol=1e-8)
