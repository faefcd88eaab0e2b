import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cloakwork.llm import hard_negatives as H

VECTORS = "vec_id bigint, embedding array<float>, label int"


def brute(rows, every=10, positives=5, negatives=10):
    """All scores of all anchors, by loops. rows: (vec_id, vector, label); ids that repeat have one label and vector."""
    x = {i: (tag, [math.floor(256 * float(np.float32(c))) for c in v]) for i, v, tag in rows}
    out = []
    for a, (tag, mine) in x.items():
        if a % every:
            continue
        scored = [(-sum(p * q for p, q in zip(mine, v)), i, t) for i, (t, v) in x.items() if i != a]
        for p, pos, _ in sorted(s for s in scored if s[2] == tag)[:positives]:
            fits = sorted(s for s in scored if s[2] != tag and 30 * -p <= 100 * -s[0] <= 90 * -p)[:negatives]
            out += [(a, pos, k + 1, neg, -p, -n) for k, (n, neg, _) in enumerate(fits)]
    return sorted(out)


def table(n, d, seed, labels=3, ties=False):
    rnd = np.random.default_rng(seed)
    v = rnd.normal(size=(n, d)) + (np.arange(n) % 4 == 0)[:, None] * rnd.normal(size=d) * 2
    v = np.round(v) if ties else v
    return [(i, [float(c) for c in v[i].astype(np.float32)], int(rnd.integers(labels))) for i in range(n)]


def got(df, every=10, **parameters):
    return sorted(tuple(r) for r in H.mine(df, F.col("vec_id") % every == 0, **parameters).collect())


@pytest.mark.parametrize("d,ties", [(12, False), (4, True)])
def test_equals_all_pairs(spark, d, ties):
    rows = table(400, d, seed=d, ties=ties)
    df = spark.createDataFrame(rows, VECTORS)
    want = brute(rows)
    assert len(want) > 100
    assert got(df.repartition(3)) == want
    assert got(df.repartition(7), block=11) == want


def test_bounds_discard_pairs_but_no_result():
    """One task, many batches: once it has found enough, few pairs are scored, and what is found stays that of all pairs."""
    rnd = np.random.default_rng(1)
    x = np.floor(256 * rnd.normal(size=(6000, 64)) * np.linspace(1, 0.05, 64)).astype(float)
    labels = rnd.integers(4, size=6000)
    values, vectors = np.linalg.eigh(x.T @ x)
    turn = H.Rotation(np.ascontiguousarray(vectors[:, ::-1]), [8, 16, 32])
    asked = H.Asked(np.arange(20), labels[:20], x[:20], np.full((20, 1), -np.inf), np.full((20, 1), np.inf), True, 5)
    search, scored = H.Search(asked, turn), 0
    for b in range(0, 6000, 500):
        scored += len(search.candidates(labels[b : b + 500], x[b : b + 500])[0]) if b else 0
        search.add(np.arange(b, b + 500), labels[b : b + 500], x[b : b + 500])
    for k in range(20):
        all_ = sorted((-int(x[k] @ x[j]), j) for j in range(6000) if j != k and labels[j] == labels[k])
        assert search.found[k][0] == all_[:5]
    assert scored < 0.1 * 20 * 5500 / 4  # of the pairs with the same label


def test_awkward_rows(spark):
    rows = table(120, 6, seed=9)
    nan, inf = float("nan"), float("inf")
    odd = [(None, rows[0][1], 0), (200, None, 1), (210, [1.0, None, 1.0, 1.0, 1.0, 1.0], 1), (220, [nan] * 6, 1), (230, [inf] * 6, 1), (240, [1.0, 2.0], 1), (250, rows[3][1], None), (260, [], 1)]
    df = spark.createDataFrame([*rows, *rows[:30], *odd], VECTORS).withColumns({"id": F.lit("clash"), "x": F.lit("clash"), "rank": F.lit(1), "slot": F.lit(2)})
    assert got(df.repartition(5)) == brute(rows)
    assert got(df.limit(0)) == [] and got(spark.createDataFrame(odd, VECTORS)) == []
    assert got(spark.createDataFrame([(i, [0.0] * 3, i % 2) for i in range(12)], VECTORS)) == brute([(i, [0.0] * 3, i % 2) for i in range(12)])


def test_few_partners(spark):
    """An anchor alone with its label has no rows; one with two positives has rows for both."""
    rows = [(0, [1.0, 0.0], 0), (10, [1.0, 1.0], 1), (11, [1.0, 0.9], 1), (12, [0.9, 1.0], 1), (13, [0.5, 0.5], 2), (14, [0.3, 0.4], 2)]
    df = spark.createDataFrame(rows, VECTORS)
    assert got(df) == brute(rows) and {r[0] for r in got(df)} == {10}
    with pytest.raises(Exception, match="2\\^53"):
        got(spark.createDataFrame([(i, [1e9, 1e9], 0) for i in range(20)], VECTORS))
