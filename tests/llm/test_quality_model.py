import itertools
import random

import numpy as np
from pyspark.sql import functions as F

from cloakwork.llm import quality_model as Q
from tests.llm.helpers import DOCS

WORDS = ["the", "cat", "sat", "on", "a", "mat", "and", "saw", "rain", "fall", "over", "hills", "while", "old", "men", "spoke"]
LABELS = "doc_id bigint, quality int, toxic int"


def corpus(spark, n=600, seed=5):
    """Bad documents repeat a line, or are full of symbols, or have both kinds of words that are fine alone."""
    rnd, rows, labels = random.Random(seed), [], []
    for i in range(n):
        line = lambda: " ".join(rnd.choices(WORDS, k=12)) + "."  # noqa: E731, B023
        text, good = "\n".join(line() for _ in range(5)), 1
        kind = i % 6
        if kind == 0:
            text, good = "\n".join([line()] * 5), 0
        elif kind == 1:
            text, good = " ".join(rnd.choice("#$%&") * 3 for _ in range(40)), 0
        elif kind in (2, 3, 4):
            zig, zag = kind in (2, 4), kind in (3, 4)
            text, good = text + " zig" * zig + " zag" * zag, int(not (zig and zag))
        rows.append((i, text, "en", "s", len(text)))
        labels.append((i, good, 0))
    return spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, LABELS)


def test_pairs_in_linear_time():
    rnd = np.random.default_rng(2)
    m = Q.Machine(5, [np.array([0.5]), np.array([])], 0.3, rnd.normal(size=10), rnd.normal(size=(10, 3)))
    at, x, starts = Q.places([[0, 3], [], [1, 2, 4]], np.array([[0.2, 1.0], [0.9, np.nan], [np.inf, 2.0]]), m.edges, 5)
    assert at.tolist() == [0, 3, 5, 8, 6, 9, 1, 2, 4, 7, 8]
    for k, got in enumerate(m.logits(at, x, starts)):
        mine = range(starts[k], [*starts, len(at)][k + 1])
        pairs = sum(m.vectors[at[i]] @ m.vectors[at[j]] * x[i] * x[j] for i, j in itertools.combinations(mine, 2))
        assert abs(got - (0.3 + sum(m.weights[at[i]] * x[i] for i in mine) + pairs)) < 1e-9


def test_held_out_accuracy(spark):
    docs, labels = corpus(spark)
    out = Q.judge(docs.repartition(3), labels).join(labels, "doc_id").collect()
    held = [r for r in out if r.held_out]
    assert len(out) == 600 and 80 < len(held) < 160 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in out)
    assert sum((r.score >= 0.5) == (r.quality == 1) for r in held) / len(held) > 0.93
    apart = [r for r in held if r.doc_id % 6 in (0, 1, 5)]
    assert sum((r.score >= 0.5) == (r.quality == 1) for r in apart) / len(apart) > 0.97


def test_what_is_learned_from(spark):
    """Labels of held-out rows, other columns, the order of rows and repeated ones change nothing."""
    docs, labels = corpus(spark, 200)
    fit = lambda d, x: Q.fit(d, x, usable=~Q.held_out(F.col("doc_id")))
    one = fit(docs, labels)
    lied = labels.withColumn("quality", F.when(Q.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    other = docs.withColumns({"lang": F.lit("zz"), "source": F.lit(None).cast("string"), "score": F.lit("clash"), "__y": F.lit("clash")})
    two = fit(other.unionByName(other.limit(50)).repartition(5), lied.unionByName(lied.limit(20)))
    assert np.array_equal(one.weights, two.weights) and np.array_equal(one.vectors, two.vectors) and one.bias == two.bias
    assert len(fit(docs, labels.where("quality = 1")).weights) and fit(docs, labels.limit(0)).bias == 0


def test_awkward_rows(spark):
    docs, labels = corpus(spark, 120)
    odd = [(1000, None, None, None, None), (1001, "", "en", "s", 0), (1002, "word " * 200_000, "en", "s", None), (None, "no id here", "en", "s", 3), (1003, "twice", "en", "s", 5), (1003, "twice", "en", "s", 5), (1004, " \n\t ", "en", "s", -1)]
    more = labels.unionByName(spark.createDataFrame([(1000, 1, 0), (1001, None, 0), (None, 0, 0), (1003, 1, 1), (1003, 0, 1), (5000, 1, 1)], LABELS))
    out = Q.judge(docs.unionByName(spark.createDataFrame(odd, DOCS)), more).where("doc_id >= 1000 or doc_id is null").collect()
    assert sorted(str(r.doc_id) for r in out) == ["1000", "1001", "1002", "1003", "1003", "1004", "None"]
    assert all(0 <= r.score <= 1 for r in out) and not next(r for r in out if r.doc_id is None).held_out
    assert Q.judge(docs.limit(0), labels).collect() == []
    assert {r.score for r in Q.judge(docs.limit(5), labels.limit(0)).collect()} == {0.5}
    assert all(r.score > 0.9 and r.predicted == 1 for r in Q.judge(docs, labels.withColumn("quality", F.lit(1))).collect())
    assert Q.judge(docs.drop("n_chars"), labels).count() == 120
