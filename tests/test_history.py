"""Histories as chains of prefixes, against histories as arrays."""

import random

from pyspark.sql import functions as F

from cloakwork.operators import history as H

SCHEMA = "conv_id bigint, turn int, text string"


def conversations():
    r = random.Random(5)
    rows = []
    for c in range(60):
        base, n = r.randrange(5), r.randrange(1, 9)
        rows += [(c, t, r.choice([f"text {base} {t}"] * 6 + [f"own {c} {t}", None, ""])) for t in range(n)]
    return rows


def test_nodes_are_the_distinct_histories(spark):
    rows = conversations()
    whole: dict = {}
    for c, t, x in rows:
        whole[c, t] = (*whole.get((c, t - 1), ()), x)
    df = spark.createDataFrame([*rows, (None, 0, "of none")], SCHEMA).withColumn("other", F.lit(1))
    chained = H.chain(df)
    got = chained.collect()
    by_node: dict = {}
    for r in got:
        assert r.place == len(whole[r.conv_id, r.turn]) and (r.parent is None) == (r.turn == 0)
        by_node.setdefault(r.node, set()).add(whole[r.conv_id, r.turn])
        if r.parent is not None:
            assert by_node.get(r.parent, {whole[r.conv_id, r.turn][:-1]}) == {whole[r.conv_id, r.turn][:-1]}
    assert len(got) == len(rows) and all(len(x) == 1 for x in by_node.values()) and len(by_node) == len(set(whole.values()))
    for r in H.nodes(chained).collect():
        have = [c for (c, _), w in whole.items() if {w} == by_node[r.node]]
        assert (r.owner, r.conversations, r.text) == (min(have), len(have), next(iter(by_node[r.node]))[-1])


def test_histories_on_demand(spark):
    rows = conversations()
    chained = H.chain(spark.createDataFrame(rows, SCHEMA))
    wanted = chained.where("turn = 2").select("conv_id", "node")
    unknown = spark.sql("SELECT -1L AS conv_id, struct(CAST(1 AS decimal(30,0)) AS a, CAST(2 AS decimal(30,0)) AS b) AS node")
    got = {r.conv_id: r.sent for r in H.sent(chained, wanted.unionByName(unknown)).collect()}
    want = {c: [x for d, t, x in rows if d == c and t <= 2] for c in {c for c, t, _ in rows if t == 2}}
    assert got == {**want, -1: None}


def test_a_store_of_nodes_grows_with_turns(spark):
    """A conversation of 20,000 turns and its snapshot: as many nodes as turns, and no array of texts."""
    df = spark.range(40_000).select((F.col("id") % 2).alias("conv_id"), F.floor(F.col("id") / 2).cast("int").alias("turn"), F.floor(F.col("id") / 2).cast("string").alias("text"))
    kept = H.nodes(H.chain(df)).agg(F.count("*").alias("n"), F.min("conversations").alias("c"), F.sum(F.length("text")).alias("chars")).first()
    assert tuple(kept) == (20_000, 2, sum(len(str(i)) for i in range(20_000)))


def test_empty(spark):
    chained = H.chain(spark.createDataFrame([], SCHEMA))
    assert chained.count() == 0 and H.nodes(chained).count() == 0 and H.sent(chained, chained.select("node")).count() == 0
