"""Detection as a table function, against the expression."""

import random

from pyspark.sql import functions as F

from cloakwork.operators import detect as D
from cloakwork.operators import table_function as TF
from cloakwork.sources.rules import Rule, load_pack

TEXTS = [None, "", "nothing", "ann@example.org and 10.0.0.1, 10.0.0.999 and bob@example.org", "é ann@example.org\n" * 300, "card 4111 1111 1111 1111 or 4111 1111 1111 1112"]


def test_lateral_join_equals_the_expression(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "id int, text string").withColumn("value", F.lit("clash"))
    for strategy in ("longest", "priority"):
        TF.register(spark, load_pack(), "found", strategy)
        got = spark.sql("SELECT d.id, e.start, e.stop, e.value, e.entity_type FROM {docs} AS d, LATERAL found(d.text) AS e", docs=docs)
        each = D.scan(docs, load_pack(), strategy=strategy).select("id", F.explode("candidates").alias("c")).select("id", "c.start", "c.end", "c.value", "c.entity_type")
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, each.collect())) and got.where("id = 4").count() == 300
    kept = spark.sql("SELECT d.id, count(f.start) AS n FROM {docs} AS d LEFT JOIN (SELECT d.id, e.start FROM {docs} AS d, LATERAL found(d.text) AS e) AS f USING (id) GROUP BY d.id", docs=docs)
    assert {r.id: r.n for r in kept.collect() if r.id in (0, 1, 2, 4)} == {0: 0, 1: 0, 2: 0, 4: 300}


def test_rules_beyond_the_native_dialect(spark):
    TF.register(spark, [Rule("PAIR", r"(?<=x)(a)|(b)(?=y)")], "pairs")
    assert [tuple(r) for r in spark.sql("SELECT * FROM pairs('xa by b')").collect()] == [(1, 2, "a", "PAIR"), (3, 4, "b", "PAIR")]


def test_allocation_against_brute_force():
    r = random.Random(7)
    for n in (0, 1, 5, 40, 200):
        found = [{"start": (a := r.randrange(100)), "end": a + r.randrange(1, 9), "value": "", "entity_type": "", "ord": r.randrange(5)} for _ in range(n)]
        for strategy, order in (("longest", lambda c: (c["start"] - c["end"], c["start"], c["ord"])), ("priority", lambda c: (c["ord"], c["start"]))):
            taken = []
            for c in sorted(found, key=order):
                if all(c["end"] <= t["start"] or t["end"] <= c["start"] for t in taken):
                    taken.append(c)
            key = lambda c: (c["start"], c["end"])
            assert TF.accepted(found, strategy) == sorted(taken, key=key)
