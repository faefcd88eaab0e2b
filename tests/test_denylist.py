import random
import time

from pyspark.sql import functions as F

from cloakwork.operators import denylist as N
from cloakwork.operators import detect as D
from cloakwork.sources.rules import Literal

ENTRIES = "value string, entity_type string, case_sensitive boolean, word_boundary boolean"


def table(spark, entries):
    return spark.createDataFrame([(e.value, e.entity_type, e.case_sensitive, e.word_boundary) for e in entries], ENTRIES)


def rows(df):
    return sorted((r.i, [(c.start, c.end, c.value, c.entity_type, c.ord) for c in sorted(r.candidates, key=lambda c: c.start)]) for r in df.collect())


def test_equals_the_automaton(spark):
    rnd = random.Random(4)
    letters = ["a", "b", "A", "é", "É", " ", "_", "𝄞", "1", "-"]
    entries = {}
    for _ in range(300):
        v = "".join(rnd.choices(letters, k=rnd.choice([1, 2, 3, 4, 5, 8, 9, 17])))
        e = Literal(rnd.choice("XYZ"), v, rnd.random() < 0.5, rnd.random() < 0.6)
        entries.setdefault((e.value if e.case_sensitive else N.folded(e.value), e.case_sensitive), e)
    mine = list(entries.values())
    texts = ["".join(rnd.choices(letters, k=rnd.randrange(1, 120))) for _ in range(60)] + ["", None, mine[0].value, " ".join(e.value for e in mine)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    want = rows(D.denylist(df, mine, backend="aho"))
    assert sum(len(x[1]) for x in want) > 300
    for most_bytes in (1 << 20, 0):
        assert rows(N.detect(df.repartition(3), table(spark, mine), ["i"], most_bytes=most_bytes)) == want


def test_awkward_rows(spark):
    entries = [("Bob", "PERSON", True, True), ("Bob", "OTHER", True, True), ("acme", "ORGANIZATION", False, None), (None, "X", True, True), ("", "X", True, True), ("x", None, True, True), ("Alice", "PERSON", None, False)]
    docs = [(1, "Bob, Bobby and ACME"), (1, "Bob, Bobby and ACME"), (1, "another Acme text"), (None, "Alices"), (None, None), (2, "")]
    df = spark.createDataFrame(docs, "i int, text string").withColumns({"needle": F.lit("clash"), "hits": F.lit(1), "exact": F.lit(True)})
    out = N.detect(df, spark.createDataFrame(entries, ENTRIES), ["i"])
    assert out.columns == [*df.columns, "candidates"]
    got = sorted((str(r.i), r.text or "", [(c.value, c.entity_type) for c in r.candidates]) for r in out.collect())
    whole = [("Bob", "OTHER"), ("ACME", "ORGANIZATION")]
    assert [(k, t, sorted(v)) for k, t, v in got] == [("1", "Bob, Bobby and ACME", sorted(whole))] * 2 + [("1", "another Acme text", [("Acme", "ORGANIZATION")]), ("2", "", []), ("None", "", []), ("None", "Alices", [("Alice", "PERSON")])]
    assert N.detect(df.limit(0), spark.createDataFrame(entries, ENTRIES), ["i"]).count() == 0
    assert {len(r.candidates) for r in N.detect(df, spark.createDataFrame([], ENTRIES), ["i"]).collect()} == {0}


def test_a_million_entries(spark):
    """No entry is in the plan; time follows the texts, not the entries times the texts."""
    entries = spark.range(1_000_000).select(F.concat(F.lit("name-"), F.conv(F.col("id") * 7919 + 13, 10, 36)).alias("value"), F.lit("PERSON").alias("entity_type"), (F.col("id") % 3 > 0).alias("case_sensitive"), F.lit(True).alias("word_boundary"))
    known = [r.value for r in entries.where("id % 100003 = 5").collect()]
    docs = spark.range(400).select(F.col("id").cast("int").alias("i"), F.concat(F.repeat(F.lit("prose without any name-like word, name-# "), 50), F.element_at(F.array(*map(F.lit, known)), (F.col("id") % len(known) + 1).cast("int")), F.lit(" ends.")).alias("text"))
    began = time.perf_counter()
    out = N.detect(docs, entries, ["i"])
    assert len(out._jdf.queryExecution().optimizedPlan().toString()) < 50_000
    got = out.collect()
    assert {(r.i, c.value) for r in got for c in r.candidates} == {(i, known[i % len(known)]) for i in range(400)}
    assert time.perf_counter() - began < 240
