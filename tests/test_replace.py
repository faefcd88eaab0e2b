import random
import re
import time

from pyspark.sql import functions as F

from cloakwork.functions import spans as S

SCHEMA = "i int, text string, entries array<struct<original:string,surrogate:string>>"


def brute(text, pairs):
    """An alternation of the keys, the longest first, as one pass of ``re``."""
    keys = sorted({a for a, _ in pairs if a}, key=len, reverse=True)
    if text is None or not keys:
        return text
    return re.sub("|".join(map(re.escape, keys)), lambda m: dict(pairs)[m[0]], text)


def replaced(df):
    return {r.i: r.out for r in df.select("i", S.replace_all(F.col("text"), F.col("entries"), "original", "surrogate").alias("out")).collect()}


def test_equals_an_alternation(spark):
    """Keys that overlap each other and themselves, stand within others, or are marks that the search uses itself."""
    rnd = random.Random(6)
    letters = ["a", "b", "é", "𝄞", ".", S.BEGIN]
    rows = []
    for i in range(250):
        keys = {"".join(rnd.choices(letters, k=rnd.choice([1, 2, 2, 3, 4, 5]))) for _ in range(rnd.randrange(0, 7))}
        rows.append((i, "".join(rnd.choices(letters[: rnd.choice([2, 4, 6])], k=rnd.randrange(0, 60))), [(k, f"<{n}>") for n, k in enumerate(sorted(keys))]))
    rows += [(1000, None, [("a", "x")]), (1001, "abc", []), (1002, "", [("a", "x")]), (1003, "abc", [("", "x"), ("b", "a")]), (1004, "aaa" * 2000, [("aa", "b"), ("aaa", "c")])]
    df = spark.createDataFrame(rows, SCHEMA)
    assert replaced(df) == {i: brute(t, e) for i, t, e in rows}
    assert replaced(df.withColumn("entries", F.lit(None).cast("array<struct<original:string,surrogate:string>>")))[1001] == "abc"


def test_five_thousand_originals(spark):
    keys = [f"user{i}@example{i % 7}.org" for i in range(5000)]
    text = " and ".join(f"mail {k}." for k in reversed(keys))
    df = spark.createDataFrame([(1, text, [(k, f"[EMAIL_{i}]") for i, k in enumerate(keys)])], SCHEMA)
    replaced(df.withColumn("text", F.substring("text", 1, 100)))
    began = time.perf_counter()
    got = replaced(df)[1]
    assert time.perf_counter() - began < 30
    assert got == " and ".join(f"mail [EMAIL_{i}]." for i in reversed(range(5000)))
