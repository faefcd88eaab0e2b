import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cloakwork.operators import anonymize as A
from cloakwork.operators import policy as P
from cloakwork.operators import resolve as R
from cloakwork.operators import surrogate as X
from cloakwork.operators import vault as V
from cloakwork.sources.rules import load_pack

CALLS = "call_id string, texts array<string>"


def round_trip(spark, calls, **parameters):
    done = A.anonymize_rules(spark.createDataFrame(calls, CALLS), load_pack(), "s", **parameters).withColumn("ts", F.lit("2024-01-01 00:00:00").cast("timestamp"))
    back = A.restore(done.select("call_id", F.col("anonymized").alias("texts"), "ts"), V.put(done))
    return {r.call_id: r for r in done.collect()}, {r.call_id: r for r in back.collect()}


@pytest.mark.parametrize("realistic", [False, True])
def test_round_trip_and_consistency(spark, realistic):
    calls = [("a", ["host A: 10.0.0.1, x@y.org", "again: 10.0.0.1", None, ""]), ("b", ["nothing here"]), ("c", []), (None, ["10.0.0.2"]), ("", ["10.0.0.3"]), ("d", ["10.0.0.1 110.0.0.11 10.0.0.1."]), ("e", ["a.b+c@d.org (a.b+c@d.org.uk) [x]$ sk-aaaaaaaaaaaaaaaaaaaaaaaa"] * 3)]
    done, back = round_trip(spark, calls, use_realistic=realistic)
    for call, texts in calls:
        if call:
            assert back[call].restored == texts
    assert len(done["a"].entries) == 2 and done["b"].entries == [] and done["b"].anonymized == ["nothing here"]
    assert "10.0.0.1" not in "".join(filter(None, done["a"].anonymized))
    assert back["a"].late is False and back["b"].late is True and back["c"].late is True


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="a1.@-[]$\\ \n", max_size=40), min_size=1, max_size=3))
def test_any_text_comes_back(spark, texts):
    _, back = round_trip(spark, [("x", [*texts, "mail a@b.org to 10.1.2.3"])])
    assert back["x"].restored == [*texts, "mail a@b.org to 10.1.2.3"]


def test_tokens(spark):
    import hashlib

    row = spark.range(1).select(X.opaque(F.lit("URL"), F.lit("v"), "salt").alias("a"), X.opaque(F.lit("URL"), F.lit("v"), "pepper").alias("b")).first()
    assert row.a == f"[URL_{hashlib.sha256(b'4:saltv').hexdigest()[:8].upper()}]" != row.b
    t = X.opaque_blake2b(spark.createDataFrame([("v", "URL"), (None, "URL")], "text string, entity_type string"), "salt").collect()
    assert t[0].surrogate == f"[URL_{hashlib.blake2b(b'v', key=b'salt', digest_size=4).hexdigest().upper()}]" and t[1].surrogate is None
    assert len(X.salt_bytes(None)) == 32 and X.salt_bytes("x" * 99) == "x" * 64
    warned: list = []
    assert X.choose_locale(["xx", "de_DE"], warned) == "de_DE" and X.choose_locale(None) == "en_US" and warned


def test_realistic_values_have_their_shape(spark):
    from cloakwork.functions import text as T
    from cloakwork.model import ALWAYS_OPAQUE, ENTITY_TYPES

    shapes = {"IPV4_ADDRESS": r"\d+(\.\d+){3}", "EMAIL_ADDRESS": r"[a-z.0-9]+@example\.(com|net|org)", "UUID": r"[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-a[0-9a-f]{3}-[0-9a-f]{12}", "PHONE": r"\+1-555-\d{3}-\d{4}", "MAC_ADDRESS": "02(:[0-9a-f]{2}){5}", "PERSON": r"\w+ \w+"}
    df = spark.createDataFrame([(k, f"v{i}") for k in ENTITY_TYPES for i in range(20)], "kind string, v string")
    got = df.select("kind", X.realistic(F.col("kind"), F.col("v"), "s").alias("r")).withColumn("ok", T.valid(F.col("r"), F.col("kind"))).collect()
    import re

    for r in got:
        assert r.ok and r.r, r
        assert (r.r.startswith(f"[{r.kind}_")) == (r.kind in ALWAYS_OPAQUE), r
        assert re.fullmatch(shapes.get(r.kind, "(?s).*"), r.r), r


def test_contested_values_go_to_the_first(spark):
    names = [f"n{i}" for i in range(400)]  # more people than the vocabulary has names
    df = spark.createDataFrame([([(n, "PERSON", ["regex"]) for n in names],)], "e array<struct<text:string,entity_type:string,source_detectors:array<string>>>")
    got = df.select(X.assign(F.col("e"), "s", True).alias("a")).first().a
    assert len({g.surrogate for g in got}) == 400 and [g.original for g in got] == names
    assert any(g.surrogate.startswith("[PERSON_") and len(g.surrogate) == 25 for g in got)


def test_vault(spark):
    rows = [("a", [("s", "o", "URL", ["regex"])], "2024-01-01 00:00:00"), ("a", [("t", "o", "URL", ["regex"])], "2024-01-01 00:00:10"), ("b", [], "2024-01-01 00:00:00"), (None, [("s", "o", "URL", ["regex"])], "2024-01-01 00:00:00"), ("", [("s", "o", "URL", ["regex"])], "2024-01-01 00:00:00")]
    done = spark.createDataFrame(rows, "call_id string, entries array<struct<surrogate:string,original:string,entity_type:string,source_detectors:array<string>>>, at string").withColumn("ts", F.col("at").cast("timestamp"))
    vault = V.put(done)
    asked = spark.createDataFrame([("a", "2024-01-01 00:02:10"), ("zz", "2024-01-01 00:00:00")], "call_id string, at string").select("call_id", F.col("at").cast("timestamp").alias("ts"))
    assert [r.surrogate for r in V.peek(asked, vault).collect()] == ["t"] == [r.surrogate for r in V.peek(asked, vault).collect()]
    found, rest = V.pop(asked, vault)
    assert found.count() == 1 and rest.count() == 0 and V.peek(asked, rest).count() == 0
    assert V.peek(asked, vault, 119).count() == 0
    assert V.sweep(vault, "2024-01-01 00:02:11").count() == 0 and V.sweep(vault, "2024-01-01 00:02:10").count() == 1


def test_rows_and_arrays_dedup_alike(spark):
    rows = [("c", "a", "PERSON", "regex", 0, 0), ("c", "b", "URL", "regex", 0, 1), ("c", "a", "OTHER", "llm", 0, 2), ("c", "", "OTHER", "llm", 0, 3), ("c", "b", "URL", "llm", 1, 0)]
    df = spark.createDataFrame(rows, "call string, text string, entity_type string, detector string, t int, i int")
    by_rows = {r.text: (r.entity_type, r.source_detectors) for r in R.dedup_rows(df, ["call"], ["t", "i"]).collect()}
    array = df.orderBy("t", "i").agg(F.collect_list(F.struct("text", "entity_type", F.array("detector").alias("source_detectors"))).alias("m"))
    by_array = {m.text: (m.entity_type, m.source_detectors) for m in array.select(R.dedup(F.col("m")).alias("m")).first().m}
    assert by_rows == by_array == {"a": ("PERSON", ["regex", "llm"]), "b": ("URL", ["regex", "llm"])}


def test_blocked_calls(spark):
    runs = spark.createDataFrame([("a", "llm", "unavailable", True), ("b", "regex", "crash", True)], "call_id string, detector string, status string, fail_closed boolean")
    assert {r.call_id: r.blocked for r in P.fail_policy(runs).collect()} == {"a": True, "b": False}
