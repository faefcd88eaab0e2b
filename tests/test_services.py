import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest

from cloakwork.operators import registry as G
from cloakwork.operators import remote, report
from cloakwork.sources import requests, synthetic
from cloakwork.sources.rules import Literal, Rule


class Handler(BaseHTTPRequestHandler):
    def do_POST(self):
        if self.path == "/chat":
            return self.chat()
        text = json.loads(self.rfile.read(int(self.headers["Content-Length"])))["text"]
        status, body = {"good": (200, b'{"spans": [{"label": "x", "start": 0, "end": 4, "text": "good"}]}'), "busy": (503, b""), "junk": (200, b"<html>"), "odd": (200, b"[]")}[text]
        self.send_response(status)
        self.end_headers()
        self.wfile.write(body)

    def chat(self):
        """Says what it was asked; a user text in braces is the answer."""
        asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        text = asked["messages"][1]["content"]
        told = json.dumps({"entities": [{"text": f"{asked['model']}", "type": "M"}, {"text": asked["messages"][0]["content"], "type": "P"}, {"text": self.headers["Authorization"], "type": "K"}, {"text": "nowhere", "type": "X"}, "odd"]})
        reply = text if text.startswith("{") else f"Sure: {told}"
        self.send_response(200)
        self.end_headers()
        self.wfile.write(json.dumps({"choices": [{"message": {"content": reply}}]} if text != "none" else {}).encode())

    def log_message(self, *args):
        pass


@pytest.fixture(scope="module")
def url():
    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/detect"
    server.shutdown()


def test_failures_of_a_service_are_data(spark, url):
    df = spark.createDataFrame([(1, "good"), (2, "busy"), (3, "junk"), (4, "odd"), (5, " "), (6, None), (7, "good")], "i int, text string")
    got = {r.i: r for r in remote.detect(df, lambda: remote.http_client(url), at_once=2).collect()}
    assert [(got[i].status, got[i].error_kind, len(got[i].spans)) for i in range(1, 8)] == [("ok", None, 1), ("unavailable", "status", 0), ("unavailable", "json", 0), ("unavailable", "shape", 0), ("ok", None, 0), ("ok", None, 0), ("ok", None, 1)]
    closed = remote.detect(df.where("i = 1"), lambda: remote.http_client("http://127.0.0.1:9/")).first()
    assert (closed.status, closed.error_kind) == ("unavailable", "connect")


def test_registry():
    a, b = G.DenylistDetector((Literal("A", "x"),)), G.RuleDetector((Rule("A", "x"),))
    assert [d.name for d in G.ranked([a, b, a])] == ["regex", "denylist"]
    with pytest.raises(ValueError):
        G.ranked([G.RecordedDetector("bogus", lambda t: t)])
    with pytest.raises(ValueError):
        G.DetectorSpec("llm", can_be_unavailable=True)
    with pytest.raises(ValueError):
        G.DetectorSpec("bogus")


def test_reports(spark):
    df = spark.createDataFrame([(1, "a|b"), (2, None)], "n int, s string")
    assert report.markdown(df.orderBy("n")) == "| n | s |\n|-|-|\n| 1 | a\\|b |\n| 2 |  |"
    with pytest.raises(ValueError):
        report.markdown(df, most=1)


def test_requests_without_rows(spark, tmp_path):
    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "a.txt").write_text("")
    good, bad = requests.read(spark, str(tmp_path / "r"))
    assert good.count() == 0 == bad.count() and requests.exploded(good).count() == 0


def test_chunks(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("",), ("a  b\nc ",), (" x",), ("é" * 15,)], "t string")
    got = df.select(synthetic.chunks(F.col("t")).alias("w"), synthetic.chunks(F.col("t"), 7).alias("f")).collect()
    assert [r.w for r in got] == [[], ["a  ", "b\n", "c "], [" ", "x"], ["é" * 15]] and [len(r.f) for r in got] == [0, 1, 1, 3]


def test_chat_client(spark, url):
    """Model, prompt and key, from the client or from the call; entities that aren't in the text are dropped."""
    texts = ["m1 under p1 with Bearer k1", "m2 under p2 with Bearer k2", '{"entities": {}}', '{"entities": []}', "none", "{broken"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    make = lambda: remote.chat_client(url.replace("/detect", "/chat"), "m1", "p1", "k1")
    own = {r.i: (r.status, r.error_kind, [(s.label, s.text) for s in r.spans]) for r in remote.detect(df, make).collect()}
    assert own[0] == ("ok", None, [("M", "m1"), ("P", "p1"), ("K", "Bearer k1")]) and own[1] == ("ok", None, [])
    assert own[2] == own[4] == own[5] == ("unavailable", "shape", []) and own[3] == ("ok", None, [])
    other = {r.i: [s.text for s in r.spans] for r in remote.detect(df, make, {"llm_model": "m2", "llm_prompt": "p2", "llm_key": "k2"}).collect()}
    assert other[1] == ["m2", "p2", "Bearer k2"] and other[0] == []


def test_store(spark, tmp_path):
    from cloakwork.operators.storage import TableStore

    store = TableStore(spark, str(tmp_path / "s"), "k string, v int, put_ts timestamp", ["k"], ttl_seconds=60)
    rows = lambda *r: spark.createDataFrame(list(r), "k string, v int, at string").selectExpr("k", "v", "cast(at as timestamp) as put_ts", "1 as extra")
    assert store.rows().count() == 0
    store.compact()
    store.put(rows(("a", 1, "2024-01-01 00:00:00"), ("b", 1, "2024-01-01 00:00:00"), (None, 5, "2024-01-01 00:00:30")))
    store.put(rows(("a", 2, "2024-01-01 00:00:30"), ("a", 3, "2024-01-01 00:00:30")))
    (tmp_path / "s" / "put-unfinished").mkdir()
    want = [(None, 5), ("a", 3), ("b", 1)]
    for _ in range(2):
        assert sorted(((r.k, r.v) for r in store.rows().collect()), key=str) == sorted(want, key=str)
        store.compact()
    assert sorted((r.v for r in store.rows("2024-01-01 00:01:10").collect())) == [3, 5]


def test_detectors_side_by_side(spark):
    """Each call is narrowed by its own detector_mode; a text keeps its first type and all of its sources."""
    both = [G.DenylistDetector((Literal("ORGANIZATION", "Ann"), Literal("OTHER", "x1"))), G.RuleDetector((Rule("PERSON", "[A-Z][a-z]+"),))]
    texts = [None, "", "x1 met Ann", "Bob, Ann"]
    calls = spark.createDataFrame([(1, texts, None), (2, texts, ["denylist"]), (3, texts, ["denylist", "regex"]), (4, texts, ["bogus"]), (5, [], None), (6, None, None)], "i int, texts array<string>, detector_mode array<string>")
    got = {r.i: r.found and [tuple(e) for e in r.found] for r in G.detect_calls(calls, both, "found").collect()}
    all_ = [("Ann", "PERSON", ["regex", "denylist"]), ("x1", "OTHER", ["denylist"]), ("Bob", "PERSON", ["regex"])]
    assert got[1] == got[3] == got[4] == all_ and got[5] == [] and got[6] is None
    assert got[2] == [("Ann", "ORGANIZATION", ["denylist"]), ("x1", "OTHER", ["denylist"])]  # longer ones come first in a text
    assert [tuple(e) for e in G.detect_calls(calls.drop("detector_mode").where("i = 2"), both).first().entities] == all_


def test_merged_texts(spark):
    """Short calls are looked at once, with matches over the break dropped; longer ones text by text."""
    rule = G.RuleDetector((Rule("PERSON", r"[A-Z][a-z]+"), Rule("OTHER", r"(?s)end.*start"), Rule("PROJECT", "ANONYMIZER-[A-Z-]+")))
    calls = spark.createDataFrame([(1, ["Ann, Bob", None, "Ann"]), (2, ["the end", "start"]), (3, ["Ann " * 30, "Bob"]), (4, []), (5, None)], "i int, texts array<string>")
    got = {r.i: r.entities and [tuple(e) for e in r.entities] for r in G.detect_merged(calls, rule, 100).collect()}
    ann, bob = ("Ann", "PERSON", ["regex"]), ("Bob", "PERSON", ["regex"])
    assert got == {1: [ann, bob], 2: [], 3: [ann, bob], 4: [], 5: []}
