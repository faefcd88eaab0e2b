"""Queries of request sources, remote detectors and detectors side by side."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakwork.operators import registry as G
from cloakwork.operators import remote, report
from cloakwork.operators import detect as D
from cloakwork.operators import policy, quality
from cloakwork.plans.calls import _C, NAME, OVERRIDDEN, _drain
from cloakwork.plans.detection import BARE, _deny_sql, _spans_sql
from cloakwork.plans.fixtures import frame, values
from cloakwork.plans.scores import ORACLES as SCORES
from cloakwork.plans.scores import speedups
from cloakwork.session import shared_dir, spread
from cloakwork.sources import requests
from cloakwork.sources.rules import Rule

QUERIES: dict = {}
ORACLES: dict = {}

BODIES = [
    json.dumps({"call_id": "a", "input_type": "request", "texts": ["x", "y"], "extra": {"k": 1}}),
    json.dumps({"call_id": "b", "input_type": "response", "texts": ["z"], "is_final": False}),
    json.dumps({"call_id": "c", "input_type": "response", "texts": [], "is_final": True}),
    json.dumps({"call_id": "d", "input_type": "response", "texts": ["w"], "is_final": True, "overrides": {"use_faker": True}}),
    "not json",
    json.dumps({"call_id": "e", "texts": ["l" * 400]}),
]


def _requests(spark: SparkSession, stream: bool = False) -> tuple[DataFrame, DataFrame]:
    path = f"{shared_dir(spark)}/requests-{uuid.uuid4().hex}"
    frame(spark, [(b,) for b in BODIES], "value string").write.text(path)
    return requests.read(spark, path, stream, most_bytes=300)


def request_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests from JSON lines, exploded to texts."""
    return requests.exploded(_requests(spark)[0])


def request_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S1 as a stream."""
    return _drain(requests.exploded(_requests(spark, True)[0]), "requests")


def request_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S3: what is refused."""
    return _requests(spark)[1]


def warm_final(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T3, T7."""
    return requests.warmable(_requests(spark)[0]).select("call_id", "is_final")


QUERIES |= {"request_source": request_source, "request_stream": request_stream, "request_admission": request_admission, "warm_final": warm_final}
_ACCEPTED = f"(SELECT b::JSON AS r FROM {values([(b,) for b in BODIES], ['b'])} WHERE strlen(b) <= 300 AND json_valid(b))"
ORACLES["request_source"] = ORACLES["request_stream"] = f"""SELECT r->>'call_id' AS call_id, r->>'input_type' AS input_type, CAST(r->>'is_final' AS BOOLEAN) AS is_final, CAST(i AS INTEGER) AS text_idx, r->'texts'->>i AS text
FROM {_ACCEPTED} AS x, unnest(range(0, CAST(json_array_length(r->'texts') AS BIGINT))) AS u(i)"""
ORACLES["request_admission"] = f"SELECT CAST(strlen(b) AS INTEGER) AS bytes, CASE WHEN strlen(b) > 300 THEN 'too large' ELSE 'malformed' END AS reason FROM {values([(b,) for b in BODIES[4:]], ['b'])}"
ORACLES["warm_final"] = f"SELECT r->>'call_id' AS call_id, CAST(r->>'is_final' AS BOOLEAN) AS is_final FROM {_ACCEPTED} AS x WHERE coalesce(r->>'is_final', '') <> 'false'"

ASKED = [(1, "Ann met Bob"), (2, "Ann met Bob"), (3, " \n"), (4, "please time out"), (5, "bad shape"), (6, "crash now"), (7, "nobody"), (8, None)]


def _service():
    """A recorded service: capitalised words are people."""
    import re

    def ask(text: str, arguments: dict) -> list:
        if "time out" in text:
            raise remote.Unavailable("timeout")
        if "crash" in text:
            raise KeyError("oops")
        data = {"spans": "none"} if "shape" in text else {"spans": [{"label": "private_person", "start": m.start(), "end": m.end(), "text": m[0]} for m in re.finditer("[A-Z][a-z]+", text)]}
        return remote.spans_of(data)

    return ask


def remote_detector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers and failures of a service."""
    got = remote.detect(frame(spark, ASKED, "id int, text string"), _service)
    named = F.array_join(F.transform(D.span_matches(F.col("text"), F.col("spans")), lambda m: m["text"]), ",")
    return got.select("id", "status", "error_kind", F.coalesce(named, F.lit("")).alias("people"))


QUERIES["remote_detector"] = remote_detector
ORACLES["remote_detector"] = "SELECT * FROM (VALUES (1, 'ok', NULL, 'Ann,Bob'), (2, 'ok', NULL, 'Ann,Bob'), (3, 'ok', NULL, ''), (4, 'unavailable', 'timeout', ''), (5, 'unavailable', 'shape', ''), (6, 'crash', 'KeyError', ''), (7, 'ok', NULL, ''), (8, 'ok', NULL, '')) AS v(id, status, error_kind, people)"

SIDE_BY_SIDE = "[A-Z][a-z]{9,}|tion"


def detector_fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two detectors over all turns of each conversation, narrowed row by row."""
    turns = spread(spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "text"))
    calls = turns.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda t: t["text"]).alias("texts"))
    modes = F.array(F.lit(None).cast("string"), F.lit("denylist"), F.lit("denylist,regex"), F.lit("bogus"))
    calls = calls.withColumn("detector_mode", F.split(F.get(modes, (F.col("conv_id") % 4).cast("int")), ","))
    both = [G.DenylistDetector(tuple(BARE)), G.RuleDetector((Rule("PERSON", SIDE_BY_SIDE, ("ASCII",)),))]
    found = G.detect_calls(calls, both).select("conv_id", F.explode_outer("entities").alias("e")).where("e is not null")
    return found.select("conv_id", "e.text", "e.entity_type", F.array_join("e.source_detectors", ",").alias("sources"))


QUERIES["detector_fanout"] = detector_fanout
ORACLES["detector_fanout"] = f"""
WITH h AS (SELECT doc_id // 1000 AS conv_id, doc_id % 1000 * 10 AS place, value, 'PERSON' AS kind, 'regex' AS det FROM ({_spans_sql(_C, SIDE_BY_SIDE)}) AS a WHERE doc_id // 1000 % 4 <> 1
 UNION ALL SELECT doc_id // 1000, doc_id % 1000 * 10 + 1, value, entity_type, 'denylist' FROM ({_deny_sql(BARE, _C)}) AS b),
f AS (SELECT conv_id, value, det, min(place) AS k, arg_min(kind, place) AS kind FROM h GROUP BY conv_id, value, det)
SELECT conv_id, value AS text, arg_min(kind, k) AS entity_type, string_agg(det, ',' ORDER BY k) AS sources FROM f GROUP BY conv_id, value
"""

NAMES = "[A-Z][a-z]+(?: [A-Z][a-z]+)*"


def _tagger():
    """A recorded service: words with their tags; neighbouring capitalised words are one person."""
    import re

    def ask(text: str, arguments: dict) -> list:
        rows = []
        for m in re.finditer(f"{NAMES}|[^A-Z ]+|[A-Z ]", text):
            words = [(w.start() + m.start(), w.end() + m.start()) for w in re.finditer("[^ ]+", m[0])] if re.fullmatch(NAMES, m[0]) else []
            marks = "S" if len(words) == 1 else "B" + "I" * (len(words) - 2) + "E"
            rows += [{"label": f"{k}-private_person", "start": a, "end": b} for k, (a, b) in zip(marks, words)] or [{"label": "O", "start": m.start(), "end": m.end()}]
        return rows

    return ask


def tag_service(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A service that classifies tokens, over all turns; its tags are put together here."""
    turns = spread(spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "text"))
    tokens = F.transform("spans", lambda s: F.struct(s["label"].alias("tag"), s["start"].alias("start"), s["end"].alias("end")))
    found = remote.detect(turns, _tagger).select("conv_id", "turn", F.explode(D.decode_tags(F.col("text"), tokens)).alias("s"))
    return found.select("conv_id", "turn", "s.start", F.col("s.end").alias("stop"), F.col("s.text").alias("value"))


QUERIES["tag_service"] = tag_service
ORACLES["tag_service"] = f"SELECT doc_id // 1000 AS conv_id, doc_id % 1000 AS turn, start, stop, value FROM ({_spans_sql(_C, NAMES)}) AS a"


def headline_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K5, L4: the report written as JSON and read again."""
    path = f"{shared_dir(spark)}/report-{uuid.uuid4().hex}"
    sorted_ = report.headline(speedups(spark, sf_dir))
    report.write_json(sorted_, path)
    return spark.read.schema(sorted_.schema).json(path)


QUERIES["headline_report"] = headline_report
ORACLES["headline_report"] = SCORES["speedups"]


def merged_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names in whole conversations, looked at once, or turn by turn where they are long."""
    calls = spark.read.parquet(f"{sf_dir}/conversations.parquet").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda t: t["text"]).alias("texts"))
    found = G.detect_merged(calls, G.RuleDetector((Rule("PERSON", NAME), Rule("OTHER", "ANONYMIZER-[A-Z-]+"))), 3000)
    return found.select("conv_id", F.explode_outer("entities").alias("e")).where("e is not null").select("conv_id", "e.text", "e.entity_type")


QUERIES["merged_detect"] = merged_detect
ORACLES["merged_detect"] = f"SELECT DISTINCT doc_id // 1000 AS conv_id, value AS text, 'PERSON' AS entity_type FROM ({_spans_sql(_C, NAME)}) AS a"


def override_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L3: the first problem of each override, by what kind it is."""
    rows = frame(spark, [r[:2] for r in OVERRIDDEN], "key string, value string")
    problem = policy.override_problem(F.col("key"), F.col("value"))
    return rows.select("key", "value", problem.alias("problem"))


_PROBLEMS = [(k, v, None if e is not None or v in ('"  "', '""') else "unknown override" if k == "unknown" else "not JSON" if v == "broken[" else "length 4 exceeds cap of 3" if "d" in v and k == "faker_locale" else "length 6 exceeds cap of 5" if k == "detector_mode" else "wrong type or value") for k, v, e in OVERRIDDEN]
QUERIES["override_problems"] = override_problems
ORACLES["override_problems"] = f"SELECT * FROM {values(_PROBLEMS, ['key', 'value', 'problem'])}"

RESULTS = [("a", False, False, 2, 2), ("b", True, False, 3, 0), ("c", False, True, 4, 0), ("d", None, None, 2, 1)]


def scored_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Skipped and blocked cases don't count."""
    rows = frame(spark, RESULTS, "case_id string, skipped boolean, blocked boolean, expected int, redacted int")
    return quality.scored(rows).agg(F.count("*").alias("cases"), F.round(F.try_divide(F.sum("redacted"), F.sum("expected")), 6).alias("recall"))


QUERIES["scored_cases"] = scored_cases
ORACLES["scored_cases"] = f"SELECT count(*) AS cases, round(sum(redacted) / sum(expected), 6) AS recall FROM {values(RESULTS, ['case_id', 'skipped', 'blocked', 'expected', 'redacted'])} WHERE NOT coalesce(skipped, false) AND NOT coalesce(blocked, false)"
