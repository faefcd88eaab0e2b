"""Detectors behind a service: a client per task, failures as data, each distinct text asked once.

A client is made on the executor by a factory, once a task; it gets a text and the call's arguments and returns rows, or
raises. What it raises becomes a kind of failure, so that a table of results never hides an outage.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPANS = "array<struct<label:string,start:int,end:int,text:string,score:double>>"
SPAN_ARROW = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("text", pa.string()), ("score", pa.float64())]))


class Unavailable(Exception):
    """The service can't answer. kind: connect, timeout, http, status, json, shape or other."""

    def __init__(self, kind: str, message: str = ""):
        super().__init__(message or kind)
        self.kind = kind


def http_client(url: str, timeout: float = 30.0, headers: dict | None = None) -> Callable[[str, dict], list]:
    """A client of a service that takes {"text": ..., **arguments} and answers {"spans": [...]} or {"matches": [...]}."""

    def ask(text: str, arguments: dict) -> list:
        return spans_of(_post(url, {"text": text} | {k: v for k, v in arguments.items() if v is not None}, timeout, headers or {}))

    return ask


def _post(url: str, body: dict, timeout: float, headers: dict) -> object:
    """The JSON that a service answers with; any failure is an Unavailable of its kind."""
    import urllib.error
    import urllib.request

    request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json"} | headers)
    try:
        with urllib.request.urlopen(request, timeout=timeout) as answer:
            if answer.status != 200:
                raise Unavailable("status", str(answer.status))
            raw = answer.read()
    except urllib.error.HTTPError as x:
        raise Unavailable("status", str(x.code)) from x
    except TimeoutError as x:
        raise Unavailable("timeout") from x
    except urllib.error.URLError as x:
        raise Unavailable("timeout" if isinstance(x.reason, TimeoutError) else "connect", str(x.reason)) from x
    try:
        return json.loads(raw)
    except ValueError as x:
        raise Unavailable("json") from x


def chat_body(text: Column, model: Column, prompt: Column) -> Column:
    """The request to a chat model as JSON: temperature 0, an object as answer, the prompt and then the text."""
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return F.to_json(F.struct(model.alias("model"), F.lit(0).alias("temperature"), F.struct(F.lit("json_object").alias("type")).alias("response_format"), F.array(message("system", prompt), message("user", text)).alias("messages")))


def chat_client(url: str, model: str, prompt: str, key: str | None = None, timeout: float = 30.0) -> Callable[[str, dict], list]:
    """A client of a chat model that answers with entities; arguments llm_model, llm_prompt and llm_key override.

    Rows have a label and a text and no place; what doesn't stand in the text is dropped (P11). An answer that isn't the wanted
    object is a failure, not an empty result.
    """

    def ask(text: str, arguments: dict) -> list:
        told = {k: arguments.get(f"llm_{k}") or v for k, v in (("model", model), ("prompt", prompt), ("key", key))}
        body = {"model": told["model"], "temperature": 0, "response_format": {"type": "json_object"}, "messages": [{"role": "system", "content": told["prompt"]}, {"role": "user", "content": text}]}
        data = _post(url, body, timeout, {"Authorization": f"Bearer {told['key']}"} if told["key"] else {})
        try:
            reply = data["choices"][0]["message"]["content"]
            found = json.loads(reply[reply.index("{") : reply.rindex("}") + 1]).get("entities", [])
        except (KeyError, IndexError, TypeError, AttributeError, ValueError) as x:
            raise Unavailable("shape") from x
        if not isinstance(found, list):
            raise Unavailable("shape")
        said = [(str(e.get("text") or "").strip(), str(e.get("type") or "OTHER")) for e in found if isinstance(e, dict)]
        return [{"label": t, "text": x} for x, t in said if x and x in text]

    return ask


def spans_of(data: object) -> list:
    """The list of rows in an answer; anything else is a failure of shape."""
    found = data.get("spans", data.get("matches")) if isinstance(data, dict) else None
    if not isinstance(found, list) or not all(isinstance(x, dict) for x in found):
        raise Unavailable("shape")
    return found


def _row(x: dict) -> dict:
    number = lambda v: v if isinstance(v, int) and not isinstance(v, bool) else None
    score = x.get("score")
    return {"label": str(x.get("label", x.get("entity_type", "")) or ""), "start": number(x.get("start")), "end": number(x.get("end")), "text": None if x.get("text") is None else str(x["text"]), "score": float(score) if isinstance(score, (int, float)) and not isinstance(score, bool) else None}


def detect(texts: DataFrame, make_client: Callable[[], Callable[[str, dict], list]], arguments: dict | None = None, text: str = "text", at_once: int | None = None) -> DataFrame:
    """Adds status (ok, unavailable or crash), error_kind and spans.

    Blank texts are ok and empty without asking (P1). Each distinct text is asked once and joined back, which is the memory of
    a job; ``at_once`` bounds the tasks that ask at the same time.
    """
    asked = texts.where(F.btrim(text, F.lit(" \t\n\r\x0b\x0c")) != "").select(F.col(text).alias("__asked")).distinct()
    if at_once:
        asked = asked.repartition(at_once)
    known = dict(arguments or {})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ask = make_client()
        for b in batches:
            status, kinds, rows = [], [], []
            for t in b.column(0).to_pylist():
                try:
                    found, state, kind = [_row(x) for x in ask(t, known)], "ok", None
                except Unavailable as x:
                    found, state, kind = [], "unavailable", x.kind
                except Exception as x:  # a failure of the client itself is data too
                    found, state, kind = [], "crash", type(x).__name__
                status.append(state)
                kinds.append(kind)
                rows.append(found)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(status), pa.array(kinds, pa.string()), pa.array(rows, SPAN_ARROW)], names=["__asked", "status", "error_kind", "spans"])

    answers = asked.mapInArrow(run, f"__asked string, status string, error_kind string, spans {SPANS}")
    joined = texts.join(answers, F.col(text) == F.col("__asked"), "left").drop("__asked")
    return joined.withColumns({"status": F.coalesce("status", F.lit("ok")), "spans": F.coalesce("spans", F.array().cast(SPANS))})
