"""Test sources: conversations from templates, a rule-driven chat model, chunks of answers, labelled corpora."""

from __future__ import annotations

from collections.abc import Iterable

import yaml
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakwork.sources.rules import RuleError, resolve

# Our own persona and templates.
PERSONAS = {
    "support": {"name": "Robin Ashford", "email": "robin.ashford@example.com", "phone": "+1-555-010-2030", "ip": "192.0.2.17", "card": "4111-1111-1111-1111"},
    "hr": {"name": "Sasha Keller", "email": "sasha.keller@example.org", "phone": "+1-555-010-4050", "ip": "198.51.100.40", "card": "5500-0000-0000-0004"},
    "tech": {"name": "Noa Lambert", "email": "noa.lambert@example.net", "phone": "+1-555-010-6070", "ip": "203.0.113.99", "card": "3782-822463-10005"},
}
TOPICS = ["account", "invoice", "login", "address", "contract", "upgrade", "refund", "report", "meeting", "password"]
USER_FORMS = ["I am {name}; please look at my {topic}.", "Write to {email} about the {topic}.", "Call {phone} before you change the {topic}, I was at {ip}."]
ANSWER_FORMS = ["Thank you, {name}. The {topic} is noted.", "A mail about the {topic} went to {email}.", "We will call {phone} about the {topic}."]


def templates() -> list[tuple[str, str, str]]:
    """scenario, user text, answer: 30 turns for each of the three scenarios, persona already filled in."""
    rows = []
    for scenario, persona in PERSONAS.items():
        for i in range(30):
            fill = persona | {"topic": TOPICS[i % len(TOPICS)]}
            rows.append((scenario, i, USER_FORMS[i // 10].format(**fill), ANSWER_FORMS[i // 10].format(**fill)))
    return rows


def conversations(spark: SparkSession, lengths: DataFrame | list[int]) -> DataFrame:
    """Name, turn, user, assistant, one conversation a scenario for each row (key, length), or length; turns beyond the 30 templates start over."""
    if isinstance(lengths, list):
        lengths = spark.createDataFrame([(n, n) for n in lengths], "key int, length int")
    bank = spark.createDataFrame(templates(), "scenario string, slot int, user string, assistant string")
    turns = lengths.where("length > 0").select("key", F.explode(F.sequence(F.lit(0), F.col("length").cast("int") - 1)).alias("turn"))
    joined = turns.withColumn("slot", F.col("turn") % 30).join(F.broadcast(bank), "slot")  # 90 rows
    return joined.select(F.concat_ws("-", "scenario", F.col("key").cast("string")).alias("name"), "turn", "user", "assistant")


def chunks(text: Column, size: int | None = None) -> Column:
    """Pieces of an answer: words with the blanks behind them, or ``size`` characters each."""
    if size is None:
        return F.regexp_extract_all(text, F.lit(r"\S+\s*|\s+"), F.lit(0))
    starts = F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1)), F.lit(size))
    return F.filter(F.transform(starts, lambda s: text.substr(s, F.lit(size))), lambda x: x != "")


def fake_model(requests: DataFrame, rules: list[dict], otherwise: str = '{"entities": []}') -> DataFrame:
    """The reply of the first rule that fits: requests (request_id, model, system, text) to (request_id, status, reply).

    A rule's texts are alternatives; model and system prompt must fit too. ``echo`` beats ``raw`` beats ``entities``.
    """
    status, reply = F.lit(200), F.lit(otherwise)
    for r in reversed(rules):
        fits = F.lit(True)
        if r.get("contains"):
            any_text = F.lit(False)
            for t in r["contains"]:
                any_text = any_text | F.contains("text", F.lit(t))
            fits = fits & any_text
        if r.get("matches"):
            fits = fits & F.col("text").rlike(r["matches"])
        if r.get("model"):
            fits = fits & (F.col("model") == r["model"])
        if r.get("system"):
            fits = fits & F.contains(F.coalesce("system", F.lit("")), F.lit(r["system"]))
        body = F.col("text") if r.get("echo") else F.lit(r["raw"]) if r.get("raw") is not None else F.to_json(F.struct(F.array(*[F.struct(F.lit(e["text"]).alias("text"), F.lit(e["type"]).alias("type")) for e in r.get("entities", [])]).alias("entities"))) if r.get("entities") else F.lit(otherwise)
        status, reply = F.when(fits, F.lit(r.get("status", 200))).otherwise(status), F.when(fits, body).otherwise(reply)
    return requests.select("request_id", status.alias("status"), reply.alias("reply"))


CASES = "case_id string, text string, expect array<struct<text:string,type:string,tolerated_miss:boolean>>, must_keep array<string>, requires array<string>"


def load_corpus(spark: SparkSession, spec: str) -> DataFrame:
    """The cases of a labelled corpus."""
    text, label, _ = resolve(spec)
    data = yaml.safe_load(text)
    if not isinstance(data, dict) or not data.get("cases"):
        raise RuleError(f"{label}: a mapping with cases is needed")
    return spark.createDataFrame(list(check_cases(data["cases"], label)), CASES)


def check_cases(cases: list, label: str) -> Iterable[tuple]:
    seen = set()
    for i, c in enumerate(cases):
        at = f"{label}, case {i}"
        if not isinstance(c, dict) or not isinstance(c.get("id"), str) or not isinstance(c.get("text"), str):
            raise RuleError(f"{at}: id and text are needed")
        if c["id"] in seen:
            raise RuleError(f"{at}: {c['id']!r} is there twice")
        seen.add(c["id"])
        expect, keep = c.get("expect") or [], c.get("must_keep") or []
        if not expect and not keep:
            raise RuleError(f"{at}: it expects nothing")
        for t in [*(e.get("text") for e in expect), *keep]:
            if not isinstance(t, str) or not t or t not in c["text"]:
                raise RuleError(f"{at}: {t!r} isn't in the text")
        yield c["id"], c["text"], [(e["text"], str(e["type"]).upper(), bool(e.get("tolerated_miss", False))) for e in expect], list(keep), list(c.get("requires") or [])
