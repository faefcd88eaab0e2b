"""Queries of recorded model outputs: span merging, zero-shot rows, tag decoding, chat replies, merged calls."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakwork.functions import spans as S
from cloakwork.functions import text as T
from cloakwork.model import MERGE_GAPS, SENTINEL, SPAN_LABELS, ZERO_SHOT_LABELS
from cloakwork.operators import detect as D
from cloakwork.plans.detection import _spans_sql
from cloakwork.plans.fixtures import frame, values
from cloakwork.session import spread
from cloakwork.sources import synthetic

QUERIES: dict = {}
ORACLES: dict = {}

TEXTS = [
    (1, "Please ask for Nora Lindqvist at the desk"),
    (2, "reviewers: Omar / Petra signed"),
    (3, "Ship it to 48 Quarry Row, Eastmere."),
    (4, "Guests: Ines, Tomas"),
    (5, "Lists: ann.w@example.com kim@example.org both"),
    (6, "Dear Nora    Lindqvist, hello"),
    (7, "Due 2031-02-08\n\nNotes: none so far."),
    (8, "Signed by Nora\nLindqvist today"),
    (9, "Petra petra@example.org"),
    (10, "é Ines and  Tomas,"),
]
#: What a model says of these texts: a label and where the part stands.
PARTS = [
    (1, "private_person", "Nora"), (1, "private_person", "Lindqvist"), (2, "private_person", "Omar"), (2, "private_person", "Petra"), (3, "private_address", "48 Quarry Row"), (3, "private_address", "Eastmere"),
    (4, "private_person", "Ines"), (4, "private_person", "Tomas"), (5, "private_email", "ann.w@example.com"), (5, "private_email", "kim@example.org"), (6, "private_person", "Nora"), (6, "private_person", "Lindqvist"),
    (7, "private_date", "2031-02-08\n\nNotes: none"), (8, "private_person", "Nora"), (8, "private_person", "Lindqvist"), (9, "private_person", "Petra"), (9, "private_email", "petra@example.org"), (10, "strange", " Tomas,"),
]
RAW = [(i, label, (at := dict(TEXTS)[i].index(part)), at + len(part), None) for i, label, part in PARTS]
RAW += [(10, "private_person", None, None, " Ines "), (10, "private_person", 3, 99, "nobody"), (10, "", 0, 1, None)]


def _recorded(spark: SparkSession) -> DataFrame:
    raw = frame(spark, RAW, "id int, label string, start int, end int, text string").groupBy("id").agg(F.collect_list(F.struct("label", "start", "end", "text")).alias("spans"))
    return frame(spark, TEXTS, "id int, text string").join(raw, "id")


def ner_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D9."""
    return _recorded(spark).select("id", F.explode(D.extract_spans(F.col("text"), F.col("spans"))).alias("s")).select("id", "s.start", F.col("s.end").alias("stop"), "s.entity_type")


def ner_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D10."""
    t = F.col("text")
    return _recorded(spark).select("id", F.explode(D.merge_spans(t, D.extract_spans(t, F.col("spans")))).alias("s")).select("id", "s.start", F.col("s.end").alias("stop"), "s.entity_type")


def ner_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D9 to D12, P2, P3."""
    return _recorded(spark).select("id", F.explode(D.span_matches(F.col("text"), F.col("spans"))).alias("m")).select("id", "m.text", "m.entity_type")


QUERIES |= {"ner_extract": ner_extract, "ner_merge": ner_merge, "ner_matches": ner_matches}
_label = "CASE label " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in SPAN_LABELS.items()) + " ELSE 'OTHER' END"
_gap = "CASE entity_type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in MERGE_GAPS.items()) + " ELSE 1 END"
_EXTRACT = f"""t AS (SELECT * FROM {values(TEXTS, ['id', 'body'])}), r AS (SELECT * FROM {values(RAW, ['id', 'label', 's', 'e', 'said'])}),
x AS (SELECT id, body, {_label} AS entity_type, s, e, trim(coalesce(said, '')) AS said, s IS NOT NULL AND e IS NOT NULL AND s >= 0 AND e <= length(body) AND s < e AS usable FROM r JOIN t USING (id) WHERE label <> ''),
placed AS (SELECT id, body, entity_type, CASE WHEN usable THEN s ELSE instr(body, said) - 1 END AS start, CASE WHEN usable THEN e ELSE instr(body, said) - 1 + length(said) END AS stop FROM x WHERE usable OR (said <> '' AND instr(body, said) > 0))"""
ORACLES["ner_extract"] = f"WITH {_EXTRACT} SELECT id, CAST(start AS INTEGER) AS start, CAST(stop AS INTEGER) AS stop, entity_type FROM placed"
_MERGE = f"""{_EXTRACT},
lagged AS (SELECT *, lag(stop) OVER w AS before, lag(entity_type) OVER w AS was FROM placed WINDOW w AS (PARTITION BY id ORDER BY start, stop)),
flagged AS (SELECT *, substr(body, CAST(before + 1 AS BIGINT), CAST(start - before AS BIGINT)) AS gap FROM lagged),
grouped AS (SELECT *, sum(CASE WHEN was = entity_type AND start >= before AND (start = before OR (length(gap) <= {_gap} AND NOT contains(gap, chr(10) || chr(10))
     AND trim(gap, CASE WHEN entity_type = 'ADDRESS' THEN ' ,' || chr(9) || chr(10) || chr(13) ELSE ' ' || chr(9) || chr(10) || chr(13) END) = '')) THEN 0 ELSE 1 END) OVER (PARTITION BY id ORDER BY start, stop) AS g FROM flagged),
merged AS (SELECT id, body, min(start) AS start, max_by(stop, (start, stop)) AS stop, any_value(entity_type) AS entity_type FROM grouped GROUP BY id, body, g)"""
ORACLES["ner_merge"] = f"WITH {_MERGE} SELECT id, CAST(start AS INTEGER) AS start, CAST(stop AS INTEGER) AS stop, entity_type FROM merged"
ORACLES["ner_matches"] = f"""
WITH {_MERGE}, cut AS (SELECT id, entity_type, trim(unnest(string_split_regex(substr(body, CAST(start + 1 AS BIGINT), CAST(stop - start AS BIGINT)), '\\n{{2,}}'))) AS v FROM merged)
SELECT id, CASE WHEN entity_type IN ('CREDENTIAL', 'TOKEN', 'PATH', 'IDENTIFIER', 'OTHER') THEN v ELSE rtrim(v, '.,;!?') END AS text, entity_type FROM cut WHERE v <> ''
"""

ZERO = [(1, "Call Ann at 555-0100 now", "Ann", "person", 5, 8, 0.9), (1, "Call Ann at 555-0100 now", "555-0100", "phone_number", 12, 20, 0.6), (1, "Call Ann at 555-0100 now", "Bob", "person", 5, 8, 0.9), (1, "Call Ann at 555-0100 now", "now", "mood", 21, 24, 0.8), (2, "Ann.", "Ann", "person", 0, 3, 0.3), (2, "Ann.", "Ann.", "SSN", 0, 4, 0.7)]


def zero_shot_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S17, P12, D14."""
    rows = frame(spark, ZERO, "id int, body string, text string, entity_type string, start int, end int, score double").groupBy("id", "body").agg(F.collect_list(F.struct("text", "entity_type", "start", "end", "score")).alias("m"))
    return rows.select("id", F.explode(D.zero_shot_matches(F.col("body"), F.col("m"), ["person", "phone_number", "mood", "SSN"], 0.5)).alias("m")).select("id", "m.text", "m.entity_type")


QUERIES["zero_shot_filter"] = zero_shot_filter
_zero = "CASE lower(kind) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in ZERO_SHOT_LABELS.items()) + " ELSE 'OTHER' END"
ORACLES["zero_shot_filter"] = f"""
SELECT id, CASE WHEN {_zero} = 'OTHER' THEN said ELSE rtrim(said, '.,;!?') END AS text, {_zero} AS entity_type FROM {values(ZERO, ['id', 'body', 'said', 'kind', 's', 'e', 'score'])}
WHERE score >= 0.5 AND kind IN ('person', 'phone_number', 'mood', 'SSN') AND trim(substr(body, s + 1, e - s)) = said AND contains(body, said)
"""

WORD = r"[^\x20\x09-\x0D]+"
#: Tags by a word's length; those of thirteen characters stand at (0, 0), as padding does.
TAGS = ["O", "B-person", "I-person", "E-person", "S-place", "I-place", "B-place", "X-person", None, "E-place", "I-person"]


def bioes_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of each turn, tagged by their lengths, stray and open tags among them."""
    turns = spread(spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "text"))
    n = lambda w: F.length(w["value"])
    at = lambda w, end: F.when(n(w) == 13, 0).otherwise(w[end])
    tag = lambda w: F.get(F.array(*map(F.lit, TAGS)), n(w) % len(TAGS))
    words = turns.select("conv_id", "turn", "text", S.find(F.col("text"), WORD, "OTHER", 0).alias("w"))
    tokens = words.withColumn("tokens", F.transform("w", lambda w: F.struct(tag(w).alias("tag"), at(w, "start").alias("start"), at(w, "end").alias("end"))))
    return tokens.select("conv_id", "turn", F.explode(D.decode_tags(F.col("text"), F.col("tokens"))).alias("s")).select("conv_id", "turn", "s.label", "s.start", F.col("s.end").alias("stop"), "s.text")


QUERIES["bioes_decode"] = bioes_decode
_blank = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_tags = ", ".join("NULL" if t is None else f"'{t}'" for t in TAGS)
ORACLES["bioes_decode"] = f"""
WITH w AS (SELECT doc_id, length(value) AS n, start, stop, row_number() OVER (PARTITION BY doc_id ORDER BY start) AS i FROM ({_spans_sql("(SELECT conv_id * 1000 + turn AS doc_id, text FROM conversations)", WORD)}) AS a),
t AS (SELECT doc_id, i, coalesce([{_tags}][CAST(n % {len(TAGS)} AS INTEGER) + 1], 'O') AS tag, CASE WHEN n = 13 THEN 0 ELSE start END AS start, CASE WHEN n = 13 THEN 0 ELSE stop END AS stop FROM w),
m AS (SELECT *, left(tag, 1) AS mark, substr(tag, 3) AS base FROM t WHERE (stop > 0 OR i = 1) AND left(tag, 1) IN ('O', 'B', 'I', 'E', 'S')),
o AS (SELECT *, lag(CASE WHEN mark IN ('B', 'I') THEN base END) OVER (PARTITION BY doc_id ORDER BY i) AS was FROM m),
g AS (SELECT *, sum(CASE WHEN mark IN ('I', 'E') AND was = base THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM o WHERE mark <> 'O'),
s AS (SELECT doc_id, any_value(base) AS label, arg_min(start, i) AS start, arg_max(stop, i) AS stop FROM g GROUP BY doc_id, g),
b AS (SELECT s.*, conv_id, turn, substr(text, start + 1, stop - start) AS body FROM s JOIN conversations ON doc_id = conv_id * 1000 + turn)
SELECT conv_id, turn, label, CAST(start + length(body) - length(ltrim(body, {_blank})) AS INTEGER) AS start,
  CAST(greatest(stop - (length(body) - length(rtrim(body, {_blank}))), start + length(body) - length(ltrim(body, {_blank}))) AS INTEGER) AS stop, trim(body, {_blank}) AS text FROM b"""

REPLIES = [
    (1, "mail bob@x.org to Bob", '{"entities": [{"text": "bob@x.org", "type": "EMAIL_ADDRESS"}, {"text": "Bob", "type": "PERSON"}]}'),
    (2, "host db1 is down.", '<think>{"entities": 1}</think>Sure:\n```json\n{"entities": [{"text": " db1 ", "type": "HOSTNAME"}]}\n```'),
    (3, "nothing here", '{"entities": [{"text": "invented", "type": "PERSON"}]}'),
    (4, "x", "I can't do that."),
    (5, "x", '{"entities": [{"text": "x"'),
    (6, "x", "<entities><x/></entities>"),
    (7, "x", '{"entities": {"text": "x"}}'),
    (8, "pay Eve.", '{"entities": ["Eve", 3, {"text": "Eve.", "type": "PERSON"}, {"type": "PERSON"}, {"text": "pay"}]}'),
    (9, "x", "{}"),
    (10, "x", None),
]
PARSED = [(1, "ok", "bob@x.org", "EMAIL_ADDRESS"), (1, "ok", "Bob", "PERSON"), (2, "ok", "db1", "HOSTNAME"), (3, "ok", None, None), (4, "unavailable", None, None), (5, "unavailable", None, None), (6, "unavailable", None, None), (7, "unavailable", None, None), (8, "ok", "Eve", "PERSON"), (8, "ok", "pay", "OTHER"), (9, "ok", None, None), (10, "unavailable", None, None)]


def llm_reply_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D16, P11, against results worked out by hand."""
    rows = frame(spark, REPLIES, "id int, source string, reply string")
    status, matches = D.llm_matches(F.col("source"), F.col("reply"))
    return rows.select("id", status.alias("status"), F.explode_outer(F.when(status == "ok", matches)).alias("m")).select("id", "status", "m.text", "m.entity_type")


QUERIES["llm_reply_parse"] = llm_reply_parse
ORACLES["llm_reply_parse"] = f"SELECT * FROM {values(PARSED, ['id', 'status', 'text', 'entity_type'])}"


def hallucination_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P11 over conversations: the first words of each turn, looked for in its own and in another text."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", F.substring_index("text", " ", 2).alias("entity"), F.concat_ws(" ", F.col("text"), F.lit("Thank you.")).alias("source"))
    return rows.select("conv_id", "turn", T.grounded(F.col("entity"), F.col("source")).alias("own"), T.grounded(F.col("entity"), F.lit("Thank you.")).alias("other"))


QUERIES["hallucination_guard"] = hallucination_guard
ORACLES["hallucination_guard"] = """
SELECT conv_id, turn, e <> '' AND contains(concat_ws(' ', text, 'Thank you.'), e) AS own, e <> '' AND contains('Thank you.', e) AS other
FROM (SELECT *, array_to_string(string_split(text, ' ')[1:2], ' ') AS e FROM conversations)
"""


def merged_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One text a conversation, whether it is short enough for one request, and the separators in it."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda t: t["text"]).alias("texts"))
    blob = D.merged_text(F.col("texts"))
    return rows.select("conv_id", F.length(blob).cast("bigint").alias("n_chars"), F.when(F.length(blob) > 3000, "per_text").otherwise("merged").alias("mode"), (F.size(F.split(blob, SENTINEL)) - 1).cast("bigint").alias("n_breaks"))


QUERIES["merged_mode"] = merged_mode
ORACLES["merged_mode"] = f"""
SELECT conv_id, length(b) AS n_chars, CASE WHEN length(b) > 3000 THEN 'per_text' ELSE 'merged' END AS mode, CAST(len(string_split(b, '{SENTINEL}')) - 1 AS BIGINT) AS n_breaks
FROM (SELECT conv_id, string_agg(text, chr(10) || chr(10) || '--- {SENTINEL} ---' || chr(10) || chr(10) ORDER BY turn) AS b FROM conversations GROUP BY conv_id)
"""


def chunk_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both ways of cutting answers."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").where("role = 'assistant'")
    words, fixed = synthetic.chunks(F.col("text")), synthetic.chunks(F.col("text"), 7)
    return rows.select("conv_id", "turn", F.size(words).cast("bigint").alias("n_words"), F.array_join(words, "|").alias("words"), F.size(fixed).cast("bigint").alias("n_fixed"), F.array_join(fixed, "|").alias("fixed"))


QUERIES["chunk_split"] = chunk_split
ORACLES["chunk_split"] = r"""
SELECT conv_id, turn, CAST(len(w) AS BIGINT) AS n_words, array_to_string(w, '|') AS words, CAST(len(f) AS BIGINT) AS n_fixed, array_to_string(f, '|') AS fixed
FROM (SELECT conv_id, turn, regexp_extract_all(text, '\S+\s*|\s+') AS w, list_transform(range(0, (length(text) + 6) // 7), lambda i: substr(text, CAST(7 * i + 1 AS BIGINT), 7)) AS f FROM conversations WHERE role = 'assistant')
"""

MODEL_RULES = [
    {"contains": ["error"], "status": 503},
    {"matches": "(?i)^say ", "echo": True},
    {"contains": ["Alice", "Bob"], "model": "m1", "entities": [{"text": "Alice", "type": "PERSON"}]},
    {"system": "strict", "raw": "not json"},
]
ASKED = [(1, "m1", None, "Hi Alice"), (2, "m2", None, "Hi Alice"), (3, "m1", "be strict", "hello"), (4, "m1", "be strict", "Say it, Bob"), (5, "m1", None, "an error, Bob"), (6, "m1", "strict", "for Bob")]


def fake_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S13, J8."""
    return synthetic.fake_model(frame(spark, ASKED, "request_id int, model string, system string, text string"), MODEL_RULES)


QUERIES["fake_model"] = fake_model
ORACLES["fake_model"] = f"""
SELECT request_id, CASE WHEN contains(text, 'error') THEN 503 ELSE 200 END AS status,
  CASE WHEN contains(text, 'error') THEN '{{"entities": []}}' WHEN lower(text) LIKE 'say %' THEN text
       WHEN (contains(text, 'Alice') OR contains(text, 'Bob')) AND model = 'm1' THEN '{{"entities":[{{"text":"Alice","type":"PERSON"}}]}}'
       WHEN contains(coalesce(system, ''), 'strict') THEN 'not json' ELSE '{{"entities": []}}' END AS reply
FROM {values(ASKED, ['request_id', 'model', 'system', 'text'])}
"""


def conversation_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and wrapping of synthetic conversations, each as long as a given one has lines."""
    lines = spread(spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", F.size(F.split("text", "\n", -1)).alias("n")))
    turns = synthetic.conversations(spark, lines.where("n > 0").groupBy(F.col("conv_id").alias("key")).agg(F.sum("n").alias("length")))
    return turns.groupBy("name").agg(F.count("*").alias("turns"), F.countDistinct("user").alias("users"), F.sum(F.when(F.contains("user", F.lit("@")), 1).otherwise(0)).alias("mails"))


QUERIES["conversation_source"] = conversation_source
ORACLES["conversation_source"] = """
SELECT s || '-' || conv_id AS name, CAST(n AS BIGINT) AS turns, CAST(least(n, 30) AS BIGINT) AS users, CAST(n // 30 * 10 + least(greatest(n % 30 - 10, 0), 10) AS BIGINT) AS mails
FROM (VALUES ('support'), ('hr'), ('tech')) AS a(s), (SELECT conv_id, sum(len(string_split(text, chr(10)))) AS n FROM conversations GROUP BY conv_id HAVING count(text) > 0) AS b
"""
