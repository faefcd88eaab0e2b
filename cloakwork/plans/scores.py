"""Queries of scoring and of benchmark arithmetic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakwork.functions import spans as S
from cloakwork.functions.arrays import record
from cloakwork.operators import anonymize as A
from cloakwork.operators import detect as D
from cloakwork.operators import history as H
from cloakwork.operators import quality as Q
from cloakwork.operators import resolve as R
from cloakwork.plans.detection import EMAIL, IPV4
from cloakwork.session import spread
from cloakwork.sources.rules import Literal, Rule

QUERIES: dict = {}
ORACLES: dict = {}

#: What a document's case expects: (type, pattern, tolerated). Numbers that are no addresses, and names, are found by no detector.
EXPECTED = [("EMAIL_ADDRESS", EMAIL, False), ("IPV4_ADDRESS", IPV4, False), ("PERSON", "[A-Z][a-z]{13,}", True), ("ORGANIZATION", "thnd the", False), ("OTHER", "wh [a-z]+ly", True)]
KEPT, DENIED = "thnd [a-z]+", [Literal("ORGANIZATION", "thnd the", True, False), Literal("OTHER", "ntly", True, False)]


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as labelled cases; those of an odd id with an organization need the denylist."""
    texts = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("string").alias("case_id"), "doc_id", "text"))
    found = lambda pattern: F.array_distinct(F.regexp_extract_all("text", F.lit("(?d)" + pattern), F.lit(0)))
    labelled = [F.transform(found(pattern), lambda t: record(text=t, type=F.lit(kind), tolerated_miss=F.lit(miss))) for kind, pattern, miss in EXPECTED]  # noqa: B023
    none, needs = F.array().cast("array<string>"), (F.col("doc_id") % 2 == 1) & F.contains("text", F.lit(DENIED[0].value))
    told = texts.where("text is not null").select("case_id", "text", F.concat(*labelled).alias("expect"), found(KEPT).alias("must_keep"), F.when(needs, F.array(F.lit("denylist"))).otherwise(none).alias("requires"))
    return told.where((F.size("expect") > 0) | (F.size("must_keep") > 0))  # a case expects something


def outputs(rows: DataFrame, detectors: list[str], rules: list[Rule], entries: list[Literal], salt: str = "pepper") -> DataFrame:
    """Cases with the text that these detectors leave. Finding and uniting are columns of their own, as in ``detect_calls``."""
    active = Q.active_cases(rows, detectors).withColumn("texts", F.array("text"))
    found = []
    if "regex" in detectors:
        found.append(R.tag(A.rule_matches(F.col("text"), rules), "regex"))
    if "denylist" in detectors:
        found.append(R.tag(D.normalized(S.greedy(D.denylist_candidates(F.col("text"), entries))), "denylist"))
    return A.anonymize(active.withColumn("found", F.concat(*found)), R.dedup(F.col("found")), salt).withColumn("output", F.get("anonymized", 0))


def _outputs(spark: SparkSession, sf_dir: str, detectors: list[str]) -> DataFrame:
    return outputs(cases(spark, sf_dir), detectors, [Rule("EMAIL_ADDRESS", EMAIL, (), "@"), Rule("IPV4_ADDRESS", IPV4, (), ".")], DENIED)


def corpus_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S11, P16, A1 to A4 for each case."""
    return Q.score_cases(_outputs(spark, sf_dir, ["regex", "denylist"]))


def corpus_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1 to A4."""
    return Q.summary(Q.score_cases(_outputs(spark, sf_dir, ["regex", "denylist"])))


def detector_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each detector alone, and all together, resolved anew."""
    runs = [("regex", ["regex"]), ("denylist", ["denylist"]), ("all", ["regex", "denylist"])]
    scored = [Q.score_cases(_outputs(spark, sf_dir, d)).withColumn("detectors", F.lit(n)) for n, d in runs]
    return Q.summary(scored[0].unionByName(scored[1]).unionByName(scored[2]), ["detectors"])


def _cases_sql(detectors: list[str]) -> str:
    """The scores of the cases whose detectors these are: entities, longest first, replaced one by one, then counted."""
    listed = lambda p: f"list_distinct(regexp_extract_all(text, '{p}'))"
    expected = " || ".join(f"list_transform({listed(p)}, lambda t: {{'t': t, 'k': '{k}', 'm': {str(m).lower()}}})" for k, p, m in EXPECTED)
    octets = "len(list_filter(string_split(t, '.'), lambda o: CAST(o AS INTEGER) <= 255)) = 4"
    found = {
        "regex": [f"list_transform({listed(EMAIL)}, lambda t: {{'t': t, 'k': 'EMAIL_ADDRESS'}})", f"list_transform(list_filter({listed(IPV4)}, lambda t: {octets}), lambda t: {{'t': t, 'k': 'IPV4_ADDRESS'}})"],
        "denylist": [f"CASE WHEN contains(text, '{e.value}') THEN [{{'t': '{e.value}', 'k': '{e.entity_type}'}}] ELSE [] END" for e in DENIED],
    }
    entities = " || ".join(x for d in detectors for x in found[d])
    types = "[" + ", ".join(f"'{k}'" for k, _, _ in EXPECTED) + "]"
    gone = "NOT contains(text, z['t'])"
    many = lambda c: f"CAST(len({c}) AS BIGINT)"
    return f"""
WITH RECURSIVE c AS (SELECT CAST(doc_id AS VARCHAR) AS case_id, text, {expected} AS x, {listed(KEPT)} AS keep, {entities} AS e FROM documents WHERE text IS NOT NULL AND {"true" if "denylist" in detectors else f"NOT (doc_id % 2 = 1 AND contains(text, '{DENIED[0].value}'))"}),
u AS (SELECT case_id, list({{'v': t, 't': '[' || k || '_' || upper(substr(sha256('6:pepper' || t), 1, 8)) || ']'}} ORDER BY length(t) DESC, t) AS l FROM (SELECT case_id, unnest(e, recursive := true) FROM c) AS a GROUP BY case_id),
fold AS (SELECT case_id, 0 AS i, coalesce(l, []) AS l, text FROM c LEFT JOIN u USING (case_id) WHERE len(x) + len(keep) > 0
  UNION ALL SELECT case_id, i + 1, l, replace(text, l[i + 1].v, l[i + 1].t) FROM fold WHERE i < len(l)),
o AS (SELECT case_id, x, keep, fold.text AS text, regexp_extract_all(fold.text, '\\[([A-Z][A-Z0-9_]*)_([0-9A-F]{{8,}})\\]', 1) AS made FROM fold JOIN c USING (case_id) WHERE i = len(l))
SELECT case_id, {many("x")} AS expected, {many(f"list_filter(x, lambda z: {gone})")} AS redacted, {many("list_filter(x, lambda z: NOT z['m'])")} AS strict_expected, {many(f"list_filter(x, lambda z: NOT z['m'] AND {gone})")} AS strict_redacted,
  CAST(list_sum(list_transform({types}, lambda k: least(len(list_filter(x, lambda z: z['k'] = k)), len(list_filter(made, lambda y: y = k))))) AS BIGINT) AS type_correct, {many("keep")} AS must_keep, {many("list_filter(keep, lambda k: contains(text, k))")} AS kept FROM o"""


QUERIES |= {"corpus_cases": corpus_cases, "corpus_scores": corpus_scores, "detector_compare": detector_compare}
ORACLES["corpus_cases"] = _cases_sql(["regex", "denylist"])
_RATIOS = "round(sum(redacted) / nullif(sum(expected), 0), 6) AS recall, round(sum(strict_redacted) / nullif(sum(strict_expected), 0), 6) AS strict_recall, round(sum(type_correct) / nullif(sum(expected), 0), 6) AS type_accuracy, round(sum(kept) / nullif(sum(must_keep), 0), 6) AS precision"
ORACLES["corpus_scores"] = f"SELECT {_RATIOS} FROM ({_cases_sql(['regex', 'denylist'])}) AS s"
_BY = " UNION ALL ".join(f"SELECT '{n}' AS detectors, * FROM ({_cases_sql(d)}) AS s" for n, d in (("regex", ["regex"]), ("denylist", ["denylist"]), ("all", ["regex", "denylist"])))
ORACLES["detector_compare"] = f"SELECT detectors, {_RATIOS} FROM ({_BY}) AS a GROUP BY detectors"


def token_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3: types of tokens in anonymised documents, counted."""
    from cloakwork.plans.calls import anonymize_docs

    return anonymize_docs(spark, sf_dir).select(F.explode(Q.types_in(F.col("text"))).alias("entity_type")).groupBy("entity_type").agg(F.count("*").alias("n"))


def entity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A10: entities and texts of each source's documents."""
    from cloakwork.plans.calls import RULES, SALT, _calls

    source = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("call_id"), "source")
    done = A.anonymize_rules(_calls(spark, sf_dir), RULES, SALT).select("call_id", F.size("entries").alias("n"))
    return done.join(source, "call_id").groupBy("source").agg(F.sum("n").alias("entities"), F.count("*").alias("texts"))


def dedup_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R4 in a row: the words of each turn as matches of three detectors in turn, short ones empty; types and places by position."""
    turns = spread(spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "text"))
    among = lambda names, n: F.get(F.array(*map(F.lit, names)), n)
    match = lambda w, i: record(text=F.when(F.length(w) > 1, w).otherwise(""), entity_type=among(["PERSON", "URL"], i % 2), source_detectors=F.array(among(["regex", "llm", "denylist"], i % 3)))
    m = F.transform(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0)), match)
    rows = turns.select("conv_id", "turn", F.posexplode(R.dedup(m)).alias("i", "m"))
    return rows.select("conv_id", "turn", "i", "m.text", "m.entity_type", F.array_join("m.source_detectors", ",").alias("sources"))


def bench_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A12 over the events table: mixes and caches by id, overrides and backends by user; errors are runs of a mix outside of the matrix."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    among = lambda names, n: F.get(F.array(*map(F.lit, names)), n.cast("int"))
    mix = F.when(F.col("event_type") == "error", "llm").otherwise(among(Q.MIXES, F.col("event_id") % 5))
    backend, cache = among(["memory", "redis"], F.col("user_id") % 2), among(["none", "detector", "pipeline", "both"], F.floor(F.col("event_id") / 5) % 4)
    return Q.bench_matrix(e.select(mix.alias("mix"), among(["none", "varied"], F.floor(F.col("user_id") / 2) % 2).alias("overrides"), cache.alias("cache"), backend.alias("backend"), F.round("value", 3).alias("ms")))


def cache_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The closed form over conversations."""
    return Q.cache_growth(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def history_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each turn sends."""
    return Q.history(spark.read.parquet(f"{sf_dir}/conversations.parquet")).select("conv_id", "turn", F.size("sent").cast("bigint").alias("n_sent"), F.sha2(F.array_join("sent", "|"), 256).alias("sent"))


def _latencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select((F.col("user_id") % 2).cast("string").alias("mode"), F.col("event_type").alias("service"), (F.col("event_id") % 3).cast("string").alias("size"), F.round("value", 3).alias("ms"), (F.col("event_id") % 7 > 0).alias("ok"))


def latency_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5, A13 over the events table."""
    return Q.latency(_latencies(spark, sf_dir)).withColumn("total_ms", F.round("total_ms", 3))


def speedups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A8 over the events table: event types as mixes, places by id as caches."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    cache = F.element_at(F.array(*[F.lit(x) for x in ("none", "detector", "pipeline", "both")]), (F.col("event_id") % 4 + 1).cast("int"))
    runs = e.select(F.col("event_type").alias("mix"), F.lit("none").alias("overrides"), cache.alias("cache"), F.lit("memory").alias("backend"), F.round("value", 3).alias("ms"))
    return Q.speedups(runs)


def stat_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A9 over running counts of events by user."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    daily = e.groupBy("user_id", F.to_date("ts").alias("day")).agg(F.max("event_id").alias("seen"))
    return Q.deltas(daily, "user_id", "day", ["seen"])


QUERIES |= {f.__name__: f for f in (token_types, entity_counts, dedup_sources, bench_matrix, cache_growth, history_growth, latency_summary, speedups, stat_deltas)}


def _late_oracles() -> None:
    from cloakwork.plans.calls import _ENTITIES, ORACLES as CALLS

    ORACLES["token_types"] = f"WITH a AS ({CALLS['anonymize_docs']}) SELECT entity_type, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '\\[([A-Z][A-Z0-9_]*)_([0-9A-F]{{8,}})\\]', 1)) AS entity_type FROM a) AS x GROUP BY entity_type"
    ORACLES["entity_counts"] = f"WITH {_ENTITIES} SELECT source, count(value) AS entities, count(DISTINCT d.doc_id) AS texts FROM documents AS d LEFT JOIN t USING (doc_id) GROUP BY source"


_late_oracles()
ORACLES["dedup_sources"] = """
WITH w AS (SELECT conv_id, turn, unnest(m) AS text, generate_subscripts(m, 1) - 1 AS i FROM (SELECT conv_id, turn, regexp_extract_all(text, '[A-Za-z]+') AS m FROM conversations) AS a),
d AS (SELECT conv_id, turn, text, ['regex', 'llm', 'denylist'][i % 3 + 1] AS det, min(i) AS k FROM w WHERE length(text) > 1 GROUP BY ALL),
f AS (SELECT conv_id, turn, text, min(k) AS k, string_agg(det, ',' ORDER BY k) AS sources FROM d GROUP BY conv_id, turn, text)
SELECT conv_id, turn, CAST(row_number() OVER (PARTITION BY conv_id, turn ORDER BY k) - 1 AS INTEGER) AS i, text, ['PERSON', 'URL'][k % 2 + 1] AS entity_type, sources FROM f
"""
ORACLES["bench_matrix"] = """
WITH r AS (SELECT CASE WHEN event_type = 'error' THEN 'llm' ELSE ['regex', 'gliner_pii', 'privacy_filter', 'regex,gliner_pii', 'regex,gliner_pii,privacy_filter'][event_id % 5 + 1] END AS mix, ['none', 'varied'][user_id // 2 % 2 + 1] AS overrides,
 ['none', 'detector', 'pipeline', 'both'][event_id // 5 % 4 + 1] AS cache, ['memory', 'redis'][user_id % 2 + 1] AS backend, round(value, 3) AS ms FROM events)
SELECT g.*, coalesce(runs, 0) AS runs, median_ms FROM (SELECT mix, overrides, cache, backend FROM (VALUES ('regex'), ('gliner_pii'), ('privacy_filter'), ('regex,gliner_pii'), ('regex,gliner_pii,privacy_filter')) AS m(mix), (VALUES ('none'), ('varied')) AS o(overrides),
 (VALUES ('none', 'memory'), ('detector', 'memory'), ('detector', 'redis'), ('pipeline', 'memory'), ('pipeline', 'redis'), ('both', 'memory'), ('both', 'redis')) AS c(cache, backend)) AS g
 LEFT JOIN (SELECT mix, overrides, cache, backend, count(*) AS runs, round(median(ms), 6) AS median_ms FROM r GROUP BY ALL) AS s USING (mix, overrides, cache, backend)
"""
ORACLES["cache_growth"] = "SELECT conv_id, count(*) AS turns, sum(2 * i - 1)::BIGINT AS lookups, count(*) AS misses, (sum(2 * i - 1) - count(*))::BIGINT AS hits FROM (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations) AS x GROUP BY conv_id"
ORACLES["history_growth"] = "SELECT a.conv_id, a.turn, count(*) AS n_sent, sha256(string_agg(b.text, '|' ORDER BY b.turn)) AS sent FROM conversations AS a JOIN conversations AS b ON a.conv_id = b.conv_id AND b.turn <= a.turn GROUP BY a.conv_id, a.turn"
ORACLES["latency_summary"] = "SELECT mode, service, size, count(*) AS calls, round(sum(ms), 3) AS total_ms, round(avg(ms), 6) AS avg_ms, min(ms) AS min_ms, max(ms) AS max_ms, count(*) FILTER (ok) AS n_ok, count(*) FILTER (NOT ok) AS n_err FROM (SELECT CAST(user_id % 2 AS VARCHAR) AS mode, event_type AS service, CAST(event_id % 3 AS VARCHAR) AS size, round(value, 3) AS ms, event_id % 7 > 0 AS ok FROM events) AS x GROUP BY mode, service, size"
ORACLES["speedups"] = """
WITH r AS (SELECT event_type AS mix, ['none', 'detector', 'pipeline', 'both'][event_id % 4 + 1] AS cache, round(value, 3) AS ms FROM events),
c AS (SELECT mix, cache, median(ms) AS m, avg(ms) AS a FROM r GROUP BY mix, cache)
SELECT c.mix, 'none' AS overrides, c.cache, 'memory' AS backend, round(c.m, 6) AS median_ms, round(c.a, 6) AS mean_ms, round(b.m / c.m, 6) AS speedup FROM c JOIN c AS b ON b.mix = c.mix AND b.cache = 'none'
"""
ORACLES["stat_deltas"] = "SELECT user_id, day, seen - coalesce(lag(seen) OVER (PARTITION BY user_id ORDER BY day), 0) AS seen FROM (SELECT user_id, CAST(ts AS DATE) AS day, max(event_id) AS seen FROM events GROUP BY ALL) AS x"


# ---- histories ---------------------------------------------------------------------------------------------------------


def history_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn with the length of its history, how many conversations share it and the least of them; no history is gathered."""
    chained = H.chain(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    known = H.nodes(chained).select("node", "conversations", "owner")
    return chained.join(known, "node").select("conv_id", "turn", F.col("place").alias("n_sent"), F.col("conversations").alias("n_conversations"), "owner")


def history_sent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the last turn of each conversation sends, from the chain; a history that several end with is read once."""
    chained = H.chain(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    last = chained.groupBy("conv_id").agg(F.max_by("node", "place").alias("node"))
    return H.sent(chained, last).select("conv_id", F.size("sent").cast("bigint").alias("n_sent"), F.sha2(F.array_join("sent", "|"), 256).alias("sent"))


QUERIES |= {"history_chain": history_chain, "history_sent": history_sent}
ORACLES["history_chain"] = """WITH h AS (SELECT conv_id, turn, list(text) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS sent FROM conversations)
SELECT conv_id, turn, len(sent) AS n_sent, count(*) OVER (PARTITION BY sent) AS n_conversations, min(conv_id) OVER (PARTITION BY sent) AS owner FROM h"""
ORACLES["history_sent"] = "SELECT conv_id, count(*) AS n_sent, sha256(string_agg(text, '|' ORDER BY turn)) AS sent FROM conversations GROUP BY conv_id"
