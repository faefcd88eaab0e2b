"""Queries of options: named packs and denylists, registries, prompts, salts, locales, caches, stores, detector specs."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakwork.operators import detect as D
from cloakwork.operators import registry as G
from cloakwork.operators import remote
from cloakwork.operators import surrogate as X
from cloakwork.operators import vault as V
from cloakwork.operators.storage import TableStore
from cloakwork.plans.calls import _ENTITIES, _LIVE, _asked, _vault
from cloakwork.plans.detection import BARE, BARE_CASELESS, EMAIL, IPV4, _deny_sql, _spans_sql, docs
from cloakwork.session import shared_dir
from cloakwork.sources import rules as S
from cloakwork.sources.rules import Rule

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


# ---- names -------------------------------------------------------------------------------------------------------------

NAMES = ["default", "mail", "addresses", "nothing", ""]


def _with_name(df: DataFrame) -> DataFrame:
    """Each document says which pack or list it wants: a known name, an unknown one, an empty one or none."""
    return df.withColumn("wanted", F.get(F.array(*[F.lit(x) for x in NAMES]), (F.col("doc_id") % 6).cast("int")))


_WANTED = f"{NAMES!r}[doc_id % 6 + 1]"
_MAIL, _V4 = Rule("EMAIL_ADDRESS", EMAIL, ("ASCII",), "@"), Rule("IDENTIFIER", IPV4, ("ASCII",), ".")
_WARNED = f"CASE WHEN {_WANTED} = 'nothing' THEN 'unknown name ''nothing''; the default is used' END"


@query(f"""
WITH e AS (SELECT doc_id, start, stop, value, 'EMAIL_ADDRESS' AS entity_type FROM ({_spans_sql("documents", EMAIL)}) AS a WHERE coalesce({_WANTED}, '') <> 'addresses'
 UNION ALL SELECT doc_id, start, stop, value, 'IDENTIFIER' FROM ({_spans_sql("documents", IPV4)}) AS b WHERE coalesce({_WANTED}, '') <> 'mail')
SELECT *, {_WARNED} AS warning FROM e
""")
def named_packs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packs chosen row by row."""
    found = D.scan_named(_with_name(docs(spark, sf_dir)), [_MAIL, _V4], {"mail": [_MAIL], "addresses": [_V4]}, "wanted")
    return found.select("doc_id", "warning", F.explode_outer("candidates").alias("c")).where("c is not null").select("doc_id", "c.start", F.col("c.end").alias("stop"), "c.value", "c.entity_type", "warning")


#: With what a reader has to cope with: values that are there twice, flags left to their defaults.
MAIL_LIST = [{"type": e.entity_type, "value": e.value, "word_boundary": False} for e in BARE for _ in range(2)]


@query(f"""
SELECT *, {_WARNED} AS warning FROM ({_deny_sql(BARE)}) AS a WHERE {_WANTED} = 'mail'
UNION ALL SELECT *, {_WARNED} AS warning FROM ({_deny_sql(BARE_CASELESS)}) AS b WHERE coalesce({_WANTED}, '') <> 'mail'
""")
def named_denylists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Denylists as read, chosen row by row."""
    found = D.denylist_named(_with_name(docs(spark, sf_dir)), BARE_CASELESS, {"mail": S.parse_denylist(MAIL_LIST), "addresses": BARE_CASELESS}, "wanted")
    return found.select("doc_id", "warning", F.explode_outer("candidates").alias("c")).where("c is not null").select("doc_id", "c.start", F.col("c.end").alias("stop"), "c.value", "c.entity_type", "warning")


def _registry(text: str) -> tuple[str, dict[str, str]]:
    try:
        return "ok", S.parse_registry(text)
    except S.RuleError:
        return "error", {}


@query("""
WITH r AS (SELECT r_regionkey AS region, CASE r_regionkey WHEN 1 THEN 'default=x,' WHEN 2 THEN 'a=1, a = 2,' WHEN 3 THEN 'broken,' ELSE ' , ' END || string_agg(lower(n_name) || ' = rules/' || n_nationkey || '.yaml', ',' ORDER BY n_nationkey) AS t
  FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_regionkey),
p AS (SELECT region, trim(x) AS x, trim(split_part(x, '=', 1)) AS name, trim(split_part(x, '=', 2)) AS path FROM (SELECT region, unnest(string_split(t, ',')) AS x FROM r) AS u WHERE trim(x) <> ''),
bad AS (SELECT region FROM p GROUP BY region HAVING count(*) <> count(DISTINCT name) OR bool_or(NOT contains(x, '=') OR name = '' OR path = '' OR name = 'default'))
SELECT region, 'ok' AS status, name, path FROM p WHERE region NOT IN (SELECT region FROM bad) UNION ALL SELECT region, 'error', NULL, NULL FROM bad
""")
def registry_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A registry option for each region, read on the driver as options are; a malformed one is refused whole."""
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_regionkey", "n_nationkey", "n_name").orderBy("n_nationkey").toPandas()  # options, as many as there are nations
    head, rows = {1: "default=x,", 2: "a=1, a = 2,", 3: "broken,"}, []
    for region, mine in nation.groupby("n_regionkey"):
        status, found = _registry(head.get(region, " , ") + ",".join(f"{n.lower()} = rules/{k}.yaml" for k, n in zip(mine["n_nationkey"], mine["n_name"])))
        rows += [(int(region), status, k, v) for k, v in found.items()] or [(int(region), status, None, None)]
    return spark.createDataFrame(rows, "region bigint, status string, name string, path string")


# ---- prompts and chat models -------------------------------------------------------------------------------------------

PROMPT = S.read_prompt(S.DEFAULT_PROMPT)
_SQL_PROMPT = PROMPT.replace("'", "''")


@query(f"""
SELECT conv_id, turn, CAST(to_json({{'model': CASE WHEN role = 'user' THEN 'small' ELSE 'large' END, 'temperature': 0, 'response_format': {{'type': 'json_object'}},
  'messages': [{{'role': 'system', 'content': '{_SQL_PROMPT}'}}, {{'role': 'user', 'content': text}}]}}) AS VARCHAR) AS body FROM conversations
""")
def chat_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a chat model is asked, with the bundled prompt."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    model = F.when(F.col("role") == "user", "small").otherwise("large")
    return turns.select("conv_id", "turn", remote.chat_body(F.col("text"), model, F.lit(PROMPT)).alias("body"))


# ---- surrogates --------------------------------------------------------------------------------------------------------

LONG_SALT = "0123456789é" * 9


def _mails(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select(F.explode(F.regexp_extract_all("text", F.lit(EMAIL), F.lit(0))).alias("value")).distinct()


_SALT64 = LONG_SALT.encode()[:64].decode(errors="ignore")
_E = f"e AS (SELECT DISTINCT unnest(regexp_extract_all(text, '{EMAIL}')) AS value FROM documents)"


@query(f"WITH {_E} SELECT value, '[USERNAME_' || upper(substr(sha256('{len(_SALT64.encode())}:{_SALT64}' || value), 1, 8)) || ']' AS token FROM e")
def salted_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a salt at most 64 bytes count, and no letter is cut in two."""
    return _mails(spark, sf_dir).select("value", X.opaque(F.lit("USERNAME"), F.col("value"), X.salt_bytes(LONG_SALT)).alias("token"))


_CHAIN = "[lang || '_' || upper(lang), 'es_ES']"


@query(f"SELECT doc_id, coalesce(list_filter({_CHAIN}, lambda x: x IN ('en_US', 'de_DE', 'fr_FR', 'es_ES', 'pt_BR'))[1], 'en_US') AS locale FROM documents")
def locale_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first known locale of each document's chain."""
    chain = F.array(F.concat("lang", F.lit("_"), F.upper("lang")), F.lit("es_ES"))
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", X.locale_of(chain).alias("locale"))


_KINDS = ["PERSON", "CREDENTIAL"]
_pick = lambda locale: " || ' ' || ".join("[" + ",".join(f"'{x}'" for x in part) + f"][CAST('0x' || substr(p, {1 + 7 * k}, 7) AS BIGINT) % {len(part)} + 1]" for k, part in enumerate(X.NAMES[locale]))


@query(f"""
WITH {_E}, w AS (SELECT value, kind, use_realistic, locale, sha256('4:saltPERSON:' || value) AS p FROM e, unnest({_KINDS!r}) AS k(kind), unnest([true, false]) AS u(use_realistic), unnest(['en_US', 'de_DE']) AS l(locale))
SELECT value, kind AS entity_type, use_realistic, locale, CASE WHEN kind = 'CREDENTIAL' OR NOT use_realistic THEN '[' || kind || '_' || upper(substr(sha256('4:salt' || value), 1, 8)) || ']' WHEN locale = 'en_US' THEN {_pick("en_US")} ELSE {_pick("de_DE")} END AS surrogate,
  kind = 'PERSON' AS cached FROM w
""")
def surrogate_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A surrogate for each key, part of them from the cache; opaque ones have one key for all locales."""
    each = lambda values: F.explode(F.array(*[F.lit(v) for v in values]))
    wanted = _mails(spark, sf_dir).select(F.col("value").alias("text"), each(_KINDS).alias("entity_type")).select("*", each([True, False]).alias("use_realistic")).select("*", each(["en_US", "de_DE"]).alias("locale"))
    _, cache = X.surrogates(wanted.where("entity_type = 'PERSON'"), "salt")
    found, fresh = X.surrogates(wanted, "salt", cache)
    new = fresh.select(F.col("key.text").alias("t"), F.col("key.entity_type").alias("k")).distinct()
    return found.join(new, (F.col("text") == F.col("t")) & (F.col("entity_type") == F.col("k")), "left").select(F.col("text").alias("value"), "entity_type", "use_realistic", "locale", "surrogate", F.col("t").isNull().alias("cached"))


# ---- stores and specs --------------------------------------------------------------------------------------------------


@query(f"WITH {_ENTITIES} SELECT doc_id, token AS surrogate, value AS original, kind AS entity_type FROM t WHERE {_LIVE}")
def stored_vault(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vault in a store: put twice, compacted, put again, then asked."""
    rows = _vault(spark, sf_dir)
    store = TableStore(spark, f"{shared_dir(spark)}/cloakwork/store-{uuid.uuid4().hex}", rows.schema, ["call_id"], ttl_seconds=V.TTL_SECONDS)
    old = rows.withColumn("put_ts", F.col("put_ts") - F.expr("interval 1 hour"))
    store.put(old)
    store.put(rows.where("call_id % 3 = 0"))
    store.compact()
    store.put(rows.where("call_id % 3 <> 0"))
    return V.peek(_asked(spark, sf_dir), store.rows("2024-01-01 00:04:00")).select(F.col("call_id").alias("doc_id"), "surrogate", "original", "entity_type")


@query(f"WITH {_ENTITIES} SELECT doc_id, token AS surrogate, value AS original, kind AS entity_type, doc_id % 3 = 0 AS taken FROM t")
def popped_vault(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a pop takes out of a store, and what stays; a second pop of the same calls takes nothing."""
    rows = _vault(spark, sf_dir)
    store = TableStore(spark, f"{shared_dir(spark)}/cloakwork/store-{uuid.uuid4().hex}", rows.schema, ["call_id"], ttl_seconds=V.TTL_SECONDS)
    store.put(rows)
    asked = _asked(spark, sf_dir).where("call_id % 3 = 0")
    taken = store.pop(asked).unionByName(store.pop(asked)).withColumn("taken", F.lit(True))
    return taken.unionByName(store.rows().withColumn("taken", F.lit(False))).select(F.col("call_id").alias("doc_id"), F.inline("entries"), "taken").select("doc_id", "surrogate", "original", "entity_type", "taken")


@query(f"WITH {_ENTITIES} SELECT doc_id, token AS surrogate, value AS original, kind AS entity_type FROM t")
def streamed_vault(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream of puts into a store, run to its end and, with its progress lost, once more; each batch counts once."""
    rows, folder = _vault(spark, sf_dir), f"{shared_dir(spark)}/cloakwork/stream-{uuid.uuid4().hex}"
    store = TableStore(spark, f"{folder}/store", rows.schema, ["call_id"])
    rows.write.parquet(f"{folder}/puts")
    for progress in ("first", "again"):
        puts = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 4).parquet(f"{folder}/puts")
        q = puts.writeStream.foreachBatch(store.sink("puts")).option("checkpointLocation", f"{folder}/{progress}").trigger(availableNow=True).start()
        if not q.awaitTermination(300):
            q.stop()
            raise TimeoutError("the stream of puts did not end")
    return store.rows().select(F.col("call_id").alias("doc_id"), F.inline("entries")).select("doc_id", "surrogate", "original", "entity_type")


@query("SELECT text, min(conv_id) AS first_conv FROM conversations GROUP BY text")
def stored_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cache in which the first writer wins."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("text", F.col("conv_id").alias("first_conv"), F.timestamp_seconds(F.col("conv_id")).alias("put_ts"))
    store = TableStore(spark, f"{shared_dir(spark)}/cloakwork/store-{uuid.uuid4().hex}", "text string, first_conv bigint, put_ts timestamp", ["text"], first_wins=True)
    store.put(turns.where("first_conv % 2 = 0"))
    store.put(turns.where("first_conv % 2 = 1"))
    return store.rows().select("text", "first_conv")


@query("""
WITH r AS (SELECT user_id, ['regex', 'denylist', 'privacy_filter', 'gliner_pii', 'llm', 'other'][event_id % 6 + 1] AS d, event_id % 6 AS k FROM events WHERE event_id % 10 = 3)
SELECT user_id AS call_id, ['privacy filter', 'zero-shot', 'LLM'][min(k) - 1] || ' detector is unavailable; request blocked.' AS blocked_reason FROM r WHERE k BETWEEN 2 AND 4 GROUP BY user_id
""")
def detector_specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the events table as runs of detectors, of which one in ten fails."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    detector = F.get(F.array(*[F.lit(s.name) for s in G.REGISTRY], F.lit("other")), (F.col("event_id") % 6).cast("int"))
    runs = e.select(F.col("user_id").alias("call_id"), detector.alias("detector"), F.when(F.col("event_id") % 10 == 3, "unavailable").otherwise("ok").alias("status"))
    return G.blocked(runs, G.specs_frame(spark))
