"""Queries of detection: rules over documents, validators, normalisation, overlap resolution, denylists."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakwork.functions import spans as S
from cloakwork.functions import text as T
from cloakwork.operators import denylist as N
from cloakwork.operators import detect as D
from cloakwork.operators import table_function
from cloakwork.plans.fixtures import frame, values
from cloakwork.session import spread
from cloakwork.sources.rules import Literal, Rule, load_pack

QUERIES: dict = {}
ORACLES: dict = {}


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


# ---- single rules ------------------------------------------------------------------------------------------------------

EMAIL, IPV4, CARD, UUID, HASH40, HOST, DOB = (
    r"\b[A-Za-z0-9_.+-]+@[A-Za-z0-9_-]+(?:\.[A-Za-z0-9_-]+)+\b",
    r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b",
    r"\b(?:4[0-9]{3}(?:[- ]?[0-9]{4}){3}|5[1-5][0-9]{2}(?:[- ]?[0-9]{4}){3})\b",
    r"\b[a-fA-F0-9]{8}-[a-fA-F0-9]{4}-[a-fA-F0-9]{4}-[a-fA-F0-9]{4}-[a-fA-F0-9]{12}\b",
    r"\b[a-fA-F0-9]{40}\b",
    r"\b[a-zA-Z0-9][a-zA-Z0-9-]{0,62}\.(?:local|internal|corp|lan|home|intranet)\b",
    r"(\b(?:DOB|Born)\s*[:=]\s*)([0-9]{1,4}[-/.][0-9]{1,2}[-/.][0-9]{1,4})\b",
)


def _spans_sql(source: str, pattern: str, group: int = 0) -> str:
    """doc_id, start, stop, value of all matches, in DuckDB."""
    p = pattern.replace("'", "''")
    lead = f"list_transform(regexp_extract_all(text, '{p}', 1), lambda x: length(x))" if group else "list_transform(m, lambda x: 0)"
    value = f"regexp_extract_all(text, '{p}', {group})" if group else "m"
    return f"""SELECT doc_id, CAST(start + lead AS INTEGER) AS start, CAST(start + lead + length(value) AS INTEGER) AS stop, value FROM (
        SELECT doc_id, unnest(list_transform(range(1, len(m) + 1), lambda i: list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0))) AS start,
               unnest(value) AS value, unnest(lead) AS lead
        FROM (SELECT doc_id, m, g, {value} AS value, {lead} AS lead FROM (SELECT doc_id, text, regexp_extract_all(text, '{p}') AS m, string_split_regex(text, '{p}') AS g FROM {source}) AS a) AS b WHERE len(m) > 0) AS c"""


def _spans_query(name: str, pattern: str, kind: str, needs: str | None = None, group: int = 0, rows: list[tuple] | None = None) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        source = frame(spark, rows, "doc_id bigint, text string") if rows else docs(spark, sf_dir)
        found = source.select("doc_id", F.explode(S.find(F.col("text"), "(?d)" + pattern, kind, 0, bool(group), needs)).alias("c"))
        return found.select("doc_id", "c.start", F.col("c.end").alias("stop"), "c.value")

    QUERIES[name] = run
    ORACLES[name] = _spans_sql(f"(SELECT CAST(doc_id AS BIGINT) AS doc_id, text FROM {values(rows, ['doc_id', 'text'])})" if rows else "documents", pattern, group)


_spans_query("email_spans", EMAIL, "EMAIL_ADDRESS", "@")
_spans_query("ipv4_spans", IPV4, "IPV4_ADDRESS", ".")
_spans_query("card_spans", CARD, "CREDIT_CARD")
_spans_query("sha1_spans", HASH40, "HASH")
_spans_query("uuid_spans", UUID, "UUID", rows=[(1, "id 550e8400-e29b-41d4-a716-446655440000."), (2, "none"), (3, "a 11111111-2222-3333-4444-555555555555 b é 550E8400-E29B-41D4-A716-446655440000")])
_spans_query("hostname_spans", HOST, "HOSTNAME", rows=[(1, "ssh dc01.internal and srv-2.corp."), (2, "é db.lan x"), (3, "www.example.com")])
_spans_query("dob_labelled", DOB, "DATE_OF_BIRTH", group=2, rows=[(1, "DOB: 1985-04-15 and Born = 1/2/1990."), (2, "date 1985-04-15"), (3, "é Born: 12.11.1971")])


# ---- validators --------------------------------------------------------------------------------------------------------

VALIDATED = [("CREDIT_CARD", x) for x in ("4000-2719-3658-2146", "5329 1804 7736 5020", "3719 442058 36166", "4000-2719-3658-2149", "5329 1804 7736 5023", "9", "")]
VALIDATED += [("IBAN", x) for x in ("DE34200505501234567890", "GB07LOYD30963412345678", "DE00200505501234567890", "GB00LOYD30963412345678", "DE342005055012345678?!", "de34 2005 0550 1234 5678 90", "DE3")]
VALIDATED += [("IPV4_ADDRESS", x) for x in ("10.20.30.40", "0.1.2.3", "255.254.253.252", "010.020.030.040", "300.301.302.303", "1.2.3.256", "10.20.30", "1.2.3.4.5.6")]
VALIDATED += [("IPV4_CIDR", x) for x in ("172.16.0.0/12", "10.20.30.40/31", "0.0.0.0/0", "172.16.0.0/40", "300.0.0.0/8", "172.16.0.0")]


def validators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P4 to P7, P10."""
    return frame(spark, VALIDATED, "kind string, s string").select("kind", "s", T.valid(F.col("s"), F.col("kind")).alias("ok"))


QUERIES["validators"] = validators
_V4 = "(len(string_split({x}, '.')) = 4 AND len(list_filter(string_split({x}, '.'), lambda p: NOT (regexp_full_match(p, '[0-9]{{1,9}}') AND coalesce(TRY_CAST(p AS INTEGER), 999) <= 255))) = 0)"
ORACLES["validators"] = f"""
WITH v AS (SELECT kind, s, regexp_replace(s, '[^0-9]', '', 'g') AS d, upper(replace(s, ' ', '')) AS b FROM {values(VALIDATED, ['kind', 's'])}),
luhn AS (SELECT kind, s, length(d) >= 2 AND coalesce((SELECT sum(CASE WHEN (length(d) - i) % 2 = 0 THEN CAST(substr(d, i, 1) AS INTEGER) ELSE (2 * CAST(substr(d, i, 1) AS INTEGER)) // 10 + (2 * CAST(substr(d, i, 1) AS INTEGER)) % 10 END) FROM range(1, length(d) + 1) AS r(i)), 1) % 10 = 0 AS ok FROM v WHERE kind = 'CREDIT_CARD'),
iban AS (SELECT kind, s, CASE WHEN length(b) >= 5 AND regexp_full_match(b, '[A-Z0-9]+') THEN CAST(list_reduce(list_transform(string_split(substr(b, 5) || substr(b, 1, 4), ''), lambda c: CASE WHEN c BETWEEN '0' AND '9' THEN c ELSE CAST(ascii(c) - 55 AS VARCHAR) END), lambda x, y: x || y) AS HUGEINT) % 97 = 1 ELSE false END AS ok FROM v WHERE kind = 'IBAN'),
ip AS (SELECT kind, s, {_V4.format(x='s')} AS ok FROM v WHERE kind = 'IPV4_ADDRESS'),
net AS (SELECT kind, s, contains(s, '/') AND {_V4.format(x="split_part(s, '/', 1)")} AND coalesce(TRY_CAST(split_part(s, '/', 2) AS INTEGER), 99) <= 32 AS ok FROM v WHERE kind = 'IPV4_CIDR')
SELECT * FROM luhn UNION ALL SELECT * FROM iban UNION ALL SELECT * FROM ip UNION ALL SELECT * FROM net
"""

IPV6 = [(x, k) for x, k in (("2001:db8::1", "a"), ("::1", "a"), ("::", "a"), ("fe80::1ff:fe23:4567:890a%eth0", "a"), ("1:2:3:4:5:6:7:8", "a"), ("::ffff:192.0.2.1", "a"), ("::1::2", "a"), ("gggg::1", "a"), ("12345::", "a"), ("1:2:3:4:5:6:7", "a"), ("1:2:3:4:5:6:7:8:9", "a"), ("::1.2.3", "a"), ("2001:db8::/32", "n"), ("fe80::/10", "n"), ("::1/129", "n"), ("::1::2/64", "n"), ("::1", "n"))]


def ipv6_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P8, P9."""
    return frame(spark, IPV6, "s string, kind string").select("s", "kind", F.when(F.col("kind") == "a", T.ipv6(F.col("s"))).otherwise(T.ipv6_cidr(F.col("s"))).alias("ok"))


QUERIES["ipv6_valid"] = ipv6_valid
_H = "[0-9A-Fa-f]{1,4}"
_FORMS = "|".join([f"({_H}:){{7}}{_H}"] + [f"({_H}(:{_H}){{{a - 1}}})?::({_H}(:{_H}){{0,{6 - a}}})?" if a else f"::({_H}(:{_H}){{0,6}})?" for a in range(0, 7)] + [f"({_H}:){{7}}:"])
_TAIL_V4 = ":(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])([.](25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}$"
ORACLES["ipv6_valid"] = f"""
WITH v AS (SELECT s, kind, regexp_replace(split_part(split_part(s, '/', 1), '%', 1), ':(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])([.](25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){{3}}$', ':0:0') AS plain FROM {values(IPV6, ['s', 'kind'])})
SELECT s, kind, regexp_full_match(plain, '{_FORMS}') AND (kind = 'a' OR coalesce(TRY_CAST(nullif(split_part(s, '/', 2), '') AS INTEGER), 999) <= 128) AS ok FROM v
"""

NORMALISED = [("Eastmere,", "ADDRESS"), ("Nora;;.", "PERSON"), ("Petra!?", "PERSON"), ("p4ss!?", "CREDENTIAL"), ("/srv/data/.", "PATH"), ("odd,", "NOT_A_TYPE"), (".,;", "PERSON"), ("x;y.", "URL")]


def match_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P2, P3."""
    t = T.normalize_type(F.col("etype"))
    return frame(spark, NORMALISED, "raw string, etype string").select("raw", "etype", T.trim_match(F.col("raw"), t).alias("text"), t.alias("entity_type"))


QUERIES["match_normalize"] = match_normalize
ORACLES["match_normalize"] = f"""
SELECT raw, etype, CASE WHEN etype IN ('CREDENTIAL', 'TOKEN', 'PATH', 'IDENTIFIER', 'OTHER', 'NOT_A_TYPE') THEN raw ELSE rtrim(raw, '.,;!?') END AS text,
       CASE WHEN etype = 'NOT_A_TYPE' THEN 'OTHER' ELSE etype END AS entity_type FROM {values(NORMALISED, ['raw', 'etype'])}
"""


# ---- overlap resolution ------------------------------------------------------------------------------------------------

#: Rules whose matches overlap in documents: digits inside addresses, words around them.
OVERLAPPING = [("IPV4_ADDRESS", r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b"), ("PHONE", r"[0-9]{2,4}[ .-][0-9]{2,4}"), ("HASH", r"\b[a-fA-F0-9]{32,40}\b"), ("IDENTIFIER", r"[0-9]{6,}"), ("EMAIL_ADDRESS", EMAIL), ("USERNAME", r"[a-z0-9.]+@")]


def _overlap(strategy: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = F.concat(*[S.find(F.col("text"), "(?d)" + p, k, i) for i, (k, p) in enumerate(OVERLAPPING)])
        kept = docs(spark, sf_dir).select("doc_id", F.explode(S.greedy(found, strategy)).alias("c"))
        return kept.select("doc_id", "c.start", F.col("c.end").alias("stop"), "c.value", "c.entity_type")

    return run


def _resolved_sql(every: str, order: str) -> str:
    """Of candidates (doc_id, start, stop, value, entity_type, ord), in this order, those that overlap none taken before."""
    return f"""
WITH RECURSIVE c AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY {order}) AS n FROM ({every}) AS e),
lists AS (SELECT doc_id, list({{'a': start, 'b': stop, 'v': value, 't': entity_type}} ORDER BY n) AS l FROM c GROUP BY doc_id),
fold AS (SELECT doc_id, 0 AS i, l, l[1:0] AS kept FROM lists
  UNION ALL SELECT doc_id, i + 1, l, CASE WHEN len(list_filter(kept, lambda k: k.a < l[i + 1].b AND l[i + 1].a < k.b)) = 0 THEN list_append(kept, l[i + 1]) ELSE kept END FROM fold WHERE i < len(l))
SELECT doc_id, k.a AS start, k.b AS stop, k.v AS value, k.t AS entity_type FROM (SELECT doc_id, unnest(kept) AS k FROM fold WHERE i = len(l)) AS x
"""


def _overlap_sql(strategy: str) -> str:
    every = " UNION ALL ".join(f"SELECT doc_id, start, stop, value, '{k}' AS entity_type, {i} AS ord FROM ({_spans_sql('documents', p)}) AS s{i}" for i, (k, p) in enumerate(OVERLAPPING))
    return _resolved_sql(every, "start - stop, start, ord" if strategy == "longest" else "ord, start")


for _s in ("longest", "priority"):
    QUERIES[f"overlap_{_s}"] = _overlap(_s)
    ORACLES[f"overlap_{_s}"] = _overlap_sql(_s)


# ---- packs -------------------------------------------------------------------------------------------------------------


def _pack_query(name: str, scan):
    """A pack over documents, validated and resolved."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = scan(docs(spark, sf_dir)).select("doc_id", F.explode_outer("candidates").alias("c")).where("c is not null")
        return found.select("doc_id", "c.start", F.col("c.end").alias("stop"), "c.value", "c.entity_type")

    QUERIES[name] = run


def _default(df: DataFrame) -> DataFrame:
    return D.scan(df, load_pack(), strategy="longest")


def _extended(df: DataFrame) -> DataFrame:
    return D.scan_with_python(df, load_pack("bundled:rules_extended.yaml"), strategy="longest")


_pack_query("default_pack", _default)
_pack_query("extended_pack", _extended)

def re2(pattern: str, flags: tuple[str, ...] = ()) -> tuple[str, str, str, str | None]:
    """A rule in RE2's dialect: what must stand before its value, the value, what must follow, and a veto on value and rest.

    RE2 has no looking around: what must (not) stand before or behind becomes part of the match, and a look ahead inside
    becomes a pattern that value and rest must not begin with.
    """
    if "VERBOSE" in flags:
        pattern = re.sub(r"\s+", "", pattern)
    lead = re.match(r"\(\?[ims]+\)", pattern)
    head, pattern = (lead[0], pattern[lead.end() :]) if lead else ("", pattern)
    head += "".join(f"(?{x})" for f, x in (("IGNORECASE", "i"), ("MULTILINE", "m"), ("DOTALL", "s")) if f in flags)
    before = after = ""
    veto = None
    if found := re.match(r"\(\?<([=!])((?:[^()\\]|\\.)*)\)", pattern):
        inside = found[2]
        before = f"(?:{inside})" if found[1] == "=" else f"(?:^|[^{inside[1:-1] if inside[0] == '[' else inside}])"
        pattern = pattern[found.end() :]
    if found := re.search(r"\(\?([=!])((?:[^()\\]|\\.|\((?:[^()\\]|\\.)*\))*)\)$", pattern):
        after = f"(?:{found[2]})" if found[1] == "=" else f"(?:$|[^{found[2][1:-1]}])"
        pattern = pattern[: found.start()]
    if found := re.search(r"\(\?!((?:[^()\\]|\\.|\((?:[^()\\]|\\.)*\))*)\)", pattern):
        veto = f"^(?:{found[1]})"
        pattern = pattern[: found.start()] + pattern[found.end() :]
    cut = D.split_group(pattern)
    start, value, end = cut if cut else ("", f"(?:{pattern})", "")
    return head, *(_classes(x) for x in (before + start, value, end + after)), _classes(veto) if veto else None


def _classes(pattern: str) -> str:
    """Word characters as in Unicode, inside and outside of sets."""
    out, in_set, i = "", False, 0
    while i < len(pattern):
        two = pattern[i : i + 2]
        if two[0] == "\\":
            out += {"\\w": r"\pL\pN_" if in_set else r"[\pL\pN_]"}.get(two, two)
            i += 2
            continue
        in_set = (in_set or two[0] == "[") and not (two[0] == "]" and in_set)
        out += two[0]
        i += 1
    return out


#: Rules whose alternatives look behind each for themselves, by a piece of their pattern: what stands before, value, after.
APART = {
    "(?<=AWS_SECRET_ACCESS_KEY=)": [("AWS_SECRET_ACCESS_KEY=", "[A-Za-z0-9/+]{40}", r"\b"), (r"aws_secret_access_key\s=\s", "[A-Za-z0-9/+]{40}", r"\b")],
    r"(?:(?<=\s-p\s')": [(r"""\s-p\s['"]""", """[^'"]{4,64}""", """['"]"""), (r"\s-p\s", r"""[^\s'"]{4,64}""", r"(?:\s|$)"), (":'", "[^'@]{4,64}", "'@")],
    r"(?:(?<=-u\s)": [(r"-u\s", r"[a-zA-Z][a-zA-Z0-9._\-]{2,40}", r"\b")],
}


def _parts_sql(source: str, parts: tuple[str, str, str, str, str | None]) -> str:
    """doc_id, start, stop, value of all matches of (before)(value)after."""
    head, before, value, after, veto = parts
    found = _spans_sql(source, f"{head}({before})({value}){after}", 2)
    return found if veto is None else f"SELECT * FROM ({found}) AS v WHERE NOT regexp_matches(value, '{veto}')"


_DIGITS = "regexp_replace(value, '[^0-9]', '', 'g')"
_SQL_CHECKS = {
    "CREDIT_CARD": f"length({_DIGITS}) >= 2 AND list_sum(list_transform(range(1, length({_DIGITS}) + 1), lambda i: CASE WHEN (length({_DIGITS}) - i) % 2 = 0 THEN CAST(substr({_DIGITS}, CAST(i AS BIGINT), 1) AS INTEGER) ELSE (2 * CAST(substr({_DIGITS}, CAST(i AS BIGINT), 1) AS INTEGER)) // 10 + (2 * CAST(substr({_DIGITS}, CAST(i AS BIGINT), 1) AS INTEGER)) % 10 END)) % 10 = 0",
    "IBAN": "CAST(array_to_string(list_transform(string_split(substr(upper(replace(value, ' ', '')), 5) || substr(upper(replace(value, ' ', '')), 1, 4), ''), lambda c: CASE WHEN c BETWEEN '0' AND '9' THEN c ELSE CAST(ascii(c) - 55 AS VARCHAR) END), '')[1:18] AS HUGEINT) IS NOT NULL AND list_reduce(list_prepend(0::BIGINT, list_transform(string_split(array_to_string(list_transform(string_split(substr(upper(replace(value, ' ', '')), 5) || substr(upper(replace(value, ' ', '')), 1, 4), ''), lambda c: CASE WHEN c BETWEEN '0' AND '9' THEN c ELSE CAST(ascii(c) - 55 AS VARCHAR) END), ''), ''), lambda c: CAST(c AS BIGINT))), lambda x, y: (x * 10 + y) % 97) = 1",
    "IPV4_ADDRESS": _V4.format(x="value"),
    "IPV6_ADDRESS": f"regexp_full_match(regexp_replace(split_part(value, '%', 1), '{_TAIL_V4}', ':0:0'), '{_FORMS}')",
    "IPV6_CIDR": f"regexp_full_match(regexp_replace(split_part(value, '/', 1), '{_TAIL_V4}', ':0:0'), '{_FORMS}') AND coalesce(TRY_CAST(split_part(value, '/', 2) AS INTEGER), 999) <= 128",
    "IPV4_CIDR": _V4.format(x="split_part(value, '/', 1)") + " AND CAST(split_part(value, '/', 2) AS INTEGER) <= 32",
}


def _pack_sql(rules: list[Rule]) -> str:
    """All rules as spans in RE2's dialect, checked and then resolved, the longest first."""
    each = []
    for i, r in enumerate(rules):
        value = f"trim(value, {_BLANK})"
        apart = next((v for k, v in APART.items() if r.pattern.startswith(k)), None)
        for parts in [("(?m)", *x, None) for x in apart] if apart else [re2(r.pattern, r.flags)]:
            spans = f"SELECT doc_id, start, stop, {value} AS value, '{r.entity_type}' AS entity_type, {i} AS ord FROM ({_parts_sql('documents', parts)}) AS s"
            each.append(f"SELECT * FROM ({spans}) AS t WHERE value <> '' AND {_SQL_CHECKS.get(r.entity_type, 'true')}")
    return _resolved_sql(" UNION ALL ".join(each), "start - stop, start, ord")


_BLANK = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
ORACLES["default_pack"] = _pack_sql(load_pack())


def detect_lateral(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the default pack as a table function, joined laterally in SQL."""
    table_function.register(spark, load_pack(), "cloakwork_default")
    return spark.sql("SELECT d.doc_id, e.* FROM {docs} AS d, LATERAL cloakwork_default(d.text) AS e", docs=docs(spark, sf_dir))


QUERIES["detect_lateral"] = detect_lateral
ORACLES["detect_lateral"] = ORACLES["default_pack"]
ORACLES["extended_pack"] = _pack_sql(load_pack("bundled:rules_extended.yaml"))

FLAGGED = [(1, "Token: ABC\ntoken: def"), (2, "x token:ghi"), (3, "TOKEN: é1")]


def rule_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A multi-line, caseless rule with a group."""
    rule = Rule("TOKEN", r"^token:\s*(\S+)", ("IGNORECASE", "MULTILINE"))
    found = D.scan(frame(spark, FLAGGED, "doc_id bigint, text string"), [rule]).select("doc_id", F.explode_outer("candidates").alias("c")).where("c is not null")
    return found.select("doc_id", "c.start", F.col("c.end").alias("stop"), "c.value")


QUERIES["rule_flags"] = rule_flags
ORACLES["rule_flags"] = _spans_sql(f"(SELECT CAST(doc_id AS BIGINT) AS doc_id, text FROM {values(FLAGGED, ['doc_id', 'text'])})", r"(?im)(^token:\s*)(\S+)", 2)


# ---- denylists ---------------------------------------------------------------------------------------------------------

EXACT = [Literal("PERSON", "The", True, True), Literal("ORGANIZATION", "The the", True, True), Literal("OTHER", "ing", True, False), Literal("PROJECT", "of the", True, True)]
CASELESS = [Literal("ORGANIZATION", "the", False, True), Literal("IDENTIFIER", "TION", False, False)]


def _deny(entries: list[Literal], backend: str = "regex"):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = D.denylist(docs(spark, sf_dir), entries, backend=backend).select("doc_id", F.explode_outer("candidates").alias("c")).where("c is not null")
        return found.select("doc_id", "c.start", F.col("c.end").alias("stop"), "c.value", "c.entity_type")

    return run


def _deny_sql(entries: list[Literal], source: str = "documents") -> str:
    """The alternation, longest fragment first, with ASCII word characters told apart from letters beyond by hand."""
    fragments = sorted((D.literal_pattern(e) for e in entries), key=len, reverse=True)
    exact = entries[0].case_sensitive
    pattern = ("" if exact else "(?i)") + "|".join(f"(?:{f})" for f in fragments)
    types = " ".join(f"WHEN {'value' if exact else 'lower(value)'} = '{e.value if exact else e.value.lower()}' THEN '{e.entity_type}'" for e in entries)
    return f"SELECT doc_id, start, stop, value, CASE {types} END AS entity_type FROM ({_spans_sql(source, pattern)}) AS s"


def _bounded_sql(entries: list[Literal], source: str = "documents") -> str:
    """Exact entries with boundaries told by the characters beside each occurrence, then the leftmost and longest ones."""
    each = []
    for e in entries:
        lit = e.value.replace("'", "''")
        edge = lambda at: f"NOT regexp_matches(substr(text, {at}, 1), '[\\pL\\pN_]')"
        tests = [edge("start") + " OR start = 0"] * (e.word_boundary and (e.value[0].isalnum() or e.value[0] == "_")) + [edge("stop + 1")] * (e.word_boundary and (e.value[-1].isalnum() or e.value[-1] == "_"))
        found = f"SELECT doc_id, text, CAST(unnest(list_transform(range(1, len(p)), lambda i: list_sum(list_transform(p[1:i], lambda x: length(x))) + (i - 1) * {len(e.value)})) AS INTEGER) AS start FROM (SELECT doc_id, text, string_split(text, '{lit}') AS p FROM {source}) AS a"
        each.append(f"SELECT doc_id, start, stop, '{lit}' AS value, '{e.entity_type}' AS entity_type FROM (SELECT *, start + {len(e.value)} AS stop FROM ({found}) AS b) AS c WHERE " + " AND ".join(f"({t})" for t in tests or ["true"]))
    return f"""
WITH RECURSIVE c AS ({" UNION ALL ".join(each)}),
lists AS (SELECT doc_id, list({{'a': start, 'b': stop, 'v': value, 't': entity_type}} ORDER BY start, start - stop) AS l FROM c GROUP BY doc_id),
fold AS (SELECT doc_id, 0 AS i, l, 0 AS last, false AS taken FROM lists
  UNION ALL SELECT doc_id, i + 1, l, CASE WHEN l[i + 1].a >= last THEN l[i + 1].b ELSE last END, l[i + 1].a >= last FROM fold WHERE i < len(l))
SELECT doc_id, l[i].a AS start, l[i].b AS stop, l[i].v AS value, l[i].t AS entity_type FROM fold WHERE taken
"""


#: Entries without word boundaries: RE2 takes letters beyond ASCII for the edge of a word.
BARE = [Literal("ORGANIZATION", "tion the", True, False), Literal("OTHER", "ing", True, False), Literal("PERSON", "tion", True, False)]
QUERIES["denylist_bare"] = _deny(BARE)
ORACLES["denylist_bare"] = _deny_sql(BARE)
QUERIES["denylist_exact"] = _deny(EXACT)
ORACLES["denylist_exact"] = _bounded_sql(EXACT)


def listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A denylist as a table: pairs of neighbouring words of the benchmark, and its long words whatever their case and surroundings."""
    words = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)).alias("w"))
    pairs = words.select(F.explode(F.transform(F.slice("w", F.lit(2), F.size("w")), lambda x, i: F.concat_ws(" ", F.get("w", i), x))).alias("value"), F.lit("PHRASE").alias("entity_type"), F.lit(True).alias("case_sensitive"), F.lit(True).alias("word_boundary"))
    long = words.select(F.explode(F.filter("w", lambda x: F.length(x) >= 8)).alias("value"), F.lit("TERM").alias("entity_type"), F.lit(False).alias("case_sensitive"), F.lit(False).alias("word_boundary"))
    return pairs.unionByName(long)


def denylist_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = N.detect(docs(spark, sf_dir), listed(spark, sf_dir), ["doc_id"]).select("doc_id", F.explode_outer("candidates").alias("c")).where("c is not null")
    return found.select("doc_id", "c.start", F.col("c.end").alias("stop"), "c.value", "c.entity_type")


QUERIES["denylist_entries"] = denylist_entries
ORACLES["denylist_entries"] = _resolved_sql(r"""
    WITH w AS (SELECT regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM benchmark),
    e AS MATERIALIZED (SELECT DISTINCT x AS needle, 0 AS ord, 'PHRASE' AS entity_type FROM (SELECT unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS x FROM w) AS a
          UNION ALL SELECT DISTINCT lower(x), 1, 'TERM' FROM (SELECT unnest(w) AS x FROM w) AS a WHERE length(x) >= 8),
    d AS (SELECT doc_id, text, CASE WHEN ord = 0 THEN text ELSE lower(text) END AS body, ord FROM documents, (VALUES (0), (1)) AS o(ord) WHERE length(text) >= 3),
    g AS MATERIALIZED (SELECT doc_id, ord, unnest(range(1, len(c) - 1)) AS i, unnest(list_transform(range(1, len(c) - 1), lambda i: concat(c[i], c[i + 1], c[i + 2], c[i + 3], c[i + 4], c[i + 5]))) AS six FROM (SELECT doc_id, ord, string_split(body, '') AS c FROM d) AS a),
    near AS MATERIALIZED (SELECT doc_id, g.ord AS ord, i, needle, entity_type FROM g JOIN e ON six = left(needle, 6) AND g.ord = e.ord WHERE length(needle) >= 6
             UNION ALL SELECT doc_id, g.ord, i, needle, entity_type FROM g JOIN e ON left(six, 3) = left(needle, 3) AND g.ord = e.ord WHERE length(needle) < 6),
    SELECT d.doc_id, CAST(i - 1 AS INTEGER) AS start, CAST(i - 1 + length(needle) AS INTEGER) AS stop, substr(text, i, length(needle)) AS value, entity_type, d.ord
    FROM near JOIN d ON near.doc_id = d.doc_id AND near.ord = d.ord WHERE substr(body, i, length(needle)) = needle AND (d.ord = 1
      OR ((i = 1 OR NOT regexp_matches(substr(text, i, 1), '[\pL\pN_]') OR NOT regexp_matches(substr(text, i - 1, 1), '[\pL\pN_]'))
      AND (NOT regexp_matches(right(needle, 1), '[\pL\pN_]') OR NOT regexp_matches(substr(text, i + length(needle), 1), '[\pL\pN_]'))))
""", "start - stop, start, ord")
QUERIES["denylist_automaton"] = _deny(BARE[1:], "aho")
ORACLES["denylist_automaton"] = _deny_sql(BARE[1:])
BARE_CASELESS = [Literal("IDENTIFIER", "TION", False, False), Literal("OTHER", "ed.", False, False)]
QUERIES["denylist_caseless"] = _deny(BARE_CASELESS)
ORACLES["denylist_caseless"] = _deny_sql(BARE_CASELESS)

#: Entries that begin, or are part of, longer words and longer entries.
PEOPLE = [Literal("PERSON", "Re"), Literal("PERSON", "The"), Literal("ORGANIZATION", "of"), Literal("ORGANIZATION", "of the"), Literal("OTHER", "de la"), Literal("OTHER", "de")]


def denylist_boundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over all turns."""
    turns = spread(spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "text"))
    found = D.denylist(turns, PEOPLE).select("conv_id", "turn", F.explode_outer("candidates").alias("c")).where("c is not null")
    return found.select("conv_id", "turn", "c.start", F.col("c.end").alias("stop"), "c.value", "c.entity_type")


QUERIES["denylist_boundary"] = denylist_boundary
ORACLES["denylist_boundary"] = f"SELECT doc_id // 1000 AS conv_id, doc_id % 1000 AS turn, start, stop, value, entity_type FROM ({_bounded_sql(PEOPLE, '(SELECT conv_id * 1000 + turn AS doc_id, text FROM conversations)')}) AS b"
