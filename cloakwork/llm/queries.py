"""The registered queries of this subpackage and their DuckDB counterparts where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakwork.llm.common import table

QUERIES: dict = {}
ORACLES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cloakwork.llm.language_id import label_documents

    return label_documents(table(spark, sf_dir, "documents"))


@query
def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cloakwork.llm.decontaminate import digest, report

    return digest(report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


LOWER_ASCII = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES["op2_decontaminate"] = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({LOWER_ASCII}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({LOWER_ASCII}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item, least(10, len(w)) AS n, w[i:i + least(10, len(w)) - 1] AS x
        FROM b, unnest(generate_series(1, greatest(1, len(w) - 9))) AS t(i) WHERE len(w) > 0),
pos AS (SELECT doc_id, i, n, w[i:i + n - 1] AS x FROM d, (SELECT DISTINCT n FROM win) AS l, unnest(generate_series(1, len(w) - n + 1)) AS t(i)),
hits AS (SELECT DISTINCT doc_id, i, pos.n AS n, item FROM pos JOIN win ON pos.n = win.n AND pos.x = win.x),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

@query
def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cloakwork.llm.secret_scan import digest, scan

    return digest(scan(table(spark, sf_dir, "documents")))


def _op3_sql() -> str:
    from cloakwork.llm import secret_scan as S

    def spans(pattern: str, kind: int, value: str = "true") -> str:
        p = pattern.replace("'", "''")
        return f"""SELECT doc_id, {kind} AS kind, start, start + len AS stop FROM (
            SELECT doc_id, unnest(list_transform(range(1, len(m) + 1), lambda i: list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0))) AS start,
                   unnest(list_transform(m, lambda x: length(x))) AS len, unnest({'list_transform(v, lambda x: length(x) >= 8)' if value != 'true' else 'list_transform(m, lambda x: true)'}) AS ok
            FROM (SELECT doc_id, regexp_extract_all(body, '{p}') AS m, string_split_regex(body, '{p}') AS g, {f"regexp_extract_all(body, '{p}', 2)" if value != 'true' else 'NULL'} AS v FROM d)) WHERE ok"""

    names = "['" + "','".join(S.KINDS) + "']"
    near = lambda c: f"EXISTS (SELECT 1 FROM p AS q WHERE q.doc_id = p.doc_id AND q.kind IN ({','.join(str(i) for i, k in enumerate(S.KINDS) if S.CLASSES[k] == c)}) AND q.start <= p.stop + 200 AND q.stop >= p.start - 200)"
    listed = f"string_agg({names}[kind + 1] || ':' || CAST(start AS BIGINT) || ':' || CAST(stop AS BIGINT), ',' ORDER BY start, kind, stop)"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS body FROM documents),
p AS ({spans(S.ASSIGN, 0, 'value')} UNION ALL {spans(S.ACCESS, 1)} UNION ALL {spans(S.HEX, 2)} UNION ALL {spans(S.ACCESS_PART, 3)} UNION ALL {spans(S.SECRET_PART, 4)} UNION ALL {spans(S.ENDPOINT_PART, 5)}),
base AS (SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex, {listed} AS listed FROM p WHERE kind < 3 GROUP BY doc_id),
weak AS (SELECT * FROM p WHERE kind >= 3 AND ((kind = 3 AND {near('secret')}) OR (kind = 4 AND ({near('id')} OR {near('endpoint')})) OR (kind = 5 AND {near('id')} AND {near('secret')}))
         AND NOT EXISTS (SELECT 1 FROM p AS q WHERE q.doc_id = p.doc_id AND q.kind < 3 AND q.start < p.stop AND p.start < q.stop)),
every AS (SELECT doc_id, {listed} AS spans FROM (SELECT * FROM p WHERE kind < 3 UNION ALL SELECT * FROM weak) GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(listed, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN base USING (doc_id) LEFT JOIN every USING (doc_id)
"""


ORACLES["op3_secret_scan"] = _op3_sql()


@query
def op9_piece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cloakwork.llm.piece_sampling import digest

    return digest(table(spark, sf_dir, "documents"))


@query
def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cloakwork.llm.quality_rules import judge

    return judge(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("posterior", 6).alias("posterior"))


@query
def op6_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cloakwork.llm.near_dup import components

    return components(table(spark, sf_dir, "documents"), k=3, percent=85).select("doc_id", "n_shingles", "component_id", "kept")


@query
def op10_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cloakwork.llm.warc_zip import round_trip

    return round_trip(table(spark, sf_dir, "pages"))


_B32 = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((v[{i + 1}] >> {s}) & 31 AS INTEGER) + 1, 1)" for i in range(8) for s in (15, 10, 5, 0))
ORACLES["op10_warc_zip"] = f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
h AS (SELECT page_id, octet_length(payload) AS n, sha1(payload) AS sha, max(page_id) OVER (PARTITION BY payload) AS top FROM p),
d AS (SELECT *, list_transform(range(0, 8), lambda i: ('0x' || substr(sha, CAST(1 + 5 * i AS INTEGER), 5))::BIGINT) AS v FROM h)
SELECT page_id, n AS payload_bytes, {_B32} AS payload_digest, CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> top THEN top END AS refers_to
FROM d
"""


@query
def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cloakwork.llm.url_filter import judge

    return judge(table(spark, sf_dir, "pages"))


@query
def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cloakwork.llm.license_scan import digest, scan

    return digest(scan(table(spark, sf_dir, "documents")))


def _op5_sql() -> str:
    from cloakwork.llm.license_scan import TEMPLATES

    values = ", ".join(f"('{k}', '{v.replace(chr(39), chr(39) * 2)}')" for k, v in sorted(TEMPLATES.items()))
    words = lambda x: f"regexp_extract_all(translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    bigrams = lambda w: f"list_distinct(list_transform(range(1, len({w})), lambda i: {w}[i] || ' ' || {w}[i + 1]))"
    return rf"""
WITH RECURSIVE t AS (SELECT name, {bigrams('w')} AS b FROM (SELECT name, {words('text')} AS w FROM (VALUES {values}) AS v(name, text))),
d AS (SELECT doc_id, coalesce(text, '') AS body FROM documents),
seg AS (
  SELECT doc_id, 0 AS level, i - 1 AS place, p[i] AS body FROM (SELECT doc_id, string_split(body, chr(10)) AS p FROM d), unnest(range(1, len(p) + 1)) AS u(i)
  UNION ALL SELECT doc_id, 1, i - 1, p[i] FROM (SELECT doc_id, string_split_regex(body, '\n[ \t]*\n[ \t\n\f\r]*') AS p FROM d), unnest(range(1, len(p) + 1)) AS u(i) WHERE contains(p[i], chr(10))
  UNION ALL SELECT doc_id, 2, 0, body FROM d WHERE len(string_split_regex(body, '\n[ \t]*\n[ \t\n\f\r]*')) > 1),
own AS (SELECT doc_id, level, place, {bigrams('w')} AS b FROM (SELECT doc_id, level, place, {words('body')} AS w FROM seg) WHERE len(w) > 1),
hit AS (SELECT doc_id, level, place, name, len(o.b) + len(t.b) AS n, len(list_intersect(o.b, t.b)) AS shared FROM own AS o JOIN t ON len(o.b) * 120 >= len(t.b) * 80 AND len(t.b) * 120 >= len(o.b) * 80 AND list_has_any(o.b, t.b)),
good AS (SELECT doc_id, level, place, name, round(shared * 2 / n, 6) AS dice FROM hit WHERE shared * 200 >= n * 80),
-- runs of lines: from each line with a shared bigram, the bigrams that are new since then, line by line
tok AS (SELECT doc_id, line, unnest(w) AS word, generate_subscripts(w, 1) AS k FROM (SELECT doc_id, place AS line, {words('body')} AS w FROM seg WHERE level = 0)),
bg AS (SELECT *, lag(a) OVER (PARTITION BY doc_id, h ORDER BY pos) AS before FROM (SELECT doc_id, row_number() OVER o AS pos, line AS a, lead(line) OVER o AS b, word || ' ' || lead(word) OVER o AS h FROM tok WINDOW o AS (PARTITION BY doc_id ORDER BY line, k)) WHERE b IS NOT NULL),
tb AS (SELECT name, len(b) AS size, unnest(b) AS h FROM t),
likely AS (SELECT doc_id, name, size FROM (SELECT DISTINCT doc_id, h FROM bg) JOIN tb USING (h) GROUP BY doc_id, name, size HAVING count(*) * 120 >= size * 80),
starts AS (SELECT DISTINCT l.doc_id, l.name, l.size, a AS i FROM likely AS l JOIN tb ON tb.name = l.name JOIN bg ON bg.doc_id = l.doc_id AND bg.h = tb.h),
grown AS (SELECT s.doc_id, s.name, s.size, i, g.b AS j, count(*) OVER r AS own, count(tb.h) OVER r AS shared FROM starts AS s JOIN bg AS g ON g.doc_id = s.doc_id AND g.a >= i AND coalesce(g.before, -1) < i LEFT JOIN tb ON tb.name = s.name AND tb.h = g.h
  WINDOW r AS (PARTITION BY s.doc_id, s.name, i ORDER BY g.pos)),
runs AS (SELECT doc_id, name, i, j, round(max(shared) * 2 / (max(own) + size), 6) AS dice FROM grown WHERE j > i GROUP BY doc_id, name, size, i, j HAVING max(shared) * 200 >= (max(own) + size) * 80),
para AS (SELECT doc_id, k - 1 AS k, coalesce(list_sum(list_transform(p[1:k - 1], lambda x: len(x) - len(replace(x, chr(10), '')))), 0) + coalesce(list_sum(list_transform(g[1:k - 1], lambda x: len(x) - len(replace(x, chr(10), '')))), 0) AS top, len(p[k]) - len(replace(p[k], chr(10), '')) AS more
  FROM (SELECT doc_id, string_split_regex(body, '\n[ \t]*\n[ \t\n\f\r]*') AS p, regexp_extract_all(body, '\n[ \t]*\n[ \t\n\f\r]*') AS g FROM d WHERE doc_id IN (SELECT doc_id FROM runs)), unnest(range(1, len(p) + 1)) AS u(k)),
free AS (SELECT * FROM runs AS r WHERE NOT EXISTS (SELECT 1 FROM good AS m WHERE m.doc_id = r.doc_id AND m.name = r.name AND (m.level = 2 OR (m.level = 0 AND m.place BETWEEN i AND j)
  OR (m.level = 1 AND m.place BETWEEN (SELECT k FROM para WHERE para.doc_id = r.doc_id AND i BETWEEN top AND top + more) AND (SELECT k FROM para WHERE para.doc_id = r.doc_id AND j BETWEEN top AND top + more))))),
lists AS (SELECT doc_id, list({{'i': i, 'j': j, 'name': name, 'dice': dice}} ORDER BY dice DESC, j - i, i, j, name) AS l FROM free GROUP BY doc_id),
fold AS (SELECT doc_id, 0 AS n, l, l[1:0] AS kept FROM lists
  UNION ALL SELECT doc_id, n + 1, l, CASE WHEN len(list_filter(kept, lambda o: o.name = l[n + 1].name AND o.i <= l[n + 1].j AND l[n + 1].i <= o.j)) = 0 THEN list_append(kept, l[n + 1]) ELSE kept END FROM fold WHERE n < len(l)),
every AS (SELECT * FROM good UNION ALL SELECT doc_id, 3, x.i, x.name, x.dice FROM (SELECT doc_id, unnest(kept) AS x FROM fold WHERE n = len(l))),
best AS (SELECT doc_id, count(*) AS n_matches, string_agg(name || ':' || ['line', 'paragraph', 'text', 'run'][level + 1] || ':' || place, ',' ORDER BY dice DESC, level, name, place) AS matches,
         first(name ORDER BY dice DESC, level, name, place) AS license, max(dice) AS dice FROM every GROUP BY doc_id)
SELECT d.doc_id, license, dice, coalesce(n_matches, 0) AS n_matches, coalesce(matches, '') AS matches FROM d LEFT JOIN best USING (doc_id)
"""


ORACLES["op5_license_scan"] = _op5_sql()


@query
def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cloakwork.llm.chat_format import format_chats

    return format_chats(table(spark, sf_dir, "conversations"))


ORACLES["op7_chat_format"] = """
WITH turns AS (SELECT DISTINCT 'c' || conv_id AS c, conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL
     UNION ALL SELECT 'n' || row_number() OVER (), NULL, turn, role, text FROM conversations WHERE conv_id IS NULL),
convs AS (SELECT any_value(conv_id) AS conv_id, list(coalesce(CAST(length(role) AS VARCHAR), 'null') || ':' || coalesce(role, '') || coalesce(CAST(length(text) AS VARCHAR), 'null') || ':' || coalesce(text, '') ORDER BY turn NULLS FIRST, role NULLS FIRST, text) AS t,
          string_agg('<|im_start|>' || replace(coalesce(role, ''), '<|', '<\\|') || chr(10) || replace(coalesce(text, ''), '<|', '<\\|') || '<|im_end|>' || chr(10), '' ORDER BY turn NULLS FIRST, role NULLS FIRST, text) AS rendered
          FROM turns GROUP BY c),
pre AS (SELECT DISTINCT t[1:i] AS p FROM convs, unnest(range(1, len(t))) AS u(i)),
whole AS (SELECT t, min(conv_id) AS conv_id, count(*) AS copies, any_value(rendered) AS rendered FROM convs GROUP BY t)
SELECT conv_id, len(t) AS n_turns, copies, rendered FROM whole AS w WHERE NOT EXISTS (SELECT 1 FROM pre WHERE pre.p = w.t)
"""


#: All pairs that share a shingle, counted: for small tables.
ORACLES["op6_near_dup"] = rf"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex({LOWER_ASCII}, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 3 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 2], ' ') END AS sh FROM w, unnest(range(1, greatest(len(w) - 1, 2))) AS u(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s AS a JOIN s AS b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (SELECT x, y FROM pairs JOIN n AS nx ON nx.doc_id = x JOIN n AS ny ON ny.doc_id = y WHERE 100 * c >= 85 * (nx.n + ny.n - c)),
both_ways AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
reach AS (SELECT doc_id AS v, doc_id AS r FROM documents UNION SELECT v, y FROM reach JOIN both_ways ON r = x)
SELECT v AS doc_id, coalesce(any_value(n), 0) AS n_shingles, min(r) AS component_id, v = min(r) AS kept FROM reach LEFT JOIN n ON n.doc_id = v GROUP BY v
"""

def _op8_sql() -> str:
    from cloakwork.llm import quality_rules as Q

    words, chars, lines = "greatest(n_words, 1)", "greatest(word_chars, 1)", "greatest(n_lines, 1)"
    bands = [
        ("n_words >= 100", "n_words < 50"),
        (f"{chars} BETWEEN 4 * {words} AND 7 * {words}", f"{chars} < 3 * {words} OR {chars} > 10 * {words}"),
        ("n_symbols * 50 <= n_words", "n_symbols * 10 > n_words"),
        (f"n_dup_lines * 10 <= {lines}", f"n_dup_lines * 10 > 3 * {lines}"),
        (f"n_repeat_words * 4 <= {words}", f"n_repeat_words * 5 > 2 * {words}"),
        (f"n_upper * 500 >= {chars} AND n_upper * 20 <= {chars}", f"n_upper * 10 > 3 * {chars}"),
        (f"n_digits * 20 <= {chars}", f"n_digits * 20 > 3 * {chars}"),
        (f"n_ended * 5 >= 4 * {lines}", f"n_ended * 2 < {lines}"),
    ]
    k = len(bands)
    votes = "[" + ", ".join(f"CASE WHEN {bad} THEN -1 WHEN {good} THEN 1 ELSE 0 END" for good, bad in bands) + "]"
    kinds, rules = f"range(1, {k + 2})", f"range(1, {k + 1})"
    listed = lambda x: "[" + ", ".join(f"{v}::DOUBLE" for v in x) + "]"
    share = listed([0.5] + [0.5 / k] * k)
    begun = f"list_transform({kinds}, lambda m: list_transform({rules}, lambda r: CASE WHEN m = 1 THEN {listed(Q.START_GOOD)} WHEN m = r + 1 THEN {listed(Q.START_OWN)} ELSE {listed(Q.START_OTHER)} END))"
    weight = lambda v: f"list_transform({kinds}, lambda m: exp(ln(share[m]) + list_sum(list_transform({rules}, lambda r: ln(rate[m][r][{v}[r] + 2])))))"
    return rf"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(text, '') AS t, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
   list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
win AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i:i + 2]) AS c FROM d, unnest(range(1, len(w) - 1)) AS u(i)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM win WHERE c > 1) AS x GROUP BY doc_id),
counts AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
   CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words, len(l) AS n_lines, len(regexp_extract_all(t, '[A-Z]')) AS n_upper, len(regexp_extract_all(t, '[0-9]')) AS n_digits,
   len(list_filter(l, lambda x: regexp_matches(x, '[.!?:"][\x20\x09-\x0D]*$'))) AS n_ended FROM d LEFT JOIN hit ON hit.doc_id = d.doc_id),
voted AS (SELECT *, {votes} AS v FROM counts),
pats AS (SELECT list({{'v': v, 'c': c}} ORDER BY v) AS l, sum(c) AS total FROM (SELECT v, count(*) AS c FROM voted GROUP BY v) AS x),
em AS (SELECT 0 AS i, {share} AS share, {begun} AS rate
  UNION ALL SELECT i + 1,
    list_transform({kinds}, lambda m: (list_sum(list_transform(g, lambda p: p.g[m])) + {Q.PSEUDO} * first_share[m]) / (total + {Q.PSEUDO})),
    list_transform({kinds}, lambda m: list_transform({rules}, lambda r: list_transform(range(1, 4), lambda o:
      (list_sum(list_transform(g, lambda p: CASE WHEN p.v[r] = o - 2 THEN p.g[m] ELSE 0 END)) + {Q.PSEUDO} * first_rate[m][r][o]) / (list_sum(list_transform(g, lambda p: p.g[m])) + {Q.PSEUDO}))))
  FROM (SELECT i, total, {share} AS first_share, {begun} AS first_rate, list_transform(e, lambda p: {{'v': p.v, 'g': list_transform(p.e, lambda y: p.c * y / list_sum(p.e))}}) AS g
    FROM (SELECT i, total, list_transform(l, lambda p: {{'v': p.v, 'c': p.c, 'e': {weight('p.v')}}}) AS e FROM em, pats WHERE i < {Q.ROUNDS}) AS y) AS z),
post AS (SELECT voted.*, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, {weight('v')} AS e FROM voted, em WHERE i = {Q.ROUNDS})
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND e[1] / list_sum(e) >= 0.5 AS kept, round(e[1] / list_sum(e), 6) AS posterior FROM post
"""


ORACLES["op8_quality_rules"] = _op8_sql()


@query
def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cloakwork.llm.whitening import whiten

    return whiten(table(spark, sf_dir, "embeddings"))


@query
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cloakwork.llm.hard_negatives import mine

    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(table(spark, sf_dir, "embeddings"), anchor=F.col("vec_id") % 100 == 0, label=label)


ORACLES["op11_hard_negatives"] = """
WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda c: CAST(floor(256 * CAST(c AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
           WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
s AS (SELECT DISTINCT a.vec_id AS anchor_id, r.vec_id AS other, a.label = r.label AS same, CAST(list_sum(list_transform(list_zip(a.x, r.x), lambda p: p[1] * p[2])) AS BIGINT) AS score
      FROM r AS a JOIN r ON a.vec_id <> r.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other) AS INTEGER) AS rank, other AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other) <= 10
"""


@query
def op12_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cloakwork.llm.quality_model import judge

    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
