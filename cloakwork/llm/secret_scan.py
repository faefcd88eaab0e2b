"""Secret scan with multipart credential linking.

Strong kinds are reported wherever they match: ``assign`` (a named secret with a value of 8 or more characters), ``access``
(an access key id of 16 or more characters) and ``hex`` (32 or more lower-case hexadecimal digits). Weak kinds are single
parts of a credential, which alone mean little: ``access_part`` (a user or client id), ``secret_part`` (a short password
assignment, or a bare run of 40 or more base-64 characters) and ``endpoint_part`` (a URL or an IPv4 address). A weak part is
reported only if complementary parts stand in its scope, with at most ``scope`` code points between the end of the one and
the start of the other: a secret part beside an identifier or an endpoint, an identifier beside a secret, an endpoint
beside both an identifier and a secret.

The interval join of parts with parts of the same document takes running maxima: a part has another in its scope if of
those that start at most ``scope`` after its end, the last end is at most ``scope`` before its start. So no pair of parts
is formed, and parts may have any length. The join stays inside the row: the parts' events are sorted and scanned in blocks
(``arrays.prefix``), so nothing is shuffled, each row is judged for itself whatever rows repeat it, and a text of many
matches costs little more than its patterns.

Defined results: null and empty texts have no spans; repeated rows and null doc_ids are reported row by row; weak parts that
overlap a strong span, or an earlier part of the same kind, are dropped. Positions count code points from 0, the end is
exclusive. The noncharacters U+FDD0 to U+FDD2 are searched as U+FDD3, which no pattern tells from them. Other columns are
ignored by ``scan`` unless kept, and kept by ``redact``; names that start with two underscores are reserved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakwork.functions.arrays import let, pieces, prefix, record, running_max, running_sum


def _any_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


def _names(*words: str) -> str:
    return "|".join(_any_case(w) for w in words)


SEPARATOR = r"""["']?\x20*[:=]\x20*["']?"""
ASSIGN = f"({_names('password', 'passwd', 'secret', 'token')}|{_any_case('api')}_?{_any_case('key')}){SEPARATOR}([A-Za-z0-9+/_.=-]+)"
#: Runs are maximal, so a least length in the pattern equals dropping short matches.
ACCESS = "AKIA[A-Z0-9]{12,}"
HEX = "[0-9a-f]{32,}"
ACCESS_PART = f"(?:{_names('client_id', 'access_key_id', 'username', 'user', 'login', 'account')}){SEPARATOR}[A-Za-z0-9._@-]{{3,}}"
SECRET_PART = f"(?:{_names('pwd', 'passphrase', 'pass', 'credential', 'private_key')}){SEPARATOR}[A-Za-z0-9!#$%&*+./=?@^_-]{{4,}}|[A-Za-z0-9+/]{{40,}}={{0,2}}"
ENDPOINT_PART = r"""[a-z]{2,8}://[^\x00-\x20"'<>]+|[0-9]{1,3}(?:\.[0-9]{1,3}){3}"""

#: In the order in which spans of the same start are listed. The class of each kind is what links look at.
KINDS = ["assign", "access", "hex", "access_part", "secret_part", "endpoint_part"]
CLASSES = {"assign": "secret", "access": "id", "hex": "secret", "access_part": "id", "secret_part": "secret", "endpoint_part": "endpoint"}
STRONG = 3

SPAN = "array<struct<start:int,kind:int,end:int>>"

#: Noncharacters that mark where a match begins, where its value does, and where both end.
BEGIN, VALUE, END = "\ufdd0", "\ufdd1", "\ufdd2"
OTHER = "\ufdd3"


#: (pattern, group of the value, least length of the value) of each kind.
PATTERNS = [(ASSIGN, 2, 8), (ACCESS, 0, 0), (HEX, 0, 0), (ACCESS_PART, 0, 0), (SECRET_PART, 0, 0), (ENDPOINT_PART, 0, 0)]


def _spans(text: Column, patterns: list[tuple[str, int, int]]) -> Column:
    """Of each pattern, all leftmost non-overlapping matches as (start, kind, end); those with a shorter value are dropped after matching.

    One pass of a pattern marks its matches; what stands between the marks gives lengths, and their running sums the places.
    """
    plain = F.translate(text, BEGIN + VALUE + END, OTHER * 3)
    marked = [
        record(body=F.when(text.rlike(p), F.regexp_replace(plain, F.lit(p), F.lit(f"{BEGIN}$0{VALUE}${group}{END}"))), kind=F.lit(kind), least=F.lit(least))
        for kind, (p, group, least) in enumerate(patterns)
    ]

    def placed(m: Column) -> Column:
        def measured(piece: Column) -> Column:
            value, end = F.instr(piece, VALUE), F.instr(piece, END)
            return record(len=value - 1, ok=end - value - 1 >= m["least"], rest=F.length(piece) - end)

        def spans(parts: Column) -> Column:
            ends = lambda x: running_sum(F.transform(x, lambda y, i: y["len"] + F.when(i == 0, F.length(F.get(parts, 0))).otherwise(F.get(x, i - 1)["rest"])))
            each = lambda x: F.zip_with(x, ends(x), lambda y, end: record(start=end - y["len"], kind=m["kind"], end=end, ok=y["ok"]))
            return let(F.transform(F.slice(parts, F.lit(2), F.size(parts)), measured), each)

        return let(F.split(m["body"], BEGIN, -1), spans)

    found = F.flatten(F.transform(F.filter(F.array(*marked), lambda m: m["body"].isNotNull()), placed))
    return F.transform(F.filter(found, lambda s: s["ok"]), lambda s: record(start=s["start"], kind=s["kind"], end=s["end"])).cast(SPAN)


def _listed(spans: Column) -> Column:
    """kind:start:end by start, then kind, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


NEVER = -(2**30)


def _linked(strong: Column, weak: Column, scope: int) -> Column:
    """The weak parts to report."""
    kinds = lambda c: [i for i, k in enumerate(KINDS) if CLASSES[k] == c]
    event = lambda p, at, asks: record(at=at, asks=F.lit(asks), start=p["start"], kind=p["kind"], end=p["end"])

    # A part stands at its start to be found; a weak one stands again at the end of its scope, behind those found there, to ask.
    events = F.sort_array(F.concat(F.transform(F.concat(strong, weak), lambda p: event(p, p["start"], 0)), F.transform(weak, lambda p: event(p, p["end"] + scope, 1))))

    def asked(e: Column) -> Column:
        seen = lambda x: record(**{c: F.when((x["asks"] == 0) & x["kind"].isin(kinds(c)), x["end"]).otherwise(NEVER) for c in ("id", "secret", "endpoint")})
        last = prefix(F.transform(e, seen), lambda a, b: record(**{c: F.greatest(a[c], b[c]) for c in ("id", "secret", "endpoint")}))

        def told(x: Column, m: Column) -> Column:
            has = {c: m[c] >= x["start"] - scope for c in ("id", "secret", "endpoint")}
            enough = ((x["kind"] == 3) & has["secret"]) | ((x["kind"] == 4) & (has["id"] | has["endpoint"])) | ((x["kind"] == 5) & has["id"] & has["secret"])
            return record(start=x["start"], kind=x["kind"], end=x["end"], ok=(x["asks"] == 1) & enough)

        return F.filter(F.zip_with(e, last, told), lambda x: x["ok"])

    # Of the strong spans that start before a part's end, none may end behind its start.
    def clear(parts: Column) -> Column:
        both = F.sort_array(F.concat(F.transform(parts, lambda p: event(p, p["end"], 0)), F.transform(strong, lambda p: event(p, p["start"], 1))))
        ends = lambda e: running_max(F.transform(e, lambda x: F.when(x["asks"] == 1, x["end"]).otherwise(NEVER)))
        free = lambda x, end: record(start=x["start"], kind=x["kind"], end=x["end"], ok=(x["asks"] == 0) & (end <= x["start"]))
        return F.filter(let(both, lambda e: F.zip_with(e, ends(e), free)), lambda x: x["ok"])

    found = let(let(events, asked), lambda p: F.when(F.size(p) > 0, clear(p)))
    return F.transform(F.coalesce(found, F.array().cast("array<struct<start:int,kind:int,end:int,ok:boolean>>")), lambda x: record(start=x["start"], kind=x["kind"], end=x["end"])).cast(SPAN)


def found_in(text: Column, scope: int = 200) -> Column:
    """A struct of base (strong spans) and spans (all), each sorted by start, kind and end."""
    body = F.coalesce(text, F.lit(""))

    def judged(p: Column) -> Column:
        classed = lambda *of: F.exists(p, lambda s: s["kind"].isin([i for i, k in enumerate(KINDS) if CLASSES[k] in of]))
        strong, weak = F.filter(p, lambda s: s["kind"] < STRONG), F.filter(p, lambda s: s["kind"] >= STRONG)
        linkable = F.exists(p, lambda s: s["kind"] >= STRONG) & classed("secret") & classed("id", "endpoint")
        links = F.when(linkable, let(strong, lambda s: let(weak, lambda w: _linked(s, w, scope)))).otherwise(F.array().cast(SPAN))
        return record(base=F.sort_array(strong), spans=F.sort_array(F.concat(strong, links)))

    return let(_spans(body, PATTERNS), judged)


def scan(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", scope: int = 200, keep: list[str] | None = None) -> DataFrame:
    """One row per row of docs: doc_id and the columns ``keep``, base (strong spans) and spans (all), as sorted arrays. Narrow."""
    found = docs.select(F.col(doc_id).alias("doc_id"), *(keep or []), found_in(F.col(text), scope).alias("__found"))
    return found.select("doc_id", *(keep or []), F.col("__found.base").alias("base"), F.col("__found.spans").alias("spans"))


def digest(scanned: DataFrame) -> DataFrame:
    """The columns of the contract."""
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return scanned.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"))


def _masked(body: Column, spans: Column, mask: str) -> Column:
    """body with ``mask`` in place of each run of overlapping spans (sorted by start)."""
    length = F.length(body)

    def rest(s: Column) -> Column:
        def ranges(top: Column) -> Column:
            before = F.transform(s, lambda x, i: record(first=F.when(i == 0, F.lit(0)).otherwise(F.get(top, i - 1)), last=x["start"]))
            return F.concat(F.filter(before, lambda r: r["last"] >= r["first"]), F.array(record(first=F.element_at(top, -1), last=length)))

        return let(running_max(F.transform(s, lambda x: x["end"])), ranges)

    return pieces(body, let(spans, rest), mask)


def redact(docs: DataFrame, text: str = "text", mask: str = "[SECRET]", scope: int = 200) -> DataFrame:
    """docs with each run of overlapping spans replaced by ``mask``; all columns and all rows are kept. Narrow: no shuffle."""
    body = F.col(text)
    found = docs.withColumn("__spans", found_in(body, scope)["spans"])
    return found.withColumn(text, F.when(F.size("__spans") > 0, _masked(body, F.col("__spans"), mask)).otherwise(body)).drop("__spans")
