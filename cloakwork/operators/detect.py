"""Detectors: expressions and operators from texts to candidate spans and matches.

Native detectors are one array expression per text, so that detection is narrow and a text is read once. Rules that the
native route can't express (several groups, look-behind into a group) run in Python's own dialect, batch by batch.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakwork.functions import spans as S
from cloakwork.functions import text as T
from cloakwork.functions.arrays import let, record, running_sum, runs
from cloakwork.model import (
    CANDIDATES,
    MATCHES,
    MERGE_CHARACTERS,
    MERGE_CHARACTERS_OTHERWISE,
    MERGE_GAP_OTHERWISE,
    MERGE_GAPS,
    SENTINEL,
    SPAN_LABELS,
    ZERO_SHOT_LABELS,
)
from cloakwork.sources.literals import fold, may_match, required
from cloakwork.sources.rules import Literal, Rule

# ---- rules -------------------------------------------------------------------------------------------------------------


def split_group(pattern: str) -> tuple[str, str, str] | None:
    """(before, inside, after) of a pattern's only capturing group, if it stands at the top level; otherwise None."""
    depth, i, opens, found, in_class = 0, 0, [], [], False
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            i += 2
            continue
        if in_class:
            in_class = c != "]"
        elif c == "[":
            in_class = True
            i += 1 if pattern[i + 1 : i + 2] == "^" else 0
            i += 1 if pattern[i + 1 : i + 2] == "]" else 0
        elif c == "(":
            capturing = pattern[i + 1 : i + 2] != "?"
            opens.append((i, capturing, depth))
            depth += 1
            if capturing or re.match(r"\(\?P?<[A-Za-z]", pattern[i:]):
                found.append([i, None, depth - 1])
        elif c == ")":
            depth -= 1
            at, _, _ = opens.pop()
            for f in found:
                if f[0] == at:
                    f[1] = i
        elif c == "|" and depth == 0:
            return None
        i += 1
    if len(found) != 1 or found[0][2] != 0 or re.match(r"[*+?{]", pattern[found[0][1] + 1 :]):
        return None
    start, end, _ = found[0]
    inside = re.sub(r"^\?P?<\w+>", "", pattern[start + 1 : end])
    return pattern[:start], inside, pattern[end + 1 :]


def native_rule(rule: Rule) -> tuple[str, bool] | None:
    """(Java pattern, grouped), or None if the rule needs Python's dialect."""
    if re.search(r"\((?!\?)|\(\?P<", re.sub(r"\\.|\[\^?\]?[^\]]*\]", "", rule.pattern)):
        cut = split_group(rule.pattern)
        if cut is None or "(?<" in re.sub(r"\(\?P<", "", rule.pattern):
            return None
        lead = re.match(r"\(\?[a-zA-Z]+\)", cut[0])
        flags, before = (lead[0], cut[0][lead.end() :]) if lead else ("", cut[0])
        return Rule(rule.entity_type, f"{flags}({before})({cut[1]}){cut[2]}", rule.flags).java(), True
    return rule.java(), False


def rule_candidates(text: Column, rules: list[Rule]) -> Column:
    """Candidates of all rules, without those that a validator refuses (which frees their place)."""
    sought = [S.Sought(java, rule.entity_type, i, grouped, rule.needs) for i, rule in enumerate(rules) for java, grouped in [native_rule(rule) or _refuse(rule)]]
    return F.filter(S.find_all(text, sought), lambda c: T.valid(c["value"], c["entity_type"]))


def _refuse(rule: Rule):
    raise ValueError(f"no native form for {rule.pattern!r}; use scan_with_python")


def scan(df: DataFrame, rules: list[Rule], text: str = "text", into: str = "candidates", strategy: str | None = None) -> DataFrame:
    """Adds the candidates of a pack that is native throughout; with a strategy, those that greedy allocation accepts."""
    out = df.withColumn(into, F.when(F.col(text).isNull() | (F.col(text) == ""), S.no_candidates()).otherwise(rule_candidates(F.col(text), rules)))
    return out if strategy is None else out.withColumn(into, S.greedy(F.col(into), strategy))


def _named(name: Column, default: Column, known: dict[str, Column]) -> Column:
    """What a name stands for; without a name, or with an unknown one, the default."""
    found = default
    for k, v in known.items():
        found = F.when(name == k, v).otherwise(found)
    return found


def unknown_name(name: Column, known: list[str]) -> Column:
    """A warning for a name that stands for nothing, else null."""
    return F.when((F.coalesce(name, F.lit("")) != "") & ~name.isin("default", *known), F.concat(F.lit("unknown name '"), name, F.lit("'; the default is used")))


def scan_named(df: DataFrame, default: list[Rule], packs: dict[str, list[Rule]], name: str, text: str = "text", into: str = "candidates") -> DataFrame:
    """Each row's text by the pack that its column ``name`` says; adds a column ``warning``. Packs are native throughout."""
    body = F.col(text)
    found = _named(F.col(name), rule_candidates(body, default), {k: rule_candidates(body, v) for k, v in packs.items()})
    return df.withColumn(into, F.when(body.isNull() | (body == ""), S.no_candidates()).otherwise(found)).withColumn("warning", unknown_name(F.col(name), list(packs)))


def denylist_named(df: DataFrame, default: list[Literal], lists: dict[str, list[Literal]], name: str, text: str = "text", into: str = "candidates") -> DataFrame:
    """Each row's text by the denylist that its column ``name`` says; adds a column ``warning``."""
    body = F.col(text)
    found = _named(F.col(name), denylist_candidates(body, default), {k: denylist_candidates(body, v) for k, v in lists.items()})
    spotted = df.withColumn(into, F.when(body.isNull() | (body == ""), S.no_candidates()).otherwise(found))
    return spotted.withColumn(into, S.greedy(F.col(into), "longest")).withColumn("warning", unknown_name(F.col(name), list(lists)))


def find_with_python(text: str, compiled: list[tuple[str, re.Pattern[str], list[list[str]]]], validators: dict) -> list[dict]:
    """D1 in Python's dialect: the named group ``entity``, else the first group that took part, else the match.

    Rules are skipped if the text lacks literals that they need.
    """
    found, folded = [], fold(text)
    for order, (kind, pattern, needs) in enumerate(compiled):
        if not may_match(folded, needs):
            continue
        named = "entity" in pattern.groupindex
        for m in pattern.finditer(text):
            group = "entity" if named and m.group("entity") is not None else next((g for g in range(1, pattern.groups + 1) if m.group(g) is not None), 0)
            value = m.group(group).strip()
            check = validators.get(kind)
            if value and (check is None or check(value)):
                found.append({"start": m.start(group), "end": m.end(group), "value": value, "entity_type": kind, "ord": order})
    return found


def python_validators() -> dict:
    import ipaddress

    def digits(s: str) -> list[int]:
        return [int(c) for c in s if c in "0123456789"]

    def luhn(s: str) -> bool:
        d = digits(s)[::-1]
        return len(d) >= 2 and (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0

    def iban(s: str) -> bool:
        s = s.replace(" ", "").upper()
        return len(s) >= 5 and s.isascii() and s.isalnum() and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1

    def v4(s: str) -> bool:
        parts = s.split(".")
        return len(parts) == 4 and all(p.isascii() and p.isdigit() and int(p) <= 255 for p in parts)

    def v4_net(s: str) -> bool:
        host, slash, bits = s.rpartition("/")
        return bool(slash) and v4(host) and bits.isascii() and bits.isdigit() and int(bits) <= 32

    def ip6(make, s: str) -> bool:
        try:
            make(s)
        except ValueError:
            return False
        return True

    return {
        "CREDIT_CARD": luhn, "IBAN": iban, "IPV4_ADDRESS": v4, "IPV4_CIDR": v4_net,
        "IPV6_ADDRESS": lambda s: ip6(ipaddress.IPv6Address, s.split("%")[0]), "IPV6_CIDR": lambda s: ip6(lambda x: ipaddress.IPv6Network(x, strict=False), s),
    }


CANDIDATE_ARROW = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("value", pa.string()), ("entity_type", pa.string()), ("ord", pa.int32())]))


def _mapped(df: DataFrame, into: str, make, text: str) -> DataFrame:
    """df with a column of candidates that make() (called once a task) gives for each text."""
    at = df.columns.index(text)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), f"`{into}` {CANDIDATES}"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = make()
        for batch in batches:
            found = [find(t) if t else [] for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, CANDIDATE_ARROW)], names=[*batch.schema.names, into])

    return df.mapInArrow(run, schema)


def scan_with_python(df: DataFrame, rules: list[Rule], text: str = "text", into: str = "candidates", strategy: str | None = None) -> DataFrame:
    """D3: any pack, in Python's dialect; each rule keeps its place in the pack."""

    def make():
        compiled, checks = [(r.entity_type, r.python(), required(r.python())) for r in rules], python_validators()
        return lambda t: find_with_python(t, compiled, checks)

    out = _mapped(df, into, make, text)
    return out if strategy is None else out.withColumn(into, S.greedy(F.col(into), strategy))


# ---- denylists ---------------------------------------------------------------------------------------------------------


def _edge(c: str) -> bool:
    return c.isalnum() or c == "_"


def literal_pattern(e: Literal, java: bool = True) -> str:
    """The value, with a word boundary on each side whose edge is a word character."""
    body = re.escape(e.value)
    left = r"\b" if e.word_boundary and _edge(e.value[0]) else ""
    right = r"\b" if e.word_boundary and _edge(e.value[-1]) else ""
    return f"{left}{body}{right}"


def denylist_candidates(text: Column, entries: list[Literal]) -> Column:
    """One alternation for exact and one for caseless entries, longest fragment first; exact ones win ties."""
    found = []
    for exact in (True, False):
        mine = [e for e in entries if e.case_sensitive is exact]
        if not mine:
            continue
        fragments = sorted((literal_pattern(e) for e in mine), key=len, reverse=True)
        pattern = ("(?dU)" if exact else "(?dUiu)") + "|".join(f"(?:{f})" for f in fragments)
        types = {(e.value if exact else e.value.lower()): e.entity_type for e in mine}
        hits = S.find(text, pattern, "", 0 if exact else 1, stripped=False)

        def kind(v: Column) -> Column:
            """The entry's type: sets of values by type, each of which is one look into a hash set."""
            found = F.lit(None).cast("string")
            for t in dict.fromkeys(types.values()):  # noqa: B023
                found = F.when((v if exact else F.lower(v)).isin([k for k, x in types.items() if x == t]), t).otherwise(found)  # noqa: B023
            return found

        typed = F.transform(hits, lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), c["value"].alias("value"), kind(c["value"]).alias("entity_type"), c["ord"].alias("ord")))  # noqa: B023
        found.append(F.filter(typed, lambda c: c["entity_type"].isNotNull()).cast(CANDIDATES))
    return F.concat(*found) if found else S.no_candidates()


def denylist(df: DataFrame, entries: list[Literal], text: str = "text", into: str = "candidates", backend: str = "regex") -> DataFrame:
    """Adds the accepted spans of a denylist. ``aho`` finds overlapping hits too, before allocation."""
    if backend == "regex":
        spotted = df.withColumn(into, F.when(F.col(text).isNull() | (F.col(text) == ""), S.no_candidates()).otherwise(denylist_candidates(F.col(text), entries)))
    else:
        spotted = _mapped(df, into, lambda: _automaton(entries), text)
    return spotted.withColumn(into, S.greedy(F.col(into), "longest"))


def _automaton(entries: list[Literal]):
    """All hits of all entries in one pass each for exact and caseless ones; boundaries are checked afterwards."""
    import ahocorasick

    machines = []
    for exact in (True, False):
        of: dict[str, list[Literal]] = {}
        for e in entries:
            if e.case_sensitive is exact:
                of.setdefault(e.value if exact else e.value.lower(), []).append(e)
        if of:
            machine = ahocorasick.Automaton()
            for k, v in of.items():
                machine.add_word(k, (len(k), v[-1]))
            machine.make_automaton()
            machines.append((exact, machine))

    def find(text: str) -> list[dict]:
        found = []
        for exact, machine in machines:
            lowered = text if exact else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
            for last, (n, e) in machine.iter(lowered):
                start, end = last - n + 1, last + 1
                if e.word_boundary:
                    if _edge(e.value[0]) and start and _edge(text[start - 1]):
                        continue
                    if _edge(e.value[-1]) and end < len(text) and _edge(text[end]):
                        continue
                found.append({"start": start, "end": end, "value": text[start:end], "entity_type": e.entity_type, "ord": 0 if exact else 1})
        return found

    return find


# ---- recorded model outputs --------------------------------------------------------------------------------------------


def _lookup(table: dict, key: Column, otherwise) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for k, v in table.items() for x in (k, v)]), key), F.lit(otherwise))


PLACED = "array<struct<start:int,end:int,entity_type:string>>"


def extract_spans(text: Column, raw: Column) -> Column:
    """Spans (label, start, end, text) with usable offsets; others fall back to the first place of their text."""

    def one(s: Column) -> Column:
        usable = s["start"].isNotNull() & s["end"].isNotNull() & (s["start"] >= 0) & (s["end"] <= F.length(text)) & (s["start"] < s["end"])
        said = T.strip(F.coalesce(s["text"], F.lit("")))
        at = F.when(said == "", F.lit(-1)).otherwise(F.instr(text, said) - 1)
        return F.struct(
            F.when(usable, s["start"]).otherwise(at).cast("int").alias("start"),
            F.when(usable, s["end"]).otherwise(F.when(at >= 0, at + F.length(said)).otherwise(-1)).cast("int").alias("end"),
            _lookup(SPAN_LABELS, s["label"], "OTHER").alias("entity_type"),
        )

    labelled = F.filter(raw, lambda s: F.coalesce(s["label"], F.lit("")) != "")
    return F.filter(F.transform(labelled, one), lambda s: s["end"] > s["start"]).cast(PLACED)


def merge_spans(text: Column, placed: Column) -> Column:
    """Neighbouring spans of a type become one if nothing, or little and nothing but connecting characters, is between."""

    def joins(last: Column, s: Column) -> Column:
        gap = text.substr(last["end"] + 1, s["start"] - last["end"])
        allowed = _lookup(MERGE_CHARACTERS, s["entity_type"], MERGE_CHARACTERS_OTHERWISE)
        close = (F.length(gap) <= _lookup(MERGE_GAPS, s["entity_type"], MERGE_GAP_OTHERWISE)) & ~F.contains(gap, F.lit("\n\n")) & (F.btrim(gap, allowed) == "")
        return (last["entity_type"] == s["entity_type"]) & (s["start"] >= last["end"]) & ((s["start"] == last["end"]) | close)

    groups = let(F.sort_array(placed), lambda v: runs(v, lambda s, i: ~F.coalesce(joins(F.get(v, i - 1), s), F.lit(False))))
    return F.transform(groups, lambda g: record(start=F.get(g, 0)["start"], end=F.element_at(g, -1)["end"], entity_type=F.get(g, 0)["entity_type"])).cast(PLACED)


def split_spans(text: Column, placed: Column) -> Column:
    """Spans are cut at blank lines."""

    def cut(s: Column) -> Column:
        body = text.substr(s["start"] + 1, s["end"] - s["start"])
        sized = F.zip_with(F.split(body, "\n{2,}", -1), F.regexp_extract_all(body, F.lit("\n{2,}"), F.lit(0)), lambda p, g: record(part=F.length(p), both=F.length(p) + F.coalesce(F.length(g), F.lit(0))))
        one = lambda x, end: record(start=s["start"] + end - x["both"], end=s["start"] + end - x["both"] + x["part"], entity_type=s["entity_type"])
        walked = let(sized, lambda v: F.zip_with(v, running_sum(F.transform(v, lambda x: x["both"])), one))
        return F.filter(walked, lambda x: x["end"] > x["start"]).cast(PLACED)

    return F.flatten(F.transform(placed, cut))


def emit_spans(text: Column, placed: Column) -> Column:
    """Stripped values, without empty ones."""
    said = F.transform(placed, lambda s: F.struct(T.strip(text.substr(s["start"] + 1, s["end"] - s["start"])).alias("value"), s["entity_type"].alias("entity_type")))
    return normalized(F.filter(said, lambda m: m["value"] != ""))


def normalized(pairs: Column) -> Column:
    """P2, P3 on (value, entity_type) pairs; what trimming empties is dropped."""
    done = F.transform(pairs, lambda m: F.struct(T.trim_match(m["value"], T.normalize_type(m["entity_type"])).alias("text"), T.normalize_type(m["entity_type"]).alias("entity_type")))
    return F.filter(done, lambda m: m["text"] != "").cast(MATCHES)


def span_matches(text: Column, raw: Column) -> Column:
    """D9 to D12."""
    return emit_spans(text, split_spans(text, merge_spans(text, extract_spans(text, raw))))


def zero_shot_matches(text: Column, raw: Column, labels: list[str] | None = None, threshold: float | None = None) -> Column:
    """Rows (text, entity_type, start, end, score) that reach the threshold, have a wanted label and fit their place."""

    def fits(m: Column) -> Column:
        ok = T.strip(text.substr(m["start"] + 1, m["end"] - m["start"])) == m["text"]
        ok = ok & (m["score"] >= threshold) if threshold is not None else ok
        return ok & m["entity_type"].isin(labels) & T.grounded(m["text"], text) if labels else ok & T.grounded(m["text"], text)

    kept = F.filter(raw, fits)
    return normalized(F.transform(kept, lambda m: F.struct(m["text"].alias("value"), F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for k, v in ZERO_SHOT_LABELS.items() for x in (k, v)]), F.lower(m["entity_type"])), F.upper(m["entity_type"])).alias("entity_type"))))


def llm_matches(source: Column, reply: Column) -> tuple[Column, Column]:
    """(status, matches). A reply that isn't an object with a list ``entities`` is unavailable, not empty."""
    body = T.json_object(reply)
    parsed = F.try_parse_json(body)
    kind = F.schema_of_variant(parsed)
    raw = F.try_variant_get(parsed, "$.entities", "string")
    entities = F.try_variant_get(parsed, "$.entities", "array<variant>")
    is_object, missing = kind.startswith("OBJECT"), raw.isNull()
    status = F.when(reply.isNull() | parsed.isNull() | ~is_object, "unavailable").when(~missing & entities.isNull(), "unavailable").otherwise("ok")
    said = F.transform(
        F.filter(F.coalesce(entities, F.array().cast("array<variant>")), lambda v: F.schema_of_variant(v).startswith("OBJECT")),
        lambda v: F.struct(T.strip(F.coalesce(F.try_variant_get(v, "$.text", "string"), F.lit(""))).alias("value"), F.coalesce(F.try_variant_get(v, "$.type", "string"), F.lit("OTHER")).alias("entity_type")),
    )
    return status, normalized(F.filter(said, lambda m: T.grounded(m["value"], source)))


def decode_tags(text: Column, tokens: Column) -> Column:
    """Tokens (tag, start, end) in B/I/O/E/S notation to spans (label, start, end, text) without blanks at the ends.

    A stray I begins a span, a stray E is a span, and a span open at the end counts. Tokens (0, 0) after the first are skipped.
    """
    spans = "array<struct<label:string,start:int,end:int>>"
    numbered = F.transform(tokens, lambda t, i: F.struct(t["tag"].alias("tag"), t["start"].alias("start"), t["end"].alias("end"), i.alias("i")))
    none = F.lit(None).cast("struct<label:string,start:int,end:int>")

    def step(acc: Column, t: Column) -> Column:
        mark, base = F.substring_index(t["tag"], "-", 1), F.substr(t["tag"], F.instr(t["tag"], "-") + 1)
        outside = ~F.contains(F.coalesce(t["tag"], F.lit("O")), F.lit("-"))
        same = F.coalesce(acc["open"]["label"] == base, F.lit(False))
        here = F.struct(base.alias("label"), t["start"].alias("start"), t["end"].alias("end"))
        grown = F.struct(acc["open"]["label"].alias("label"), acc["open"]["start"].alias("start"), t["end"].alias("end"))
        closed = F.when(acc["open"].isNull(), F.array().cast(spans)).otherwise(F.array(acc["open"]).cast(spans))
        state = lambda out, open_: F.struct(F.concat(acc["out"], out).cast(spans).alias("out"), open_.cast("struct<label:string,start:int,end:int>").alias("open"))
        nothing = F.array().cast(spans)
        return (
            F.when((t["start"] == 0) & (t["end"] == 0) & (t["i"] > 0), acc)
            .when(outside, state(closed, none))
            .when(mark == "B", state(closed, here))
            .when((mark == "I") & same, state(nothing, grown))
            .when(mark == "I", state(closed, here))
            .when((mark == "E") & same, state(F.array(grown).cast(spans), none))
            .when(mark.isin("E", "S"), state(F.concat(closed, F.array(here).cast(spans)), none))
            .otherwise(acc)
        )

    start = F.struct(F.array().cast(spans).alias("out"), none.alias("open"))
    done = F.aggregate(numbered, start, step, lambda a: F.when(a["open"].isNull(), a["out"]).otherwise(F.concat(a["out"], F.array(a["open"]).cast(spans))))

    def trimmed(s: Column) -> Column:
        body = text.substr(s["start"] + 1, s["end"] - s["start"])
        lead = F.length(body) - F.length(F.ltrim(body, F.lit(T.BLANK)))
        tail = F.length(body) - F.length(F.rtrim(body, F.lit(T.BLANK)))
        return F.struct(s["label"].alias("label"), (s["start"] + lead).alias("start"), F.greatest(s["end"] - tail, s["start"] + lead).alias("end"), T.strip(body).alias("text"))

    return F.transform(done, trimmed)


def merged_text(texts: Column) -> Column:
    """The texts of a call as one, with the sentinel between them."""
    return F.array_join(texts, f"\n\n--- {SENTINEL} ---\n\n")


def without_sentinel(matches: Column) -> Column:
    """P13."""
    return F.filter(matches, lambda m: ~F.contains(m["text"], F.lit(SENTINEL)))
