"""Span expressions: finding matches with their places, greedy allocation, replacement. All stay in Catalyst.

None of them appends to one growing array, so a text of many matches costs little more than its patterns.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from cloakwork.functions.arrays import blocks, let, record, running_max, running_sum, runs, slices
from cloakwork.functions.text import strip
from cloakwork.model import CANDIDATES

#: Noncharacters that mark where a match, what stands before its value, and its value begin, and where all end.
BEGIN, LEAD, VALUE, END = MARKS = "\ufdd0", "\ufdd1", "\ufdd2", "\ufdd3"
OTHER = "\ufdd4"


def no_candidates() -> Column:
    return F.array().cast(CANDIDATES)


@dataclass(frozen=True)
class Sought:
    """A Java pattern; ``grouped``: it reads (before)(value)after. ``needs``: texts without this literal are skipped."""

    pattern: str
    entity_type: str
    order: int
    grouped: bool = False
    needs: str | None = None


def find(text: Column, pattern: str, entity_type: str, order: int, grouped: bool = False, needs: str | None = None, stripped: bool = True) -> Column:
    """All non-overlapping matches of a Java pattern as candidates."""
    return find_all(text, [Sought(pattern, entity_type, order, grouped, needs)], stripped)


def find_all(text: Column, sought: list[Sought], stripped: bool = True) -> Column:
    """The candidates of all patterns, pattern after pattern.

    A pattern runs over a text until its first match, and where there is one once more to mark all of them; lengths between
    the marks give the places by running sums. One expression places the matches of all patterns.
    """
    if not sought:
        return no_candidates()
    clean = ~reduce(lambda a, b: a | b, [F.contains(text, F.lit(mark)) for mark in MARKS])

    def marked(s: Sought) -> Column:
        said = f"{BEGIN}$0{LEAD}$1{VALUE}$2{END}" if s.grouped else f"{BEGIN}$0{LEAD}{VALUE}$0{END}"
        guard = text.rlike(s.pattern) if s.needs is None else F.contains(text, F.lit(s.needs)) & text.rlike(s.pattern)
        within = lambda t: F.regexp_replace(t, F.lit(s.pattern), F.lit(said))
        body = F.when(guard, F.when(clean, within(text)).otherwise(within(F.translate(text, "".join(MARKS), OTHER * 4))))
        return record(body=body, kind=F.lit(s.entity_type), ord=F.lit(s.order))

    def measured(piece: Column) -> Column:
        lead, value, end = F.instr(piece, LEAD), F.instr(piece, VALUE), F.instr(piece, END)
        return record(len=lead - 1, lead=value - lead - 1, value=piece.substr(value + 1, end - value - 1), rest=F.length(piece) - end)

    def placed(m: Column) -> Column:
        def site(x: Column, end: Column) -> Column:
            start = end - x["len"] + x["lead"]
            return record(first=start, last=start + F.length(x["value"]), value=x["value"])

        def candidate(x: Column, value: Column) -> Column:
            return record(start=x["first"], end=x["last"], value=strip(value) if stripped else value, entity_type=m["kind"], ord=m["ord"])

        def valued(sites: Column) -> Column:
            # The values of a text that has marks itself are cut out of it again, out of all chunks at once.
            return F.when(clean, F.transform(sites, lambda x: candidate(x, x["value"]))).otherwise(F.zip_with(sites, slices(text, sites), candidate))

        def spans(parts: Column) -> Column:
            ends = lambda x: running_sum(F.transform(x, lambda y, i: y["len"] + F.when(i == 0, F.length(F.get(parts, 0))).otherwise(F.get(x, i - 1)["rest"])))
            return let(let(F.transform(F.slice(parts, F.lit(2), F.size(parts)), measured), lambda x: F.zip_with(x, ends(x), site)), valued)

        return let(F.split(m["body"], BEGIN, -1), spans)

    found = F.filter(F.array(*map(marked, sought)), lambda m: m["body"].isNotNull())
    return F.flatten(F.transform(found, placed)).cast(CANDIDATES)


def greedy(candidates: Column, strategy: str = "longest") -> Column:
    """Accepts candidates one by one if they overlap none accepted before.

    ``longest``: longer first, then earlier, then by order; ``priority``: by order, then earlier. The result is in order of
    acceptance.
    """
    long = strategy == "longest"
    kind = "array<struct<start:int,end:int,ord:int,value:string,entity_type:string>>"
    sorted_ = F.sort_array(F.transform(candidates, lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), c["ord"].alias("ord"), c["value"].alias("value"), c["entity_type"].alias("entity_type"))).cast(kind))

    # Candidates fall into runs that overlap nothing outside; a run is small even where a text has thousands of candidates.
    ends = lambda v: running_max(F.transform(v, lambda c: c["end"]))
    cut = lambda v: let(ends(v), lambda top: runs(v, lambda c, i: c["start"] >= F.get(top, i - 1)))

    item = "struct<k1:int,k2:int,k3:int,end:int,value:string,entity_type:string>"
    key = lambda c: F.struct((c["start"] - c["end"] if long else c["ord"]).alias("k1"), c["start"].alias("k2"), c["ord"].alias("k3"), c["end"].alias("end"), c["value"].alias("value"), c["entity_type"].alias("entity_type"))

    def before(placed: Column, at: Column) -> Column:
        """How many of those in ``placed``, which are in order, start before a place, by halving."""
        half = lambda s: F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        halved = lambda s, _: F.when(s["lo"] >= s["hi"], s).when(F.get(placed, half(s))["start"] < at, record(lo=half(s) + 1, hi=s["hi"])).otherwise(record(lo=s["lo"], hi=half(s)))
        return F.aggregate(F.sequence(F.lit(0), F.log2(F.size(placed) + 1).cast("int")), record(lo=F.lit(0), hi=F.size(placed)), halved)["lo"]

    def fold(block: Column, room=lambda c: F.lit(True)) -> Column:
        clash = lambda taken, c: F.exists(taken, lambda a: (a["k2"] < c["end"]) & (c["k2"] < a["end"]))
        return F.aggregate(block, F.array().cast(f"array<{item}>"), lambda taken, c: F.when(clash(taken, c) | ~room(c), taken).otherwise(F.concat(taken, F.array(c))))

    def allocate(mine: Column) -> Column:
        """Candidates by priority, in blocks. A fold copies its result at each step, so the inner one, over a block, has only
        what that block adds; what earlier blocks added overlaps nowhere, so of those that start before a candidate's end
        the last one tells whether there is room."""

        def put(placed: Column, block: Column) -> Column:
            room = lambda c: let(before(placed, c["end"]), lambda n: (n == 0) | (F.get(placed, n - 1)["end"] <= c["k2"]))
            return F.sort_array(F.concat(placed, F.transform(fold(block, room), lambda c: record(start=c["k2"], end=c["end"], item=c))))

        return F.transform(F.aggregate(blocks(mine), F.array().cast(f"array<struct<start:int,end:int,item:{item}>>"), put), lambda x: x["item"])

    def accept(run: Column) -> Column:
        mine = F.sort_array(F.transform(run, key).cast(f"array<{item}>"))
        return F.when(F.size(run) < 2, mine).when(F.size(run) <= 64, fold(mine)).otherwise(let(mine, allocate))

    kept = F.sort_array(F.flatten(F.transform(let(sorted_, cut), accept)))
    return F.transform(kept, lambda c: F.struct(c["k2"].alias("start"), c["end"].alias("end"), c["value"].alias("value"), c["entity_type"].alias("entity_type"), c["k3"].alias("ord"))).cast(CANDIDATES)


def occurrences(text: Column, key: Column) -> Column:
    """First and last (exclusive) place of each occurrence of a literal, those that overlap each other too; no pattern is made of it.

    The text must not have BEGIN in it.
    """
    n = F.length(key)
    gaps = F.transform(F.split(F.replace(text, key, F.lit(BEGIN)), BEGIN, -1), F.length)
    apart = lambda g: F.transform(running_sum(F.slice(g, F.lit(1), F.size(g) - 1)), lambda x, i: x + i * n)
    # What is left out begins within one of those found, by a period of the key behind it.
    periods = F.filter(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda q: (q < n) & (key.substr(q + 1, n - q) == key.substr(F.lit(1), n - q)))
    again = lambda starts: F.flatten(F.transform(periods, lambda q: F.filter(F.transform(starts, lambda i: i + q), lambda j: text.substr(j + 1, n) == key)))
    first = lambda k: key.substr(F.lit(1), F.lit(k))
    never = (first(1) != key.substr(n, F.lit(1))) & ~F.contains(key.substr(F.lit(2), n), first(2))  # what ends a key like that doesn't begin it
    every = lambda starts: F.when(never, starts).otherwise(F.array_distinct(F.concat(starts, again(starts))))
    return F.transform(let(let(gaps, apart), every), lambda i: record(first=i.cast("int"), last=(i + n).cast("int")))


def replace_all(text: Column, entries: Column, old: str, new: str) -> Column:
    """The text with the field ``old`` of each of the entries replaced by its field ``new``, in one pass.

    At each place the longest literal counts, from left to right. Places are found literal by literal and put in order; what is spliced
    then is the text between them, so neither a pattern nor a text is made anew for each literal.
    """
    sites = "array<struct<first:int,size:int,last:int,old:string,new:string>>"
    clean = ~F.contains(text, F.lit(BEGIN))

    def found(body: Column, e: Column, key: Column) -> Column:
        return F.transform(occurrences(body, key), lambda o: record(first=o["first"], size=o["first"] - o["last"], last=o["last"], old=e[old], new=e[new]))

    def of(e: Column) -> Column:
        other = lambda c: F.translate(c, BEGIN, OTHER)
        near = lambda: let(found(other(text), e, other(e[old])), lambda f: F.zip_with(f, slices(text, f), lambda x, v: F.when(v == x["old"], x)))
        return F.when(clean, found(text, e, e[old])).otherwise(F.filter(near(), lambda x: x.isNotNull()))

    def chosen(all_: Column) -> Column:
        candidates = F.transform(all_, lambda x, i: record(start=x["first"], end=x["last"], value=x["old"], entity_type=x["new"], ord=i)).cast(CANDIDATES)
        return F.sort_array(F.transform(greedy(candidates, "priority"), lambda c: record(first=c["start"], last=c["end"], new=c["entity_type"])))

    def apart(all_: Column) -> Column:
        clash = F.exists(F.zip_with(all_, F.slice(all_, F.lit(2), F.size(all_)), lambda a, b: F.coalesce(b["first"] < a["last"], F.lit(False))), lambda x: x)
        return F.when(clash, chosen(all_)).otherwise(F.transform(all_, lambda x: record(first=x["first"], last=x["last"], new=x["new"])))

    def spliced(kept: Column) -> Column:
        ends = F.concat(F.array(F.lit(0)), F.transform(kept, lambda k: k["last"]))
        between = slices(text, F.zip_with(ends, F.transform(kept, lambda k: k["first"]), lambda a, b: record(first=a, last=F.coalesce(b, F.length(text)))))
        return F.array_join(F.zip_with(between, kept, lambda g, k: F.concat(g, F.coalesce(k["new"], F.lit("")))), "")

    present = F.filter(entries, lambda e: (F.length(e[old]) > 0) & F.contains(text, e[old]))
    several = lambda p: let(let(F.sort_array(F.flatten(F.transform(p, of)).cast(sites)), apart), spliced)
    return F.when(text.isNull() | entries.isNull(), text).otherwise(let(present, lambda p: F.when(F.size(p) == 0, text).otherwise(several(p))))
