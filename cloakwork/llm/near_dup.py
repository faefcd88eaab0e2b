"""Near-duplicate documents: MinHash with banding, verification on full sets, components by large-star and small-star.

A document's set is its distinct shingles of ``k`` words (ASCII white space between words, A-Z lower-cased); shorter texts
with a word are one shingle. Documents are linked if 100 * intersection >= ``percent`` * union, and a component is what
links reach.

1. One scan makes, for each document, the set's size, a 128-bit digest of the set and one 64-bit key for each band of
   ``ROWS`` universal hash minima. Equal sets are one class from here on: copies are never paired.
2. Classes that share a band key are candidates. In each bucket the class with the most bucket mates is the pivot; each
   class is verified on full sets against the pivot with which it shares most bands, then, in buckets that still hold
   several components, against the pivots of other components. So a group of n near copies around a text costs a few n
   verifications, not n^2 / 2.
3. What may be left are links between classes of different components that share a bucket. They are found exactly, by a
   prefix join over the classes of such buckets: shingles are ordered rare first, two linked sets share one of their first
   few shingles, and the places at which they share it bound their intersection. Where many sets share one, as texts made from one
   template do, that shingle is taken out and the group is put as differences from one of its sets: what each has beside it
   and what it lacks of it. A shingle that nearly all have tells nothing, but one that a text lacks does. Two linked sets
   share enough of their differences, so the group is joined by its own rare-first prefixes before any pair is formed.
   Pairs are formed only across components.
4. Components are taken over all links by alternating large-star and small-star.

The number of bands follows from the threshold: two sets at the threshold share no bucket with probability below 1e-7.
Every step exchanges keys, digests or sets of candidates, never the pairs of a group; hot keys meet in sort-merge joins
that adaptive execution can split, or in aggregates that combine before the shuffle. Intermediate tables go to the shared
folder, so that a lost executor costs a reread; all but what the result reads are deleted at the end.

Defined results: null and empty texts have no shingles, are linked with nothing and are their own component (kept). The
component's id is its least doc_id that isn't null; a row with a null doc_id is kept only if its component has no other
id. Repeated rows are returned as often as they come, with the same verdict. Other columns are ignored by ``components``
and kept by ``deduplicate``, which with ``repeats=False`` leaves one row of each kept doc_id and text, whichever comes first.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakwork.llm.common import small_batches, table_schema, text_key, written
from cloakwork.session import Scratch

ROWS = 4
MISS = 1e-7
SKETCH = 1 << 18
KNOWN_WORDS = 300_000
#: Up to so many candidates are broadcast to the texts; more are joined with a shuffle of the texts.
FEW = 200_000
#: Groups in which more sets than this have the shared item in their indexed prefix, so that all of these are pairs, are put as
#: differences anew, up to so many times. Both decide speed only: a set forms at most about LARGE / 2 pairs for an item.
LARGE, DEEPEST = 1000, 4
C = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)]


def bands_for(percent: int) -> int:
    return math.ceil(math.log(MISS) / math.log(1 - (percent / 100) ** ROWS))


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * C[4]
    x = (x ^ (x >> np.uint64(29))) * C[1]
    return x ^ (x >> np.uint64(32))


class Shingler:
    """Sets of 64-bit shingle hashes; words' hashes are kept in a bounded table."""

    def __init__(self, k: int):
        self.k, self.known = k, {}
        powers = [1]
        for _ in range(k):
            powers.append(powers[-1] * int(C[0]) % (1 << 64))
        self.factors = [np.uint64(p | 1) for p in powers[1:]]

    def words(self, text: str) -> np.ndarray:
        import xxhash

        cut = text.encode("utf-8", "surrogatepass").lower().split()  # bytes.lower changes A-Z only
        known = self.known
        if len(known) > KNOWN_WORDS:
            known.clear()
        for w in cut:
            if w not in known:
                known[w] = xxhash.xxh3_64_intdigest(w)
        return np.fromiter(map(known.__getitem__, cut), np.uint64, len(cut))

    def set_of(self, text: str | None) -> np.ndarray:
        """Sorted distinct hashes."""
        w = self.words(text) if text else np.zeros(0, np.uint64)
        if not len(w):
            return w
        with np.errstate(over="ignore"):
            k = min(self.k, len(w))
            total = np.full(len(w) - k + 1, k, np.uint64)
            for i in range(k):
                total += mix(w[i : len(w) - k + 1 + i] + np.uint64(i)) * self.factors[i]
            return np.unique(mix(total))

    def digest(self, s: np.ndarray) -> bytes:
        return hashlib.blake2b(s.astype("<u8").tobytes(), digest_size=16, salt=self.k.to_bytes(8, "little")).digest()


class Minima:
    """Keys of bands of universal hash minima."""

    def __init__(self, bands: int, seed: int = 7):
        rng = np.random.Generator(np.random.PCG64(seed))
        n = bands * ROWS
        self.bands = bands
        self.a = rng.integers(0, 1 << 63, n, np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = rng.integers(0, 1 << 63, n, np.uint64)

    def keys(self, s: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            least = np.full(len(self.a), np.uint64((1 << 64) - 1))
            for i in range(0, len(s), 2048):
                np.minimum(least, (self.a[:, None] * s[None, i : i + 2048] + self.b[:, None]).min(axis=1), out=least)
            rows = mix(least).reshape(self.bands, ROWS)
            key = np.arange(1, self.bands + 1, dtype=np.uint64)
            for r in range(ROWS):
                key = mix(key * C[2] + rows[:, r])
        return key.view(np.int64)


def signatures(docs: DataFrame, k: int, percent: int, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, __key (of the text), n_shingles, cls (digest of the set, null if empty) and the keys of its bands."""
    small_batches(docs.sparkSession)
    bands = bands_for(percent)
    sent = docs.select(F.col(doc_id).alias("doc_id"), text_key(F.col(text)).alias("__key"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, minima = Shingler(k), Minima(bands)
        for batch in batches:
            sizes, digests, keys = [], [], []
            for text in batch.column(2):
                s = shingler.set_of(text.as_py())
                sizes.append(len(s))
                digests.append(shingler.digest(s) if len(s) else None)
                keys.append(minima.keys(s) if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                names=["doc_id", "__key", "n_shingles", "cls", "bands"],
            )

    return sent.mapInArrow(run, f"{table_schema(sent.select('doc_id', '__key'))}, n_shingles bigint, cls binary, bands array<bigint>")


def _sets(docs: DataFrame, wanted: DataFrame, k: int, text: str, doc_id: str) -> DataFrame:
    """cls and the full set, as sorted signed hashes, of each class in ``wanted`` (cls, rep)."""
    reps = wanted.select("cls", F.col("rep.doc_id").alias("__id"), F.col("rep.__key").alias("__k"))
    mine = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), text_key(F.col(text)).alias("__key"))
    if wanted.count() <= FEW:  # counted, so this is a bound: about 10 MB
        reps = F.broadcast(reps)
    found = mine.join(reps, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__key") == F.col("__k")))
    one = found.groupBy("cls").agg(F.first("text").alias("text"))  # rows may be repeated
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(k)
        for batch in batches:
            sets = [shingler.set_of(x.as_py()).view(np.int64) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["cls", "items"])

    return one.mapInArrow(run, "cls binary, items array<bigint>")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (x, y) that are linked."""
    left = sets.select(F.col("cls").alias("x"), F.col("items").alias("xs"))
    right = sets.select(F.col("cls").alias("y"), F.col("items").alias("ys"))
    both = pairs.select("x", "y").join(left, "x").join(right, "y").select("x", "y", (F.size("xs") + F.size("ys")).alias("n"), F.size(F.array_intersect("xs", "ys")).alias("shared"))
    return both.where(_linked(F.col("shared"), F.col("n"), percent)).select("x", "y")


def _linked(shared: Column, sizes: Column, percent: int) -> Column:
    return shared * 100 >= (sizes - shared) * percent


def _is_forest_of_stars(e: DataFrame) -> bool:
    """Whether every larger end of an edge (a > b) has one edge only and is no smaller end."""
    ends = e.select(F.col("a").alias("v"), F.lit(1).alias("up")).union(e.select(F.col("b").alias("v"), F.lit(0).alias("up")))
    return ends.groupBy("v").agg(F.sum("up").alias("up"), F.count("*").alias("n")).where("up > 1 or (up = 1 and n > 1)").isEmpty()


def connected(edges: DataFrame) -> DataFrame:
    """(v, root) for every vertex of edges (x, y): alternating large-star and small-star until only stars are left.

    Vertices may be of any ordered type; root is the least vertex of the component.
    """
    scratch = Scratch(edges.sparkSession, "components")
    e = scratch.written(edges.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).where("a != b").distinct(), "edges")
    while not _is_forest_of_stars(e):
        # large-star: each larger neighbour of a vertex goes to the least of the neighbourhood
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = scratch.written(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
        large = scratch.written(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct(), "large-star")
        scratch.drop("edges", "least")
        # small-star: each vertex and its smaller neighbours go to the least of these
        least = scratch.written(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        joined = large.join(least, "a")
        small = joined.select("a", F.col("m").alias("b")).union(joined.select(F.col("b").alias("a"), F.col("m").alias("b")))
        e = scratch.written(small.where("a != b").distinct(), "edges")
        scratch.drop("large-star", "least")
    roots = written(e.select(F.col("a").alias("v"), F.col("b").alias("root")).union(e.select(F.col("b").alias("v"), F.col("b").alias("root"))).distinct(), "roots")
    scratch.drop()
    return roots


def _ordered(slots: np.ndarray, items: np.ndarray, often: np.ndarray) -> np.ndarray:
    """Places of items, rare first: by a count sketch, then by hash. The same order for all members of a group."""
    return np.lexsort((items, often[slots]))


def _prefixes(rows: DataFrame, often) -> DataFrame:
    """Rare-first prefixes of rows (gid, cls, root, w, least, items, slots): token, gid, cls, root, w, size, pos, indexed.

    Two members of a group are linked if they share w + w of their items. The one of smaller w has what must be met in its
    indexed prefix, the other in its whole prefix, as no member has a smaller w than ``least``. Any order gives exact results;
    a better one, fewer pairs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["token", "gid", "cls", "root", "w", "size", "pos", "indexed"]
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.float64(), pa.int32(), pa.int32(), pa.bool_()]
        for batch in batches:
            columns: list[list] = [[] for _ in names]
            *plain, all_items, all_slots = batch.columns
            for (gid, cls, root, w, least), items, slots in zip(zip(*(c.to_pylist() for c in plain)), all_items, all_slots):
                s = np.asarray(items.values, np.int64)
                n = len(s)
                probe, index = (n - max(1, math.ceil(need - 1e-9)) + 1 for need in (w + least, 2 * w))
                if probe <= 0:
                    continue
                order = _ordered(np.asarray(slots.values, np.int64), s, often.value)[:probe]
                for c, v in zip(columns, (s[order].tolist(), *([x] * len(order) for x in (gid, cls, root, w, n)), range(len(order)), [i < index for i in range(len(order))])):
                    c.extend(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)

    return rows.select("gid", "cls", "root", "w", "least", "items", "slots").mapInArrow(run, "token bigint, gid bigint, cls binary, root binary, w double, size int, pos int, indexed boolean")


def _behind(rows: DataFrame, often) -> DataFrame:
    """gid, token, cls, root, w, items: for rows (gid, cls, root, w, items, slots, tokens), what stands behind each of the tokens.

    A pair belongs to the group of the first item that it shares; the rest of what it shares is behind. That item counts half for
    each of the two.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.float64(), pa.list_(pa.int64())]
        made = lambda out: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], names=["gid", "token", "cls", "root", "w", "items"])
        for batch in batches:
            out, held = [[], [], [], [], [], []], 0
            *plain, all_items, all_slots, all_tokens = batch.columns
            for (gid, cls, root, w), items, slots, tokens in zip(zip(*(c.to_pylist() for c in plain)), all_items, all_slots, all_tokens):
                s = np.asarray(items.values, np.int64)
                s = s[_ordered(np.asarray(slots.values, np.int64), s, often.value)]
                for t in tokens.as_py():
                    rest = s[int(np.nonzero(s == t)[0][0]) + 1 :]
                    for c, v in zip(out, (gid, t, cls, root, w - 0.5, rest)):
                        c.append(v)
                    held += len(rest)
                    if held > 1 << 20:
                        yield made(out)
                        out, held = [[], [], [], [], [], []], 0
            yield made(out)

    return rows.select("gid", "cls", "root", "w", "items", "slots", "tokens").mapInArrow(run, "gid bigint, token bigint, cls binary, root binary, w double, items array<bigint>")


def _small(table: DataFrame, weight: Column, most: int) -> DataFrame:
    """The table, to be broadcast if the sum of weights is at most ``most``."""
    return F.broadcast(table) if (table.agg(F.sum(weight)).first()[0] or 0) <= most else table


def _as_differences(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """rows (gid, cls, root, w, items), each group as differences from the items of one member.

    With P the member's items, |A & B| is |P|, less what A lacks, less what B lacks, plus what their differences share (what both
    have beside P, and what both lack); so what A lacks goes to its w, and |P| is taken off in halves.
    """
    chosen = scratch.written(rows.groupBy("gid").agg(F.min_by("items", F.struct(F.xxhash64("cls"), "cls")).alias("ps")), "chosen")
    both = rows.join(_small(chosen, F.size("ps"), 4 << 20), "gid").select("gid", "cls", "root", "w", F.array_except("items", "ps").alias("has"), F.array_except("ps", "items").alias("lacks"), F.size("ps").alias("np"))
    return both.select("gid", "cls", "root", (F.col("w") + F.size("lacks") - F.col("np") / 2).alias("w"), F.concat("has", F.transform("lacks", lambda x: F.bitwise_not(x))).alias("items"))


def _across(rows: DataFrame, scratch: Scratch, depth: int = 1) -> DataFrame:
    """Pairs (x, y) of classes of different roots that may share w + w items. rows: gid, cls, root, w, items."""
    groups = rows.groupBy("gid").agg(F.min(F.struct("w", "cls", "root")).alias("first"), F.min("root").alias("r"), F.max("root").alias("s")).where("r != s").select("gid", F.col("first.w").alias("least"), F.col("first.cls").alias("y"), F.col("first.root").alias("y_root"))
    slots = F.transform("items", lambda t: F.pmod(F.xxhash64("gid", t), F.lit(SKETCH)).cast("int"))
    groups = _small(scratch.written(groups, "groups"), F.lit(1), FEW)
    rows = scratch.written(rows.join(groups, "gid").withColumn("slots", slots), f"members-{depth}")
    # Two members that need share nothing more are both linked with the one of least w, through which they meet.
    free = rows.where((F.col("w") + F.col("least") <= 1e-9) & (F.col("root") != F.col("y_root"))).select(F.col("cls").alias("x"), "y")
    sketch = np.zeros(SKETCH, np.int64)  # fixed size, whatever the corpus
    got = rows.select(F.explode("slots").alias("slot")).groupBy("slot").count().toPandas()
    sketch[got["slot"].to_numpy(np.int64)] = got["count"].to_numpy(np.int64)
    often = rows.sparkSession.sparkContext.broadcast(sketch)
    prefixes = scratch.written(_prefixes(rows, often), f"prefixes-{depth}")
    # To put a group anew moves its members' items once more, which pays off where its pairs would be more than that.
    large = (F.col("k") > LARGE) & (F.col("n") * 2 > F.col("mean")) if depth < DEEPEST else F.lit(False)
    met = prefixes.groupBy("gid", "token").agg(F.min("root").alias("r"), F.max("root").alias("s"), F.count("*").alias("n"), F.count_if("indexed").alias("k"), F.avg("size").alias("mean")).where("r != s").select("gid", "token", large.alias("large"))
    found = scratch.written(prefixes.join(met, ["gid", "token"]), f"met-{depth}")
    p, q = found.where("not large").alias("p"), found.where("indexed and not large").alias("q")
    smaller = F.struct("q.w", "q.cls") < F.struct("p.w", "p.cls")
    fits = F.least(F.col("p.size") - F.col("p.pos"), F.col("q.size") - F.col("q.pos")) >= F.ceil(F.col("p.w") + F.col("q.w") - 1e-9)
    pairs = p.join(q, (F.col("p.gid") == F.col("q.gid")) & (F.col("p.token") == F.col("q.token")) & (F.col("p.root") != F.col("q.root")) & smaller & fits)
    pairs = pairs.select(F.col("p.cls").alias("x"), F.col("q.cls").alias("y")).union(free)
    again = found.where("large").groupBy("gid", "cls").agg(F.collect_list("token").alias("tokens"))  # at most a prefix
    if depth == DEEPEST or again.isEmpty():
        return pairs
    inner = _behind(again.join(rows, ["gid", "cls"]), often).withColumn("gid", F.xxhash64("gid", "token")).drop("token")
    return pairs.union(_across(_as_differences(scratch.written(inner, f"behind-{depth}"), scratch), scratch, depth + 1))


def _with_pivots(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """(x, y, together) for rows (bucket, cls, degree, root): each class, its buckets' pivots of another root, and in how
    many buckets it meets them.
    """
    top = rows.groupBy("bucket").agg(F.max(F.struct("degree", "cls", "root")).alias("top")).select("bucket", F.col("top.cls").alias("y"), F.col("top.root").alias("y_root"))
    return rows.select("bucket", F.col("cls").alias("x"), "root").join(scratch.written(top, "pivots"), "bucket").where("root != y_root").groupBy("x", "y").agg(F.count("*").alias("together"))


def _unsettled(rows: DataFrame, roots: DataFrame, scratch: Scratch) -> DataFrame:
    """rows (bucket, cls, degree) with their roots, of buckets with more than one root."""
    rooted = rows.join(roots.withColumnRenamed("v", "cls"), "cls", "left").select("bucket", "cls", "degree", F.coalesce("root", "cls").alias("root"))
    rooted = scratch.written(rooted, "rooted")
    mixed = rooted.groupBy("bucket").agg(F.min("root").alias("r"), F.max("root").alias("s")).where("r != s").select("bucket")
    return scratch.written(rooted.join(mixed, "bucket"), "unsettled")


def _stars(roots: DataFrame) -> DataFrame:
    return roots.where("v != root").select(F.col("v").alias("x"), F.col("root").alias("y"))


def components(docs: DataFrame, k: int = 5, percent: int = 80, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per row of docs: doc_id, __key (of the text), n_shingles, component_id, kept."""
    scratch = Scratch(docs.sparkSession, "near-dup")
    sig = scratch.written(signatures(docs, k, percent, text, doc_id), "signatures")
    classes = sig.where(F.col("cls").isNotNull()).groupBy("cls").agg(F.min("doc_id").alias("least_id"), F.min(F.struct("doc_id", "__key")).alias("rep"), F.count("*").alias("copies"), F.first("bands").alias("bands"))
    classes = scratch.written(classes, "classes")

    rows = classes.select("cls", F.explode("bands").alias("bucket"))
    shared = rows.groupBy("bucket").agg(F.count("*").alias("mates")).where("mates > 1")
    rows = scratch.written(rows.join(shared, "bucket"), "buckets")
    degree = rows.groupBy("cls").agg(F.sum("mates").alias("degree"))
    rows = scratch.written(rows.select("bucket", "cls").join(degree, "cls"), "ranked")
    candidates = scratch.written(degree.select("cls").join(classes.select("cls", "rep"), "cls"), "candidates")
    sets = scratch.written(_sets(docs, candidates, k, text, doc_id), "sets")
    scratch.drop("buckets", "candidates")

    tried = _with_pivots(rows.withColumn("root", F.col("cls")), scratch)
    best = tried.groupBy("x").agg(F.max(F.struct("together", "y")).alias("top")).select("x", F.col("top.y").alias("y"))
    roots = connected(scratch.written(_verified(best, sets, percent), "links"))
    rows = _unsettled(rows, roots, scratch)
    if not rows.isEmpty():
        more = _verified(_with_pivots(rows, scratch), sets, percent)
        roots = connected(_stars(roots).union(more))
        rows = _unsettled(rows.drop("root"), roots, scratch)
    if not rows.isEmpty():
        # Sets are linked if they share percent / (100 + percent) of the sum of their sizes.
        w = F.size("items") * F.lit(percent / (100 + percent))
        members = rows.select("cls", "root").distinct().join(sets, "cls").select(F.lit(0).cast("bigint").alias("gid"), "cls", "root", w.alias("w"), "items")
        pairs = scratch.written(_across(members, scratch).distinct(), "across")
        roots = connected(_stars(roots).union(_verified(pairs, sets, percent)))

    grouped = roots.withColumnRenamed("v", "cls").join(classes.select("cls", "least_id"), "cls")
    of_root = scratch.written(grouped.groupBy("root").agg(F.min("least_id").alias("component")), "component-ids")
    of_class = grouped.select("cls", "root").join(of_root, "root").select("cls", "component")
    lone = classes.where("copies > 1").select("cls", "least_id").join(of_class.select("cls"), "cls", "left_anti").select("cls", F.col("least_id").alias("component"))
    ids = scratch.written(of_class.union(lone).withColumn("hit", F.lit(True)), "class-ids")
    scratch.keep("signatures", "class-ids")
    out = sig.select("doc_id", "__key", "n_shingles", "cls").join(ids, "cls", "left")
    component = F.when(F.col("hit"), F.col("component")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "__key", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def deduplicate(docs: DataFrame, k: int = 5, percent: int = 80, text: str = "text", doc_id: str = "doc_id", repeats: bool = True) -> DataFrame:
    """docs without the documents that aren't kept; all columns stay. Without ``repeats``, rows of the same doc_id (null too) and text leave one."""
    found = components(docs, k, percent, text, doc_id).groupBy("doc_id", "__key").agg(F.min("kept").alias("kept"), F.count("*").alias("rows"))
    # A table of known size: where it is small, texts aren't shuffled to meet it.
    found = written(found.where("not kept or rows > 1").select(F.col("doc_id").alias("__id"), "__key", "kept"), "duplicates")
    mine = docs.withColumn("__key2", text_key(F.col(text)))
    met = F.col(doc_id).eqNullSafe(F.col("__id")) & (F.col("__key2") == F.col("__key"))
    left = mine.join(found.where("not kept"), met, "left_anti")
    if not repeats:
        again = found.where("kept")
        left = left.join(again, met, "left_anti").union(left.join(again, met, "left_semi").dropDuplicates([doc_id, "__key2"]))
    return left.drop("__key2")
