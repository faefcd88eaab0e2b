"""Benchmark decontamination: exact hits of benchmark word windows in training documents.

Texts are lower-cased over A-Z and cut into words of a-z, digits and characters from U+0080. Each benchmark item gives its
windows of ``width`` consecutive words, or a single shorter window if it has fewer words. The distinct windows form a hash
set that is broadcast; every position of every document is looked up by a 64-bit hash of the words that start there, and
a hash match counts only if all the words are equal.

One scan, one shuffle: a document's positions are generated, hashed, looked up and reduced inside the scan's task, and what
is exchanged is one row for each document plus partial aggregates of its hits. The broadcast has windows and their numbers
only; it is bounded by ``most_windows`` windows and about ``most_bytes`` bytes at a time, which are counted before: a larger
set is dealt into blocks by hash and the scan is repeated for each block, with the same result. The items of a window stay
outside: what documents hit is a set of window numbers, and items are listed once for each such set, however many documents
have it and however many items share a window.

Defined results: null and empty texts have no words, no hits and are not contaminated. Items without words (null, empty,
punctuation) have no window. A null item_id takes part in hits but is neither counted nor listed; repeated item_ids count
once. Rows repeated in documents are reported once for each repetition. Extra columns are ignored by ``report`` and kept
by ``remove_documents`` and ``remove_spans``; columns may have any names but those that start with two underscores.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakwork.functions.arrays import let, pieces, record, running_max, running_sum, runs
from cloakwork.llm.common import ascii_lower, text_key, written

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    return F.coalesce(F.regexp_extract_all(ascii_lower(text), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def windows(items: DataFrame, text: str = "text", item_id: str = "item_id", width: int = 10) -> tuple[DataFrame, DataFrame]:
    """Distinct windows (__wid, __words, __len, __hash), and which items have them (__wid, id; null ids left out)."""
    cut = items.select(F.col(item_id).cast("string").alias("id"), words_of(F.col(text)).alias("w")).where(F.size("w") > 0)
    each = cut.select("id", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - (width - 1))), lambda i: F.slice("w", i, width))).alias("__words"))
    distinct = each.select("__words").distinct().select("__words", F.size("__words").alias("__len"), F.xxhash64(F.size("__words"), F.col("__words")).alias("__hash"))
    # Written, since numbers given to rows must not be given anew.
    found = written(distinct.withColumn("__wid", F.monotonically_increasing_id()), "windows")
    return found, written(each.where(F.col("id").isNotNull()).join(found.select("__words", "__wid"), "__words").select("__wid", "id").distinct(), "window-items")


def _hash_at(words: Column, at: Column, n: int) -> Column:
    """xxhash64 of n words from a position: the same as of the array of these words, without building it."""
    return F.xxhash64(F.lit(n), *[F.get(words, at + k) for k in range(n)])


def report(docs: DataFrame, items: DataFrame, text: str = "text", doc_id: str = "doc_id", item_id: str = "item_id", width: int = 10, most_windows: int = 250_000, most_bytes: int = 64 << 20) -> DataFrame:
    """One row per row of docs: doc_id, __key (of the text), n_words, n_hit, n_items, items, items_sha256, spans, contaminated.

    ``spans`` are the hit words as [first, last] positions of merged runs; ``items_sha256`` digests the comma-joined items.
    """
    found, owners = windows(items, text, item_id, width)
    lengths = found.groupBy("__len").agg(F.count("*").alias("n"), F.sum(64 + F.aggregate("__words", F.lit(0).cast("long"), lambda a, w: a + 24 + F.octet_length(w))).alias("bytes")).collect()  # at most `width` rows
    blocks = max(1, -(-sum(r["n"] for r in lengths) // most_windows), -(-sum(r["bytes"] for r in lengths) // most_bytes))
    base = docs.select(F.col(doc_id).alias("doc_id"), text_key(F.col(text)).alias("__key"), words_of(F.col(text)).alias("w"))
    base = base.withColumn("n_words", F.size("w").cast("long"))
    parts = None
    for b in range(blocks):
        block = found.where(F.pmod(F.xxhash64("__hash"), F.lit(blocks)) == b) if blocks > 1 else found
        part = _scan(base, block, sorted(r["__len"] for r in lengths), first=b == 0)
        parts = part if parts is None else parts.unionByName(part)
    one = parts.groupBy("doc_id", "__key").agg(
        F.max("n_words").alias("n_words"),
        F.sum(F.when(F.col("at") == -1, 1).otherwise(0)).alias("copies"),
        F.collect_set(F.when(F.col("at") >= 0, F.struct("at", "len"))).alias("hits"),
        F.sort_array(F.collect_set(F.when(F.col("at") >= 0, F.col("wid")))).alias("wids"),
    )
    one = written(one.select("doc_id", "__key", "n_words", "copies", _merged(F.col("hits")).alias("spans"), F.when(F.size("wids") > 0, F.col("wids")).alias("wids")), "hits")
    sets = one.where(F.col("wids").isNotNull()).select("wids").distinct().select("wids", F.explode("wids").alias("__wid")).join(owners, "__wid").groupBy("wids").agg(F.sort_array(F.collect_set("id")).alias("items"))
    sets = written(sets.withColumn("items_sha256", F.sha2(F.array_join("items", ","), 256)), "window-sets").withColumnRenamed("wids", "__wids")
    out = one.join(sets, F.col("wids") == F.col("__wids"), "left")
    out = out.withColumn("n_hit", F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + (s["last"] - s["first"] + 1).cast("long")))
    out = out.select(
        "doc_id", "__key", "n_words", "n_hit", F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"), F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), "spans", (F.col("n_hit") > 0).alias("contaminated"),
        F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("__copy"),
    )
    return out.drop("__copy")


def _merged(hits: Column) -> Column:
    """Runs of hits (at, len) that touch or overlap, as (first, last) words."""

    def cut(h: Column) -> Column:
        ends = running_max(F.transform(h, lambda x: x["at"] + x["len"]))
        return let(ends, lambda top: runs(F.zip_with(h, top, lambda x, end: record(at=x["at"], end=end)), lambda x, i: x["at"] > F.get(top, i - 1)))

    done = F.transform(let(F.sort_array(hits), cut), lambda r: record(first=F.get(r, 0)["at"], last=F.element_at(r, -1)["end"] - 1))
    return F.when(F.size(hits) > 0, done).otherwise(F.array()).cast("array<struct<first:int,last:int>>")


def _scan(base: DataFrame, block: DataFrame, lengths: list[int], first: bool) -> DataFrame:
    """Rows (doc_id, __key, n_words, at, len, wid): for each hit, and in the first scan a row at = -1 for each document."""
    at = base.select("doc_id", "__key", "n_words", "w", F.explode(F.sequence(F.lit(-1), F.size("w") - 1)).alias("at"))
    if not first:
        at = at.where(F.col("at") >= 0)
    probes = F.array(*[F.struct(F.lit(n).alias("len"), _hash_at(F.col("w"), F.col("at"), n).alias("hash")) for n in lengths or [0]])
    if len(lengths) == 1:
        at = at.select("*", F.lit(lengths[0]).alias("len"), _hash_at(F.col("w"), F.greatest(F.col("at"), F.lit(0)), lengths[0]).alias("hash"))
    elif lengths:
        at = at.select("*", F.explode(probes).alias("p")).select("doc_id", "__key", "n_words", "w", "at", "p.len", "p.hash")
        # the sentinel row is there once, not once for each length
        at = at.where((F.col("at") >= 0) | (F.col("len") == lengths[0]))
    else:
        return at.where(F.col("at") == -1).select("doc_id", "__key", "n_words", "at", F.lit(0).alias("len"), F.lit(None).cast("long").alias("wid"))
    side = block.select(F.col("__words").alias("words"), F.col("__len").alias("wlen"), _hash_at(F.col("__words"), F.lit(0), lengths[0]).alias("whash") if len(lengths) == 1 else _by_length(lengths).alias("whash"), F.col("__wid").alias("wid"))
    joined = at.join(
        F.broadcast(side),
        (F.col("hash") == F.col("whash")) & (F.col("at") >= 0) & (F.col("len") == F.col("wlen")) & (F.slice("w", F.greatest(F.col("at"), F.lit(0)) + 1, F.col("len")) == F.col("words")),
        "left",
    )
    return joined.where((F.col("at") == -1) | F.col("wid").isNotNull()).select("doc_id", "__key", "n_words", "at", "len", "wid")


def _by_length(lengths: list[int]) -> Column:
    found = F.lit(None).cast("long")
    for n in lengths:
        found = F.when(F.col("__len") == n, _hash_at(F.col("__words"), F.lit(0), n)).otherwise(found)
    return found


def digest(reported: DataFrame) -> DataFrame:
    """The columns of the contract from a report."""
    return reported.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def remove_documents(docs: DataFrame, items: DataFrame, text: str = "text", doc_id: str = "doc_id", least_hit: int = 1, **parameters) -> DataFrame:
    """docs without the documents of which at least ``least_hit`` words are hit; all columns are kept."""
    bad = written(report(docs, items, text, doc_id, **parameters).where(F.col("n_hit") >= least_hit).select(F.col("doc_id").alias("__id"), "__key").distinct(), "contaminated")
    mine = docs.withColumn("__key2", text_key(F.col(text)))
    return mine.join(bad, F.col(doc_id).eqNullSafe(F.col("__id")) & (F.col("__key2") == F.col("__key")), "left_anti").drop("__key2")


def remove_spans(docs: DataFrame, items: DataFrame, text: str = "text", doc_id: str = "doc_id", **parameters) -> DataFrame:
    """docs with hit words, and what stands between two hit words of a run, cut out of the text."""
    bad = written(report(docs, items, text, doc_id, **parameters).where("contaminated").select(F.col("doc_id").alias("__id"), "__key", F.col("spans").alias("__spans")).dropDuplicates(["__id", "__key"]), "contaminated")
    mine = docs.withColumn("__key2", text_key(F.col(text)))
    joined = mine.join(bad, F.col(doc_id).eqNullSafe(F.col("__id")) & (F.col("__key2") == F.col("__key")), "left")
    plain = F.col(text)

    def kept(x: Column) -> Column:
        """The pieces between runs: from the end of a run's last word to the start of the next one's first."""
        ends = running_sum(F.transform(x, lambda y: y["gap"] + y["word"]))
        starts = lambda e, i: F.get(e, i) - F.get(x, i)["word"]
        before = lambda e: F.transform("__spans", lambda r, k: record(first=F.when(k == 0, F.lit(0)).otherwise(F.get(e, F.get("__spans", k - 1)["last"])), last=starts(e, r["first"])))
        return let(ends, lambda e: F.concat(before(e), F.array(record(first=F.get(e, F.element_at("__spans", -1)["last"]), last=F.length(plain)))))

    # Lengths are the same after A-Z to a-z, so pieces are cut from the text as it is: gap 0, word 0, gap 1, word 1, ...
    sized = F.zip_with(F.split(ascii_lower(plain), WORD, -1), words_of(plain), lambda g, w: record(gap=F.length(g), word=F.coalesce(F.length(w), F.lit(0))))
    cleaned = joined.withColumn(text, F.when(F.col("__spans").isNotNull(), pieces(plain, let(sized, kept))).otherwise(plain))
    return cleaned.drop("__key2", "__id", "__key", "__spans")
