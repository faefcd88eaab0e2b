"""Chat formatting with cumulative-snapshot collapse.

Logs often hold a conversation many times, once after each turn. The hash of each turn prefix is a running sum (over the
conversation's turns in order) of hashes of (place, role, text), in two independent 64-bit sums; so two conversations have
the same prefix hash exactly if their first turns are the same, up to 128-bit collisions. A conversation whose whole hash is
the hash of a proper prefix of a longer one is a snapshot: an anti-join removes it. Of equal conversations the one with the
least conv_id stays. What is left is rendered, one string a conversation.

Hashes are made in the scan, so the prefix work exchanges no texts. Turns are dealt out by range, so a conversation with a
third of all rows lies in many blocks; places and sums run within blocks, and what earlier blocks add comes from a row for each
block of a conversation. A first turn or a conversation that a third of all rows share meets in aggregates that
combine before the shuffle. Rows without a conv_id need no order, so they pass by the blocks, and equal ones are one row
before anything else. A conversation is one string in the end; turns are sorted, made distinct and rendered by blocks of ``TURNS``
numbers before.

Defined results: turns are ordered by turn, then role, then hash; rows that repeat a turn, role and text of their
conversation count once; null roles and texts are written as empty and hash apart from empty ones; a null turn comes
first; each row with a null conv_id is a conversation of one turn, and those that stay have a null conv_id; an empty table
gives no rows. Special tokens inside a text are
broken by a backslash, so that they can't end a turn. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from cloakwork.llm.common import written

#: Turns of so many successive numbers are rendered at once; more than a block of equal or null numbers stay one.
TURNS = 256


def _turns(conversations: DataFrame, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    return conversations.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))


def _hash(*columns: Column) -> Column:
    """64 bits that tell null from empty, as a decimal, so that sums can't overflow."""
    return F.xxhash64(*[x for c in columns for x in (c, c.isNull())])


def _hashed(turns: DataFrame) -> DataFrame:
    return turns.select("*", _hash(F.col("role"), F.col("text")).alias("h1"), _hash(F.lit("second"), F.col("text"), F.col("role")).alias("h2"))


def _step(place: Column, h: str) -> Column:
    return F.xxhash64(place, F.col(h)).cast("decimal(20,0)")


def _before(blocks: DataFrame, *values: str) -> DataFrame:
    """For each block of a conversation, the sums of ``values`` over its earlier blocks, under before_ and the name."""
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return blocks.select("*", *[F.coalesce(F.sum(v).over(earlier), F.lit(0)).alias(f"before_{v}") for v in values])


def prefixes(turns: DataFrame) -> DataFrame:
    """conv_id, place (1 ...), p1, p2 (prefix hash up to this place) and is_last, for each distinct turn of conversations with an id."""
    order = ["conv_id", "turn", "role", "h1", "h2"]
    distinct = _hashed(turns.where(F.col("conv_id").isNotNull())).select(*order).distinct()
    # Written, so that a row's block is the same whenever a task runs again.
    ranged = written(distinct.repartitionByRange(*order).withColumn("block", F.spark_partition_id()), "turns")
    key = ["block", "conv_id"]
    by = Window.partitionBy(*key).orderBy("turn", "role", "h1", "h2")
    sizes = _before(ranged.groupBy(*key).agg(F.count("*").alias("n")), "n").withColumn("total", F.sum("n").over(Window.partitionBy("conv_id")))
    placed = ranged.withColumn("local", F.row_number().over(by)).join(sizes, key)
    placed = placed.select(*key, "turn", "role", "h1", "h2", "total", (F.col("local") + F.col("before_n")).cast("bigint").alias("place"))
    steps = placed.select("*", *[_step(F.col("place"), h).alias(s) for h, s in (("h1", "s1"), ("h2", "s2"))])
    sums = _before(steps.groupBy(*key).agg(F.sum("s1").alias("s1"), F.sum("s2").alias("s2")), "s1", "s2").select(*key, "before_s1", "before_s2")
    running = by.rowsBetween(Window.unboundedPreceding, 0)
    local = steps.select(*key, "place", "total", *[F.sum(s).over(running).alias(s) for s in ("s1", "s2")])
    whole = lambda s: (F.col(s) + F.col(f"before_{s}")).cast("decimal(30,0)")
    return local.join(sums, key).select("conv_id", "place", whole("s1").alias("p1"), whole("s2").alias("p2"), (F.col("place") == F.col("total")).alias("is_last"))


def maximal(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns and copies of the conversations that stay; role and text of those without an id."""
    p = prefixes(turns)
    whole = p.where("is_last").groupBy("place", "p1", "p2").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("copies"))
    single = _hashed(turns.where(F.col("conv_id").isNull())).select(F.lit(1).cast("bigint").alias("place"), *[_step(F.lit(1).cast("bigint"), h).cast("decimal(30,0)").alias(p) for h, p in (("h1", "p1"), ("h2", "p2"))], "conv_id", "role", "text")
    single = single.groupBy("place", "p1", "p2").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("copies"), F.first("role").alias("role"), F.first("text").alias("text"))
    both = whole.select("*", F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text")).unionByName(single)
    # At most two rows meet here, one of each kind.
    both = both.groupBy("place", "p1", "p2").agg(F.min("conv_id").alias("conv_id"), F.sum("copies").alias("copies"), F.max("role").alias("role"), F.max("text").alias("text"))
    proper = p.where("not is_last").select("place", "p1", "p2").distinct()
    return both.join(proper, ["place", "p1", "p2"], "left_anti").select("conv_id", F.col("place").alias("n_turns"), "copies", "role", "text")


def _part() -> Column:
    said = lambda c: F.replace(F.coalesce(F.col(c), F.lit("")), F.lit("<|"), F.lit("<\\|"))
    return F.concat(F.lit("<|im_start|>"), said("role"), F.lit("\n"), said("text"), F.lit("<|im_end|>\n"))


def _parts(turns: DataFrame) -> DataFrame:
    """conv_id, block and rendered, for each block of ``TURNS`` numbers of turns."""
    numbers = isinstance(turns.schema["turn"].dataType, NumericType)
    block = F.floor(F.col("turn") / TURNS) if numbers else F.lit(None).cast("bigint")
    each = _hashed(turns).select("conv_id", block.alias("block"), F.struct("turn", "role", "h1", "h2", _part().alias("part")).alias("t"))
    return each.groupBy("conv_id", "block").agg(F.array_join(F.transform(F.array_sort(F.collect_set("t")), lambda t: t["part"]), "").alias("rendered"))


def format_chats(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, n_turns, copies and rendered, for each maximal conversation."""
    turns = _turns(conversations, conv_id, turn, role, text)
    kept = maximal(turns)
    # Blocks are rendered by themselves; then join and grouping share a key, and a conversation's task only strings them together.
    mine = _parts(turns.where(F.col("conv_id").isNotNull())).join(kept.where(F.col("conv_id").isNotNull()).select("conv_id", "n_turns", "copies"), "conv_id")
    strung = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "rendered"))), lambda b: b["rendered"]), "")
    rendered = mine.groupBy("conv_id", "n_turns", "copies").agg(strung.alias("rendered")).select("conv_id", "n_turns", "copies", "rendered")
    return rendered.unionByName(kept.where(F.col("conv_id").isNull()).select("conv_id", "n_turns", "copies", _part().alias("rendered")))
