"""What each turn of a conversation sends, as a chain of prefixes instead of an array for each turn.

A turn's node is a hash of all texts so far, in order: a running sum of hashes of (place, text), in two independent sums of 64 bits. Its parent is the node of
the turn before. So conversations that begin alike share nodes, a store of nodes grows with the distinct turns and not with the square of a conversation's
length, and the running sums keep one row at a time. ``sent`` gives the texts of the nodes that are asked for, and of no others.

Turns of equal order are taken by their hashes; a null text counts, apart from an empty one; rows without a key are no turns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _hashes(text: Column) -> list[Column]:
    return [F.xxhash64(F.lit(i), text, text.isNull()) for i in range(2)]


def chain(turns: DataFrame, key: str = "conv_id", order: str = "turn", text: str = "text") -> DataFrame:
    """Adds place (from 1), node and parent (null at the first turn)."""
    first, second = _hashes(F.col(text))
    by = Window.partitionBy(key).orderBy(order, first, second)
    placed = turns.where(F.col(key).isNotNull()).withColumn("place", F.row_number().over(by).cast("bigint"))
    running = Window.partitionBy(key).orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    sums = [F.sum(F.xxhash64("place", h).cast("decimal(20,0)")).over(running).cast("decimal(30,0)") for h in (first, second)]
    noded = placed.withColumn("node", F.struct(sums[0].alias("a"), sums[1].alias("b")))
    return noded.withColumn("parent", F.lag("node").over(Window.partitionBy(key).orderBy("place")))


def nodes(chained: DataFrame, key: str = "conv_id", text: str = "text") -> DataFrame:
    """node, parent, place, text, owner (the least conversation that has the node) and conversations (how many have it): a row for each node."""
    own = [F.min(c).alias(c) for c in ("parent", "place")]
    return chained.groupBy("node").agg(*own, F.min(text).alias(text), F.min(key).alias("owner"), F.count("*").alias("conversations"))


def sent(chained: DataFrame, wanted: DataFrame, key: str = "conv_id", text: str = "text") -> DataFrame:
    """The rows of ``wanted`` (node and others) with ``sent``: the texts up to their node, from one of the conversations that have it.

    Nodes that no conversation has get null. What comes out is as long as what is asked for.
    """
    asked = wanted.select("node").distinct()
    owners = chained.join(asked, "node", "left_semi").groupBy("node").agg(F.min(F.struct(F.col(key).alias("k"), F.col("place").alias("p"))).alias("o")).select("node", F.col("o.k").alias("__key"), F.col("o.p").alias("__place"))
    before = chained.select(F.col(key).alias("__key"), F.col("place").alias("__at"), F.col(text).alias("__text"))
    texts = owners.join(before, "__key").where("__at <= __place").groupBy("node").agg(F.transform(F.array_sort(F.collect_list(F.struct("__at", "__text"))), lambda x: x["__text"]).alias("sent"))
    return wanted.join(texts, "node", "left")
