"""Requests as tables: JSON lines in batch or as a stream, admission by size, and the exploded working form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakwork.model import MOST_BODY_BYTES, REQUESTS
from cloakwork.operators.policy import body_ok


def read(spark: SparkSession, path: str, stream: bool = False, most_bytes: int = MOST_BODY_BYTES) -> tuple[DataFrame, DataFrame]:
    """(accepted requests, refused bodies). Unknown fields are ignored; missing ones are null.

    A body is refused if it is larger than the cap or no JSON object; nothing is inferred.
    """
    lines = (spark.readStream if stream else spark.read).text(path)
    parsed = lines.select("value", F.octet_length("value").alias("bytes"), F.from_json("value", f"{REQUESTS}, __bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__bad"}).alias("r"))
    good = body_ok(F.col("value"), most_bytes) & F.col("r").isNotNull() & F.col("r.__bad").isNull()
    accepted = parsed.where(good).select("r.*").drop("__bad")
    refused = parsed.where(~good).select("bytes", F.when(F.col("bytes") > most_bytes, "too large").otherwise("malformed").alias("reason"))
    return accepted, refused


def exploded(requests: DataFrame) -> DataFrame:
    """One row a text, with its place; requests without texts have none."""
    return requests.select("call_id", "input_type", "is_final", F.posexplode("texts").alias("text_idx", "text"))


def warmable(responses: DataFrame) -> DataFrame:
    """Responses that aren't a chunk with more to come."""
    return responses.where(~F.coalesce(F.col("is_final") == F.lit(False), F.lit(False)))
