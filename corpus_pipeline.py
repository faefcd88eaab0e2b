"""The corpus pipeline: language ID, near-duplicate removal, benchmark decontamination, secret redaction, piece encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the docs of
the next stage. All stages but the last return the columns of documents.

1. ``language_id`` drops documents of which no language can be told: null texts, texts without a letter, and texts in scripts
   that no labelled row has. These are unlike all labelled rows by their trigrams and by their letters too: neither cosine is
   higher than what unrelated vectors reach by chance (``language_id.chance``). A text that shares letters with labelled rows, but
   no trigrams, stays. Profiles are learned from the stage's own labelled rows that aren't held out; the columns of what stays
   are unchanged.
2. ``near_dup`` keeps one document of each near-duplicate group (5-word shingles, similarity of 0.8 or more),
   and one row of those repeated with doc_id and text.
3. ``decontaminate`` drops documents in which a 10-word window of a benchmark item occurs.
4. ``secrets`` replaces secrets by a mask in the text (n_chars follows); no document is dropped.
5. ``encode`` adds sampled piece ids as a last column, ``ids``, or ids_1 and so on if documents have an ``ids`` of their own.

Extra columns are kept by all stages; names that start with two underscores are reserved. What a stage wrote is deleted once the
next one has written its result. Null texts go in the first stage; a null doc_id is a key like others (near_dup says what of
it stays), repeated rows leave one, and an empty table gives an empty result with all columns.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakwork.llm import decontaminate as contamination
from cloakwork.llm import language_id as languages
from cloakwork.llm import near_dup as duplicates
from cloakwork.llm import piece_sampling as pieces
from cloakwork.llm import secret_scan as secret
from cloakwork.llm.common import shared_dir, table
from cloakwork.session import remove


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    usable = F.col("doc_id").isNotNull() & ~languages.held_out(F.col("doc_id"))
    learned = languages.learn(docs, usable=usable)
    known = languages.identify(docs, learned, keep=docs.columns, names=("__lang", "__score"))
    if learned.isEmpty():  # no document has a known language; then only those without letters go
        return known.where(F.col("text").rlike(r"\p{L}")).select(*docs.columns)
    # Few and unlike labelled rows share hardly a trigram with clean texts, but their letters; only texts in doubt are compared by these.
    letters = languages.learn(docs, usable=usable, n=1)
    doubtful = known.withColumn("__doubtful", F.when(F.col("__score") <= languages.chance(), F.col("text")))
    found = languages.identify(doubtful, letters, text="__doubtful", keep=[*docs.columns, "__lang", "__score"], names=("__script", "__likeness"))
    alike = (F.col("__lang") != languages.UNKNOWN) & (F.col("__score") > languages.chance())
    return found.where(alike | (F.col("__likeness") > languages.chance(sigmas=4))).select(*docs.columns)


def near_dup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return duplicates.deduplicate(docs, k=5, percent=80, repeats=False)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return contamination.remove_documents(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cleaned = secret.redact(docs)
    return cleaned.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else cleaned


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.encode(docs)


STAGES = [("language_id", language_id), ("near_dup", near_dup), ("decontaminate", decontaminate), ("secrets", secrets), ("encode", encode)]

#: SQL can't express the stages language_id, near_dup and encode.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/cloakwork/pipeline-{uuid.uuid4().hex}"
    before = None
    for i, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        path = f"{folder}/{i}-{name}"
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
        if before:
            remove(spark, before)
        before = path
    return docs


QUERIES = {"pipeline": run}
ORACLES: dict = {}
