"""Small tables with awkward rows, shared by the tests of this folder."""

from __future__ import annotations

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def documents(spark, texts, extra=()):
    """A documents table: (doc_id, text) pairs or texts; lang is null."""
    rows = [(t if isinstance(t, tuple) else (i, t)) for i, t in enumerate(texts)]
    return spark.createDataFrame([(i, t, None, "s", len(t) if t is not None else None) for i, t in [*rows, *extra]], DOCS)
