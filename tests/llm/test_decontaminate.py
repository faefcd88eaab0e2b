import hashlib
import re

import pytest
from pyspark.sql import functions as F

from cloakwork.llm import decontaminate as D
from tests.llm.helpers import documents

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ITEMS = [(1, " ".join(f"w{i}" for i in range(14))), (2, "Only Four Words here"), (3, None), (4, "!?"), (10, " ".join(f"w{i}" for i in range(2, 13))), (None, "no id at all"), (2, "only four words HERE")]
TEXTS = [None, "", "nothing", "a only, four words here b", "x " + " ".join(f"W{i}" for i in range(12)) + " y", " ".join(f"w{i}" for i in range(30)), "é no id at all é", "only four words here " * 3000, "w1 w2 w3"]


def brute(text, items):
    w = WORD.findall((text or "").translate(LOWER))
    hit, ids = set(), set()
    for item, t in items:
        x = WORD.findall((t or "").translate(LOWER))
        n = min(10, len(x))
        windows = {tuple(x[i : i + n]) for i in range(len(x) - n + 1)} if n else set()
        for i in range(len(w) - n + 1 if n else 0):
            if tuple(w[i : i + n]) in windows:
                hit.update(range(i, i + n))
                if item is not None:
                    ids.add(str(item))
    return len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)


def tables(spark, extra=()):
    return documents(spark, TEXTS, extra), spark.createDataFrame(ITEMS, "item_id bigint, text string")


@pytest.mark.parametrize("most", [250_000, 3])
def test_against_brute_force(spark, most):
    docs, items = tables(spark, [(None, TEXTS[3]), (3, TEXTS[3]), (3, "another text")])
    got = D.digest(D.report(docs.withColumn("n_hit", F.lit(1)), items, most_windows=most)).collect()
    want = sorted((str(r.doc_id), *brute(r.text, ITEMS)) for r in docs.collect())
    assert sorted((str(r.doc_id), *r[1:]) for r in got) == want


def test_empty_tables(spark):
    docs, items = tables(spark)
    assert D.digest(D.report(docs.limit(0), items)).count() == 0
    got = D.digest(D.report(docs, items.limit(0))).collect()
    assert len(got) == len(TEXTS) and not any(r.contaminated or r.n_items for r in got)


def test_removal(spark):
    docs, items = tables(spark, [(None, TEXTS[3])])
    left = D.remove_documents(docs, items)
    assert sorted(r.doc_id for r in left.collect()) == [0, 1, 2, 8] and left.columns == docs.columns
    cut = {r.doc_id: r.text for r in D.remove_spans(docs, items).collect()}
    assert cut[3] == "a ,  b".replace(",  ", "  ") or cut[3] == "a  b"
    assert cut[0] is None and cut[2] == "nothing" and cut[8] == "w1 w2 w3"


def test_a_window_common_to_many_items(spark):
    """A prompt header of 10^5 items: the broadcast has it once, and the items are listed."""
    header = " ".join(f"h{i}" for i in range(10))
    items = spark.range(100_000).select(F.col("id").alias("item_id"), F.concat(F.lit(header + " "), F.col("id").cast("string")).alias("text"))
    docs = documents(spark, [f"before {header} after", f"{header} 7 x", "clean"])
    found, owners = D.windows(items)
    assert found.count() == 100_001 and owners.groupBy("__wid").count().agg(F.max("count")).first()[0] == 100_000
    got = {r.doc_id: r for r in D.report(docs, items, most_bytes=4 << 20).select("doc_id", "n_hit", "n_items", "items_sha256").collect()}
    want = hashlib.sha256(",".join(sorted(map(str, range(100_000)))).encode()).hexdigest()
    assert (got[0].n_hit, got[0].n_items, got[0].items_sha256) == (10, 100_000, want) and (got[1].n_hit, got[1].n_items) == (11, 100_000) and got[2].n_items == 0


def cut_by_hand(text, spans):
    words = [m.span() for m in re.finditer(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text)]
    out, at = "", 0
    for first, last in spans:
        out += text[at : words[first][0]]
        at = words[last][1]
    return out + text[at:]


def test_many_hits_in_a_long_text(spark):
    docs = documents(spark, ["É! only four words here. Ab, " * 4000, " only FOUR words here", "x"])
    items = spark.createDataFrame([(1, "only four words here"), (2, "ab é only")], "item_id bigint, text string")
    reported = {r.doc_id: r for r in D.report(docs, items).collect()}
    cut = {r.doc_id: r.text for r in D.remove_spans(docs.withColumn("spans", F.lit(0)), items).collect()}
    for r in docs.collect():
        assert cut[r.doc_id] == cut_by_hand(r.text, [(s.first, s.last) for s in reported[r.doc_id].spans])
        assert reported[r.doc_id].n_hit == sum(s.last - s.first + 1 for s in reported[r.doc_id].spans)
    assert len(reported[0].spans) == 4000 and cut[1] == " "
