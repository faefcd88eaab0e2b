import numpy as np
from pyspark.sql import functions as F

from cloakwork.llm import language_id as L
from tests.llm.helpers import DOCS

EN = ["the cat sat on the mat and looked at the rain", "there is nothing that the weather would not change", "they went with the others to the old house"]
DE = ["der hund lag unter dem tisch und schlief ein", "es gibt nichts was das wetter nicht verändern würde", "sie gingen mit den anderen zu dem alten haus"]


def corpus(spark, n=20):
    rows, i = [], 0
    for _ in range(n):
        for lang, texts in (("en", EN), ("de", DE)):
            for t in texts:
                rows.append((i, t, lang, "s", len(t)))
                i += 1
    return spark.createDataFrame(rows, DOCS)


def test_learns_and_predicts_held_out_rows(spark):
    out = L.label_documents(corpus(spark)).join(corpus(spark).select("doc_id", "lang"), "doc_id").collect()
    assert {r.held_out for r in out} == {True, False}
    assert all(r.lang == r.lang_pred and 0 < r.score <= 1 for r in out)


def test_awkward_rows(spark):
    odd = spark.createDataFrame([(1000, None, "en", "s", 0), (1001, "", "en", "s", 0), (1002, "123 !?", "de", "s", 6), (None, EN[0], "en", "s", 1), (1003, "the " * 100_000, None, "s", 1), (1003, "the " * 100_000, None, "s", 1)], DOCS)
    out = L.label_documents(corpus(spark).unionByName(odd).withColumn("lang_pred", F.lit("clash"))).where("doc_id >= 1000 or doc_id is null").collect()
    by = {r.doc_id: r for r in out}
    assert len(out) == 6 and [by[i].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3 and by[1001].score == 0
    assert by[None].lang_pred == "en" and by[None].held_out is False and by[1003].lang_pred == "en"


def test_nothing_to_learn_from(spark):
    assert L.label_documents(spark.createDataFrame([], DOCS)).collect() == []
    out = L.label_documents(spark.createDataFrame([(1, "hello", None, "s", 5)], DOCS)).collect()
    assert [(r.lang_pred, r.score) for r in out] == [("und", 0.0)]


def test_linear_score_equals_bundled_vectors():
    letters: dict = {}
    keys, counts = np.unique(L.grams_of("the rain in spain"), return_counts=True)
    vector = L.bundle(keys, counts, 512, 3, letters)
    proto = L.bundle(*np.unique(L.grams_of("rain again and again"), return_counts=True), 512, 3, letters)
    profiles = L.Profiles(["x"], (proto / np.linalg.norm(proto))[None, :], 3)
    direct = vector @ proto / np.linalg.norm(proto) / np.sqrt(512 * np.square(counts).sum())
    assert abs(L.Scorer(profiles).score("the rain in spain")[1] - direct) < 1e-9


def test_labels_of_held_out_rows_are_not_used(spark):
    docs = corpus(spark)
    lied = docs.withColumn("lang", F.when(L.held_out(F.col("doc_id")), "zz").otherwise(F.col("lang")))
    assert {r.lang_pred for r in L.label_documents(lied).collect()} == {"en", "de"}


def test_more_labels_than_one_block(spark):
    """2,500 labels: none is left out, whatever the block; each label's texts have a word of their own."""
    word = lambda i: "".join(chr(97 + i // 26**k % 26) for k in range(3)) * 3
    rows = [(i * 4 + j, f"{word(i)} {word(i)} {word(i)[::-1]}", f"l{i:04d}", "s", 1) for i in range(2500) for j in range(4)]
    docs = spark.createDataFrame(rows, DOCS).repartition(4)
    learned = L.learn(docs, dim=256)
    assert learned.count() == 2500
    sample = docs.where("doc_id % 97 = 0")
    few = {r.doc_id: (r.lang_pred, round(r.score, 9)) for r in L.identify(sample, learned, most=400).collect()}
    one = {r.doc_id: (r.lang_pred, round(r.score, 9)) for r in L.identify(sample, learned, most=5000).collect()}
    assert few == one and len(few) == 104 and all(v[0] == f"l{k // 4:04d}" for k, v in few.items())
