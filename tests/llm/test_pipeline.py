import inspect

from pyspark.sql import functions as F

from cloakwork.llm import near_dup, queries
from tests.llm.helpers import DOCS


def test_stages(spark, tmp_path):
    import corpus_pipeline as P

    assert [n for n, _ in P.STAGES] == ["language_id", "near_dup", "decontaminate", "secrets", "encode"]
    body = " ".join(f"wordy{c}" for c in "abcdefghijklmnopqrstuvwxyz")
    rows = [(1, body, "en", "s", 1), (2, body.upper() + " x", "en", "s", 1), (3, "123 456", "en", "s", 1), (4, None, "en", "s", 1), (5, "an item of ten words that stands in the benchmark too", "en", "s", 1), (6, "note password=supersecret99 here", "en", "s", 1), (7, "a clean text", "en", "s", 1)]
    extra = {k: F.lit("clash") for k in ("lang_pred", "score", "ids", "kept", "cls", "spans", "words", "hash")}
    spark.createDataFrame(rows, DOCS).withColumns(extra).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "An item of ten words that stands in the benchmark")], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = {r.doc_id: r for r in P.run(spark, str(tmp_path)).collect()}
    assert out[1].lang_pred == out[1].cls == out[1].ids == "clash" and out[1].ids_1
    assert set(out) == {1, 6, 7} and out[6].text == "note [SECRET] here" and out[6].n_chars == len(out[6].text) and out[7].text == "a clean text" and out[7].ids_1


def test_awkward_tables(spark, tmp_path):
    """Empty tables; nulls in any column, repeated rows, ties, and a long text, through all stages."""
    import corpus_pipeline as P

    long = " ".join(f"w{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}{'uvwxyzabcd'[i // 100 % 10]}{'efghijklmn'[i // 1000 % 10]}" for i in range(9000))
    rows = [(1, long, "en", "s", 1), (1, long, "en", "s", 1), (None, long + " and a little", None, None, None), (None, "a text of no id", None, None, None), (None, "a text of no id", None, None, None), (2, "a tie of two texts", "en", "s", 1), (2, "a tie with another one", "fr", None, 1), (3, None, None, None, None), (4, "", "en", "s", 0), (None, None, None, None, None), (5, "token=abcdefgh1 " * 3000, "en", "s", 1)]
    items = [(None, None), (1, ""), (2, "words of no document at all here")]
    for name, mine, theirs in (("full", rows, items), ("no_items", rows, []), ("empty", [], items)):
        spark.createDataFrame(mine, DOCS).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame(theirs, "item_id bigint, text string").write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
        out = P.run(spark, f"{tmp_path}/{name}")
        assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "ids"]
        got = sorted(repr((r.doc_id, r.text)) for r in out.collect())
        left = [(1, long), (None, "a text of no id"), (2, "a tie of two texts"), (2, "a tie with another one"), (5, "[SECRET] " * 3000)]
        assert got == (sorted(map(repr, left)) if mine else [])


def test_queries_are_registered():
    import __spark_entry__ as e

    names = e.queries()
    for n in range(1, 14):
        assert sum(x.startswith(f"op{n}_") for x in names) == 1
    assert "pipeline" in names and set(queries.ORACLES) <= set(names)
    assert "localCheckpoint" not in inspect.getsource(near_dup)


def test_language_stage_decides_by_its_profiles(spark):
    """Texts in scripts that no labelled row has go, labelled or short ones stay."""
    import corpus_pipeline as P

    known = [(i, f"the weather {w} would not change with the others in the old house", "en", "s", 1) for i, w in enumerate("abcdefghijklmnopqrst")]
    other = ["привет как дела сегодня утром в городе", "これは日本語の文章です", "καλημέρα τι κάνεις σήμερα εδώ", "안녕하세요 오늘 날씨가 좋네요", "שלום מה שלומך היום בבוקר", "สวัสดีครับวันนี้อากาศดี"]
    odd = [(100 + i, t, None, "s", 1) for i, t in enumerate(other)] + [(200, "The weather.", None, "s", 1), (201, "house", None, "s", 1)]
    kept = {r.doc_id for r in P.language_id(spark, spark.createDataFrame(known + odd, DOCS), "").collect()}
    assert kept >= {*range(20), 200, 201} and len(kept & set(range(100, 106))) <= 2


def test_language_stage_keeps_unlike_texts_in_known_letters(spark):
    """Few labelled rows, which share hardly a trigram with clean texts: these stay by their letters; other scripts and texts without letters go."""
    import corpus_pipeline as P

    rows = [(1, "the quick brown fox jumps over a lazy dog", "en", "s", 1), (3, "pack my box with five dozen jugs", "en", "s", 1)]
    clean = [(10, "mnemosyne askew", None, "s", 1), (11, "Gypsum hydrant", None, "s", 1), (12, "Uhrwerk, Bauamt", None, "s", 1), (None, "ein Igel", None, None, None)]
    other = [(20, "привет как дела сегодня утром", None, "s", 1), (21, "これは日本語の文章です", None, "s", 1), (22, "안녕하세요 오늘 날씨가", None, "s", 1), (23, "12 - 34", None, "s", 1), (24, None, "en", "s", 1)]
    kept = {r.text for r in P.language_id(spark, spark.createDataFrame(rows + clean + other, DOCS), "").collect()}
    assert kept == {r[1] for r in rows + clean}
