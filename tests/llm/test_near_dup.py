import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from cloakwork.llm import near_dup as N
from tests.llm.helpers import documents


def shingles(text, k):
    w = (text or "").encode().lower().split()
    return frozenset([tuple(w)] if w and len(w) < k else (tuple(w[i : i + k]) for i in range(len(w) - k + 1)))


def brute(rows, k, percent):
    sets = [(i, shingles(t, k)) for i, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                parent[find(a)] = find(b)
    groups = defaultdict(list)
    for a in range(len(sets)):
        groups[find(a)].append(sets[a][0])
    out = []
    for a, (i, s) in enumerate(sets):
        ids = [x for x in groups[find(a)] if x is not None]
        c = min(ids) if ids else None
        out.append((i, len(s), c, i == c))
    return out


def corpus():
    r = random.Random(4)
    word = lambda: r.choice("abcdefghij") + str(r.randrange(400))
    texts = [None, "", "  \n", "one", "One", "two words", "two  WORDS", "é É", "x " * 3000]
    for size, copies, most in ((150, 60, 12), (40, 20, 4), (400, 10, 30)):
        start = [word() for _ in range(size)]
        for _ in range(copies):
            w = list(start)
            for _ in range(r.randrange(most)):
                w[r.randrange(size)] = word()
            texts.append(" ".join(w))
        for _ in range(3):
            texts.append(" ".join(start).upper())
    # a drift: each text a little off the one before
    w = [word() for _ in range(80)]
    for i in range(25):
        w = list(w)
        w[r.randrange(80)] = word()
        texts.append(" ".join(w))
    texts += [" ".join(word() for _ in range(60)) for _ in range(30)]
    r.shuffle(texts)
    return list(enumerate(texts, 100))


@pytest.mark.parametrize(("k", "percent"), [(3, 85), (5, 80)])
def test_against_brute_force(spark, k, percent):
    rows = corpus()
    rows += [rows[5], (None, rows[9][1]), (None, "a text of its own with some words"), (rows[7][0], "the same id but another text here")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("cls", F.lit("clash")).withColumn("kept", F.lit(1))
    got = N.components(docs.repartition(5), k, percent).select("doc_id", "n_shingles", "component_id", "kept").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, brute(rows, k, percent)))
    left = N.deduplicate(docs, k, percent)
    assert left.columns == docs.columns
    assert sorted(str(r.doc_id) for r in left.collect()) == sorted(str(i) for i, _, _, kept in brute(rows, k, percent) if kept)


def test_texts_of_one_template_form_few_pairs(spark, monkeypatch):
    """Nearly all pairs share most shingles and none of these tells anything; what a text lacks of the template does."""
    r = random.Random(8)
    rows = []
    for i in range(400):
        w = [f"w{k}" for k in range(100)]
        for _ in range(2):
            w[r.randrange(100)] = f"x{r.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    formed, across = [], N._across

    def counted(*arguments):
        pairs = across(*arguments)
        formed.append(pairs.select("x", "y").distinct().count())
        return pairs

    monkeypatch.setattr(N, "_across", counted)
    monkeypatch.setattr(N, "LARGE", 4)  # so that groups of this small table are ordered anew
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = N.components(docs, 3, 85).select("doc_id", "n_shingles", "component_id", "kept").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, brute(rows, 3, 85)))
    assert len(formed) > 1 and formed[-1] < 25 * len(rows)  # of 79,800 pairs; the outermost call ends last


def test_empty(spark):
    assert N.components(documents(spark, ["a"]).limit(0)).count() == 0
    assert [tuple(r) for r in N.components(documents(spark, [None])).select("n_shingles", "component_id", "kept").collect()] == [(0, 0, True)]


def test_connected_settles_on_chains(spark):
    n = 40
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(100, 101), (7, 7)], "x int, y int")
    got = {r.v: r.root for r in N.connected(edges).collect()}
    assert all(got[i] == 0 for i in range(n + 1)) and got[100] == got[101] == 100 and len(got) == n + 3


def test_bands_miss_few():
    for percent in (80, 85, 95):
        assert (1 - (percent / 100) ** N.ROWS) ** N.bands_for(percent) < 1e-7


def test_one_row_of_repeated_ones_stays_in_the_pipeline(spark):
    import corpus_pipeline as P

    body = "a text of its own with some words"
    rows = [(1, "x " * 9), (1, "x " * 9), (None, body), (None, body), (None, body), (None, "another of them which nothing else is like"), (2, None), (2, None), (2, ""), (None, None), (None, None), (3, None)]
    left = P.near_dup(spark, documents(spark, rows).repartition(3), "").collect()
    assert sorted(repr((r.doc_id, r.text)) for r in left) == sorted(map(repr, set(rows)))
