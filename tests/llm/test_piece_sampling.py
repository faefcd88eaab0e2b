import itertools
import math
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cloakwork.llm import piece_sampling as P
from tests.llm.helpers import documents


@pytest.fixture(scope="module")
def lattice():
    return P.Lattice(P.read_vocabulary(), 0.5)


TEXTS = [None, "", " ", "  a  b ", "▁x ▁", "é\n\t日本語𝄞\x00\x01", "x" * 3000, "Hello world", "Hello world", "a" * 64, "a" * 65]


def test_round_trip_and_seeds(spark):
    docs = documents(spark, TEXTS, [(7, TEXTS[7]), (None, TEXTS[7]), (None, TEXTS[7])])
    got = P.decode(P.encode(docs.withColumn("decoded0", F.lit(1)).repartition(3)), text="decoded").collect()
    assert all(r.text == r.decoded for r in got) and len(got) == len(TEXTS) + 3
    ids = [tuple(r.ids) for r in got if r.doc_id == 7]
    assert ids[0] == ids[1] and [r.ids for r in got if r.text is None] == [None] and [r.ids for r in got if r.text == ""] == [[]]
    other = {r.doc_id: r.ids for r in P.encode(docs.coalesce(1)).collect() if r.doc_id is not None}
    assert all(other[r.doc_id] == r.ids for r in got if r.doc_id is not None)
    d = P.digest(docs).collect()
    assert all(r.lossless for r in d) and len(d) == len(got)
    assert P.encode(docs.limit(0)).count() == 0


def test_decodes_as_the_library_does(lattice):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=P.MODEL)
    for t in ["Hello  world\n foo", "né à 日本", "tabs\tand more"]:
        assert model.decode(lattice.encode([t], [3])[0].tolist()) == t


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=80), st.integers(0, 2**64 - 1))
def test_any_text_is_lossless(text, seed):
    own = _cached()
    text = text.encode("utf-8", "ignore").decode()
    ids = own.encode(["padding text", text], [1, seed])[1]
    assert (own.decode(ids) if text else "") == text


_KEPT: list = []


def _cached():
    if not _KEPT:
        _KEPT.append(P.Lattice(P.read_vocabulary(), 0.5))
    return _KEPT[0]


@pytest.mark.parametrize("long", [False, True])
def test_distribution_is_that_of_the_lattice(lattice, long, monkeypatch):
    unit = " theing"
    own = {p: i for i, p in enumerate(lattice.v.pieces) if p}
    weights = {}
    for cuts in itertools.product([0, 1], repeat=len(unit) - 1):
        at = [0, *[i + 1 for i, c in enumerate(cuts) if c], len(unit)]
        pieces = [unit[a:b] for a, b in zip(at, at[1:])]
        if all(p in own for p in pieces):
            weights[tuple(own[p] for p in pieces)] = math.exp(0.5 * sum(lattice.v.log_p[own[p]] for p in pieces))
    total = sum(weights.values())
    n = 30_000
    if long:
        n = 4000
        drawn = Counter(tuple(lattice.long(unit, P.row_seed(i, 0), 0)) for i in range(n))
    else:
        drawn = Counter(tuple(x.tolist()) for x in lattice.encode(["theing"] * n, [P.row_seed(i, 0) for i in range(n)]))
    assert set(drawn) <= set(weights)
    for k, w in weights.items():
        p = w / total
        assert abs(drawn[k] / n - p) < 5 * math.sqrt(p * (1 - p) / n) + 1e-3


def test_unigram_scores_are_used_as_they_are():
    v = P.Vocabulary([None, "a", "b", "ab", " "], [0.0, -1.5, -2.5, -0.5, -1.0], [0] * 256, "x")
    own = P.Lattice(v, 1.0)
    got = Counter(tuple(x.tolist()) for x in own.encode(["ab"] * 20_000, [P.row_seed(i, 1) for i in range(20_000)]))
    p = math.exp(-0.5) / (math.exp(-0.5) + math.exp(-4.0))
    assert abs(got[(4, 3)] / 20_000 - p) < 0.01
    assert np.array_equal(own.encode(["ab"], [5])[0], own.encode(["zz", "ab"][1:], [5])[0])


def test_empty_table(spark):
    none = documents(spark, [])
    assert P.encode(none).columns == [*none.columns, "ids"] and P.encode(none).count() == 0
    assert P.decode(P.encode(none)).count() == 0 and P.digest(none).count() == 0
