import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from cloakwork.llm import quality_rules as Q
from tests.llm.helpers import documents

GOOD = "This is a line of plain words that ends as it should.\nAnd here is another one, with nothing odd in it at all.\n"
TEXTS = [None, "", " \t\n\x0b", "one two", "a b c a b c a b c", "x\nx\n\n x\ny", "é# $ü*", "\x1cword\x85other", "tail words " * 60, (GOOD + "Third sentence here {}.\n") * 6, "### $$$ word " * 60]


def brute(text):
    t = text or ""
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", t) if x]
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    triples = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    often = Counter(triples)
    hit = {i + k for i, x in enumerate(triples) if often[x] > 1 for k in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(hit)


def test_counts_and_base_rule_against_brute_force(spark):
    docs = documents(spark, TEXTS, [(4, TEXTS[4]), (None, GOOD)])
    got = Q.judge(docs.withColumn("kept", F.lit("clash"))).collect()
    want = [(str(r.doc_id), *brute(r.text)) for r in docs.collect()]
    assert sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == sorted(want)
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.kept and r.base_failed)


def test_good_is_kept_and_soup_is_not(spark):
    texts = [" ".join(f"w{i}{j}" for j in range(12)) + ".\n" + "\n".join(" ".join(f"v{i}{k}{j}" for j in range(11)) + "." for k in range(8)) for i in range(40)]
    soup = [" ".join(f"w{i}{j}###" for j in range(80)) for i in range(6)]
    texts = [re.sub(r"\d", lambda m: "abcdefghij"[int(m[0])], t) for t in texts + soup]
    got = {r.doc_id: r for r in Q.judge(documents(spark, texts)).collect()}
    assert all(got[i].kept for i in range(40)) and not any(got[i].kept for i in range(40, 46))
    assert Q.judge(documents(spark, texts).limit(0)).count() == 0
    assert Q.keep_good(documents(spark, texts)).count() == 40


def test_posterior_by_hand():
    patterns, counts = np.array([[1, -1, 0], [0, 0, 0], [-1, -1, 1]]), np.array([50.0, 10.0, 5.0])
    m = Q.fit(patterns, counts)
    assert np.allclose(m.share.sum(), 1) and np.allclose(m.rate.sum(axis=2), 1) and m.rate.min() > 0.001 and m.rate.max() < 0.999
    for p, found in zip(patterns, Q.posterior(m, patterns)):
        each = [m.share[c] * np.prod([m.rate[c, k, v + 1] for k, v in enumerate(p)]) for c in range(4)]
        assert np.isclose(found, each[0] / sum(each))


def planted(n=40_000, seed=5):
    """Votes under the registered rules: good documents, and two kinds of bad ones that few rules see; one rule errs with one in ten."""
    names = list(Q.rules())
    k = len(names)
    rate = np.tile([0.02, 0.08, 0.9], (3, k, 1))
    rate[0, names.index("repeated_lines")] = [0.1, 0.2, 0.7]
    rate[1, names.index("symbols")] = [0.9, 0.05, 0.05]
    rate[2, names.index("capitals")] = [0.85, 0.1, 0.05]
    rate[2, names.index("repeated_words")] = [0.8, 0.1, 0.1]
    rng = np.random.default_rng(seed)
    truth = rng.choice(3, n, p=[0.8, 0.12, 0.08])
    draws = rng.random((n, k))
    votes = (draws[:, :, None] >= np.cumsum(rate, axis=2)[truth][:, :, :2]).sum(axis=2) - 1
    return names, rate, truth, votes


def test_planted_accuracies_are_found_under_the_registered_rules():
    names, rate, truth, votes = planted()
    patterns, at, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    m = Q.fit(patterns, counts.astype(float))
    assert np.isclose(m.share[0], 0.8, atol=0.05) and np.allclose(m.rate[0], rate[0], atol=0.05)
    assert np.allclose(m.rate[1 + names.index("symbols")], rate[1], atol=0.1)
    good = Q.posterior(m, patterns)[at.ravel()] >= 0.5
    best = Q.posterior(Q.Model(np.array([0.8, 0.12, 0.08]), rate), patterns)[at.ravel()] >= 0.5  # by the planted rates
    assert (good == (truth == 0)).mean() > (best == (truth == 0)).mean() - 0.02
    # The posterior isn't all-must-pass: the bad vote of a rule that often errs is outvoted, that of a sure one isn't.
    one = lambda name, v: np.array([[v if r == name else 1 for r in names]])
    assert Q.posterior(m, one("repeated_lines", -1))[0] >= 0.5 and Q.posterior(m, one("symbols", -1))[0] < 0.5


def test_the_expression_equals_the_model(spark):
    rng = np.random.default_rng(3)
    words = ["".join(chr(97 + c) for c in rng.integers(0, 26, 5)) for _ in range(3000)]
    line = lambda: ("The " + " ".join(rng.choice(words, 11)) + ".").replace("  ", " ")
    bodies = [[line() for _ in range(12)] for _ in range(60)]
    texts = ["\n".join(b + b[:2] * (i % 3 == 0) + [b[0]] * (6 * (i % 20 == 0))) for i, b in enumerate(bodies)]
    texts += [t.replace(" ", " # ") for t in texts[1:11]] + ["\n".join(b).upper() for b in bodies[:5]] + texts[:2]
    docs = documents(spark, texts)
    voted = Q.counted(docs).select("doc_id", *[v.alias(k) for k, v in Q.rules().items()]).toPandas().set_index("doc_id").sort_index()
    patterns, at, counts = np.unique(voted.to_numpy(), axis=0, return_inverse=True, return_counts=True)
    want = Q.posterior(Q.fit(patterns, counts.astype(float)), patterns)[at.ravel()]
    got = Q.judge(docs).toPandas().set_index("doc_id").sort_index()
    assert np.allclose(got["posterior"], want) and (got["kept"] == ~got["base_failed"] & (want >= 0.5)).all()
    assert got["kept"][:60].sum() >= 55 and (got["posterior"][60:70] < got["posterior"][1]).all()


def test_empty_table(spark):
    out = Q.judge(documents(spark, []))
    assert {"doc_id", "n_words", "base_failed", "kept", "posterior"} <= set(out.columns) and out.count() == 0
