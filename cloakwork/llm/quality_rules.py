"""Quality rules as weak supervision.

Each rule votes good (1), bad (-1) or abstains (0): it looks at one measure, votes good inside a band, bad well outside, and
abstains between. All documents' votes are counted by pattern (at most 3^rules patterns, whatever the corpus), and
expectation-maximisation on these counts estimates how often each rule votes each way for good documents and for each kind
of bad ones. The kinds are latent too, one begun at each rule: faults of text come in kinds that few rules see each, and with
one class for all of them the model finds the commonest kind and takes the others for good. The share of each class is
estimated with the rates. A document's posterior probability of being good follows from its pattern; ``kept`` is posterior >=
``least``, in place of passing all rules: a bad vote of a rule that often errs is outvoted, several abstentions can tell
against a document. Documents that fail the base rules (too few words, or mostly repeated three-word windows) are never kept.

Labels take no part in the fit. Counting needs one pass over the texts; its narrow result is written to the shared folder
once, since both the pattern counts and the verdicts read it. Nothing is shuffled but pattern counts. The start, the number
of rounds and the smoothing are fixed, so the same corpus gives the same model at any partitioning.

Defined results: null and empty texts have no words, fail the base rule and are not kept; null and repeated doc_ids are
judged row by row; an empty table gives no rows; a posterior of exactly ``least`` is kept. A rule without any vote stays near
its starting rates. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakwork.llm.common import small_batches, written

SYMBOLS = re.compile(rb"[#*$%&|<>]")
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits", "n_ended"]


def count(text: str | None) -> tuple[int, ...]:
    """Whole-text counts of one document, in the order of COUNTS.

    Words are runs of anything but ASCII white space, which is how bytes.split cuts UTF-8.
    """
    body = (text or "").encode("utf-8", "surrogatepass")
    words = body.split()
    n = len(words)
    if not n:
        return (0,) * len(COUNTS)
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    repeated = 0
    if n >= 3:
        base = len(number)
        pairs = np.unique(ids[:-2] * base + ids[1:-1], return_inverse=True)[1]  # pairs by number, so that triples fit 64 bits
        _, at, times = np.unique(pairs * base + ids[2:], return_inverse=True, return_counts=True)
        again = times[at] > 1
        hit = np.zeros(n, bool)
        for k in range(3):
            hit[k : n - 2 + k] |= again
        repeated = int(hit.sum())
    lines = [x for x in body.split(b"\n") if x.strip()]
    joined = b"".join(words)
    points = np.frombuffer(joined, np.uint8)
    return (
        n,
        int(((points & 0xC0) != 0x80).sum()),
        len(SYMBOLS.findall(body)),
        len(lines) - len(set(lines)),
        repeated,
        len(lines),
        int(((points >= 65) & (points <= 90)).sum()),
        int(((points >= 48) & (points <= 57)).sum()),
        sum(x.rstrip()[-1:] in b'.!?:"' for x in lines),
    )


def counted(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id and the counts, one row per row of docs."""
    small_batches(docs.sparkSession)
    sent = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = sent.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [count(x.as_py()) for x in batch.column(1)]
            columns = [pa.array(c, pa.int64()) for c in zip(*rows)] or [pa.array([], pa.int64()) for _ in COUNTS]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", *COUNTS])

    return sent.mapInArrow(run, ", ".join([f"doc_id {kind}", *(f"{c} bigint" for c in COUNTS)]))


def rules() -> dict[str, Column]:
    """The votes, from the counts."""
    c = {k: F.col(k) for k in COUNTS}
    words, chars, lines = F.greatest(c["n_words"], F.lit(1)), F.greatest(c["word_chars"], F.lit(1)), F.greatest(c["n_lines"], F.lit(1))
    vote = lambda good, bad: F.when(bad, -1).when(good, 1).otherwise(0)
    return {
        "length": vote(c["n_words"] >= 100, c["n_words"] < 50),
        "word_size": vote((chars >= 4 * words) & (chars <= 7 * words), (chars < 3 * words) | (chars > 10 * words)),
        "symbols": vote(c["n_symbols"] * 50 <= c["n_words"], c["n_symbols"] * 10 > c["n_words"]),
        "repeated_lines": vote(c["n_dup_lines"] * 10 <= lines, c["n_dup_lines"] * 10 > 3 * lines),
        "repeated_words": vote(c["n_repeat_words"] * 4 <= words, c["n_repeat_words"] * 5 > 2 * words),
        "capitals": vote((c["n_upper"] * 500 >= chars) & (c["n_upper"] * 20 <= chars), c["n_upper"] * 10 > 3 * chars),
        "digits": vote(c["n_digits"] * 20 <= chars, c["n_digits"] * 20 > 3 * chars),
        "line_ends": vote(c["n_ended"] * 5 >= 4 * lines, c["n_ended"] * 2 < lines),
    }


#: Rates of the votes -1, 0 and 1 before any document is seen: of good documents; of a bad kind, for the rule that it
#: begins at and for the others. They weigh as much as PSEUDO documents of each class.
START_GOOD, START_OWN, START_OTHER = (0.05, 0.15, 0.8), (0.8, 0.15, 0.05), (0.2, 0.3, 0.5)
PSEUDO, ROUNDS = 10, 50


@dataclass
class Model:
    """share[m]: of class m among documents; class 0 is good, class k + 1 the kind begun at rule k.

    rate[m, k, v + 1]: how often rule k votes v on documents of class m.
    """

    share: np.ndarray
    rate: np.ndarray


def start(n_rules: int) -> Model:
    rate = np.empty((n_rules + 1, n_rules, 3))
    rate[:] = START_OTHER
    rate[0] = START_GOOD
    for k in range(n_rules):
        rate[k + 1, k] = START_OWN
    return Model(np.array([0.5] + [0.5 / n_rules] * n_rules), rate)


def classes(m: Model, patterns: np.ndarray) -> np.ndarray:
    """The posterior of each class for each pattern; rules are independent given the class."""
    places = np.arange(patterns.shape[1])
    logs = np.log(m.share) + np.log(m.rate[:, places, patterns + 1]).sum(axis=2).T
    odds = np.exp(logs - logs.max(axis=1, keepdims=True))
    return odds / odds.sum(axis=1, keepdims=True)


def fit(patterns: np.ndarray, counts: np.ndarray, rounds: int = ROUNDS) -> Model:
    """Expectation-maximisation on counts of vote patterns. Rates are smoothed, so none reaches 0 or 1."""
    first = start(patterns.shape[1])
    m = first
    cast = np.stack([patterns == v for v in (-1, 0, 1)], axis=2).astype(float)
    for _ in range(rounds if len(counts) else 0):
        weights = classes(m, patterns) * counts[:, None]
        total = weights.sum(axis=0)
        m = Model((total + PSEUDO * first.share) / (counts.sum() + PSEUDO), (np.einsum("pm,pkv->mkv", weights, cast) + PSEUDO * first.rate) / (total[:, None, None] + PSEUDO))
    return m


def posterior(m: Model, patterns: np.ndarray) -> np.ndarray:
    """Of being good."""
    return classes(m, patterns)[:, 0]


def _posterior(m: Model, votes: list[Column]) -> Column:
    """The same as an expression: 1 / (1 + the odds of each bad kind against good)."""
    odds = F.lit(1.0)
    for kind in range(1, len(m.share)):
        logs = F.lit(float(np.log(m.share[kind] / m.share[0])))
        for k, vote in enumerate(votes):
            bad, none, good = (float(x) for x in np.log(m.rate[kind, k] / m.rate[0, k]))
            logs = logs + F.when(vote == 1, good).when(vote == 0, none).otherwise(bad)
        odds = odds + F.exp(logs)
    return 1 / odds


def judge(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", least: float = 0.5) -> DataFrame:
    """doc_id, the counts, base_failed, posterior and kept, one row per row of docs."""
    spark = docs.sparkSession
    votes = rules()
    table = written(counted(docs, text, doc_id), "quality-counts")
    voted = table.withColumns({f"v_{k}": v for k, v in votes.items()})
    names = [f"v_{k}" for k in votes]
    rows = voted.groupBy(*names).count().collect()  # at most 3^rules rows
    patterns = np.array([[r[n] for n in names] for r in rows], np.int64).reshape(len(rows), len(names))
    model = fit(patterns, np.array([r["count"] for r in rows], np.float64))
    failed = (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    out = voted.select("doc_id", *COUNTS, failed.alias("base_failed"), _posterior(model, [F.col(n) for n in names]).alias("posterior"))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= least))


def keep_good(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", least: float = 0.5) -> DataFrame:
    """The rows of docs whose doc_id is kept by ``judge`` in all its rows."""
    bad = judge(docs, text, doc_id, least).where(~F.col("kept")).select(F.col("doc_id").alias("__id")).distinct()
    return docs.join(bad, F.col(doc_id).eqNullSafe(F.col("__id")), "left_anti")
