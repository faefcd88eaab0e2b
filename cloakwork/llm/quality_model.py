"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

A document is a sparse vector: its distinct lower-cased words, hashed into ``words`` places and weighted so that they have length 1
together, and one place for each statistic, chosen by the interval that its value falls into. Statistics are those of the text's
structure (words, lines, repeats, kinds of characters) and numeric columns given as metadata (by default n_chars, if it is there). Every place has a
weight and a vector of ``rank`` numbers; a document's logit is the bias, the weighted sum, and the products of all pairs of its
places' vectors. With the sum-of-squares identity these pairs take linear time: half of (sum of v x)^2 - sum of (v x)^2, added up
over the ranks.

Intervals and weights are learned in one task from a bounded sample of labelled rows: at most about ``most_rows`` of them, taken by a hash of the id
whose share follows from the exact number of labelled rows. The task gets their statistics and places, not their texts. All else
covers all rows: whole texts are scored batch by batch, with no shuffle.

Defined results: a null text counts as an empty one, which has statistics but no words and gets a score like others. A row without a label, or
with a null id, is scored and not learned from; an id with several labels counts with their mean, rounded up. Without labelled rows, or with one label only,
the score is that label's share smoothed by one of each, 0.5 without any. Repeated rows are scored each for itself and learned from once. A null,
infinite or missing metadata value has an interval of its own. Other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakwork.llm.common import small_batches, worker_cache

METADATA = ("n_chars",)
#: Kinds of ASCII characters whose shares are statistics.
KINDS = {"upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": "0123456789", "symbol": "#*$%&|<>{}[]\\^~_@=+/", "stop": ".!?", "mark": ",;:-'\"()", "space": " \t\r\x0b\x0c", "line": "\n"}
STATISTICS = ("characters", "words", "word_length", "distinct", "lines", "line_length", "same_lines", "same_triples", "commonest", "ended", *KINDS, "beyond")


def statistics(text: str, words: list[str]) -> list[float]:
    """The values of STATISTICS: counts, means and shares; those of an empty text are 0."""

    def kinds() -> np.ndarray:
        found = np.zeros(128, np.int64)
        for k, listed in enumerate(KINDS.values()):
            found[[ord(c) for c in listed]] = k + 1
        return found

    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    plain = points[points < 128]
    per_kind = np.bincount(worker_cache(("quality kinds",), kinds)[plain], minlength=len(KINDS) + 1)[1:]
    lines = [x.strip() for x in text.split("\n")]
    lines = [x for x in lines if x]
    n, c, m = max(1, len(words)), max(1, len(text)), max(1, len(lines))
    triples = list(zip(words, words[1:], words[2:]))
    counted: dict[str, int] = {}
    for w in words:
        counted[w] = counted.get(w, 0) + 1
    return [
        len(text), len(words), sum(map(len, words)) / n, len(counted) / n, len(lines), len(words) / m, 1 - len(set(lines)) / m if lines else 0.0,
        1 - len(set(triples)) / len(triples) if triples else 0.0, max(counted.values(), default=0) / n, sum(x[-1] in ".!?:\"" for x in lines) / m, *(per_kind / c).tolist(), (len(points) - len(plain)) / c,
    ]


@dataclass
class Machine:
    """edges: for each statistic the ends of its intervals. Places 0 to words - 1 are those of words."""

    words: int
    edges: list[np.ndarray]
    bias: float
    weights: np.ndarray
    vectors: np.ndarray

    def logits(self, at: np.ndarray, x: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Of documents whose places and values stand one after the other; starts: where each begins, none is empty."""
        vx = self.vectors[at] * x[:, None]
        pairs = np.square(np.add.reduceat(vx, starts)) - np.add.reduceat(np.square(vx), starts)
        return self.bias + np.add.reduceat(self.weights[at] * x, starts) + 0.5 * pairs.sum(1)


def intervals(edges: list[np.ndarray], words: int) -> np.ndarray:
    """The first place of each statistic, and the number of places: one an interval, and one for a value that is missing."""
    return words + np.cumsum([0, *(len(e) + 2 for e in edges)])


def places(words_at: list[list[int]], values: np.ndarray, edges: list[np.ndarray], words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places, values and starts of documents."""
    base = intervals(edges, words)
    cells = np.stack([base[k] + np.where(np.isfinite(values[:, k]), np.searchsorted(e, values[:, k], side="right"), len(e) + 1) for k, e in enumerate(edges)], 1)
    sizes = np.array([len(w) for w in words_at]) + len(edges)
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1])).astype(np.int64)
    at = np.concatenate([y for w, c in zip(words_at, cells) for y in (np.asarray(w, np.int64), c)])
    x = np.concatenate([y for w in words_at for y in (np.full(len(w), 1 / max(1, len(w)) ** 0.5), np.ones(len(edges)))])
    return at, x, starts


def train(words_at: list[list[int]], values: np.ndarray, y: np.ndarray, words: int, rank: int, cells: int, rounds: int, seed: int) -> Machine:
    """Minibatches of 128 in an order drawn from the seed; steps by Adam on logistic loss with weight decay."""
    edges = []
    for column in values.T:
        told = column[np.isfinite(column)]
        edges.append(np.unique(np.quantile(told, np.linspace(0, 1, cells + 1)[1:-1])) if len(told) else np.zeros(0))
    size = int(intervals(edges, words)[-1])
    rnd = np.random.default_rng(seed)
    share = (y.sum() + 1) / (len(y) + 2)
    m = Machine(words, edges, float(np.log(share / (1 - share))), np.zeros(size), rnd.normal(0, 0.05, (size, rank)))
    if not 0 < y.sum() < len(y):
        m.vectors[:] = 0
        return m
    both = np.concatenate([m.weights[:, None], m.vectors], 1)
    first, second, bias, step = np.zeros_like(both), np.zeros_like(both), np.zeros(2), 0
    for _ in range(rounds):
        order = rnd.permutation(len(y))
        for b in range(0, len(y), 128):
            mine = order[b : b + 128]
            at, x, starts = places([words_at[i] for i in mine], values[mine], edges, words)
            owner = np.repeat(np.arange(len(mine)), np.diff([*starts, len(at)]))
            m.weights, m.vectors = both[:, 0], both[:, 1:]
            p = 1 / (1 + np.exp(-np.clip(m.logits(at, x, starts), -30, 30)))
            loss = (p - y[mine]) / len(mine)
            vx = m.vectors[at] * x[:, None]
            sums = np.add.reduceat(vx, starts)[owner]
            slope = (loss[owner] * x)[:, None] * np.concatenate([np.ones((len(at), 1)), sums - vx], 1)
            touched, back = np.unique(at, return_inverse=True)
            g = 1e-4 * both[touched]
            for k in range(both.shape[1]):
                g[:, k] += np.bincount(back, slope[:, k], len(touched))
            step += 1
            first[touched] = 0.9 * first[touched] + 0.1 * g
            second[touched] = 0.99 * second[touched] + 0.01 * g * g
            both[touched] -= 0.02 * (first[touched] / (1 - 0.9**step)) / (np.sqrt(second[touched] / (1 - 0.99**step)) + 1e-8)
            bias = 0.9 * bias + np.array([0.1, 0.0]) * loss.sum()
            m.bias -= 0.02 * bias[0]
    m.weights, m.vectors = both[:, 0].copy(), both[:, 1:].copy()
    return m


class Describer:
    """Places of the distinct words, and statistics with metadata, of texts; keeps the places of words that it has met."""

    def __init__(self, words: int):
        self.words, self.known = words, {}

    def describe(self, bodies: list, *metadata: list) -> tuple[list[list[int]], list[list[float]]]:
        listed, values = [], []
        for body, *more in zip(bodies, *metadata):
            found = (body or "").split()
            values.append([*statistics(body or "", found), *(float("nan") if v is None else float(v) for v in more)])
            if len(self.known) > 500_000:
                self.known.clear()
            for w in (distinct := {w.lower() for w in found}):
                if w not in self.known:
                    self.known[w] = zlib.crc32(w.encode("utf-8", "surrogatepass")) % self.words
            listed.append(sorted({self.known[w] for w in distinct}))
        return listed, values


def _prepared(docs: DataFrame, key: str, text: str, metadata: tuple[str, ...]) -> tuple[DataFrame, list[str]]:
    names = [f"__m{i}" for i in range(len([c for c in metadata if c in docs.columns]))]
    there = [F.col(c).cast("double").alias(n) for c, n in zip([c for c in metadata if c in docs.columns], names)]
    return docs.select(F.col(key).alias("__key"), F.col(text).alias("__text"), *there), names


def fit(docs: DataFrame, labels: DataFrame, usable: Column | None = None, key: str = "doc_id", text: str = "text", label: str = "quality", metadata: tuple[str, ...] = METADATA,
        most_rows: int = 10_000, words: int = 4096, rank: int = 6, cells: int = 12, rounds: int = 12, seed: int = 1) -> Machine:
    """Learns from documents whose id has a label; usable: a condition on the id column that they have to meet."""
    told = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull() & (F.lit(True) if usable is None else usable)).groupBy(F.col(key).alias("__id")).agg((F.avg(label) >= 0.5).cast("int").alias("__y"))
    span = 1 << 20
    share = min(span, -(-most_rows * span // max(1, told.count())))
    taken = told.where(F.pmod(F.xxhash64(F.col("__id").cast("string")), F.lit(span)) < share)
    ready, names = _prepared(docs, key, text, metadata)
    once = ready.join(taken, F.col("__key") == F.col("__id")).groupBy("__id", "__y").agg(F.min(F.struct(F.coalesce("__text", F.lit("")).alias("__text"), *names)).alias("s"))
    small_batches(docs.sparkSession)

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = Describer(words)
        for batch in batches:
            listed, values = d.describe(*(c.to_pylist() for c in batch.columns[2:]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(listed, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float64()))], names=["__id", "__y", "__words", "__values"])

    rows = once.select(F.col("__id").cast("string"), "__y", "s.*").mapInArrow(described, "__id string, __y int, __words array<int>, __values array<double>")

    def learned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((r for b in batches for r in zip(*(c.to_pylist() for c in b.columns))), key=lambda r: r[0])
        if rows:
            m = train([r[2] for r in rows], np.array([r[3] for r in rows], float), np.array([r[1] for r in rows], float), words, rank, cells, rounds, seed)
            yield pa.RecordBatch.from_pydict({"bias": [m.bias], "weights": [m.weights.tolist()], "vectors": [m.vectors.ravel().tolist()], "edges": [[e.tolist() for e in m.edges]]})

    # The sample is bounded, and one task learns from it.
    found = rows.repartition(1).mapInArrow(learned, "bias double, weights array<double>, vectors array<double>, edges array<array<double>>").collect()
    if not found:
        edges = [np.zeros(0)] * (len(STATISTICS) + len(names))
        size = int(intervals(edges, words)[-1])
        return Machine(words, edges, 0.0, np.zeros(size), np.zeros((size, rank)))
    m = found[0]
    return Machine(words, [np.array(e, float) for e in m.edges], m.bias, np.array(m.weights), np.array(m.vectors).reshape(-1, rank))


def score(docs: DataFrame, machine: Machine, key: str = "doc_id", text: str = "text", metadata: tuple[str, ...] = METADATA) -> DataFrame:
    """The key and ``score``, the probability of label 1. Narrow: no shuffle."""
    ready, _ = _prepared(docs, key, text, metadata)
    small_batches(docs.sparkSession)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = Describer(machine.words)
        for batch in batches:
            if batch.num_rows:
                listed, values = d.describe(*(c.to_pylist() for c in batch.columns[1:]))
                at, x, starts = places(listed, np.array(values, float), machine.edges, machine.words)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(machine.logits(at, x, starts), -30, 30))))], names=[key, "score"])

    return ready.mapInArrow(scored, f"`{key}` {docs.schema[key].dataType.simpleString()}, score double")


def held_out(doc_id: Column) -> Column:
    """Rows whose labels aren't learned from: the CRC-32 of doc_id as text is divisible by 5."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def judge(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **parameters) -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""
    machine = fit(docs, labels, usable=~held_out(F.col("doc_id")), **parameters)
    return score(docs, machine).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
