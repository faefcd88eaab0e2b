"""Language identification with hyperdimensional profiles.

Each letter owns a random vector of D signs, drawn from its code point. An n-gram of letters is bound by multiplying the
vectors of its letters, each permuted (rolled) by its place; a document bundles (adds) the vectors of its n-grams, and a
language prototype bundles those of its training documents. A document gets the language with the largest cosine.

Binding and bundling are linear in the counts of n-grams, so <document, prototype> is the sum over the document's n-grams
of count * <n-gram vector, prototype>: every worker computes that product once for an n-gram and keeps it, and never
builds the D numbers of a document. The document's length in the cosine uses that vectors of different n-grams are
orthogonal in expectation: |document|^2 = D * sum(count^2).

Defined results: null text or text without a letter gives ``und`` and score 0, as does every text if nothing could be
learned (empty table, no labels). Null doc_id is predicted too, is never held out and never learned from. Repeated rows
are predicted each for itself. Ties between languages go to the first in alphabetical order. Columns other than those
named in the arguments are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakwork.llm.common import small_batches, table_schema, worker_cache, written

UNKNOWN = "und"
SEED = 0x5EED
DIM = 2048


def chance(dim: int = DIM, sigmas: float = 2.0) -> float:
    """A cosine that unlike texts seldom reach: products of unrelated vectors of dim signs spread by 1 / sqrt(dim)."""
    return sigmas / dim**0.5


@dataclass
class Profiles:
    """A block of language names in alphabetical order and their prototypes, one unit vector a row."""

    languages: list[str]
    vectors: np.ndarray
    n: int


def letter_table() -> np.ndarray:
    """For each code point: the lower-case letter it counts as, or 0 if it is no letter."""

    def make() -> np.ndarray:
        found = np.zeros(0x110000, np.uint32)
        for c in range(0x110000):
            if (ch := chr(c)).isalpha():
                found[c] = ord(ch.lower()[0])
        return found

    return worker_cache(("letters",), make)


def letters_of(text: str) -> np.ndarray:
    """Lower-case letters with single zeros where other characters stood, and a zero at both ends."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    found = np.concatenate(([0], letter_table()[points], [0])).astype(np.uint64)
    return found[~((found == 0) & (np.concatenate(([1], found[:-1])) == 0))]


def grams_of(text: str, n: int = 3) -> np.ndarray:
    """The n-grams as numbers of 21 bits a letter; those without a letter in a row of two are left out, as are single blanks."""
    s = letters_of(text)
    if n == 1:
        return s[s != 0]
    if len(s) < n:
        return np.zeros(0, np.uint64)
    keys = np.zeros(len(s) - n + 1, np.uint64)
    for k in range(n):
        keys = (keys << np.uint64(21)) | s[k : len(s) - n + 1 + k]
    return keys


def letter_vector(point: int, dim: int) -> np.ndarray:
    return np.where(np.random.Generator(np.random.PCG64([SEED, point])).random(dim) < 0.5, -1, 1).astype(np.int8)


def gram_vectors(keys: np.ndarray, dim: int, n: int, letters: dict[int, np.ndarray]) -> np.ndarray:
    """Binds: the product of the letters' vectors, each rolled by its place."""
    bound = np.ones((len(keys), dim), np.int8)
    for k in range(n):
        points = ((keys >> np.uint64(21 * (n - 1 - k))) & np.uint64(0x1FFFFF)).tolist()
        for p in set(points) - letters.keys():
            letters[p] = letter_vector(p, dim)
        bound *= np.stack([np.roll(letters[p], n - 1 - k) for p in points])
    return bound


def bundle(keys: np.ndarray, counts: np.ndarray, dim: int, n: int, letters: dict) -> np.ndarray:
    total = np.zeros(dim)
    for i in range(0, len(keys), 512):
        total += counts[i : i + 512].astype(np.float64) @ gram_vectors(keys[i : i + 512], dim, n, letters)
    return total


def _sampled(rows: DataFrame, label: str, order: Column, per_language: int, most_broadcast: int) -> DataFrame:
    """The rows that are learned from: of each language a share that follows from its exact count, by a hash of ``order``."""
    span = 1 << 20
    counts = rows.groupBy(F.col(label).alias("__label")).count()
    share = written(counts.select("__label", F.least(F.lit(span), F.ceil(F.lit(per_language * span) / F.col("count"))).alias("__share")), "languages")
    share = F.broadcast(share) if share.count() <= most_broadcast else share
    return rows.join(share, F.col(label) == F.col("__label")).where(F.pmod(F.xxhash64(order.cast("string")), F.lit(span)) < F.col("__share"))


def learn(docs: DataFrame, label: str = "lang", text: str = "text", usable: Column | None = None, order: Column | None = None, per_language: int = 4000, dim: int = DIM, n: int = 3, most_broadcast: int = 50_000) -> DataFrame:
    """Prototypes of all labels, as a table in the shared folder: language, vector (of length 1), n.

    ``per_language`` bounds the rows learned from in each language (in expectation): their share follows from exact counts of
    labels, and rows are taken by a hash of ``order``, each value of it once, so the same rows are taken at every partitioning
    and repeated ones don't add up. The counts are broadcast if there are at most ``most_broadcast`` labels.
    """
    order = F.col("doc_id") if order is None else order
    rows = docs.where((F.lit(True) if usable is None else usable) & F.col(label).isNotNull() & F.col(text).isNotNull())
    small_batches(docs.sparkSession)

    def bundled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counted: dict[str, dict[int, float]] = {}
        for batch in batches:
            for language, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                keys, times = np.unique(grams_of(body, n), return_counts=True)
                weights = times / max(1e-9, float(np.sqrt(np.square(times, dtype=np.float64).sum())))
                own = counted.setdefault(language, {})
                for key, weight in zip(keys.tolist(), weights.tolist()):
                    own[key] = own.get(key, 0.0) + weight
        letters: dict[int, np.ndarray] = {}
        for language, own in counted.items():
            keys = np.array(sorted(own), np.uint64)
            total = bundle(keys, np.array([own[k] for k in sorted(own)]), dim, n, letters)
            yield pa.RecordBatch.from_pydict({"language": [language], "vector": [total.tolist()]})

    once = _sampled(rows, label, order, per_language, most_broadcast).groupBy(F.col(label).alias("language"), order.cast("string").alias("__order")).agg(F.min(text).alias("body"))
    # A language's rows go to four tasks at most, whose sums are added then.
    dealt = once.withColumn("__part", F.pmod(F.xxhash64("__order"), F.lit(4))).repartition("language", "__part").select("language", "body")
    parts = dealt.mapInArrow(bundled, "language string, vector array<double>").groupBy("language").agg(F.collect_list("vector").alias("parts"))
    total = F.aggregate(F.slice("parts", F.lit(2), F.size("parts")), F.get("parts", F.lit(0)), lambda a, v: F.zip_with(a, v, lambda x, y: x + y))
    summed = written(parts.select("language", total.alias("vector")), "language-sums")
    length = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x))
    return summed.withColumn("length", length).where("length > 0").select("language", F.transform("vector", lambda x: x / F.col("length")).alias("vector"), F.lit(n).alias("n"))


def in_blocks(learned: DataFrame, most: int = 1000) -> Iterator[Profiles]:
    """The prototypes in alphabetical order, ``most`` of them at a time: so many vectors come to the driver and go to a task at once."""
    last, n = None, most
    while n == most:
        rows = (learned if last is None else learned.where(F.col("language") > last)).orderBy("language").limit(most).collect()
        n = len(rows)
        if n:
            last = rows[-1].language
            yield Profiles([r.language for r in rows], np.array([r.vector for r in rows]), rows[0].n)


class Scorer:
    """Scores texts in one Python worker; keeps <n-gram, prototype> for the n-grams that it has met, up to a bound."""

    def __init__(self, profiles: Profiles, most: int = 200_000):
        self.p, self.most, self.dim = profiles, most, profiles.vectors.shape[1]
        self.letters: dict[int, np.ndarray] = {}
        self.clear()

    def clear(self) -> None:
        self.place, self.known = {}, np.zeros((1024, len(self.p.languages)))

    def places(self, keys: np.ndarray) -> np.ndarray:
        new = [k for k in keys.tolist() if k not in self.place]
        if new:
            if len(self.place) + len(new) > self.most:
                self.clear()
                new = keys.tolist()
            at, end = len(self.place), len(self.place) + len(new)
            while end > len(self.known):  # twice the room, so that what is known is seldom copied
                self.known = np.concatenate([self.known, np.zeros_like(self.known)])
            for i in range(0, len(new), 512):
                part = new[i : i + 512]
                self.known[at + i : at + i + len(part)] = gram_vectors(np.array(part, np.uint64), self.dim, self.p.n, self.letters) @ self.p.vectors.T
            self.place.update(zip(new, range(at, end)))
        return np.fromiter(map(self.place.__getitem__, keys.tolist()), np.int64, len(keys))

    def score(self, text: str | None) -> tuple[str, float]:
        """The best language and its cosine, which is below 0 for texts unlike all of them."""
        keys = grams_of(text, self.p.n) if text else np.zeros(0, np.uint64)
        if not len(keys) or not self.p.languages:
            return UNKNOWN, 0.0
        keys, counts = np.unique(keys, return_counts=True)
        places = self.places(keys)
        products = counts @ self.known[places]
        best = int(np.argmax(products))
        length = np.sqrt(self.dim * float(np.square(counts, dtype=np.float64).sum()))
        return self.p.languages[best], float(products[best] / length)


def _better(docs: DataFrame, profiles: Profiles) -> DataFrame:
    """docs, whose last columns are a text, and the best language and cosine so far; the first one stays among equals."""

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(profiles)
        for batch in batches:
            found = [old if old[0] != UNKNOWN and new[1] <= old[1] else new for body, *old in zip(*(c.to_pylist() for c in batch.columns[-3:])) for new in [scorer.score(body)]]
            columns = [pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], *columns], names=batch.schema.names)

    return docs.mapInArrow(predict, table_schema(docs))


def identify(docs: DataFrame, learned: DataFrame, text: str = "text", keep: list[str] | None = None, names: tuple[str, str] = ("lang_pred", "score"), most: int = 1000) -> DataFrame:
    """One row per row of docs: the columns ``keep`` (default doc_id), and language and score under ``names``. Narrow: no shuffle.

    Texts are compared with ``most`` prototypes at a time and keep the best so far, so the number of languages has no bound
    and a task holds no more than a block of them.
    """
    small_batches(docs.sparkSession)
    keep = ["doc_id"] if keep is None else keep
    out = docs.select(*keep, F.col(text).alias("__body"), F.lit(UNKNOWN).alias(names[0]), F.lit(0.0).alias(names[1]))
    for profiles in in_blocks(learned, most):
        out = _better(out, profiles)
    return out.withColumn(names[1], F.least(F.lit(1.0), F.greatest(F.lit(0.0), names[1]))).drop("__body")


def held_out(doc_id: Column) -> Column:
    """Rows kept from training: the CRC-32 of doc_id as text has remainder 1 by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def label_documents(docs: DataFrame, **parameters) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row; learns only from rows that aren't held out."""
    usable = F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))
    return identify(docs, learn(docs, usable=usable, **parameters)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
