"""SentencePiece encoding by sampling from the piece lattice, and lossless decoding.

A text's lattice has an edge for each vocabulary piece at each place where the text spells it. Forward filtering sums the
weights of all ways to each place; backward sampling then walks from the end, taking each incoming edge with its share of
that sum, so a segmentation is drawn exactly from the lattice's distribution. Draws are a counter-based hash of the row's
key, the unit's ordinal and the step, so a row's segmentation does not depend on partitioning, order or retries.

No piece goes over the start of a run of spaces or over a character that only stands alone, so the lattice falls apart
exactly at these places. Each distinct unit of a batch gets its lattice once, all units together as arrays; occurrences are
then sampled together. Work and memory are linear in the text. Units of more than ``LONG`` characters are filtered one by
one with rescaled sums.

Weights: a unigram vocabulary's scores are log probabilities and are used as they are. A BPE vocabulary's scores are only
ranks, so a piece of rank r gets log probability -log(r + 2) (Zipf's law). ``alpha`` smooths: weights are exp(alpha * log p).

As in SentencePiece, a space is put before the text, spaces are written U+2581, and characters without a piece become their
UTF-8 bytes. Decoding is lossless for every text, also with runs of spaces, control characters and a literal U+2581, which
is written as bytes. Defined results: a null text has null ids and decodes to null; an empty text has no ids; rows with the
same key and text get the same ids; a null key has a seed of its own. Other columns are kept by ``encode``.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakwork.llm.common import free_name, small_batches, worker_cache

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
LONG = 64
MIX = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


@dataclass
class Vocabulary:
    """pieces[i]: the string of id i with plain spaces, or None if it isn't an ordinary piece; bytes_at: ids of bytes."""

    pieces: list[str | None]
    log_p: list[float]
    bytes_at: list[int]
    digest: str


def read_vocabulary(path: str = MODEL) -> Vocabulary:
    """Reads a model file on the driver; executors get the table and need no file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    special = [model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i) for i in range(n)]
    pieces = [None if special[i] else model.id_to_piece(i).replace("▁", " ") for i in range(n)]
    bytes_at = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
    if not all(model.is_byte(i) for i in bytes_at):
        raise ValueError("the vocabulary has no byte pieces, so decoding could not be lossless")
    scores = [model.get_score(i) for i in range(n)]
    ranked = all(s == int(s) for s, p in zip(scores, pieces) if p)
    log_p = [-math.log(2 - s) if ranked and p else s for s, p in zip(scores, pieces)]
    return Vocabulary(pieces, log_p, bytes_at, hashlib.sha256(repr((pieces, log_p)).encode()).hexdigest())


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(MIX[1])
    x = (x ^ (x >> np.uint64(27))) * np.uint64(MIX[2])
    return x ^ (x >> np.uint64(31))


def draw(seed: np.ndarray, ordinal: np.ndarray, step: int) -> np.ndarray:
    """Uniform numbers in [0, 1) from the row's seed, the unit's ordinal in the row and the step."""
    with np.errstate(over="ignore"):
        x = mix(seed + ordinal.astype(np.uint64) * np.uint64(MIX[0]))
        return (mix(x + np.uint64(step + 1) * np.uint64(MIX[2])) >> np.uint64(11)).astype(np.float64) * 2.0**-53


def row_seed(key: object, seed: int) -> int:
    return int.from_bytes(hashlib.blake2b(repr((seed, key)).encode(), digest_size=8).digest(), "little")


class Lattice:
    """The vocabulary as a trie in an array, and the rule by which texts fall into units."""

    def __init__(self, v: Vocabulary, alpha: float):
        self.v = v
        own = {p: i for i, p in enumerate(v.pieces) if p}
        joined = sorted({c for p in own if len(p) > 1 for c in p})
        if missing := [c for c in joined if c not in own]:
            raise ValueError(f"characters only inside longer pieces: {missing[:5]}")
        if any(" " in p.lstrip(" ") for p in own):
            raise ValueError("a piece has a space after another character")
        self.single = {c: [i] for c, i in own.items() if len(c) == 1}
        inside = "".join(re.escape(c) for c in joined if c != " ")
        self.unit = re.compile(f" *[{inside}]+| +|[^ {inside}]" if inside else " +|[^ ]", re.S)
        self.letter = np.zeros(0x110000, np.int16)
        for k, c in enumerate([c for c in joined if c != " "] + [" "]):
            self.letter[ord(c)] = k + 1
        self.width = len(joined) + 2
        steps: list[dict[int, int]] = [{}, {}]  # 0: no such piece; 1: root
        ids = [-1, -1]
        for p, i in own.items():
            at = 1
            codes = [int(self.letter[ord(c)]) for c in p]
            if 0 in codes:
                continue  # a single character that is in no longer piece: a unit of its own
            for k in codes:
                if k not in steps[at]:
                    steps[at][k] = len(steps)
                    steps.append({})
                    ids.append(-1)
                at = steps[at][k]
            ids[at] = i
        self.next = np.zeros((len(steps), self.width), np.int32)
        for at, to in enumerate(steps):
            for k, x in to.items():
                self.next[at, k] = x
        self.id_at = np.array(ids, np.int32)
        self.weight_at = np.array([math.exp(alpha * v.log_p[i]) if i >= 0 else 0.0 for i in ids])
        self.longest = max((len(p) for p in own), default=1)
        self.as_bytes = [b""] * len(v.pieces)
        for i, p in enumerate(v.pieces):
            if p:
                self.as_bytes[i] = p.encode()
        for b, i in enumerate(v.bytes_at):
            self.as_bytes[i] = bytes([b])

    def fixed(self, unit: str) -> list[int] | None:
        """Ids of a unit that has one segmentation only."""
        if len(unit) == 1:
            return self.single.get(unit) or [self.v.bytes_at[b] for b in unit.encode("utf-8", "surrogatepass")]
        return None

    def codes(self, text: str) -> np.ndarray:
        return self.letter[np.frombuffer(text.encode("utf-32-le"), np.uint32)]

    def long(self, unit: str, seed: int, ordinal: int) -> list[int]:
        """One unit of any length: sums are rescaled at each place, so nothing underflows."""
        code, n = self.codes(unit).tolist(), len(unit)
        into: list[list[tuple[int, int, float]]] = [[] for _ in range(n + 1)]
        for i in range(n):
            at = 1
            for j in range(i, min(n, i + self.longest)):
                at = int(self.next[at, code[j]])
                if not at:
                    break
                if self.id_at[at] >= 0:
                    into[j + 1].append((i, int(self.id_at[at]), float(self.weight_at[at])))
        logs, shares = [0.0] * (n + 1), [None] * (n + 1)
        for j in range(1, n + 1):
            logged = [logs[i] + math.log(w) for i, _, w in into[j]]
            top = max(logged)
            parts = [math.exp(x - top) for x in logged]
            total = sum(parts)
            logs[j], shares[j] = top + math.log(total), [x / total for x in parts]
        found, j, step = [], n, 0
        u = draw(np.full(n, seed, np.uint64), np.full(n, ordinal, np.uint64) + np.arange(n, dtype=np.uint64) * np.uint64(1 << 32), 0).tolist()
        while j:
            left, k = u[step], 0
            while k < len(shares[j]) - 1 and left >= shares[j][k]:
                left -= shares[j][k]
                k += 1
            i, piece, _ = into[j][k]
            found.append(piece)
            j, step = i, step + 1
        return found[::-1]

    def table(self, units: list[str]) -> dict[str, np.ndarray]:
        """Lattices of short units, by place and then by unit (longest first), as arrays."""
        size = np.array([len(u) for u in units])
        order = np.argsort(-size, kind="stable")
        code = self.codes("".join(units))
        start = np.concatenate(([0], np.cumsum(size)))[:-1][order]
        size = size[order]
        most = int(size[0])
        alive = [int(np.searchsorted(-size, -j, side="left")) for j in range(most + 1)]  # units with more than j characters
        first = np.concatenate(([0], np.cumsum(alive)))  # of the nodes at place j; node (j, u) stands after j + 1 characters
        at = [code[start[: alive[j]] + j] for j in range(most)]
        nodes = int(first[most])
        weight = np.zeros((nodes, self.longest))
        piece = np.zeros((nodes, self.longest), np.int32)
        for j in range(most):
            state = np.ones(alive[j], np.int32)
            for length in range(1, min(self.longest, most - j) + 1):
                live = alive[j + length - 1]
                state = self.next[state[:live], at[j + length - 1][:live]]
                if not state.any():
                    break
                to = first[j + length - 1]
                weight[to : to + live, length - 1] = self.weight_at[state]
                piece[to : to + live, length - 1] = self.id_at[state]
        total = np.ones(nodes)
        for j in range(most):
            here = slice(first[j], first[j] + alive[j])
            for length in range(1, min(self.longest, j + 1) + 1):
                if j >= length:
                    weight[here, length - 1] *= total[first[j - length] : first[j - length] + alive[j]]
            total[here] = weight[here].sum(axis=1)
            weight[here] /= total[here][:, None]
        node, length = np.nonzero(weight)
        edges = np.concatenate(([0], np.cumsum(np.bincount(node, minlength=nodes))))
        rank = np.empty(len(units), np.int64)
        rank[order] = np.arange(len(units))
        place = np.empty(len(units), np.int64)
        place[order] = size
        return {"rank": rank, "size": place, "first": first, "cum": np.cumsum(weight[node, length]), "edges": edges, "length": (length + 1).astype(np.int64), "piece": piece[node, length]}

    def encode(self, texts: list[str | None], seeds: list[int]) -> list[np.ndarray | None]:
        """Ids of each text."""
        index: dict[str, int] = {}
        occurs, rows = [], []
        for r, text in enumerate(texts):
            if text:
                units = self.unit.findall(" " + text)
                occurs.extend([index.setdefault(u, len(index)) for u in units])
                rows.append((r, len(units)))
        if not rows:
            return [None if t is None else np.zeros(0, np.int32) for t in texts]
        units = list(index)
        fixed = {k: ids for k, u in enumerate(units) if (ids := self.fixed(u)) is not None}
        long = {k for k, u in enumerate(units) if len(u) > LONG}
        short = [k for k in range(len(units)) if k not in fixed and k not in long]
        occur = np.array(occurs, np.int64)
        n_units = np.array([n for _, n in rows])
        seed = np.repeat(np.array([seeds[r] for r, _ in rows], np.uint64), n_units)
        ordinal = np.arange(len(occur)) - np.repeat(np.cumsum(n_units) - n_units, n_units)
        count = np.zeros(len(occur), np.int64)
        picked: list[tuple[np.ndarray, np.ndarray, int]] = []
        if short:
            t = self.table([units[k] for k in short])
            slot = np.full(len(units), -1, np.int64)
            slot[short] = np.arange(len(short))
            who = np.nonzero(slot[occur] >= 0)[0]
            rank, place, step = t["rank"][slot[occur[who]]], t["size"][slot[occur[who]]], 0
            while len(who):
                node = t["first"][place - 1] + rank
                edge = np.searchsorted(t["cum"], node + draw(seed[who], ordinal[who], step), side="right")
                edge = np.clip(edge, t["edges"][node], t["edges"][node + 1] - 1)
                picked.append((who, t["piece"][edge], step))
                count[who] += 1
                place = place - t["length"][edge]
                going = place > 0
                who, rank, place, step = who[going], rank[going], place[going], step + 1
        others = np.nonzero(np.isin(occur, np.array([*fixed, *long], np.int64)))[0] if fixed or long else np.zeros(0, np.int64)
        given = {}
        for o in others.tolist():
            k = int(occur[o])
            given[o] = fixed[k] if k in fixed else self.long(units[k], int(seed[o]), int(ordinal[o]))
            count[o] = len(given[o])
        ends = np.cumsum(count)
        out = np.zeros(int(ends[-1]), np.int32)
        for who, ids, step in picked:
            out[ends[who] - 1 - step] = ids
        for o, ids in given.items():
            out[ends[o] - len(ids) : ends[o]] = ids
        found: list[np.ndarray | None] = [None if t is None else np.zeros(0, np.int32) for t in texts]
        at = 0
        for r, n in rows:
            begin = int(ends[at - 1]) if at else 0
            at += n
            found[r] = out[begin : int(ends[at - 1])]
        return found

    def decode(self, ids: list[int] | np.ndarray | None) -> str | None:
        if ids is None:
            return None
        joined = b"".join(map(self.as_bytes.__getitem__, ids.tolist() if isinstance(ids, np.ndarray) else ids))
        return joined.decode("utf-8", "surrogatepass")[1:]


def _shared(spark: SparkSession, model: str):
    """The vocabulary as a broadcast of plain values, which workers can read without this package; its size is the file's."""
    v = read_vocabulary(model)
    return spark.sparkContext.broadcast((v.pieces, v.log_p, v.bytes_at, v.digest))


def _lattice(vocabulary, alpha: float) -> Lattice:
    v = Vocabulary(*vocabulary.value)
    return worker_cache(("lattice", v.digest, alpha), lambda: Lattice(v, alpha))


def _chunks(batch: pa.RecordBatch, text: int, most: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """Slices of about ``most`` characters, or one row."""
    lengths = np.cumsum([len(x.as_buffer() or b"") if x.is_valid else 0 for x in batch.column(text)])
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(lengths, (lengths[at - 1] if at else 0) + most, side="right")))
        yield batch.slice(at, to - at)
        at = to


def _schema(df: DataFrame, *more: str) -> str:
    return ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), *more])


def encode(docs: DataFrame, text: str = "text", key: str = "doc_id", model: str = MODEL, alpha: float = 0.5, seed: int = 0, ids: str = "ids") -> DataFrame:
    """docs with a last column of sampled piece ids, called ``ids`` or, if docs has such a column, ids_1 and so on. Narrow."""
    spark = docs.sparkSession
    ids = free_name(docs, ids)
    small_batches(spark)
    vocabulary = _shared(spark, model)
    at, by = docs.columns.index(text), docs.columns.index(key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = _lattice(vocabulary, alpha)
        for whole in batches:
            for batch in _chunks(whole, at):
                found = lattice.encode(batch.column(at).to_pylist(), [row_seed(k, seed) for k in batch.column(by).to_pylist()])
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(pa.int32()))], names=[*batch.schema.names, ids])

    return docs.mapInArrow(run, _schema(docs, f"`{ids}` array<int>"))


def decode(encoded: DataFrame, ids: str = "ids", model: str = MODEL, text: str = "decoded") -> DataFrame:
    """encoded with a last column of the texts that its ids spell, named like that of ``encode``."""
    spark = encoded.sparkSession
    text = free_name(encoded, text)
    small_batches(spark)
    vocabulary = _shared(spark, model)
    at = encoded.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = _lattice(vocabulary, 1.0)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([lattice.decode(x) for x in batch.column(at).to_pylist()], pa.string())], names=[*batch.schema.names, text])

    return encoded.mapInArrow(run, _schema(encoded, f"`{text}` string"))


def digest(docs: DataFrame, text: str = "text", key: str = "doc_id", model: str = MODEL, alpha: float = 0.5, seed: int = 0) -> DataFrame:
    """For each row: the key, n_pieces, ids_sha256 (of the ids as little-endian 32-bit numbers) and lossless: whether decoding gives the text back."""
    spark = docs.sparkSession
    small_batches(spark)
    vocabulary = _shared(spark, model)
    sent = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = _lattice(vocabulary, alpha)
        for whole in batches:
            for batch in _chunks(whole, 1):
                texts = batch.column(1).to_pylist()
                found = lattice.encode(texts, [row_seed(k, seed) for k in batch.column(0).to_pylist()])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0),
                        pa.array([None if x is None else len(x) for x in found], pa.int64()),
                        pa.array([None if x is None else hashlib.sha256(x.astype("<i4").tobytes()).hexdigest() for x in found], pa.string()),
                        pa.array([lattice.decode(x) == t if t != "" else len(x) == 0 for x, t in zip(found, texts)], pa.bool_()),
                    ],
                    names=["doc_id", "n_pieces", "ids_sha256", "lossless"],
                )

    return sent.mapInArrow(run, _schema(sent.select("doc_id"), "n_pieces bigint", "ids_sha256 string", "lossless boolean"))
