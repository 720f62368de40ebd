"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A document is the set of the hash buckets of its words, word pairs, word triples and
pairs with one or two words between. Every bucket has its own learning rate (from the
squares of its gradients) and an L1 threshold, so all but a few thousand weights are
exactly zero and the model that goes to the tasks is short lists of buckets and weights.

The labelled sample is dealt to a fixed number of shards by a hash of the id. In a round
each shard runs through its documents in hash order from the common state (z, n of every
bucket), and the changes of all shards are averaged, by ranges of buckets. Neither the
number of executors nor the order of rows changes the model.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .flat import BLOCK_BYTES, SegmentHash, distinct, mix, text_blocks, word_bounds
from .steps import step

BITS = 20  # buckets: 2^20, one more for the intercept
SHARDS, RANGES = 8, 16
MAX_TRAIN = 65_536  # labelled documents learnt from: those with the smallest hashes of their ids
TAIL = 3  # words before a word that its skip-grams reach

_LETTER = np.full(256, 32, np.uint8)
_LETTER[128:] = np.arange(128, 256)
_LETTER[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
_LETTER[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)


def _grams(h: np.ndarray, row: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams and skip-grams of words ``h``, and the rows they are in; ``row`` ascends."""
    odd = [np.uint64(k) for k in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1)]
    keys, rows = [h * odd[0]], [row]
    for gap, factor in ((1, odd[1]), (2, odd[2]), (3, odd[3])):
        inside = row[gap:] == row[:-gap] if len(h) > gap else np.zeros(0, bool)
        first, last = h[: len(inside)][inside], h[gap : gap + len(inside)][inside]
        keys.append(first * factor + mix(last))
        rows.append(row[: len(inside)][inside])
        if gap == 2:
            middle = h[1 : 1 + len(inside)][inside]
            keys.append(first * odd[4] + mix(last + mix(middle)))
            rows.append(rows[-1])
    return (mix(np.concatenate(keys)) >> np.uint64(64 - bits)).astype(np.int64), np.concatenate(rows)


def buckets(data: np.ndarray, offsets: np.ndarray, bits: int = BITS, piece: int = BLOCK_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Buckets and rows of a block of texts; a longer text comes in several pieces, whose words overlap.

    Words are runs of letters (A-Z in lower case) and bytes beyond ASCII; everything else parts them.
    """
    data = _LETTER[data]
    if len(offsets) > 2 or len(data) <= piece:
        start, end, bound = word_bounds(data, offsets)
        if len(start):
            yield _grams(SegmentHash(data).of(start, end), np.repeat(np.arange(len(offsets) - 1), np.diff(bound)), bits)
        return
    at, tail = 0, np.zeros(0, np.uint64)
    while at < len(data):
        stop = min(at + piece, len(data))
        while stop < len(data) and data[stop] != 32:  # to the end of the word
            rest = np.flatnonzero(data[stop : stop + piece] == 32)
            stop = stop + int(rest[0]) if len(rest) else min(stop + piece, len(data))
        part = data[at:stop]
        start, end, _ = word_bounds(part, np.array([0, len(part)]))
        if len(start):
            h = np.concatenate([tail, SegmentHash(part).of(start, end)])
            yield _grams(h, np.zeros(len(h), np.int64), bits)
            tail = h[-TAIL:]
        at = stop


def bucket_sets(data: np.ndarray, offsets: np.ndarray, bits: int = BITS) -> list[np.ndarray]:
    """The distinct buckets of each text, ascending."""
    n = len(offsets) - 1
    code = np.zeros(0, np.int64)
    for index, row in buckets(data, offsets, bits):
        code = distinct(np.concatenate([code, row << bits | index]))
    bound = np.searchsorted(code, np.arange(n + 1) << bits)
    code &= (1 << bits) - 1
    return [code[i:j] for i, j in zip(bound[:-1], bound[1:], strict=True)]


@dataclass(frozen=True)
class Rates:
    """alpha and beta of the per-bucket rate, the L1 and L2 weights, and the number of rounds."""

    alpha: float = 3.0
    beta: float = 1.0
    l1: float = 2.0
    l2: float = 0.1
    rounds: int = 4


class State:
    """z and n of every bucket; the last one is the intercept, which L1 leaves alone."""

    def __init__(self, rates: Rates, index: np.ndarray, z: np.ndarray, n: np.ndarray, bits: int = BITS):
        self.rates, self.z, self.n = rates, np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)
        self.z[index], self.n[index] = z, n
        self.l1 = np.full((1 << bits) + 1, rates.l1)
        self.l1[-1] = 0.0

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, r = self.z[at], self.rates
        held = np.sign(z) * np.maximum(np.abs(z) - self.l1[at], 0.0)
        return -held / ((r.beta + np.sqrt(self.n[at])) / r.alpha + r.l2)

    def learn(self, at: np.ndarray, label: int) -> None:
        """One document: its buckets and its label."""
        at = np.append(at, len(self.z) - 1)
        w = self.weights(at)
        g = sigmoid(w.sum()) - label
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.rates.alpha * w
        self.n[at] = n + g * g


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -50, 50)))


@dataclass
class Model:
    """Buckets with a weight, their weights, and the intercept (None where nothing was learnt)."""

    index: np.ndarray
    weight: np.ndarray
    intercept: float | None
    bits: int = BITS

    def scores(self, data: np.ndarray, offsets: np.ndarray, dense: np.ndarray) -> np.ndarray:
        n = len(offsets) - 1
        if self.intercept is None:
            return np.zeros(n)
        code = np.zeros(0, np.int64)
        for index, row in buckets(data, offsets, self.bits):
            hit = dense[index] != 0
            code = distinct(np.concatenate([code, row[hit] << self.bits | index[hit]]))
        total = np.bincount(code >> self.bits, weights=dense[code & ((1 << self.bits) - 1)], minlength=n)
        return sigmoid(total + self.intercept)

    def dense(self) -> np.ndarray:
        out = np.zeros(1 << self.bits)
        out[self.index] = self.weight
        return out


def held_out(doc_id: str = "doc_id"):
    """Rows that no model may learn from: crc32 of the id as text, modulo 4, is 2. A null id is held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(True))


def training_rows(docs: DataFrame, labels: DataFrame, label: str = "toxic", bound: int = MAX_TRAIN) -> DataFrame:
    """shard, place, text, label of at most ``bound`` labelled documents that are not held out.

    A document labelled more than once counts with its smallest label, one in several rows with
    its smallest text; null labels and null ids do not count, a null text is empty.
    """
    own = labels.where(~held_out() & F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.min(label).cast("int").alias("label"))
    place = F.xxhash64("doc_id")
    own = own.select("doc_id", "label", place.alias("place")).orderBy("place", "doc_id").limit(bound)
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text")).join(F.broadcast(own), "doc_id")
    rows = rows.groupBy("doc_id", "label", "place").agg(F.min("text").alias("text"))
    return rows.select(F.pmod("place", F.lit(SHARDS)).cast("int").alias("shard"), "place", "doc_id", "text", "label")


_CHANGE = T.StructType([T.StructField("range", T.IntegerType()), T.StructField("shard", T.IntegerType()), T.StructField("index", T.ArrayType(T.IntegerType())), T.StructField("z", T.ArrayType(T.FloatType())), T.StructField("n", T.ArrayType(T.FloatType()))])


def _round(rows: DataFrame, rates: Rates, index: np.ndarray, z: np.ndarray, n: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The state after every shard has run through its rows from the given one, changes averaged."""

    def changes(shard: int, state: State) -> pa.RecordBatch:
        before = State(rates, index, z, n, bits)
        touched = np.flatnonzero(state.n != before.n)
        bound = np.searchsorted(touched, np.linspace(0, len(before.z), RANGES + 1).astype(np.int64))
        parts = [touched[i:j] for i, j in zip(bound[:-1], bound[1:], strict=True)]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(range(RANGES), pa.int32()), pa.array([shard] * RANGES, pa.int32()), pa.array([p.astype(np.int32) for p in parts], pa.list_(pa.int32())),
                pa.array([(state.z[p] - before.z[p]).astype(np.float32) for p in parts], pa.list_(pa.float32())), pa.array([(state.n[p] - before.n[p]).astype(np.float32) for p in parts], pa.list_(pa.float32())),
            ],
            names=_CHANGE.names,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, state = None, None
        for batch in batches:
            shards, label = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            for i, _, data, offsets in text_blocks(batch.column(1)):
                for k, found in enumerate(bucket_sets(data, offsets, bits), i):
                    if shards[k] != shard:
                        if state is not None:
                            yield changes(shard, state)
                        shard, state = shards[k], State(rates, index, z, n, bits)
                    state.learn(found, label[k])
        if state is not None:
            yield changes(shard, state)

    def merged(table: pa.Table) -> pa.Table:
        flat = {c: table.column(c).combine_chunks() for c in ("index", "z", "n")}
        lists = {c: [v[i].values.to_numpy(zero_copy_only=False) for i in np.argsort(table.column("shard").to_numpy())] for c, v in flat.items()}  # sums in a fixed order
        at = distinct(np.concatenate(lists["index"])).astype(np.int64)
        out = {c: np.zeros(len(at)) for c in "zn"}
        for k, index in enumerate(lists["index"]):
            place = np.searchsorted(at, index)
            for c in "zn":
                out[c][place] += lists[c][k] / SHARDS
        columns = [pa.array([table.column("range")[0].as_py()], pa.int32()), pa.array([0], pa.int32()), pa.array([at.astype(np.int32)], pa.list_(pa.int32())), *(pa.array([out[c].astype(np.float32)], pa.list_(pa.float32())) for c in "zn")]
        return pa.table(columns, names=_CHANGE.names)

    dealt = rows.repartition(SHARDS, "shard").sortWithinPartitions("shard", "place", "doc_id").select("shard", "text", "label")
    change = step(dealt.mapInArrow(run, _CHANGE).groupBy("range").applyInArrow(merged, _CHANGE), "ftrl-round")
    state = State(rates, index, z, n, bits)
    found = change.toArrow()  # one row a range, 2^20 buckets in all at most
    for k in range(found.num_rows):
        at, dz, dn = (found.column(c)[k].values.to_numpy(zero_copy_only=False) for c in ("index", "z", "n"))
        state.z[at] += dz
        state.n[at] += dn
    index = np.flatnonzero(state.n)
    return index.astype(np.int32), state.z[index].astype(np.float32), state.n[index].astype(np.float32)  # what tasks get


def train(rows: DataFrame, rates: Rates = Rates(), bits: int = BITS) -> Model:
    """Fits on rows of ``training_rows``; without rows nothing is learnt and every score is 0."""
    rows = step(rows, "ftrl-sample")
    state = np.zeros(0, np.int64), np.zeros(0), np.zeros(0)
    for _ in range(rates.rounds):
        state = _round(rows, rates, *state, bits)
    if not len(state[0]):
        return Model(state[0], state[1], None, bits)
    index = state[0]
    weight = State(rates, *state, bits).weights(index)
    kept = (weight != 0) & (index < 1 << bits)
    return Model(index[kept], weight[kept], float(weight[index == 1 << bits][0]), bits)


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """Row-local: adds the probability of label 1; null and empty texts have that of the intercept. ``out`` is replaced, the text goes."""
    keep = [c for c in docs.columns if c not in (text, out)]
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(out, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense = model.dense()
        for batch in batches:
            for i, j, data, offsets in text_blocks(batch.column(batch.schema.get_field_index(text))):
                part = batch.slice(i, j - i)
                arrays = [part.column(part.schema.get_field_index(c)) for c in keep]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array(model.scores(data, offsets, dense))], names=schema.names)

    return docs.mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame, label: str = "toxic", threshold: float = 0.3, rates: Rates = Rates(), bound: int = MAX_TRAIN) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``.

    Repeated rows are all returned. Null and empty texts are scored by the intercept; without
    usable labels every score is 0. Only the text enters a score.
    """
    model = train(training_rows(docs, labels, label, bound), rates)
    out = score(docs.select("doc_id", "text"), model).withColumn("held_out", held_out())
    return out.select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
