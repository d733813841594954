"""Logistic regression on hashed word n-grams, trained by follow-the-regularised-leader updates.

Features are n-grams of tokens (runs of word characters, runs of other visible characters) and
of their shapes (case, digits, punctuation, repetition of the token before), hashed into a fixed
number of slots; a value is the logarithm of one more than the count, and a text's vector has
a fixed length.  A score is the sparse dot product of vector and weights, through the logistic
curve.

Training takes a bounded sample of labelled rows: the ``sample_rows`` of them with the smallest
hash of their id.  The sample's ids are few enough to broadcast, so texts aren't shuffled.  Its
vectors are staged and dealt to ``SHARDS``; in each round every shard goes on from the common
state with per-coordinate updates, and the states are averaged.  The state that the driver holds
has ``SLOTS`` numbers, whatever the size of the data.

Cases: null and empty texts have no features, and get the score of the intercept; rows without a
label, and labels without a row, train nothing; of several labels of an id the smallest counts;
repeated rows are scored each; null ids are scored, and never trained on; extra columns, whatever
their names, play no part; without any labels the score is 0.5; an empty table gives an empty
table; long texts are taken whole.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import id_and_text, ready_workers, staged
from .tokens import shares

BITS = 18
SLOTS = 1 << BITS
SAMPLE_ROWS = 10_000
SHARDS, ROUNDS = 4, 4
# Of the updates: learning rate, its smoothing, and both penalties.
ALPHA, BETA, L1, L2 = 1.0, 1.0, 0.005, 0.1
# Length of a text's vector.
LENGTH = 4.0
_TOKEN = re.compile(r"\w+|[^\w\s]+")
_REMEMBERED = 300_000


def shape(token: str) -> str:
    if not (token[0].isalnum() or token[0] == "_"):
        return token[:3]
    if token.isdigit():
        return "0"
    return "A" if token.isupper() and len(token) > 1 else "Aa" if token[0].isupper() else "a"


class Hasher:
    """Vectors of texts; remembers the hashes of words that it has seen."""

    def __init__(self):
        self.known: dict[str, tuple[int, int]] = {}

    def _hash(self, token: str) -> tuple[int, int]:
        from xxhash import xxh64_intdigest

        if len(self.known) > _REMEMBERED:
            self.known.clear()
        found = self.known[token] = (xxh64_intdigest(token.lower(), 1),
                                     xxh64_intdigest(shape(token), 2))
        return found

    def vector(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Slots, ascending, and values."""
        tokens = _TOKEN.findall(text)
        if not tokens:
            return np.zeros(0, np.int32), np.zeros(0, np.float32)
        known = self.known
        both = np.array([known.get(t) or self._hash(t) for t in tokens], dtype=np.uint64)
        words, shapes = both[:, 0], both[:, 1].copy()
        shapes[1:][words[1:] == words[:-1]] = 7  # the token before, again
        grams = [words, _joined(words, 2), _joined(shapes, 2), _joined(shapes, 3)]
        slots, counts = np.unique(
            (np.concatenate(grams) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS),
            return_counts=True)
        values = np.log1p(counts)
        values *= LENGTH / np.sqrt((values ** 2).sum())
        return slots.astype(np.int32), values.astype(np.float32)


def _joined(tokens: np.ndarray, n: int) -> np.ndarray:
    out = np.full(max(0, len(tokens) - n + 1), n, dtype=np.uint64)
    for i in range(n):
        out = out * np.uint64(0xC2B2AE3D27D4EB4F) + tokens[i:len(tokens) - n + 1 + i]
        out ^= out >> np.uint64(29)
    return out


class Leader:
    """State of the updates; the last slot is the intercept."""

    def __init__(self, z: np.ndarray, n: np.ndarray):
        self.z, self.n = z, n

    def weights(self, slots=slice(None)) -> np.ndarray:
        z, n = self.z[slots], self.n[slots]
        return np.where(np.abs(z) <= L1, 0.0,
                        -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def learn(self, slots: np.ndarray, values: np.ndarray, label: int) -> None:
        slots, values = np.append(slots, SLOTS), np.append(values, 1.0)
        w = self.weights(slots)
        g = (1 / (1 + np.exp(-np.clip(w @ values, -30, 30))) - label) * values
        self.z[slots] += g - (np.sqrt(self.n[slots] + g * g) - np.sqrt(self.n[slots])) / ALPHA * w
        self.n[slots] += g * g


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> np.ndarray:
    """Weights, the intercept last, from ``(doc_id, label)`` rows with labels 0 and 1."""
    ready_workers(docs.sparkSession)
    chosen = labels.filter("doc_id is not null and label in (0, 1)").groupBy("doc_id").agg(
        F.min("label").cast("int").alias("label")).orderBy(
        F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    sample = id_and_text(docs).join(F.broadcast(chosen), "doc_id")
    schema = T.StructType.fromDDL("shard int, place long, label int, slots binary, values binary")

    def vectors(batches):
        hasher = Hasher()
        for batch in batches:
            for at, texts in shares(batch):
                part, found = batch.slice(at, len(texts)), [hasher.vector(t) for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [part.column("shard"), part.column("place"), part.column("label"),
                     pa.array([s.tobytes() for s, _ in found], pa.binary()),
                     pa.array([v.tobytes() for _, v in found], pa.binary())], schema.names)

    rows = staged(sample.select(
        F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(SHARDS)).cast("int").alias("shard"),
        F.xxhash64("doc_id", F.lit(5)).alias("place"), "label", "text").mapInArrow(
        vectors, schema))
    state = (np.zeros(SLOTS + 1), np.zeros(SLOTS + 1))
    for _ in range(ROUNDS):
        state = _round(rows, state)
    return Leader(*state).weights()


def _round(rows: DataFrame, state: tuple[np.ndarray, np.ndarray]) -> tuple:
    """One pass of every shard from the common state, then the average of the states."""
    z, n = state
    shared = rows.sparkSession.sparkContext.broadcast(state)

    def run(shard: pa.Table) -> pa.Table:
        leader = Leader(*(x.copy() for x in shared.value))
        shard = shard.sort_by([("place", "ascending"), ("label", "ascending"),
                               ("slots", "ascending")])
        for label, slots, values in zip(*(shard.column(c).to_pylist()
                                          for c in ("label", "slots", "values"))):
            leader.learn(np.frombuffer(slots, np.int32), np.frombuffer(values, np.float32), label)
        moved = np.flatnonzero((leader.z != shared.value[0]) | (leader.n != shared.value[1]))
        return pa.table({"slot": pa.array(moved, pa.int64()),
                         "z": leader.z[moved] - shared.value[0][moved],
                         "n": leader.n[moved] - shared.value[1][moved]})

    # A shard has at most the bounded sample's rows.
    steps = rows.groupBy("shard").applyInArrow(run, "slot long, z double, n double").groupBy(
        "slot").agg(F.sum("z").alias("z"), F.sum("n").alias("n")).toPandas()  # <= SLOTS + 1 rows
    z, n = z.copy(), n.copy()
    z[steps["slot"]] += steps["z"] / SHARDS
    n[steps["slot"]] += steps["n"] / SHARDS
    return z, n


def scored(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """``(doc_id, score)`` of each whole text."""
    rows = id_and_text(docs)
    ready_workers(docs.sparkSession)
    schema = T.StructType([rows.schema["doc_id"], T.StructField("score", T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches):
        hasher, w = Hasher(), shared.value
        for batch in batches:
            for at, texts in shares(batch):
                dots = np.array([w[slots] @ values + w[-1]
                                 for slots, values in map(hasher.vector, texts)])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(at, len(texts)),
                     pa.array(1 / (1 + np.exp(-np.clip(dots, -30, 30))), pa.float64())],
                    schema.names)

    return rows.mapInArrow(run, schema)
