"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

Its score is linear in the number of features by the sum-of-squares identity
``sum_{i<j} <v_i, v_j> x_i x_j = 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i (v_if x_i)^2)``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tideline.llm import sampling, text as T

PER_CLASS = 5000
BITS = 14
FACTORS = 6
EPOCHS = 6
RATE = 0.02
BATCH = 128
LEAST = 12  # counted words per text below which values are damped

_kinds = {"upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "symbol": b"#*$%&|<>", "mark": b"!?", "stop": b".,;:", "line": b"\n"}
_CLASS = np.zeros(256, np.int64)
for _i, _members in enumerate(_kinds.values()):
    _CLASS[list(_members)] = _i + 1
N_STATS = len(_kinds) + 1 + 5
N_WORDS = 1 << BITS
WIDTH = N_WORDS + N_STATS


def features(block: T.Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bounds of each row's entries, feature numbers and values of the entries, and the row of each entry."""
    w = T.words(block, lower=True)
    rows = block.hi - block.lo
    n_words, n_bytes = np.diff(w.first), np.diff(block.bounds)
    key = w.row.astype(np.int64) << BITS | (w.hash >> np.uint64(64 - BITS)).astype(np.int64)
    key.sort()
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    tf = np.diff(np.append(first, len(key)))
    word_row, word_id = key[first] >> BITS, key[first] & (N_WORDS - 1)
    value = np.log1p(tf)
    norm = np.sqrt(np.bincount(word_row, weights=value**2, minlength=rows))
    value = value / np.sqrt(norm[word_row] ** 2 + LEAST)
    classes = np.bincount(np.repeat(np.arange(rows), n_bytes) * (len(_kinds) + 1) + _CLASS[block.data], minlength=rows * (len(_kinds) + 1))
    shares = classes.reshape(rows, -1) / np.maximum(n_bytes, 1)[:, None]
    distinct = np.bincount(word_row, minlength=rows)
    stats = np.column_stack([
        np.sqrt(shares), distinct / np.maximum(n_words, 1), np.minimum(n_bytes / np.maximum(n_words, 1), 40) / 10,
        np.log1p(n_words) / 10, np.log1p(n_bytes) / 10, np.bincount(word_row, weights=np.where(tf > 1, tf, 0), minlength=rows) / np.maximum(n_words, 1)])
    row = np.concatenate([word_row, np.repeat(np.arange(rows), N_STATS)])
    number = np.concatenate([word_id, np.tile(np.arange(N_WORDS, WIDTH), rows)])
    values = np.concatenate([value, stats.ravel()])
    order = np.argsort(row, kind="stable")
    row = row[order]
    return np.searchsorted(row, np.arange(rows + 1)), number[order], values[order].astype(np.float32), row


class Machine:
    def __init__(self, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.bias = np.float32(0)
        self.linear = np.zeros(WIDTH, np.float32)
        self.factor = rng.normal(0, 0.02, (WIDTH, FACTORS)).astype(np.float32)

    def raw(self, bounds: np.ndarray, number: np.ndarray, value: np.ndarray) -> np.ndarray:
        """Scores before the logistic, each row from its own entries (every row has some)."""
        if len(bounds) < 2:
            return np.zeros(0)
        vx = self.factor[number] * value[:, None]
        at = bounds[:-1]
        total, squares = np.add.reduceat(vx, at, axis=0), np.add.reduceat(vx * vx, at, axis=0)
        return self.bias + np.add.reduceat(self.linear[number] * value, at) + 0.5 * (total**2 - squares).sum(1)

    def train(self, rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, weight: np.ndarray, epochs: int = EPOCHS) -> None:
        """Adagrad over mini-batches on the logistic loss."""
        rng = np.random.default_rng(5)
        g_linear, g_factor = np.full(WIDTH, 1e-3, np.float32), np.full((WIDTH, FACTORS), 1e-3, np.float32)
        g_bias = 1e-3
        for _ in range(epochs):
            order = rng.permutation(len(rows))
            for lo in range(0, len(order), BATCH):
                pick = order[lo:lo + BATCH]
                number, value = np.concatenate([rows[i][0] for i in pick]), np.concatenate([rows[i][1] for i in pick])
                size = np.array([len(rows[i][0]) for i in pick])
                bounds = np.concatenate([[0], np.cumsum(size)])
                owner = np.repeat(np.arange(len(pick)), size)
                vx = self.factor[number] * value[:, None]
                total = np.add.reduceat(vx, bounds[:-1], axis=0)
                z = self.raw(bounds, number, value)
                error = ((1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[pick]) * weight[pick]).astype(np.float32)
                ev = error[owner] * value
                unique, inverse = np.unique(number, return_inverse=True)
                grad = np.column_stack([ev, ev[:, None] * (total[owner] - vx)])
                by = np.zeros((len(unique), 1 + FACTORS), np.float32)
                np.add.at(by, inverse, grad)
                by = by / len(pick) + np.column_stack([self.linear[unique], self.factor[unique]]) * np.float32(1e-5)
                g_linear[unique] += by[:, 0] ** 2
                g_factor[unique] += by[:, 1:] ** 2
                self.linear[unique] -= np.float32(5 * RATE) * by[:, 0] / np.sqrt(g_linear[unique])
                self.factor[unique] -= np.float32(RATE) * by[:, 1:] / np.sqrt(g_factor[unique])
                g_bias += float(error.mean()) ** 2
                self.bias -= np.float32(5 * RATE * float(error.mean()) / g_bias**0.5)


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Machine:
    """Train on at most ``2 * per_class`` labelled rows outside the held-out fold; classes count alike."""
    sample = sampling.labelled_sample(docs, labels, "quality", 3, 1, per_class)
    schema = pa.schema([("label", pa.int32()), ("number", pa.list_(pa.int32())), ("value", pa.list_(pa.float32()))])

    def run(batches):
        for batch in batches:
            label = batch.column(batch.schema.get_field_index("label"))
            for block in T.blocks(batch):
                bounds, number, value, _ = features(block)
                at = pa.array(bounds, pa.int32())
                yield pa.RecordBatch.from_arrays([label.slice(block.lo, block.hi - block.lo), pa.ListArray.from_arrays(at, pa.array(number, pa.int32())),
                                                  pa.ListArray.from_arrays(at, pa.array(value, pa.float32()))], schema=schema)

    table = sample.mapInArrow(run, "label int, number array<int>, value array<float>").toArrow()
    machine = Machine()
    if len(table):
        y = table.column("label").to_numpy().astype(float)
        rows = [(np.asarray(n.values), np.asarray(v.values)) for n, v in
                zip(table.column("number"), table.column("value"), strict=True)]
        share = max(y.mean(), 1e-3), max(1 - y.mean(), 1e-3)
        machine.train(rows, y, np.where(y == 1, 0.5 / share[0], 0.5 / share[1]))
    return machine


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """doc_id and score of each row of ``docs``; null and empty texts are scored by their (zero) statistics.

    One pass over whole texts, no shuffle. Repeated rows are scored each; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(machine)
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches):
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("doc_id"))
            for block in T.blocks(batch):
                z = shared.value.raw(*features(block)[:3])
                p = 1 / (1 + np.exp(-np.clip(z, -30, 30).astype(np.float64)))
                yield pa.RecordBatch.from_arrays([ids.slice(block.lo, block.hi - block.lo), pa.array(p)], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")
