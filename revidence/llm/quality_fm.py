"""Operator 2: quality classifier, a factorisation machine.

Features of a text: its distinct words hashed into ``BUCKETS`` (value 1 / sqrt of their number), statistics of its
structure, each as one of ``LEVELS`` steps, and its length as metadata. Pairs of features interact through rank
``RANK`` factors; by the identity sum_{i<j} <v_i, v_j> x_i x_j = (|sum v_i x_i|^2 - sum |v_i x_i|^2) / 2 a text is scored in
time linear in its features.

The model is fitted by Adagrad on at most ``SAMPLE`` labelled rows (common.labelled_sample), of which only the features reach
the driver: a bounded number of rows, each with all features of its whole text (at most ``BUCKETS`` hashed words), as in scoring.

Rows: null and empty texts have no words and the statistics of an empty text, and get a score like any other. Null labels are not
learned from; an id with several labels counts with each. Without labelled rows the score is 0.5. Repeated rows get equal
scores. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

BUCKETS, RANK, LEVELS = 1 << 16, 4, 16
SAMPLE = 8_000
EPOCHS, BATCH, RATE, L2 = 8, 64, 0.08, 2e-5

_CLASS = np.zeros(256, np.int64)  # of a byte: letter a-z, A-Z, other word byte, digit, space, line feed, sentence mark, symbol
for _i in range(256):
    _c = chr(_i)
    _CLASS[_i] = (1 if "a" <= _c <= "z" else 2 if "A" <= _c <= "Z" else 3 if _i >= 128 else 4 if "0" <= _c <= "9" else 5 if _c in " \t\r\x0b\x0c"
                  else 6 if _c == "\n" else 7 if _c in ".,;:'\"()-" else 0)
STATISTICS = 14


def structure(data: bytes, words: list[bytes], distinct: set[bytes]) -> np.ndarray:
    """STATISTICS shares in 0..1."""
    n, w = max(len(data), 1), max(len(words), 1)
    c = np.bincount(_CLASS[np.frombuffer(data, np.uint8)], minlength=8)[:8] / n
    same_as_last = sum(map(bytes.__eq__, words, words[1:])) / w
    lines = data.split(b"\n")
    short = sum(len(x) <= 1 for x in words) / w
    trigrams = set(zip(words, words[1:], words[2:]))
    return np.array([*c[:5], c[7], len(distinct) / w, same_as_last, 1 - len(trigrams) / max(len(words) - 2, 1) if len(words) > 2 else 0.0,
                     min(n / w / 32, 1), short, len(set(lines)) / len(lines), min(len(lines) / w * 4, 1), min(np.log2(1 + len(data)) / 24, 1)])


def features(text: str | None, length: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(indices, values): structure and metadata first, then the hashed words. Linear in the text."""
    data = (text or "").encode()
    words = data.lower().split()
    distinct = set(words)
    step = np.minimum((structure(data, words, distinct) * LEVELS).astype(np.int64), LEVELS - 1)
    fixed = BUCKETS + np.arange(STATISTICS) * LEVELS + step
    hashed = np.unique(np.fromiter(map(zlib.crc32, distinct), np.int64, len(distinct)) % BUCKETS)
    x = np.concatenate([fixed, hashed])
    values = np.ones(len(x))
    values[STATISTICS:] = 1 / np.sqrt(max(len(hashed), 1))
    return x, values


@dataclass
class Model:
    w0: float
    w: np.ndarray
    v: np.ndarray

    def margin(self, x: np.ndarray, values: np.ndarray) -> float:
        """w0 + <w, x> + sum of the pairs, by sums of squares."""
        s = self.v[x] * values[:, None]
        return float(self.w0 + self.w[x] @ values + 0.5 * ((s.sum(axis=0) ** 2).sum() - (s ** 2).sum()))

    def score(self, text: str | None) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.margin(*features(text)), -30, 30))))


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], *, seed: int = 7) -> Model:
    """Adagrad over mini-batches; classes are weighted to the same total, and the offset is set back for it in w0."""
    rng = np.random.default_rng(seed)
    size = BUCKETS + STATISTICS * LEVELS
    m = Model(0.0, np.zeros(size), rng.normal(0, 0.02, (size, RANK)))
    y = np.array([r[2] for r in rows], float)
    if not len(rows) or y.min() == y.max():
        m.v[:] = 0
        m.w0 = 0.0 if not len(rows) else 6.0 * (2 * y[0] - 1)
        return m
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    g0, gw, gv = 1e-6, np.full(size, 1e-6), np.full((size, RANK), 1e-6)
    for _ in range(EPOCHS):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), BATCH):
            take = order[at:at + BATCH]
            x, val = np.concatenate([rows[i][0] for i in take]), np.concatenate([rows[i][1] for i in take])
            n = np.array([len(rows[i][0]) for i in take])
            starts = np.cumsum(n) - n
            s = m.v[x] * val[:, None]
            total = np.add.reduceat(s, starts)
            margin = m.w0 + np.add.reduceat(m.w[x] * val, starts) + 0.5 * ((total ** 2).sum(1) - np.add.reduceat((s ** 2).sum(1), starts))
            err = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - y[take]) * weight[take] / len(take)
            each = np.repeat(err, n) * val
            dv = each[:, None] * (np.repeat(total, n, axis=0) - s)
            used, back = np.unique(x, return_inverse=True)
            dw = np.bincount(back, each) + L2 * m.w[used]
            dv = np.stack([np.bincount(back, dv[:, f]) for f in range(RANK)], 1) + L2 * m.v[used]
            gw[used] += dw ** 2
            gv[used] += dv ** 2
            g0 += err.sum() ** 2
            m.w[used] -= RATE * dw / np.sqrt(gw[used])
            m.v[used] -= RATE * dv / np.sqrt(gv[used])
            m.w0 -= RATE * err.sum() / np.sqrt(g0)
    return m


def train(labelled: DataFrame) -> Model:
    """From a bounded number of rows (text, label 0/1), see common.labelled_sample."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [features(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([x.astype("<i4").tobytes() for x, _ in made], pa.binary()), pa.array([float(v[-1]) for _, v in made]),
                                              b.column("label")], names=["x", "value", "label"])
    got = labelled.select("text", "label").mapInArrow(run, "x binary, value double, label int").toArrow()
    out = []
    for x, value, label in zip(got["x"].to_pylist(), got["value"].to_pylist(), got["label"].to_pylist()):
        x = np.frombuffer(x, "<i4")
        values = np.full(len(x), value)
        values[:STATISTICS] = 1
        out.append((x, values, label))
    out.sort(key=lambda r: (len(r[0]), r[0].tobytes(), r[2]))  # the fit must not depend on the order of tasks
    return fit(out)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score for each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS x (RANK + 1) numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([shared.value.score(t.as_py()) for t in b.column("text")], pa.float64())], names=["doc_id", "score"])
    rows = docs.select("doc_id", "text")
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")
