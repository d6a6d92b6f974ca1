"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata of the text.

score = sigmoid(w0 + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j); the pairwise term is computed in
linear time as half of sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2). Inputs are hashed lower-cased
words (weighted 1 + ln of their count, of unit length together) and statistics of the text: shares of
symbols, upper case, digits, bars, repeated words and lines, mean word length, length. Labels,
language, source and id are never inputs.

Training takes labelled rows outside the held-out fold, at most sample_rows of them: those with the smallest hash
of their id, which is a fixed sample. Features are made on executors; the driver holds the bounded
sample and runs AdaGrad over seeded mini batches. Scoring reads every text in full.

Defined cases: null and empty texts get a score from their statistics alone; rows with a null label
or id are not trained on; several labels of one id count as their minimum; without labels of both classes
the score is the share of label 1 (0.5 without any); repeated rows each get a row; an empty table gives an empty result; extra columns are ignored, and kept by keep_good().
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillfern.llm.common import id_and_text, text_slices

N_STATS = 10
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
UPPER_BYTES, DIGIT_BYTES, SYMBOL_BYTES = bytes(range(65, 91)), bytes(range(48, 58)), b"#*$%&<>"


@dataclass
class Machine:
    """Weights of a factorisation machine with 2**bits hashed words before the statistics."""

    bits: int
    w0: float
    w: np.ndarray
    v: np.ndarray
    constant: float | None = None
    history: list[float] = field(default_factory=list)


def statistics(raw: bytes, words: list[bytes], counts: Counter) -> list[float]:
    n = max(1, len(raw))
    lines = raw.split(b"\n")
    share = lambda chars: (n - len(raw.translate(None, chars))) / n if raw else 0.0
    return [
        1.0,
        min(1.0, 10 * share(SYMBOL_BYTES)),
        share(UPPER_BYTES),
        min(1.0, 10 * share(DIGIT_BYTES)),
        min(1.0, 10 * share(b"|")),
        min(1.0, 10 * share(b"!")),
        1 - len(counts) / max(1, len(words)),
        1 - len(set(lines)) / max(1, len(lines)),
        min(1.0, len(raw) / max(1, len(words)) / 20),
        min(1.0, np.log1p(len(words)) / 12),
    ]


def features(text: str, bits: int, memo: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct indices and their values; the last N_STATS are statistics. memo: hashes of words, bounded by its owner."""
    raw = text.encode()
    words = raw.translate(LOWER).split()
    counts = Counter(words)
    mask = (1 << bits) - 1
    at = []
    for w in counts:
        k = memo.get(w)
        if k is None:
            k = memo[w] = zlib.crc32(w) & mask
        at.append(k)
    stats = np.array(statistics(raw, words, counts), np.float32)
    if not at:
        return np.arange(1 << bits, (1 << bits) + N_STATS, dtype=np.int32), stats
    value = 1 + np.log(np.fromiter(counts.values(), np.float32, len(at)))
    index = np.array(at, np.int32)
    order = np.argsort(index, kind="stable")
    index, value = index[order], value[order]
    first = np.flatnonzero(np.concatenate(([True], index[1:] != index[:-1])))
    index, value = index[first], np.add.reduceat(value, first)
    value /= np.linalg.norm(value)
    return np.concatenate((index, np.arange(1 << bits, (1 << bits) + N_STATS, dtype=np.int32))), np.concatenate((value, stats))


def raw_scores(m: Machine, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The margin of each row, by the sum-of-squares identity."""
    index, value = np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows])
    start = np.cumsum([0, *(len(r[0]) for r in rows[:-1])])
    vx = m.v[index] * value[:, None]
    sums, squares = np.add.reduceat(vx, start), np.add.reduceat(vx * vx, start)
    return m.w0 + np.add.reduceat(m.w[index] * value, start) + 0.5 * (sums * sums - squares).sum(1)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def train(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, bits: int = 16, rank: int = 6, epochs: int = 6, rate: float = 0.1, l2: float = 1e-5, seed: int = 11) -> Machine:
    """AdaGrad on the logistic loss; both classes weigh the same in the gradient."""
    size = (1 << bits) + N_STATS
    rng = np.random.default_rng(seed)
    m = Machine(bits, 0.0, np.zeros(size, np.float32), rng.normal(0, 0.02, (size, rank)).astype(np.float32))
    if not len(y) or y.min() == y.max():
        m.constant = float(y.mean()) if len(y) else 0.5
        return m
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())).astype(np.float32)
    gw, gv, g0 = np.full(size, 1e-6, np.float32), np.full((size, rank), 1e-6, np.float32), 1e-6
    for _ in range(epochs):
        loss, order = 0.0, rng.permutation(len(y))
        for k in range(0, len(order), 128):
            pick = order[k : k + 128]
            batch = [rows[i] for i in pick]
            index, value = np.concatenate([r[0] for r in batch]), np.concatenate([r[1] for r in batch])
            owner = np.repeat(np.arange(len(batch)), [len(r[0]) for r in batch])
            start = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
            vx = m.v[index] * value[:, None]
            sums = np.add.reduceat(vx, start)
            z = m.w0 + np.add.reduceat(m.w[index] * value, start) + 0.5 * (sums * sums - np.add.reduceat(vx * vx, start)).sum(1)
            p = sigmoid(z)
            g = ((p - y[pick]) * weight[pick] / len(batch)).astype(np.float32)
            loss -= float(np.sum(weight[pick] * np.log(np.where(y[pick] == 1, p, 1 - p) + 1e-12)))
            touched, back = np.unique(index, return_inverse=True)
            scale = (g[owner] * value)[:, None]
            dv = np.zeros((len(touched), rank), np.float32)
            np.add.at(dv, back, scale * (sums[owner] - vx))
            dw = np.bincount(back, scale[:, 0], len(touched)).astype(np.float32)
            dw += l2 * m.w[touched]
            dv += l2 * m.v[touched]
            gw[touched] += dw * dw
            gv[touched] += dv * dv
            g0 += float(g.sum()) ** 2
            m.w[touched] -= rate * dw / np.sqrt(gw[touched])
            m.v[touched] -= rate * dv / np.sqrt(gv[touched])
            m.w0 -= rate * float(g.sum()) / np.sqrt(g0)
        m.history.append(loss / len(y))
    return m


def _featured(bits: int):
    def each(batches):
        import pyarrow as pa

        memo: dict[bytes, int] = {}
        for batch in batches:
            rest = batch.column(2)
            done = 0
            for ids, texts in text_slices([batch]):
                if len(memo) > 500_000:
                    memo.clear()
                got = [features(t, bits, memo) for t in texts]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([g[0] for g in got], pa.list_(pa.int32())), pa.array([g[1] for g in got], pa.list_(pa.float32())), rest.slice(done, len(ids))], ["doc_id", "index", "value", "y"])
                done += len(ids)

    return each


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", sample_rows: int = 6000, bits: int = 16, rank: int = 6) -> Machine:
    """Trains on at most sample_rows labelled rows outside the held-out fold (crc32(doc_id as text) mod 5 = 0)."""
    y = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where("doc_id is not null and y is not null and crc32(cast(doc_id as string)) % 5 <> 0")
    y = y.groupBy("doc_id").agg(F.min("y").alias("y"))
    # The sample is chosen among labels, before any text is touched: a bounded table that may be broadcast.
    chosen = y.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    sample = id_and_text(docs, doc_id, text).join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"])
    got = sample.select("doc_id", "text", "y").mapInArrow(_featured(bits), "doc_id long, index array<int>, value array<float>, y int").orderBy("doc_id").toArrow()
    rows = [(i.values.to_numpy(), v.values.to_numpy()) for i, v in zip(got["index"], got["value"], strict=True)]
    return train(rows, got["y"].to_numpy().astype(np.float32), bits, rank)


def score(docs: DataFrame, machine: Machine, doc_id: str = "doc_id", text: str = "text", threshold: float = 0.3) -> DataFrame:
    """doc_id, score, predicted of every row. The broadcast machine has a fixed size: 2**bits * (rank + 1) floats."""
    held = docs.sparkSession.sparkContext.broadcast(machine)

    def each(batches):
        import pyarrow as pa

        m = held.value
        memo: dict[bytes, int] = {}
        for ids, texts in text_slices(batches, 2_000_000):
            if len(memo) > 500_000:
                memo.clear()
            if m.constant is not None:
                p = np.full(len(ids), m.constant)
            else:
                p = sigmoid(raw_scores(m, [features(t, m.bits, memo) for t in texts])).astype(np.float64)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(p), pa.array((p >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    return id_and_text(docs, doc_id, text).mapInArrow(each, "doc_id long, score double, predicted int")


def keep_good(docs: DataFrame, machine: Machine, text: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows of docs, all columns, whose text scores at least the threshold; no shuffle."""
    held = docs.sparkSession.sparkContext.broadcast(machine)
    at = docs.columns.index(text)

    def each(batches):
        import pyarrow as pa

        m = held.value
        memo: dict[bytes, int] = {}
        for batch in batches:
            keep = []
            for _, texts in text_slices([pa.RecordBatch.from_arrays([batch.column(at), batch.column(at)], ["i", "t"])], 2_000_000):
                if len(memo) > 500_000:
                    memo.clear()
                z = np.full(len(texts), m.constant) if m.constant is not None else sigmoid(raw_scores(m, [features(t, m.bits, memo) for t in texts]))
                keep.append(z >= threshold)
            if keep:
                yield batch.filter(pa.array(np.concatenate(keep)))

    return docs.mapInArrow(each, docs.schema)
