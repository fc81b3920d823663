"""Quality classifier: a factorisation machine over hashed words, structure and size.

score = sigmoid(w0 + sum_i w_i x_i + 1/2 sum_f [(sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2])

so all pairwise interactions cost one pass over a document's features. Features
are the document's distinct words, hashed to ``BUCKETS``, with the logarithm of
their counts, scaled to unit length; and statistics of structure and size, each
as a value. Nothing but the text enters.

Labels are learned from a sample of bounded size (``max_train`` rows, chosen by
a hash of the id); scoring covers every whole text.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh32_intdigest

from .common import id_and_text, map_slices, raw_texts
from .pieces import WordMemory

BUCKETS = 1 << 16
FACTORS = 8
MAX_TRAIN = 6000
STATISTICS = 16
_UPPER = bytes(range(65, 91))
_DIGITS = b"0123456789"
_SYMBOLS = b"#*$%&|<>{}[]\\^~=_@"
_POINTS = b".,;:"
_LOUD = b"!?"


def statistics(raw: bytes, words: list[bytes], counts: Counter) -> list[float]:
    """Structure and size, each about 0 to 1."""
    n, size = max(len(words), 1), max(len(raw), 1)
    lines = raw.split(b"\n")
    share = lambda chars: (size - len(raw.translate(None, chars)) if raw else 0) / size
    common = counts.most_common(3)
    return [
        1.0,
        min(np.log1p(len(words)) / 10, 2.0),
        min(np.log1p(len(raw)) / 12, 2.0),
        min(np.log1p(len(lines)) / 6, 2.0),
        min(size / n / 10, 3.0),
        len(counts) / n,
        sum(c for _, c in common) / n,
        common[0][1] / n if common else 0.0,
        len(set(lines)) / len(lines),
        share(_UPPER),
        3 * share(_DIGITS),
        3 * share(_SYMBOLS),
        3 * share(_POINTS),
        3 * share(_LOUD),
        sum(c for w, c in counts.items() if len(w) == 1) / n,
        sum(c for w, c in counts.items() if len(w) <= 4) / n,
    ]


class Features:
    def __init__(self, buckets: int = BUCKETS):
        self.buckets = buckets
        self.bucket = WordMemory(lambda w: xxh32_intdigest(w, 7) % buckets, 300_000)

    def of(self, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Positions and values; a position occurs once, words first by position, then the statistics."""
        counts = Counter(raw.lower().split())
        stats = np.array(statistics(raw, raw.split(), counts), np.float32)
        at = np.fromiter(map(self.bucket.__getitem__, counts), np.int64, len(counts))
        value = np.log1p(np.fromiter(counts.values(), np.float64, len(counts)))
        at, where = np.unique(at, return_inverse=True)
        value = np.bincount(where, value, len(at))
        value = (value / max(float(np.sqrt((value * value).sum())), 1e-9)).astype(np.float32)
        return np.r_[at, self.buckets + np.arange(len(stats))].astype(np.int32), np.r_[value, stats]


@dataclass
class Machine:
    bias: float
    weight: np.ndarray
    factor: np.ndarray

    def _sums(self, at, value, rows):
        v = self.factor[at] * value[:, None]
        total = np.add.reduceat(v, rows)
        pair = 0.5 * (total * total - np.add.reduceat(v * v, rows)).sum(axis=1)
        return self.bias + np.add.reduceat(self.weight[at] * value, rows) + pair, total, v

    def score(self, documents: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        if not documents:
            return np.zeros(0)
        at, value, rows = _stack(documents)
        return 1 / (1 + np.exp(-np.clip(self._sums(at, value, rows)[0].astype(np.float64), -30, 30)))

    @classmethod
    def fit(cls, documents, labels, *, buckets: int = BUCKETS, factors: int = FACTORS, epochs: int = 12, rate: float = 0.1, decay: float = 1e-5, batch: int = 128, seed: int = 11) -> Machine:
        """Logistic loss, AdaGrad; deterministic for a given order of documents."""
        rnd = np.random.default_rng(seed)
        n = buckets + STATISTICS
        if not len(documents):
            return cls(0.0, np.zeros(n, np.float32), np.zeros((n, factors), np.float32))
        machine = cls(0.0, np.zeros(n, np.float32), rnd.normal(0, 0.02, (n, factors)).astype(np.float32))
        seen_w, seen_v, seen_b = np.full(n, 1e-6, np.float32), np.full((n, factors), 1e-6, np.float32), 1e-6
        order = rnd.permutation(len(documents))
        labels = np.asarray(labels, np.float32)
        batches = []
        for a in range(0, len(order), batch):
            mine = order[a : a + batch]
            at, value, rows = _stack([documents[i] for i in mine])
            by = np.argsort(at, kind="stable")
            used, first = np.unique(at[by], return_index=True)
            row = np.repeat(np.arange(len(mine)), np.diff(np.r_[rows, len(at)]))
            batches.append((at, value, rows, by, used, first, row, labels[mine]))
        for _ in range(epochs):
            for k in rnd.permutation(len(batches)):
                at, value, rows, by, used, first, row, y = batches[k]
                raw, total, v = machine._sums(at, value, rows)
                slope = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - y).astype(np.float32) / len(y)
                each = slope[row] * value
                gw = np.add.reduceat(each[by], first) + decay * machine.weight[used]
                gv = np.add.reduceat((each[:, None] * (total[row] - v))[by], first) + decay * machine.factor[used]
                gb = float(slope.sum())
                seen_w[used] += gw * gw
                seen_v[used] += gv * gv
                seen_b += gb * gb
                machine.weight[used] -= rate * gw / np.sqrt(seen_w[used])
                machine.factor[used] -= rate * gv / np.sqrt(seen_v[used])
                machine.bias -= rate * gb / np.sqrt(seen_b)
        return machine


def _stack(documents):
    size = np.array([len(d[0]) for d in documents])
    return np.concatenate([d[0] for d in documents]), np.concatenate([d[1] for d in documents]), np.cumsum(size) - size


def held_out(id_col) -> F.Column:
    """True where the CRC-32 of the id as text leaves 1 when divided by 3; no label of such a row is learned."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit(""))) % 3 == 1


def fit_quality(docs: DataFrame, labels: DataFrame, *, label_col: str = "quality", max_train: int = MAX_TRAIN, buckets: int = BUCKETS) -> Machine:
    """Learns from at most ``max_train`` labelled rows outside the held-out third.

    Rows without id or label teach nothing; of several labels of one id the
    greatest counts, of several texts the least. So the driver gets
    ``max_train`` rows at most. Without any such row every text scores 0.5.
    """
    known = labels.select(labels["doc_id"].cast("long").alias("label_id"), labels[label_col].cast("int").alias("label")).filter("label_id is not null and label is not null")
    known = known.filter(~held_out(F.col("label_id"))).groupBy("label_id").agg(F.max("label").alias("label"))
    sample = known.orderBy(F.xxhash64("label_id"), "label_id").limit(max_train)
    rows = id_and_text(docs).join(F.broadcast(sample), F.col("doc_id") == F.col("label_id")).groupBy("doc_id").agg(F.max("label").alias("label"), F.min("text").alias("text"))

    def make():
        features = Features(buckets)

        def step(part: pa.RecordBatch) -> pa.RecordBatch:
            found = [features.of(t) for t in raw_texts(part["text"])]
            packed = [pa.array([f[k].astype(kind).tobytes() for f in found], pa.binary()) for k, kind in ((0, "<i4"), (1, "<f4"))]
            return pa.RecordBatch.from_arrays([part["doc_id"], part["label"], *packed], names=["doc_id", "label", "at", "value"])

        return step

    table = map_slices(rows, make, "doc_id long, label int, at binary, value binary").toArrow().sort_by([("doc_id", "ascending"), ("at", "ascending")])
    documents = [(np.frombuffer(a, "<i4"), np.frombuffer(v, "<f4")) for a, v in zip(table["at"].to_pylist(), table["value"].to_pylist(), strict=True)]
    return Machine.fit(documents, table["label"].to_numpy(), buckets=buckets)


def score_quality(docs: DataFrame, machine: Machine, *, buckets: int = BUCKETS) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for each row; null texts score as empty ones, repeated rows alike."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)  # its size is that of the tables, whatever the input

    def make():
        features, model = Features(buckets), shared.value

        def step(part: pa.RecordBatch) -> pa.RecordBatch:
            scores = model.score([features.of(t) for t in raw_texts(part["text"])])
            return pa.RecordBatch.from_arrays([part["doc_id"], pa.array(scores, pa.float64())], names=["doc_id", "score"])

        return step

    scored = map_slices(id_and_text(docs), make, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
