"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` words, all of its words.  Each
passage has style features (shares of byte classes, repetition, word lengths and
word shapes), encoded by one hidden layer.  A gated attention, tanh(V h) times
sigmoid(U h), weighs the passages; the weighted sum of their codes is scored by a
logistic unit.  Only document labels are used, so which passage gives a document
away is learned, not told.

The fit reads about ``SAMPLE`` labelled documents of each label.  Scoring reads
every word of every document, one batch of bytes at a time.

Defined results: null and empty texts are one passage without words and are
scored like any other; without both labels in the training rows every score is
the share of label 1 among them (0.5 with no rows); null ids are scored and never
learned from; repeated rows get equal scores; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import _SPACE, chunks, text_buffers, word_hashes
from .learning import Adam, labelled_ids, segment_softmax, sigmoid
from .shared import prepare

PASSAGE = 64
#: About so many labelled documents of each label are fitted on.
SAMPLE = 3000
_HIDDEN, _GATE, _EPOCHS = 24, 12, 60

_MARKS = b".,;:!?%$&*#|/<>{}[]()=_-+@\"'"


def _byte_class() -> np.ndarray:
    kind = np.full(256, 4, dtype=np.intp)
    kind[_SPACE] = 3
    kind[97:123], kind[65:91], kind[48:58] = 0, 1, 2
    kind[128:] = 5
    for i, b in enumerate(_MARKS):
        kind[b] = 6 + i
    kind[10] = 6 + len(_MARKS)
    return kind


_KIND = _byte_class()
_KINDS = int(_KIND.max()) + 1
_SHAPES = 48
FEATURES = _KINDS + _SHAPES + 6


def passages(offsets: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of every passage, and where each document's passages begin (n + 1)."""
    words, rows = word_hashes(offsets, raw)
    n_words = np.diff(rows)
    n_pass = np.maximum(1, -(-n_words // PASSAGE))
    begins = np.concatenate(([0], np.cumsum(n_pass)))
    total = int(begins[-1])
    x = np.zeros((total, FEATURES), dtype=np.float32)
    if not len(words):
        return x, begins
    owner = np.repeat(np.arange(len(n_words)), n_words)
    passage = begins[owner] + (np.arange(len(words)) - rows[owner]) // PASSAGE
    inside = ~_SPACE[raw]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edges = offsets[:-1][offsets[:-1] < len(raw)]
    first[edges] = inside[edges]
    starts = np.flatnonzero(first)
    # a byte belongs to the passage of the last word that began; leading space to the first
    of_byte = np.repeat(passage, np.diff(np.append(starts, len(raw))))
    kinds = _KIND[raw[starts[0] :]]
    counts = np.bincount(of_byte * _KINDS + kinds, minlength=total * _KINDS).reshape(total, _KINDS)
    size = np.maximum(1, counts.sum(axis=1, keepdims=True))
    x[:, :_KINDS] = np.sqrt(counts / size)
    ends = np.append(np.flatnonzero(inside[:-1] & (~inside[1:] | first[1:])), np.flatnonzero(inside[-1:]) + len(raw) - 1)
    length = ends - starts + 1
    k1, k2 = np.minimum(_KIND[raw[starts]], 6), np.minimum(_KIND[raw[ends]], 6)
    shape = (k1 * 7 + k2) * 3 + np.digitize(length, (4, 12))
    shape = (shape * 2654435761 % 2**32) % _SHAPES
    per = np.maximum(1, np.bincount(passage, minlength=total)).astype(np.float32)
    x[:, _KINDS : _KINDS + _SHAPES] = np.sqrt(np.bincount(passage * _SHAPES + shape, minlength=total * _SHAPES).reshape(total, _SHAPES) / per[:, None])
    again = np.zeros(len(words), dtype=np.float32)
    again[1:] = (words[1:] == words[:-1]) & (passage[1:] == passage[:-1])
    order = np.lexsort((words, passage))
    same = np.zeros(len(words), dtype=np.float32)
    same[1:] = (words[order][1:] == words[order][:-1]) & (passage[order][1:] == passage[order][:-1])
    x[:, -6] = np.bincount(passage, again, total) / per
    x[:, -5] = np.bincount(passage[order], same, total) / per
    x[:, -4] = np.log1p(np.bincount(passage, length, total) / per) / 3
    x[:, -3] = np.log1p(per) / 5
    x[:, -2] = np.minimum(1, np.log1p(np.bincount(passage, length > 20, total)) / 3)
    x[:, -1] = np.log1p(n_words[np.repeat(np.arange(len(n_words)), n_pass)]) / 8
    return x, begins


class AttentionMil:
    """Gated attention over passage codes; ``fit`` on bags, ``score`` per bag."""

    def __init__(self, seed: int = 5):
        g = np.random.default_rng(seed)
        w = lambda a, b: (g.standard_normal((a, b)) / np.sqrt(a)).astype(np.float32)
        self.mean, self.scale = np.zeros(FEATURES, np.float32), np.ones(FEATURES, np.float32)
        self.p = {"w": w(FEATURES, _HIDDEN), "b": np.zeros(_HIDDEN, np.float32), "v": w(_HIDDEN, _GATE), "u": w(_HIDDEN, _GATE), "a": w(_GATE, 1), "o": w(_HIDDEN, 1), "c": np.zeros(1, np.float32)}
        self.constant: float | None = 0.5

    def _forward(self, x: np.ndarray, begins: np.ndarray):
        p = self.p
        owner, starts = np.repeat(np.arange(len(begins) - 1), np.diff(begins)), begins[:-1]
        x = np.clip((x - self.mean) / self.scale, -6, 6)
        h = np.tanh(x @ p["w"] + p["b"])
        t, s = np.tanh(h @ p["v"]), sigmoid(h @ p["u"])
        a = segment_softmax(((t * s) @ p["a"])[:, 0], starts, owner)
        z = np.add.reduceat(a[:, None] * h, starts, axis=0)
        return x, owner, starts, h, t, s, a, z, (z @ p["o"])[:, 0] + p["c"][0]

    def score(self, x: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """Probability of label 1 of each bag."""
        if self.constant is not None:
            return np.full(len(begins) - 1, self.constant)
        return sigmoid(self._forward(x, begins)[-1].astype(np.float64))

    def fit(self, bags: list[np.ndarray], y: np.ndarray, seed: int = 6) -> AttentionMil:
        if len(y) == 0 or y.min() == y.max():
            self.constant = float(y.mean()) if len(y) else 0.5
            return self
        self.constant = None
        everything = np.concatenate(bags)
        self.mean, self.scale = everything.mean(axis=0), np.maximum(everything.std(axis=0), 0.02)
        adam, g, p = Adam(self.p, 0.006), np.random.default_rng(seed), self.p
        sizes = np.array([len(b) for b in bags])
        epochs = max(12, min(_EPOCHS, int(80_000 / len(y))))
        for _ in range(epochs):
            for part in np.array_split(g.permutation(len(y)), max(1, len(y) // 64)):
                begins = np.concatenate(([0], np.cumsum(sizes[part])))
                x, owner, starts, h, t, s, a, z, out = self._forward(np.concatenate([bags[i] for i in part]), begins)
                d = ((sigmoid(out) - y[part]) / len(part)).astype(np.float32)
                dz = d[:, None] @ p["o"].T
                dh = a[:, None] * dz[owner]
                da = (h * dz[owner]).sum(axis=1)
                de = a * (da - np.add.reduceat(a * da, starts)[owner])
                dg = de[:, None] @ p["a"].T
                dt, ds = dg * s * (1 - t * t), dg * t * s * (1 - s)
                dh += dt @ p["v"].T + ds @ p["u"].T
                dx = dh * (1 - h * h)
                adam.step({"w": x.T @ dx + 1e-4 * p["w"], "b": dx.sum(0), "v": h.T @ dt, "u": h.T @ ds, "a": (t * s).T @ de[:, None], "o": z.T @ d[:, None] + 1e-4 * p["o"], "c": np.array([d.sum()])})
        return self


def _batches(batches, column: int):
    """(batch, lo, hi, features, begins) over whole texts, some bytes at a time."""
    for batch in batches:
        offsets, raw = text_buffers(batch.column(column))
        for lo, hi in chunks(offsets):
            yield batch, lo, hi, *passages(offsets[lo : hi + 1] - offsets[lo], raw[offsets[lo] : offsets[hi]])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> AttentionMil:
    """Fit on ``labels`` (doc_id, label 0 or 1 in ``quality``); features are made on the executors."""
    prepare(docs.sparkSession)
    ids = labelled_ids(labels, "quality", sample)
    texts = docs.select("doc_id", F.col("text").cast("string")).join(F.broadcast(ids), "doc_id").select("doc_id", "label", "text")

    def run(batches):
        for batch, lo, hi, x, begins in _batches(batches, 2):
            rows = [x[a:b].tobytes() for a, b in zip(begins[:-1], begins[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], batch.column(1)[lo:hi], pa.array(rows, pa.binary())], names=["doc_id", "label", "x"])

    rows = sorted(texts.mapInArrow(run, "doc_id long, label int, x binary").collect(), key=lambda r: (r["doc_id"], r["x"]))
    bags = [np.frombuffer(r["x"], dtype=np.float32).reshape(-1, FEATURES) for r in rows]
    return AttentionMil().fit(bags, np.array([r["label"] for r in rows], dtype=np.float32))


def score_quality(docs: DataFrame, model: AttentionMil) -> DataFrame:
    """doc_id and score (0 to 1) of every whole text."""
    prepare(docs.sparkSession)

    def run(batches):
        for batch, lo, hi, x, begins in _batches(batches, 1):
            yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], pa.array(model.score(x, begins).astype(np.float64))], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double")
