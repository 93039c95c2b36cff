"""Quality classifier: attention-based multiple-instance learning over a document's passages.

A document is a bag of passages that cover its whole text, as many as it has. Each passage is encoded; gated attention,
learnt from labels of documents alone, weighs the encodings; the weighted sum is scored.

Defined results: an empty or null text is one passage without words and gets the score learnt for such; without
labelled documents every score is 0.5; of rows that share a doc_id one text and one label are learnt from; an empty table gives no rows; repeated rows get the same result; a null doc_id is not held out;
of the documents' columns only doc_id and text are read, and a score comes from the text alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftmine.llm.arrow import slices, utf8
from weftmine.llm.shingles import words

PASSAGE = 512
#: Labelled documents to learn from at most, chosen by a hash of their ids, and passages of each, spread evenly over it: 4000 * 64 * 174 numbers,
#: 178 MB, reach the driver at most. Scores look at all passages.
SAMPLE, LEARNT = 4000, 64
#: Passages encoded at a time.
STEP = 4096
THRESHOLD = 0.7

_KINDS = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " ", "\n\r\t", ".", ",;:", "!?", "|", "#$%&*@^~+=<>\\`", "'\"()[]{}-_/")
_KIND = np.zeros(256, np.int64)
for _i, _chars in enumerate(_KINDS, 1):
    _KIND[[*_chars.encode()]] = _i
_KIND[128:] = len(_KINDS) + 1
_N = len(_KINDS) + 2
#: Kinds of bytes, pairs of them, words like the one before or two before, and lengths.
FEATURES = _N + _N * _N + 5


def passages(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of all texts' passages, and where each text's begin and the last's end. Each text has one at least."""
    edges, whole, begins = cuts(offsets)
    return described(data, edges, whole), begins


def cuts(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where passages begin and the last ends, the length of each one's text, and the number of passages before each text."""
    size = np.diff(offsets)
    count = np.maximum(-(-size // PASSAGE), 1)
    begins = np.concatenate([[0], np.cumsum(count)])
    text = np.repeat(np.arange(len(size)), count)
    k = np.arange(begins[-1]) - begins[text]
    edges = offsets[text] + k * size[text] // count[text]
    return np.concatenate([edges, offsets[-1:]]), size[text], begins


def described(data: np.ndarray, edges: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """Features of passages between ``edges``, each looked at by itself but for the length of its whole text."""
    length = np.diff(edges)
    data, edges = data[edges[0] : edges[-1]], edges - edges[0]
    out = np.zeros((len(length), FEATURES), np.float32)
    if len(data):
        place = np.repeat(np.arange(len(length)), length)
        kind = _KIND[data]
        n = np.maximum(length, 1)[:, None]
        out[:, :_N] = np.bincount(place * _N + kind, minlength=len(length) * _N).reshape(-1, _N) / n
        pair = place[1:] * (_N * _N) + kind[:-1] * _N + kind[1:]
        pair = pair[place[1:] == place[:-1]]
        out[:, _N : _N + _N * _N] = np.bincount(pair, minlength=len(length) * _N * _N).reshape(len(length), -1) / n
        _, starts, _, hashes, _ = words(data, edges)
        if len(starts):
            its = place[starts]
            total = np.maximum(np.bincount(its, minlength=len(length)), 1)
            for back in (1, 2):
                same = its[back:][(hashes[back:] == hashes[:-back]) & (its[back:] == its[:-back])]
                out[:, -6 + back] = np.bincount(same, minlength=len(length)) / total
            out[:, -3] = total / n[:, 0]
    out[:, -2] = np.log1p(length)
    out[:, -1] = np.log1p(whole)
    return out


class Model(NamedTuple):
    """Weights of the encoder, of the two sides of the gate, of attention and of the score."""

    mean: np.ndarray
    scale: np.ndarray
    encode: np.ndarray
    tanh: np.ndarray
    gate: np.ndarray
    attend: np.ndarray
    out: np.ndarray
    bias: np.ndarray

    def encoded(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Passages' features as the encoder takes them, and encodings."""
        x = np.clip((x - self.mean) / self.scale, -8, 8)
        return x, np.tanh(np.concatenate([x, np.ones((len(x), 1), x.dtype)], 1) @ self.encode)

    def attended(self, h: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, ...]:
        t, g = np.tanh(h @ self.tanh), 1 / (1 + np.exp(-(h @ self.gate)))
        raw = (t * g) @ self.attend
        at, n = begins[:-1], np.diff(begins)
        weight = np.exp(raw - np.repeat(np.maximum.reduceat(raw, at), n))
        weight /= np.repeat(np.add.reduceat(weight, at), n)
        whole = np.add.reduceat(weight[:, None] * h, at)
        score = 1 / (1 + np.exp(-np.clip(whole @ self.out + self.bias[0], -30, 30)))
        return score, whole, weight, t, g

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Scores of whole texts. Features take more room than text, so that they are made for a few passages at a time."""
        edges, whole, begins = cuts(offsets)
        parts = [self.encoded(described(data, edges[i : i + STEP + 1], whole[i : i + STEP]))[1] for i in range(0, len(whole), STEP)]
        return self.attended(np.concatenate(parts), begins)[0] if parts else np.zeros(0)

    def gradients(self, x: np.ndarray, begins: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        """Of the documents' mean cross entropy, by each of the weights from ``encode`` on."""
        x, h = self.encoded(x)
        score, whole, a, t, g = self.attended(h, begins)
        sizes, at = np.diff(begins), begins[:-1]
        error = ((score - y) / len(y)).astype(h.dtype)
        back = np.repeat(error, sizes)[:, None] * self.out  # of the loss by the document's encoding
        by_a = (back * h).sum(1)
        by_raw = a * (by_a - np.repeat(np.add.reduceat(a * by_a, at), sizes))
        by_t, by_g = by_raw[:, None] * self.attend * g * (1 - t * t), by_raw[:, None] * self.attend * t * g * (1 - g)
        by_h = (a[:, None] * back + by_t @ self.tanh.T + by_g @ self.gate.T) * (1 - h * h)
        with_one = np.concatenate([x, np.ones((len(x), 1), x.dtype)], 1)
        return [with_one.T @ by_h, h.T @ by_t, h.T @ by_g, (t * g).T @ by_raw, whole.T @ error, error.sum(keepdims=True)]


def train(x: np.ndarray, begins: np.ndarray, y: np.ndarray, *, width: int = 24, gate: int = 12, epochs: int = 40, batch: int = 64, rate: float = 0.004, decay: float = 1e-4, seed: int = 1) -> Model:
    """Fit to documents' labels y (0 or 1) by Adam on the cross entropy."""
    r = np.random.default_rng(seed)
    n, d = len(y), x.shape[1]
    normal = lambda *shape: (r.normal(size=shape) / np.sqrt(shape[0])).astype(np.float32)
    weights = [normal(d + 1, width), normal(width, gate), normal(width, gate), normal(gate), normal(width), np.zeros(1, np.float32)]
    if not n:
        weights[4][:] = 0
        return Model(np.zeros(d, np.float32), np.ones(d, np.float32), *weights)
    fixed = (x.mean(0), x.std(0) + 0.01 * max(float(x.std()), 1e-3))
    if len(np.unique(y)) < 2:
        weights[4][:] = 0
        weights[5][0] = np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3))
        return Model(*fixed, *weights)
    moments = [(np.zeros_like(w), np.zeros_like(w)) for w in weights]
    step = 0
    for epoch in range(epochs):
        order = r.permutation(n)
        for i in range(0, n, batch):
            docs = order[i : i + batch]
            sizes = begins[docs + 1] - begins[docs]
            at = np.concatenate([[0], np.cumsum(sizes)])
            rows = np.arange(at[-1]) + np.repeat(begins[docs] - at[:-1], sizes)
            grads = Model(*fixed, *weights).gradients(x[rows], at, y[docs])
            step += 1
            now = rate * (1 - epoch / epochs)
            for w, gr, (m1, m2) in zip(weights, grads, moments, strict=True):
                gr = gr + decay * w
                m1 += 0.1 * (gr - m1)
                m2 += 0.001 * (gr * gr - m2)
                w -= (now * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return Model(*fixed, *weights)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, learnt: int = LEARNT) -> Model:
    """A model from the labelled documents that are not held out, ``sample`` of them and ``learnt`` passages of each at most. These, one row for each document, go to the driver."""
    rows = labels.filter(~held_out(F.col("doc_id")) & F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
    rows = rows.groupBy(F.col("doc_id").alias("__doc")).agg(F.min("quality").alias("__label"))
    rows = rows.orderBy(F.xxhash64("__doc"), "__doc").limit(sample)
    found = docs.select("doc_id", "text").join(F.broadcast(rows), F.col("doc_id") == F.col("__doc"))
    found = found.groupBy("doc_id", "__label").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            x, begins = passages(*utf8(batch.column("text")))
            bag = [x[a + np.arange(min(b - a, learnt)) * (b - a) // min(b - a, learnt)].tobytes() for a, b in zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("__label").cast(pa.int32()), pa.array(bag, pa.binary())], names=["doc_id", "label", "bag"])

    got = sorted(map(tuple, found.mapInArrow(bags, "doc_id long, label int, bag binary").collect()))
    bag = [np.frombuffer(b, np.float32).reshape(-1, FEATURES) for _, _, b in got]
    begins = np.cumsum([0, *map(len, bag)])
    return train(np.concatenate([np.zeros((0, FEATURES), np.float32), *bag]), begins, np.array([y > 0 for _, y, _ in got], np.float32))


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 19):
            scores = model.score(*utf8(batch.column("text"))).astype(np.float64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(scores), pa.array((scores >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(rows, "doc_id long, held_out boolean, score double, predicted int")


def keep(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The documents with a score of ``threshold`` or more, with their own columns."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 19):
            scores = model.score(*utf8(batch.column("text")))
            yield batch.filter(pa.array(scores.astype(np.float64) >= threshold))

    return docs.mapInArrow(rows, docs.schema)
