"""Quality: random-indexing word vectors, pooled for a document, then a two-layer network with a temperature.

Every token has a sparse random index vector that follows from its hash. A word's vector is the sum of the index
vectors of its neighbours over the training sample, scaled to length one and added to its own; words outside the
vocabulary have their index vector. A document's vector is the mean over its tokens: words in lower case, runs of
signs, and marks for shape (capitals, a repeated word, signs in a row). A network of one hidden layer reads it, and
a temperature fitted on a part set aside makes its outputs probabilities. Sample: at most ``SAMPLE`` labelled
documents, never of the held-out fifth. Every text is scored whole; label, language, source and id are no inputs.

Nulls: a null text is an empty one and is scored as such; a null id counts as held out. Without labels every
score is the same. Repeated rows keep their rows. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import is_held_out, labelled_sample, map_arrow, whole_text, written

#: Bounds: labelled documents in the sample, words with a learnt vector, slots for the others; numbers in a vector.
SAMPLE, VOCABULARY, SLOTS, DIM = 12_000, 4096, 4096, 64
_TOKEN = re.compile(r"[^\W_]+|[^\w\s]+|_+")
REACH, NONZERO = 2, 6


def tokens(text: str) -> list[str]:
    found = _TOKEN.findall(text)
    out, last = [], ""
    for t in found:
        low = t.lower()
        out.append(low)
        if t.isupper() and len(t) > 1:
            out.append("\x01caps")
        if low == last:
            out.append("\x01again")
        if not t[0].isalnum() and len(t) > 1:
            out.append("\x01signs")
        last = low
    return out


def index_vectors(n: int, seed: int) -> np.ndarray:
    """n sparse vectors of NONZERO entries of +1 or -1."""
    rng = np.random.default_rng(seed)
    out = np.zeros((n, DIM), np.float32)
    for k in range(NONZERO):
        np.add.at(out, (np.arange(n), rng.integers(0, DIM, n)), rng.choice(np.array([-1, 1], np.float32), n))
    return out


@dataclass
class Words:
    ids: dict[str, int]  # bounded by VOCABULARY
    vectors: np.ndarray | None = None

    def of(self, toks: list[str]) -> np.ndarray:
        ids, n = self.ids, len(self.ids)
        return np.fromiter((ids[t] if t in ids else n + crc32(t.encode()) % SLOTS for t in toks), np.int64, len(toks))

    def pooled(self, text: str) -> np.ndarray:
        toks = tokens(text)
        out = np.zeros(DIM + 2, np.float32)
        if toks:
            many = np.bincount(self.of(toks), minlength=len(self.vectors)).astype(np.float32) if len(toks) > 4000 else None
            out[:DIM] = many @ self.vectors / len(toks) if many is not None else self.vectors[self.of(toks)].mean(axis=0)
            out[DIM] = np.log1p(len(toks)) / 8
            out[DIM + 1] = len(set(toks)) / len(toks)
        return out


def _token_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        many: dict[str, int] = {}
        for t in b.column("text"):
            for w in set(tokens(t.as_py() or "")):
                many[w] = many.get(w, 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array(list(many), pa.string()), pa.array(list(many.values()), pa.int64())], names=["word", "n"])


def _contexts(words: Words):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = len(words.ids)
        index = index_vectors(v + SLOTS, 11)
        total = np.zeros((v, DIM), np.float64)
        for b in batches:
            for t in b.column("text"):
                ids = words.of(tokens(t.as_py() or ""))
                for k in range(1, REACH + 1):
                    a, z = ids[:-k], ids[k:]
                    for own, other in ((a, z), (z, a)):
                        m = own < v
                        np.add.at(total, own[m], index[other[m]])
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

    return run


def _as_pooled(words: Words):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [words.pooled(t.as_py() or "").tolist() for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("label"), pa.array(rows, pa.list_(pa.float32()))], names=["label", "f"])

    return run


@dataclass
class Network:
    shift: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.maximum((x - self.shift) / self.scale @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -35, 35)))


def train(x: np.ndarray, y: np.ndarray, hidden: int = 32, epochs: int = 40, rate: float = 3e-3, decay: float = 1e-3, seed: int = 3) -> Network:
    """Adam on the log loss in batches of 128; a fifth is set aside for the temperature."""
    rng = np.random.default_rng(seed)
    d = x.shape[1]
    net = Network(np.zeros(d), np.ones(d), rng.normal(0, (2 / d) ** 0.5, (d, hidden)), np.zeros(hidden), rng.normal(0, (1 / hidden) ** 0.5, hidden), 0.0)
    if not len(y) or y.min() == y.max():
        net.w2[:] = 0
        net.b2 = float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))) if len(y) else 0.0
        return net
    aside = rng.random(len(y)) < 0.2
    xt, yt, xa, ya = x[~aside], y[~aside], x[aside], y[aside]
    net.shift, net.scale = xt.mean(axis=0), xt.std(axis=0) + 1e-6
    xt = (xt - net.shift) / net.scale
    b2 = np.zeros(1)
    held = [net.w1, net.b1, net.w2, b2]
    mean, square, step = [np.zeros_like(p) for p in held], [np.zeros_like(p) for p in held], 0
    for _ in range(epochs):
        order = rng.permutation(len(yt))
        for k in range(0, len(order), 128):
            rows = order[k : k + 128]
            z = xt[rows] @ net.w1 + net.b1
            a = np.maximum(z, 0)
            p = 1 / (1 + np.exp(-np.clip(a @ net.w2 + b2, -35, 35)))
            g = (p - yt[rows]) / len(rows)
            back = np.outer(g, net.w2) * (z > 0)
            step += 1
            for i, (q, dq) in enumerate(zip(held, (xt[rows].T @ back + decay * net.w1, back.sum(axis=0), a.T @ g + decay * net.w2, np.array([g.sum()])), strict=True)):
                mean[i] = 0.9 * mean[i] + 0.1 * dq
                square[i] = 0.999 * square[i] + 0.001 * dq * dq
                q -= rate * (mean[i] / (1 - 0.9**step)) / (np.sqrt(square[i] / (1 - 0.999**step)) + 1e-8)
    net.b2 = float(b2[0])
    if len(ya):
        logit = net.logits(xa)
        loss = lambda t: np.mean(np.logaddexp(0, logit / t) - ya * logit / t)
        net.temperature = float(min(np.geomspace(0.3, 10, 60), key=loss))
    return net


def fit(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE) -> tuple[Words, Network]:
    sample = written(labelled_sample(docs, labels, "quality", bound).repartition(12, "doc_id"), "sample")
    texts = sample.select("text", "label")
    many = map_arrow(texts.select("text"), _token_rows, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    top = many.where("n > 1").orderBy(F.desc("n"), "word").limit(VOCABULARY).collect()
    words = Words({r.word: i for i, r in enumerate(top)})
    sums = map_arrow(texts.select("text").coalesce(4), _contexts(words), "sums binary").collect()  # a matrix of VOCABULARY rows for each of 4 tasks
    total = sum((np.frombuffer(r.sums).reshape(-1, DIM) for r in sums), np.zeros((len(words.ids), DIM)))
    index = index_vectors(len(words.ids) + SLOTS, 11)
    index /= NONZERO**0.5
    length = np.linalg.norm(total, axis=1, keepdims=True)
    index[: len(words.ids)] += (total / np.maximum(length, 1e-9)).astype(np.float32)
    words.vectors = index
    rows = map_arrow(texts, _as_pooled(words), "label int, f array<float>").collect()  # `bound` rows of DIM + 2 numbers
    rows.sort(key=lambda r: (r.f, r.label))
    x, y = np.array([r.f for r in rows], float).reshape(-1, DIM + 2), np.array([r.label for r in rows], float)
    return words, train(x, y)


def _scored(words: Words, net: Network):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([words.pooled(t.as_py() or "") for t in b.column("text")], float).reshape(-1, DIM + 2)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(net.score(x))], names=["doc_id", "held_out", "score"])

    return run


def scores(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE, cut: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of ``docs``; predicted is 1 from a score of ``cut``."""
    model = fit(docs, labels, bound)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), is_held_out().alias("held_out"), whole_text().alias("text"))
    return map_arrow(own, _scored(*model), "doc_id long, held_out boolean, score double").withColumn("predicted", (F.col("score") >= cut).cast("int"))
