"""Quality scores: random-indexing word vectors, pooled per document, under a two-layer network.

Each word has a sparse ternary index vector, drawn from its hash; its word vector is the
sum of its neighbours' index vectors over the training texts. Rare and unseen words share
the vector of their shape (letters, capitals, digits and signs, runs collapsed). A document
is the mean of its words' vectors, the mean over distinct words, and three numbers about
repetition and length. The network's logits are divided by a temperature, fitted on a part
of the training rows that the network hasn't seen.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from . import wordgrams as wg
from .decontaminate import Keys
from .shared import held_out
from .toxicity import sigmoid

DIMS, WINDOW, NONZERO = 48, 2, 4
MIN_COUNT, MOST_WORDS = 3, 50_000

#: Each byte's class: lower case and non-ASCII letters, capitals, digits, or the sign itself.
CLASS = np.arange(256, dtype=np.uint8)
CLASS[97:123] = 97
CLASS[128:] = 97
CLASS[65:91] = 65
CLASS[48:58] = 48


def tokens(texts: pa.Array) -> tuple[tk.Words, np.ndarray, np.ndarray]:
    """Words with their hashes and their shapes' hashes."""
    data, off = tk.buffer_of(texts)
    w = tk.Words(data, off, tk.SPACED)
    h = tk.span_hashes(data, w.start, w.end)
    kind = CLASS[data]
    keep = np.ones(len(data), bool)
    keep[1:] = kind[1:] != kind[:-1]
    keep[w.start] = True
    keep &= tk.SPACED[data]
    before = np.concatenate([[0], np.cumsum(keep)])
    short = kind[keep]
    return w, h, tk.span_hashes(short, before[w.start], before[w.end]) if len(short) else h


class Vectors:
    """Word vectors by hash; at 0 the vector of what is unknown in word and shape."""

    def __init__(self, w: tk.Words, h: np.ndarray, shape: np.ndarray):
        kinds, n = np.unique(h, return_counts=True)
        often = np.argsort(-n, kind="stable")[:MOST_WORDS]
        often = often[n[often] >= MIN_COUNT]
        self.words, self.shapes = Keys(kinds[often]), Keys(shape)
        size = 1 + len(self.words.keys) + len(self.shapes.keys)
        names = np.concatenate([np.zeros(1, tk.U), self.words.keys, self.shapes.keys])
        index = np.zeros((size, DIMS))
        for j in range(NONZERO):
            x = tk.mix(names + tk.U((j + 1) * int(tk.BASE) % (1 << 64)))
            index[np.arange(size), (x >> tk.U(8)) % tk.U(DIMS)] += np.where(x & tk.U(1), 1.0, -1.0)
        ids, shape_ids, doc = self.ids(h, np.zeros_like(h)), self.ids(np.zeros_like(h), shape), w.doc
        vectors = np.zeros((size, DIMS))
        # a word's neighbours teach its own vector and that of its shape
        for own in (np.where(ids == 0, shape_ids, ids), shape_ids):
            for step in range(1, WINDOW + 1):
                at = np.flatnonzero(doc[step:] == doc[:-step])
                for a, b in ((at, at + step), (at + step, at)):
                    for k in range(DIMS):
                        vectors[:, k] += np.bincount(own[a], index[np.where(ids == 0, shape_ids, ids)[b], k], size)
        length = np.linalg.norm(vectors, axis=1, keepdims=True)
        # some of its own index vector tells apart words with like neighbours
        self.vectors = (vectors / np.maximum(length, 1e-9) + index / np.maximum(np.linalg.norm(index, axis=1, keepdims=True), 1e-9)).astype(np.float32)

    def ids(self, h: np.ndarray, shape: np.ndarray) -> np.ndarray:
        out = np.zeros(len(h), np.int64)
        at, k = self.shapes.find(shape)
        out[at] = 1 + len(self.words.keys) + k
        at, k = self.words.find(h)
        out[at] = 1 + k
        return out

    def pooled(self, w: tk.Words, h: np.ndarray, shape: np.ndarray) -> np.ndarray:
        n_docs, n = len(w.first) - 1, np.maximum(w.counts, 1)
        out = np.zeros((n_docs, 2 * DIMS + 3))
        doc = w.doc
        d, i, often = wg.pairs(doc, self.ids(h, shape), len(self.vectors))
        if len(d):
            own, starts = np.unique(d, return_index=True)
            v = self.vectors[i]
            out[own, :DIMS] = np.add.reduceat(v * often[:, None].astype(np.float32), starts) / n[own, None]
            out[own, DIMS : 2 * DIMS] = np.add.reduceat(v, starts) / np.diff(np.append(starts, len(d)))[:, None]
        _, which = np.unique(h, return_inverse=True)
        out[:, -3] = np.bincount(wg.pairs(doc, which, len(h))[0], minlength=n_docs) / n
        same = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
        out[:, -2] = np.bincount(doc[1:][same], minlength=n_docs) / n
        out[:, -1] = np.log1p(w.counts) / 5
        return out


class Network:
    """Inputs, one hidden layer of tanh units, one logit."""

    def __init__(self, x: np.ndarray, y: np.ndarray, hidden: int = 24, rounds: int = 400, decay: float = 1e-3, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-3
        x = (x - self.mean) / self.scale
        p = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), hidden), np.array([np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))])]
        m, v = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
        for t in range(1, rounds + 1):
            a = np.tanh(x @ p[0] + p[1])
            err = (sigmoid(a @ p[2] + p[3][0]) - y) / len(y)
            back = np.outer(err, p[2]) * (1 - a**2)
            for k, g in enumerate((x.T @ back + decay * p[0], back.sum(0), a.T @ err + decay * p[2], np.array([err.sum()]))):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                p[k] = p[k] - 0.02 * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
        self.params, self.temperature = p, 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        p = self.params
        return np.tanh((x - self.mean) / self.scale @ p[0] + p[1]) @ p[2] + p[3][0]

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        """The temperature of the least log loss."""
        z = self.logits(x)
        choices = np.exp(np.linspace(np.log(0.25), np.log(8), 60))
        loss = [np.logaddexp(0, -np.where(y == 1, z, -z) / t).mean() for t in choices]
        self.temperature = float(choices[int(np.argmin(loss))])

    def probability(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.logits(x) / self.temperature)


def fit(texts: list[str], good: np.ndarray):
    """(Vectors, Network), or the base rate where there aren't rows of both labels."""
    if not 2 <= good.sum() <= len(good) - 2:
        return float((good.sum() + 0.5) / (len(good) + 1))
    got = tokens(wg.arrow_texts(texts))
    vectors = Vectors(*got)
    x, y = vectors.pooled(*got), good.astype(float)
    kept = np.arange(len(y)) % 5 == 4
    if not 0 < y[~kept].sum() < (~kept).sum():
        kept[:] = False
    net = Network(x[~kept], y[~kept])
    if kept.any():
        net.calibrate(x[kept], y[kept])
    return vectors, net


def scored(model) -> callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = model.value
        for batch in tk.small_slices(batches):
            if isinstance(got, float):
                score = np.full(batch.num_rows, got)
            else:
                score = got[1].probability(got[0].pooled(*tokens(batch.column(2))))
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(score)], ["doc_id", "held_out", "score"])

    return run


def quality(docs: DataFrame, labels: DataFrame, modulus: int = 5, remainder: int = 0, most: int = 2500) -> DataFrame:
    """doc_id, held_out and a score of 0 to 1 for each row of docs.

    Trained on the labelled rows that aren't held out, at most about `most` of each label
    and wordgrams.TRAINING_BYTES of text; their MOST_WORDS most frequent words have vectors
    of their own, the others their shape's. Every row is scored by its whole text, whatever
    its length. Null and empty texts are scored as a text without words. Repeated ids in labels count
    once, their smallest label; rows with a null id or label teach nothing. Repeated rows
    and rows without an id are scored each; other columns, whatever their names, are ignored. Without two
    training rows of either label every score is the base rate. An empty table gives no rows.
    """
    known = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id", modulus, remainder)).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    some = wg.sample(known, "quality", most, F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)))
    rows = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").filter("text is not null").select("doc_id", "text", "quality")
    model = docs.sparkSession.sparkContext.broadcast(wg.fitted(rows, lambda x: fit(x["text"].tolist(), x["quality"].to_numpy(float))))
    return docs.select("doc_id", held_out("doc_id", modulus, remainder).alias("held_out"), "text").mapInArrow(scored(model), "doc_id long, held_out boolean, score double")


def op7(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """quality() with predicted, 1 from a score of 0.3 on."""
    return quality(docs, labels).withColumn("predicted", (F.col("score") >= 0.3).cast("int"))
