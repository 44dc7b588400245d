"""Toxicity scores: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

A document's feature for an n-gram is the number of its distinct words that hold it. The
features are multiplied by the n-gram's log-count ratio between toxic and other training
documents, and a logistic regression is fitted on the products. Because a score is a sum
over n-grams of words, the executors score each distinct word once a batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from . import wordgrams as wg
from .shared import held_out

SIZES = (3, 4, 5)
BUCKETS = 1 << 18


def features(texts: pa.Array) -> tuple[tuple, tuple, np.ndarray]:
    """(document, word) pairs, (word, n-gram) pairs, and each document's number of distinct words."""
    data, off = tk.buffer_of(texts)
    data = tk.LOWER[data]
    w = tk.Words(data, off, tk.ALNUM)
    place, which = wg.distinct_words(tk.span_hashes(data, w.start, w.end))
    doc, word, _ = wg.pairs(w.doc, which, len(place))
    return (doc, word), wg.grams(data, w.start[place], w.end[place], SIZES, BUCKETS), np.bincount(doc, minlength=len(texts))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit(texts: list[str], toxic: np.ndarray, smoothing: float = 1.0, ridge: float = 30.0, rounds: int = 150) -> tuple[np.ndarray, float]:
    """Weights of the n-grams (log-count ratio times coefficient) and the bias. Without both labels: the base rate."""
    rate = (toxic.sum() + 0.5) / (len(toxic) + 1)
    bias = float(np.log(rate / (1 - rate)))
    if not 0 < toxic.sum() < len(toxic):
        return np.zeros(BUCKETS), bias
    (doc, word), (gram_word, gram), _ = features(wg.arrow_texts(texts))
    n_docs, n_words = len(texts), int(gram_word.max()) + 1 if len(gram_word) else 0
    used, gram = np.unique(gram, return_inverse=True)

    def spread(values: np.ndarray) -> np.ndarray:  # n-grams to documents
        return np.bincount(doc, np.bincount(gram_word, values[gram], n_words)[word], n_docs)

    def gather(values: np.ndarray) -> np.ndarray:  # documents to n-grams
        return np.bincount(gram, np.bincount(word, values[doc], n_words)[gram_word], len(used))

    mass = [gather(toxic == k) + smoothing for k in (1, 0)]
    ratio = np.log(mass[0] / mass[0].sum()) - np.log(mass[1] / mass[1].sum())
    # weights start at the naive Bayes direction, scaled to the documents' margins
    y, coef = toxic.astype(float), np.zeros(len(used))
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())) ** 0.5
    first, second = np.zeros(len(used) + 1), np.zeros(len(used) + 1)
    for t in range(1, rounds + 1):
        err = weight * (sigmoid(spread(coef * ratio) + bias) - y)
        slope = np.append(gather(err) * ratio + ridge * coef, err.sum()) / n_docs
        first = 0.9 * first + 0.1 * slope
        second = 0.999 * second + 0.001 * slope**2
        move = 0.02 * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
        coef, bias = coef - move[:-1], bias - 5 * move[-1]
    out = np.zeros(BUCKETS)
    out[used] = coef * ratio
    return out, float(bias)


def margins(texts: list[str] | pa.Array, weights: np.ndarray, bias: float) -> np.ndarray:
    (doc, word), (gram_word, gram), _ = features(wg.arrow_texts(texts) if isinstance(texts, list) else texts)
    own = np.bincount(gram_word, weights[gram], int(gram_word.max()) + 1 if len(gram_word) else 0)
    return np.bincount(doc, own[word] if len(doc) else None, len(texts)) + bias


def best_cut(margin: np.ndarray, toxic: np.ndarray) -> float:
    """The margin that best parts the two by F1, halfway between its neighbours."""
    order = np.argsort(-margin, kind="stable")
    hits = np.cumsum(toxic[order])
    k = int(np.argmax(2 * hits / (np.arange(1, len(order) + 1) + toxic.sum())))
    below = margin[order[k + 1]] if k + 1 < len(order) else margin[order[k]] - 2
    return float(margin[order[k]] + below) / 2


def fit_calibrated(texts: list[str], toxic: np.ndarray, at: float = 0.7) -> tuple[np.ndarray, float]:
    """fit(), shifted so that a score of `at` is the best cut for a quarter of the rows under a fit on the others."""
    weights, bias = fit(texts, toxic)
    kept = np.arange(len(texts)) % 4 == 3
    if 0 < toxic[kept].sum() < kept.sum() and 0 < toxic[~kept].sum() < (~kept).sum():
        part = fit([t for t, k in zip(texts, kept, strict=True) if not k], toxic[~kept])
        cut = best_cut(margins([t for t, k in zip(texts, kept, strict=True) if k], *part), toxic[kept])
        bias += float(np.log(at / (1 - at))) - cut
    return weights, bias


def scored(model) -> callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = model.value
        for batch in tk.small_slices(batches):
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(sigmoid(margins(batch.column(2), weights, bias)))], ["doc_id", "held_out", "score"])

    return run


def toxicity(docs: DataFrame, labels: DataFrame, modulus: int = 3, remainder: int = 1, most: int = 3000) -> DataFrame:
    """doc_id, held_out and a score of 0 to 1 for each row of docs.

    Trained on the labelled rows that aren't held out, at most about `most` of each label
    and wordgrams.TRAINING_BYTES of text. Every row is scored by its whole text, whatever its
    length; repeated rows and rows without an id are scored each; other columns, whatever
    their names, are ignored. Null and empty texts get the bias's score. Repeated ids in labels count once, their
    largest label; rows with a null id or label teach nothing. Without training rows of both
    labels every score is the base rate, or a half without any. An empty table gives no rows.
    """
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id", modulus, remainder)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    some = wg.sample(known, "toxic", most, F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)))
    rows = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").filter("text is not null").select("doc_id", "text", "toxic")
    model = docs.sparkSession.sparkContext.broadcast(wg.fitted(rows, lambda x: fit_calibrated(x["text"].tolist(), x["toxic"].to_numpy(float))))
    return docs.select("doc_id", held_out("doc_id", modulus, remainder).alias("held_out"), "text").mapInArrow(scored(model), "doc_id long, held_out boolean, score double")


def op5(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """toxicity() with predicted, 1 from a score of 0.7 on."""
    return toxicity(docs, labels).withColumn("predicted", (F.col("score") >= 0.7).cast("int"))
