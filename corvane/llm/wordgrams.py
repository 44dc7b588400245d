"""Character n-grams of distinct words, and bounded samples to train on."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import textkit as tk


def distinct_words(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One place of each distinct word, and which of these each word is."""
    _, place, which = np.unique(h, return_index=True, return_inverse=True)
    return place, which


def grams(data: np.ndarray, start: np.ndarray, end: np.ndarray, sizes: tuple[int, ...], buckets: int, whole: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Each word's n-grams, with marks of its start and end, as (word, bucket) pairs; the whole word too.

    Sizes count bytes of UTF-8.
    """
    n = end - start + 2
    at = np.cumsum(n) - n
    padded = np.empty(int(n.sum()), np.uint8)
    padded[at], padded[at + n - 1] = 2, 3
    inner = np.repeat(at + 1, n - 2) + tk.ranges(n - 2)
    padded[inner] = data[np.repeat(start, n - 2) + tk.ranges(n - 2)]
    p, inverse = tk.powers(len(padded) + 1, tk.BASE)
    total = np.zeros(len(padded) + 1, tk.U)
    np.cumsum(tk.BYTE_VALUES[padded] * p[:-1], out=total[1:])
    words, ids = [], []
    for size in sizes:
        room = np.maximum(n - size + 1, 0)
        a = np.repeat(at, room) + tk.ranges(room)
        words.append(np.repeat(np.arange(len(n)), room))
        ids.append(tk.mix((total[a + size] - total[a]) * inverse[a] + tk.U(size)) & tk.U(buckets - 1))
    if whole:
        words.append(np.arange(len(n)))
        ids.append(tk.mix((total[at + n] - total[at]) * inverse[at] + tk.U(255)) & tk.U(buckets - 1))
    return np.concatenate(words), np.concatenate(ids).astype(np.int64)


def gram_chunks(data: np.ndarray, start: np.ndarray, end: np.ndarray, sizes: tuple[int, ...], buckets: int, most: int = 1 << 17) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """grams() of some words at a time, of at most `most` bytes or one word: (first word, word after the last, words from 0, buckets)."""
    total = np.cumsum(end - start)
    a = 0
    while a < len(start):
        b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + most, "right")))
        yield a, b, *grams(data, start[a:b], end[a:b], sizes, buckets)
        a = b


def pairs(doc: np.ndarray, word: np.ndarray, n_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct (document, word) pairs and how often each occurs."""
    key, often = np.unique(doc * max(n_words, 1) + word, return_counts=True)
    return key // max(n_words, 1), key % max(n_words, 1), often


def sample(rows: DataFrame, label: str, most: int, order: Column) -> DataFrame:
    """About `most` rows of each label, never over twice that for all labels together: those with the smallest order, a hash in 0..2**20-1, and of equal ones the smallest rows."""
    n = {r[0]: r[1] for r in rows.groupBy(label).count().collect()}
    cut = F.lit(0)
    for value, rows_of in n.items():
        cut = F.when(F.col(label) == F.lit(value), F.lit(int((1 << 20) * min(1.0, most / max(rows_of, 1))) + 1)).otherwise(cut)
    return rows.filter(order < cut).orderBy(order, *rows.columns).limit(2 * most * max(len(n), 1))


#: Bytes of text that a model is fitted on at most.
TRAINING_BYTES = 64 << 20


def fitted(rows: DataFrame, fit: Callable[[pd.DataFrame], object], most_bytes: int = TRAINING_BYTES) -> object:
    """fit(rows) as one task does it, on at most so many bytes of text: those rows that come first by their ids' hashes. They come sorted.

    rows must be few, as sample() leaves them; the running sum of their sizes is one spillable pass.
    """
    names, order = rows.columns, ["doc_id", "text"]
    before = Window.orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    few = rows.select(*names, F.sum(F.octet_length("text")).over(before).alias("bytes_so_far")).filter(F.col("bytes_so_far") <= most_bytes).select(*names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        frame = pa.Table.from_batches(held).to_pandas() if held else pd.DataFrame({c: [] for c in names})
        yield pa.record_batch([pa.array([pickle.dumps(fit(frame.sort_values(order, ignore_index=True)))], pa.binary())], ["model"])

    found = few.repartition(1).mapInArrow(run, "model binary").collect()
    return pickle.loads(found[0]["model"]) if found else fit(pd.DataFrame({c: [] for c in names}))


def arrow_texts(rows: list) -> pa.Array:
    return pa.array(rows, pa.large_string())
