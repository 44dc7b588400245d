"""Benchmark decontamination: a prefix-filtered set join of documents with benchmark windows.

Every window of an item (n consecutive words; a shorter item is one window) is a set of
word shingles that a document must contain whole, so the one rarest shingle is a
sufficient prefix. Rarity is counted over all documents. Documents' words are looked up
for prefix shingles only; a hit gives the window's place, which must lie in the document
(length and position bounds), and all its words are then compared.

The benchmark's index is built and broadcast in blocks of at most `block_windows`
windows, which bounds what driver and executors hold of it however large it is; a long
item is spread over blocks, its pieces sharing n - 1 words. Some texts at a time are held
against one block after the other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit as tk

FLAG_BITS = 20
#: Slices of text that are held against a block before the next block is loaded.
SLICES_AT_ONCE = 8
SCHEMA = "doc_id long, n_words long, n_hit long, items array<string>, hit_start array<int>, hit_end array<int>"


def words_of(texts: pa.Array) -> tuple[tk.Words, np.ndarray]:
    data, off = tk.buffer_of(texts)
    data = tk.LOWER[data]
    w = tk.Words(data, off, tk.ALNUM)
    return w, tk.span_hashes(data, w.start, w.end)


class Keys:
    """A set of shingle hashes: a bit table first, then binary search."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.unique(keys)
        self.flags = np.zeros(1 << FLAG_BITS, bool)
        self.flags[self.keys >> tk.U(64 - FLAG_BITS)] = True

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in h of members, and which members they are."""
        at = np.flatnonzero(self.flags[h >> tk.U(64 - FLAG_BITS)])
        if not len(self.keys) or not len(at):
            return at[:0], at[:0]
        k = np.minimum(np.searchsorted(self.keys, h[at]), len(self.keys) - 1)
        same = self.keys[k] == h[at]
        return at[same], k[same]


class Block:
    """Windows of some items: their words' hashes, lengths, items, and the shingles in each."""

    def __init__(self, items: list[tuple[str, np.ndarray]], n: int, shingle: int):
        """items: their ids and the hashes of their words."""
        self.n = n
        h = np.concatenate([np.zeros(0, tk.U), *(x for _, x in items)])
        first = np.concatenate([[0], np.cumsum([len(x) for _, x in items], dtype=np.int64)])
        counts = np.diff(first)
        long, short = tk.starts_within(first, n), first[:-1][(counts > 0) & (counts < n)]
        start = np.concatenate([long, short])
        own = np.searchsorted(first, start, "right") - 1
        length = np.minimum(first[own + 1] - start, n)
        length[: len(long)] = n
        words = np.zeros((len(start), n), tk.U)
        for k in range(n):
            inside = np.flatnonzero(length > k)
            words[inside, k] = h[start[inside] + k]
        # equal windows are one, whose items are all that have it
        order = np.lexsort((own, length, *words.T))
        words, length, own = words[order], length[order], own[order]
        new = np.ones(len(order), bool)
        new[1:] = (words[1:] != words[:-1]).any(1) | (length[1:] != length[:-1])
        at, end = np.flatnonzero(new), np.append(np.flatnonzero(new)[1:], len(own))[: new.sum()]
        self.words, self.length = words[at], length[at]
        self.items = [sorted({items[d][0] for d in own[a:b].tolist()}) for a, b in zip(at.tolist(), end.tolist(), strict=True)]
        #: shingle width -> (window, offset in it, hash) of every shingle
        self.shingles: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for size in np.unique(self.length).tolist():
            own, s = np.flatnonzero(self.length == size), min(shingle, size)
            total = tk.sums(self.words[own, :size].reshape(-1))
            offset = np.tile(np.arange(size - s + 1), len(own))
            start = np.repeat(np.arange(len(own)) * size, size - s + 1) + offset
            got = (np.repeat(own, size - s + 1), offset, tk.sequence_hashes(total, start, start + s))
            before = self.shingles.get(s)
            self.shingles[s] = got if before is None else tuple(map(np.concatenate, zip(before, got, strict=True)))

    def vocabulary(self) -> dict[int, Keys]:
        return {s: Keys(h) for s, (_, _, h) in self.shingles.items()}

    def prefixes(self, rows: dict[tuple[int, int], int]) -> None:
        """Keeps each window's rarest shingle; rows: occurrences by width and hash."""
        self.prefix = {}
        for s, (window, offset, h) in self.shingles.items():
            often = np.array([rows.get((s, int(x)), 0) for x in h.view(np.int64)], np.int64)
            order = np.lexsort((offset, h, often, window))
            first = order[np.unique(window[order], return_index=True)[1]]
            by = first[np.argsort(h[first], kind="stable")]
            keys = Keys(h[by])
            bounds = np.searchsorted(h[by], keys.keys), np.searchsorted(h[by], keys.keys, "right")
            self.prefix[s] = (keys, *bounds, window[by], offset[by])
        self.shingles = {}


def counted(blocks) -> callable:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = blocks.value
        seen = {s: np.zeros(len(k.keys), np.int64) for s, k in keys.items()}
        for batch in tk.small_slices(batches):
            w, h = words_of(batch.column(0))
            total = tk.sums(h)
            for s, k in keys.items():
                at = tk.starts_within(w.first, s)
                seen[s] += np.bincount(k.find(tk.sequence_hashes(total, at, at + s))[1], minlength=len(k.keys))
        for s, n in seen.items():
            some = np.flatnonzero(n)
            yield pa.record_batch([pa.array(np.full(len(some), s)), pa.array(keys[s].keys[some].view(np.int64)), pa.array(n[some])], ["width", "shingle", "n"])

    return count


def matches(block: Block, w: tk.Words, h: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start positions and windows of all verified occurrences."""
    found = []
    for s, (keys, lo, hi, window, offset) in block.prefix.items():
        at = tk.starts_within(w.first, s)
        place, key = keys.find(tk.sequence_hashes(total, at, at + s))
        n = hi[key] - lo[key]
        j = np.repeat(lo[key], n) + tk.ranges(n)
        start = np.repeat(at[place], n) - offset[j]
        own = np.repeat(np.searchsorted(w.first, at[place], "right") - 1, n)
        size = block.length[window[j]]
        fits = (start >= w.first[own]) & (start + size <= w.first[own + 1])
        start, win, size = start[fits], window[j[fits]], size[fits]
        same = np.ones(len(start), bool)
        for k in range(block.n):
            inside = np.flatnonzero(same & (size > k))
            same[inside] &= h[start[inside] + k] == block.words[win[inside], k]
        found.append((start[same], win[same]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(map(np.concatenate, zip(*found, strict=True)))


def loaded(b, alone: bool) -> Block:
    """A broadcast block; of several only one at a time is in memory."""
    return b.value if alone or b._path is None else b.load_from_path(b._path)


def overlaps(blocks: list, texts: list[pa.Array]) -> Iterator[tuple[tk.Words, np.ndarray, list[set[str]]]]:
    """For each batch of texts their words, which of them are hit, and each text's items."""
    held = []
    for t in texts:
        w, h = words_of(t)
        held.append((w, h, tk.sums(h), np.zeros(len(h) + 1, np.int32), [set() for _ in range(len(t))]))
    for b in blocks:
        block = loaded(b, len(blocks) == 1)
        for w, h, total, edge, items in held:
            start, win = matches(block, w, h, total)
            np.add.at(edge, start, 1)
            np.add.at(edge, start + block.length[win], -1)
            own = np.searchsorted(w.first, start, "right") - 1
            for d, x in set(zip(own.tolist(), win.tolist(), strict=True)):
                items[d].update(block.items[x])
    for w, _, _, edge, items in held:
        yield w, np.cumsum(edge[:-1]) > 0, items


def together(batches: Iterator[pa.RecordBatch], blocks: list) -> Iterator[list[pa.RecordBatch]]:
    """Slices in lists: of one block's texts one by one, else some at once."""
    held: list[pa.RecordBatch] = []
    for batch in tk.small_slices(batches):
        held.append(batch)
        if len(held) >= (SLICES_AT_ONCE if len(blocks) > 1 else 1):
            yield held
            held = []
    if held:
        yield held


def matched(blocks: list) -> callable:
    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, (w, hit, items) in (x for held in together(batches, blocks) for x in zip(held, overlaps(blocks, [b.column(1) for b in held]), strict=True)):
            # maximal runs of hit words, cut where documents meet
            turn = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
            inner = w.first[1:-1]
            cuts = np.unique(inner[(inner > 0) & (inner < len(hit))])
            cuts = cuts[hit[cuts - 1] & hit[cuts]] if len(cuts) else cuts
            run_start = np.sort(np.concatenate([np.flatnonzero(turn == 1), cuts]))
            run_end = np.sort(np.concatenate([np.flatnonzero(turn == -1), cuts]))
            own = np.searchsorted(w.first, run_start, "right") - 1
            by = np.searchsorted(own, np.arange(batch.num_rows + 1)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(by, pa.array((x - w.first[own]).astype(np.int32))) for x in (run_start, run_end)]
            yield pa.record_batch([batch.column(0).cast(pa.int64()), pa.array(w.counts.astype(np.int64)), pa.array(tk.per_doc(hit.astype(np.int64), w.first)), pa.array([sorted(x) for x in items], pa.list_(pa.string())), *lists], ["doc_id", "n_words", "n_hit", "items", "hit_start", "hit_end"])

    return match


def item_blocks(items: DataFrame, n: int, shingle: int, block_windows: int) -> Iterator[Block]:
    own, size = [], 0
    for row in items.select(F.col("item_id").cast("string").alias("item_id"), "text").filter("item_id is not null and text is not null").toLocalIterator():
        _, h = words_of(pa.array([row[1]], pa.large_string()))
        for a in range(0, max(len(h) - n + 1, 1), block_windows):
            piece = h[a : a + block_windows + n - 1]
            windows = max(len(piece) - n + 1, 1)
            if own and size + windows > block_windows:
                yield Block(own, n, shingle)
                own, size = [], 0
            own.append((row[0], piece))
            size += windows
    if own or not size:
        yield Block(own, n, shingle)


def benchmark_overlap(docs: DataFrame, items: DataFrame, n: int = 10, shingle: int = 3, block_windows: int = 1_000_000) -> DataFrame:
    """For each row of docs: doc_id, n_words, n_hit, items, and the runs of hit words.

    docs has doc_id and text, items item_id and text; other columns, whatever their names,
    are ignored. A null or empty text has no words and hits nothing; so does an item without
    words or with a null id. Repeated rows of docs, and rows without an id, each give a row;
    repeated items count once by their id. A text's or an item's length has no bound. Both
    tables may be empty.
    """
    return docs.select("doc_id", "text").mapInArrow(matched(indexed(docs, items, n, shingle, block_windows)), SCHEMA)


def indexed(docs: DataFrame, items: DataFrame, n: int = 10, shingle: int = 3, block_windows: int = 1_000_000) -> list:
    """Broadcast blocks of the items' windows, filed by the shingle that is rarest in docs."""
    spark: SparkSession = docs.sparkSession
    texts, shared = docs.select("text"), []
    for block in item_blocks(items, n, shingle, block_windows):
        keys = spark.sparkContext.broadcast(block.vocabulary())
        counts = texts.mapInArrow(counted(keys), "width long, shingle long, n long").groupBy("width", "shingle").agg(F.sum("n").alias("n"))
        # no more rows than the block has shingles
        block.prefixes({(r["width"], r["shingle"]): r["n"] for r in counts.collect()} if len(block.length) else {})
        keys.unpersist()
        shared.append(spark.sparkContext.broadcast(block))
    return shared


def clean_documents(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The rows of docs that hold no benchmark window, all columns: one pass, no shuffle.

    Null and empty texts hold none. Repeated rows stay or go together; either table may be empty.
    """
    blocks, at = indexed(docs, items, **options), docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, (w, hit, _) in (x for held in together(batches, blocks) for x in zip(held, overlaps(blocks, [b.column(at) for b in held]), strict=True)):
            yield batch.filter(pa.array(tk.per_doc(hit.astype(np.int64), w.first) == 0))

    return docs.mapInArrow(keep, docs.schema)


def op10(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The digest columns of benchmark_overlap(), which says what becomes of nulls, repeats, long texts and empty tables."""
    got = benchmark_overlap(docs, items)
    return got.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def digest_of(ids: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
