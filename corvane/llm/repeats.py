"""Substring dedup by recompression: passages of `width` words that an earlier document has are removed.

Rounds name first the runs of equal words, then pairs of neighbouring symbols, of which a
bit of each symbol's name says whether it may be a pair's left or right. A name is a hash of
what it stands for, so every executor gives equal substrings the same names without asking,
but for symbols at a substring's edges that what lies outside could have changed. Each
symbol therefore carries the span of words that settles it. A window of `width` words is
filed under its best interior symbol: of the highest round, then of the largest hash. That
is the same symbol wherever the window occurs, and neighbouring windows share it, so a
document of n words has about n / 4 groups of windows, not n.

A group is a row (symbol, content, document); the content is 128 bits of all words that its
windows cover, from two families of hashes that share neither byte nor word values. Rows
meet by symbol. Where equal groups meet, all their windows repeat, and only the smallest
document keeps them. Where one symbol has unlike groups, some windows may still be equal:
those groups' windows are hashed one by one in a second step, by 128 bits of each again. A
symbol only brings groups together, so 32 bits of its name do, beside its bucket: two
symbols of one name make unlike groups, which costs work and changes nothing.

The rounds of naming are two, as a symbol must lie within a window to be its key. Before a
shuffle, SETTLE_BYTES of text are settled among themselves: of equal groups the smallest
document's only is passed on, and of a symbol with unlike groups a mark. So however often a
passage occurs, so much text gives one row for it. Rows travel as packed blocks for each
bucket of symbols.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .shared import cut

ROUNDS = 2
#: Text whose groups are settled among themselves before they are sent.
SETTLE_BYTES = 4 << 20
#: Documents whose words are cut at once.
CUT_AT_ONCE = 256
NO_ID = (1 << 63) - 1
BLOCKS, REMOVED, OPEN = 0, 1, 2
SCHEMA = "kind int, bucket int, block binary, did long, row long, starts array<int>, ends array<int>"
NAMES = ["kind", "bucket", "block", "did", "row", "starts", "ends"]


class Symbols:
    """Symbols of one round: names, and the words [left, right) that settle each."""

    def __init__(self, name, doc, left, right):
        self.name, self.doc, self.left, self.right = name, doc, left, right


def token_runs(h: np.ndarray, doc: np.ndarray) -> Symbols:
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    start = np.flatnonzero(new)
    end = np.append(start[1:], len(h))
    size = (end - start).astype(tk.U)
    # a run is whole if the words beside it are others; at a document's edge that can't be told
    return Symbols(np.where(size == 1, h[start], tk.mix(h[start] + tk.mix(size))), doc[start], start - 1, end + 1)


def pair_round(s: Symbols, number: int) -> tuple[Symbols, Symbols]:
    """The next round's symbols, and those of them that are new pairs."""
    bit = (tk.mix(s.name + tk.U(0xA5A5 + number)) & tk.U(1)).astype(bool)
    n = len(bit)
    beside = np.zeros(n, bool)
    beside[:-1] = s.doc[1:] == s.doc[:-1]
    pair = np.zeros(n, bool)
    pair[:-1] = ~bit[:-1] & bit[1:] & beside[:-1]
    second = np.zeros(n, bool)
    second[1:] = pair[:-1]
    nxt = np.minimum(np.arange(n) + 1, n - 1)
    left, right = s.left.copy(), s.right.copy()
    # a symbol that stays alone has been told by its neighbour on the side where it could pair
    lone = ~bit & ~pair & beside
    right[lone] = np.maximum(right[lone], s.right[nxt[lone]])
    lone = np.flatnonzero(bit & ~second)
    lone = lone[(lone > 0) & beside[lone - 1]]
    left[lone] = np.minimum(left[lone], s.left[lone - 1])
    at = np.flatnonzero(pair)
    left[at] = np.minimum(s.left[at], s.left[at + 1])
    right[at] = np.maximum(s.right[at], s.right[at + 1])
    name = s.name.copy()
    name[at] = tk.mix(tk.mix(s.name[at] + tk.U(number)) * tk.BASE + s.name[at + 1])
    keep = ~second
    return Symbols(name[keep], s.doc[keep], left[keep], right[keep]), Symbols(name[at], s.doc[at], left[at], right[at])


def best_inside(s: Symbols, window: np.ndarray, width: int) -> np.ndarray:
    """For each window the symbol of the largest priority that it settles; -1 if none."""
    lo = np.searchsorted(s.left, window)
    hi = np.searchsorted(s.right, window + width, "right")
    best = np.where(lo < hi, lo, -1)
    value = tk.mix(s.name + tk.U(77))
    open_ = np.flatnonzero(hi - lo > 1)
    k = 1
    while len(open_):
        other = lo[open_] + k
        up = value[other] > value[best[open_]]
        best[open_[up]] = other[up]
        k += 1
        open_ = open_[hi[open_] - lo[open_] > k]
    return best


class Hashes:
    """Two families of hashes of a batch's words and of any run of them."""

    def __init__(self, data: np.ndarray, w: tk.Words):
        self.words = tk.word_hashes(data, w.start, w.end, 1)
        self.totals = tk.sums(self.words), tk.sums(tk.word_hashes(data, w.start, w.end, 2), tk.OTHER_BASE)

    def one(self, start: np.ndarray, end: np.ndarray, seed: int) -> np.ndarray:
        return tk.sequence_hashes(self.totals[0], start, end, seed)

    def both(self, start: np.ndarray, end: np.ndarray, seed: int) -> np.ndarray:
        """A column for each family."""
        return np.stack([self.one(start, end, seed), tk.sequence_hashes(self.totals[1], start, end, seed, tk.OTHER_BASE)])


def groups(hashes: Hashes, first: np.ndarray, doc: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """(first window, number of windows, symbol, content) of each group of windows."""
    window = tk.starts_within(first, width)
    if not len(window):
        return window, window, np.zeros(0, tk.U), np.zeros((2, 0), tk.U)
    rounds, level = [], token_runs(hashes.words, doc)
    for r in range(1, ROUNDS + 1):
        level, new = pair_round(level, r)
        rounds.append(new)
    left, right, owner = window.copy(), window + width, -1 - np.arange(len(window))
    open_, shift = np.arange(len(window)), 0
    for s in reversed(rounds):
        b = best_inside(s, window[open_], width)
        got = open_[b >= 0]
        b = b[b >= 0]
        left[got], right[got], owner[got] = s.left[b], s.right[b], shift + b
        shift += len(s.name)
        open_ = open_[owner[open_] < 0]
    new = np.ones(len(window), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (window[1:] != window[:-1] + 1) | (doc[window[1:]] != doc[window[:-1]])
    g = np.flatnonzero(new)
    count = np.diff(np.append(g, len(window)))
    start, left, right = window[g], left[g], right[g]
    # groups are equal if their words are, and their symbols lie at the same place in them
    content = tk.mix(hashes.both(start, start + count + width - 1, 12) + (left - start).astype(tk.U))
    return start, count, hashes.one(left, right, 11), content


# ---- packed blocks: 32-bit keys, then the documents they came from


def pack(key: np.ndarray, content: np.ndarray, own: np.ndarray, pos: np.ndarray, count: np.ndarray, did: np.ndarray, row: np.ndarray) -> bytes:
    docs, own = np.unique(own, return_inverse=True)
    wide = int(pos.max(initial=0) >= 1 << 16 or len(docs) >= 1 << 16)
    small = np.uint32 if wide else np.uint16
    head = np.array([len(key), len(docs), wide], np.int64)
    return b"".join(x.tobytes() for x in (head, did[docs], row[docs], *content, (key >> tk.U(32)).astype(np.uint32), own.astype(small), pos.astype(small), count.astype(np.uint8)))


def unpack(block: bytes) -> tuple[np.ndarray, ...]:
    n, d, wide = np.frombuffer(block, np.int64, 3).tolist()
    small, at, out = np.uint32 if wide else np.uint16, 24, []
    for kind, size in ((np.int64, d), (np.int64, d), (tk.U, n), (tk.U, n), (np.uint32, n), (small, n), (small, n), (np.uint8, n)):
        out.append(np.frombuffer(block, kind, size, at))
        at += out[-1].nbytes
    did, row, one, two, key, own, pos, count = out
    return key, one, two, did[own], row[own], pos.astype(np.int32), count


def settle(key: np.ndarray, content: np.ndarray, did: np.ndarray, mark: np.ndarray) -> tuple[np.ndarray, ...]:
    """Order, and in that order: rows that a smaller document's equal row makes repeats; rows of a key with unlike contents in several documents, or with a mark."""
    one, two = content
    order = np.lexsort((did, two, one, key))
    k, c, c2, d = key[order], one[order], two[order], did[order]
    new_key, new = np.ones(len(k), bool), np.ones(len(k), bool)
    new_key[1:] = k[1:] != k[:-1]
    new[1:] = new_key[1:] | (c[1:] != c[:-1]) | (c2[1:] != c2[:-1])
    first = np.flatnonzero(new)
    repeat = d > np.repeat(d[first], np.diff(np.append(first, len(k))))
    starts = np.flatnonzero(new_key)
    size = np.diff(np.append(starts, len(k)))
    if len(k):
        unlike = (np.add.reduceat(new.astype(np.int64), starts) > 1) & (np.maximum.reduceat(d, starts) > np.minimum.reduceat(d, starts))
        unlike |= np.logical_or.reduceat(mark[order], starts)
    else:
        unlike = new
    return order, repeat, np.repeat(unlike, size)


def batch_of(kind: int, bucket, block, did, row, starts, ends) -> pa.RecordBatch:
    n = len(bucket)
    ints = pa.list_(pa.int32())
    return pa.record_batch([pa.array(np.full(n, kind, np.int32)), pa.array(bucket, pa.int32()), pa.array(block, pa.binary()) if block is not None else pa.nulls(n, pa.binary()), pa.array(did, pa.int64()) if did is not None else pa.nulls(n, pa.int64()), pa.array(row, pa.int64()) if row is not None else pa.nulls(n, pa.int64()), starts if starts is not None else pa.nulls(n, ints), ends if ends is not None else pa.nulls(n, ints)], NAMES)


def by_document(kind: int, did: np.ndarray, row: np.ndarray, a: np.ndarray, b: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """One row a document with its (a, b); spans that touch become one if kind is REMOVED."""
    if not len(did):
        return
    order = np.lexsort((a, row, did))
    did, row, a, b = did[order], row[order], a[order], b[order]
    doc = np.ones(len(did), bool)
    doc[1:] = (did[1:] != did[:-1]) | (row[1:] != row[:-1])
    if kind == REMOVED:
        which = np.cumsum(doc) - 1
        # ends so far, kept apart by document
        shift = which * (int(b.max()) + 1)  # 64 bits
        reach = np.maximum.accumulate(b + shift) - shift
        new = doc.copy()
        new[1:] |= a[1:] > reach[:-1]
        at = np.flatnonzero(new)
        a, b = a[at], reach[np.append(at[1:], len(did)) - 1]
        did, row, doc = did[at], row[at], doc[at]
    at = np.flatnonzero(doc)
    by = pa.array(np.append(at, len(did)).astype(np.int32))
    lists = [pa.ListArray.from_arrays(by, pa.array(x.astype(np.int32))) for x in (a, b)]
    bucket = (tk.mix(row[at].view(tk.U)) % tk.U(buckets)).astype(np.int32)
    yield batch_of(kind, bucket, None, did[at], row[at], *lists)


def sent(key, content, own, pos, count, did, row, buckets: int) -> Iterator[pa.RecordBatch]:
    """Blocks of rows for each bucket of keys."""
    bucket = (tk.mix(key) % tk.U(buckets)).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    edge = np.searchsorted(bucket[order], np.arange(buckets + 1))
    some = np.flatnonzero(np.diff(edge))
    blocks = []
    for x in some.tolist():
        at = order[edge[x] : edge[x + 1]]
        blocks.append(pack(key[at], content[:, at], own[at], pos[at], count[at], did, row))
    yield batch_of(BLOCKS, some.astype(np.int32), blocks, None, None, None, None)


def kept_here(key, content, doc, pos, count, did, row, buckets: int, width: int, whole: bool) -> Iterator[pa.RecordBatch]:
    """Settles rows among themselves and passes the rest on. whole: rows are single windows, which are never unlike."""
    order, repeat, unlike = settle(key, content, did[doc], np.zeros(len(key), bool))
    key, content, doc, pos, count = key[order], content[:, order], doc[order], pos[order], count[order]
    yield from by_document(REMOVED, did[doc][repeat], row[doc][repeat], pos[repeat], (pos + count + width - 1)[repeat], buckets)
    if whole:
        ask = ~repeat
    else:
        open_ = unlike & ~repeat
        yield from by_document(OPEN, did[doc][open_], row[doc][open_], pos[open_], count[open_], buckets)
        # one row, of no windows, tells the others that this symbol's groups are unlike
        mark = open_.copy()
        mark[1:] &= ~(open_[:-1] & (key[1:] == key[:-1]))
        mark &= open_
        count = np.where(mark, 0, count)
        ask = (~unlike & ~repeat) | mark
    yield from sent(key[ask], content[:, ask], doc[ask], pos[ask], count[ask], did, row, buckets)


class Held:
    """Rows of several slices, until they stand for SETTLE_BYTES of text."""

    def __init__(self, buckets: int, width: int, whole: bool):
        self.to = buckets, width, whole
        self.clear()

    def clear(self) -> None:
        self.parts, self.docs, self.bytes = [], 0, 0

    def add(self, key, content, doc, pos, count, did, row, size: int) -> Iterator[pa.RecordBatch]:
        self.parts.append((key, content, (doc + self.docs).astype(np.int32), pos.astype(np.int32), count.astype(np.int32), did, row))
        self.docs, self.bytes = self.docs + len(did), self.bytes + size
        if self.bytes >= SETTLE_BYTES:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.parts:
            parts = [np.concatenate(x, -1) for x in zip(*self.parts, strict=True)]
            self.clear()
            yield from kept_here(*parts, *self.to)


def ids_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)


def first_step(width: int, buckets: int) -> callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Held(buckets, width, whole=False)
        for batch in tk.small_slices(batches):
            did, row = ids_of(batch)
            data, off = tk.buffer_of(batch.column(2))
            w = tk.Words(data, off, tk.SPACED)
            doc = w.doc
            start, count, symbol, content = groups(Hashes(data, w), w.first, doc, width)
            own = doc[start]
            yield from held.add(symbol, content, own, start - w.first[own], count, did, row, len(data))
        yield from held.flush()

    return run


def second_step(width: int, buckets: int) -> callable:
    """Windows of the open groups, one by one: the content is the window's, the key a hash of that."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Held(buckets, width, whole=True)
        for batch in tk.small_slices(b.filter(b.column(3).is_valid()) for b in batches):
            did, row = ids_of(batch)
            data, off = tk.buffer_of(batch.column(2))
            w = tk.Words(data, off, tk.SPACED)
            hashes = Hashes(data, w)
            starts, counts = (batch.column(k).flatten().to_numpy().astype(np.int64) for k in (3, 4))
            own = np.repeat(np.arange(batch.num_rows), batch.column(3).value_lengths().to_numpy())
            own, pos = np.repeat(own, counts), np.repeat(starts, counts) + tk.ranges(counts)
            at = w.first[own] + pos
            content = hashes.both(at, at + width, 21)
            yield from held.add(tk.mix(content[0] + tk.mix(content[1])), content, own, pos, np.ones(len(pos), np.int32), did, row, len(data))
        yield from held.flush()

    return run


def met(width: int, buckets: int) -> callable:
    """Settles the rows of each bucket; what tasks have settled already passes through."""

    def resolve(blocks: list[bytes]) -> Iterator[pa.RecordBatch]:
        key, one, two, did, row, pos, count = map(np.concatenate, zip(*map(unpack, blocks), strict=True))
        order, repeat, unlike = settle(key, (one, two), did, count == 0)
        did, row, pos, count = (x[order] for x in (did, row, pos, count))
        end = pos + count + (width - 1)
        gone = repeat & (count > 0)
        yield from by_document(REMOVED, did[gone], row[gone], pos[gone], end[gone], buckets)
        open_ = unlike & ~repeat & (count > 0)
        yield from by_document(OPEN, did[open_], row[open_], pos[open_], count[open_], buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, blocks = None, []
        for batch in batches:
            sent_on = batch.filter(pc.not_equal(batch.column(0), BLOCKS))
            if sent_on.num_rows:
                yield sent_on
            rows = batch.filter(pc.equal(batch.column(0), BLOCKS))
            for bucket, block in zip(rows.column(1).to_pylist(), rows.column(2), strict=True):
                if bucket != now and blocks:
                    yield from resolve(blocks)
                    blocks = []
                now = bucket
                blocks.append(block.as_py())
        if blocks:
            yield from resolve(blocks)

    return run


def removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[list] = [[], [], []]
        for text, starts, ends in zip(*(batch.column(k) for k in (1, 2, 3)), strict=True):
            words = (text.as_py() or "").encode().split()  # at the six bytes of white space
            gone = 0
            kept = words
            if starts.is_valid:
                mask = bytearray(b"\x01") * len(words)
                for a, b in zip(starts.as_py(), ends.as_py(), strict=True):
                    mask[a:b] = bytes(b - a)
                kept = list(compress(words, mask))
                gone = len(words) - len(kept)
            for c, v in zip(out, (len(words), gone, hashlib.sha256(b" ".join(kept)).hexdigest()), strict=True):
                c.append(v)
        yield pa.record_batch([batch.column(0), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])


def removed_spans(docs: DataFrame, width: int = 13) -> tuple[DataFrame, DataFrame]:
    """docs with its keys did and row, and for each key with repeats the word spans [starts, ends) that go."""
    if not 2 <= width <= 255:
        raise ValueError("width must be 2 to 255 words")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = 4 * parts
    keyed = docs.select("doc_id", "text", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("did"), F.xxhash64("doc_id", "text").alias("row"))

    def meet(rows: DataFrame) -> DataFrame:
        return rows.repartition(parts, "bucket").sortWithinPartitions("kind", "bucket").mapInArrow(met(width, buckets), SCHEMA)

    def gathered(rows: DataFrame) -> DataFrame:
        # a document has at most two rows of each bucket
        return rows.groupBy("did", "row").agg(F.flatten(F.collect_list("starts")).alias("starts"), F.flatten(F.collect_list("ends")).alias("ends")).hint("shuffle_hash")

    found = cut(meet(keyed.select("did", "row", "text").mapInArrow(first_step(width, buckets), SCHEMA)))
    open_ = gathered(found.filter(F.col("kind") == OPEN))
    again = keyed.join(open_, ["did", "row"], "left").select("did", "row", "text", "starts", "ends").mapInArrow(second_step(width, buckets), SCHEMA)
    spans = found.unionByName(meet(again)).filter(F.col("kind") == REMOVED)
    return keyed, gathered(spans)


def remove_repeats(docs: DataFrame, width: int = 13) -> DataFrame:
    """For each row of docs: doc_id, n_words, n_removed and the SHA-256 of the kept words.

    A null or empty text has no words. A null doc_id counts as larger than any. Rows of the
    same doc_id don't make each other's windows repeats; rows that are equal throughout get
    equal results. Documents of fewer than `width` words have no window and stay whole. An
    empty table gives no rows. Columns other than doc_id and text are ignored.
    """
    keyed, spans = removed_spans(docs, width)
    return keyed.join(spans, ["did", "row"], "left").select("doc_id", "text", "starts", "ends").mapInArrow(removed, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def op2(docs: DataFrame) -> DataFrame:
    """remove_repeats(), which says what becomes of nulls, long texts, repeats and empty tables."""
    return remove_repeats(docs)
