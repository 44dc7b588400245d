"""N-gram Jaccard join with Bayesian candidate pruning.

Documents are sets of word shingles; equal texts form a class, and classes are joined. A
class has a MinHash signature. Classes that agree on all rows of some band are candidates.
A pair's MinHash values are compared a batch at a time: with m of n equal and a uniform
prior, the posterior of the likeness is Beta(m + 1, n - m + 1), and the pair is dropped once
the probability of reaching the threshold falls below the tolerance. What is left is
verified on the shingle sets themselves.

No step emits pairs. Buckets of candidates give the edges of a spanning forest, whose
components bring together the texts that must be verified against each other; the task that
verifies them gives each class's number of links and again a spanning forest. Buckets and
components of over BLOCK classes, or of over BLOCK_SHINGLES shingles, are dealt as tiles,
each two blocks, so that no task holds more at once however large a group is; a single text
of more shingles is a block's own.

Texts are equal if the 128 bits of their MD5 are. A class is numbered once it is written,
so that numbers, of 64 bits, are never shared.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .components import components
from .shared import cut, lookup

SHINGLE, THRESHOLD, TOLERANCE = 5, 0.8, 1e-6
BANDS, ROWS = 32, 5
HASHES = BANDS * ROWS
STEP = 32
BLOCK = 512
#: Shingles of a block's texts, some eight bytes of text each.
BLOCK_SHINGLES = 1 << 20
PAIRS_AT_ONCE = 1 << 18
FACTORS = tk.mix(np.arange(1, HASHES + 1, dtype=tk.U) * tk.U(0xC2B2AE3D27D4EB4F)) | tk.U(1)


def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> list[tuple[int, int]]:
    """(n, m): after n values a pair with fewer than m equal ones is dropped.

    P(J >= t | m of n equal) is the probability that of n + 1 trials of chance t at most m succeed.
    """
    out = []
    for n in range(STEP, HASHES + 1, STEP):
        below, m = 0.0, 0
        while True:
            below += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if below >= tolerance or m == n:
                break
            m += 1
        out.append((n, m))
    return out


def shingle_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (document, shingle hash) pairs in order, and where each document's start."""
    data, off = tk.buffer_of(texts)
    w = tk.Words(data, off, tk.SPACED)
    total = tk.sums(tk.span_hashes(data, w.start, w.end))
    n = w.counts
    many = tk.starts_within(w.first, SHINGLE)
    few = np.flatnonzero((n > 0) & (n < SHINGLE))
    start = np.concatenate([many, w.first[few]])
    end = np.concatenate([many + SHINGLE, w.first[few + 1]])
    doc = np.concatenate([np.searchsorted(w.first, many, "right") - 1, few])
    h = tk.sequence_hashes(total, start, end)
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
    doc, h = doc[new], h[new]
    return doc, h, np.searchsorted(doc, np.arange(len(texts) + 1))


def signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in tk.small_slices(batches):
        _, h, first = shingle_sets(batch.column(2))
        n = np.diff(first)
        some = np.flatnonzero(n)
        sig = np.zeros((batch.num_rows, HASHES), np.uint16)
        if len(some):
            for k, f in enumerate(FACTORS):
                # of the smallest product some middle bits
                sig[some, k] = (np.minimum.reduceat(h * f, first[some]) >> tk.U(12)).astype(np.uint16)
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array(n.astype(np.int64)), pa.array([x.tobytes() if s else None for x, s in zip(sig, n.tolist(), strict=True)], pa.binary())], ["doc_id", "digest", "n", "sig"])


def matrix(column: pa.Array) -> np.ndarray:
    data, _ = tk.buffer_of(column)
    return np.frombuffer(data.tobytes(), np.uint16).reshape(len(column), HASHES)


def band_keys(sig: np.ndarray) -> np.ndarray:
    parts = sig.reshape(len(sig), BANDS, ROWS).astype(tk.U)
    out = np.broadcast_to(np.arange(BANDS, dtype=tk.U) + tk.U(1), parts.shape[:2])
    for r in range(ROWS):
        out = tk.mix(out * tk.BASE + parts[:, :, r])
    return out


def bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            keys = band_keys(matrix(batch.column(1)))
            yield pa.record_batch([pa.array(keys.reshape(-1).view(np.int64)), pa.array(np.repeat(batch.column(0).to_numpy(zero_copy_only=False), BANDS))], ["band", "node"])


def survivors(sig: np.ndarray, a: np.ndarray, b: np.ndarray, limits: list[tuple[int, int]]) -> np.ndarray:
    """Which of the pairs of rows of sig Bayesian pruning leaves."""
    open_, equal, before = np.arange(len(a)), np.zeros(len(a), np.int32), 0
    for n, m in limits:
        equal[open_] += (sig[a[open_], before:n] == sig[b[open_], before:n]).sum(1, dtype=np.int32)
        open_ = open_[equal[open_] >= m]
        before = n
    return open_


def pair_blocks(t: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of a tile's rows, some at a time: of one block all, of two those across, none if one of the two is empty."""
    block, n = column(t, "block"), t.num_rows
    crossing = n and t.column("tile_i")[0] != t.column("tile_j")[0]
    i = 0
    while i < n - 1:
        j = i + max(1, PAIRS_AT_ONCE // n)
        rows = np.arange(i, min(j, n - 1))
        counts = n - 1 - rows
        a = np.repeat(rows, counts)
        b = a + 1 + tk.ranges(counts)
        if crossing:
            keep = block[a] != block[b]
            a, b = a[keep], b[keep]
        yield a, b
        i = j


def forest(n: int, pairs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """For each of n rows the least row of its component."""
    label = np.arange(n)
    while True:
        before = label.copy()
        for a, b in pairs:
            least = np.minimum(label[a], label[b])
            np.minimum.at(label, a, least)
            np.minimum.at(label, b, least)
        label = label[label]
        if (label == before).all():
            return label


def groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.RecordBatch]:
    """Rows of one key after another, as they come, sorted by the first `keys` columns."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        k = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(keys)])
        at = np.concatenate([[0], np.flatnonzero((k[:, 1:] != k[:, :-1]).any(0)) + 1, [batch.num_rows]])
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            key = tuple(k[:, a].tolist())
            if key != last and held:
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
            last = key
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def column(t: pa.Table, name: str) -> np.ndarray:
    return t.column(name).to_numpy()


def candidate_forest(limits) -> callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        us, vs = [], []
        for t in groups(batches, 3):
            if t.num_rows < 2:
                continue
            sig, node = matrix(t.column("sig").combine_chunks()), column(t, "node")
            left = []
            for a, b in pair_blocks(t):
                s = survivors(sig, a, b, limits)
                left.append((a[s], b[s]))
            root = forest(len(node), left)
            own = np.flatnonzero(root != np.arange(len(node)))
            us.append(node[own])
            vs.append(node[root[own]])
            if sum(map(len, us)) > 100_000:
                yield pa.record_batch([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))], ["u", "v"])
                us, vs = [], []
        if us:
            yield pa.record_batch([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))], ["u", "v"])

    return run


def shared_shingles(doc: np.ndarray, h: np.ndarray, n: int, width: int = 4096) -> np.ndarray:
    """The number of shingles that each two of n documents share."""
    order = np.argsort(h, kind="stable")
    doc, h = doc[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    ids = np.cumsum(new) - 1
    often = np.bincount(ids, minlength=1)
    keep = often[ids] > 1
    _, ids = np.unique(ids[keep], return_inverse=True)
    doc = doc[keep]
    out = np.zeros((n, n), np.float32)
    edges = np.searchsorted(ids, np.arange(0, int(ids[-1]) + 1 + width, width)) if len(ids) else []
    for a, b, base in zip(edges[:-1], edges[1:], range(0, 1 << 62, width), strict=False):
        m = np.zeros((n, width), np.float32)
        m[doc[a:b], ids[a:b] - base] = 1
        out += m @ m.T
    return out


def verified(limits) -> callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(batches, 3):
            if t.num_rows < 2:
                continue
            node, copies, n = column(t, "node"), column(t, "copies"), column(t, "n")
            sig = matrix(t.column("sig").combine_chunks())
            doc, h, _ = shingle_sets(t.column("text").combine_chunks())
            shared = shared_shingles(doc, h, len(node))
            keys, links, left = band_keys(sig), np.zeros(len(node), np.int64), []
            for a, b in pair_blocks(t):
                # the pairs that buckets and pruning have left, of these the alike
                s = survivors(sig, a, b, limits)
                s = s[(keys[a[s]] == keys[b[s]]).any(1)]
                a, b = a[s], b[s]
                both = shared[a, b].astype(np.float64)
                s = both >= THRESHOLD * (n[a] + n[b] - both) - 1e-9
                a, b = a[s], b[s]
                links += np.bincount(a, copies[b], len(node)).astype(np.int64) + np.bincount(b, copies[a], len(node)).astype(np.int64)
                left.append((a, b))
            root = node[forest(len(node), left)]
            some = links > 0
            yield pa.record_batch([pa.array(node[some]), pa.array(links[some]), pa.array(root[some])], ["node", "links", "root"])

    return run


def tiled(rows: DataFrame, group: str, size: str, weight: str | None = None) -> DataFrame:
    """rows dealt to tiles of their group: columns tile_i, tile_j, and block, which of the group's blocks a row is in. size counts the group's rows, weight its shingles."""
    blocks = F.ceil(F.col(size) / BLOCK).cast("int")
    if weight:
        blocks = F.greatest(blocks, F.least(F.ceil(F.col(weight) / BLOCK_SHINGLES), F.col(size)).cast("int"))
    rows = rows.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return rows.withColumns({"tile_i": F.least("block", "other"), "tile_j": F.greatest("block", "other")}).drop("other", "blocks", size, *([weight] if weight else []))


def together(rows: DataFrame, group: str) -> DataFrame:
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [group, "tile_i", "tile_j"]
    rows = rows.select(*keys, *(c for c in rows.columns if c not in keys))
    return rows.repartition(parts, *keys).sortWithinPartitions(*keys)


def near_links(docs: DataFrame) -> DataFrame:
    """For each row of docs: doc_id, class_id, copy_of, n_links.

    Two documents are linked if their texts are equal or the Jaccard likeness of their sets
    of five-word shingles is 0.8 or more. class_id is the smallest doc_id that links lead
    to, directly or over others; copy_of the smallest with the same text; n_links the number
    of other documents linked directly. A text of one to four words is one shingle. Texts
    without words, and null ones, link to nothing and are their own class. A null doc_id is
    never a class's name if it has another; rows without ids are linked as all others.
    Repeated rows are copies of each other. Unlike texts under one id are held apart. An
    empty table gives no rows. Columns other than doc_id and text are ignored.

    A pair is missed only if no band has agreed or pruning was wrong: at a likeness of 0.8,
    the least, with probabilities of 3e-6 and 1e-6.
    """
    signed, named = near_classes(docs)
    total = named.count()
    least = named.groupBy("component").agg(F.min("copy_of").alias("class_id"), F.count("*").alias("rows"))
    named = lookup(named, least, "component", "rows", max(total, 1), "node").select("digest", "copy_of", "class_id", "copies", "links")

    slim = signed.select("doc_id", F.when(F.col("n") > 0, F.col("digest")).alias("digest"))
    out = lookup(slim, named, "digest", "copies", max(total, signed.count()), "doc_id")
    return out.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("copy_of", "doc_id").alias("copy_of"), F.coalesce(F.col("links") + F.col("copies") - 1, F.lit(0)).alias("n_links"))


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, digest and text."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), digest_of("text").alias("digest"), "text")


def digest_of(text: str):
    """128 bits that equal texts share; null for a null text."""
    return F.unhex(F.md5(text))


def near_classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of each row of docs doc_id, digest and n, the number of its shingles; of each text with words node, digest, copy_of, copies, links and component, the least node that links lead to."""
    limits = least_matches()
    docs = keyed(docs)
    signed = cut(docs.mapInArrow(signatures, "doc_id long, digest binary, n long, sig binary"))
    worded = signed.filter("n > 0")
    classes = worded.groupBy("digest").agg(F.min("doc_id").alias("copy_of"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("sig").alias("sig"))
    classes = cut(classes.withColumn("node", F.monotonically_increasing_id()))
    total = classes.agg(F.count("*")).first()[0]

    banded = classes.select("node", "sig").mapInArrow(bands, "band long, node long")
    full = banded.groupBy("band").agg(F.count("*").alias("rows")).filter("rows > 1")
    members = lookup(banded, full, "band", "rows", BANDS * max(total, 1), "node").filter("rows > 1")
    members = members.join(classes.select("node", "sig"), "node")
    edges = together(tiled(members, "band", "rows"), "band").mapInArrow(candidate_forest(limits), "u long, v long")

    found = components(edges).join(classes, "node")
    sizes = found.groupBy("component").agg(F.count("*").alias("size"), F.sum("n").alias("shingles"))
    wanted = lookup(found, sizes, "component", "size", max(total, 1), "node")
    wanted = wanted.select("node", "component", "size", "shingles", "copies", "n", "sig", F.col("copy_of").alias("wanted_id"), F.col("digest").alias("wanted_digest"))
    # of each class the text of one document; where ids repeat, or are null, of one with this class's text
    texts = docs.dropDuplicates(["doc_id", "digest"]) if repeats(signed, "doc_id", "digest") else docs
    texts = texts.join(wanted.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("wanted_id")) & (F.col("digest") == F.col("wanted_digest")))
    tiles = together(tiled(texts.select("node", "component", "size", "shingles", "copies", "n", "sig", "text"), "component", "size", "shingles"), "component")
    links = cut(tiles.mapInArrow(verified(limits), "node long, links long, root long"))

    joined = components(links.select(F.col("node").alias("u"), F.col("root").alias("v")))
    degree = links.groupBy("node").agg(F.sum("links").alias("links"))
    named = classes.select("node", "digest", "copy_of", "copies").join(joined, "node", "left").join(degree, "node", "left")
    named = cut(named.select("node", "digest", "copy_of", "copies", F.coalesce("component", "node").alias("component"), F.coalesce("links", F.lit(0)).alias("links")))
    return signed, named


def repeats(rows: DataFrame, *key: str) -> bool:
    """Whether some key comes twice."""
    return bool(rows.groupBy(*key).count().filter("count > 1").limit(1).count())


def one_of_each(docs: DataFrame) -> DataFrame:
    """Of each class the row with the smallest doc_id, all columns; of equal ids that with the smallest digest.

    A class is known by its texts, as unlike texts may share an id, or have none. A row whose
    id is null stays only if its class has no other. Of repeated rows, those of one id and
    text, one stays, with one row's other columns. Texts without words and null ones are
    classes of their own: one row of each id and text stays. An empty table stays empty;
    other columns may have any names.
    """
    signed, named = near_classes(docs)
    seen = named.groupBy("component").agg(F.min(F.struct(F.col("copy_of").isNull(), "copy_of", "digest")).alias("least"))
    seen = seen.select("least.copy_of", "least.digest").unionByName(signed.filter("n = 0").select(F.col("doc_id").alias("copy_of"), "digest").distinct())
    seen = seen.select(F.col("copy_of").alias("kept_id"), F.col("digest").alias("kept_digest"))
    rows = docs.select(F.struct(*docs.columns).alias("row"))
    rows = rows.select("row", F.col("row.doc_id").cast("long").alias("own_id"), digest_of("row.text").alias("own_digest"))
    same = F.col("own_id").eqNullSafe(F.col("kept_id")) & F.col("own_digest").eqNullSafe(F.col("kept_digest"))
    kept = rows.join(seen.hint("shuffle_hash"), same, "left_semi")
    kept = kept.dropDuplicates(["own_id", "own_digest"]) if repeats(signed, "doc_id", "digest") else kept
    return kept.select("row.*")


def op6(docs: DataFrame) -> DataFrame:
    """near_links(), which says what becomes of nulls, long texts, repeats and empty tables."""
    return near_links(docs)
