"""Best-fit packing of tokenised documents into sequences, by hierarchical residual packing.

Each partition tokenises its documents, cuts the long ones, and packs the pieces by best
fit, decreasing. Bins that are nearly full are done. The others become items themselves:
a tree of rounds brings the underfull bins of `fan_in` groups together and packs them by
best fit again, until one group is left or nothing is underfull. A round moves only bins
(an id, a fill and which first-round bins they hold), never tokens. When few are left, all
meet in one group; how many may is a parameter, beyond which a group is packed in parts,
whose rests are dealt anew and packed again while that leaves fewer.
"""

from __future__ import annotations

import json
import math
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .shared import cut

#: Where a cut before a single space could change the tokens: after white space, and at a text's ends.
UNSAFE = re.compile(r"\s |\A | \Z")
KNOWN_WORDS, WORDS_AT_ONCE = 1 << 20, 1 << 10
#: Text that is encoded at once.
ENCODE_BYTES = 2 << 20
BETWEEN_SPACES = tk.word_bytes(b" ")
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, bin long, bin_offset long, bin_fill int, grp long"
#: A worker's encoders by path: a vocabulary is read once, and the words that are known serve all of its tasks, until another operator runs there.
ENCODERS: dict[str, Encoder] = {}
tk.HELD["packing"] = ENCODERS.clear


class Encoder:
    """Ids of texts, those of the library `tokenizers`.

    A byte-level BPE whose pattern never joins a letter, digit or sign with white space
    after it gives a text's ids word by word, cut before single spaces. A word's ids are
    kept under 128 bits of its hashes, in arrays; a text is a gather from them. New words
    are encoded many at once, with a special token between them, across which nothing is
    merged. Other texts, texts with the string of a special token, which stands for that
    token, and those of tokenizers of other kinds are encoded whole.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        cut = said.get("pre_tokenizer") or {}
        self.by_word = not said.get("normalizer") and cut.get("type") == "ByteLevel" and not cut.get("add_prefix_space") and cut.get("use_regex", True)
        added = self.model.get_added_tokens_decoder()
        self.added = [t.content for t in added.values()]
        self.mark = next(((i, t.content) for i, t in added.items() if t.special and not (t.lstrip or t.rstrip or t.single_word)), None)
        self.by_word = self.by_word and self.mark is not None
        self.clear()

    def clear(self) -> None:
        self.keys, self.others = np.zeros(0, tk.U), np.zeros(0, tk.U)
        self.start, self.count = np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.flat = np.zeros(0, np.uint32)

    def whole(self, text: str) -> np.ndarray:
        # as encode(), but without the places of tokens in the text
        return np.asarray(self.model.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)

    def learn(self, keys: np.ndarray, others: np.ndarray, place: np.ndarray, words: list[str]) -> None:
        number, mark = self.mark
        found = [self.whole(mark.join([*words[a : a + WORDS_AT_ONCE], ""])) for a in range(0, len(words), WORDS_AT_ONCE)]
        ids = np.concatenate(found)
        count = np.diff(np.flatnonzero(ids == number), prepend=-1) - 1
        self.start = np.insert(self.start, place, len(self.flat) + np.cumsum(count) - count)
        self.count = np.insert(self.count, place, count)
        self.keys, self.others = np.insert(self.keys, place, keys), np.insert(self.others, place, others)
        self.flat = np.concatenate([self.flat, ids[ids != number]])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        if len(self.keys) > KNOWN_WORDS:
            self.clear()
        out: list[np.ndarray | None] = [None] * len(texts)
        plain = [i for i, t in enumerate(texts) if t and self.by_word and not UNSAFE.search(t) and not any(x in t for x in self.added)]
        data, off = tk.buffer_of(pa.array([texts[i] for i in plain], pa.large_string()))
        w = tk.Words(data, off, BETWEEN_SPACES)
        key, other = tk.word_hashes(data, w.start, w.end, 1), tk.word_hashes(data, w.start, w.end, 2)
        # a text's first word has no space before it
        first = w.first[:-1]
        key[first], other[first] = tk.mix(key[first]), tk.mix(other[first])
        at_start = np.zeros(len(key), bool)
        at_start[first] = True
        keys, place, which = np.unique(key, return_index=True, return_inverse=True)
        others = other[place]
        at = np.searchsorted(self.keys, keys)
        old = at < len(self.keys)
        old[old] = self.keys[at[old]] == keys[old]
        new = np.flatnonzero(~old)
        if len(new):
            spans = zip(w.start[place[new]].tolist(), w.end[place[new]].tolist(), at_start[place[new]].tolist(), strict=True)
            raw = data.tobytes()
            self.learn(keys[new], others[new], at[new], [("" if s else " ") + raw[a:b].decode() for a, b, s in spans])
            at = np.searchsorted(self.keys, keys)
        row = at[which]
        count = self.count[row]
        ids = self.flat[np.repeat(self.start[row], count) + tk.ranges(count)]
        # of words that share half of their hash only one is known
        wrong = set(np.searchsorted(w.first, np.flatnonzero(self.others[row] != other), "right") - 1) if len(row) else set()
        bound = np.concatenate([[0], np.cumsum(count)])[w.first].tolist()
        for j, i in enumerate(plain):
            if j not in wrong:
                out[i] = ids[bound[j] : bound[j + 1]]
        return [x if x is not None else self.whole(t) if t else np.zeros(0, np.uint32) for x, t in zip(out, texts, strict=True)]


def encoder_of(path: str) -> Encoder:
    if path not in ENCODERS:
        ENCODERS[path] = Encoder(path)
    return ENCODERS[path]


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each item, and the bins' fills. Largest first, each into the fullest bin that has room."""
    bin_of, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    fills: list[int] = []
    open_rooms = 0  # bit r: some bin has room r
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        fit = open_rooms >> size
        if fit:
            r = size + (fit & -fit).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                open_rooms &= ~(1 << r)
        else:
            b, r = len(fills), capacity
            fills.append(0)
        bin_of[i], offset[i] = b, fills[b]
        fills[b] += size
        left = r - size
        if left:
            room[left].append(b)
            open_rooms |= 1 << left
    return bin_of, offset, np.array(fills, np.int64)


def tokenised(path: str, capacity: int, end_id: int) -> callable:
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, group = encoder_of(path), TaskContext.get().partitionId()
        cols: list[list] = [[], [], [], [], []]
        for batch in tk.small_slices(batches, most=ENCODE_BYTES, keeps="packing"):
            for doc_id, own in zip(batch.column(0).to_pylist(), encoder.encode([t or "" for t in batch.column(1).to_pylist()]), strict=True):
                ids = own.astype("<u4").tobytes() + end
                n = len(ids) // 4
                first = (n - 1) % capacity + 1
                bounds = [0, *range(first, n + 1, capacity)]
                for piece, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)):
                    for c, v in zip(cols, (doc_id, piece, a, b - a, zlib.crc32(ids[4 * a : 4 * b])), strict=True):
                        c.append(v)
        if cols[0]:
            sizes = np.array(cols[3], np.int64)
            b, offset, fills = best_fit(sizes, capacity)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            out = pa.record_batch([*(pa.array(c, t) for c, t in zip(cols, kinds, strict=True)), pa.array(b + (group << 40)), pa.array(offset), pa.array(fills[b].astype(np.int32)), pa.array(np.full(len(b), group))], ["doc_id", "piece", "start", "length", "ids_crc32", "bin", "bin_offset", "bin_fill", "grp"])
            for i in range(0, out.num_rows, 20_000):
                yield out.slice(i, 20_000)

    return run


def repacked(capacity: int) -> callable:
    def pack(bins: pd.DataFrame) -> pd.DataFrame:
        bins = bins.sort_values("bin", ignore_index=True)
        b, offset, fills = best_fit(bins["fill"].to_numpy(np.int64), capacity)
        # a new bin bears the id of its smallest member; members keep their order by offset
        name = bins["bin"].groupby(b).min()
        out: dict[int, tuple[list, list]] = {k: ([], []) for k in range(len(fills))}
        for k, off, own, own_off in zip(b.tolist(), offset.tolist(), bins["members"], bins["offsets"], strict=True):
            out[k][0].extend(own)
            out[k][1].extend(int(x) + off for x in own_off)
        return pd.DataFrame({"bin": name.to_numpy(), "fill": fills.astype(np.int32), "members": [out[k][0] for k in range(len(fills))], "offsets": [out[k][1] for k in range(len(fills))], "grp": bins["grp"].iloc[0]})

    return pack


BINS = "bin long, fill int, members array<long>, offsets array<long>, grp long"


def pack_sequences(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2, nearly_full: float = 0.995, fan_in: int = 8, most_in_group: int = 500_000) -> DataFrame:
    """For each piece of each document: its ids' place and CRC-32, its sequence and offset.

    A null text counts as empty, which is one token, end_id; repeated rows and rows of one
    id are packed once each. A very long text is cut into pieces like any other. An empty
    table gives no rows. Columns other than doc_id and text are ignored, whatever their
    names. A special token's string in a text is that token.

    A group of more than most_in_group open bins is packed in parts. Parts' rests meet again,
    dealt anew, for as long as that leaves fewer bins.
    """
    docs = docs.select("doc_id", "text")
    pieces = cut(docs.mapInArrow(tokenised(tokenizer, capacity, end_id), PIECES))
    limit = math.ceil(capacity * nearly_full)
    bins = pieces.groupBy("bin").agg(F.first("bin_fill").alias("fill"), F.first("grp").alias("grp"))
    open_bins = bins.filter(F.col("fill") < limit).select("bin", "fill", F.array("bin").alias("members"), F.array(F.lit(0).cast("long")).alias("offsets"), "grp")
    groups = (pieces.agg(F.max("grp")).first()[0] or 0) + 1
    moved, salt, left = None, 0, None
    while groups > 1 or left is not None:
        groups, salt = math.ceil(groups / fan_in), salt + 1
        sized = open_bins.withColumn("grp", F.floor(F.col("grp") / fan_in))
        counts = sized.groupBy("grp").agg(F.count("*").alias("rows"))
        part = F.floor(F.col("rows") / most_in_group) + 1
        sized = sized.join(F.broadcast(counts), "grp").withColumn("part", F.pmod(F.xxhash64("bin", F.lit(salt)), part)).drop("rows")
        packed = cut(sized.groupBy("grp", "part").applyInPandas(repacked(capacity), BINS))
        # how many are open, and whether some group was too large for one part
        still, most = packed.filter(F.col("fill") < limit).count(), counts.agg(F.max("rows")).first()[0] or 0
        again = groups == 1 and most >= most_in_group and (left is None or still < left)
        done = packed if groups == 1 and not again else packed.filter(F.col("fill") >= limit)
        moved = done if moved is None else moved.unionByName(done)
        open_bins, left = packed.filter(F.col("fill") < limit), still if again else None
    if moved is None:
        return pieces.select("doc_id", "piece", "start", "length", "ids_crc32", F.col("bin").alias("sequence_id"), F.col("bin_offset").alias("offset"))
    place = moved.select(F.col("bin").alias("sequence_id"), F.explode(F.arrays_zip("members", "offsets")).alias("m")).select("sequence_id", F.col("m.members").alias("bin"), F.col("m.offsets").alias("base"))
    out = pieces.join(place, "bin", "left")
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", F.coalesce("sequence_id", "bin").alias("sequence_id"), (F.col("bin_offset") + F.coalesce("base", F.lit(0))).alias("offset"))


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op9(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """pack_sequences() with the given vocabulary, or the 50,257 byte pairs; it says what becomes of nulls, long texts, repeats and empty tables."""
    return pack_sequences(docs, tokenizer or default_tokenizer())
