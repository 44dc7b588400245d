"""Words and hashes of Arrow string batches, in numpy.

A batch's texts stay one UTF-8 buffer; words are byte spans in it. All hashes are
64-bit polynomials over a table of mixed byte values, the same on every executor.
"""

from __future__ import annotations

import contextlib
import ctypes
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
BASE = U(0x9E3779B97F4A7C15)
WORD_BASE = U(0xD6E8FEB86659FD93)
OTHER_BASE = U(0xA24BAED4963EE407)
#: Text that is worked on at once: some 50 bytes of arrays stand for each of its bytes. The tables of powers() stay at 2**19 entries.
SLICE_BYTES = (1 << 19) - 4096


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose output bits all depend on all input bits."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


BYTE_VALUES = mix(np.arange(1, 257, dtype=U) * BASE)

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int, base: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    got = _powers.get(int(base))
    if got is None or len(got[0]) < n:
        m = max(1 << 16, 1 << int(n - 1).bit_length())
        pair = []
        for b in (int(base), pow(int(base), -1, 1 << 64)):
            p = np.full(m, b, U)
            p[0] = 1
            pair.append(np.cumprod(p))
        got = (pair[0], pair[1])
        if m <= 1 << 20:  # larger ones are for one long text and go with it
            _powers[int(base)] = got
    return got[0][:n], got[1][:n]


def word_bytes(separators: bytes) -> np.ndarray:
    table = np.ones(256, bool)
    table[list(separators)] = False
    return table


#: [^\x20\x09-\x0D]+
SPACED = word_bytes(b" \t\n\x0b\x0c\r")
#: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+
ALNUM = word_bytes(bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def buffer_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The texts' bytes as one array, and n + 1 offsets into it. A null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("" if not pa.types.is_binary(texts.type) else b"")
    if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type):
        kind = np.int64
    else:
        kind = np.int32
    _, offsets, data = texts.buffers()
    if offsets is None or not len(texts):
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    off = np.frombuffer(offsets, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, off - off[0]


#: What operators keep in a worker from task to task, and how to let go of it.
HELD: dict[str, Callable[[], None]] = {}


def trim() -> None:
    """Gives memory that is free back to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def small_slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES, keeps: str = "") -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most so many bytes of text, or of one row.

    A worker that has served other operators lets go of what they have kept, and at the end
    gives back its free memory: workers are used again, and an executor has several.
    """
    for name, drop in HELD.items():
        if name != keeps:
            drop()
    yield from sliced(batches, column, most)
    trim()


def sliced(batches: Iterator[pa.RecordBatch], column: str, most: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        _, off = buffer_of(batch.column(batch.schema.get_field_index(column)))
        i = 0
        while i < batch.num_rows:
            j = max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1)
            yield batch.slice(i, j - i)
            i = j


def pieces(data: np.ndarray, offsets: np.ndarray, table: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Texts as (bytes, offsets) of at most about `most` bytes; a longer text is cut between words, and each piece has all n + 1 offsets."""
    a = 0
    while True:
        b = a + most
        if b >= len(data):
            b = len(data)
        while b < len(data) and table[data[b]]:
            ahead = np.flatnonzero(~table[data[b : b + 4096]])
            b = b + int(ahead[0]) if len(ahead) else min(b + 4096, len(data))
        yield data[a:b], np.clip(offsets - a, 0, b - a)
        if b >= len(data):
            return
        a = b


class Words:
    """Words of a batch: byte spans start, end; first[d]:first[d + 1] are document d's."""

    __slots__ = ("end", "first", "start")

    def __init__(self, data: np.ndarray, offsets: np.ndarray, table: np.ndarray):
        inside = table[data]
        begin, last = inside.copy(), inside.copy()
        if len(data):
            begin[1:] &= ~inside[:-1]
            last[:-1] &= ~inside[1:]
            edge = offsets[offsets < len(data)]
            begin[edge] = inside[edge]
            edge = offsets[offsets > 0] - 1
            last[edge] = inside[edge]
        self.start = np.flatnonzero(begin)
        self.end = np.flatnonzero(last) + 1
        self.first = np.searchsorted(self.start, offsets)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each byte span."""
    p, inverse = powers(len(data) + 1, BASE)
    total = np.zeros(len(data) + 1, U)
    np.cumsum(BYTE_VALUES[data] * p[:-1], out=total[1:])
    return mix((total[end] - total[start]) * inverse[start] + (end - start).astype(U) * BASE)


#: Words of more bytes are hashed one by one.
LONG_WORD = 64


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int) -> np.ndarray:
    """A hash of each byte span, eight bytes a step; hashes of unlike seeds have nothing in common."""
    size = end - start
    h = mix(size.astype(U) + U(seed * int(BASE) % (1 << 64)))
    eight = np.lib.stride_tricks.as_strided(padded := np.concatenate([data, np.zeros(8, np.uint8)]), (len(data) + 1, 8), (1, 1))
    at = np.flatnonzero((size > 0) & (size <= LONG_WORD))
    done = 0
    while len(at):
        block = np.ascontiguousarray(eight[start[at] + done]).view(np.dtype("<u8"))[:, 0]
        left = size[at] - done
        block &= U(0xFFFFFFFFFFFFFFFF) >> (U(8) * (U(8) - np.minimum(left, 8).astype(U)))
        h[at] = mix((h[at] ^ block) * BASE + U(seed + 1))
        at, done = at[left > 8], done + 8
    for i in np.flatnonzero(size > LONG_WORD).tolist():
        own = hashlib.blake2b(padded[start[i] : end[i]].tobytes(), digest_size=8, salt=seed.to_bytes(8, "little")).digest()
        h[i] = int.from_bytes(own, "little")
    return h


def sums(h: np.ndarray, base: np.uint64 = WORD_BASE) -> np.ndarray:
    """Prefix sums from which sequence_hashes takes any run of words."""
    total = np.zeros(len(h) + 1, U)
    np.cumsum(h * powers(len(h) + 1, base)[0][:-1], out=total[1:])
    return total


def sequence_hashes(total: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0, base: np.uint64 = WORD_BASE) -> np.ndarray:
    """A hash of the words [start, end) from sums(their hashes, base)."""
    inverse = powers(len(total), base)[1]
    return mix((total[end] - total[start]) * inverse[start] + (end - start).astype(U) * BASE + U(seed))


def starts_within(first: np.ndarray, width: int) -> np.ndarray:
    """Positions at which a run of so many words of one document starts."""
    n = np.diff(first)
    room = np.maximum(n - width + 1, 0)
    return np.repeat(first[:-1], room) + ranges(room)


def ranges(counts: np.ndarray) -> np.ndarray:
    """0..c-1 for each count, end to end."""
    ends = np.cumsum(counts)
    return np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - counts, counts)


def per_doc(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of values over each document's words."""
    total = np.concatenate([[0], np.cumsum(values)])
    return total[first[1:]] - total[first[:-1]]
