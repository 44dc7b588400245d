"""WARC archives under Zstandard: a dictionary in the leading skippable frame, then a frame per record.

write() trains a dictionary on an archive's first payloads, puts it into a skippable frame
at the archive's start, and compresses each record into a frame of its own, which bears its
length and a checksum. read() takes archives as binary files, loads the dictionary, walks
the frames by their block headers, decodes one at a time, and holds the record's headers,
lengths and digest against its bytes.
"""

from __future__ import annotations

import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import cut, lookup, shared_folder

#: Magic numbers of the dictionary's skippable frame, of frames, and of dictionaries.
SKIPPABLE, FRAME, DICTIONARY = 0x184D2A5D, 0xFD2FB528, 0xEC30A437
VERSION = b"WARC/1.1"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
REVISIT_PROFILE = b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ARCHIVE_BYTES = 16 << 20
SAMPLES, SAMPLE_BYTES, DICTIONARY_BYTES = 256, 2 << 20, 32 << 10
DATE = b"2024-01-01T00:00:00Z"

READ_SCHEMA = "archive string, record_id string, record_type string, uri string, page_id long, payload_bytes long, payload_digest string, refers_to long, payload binary"


class WarcError(ValueError):
    """An archive or record that isn't what its headers say."""


def uri_of(url: str | None, page_id: int | None) -> bytes:
    if not url:
        return f"urn:page:{page_id}".encode()
    return re.sub(rb"[\x00-\x20\x7f]", lambda m: b"%%%02X" % m[0][0], url.encode("utf-8", "replace"))


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, size: int, refers_to: int | None, revisit: bool) -> bytes:
    """One record: for a revisit without the payload, whose full length and digest the headers keep."""
    http = HTTP + f"Content-Length: {size}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        VERSION,
        b"WARC-Type: " + (b"revisit" if revisit else b"response"),
        b"WARC-Record-ID: <urn:uuid:" + str(uuid.uuid5(uuid.NAMESPACE_URL, f"page:{page_id}:{url}:{digest}")).encode() + b">",
        b"WARC-Target-URI: " + uri_of(url, page_id),
        b"WARC-Date: " + DATE,
        b"WARC-Payload-Digest: sha1:" + digest.encode(),
        b"WARC-Block-Digest: sha1:" + hashlib.sha1(block).hexdigest().encode(),
        b"Content-Type: application/http; msgtype=response",
    ]
    if page_id is not None:
        head.append(b"X-Page-Id: %d" % page_id)
    if revisit:
        head += [b"WARC-Profile: " + REVISIT_PROFILE, b"X-Payload-Length: %d" % size]
        if refers_to is not None:
            head.append(b"X-Refers-To-Page-Id: %d" % refers_to)
    return b"\r\n".join([*head, b"Content-Length: %d" % len(block)]) + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """The record's fields and payload. Raises WarcError where headers or lengths don't hold."""
    head, found, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.split(b"\r\n")
    if not found or version not in (b"WARC/1.0", VERSION):
        raise WarcError(f"no WARC header: {version[:40]!r}")
    fields = {}
    for line in lines:
        name, colon, value = line.partition(b":")
        if not colon:
            raise WarcError(f"a header line without a colon: {line[:80]!r}")
        fields[name.strip().lower()] = value.strip()
    for name in (b"warc-type", b"warc-record-id", b"warc-date", b"content-length"):
        if name not in fields:
            raise WarcError(f"no {name.decode()}")
    if not fields[b"content-length"].isdigit() or len(rest) != (n := int(fields[b"content-length"])) + 4 or rest[n:] != b"\r\n\r\n":
        raise WarcError("the record's length isn't Content-Length")
    block = rest[:n]
    digest = fields.get(b"warc-block-digest")
    if digest and digest != b"sha1:" + hashlib.sha1(block).hexdigest().encode():
        raise WarcError("the block isn't that of WARC-Block-Digest")
    payload = block
    if fields.get(b"content-type", b"").startswith(b"application/http"):
        http, found, payload = block.partition(b"\r\n\r\n")
        length = re.search(rb"(?im)^content-length:\s*(\d+)\s*$", http)
        if not found or not http.startswith(b"HTTP/"):
            raise WarcError("no HTTP header in the block")
        if length and fields[b"warc-type"] == b"response" and int(length[1]) != len(payload):
            raise WarcError("the payload's length isn't that of the HTTP header")
    said = fields.get(b"warc-payload-digest", b"").removeprefix(b"sha1:").decode()
    revisit = fields[b"warc-type"] == b"revisit"
    if said and not revisit and said != hashlib.sha1(payload).hexdigest():
        raise WarcError("the payload isn't that of WARC-Payload-Digest")
    number = lambda name: int(fields[name]) if name in fields else None
    return {"record_id": fields[b"warc-record-id"].decode(), "record_type": fields[b"warc-type"].decode(), "uri": fields.get(b"warc-target-uri", b"").decode("utf-8", "replace"), "page_id": number(b"x-page-id"), "payload_bytes": number(b"x-payload-length") if revisit else len(payload), "payload_digest": said or hashlib.sha1(payload).hexdigest(), "refers_to": number(b"x-refers-to-page-id"), "payload": b"" if revisit else payload}


def dictionary_of(samples: list[bytes]) -> bytes:
    """A trained dictionary, or where the samples are too few for one, their own bytes; empty for none."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes() if len(samples) >= 16 else b"".join(samples)[:DICTIONARY_BYTES]
    except zstandard.ZstdError:
        return b"".join(samples)[:DICTIONARY_BYTES]


def dictionary(data: bytes) -> zstandard.ZstdCompressionDict | None:
    if len(data) < 8:
        return None
    trained = struct.unpack_from("<I", data)[0] == DICTIONARY
    return zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_FULLDICT if trained else zstandard.DICT_TYPE_RAWCONTENT)


def archives(records: Iterator[bytes], most: int = ARCHIVE_BYTES) -> Iterator[tuple[bytes, int]]:
    """(bytes, number of records) of one archive after another, each a little over `most` bytes at most."""
    held, out = [], None
    packer, n = None, 0

    def begin() -> None:
        nonlocal packer, out, n
        raw = dictionary_of(held)
        packer = zstandard.ZstdCompressor(level=3, dict_data=dictionary(raw), write_content_size=True, write_checksum=True)
        packed = zstandard.ZstdCompressor(level=9, write_content_size=True).compress(raw) if len(raw) >= 8 else b""
        out = bytearray(struct.pack("<II", SKIPPABLE, len(packed)) + packed)
        n = 0
        for r in held:
            add(r)
        held.clear()

    def add(r: bytes) -> None:
        nonlocal n
        out.extend(packer.compress(r))
        n += 1

    size = 0
    for r in records:
        if packer is None:
            held.append(r)
            size += len(r)
            if len(held) >= SAMPLES or size >= SAMPLE_BYTES:
                begin()
                size = 0
        else:
            add(r)
        if packer and len(out) >= most:
            yield bytes(out), n
            packer = None
    if held:
        begin()
    if packer and n:
        yield bytes(out), n


def frame_end(data: memoryview, at: int) -> int:
    """Where the frame that starts at `at` ends, by its blocks' headers."""
    params = zstandard.get_frame_parameters(data[at : at + 18])
    p = at + zstandard.frame_header_size(data[at : at + 18])
    while True:
        if p + 3 > len(data):
            raise WarcError("a frame is cut off")
        head = int.from_bytes(data[p : p + 3], "little")
        kind, size = head >> 1 & 3, head >> 3
        if kind == 3:
            raise WarcError("a block of a reserved type")
        p += 3 + (1 if kind == 1 else size)
        if head & 1:
            break
    p += 4 * params.has_checksum
    if p > len(data):
        raise WarcError("a frame is cut off")
    return p


def frames(content: bytes) -> Iterator[bytes]:
    """Decoded records of an archive."""
    data, at, words = memoryview(content), 0, None
    if len(data) < 8:
        if len(data):
            raise WarcError("too short for an archive")
        return
    magic, size = struct.unpack_from("<II", data)
    if magic == SKIPPABLE:
        raw, at = bytes(data[8 : 8 + size]), 8 + size
        if len(raw) != size:
            raise WarcError("the dictionary's frame is cut off")
        if raw[:4] == struct.pack("<I", FRAME):
            raw = zstandard.ZstdDecompressor().decompress(raw)
        words = dictionary(raw)
    decoder = zstandard.ZstdDecompressor(dict_data=words)
    while at < len(data):
        if len(data) - at < 8:
            raise WarcError("bytes after the last frame")
        magic, size = struct.unpack_from("<II", data, at)
        if magic & 0xFFFFFFF0 == 0x184D2A50:
            at += 8 + size
            continue
        if magic != FRAME:
            raise WarcError(f"no frame at byte {at}")
        end = frame_end(data, at)
        try:
            out = decoder.decompress(data[at:end])
        except zstandard.ZstdError as e:
            raise WarcError(f"the frame at byte {at}: {e}") from e
        said = zstandard.frame_content_size(data[at:end])
        if said >= 0 and said != len(out):
            raise WarcError("a record's length isn't its frame's")
        yield out
        at = end


def writer(folder: str) -> callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        context, names, counts, sizes = TaskContext.get(), [], [], []

        def records() -> Iterator[bytes]:
            for batch in batches:
                for i in range(batch.num_rows):
                    page_id, url, html, digest, size, refers_to, revisit = (c[i].as_py() for c in batch.columns)
                    yield record(page_id, url, (html or "").encode(), digest, size, refers_to, revisit)

        for k, (data, n) in enumerate(archives(records())):
            # an attempt's own name: what a lost attempt has left is in nobody's list
            name = f"part-{context.partitionId():05d}-{context.taskAttemptId()}-{k:04d}.warc.zst"
            with store.open_output_stream(f"{root}/{name}", compression=None) as f:
                f.write(data)
            names.append(name)
            counts.append(n)
            sizes.append(len(data))
        yield pa.record_batch([pa.array(names, pa.string()), pa.array(counts, pa.int64()), pa.array(sizes, pa.int64())], ["archive", "records", "bytes"])

    return run


def rows_of(archive: str, content: bytes) -> Iterator[pa.RecordBatch]:
    """An archive's records, some at a time."""
    names = [f.split()[0] for f in READ_SCHEMA.split(", ")]
    kinds = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
    rows, size = [], 0
    for data in frames(content):
        rows.append({"archive": archive} | parse(data))
        size += len(data)
        if size >= 4 << 20 or len(rows) >= 5000:
            yield pa.record_batch([pa.array([r[c] for r in rows], k) for c, k in zip(names, kinds, strict=True)], names)
            rows, size = [], 0
    if rows:
        yield pa.record_batch([pa.array([r[c] for r in rows], k) for c, k in zip(names, kinds, strict=True)], names)


def reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (archive, content)."""
    for batch in batches:
        for archive, content in zip(batch.column(0), batch.column(1), strict=True):
            yield from rows_of(archive.as_py(), content.as_buffer().to_pybytes())


def opener(folder: str) -> callable:
    """Of rows (archive, records, bytes), whose archives are in the folder: each must be there and have its size and number of records."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for archive, records, size in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                try:
                    with store.open_input_stream(f"{root}/{archive}", compression=None) as f:
                        content = f.read()
                except FileNotFoundError as e:
                    raise WarcError(f"{archive} is missing") from e
                if len(content) != size:
                    raise WarcError(f"{archive} has {len(content)} bytes, not {size}")
                n = 0
                for out in rows_of(archive, content):
                    n += out.num_rows
                    yield out
                if n != records:
                    raise WarcError(f"{archive} has {n} records, not {records}")

    return run


def revisits(pages: DataFrame, least_bytes: int = 1000) -> DataFrame:
    """pages with payload_digest, payload_bytes, and refers_to: the largest page_id of an equal payload of at least so many bytes, null for that page itself and for smaller payloads."""
    html = F.coalesce(F.col("html"), F.lit(""))
    pages = pages.select("page_id", "url", "html", F.sha1(html.cast("binary")).alias("payload_digest"), F.octet_length(html).cast("long").alias("payload_bytes"))
    slim = pages.select("page_id", "payload_digest", "payload_bytes").filter(F.col("payload_bytes") >= least_bytes)
    last = cut(slim.groupBy("payload_digest").agg(F.max("page_id").alias("last"), F.count("*").alias("copies")).filter("copies > 1"))
    total = last.agg(F.sum("copies")).first()[0] or 0
    out = lookup(pages, last, "payload_digest", "copies", total, "page_id")
    return out.select("page_id", "url", "html", "payload_digest", "payload_bytes", F.when((F.col("payload_bytes") >= least_bytes) & ~F.col("last").eqNullSafe(F.col("page_id")), F.col("last")).alias("refers_to"))


def write(pages: DataFrame, folder: str) -> DataFrame:
    """Writes archives of at most about 16 MB into the folder; returns their names, numbers of records and sizes.

    folder is a URI that all executors share. The rows need what revisits() adds.
    """
    revisit = F.col("refers_to").isNotNull()
    rows = pages.select("page_id", "url", F.when(~revisit, F.col("html")).alias("html"), "payload_digest", "payload_bytes", "refers_to", revisit.alias("revisit"))
    return cut(rows.mapInArrow(writer(folder), "archive string, records long, bytes long"))


def read(spark: SparkSession, folder: str, archives: DataFrame | None = None) -> DataFrame:
    """The records of the folder's archives; of those that `archives` lists, as write() does, if given.

    A damaged archive fails the query. So does a listed one that is missing, or whose size or
    number of records isn't the listed one. Only the list is shuffled, not what archives hold.
    """
    if archives is None:
        files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder)
        return files.select(F.element_at(F.split("path", "/"), -1).alias("archive"), "content").mapInArrow(reader, READ_SCHEMA)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return archives.select("archive", "records", "bytes").repartition(parts, "archive").mapInArrow(opener(folder), READ_SCHEMA)


def new_folder(spark: SparkSession) -> str:
    folder = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)
    return folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"


def op3(pages: DataFrame) -> DataFrame:
    """A null html is an empty payload, a null url a urn; equal page_ids with equal payloads are all responses; an empty table gives no rows."""
    spark = pages.sparkSession
    folder = new_folder(spark)
    written = write(revisits(pages), folder)
    found = read(spark, folder, written)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
