"""Operator 8: WARC archives in Zstandard frames with a shared dictionary: writing and reading."""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, column_bytes, small_batches
from .files import get, put

#: Magic numbers: the skippable frame that holds an archive's dictionary, and a Zstandard frame (fixed values).
DICTIONARY_MAGIC, FRAME_MAGIC = 0x184D2A5D, 0xFD2FB528
#: Payload bytes after which a task begins another archive, bytes of the first records a dictionary is made from, and its size.
ARCHIVE_BYTES, SAMPLE_BYTES, DICTIONARY_BYTES = 32_000_000, 2_000_000, 65_536
#: Header lines of a record beside those computed, by type.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"


def digest(payload: bytes) -> str:
    """Upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record. A revisit carries the payload's digest and length, not the payload."""
    name = lambda i: f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{i}')}>"
    uri = (url or "about:blank").replace("\r", "%0D").replace("\n", "%0A")
    block = b"" if revisit else payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {name(page_id)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha1:{digest(payload)}"]
    head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {name(refers_to)}", f"X-Refers-To-Page: {refers_to}"] if revisit else []
    head += [] if page_id is None else [f"X-Page-Id: {page_id}"]
    head += [f"X-Payload-Length: {len(payload)}", "Content-Type: text/html;charset=utf-8", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def make_dictionary(samples: list[bytes]) -> bytes:
    """A trained dictionary of the samples; their plain beginning where they are too few to train on."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:DICTIONARY_BYTES] or b"WARC/1.1\r\n"


def _dictionary(data: bytes) -> zstandard.ZstdCompressionDict:
    trained = data[:4] == (0xEC30A437).to_bytes(4, "little")
    return zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_FULLDICT if trained else zstandard.DICT_TYPE_RAWCONTENT)


def write_archive(records: Iterator[bytes] | list[bytes]) -> bytes:
    """The dictionary, itself compressed, in a leading skippable frame, then one frame for each record."""
    records = list(records)
    samples, used = [], 0
    for r in records:
        if used >= SAMPLE_BYTES:
            break
        samples.append(r), (used := used + len(r))
    data = make_dictionary(samples)
    packed = zstandard.ZstdCompressor(level=9).compress(data)
    pack = zstandard.ZstdCompressor(level=3, dict_data=_dictionary(data), write_checksum=True)
    return b"".join([DICTIONARY_MAGIC.to_bytes(4, "little"), len(packed).to_bytes(4, "little"), packed, *map(pack.compress, records)])


def frames(archive: bytes, piece: int = 1 << 14) -> Iterator[bytes]:
    """The content of each frame. Raises ValueError where the archive is damaged or cut short."""
    at, view = 0, memoryview(archive)
    size = int.from_bytes(view[4:8], "little")
    if len(view) < 8 or int.from_bytes(view[:4], "little") != DICTIONARY_MAGIC or len(view) < 8 + size:
        raise ValueError("no dictionary frame leads the archive")
    data = bytes(view[8 : 8 + size])
    if data[:4] == FRAME_MAGIC.to_bytes(4, "little"):
        data = zstandard.ZstdDecompressor().decompress(data)
    unpack, at = zstandard.ZstdDecompressor(dict_data=_dictionary(data)), 8 + size
    while at < len(view):
        one, out = unpack.decompressobj(), []
        try:
            while not one.eof:
                if at >= len(view):
                    raise ValueError("the archive ends within a frame")
                out.append(one.decompress(view[at : at + piece]))
                at += min(piece, len(view) - at)
        except zstandard.ZstdError as e:
            raise ValueError(f"damaged frame: {e}") from e
        at -= len(one.unused_data)
        yield b"".join(out)


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (by lower-case name) and block of a record, whose version, needed headers, lengths and payload digest are checked."""
    head, found, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not found or lines[0] not in ("WARC/1.0", "WARC/1.1"):
        raise ValueError("not a WARC record")
    headers = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or not name or name != name.strip():
            raise ValueError(f"not a header line: {line[:80]!r}")
        headers[name.lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in headers:
            raise ValueError(f"no {name}")
    if not headers["content-length"].isdigit() or len(rest) != int(headers["content-length"]) + 4 or not rest.endswith(b"\r\n\r\n"):
        raise ValueError("the block's length is not the one stated")
    block = rest[:-4]
    if headers["warc-type"] == "response":
        if headers.get("warc-payload-digest", "sha1:" + digest(block)) != "sha1:" + digest(block):
            raise ValueError("the payload's digest is not the one stated")
        if int(headers.get("x-payload-length", len(block))) != len(block):
            raise ValueError("the payload's length is not the one stated")
    return headers, block


def write_pages(pages: DataFrame, scratch: Scratch, least: int = 0) -> DataFrame:
    """Write every row of pages (page_id, url, html) as a record; returns the archives' paths, in the shared folder.

    Of rows with equal payloads of `least` bytes or more that with the smallest page_id is a response and the others revisit it.
    A null html is an empty payload. A null page_id comes after all others; rows that repeat the smallest page_id are responses.
    """
    folder = f"{scratch.root}/archives"
    source = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html")).withColumn("sum", F.sha1("html")).withColumn("size", F.octet_length("html"))
    copies = source.where(F.col("size") >= least).groupBy("sum", "size").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    rows = source.join(copies, ["sum", "size"], "left").select("page_id", "url", "html", "first")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([put(folder, write_archive(held), ".warc.zst")]), pa.array([len(held)], pa.int64())], names=["path", "records"])

        for b in small_batches(batches):
            for i, url, html, first in zip(b.column("page_id").to_pylist(), b.column("url").to_pylist(), column_bytes(b, "html"), b.column("first").to_pylist(), strict=True):
                held.append(record(i, url, html, first, first is not None and i != first))
                size += len(held[-1])
                if size >= ARCHIVE_BYTES:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return scratch.keep(rows.mapInArrow(run, "path string, records long"))


def read_archives(paths: DataFrame) -> DataFrame:
    """One row per record of the archives: page_id, url, payload_bytes, payload_digest, record_type, refers_to, html (null for a revisit). A damaged archive or record raises ValueError."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("html", pa.string())])
        number = lambda s: None if s is None else int(s)
        for b in batches:
            for path in b.column("path").to_pylist():
                rows = []
                for data in frames(get(path)):
                    h, block = parse(data)
                    rows.append((number(h.get("x-page-id")), h.get("warc-target-uri"), number(h.get("x-payload-length")), h.get("warc-payload-digest", "").removeprefix("sha1:"), h["warc-type"], number(h.get("x-refers-to-page")), None if h["warc-type"] == "revisit" else block.decode("utf-8")))
                    if len(rows) == 256:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    listed = paths.select("path")
    parts = max(1, paths.count())
    return listed.repartition(min(parts, 4 * paths.sparkSession.sparkContext.defaultParallelism)).mapInArrow(run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, html string")


def round_trip(pages: DataFrame, least: int = 0) -> DataFrame:
    """Write pages and read the archives back: see write_pages and read_archives. Repeated rows are a record each; no rows give none. Extra columns are ignored."""
    return read_archives(write_pages(pages, Scratch(pages.sparkSession, "warc"), least))
