"""WARC archives in seekable Zstandard bundles.

Records are grouped into independent Zstandard frames; a bundle ends with a seek table in a skippable frame
(sizes of all frames), and the index maps each record to (bundle, frame, offset in the frame, length), so one
record is read by decompressing one frame.  Equal payloads are stored once: the record with the largest id is
the response, the others are ``revisit`` records that refer to it.

Bundles get names of their own for each task attempt and are listed only by the index rows of the attempt that
Spark commits, so a lost executor or a repeated task leaves at most files that nothing refers to.
"""

from __future__ import annotations

import base64
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import keep, scratch

# fixed values of the seekable format: skippable frame, footer
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1

INDEX_SCHEMA = "record_id string, record_type string, refers_to string, bundle string, frame int, offset long, length long"
RECORD_SCHEMA = ("record_id string, record_type string, refers_to string, target_uri string, payload binary, "
                 "payload_digest string, payload_length long")


def _store(path: str):
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def _header_text(value: str) -> str:
    """A value fit for a header line: control characters are percent-encoded."""
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in value)


def build_record(record_id: str, url: str | None, payload: bytes, sha1_hex: str, refers_to: str | None, date: str) -> bytes:
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    body = head if refers_to is not None else head + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
             f"WARC-Record-ID: <urn:record:{record_id}>", f"WARC-Date: {date}",
             f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(sha1_hex)).decode()}",
             f"WARC-Payload-Length: {len(payload)}", "Content-Type: application/http; msgtype=response",
             f"Content-Length: {len(body)}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_header_text(url)}")
    if refers_to is not None:
        lines.append(f"WARC-Refers-To: <urn:record:{refers_to}>")
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of every record of one decompressed frame."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("not at the start of a WARC record")
        headers = dict(line.split(": ", 1) for line in lines[1:])
        stop = end + 4 + int(headers["Content-Length"])
        yield headers, data[end + 4:stop]
        at = stop + 4


class _Bundle:
    """One open bundle: records go into frames, frames into the file, their sizes into the seek table."""

    def __init__(self, directory: str, frame_bytes: int, level: int):
        import zstandard

        self.path = f"{directory}/{uuid.uuid4().hex}.warc.zst"
        store, local = _store(self.path)
        self.file = store.open_output_stream(local, compression=None)
        self.codec = zstandard.ZstdCompressor(level=level, write_content_size=True)
        self.frame_bytes, self.parts, self.held, self.sizes, self.taken = frame_bytes, [], 0, [], 0

    def add(self, record: bytes) -> tuple[int, int]:
        if self.held and self.held + len(record) > self.frame_bytes:
            self.flush()
        place = len(self.sizes), self.held
        self.parts.append(record)
        self.held += len(record)
        self.taken += len(record)
        return place

    def flush(self) -> None:
        if self.parts:
            frame = self.codec.compress(b"".join(self.parts))
            self.file.write(frame)
            self.sizes.append((len(frame), self.held))
            self.parts, self.held = [], 0

    def close(self) -> None:
        self.flush()
        table = b"".join(struct.pack("<II", *s) for s in self.sizes) + struct.pack("<IBI", len(self.sizes), 0, SEEKABLE_MAGIC)
        self.file.write(struct.pack("<II", SKIPPABLE_MAGIC, len(table)) + table)
        self.file.close()


def seek_table(file) -> list[tuple[int, int, int]]:
    """(start, compressed size, size) of every frame, from the footer of an open bundle."""
    end = file.size()
    file.seek(end - 9)
    n, descriptor, magic = struct.unpack("<IBI", file.read(9))
    if magic != SEEKABLE_MAGIC:
        raise ValueError("no seek table")
    width = 12 if descriptor & 0x80 else 8
    file.seek(end - 9 - n * width)
    table, out, at = file.read(n * width), [], 0
    for i in range(n):
        packed, size = struct.unpack_from("<II", table, i * width)
        out.append((at, packed, size))
        at += packed
    return out


def write_archives(pages: DataFrame, directory: str | None = None, id_col: str = "page_id", url_col: str = "url",
                   payload_col: str = "html", min_revisit_bytes: int = 1000, frame_bytes: int = 1 << 18,
                   bundle_bytes: int = 1 << 27, level: int = 3, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write one record per row and return the index (``INDEX_SCHEMA``).

    ``directory`` must be shared by all executors; by default a new folder under ``spark.checkpoint.dir``.
    A frame takes records up to ``frame_bytes`` and a bundle ends at ``bundle_bytes``, both counted before
    compression (one longer record has a frame or bundle of its own), so neither hangs on how well the data compress.
    A null payload is empty, a null URL leaves its header out, a null id is written as an empty id and never
    referred to; repeated rows are written each; further columns are ignored.
    """
    spark = pages.sparkSession
    directory = directory or scratch(spark, "warc")
    store, local = _store(directory)
    store.create_dir(local, recursive=True)
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"),
                        F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"")).alias("payload"))
    digested = rows.withColumn("digest", F.sha1("payload")).withColumn("n", F.octet_length("payload"))
    shared = (digested.where(F.col("n") >= min_revisit_bytes).groupBy("digest", "n")
              .agg(F.max("id").alias("leader"), F.count(F.lit(1)).alias("copies")).where("copies > 1").drop("copies"))
    linked = digested.join(shared, ["digest", "n"], "left").select(
        F.coalesce(F.col("id").cast("string"), F.lit("")).alias("id"), "url", "payload", "digest",
        F.when(~F.col("leader").eqNullSafe(F.col("id")), F.col("leader").cast("string")).alias("refers_to"))

    def write(batches):
        bundle = None
        for batch in batches:
            found = []
            for x in batch.to_pylist():
                if bundle is None:
                    bundle = _Bundle(directory, frame_bytes, level)
                record = build_record(x["id"], x["url"], x["payload"], x["digest"], x["refers_to"], date)
                frame, offset = bundle.add(record)
                found.append((x["id"], "response" if x["refers_to"] is None else "revisit", x["refers_to"], bundle.path,
                              frame, offset, len(record)))
                if bundle.taken >= bundle_bytes:
                    bundle.close()
                    bundle = None
            columns = list(zip(*found)) if found else [[]] * 7
            kinds = [pa.string()] * 4 + [pa.int32(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)],
                                             names=["record_id", "record_type", "refers_to", "bundle", "frame", "offset", "length"])
        if bundle is not None:
            bundle.close()

    return keep(linked.mapInArrow(write, INDEX_SCHEMA), "warc-index")


def _row(headers: dict[str, str], block: bytes) -> tuple:
    revisit = headers["WARC-Type"] == "revisit"
    payload = None if revisit else block[block.index(b"\r\n\r\n") + 4:]
    bare = lambda name: headers[name][len("<urn:record:"):-1] if name in headers else None
    digest = base64.b32decode(headers["WARC-Payload-Digest"][5:]).hex()
    return (bare("WARC-Record-ID"), headers["WARC-Type"], bare("WARC-Refers-To"), headers.get("WARC-Target-URI"), payload,
            digest, int(headers["WARC-Payload-Length"]))


def _batch(found: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string()] * 4 + [pa.binary(), pa.string(), pa.int64()]
    columns = list(zip(*found)) if found else [[]] * 7
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)],
                                      names=["record_id", "record_type", "refers_to", "target_uri", "payload", "payload_digest", "payload_length"])


def read_archives(index: DataFrame) -> DataFrame:
    """All records of the bundles that the index lists (``RECORD_SCHEMA``), a frame at a time.

    A revisit has no payload of its own; its digest and length are those of the payload it refers to.
    """
    bundles = index.select("bundle").distinct()
    bundles = keep(bundles, "warc-bundles")
    spread = bundles.repartition(max(1, min(bundles.count(), 1 << 16)), "bundle")

    def read(batches):
        import zstandard

        codec = zstandard.ZstdDecompressor()
        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, local = _store(path)
                with store.open_input_file(local) as file:
                    for start, packed, size in seek_table(file):
                        file.seek(start)
                        data = codec.decompress(file.read(packed), max_output_size=size)
                        yield _batch([_row(h, b) for h, b in parse_records(data)])

    return spread.mapInArrow(read, RECORD_SCHEMA)


def fetch_records(wanted: DataFrame) -> DataFrame:
    """Only the records of the given index rows: one frame is decompressed for each frame that is asked for.

    Rows come back in no set order, repeated index rows once each; no index rows give no records, and other
    columns are ignored.
    """

    def read(batches):
        import zstandard

        codec = zstandard.ZstdDecompressor()
        for batch in batches:
            asked: dict[str, dict[int, list[tuple[int, int]]]] = {}
            for x in batch.to_pylist():
                asked.setdefault(x["bundle"], {}).setdefault(x["frame"], []).append((x["offset"], x["length"]))
            for path, frames in asked.items():
                store, local = _store(path)
                with store.open_input_file(local) as file:
                    table = seek_table(file)
                    for frame, places in frames.items():
                        start, packed, size = table[frame]
                        file.seek(start)
                        data = codec.decompress(file.read(packed), max_output_size=size)
                        yield _batch([_row(*next(parse_records(data[o:o + n]))) for o, n in places])

    near = wanted.select("bundle", "frame", "offset", "length").repartition("bundle", "frame").sortWithinPartitions("bundle", "frame")
    return near.mapInArrow(read, RECORD_SCHEMA)
