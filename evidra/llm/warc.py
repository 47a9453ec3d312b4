"""Operator 7: WARC archives in Zstandard: one frame per record, the dictionary in a leading skippable frame.

The writer makes archives of a bounded size in the shared folder. Tasks write them under hidden names of their own
and report these; only what the tasks that count have reported gets its final name, in a second job whose steps
may be repeated, so archives of lost or repeated tasks are never read. A payload that an
earlier-known record holds becomes a revisit: a header block only, with the digest, the length and the
record it refers to. The reader loads the dictionary from the first frame, decodes frame by frame, and
validates version, required headers, lengths, the end mark and payload digests; faults raise ValueError.
The dictionary is trained on a bounded sample of rows (`sample` rows with the smallest id hash); it changes
sizes only.

Defined cases: null html is the empty payload, a null url gives no target header, a null id is read back
as null and never referred to; of repeated rows of the largest id all are responses; an empty table
gives no archive and an empty result; other columns are not carried.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, stored

SKIPPABLE, FRAME = 0x184D2A5D, 0xFD2FB528  # fixed values of the format: a dictionary's frame, a Zstandard frame
DATE = "2024-01-01T00:00:00Z"
_SCHEMA = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record; with refers_to a revisit without the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    name = lambda k: f"<urn:x-page:{'' if k is None else k}>"
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {name(page_id)}", f"WARC-Date: {DATE}", "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{digest}"]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(c if c > " " else f"%{ord(c):02X}" for c in url))
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {name(refers_to)}"]
    block = http if refers_to is not None else http + payload
    return "\r\n".join([*head, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """Validate one record and return what it holds."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not gap or not lines[0].startswith("WARC/1."):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    missing = {"WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length", "WARC-Payload-Digest"} - fields.keys()
    if missing:
        raise ValueError(f"a record lacks {sorted(missing)}")
    n = int(fields["Content-Length"])
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise ValueError("a record's length is not its Content-Length")
    http, gap, payload = rest[:n].partition(b"\r\n\r\n")
    told = dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])
    size, digest, kind = int(told["Content-Length"]), fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"]
    if kind == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError("a payload is not what its headers say")
    number = lambda x: int(k) if x and (k := x[len("<urn:x-page:") : -1]) else None
    return {"page_id": number(fields["WARC-Record-ID"]), "url": fields.get("WARC-Target-URI"), "record_type": kind, "refers_to": number(fields.get("WARC-Refers-To")), "payload_bytes": size, "payload_digest": digest, "payload": payload if kind == "response" else None}


def frames(data: bytes, step: int = 1 << 16) -> Iterator[bytes]:
    """The contents of an archive's frames; a leading skippable frame is the dictionary (itself possibly compressed)."""
    at, dictionary = 0, None
    if len(data) >= 8 and struct.unpack_from("<I", data)[0] == SKIPPABLE:
        size = struct.unpack_from("<I", data, 4)[0]
        raw = data[8 : 8 + size]
        if len(raw) != size:
            raise ValueError("the dictionary's frame is cut short")
        if struct.unpack_from("<I", raw)[0] == FRAME:
            raw = zstandard.ZstdDecompressor().decompress(raw)
        dictionary, at = zstandard.ZstdCompressionDict(raw), 8 + size
    context, view = zstandard.ZstdDecompressor(dict_data=dictionary), memoryview(data)
    while at < len(data):
        one, out = context.decompressobj(), []
        while not one.eof:
            if at >= len(data):
                raise ValueError("the last frame is cut short")
            part = view[at : at + step]
            out.append(one.decompress(part))
            at += len(part)
        at -= len(one.unused_data)
        yield b"".join(out)


@lru_cache(2)
def _compressor(raw: bytes, level: int) -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(raw) if raw else None)


def dictionary_of(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", sample: int = 200, size: int = 65_536) -> bytes:
    """A dictionary from at most sample rows (each at most 16 KiB long), or nothing where they are too few."""
    ids = [r[0] for r in pages.select(id_col).where(F.col(id_col).isNotNull()).distinct().orderBy(F.xxhash64(id_col), id_col).limit(sample).collect()]
    rows = pages.where(F.col(id_col).isin(ids)).select(id_col, F.encode(F.substring(html_col, 1, 16_384), "UTF-8").alias("h")).dropDuplicates([id_col])
    texts = [bytes(r.h) for r in rows.orderBy(id_col).collect() if r.h]
    try:
        return zstandard.train_dictionary(size, texts).as_bytes() if len(texts) >= 20 else b""
    except zstandard.ZstdError:
        return b""


def write(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 1000, roll: int = 32 << 20, level: int = 3) -> int:
    """Write a record for every page; equal payloads of at least least bytes refer to the one with the largest id. Returns the records' number."""
    payload = F.encode(F.coalesce(html_col, F.lit("")), "UTF-8")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload"), F.sha1(payload).alias("digest"))
    large = F.octet_length("payload") >= least
    twice = stored(rows.where(large).groupBy("digest").agg(F.max("page_id").alias("original"), F.count("*").alias("n")).where("n > 1").select("digest", "original"), "digests")
    rows = rows.join(twice, "digest", "left").select("page_id", "url", "payload", "digest", F.when(large & ~F.col("original").eqNullSafe(F.col("page_id")), F.col("original")).alias("refers_to"))
    raw = dictionary_of(pages, id_col, html_col)
    sent = pages.sparkSession.sparkContext.broadcast(raw)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = pafs.FileSystem.from_uri(folder)
        system.create_dir(base, recursive=True)
        dictionary, out, held = sent.value, [], 0
        pack = _compressor(dictionary, level).compress
        lead = struct.pack("<II", SKIPPABLE, len(dictionary)) + dictionary if dictionary else b""

        def finish() -> pa.RecordBatch:
            nonlocal held
            name = uuid.uuid4().hex
            with system.open_output_stream(f"{base}/_{name}") as f:
                f.write(lead + b"".join(out))
            told = pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(out)], pa.int64())], ["name", "n"])
            out.clear()
            held = 0
            return told

        for batch in slices(batches, "payload"):
            for row in batch.to_pylist():
                out.append(pack(record(row["page_id"], row["url"], row["payload"], row["digest"], row["refers_to"])))
                held += len(out[-1])
                if held >= roll:
                    yield finish()
        if out:
            yield finish()

    def name_them(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for name in batch.column("name").to_pylist():
                if system.get_file_info(f"{base}/_{name}").type != pafs.FileType.NotFound:  # else an earlier try has named it
                    system.move(f"{base}/_{name}", f"{base}/part-{name}.warc.zst")
            yield batch.select(["n"])

    told = stored(rows.mapInArrow(run, "name string, n long"), "archives")
    return told.mapInArrow(name_them, "n long").agg(F.sum("n")).first()[0] or 0


def read(spark: SparkSession, folder: str) -> DataFrame:
    """(page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload) of all records under folder; payload is null for revisits."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder).select("content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload")
        kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary())
        batch_of = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds, strict=True)], list(names))
        for batch in batches:
            for content in batch.column("content"):
                rows, held = [], 0
                for data in frames(content.as_py()):
                    rows.append(parse(data))
                    held += len(data)
                    if held > 8 << 20:
                        yield batch_of(rows)
                        rows, held = [], 0
                if rows:
                    yield batch_of(rows)

    return files.mapInArrow(run, _SCHEMA)


def round_trip(pages: DataFrame, folder: str, **columns: str) -> DataFrame:
    """Write all pages to folder and read the archives back."""
    if not write(pages, folder, **columns):
        return pages.sparkSession.createDataFrame([], _SCHEMA)
    return read(pages.sparkSession, folder)
