"""Uploaded files as a Spark data source: a row with a verdict for every file, the rejected and the empty ones too.

    spark.dataSource.register(Uploads)
    spark.read.format("uploads").load("s3://bucket/folder")

The folder is listed once, by `pyarrow.fs`, which must reach it from the driver and the executors; files are dealt to
partitions by their bytes, the largest first. A file beyond the bound is never read; others are read one at a time and
decoded strictly. A bad file is a row, never a failed task; one that cannot be read is UNREADABLE.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

MAX_BYTES, MAX_PAGES = 10 * 1024 * 1024, 300
SCHEMA = "name string, size long, digest string, verdict string, pages int, text string"
_PACKED = re.compile(rb"/ObjStm.{0,500}?>>\s{0,9}stream\r?\n", re.S)
_PAGE = re.compile(rb"/Type\s*/Page(?![A-Za-z])")


@dataclass
class Share(InputPartition):
    """Files (path, name, size) that one task reads."""

    files: list[tuple[str, str, int]]


def shares(files: list[tuple[str, str, int]], most: int) -> list[Share]:
    """files in at most `most` shares of about as many bytes each: the largest file goes to the share that has the fewest."""
    heap = [(0, k) for k in range(max(1, min(most, len(files))))]
    out: list[list[tuple[str, str, int]]] = [[] for _ in heap]
    for f in sorted(files, key=lambda f: (-f[2], f[0])):
        size, k = heapq.heappop(heap)
        out[k].append(f)
        heapq.heappush(heap, (size + min(f[2], MAX_BYTES) + 4096, k))
    return [Share(f) for f in out]


def name_verdict(name: str, size: int) -> str | None:
    """The verdict that needs no content: a name with separators of any system, control characters or another ending; size."""
    if re.search(r"[/\\\x00-\x1f]|^\.", name) or not re.search(r"\.(txt|pdf)$", name, re.I):
        return "BAD_NAME"
    return "EMPTY" if size == 0 else "TOO_LARGE" if size > MAX_BYTES else None


def pdf_pages(data: bytes) -> int:
    """The number of page objects, those in compressed object streams too."""
    count = len(_PAGE.findall(data))
    for m in _PACKED.finditer(data):
        try:
            count += len(_PAGE.findall(zlib.decompressobj().decompress(data[m.end() :], 16 * 1024 * 1024)))
        except zlib.error:
            continue
    return count


def judged(name: str, data: bytes) -> tuple[str, int | None, str | None]:
    """(verdict, pages, text) of a file's content: OK, NOT_UTF8, BLANK, or of a PDF UNREADABLE, ENCRYPTED, TOO_MANY_PAGES."""
    if name.lower().endswith(".txt"):
        try:
            text = data.decode("utf-8")
        except UnicodeDecodeError:
            return "NOT_UTF8", None, None
        return ("OK", 1, text) if text.strip() else ("BLANK", 1, None)
    if not data.startswith(b"%PDF-"):
        return "UNREADABLE", None, None
    if re.search(rb"/Encrypt\s", data):
        return "ENCRYPTED", None, None
    pages = pdf_pages(data)
    return "UNREADABLE" if not pages else "TOO_MANY_PAGES" if pages > MAX_PAGES else "OK", pages or None, None


class _Reader(DataSourceReader):
    def __init__(self, path: str, most: int):
        self.path, self.most = path, most

    def partitions(self) -> list[Share]:
        from pyarrow import fs

        found, base = fs.FileSystem.from_uri(self.path)
        base = base.rstrip("/")
        infos = found.get_file_info(fs.FileSelector(base, recursive=True))
        return shares([(i.path, i.path[len(base) + 1 :], i.size) for i in infos if i.type == fs.FileType.File], self.most)

    def read(self, partition: Share) -> Iterator[tuple]:
        from pyarrow import fs

        found, _ = fs.FileSystem.from_uri(self.path)
        for path, name, size in partition.files:
            verdict = name_verdict(name, size)
            if verdict:
                yield name, size, None, verdict, None, None
                continue
            try:
                with found.open_input_stream(path) as f:
                    data = f.read(MAX_BYTES + 1)
            except OSError:
                yield name, size, None, "UNREADABLE", None, None
                continue
            yield name, len(data), hashlib.sha256(data).hexdigest(), *judged(name, data)


class Uploads(DataSource):
    """Options: path (of a folder, as a URI) and partitions (200 at most unless given)."""

    @classmethod
    def name(cls) -> str:
        return "uploads"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(self.options["path"], int(self.options.get("partitions", 200)))
