"""Page ranges of layout files as the partitions of a Python data source.

A reader is a class with `open(path)`, which returns a document with `page_count` and `page(n)`, the lines of page n
(from 1) as {block_no, line_no, spans}; libraries of page formats are plugged in so.  Each shard of layout.plan_shards
opens its document anew and reads its pages alone; a page that can't be read is left out, a document that can't be
opened gives nothing.  The lines go on through layout.paragraphs.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from typing import Any, Protocol

import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lodestar.operators.layout import plan_shards

LINES = "document_id string, shard_index int, page int, block_no int, line_no int, spans array<struct<text:string,size:double,flags:int>>"
#: Tasks of one source at most; beyond that a task reads several shards.
MOST_TASKS = 10_000


class Document(Protocol):
    page_count: int

    def page(self, n: int) -> list[dict[str, Any]]: ...


class Reader(Protocol):
    def open(self, path: str) -> Document: ...


def read_bytes(path: str) -> bytes:
    """A file of a local folder or of a store that Arrow knows by its scheme."""
    system, inner = pyarrow.fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pyarrow.fs.LocalFileSystem(), path)
    with system.open_input_stream(inner) as f:
        return f.read()


class FormFeedText:
    """Plain text with form feeds between its pages, as text extractors write it: blank lines part blocks."""

    def __init__(self, size: float = 10.5):
        self.size = size

    def open(self, path: str) -> Document:
        return _FormFeedDocument(read_bytes(path).decode(errors="replace").split("\f"), self.size)


class _FormFeedDocument:
    def __init__(self, pages: list[str], size: float):
        self.pages, self.size, self.page_count = pages, size, len(pages)

    def page(self, n: int) -> list[dict[str, Any]]:
        lines, block = [], 0
        for i, line in enumerate(self.pages[n - 1].split("\n")):
            if line.strip():
                lines.append({"block_no": block, "line_no": i, "spans": [(line, self.size, 0)]})
            else:
                block += 1
        return lines


class Shards(InputPartition):
    def __init__(self, shards: list[tuple[str, int, int, int]]):
        self.shards = shards


def _read(reader: Reader, path: str, shard: int, first: int, last: int) -> Iterator[tuple]:
    try:
        document = reader.open(path)
    except Exception:  # noqa: BLE001  a file that can't be read has no lines
        return
    for n in range(max(1, first), min(last, document.page_count) + 1):
        try:
            lines = document.page(n)
        except Exception:  # noqa: BLE001  nor has such a page
            continue
        for x in lines:
            yield path, shard, n, x["block_no"], x["line_no"], [tuple(s) for s in x["spans"]]


def read_shards(documents: DataFrame, reader: Reader, per_shard: int = 20, most_tasks: int = MOST_TASKS) -> DataFrame:
    """Lines of documents (path, total_pages), one task for each shard of pages: LINES, for layout.paragraphs.

    The driver holds the plan, a few numbers a shard, as it holds any scan's file splits."""
    planned = plan_shards(documents.selectExpr("path AS document_id", "total_pages"), per_shard)
    shards = [tuple(r) for r in planned.orderBy("document_id", "shard_index").collect()]
    step = max(1, -(-len(shards) // most_tasks))
    parts = [Shards(shards[i : i + step]) for i in range(0, len(shards), step)]

    name = f"lodestar_pages_{uuid.uuid4().hex}"

    class PageReader(DataSourceReader):
        def partitions(self) -> list[InputPartition]:
            return parts or [Shards([])]

        def read(self, partition: Shards) -> Iterator[tuple]:
            for shard in partition.shards:
                yield from _read(reader, *shard)

    class PageSource(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return LINES

        def reader(self, schema) -> DataSourceReader:
            return PageReader()

    spark = documents.sparkSession
    spark.dataSource.register(PageSource)
    return spark.read.format(name).load()
