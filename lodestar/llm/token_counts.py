"""Token counts: a separator scan over flat token files without an index.

A file is a stream of ids cut into blocks at fixed places, whatever documents they hold; each document ends with the
end-of-document id.  `scan` finds separators in each block by itself with numpy, then stitches: a prefix scan over a
file's blocks (ids before, documents before, place of the last separator before) turns separators into lengths, also
of documents that begin blocks earlier.  Files are rows (file, block, data): as written by `write`, or cut from binary
files by `blocks_of_files`.

Defined results: null and empty texts have no tokens; what follows a file's last separator is a last document without
one, if it has tokens; repeated rows are counted each; a null doc_id stays null; extra columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import pieces, shared_dir
from .encoder import shared

#: Ids in a block.
BLOCK_IDS = 1 << 20
FILES = "file long, block int, data binary, names array<long>"


def write(docs: DataFrame, tokenizer: str, path: str, separator: int = 49407, id_col: str = "doc_id", text_col: str = "text") -> None:
    """A file for each task: blocks of 16-bit ids, and, beside the stream, the documents' ids in their order."""
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared(tokenizer, ordinary=True)
        file, block = TaskContext.get().partitionId(), 0
        held, rows = [], 0
        names: list[pa.Array] = []

        def row(data: bytes | None, k: int, own: pa.Array | None) -> pa.RecordBatch:
            listed = pa.array([None], pa.list_(pa.int64())) if own is None else pa.ListArray.from_arrays([0, len(own)], own)
            return pa.RecordBatch.from_arrays([pa.array([file], pa.int64()), pa.array([k], pa.int32()), pa.array([data], pa.binary()), listed], names=["file", "block", "data", "names"])

        for batch in batches:
            names.append(batch.column(0))
            for _, _, raw, offsets in pieces(batch, "text"):
                ids, at = encoder.encode(raw, offsets)
                held.append(np.insert(ids, at[1:], separator).astype("<u2"))
                rows += len(held[-1])
                if rows >= 4 * BLOCK_IDS:
                    stream = np.concatenate(held)
                    for k in range(0, rows - rows % BLOCK_IDS, BLOCK_IDS):
                        yield row(stream[k : k + BLOCK_IDS].tobytes(), block, None)
                        block += 1
                    held = [stream[rows - rows % BLOCK_IDS :]]
                    rows = len(held[0])
        stream = np.concatenate(held) if held else np.empty(0, "<u2")
        for k in range(0, len(stream), BLOCK_IDS):
            yield row(stream[k : k + BLOCK_IDS].tobytes(), block, None)
            block += 1
        if names:
            yield row(None, -1, pa.concat_arrays(names))

    own.mapInArrow(encode, FILES).write.option("compression", "zstd").parquet(path)


def blocks_of_files(files: DataFrame, block_ids: int = BLOCK_IDS, width: int = 2) -> DataFrame:
    """Blocks of flat files that `spark.read.format("binaryFile")` has read (path, content)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = content.as_buffer()
                for k in range(0, data.size, block_ids * width):
                    yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([k // (block_ids * width)], pa.int32()), pa.array([data[k : k + block_ids * width].to_pybytes()], pa.binary())], names=["file", "block", "data"])

    return files.select("path", "content").mapInArrow(cut, "file string, block int, data binary")


def scan(blocks: DataFrame, separator: int = 49407, width: int = 2) -> DataFrame:
    """(file, ordinal, n_tokens) of every document in the files; tokens without the separator."""
    kind = dict(blocks.dtypes)["file"]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, data in enumerate(batch.column(2)):
                ids = np.frombuffer(data.as_buffer(), f"<u{width}")
                at = np.flatnonzero(ids == separator).astype("<u4")
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(k, 1), batch.column(1).slice(k, 1), pa.array([len(ids)]), pa.array([len(at)]),
                    pa.array([int(at[-1]) if len(at) else None], pa.int64()), pa.array([at.tobytes()], pa.binary()),
                ], names=["file", "block", "n", "seps", "last", "at"])

    found = blocks.select("file", "block", "data").mapInArrow(find, f"file {kind}, block int, n long, seps long, last long, at binary")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    found = found.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).withColumn("first", F.coalesce(F.sum("seps").over(before), F.lit(0)))
    found = found.withColumn("prior", F.coalesce(F.max(F.col("base") + F.col("last")).over(before), F.lit(-1)))
    found = found.withColumn("final", F.lead("block").over(Window.partitionBy("file").orderBy("block")).isNull())

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = {name: batch.column(i).to_pylist() for i, name in enumerate(batch.schema.names) if name not in ("at", "file")}
            for k, data in enumerate(batch.column(batch.schema.get_field_index("at"))):
                at = np.frombuffer(data.as_buffer(), "<u4").astype(np.int64) + c["base"][k]
                ends = np.concatenate([[c["prior"][k]], at])
                size = np.diff(ends) - 1
                rest = c["base"][k] + c["n"][k] - 1 - ends[-1]
                if c["final"][k] and rest:
                    size = np.append(size, rest)
                n = len(size)
                file = pa.array([batch.column(0)[k].as_py()] * n, batch.schema.field(0).type)
                yield pa.RecordBatch.from_arrays([file, pa.array(c["first"][k] + np.arange(n)), pa.array(size)], names=["file", "ordinal", "n_tokens"])

    return found.select("file", "block", "n", "base", "first", "prior", "final", "at").mapInArrow(lengths, f"file {kind}, ordinal long, n_tokens long")


def count_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id") -> DataFrame:
    """Write docs as flat token files, count by scanning them, and name the documents."""
    spark: SparkSession = docs.sparkSession
    path = f"{shared_dir(spark)}/lodestar-flat-{uuid.uuid4().hex}"
    write(docs, tokenizer, path, id_col=id_col)
    files = spark.read.schema(FILES).parquet(path)
    counts = scan(files.where("block >= 0"))
    names = files.where("block = -1").select("file", F.posexplode("names").alias("ordinal", id_col))
    return names.join(counts, ["file", "ordinal"]).select(id_col, "file", "ordinal", "n_tokens")
