"""Token-ID output: documents' ids in ascending order of doc_id, in shards compressed by Re-Pair.

`write` deals the documents into ranges of doc_id, encodes each range in order and writes its shards as rows of a
parquet table (any store that Spark writes to will do): range, shard, n_docs, n_ids, data.  `data` is the file format
of repair.Shard: rules, expansion lengths and symbols, with a check sum.  `read` decodes them; `read_documents`
decodes single documents without expanding their neighbours.

Defined results: null and empty texts hold the end id alone; null ids come first; rows that share an id are ordered by
text; extra columns are ignored; an empty table gives no shards.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import CLEANUP, pieces, shared_dir, shuffle_width
from .encoder import shared
from .repair import Shard

#: Ids after which a shard is closed.
SHARD_IDS = 2_000_000
SHARDS = "range int, shard int, n_docs long, n_ids long, data binary"


def write(docs: DataFrame, tokenizer: str, path: str, end_id: int = 2, vocabulary: int = 49408, id_col: str = "doc_id", text_col: str = "text") -> None:
    spark = docs.sparkSession
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    own = own.repartitionByRange(shuffle_width(spark), "id").sortWithinPartitions("id", "text")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared(tokenizer)
        part, shard = TaskContext.get().partitionId(), 0
        held: list[tuple] = []
        rows = 0

        def close() -> pa.RecordBatch:
            ids = np.concatenate([x[2] for x in held])
            size = np.concatenate([np.diff(x[3]) for x in held])
            data = Shard.of(np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held]), ids, np.concatenate([[0], np.cumsum(size)]), vocabulary, end_id).to_bytes()
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([shard], pa.int32()), pa.array([len(size)]), pa.array([len(ids)]), pa.array([data], pa.binary())], names=["range", "shard", "n_docs", "n_ids", "data"])

        for batch in batches:
            for lo, hi, raw, offsets in pieces(batch, "text"):
                ids, at = encoder.encode(raw, offsets)
                key = batch.column(0).slice(lo, hi - lo)
                has = np.asarray(key.is_valid().to_numpy(zero_copy_only=False), bool)
                held.append((key.fill_null(0).to_numpy(zero_copy_only=False), has, np.insert(ids, at[1:], end_id), at + np.arange(len(at))))
                rows += len(held[-1][2])
                if rows >= SHARD_IDS:
                    yield close()
                    held, rows, shard = [], 0, shard + 1
        if held:
            yield close()

    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        own.mapInArrow(encode, SHARDS).write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)


def read(spark: SparkSession, path: str, id_col: str = "doc_id", with_ids: bool = True) -> DataFrame:
    """A row for each document: its id, start, n_tokens, ids_crc32 and, if asked for, ids."""
    shards = spark.read.schema(SHARDS).parquet(path)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, number, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                shard = Shard.from_bytes(data.as_buffer().to_pybytes())
                ids, at = shard.all_ids().astype("<u4"), shard.starts()
                n = len(at) - 1
                view = memoryview(ids).cast("B")
                check = [zlib.crc32(view[4 * at[k] : 4 * at[k + 1]]) for k in range(n)]
                cols = [pa.array(np.full(n, part, np.int32)), pa.array(np.full(n, number, np.int32)), pa.array(shard.doc_ids, mask=~shard.has_id), pa.array(at[:-1]), pa.array(np.diff(at)), pa.array(check, pa.int64())]
                names = ["range", "shard", "id", "at", "n_tokens", "ids_crc32"]
                if with_ids:
                    cols.append(pa.ListArray.from_arrays(at.astype(np.int32), pa.array(ids.astype(np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names=names)

    found = shards.select("range", "shard", "data").mapInArrow(decode, "range int, shard int, id long, at long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids)
    # ids before each shard: sums of ranges, then of shards within a range
    sizes = shards.select("range", "shard", "n_ids")
    ranges = sizes.groupBy("range").agg(F.sum("n_ids").alias("n"))
    ranges = ranges.withColumn("before", F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1))).select("range", F.coalesce("before", F.lit(0)).alias("before"))
    inner = F.sum("n_ids").over(Window.partitionBy("range").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    base = sizes.withColumn("inner", F.coalesce(inner, F.lit(0))).join(ranges, "range").select("range", "shard", (F.col("before") + F.col("inner")).alias("base"))
    out = found.join(base, ["range", "shard"])
    return out.select(F.col("id").alias(id_col), (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if with_ids else []))


def read_documents(spark: SparkSession, path: str, ids: list[int]) -> DataFrame:
    """Random access: (doc_id, ids) of the documents asked for, each decoded alone."""
    wanted = np.sort(np.array(ids, np.int64))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                shard = Shard.from_bytes(data.as_buffer().to_pybytes())
                for k in np.flatnonzero(np.isin(shard.doc_ids, wanted) & shard.has_id):
                    yield pa.RecordBatch.from_arrays([pa.array([shard.doc_ids[k]], pa.int64()), pa.array([shard.document(k).tolist()], pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return spark.read.schema(SHARDS).parquet(path).select("data").mapInArrow(decode, "doc_id long, ids array<int>")


def round_trip(docs: DataFrame, tokenizer: str, with_ids: bool = False) -> DataFrame:
    """Write the shards of docs to the shared folder and read them back."""
    spark = docs.sparkSession
    path = f"{shared_dir(spark)}/lodestar-tokens-{uuid.uuid4().hex}"
    write(docs, tokenizer, path)
    return read(spark, path, with_ids=with_ids)
