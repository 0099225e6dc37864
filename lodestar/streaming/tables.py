"""Tables that micro-batches write into by key, so that a repeated batch changes nothing.

Each batch writes the whole table anew as a version with the batch's number, made from the newest complete version
before it.  A batch that is run again after a failure reads the same version and replaces its own, so its rows count
once.  Only the version before the last is kept besides it.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestar.shared import shared_dir


class VersionedTable:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _versions(self) -> list[int]:
        """Numbers of the versions that were written to their end."""
        jvm = self.spark._jvm
        top = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = top.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())
        if not fs.exists(top):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(top)]
        whole = (n for n in names if n.startswith("v") and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{self.path}/{n}/_SUCCESS")))
        return sorted(int(n[1:]) for n in whole)

    def read(self, before: int | None = None) -> DataFrame | None:
        """The newest version (before one), or nothing."""
        found = [v for v in self._versions() if before is None or v < before]
        return self.spark.read.parquet(f"{self.path}/v{found[-1]:012d}") if found else None

    def write(self, rows: DataFrame, version: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/v{version:012d}")
        jvm = self.spark._jvm
        fs = jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())
        for old in [v for v in self._versions() if v < version][:-1]:
            fs.delete(jvm.org.apache.hadoop.fs.Path(f"{self.path}/v{old:012d}"), True)


def merging(table: VersionedTable, merge: Callable[[DataFrame | None, DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """What foreachBatch calls: the table before the batch and the batch's rows become the table."""

    def batch(rows: DataFrame, number: int) -> None:
        table.write(merge(table.read(before=number), rows), number)

    return batch


def run_into(stream: DataFrame, table: VersionedTable, merge: Callable[[DataFrame | None, DataFrame], DataFrame], checkpoint: str) -> DataFrame | None:
    """All that the stream has now into the table; called again with the same checkpoint it goes on behind that."""
    writer = stream.writeStream.foreachBatch(merging(table, merge)).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    writer.start().awaitTermination()
    return table.read()


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's name in the shared folder."""
    return f"{shared_dir(spark)}/lodestar-{name}-{uuid.uuid4().hex}"
