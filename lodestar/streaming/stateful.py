"""Stateful streams: near duplicates with fingerprints that expire, and tasks that time out.

Both keep their state by key in Spark's state store (RocksDB), so a restarted query goes on where it stopped.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lodestar.functions.fingerprint import BANDS, simhash_of
from lodestar.functions.text import normal, normal_nfkc

STORE, ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Micro-batches without data: timers of event time need one at the end, state that expires by the wall clock never stops asking for them.
IDLE = "spark.sql.streaming.noDataMicroBatches.enabled"
DAY_MS = 24 * 3600 * 1000


@contextmanager
def state_store(spark: SparkSession, idle: bool) -> Iterator[None]:
    """The settings that these streams need, while a query is started and run; idle: with micro-batches without data."""
    told = {STORE: ROCKS, IDLE: str(idle).lower()}
    before = {k: spark.conf.get(k) for k in told}
    try:
        for k, v in told.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


class NearDuplicates(StatefulProcessor):
    """Verdicts of a namespace's items in the order in which they come: only kept items leave a hash and a fingerprint
    behind, and these are forgotten `ttl_ms` after they were last written."""

    def __init__(self, least: int, most: int, ttl_ms: int, kind: str):
        self.least, self.most, self.ttl_ms, self.kind = least, most, ttl_ms, kind

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.hashes = handle.getMapState("hashes", "hash string", "seen boolean", self.ttl_ms)
        self.bands = handle.getMapState("bands", "band int, value int", "prints array<long>", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        found = pd.concat(list(rows)).sort_values("ord", kind="stable", na_position="first")
        seen: dict[str, bool] = {}
        near: dict[tuple[int, int], list[int]] = {}
        fresh, touched, verdicts = [], set(), []
        for n, digest, simhash in zip(found["n"], found["hash"], found["simhash"], strict=True):
            verdicts.append(self._verdict(int(n), digest, int(simhash), seen, near, fresh, touched))
        for digest in fresh:
            self.hashes.updateValue((digest,), (True,))
        for band in touched:
            self.bands.updateValue(band, (near[band],))
        yield pd.DataFrame({"within": [key[0]] * len(found), "ord": found["ord"].astype(self.kind).to_numpy(), "verdict": verdicts})

    def _verdict(self, n: int, digest: str, simhash: int, seen: dict, near: dict, fresh: list, touched: set) -> str:
        if n < self.least:
            return "short"
        if digest not in seen:
            seen[digest] = self.hashes.containsKey((digest,))
        if seen[digest]:
            return "exact"
        own = [(i, simhash >> (16 * i) & 65535) for i in range(BANDS)] if self.most > 0 and simhash else []
        for band in own:
            if band not in near:
                near[band] = [int(x) for x in self.bands.getValue(band)[0]] if self.bands.containsKey(band) else []
        if any(((simhash ^ other) & 0xFFFFFFFFFFFFFFFF).bit_count() <= self.most for band in own for other in near[band]):
            return "near"
        seen[digest] = True
        fresh.append(digest)
        for band in own:
            near[band].append(simhash)
            touched.add(band)
        return "kept"

    def close(self) -> None:
        pass


def near_duplicates(items: DataFrame, least: int = 150, most: int = 3, ttl_ms: int = 7 * DAY_MS, within: str = "document_id", order: str = "ord", text_col: str = "text", compatible: bool = True, md5: bool = False) -> DataFrame:
    """within, ord, verdict (kept, short, exact, near) of a stream of items, as dedup.greedy gives them for a table.

    Items of a namespace count as coming in `order` within a micro-batch and after all of earlier ones.  Null texts are
    empty.  A namespace is one state and is meant to be a document: its batch of hashes passes one task."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    text = normal_nfkc(text) if compatible else normal(text)
    own = items.select(F.col(within).alias("within"), F.col(order).alias("ord"), text.alias("norm"))
    own = own.select("within", "ord", F.length("norm").alias("n"), F.sha2("norm", 256).alias("hash"), simhash_of("norm", md5).alias("simhash"))
    kinds = dict(own.dtypes)
    processor = NearDuplicates(least, most, ttl_ms, {"bigint": "int64", "int": "int32", "string": "object"}.get(kinds["ord"], "object"))
    schema = f"within {kinds['within']}, ord {kinds['ord']}, verdict string"
    return own.groupBy("within").transformWithStateInPandas(processor, schema, outputMode="append", timeMode="ProcessingTime")


def expired(tasks: DataFrame, hours: float = 24, late: str = "0 seconds", message: str = "expired") -> DataFrame:
    """Failures of tasks (task_id, status, error_message, updated_at) that stay uploading for longer than `hours`, by the
    stream's own clock: the newest updated_at less `late`.  Rows older than that clock by `hours` are late and are left out.

    A task's updates that follow within `hours` are a session, which ends a millisecond after that time without a further
    one; sessions whose last update was uploading have failed.  Of updates at the same time one that ends the task counts
    as the last.  Sessions are Spark's own state, so no task's state passes through Python."""
    at = F.col("updated_at").cast("timestamp")
    own = tasks.select("task_id", "status", F.col("error_message").cast("string").alias("error_message"), at.alias("updated_at")).withWatermark("updated_at", late)
    gap = f"{round(hours * 3_600_000) + 1} milliseconds"
    last = F.max_by(F.struct("status", "error_message"), F.struct("updated_at", F.col("status") != "uploading"))
    open_ = own.groupBy(F.session_window("updated_at", gap), "task_id").agg(last.alias("last")).where("last.status = 'uploading'")
    return open_.select("task_id", F.lit("failed").alias("status"), F.coalesce("last.error_message", F.lit(message)).alias("error_message"))
