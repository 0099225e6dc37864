"""Multipart uploads: parts that are missing or differ, progress, references to objects, matching earlier uploads."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MB = 1 << 20


def part_plan(files: DataFrame, size: str = "file_size", chunk: str = "chunk_size", most: int = 10_000) -> DataFrame:
    """total_parts; a part size that makes too many parts grows to the next whole megabyte."""
    wide = F.ceil(F.col(size) / most / MB) * MB
    out = files.withColumn("part_size", F.when(F.ceil(F.col(size) / F.col(chunk)) > most, wide).otherwise(F.col(chunk)).cast("long"))
    return out.withColumn("total_parts", F.greatest(F.lit(1), F.ceil(F.col(size) / F.col("part_size"))).cast("int"))


def missing_parts(tasks: DataFrame, parts: DataFrame, shown: int = 50) -> DataFrame:
    """(task_id, n_missing, missing): part numbers from 1 to total_parts that aren't stored; the first few are listed."""
    want = tasks.select("task_id", F.explode(F.sequence(F.lit(1), F.col("total_parts"))).alias("part_number"))
    gone = want.join(parts.select("task_id", "part_number").distinct(), ["task_id", "part_number"], "left_anti")
    return gone.groupBy("task_id").agg(F.count("*").alias("n_missing"), F.slice(F.array_sort(F.collect_list("part_number")), 1, shown).alias("missing"))


def differing_parts(told: DataFrame, stored: DataFrame, shown: int = 20) -> DataFrame:
    """Parts whose tag as told differs from the stored one, quotes aside; the first few of each task."""

    def bare(c):
        return F.regexp_replace(c, '^"+|"+$', "")

    s = stored.select("task_id", "part_number", bare(F.col("etag")).alias("stored_etag"))
    out = told.select("task_id", "part_number", bare(F.col("etag")).alias("told_etag")).join(s, ["task_id", "part_number"]).where("told_etag <> stored_etag")
    w = Window.partitionBy("task_id").orderBy("part_number")
    return out.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= shown).drop("__n")


def progress(tasks: DataFrame, parts: DataFrame) -> DataFrame:
    """Bytes stored and percent done, two places; a completed task is done."""
    have = parts.groupBy("task_id").agg(F.sum("size").alias("uploaded_bytes"), F.count("*").alias("n_parts"))
    out = tasks.join(have, "task_id", "left").withColumn("uploaded_bytes", F.coalesce("uploaded_bytes", F.lit(0))).withColumn("n_parts", F.coalesce("n_parts", F.lit(0)))
    share = F.least(F.lit(100.0), F.round(F.try_divide(F.col("uploaded_bytes") * 100.0, F.col("file_size")), 2))
    return out.withColumn("progress", F.when(F.col("status") == "completed", F.lit(100.0)).otherwise(F.coalesce(share, F.lit(0.0))))


def references(files: DataFrame) -> DataFrame:
    return files.where(F.col("deleted_at").isNull()).groupBy("object_key").agg(F.count("*").alias("refs"))


def orphans(files: DataFrame) -> DataFrame:
    """Object keys that only deleted rows refer to: their objects can go."""
    return files.select("object_key").distinct().join(references(files), "object_key", "left_anti")


def _inside(rows: DataFrame, prefix: str | None) -> DataFrame:
    return rows.where(F.startswith("object_key", F.lit(f"{prefix}/"))) if prefix else rows


def _latest(rows: DataFrame, wanted: DataFrame, found: str, keys: list[str]) -> DataFrame:
    own = wanted.where(F.coalesce(F.trim("file_hash"), F.lit("")) != "").select(*keys).distinct()
    return rows.join(own, keys, "left_semi").groupBy(*keys).agg(F.max_by(found, F.struct("created_at", found)).alias(found))


def resumable(tasks: DataFrame, wanted: DataFrame, prefix: str | None = None) -> DataFrame:
    """The latest unfinished task of the same user, hash and size for each wanted upload with a hash."""
    return _latest(_inside(tasks.where(F.col("status") == "uploading"), prefix), wanted, "task_id", ["user_id", "file_hash", "file_size"])


def instant(files: DataFrame, wanted: DataFrame, prefix: str | None = None) -> DataFrame:
    """Wanted uploads that need no bytes: the latest file of the same user and hash, if its size is the wanted one."""
    live = _inside(files.where(F.col("deleted_at").isNull()), prefix)
    found = _latest(live, wanted, "file_id", ["user_id", "file_hash"])
    sizes = live.select("file_id", F.col("file_size").alias("__size"))
    own = wanted.select("user_id", "file_hash", "file_size").distinct()
    return own.join(found, ["user_id", "file_hash"]).join(sizes, "file_id").where(F.col("file_size") == F.col("__size")).drop("__size")


def listed_parts(parts: DataFrame, per_page: int = 1000) -> DataFrame:
    """Stored parts of each task in the order of their numbers, with the page of a listing that holds them."""
    at = F.row_number().over(Window.partitionBy("task_id").orderBy("part_number")) - 1
    return parts.withColumn("position", at).withColumn("page", F.floor(F.col("position") / per_page).cast("int"))


def user_files(files: DataFrame, user: str, word: str | None = None) -> DataFrame:
    from lodestar.functions.text import keyword

    out = files.where((F.col("user_id") == user) & F.col("deleted_at").isNull() & ~F.col("object_key").like("avatars/%"))
    return out.where(F.col("filename").ilike(f"%{keyword(word)}%")) if word and keyword(word) else out
