"""A document's way from blocks to stored passages and questions, composed of the operators of this package.

Each step takes and returns tables of all documents; a run is a few Spark jobs, whatever the number of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.functions import formats, text
from lodestar.operators import chunking, dedup, layout, upsert
from lodestar.shared import keep
from lodestar.sources import documents as sources


def prepare(found: DataFrame, documents: DataFrame, chunks: DataFrame, force: bool = False) -> DataFrame:
    """Files (script_id, object_key, content) to work on, with file_hash, version and what was there before.

    A file whose document (same script and hash) has all the passages that it declares is left out, unless forced."""
    own = found.select("script_id", "object_key", F.sha2("content", 256).alias("file_hash"))
    have = chunks.groupBy(F.col("document_id").alias("id")).agg(F.count("*").alias("have"))
    known = documents.join(have, "id", "left").select("script_id", "file_hash", "id", (F.col("total_chunks") > 0).alias("declared"), (F.coalesce("have", F.lit(0)) >= F.col("total_chunks")).alias("whole"))
    out = own.join(known, ["script_id", "file_hash"], "left").join(upsert.next_version(documents, "script_id"), "script_id", "left")
    done = F.coalesce(F.col("declared") & F.col("whole"), F.lit(False)) & F.lit(not force)
    return out.where(~done).select("script_id", "object_key", "file_hash", F.col("id").alias("document_id"), F.coalesce("next_version", F.lit(1)).alias("version"))


def passages(shards: DataFrame, limits: chunking.Limits = chunking.Limits(), split: Callable[[str], list[str]] | None = None, most: int = 3) -> tuple[DataFrame, DataFrame]:
    """Kept passages, numbered anew, with content_hash and simhash; and counts of each document.

    Shards are stitched, page heads and noise go, headings are graded, and blocks become passages that are held against
    the document's earlier ones.  dropped_chunks counts noise as well."""
    blocks = keep(layout.stitch(shards), "blocks")
    clean = keep(layout.strip_noise(blocks), "clean")
    cut = keep(chunking.chunk_blocks(layout.section_paths(layout.calibrate(clean)), limits, split), "passages")
    items = cut.select("document_id", F.col("chunk_index").alias("ord"), "text")
    verdicts = dedup.greedy(items, limits.least, most)
    told = verdicts.where("verdict = 'kept'").select("document_id", F.col("ord").alias("chunk_index"), "content_hash", "simhash")
    kept = cut.join(told, ["document_id", "chunk_index"])
    noise = blocks.groupBy("document_id").agg(F.count("*").alias("b"), F.max("page").alias("total_pages")).join(clean.groupBy("document_id").agg(F.count("*").alias("c")), "document_id", "left")
    noise = noise.select("document_id", "total_pages", (F.col("b") - F.coalesce("c", F.lit(0))).alias("noise"))
    counts = noise.join(dedup.stats(verdicts), "document_id", "left").fillna(0, ["total", "kept"])
    counts = counts.select("document_id", "total_pages", F.col("kept").alias("total_chunks"), (F.col("total") - F.col("kept") + F.col("noise")).alias("dropped_chunks"))
    return layout.renumber(kept), counts


def questions(chunks: DataFrame, model: Callable[[list[str]], str], per_batch: int = 3) -> DataFrame:
    """Question and answer pairs of each document's passages, with their passage's hash, place, path and last heading."""
    source = chunks.withColumn("pos", (F.col("chunk_index") % per_batch).cast("int")).withColumn("batch", F.floor(F.col("chunk_index") / per_batch).cast("int"))
    source = source.withColumn("batch_id", F.concat_ws(":", "document_id", "batch"))
    answers = sources.generate_batches(source.select("batch_id", "pos", "text"), model)
    pairs = sources.to_source(sources.pairs_of(answers), source.select("batch_id", "pos", "document_id", "content_hash", "page_start", "page_end", "section_path"))
    title = F.coalesce(text.strip(F.try_element_at("section_path", F.lit(-1))), F.lit(""))
    return pairs.select("document_id", "question", "answer", text.question_hash(F.col("question")).alias("question_hash"), "category", title.alias("title"), "content_hash", "page_start", "page_end", "section_path")


def store(chunks: DataFrame, qa: DataFrame, model: Callable[[list[str]], list[list[float]]], dimension: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Passages (embedded with their section path, stored as they are) and questions with their vectors; of rows with
    one key the first of a batch stays, as a write would leave it."""
    own = upsert.first_per_key(chunks, ["document_id", "content_hash"], ["chunk_index"])
    asked = upsert.first_per_key(qa, ["document_id", "question_hash"], ["content_hash", "question"])
    return sources.embed(own, model, formats.breadcrumb(F.col("section_path"), F.col("text")), dimension=dimension), sources.embed(asked, model, F.col("question"), dimension=dimension)
