"""Question titles in the order of the story, and the tree of their section paths as a flat node table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions.formats import category_text, page_range
from lodestar.functions.text import strip

UNTITLED = "untitled"


def title_list(qa: DataFrame, documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """Questions of active documents with pos: by document, chunk (without one last), then question."""
    live = documents.where(F.col("deleted_at").isNull() & F.col("is_active")).select(F.col("id").alias("document_id"), F.col("created_at").alias("__doc"))
    parts = chunks.select(F.col("id").alias("chunk_id"), F.col("chunk_index").alias("__chunk"))
    out = qa.join(live, "document_id").join(parts, "chunk_id", "left")
    order = Window.partitionBy("script_code").orderBy("__doc", F.asc_nulls_last("__chunk"), "created_at", "id")
    return out.withColumn("pos", F.row_number().over(order) - 1).drop("__doc", "__chunk")


def answers_of(qa: DataFrame, scripts: DataFrame, params: DataFrame) -> DataFrame:
    """Questions and answers of the one script whose code a parameter table (script_code, one row) names, by category and
    age: category, question, answer, pages.  A script that is deleted or not there has none."""
    own = scripts.where(F.col("deleted_at").isNull() & (F.col("code") == params.select("script_code").scalar()))
    out = qa.join(own.select(F.col("id").alias("script_id")), "script_id").orderBy("category", "created_at")
    return out.select(category_text(F.col("category")).alias("category"), "question", "answer", page_range(F.col("page_start"), F.col("page_end")).alias("pages"))


def tree_nodes(rows: DataFrame, within: str = "script_code") -> DataFrame:
    """(within, path, title, parent, depth, first_pos, qa_count): every prefix of every path once; order of first
    appearance is first_pos; rows without a path share one untitled node.  rows: within, pos, section_path."""
    path = F.filter(F.transform(F.coalesce("section_path", F.array().cast("array<string>")), strip), lambda x: x != "")
    own = rows.select(within, "pos", F.when(F.size(path) > 0, path).otherwise(F.array(F.lit(UNTITLED))).alias("own"))
    steps = own.select(within, "pos", "own", F.explode(F.sequence(F.lit(1), F.size("own"))).alias("depth"))
    steps = steps.select(within, "pos", "depth", F.slice("own", 1, F.col("depth")).alias("path"), (F.col("depth") == F.size("own")).alias("leaf"))
    nodes = steps.groupBy(within, "path").agg(F.first("depth").alias("depth"), F.min("pos").alias("first_pos"), F.count_if("leaf").alias("qa_count"))
    return nodes.select(within, "path", F.element_at("path", -1).alias("title"), F.slice("path", 1, F.col("depth") - 1).alias("parent"), "depth", "first_pos", "qa_count")


def tree_totals(nodes: DataFrame, within: str = "script_code") -> DataFrame:
    return nodes.groupBy(within).agg(F.count_if(F.col("qa_count") > 0).alias("n_titles"), F.sum("qa_count").alias("n_qa"), F.count_if(F.col("depth") == 1).alias("n_roots"))


def empty_path_share(rows: DataFrame, within: str) -> DataFrame:
    empty = F.coalesce(F.size("section_path") <= 0, F.lit(True))
    return rows.groupBy(within).agg(F.count("*").alias("total"), F.count_if(empty).alias("empty"))


def backfill_titles(qa: DataFrame) -> DataFrame:
    """A blank title becomes the path's last element, where it has one."""
    blank = F.coalesce(strip(F.col("title")), F.lit("")) == ""
    return qa.withColumn("title", F.when(blank, F.coalesce(F.try_element_at("section_path", F.lit(-1)), F.col("title"))).otherwise(F.col("title")))
