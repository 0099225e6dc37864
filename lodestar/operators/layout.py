"""Layout analysis over text blocks: headings, section paths, page headers and footers, reading order, shards.

A block has document_id, ord, text, page, block_type, heading_level, font_size, is_bold and y_ratio.  All of it is
windows partitioned by document (or page), so documents are spread over the cluster.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType

from lodestar.functions.text import BLANKS, LIST_ITEM, SENTENCE_END, compare_key, ends, is_heading_like, is_noise, strip
from lodestar.shared import keep

LEVELS = 6
#: Bands at the top and bottom of a page where repeated lines are looked for, and what counts as its edge.
EDGE, EDGE_STEP = 0.12, 0.03
LARGER = 1.15
#: Share of bold characters that makes a paragraph bold, and the bit of a span's flags that says so.
BOLD_SHARE, BOLD_FLAG = 0.6, 16
# Fixed value: a line that ends so goes on in the next one.
UNFINISHED = r"[，,、；;：:（(\[【“\"'/\\—-]$"


def block_class(text: Column, size: Column, bold: Column, body: Column) -> tuple[Column, Column]:
    """(block_type, heading_level) by size against the body text, numbering and weight."""
    own = strip(text)
    ratio = F.when((body > 0) & (size > 0), size / body).otherwise(F.lit(1.0))
    short, numbered = F.length(own) <= 40, is_heading_like(own)
    level = (
        F.when((own == "") | own.rlike(LIST_ITEM), 0)
        .when((body > 0) & (ratio < 0.92), 0)
        .when(short & (ratio >= 1.6), 1)
        .when(short & (ratio >= 1.35), 2)
        .when(short & (ratio >= 1.15), 3)
        .when(numbered & short & (bold | (ratio >= 1.05)), 4)
        .when(numbered & (F.length(own) <= 24), 5)
        .when(bold & short & (ratio >= 1.0) & ~ends(own, SENTENCE_END), 6)
        .otherwise(0)
    )
    kind = F.when((own != "") & own.rlike(LIST_ITEM), "list").when(level > 0, "heading").otherwise("body")
    return kind, level


def paragraphs(lines: DataFrame) -> DataFrame:
    """Lines of a page's blocks (document_id, page, block_no, line_no, spans of text, size and flags) as paragraphs:
    (document_id, page, block_no, part, text, font_size, is_bold).

    A line begins a paragraph where its size differs by LARGER from the line before, or where it looks like a heading
    behind an ended sentence.  Lines join without a blank, as Chinese is set, but for two that meet in ASCII letters or
    digits, or by a line break before a heading.  Sizes are medians over characters, from one count for each size,
    counted in Arrow batches.  Windows over a block's lines and one aggregate on the same shuffle; blank lines don't count."""
    key = ["document_id", "page", "block_no"]
    own = lines.select(*key, "line_no", _measured("spans").alias("m")).select(*key, "line_no", "m.*").where("text <> ''")
    block = Window.partitionBy(*key).orderBy("line_no")
    before, last = F.lag("text").over(block), F.lag("size").over(block)
    own = own.withColumns({"before": before, "last": last, "heads": is_heading_like(F.col("text"))}).withColumn("ended", ends(F.col("before"), SENTENCE_END))
    ratio = F.when((F.col("last") > 0) & (F.col("size") > 0), F.col("size") / F.col("last"))
    breaks = (ratio >= LARGER) | (ratio <= 1 / LARGER) | (ratio.isNotNull() & F.col("heads") & F.col("ended"))
    own = own.withColumn("begins", F.col("before").isNull() | F.coalesce(breaks, F.lit(False)))
    own = own.withColumn("part", F.sum(F.when(F.col("begins"), 1).otherwise(0)).over(block) - 1)
    ascii_ends = ends(F.col("before"), "[A-Za-z0-9]$") & F.substring("text", 1, 1).rlike("[A-Za-z0-9]")
    link = F.when(F.col("begins"), "").when(F.col("ended") & F.col("heads"), "\n").when(ends(F.col("before"), UNFINISHED), "").when(ascii_ends, " ").otherwise("")
    ordered = F.array_sort(F.collect_list(F.struct("line_no", F.concat(link, "text").alias("text"), "counts")))
    out = own.groupBy(*key, "part").agg(ordered.alias("l"), F.sum("bold").alias("bold"))
    out = out.select(*key, F.col("part").cast("int").alias("part"), F.array_join(F.transform("l", lambda x: x["text"]), "").alias("text"), F.flatten(F.transform("l", lambda x: x["counts"])).alias("counts"), "bold")
    middle = _middle("counts")
    share = F.try_divide(F.col("bold"), F.col("m.n"))
    out = out.select(*key, "part", "text", "bold", middle.alias("m"))
    return out.select(*key, "part", "text", F.coalesce("m.size", F.lit(0.0)).alias("font_size"), F.coalesce(share >= BOLD_SHARE, F.lit(False)).alias("is_bold"))


def _counts(row: np.ndarray, size: np.ndarray, n: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each row's sizes (NaN last, null ones left out by the caller) each one once, ascending, as row, size and sum of
    n; and each row's sum and median, the mean of the two in the middle (NaN where it has none)."""
    order = np.lexsort((size, row))
    row, size, n = row[order], size[order], n[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | ((size[1:] != size[:-1]) & ~(np.isnan(size[1:]) & np.isnan(size[:-1])))
    first = np.flatnonzero(new)
    n = np.add.reduceat(n, first) if len(first) else n
    row, size = row[first], size[first]
    total = np.zeros(rows, np.int64)
    np.add.at(total, row, n)
    upto, before = np.cumsum(n), np.cumsum(total) - total
    middle = np.full(rows, np.nan)
    some = total > 0
    low, high = (np.searchsorted(upto, (before + half)[some], "right") for half in ((total - 1) // 2, total // 2))
    middle[some] = (size[low] + size[high]) / 2
    return row, size, n, total, middle


def _lists(row: np.ndarray, rows: int) -> pa.Array:
    return pa.array(np.searchsorted(row, np.arange(rows + 1)), pa.int32())


_COUNT = StructType([StructField("size", DoubleType()), StructField("n", LongType())])
_MEASURES = StructType([StructField("text", StringType()), StructField("counts", ArrayType(_COUNT)), StructField("size", DoubleType()), StructField("bold", LongType())])


@F.arrow_udf(_MEASURES)
def _measured(spans: pa.Array) -> pa.Array:
    """A line's text, the characters of each size, their median and the bold ones; blank spans count as text alone."""
    rows, row = len(spans), pc.list_parent_indices(spans).to_numpy(zero_copy_only=False)
    flat = pc.list_flatten(spans)
    words, size, flags = (pc.struct_field(flat, c) for c in ("text", "size", "flags"))
    words = pc.fill_null(words, "")
    ends_at = _lists(row, rows)
    text = pc.utf8_trim(pc.binary_join(pa.ListArray.from_arrays(ends_at, words), ""), BLANKS)
    text = pc.if_else(spans.is_valid(), text, None)
    n = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    seen = pc.greater(pc.utf8_length(pc.utf8_trim(words, BLANKS)), 0).to_numpy(zero_copy_only=False)
    heavy = seen & (pc.fill_null(pc.cast(flags, pa.int64()), 0).to_numpy(zero_copy_only=False) & BOLD_FLAG != 0)
    bold = np.bincount(row[heavy], n[heavy], rows).astype(np.int64)
    size = pc.cast(size, pa.float64())
    sized = seen & size.is_valid().to_numpy(zero_copy_only=False)
    at, sizes, n, total, middle = _counts(row[sized], size.to_numpy(zero_copy_only=False)[sized], n[sized], rows)
    counts = pa.ListArray.from_arrays(_lists(at, rows), pa.StructArray.from_arrays([pa.array(sizes), pa.array(n)], ["size", "n"]))
    return pa.StructArray.from_arrays([text, counts, pa.array(middle, mask=total == 0), pa.array(bold)], ["text", "counts", "size", "bold"])


@F.arrow_udf(_COUNT)
def _middle(counts: pa.Array) -> pa.Array:
    """Median size of counted sizes, and how many characters they are."""
    flat = pc.list_flatten(counts)
    row = pc.list_parent_indices(counts).to_numpy(zero_copy_only=False)
    size, n = (pc.struct_field(flat, c).to_numpy(zero_copy_only=False) for c in ("size", "n"))
    _, _, _, total, middle = _counts(row, size, n, len(counts))
    return pa.StructArray.from_arrays([pa.array(middle, mask=total == 0), pa.array(total)], ["size", "n"])


def calibrate(blocks: DataFrame) -> DataFrame:
    """Classify again against the document's median size, and number the levels in use from 1.  Documents without
    sizes stay as they are."""
    doc = Window.partitionBy("document_id")
    sized = blocks.withColumn("__body", F.median(F.when(F.col("font_size") > 0, F.col("font_size"))).over(doc))
    kind, level = block_class(F.col("text"), F.col("font_size"), F.col("is_bold"), F.col("__body"))
    out = sized.withColumn("__kind", kind).withColumn("__level", level)
    used = F.array_sort(F.collect_set(F.when(F.col("__level") > 0, F.col("__level"))).over(doc))
    out = out.withColumn("__rank", F.array_position(used, F.col("__level")).cast("int"))
    known = F.col("__body").isNotNull()
    return out.withColumn("block_type", F.when(known, F.col("__kind")).otherwise(F.col("block_type"))).withColumn("heading_level", F.when(known, F.col("__rank")).otherwise(F.col("heading_level"))).drop("__body", "__kind", "__level", "__rank")


def section_paths(blocks: DataFrame) -> DataFrame:
    """section_path of every block: the open headings above it, outermost first, itself included.

    A heading of level n closes those of level n and deeper.  So the last heading of a level is open where it comes
    after the last one of every lesser level: six running maxima and no state machine."""
    run = Window.partitionBy("document_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    heading = (F.col("block_type") == "heading") & F.col("heading_level").between(1, LEVELS)
    out, parts, above = blocks, [], F.lit(-1).cast("long")
    for n in range(1, LEVELS + 1):
        at = F.struct(F.col("ord").cast("long").alias("ord"), F.substring("text", 1, 120).alias("text"))
        out = out.withColumn(f"__h{n}", F.max(F.when(heading & (F.col("heading_level") == n), at)).over(run))
        pos = F.coalesce(F.col(f"__h{n}.ord"), F.lit(-1))
        parts.append(F.when(pos > above, F.col(f"__h{n}.text")))
        above = F.greatest(above, pos)
    return out.withColumn("section_path", F.array_compact(F.array(*parts))).drop(*(f"__h{n}" for n in range(1, LEVELS + 1)))


def edge_candidates(blocks: DataFrame) -> DataFrame:
    """The outermost small lines at the top and bottom of each page, with their compare key."""
    doc = Window.partitionBy("document_id")
    side = F.when(F.col("y_ratio") <= EDGE, "top").when(F.col("y_ratio") >= 1 - EDGE, "bottom")
    out = blocks.withColumn("__body", F.median(F.when(F.col("font_size") > 0, F.col("font_size"))).over(doc)).withColumn("__side", side)
    small = F.col("__body").isNull() | (F.col("font_size") <= LARGER * F.col("__body"))
    out = out.where(F.col("__side").isNotNull() & small & (strip("text") != ""))
    edge = Window.partitionBy("document_id", "page", "__side")
    out = out.withColumn("__lo", F.min("y_ratio").over(edge)).withColumn("__hi", F.max("y_ratio").over(edge))
    near = F.when(F.col("__side") == "top", F.col("y_ratio") <= F.col("__lo") + EDGE_STEP).otherwise(F.col("y_ratio") >= F.col("__hi") - EDGE_STEP)
    return out.where(near).withColumn("key", compare_key(F.col("text"))).where((F.col("key") != "") & (F.length("key") <= 120)).drop("__body", "__lo", "__hi").withColumnRenamed("__side", "side")


def templates(blocks: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """(document_id, key, pages, span, density) of edge lines that repeat: on many pages, or densely on a stretch."""
    edges = edge_candidates(blocks) if edges is None else edges
    total = blocks.groupBy("document_id").agg(F.countDistinct("page").alias("n_pages"))
    out = edges.groupBy("document_id", "key").agg(F.countDistinct("page").alias("pages"), (F.max("page") - F.min("page") + 1).alias("span")).join(total, "document_id")
    out = out.withColumn("density", F.col("pages") / F.col("span"))
    often = F.col("pages") >= F.greatest(F.lit(2), F.floor(0.6 * F.col("n_pages")))
    dense = (F.col("pages") >= F.greatest(F.lit(3), F.floor(0.05 * F.col("n_pages")))) & (F.col("density") >= 0.45)
    return out.where(often | dense).select("document_id", "key", "pages", "span", "density")


def strip_noise(blocks: DataFrame) -> DataFrame:
    """Blocks without noise lines and without edge lines that repeat; the edge lines are made once and kept."""
    edges = keep(edge_candidates(blocks).select("document_id", "ord", "page", "key"), "edges")
    repeated = edges.join(templates(blocks, edges), ["document_id", "key"], "left_semi").select("document_id", "ord")
    return blocks.where(~is_noise(F.col("text"))).join(repeated, ["document_id", "ord"], "left_anti")


def stitch(blocks: DataFrame) -> DataFrame:
    """Paragraphs that run over a shard's end are joined: both body, the first not ended, at most a page apart.

    Blocks carry shard_index.  A joined block keeps its first page, and the next fragment is held against that page, so
    a chain of one-block shards begins a new block every second page.  Chains are found by a window; where they break
    is folded within each."""
    doc = Window.partitionBy("document_id").orderBy("shard_index", "ord")
    before = F.lag(F.struct("shard_index", "block_type", "text")).over(doc)
    flows = (before["shard_index"] != F.col("shard_index")) & (before["block_type"] == "body") & (F.col("block_type") == "body") & ~ends(before["text"], SENTENCE_END)
    out = blocks.withColumn("__new", F.when(F.coalesce(flows, F.lit(False)), 0).otherwise(1))
    out = out.withColumn("__chain", F.sum("__new").over(doc))
    fields = ["shard_index", "ord", "page", "block_type", "heading_level", "font_size", "is_bold", "y_ratio", "text"]
    parts = F.array_sort(F.collect_list(F.struct(*fields)))

    def fold(done: Column, x: Column) -> Column:
        last = F.element_at(done, -1)
        joined = last.withField("text", F.concat(last["text"], x["text"]))
        return F.when(x["page"] - last["page"] <= 1, F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(joined))).otherwise(F.concat(done, F.array(x)))

    merged = out.groupBy("document_id", "__chain").agg(parts.alias("p"))
    merged = merged.select("document_id", F.inline(F.aggregate(F.slice("p", 2, F.greatest(F.size("p") - 1, F.lit(1))), F.slice("p", 1, 1), fold)))
    order = F.row_number().over(doc) - 1
    return merged.withColumn("__ord", order).select("document_id", F.col("__ord").cast("int").alias("ord"), "text", "page", "block_type", "heading_level", "font_size", "is_bold", "y_ratio")


def plan_shards(documents: DataFrame, per_shard: int = 20) -> DataFrame:
    """(document_id, shard_index, page_start, page_end) of total_pages; a last shard below half a step joins the one before."""
    n = F.col("total_pages")
    full, rest = F.floor(n / per_shard).cast("int"), (n % per_shard).cast("int")
    short = (rest > 0) & (rest < max(1, per_shard // 2)) & (full > 0)
    count = F.when(n <= 0, 0).when(short, full).otherwise(full + F.when(rest > 0, 1).otherwise(0))
    shards = documents.withColumn("__n", count).where("__n > 0").withColumn("shard_index", F.explode(F.sequence(F.lit(0), F.col("__n") - 1)))
    end = F.when(F.col("shard_index") == F.col("__n") - 1, n).otherwise((F.col("shard_index") + 1) * per_shard)
    return shards.select("document_id", "shard_index", (F.col("shard_index") * per_shard + 1).alias("page_start"), end.cast("int").alias("page_end"))


def reading_order(blocks: DataFrame, width: str = "page_width") -> DataFrame:
    """reading_pos within a page: by column where a quarter to three quarters of the blocks begin in the right half,
    else from the top; blocks carry x0, y0 and the page's width."""
    page = Window.partitionBy("document_id", "page")
    right = F.col("x0") > F.col(width) / 2 * 1.05
    out = blocks.withColumn("__share", F.avg(F.when(right, 1.0).otherwise(0.0)).over(page))
    column = F.when(F.col("__share").between(0.25, 0.75) & right, 1).otherwise(0)
    return out.withColumn("reading_pos", F.row_number().over(page.orderBy(column, "y0", "x0", "ord")) - 1).drop("__share")


def pages_without_text(documents: DataFrame, blocks: DataFrame) -> DataFrame:
    """(document_id, page) to recognise optically: all pages less those with a block."""
    pages = documents.select("document_id", F.explode(F.sequence(F.lit(1), F.col("total_pages"))).alias("page"))
    return pages.join(blocks.select("document_id", "page").distinct(), ["document_id", "page"], "left_anti")


def renumber(rows: DataFrame, within: str = "document_id", order: str = "chunk_index") -> DataFrame:
    return rows.withColumn(order, F.row_number().over(Window.partitionBy(within).orderBy(order)) - 1)


def batches(rows: DataFrame, size: int, order: str = "chunk_index") -> DataFrame:
    return rows.withColumn("batch_id", F.floor(F.col(order) / size).cast("int"))
