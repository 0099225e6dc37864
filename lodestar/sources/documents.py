"""Document sources: word-processor files, model answers, and plug-ins for page layout, recognition and generation.

Page-layout files and optical recognition need libraries that aren't part of this package; `read_pages` and
`recognise` take the reader as a function and give it Arrow batches of files.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions.text import is_heading_like, strip

BLOCK = "document_id string, ord int, text string, page int, block_type string, heading_level int, font_size double, is_bold boolean, y_ratio double"
#: Units (paragraphs and table rows) on a made-up page.
UNITS_PER_PAGE = 40
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def files(spark: SparkSession, path: str, pattern: str = "*", most: int | None = None) -> DataFrame:
    """(path, length, content) of files in any store that Spark reads; larger files than `most` bytes are left out
    before they are read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    found = found.where(F.col("length") <= most) if most else found
    return found.select("path", "length", "content")


def digests(found: DataFrame) -> DataFrame:
    """(path, length, file_hash): SHA-256 of each file's bytes."""
    return found.select("path", "length", F.sha2("content", 256).alias("file_hash"))


def _paragraph(p: ElementTree.Element) -> tuple[str, float, bool, str]:
    text = "".join(t.text or "" for t in p.iter(f"{_W}t")).strip()
    sizes = [float(s.get(f"{_W}val")) / 2 for s in p.iter(f"{_W}sz") if (s.get(f"{_W}val") or "").isdigit()]
    bold = any(b.get(f"{_W}val") not in ("0", "false") for b in p.iter(f"{_W}b"))
    style = next((s.get(f"{_W}val") or "" for s in p.iter(f"{_W}pStyle")), "")
    return text, max(sizes, default=0.0), bold, style


# Names of title and subtitle styles.
STYLES = {"title": 1, "标题": 1, "subtitle": 2, "副标题": 2}


def style_level(style: str) -> int:
    """The level in a style's name, 1 to 6: its number, or that of a title; 0 for none."""
    found = re.search(r"(?i)(?:heading|标题)\s*(\d+)", style) or re.search(r"(\d+)", style)
    return max(1, min(6, int(found[1]))) if found else STYLES.get(style.strip().lower(), 0)


def docx_units(content: bytes) -> list[tuple[str, float, bool, str]]:
    """Paragraphs in order, then table rows with their cells joined by bars; empty cells and units drop out."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    if body is None:
        return []
    units = [_paragraph(p) for p in body.findall(f"{_W}p")]
    for row in body.iter(f"{_W}tr"):
        cells = ["".join(t.text or "" for t in c.iter(f"{_W}t")).strip() for c in row.findall(f"{_W}tc")]
        units.append((" | ".join(c for c in cells if c), 0.0, False, ""))
    return [u for u in units if u[0]]


def read_docx(found: DataFrame, units_per_page: int = UNITS_PER_PAGE) -> DataFrame:
    """Blocks of word-processor files: headings from style names that end in a level; a broken file gives none."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for path, content in zip(frame["path"], frame["content"], strict=True):
                try:  # a file that can't be read has no blocks
                    units = docx_units(content)
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
                    continue
                for i, (text, size, bold, style) in enumerate(units):
                    n = style_level(style)
                    rows.append((path, i, text, i // units_per_page + 1, "heading" if n else "body", n, size, bold, 0.5))
            yield pd.DataFrame(rows, columns=[c.split(" ")[0] for c in BLOCK.split(", ")])

    return found.select("path", "content").mapInPandas(run, BLOCK)


def read_pages(found: DataFrame, reader: Callable[[bytes], list[dict]]) -> DataFrame:
    """Blocks by a reader of one file's bytes (a page-layout library); pages that it can't read are left out by it."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split(" ")[0] for c in BLOCK.split(", ")]
        for frame in frames:
            rows = [{"document_id": path, "ord": i} | b for path, content in zip(frame["path"], frame["content"], strict=True) for i, b in enumerate(reader(content))]
            yield pd.DataFrame(rows, columns=names)

    return found.select("path", "content").mapInPandas(run, BLOCK)


def recognised_blocks(lines: DataFrame) -> DataFrame:
    """Lines of recognised pages (document_id, page, pos, text) as blocks, in page order: short heading-like ones are set larger."""
    like = is_heading_like(F.col("text"))
    size = F.when(like, 16.0).otherwise(10.5)
    return lines.select("document_id", (F.col("page") * 100_000 + F.col("pos")).cast("int").alias("ord"), "text", "page", F.lit("body").alias("block_type"), F.lit(0).alias("heading_level"), size.alias("font_size"), F.lit(False).alias("is_bold"), F.lit(0.5).alias("y_ratio"))


# answers of a language model

# Keys under which models put their list of pairs, and the fields of a pair.
WRAPPERS = ("data", "qa_pairs", "result", "items", "list")
FIELDS = "question string, answer string, category string, index string"
FENCE = r"(?s)```(?:json)?\s*(.+?)\s*```"
_STRICT = {"allowSingleQuotes": "false"}


def _list(c: Column) -> Column:
    """The elements of a JSON array as JSON texts; null for anything else."""
    return F.when(F.ltrim(c).startswith("["), F.from_json(c, "array<string>", _STRICT))


def answer_items(content: Column) -> Column:
    """The JSON objects of a model's answer: bare or fenced, an array inside prose, or a list under a wrapper's key."""
    raw = strip(F.coalesce(F.nullif(F.regexp_extract(content, FENCE, 1), F.lit("")), content))
    whole = F.from_json(raw, ", ".join(f"{k} string" for k in WRAPPERS), _STRICT | {"columnNameOfCorruptRecord": "__bad"})
    known = F.when(raw.startswith("{") & F.from_json(raw, "map<string,string>", _STRICT).isNotNull(), F.coalesce(*(_list(whole[k]) for k in WRAPPERS), F.array(raw)))
    inner = F.regexp_extract(raw, r"(?s)\[.*\]", 0)
    found = F.coalesce(_list(raw), known, _list(inner), F.array().cast("array<string>"))
    return F.filter(found, lambda x: F.ltrim(x).startswith("{"))


def pairs_of(answers: DataFrame, content: str = "content", last: str = "last_index") -> DataFrame:
    """Answers exploded into pairs: question, answer, category and source_index, the `index` field held within 0 and last.

    Questions below four characters and answers below two go; a missing category is general, an index that is no whole
    number 0.  Column functions only."""
    names = [c for c in answers.columns if c not in (content, last)]
    rows = answers.withColumn("__x", F.explode(answer_items(F.col(content)))).withColumn("__x", F.from_json("__x", FIELDS, _STRICT))
    question, answer = (strip(F.coalesce(F.col(f"__x.{c}"), F.lit(""))) for c in ("question", "answer"))
    category = F.coalesce(F.nullif(F.lower(strip(F.col("__x.category"))), F.lit("")), F.lit("general"))
    index = F.coalesce(F.regexp_extract(F.col("__x.index"), r"^\s*([+-]?[0-9]+)(\.[0-9]+)?\s*$", 1).try_cast("int"), F.lit(0))
    out = rows.select(*names, question.alias("question"), answer.alias("answer"), category.alias("category"), F.greatest(F.least(index, F.col(last).cast("int")), F.lit(0)).alias("source_index"))
    return out.where((F.length("question") >= 4) & (F.length("answer") >= 2))


def to_source(pairs: DataFrame, chunks: DataFrame) -> DataFrame:
    """Pairs with the columns of their source passage; an index that is out of range means the batch's first one."""
    n = chunks.groupBy("batch_id").agg(F.count("*").alias("__n"))
    own = pairs.join(n, "batch_id").withColumn("pos", F.when(F.col("source_index").between(0, F.col("__n") - 1), F.col("source_index")).otherwise(0))
    return own.join(chunks, ["batch_id", "pos"]).drop("__n", "pos")


def generate_batches(rows: DataFrame, model: Callable[[list[str]], str]) -> DataFrame:
    """(batch_id, content, last_index): a model's answer to each batch of passages (batch_id, pos, text); one that fails
    answers nothing."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("pos")
        try:
            content = model(group["text"].tolist())
        except Exception:  # noqa: BLE001  an answer that is missing leaves the batch without pairs
            content = "[]"
        return pd.DataFrame([(group["batch_id"].iloc[0], content, len(group) - 1)], columns=["batch_id", "content", "last_index"])

    return rows.select("batch_id", "pos", "text").groupBy("batch_id").applyInPandas(run, f"batch_id {dict(rows.dtypes)['batch_id']}, content string, last_index int")


def generate(chunks: DataFrame, model: Callable[[list[str]], str], per_batch: int = 3) -> DataFrame:
    """The same over one document's passages by chunk_index."""
    return generate_batches(chunks.withColumn("pos", (F.col("chunk_index") % per_batch).cast("int")).withColumn("batch_id", F.floor(F.col("chunk_index") / per_batch).cast("int")), model)


def embed(rows: DataFrame, model: Callable[[list[str]], list[list[float]]], text: Column, size: int = 32, most: int = 480, dimension: int | None = None) -> DataFrame:
    """`embedding` by a model, in batches; texts are cut to what the model reads.  A wrong number of vectors, or of
    their elements where a dimension is given, is an error."""

    @F.pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        own = texts.fillna("").tolist()
        found = [v for i in range(0, len(own), size) for v in model(own[i : i + size])]
        if len(found) != len(own):
            raise ValueError(f"{len(found)} vectors for {len(own)} texts")
        if dimension and any(len(v) != dimension for v in found):
            raise ValueError(f"a vector has not {dimension} elements")
        return pd.Series(found)

    return rows.withColumn("embedding", run(F.substring(text, 1, most)))
