"""Vector retrieval over stored passages and questions: top-k, hybrid merge, sources of an answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions import vector
from lodestar.functions.formats import page_range

#: Factor by which a question's similarity counts against a passage's.
QA_BOOST = 1.12
#: Passages at most in a hybrid result.
CHUNK_QUOTA = 3
#: Below this raw similarity an answer needs a person.
MEANINGFUL = 0.5


def active_documents(documents: DataFrame) -> DataFrame:
    return documents.where(F.col("deleted_at").isNull() & F.col("is_active"))


def optional(**wanted: object) -> Column:
    """Equality for each given value; None is a wildcard."""
    out = F.lit(True)
    for name, value in wanted.items():
        if value is not None:
            out &= F.col(name) == F.lit(value)
    return out


def top_k(rows: DataFrame, query: Column, k: int = 8, least: float = 0.25, id_col: str = "id", vec_col: str = "embedding", **wanted: object) -> DataFrame:
    """The k rows most similar to a vector, exactly: filters and columns reach the scan, and the rest is one
    TakeOrderedAndProject (k rows from each task).  Ties go to the lower id."""
    rows = rows.where(F.col(vec_col).isNotNull() & optional(**wanted))
    scored = rows.withColumn("similarity", vector.cosine(F.col(vec_col), query)).where(F.col("similarity") >= least)
    return scored.orderBy(F.desc("similarity"), F.asc(id_col)).limit(k)


def match(rows: DataFrame, documents: DataFrame, query: Column, k: int = 8, least: float = 0.25, **wanted: object) -> DataFrame:
    """top_k among rows of active documents; `wanted` may name any column of rows (script_id, script_code, category)."""
    live = active_documents(documents).select(F.col("id").alias("document_id"))
    return top_k(rows.join(live, "document_id", "left_semi"), query, k, least, **wanted)


def by_code_or_id(rows: DataFrame, code: str, ident: str) -> DataFrame:
    """Rows of a code; where it has none, rows of the id."""
    ranked = rows.where((F.col("script_code") == code) | (F.col("script_id") == ident)).withColumn("__rank", F.when(F.col("script_code") == code, 0).otherwise(1))
    best = ranked.agg(F.min("__rank").alias("__best"))
    return ranked.join(F.broadcast(best), F.col("__rank") == F.col("__best")).drop("__rank", "__best")


def hybrid(qa: DataFrame, chunks: DataFrame, query: Column, k: int = 8, least: float = 0.25, boost: float = QA_BOOST, quota: int = CHUNK_QUOTA) -> DataFrame:
    """Questions first: both lists by similarity rounded to four places, questions boosted, ties to questions, then by
    place.  Columns of both: id, embedding; result: kind, id, raw, score, pos."""

    def ranked(rows: DataFrame, kind: str, n: int, factor: float) -> DataFrame:
        found = top_k(rows, query, n, least).select("id", "similarity")
        place = F.row_number().over(Window.orderBy(F.desc("similarity"), "id"))  # n rows at most
        raw = F.round("similarity", 4)
        return found.select(F.lit(kind).alias("kind"), "id", raw.alias("raw"), F.round(raw * factor, 4).alias("score"), place.alias("pos"))

    both = ranked(qa, "qa", k, boost).unionByName(ranked(chunks, "chunk", min(k, quota), 1.0))
    return both.orderBy(F.desc("score"), F.when(F.col("kind") == "qa", 0).otherwise(1), "pos")


def search(qa: DataFrame, chunks: DataFrame, query: Column, mode: str = "hybrid", k: int = 8, least: float = 0.25, category: str | None = None) -> DataFrame:
    """Hits (kind, id, raw, score, pos) among questions, passages or both; a category counts for questions alone."""
    if mode not in ("chunk", "qa", "hybrid"):
        raise ValueError(f"no such mode: {mode}")
    qa = qa.where(optional(category=category))
    if mode == "hybrid":
        return hybrid(qa, chunks, query, k, least)
    return hybrid(qa, chunks.limit(0), query, k, least, boost=1.0) if mode == "qa" else hybrid(qa.limit(0), chunks, query, k, least, quota=k)


def ask(qa: DataFrame, chunks: DataFrame, query: Column, n: int = 6, k: int = 8, least: float = 0.25) -> DataFrame:
    """One row: the context of an answer, the direct answer, how similar the best source is, and whether that is too
    little to answer from.  Both tables: id, embedding, section_path, page_start, page_end and text."""
    hits = hybrid(qa, chunks, query, k, least, quota=n)
    told = ["id", "section_path", "page_start", "page_end", "text"]
    every = qa.select(F.lit("qa").alias("kind"), *told).unionByName(chunks.select(F.lit("chunk").alias("kind"), *told))
    sources = ask_sources(hits, n, k).select("kind", "id", F.row_number().over(Window.orderBy(F.when(F.col("kind") == "qa", 0).otherwise(1), "pos")).alias("pos"))  # n rows or so
    return answer_context(every.join(F.broadcast(sources), ["kind", "id"])).crossJoin(needs_person(hits))  # one row each


def ask_sources(hits: DataFrame, n: int = 6, k: int = 8) -> DataFrame:
    """Sources of an answer from hybrid hits: up to k questions, then passages to fill up, one at least if there is one."""
    kind = Window.partitionBy("kind").orderBy("pos")
    ranked = hits.withColumn("rank", F.row_number().over(kind)).withColumn("n_qa", F.sum(F.when(F.col("kind") == "qa", 1).otherwise(0)).over(Window.partitionBy()))
    used = F.least(F.col("n_qa"), F.lit(min(n, k)))
    room = F.greatest(F.lit(1), F.lit(n) - used)
    keep = F.when(F.col("kind") == "qa", F.col("rank") <= used).otherwise(F.col("rank") <= room)
    return ranked.where(keep).drop("rank", "n_qa")


def needs_person(hits: DataFrame, least: float = MEANINGFUL) -> DataFrame:
    """One row: the best raw similarity (0 without hits) and whether it is too low to answer from."""
    best = hits.agg(F.coalesce(F.max("raw"), F.lit(0.0)).alias("best_similarity"))
    return best.withColumn("needs_person", F.col("best_similarity") < least)


def answer_context(sources: DataFrame) -> DataFrame:
    """One row: the sources as numbered blocks with section and pages, and the first as a direct answer."""
    line = F.concat(
        F.lit("["), F.col("pos").cast("string"), F.lit("] "), F.array_join("section_path", " > "),
        F.coalesce(F.concat(F.lit(" p."), page_range(F.col("page_start"), F.col("page_end"))), F.lit("")), F.lit("\n"), F.col("text"),
    )
    ordered = F.array_sort(F.collect_list(F.struct("pos", line.alias("line"), F.trim("text").alias("text"))))
    row = sources.agg(ordered.alias("s"))
    return row.select(F.array_join(F.transform("s", lambda x: x["line"]), "\n\n").alias("context"), F.get("s", F.lit(0))["text"].alias("direct_answer"))


def hamming_scan(rows: DataFrame, probe: int, most: int = 3, n: int = 10, id_col: str = "id") -> DataFrame:
    """Rows whose fingerprint is within `most` bits of a probe, nearest first."""
    from lodestar.functions.fingerprint import hamming

    found = rows.withColumn("distance", hamming(F.col("simhash"), F.lit(probe).cast("long"))).where(F.col("distance") <= most)
    return found.orderBy("distance", id_col).limit(n)
