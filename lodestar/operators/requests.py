"""Requests to parse a title: keys, a fold of their events, completion by id and by title key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions.text import title_key


def match_key(requests: DataFrame) -> DataFrame:
    """The linked script's id, else the title key."""
    return requests.withColumn("match_key", F.coalesce("script_id", title_key(F.col("script_title"))))


def fold(events: DataFrame) -> DataFrame:
    """create, cancel and complete events as one request a (user, key): a cancelled one revives, a pending one is
    reused, a completed one stays completed whatever follows."""
    done = F.min(F.when(F.col("action") == "complete", F.col("seq")))
    out = events.groupBy("user_id", "match_key").agg(
        done.alias("done"), F.max_by("action", F.when(F.col("action") != "complete", F.col("seq"))).alias("last"),
        F.min_by("script_title", "seq").alias("script_title"), F.min("ts").alias("created_at"), F.max("ts").alias("updated_at"),
        F.count_if((F.col("action") == "create")).alias("n_created"),
    )
    status = F.when(F.col("done").isNotNull(), "completed").when(F.col("last") == "cancel", "cancelled").otherwise("pending")
    return out.select("user_id", "match_key", "script_title", status.alias("status"), "n_created", "created_at", "updated_at")


def indexed_scripts(documents: DataFrame) -> DataFrame:
    live = documents.where(F.col("is_active") & F.col("deleted_at").isNull() & (F.col("total_chunks") > 0))
    return live.select("script_id").distinct()


def complete_by_id(requests: DataFrame, indexed: DataFrame) -> DataFrame:
    """Pending requests whose script is indexed."""
    return requests.where(F.col("status") == "pending").join(indexed, "script_id", "left_semi")


def complete_by_key(requests: DataFrame, scripts: DataFrame, indexed: DataFrame) -> DataFrame:
    """Pending requests without a script that an indexed script's title or alias matches: (id, script_id).

    Of several scripts with one key the least id counts."""
    names = F.concat(F.array("title"), F.coalesce("aliases", F.array().cast("array<string>")))
    keys = scripts.join(indexed, scripts["id"] == indexed["script_id"], "left_semi").select(F.col("id").alias("found_id"), F.explode(names).alias("name"))
    keys = keys.select("found_id", title_key(F.col("name")).alias("match_key")).where("match_key <> ''").groupBy("match_key").agg(F.min("found_id").alias("found_id"))
    open_ones = requests.where((F.col("status") == "pending") & F.col("script_id").isNull())
    return open_ones.join(keys, "match_key").select("id", F.col("found_id").alias("script_id"))


def with_scripts(requests: DataFrame, scripts: DataFrame, indexed: DataFrame) -> DataFrame:
    """Requests with the script's title and cover, and whether it can be asked by now."""
    s = scripts.select(F.col("id").alias("script_id"), F.col("title").alias("title_now"), "cover_url")
    out = requests.join(s, "script_id", "left").join(indexed.withColumn("has_guide", F.lit(True)), "script_id", "left")
    return out.withColumn("has_guide", F.coalesce("has_guide", F.lit(False)))


def with_profiles(rows: DataFrame, profiles: DataFrame, roles: dict[str, str]) -> DataFrame:
    """Nicknames for user columns: {column: output}; unknown users give null."""
    for column, out in roles.items():
        rows = rows.join(profiles.select(F.col("id").alias(column), F.col("nickname").alias(out)), column, "left")
    return rows


def question_page(questions: DataFrame, profiles: DataFrame, code: str, status: str | None = None, limit: int = 20, offset: int = 0) -> DataFrame:
    """A page of a guide's questions with the nicknames of those who asked and answered, in the page's order (pos)."""
    from lodestar.operators import upsert

    page = upsert.question_page(questions, code, status, min(100, max(1, limit)), max(0, offset))
    order = Window.orderBy(F.desc("ask_count"), F.desc("created_at"), F.asc("question_hash"))  # a page, a hundred rows at most
    page = page.withColumn("pos", F.row_number().over(order) - 1)
    return with_profiles(page, profiles, {"created_by": "asked_by", "answered_by": "answered_by_name"})


def current_document(documents: DataFrame, object_key: str | None) -> DataFrame:
    """Of each script the document of an object key, else the newest."""
    w = Window.partitionBy("script_id").orderBy(F.desc(F.coalesce(F.col("object_key") == F.lit(object_key), F.lit(False))), F.desc("created_at"), F.desc("id"))
    return documents.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def script_status(documents: DataFrame, key: str = "script_code") -> DataFrame:
    """Sums over the active documents of a code, and whether it is indexed."""
    live = documents.where(F.col("is_active") & F.col("deleted_at").isNull())
    out = live.groupBy(key).agg(*(F.sum(c).alias(c) for c in ("total_pages", "total_chunks", "total_qa")), F.max("version").alias("version"))
    return out.withColumn("indexed", F.col("total_chunks") > 0)


def overview(documents: DataFrame, scripts: DataFrame) -> DataFrame:
    """Documents with their script's code where they have none, and the share of passages dropped, in percent."""
    out = documents.alias("d").join(scripts.select(F.col("id").alias("script_id"), "code", "title"), "script_id")
    both = F.col("total_chunks") + F.col("dropped_chunks")
    rate = F.when(both > 0, F.round((F.col("dropped_chunks") / both * 100).cast("decimal(18,6)"), 1)).otherwise(F.lit(0).cast("decimal(18,1)"))
    return out.withColumn("script_code", F.coalesce(F.nullif(F.col("script_code"), F.lit("")), F.col("code"))).withColumn("dedup_rate", rate)


def health(scripts: DataFrame, jobs: DataFrame, documents: DataFrame, chunks: DataFrame, qa: DataFrame) -> DataFrame:
    """A verdict on each script (guide_key null: none): the first thing that is wrong."""
    from lodestar.operators.upsert import latest_per_key

    job = latest_per_key(jobs, ["script_id"], "created_at", "id").select("script_id", F.col("status").alias("job_status"), "error_message")
    doc = latest_per_key(documents.where(F.col("deleted_at").isNull()), ["script_id"], "created_at", "id").select("script_id", F.col("is_active").alias("doc_active"))

    def gaps(rows: DataFrame, name: str) -> DataFrame:
        return rows.groupBy("script_id").agg(F.count_if(F.col("embedding").isNull()).alias(name))

    out = scripts.withColumnRenamed("id", "script_id").join(job, "script_id", "left").join(doc, "script_id", "left").join(gaps(chunks, "chunk_gaps"), "script_id", "left").join(gaps(qa, "qa_gaps"), "script_id", "left")
    verdict = (
        F.when(F.col("guide_key").isNull(), "no guide").when(F.col("job_status").isNull(), "no job").when(F.col("job_status") == "failed", F.concat(F.lit("failed: "), F.coalesce("error_message", F.lit(""))))
        .when(~F.coalesce("doc_active", F.lit(False)), "document not active").when(F.col("chunk_gaps") > 0, "chunk vectors missing").when(F.col("qa_gaps") > 0, "question vectors missing").otherwise("ok")
    )
    return out.select("script_id", "job_status", "doc_active", "chunk_gaps", "qa_gaps", verdict.alias("verdict"))


def ingest_decision(latest: DataFrame, force: bool = False) -> DataFrame:
    """What a new import does, from the script's latest job and its object key: reuse, replace or create."""
    running = ~F.col("status").isin("completed", "failed", "cancelled", "skipped")
    same = F.col("job_object_key").eqNullSafe(F.col("object_key"))
    action = F.when(F.col("status").isNull() | ~running, "create").when(same & F.lit(not force), "reuse").otherwise("cancel_and_create")
    return latest.withColumn("action", action)


def skip_indexed(documents: DataFrame, chunks: DataFrame, force: bool = False) -> DataFrame:
    """Documents to work on: not those whose stored passages are all there, unless forced."""
    if force:
        return documents
    have = chunks.groupBy("document_id").agg(F.count("*").alias("have"))
    done = documents.join(have, documents["id"] == have["document_id"]).where((F.col("total_chunks") > 0) & (F.col("have") >= F.col("total_chunks"))).select("id")
    return documents.join(done, "id", "left_anti")


def activate(documents: DataFrame, chosen: DataFrame) -> DataFrame:
    """chosen (script_id, id): that document becomes the script's active one, the others of the script don't stay so."""
    pick = chosen.select("script_id", F.col("id").alias("__chosen"))
    out = documents.join(pick, "script_id", "left")
    return out.withColumn("is_active", F.when(F.col("__chosen").isNull(), F.col("is_active")).otherwise(F.col("id") == F.col("__chosen"))).drop("__chosen")
