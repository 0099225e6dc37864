"""Keyed writes without a merging table format: the newest row of a key, first-wins batches, event folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TERMINAL = ("completed", "failed", "cancelled", "skipped")


def upsert(table: DataFrame, changes: DataFrame, key: list[str], seq: str = "seq") -> DataFrame:
    """The table after changes: of each key the row with the highest seq; table rows come before all changes."""
    both = table.withColumn("__new", F.lit(0)).unionByName(changes.withColumn("__new", F.lit(1)))
    last = Window.partitionBy(*key).orderBy(F.desc("__new"), F.desc(seq))
    return both.withColumn("__n", F.row_number().over(last)).where("__n = 1").drop("__n", "__new")


def first_per_key(rows: DataFrame, key: list[str], order: list[Column | str]) -> DataFrame:
    first = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")


def latest_per_key(rows: DataFrame, key: list[str], at: str, tie: str) -> DataFrame:
    return first_per_key(rows, key, [F.desc_nulls_last(at), F.desc(tie)])


def top_per_key(rows: DataFrame, key: list[str], order: list[Column | str], n: int) -> DataFrame:
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def update_where(rows: DataFrame, where: Column, **values: Column) -> DataFrame:
    """Columns set where a predicate holds; a predicate that is null leaves the row."""
    where = F.coalesce(where, F.lit(False))
    return rows.withColumns({name: F.when(where, value).otherwise(F.col(name)) for name, value in values.items()})


def soft_delete(rows: DataFrame, where: Column, now: Column) -> DataFrame:
    return update_where(rows, where & F.col("deleted_at").isNull(), deleted_at=now)


def purge(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return rows.join(gone.select(key).distinct(), key, "left_anti")


def insert(table: DataFrame, rows: DataFrame, now: Column) -> DataFrame:
    """New rows behind the table, created and updated now; columns that they lack are null."""
    told = {c: now for c in ("created_at", "updated_at") if c in table.columns and c not in rows.columns}
    return table.unionByName(rows.withColumns(told), allowMissingColumns=True)


def touched(old: DataFrame, new: DataFrame, key: str, now: Column) -> DataFrame:
    """new, where rows that differ from old in any column but updated_at are updated now."""
    own = [c for c in new.columns if c not in (key, "updated_at")]
    before = old.select(key, F.struct(*own).alias("__old"))
    same = F.col("__old").eqNullSafe(F.struct(*own))
    return new.join(before, key, "left").withColumn("updated_at", F.when(same, F.col("updated_at")).otherwise(now)).drop("__old")


def purge_documents(documents: DataFrame, chunks: DataFrame, qa: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents, chunks and questions without the rows of the documents in gone (id), whose counters become 0."""
    own = gone.select(F.col("id").alias("document_id")).distinct()
    zero = documents.join(own.select(F.col("document_id").alias("id"), F.lit(True).alias("__gone")), "id", "left")
    zero = update_where(zero, F.col("__gone"), **{c: F.lit(0).cast(dict(documents.dtypes)[c]) for c in ("total_chunks", "total_qa", "dropped_chunks") if c in documents.columns}).drop("__gone")
    return zero, purge(chunks, own, "document_id"), purge(qa, own, "document_id")


def question_page(questions: DataFrame, code: str, status: str | None = None, limit: int = 20, offset: int = 0) -> DataFrame:
    """A page of a guide's questions, those asked most and newest first, with the total; unknown states don't filter."""
    from lodestar.operators.catalog import page_with_total

    own = questions.where(F.lower(F.trim("script_code")) == code.strip().lower())
    own = own.where(F.col("status") == status) if status in ("pending", "answered", "dismissed") else own
    return page_with_total(own, [F.desc("ask_count"), F.desc("created_at"), F.asc("question_hash")], limit, offset)


def next_version(documents: DataFrame, key: str) -> DataFrame:
    return documents.groupBy(key).agg((F.coalesce(F.max("version"), F.lit(0)) + 1).alias("next_version"))


def question_counts(events: DataFrame) -> DataFrame:
    """Question events as upserted counters: asks, best similarity (0 at least), and who asked first and how."""
    first = F.min_by(F.struct("question", "script_id", "created_by"), "seq")
    out = events.groupBy("script_code", "question_hash").agg(
        F.count("*").alias("ask_count"), F.greatest(F.max(F.coalesce("best_similarity", F.lit(0.0))), F.lit(0.0)).alias("best_similarity"),
        first.alias("f"), F.min("ts").alias("created_at"), F.max("ts").alias("updated_at"),
    )
    return out.select("script_code", "question_hash", "ask_count", "best_similarity", "f.question", "f.script_id", "f.created_by", "created_at", "updated_at")


COUNTERS = ("processed_pages", "finished_shards", "total_chunks", "dropped_chunks", "total_qa", "embedded_chunks", "embedded_qa")


def job_progress(events: DataFrame, counters: tuple[str, ...] = COUNTERS) -> DataFrame:
    """Progress events (d_* deltas) as one row a job: sums, the last status and detail that were given, when work
    began (first status beyond pending) and ended (completed, failed or skipped; a cancelled job has no end)."""
    told = F.col("status").isNotNull()
    ended = F.when(F.col("status").isin("completed", "failed", "skipped"), F.col("ts"))
    return events.groupBy("job_id").agg(
        *(F.sum(F.coalesce(f"d_{c}", F.lit(0))).alias(c) for c in counters),
        F.max_by("status", F.when(told, F.col("seq"))).alias("status"),
        F.substring(F.max_by("stage_detail", F.when(F.col("stage_detail").isNotNull(), F.col("seq"))), 1, 500).alias("stage_detail"),
        F.min(F.when(told & (F.col("status") != "pending"), F.col("ts"))).alias("started_at"),
        F.max(ended).alias("finished_at"),
    )


def job_states(events: DataFrame, counters: tuple[str, ...] = COUNTERS) -> DataFrame:
    """Progress events folded as far as that goes on later: sums, and the last status and detail with their places."""
    told = F.col("status").isNotNull()
    return events.groupBy("job_id").agg(
        *(F.sum(F.coalesce(f"d_{c}", F.lit(0))).alias(c) for c in counters),
        F.max(F.when(told, F.struct("seq", "status"))).alias("last_status"),
        F.max(F.when(F.col("stage_detail").isNotNull(), F.struct("seq", "stage_detail"))).alias("last_detail"),
        F.min(F.when(told & (F.col("status") != "pending"), F.col("ts"))).alias("started_at"),
        F.max(F.when(F.col("status").isin("completed", "failed", "skipped"), F.col("ts"))).alias("finished_at"),
    )


def merged_states(before: DataFrame | None, states: DataFrame, counters: tuple[str, ...] = COUNTERS) -> DataFrame:
    """job_states of two disjoint sets of events as those of both."""
    if before is None:
        return states
    return before.unionByName(states).groupBy("job_id").agg(
        *(F.sum(c).alias(c) for c in counters), F.max("last_status").alias("last_status"), F.max("last_detail").alias("last_detail"),
        F.min("started_at").alias("started_at"), F.max("finished_at").alias("finished_at"),
    )


def progress_of(states: DataFrame, counters: tuple[str, ...] = COUNTERS) -> DataFrame:
    """job_progress from job_states."""
    return states.select("job_id", *counters, F.col("last_status.status").alias("status"), F.substring("last_detail.stage_detail", 1, 500).alias("stage_detail"), "started_at", "finished_at")


def answer_transitions(questions: DataFrame, answers: DataFrame) -> DataFrame:
    """Answers (id, answer, answered_by, answered_at) applied: dismissed ones conflict, missing ones aren't found."""
    joined = answers.alias("a").join(questions.alias("q"), "id", "left")
    outcome = F.when(F.col("q.status").isNull(), "not_found").when(F.col("q.status") == "dismissed", "conflict").otherwise("answered")
    return joined.select("id", F.col("q.status").alias("before"), outcome.alias("outcome"), F.when(outcome == "answered", F.col("a.answer")).alias("answer"))


def stale(tasks: DataFrame, now: Column, hours: int) -> DataFrame:
    """Uploads that haven't moved for some hours fail; a message that is there stays."""
    late = (F.col("status") == "uploading") & (F.col("updated_at") < now - F.make_interval(hours=F.lit(hours)))
    return update_where(tasks, late, status=F.lit("failed"), error_message=F.coalesce("error_message", F.lit("expired")), updated_at=now)


def backfill_code(rows: DataFrame, scripts: DataFrame) -> DataFrame:
    """A blank script_code becomes the script's code."""
    own = scripts.select(F.col("id").alias("script_id"), F.col("code").alias("__code"))
    return rows.join(own, "script_id", "left").withColumn("script_code", F.coalesce(F.nullif(F.trim("script_code"), F.lit("")), "__code")).drop("__code")


def recount(documents: DataFrame, chunks: DataFrame, qa: DataFrame) -> DataFrame:
    """Counters of documents set to the rows there are, vectors counted where they are there."""

    def count(rows: DataFrame, name: str) -> DataFrame:
        return rows.groupBy(F.col("document_id").alias("id")).agg(F.count("*").alias(f"total_{name}"), F.count("embedding").alias(f"embedded_{name}"))

    out = documents.drop("total_chunks", "total_qa", "embedded_chunks", "embedded_qa").join(count(chunks, "chunks"), "id", "left").join(count(qa, "qa"), "id", "left")
    return out.fillna(0, ["total_chunks", "embedded_chunks", "total_qa", "embedded_qa"])


def latest_job(jobs: DataFrame, code: str, ident: str, object_key: str | None = None) -> DataFrame:
    """The newest job of a code, or of the id where the code has none; of an object key where one is given."""
    from lodestar.operators.retrieval import by_code_or_id

    own = by_code_or_id(jobs, code, ident)
    own = own.where(F.col("object_key") == object_key) if object_key else own
    return own.orderBy(F.desc("created_at"), F.desc("id")).limit(1)


def running(jobs: DataFrame) -> DataFrame:
    """The newest job of each script that hasn't ended."""
    return latest_per_key(jobs.where(~F.col("status").isin(*TERMINAL)), ["script_id"], "created_at", "id")
