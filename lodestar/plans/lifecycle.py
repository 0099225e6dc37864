"""Life-cycle queries: documents, jobs, questions, requests, uploads, dictionaries and loads, over the order tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions import formats, text
from lodestar.operators import catalog, layout, requests, retrieval, titles, uploads, upsert
from lodestar.operators import slugs as slug

from .registry import query, table

NOW = "2001-01-01 00:00:00"


def _documents(spark: SparkSession, d: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return table(spark, d, "orders").select(
        k.alias("id"), c.cast("string").alias("script_id"), F.when(c % 4 == 0, " ").otherwise(F.concat(F.lit("c"), (c % 50).cast("string"))).alias("script_code"), (F.col("o_orderstatus") != "F").alias("is_active"),
        F.when(F.col("o_orderpriority") == "5-LOW", F.col("o_orderdate")).alias("deleted_at"), (k % 4).alias("total_chunks"), (k % 6).alias("total_qa"), (k % 9).alias("total_pages"), (k % 3 + 1).alias("version"),
        F.col("o_orderdate").alias("created_at"), F.col("o_orderpriority").alias("object_key"), F.lit(2).cast("long").alias("dropped_chunks"),
    )


_DOCS = """d AS (SELECT o_orderkey AS id, o_custkey::VARCHAR AS script_id, CASE WHEN o_custkey % 4 = 0 THEN ' ' ELSE 'c' || o_custkey % 50 END AS script_code, o_orderstatus <> 'F' AS is_active,
  CASE WHEN o_orderpriority = '5-LOW' THEN o_orderdate END AS deleted_at, o_orderkey % 4 AS total_chunks, o_orderkey % 6 AS total_qa, o_orderkey % 9 AS total_pages, o_orderkey % 3 + 1 AS version,
  o_orderdate AS created_at, o_orderpriority AS object_key, 2 AS dropped_chunks FROM orders)"""


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("document_id"), F.col("l_linenumber").alias("chunk_index"), F.when(F.col("l_returnflag") != "R", F.lit(1)).alias("embedding"), "l_linestatus", F.col("l_suppkey").alias("id"))


_CHUNKS = "c AS (SELECT l_orderkey AS document_id, l_linenumber AS chunk_index, CASE WHEN l_returnflag <> 'R' THEN 1 END AS embedding, l_linestatus, l_suppkey AS id FROM lineitem)"


# documents


@query(f"WITH {_DOCS} SELECT script_id, max(version) + 1 AS next_version FROM d GROUP BY script_id")
def next_versions(spark: SparkSession, d: str) -> DataFrame:
    return upsert.next_version(_documents(spark, d), "script_id")


@query(f"WITH {_DOCS} SELECT id, CASE WHEN NOT is_active AND deleted_at IS NULL THEN TIMESTAMP '{NOW}' ELSE deleted_at END AS deleted_at FROM d")
def soft_deleted(spark: SparkSession, d: str) -> DataFrame:
    return upsert.soft_delete(_documents(spark, d), ~F.col("is_active"), F.lit(NOW).cast("timestamp")).select("id", "deleted_at")


_GONE = "g AS (SELECT id FROM d WHERE deleted_at IS NOT NULL)"


@query(f"WITH {_DOCS}, {_GONE} SELECT id, CASE WHEN id IN (SELECT id FROM g) THEN 0 ELSE total_chunks END AS total_chunks, CASE WHEN id IN (SELECT id FROM g) THEN 0 ELSE total_qa END AS total_qa, CASE WHEN id IN (SELECT id FROM g) THEN 0 ELSE dropped_chunks END AS dropped_chunks FROM d")
def purged_documents(spark: SparkSession, d: str) -> DataFrame:
    docs = _documents(spark, d)
    c = _chunks(spark, d)
    return upsert.purge_documents(docs, c, c, docs.where("deleted_at is not null"))[0].select("id", "total_chunks", "total_qa", "dropped_chunks")


@query(f"WITH {_DOCS}, {_CHUNKS}, {_GONE} SELECT document_id, chunk_index, count(*) AS n FROM c WHERE document_id NOT IN (SELECT id FROM g) GROUP BY ALL")
def purged_chunks(spark: SparkSession, d: str) -> DataFrame:
    docs, c = _documents(spark, d), _chunks(spark, d)
    return upsert.purge_documents(docs, c, c, docs.where("deleted_at is not null"))[1].groupBy("document_id", "chunk_index").agg(F.count("*").alias("n"))


@query(
    f"""WITH {_DOCS}, {_CHUNKS}, x AS (SELECT document_id AS id, count(*) AS n, count(embedding) AS e FROM c GROUP BY ALL), y AS (SELECT document_id AS id, count(*) AS n, count(embedding) AS e FROM c WHERE l_linestatus = 'O' GROUP BY ALL)
SELECT d.id, coalesce(x.n, 0) AS total_chunks, coalesce(x.e, 0) AS embedded_chunks, coalesce(y.n, 0) AS total_qa, coalesce(y.e, 0) AS embedded_qa FROM d LEFT JOIN x USING (id) LEFT JOIN y USING (id)"""
)
def recounted_documents(spark: SparkSession, d: str) -> DataFrame:
    c = _chunks(spark, d)
    return upsert.recount(_documents(spark, d), c, c.where("l_linestatus = 'O'")).select("id", "total_chunks", "embedded_chunks", "total_qa", "embedded_qa")


@query(f"WITH {_DOCS} SELECT d.id, coalesce(nullif(trim(script_code), ''), c_name) AS script_code FROM d LEFT JOIN customer ON c_custkey::VARCHAR = script_id")
def backfilled_codes(spark: SparkSession, d: str) -> DataFrame:
    scripts = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("code"))
    return upsert.backfill_code(_documents(spark, d), scripts).select("id", "script_code")


_PICK = "p AS (SELECT script_id, min(id) AS chosen FROM d WHERE total_chunks = 3 GROUP BY script_id)"


@query(f"WITH {_DOCS}, {_PICK} SELECT d.id, CASE WHEN chosen IS NULL THEN is_active ELSE d.id = chosen END AS is_active FROM d LEFT JOIN p USING (script_id)")
def activated_documents(spark: SparkSession, d: str) -> DataFrame:
    docs = _documents(spark, d)
    chosen = docs.where("total_chunks = 3").groupBy("script_id").agg(F.min("id").alias("id"))
    return requests.activate(docs, chosen).select("id", "is_active")


@query(f"WITH {_DOCS}, {_CHUNKS}, h AS (SELECT document_id AS id, count(*) AS have FROM c GROUP BY ALL) SELECT d.id FROM d LEFT JOIN h USING (id) WHERE NOT (total_chunks > 0 AND coalesce(have, 0) >= total_chunks)")
def documents_to_index(spark: SparkSession, d: str) -> DataFrame:
    return requests.skip_indexed(_documents(spark, d), _chunks(spark, d)).select("id")


@query(f"WITH {_DOCS} SELECT DISTINCT script_id FROM d WHERE is_active AND deleted_at IS NULL AND total_chunks > 0")
def indexed_scripts(spark: SparkSession, d: str) -> DataFrame:
    return requests.indexed_scripts(_documents(spark, d))


@query(f"WITH {_DOCS} SELECT script_code, sum(total_pages)::BIGINT AS total_pages, sum(total_chunks)::BIGINT AS total_chunks, sum(total_qa)::BIGINT AS total_qa, max(version) AS version, sum(total_chunks) > 0 AS indexed FROM d WHERE is_active AND deleted_at IS NULL GROUP BY script_code")
def script_status(spark: SparkSession, d: str) -> DataFrame:
    return requests.script_status(_documents(spark, d))


@query(
    f"""WITH {_DOCS}, r AS (SELECT *, CASE WHEN script_code = 'c7' THEN 0 ELSE 1 END AS rank FROM d WHERE script_code = 'c7' OR script_id = '8')
SELECT id, script_code FROM r WHERE rank = (SELECT min(rank) FROM r)"""
)
def rows_by_code_or_id(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.by_code_or_id(_documents(spark, d), "c7", "8").select("id", "script_code")


# jobs


def _import_jobs(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("o_orderstatus")
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("script_id"), F.col("o_orderdate").alias("created_at"), F.when(s == "F", "completed").when(s == "O", "embedding").otherwise("cancelled").alias("status"),
        F.col("o_orderpriority").alias("job_object_key"), F.when(F.col("o_totalprice") > 150_000, F.col("o_orderpriority")).otherwise("1-URGENT").alias("object_key"),
    )


_IMPORTS = """j AS (SELECT o_orderkey AS id, o_custkey AS script_id, o_orderdate AS created_at, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'embedding' ELSE 'cancelled' END AS status,
  o_orderpriority AS job_object_key, CASE WHEN o_totalprice > 150000 THEN o_orderpriority ELSE '1-URGENT' END AS object_key FROM orders)"""


@query(f"WITH {_IMPORTS} SELECT script_id, id, status FROM (SELECT *, row_number() OVER (PARTITION BY script_id ORDER BY created_at DESC, id DESC) AS n FROM j WHERE status = 'embedding') WHERE n = 1")
def running_jobs(spark: SparkSession, d: str) -> DataFrame:
    return upsert.running(_import_jobs(spark, d)).select("script_id", "id", "status")


@query(f"WITH {_IMPORTS}, l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY script_id ORDER BY created_at DESC, id DESC) AS n FROM j) WHERE n = 1) SELECT script_id, CASE WHEN status IN ('completed', 'cancelled') THEN 'create' WHEN job_object_key = object_key THEN 'reuse' ELSE 'cancel_and_create' END AS action FROM l")
def ingest_actions(spark: SparkSession, d: str) -> DataFrame:
    latest = upsert.latest_per_key(_import_jobs(spark, d), ["script_id"], "created_at", "id")
    return requests.ingest_decision(latest).select("script_id", "action")


# keyed writes


@query("SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS n FROM events) WHERE n = 1")
def first_wins(spark: SparkSession, d: str) -> DataFrame:
    return upsert.first_per_key(table(spark, d, "events"), ["user_id", "event_type"], ["event_id"]).select("user_id", "event_type", "event_id")


@query(f"SELECT c_custkey AS id, c_name AS name, TIMESTAMP '1999-01-01' AS created_at, TIMESTAMP '1999-01-01' AS updated_at FROM customer UNION ALL SELECT s_suppkey, s_name, TIMESTAMP '{NOW}', TIMESTAMP '{NOW}' FROM supplier")
def inserted_rows(spark: SparkSession, d: str) -> DataFrame:
    old = F.lit("1999-01-01").cast("timestamp")
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), old.alias("created_at"), old.alias("updated_at"))
    return upsert.insert(c, table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")), F.lit(NOW).cast("timestamp"))


@query(f"SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'F' THEN TIMESTAMP '{NOW}' ELSE o_orderdate END AS updated_at FROM orders")
def touched_rows(spark: SparkSession, d: str) -> DataFrame:
    old = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("updated_at"))
    new = old.withColumn("status", F.when(F.col("status") == "F", "closed").otherwise(F.col("status")))
    return upsert.touched(old, new, "id", F.lit(NOW).cast("timestamp")).select("id", "updated_at")


@query("SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'answered' WHEN 'O' THEN 'pending' ELSE 'dismissed' END AS before, CASE o_orderstatus WHEN 'P' THEN 'conflict' ELSE 'answered' END AS outcome, CASE WHEN o_orderstatus <> 'P' THEN o_orderpriority END AS answer FROM orders UNION ALL SELECT -1 - p_partkey, NULL, 'not_found', NULL FROM part")
def answer_outcomes(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    s = F.col("o_orderstatus")
    q = o.select(F.col("o_orderkey").alias("id"), F.when(s == "F", "answered").when(s == "O", "pending").otherwise("dismissed").alias("status"))
    a = o.select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("answer")).unionByName(table(spark, d, "part").select((-1 - F.col("p_partkey")).alias("id"), F.lit("late").alias("answer")))
    return upsert.answer_transitions(q, a)


# questions


@query(
    """WITH q AS (SELECT user_id % 3 AS g, event_type AS question_hash, count(*) AS ask_count, max(ts) AS created_at FROM events GROUP BY ALL), f AS (SELECT * FROM q WHERE g = 1)
SELECT question_hash, ask_count, (SELECT count(*) FROM f) AS total FROM f ORDER BY ask_count DESC, created_at DESC, question_hash LIMIT 3 OFFSET 1"""
)
def question_page(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "events").groupBy((F.col("user_id") % 3).cast("string").alias("script_code"), F.col("event_type").alias("question_hash")).agg(F.count("*").alias("ask_count"), F.max("ts").alias("created_at"))
    return upsert.question_page(q.withColumn("status", F.lit("pending")), " 1 ", "any", 3, 1).select("question_hash", "ask_count", "total")


_NORMAL = f"lower(regexp_replace(regexp_replace(text, '{text.DECORATION}', '', 'g'), '{text.SPACE}+', '', 'g'))"


@query(f"SELECT conv_id, turn, md5(substring(text, 1, 500)) AS kept_md5, sha256({_NORMAL}) AS question_hash FROM conversations WHERE role = 'user'")
def asked_questions(spark: SparkSession, d: str) -> DataFrame:
    kept, whole = text.asked(F.col("text"))
    return table(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", F.md5(kept).alias("kept_md5"), whole.alias("question_hash"))


@query(f"SELECT conv_id, turn, md5('{text.QUERY_PREFIX}' || text) AS query_md5 FROM conversations WHERE role = 'user'")
def query_texts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", F.md5(text.query_text(F.col("text"), "BAAI/bge-large-zh-v1.5")).alias("query_md5"))


@query(
    """WITH d AS (SELECT o_orderkey AS document_id, o_orderdate AS doc_at FROM orders WHERE o_orderstatus <> 'F'), q AS (SELECT l_orderkey AS document_id, l_linenumber, l_partkey, l_suppkey, l_shipdate FROM lineitem),
n AS (SELECT q.*, doc_at, CASE WHEN l_linenumber % 5 > 0 THEN l_linenumber END AS chunk FROM q JOIN d USING (document_id))
SELECT l_suppkey::VARCHAR AS script_code, document_id, l_partkey AS part, (row_number() OVER (PARTITION BY l_suppkey ORDER BY doc_at, document_id, chunk NULLS LAST, l_shipdate, l_linenumber, l_partkey, l_suppkey) - 1)::INT AS pos FROM n"""
)
def title_order(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.struct("o_orderdate", "o_orderkey").alias("created_at"), (F.col("o_orderstatus") != "F").alias("is_active"), F.lit(None).cast("timestamp").alias("deleted_at"))
    l = table(spark, d, "lineitem")
    qa = l.select(F.col("l_suppkey").cast("string").alias("script_code"), F.col("l_orderkey").alias("document_id"), F.when(F.col("l_linenumber") % 5 > 0, F.col("l_linenumber")).alias("chunk_id"), F.col("l_shipdate").alias("created_at"), F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("id"), F.col("l_partkey").alias("part"))
    chunks = l.select(F.col("l_linenumber").alias("id"), F.col("l_linenumber").alias("chunk_index")).distinct()
    return titles.title_list(qa, docs, chunks).select("script_code", "document_id", "part", "pos")


@query(
    """SELECT l_returnflag AS category, 'q' || l_linenumber AS question, l_linestatus AS answer, CASE WHEN l_linenumber % 3 > 0 THEN l_linenumber || '-' || (l_linenumber + 1) END AS pages
FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus <> 'F' AND o_orderpriority || o_custkey = (SELECT max(o_orderpriority || o_custkey) FROM orders WHERE o_orderstatus <> 'F')"""
)
def answers_of_script(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    code = F.concat("o_orderpriority", F.col("o_custkey").cast("string"))
    scripts = o.select(F.col("o_orderkey").alias("id"), code.alias("code"), F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate")).alias("deleted_at"))
    n = F.col("l_linenumber")
    qa = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("script_id"), F.col("l_returnflag").alias("category"), F.col("l_shipdate").alias("created_at"), F.concat(F.lit("q"), n.cast("string")).alias("question"), F.col("l_linestatus").alias("answer"), F.when(n % 3 > 0, n).alias("page_start"), (n + 1).alias("page_end"))
    return titles.answers_of(qa, scripts, o.where("o_orderstatus <> 'F'").agg(F.max(code).alias("script_code")))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN source ELSE 'kept' END AS title FROM documents")
def backfilled_titles(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 2 == 0, " ").otherwise("kept").alias("title"), F.array("lang", "source").alias("section_path"))
    return titles.backfill_titles(rows).select("doc_id", "title")


# requests


def _asked(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") != "P", F.col("o_custkey")).alias("script_id"), F.col("o_custkey").alias("user_id"))


@query("SELECT o_orderkey AS id, c_name AS title_now, coalesce(o_orderstatus <> 'P' AND c_acctbal > 5000, false) AS has_guide FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND o_orderstatus <> 'P'")
def requests_with_scripts(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    scripts = c.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("title"), F.lit("").alias("cover_url"))
    return requests.with_scripts(_asked(spark, d), scripts, c.where("c_acctbal > 5000").select(F.col("c_custkey").alias("script_id"))).select("id", "title_now", "has_guide")


@query("SELECT o_orderkey AS id, c_name AS nickname FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_nationkey > 3) ON c_custkey = o_custkey")
def requests_with_profiles(spark: SparkSession, d: str) -> DataFrame:
    profiles = table(spark, d, "customer").where("c_nationkey > 3").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("nickname"))
    return requests.with_profiles(_asked(spark, d), profiles, {"user_id": "nickname"}).select("id", "nickname")


@query("SELECT o_orderkey AS id, CASE WHEN o_orderstatus <> 'P' THEN 'key' || o_custkey ELSE regexp_replace(lower(o_orderpriority), ' *(副本|copy)$', '') END AS match_key FROM orders")
def match_keys(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") != "P", F.concat(F.lit("key"), F.col("o_custkey").cast("string"))).alias("script_id"), F.col("o_orderpriority").alias("script_title"))
    return requests.match_key(o).select("id", "match_key")


@query("SELECT event_id, user_id FROM events WHERE user_id = 8 OR event_type = 'purchase'")
def visible_rows(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("is_public", F.col("event_type") == "purchase")
    return catalog.visible(e, 8).select("event_id", "user_id")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_custkey = 7)")
def visible_parts(spark: SparkSession, d: str) -> DataFrame:
    """Parts of the uploads of one user."""
    tasks = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("user_id"))
    parts = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("task_id"), "l_linenumber")
    return catalog.visible_through(parts, tasks, "task_id", 7).select(F.col("task_id").alias("l_orderkey"), "l_linenumber")


@query(
    """WITH o AS (SELECT p_partkey AS id, CASE p_size % 4 WHEN 0 THEN 'draft' WHEN 1 THEN 'offline' WHEN 2 THEN 'published' END AS status, CASE WHEN p_size % 3 > 0 THEN p_size END AS old_guide FROM part),
n AS (SELECT s_suppkey AS id, CASE WHEN s_nationkey % 3 > 0 THEN s_nationkey END AS guide FROM supplier)
SELECT o.id, CASE WHEN n.id IS NOT NULL AND (status IS NULL OR status <> 'published') THEN 'published' ELSE status END AS status, coalesce(guide, old_guide)::VARCHAR AS guide, 'a' || o.id AS other FROM o LEFT JOIN n USING (id)"""
)
def attached_rows(spark: SparkSession, d: str) -> DataFrame:
    """Imports attach their guides to the rows that they are linked to, and publish them."""
    n = F.col("p_size")
    told = F.struct(F.concat(F.lit("a"), F.col("p_partkey").cast("string")).alias("other"), F.when(n % 3 > 0, n).alias("dmGuide"))
    old = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.when(n % 4 == 0, "draft").when(n % 4 == 1, "offline").when(n % 4 == 2, "published").alias("status"), F.to_json(told).alias("extra"))
    k = F.col("s_nationkey")
    new = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.to_json(F.when(k % 2 == 0, F.create_map(F.lit("dmGuide"), F.when(k % 3 > 0, k))).otherwise(F.create_map(F.lit("dm_guide"), F.when(k % 3 > 0, k)))).alias("extra"))
    out = catalog.attach(old, new, "id")
    return out.select("id", "status", F.get_json_object("extra", "$.dmGuide").alias("guide"), F.get_json_object("extra", "$.other").alias("other"))


@query(
    """WITH q AS (SELECT user_id % 3 AS g, event_type AS question_hash, count(*) AS ask_count, max(ts) AS created_at, min(user_id) AS a, max(user_id) AS z FROM events GROUP BY ALL), f AS (SELECT * FROM q WHERE g = 1)
SELECT (row_number() OVER (ORDER BY ask_count DESC, created_at DESC, question_hash) - 1)::INT AS pos, question_hash, ask_count, (SELECT count(*) FROM f) AS total, x.c_name AS asked_by, y.c_name AS answered_by_name
FROM f LEFT JOIN customer AS x ON x.c_custkey = a LEFT JOIN customer AS y ON y.c_custkey = z"""
)
def questions_with_profiles(spark: SparkSession, d: str) -> DataFrame:
    who = [F.min("user_id").alias("created_by"), F.max("user_id").alias("answered_by")]
    q = table(spark, d, "events").groupBy((F.col("user_id") % 3).cast("string").alias("script_code"), F.col("event_type").alias("question_hash")).agg(F.count("*").alias("ask_count"), F.max("ts").alias("created_at"), *who)
    profiles = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("nickname"))
    return requests.question_page(q.withColumn("status", F.lit("pending")), profiles, "1").select("pos", "question_hash", "ask_count", "total", "asked_by", "answered_by_name")


# uploads


def _files(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(
        F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("file_id"), (F.col("l_suppkey") % 20).alias("user_id"), (F.col("l_partkey") % 50).cast("string").alias("file_hash"), F.col("l_quantity").cast("int").alias("file_size"),
        F.col("l_shipdate").alias("created_at"), F.when(F.col("l_returnflag") == "R", F.col("l_shipdate")).alias("deleted_at"), F.concat(F.when(F.col("l_linestatus") == "O", "temp/").otherwise("uploads/"), F.col("l_partkey").cast("string")).alias("object_key"),
        F.concat(F.lit("File "), F.col("l_partkey").cast("string")).alias("filename"),
    )


_FILES = """f AS (SELECT {'a': l_orderkey, 'b': l_linenumber, 'c': l_partkey, 'd': l_suppkey} AS file_id, l_suppkey % 20 AS user_id, (l_partkey % 50)::VARCHAR AS file_hash, l_quantity::INT AS file_size, l_shipdate AS created_at,
  l_returnflag = 'R' AS gone, CASE WHEN l_linestatus = 'O' THEN 'temp/' ELSE 'uploads/' END || l_partkey AS object_key, 'File ' || l_partkey AS filename FROM lineitem),
w AS (SELECT DISTINCT user_id, CASE WHEN file_hash = '7' THEN ' ' ELSE file_hash END AS file_hash, file_size FROM f)"""


def _wanted(files: DataFrame) -> DataFrame:
    return files.select("user_id", F.when(F.col("file_hash") == "7", " ").otherwise(F.col("file_hash")).alias("file_hash"), "file_size").distinct()


@query(f"WITH {_FILES}, m AS (SELECT user_id, file_hash, file_size, max({{'t': created_at, 'f': file_id}}) AS x FROM f WHERE object_key LIKE 'temp/%' GROUP BY ALL) SELECT user_id, file_hash, file_size, x.f.a AS l_orderkey, x.f.b AS l_linenumber FROM m JOIN w USING (user_id, file_hash, file_size)")
def resumable_uploads(spark: SparkSession, d: str) -> DataFrame:
    f = _files(spark, d)
    tasks = f.withColumn("status", F.lit("uploading")).withColumnRenamed("file_id", "task_id")
    return uploads.resumable(tasks, _wanted(f), "temp").select("user_id", "file_hash", "file_size", "task_id.l_orderkey", "task_id.l_linenumber")


@query(
    f"""WITH {_FILES}, m AS (SELECT user_id, file_hash, max({{'t': created_at, 'f': file_id, 's': file_size}}) AS x FROM f WHERE NOT gone AND object_key LIKE 'uploads/%' GROUP BY ALL)
SELECT w.user_id, w.file_hash, w.file_size, x.f.a AS l_orderkey, x.f.b AS l_linenumber FROM m JOIN w ON w.user_id = m.user_id AND w.file_hash = m.file_hash AND w.file_size = m.x.s"""
)
def instant_uploads(spark: SparkSession, d: str) -> DataFrame:
    f = _files(spark, d)
    return uploads.instant(f, _wanted(f), "uploads").select("user_id", "file_hash", "file_size", "file_id.l_orderkey", "file_id.l_linenumber")


@query("SELECT l_orderkey AS task_id, l_linenumber AS part_number, position::INT AS position, (position // 3)::INT AS page FROM (SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1 AS position FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem))")
def listed_parts(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("task_id"), F.col("l_linenumber").alias("part_number")).distinct()
    return uploads.listed_parts(p, 3)


@query(f"WITH {_FILES} SELECT object_key, filename FROM f WHERE user_id = 3 AND NOT gone AND filename ILIKE '%le 1%'")
def user_files(spark: SparkSession, d: str) -> DataFrame:
    return uploads.user_files(_files(spark, d), 3, '"le 1"').select("object_key", "filename")


@query("SELECT page_id, n AS name, CASE WHEN n LIKE '%.pdf' THEN 'pdf' WHEN n LIKE '%.Zip' THEN 'zip' ELSE '' END AS ext, CASE WHEN n LIKE '%.pdf' THEN 'application/pdf' WHEN n LIKE '%.Zip' THEN 'application/zip' ELSE 'application/octet-stream' END AS type FROM (SELECT page_id, 'p_' || page_id || CASE page_id % 3 WHEN 0 THEN '.pdf' WHEN 1 THEN '.x.Zip' ELSE '' END AS n FROM pages)")
def file_names(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("page_id") % 3
    raw = F.concat(F.lit(" a/../p:"), F.col("page_id").cast("string"), F.when(k == 0, "..pdf. ").when(k == 1, ".x.Zip").otherwise("."))
    name = text.safe_filename(raw)
    return table(spark, d, "pages").select("page_id", name.alias("name"), text.extension(name).alias("ext"), text.content_type(name, F.lit("")).alias("type"))


@query("SELECT event_id, concat_ws('/', 'uploads', user_id, strftime(ts, '%Y/%m'), event_id || CASE WHEN event_type = 'error' THEN '' ELSE '.' || event_type END) AS key FROM events")
def object_keys(spark: SparkSession, d: str) -> DataFrame:
    name = F.when(F.col("event_type") == "error", "x").otherwise(F.concat(F.lit("x."), F.upper("event_type")))
    return table(spark, d, "events").select("event_id", text.object_key(F.col("user_id"), name, F.col("ts"), F.col("event_id").cast("string"), "/uploads/").alias("key"))


# dictionaries and catalogue


def _options(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    return p.select(F.col("p_type").alias("category_code"), F.col("p_partkey").cast("string").alias("code"), F.col("p_name").alias("label"), F.col("p_brand").alias("description"), F.array(F.col("p_size").cast("string"), F.lit("red")).alias("aliases"), F.col("p_size").alias("sort_order"), (F.col("p_size") > 5).alias("is_active"), (F.col("p_size") > 20).alias("is_hot"))


@query("SELECT p_type AS category_code, p_partkey::VARCHAR AS code FROM part WHERE p_size > 20 AND p_type = 'PROMO' AND (p_name ILIKE '%ring%' OR p_brand ILIKE '%ring%' OR p_size::VARCHAR = 'ring')")
def options_found(spark: SparkSession, d: str) -> DataFrame:
    return catalog.find_options(_options(spark, d), "r*ing", "PROMO", hot=True).select("category_code", "code")


@query("SELECT p_type AS category_code, p_partkey::VARCHAR AS code FROM part WHERE contains(lower(p_name || ' ' || p_brand || ' ' || p_size || ' red'), 'd#1 2')")
def options_searched(spark: SparkSession, d: str) -> DataFrame:
    return catalog.search_options(_options(spark, d), " D#1 2").select("category_code", "code")


_SCRIPTS = "s AS (SELECT p_partkey AS id, p_name AS title, p_size AS play_count, p_retailprice AS rating, ['a' || p_size] AS aliases FROM part)"


def _scripts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_partkey").cast("string").alias("code"), F.col("p_name").alias("title"), F.col("p_size").alias("play_count"), F.col("p_retailprice").alias("rating"), F.array(F.concat(F.lit("a"), F.col("p_size").cast("string"))).alias("aliases"),
        F.lit(None).cast("timestamp").alias("deleted_at"), F.col("p_brand").alias("author"), F.lit("u").alias("cover_url"), F.when(F.col("p_size") > 25, '{"dmGuide": {"objectKey": " k "}}').when(F.col("p_size") > 10, '{"dm_guide": ""}').alias("extra"),
    )


@query(f"WITH {_SCRIPTS} SELECT id, title FROM s WHERE lower(title) IN ('small ring.pdf', 'small ring') OR list_contains(aliases, 'small ring') ORDER BY play_count DESC, rating DESC NULLS LAST, id LIMIT 1")
def existing_title(spark: SparkSession, d: str) -> DataFrame:
    return catalog.find_existing(_scripts(spark, d), "Small Ring.pdf").select("id", "title")


@query(f"WITH {_SCRIPTS} SELECT id, title FROM s WHERE list_contains(aliases, 'a7') ORDER BY play_count DESC, rating DESC NULLS LAST, id LIMIT 1")
def existing_alias(spark: SparkSession, d: str) -> DataFrame:
    return catalog.find_existing(_scripts(spark, d), "A7 copy (1)").select("id", "title")


@query("SELECT o_orderkey AS id, o_totalprice FROM orders WHERE o_orderpriority <> '5-LOW' AND o_orderkey IN (SELECT l_suppkey FROM lineitem)")
def rows_by_ids(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), "o_totalprice", F.when(F.col("o_orderpriority") == "5-LOW", F.lit(1)).alias("deleted_at"))
    return catalog.by_ids(o, table(spark, d, "lineitem").select(F.col("l_suppkey").alias("id"))).select("id", "o_totalprice")


@query(f"WITH {_SCRIPTS} SELECT id, title, play_count > 25 AS has_guide FROM s WHERE title ILIKE '%ring%' ORDER BY play_count DESC NULLS LAST, rating DESC NULLS LAST, id LIMIT 15")
def autocompleted(spark: SparkSession, d: str) -> DataFrame:
    return catalog.autocomplete(_scripts(spark, d), "ring", 15).select("id", "title", "has_guide")


@query("SELECT p_partkey AS id, CASE WHEN p_size > 25 THEN 'k' END AS guide_key, p_size > 25 AS has_guide FROM part")
def guide_keys(spark: SparkSession, d: str) -> DataFrame:
    return _scripts(spark, d).select("id", formats.guide_key(F.col("extra")).alias("guide_key"), F.coalesce(formats.has_guide(F.col("extra")), F.lit(False)).alias("has_guide"))


@query(
    """WITH n AS (SELECT n_nationkey::VARCHAR AS code, n_name FROM nation)
SELECT c_custkey AS id, k.n_name AS kind_label, [coalesce(t.n_name, (c_custkey % 40)::VARCHAR), coalesce(k.n_name, c_nationkey::VARCHAR)][1] AS theme_label, 0 AS play_count, CASE WHEN c_nationkey = 5 THEN NULL ELSE c_nationkey || '人' END AS players_text
FROM customer LEFT JOIN n AS k ON k.code = c_nationkey::VARCHAR LEFT JOIN n AS t ON t.code = (c_custkey % 40)::VARCHAR"""
)
def catalogue_items(spark: SparkSession, d: str) -> DataFrame:
    options = table(spark, d, "nation").select(F.explode(F.array(F.lit("kind"), F.lit("theme"))).alias("category_code"), F.col("n_nationkey").cast("string").alias("code"), F.col("n_name").alias("label"), F.lit(1).alias("sort_order"))
    n = F.col("c_nationkey")
    rows = table(spark, d, "customer").select(
        F.col("c_custkey").alias("id"), n.cast("string").alias("kind"), F.array((F.col("c_custkey") % 40).cast("string"), n.cast("string")).alias("theme"), n.alias("player_min"), F.when(n != 5, n).alias("player_max"),
        *(F.lit(None).cast("int").alias(c) for c in ("male_count", "female_count", "flexible_count", "duration_min", "duration_max", "play_count", "rating_count")), F.lit("{}").alias("extra"),
    )
    return catalog.items(rows, options, {"kind": "kind"}, {"theme": "theme"}).select("id", "kind_label", F.get("theme_labels", F.lit(0)).alias("theme_label"), "play_count", "players_text")


@query("SELECT c_custkey AS id, CASE WHEN c_acctbal < 0 THEN s_name ELSE c_name END AS title, CASE WHEN c_nationkey = coalesce(s_nationkey, c_nationkey) THEN c_nationkey::VARCHAR ELSE c_nationkey || ',' || s_nationkey END AS tags FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey WHERE c_acctbal >= 0 OR s_name IS NOT NULL")
def merged_rows(spark: SparkSession, d: str) -> DataFrame:
    c, s = table(spark, d, "customer"), table(spark, d, "supplier")
    old = c.select(F.col("c_custkey").alias("id"), F.when(F.col("c_acctbal") >= 0, F.col("c_name")).otherwise(" ").alias("title"), F.array(F.col("c_nationkey").cast("string")).alias("tags"))
    new = s.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("title"), F.array(F.concat(F.lit(" "), F.col("s_nationkey").cast("string")), F.lit("")).alias("tags"))
    out = catalog.merge_rows(old, new, "id", ["title"], ["tags"], fill_only=True).where("title is not null")
    return out.select("id", "title", F.array_join("tags", ",").alias("tags"))


@query("SELECT c_custkey AS id, CASE WHEN c_acctbal < 0 AND s_suppkey IS NOT NULL THEN 'S' ELSE CASE WHEN c_acctbal < 0 THEN NULL ELSE c_mktsegment END END AS author, CASE WHEN s_suppkey IS NOT NULL THEN 'old,' || lower(s_name) ELSE 'old' END AS aliases FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey")
def linked_rows(spark: SparkSession, d: str) -> DataFrame:
    old = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("title"), F.when(F.col("c_acctbal") >= 0, F.col("c_mktsegment")).otherwise(" ").alias("author"), F.array(F.lit("old")).alias("aliases"))
    new = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.concat("s_name", F.lit(".pdf")).alias("title"), F.lit("S").alias("author"))
    out = catalog.link_rows(old, new, "id", ["author"])
    return out.select("id", "author", F.array_join("aliases", ",").alias("aliases"))


def _patched(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    p, n = table(spark, d, "part"), F.col("p_size")
    old = p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.col("p_brand").alias("author"))
    told = F.when(n == 1, F.array().cast("array<string>")).when(n == 2, F.array(F.lit("code"), F.lit("title"))).when(n == 3, F.array(F.lit("colour"))).when(n < 20, F.array(F.lit("author"))).otherwise(F.array(F.lit("title"), F.lit("author")))
    changes = p.select(F.when(n == 4, -1 - F.col("p_partkey")).otherwise(F.col("p_partkey")).alias("id"), F.col("p_type").alias("title"), F.when(n % 2 == 0, "new").alias("author"), told.alias("told"))
    return catalog.patch_rows(old, changes, "id", ["title", "author"])


@query("SELECT p_partkey AS id, CASE WHEN p_size >= 20 THEN p_type ELSE p_name END AS title, CASE WHEN p_size <= 4 THEN p_brand WHEN p_size % 2 = 0 THEN 'new' END AS author FROM part")
def patched_rows(spark: SparkSession, d: str) -> DataFrame:
    return _patched(spark, d)[0]


@query("SELECT CASE WHEN p_size = 4 THEN -1 - p_partkey ELSE p_partkey END AS id, CASE p_size WHEN 1 THEN 'nothing to change' WHEN 2 THEN 'fixed: code' WHEN 3 THEN 'unknown: colour' ELSE 'not found' END AS problem FROM part WHERE p_size <= 4")
def refused_patches(spark: SparkSession, d: str) -> DataFrame:
    return _patched(spark, d)[1]


@query("SELECT event_id, json_extract_string(props, '$.k')::INT AS k, user_id AS u FROM events")
def merged_json(spark: SparkSession, d: str) -> DataFrame:
    new = F.to_json(F.struct(F.col("user_id").alias("u")))
    merged = F.from_json(catalog.merge_json(F.concat(F.lit('{"u": "old", '), F.expr("substr(props, 2)")), new), "k int, u long")
    return table(spark, d, "events").select("event_id", merged["k"].alias("k"), merged["u"].alias("u"))


_SEEDS = "r AS (SELECT p_partkey AS id, p_partkey // 2 * 2 AS code, CASE WHEN p_size > 3 THEN p_size % 9 END AS lo, p_size % 8 AS hi, p_size % 5 AS m, p_size % 4 AS f, p_retailprice / 150 AS rating FROM part)"


@query(
    f"""WITH {_SEEDS}, p AS (SELECT id, 'code used twice' AS problem FROM r WHERE code IN (SELECT code FROM r GROUP BY code HAVING count(*) > 1)
UNION ALL SELECT id, 'range: player_min' FROM r WHERE lo IS NULL OR lo > hi UNION ALL SELECT id, 'rating' FROM r WHERE rating > 10 UNION ALL SELECT id, 'unknown kind: ' || hi FROM r WHERE hi = 7
UNION ALL SELECT id, 'unknown fields: spare' FROM r WHERE hi = 2) SELECT id, problem FROM p"""
)
def seed_problems(spark: SparkSession, d: str) -> DataFrame:
    s, k = F.col("p_size"), F.col("p_partkey")
    rows = table(spark, d, "part").select(k.alias("id"), (F.floor(k / 2) * 2).alias("code"), F.when(s > 3, s % 9).alias("player_min"), (s % 8).alias("player_max"), (s % 8).cast("string").alias("kind"), (F.col("p_retailprice") / 150).alias("rating"), F.when(s % 8 == 2, 1).alias("spare"))
    options = table(spark, d, "nation").where("n_nationkey <> 7").select(F.lit("kind").alias("category_code"), F.col("n_nationkey").cast("string").alias("code"))
    known = ["id", "code", "player_min", "player_max", "kind", "rating"]
    return catalog.seed_violations(rows, options, {"kind": "kind"}, [("player_min", "player_max", 50)], known)


@query(f"WITH {_SEEDS} SELECT id, (m + f)::INT AS total FROM r WHERE m + f > hi")
def gender_violations(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("p_size")
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("id"), (s % 5).alias("male_count"), (s % 4).alias("female_count"), F.lit(None).cast("int").alias("flexible_count"), (s % 8).alias("player_max"))
    return catalog.gender_violations(rows).select("id", F.col("total").cast("int").alias("total"))


# texts and layout


#: Terms and their syllables, as a library would keep them in a table.
_TERMS = [("雾", ["wu"]), ("都", ["du"]), ("雾都", ["wu", "du"]), ("疑影", ["yi", "ying"]), ("山", ["shan"]), ("母", ["mu"]), ("鬼", ["gui"]), ("重", ["zhong"]), ("重庆", ["chong", "qing"]), ("都城", ["du", "cheng"])]
_NAMES = ["Café Ñandú ", "雾都疑影", "山母鬼", "老重庆 重 ", "雾都城", "标题"]
_NAMED = f"""t AS (SELECT s_suppkey, CASE s_suppkey % 7 {' '.join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(_NAMES))} ELSE s_name END || CASE WHEN s_suppkey % 7 < 5 THEN (s_suppkey % 40)::VARCHAR ELSE '' END AS title FROM supplier),
d AS (SELECT list({{'n': length(term), 'term': term, 'said': said}} ORDER BY length(term) DESC) AS terms FROM (VALUES {', '.join(f"('{t}', '-{'-'.join(x)}-')" for t, x in _TERMS)}) AS v(term, said)),
r AS (SELECT DISTINCT title, 1::BIGINT AS place, ''::VARCHAR AS said FROM t UNION ALL
  SELECT title, place + coalesce(best.n, 1), said || coalesce(best.said, substring(title, place, 1)) FROM (
    SELECT r.*, list_filter(terms, lambda x: starts_with(substring(title, place), x.term))[1] AS best FROM r, d WHERE place <= length(title))),
s AS (SELECT title, substring(trim(regexp_replace(regexp_replace(lower(strip_accents(said)), '[^\\x00-\\x7F]', '', 'g'), '[^a-z0-9]+', '-', 'g'), '-'), 1, 48) AS slug FROM r WHERE place > length(title))"""


@query(f"WITH RECURSIVE {_NAMED} SELECT s_suppkey, slug, lower(CASE WHEN slug = '' THEN 'ID' || s_suppkey ELSE slug END) AS code FROM t JOIN s USING (title)")
def slugs(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey") % 7
    name = F.coalesce(F.get(F.array(*map(F.lit, _NAMES)), k.cast("int")), F.col("s_name"))
    rows = table(spark, d, "supplier").select("s_suppkey", F.concat(name, F.when(k < 5, (F.col("s_suppkey") % 40).cast("string")).otherwise("")).alias("title"))
    terms = spark.createDataFrame(_TERMS, "term string, syllables array<string>")
    read = slug.transliterate(rows, terms, "title", "said")
    return read.select("s_suppkey", text.slug(F.col("said")).alias("slug"), text.library_code(F.col("said"), F.concat(F.lit("ID"), F.col("s_suppkey").cast("string"))).alias("code"))


@query("SELECT c_custkey, CASE WHEN c_nationkey = c_custkey % 25 THEN c_nationkey::VARCHAR ELSE c_nationkey || ',' || c_custkey % 25 END AS parts FROM customer")
def cleaned_lists(spark: SparkSession, d: str) -> DataFrame:
    raw = F.concat(F.lit(" "), F.col("c_nationkey").cast("string"), F.lit(" , ,"), (F.col("c_custkey") % 25).cast("string"), F.lit(", "))
    return table(spark, d, "customer").select("c_custkey", F.array_join(text.clean_list(text.split_path(raw)), ",").alias("parts"))


_TAIL = "regexp_extract(t, '^[^{m}]*[{m}]([\\s\\S]+)$', 1)".format(m=text.TAIL_MARKS)


@query(f"SELECT doc_id, md5(CASE WHEN {_TAIL} <> '' THEN {_TAIL} ELSE t END) AS tail_md5 FROM (SELECT doc_id, right(text, 120) AS t FROM documents)")
def overlap_tails(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.md5(text.tail_overlap(F.col("text"), 120)).alias("tail_md5"))


@query(
    """WITH b AS (SELECT l_orderkey AS document_id, l_linenumber AS ord, l_partkey, l_suppkey, l_quantity AS x0, l_extendedprice AS y0 FROM lineitem),
s AS (SELECT *, avg((x0 > 26.25)::INT) OVER (PARTITION BY document_id) AS share FROM b)
SELECT document_id, ord, x0, y0, (row_number() OVER (PARTITION BY document_id ORDER BY CASE WHEN share BETWEEN 0.25 AND 0.75 AND x0 > 26.25 THEN 1 ELSE 0 END, y0, x0, ord) - 1)::INT AS reading_pos FROM s"""
)
def reading_order(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("document_id"), F.lit(1).alias("page"), F.col("l_linenumber").alias("ord"), F.col("l_quantity").alias("x0"), F.col("l_extendedprice").alias("y0"), F.lit(50.0).alias("page_width"))
    return layout.reading_order(b).select("document_id", "ord", "x0", "y0", "reading_pos")


@query("SELECT o_orderkey AS document_id, k::INT AS page FROM orders, range(1, 8) AS r(k) WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linenumber = k)")
def pages_without_text(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "orders").select(F.col("o_orderkey").alias("document_id"), F.lit(7).alias("total_pages"))
    return layout.pages_without_text(docs, table(spark, d, "lineitem").select(F.col("l_orderkey").alias("document_id"), F.col("l_linenumber").alias("page")))


@query("SELECT document_id, part, n::INT AS chunk_index, (n // 3)::INT AS batch_id FROM (SELECT l_orderkey AS document_id, l_partkey AS part, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS n FROM lineitem)")
def numbered_batches(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("document_id"), F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("chunk_index"), F.col("l_partkey").alias("part"))
    return layout.batches(layout.renumber(rows), 3).select("document_id", "part", "chunk_index", "batch_id")
