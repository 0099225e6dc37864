"""Catalogue, dictionary, counter, request and upload queries over the order tables and `events`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions import formats
from lodestar.functions.text import DECORATION, SPACE, content_hash
from lodestar.operators import catalog, requests, uploads, upsert

from .registry import ORACLES, query, table


@query("SELECT p_partkey, p_name, p_brand FROM part WHERE p_name ILIKE '%ring%' OR p_brand ILIKE '%ring%' OR p_type ILIKE '%ring%'")
def keyword_search(spark: SparkSession, d: str) -> DataFrame:
    found = table(spark, d, "part").where(catalog.like_any(["p_name", "p_brand", "p_type"], "ri*ng"))
    return found.select("p_partkey", "p_name", "p_brand")


@query(
    """SELECT p_partkey, p_name, CASE WHEN lower(trim(p_name)) = 'red' THEN 0 WHEN lower(p_brand) = 'red' THEN 1 WHEN lower(trim(p_name)) LIKE 'red%' THEN 2 ELSE 3 END AS quality
FROM part WHERE p_name ILIKE '%red%' ORDER BY quality, p_size DESC NULLS LAST, p_retailprice DESC NULLS LAST, p_partkey LIMIT 20"""
)
def name_match(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select("p_partkey", "p_name", F.array("p_brand").alias("aliases"), F.col("p_size").alias("play_count"), F.col("p_retailprice").alias("rating"), F.col("p_name").alias("title"), F.col("p_partkey").alias("id"))
    return catalog.search_names(p, "red").select("p_partkey", "p_name", catalog.name_rank("title", "aliases", "red").alias("quality"))


def _parts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), "p_brand", "p_type", F.col("p_size").alias("play_count"), F.col("p_retailprice").alias("rating"),
        (F.col("p_size") % 7 + 1).alias("player_min"), (F.col("p_size") % 7 + F.col("p_partkey") % 4 + 1).alias("player_max"), F.lit("published").alias("status"),
        F.array("p_type", "p_brand").alias("themes"), F.to_date(F.lit("2020-01-01")).alias("created_at"), (F.col("p_partkey") % 30 + 1990).alias("published_year"),
    )


_PARTS = """p AS (SELECT p_partkey AS id, p_name AS title, p_brand, p_type, p_size AS play_count, p_retailprice AS rating, p_size % 7 + 1 AS player_min,
  p_size % 7 + p_partkey % 4 + 1 AS player_max, p_partkey % 30 + 1990 AS published_year FROM part),
f AS (SELECT * FROM p WHERE p_type IN ('ECONOMY', 'SMALL', 'PROMO') AND player_min <= 4 AND player_max >= 4 AND rating >= 950)"""


def _faceted(spark: SparkSession, d: str) -> DataFrame:
    return catalog.facets(_parts(spark, d), one_of={"p_type": ["ECONOMY", "SMALL", "PROMO"]}, inside={("player_min", "player_max"): 4}, at_least={"rating": 950.0})


@query(f"WITH {_PARTS} SELECT id, title, play_count, rating, (SELECT count(*) FROM f) AS total, (SELECT count(*) FROM f) > 30 AS has_more FROM f ORDER BY play_count DESC NULLS LAST, rating DESC NULLS LAST, id LIMIT 20 OFFSET 10")
def catalog_page(spark: SparkSession, d: str) -> DataFrame:
    return catalog.page_with_total(_faceted(spark, d), catalog.sorts()["hot"], 20, 10).select("id", "title", "play_count", "rating", "total", "has_more")


def _sorted(name: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        return catalog.page(_faceted(spark, d), catalog.sorts()[name], 25).select("id", "title", "rating", "published_year")

    run.__name__ = f"catalog_sort_{name}"
    return run


for _name, _order in {
    "hot": "play_count DESC NULLS LAST, rating DESC NULLS LAST, id", "rating": "rating DESC NULLS LAST, play_count DESC NULLS LAST, id", "newest": "id",
    "year": "published_year DESC NULLS LAST, play_count DESC NULLS LAST, id", "title": "title ASC NULLS LAST, id",
}.items():
    query(f"WITH {_PARTS} SELECT id, title, rating, published_year FROM f ORDER BY {_order} LIMIT 25")(_sorted(_name))


@query("WITH c AS (SELECT o_custkey, list(DISTINCT o_orderpriority) AS ps, count(*) AS n FROM orders GROUP BY o_custkey) SELECT o_custkey, n FROM c WHERE list_has_any(ps, ['1-URGENT', '2-HIGH'])")
def array_overlap(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "orders").groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias("ps"), F.count("*").alias("n"))
    return c.where(catalog.overlaps("ps", ["1-URGENT", "2-HIGH", " "])).select("o_custkey", "n")


@query("WITH c AS (SELECT o_custkey, min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders GROUP BY o_custkey) SELECT o_custkey, lo, hi FROM c WHERE lo <= 100000 AND hi >= 100000")
def interval_containment(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "orders").groupBy("o_custkey").agg(F.min("o_totalprice").alias("lo"), F.max("o_totalprice").alias("hi"))
    return c.where(catalog.within("lo", "hi", 100_000))


def _dictionary(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    region, nation = table(spark, d, "region"), table(spark, d, "nation")
    categories = region.select(F.col("r_regionkey").cast("string").alias("code"), F.col("r_name").alias("name"), (F.col("r_regionkey") < 4).alias("is_active"))
    options = nation.select(F.col("n_regionkey").cast("string").alias("category_code"), F.col("n_nationkey").cast("string").alias("code"), F.col("n_name").alias("label"), (100 - F.col("n_nationkey")).cast("int").alias("sort_order"), (F.col("n_nationkey") % 6 != 0).alias("is_active"))
    return categories, options


@query(
    """SELECT r_regionkey::VARCHAR AS code, r_name AS name, coalesce(string_agg(n_name, '|' ORDER BY 100 - n_nationkey) FILTER (WHERE n_nationkey % 6 <> 0), '') AS labels,
count(*) FILTER (WHERE n_nationkey % 6 <> 0) AS n_options FROM region LEFT JOIN nation ON n_regionkey = r_regionkey WHERE r_regionkey < 4 GROUP BY ALL"""
)
def dictionary_tree(spark: SparkSession, d: str) -> DataFrame:
    out = catalog.option_tree(*_dictionary(spark, d))
    return out.select("code", "name", F.array_join(F.transform("options", lambda o: o["label"]), "|").alias("labels"), "n_options")


@query("SELECT s_suppkey, s_name, n_name AS nation, CASE WHEN n_regionkey = 1 THEN n_name END AS label_in_one FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey")
def labelled_view(spark: SparkSession, d: str) -> DataFrame:
    _, options = _dictionary(spark, d)
    s = table(spark, d, "supplier").withColumn("code", F.col("s_nationkey").cast("string"))
    every = options.select(F.lit("x").alias("category_code"), "code", "label")
    out = catalog.label_of(catalog.label_of(s, every, "code", "x", "nation"), options, "code", "1", "label_in_one")
    return out.select("s_suppkey", "s_name", "nation", "label_in_one")


_CODES = "c AS (SELECT c_custkey AS id, [c_nationkey::VARCHAR, (c_custkey % 30)::VARCHAR] AS codes FROM customer), x AS (SELECT id, i, codes[i] AS code FROM c, unnest([1, 2]) AS t(i))"


def _coded(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    _, options = _dictionary(spark, d)
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.array(F.col("c_nationkey").cast("string"), (F.col("c_custkey") % 30).cast("string")).alias("codes"))
    return c, options.withColumn("category_code", F.lit("x"))


@query(f"WITH {_CODES} SELECT c.id, coalesce(string_agg(n_name, '|' ORDER BY 100 - n_nationkey), '') AS labels FROM c LEFT JOIN x ON x.id = c.id LEFT JOIN nation ON n_nationkey::VARCHAR = x.code GROUP BY c.id")
def array_labels(spark: SparkSession, d: str) -> DataFrame:
    c, options = _coded(spark, d)
    return catalog.labels_of(c, options, "codes", "x", "labels").select("id", F.array_join("labels", "|").alias("labels"))


@query(f"WITH {_CODES} SELECT x.id, string_agg(coalesce(n_name, x.code), '|' ORDER BY i) AS labels FROM x LEFT JOIN nation ON n_nationkey::VARCHAR = x.code GROUP BY x.id")
def array_labels_as_stored(spark: SparkSession, d: str) -> DataFrame:
    c, options = _coded(spark, d)
    return catalog.labels_of(c, options, "codes", "x", "labels", echo=True).select("id", F.array_join("labels", "|").alias("labels"))


@query(f"WITH {_CODES} SELECT id, 'codes' AS \"column\", string_agg(DISTINCT code, ', ' ORDER BY code) AS codes FROM x WHERE NOT EXISTS (SELECT 1 FROM nation WHERE n_nationkey::VARCHAR = code) GROUP BY id")
def unknown_codes(spark: SparkSession, d: str) -> DataFrame:
    c, options = _coded(spark, d)
    return catalog.unknown_codes(c, options, {"codes": "x"})


@query(
    """WITH d AS (SELECT source, count(*) AS total, count(DISTINCT text) AS kept FROM documents GROUP BY source)
SELECT source, total, total - kept AS dropped, CASE WHEN total > 0 THEN round(((total - kept)::DOUBLE / total * 100)::DECIMAL(18, 6), 1) ELSE 0 END::DOUBLE AS dedup_rate FROM d"""
)
def overview_rate(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("total"), F.countDistinct("text").alias("kept"))
    docs = docs.select(F.col("source").alias("script_id"), F.lit("").alias("script_code"), F.col("kept").alias("total_chunks"), (F.col("total") - F.col("kept")).alias("dropped_chunks"), "total")
    scripts = docs.select(F.col("script_id").alias("id"), F.col("script_id").alias("code"), F.lit("t").alias("title"))
    out = requests.overview(docs, scripts)
    return out.select(F.col("script_code").alias("source"), "total", F.col("dropped_chunks").alias("dropped"), F.col("dedup_rate").cast("double").alias("dedup_rate"))


@query(
    """WITH j AS (SELECT d.doc_id, quality, toxic FROM documents AS d LEFT JOIN labels AS l USING (doc_id))
SELECT 'quality' AS name, count(*) AS total, count(*) FILTER (WHERE quality IS NULL) AS missing FROM j UNION ALL SELECT 'toxic', count(*), count(*) FILTER (WHERE toxic IS NULL) FROM j"""
)
def null_gaps(spark: SparkSession, d: str) -> DataFrame:
    j = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left")
    return catalog.null_gaps(j, ["quality", "toxic"])


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC NULLS LAST, event_id DESC) AS n FROM events) WHERE n = 1")
def latest_per_user(spark: SparkSession, d: str) -> DataFrame:
    return upsert.latest_per_key(table(spark, d, "events"), ["user_id"], "ts", "event_id").select("user_id", "event_id", "event_type")


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY (event_type = 'purchase') DESC, ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def preferred_else_latest(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.col("user_id").alias("script_id"), F.col("event_type").alias("object_key"), F.col("ts").alias("created_at"), F.col("event_id").alias("id"))
    return requests.current_document(e, "purchase").select(F.col("script_id").alias("user_id"), F.col("id").alias("event_id"), F.col("object_key").alias("event_type"))


def _questions(spark: SparkSession, d: str) -> DataFrame:
    u = table(spark, d, "conversations").where("role = 'user'")
    return u.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("seq"), F.timestamp_seconds(F.col("conv_id") * 100 + F.col("turn")).alias("ts"), (F.col("conv_id") % 5).cast("string").alias("script_id"),
        (F.col("conv_id") % 5).cast("string").alias("script_code"), F.col("text").alias("question"), content_hash(F.col("text")).alias("question_hash"),
        (F.length("text") % 100 / F.lit(100.0) - 0.2).alias("best_similarity"), F.col("conv_id").cast("string").alias("created_by"),
    )


_QUESTIONS = f"""u AS (SELECT conv_id * 1000 + turn AS seq, (conv_id % 5)::VARCHAR AS script_code, text AS question, sha256(lower(regexp_replace(regexp_replace(text, '{DECORATION}', '', 'g'), '{SPACE}+', '', 'g'))) AS question_hash,
  length(text) % 100 / 100.0::DOUBLE - 0.2::DOUBLE AS sim, conv_id::VARCHAR AS created_by FROM conversations WHERE role = 'user'),
q AS (SELECT script_code, question_hash, count(*) AS ask_count, greatest(max(coalesce(sim, 0)), 0) AS best, arg_min(question, seq) AS question, arg_min(created_by, seq) AS created_by, min(seq) AS first_seq FROM u GROUP BY ALL)"""


@query(f"WITH {_QUESTIONS} SELECT script_code, question_hash, ask_count, round(best, 6) AS best_similarity, md5(question) AS question_md5, created_by FROM q")
def question_counters(spark: SparkSession, d: str) -> DataFrame:
    q = upsert.question_counts(_questions(spark, d))
    return q.select("script_code", "question_hash", "ask_count", F.round("best_similarity", 6).alias("best_similarity"), F.md5("question").alias("question_md5"), "created_by")


@query(
    f"""WITH {_QUESTIONS}, s AS (SELECT *, CASE WHEN ask_count > 2 THEN 'answered' ELSE 'pending' END AS status FROM q)
SELECT script_code, question_hash, status, ask_count, rank FROM (SELECT *, row_number() OVER (PARTITION BY script_code ORDER BY status, ask_count DESC, first_seq DESC, question_hash)::INT AS rank FROM s) WHERE rank <= 3"""
)
def guide_questions(spark: SparkSession, d: str) -> DataFrame:
    q = upsert.question_counts(_questions(spark, d)).withColumn("status", F.when(F.col("ask_count") > 2, "answered").otherwise("pending"))
    top = upsert.top_per_key(q, ["script_code"], [F.asc("status"), F.desc("ask_count"), F.desc("created_at"), F.asc("question_hash")], 3)
    return top.select("script_code", "question_hash", "status", "ask_count", "rank")


_STATUS = "CASE event_type WHEN 'signup' THEN 'pending' WHEN 'view' THEN 'extracting' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN NULL ELSE 'embedding' END"


def _jobs(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    t = F.col("event_type")
    status = F.when(t == "signup", "pending").when(t == "view", "extracting").when(t == "purchase", "completed").when(t == "error", F.lit(None)).otherwise("embedding")
    return e.select(F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"), "ts", status.alias("status"), F.when(t != "view", F.concat(t, F.lit(" "), F.col("event_id").cast("string"))).alias("stage_detail"), *(F.floor(F.col("value") / (k + 1)).cast("int").alias(f"d_{c}") for k, c in enumerate(upsert.COUNTERS)))


_JOBS = f"""j AS (SELECT user_id AS job_id, event_id AS seq, ts, {_STATUS} AS status, CASE WHEN event_type <> 'view' THEN event_type || ' ' || event_id END AS detail, value FROM events),
k AS (SELECT job_id, {', '.join(f'sum(floor(value / {k + 1})::INT)::BIGINT AS {c}' for k, c in enumerate(upsert.COUNTERS))}, arg_max(status, seq) FILTER (WHERE status IS NOT NULL) AS status,
  substring(arg_max(detail, seq) FILTER (WHERE detail IS NOT NULL), 1, 500) AS stage_detail, min(ts) FILTER (WHERE status IS NOT NULL AND status <> 'pending') AS started_at,
  max(ts) FILTER (WHERE status IN ('completed', 'failed', 'skipped')) AS finished_at FROM j GROUP BY job_id)"""


@query(f"WITH {_JOBS} SELECT * FROM k")
def job_progress(spark: SparkSession, d: str) -> DataFrame:
    return upsert.job_progress(_jobs(spark, d))


_IMPORT = """CASE WHEN NOT guide THEN 'no_guide' WHEN parse = 'active' THEN 'parsing' WHEN parse = 'failed' THEN 'failed' WHEN parse = 'cancelled' THEN 'pending'
WHEN parse = 'done' THEN CASE WHEN indexed THEN 'ready' ELSE 'parsed' END WHEN indexed THEN 'ready' ELSE 'pending' END"""


@query(
    f"""WITH {_JOBS}, g AS (SELECT *, job_id % 7 <> 0 AS guide, job_id % 3 = 0 AS indexed, CASE WHEN status = 'completed' THEN 'done' WHEN total_chunks > 0 AND embedded_chunks + job_id % 5 * 1000 >= total_chunks THEN 'done' ELSE 'active' END AS parse FROM k)
SELECT job_id, {_IMPORT} AS overall, CASE WHEN total_chunks > 0 THEN least(100.0, round(embedded_chunks * 100.0::DOUBLE / total_chunks, 1)) WHEN total_qa > 0 THEN least(100.0, round(embedded_qa * 100.0::DOUBLE / total_qa, 1)) ELSE 0.0 END::DOUBLE AS progress FROM g"""
)
def import_status(spark: SparkSession, d: str) -> DataFrame:
    j = upsert.job_progress(_jobs(spark, d))
    overall = formats.import_status(F.col("job_id") % 7 != 0, F.col("job_id") % 3 == 0, F.col("status"), F.col("embedded_chunks") + F.col("job_id") % 5 * 1000, F.col("total_chunks"))
    done = formats.coarse_progress((F.col("embedded_chunks"), F.col("total_chunks")), (F.col("embedded_qa"), F.col("total_qa")))
    return j.select("job_id", overall.alias("overall"), done.alias("progress"))


@query(
    """WITH c AS (SELECT c_custkey AS script_id, c_mktsegment, c_acctbal FROM customer), j AS (SELECT o_custkey, arg_max(CASE o_orderstatus WHEN 'F' THEN 'failed' ELSE 'completed' END, (o_orderdate, o_orderkey)) AS job_status, arg_max(o_orderpriority, (o_orderdate, o_orderkey)) AS error_message FROM orders GROUP BY o_custkey),
q AS (SELECT o_custkey, count(*) FILTER (WHERE l_returnflag = 'R') AS gaps FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_quantity > 45 GROUP BY o_custkey),
g AS (SELECT o_custkey, count(*) FILTER (WHERE o_totalprice > 480000) AS gaps FROM orders GROUP BY o_custkey)
SELECT c.script_id, job_status, CASE WHEN c_mktsegment = 'MACHINERY' THEN 'no guide' WHEN job_status IS NULL THEN 'no job' WHEN job_status = 'failed' THEN 'failed: ' || error_message WHEN NOT (c_acctbal > 3000) THEN 'document not active' WHEN g.gaps > 0 THEN 'chunk vectors missing' WHEN q.gaps > 0 THEN 'question vectors missing' ELSE 'ok' END AS verdict
FROM c LEFT JOIN j ON j.o_custkey = c.script_id LEFT JOIN g ON g.o_custkey = c.script_id LEFT JOIN q ON q.o_custkey = c.script_id"""
)
def health_verdict(spark: SparkSession, d: str) -> DataFrame:
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    scripts = c.select(F.col("c_custkey").alias("id"), F.when(F.col("c_mktsegment") != "MACHINERY", "k").alias("guide_key"))
    jobs = o.select(F.col("o_custkey").alias("script_id"), F.when(F.col("o_orderstatus") == "F", "failed").otherwise("completed").alias("status"), F.col("o_orderpriority").alias("error_message"), F.col("o_orderdate").alias("created_at"), F.col("o_orderkey").alias("id"))
    docs = c.select(F.col("c_custkey").alias("script_id"), (F.col("c_acctbal") > 3000).alias("is_active"), F.lit(None).cast("date").alias("deleted_at"), F.lit(0).alias("created_at"), F.col("c_custkey").alias("id"))
    chunks = o.select(F.col("o_custkey").alias("script_id"), F.when(~(F.col("o_totalprice") > 480_000), F.lit(1)).alias("embedding"))
    qa = table(spark, d, "lineitem").where("l_quantity > 45").join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    qa = qa.select(F.col("o_custkey").alias("script_id"), F.when(F.col("l_returnflag") != "R", F.lit(1)).alias("embedding"))
    return requests.health(scripts, jobs, docs, chunks, qa).select("script_id", "job_status", "verdict")


@query("SELECT event_type AS match_key, 'T' || user_id % 40 AS script_title, count(*) AS n FROM events WHERE event_type <> 'error' AND value > 5 GROUP BY ALL")
def leaderboard(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(
        F.col("event_type").alias("match_key"), F.concat(F.lit("T"), (F.col("user_id") % 40).cast("string")).alias("script_title"), F.lit(None).cast("string").alias("script_code"), F.lit(None).cast("string").alias("script_id"),
        F.when((F.col("event_type") != "error") & (F.col("value") > 5), "pending").otherwise("completed").alias("status"),
    )
    return catalog.leaderboard(e).select("match_key", "script_title", "n")


_REQ = """r AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN o_custkey END AS script_id, 'Customer#' || lpad(o_custkey::VARCHAR, 9, '0') || CASE WHEN o_orderkey % 2 = 0 THEN '.PDF' ELSE ' copy' END AS title,
  CASE o_orderstatus WHEN 'F' THEN 'pending' ELSE 'completed' END AS status FROM orders),
i AS (SELECT c_custkey AS script_id, c_name FROM customer WHERE c_acctbal > 5000)"""


def _requests(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    c = table(spark, d, "customer")
    scripts = c.select(F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("title"), F.array().cast("array<string>").alias("aliases"))
    indexed = c.where("c_acctbal > 5000").select(F.col("c_custkey").cast("string").alias("script_id"))
    return _request_rows(table(spark, d, "orders")), scripts, indexed


def _request_rows(o: DataFrame) -> DataFrame:
    title = F.concat(F.lit("Customer#"), F.lpad(F.col("o_custkey").cast("string"), 9, "0"), F.when(F.col("o_orderkey") % 2 == 0, ".PDF").otherwise(" copy"))
    r = o.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_custkey").cast("string")).alias("script_id"), title.alias("script_title"), F.when(F.col("o_orderstatus") == "F", "pending").otherwise("completed").alias("status"))
    return requests.match_key(r)


@query(f"WITH {_REQ} SELECT r.id, r.script_id::VARCHAR AS script_id FROM r JOIN i ON i.script_id = r.script_id WHERE status = 'pending'")
def complete_by_id(spark: SparkSession, d: str) -> DataFrame:
    r, _, indexed = _requests(spark, d)
    return requests.complete_by_id(r, indexed).select("id", "script_id")


@query(f"WITH {_REQ} SELECT r.id, i.script_id::VARCHAR AS script_id FROM r JOIN i ON lower(i.c_name) = regexp_replace(lower(r.title), '(\\.pdf| copy)$', '') WHERE status = 'pending' AND r.script_id IS NULL")
def complete_by_key(spark: SparkSession, d: str) -> DataFrame:
    return requests.complete_by_key(*_requests(spark, d))


@query(
    """WITH e AS (SELECT user_id, event_type AS match_key, CASE WHEN value > 8 THEN 'create' WHEN value > 2 THEN 'cancel' ELSE CASE WHEN user_id % 2 = 0 THEN 'complete' ELSE 'create' END END AS action, event_id AS seq FROM events)
SELECT user_id, match_key, CASE WHEN count(*) FILTER (WHERE action = 'complete') > 0 THEN 'completed' WHEN arg_max(action, seq) FILTER (WHERE action <> 'complete') = 'cancel' THEN 'cancelled' ELSE 'pending' END AS status, count(*) FILTER (WHERE action = 'create') AS n_created FROM e GROUP BY ALL"""
)
def request_fold(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("value")
    action = F.when(v > 8, "create").when(v > 2, "cancel").otherwise(F.when(F.col("user_id") % 2 == 0, "complete").otherwise("create"))
    e = table(spark, d, "events").select(F.col("user_id"), F.col("event_type").alias("match_key"), action.alias("action"), F.col("event_id").alias("seq"), "ts", F.col("event_type").alias("script_title"))
    return requests.fold(e).select("user_id", "match_key", "status", "n_created")


_TASKS = "t AS (SELECT o_orderkey AS task_id, 7 AS total_parts, o_totalprice, o_orderstatus, o_orderdate FROM orders), p AS (SELECT l_orderkey AS task_id, l_linenumber AS part_number, min(l_quantity) AS size, min(l_returnflag) AS etag FROM lineitem GROUP BY ALL)"


def _uploads(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    t = table(spark, d, "orders").select(F.col("o_orderkey").alias("task_id"), F.lit(7).alias("total_parts"), F.lit(100).alias("file_size"), F.when(F.col("o_orderstatus") == "F", "completed").otherwise("uploading").alias("status"), F.col("o_orderdate").alias("updated_at"), F.lit(None).cast("string").alias("error_message"))
    p = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("task_id"), F.col("l_linenumber").alias("part_number")).agg(F.min("l_quantity").alias("size"), F.min("l_returnflag").alias("etag"))
    return t, p


@query(
    f"""WITH {_TASKS}, m AS (SELECT t.task_id, k AS part_number FROM t, range(1, 8) AS r(k) WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.task_id = t.task_id AND p.part_number = k))
SELECT task_id, count(*) AS n_missing, array_to_string(list_sort(list(part_number))[1:5], ',') AS missing FROM m GROUP BY task_id"""
)
def missing_parts(spark: SparkSession, d: str) -> DataFrame:
    t, p = _uploads(spark, d)
    return uploads.missing_parts(t, p, 5).select("task_id", "n_missing", F.array_join("missing", ",").alias("missing"))


@query(
    f"""WITH {_TASKS} SELECT task_id, part_number, etag AS stored_etag, told AS told_etag FROM (SELECT *, CASE WHEN part_number % 2 = 0 THEN 'A' ELSE etag END AS told FROM p) WHERE told <> etag"""
)
def differing_parts(spark: SparkSession, d: str) -> DataFrame:
    _, p = _uploads(spark, d)
    told = p.withColumn("etag", F.concat(F.lit('"'), F.when(F.col("part_number") % 2 == 0, "A").otherwise(F.col("etag")), F.lit('"')))
    return uploads.differing_parts(told, p)


@query(
    f"""WITH {_TASKS}, h AS (SELECT task_id, sum(size) AS b, count(*) AS n FROM p GROUP BY task_id)
SELECT t.task_id, coalesce(b, 0) AS uploaded_bytes, coalesce(n, 0) AS n_parts, CASE WHEN o_orderstatus = 'F' THEN 100.0 WHEN b IS NULL THEN 0.0 ELSE least(100.0, round(b * 100.0 / 100, 2)) END::DOUBLE AS progress FROM t LEFT JOIN h USING (task_id)"""
)
def upload_progress(spark: SparkSession, d: str) -> DataFrame:
    return uploads.progress(*_uploads(spark, d)).select("task_id", "uploaded_bytes", "n_parts", "progress")


@query("SELECT DISTINCT p_type || p_size AS object_key FROM part WHERE p_size <= 3")
def orphaned_objects(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "part").select(F.concat("p_type", F.col("p_size").cast("string")).alias("object_key"), F.when(F.col("p_size") <= 3, F.lit("2020-01-01")).alias("deleted_at"))
    return uploads.orphans(f)


@query("SELECT p_type || p_size AS object_key, count(*) AS refs FROM part WHERE p_size > 3 GROUP BY ALL")
def object_references(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "part").select(F.concat("p_type", F.col("p_size").cast("string")).alias("object_key"), F.when(F.col("p_size") <= 3, F.lit("2020-01-01")).alias("deleted_at"))
    return uploads.references(f)


@query("SELECT o_orderkey AS task_id, CASE WHEN o_orderstatus <> 'F' AND o_orderdate < TIMESTAMP '1998-06-01' - INTERVAL 48 HOUR THEN 'failed' WHEN o_orderstatus = 'F' THEN 'completed' ELSE 'uploading' END AS status FROM orders")
def stale_uploads(spark: SparkSession, d: str) -> DataFrame:
    t, _ = _uploads(spark, d)
    return upsert.stale(t, F.lit("1998-06-01").cast("timestamp"), 48).select("task_id", "status")


@query("SELECT p_partkey, CASE WHEN ceil(p_retailprice * 1e7 / 100000) > 10000 THEN (ceil(p_retailprice * 1e7 / 10000 / 1048576) * 1048576)::BIGINT ELSE 100000 END AS part_size FROM part")
def part_plan(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "part").select("p_partkey", (F.col("p_retailprice") * 1e7).alias("file_size"), F.lit(100_000).alias("chunk_size"))
    return uploads.part_plan(f).select("p_partkey", "part_size")


_HOURS = "CASE WHEN {m} % 60 = 0 THEN ({m} // 60)::VARCHAR ELSE printf('%.1f', {m} / 60.0) END"
_ONE = "CASE WHEN {m} < 60 THEN {m} || '分钟' ELSE " + _HOURS + " || '小时' END"


@query(
    f"""WITH s AS (SELECT p_partkey, p_size % 8 AS lo, p_size % 8 + p_partkey % 3 AS hi, p_partkey % 4 AS m, p_partkey % 2 AS f, p_partkey % 5 AS x, p_size * 6 AS a, p_size * 6 + p_partkey % 3 * 30 AS b FROM part)
SELECT p_partkey, CASE WHEN lo = hi THEN lo || '人' ELSE lo || '-' || hi || '人' END || CASE WHEN m + f + x = 0 THEN '' ELSE '（' || CASE WHEN m > 0 THEN m || '男' ELSE '' END || CASE WHEN f > 0 THEN f || '女' ELSE '' END || CASE WHEN x > 0 THEN x || '任意' ELSE '' END || '）' END AS players,
CASE WHEN a = b THEN {_ONE.format(m='a')} WHEN a >= 60 AND b >= 60 THEN {_HOURS.format(m='a')} || '-' || {_HOURS.format(m='b')} || '小时' ELSE {_ONE.format(m='a')} || '-' || {_ONE.format(m='b')} END AS duration FROM s"""
)
def format_texts(spark: SparkSession, d: str) -> DataFrame:
    s, k = F.col("p_size"), F.col("p_partkey").cast("int")
    players = formats.players_text(s % 8, s % 8 + k % 3, k % 4, k % 2, k % 5)
    return table(spark, d, "part").select("p_partkey", players.alias("players"), formats.duration_text(s * 6, s * 6 + k % 3 * 30).alias("duration"))


@query(
    """WITH b AS (SELECT o_custkey, o_orderkey, o_totalprice, 0 AS new FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_custkey, o_orderkey, o_totalprice, 1 FROM orders WHERE o_orderstatus <> 'F')
SELECT o_custkey, arg_max(o_orderkey, (new, o_orderkey)) AS o_orderkey, arg_max(o_totalprice, (new, o_orderkey)) AS o_totalprice FROM b GROUP BY o_custkey"""
)
def keyed_upsert(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderstatus")
    return upsert.upsert(o.where("o_orderstatus = 'F'"), o.where("o_orderstatus <> 'F'"), ["o_custkey"], "o_orderkey").select("o_custkey", "o_orderkey", "o_totalprice")


@query("SELECT p_partkey, CASE p_type WHEN 'ECONOMY' THEN '规则' WHEN 'SMALL' THEN '线索' ELSE lower(p_type) END AS category FROM part")
def category_names(spark: SparkSession, d: str) -> DataFrame:
    code = F.when(F.col("p_type") == "ECONOMY", "rule").when(F.col("p_type") == "SMALL", "clue").otherwise(F.lower("p_type"))
    return table(spark, d, "part").select("p_partkey", formats.category_text(code).alias("category"))


@query(
    """WITH s AS (SELECT p_partkey AS document_id, p_size + p_partkey % 30 AS n FROM part), c AS (SELECT *, n // 20 AS f, n % 20 AS r FROM s),
k AS (SELECT *, CASE WHEN n <= 0 THEN 0 WHEN r > 0 AND r < 10 AND f > 0 THEN f ELSE f + (r > 0)::INT END AS m FROM c)
SELECT document_id, i::INT AS shard_index, (i * 20 + 1)::INT AS page_start, CASE WHEN i = m - 1 THEN n ELSE (i + 1) * 20 END::INT AS page_end FROM k, unnest(range(m)) AS t(i)"""
)
def shard_plan(spark: SparkSession, d: str) -> DataFrame:
    from lodestar.operators.layout import plan_shards

    return plan_shards(table(spark, d, "part").select(F.col("p_partkey").alias("document_id"), (F.col("p_size") + F.col("p_partkey") % 30).cast("int").alias("total_pages")))


@query("SELECT user_id, count(*) AS n, sum(value)::BIGINT AS total FROM (SELECT user_id, round(value * 100)::BIGINT AS value FROM events) GROUP BY user_id")
def stream_counters(spark: SparkSession, d: str) -> DataFrame:
    from lodestar.streaming import pipelines

    rows = pipelines.file_stream(spark, f"{d}/events.parquet*", table(spark, d, "events").schema).select("user_id", F.round(F.col("value") * 100).cast("long").alias("value"))
    return pipelines.run_once(pipelines.counter_stream(rows, "user_id", total="value"), "complete")


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_dedup(spark: SparkSession, d: str) -> DataFrame:
    from lodestar.streaming import pipelines

    rows = pipelines.file_stream(spark, f"{d}/events.parquet*", table(spark, d, "events").schema).select("user_id", "event_type", "ts")
    return pipelines.run_once(pipelines.dedup_stream(rows, ["user_id", "event_type"], late="60 days").select("user_id", "event_type"))


@query("SELECT date_trunc('day', ts)::TIMESTAMP AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_windows(spark: SparkSession, d: str) -> DataFrame:
    from lodestar.streaming import pipelines

    rows = pipelines.file_stream(spark, f"{d}/events.parquet*", table(spark, d, "events").schema).select("event_type", "ts")
    return pipelines.run_once(pipelines.windowed_counts(rows, "event_type"), "complete")


@query("SELECT o_orderkey AS task_id, 'failed' AS status, 'expired' AS error_message FROM orders WHERE o_orderstatus <> 'F' AND o_orderdate + INTERVAL 48 HOUR < (SELECT max(o_orderdate) FROM orders)")
def stream_expired_uploads(spark: SparkSession, d: str) -> DataFrame:
    """stale_uploads by sessions of updates, with the newest update as the clock."""
    from lodestar.streaming import pipelines, stateful

    orders = pipelines.file_stream(spark, f"{d}/orders.parquet*", table(spark, d, "orders").schema)
    status = F.when(F.col("o_orderstatus") == "F", "completed").otherwise("uploading")
    tasks = orders.select(F.col("o_orderkey").alias("task_id"), status.alias("status"), F.lit(None).cast("string").alias("error_message"), F.col("o_orderdate").alias("updated_at"))
    with stateful.state_store(spark, idle=True):
        return pipelines.run_once(stateful.expired(tasks, 48))


@query(ORACLES["complete_by_key"])
def stream_complete_by_key(spark: SparkSession, d: str) -> DataFrame:
    """Requests as they come against the indexed scripts of now; completions are written by the request's id."""
    from lodestar.streaming import pipelines, tables

    _, scripts, indexed = _requests(spark, d)
    orders = pipelines.file_stream(spark, f"{d}/orders.parquet*", table(spark, d, "orders").schema)
    told = requests.complete_by_key(_request_rows(orders), scripts, indexed)
    into = tables.VersionedTable(spark, tables.scratch(spark, "completed"))

    def merge(before: DataFrame | None, rows: DataFrame) -> DataFrame:
        rows = rows.withColumn("seq", F.lit(0))
        return upsert.upsert((before if before is not None else rows.drop("seq").limit(0)).withColumn("seq", F.lit(0)), rows, ["id"]).drop("seq")

    return tables.run_into(told, into, merge, tables.scratch(spark, "checkpoint"))


@query(ORACLES["job_progress"])
def stream_job_progress(spark: SparkSession, d: str) -> DataFrame:
    """Progress events in four files, two of them folded before the stream is stopped and two after it is started again."""
    from lodestar.streaming import pipelines, tables

    events = _jobs(spark, d)
    folder, checkpoint = tables.scratch(spark, "events"), tables.scratch(spark, "checkpoint")
    into = tables.VersionedTable(spark, tables.scratch(spark, "jobs"))
    for half in (0, 1):
        events.where(F.col("seq") % 2 == half).repartition(2, "seq").write.mode("append").parquet(folder)
        stream = pipelines.file_stream(spark, folder, events.schema, max_files=1)
        states = tables.run_into(stream, into, lambda before, rows: upsert.merged_states(before, upsert.job_states(rows)), checkpoint)
    return upsert.progress_of(states)
