"""Queries over `documents`, `pages` and `conversations`: hashes, near duplicates, layout, titles, chunks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType

from lodestar.functions import fingerprint, text
from lodestar.operators import catalog, chunking, dedup, ingest, layout, retrieval, titles
from lodestar.sources import documents as sources

from . import chunk_sql
from .registry import query, table


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _normal(column: str) -> str:
    """Normal form in SQL.  DuckDB has no NFKC: the queries apply it, and no text of these tables is changed by it."""
    return f"lower(regexp_replace(regexp_replace({column}, {_quoted(text.DECORATION)}, '', 'g'), {_quoted(text.SPACE + '+')}, '', 'g'))"


def _strip(column: str) -> str:
    return f"regexp_replace({column}, {_quoted(f'^{text.SPACE}+|{text.SPACE}+$')}, '', 'g')"


def _heading_like(c: str) -> str:
    return f"({c} <> '' AND length({c}) <= 40 AND regexp_matches({c}, {_quoted('|'.join(f'(?:{p})' for p in text.HEADINGS))}))"


def _ended(c: str) -> str:
    return f"regexp_matches({c}, {_quoted(text.SENTENCE_END)})"


@query(f"WITH h AS (SELECT doc_id, sha256({_normal('text')}) AS content_hash FROM documents) SELECT doc_id, content_hash, min(doc_id) OVER (PARTITION BY content_hash) AS kept_id FROM h")
def exact_dedup(spark: SparkSession, d: str) -> DataFrame:
    return dedup.exact(table(spark, d, "documents")).select("doc_id", "content_hash", "kept_id")


_SIMHASH = f"""n AS (SELECT doc_id, {_normal('text')} AS t FROM documents),
r AS (SELECT doc_id, t, regexp_replace(t, '[a-z0-9]+', '', 'g') AS rest FROM n),
f AS (
  SELECT doc_id, unnest(list_filter(regexp_split_to_array(t, '[^a-z0-9]+'), lambda x: length(x) >= 2)) AS feature FROM r
  UNION ALL SELECT doc_id, substring(rest, i::INT, 3) FROM r, unnest(range(1, length(rest) - 1)) AS g(i) WHERE length(rest) >= 3
  UNION ALL SELECT doc_id, rest FROM r WHERE length(rest) BETWEEN 1 AND 2),
h AS (SELECT doc_id, concat('0x', substring(md5(feature), 1, 16))::UBIGINT AS h FROM f),
b AS (SELECT doc_id, count(*) AS n_features, {', '.join(f'sum(CASE WHEN (h >> {i}) & 1 = 1 THEN 1 ELSE -1 END) > 0 AS b{i}' for i in range(64))} FROM h GROUP BY doc_id),
u AS (SELECT doc_id, n_features, {' + '.join(f'(b{i}::INT::HUGEINT << {i})' for i in range(64))} AS u FROM b),
v AS (SELECT n.doc_id, coalesce(n_features, 0) AS n_features, coalesce(CASE WHEN u >= 9223372036854775808 THEN u - 18446744073709551616 ELSE u END, 0)::BIGINT AS simhash FROM n LEFT JOIN u USING (doc_id))"""


@query(f"WITH {_SIMHASH} SELECT doc_id, simhash, n_features FROM v")
def simhash_md5(spark: SparkSession, d: str) -> DataFrame:
    return fingerprint.simhash_md5(table(spark, d, "documents"))


@query(
    f"""WITH {_SIMHASH}, p AS (SELECT simhash AS s FROM v WHERE doc_id = 1)
SELECT doc_id, bit_count(xor(simhash, s))::INT AS distance FROM v, p WHERE bit_count(xor(simhash, s)) <= 24 ORDER BY distance, doc_id LIMIT 10"""
)
def simhash_scan(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    probe = fingerprint.simhash_md5(docs.where("doc_id = 1")).first()
    if probe is None:
        docs = docs.limit(0)
    probe = probe["simhash"] if probe else 0
    return retrieval.hamming_scan(fingerprint.simhash_md5(docs), probe, 24, 10, "doc_id").select("doc_id", "distance")


@query(
    f"""WITH {_SIMHASH}, e AS (SELECT simhash, min(doc_id) AS rep FROM v WHERE simhash <> 0 GROUP BY simhash),
g AS (SELECT simhash, rep, i, ((CASE WHEN simhash < 0 THEN simhash::HUGEINT + 18446744073709551616 ELSE simhash::HUGEINT END) >> (16 * i)::INT) & 65535 AS w FROM e, range(4) AS t(i))
SELECT DISTINCT least(x.rep, y.rep) AS a, greatest(x.rep, y.rep) AS b, bit_count(xor(x.simhash, y.simhash))::INT AS distance
FROM g AS x JOIN g AS y ON x.i = y.i AND x.w = y.w AND x.simhash < y.simhash WHERE bit_count(xor(x.simhash, y.simhash)) <= 6"""
)
def simhash_pairs(spark: SparkSession, d: str) -> DataFrame:
    return dedup.band_pairs(fingerprint.simhash_md5(table(spark, d, "documents")), 6)


_GREEDY = f"""WITH RECURSIVE {_SIMHASH},
it AS MATERIALIZED (SELECT source AS document_id, doc_id AS ord, length(coalesce(t, '')) AS n, sha256(coalesce(t, '')) AS h, simhash AS s, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i
  FROM documents JOIN n USING (doc_id) JOIN v USING (doc_id)),
st AS (
  SELECT DISTINCT document_id, 0::BIGINT AS i, NULL::BIGINT AS ord, ''::VARCHAR AS verdict, []::VARCHAR[] AS hs, []::BIGINT[] AS ss FROM it
  UNION ALL
  SELECT document_id, i, ord, verdict, CASE WHEN verdict = 'kept' THEN list_append(hs, h) ELSE hs END, CASE WHEN verdict = 'kept' AND s <> 0 THEN list_append(ss, s) ELSE ss END
  FROM (SELECT it.*, hs, ss, CASE WHEN n < 150 THEN 'short' WHEN list_contains(hs, h) THEN 'exact'
      WHEN s <> 0 AND len(list_filter(ss, lambda x: bit_count(xor(x, s)) <= 3)) > 0 THEN 'near' ELSE 'kept' END AS verdict
    FROM st JOIN it ON it.document_id = st.document_id AND it.i = st.i + 1))"""


def _by_source(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("source").alias("document_id"), F.col("doc_id").alias("ord"), "text")


@query(
    f"""{_GREEDY} SELECT document_id, count(*) AS total, {', '.join(f"count(*) FILTER (WHERE verdict = '{x}') AS {x}" for x in ('kept', 'exact', 'near', 'short'))},
round(count(*) FILTER (WHERE verdict <> 'kept') / count(*), 4) AS dedup_rate FROM st WHERE i > 0 GROUP BY document_id"""
)
def greedy_dedup_stats(spark: SparkSession, d: str) -> DataFrame:
    return dedup.stats(dedup.greedy(_by_source(table(spark, d, "documents")), md5=True))


@query(f"{_GREEDY} SELECT document_id AS within, ord, verdict FROM st WHERE i > 0")
def stream_near_duplicates(spark: SparkSession, d: str) -> DataFrame:
    """The verdicts of greedy_dedup_stats over a stream, with hashes and fingerprints in state that expires."""
    from lodestar.streaming import pipelines, stateful

    docs = pipelines.file_stream(spark, f"{d}/documents.parquet*", table(spark, d, "documents").schema)
    with stateful.state_store(spark, idle=False):
        return pipelines.run_once(stateful.near_duplicates(_by_source(docs), md5=True))


@query(f"SELECT doc_id, len(s) AS n_sentences, max_len AS longest FROM (SELECT doc_id, s, coalesce(list_max(list_transform(s, lambda x: length(x))), 0) AS max_len FROM (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, {_quoted(f'([{text.SENTENCE_MARKS}])')}, '\\1' || chr(30), 'g'), chr(30)), lambda x: {_strip('x')}), lambda x: x <> '') AS s FROM documents))")
def sentence_counts(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "documents").select("doc_id", text.sentences(F.col("text")).alias("s"))
    return s.select("doc_id", F.size("s").cast("long").alias("n_sentences"), F.coalesce(F.array_max(F.transform("s", F.length)), F.lit(0)).cast("long").alias("longest"))


def _lines(spark: SparkSession, d: str) -> DataFrame:
    """Documents' lines as blocks: ten lines make a page, lines that begin with a short word are headings."""
    docs = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("ord", "text"))
    n = F.length("text")
    level = F.when(n == 0, 0).when(n <= 12, 1).when(n <= 24, 2).when(n <= 40, 3).otherwise(0)
    return docs.select(
        F.col("doc_id").alias("document_id"), "ord", "text", (F.floor(F.col("ord") / 10) + 1).cast("int").alias("page"),
        F.when(level > 0, "heading").otherwise("body").alias("block_type"), level.alias("heading_level"),
        (F.lit(10.0) + n % 7).alias("font_size"), (n % 5 == 0).alias("is_bold"), ((F.col("ord") % 10) / F.lit(10.0)).alias("y_ratio"),
    )


_LINES = """l AS (
  SELECT doc_id AS document_id, i - 1 AS ord, ls[i] AS text, ((i - 1) // 10 + 1)::INT AS page, length(ls[i]) AS n
  FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), unnest(range(1, len(ls) + 1)) AS t(i)),
k AS (SELECT document_id, ord, text, page, n, CASE WHEN n = 0 THEN 0 WHEN n <= 12 THEN 1 WHEN n <= 24 THEN 2 WHEN n <= 40 THEN 3 ELSE 0 END AS level,
             10.0::DOUBLE + n % 7 AS font_size, n % 5 = 0 AS is_bold, (ord % 10) / 10.0::DOUBLE AS y_ratio FROM l)"""


@query(
    f"""WITH {_LINES}, p AS (
  SELECT *, {', '.join(f'coalesce(max(CASE WHEN level = {n} THEN ord END) OVER w, -1) AS p{n}' for n in (1, 2, 3))}
  FROM k WINDOW w AS (PARTITION BY document_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT p.document_id, p.ord::INT AS ord, concat_ws(' > ', a.text, b.text, c.text) AS path
FROM p LEFT JOIN k AS a ON a.document_id = p.document_id AND a.ord = p1
LEFT JOIN k AS b ON b.document_id = p.document_id AND b.ord = p2 AND p2 > p1
LEFT JOIN k AS c ON c.document_id = p.document_id AND c.ord = p3 AND p3 > greatest(p1, p2)"""
)
def section_paths(spark: SparkSession, d: str) -> DataFrame:
    return layout.section_paths(_lines(spark, d)).select("document_id", "ord", F.array_join("section_path", " > ").alias("path"))


_HEADING = "|".join(f"(?:{p})" for p in text.HEADINGS)
_CLASS = f"""m AS (SELECT *, median(font_size) OVER (PARTITION BY document_id) AS body, {_strip('text')} AS t FROM k),
c AS (SELECT *, font_size / body AS ratio, length(t) <= 40 AS short, length(t) BETWEEN 1 AND 40 AND regexp_matches(t, {_quoted(_HEADING)}) AS numbered, regexp_matches(t, {_quoted(text.LIST_ITEM)}) AS item FROM m),
g AS (SELECT document_id, ord, t <> '' AND item AS item, CASE
  WHEN t = '' OR item THEN 0 WHEN ratio < 0.92 THEN 0 WHEN short AND ratio >= 1.6 THEN 1 WHEN short AND ratio >= 1.35 THEN 2 WHEN short AND ratio >= 1.15 THEN 3
  WHEN numbered AND short AND (is_bold OR ratio >= 1.05) THEN 4 WHEN numbered AND length(t) <= 24 THEN 5
  WHEN is_bold AND short AND ratio >= 1.0 AND NOT regexp_matches(t, {_quoted(text.SENTENCE_END)}) THEN 6 ELSE 0 END AS level FROM c)"""


@query(
    f"""WITH {_LINES}, {_CLASS}, u AS (SELECT document_id, level, row_number() OVER (PARTITION BY document_id ORDER BY level) AS r FROM (SELECT DISTINCT document_id, level FROM g WHERE level > 0))
SELECT g.document_id, g.ord::INT AS ord, CASE WHEN item THEN 'list' WHEN g.level > 0 THEN 'heading' ELSE 'body' END AS block_type, coalesce(r, 0)::INT AS heading_level
FROM g LEFT JOIN u USING (document_id, level)"""
)
def calibrated_headings(spark: SparkSession, d: str) -> DataFrame:
    return layout.calibrate(_lines(spark, d)).select("document_id", "ord", "block_type", "heading_level")


_KEY = f"lower(regexp_replace(regexp_replace(text, {_quoted(text.SPACE + '+')}, '', 'g'), '[0-9]+', '#', 'g'))"
_EDGES = f"""m AS (SELECT *, median(font_size) OVER (PARTITION BY document_id) AS body, CASE WHEN y_ratio <= 0.12 THEN 'top' WHEN y_ratio >= 0.88 THEN 'bottom' END AS side FROM k),
s AS (SELECT *, min(y_ratio) OVER w AS lo, max(y_ratio) OVER w AS hi FROM m
      WHERE side IS NOT NULL AND font_size <= 1.15 * body AND {_strip('text')} <> '' WINDOW w AS (PARTITION BY document_id, page, side)),
e AS (SELECT *, {_KEY} AS key FROM s WHERE CASE WHEN side = 'top' THEN y_ratio <= lo + 0.03 ELSE y_ratio >= hi - 0.03 END),
x AS (SELECT * FROM e WHERE key <> '' AND length(key) <= 120),
y AS (SELECT document_id, key, count(DISTINCT page) AS pages, (max(page) - min(page) + 1)::INT AS span FROM x GROUP BY ALL),
z AS (SELECT y.*, pages / span AS density FROM y JOIN (SELECT document_id, count(DISTINCT page) AS n FROM k GROUP BY ALL) USING (document_id)
      WHERE pages >= greatest(2, floor(0.6 * n)) OR (pages >= greatest(3, floor(0.05 * n)) AND pages / span >= 0.45))"""


@query(f"WITH {_LINES}, {_EDGES} SELECT document_id, key, pages, span, round(density, 6) AS density FROM z")
def header_footer_templates(spark: SparkSession, d: str) -> DataFrame:
    return layout.templates(_lines(spark, d)).select("document_id", "key", "pages", "span", F.round("density", 6).alias("density"))


@query(
    f"""WITH {_LINES}, {_EDGES}, q AS (SELECT document_id, ord, {_strip('text')} AS t FROM k)
SELECT document_id, ord::INT AS ord FROM q
WHERE NOT (t = '' OR regexp_matches(t, {_quoted(text.PAGE_NUMBER)}) OR length(regexp_replace(t, '[^\\p{{L}}\\p{{N}}]+', '', 'g')) <= 1)
  AND NOT EXISTS (SELECT 1 FROM x JOIN z USING (document_id, key) WHERE x.document_id = q.document_id AND x.ord = q.ord)"""
)
def noise_stripped(spark: SparkSession, d: str) -> DataFrame:
    return layout.strip_noise(_lines(spark, d)).select("document_id", "ord")


def _titles(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("length(text) > 0")
    path = F.when(F.col("doc_id") % 7 == 0, F.array().cast("array<string>")).otherwise(F.array_compact(F.array(F.col("lang"), F.when(F.col("doc_id") % 3 > 0, F.col("source")), F.when(F.col("doc_id") % 3 > 1, F.concat(F.lit(" part "), (F.col("doc_id") % 5).cast("string"))))))
    return docs.select(F.lit("all").alias("script_code"), F.col("doc_id").alias("pos"), path.alias("section_path"))


_TREE = """o AS (SELECT doc_id AS pos, CASE WHEN doc_id % 7 = 0 THEN ['untitled'] WHEN doc_id % 3 = 0 THEN [lang] WHEN doc_id % 3 = 1 THEN [lang, source] ELSE [lang, source, 'part ' || (doc_id % 5)] END AS own FROM documents WHERE length(text) > 0),
t AS (SELECT pos, i AS depth, own[1:i] AS path, i = len(own) AS leaf FROM o, unnest(range(1, len(own) + 1)) AS g(i)),
n AS (SELECT array_to_string(path, ' > ') AS path, path[-1] AS title, depth::INT AS depth, min(pos) AS first_pos, sum(leaf::INT)::BIGINT AS qa_count FROM t GROUP BY path, depth)"""


@query(f"WITH {_TREE} SELECT path, title, depth, first_pos, qa_count FROM n")
def title_tree(spark: SparkSession, d: str) -> DataFrame:
    n = titles.tree_nodes(_titles(spark, d))
    return n.select(F.array_join("path", " > ").alias("path"), "title", "depth", "first_pos", "qa_count")


@query(f"WITH {_TREE} SELECT 'all' AS script_code, count(*) FILTER (WHERE qa_count > 0) AS n_titles, sum(qa_count)::BIGINT AS n_qa, count(*) FILTER (WHERE depth = 1) AS n_roots FROM n")
def title_tree_totals(spark: SparkSession, d: str) -> DataFrame:
    return titles.tree_totals(titles.tree_nodes(_titles(spark, d)))


@query("SELECT lang, count(*) AS total, count(*) FILTER (WHERE doc_id % 7 = 0) AS empty FROM documents WHERE length(text) > 0 GROUP BY lang")
def empty_path_share(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").where("length(text) > 0").withColumn("section_path", F.when(F.col("doc_id") % 7 == 0, F.array().cast("array<string>")).otherwise(F.array("lang")))
    return titles.empty_path_share(rows, "lang")


_TITLE = f"regexp_replace(lower({_strip('url')}), {_quoted(text.TITLE_EXTENSION)}, '')"
for _ in range(3):
    _TITLE = _strip(f"regexp_replace(regexp_replace({_TITLE}, {_quoted(text.TITLE_NUMBER)}, ''), {_quoted(text.TITLE_COPY)}, '')")


@query(f"SELECT page_id, {_TITLE} AS key FROM (SELECT page_id, url || CASE page_id % 4 WHEN 0 THEN '.pdf' WHEN 1 THEN ' copy' WHEN 2 THEN '（1）' ELSE ' copy (2)' END AS url FROM pages)")
def title_keys(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("page_id") % 4
    name = F.concat("url", F.when(k == 0, ".pdf").when(k == 1, " copy").when(k == 2, "（1）").otherwise(" copy (2)"))
    return table(spark, d, "pages").select("page_id", text.title_key(name).alias("key"))


@query(
    f"""WITH RECURSIVE {_LINES}, b AS (SELECT document_id AS doc, ord, text, page, '' AS path, CASE WHEN level > 0 THEN 'heading' ELSE 'body' END AS kind, level FROM k), {chunk_sql.chunks("b", chunking.Limits())}
SELECT doc AS document_id, chunk_index::INT AS chunk_index, page_start::INT AS page_start, page_end::INT AS page_end, how AS split_strategy, length(text)::INT AS char_count, md5(text) AS text_md5 FROM chunks"""
)
def chunked_documents(spark: SparkSession, d: str) -> DataFrame:
    return chunking.chunk_blocks(layout.section_paths(_lines(spark, d))).select("document_id", "chunk_index", "page_start", "page_end", "split_strategy", "char_count", F.md5("text").alias("text_md5"))


@query(f"WITH RECURSIVE d AS (SELECT doc_id AS id, coalesce(text, '') AS text FROM documents), {chunk_sql.parts('d', 800, 120)} SELECT id AS doc_id, part::INT AS part, length(text)::INT AS n_chars, md5(text) AS text_md5 FROM parts")
def recursive_parts(spark: SparkSession, d: str) -> DataFrame:
    return chunking.split_texts(table(spark, d, "documents")).select("doc_id", "part", F.length("text").alias("n_chars"), F.md5("text").alias("text_md5"))


@query(
    """WITH s AS (SELECT lang, list_sort(list(length(text))) AS v, count(*) AS n, count(*) FILTER (WHERE length(text) < 150) AS short FROM documents GROUP BY lang)
SELECT lang, n, v[n // 2 + 1] AS p50, v[floor(n * 0.9)::BIGINT + 1] AS p90, short * 100 // n AS short_percent FROM s"""
)
def length_distribution(spark: SparkSession, d: str) -> DataFrame:
    return catalog.length_profile(table(spark, d, "documents").withColumn("v", F.length("text")), "lang", "v")


@query("SELECT doc_id, source, sha256(text) AS question_hash, '【' || lang || ' > ' || source || '】' || chr(10) || substring(text, 1, 480) AS embed_text FROM (SELECT doc_id, source, lang, " + _strip("text") + " AS text FROM documents)")
def embedding_texts(spark: SparkSession, d: str) -> DataFrame:
    from lodestar.functions.formats import breadcrumb

    own = text.strip(F.col("text"))
    return table(spark, d, "documents").select("doc_id", "source", text.question_hash(F.col("text")).alias("question_hash"), breadcrumb(F.array("lang", "source"), F.substring(own, 1, 480)).alias("embed_text"))


@query(
    """WITH j AS (SELECT event_id, props, user_id FROM events), p AS (SELECT event_id, try_cast(json_extract_string(props, '$.k') AS INT) AS k FROM j)
SELECT event_id, least(greatest(coalesce(k, 0), 0), 50)::INT AS source_index FROM p"""
)
def payload_index(spark: SparkSession, d: str) -> DataFrame:
    k = F.from_json("props", "k string")["k"].try_cast("int")
    return table(spark, d, "events").select("event_id", F.least(F.greatest(F.coalesce(k, F.lit(0)), F.lit(0)), F.lit(50)).alias("source_index"))


_ANSWER = f"""a AS (SELECT conv_id, turn, {_strip("string_split(" + _strip('text') + ", chr(10))[1]")} AS question, {_strip('text')} AS answer FROM conversations WHERE role = 'assistant')"""


@query(f"WITH {_ANSWER} SELECT conv_id, turn, question, answer, 'rule' AS category, greatest(least(turn, 4), 0)::INT AS source_index FROM a WHERE length(question) >= 4 AND length(answer) >= 2")
def answer_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Turns of `conversations` as a model's answers: fenced, wrapped or bare JSON by turn."""
    rows = table(spark, d, "conversations").where("role = 'assistant'")
    item = F.to_json(F.array(F.struct(F.substring_index(text.strip(F.col("text")), "\n", 1).alias("question"), F.col("text").alias("answer"), F.lit(" Rule ").alias("category"), F.col("turn").alias("index"))))
    k = F.col("conv_id") % 3
    content = F.when(k == 0, F.concat(F.lit("```json\n"), item, F.lit("\n```"))).when(k == 1, F.concat(F.lit('{"data": '), item, F.lit("}"))).otherwise(F.concat(F.lit("Here: "), item, F.lit(" done")))
    return sources.pairs_of(rows.select("conv_id", "turn", content.alias("content"), F.lit(4).alias("last_index")))


def letter_vectors(texts: list[str]) -> list[list[float]]:
    """A model's stand-in: counts of letters, the same for the same text."""
    return [[float(t.count(c)) for c in "aeiourstnd"] + [1.0] for t in texts]


_COUNTS = ", ".join(f"(length(win) - length(replace(win, '{c}', '')))::DOUBLE" for c in "aeiourstnd")
_SENTENCES = f"list_filter(list_transform(string_split(regexp_replace(coalesce(text, ''), {_quoted(f'([{text.SENTENCE_MARKS}])')}, '\\1' || chr(30), 'g'), chr(30)), lambda x: {_strip('x')}), lambda x: x <> '')"


@query(
    f"""WITH RECURSIVE se AS (SELECT doc_id, i AS pos, s[i] AS sentence, len(s) AS n FROM (SELECT doc_id, {_SENTENCES} AS s FROM documents), unnest(range(1, len(s) + 1)) AS t(i)),
wi AS (SELECT *, coalesce(lag(sentence) OVER w, '') || sentence || coalesce(lead(sentence) OVER w, '') AS win FROM se WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
ve AS (SELECT doc_id, pos, sentence, n, [{_COUNTS}, 1.0::DOUBLE] AS v FROM wi),
di AS (SELECT *, lead(v) OVER (PARTITION BY doc_id ORDER BY pos) AS nx FROM ve),
dd AS (SELECT *, CASE WHEN nx IS NOT NULL THEN 1 - list_dot_product(v, nx) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(nx, nx))) END AS distance FROM di WHERE n >= 4),
le AS (SELECT doc_id, list_sort(list(distance) FILTER (WHERE distance IS NOT NULL)) AS ds, (count(distance) - 1) * 0.88::DOUBLE AS p FROM dd GROUP BY doc_id),
lv AS (SELECT doc_id, CASE WHEN ds[floor(p)::INT + 1] = ds[ceil(p)::INT + 1] THEN ds[floor(p)::INT + 1] ELSE (ceil(p) - p) * ds[floor(p)::INT + 1] + (p - floor(p)) * ds[ceil(p)::INT + 1] END AS level FROM le),
sg AS (SELECT doc_id, pos, sentence, coalesce(sum(coalesce(distance > level, false)::INT) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS segment FROM dd JOIN lv USING (doc_id)),
pc AS MATERIALIZED (SELECT doc_id, segment, string_agg(sentence, '' ORDER BY pos) AS text FROM sg GROUP BY ALL),
lo AS (SELECT doc_id || ':' || segment AS id, text FROM pc WHERE length(text) > 3000),
sh AS (SELECT doc_id AS id, coalesce(text, '') AS text FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM se WHERE n >= 4)),
{chunk_sql.parts("lo", 800, 120, "lp")},
{chunk_sql.parts("sh", 800, 120, "sp")},
al AS (SELECT doc_id, segment, coalesce(part, 0) AS part, coalesce(lp.text, pc.text) AS text, 'semantic' AS strategy FROM pc LEFT JOIN lp ON lp.id = doc_id || ':' || segment UNION ALL SELECT id, 0, part, text, 'recursive' FROM sp)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY segment, part) - 1)::INT AS part, strategy, length(text)::INT AS n_chars, md5(text) AS text_md5 FROM al"""
)
def semantic_pieces(spark: SparkSession, d: str) -> DataFrame:
    return chunking.semantic_pieces(table(spark, d, "documents"), letter_vectors).select("doc_id", "part", "strategy", F.length("text").alias("n_chars"), F.md5("text").alias("text_md5"))


@query(
    f"""WITH RECURSIVE {_LINES}, b AS (SELECT document_id, page AS shard, page, text, CASE WHEN level > 0 THEN 'heading' ELSE 'body' END AS kind, row_number() OVER (PARTITION BY document_id ORDER BY page, ord) AS n FROM k),
f AS MATERIALIZED (SELECT *, coalesce(lag(shard) OVER w <> shard AND lag(kind) OVER w = 'body' AND kind = 'body' AND NOT {_ended('lag(text) OVER w')}, false) AS flows FROM b WINDOW w AS (PARTITION BY document_id ORDER BY n)),
r AS (SELECT document_id, n, page, 0 AS ord FROM f WHERE n = 1 UNION ALL
  SELECT f.document_id, f.n, CASE WHEN flows AND f.page - r.page <= 1 THEN r.page ELSE f.page END, r.ord + CASE WHEN flows AND f.page - r.page <= 1 THEN 0 ELSE 1 END FROM r JOIN f ON f.document_id = r.document_id AND f.n = r.n + 1)
SELECT r.document_id, r.ord::INT AS ord, min(r.page) AS page, md5(string_agg(f.text, '' ORDER BY r.n)) AS text_md5 FROM r JOIN f USING (document_id, n) GROUP BY r.document_id, r.ord"""
)
def stitched_shards(spark: SparkSession, d: str) -> DataFrame:
    """Pages of ten lines as shards."""
    return layout.stitch(_lines(spark, d).withColumn("shard_index", F.col("page"))).select("document_id", "ord", "page", F.md5("text").alias("text_md5"))


_SPANS = ArrayType(StructType([StructField("text", StringType()), StructField("size", DoubleType()), StructField("flags", IntegerType())]))


@F.arrow_udf(_SPANS)
def _word_spans(lines: pa.Array) -> pa.Array:
    """Words of lines, each with its blank, in sizes and weights by length; Spark hands them on within one Python step."""
    words = pc.split_pattern(lines, " ")
    flat = words.flatten()
    n = pc.utf8_length(flat).to_numpy(zero_copy_only=False).astype(np.int32)
    fields = [pc.binary_join_element_wise(flat, "", " "), pa.array(n % 4 + 9.0), pa.array(n % 3 * 8, pa.int32())]
    first = np.append(0, np.cumsum(pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False)))
    spans = pa.StructArray.from_arrays(fields, ["text", "size", "flags"])
    return pa.ListArray.from_arrays(pa.array(first, pa.int32(), mask=np.append(words.is_null().to_numpy(zero_copy_only=False), False)), spans)


@query(
    f"""WITH {_LINES}, w AS (
  SELECT document_id, page, ord // 5 AS block_no, ord, {_strip("text || ' '")} AS t, list_filter(string_split(text, ' '), lambda x: {_strip('x')} <> '') AS ws FROM k),
m AS (SELECT document_id, page, block_no, ord, t, flatten(list_transform(ws, lambda x: list_transform(range(length(x) + 1), lambda i: (length(x) % 4 + 9)::DOUBLE))) AS sizes,
             coalesce(list_sum(list_transform(ws, lambda x: CASE WHEN length(x) % 3 = 2 THEN length(x) + 1 ELSE 0 END)), 0) AS bold FROM w WHERE t <> ''),
n AS (SELECT *, list_aggregate(sizes, 'median') AS size FROM m),
o AS (SELECT *, lag(t) OVER b AS before, lag(size) OVER b AS last FROM n WINDOW b AS (PARTITION BY document_id, page, block_no ORDER BY ord)),
q AS (SELECT *, before IS NULL OR size / last >= 1.15 OR size / last <= 1 / 1.15::DOUBLE OR ({_heading_like('t')} AND {_ended('before')}) AS begins FROM o),
r AS (SELECT *, sum(begins::INT) OVER (PARTITION BY document_id, page, block_no ORDER BY ord) - 1 AS part,
        CASE WHEN begins THEN '' WHEN {_ended('before')} AND {_heading_like('t')} THEN chr(10) WHEN regexp_matches(before, {_quoted(layout.UNFINISHED)}) THEN ''
             WHEN regexp_matches(before, '[A-Za-z0-9]$') AND regexp_matches(t, '^[A-Za-z0-9]') THEN ' ' ELSE '' END AS link FROM q)
SELECT document_id, page, block_no::INT AS block_no, part::INT AS part, md5(string_agg(link || t, '' ORDER BY ord)) AS text_md5,
       list_aggregate(flatten(list(sizes)), 'median') AS font_size, sum(bold) / sum(len(sizes)) >= 0.6 AS is_bold FROM r GROUP BY ALL"""
)
def page_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    """Lines of documents as lines of a page's blocks, each word a span."""
    lines = _lines(spark, d).select("document_id", "page", F.floor(F.col("ord") / 5).cast("int").alias("block_no"), F.col("ord").alias("line_no"), _word_spans("text").alias("spans"))
    return layout.paragraphs(lines).select("document_id", "page", "block_no", "part", F.md5("text").alias("text_md5"), "font_size", "is_bold")


@query()
def ingested_documents(spark: SparkSession, d: str) -> DataFrame:
    """From shards of lines to kept passages: counts of each document."""
    shards = _lines(spark, d).withColumn("shard_index", F.floor(F.col("page") / 2).cast("int")).withColumn("document_id", F.col("document_id").cast("string"))
    return ingest.passages(shards)[1]
