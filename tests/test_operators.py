"""Core operators on small tables: the cases whose results are fixed."""

import datetime
import hashlib
import io
import itertools
import math
import re
import time
import zipfile

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.functions import fingerprint, formats, text
from lodestar.operators import catalog, chunking, dedup, layout, requests, retrieval, slugs, titles, uploads, upsert
from lodestar.plans import chunk_sql
from lodestar.sources import documents
from lodestar.streaming import pipelines, stateful, tables


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("raw", "key"), [("Book.pdf", "book"), ("Book 副本", "book"), ("Book（1）", "book"), ("Book 副本（1）", "book"), ("  Book ", "book"), ("Book.DOCX", "book"), ("Book2", "book2"), ("Book 第二部", "book 第二部"), ("Book：终章", "book：终章")])
def test_title_key(spark, raw, key):
    assert one(spark, text.title_key(F.col("t")), t=raw) == key


@pytest.mark.parametrize(("raw", "noise"), [("12", True), ("- 12 -", True), ("第 12 页", True), ("12 / 400", True), ("。", True), ("a", True), ("Some words", False), ("", True)])
def test_noise(spark, raw, noise):
    assert one(spark, text.is_noise(F.col("t")), t=raw) is noise


def test_normal_forms(spark):
    assert one(spark, text.normal_nfkc(F.col("t")), t="• Ａ１ ★ b\tC—") == "a1bc"
    assert one(spark, text.sentences(F.col("t")), t="一。二！ three? four") == ["一。", "二！", "three?", "four"]
    assert one(spark, text.tail_overlap(F.col("t"), 6), t="abc。defgh") == "defgh" == chunking.tail("abc。defgh", 6)
    assert one(spark, text.slug(F.col("t")), t="Hello, World!  x") == "hello-world-x"
    assert text.keyword('a*(b)"c') == "abc"


def test_formats(spark):
    assert one(spark, formats.players_text(*(F.lit(x) for x in (4, 6, 2, 2, 0)))) == "4-6人（2男2女）"
    assert one(spark, formats.duration_text(F.lit(180), F.lit(240))) == "3-4小时"
    assert one(spark, formats.duration_text(F.lit(45), F.lit(90))) == "45分钟-1.5小时"


@pytest.mark.parametrize(
    ("guide", "indexed", "job", "done", "total", "want"),
    [(True, False, "completed", 0, 0, "parsed"), (True, True, "completed", 0, 10, "ready"), (True, False, "skipped", 0, 0, "parsed"), (True, False, "embedding", 5, 10, "parsing"), (False, False, None, 0, 0, "no_guide"), (True, False, "failed", 0, 0, "failed"), (True, False, "cancelled", 0, 0, "pending"), (True, True, "embedding", 10, 10, "ready"), (True, True, "embedding", 12, 10, "ready"), (True, False, "embedding", 10, 10, "parsed"), (True, True, "embedding", 9, 10, "parsing")],
)
def test_import_status(spark, guide, indexed, job, done, total, want):
    assert one(spark, formats.import_status(F.lit(guide), F.lit(indexed), F.lit(job).cast("string"), F.lit(done), F.lit(total))) == want


def test_guide_shapes(spark):
    rows = spark.createDataFrame([('{"dmGuide": {"objectKey": "a"}}',), ('{"dmGuide": "b"}',), ('{"dmGuide": null}',), ("{}",), ('{"dm_guide": {"objectKey": "c"}}',), (None,)], "extra string")
    got = [(r["h"], r["k"]) for r in rows.select(formats.has_guide(F.col("extra")).alias("h"), formats.guide_key(F.col("extra")).alias("k")).collect()]
    assert got == [(True, "a"), (True, "b"), (True, None), (False, None), (False, "c"), (False, None)]


def plain_greedy(items, least, most):
    kept, prints, out = set(), [], []
    for t in items:
        n = t.lower().replace(" ", "")
        if len(n) < least:
            out.append("short")
        elif n in kept:
            out.append("exact")
        else:
            h = fingerprint.votes([fingerprint._blake2b(x) for x in fingerprint.features(n)])
            if h and most and any(k and any(((h ^ k) >> (16 * b)) & 65535 == 0 for b in range(4)) and bin((h ^ k) & (2**64 - 1)).count("1") <= most for k in prints):
                out.append("near")
                continue
            kept.add(n)
            prints.append(h)
            out.append("kept")
    return out


@pytest.mark.parametrize("most", [0, 3, 12])
def test_greedy_dedup(spark, most):
    rng = np.random.default_rng(1)
    base = "这是一个很长的句子用来测试近似重复检测的效果如何" * 3
    items = []
    for _ in range(60):
        t = list(base)
        for p in rng.integers(0, len(t), rng.integers(0, 4)):
            t[p] = chr(0x4E00 + int(rng.integers(0, 30)))
        items.append("".join(t))
    items += [items[0], " " + items[1], "short", ""]
    df = spark.createDataFrame([("d", i, t) for i, t in enumerate(items)], "document_id string, ord int, text string")
    got = [r["verdict"] for r in dedup.greedy(df, 10, most).orderBy("ord").collect()]
    want = plain_greedy(items, 10, most)
    assert [g == "kept" for g in got] == [w == "kept" for w in want]
    assert dedup.stats(dedup.greedy(df, 10, most)).first()["kept"] == want.count("kept")


def test_simhash_variants(spark):
    df = spark.createDataFrame([(1, "hello world 你好世界"), (2, ""), (3, None)], "doc_id int, text string")
    got = {r["doc_id"]: r for r in fingerprint.simhash_md5(df).collect()}
    assert got[1]["simhash"] != 0 and got[1]["n_features"] == 3 and got[2]["simhash"] == got[3]["simhash"] == 0
    for md5, digest in ((True, lambda x: hashlib.md5(x).digest()[:8]), (False, lambda x: hashlib.blake2b(x, digest_size=8).digest())):
        t = "hello ab 你好世界 z"
        own = [int.from_bytes(digest(x.encode()), "big") for x in ("helloab", "你好世", "好世界")]
        want = sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in own) > len(own))
        got = fingerprint.simhash(spark.createDataFrame([(1, t)], "doc_id int, text string"), md5=md5).first()
        assert got["simhash"] % (1 << 64) == want and got["n_features"] == 3
    assert one(spark, fingerprint.hamming(F.lit(5).cast("long"), F.lit(-1).cast("long"))) == 62


def blocks(spark, rows):
    return spark.createDataFrame(rows, "document_id string, ord int, text string, page int, block_type string, heading_level int, font_size double, is_bold boolean, y_ratio double")


def test_section_paths_equal_a_stack(spark):
    rng = np.random.default_rng(2)
    rows, want, stack = [], [], []
    for i in range(300):
        n = int(rng.integers(0, 7))
        if n:
            stack = [s for s in stack if s[0] < n] + [(n, f"h{i}")]
        want.append([t for _, t in stack])
        rows.append(("d", i, f"h{i}" if n else f"text {i}", 1, "heading" if n else "body", n, 10.0, False, 0.5))
    got = layout.section_paths(blocks(spark, rows)).orderBy("ord").collect()
    assert [r["section_path"] for r in got] == want


def test_pages_with_running_heads(spark):
    rows, k = [], 0
    for page in range(1, 31):
        chapter = f"第{'一二三'[(page - 1) // 10]}章 标题"
        lines = [(chapter, 8.0, 0.05)] + ([(chapter, 20.0, 0.15)] if page % 10 == 1 else []) + ([(f"{page}.1 小节", 14.0, 0.1)] if page % 3 == 0 else [])
        for t, size, y in [*lines, (f"这一页的正文内容有些不同，编号甲{'乙' * page}。", 10.5, 0.5), (f"- {page} -", 8.0, 0.95)]:
            rows.append(("d", k, t, page, "body", 0, size, False, y))
            k += 1
    kept = layout.calibrate(layout.strip_noise(blocks(spark, rows))).collect()
    texts = [(r["text"], r["font_size"]) for r in kept]
    assert not any(s == 8.0 for _, s in texts) and sum(s == 20.0 for _, s in texts) == 3 and sum(s == 14.0 for _, s in texts) == 10
    assert {r["heading_level"] for r in kept if r["block_type"] == "heading"} == {1, 2, 3} or {r["heading_level"] for r in kept if r["block_type"] == "heading"} == {1, 2}


def test_shards(spark):
    docs = spark.createDataFrame([("a", 60), ("b", 45), ("c", 50), ("d", 0), ("e", 5)], "document_id string, total_pages int")
    got = {}
    for r in layout.plan_shards(docs).orderBy("shard_index").collect():
        got.setdefault(r["document_id"], []).append((r["page_start"], r["page_end"]))
    assert got == {"a": [(1, 20), (21, 40), (41, 60)], "b": [(1, 20), (21, 45)], "c": [(1, 20), (21, 40), (41, 50)], "e": [(1, 5)]}


def test_stitch(spark):
    rows = [("d", 0, 0, "第一段没有结束", 1, "body", 0, 10.0, False, 0.5), ("d", 1, 0, "，在这里结束。", 2, "body", 0, 10.0, False, 0.5), ("d", 1, 1, "新的一段。", 2, "body", 0, 10.0, False, 0.5)]
    df = spark.createDataFrame(rows, "document_id string, shard_index int, ord int, text string, page int, block_type string, heading_level int, font_size double, is_bold boolean, y_ratio double")
    assert [(r["text"], r["page"]) for r in layout.stitch(df).orderBy("ord").collect()] == [("第一段没有结束，在这里结束。", 1), ("新的一段。", 2)]


def plain_stitch(rows):
    """Shards in order; the first block of a shard joins the last block so far, which keeps its page."""
    shards, out = {}, []
    for r in rows:
        shards.setdefault(r[1], []).append([r[3], r[4], r[5]])
    for k in sorted(shards):
        head = shards[k][0]
        if out and out[-1][2] == head[2] == "body" and not out[-1][0].endswith("。") and head[1] - out[-1][1] <= 1:
            out[-1][0] += head[0]
            out += shards[k][1:]
        else:
            out += shards[k]
    return [(t, p) for t, p, _ in out]


def test_stitch_of_chains(spark):
    rng = np.random.default_rng(8)
    schema = "document_id string, shard_index int, ord int, text string, page int, block_type string, heading_level int, font_size double, is_bold boolean, y_ratio double"
    for shards in (3, 12, 30):
        rows = []
        for k in range(shards):
            for i in range(int(rng.integers(1, 3)) if shards > 3 else 1):
                rows.append(("d", k, i, f"甲{k}{i}" + "。" * int(rng.random() < 0.1), k + 1, "body" if rng.random() < 0.9 or shards == 3 else "heading", 0, 10.0, False, 0.5))
        got = [(r["text"], r["page"]) for r in layout.stitch(spark.createDataFrame(rows, schema)).orderBy("ord").collect()]
        assert got == plain_stitch(rows)


def plain_tail(text, n):
    """The last n characters; from behind their first mark where something follows it."""
    end = text[-n:] if n > 0 else ""
    m = re.search("[。！？!?；;\n]", end)
    return end[m.end() :] if m and m.end() < len(end) else end


def test_places_for_cuts():
    text = "ab\n\ncd。ef，gh ij。" + "x" * 9 + "，y"
    assert chunking.cut_places(text, 100).tolist() == [0, len(text)]
    assert [text[i:j] for i, j in itertools.pairwise(chunking.cut_places(text, 10))] == ["ab\n\n", "cd。", "ef，gh ij。", "x" * 9 + "，", "y"]
    assert [text[i:j] for i, j in itertools.pairwise(chunking.cut_places(text, 8))] == ["ab\n\n", "cd。", "ef，", "gh ij。", "x" * 8, "x，", "y"]


def test_recursive_parts_by_their_properties(spark):
    assert chunking.tail("甲乙。丙丁", 10) == "丙丁" == one(spark, text.tail_overlap(F.col("t"), 10), t="甲乙。丙丁")
    assert chunking.tail("甲…乙丙", 3) == "…乙丙" == one(spark, text.tail_overlap(F.col("t"), 3), t="甲…乙丙")
    rng = np.random.default_rng(5)
    signs = list("甲乙丙丁戊己庚ab") + ["。", "，", "\n", "\n\n", " ", "…", "！"]
    texts = ["".join(rng.choice(signs, int(rng.integers(0, 400)))) for _ in range(60)] + ["x" * 300, "", "  ", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {}
    for r in chunking.split_texts(df, 40, 12).orderBy("doc_id", "part").collect():
        got.setdefault(r["doc_id"], []).append(r["text"])
    for i, t in enumerate(texts):
        found, places, at, before = got.get(i, []), set(chunking.cut_places(t or "", 40).tolist()), 0, ""
        if "\n\n\n" not in (t or "") and not any(not p.strip() for p in found):
            for part in found:
                held = chunking.tail(before, 12)
                at = t.index(part[len(held) :], at)  # blank parts may stand between two
                assert part.startswith(held) and {at, at + len(part) - len(held)} <= places
                at, before = at + len(part) - len(held), part
        assert all(len(p) <= 52 and p.strip() for p in found)
    con = duckdb.connect()
    con.register("d", df.fillna("").withColumnRenamed("doc_id", "id").toPandas())
    want = con.sql(f"WITH RECURSIVE {chunk_sql.parts('d', 40, 12)} SELECT id, text FROM parts ORDER BY id, part").fetchall()
    assert want == [(i, p) for i in sorted(got) for p in got[i]]


@pytest.mark.parametrize("limits", [chunking.Limits(60, 15, 100, 20, 150), chunking.Limits(40, 30, 200, 30, 90), chunking.Limits(30, 0, 50, 10, 60)])
def test_chunks_equal_sql(spark, limits):
    rng = np.random.default_rng(21)
    rows = []
    for doc in range(60):
        for i in range(int(rng.integers(0, 30))):
            depth = int(rng.integers(0, 4)) if rng.random() < 0.3 else 0
            text = [" ", None][i % 2] if rng.random() < 0.05 else "".join(rng.choice(list("甲乙丙丁。，ab \n"), int(rng.choice([3, 12, 40, 130, 300], p=[0.3, 0.3, 0.25, 0.1, 0.05]))))
            kind = "heading" if depth else ["body", None][rng.random() < 0.03]
            rows.append((f"d{doc}", i, text, None if rng.random() < 0.05 else i // 4, f"h{depth}{i}", kind, None if rng.random() < 0.03 else depth))
    df = spark.createDataFrame(rows, "document_id string, ord int, text string, page int, path string, block_type string, heading_level int").repartition(5)
    out = chunking.chunk_blocks(df.withColumn("section_path", F.array("path")), limits)
    got = [(r["document_id"], r["chunk_index"], r["text"], r["page_start"], r["page_end"], r["section_path"][0], r["block_type"], r["split_strategy"]) for r in out.orderBy("document_id", "chunk_index").collect()]
    con = duckdb.connect()
    con.register("p", df.toPandas())
    b = "SELECT document_id AS doc, ord, text, TRY_CAST(page AS BIGINT) AS page, path, coalesce(block_type, 'body') AS kind, TRY_CAST(heading_level AS BIGINT) AS level FROM p"
    want = con.sql(f"WITH RECURSIVE b AS ({b}), {chunk_sql.chunks('b', limits)} SELECT doc, chunk_index, text, page_start, page_end, path, kind, how FROM chunks ORDER BY doc, chunk_index").fetchall()
    assert got == want and len({r[7] for r in got}) >= 2


def test_chunks_keep_all_text_and_stay_within_bounds(spark):
    lim = chunking.Limits(size=50, overlap=0, split_above=80, least=1, most=120)
    rows = [("d", i, f"block {i} " + "word. " * (i % 12), i + 1, "body", 0) for i in range(80)] + [("e", 0, "alone", 1, "heading", 1)]
    df = spark.createDataFrame(rows, "document_id string, ord int, text string, page int, block_type string, heading_level int").withColumn("section_path", F.array(F.lit("s")))
    out = chunking.chunk_blocks(df, lim).orderBy("document_id", "chunk_index").collect()
    assert "".join("".join(r["text"].split()) for r in out if r["document_id"] == "d") == "".join("".join(t.split()) for d, _, t, *_ in rows if d == "d")
    assert all(r["char_count"] <= lim.most and r["page_start"] <= r["page_end"] for r in out)
    assert [r["text"] for r in out if r["document_id"] == "e"] == ["alone"]


def test_a_splitter_that_fails_loses_nothing(spark):
    def split(t):
        if "bad" in t:
            raise RuntimeError("no model")
        return [t[:40], t[40:]]

    lim = chunking.Limits(size=50, overlap=0, split_above=60, least=1, most=100)
    rows = [("good", 0, "x" * 70, 1, "body", 0), ("bad", 0, "bad " * 20, 1, "body", 0)]
    df = spark.createDataFrame(rows, "document_id string, ord int, text string, page int, block_type string, heading_level int").withColumn("section_path", F.array(F.lit("s")))
    out = {(r["document_id"], r["split_strategy"]) for r in chunking.chunk_blocks(df, lim, split).collect()}
    assert out == {("good", "semantic"), ("bad", "recursive")}


def test_normal_forms_and_null_texts(spark):
    rows = [(1, "Ａb —c"), (2, "abc"), (3, None), (4, ""), (5, "·\u3000\u2003\x1f")]
    got = {r["doc_id"]: r["kept_id"] for r in dedup.exact(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 3, 5: 3}
    both = f"lower(regexp_replace(regexp_replace(t, '{text.DECORATION}', ''), '{text.SPACE}+', ''))"
    every = spark.range(0, 0x3100).where("id <> 0").select(F.concat(F.lit("a"), F.expr("decode(unhex(lpad(hex(id), 8, '0')), 'UTF-32')"), F.lit("b")).alias("t"))
    assert every.where(text.normal(F.col("t")) != F.expr(both.replace("\\", "\\\\"))).isEmpty()


def test_chunks_keep_the_text(spark):
    rng = np.random.default_rng(3)
    rows = [("d", i, "章节" if i % 9 == 0 else "句子内容。" * int(rng.integers(1, 200)), i // 5 + 1, "heading" if i % 9 == 0 else "body", 1 if i % 9 == 0 else 0, 10.0, False, 0.5) for i in range(60)]
    got = chunking.chunk_blocks(layout.section_paths(blocks(spark, rows))).orderBy("chunk_index").collect()
    assert [r["chunk_index"] for r in got] == list(range(len(got))) and all(r["text"].strip() and len(r["text"]) <= 3000 for r in got)
    assert sum(r["char_count"] for r in got) >= sum(len(r[2]) for r in rows)


def test_recursive_split():
    t = "段落一。" * 300 + "\n\n" + "x" * 2000
    parts = chunking.recursive_split(t, 800, 0)
    assert "".join(parts) == t and max(map(len, parts)) <= 800
    assert chunking.recursive_split("  ", 800, 10) == [] and chunking.recursive_split("abc", 800, 10) == ["abc"]


def test_titles(spark):
    rows = spark.createDataFrame([("s", 0, ["a", "b"]), ("s", 1, ["a", "b"]), ("s", 2, ["a"]), ("s", 3, []), ("s", 4, None), ("s", 5, ["c", " "])], "script_code string, pos int, section_path array<string>")
    got = {tuple(r["path"]): (r["qa_count"], r["first_pos"], tuple(r["parent"])) for r in titles.tree_nodes(rows).collect()}
    assert got == {("a",): (1, 0, ()), ("a", "b"): (2, 0, ("a",)), ("untitled",): (2, 3, ()), ("c",): (1, 5, ())}


def test_requests(spark):
    e = [("u", "k", "create", 1), ("u", "k", "create", 2), ("u", "k", "cancel", 3), ("u", "k", "create", 4), ("v", "k", "create", 1), ("v", "k", "complete", 2), ("v", "k", "create", 3), ("w", "k", "cancel", 2)]
    df = spark.createDataFrame([(*x, "t") for x in e], "user_id string, match_key string, action string, seq int, script_title string").withColumn("ts", F.timestamp_seconds("seq"))
    assert {r["user_id"]: r["status"] for r in requests.fold(df).collect()} == {"u": "pending", "v": "completed", "w": "cancelled"}


def test_job_progress(spark):
    e = [("j", 1, "pending", 0), ("j", 2, None, 3), ("j", 3, "extracting", 2), ("j", 4, "cancelled", 1)]
    cols = ", ".join(f"d_{c} int" for c in upsert.COUNTERS)
    df = spark.createDataFrame([(a, b, c, None, *([d] * 7)) for a, b, c, d in e], f"job_id string, seq int, status string, stage_detail string, {cols}").withColumn("ts", F.timestamp_seconds("seq"))
    r = upsert.job_progress(df).first()
    assert r["total_chunks"] == 6 and r["status"] == "cancelled" and r["started_at"].second == 3 and r["finished_at"] is None


def test_uploads(spark):
    tasks = spark.createDataFrame([("t", 3, 300, "uploading")], "task_id string, total_parts int, file_size long, status string")
    parts = spark.createDataFrame([("t", 1, '"a"', 100), ("t", 2, "b", 100)], "task_id string, part_number int, etag string, size long")
    assert uploads.missing_parts(tasks, parts).first()["missing"] == [3]
    assert uploads.progress(tasks, parts).first()["progress"] == 66.67
    assert [r["part_number"] for r in uploads.differing_parts(spark.createDataFrame([("t", 1, "a"), ("t", 2, '"c"')], "task_id string, part_number int, etag string"), parts).collect()] == [2]
    files = spark.createDataFrame([("k", None), ("k", "x"), ("l", "x")], "object_key string, deleted_at string")
    assert [r["object_key"] for r in uploads.orphans(files).collect()] == ["l"]


def test_catalog(spark):
    rows = spark.createDataFrame([("1", "Red", ["x"], 4, 6, "published", '{"dmGuide": {}}'), ("2", "Blue", ["red"], None, None, "published", "{}"), ("3", "redder", [], 2, 3, "draft", None)], "id string, title string, aliases array<string>, lo int, hi int, status string, extra string")
    names = {"word_columns": ("title",)}
    assert {r["id"] for r in catalog.facets(rows, word="red", **names).collect()} == {"1", "2"}
    assert {r["id"] for r in catalog.facets(rows, status=None, inside={("lo", "hi"): 5}).collect()} == {"1"}
    assert {r["id"] for r in catalog.facets(rows, guide=True).collect()} == {"1"} and {r["id"] for r in catalog.facets(rows, guide=False).collect()} == {"2"}
    merged = one(spark, catalog.merge_json(F.lit('{"a": 1, "b": {"c": 2}}'), F.lit('{"b": 3, "d": [1]}')))
    assert merged in ('{"a":1,"b":3,"d":[1]}', '{"a":1,"d":[1],"b":3}')
    assert catalog.range_violations(rows, [("lo", "hi", 5)]).first()["wrong"] == ["lo"]
    assert catalog.by_ids(rows, ["1", " 1 ", "", "9"]).count() == 1 and catalog.by_ids(rows, []).count() == 0


def test_retrieval_filters(spark):
    rows = spark.createDataFrame([(1, "d", "c", [1.0, 0.0]), (2, "d", "c", [0.9, 0.1]), (3, "e", "c", [1.0, 0.0]), (4, "d", "x", None)], "id int, document_id string, script_code string, embedding array<float>")
    docs = spark.createDataFrame([("d", True, None), ("e", False, None)], "id string, is_active boolean, deleted_at timestamp")
    got = retrieval.match(rows, docs, F.array(F.lit(1.0), F.lit(0.0)), 8, 0.25, script_code="c").collect()
    assert [r["id"] for r in got] == [1, 2]
    assert retrieval.by_code_or_id(rows.withColumn("script_id", F.lit("i")), "none", "i").count() == 4


def test_answers_of_a_model(spark):
    def parsed(content, most=2):
        df = spark.createDataFrame([(content, most)], "content string, last_index int")
        return [tuple(r) for r in documents.pairs_of(df).select("question", "answer", "category", "source_index").collect()]

    pair = '{"question": "what is it", "answer": "this", "category": " Rule ", "index": 9}'
    for content in (f"[{pair}]", f"```json\n[{pair}]\n```", f"Here: [{pair}] ok", f'{{"data": [{pair}]}}', f'{{"x": 1, "list": [{pair}]}}', pair):
        assert parsed(content) == [("what is it", "this", "rule", 2)]
    assert parsed("no json") == parsed(None) == parsed("") == parsed("[]") == parsed("{'question': 'what is it', 'answer': 'this'}") == []
    assert parsed('[{"question": "abc", "answer": "xx"}, {"question": "long enough", "answer": "x"}, 5]') == []
    for index, want in (('"x"', 0), ("1", 1), ('"1"', 1), ("-4", 0), ("null", 0), ("1.7", 1)):
        assert parsed(f'[{{"question": "long enough", "answer": "yes", "index": {index}}}]') == [("long enough", "yes", "general", want)]
    assert parsed('[{"question": "long enough", "answer": "yes"}, "x", {"question": "another one", "answer": "no"}]') == [("long enough", "yes", "general", 0), ("another one", "no", "general", 0)]


def test_docx(spark, tmp_path):
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    xml = f'<w:document xmlns:w="{w}"><w:body><w:p><w:pPr><w:pStyle w:val="Heading2"/></w:pPr><w:r><w:t>Title</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p/></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl><w:p><w:r><w:t>Body</w:t></w:r></w:p></w:body></w:document>'
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        z.writestr("word/document.xml", xml)
    (tmp_path / "a.docx").write_bytes(held.getvalue())
    (tmp_path / "b.docx").write_bytes(b"broken")
    got = documents.read_docx(documents.files(spark, str(tmp_path), "*.docx")).orderBy("ord").collect()
    assert [(r["text"], r["block_type"], r["heading_level"]) for r in got] == [("Title", "heading", 2), ("Body", "body", 0), ("a | b", "body", 0)]


def test_generate_and_embed(spark):
    chunks = spark.createDataFrame([(i, f"text {i}") for i in range(5)], "chunk_index int, text string")
    answers = documents.generate(chunks, lambda texts: '[{"question": "how many", "answer": "%d of them"}]' % len(texts))
    assert sorted(r["answer"] for r in documents.pairs_of(answers).collect()) == ["2 of them", "3 of them"]
    got = documents.embed(chunks, lambda texts: [[float(len(t))] for t in texts], F.col("text")).collect()
    assert all(r["embedding"] == [6.0] for r in got)


def test_streams(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", 5), (1, "a", 6), (2, "b", 7)], "k int, v string, t int").select("k", "v", F.timestamp_seconds("t").alias("ts"))
    df.write.parquet(f"{tmp_path}/in")
    rows = pipelines.file_stream(spark, f"{tmp_path}/in", df.schema)
    assert pipelines.run_once(pipelines.dedup_stream(rows, ["k", "v"])).count() == 2
    assert {r["k"]: r["n"] for r in pipelines.run_once(pipelines.counter_stream(rows, "k"), "complete").collect()} == {1: 2, 2: 1}


def test_items_and_seeds(spark):
    options = spark.createDataFrame([("kind", "a", "A", 1), ("theme", "t", "T", 2)], "category_code string, code string, label string, sort_order int")
    rows = spark.createDataFrame(
        [("1", "c", "Red", "me", None, [], "a", ["t", "?"], 4, 6, 2, 2, 0, 180, 240, None, None, '{"dmGuide": "k"}', 11), ("2", "c", "Blue", None, None, ["red"], "z", [], 9, 6, None, None, None, None, None, 5, 1, None, 3)],
        "id string, code string, title string, author string, cover_url string, aliases array<string>, kind string, theme array<string>, player_min int, player_max int, male_count int, female_count int, flexible_count int, duration_min int, duration_max int, play_count int, rating_count int, extra string, rating int",
    )
    got = {r["id"]: r for r in catalog.items(rows, options, {"kind": "kind"}, {"theme": "theme"}).collect()}
    assert got["1"]["kind_label"] == "A" and got["1"]["theme_labels"] == ["T", "?"] and got["1"]["players_text"] == "4-6人（2男2女）" and got["1"]["has_guide"] and got["2"]["kind_label"] is None and got["1"]["play_count"] == 0
    assert sorted(r["problem"].split(":")[0] for r in catalog.seed_violations(rows, options, {"kind": "kind", "theme": "theme"}, [("player_min", "player_max", 50)]).collect()) == ["code used twice", "code used twice", "range", "rating", "unknown kind", "unknown theme"]
    assert [r["id"] for r in catalog.autocomplete(rows, "red").collect()] == ["2", "1"]


def test_jobs_and_counts(spark):
    jobs = spark.createDataFrame([("1", "s", "", "k", "failed", 1), ("2", "s", "", "l", "embedding", 2), ("3", "s", "", "k", "extracting", 3)], "id string, script_id string, script_code string, object_key string, status string, created_at int")
    assert upsert.latest_job(jobs, "none", "s", "k").first()["id"] == "3" and [r["id"] for r in upsert.running(jobs).collect()] == ["3"]
    assert upsert.backfill_code(jobs, spark.createDataFrame([("s", "code")], "id string, code string")).first()["script_code"] == "code"
    docs = spark.createDataFrame([("d", 9)], "id string, total_chunks int")
    parts = spark.createDataFrame([("d", None), ("d", 1)], "document_id string, embedding int")
    assert upsert.recount(docs, parts, parts.limit(0)).select("total_chunks", "embedded_chunks", "total_qa").first() == (2, 1, 0)


def test_masks_find_all_pairs_that_share_a_band(spark):
    rng = np.random.default_rng(9)
    base = [int(x) for x in rng.integers(-(2**63), 2**63 - 1, 40)]
    prints = []
    for i in range(600):
        h = base[i % 40] & (2**64 - 1)
        for b in rng.choice(64, int(rng.integers(0, 8)), replace=False):
            h ^= 1 << int(b)
        prints.append((i, h - 2**64 if h >> 63 else h))
    df = spark.createDataFrame(prints, "doc_id long, simhash long")
    for most, n in ((3, 10), (3, 10**6), (3, 10**9), (6, 10**6), (0, 10**6), (1, 10**9)):
        masks = [m & (2**64 - 1) for m in dedup.key_masks(most, n)]
        rep = {}
        for i, h in prints:
            rep[h & (2**64 - 1)] = min(i, rep.get(h & (2**64 - 1), i))
        for x, y in itertools.combinations(sorted(rep), 2):
            d = x ^ y
            if d.bit_count() <= most and any(not d >> (16 * b) & 65535 for b in range(4)):
                assert any(not d & m for m in masks)
        if n > 1000:
            assert min(m.bit_count() for m in masks) >= min(40, math.log2(n)) or most == 0
    want = {(min(rep[x], rep[y]), max(rep[x], rep[y]), (x ^ y).bit_count()) for x, y in itertools.combinations(rep, 2) if (x ^ y).bit_count() <= 6 and any(not (x ^ y) >> (16 * b) & 65535 for b in range(4))}
    got = [tuple(r) for r in dedup.band_pairs(df, 6).collect()]
    assert set(got) == want and len(got) == len(want)


def test_null_texts_are_short_items(spark):
    df = spark.createDataFrame([("d", 0, None), ("d", 1, ""), ("d", 2, "long enough text")], "document_id string, ord int, text string")
    assert {r["ord"]: r["verdict"] for r in dedup.greedy(df, 10).collect()} == {0: "short", 1: "short", 2: "kept"}


def test_near_duplicate_stream_goes_on_and_forgets(spark, tmp_path):
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in range(30)]
    items = []
    for i in range(60):
        text = " ".join(rng.choice(words, 12)) if i % 3 else items[-1][2] + (" x" if i % 2 else "") if items else "start"
        items.append(("ab"[i % 2] if i % 5 else "a", i, text))
    df = spark.createDataFrame(items, "document_id string, ord int, text string")
    want = {(r["document_id"], r["ord"]): r["verdict"] for r in dedup.greedy(df, 5, 8).collect()}
    (tmp_path / "in").mkdir()
    stream = pipelines.file_stream(spark, f"{tmp_path}/in", df.schema)
    with stateful.state_store(spark, idle=False):
        for part in (df.where("ord < 25"), df.where("ord >= 25")):
            part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
            out = pipelines.run_once(stateful.near_duplicates(stream, 5, 8), root=f"{tmp_path}/out")
        assert {(r["within"], r["ord"]): r["verdict"] for r in out.collect()} == want
        assert {"kept", "exact"} <= set(want.values())
        # what was seen is forgotten after its time
        for _ in range(2):
            df.where("ord = 1").coalesce(1).write.mode("append").parquet(f"{tmp_path}/late")
            late = pipelines.file_stream(spark, f"{tmp_path}/late", df.schema)
            out = pipelines.run_once(stateful.near_duplicates(late, 5, 8, ttl_ms=200), root=f"{tmp_path}/late-out")
            time.sleep(1)
    assert [r["verdict"] for r in out.collect()] == ["kept", "kept"]


def test_tasks_expire_by_the_clock_of_the_stream(spark, tmp_path):
    day = datetime.datetime(2024, 1, 1)
    at = lambda h: day + datetime.timedelta(hours=h)
    first = [(1, "uploading", None, at(0)), (2, "uploading", "slow", at(0)), (3, "uploading", None, at(0)), (4, "completed", None, at(0)), (5, "uploading", None, at(20))]
    then = [(3, "completed", None, at(10)), (1, "uploading", None, at(5)), (6, "uploading", None, at(30)), (7, "completed", None, at(30))]
    schema = "task_id long, status string, error_message string, updated_at timestamp"
    with stateful.state_store(spark, idle=True):
        for part in (first, then):
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
            stream = pipelines.file_stream(spark, f"{tmp_path}/in", spark.createDataFrame([], schema).schema)
            out = pipelines.run_once(stateful.expired(stream, 24, late="20 hours"), root=f"{tmp_path}/out")
    assert sorted(tuple(r) for r in out.collect()) == []  # the clock stands at hour 10
    with stateful.state_store(spark, idle=True):
        spark.createDataFrame([(8, "completed", None, at(50))], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = pipelines.file_stream(spark, f"{tmp_path}/in", spark.createDataFrame([], schema).schema)
        out = pipelines.run_once(stateful.expired(stream, 24, late="20 hours"), root=f"{tmp_path}/out")
    assert sorted(tuple(r) for r in out.collect()) == [(1, "failed", "expired"), (2, "failed", "slow")]


def test_a_repeated_batch_counts_once(spark, tmp_path):
    table = tables.VersionedTable(spark, str(tmp_path / "jobs"))
    fields = "job_id long, seq long, ts timestamp, status string, stage_detail string, " + ", ".join(f"d_{c} int" for c in upsert.COUNTERS)
    t0 = datetime.datetime(2024, 1, 1)
    rows = [(i % 3, i, t0 + datetime.timedelta(minutes=i), [None, "pending", "running", "completed"][i % 4], f"d{i}" if i % 2 else None, *([i] * len(upsert.COUNTERS))) for i in range(30)]
    df = spark.createDataFrame(rows, fields)
    fold = tables.merging(table, lambda before, new: upsert.merged_states(before, upsert.job_states(new)))
    assert table.read() is None
    for number, (lo, hi) in enumerate(((0, 10), (10, 20), (20, 30))):
        batch = df.where(f"seq >= {lo} and seq < {hi}")
        fold(batch, number)
        fold(batch, number)  # as after a failure between write and commit
    got, want = upsert.progress_of(table.read()), upsert.job_progress(df)
    assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect()))
    assert len(table._versions()) == 2


def test_slugs_of_other_scripts(spark):
    terms = spark.createDataFrame([("雾", ["wu"]), ("雾都", ["wu", "du"]), ("疑影", ["yi", "ying"]), ("山", ["shan"]), ("母", ["mu"]), ("鬼", ["gui"]), ("都疑", ["no"]), ("", ["no"]), ("山", ["zzz"])], "term string, syllables array<string>")
    titles_ = {"雾都疑影": "wu-du-yi-ying", "山母鬼3": "shan-mu-gui-3", "Café 3": "cafe-3", "雾x母": "wu-x-mu", "？！": "", "": "", None: None, "字": "", "ﬁn ²": "fin-2", "a" * 47 + " bc": "a" * 47 + "-"}
    rows = spark.createDataFrame([(t,) for t in titles_] * 2, "title string").withColumns({"term": F.lit("x"), "at": F.lit(1), "n": F.lit(2)})
    got = slugs.slugs(rows, terms)
    assert got.count() == 2 * len(titles_) and got.columns == [*rows.columns, "slug"]
    assert {r["title"]: r["slug"] for r in got.collect()} == titles_
    assert slugs.slugs(rows, terms.limit(0)).where("title = 'Café 3'").first()["slug"] == "cafe-3"
