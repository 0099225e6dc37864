"""Paragraphs, cuts by meaning, the vector index and the composed ingest, against plain versions."""

import math
import statistics
import sys

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from lodestar.functions import text
from lodestar.operators import chunking, index, ingest, layout
from lodestar.plans.texts import letter_vectors
from lodestar.sources import documents, pages

ENDS, OPEN = "。！？!?；;”\"）)]】", "，,、；;：:（([【“\"'/\\—-"


def heading(t):
    return len(t) <= 40 and t[:1] in "第一二" and ("章" in t[:4] or "、" in t[:3])


def plain_paragraphs(lines):
    """lines of one block: lists of (text, size, flags)."""
    groups, now, last = [], [], None
    for spans in lines:
        t = "".join(s[0] for s in spans).strip()
        if not t:
            continue
        sizes = [s[1] for s in spans if s[0].strip() for _ in s[0]]
        bold = sum(len(s[0]) for s in spans if s[0].strip() and s[2] & 16)
        size = statistics.median(sizes)
        if now:
            ratio = size / last[1]
            if ratio >= 1.15 or ratio <= 1 / 1.15 or (heading(t) and last[0][-1] in ENDS):
                groups.append(now)
                now = []
        now.append((t, sizes, bold))
        last = (t, size)
    groups += [now] if now else []
    out = []
    for g in groups:
        merged = g[0][0]
        for t, _, _ in g[1:]:
            if merged[-1] in ENDS and heading(t):
                merged += "\n"
            elif merged[-1] not in OPEN and merged[-1].isascii() and merged[-1].isalnum() and t[0].isascii() and t[0].isalnum():
                merged += " "
            merged += t
        sizes = [x for _, s, _ in g for x in s]
        out.append((merged, statistics.median(sizes), sum(b for _, _, b in g) / len(sizes) >= 0.6))
    return out


def test_paragraphs_equal_a_plain_version(spark):
    rng = np.random.default_rng(11)
    bits = ["第一章 开始", "一、要点", "这是一句话。", "没有结束，", "word", "two words", "结束！", " ", "ok 9"]
    rows, want = [], {}
    for block in range(40):
        lines = [[(str(rng.choice(bits)), float(rng.choice([10.0, 10.5, 12.0])), int(rng.choice([0, 16]))) for _ in range(int(rng.integers(1, 3)))] for _ in range(int(rng.integers(0, 8)))]
        rows += [("d", 1, block, i, spans) for i, spans in enumerate(lines)]
        want[block] = plain_paragraphs(lines)
    df = spark.createDataFrame(rows, "document_id string, page int, block_no int, line_no int, spans array<struct<text:string,size:double,flags:int>>")
    got = {}
    for r in layout.paragraphs(df).orderBy("block_no", "part").collect():
        got.setdefault(r["block_no"], []).append((r["text"], r["font_size"], r["is_bold"]))
    assert all(got.get(k, []) == v for k, v in want.items())


def plain_semantic(t, limits):
    parts, now = [], ""
    for c in t:
        now += c
        if c in text.SENTENCE_MARKS:
            parts.append(now.strip())
            now = ""
    s = [x for x in [*parts, now.strip()] if x]
    if len(s) < 4:
        return chunking.recursive_split(t, limits.size, limits.overlap)
    v = letter_vectors(["".join(s[max(0, i - 1) : i + 2]) for i in range(len(s))])
    gap = [1 - sum(a * b for a, b in zip(x, y, strict=True)) / math.sqrt(sum(a * a for a in x) * sum(b * b for b in y)) for x, y in zip(v, v[1:], strict=False)]
    level = float(np.percentile(gap, 88))
    out, held = [], []
    for i, x in enumerate(s):
        held.append(x)
        if i == len(s) - 1 or gap[i] > level + 1e-12:
            out.append("".join(held))
            held = []
    return [y for x in out for y in ([x] if len(x) <= limits.most else chunking.recursive_split(x, limits.size, limits.overlap))]


def test_semantic_pieces_equal_a_plain_version(spark):
    rng = np.random.default_rng(4)
    words = ["tea", "stone", "river", "hundred", "oo", "sun", "cat。", "dog！", "end\n", "day…"]
    texts = [" ".join(rng.choice(words, int(rng.integers(0, 120)))) for _ in range(25)] + ["", None, "x" * 90 + "。" + "y" * 300]
    limits = chunking.Limits(size=60, overlap=10, most=120)
    found = chunking.semantic_pieces(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"), letter_vectors, limits=limits)
    got = {}
    for r in found.orderBy("doc_id", "part").collect():
        got.setdefault(r["doc_id"], []).append(r["text"])
    assert all(got.get(i, []) == plain_semantic(t or "", limits) for i, t in enumerate(texts))


def test_windows_are_embedded_whole(spark):
    given = spark.sparkContext.accumulator(0)

    def model(batch):
        given.add(sum(map(len, batch)))
        return letter_vectors(batch)

    s = ["z" * 490 + end * 10 + "。" for end in "aaaaxxxxx"]
    out = chunking.semantic_pieces(spark.createDataFrame([(1, "".join(s))], "doc_id int, text string").coalesce(1), model).collect()
    got = [r["text"] for r in sorted(out, key=lambda r: r["part"])]
    assert got == ["".join(s[:5]), "".join(s[5:])] == plain_semantic("".join(s), chunking.Limits())
    assert given.value == sum(len("".join(s[max(0, i - 1) : i + 2])) for i in range(9))


def test_a_model_that_fails_leaves_its_texts_to_separators(spark):
    def model(batch):
        if any("bad" in x for x in batch):
            raise RuntimeError("no model")
        return letter_vectors(batch)

    good, bad = "Tea. Stone! River? ".replace(". ", "。").replace("! ", "！") * 6, "bad。" * 60
    limits = chunking.Limits(size=60, overlap=0, most=120)
    df = spark.createDataFrame([(1, good), (2, bad)], "doc_id int, text string")
    out = chunking.semantic_pieces(df, model, limits=limits).collect()
    assert {(r["doc_id"], r["strategy"]) for r in out} == {(1, "semantic"), (2, "recursive")}
    assert "".join(r["text"] for r in sorted(out, key=lambda r: r["part"]) if r["doc_id"] == 2) == bad


class Fragile:
    """A made-up reader: the page that reads `broken` raises."""

    def open(self, path):
        inner = pages.FormFeedText().open(path)
        whole = inner.page

        def page(n):
            if "broken" in inner.pages[n - 1]:
                raise ValueError("broken page")
            return whole(n)

        inner.page = page
        return inner


def test_page_ranges_are_partitions(spark, tmp_path):
    (tmp_path / "a.txt").write_text("\f".join("broken" if n == 3 else f"page {n}\nline two\n\nother block {n}" for n in range(1, 46)))
    (tmp_path / "b.txt").write_text("only page")
    (tmp_path / "empty.txt").write_text("")
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    a, b, e, gone = (str(tmp_path / x) for x in ("a.txt", "b.txt", "empty.txt", "gone.txt"))
    docs = spark.createDataFrame([(a, 45), (b, 1), (e, 1), (gone, 2), (f"file://{b}", 1), (a + "none", 0)], "path string, total_pages int")
    lines = pages.read_shards(docs, Fragile())
    assert lines.rdd.getNumPartitions() == 6  # 20 and 25 pages of a, and one each
    got = lines.collect()
    assert sorted({r["page"] for r in got if r["document_id"] == a}) == [n for n in range(1, 46) if n != 3]
    assert {(r["shard_index"], r["page"] <= 20) for r in got if r["document_id"] == a} == {(0, True), (1, False)}
    assert [r["page"] for r in got if r["document_id"] in (b, f"file://{b}")] == [1, 1] and not any(r["document_id"] in (e, gone) for r in got)
    text = {(r["page"], r["block_no"]): r["text"] for r in layout.paragraphs(lines.where(F.col("document_id") == a)).collect()}
    assert text[(7, 0)] == "page 7 line two" and text[(7, 1)] == "other block 7"
    assert pages.read_shards(docs, Fragile(), most_tasks=2).rdd.getNumPartitions() == 2
    assert pages.read_shards(docs.limit(0), Fragile()).count() == 0


@pytest.mark.parametrize("spread", [0.1, 3.0])
def test_index_finds_what_a_scan_finds(spark, spread):
    rng = np.random.default_rng(2)
    centers = rng.normal(size=(12, 8))
    v = [(i, (centers[i % 12] + spread * rng.normal(size=8)).tolist()) for i in range(600)] + [(600, None), (601, [0.0] * 8), (602, centers[0].tolist()), (603, centers[0].tolist())]
    rows = spark.createDataFrame(v, "id long, embedding array<double>")
    queries = rows.where("id % 100 = 0").withColumnRenamed("id", "query_id")
    own = index.build(rows, n_lists=12)
    m = np.array([x for _, x in v if x is not None and any(x)])
    ids = np.array([i for i, x in v if x is not None and any(x)])
    m = m / np.linalg.norm(m, axis=1, keepdims=True)
    want = set()
    for q in range(0, 600, 100):
        sim = m @ m[q]
        want |= {(q, int(ids[k])) for k in np.lexsort((ids, -np.round(sim, 12)))[:5]}
    got = {(r["query_id"], r["id"]) for r in index.search(own, queries, 5, probes=2).collect()}
    assert got == want
    truth = spark.createDataFrame(sorted(want), "query_id long, id long")
    assert index.recall(index.search(own, queries, 5, probes=8, exact=False), truth) >= 0.9
    assert index.search(own, queries.limit(0), 5).count() == 0


def test_index_reads_few_vectors_and_can_be_kept(spark, tmp_path):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding")
    index.write(index.build(rows, n_lists=16), str(tmp_path / "index"))
    own = index.read(spark, str(tmp_path / "index"))
    queries = rows.where("id % 100 = 0").withColumnRenamed("id", "query_id")
    v = {r["id"]: np.array(r["embedding"], float) for r in rows.collect()}
    m = np.array([v[i] / np.linalg.norm(v[i]) for i in sorted(v)])
    want = {(q, int(i)) for q in v if q % 100 == 0 for i in np.lexsort((sorted(v), -(m @ m[q])))[:8]}
    assert {(r["query_id"], r["id"]) for r in index.search(own, queries, 8).collect()} == want
    looked_at = index.candidates(own, m[::100], 8).count()
    assert looked_at < len(m) * len(m[::100]) / 3
    truth = spark.createDataFrame(sorted(want), "query_id long, id long")
    assert index.recall(index.search(own, queries, 8, probes=12, exact=False), truth) >= 0.9


def test_index_without_vectors(spark):
    none = spark.createDataFrame([(1, None), (2, [0.0, 0.0])], "id long, embedding array<double>")
    some = spark.createDataFrame([(1, [1.0, 2.0])], "query_id long, embedding array<double>")
    assert index.search(index.build(none), some, 3).collect() == []


def test_ingest(spark):
    schema = "document_id string, shard_index int, ord int, text string, page int, block_type string, heading_level int, font_size double, is_bold boolean, y_ratio double"
    rows = []
    for d in ("a", "b"):
        for k in range(4):
            rows.append((d, k, 0, f"第{'一二三四'[k]}章 标题", 2 * k + 1, "heading", 1, 20.0, True, 0.3))
            rows.append((d, k, 1, f"内容{k % 2}有些不同的句子。" * 30, 2 * k + 1, "body", 0, 10.0, False, 0.5))
            rows.append((d, k, 2, f"- {k} -", 2 * k + 1, "body", 0, 8.0, False, 0.95))
    kept, counts = ingest.passages(spark.createDataFrame(rows, schema))
    found = kept.orderBy("document_id", "chunk_index").collect()
    assert [r["chunk_index"] for r in found if r["document_id"] == "a"] == list(range(len(found) // 2))
    assert all(len(r["content_hash"]) == 64 and r["section_path"] for r in found)
    n = {r["document_id"]: (r["total_pages"], r["total_chunks"], r["dropped_chunks"]) for r in counts.collect()}
    assert n["a"] == n["b"] and n["a"][0] == 7 and n["a"][1] == len(found) // 2 and n["a"][2] >= 4
    qa = ingest.questions(kept, lambda texts: str([{"question": f"what is {t[:9]}", "answer": "this", "index": i} for i, t in enumerate(texts)]).replace("'", '"'))
    pairs = qa.collect()
    assert len(pairs) == len(found) and {r["content_hash"] for r in pairs} == {r["content_hash"] for r in found} and all(r["title"] == r["section_path"][-1] for r in pairs)
    chunks, asked = ingest.store(kept, qa, letter_vectors, 11)
    assert all(len(r["embedding"]) == 11 for r in [*chunks.collect(), *asked.collect()])
    with pytest.raises(Exception, match="elements"):
        ingest.store(kept, qa, letter_vectors, 12)[0].collect()


def test_prepare_leaves_whole_documents_out(spark):
    found = spark.createDataFrame([("s", "k1", b"one"), ("s", "k2", b"two"), ("t", "k3", b"one")], "script_id string, object_key string, content binary")
    one = found.select(F.sha2("content", 256)).first()[0]
    docs = spark.createDataFrame([("d", "s", one, 2, 4)], "id string, script_id string, file_hash string, total_chunks int, version int")
    chunks = spark.createDataFrame([("d",), ("d",)], "document_id string")
    got = {(r["script_id"], r["object_key"]): (r["document_id"], r["version"]) for r in ingest.prepare(found, docs, chunks).collect()}
    assert got == {("s", "k2"): (None, 5), ("t", "k3"): (None, 1)}
    assert ingest.prepare(found, docs, chunks.limit(1)).count() == 3 == ingest.prepare(found, docs, chunks, force=True).count()


@pytest.mark.parametrize(("style", "level"), [("Heading 2", 2), ("标题 9", 6), ("Title", 1), ("副标题", 2), ("Body", 0), ("", 0), ("Style12", 6), ("heading 0", 1)])
def test_style_levels(style, level):
    assert documents.style_level(style) == level


@pytest.mark.parametrize(("raw", "name"), [(" a/b:c?.txt ", "b_c_.txt"), ("..\\x..y. ", "x.y"), ("/", None), (None, None), ("n" * 300 + ".pdf", "n" * 196 + ".pdf")])
def test_file_names(spark, raw, name):
    df = spark.createDataFrame([(raw,)], "t string")
    assert df.select(text.safe_filename(F.col("t"))).first()[0] == name
