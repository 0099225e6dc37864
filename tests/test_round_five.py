"""Steps that were made too often, or with too much work a row."""

import re
import time

from pyspark.sql import functions as F

from lodestar.functions import fingerprint, text
from lodestar.operators import chunking, layout


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_fingerprints_of_a_batch_equal_those_of_each(monkeypatch):
    monkeypatch.setattr(fingerprint, "STEP", 20)
    texts = ["", "abc，def。", None, "、。" * 40, "x", *(f"word{i}。甲乙丙丁{i}" for i in range(9)), ""]
    hashes = [[fingerprint._blake2b(x) for x in fingerprint.features(t or "")] for t in texts]
    want = [fingerprint.votes(h) for h in hashes]
    assert fingerprint.all_votes(sum(hashes, []), [len(h) for h in hashes]) == want
    assert list(fingerprint._prints(texts, fingerprint._blake2b)["simhash"]) == want


def test_ends_and_noise_equal_the_whole_text_s_rules(spark):
    texts = ["", "a", "a。", "a。\n", "a。\r\n", "a。b", "。\n\n", "-- 12 --", "第 3 页", "…甲…", "…甲…乙", "١٢", "12/30", " x ", "𝒳。", "𝒳𝒴", "x" * 50 + "!"]
    got = spark.createDataFrame([(t,) for t in texts], "t string")
    old = text.strip(F.col("t"))
    noise = (old == "") | old.rlike(text.PAGE_NUMBER) | (F.length(F.regexp_replace(old, r"[^\p{L}\p{N}]+", "")) <= 1)
    for r in got.select("t", text.ends(F.col("t"), text.SENTENCE_END).alias("a"), F.col("t").rlike(text.SENTENCE_END).alias("b"), text.is_noise(F.col("t")).alias("c"), noise.alias("d")).collect():
        assert (r["a"], r["c"]) == (r["b"], r["d"]), r["t"]


def test_blocks_are_cut_by_one_python_step(spark):
    blocks = spark.createDataFrame([("d", 0, "word " * 700, 1, "body", 0, ["p"])], "document_id string, ord int, text string, page int, block_type string, heading_level int, section_path array<string>")
    out = chunking.chunk_blocks(blocks)
    assert len(re.findall(r"ArrowEvalPython", plan(out))) == 1
    assert max(r["char_count"] for r in out.collect()) <= 920
    odd = chunking.Limits(size=800, most=500)
    assert all(r["split_strategy"] == "fallback" for r in chunking.chunk_blocks(blocks, odd).collect())


def test_semantic_pieces_shuffle_nothing_and_embed_once(spark):
    made = spark.sparkContext.accumulator(0)

    def model(batch):
        made.add(len(batch))
        return [[float(t.count("a")), 1.0] for t in batch]

    docs = spark.createDataFrame([(1, "aa。b。aaa。c。d。a。"), (2, "short。text。"), (3, None)], "doc_id int, text string").coalesce(1)
    out = chunking.semantic_pieces(docs, model)
    rows = out.collect()
    assert "Exchange" not in plan(out) and "Window" not in plan(out)
    assert made.value == 6
    assert "".join(r["text"] for r in rows if r["doc_id"] == 1) == "aa。b。aaa。c。d。a。"
    assert {r["doc_id"]: r["strategy"] for r in rows} == {1: "semantic", 2: "recursive"}


def test_distances_of_odd_vectors():
    far, empty = chunking._neighbour_distances([[1.0, 0.0], [0.0, 2.0], [0.0, 0.0], [1.0], [None], [3.0], [], [2.0, 2.0], [2.0, 2.0]])
    assert list(far[:7]) == [1.0, 0, 0, 0, 0, 0, 0] and abs(far[7]) < 1e-12
    assert list(empty) == [False] * 6 + [True, False, False]
    assert chunking._neighbour_distances([[]])[0].tolist() == []


def test_sizes_of_a_line_are_counted_in_one_pass(spark):
    schema = "document_id int, page int, block_no int, line_no int, spans array<struct<text:string,size:double,flags:int>>"
    odd = [("ab", 9.0, 16), (None, 50.0, 16), ("  ", 70.0, 16), ("c", None, 16), ("d", 12.0, None), ("", 80.0, 0), ("e", 12.0, 0)]
    rows = [(1, 1, 1, 1, odd), (1, 1, 1, 2, None), (1, 1, 1, 3, []), (1, 1, 1, 4, [(" ", 9.0, 0)]), (1, 1, 2, 1, [("x", None, 0)])]
    many = [(2, 1, 1, 1, [("w", float(k), 0) for k in range(30_000)])]
    out = layout.paragraphs(spark.createDataFrame(rows + many, schema))
    start = time.monotonic()
    got = {(r["document_id"], r["block_no"]): r for r in out.collect()}
    assert time.monotonic() - start < 60
    assert len(got) == 3 and got[1, 1]["text"] == "ab  cde"
    assert (got[1, 1]["font_size"], got[1, 1]["is_bold"]) == (10.5, True)
    assert (got[1, 2]["font_size"], got[1, 2]["is_bold"]) == (0.0, False)
    assert got[2, 1]["font_size"] == 14_999.5
