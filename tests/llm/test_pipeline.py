"""The pipeline's rows against plain versions of its stages."""

import hashlib
import re

import pytest
from test_llm_operators import plain_components, plain_distance, plain_encoding, plain_lines, plain_statistics

import corpus_pipeline
from lodestar.llm import decontaminate, quality, sentencepiece_lattice
from lodestar.llm.common import table
from lodestar.llm.queries import oracle_sql, queries, tokenizer_path

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, SF, "documents")
    columns = docs.columns
    forest = quality.fit_forest(docs, table(spark, SF, "labels"))
    stages = dict(corpus_pipeline.STAGES)
    items = [(r["doc_id"], r["text"]) for r in docs.collect()]

    verdict = {r["doc_id"]: r["kept"] for r in quality.score_documents(docs, forest).collect()}
    items = [(i, t) for i, t in items if plain_statistics(t)[0] >= 10 and verdict[i]]
    docs = corpus_pipeline.materialise(stages["quality rules"](spark, docs, SF), "t")
    assert docs.columns == columns and sorted((r["doc_id"], r["text"]) for r in docs.collect()) == sorted(items)

    items = [(i, t) for i, t, n, gone in plain_lines(items) if gone < n or not n]
    docs = corpus_pipeline.materialise(stages["line dedup"](spark, docs, SF), "t")
    assert docs.columns == columns and sorted((r["doc_id"], r["text"]) for r in docs.collect()) == sorted(items)

    linked = plain_components(items)
    items = [(i, t) for i, t in items if linked[i][1] == i]
    docs = corpus_pipeline.materialise(stages["n-gram Jaccard join"](spark, docs, SF), "t")
    assert docs.columns == columns and sorted(r["doc_id"] for r in docs.collect()) == sorted(i for i, _ in items)

    forms = [decontaminate.normal(r["text"]) for r in table(spark, SF, "benchmark").collect()]
    texts = {i: decontaminate.normal(t) for i, t in items}

    def near(f, t):  # the full distance only where a tenth of the item is there
        return any(f[k : k + len(f) // 10] in t for k in range(0, len(f) - len(f) // 10, 5)) and plain_distance(f, t) <= int(decontaminate.RATE * len(f))

    items = [(i, t) for i, t in items if not any(near(f, texts[i]) for f in forms)]
    docs = corpus_pipeline.materialise(stages["benchmark decontamination"](spark, docs, SF), "t")
    assert docs.columns == columns and sorted(r["doc_id"] for r in docs.collect()) == sorted(i for i, _ in items)

    v = sentencepiece_lattice.Vocabulary.load(tokenizer_path("piece_bpe_32k.model"))
    last = {r["doc_id"]: r["ids"] for r in stages["SentencePiece encoding"](spark, docs, SF).collect()}
    few = sorted(items, key=lambda x: len(x[1]))[:40]
    assert set(last) == {i for i, _ in items} and all(last[i] == plain_encoding(v, t) for i, t in few)


def test_registry():
    names = queries()
    assert {int(re.match(r"op(\d+)_", n)[1]) for n in names} == set(range(1, 14)) and len(names) == 13
    assert set(oracle_sql()) <= set(names)


def write_tables(spark, path, documents, labels=(), benchmark=()):
    columns = "doc_id long, text string, lang string, source string, n_chars long, size string, fp string, kept boolean, rows binary, id string"
    spark.createDataFrame([(i, t, "en", "s", len(t or ""), "size", "fp", False, b"r", "id") for i, t in documents], columns).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(list(benchmark), "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_run_equals_its_stages(spark):
    docs = table(spark, SF, "documents")
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialise(stage(spark, docs, SF), "t")
    want = sorted((r["doc_id"], r["n_tokens"], r["ids_crc32"], r["text_md5"]) for r in docs.collect())
    assert want and sorted((r["doc_id"], r["n_tokens"], r["ids_crc32"], r["text_md5"]) for r in corpus_pipeline.run(spark, SF).collect()) == want


def test_odd_rows_and_clashing_columns(spark, tmp_path):
    own = " ".join(f"word{i} in a text" for i in range(12))
    other = " ".join(f"other{i} lines stand here" for i in range(12))
    leaked = "a passage of the benchmark that somebody has copied into a document of the corpus"
    documents = [(1, own), (1, own), (2, None), (3, ""), (4, " \n "), (5, other), (6, other + " more"), (None, " ".join(f"nobody{i} is here" for i in range(9))), (7, f"{' '.join(f'filler{i} of words' for i in range(9))} {leaked}"), (8, "w" * 200_000 + " " + " ".join(f"long{i} words" for i in range(20)))]
    path = write_tables(spark, str(tmp_path), documents, [(1, 1, 0), (None, 0, 1), (4, None, None)], [(0, leaked), (1, None), (None, "")])
    docs = table(spark, path, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = corpus_pipeline.materialise(stage(spark, docs, path), "t")
        assert after.columns == docs.columns and all(r["size"] == "size" and r["fp"] == "fp" and r["rows"] == b"r" and r["id"] == "id" for r in after.collect())
        if name != "quality rules":  # each stage by itself keeps what has no words
            assert {2, 3, 4} <= {r["doc_id"] for r in stage(spark, table(spark, path, "documents"), path).collect()}
        docs = after
    got = corpus_pipeline.run(spark, path).collect()
    assert sorted((r["doc_id"] for r in got), key=repr) == sorted([1, 1, 5, None, 8], key=repr)
    texts = {i: t for i, t in documents}
    assert all(r["text_md5"] == hashlib.md5(texts[r["doc_id"]].encode()).hexdigest() for r in got)


def test_empty_tables(spark, tmp_path):
    path = write_tables(spark, str(tmp_path), [])
    assert corpus_pipeline.run(spark, path).count() == 0


def test_line_dedup_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = con.sql(oracle_sql()["op1_line_dedup"]).fetchall()
    got = [(r["doc_id"], r["text"], r["n_lines"], r["n_removed"]) for r in queries()["op1_line_dedup"](spark, SF).select("doc_id", "text", "n_lines", "n_removed").collect()]
    assert sorted(got) == sorted(want)
