import datetime
import itertools
import random

import numpy as np
import pyarrow as pa

from lodestar.operators import dedup, index
from lodestar.plans import vectors
from lodestar.streaming import pipelines, stateful


def test_pairs_of_a_large_key_are_dealt_out_and_never_gathered(spark, monkeypatch):
    rng = random.Random(4)
    prints = {0x1234 << 48 | rng.getrandbits(8) << 20 | rng.getrandbits(6) for _ in range(300)}
    rows = spark.createDataFrame(list(enumerate(sorted(prints))), "doc_id long, simhash long")
    monkeypatch.setattr(dedup, "TILE", 16)
    monkeypatch.setattr(dedup, "PAIRS", 1000)
    own = dedup.near_prints(rows, 4, [], ["doc_id"])
    want = {(x, y) for x, y in itertools.combinations(sorted(prints), 2) if (x ^ y).bit_count() <= 4}
    got = [(r["simhash"], r["simhash2"]) for r in own.collect()]
    assert set(got) == want and len(got) == len(want)
    plan = own._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=merge" in plan  # the keys of all rows aren't broadcast, small as the table is that they come from
    assert own.select("simhash").rdd.getNumPartitions() > 4


def test_a_task_that_has_ended_does_not_expire_by_an_older_update_that_comes_later(spark, tmp_path):
    at = lambda h: datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=h)
    schema = "task_id long, status string, error_message string, updated_at timestamp"
    parts = [[(1, "completed", None, at(5)), (2, "uploading", None, at(4))], [(1, "uploading", None, at(3)), (2, "uploading", "slow", at(3))], [(3, "completed", None, at(60))]]
    with stateful.state_store(spark, idle=True):
        for part in parts:
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
            stream = pipelines.file_stream(spark, f"{tmp_path}/in", spark.createDataFrame([], schema).schema)
            tasks = stateful.expired(stream, 24, late="10 hours")
            out = pipelines.run_once(tasks, root=f"{tmp_path}/out")
    assert sorted(tuple(r) for r in out.collect()) == [(2, "failed", "expired")]


def test_stored_vectors_come_back_as_they_were(spark, tmp_path):
    near = [0.12335, 0.12345, 1.00005, -0.99995, 0.03125, 0.09375, -0.03125, -0.00001, 0.0, 1e-12, 3.5, 12345.678]
    rows = [(i, [float(np.float32(x)), 1.0, float(np.float32(-x))], 0) for i, x in enumerate(near)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r["vec_id"]: (r["first"], r["last"], r["n"]) for r in vectors.stored_vectors(spark, str(tmp_path)).collect()}
    assert got == {i: (f"{v[0]:.4f}", f"{v[2]:.4f}", 3) for i, v, _ in rows}


def test_a_task_of_the_index_holds_few_candidates(monkeypatch):
    monkeypatch.setattr(index, "HELD", 50)
    best, given = index._Best(4, 2), []
    low = np.zeros((4, 30))
    for lo in range(0, 300, 30):
        best.add(low, low + 1, pa.array(range(lo, lo + 30)), None)
        for found in best.given(50):
            assert len(found[0]) <= 50
            given += list(zip(found[0].tolist(), found[1].to_pylist(), strict=True))
        assert best.held <= 50
    given += [x for found in best.given(0) for x in zip(found[0].tolist(), found[1].to_pylist(), strict=True)]
    assert sorted(given) == [(q, i) for q in range(4) for i in range(300)]
