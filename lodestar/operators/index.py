"""A vector index of product-quantised codes with exact re-ranking.

`build` fits centroids of lists and, for the residuals, codebooks of PART dimensions each (k-means over a bounded
sample), and keeps two tables: `codes` (list, id, one byte for each codebook, and how far the decoded vector lies from
the true one) and `rows` (the vectors themselves).  `search` reads the codes alone: the decoded distance less that error
is a bound from below, with it one from above, so of each query only rows whose lower bound does not exceed its k-th
upper bound are looked up in `rows` and compared exactly.  Results are those of a full scan; with `probes` only the
lists nearest to a query are looked into.  Jegou et al., "Product Quantization for Nearest Neighbor Search" (2011).

Queries are taken in groups of GROUP bytes; a group is sent to all tasks and the codes are read once for it.  A task
holds the group's best bounds and HELD rows that these still allow; more are given away, and fall by the bounds of all
tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.functions import vector
from lodestar.shared import keep

#: Rows that centroids and codebooks are fitted on, at most.
SAMPLE = 20_000
#: Dimensions of a codebook, and its entries.
PART, WORDS = 2, 256
#: Slack of the bounds: distances are rounded.
SLACK = 1e-6
#: Bytes of a group of queries as single-precision vectors.
GROUP = 8 << 20
#: Candidates that a task holds before it drops those that later bounds rule out and gives the others away, and pairs
#: of a query and a row that it looks at together.
HELD, LOOKED = 1 << 18, 1 << 20


@dataclass(frozen=True)
class Index:
    """rows: id, v (of length 1) and the other columns; codes: list, id, code, error; both are tables.  centroids: a row
    for each list; books: (codebooks, entries, PART), of dimensions padded with zeros."""

    rows: DataFrame
    codes: DataFrame
    centroids: np.ndarray
    books: np.ndarray
    id_col: str = "id"


def _kmeans(x: np.ndarray, k: int, seed: int, rounds: int = 10) -> np.ndarray:
    """Lloyd's rounds over a sample; an entry that nothing is nearest to moves to the row that is worst served."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near, gap = _nearest(x, c)
        n = np.bincount(near, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
        empty = np.flatnonzero(n == 0)
        c[empty] = x[np.argsort(-gap, kind="stable")[: len(empty)]]
    return c


def _nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest of c to each row of x, and the squared distance."""
    near, gap = np.empty(len(x), np.int64), np.empty(len(x))
    for lo in range(0, len(x), 4096):
        d = (c**2).sum(1) - 2 * (x[lo : lo + 4096] @ c.T)
        near[lo : lo + 4096] = d.argmin(1)
        gap[lo : lo + 4096] = d.min(1) + (x[lo : lo + 4096] ** 2).sum(1)
    return near, gap


def _parts(x: np.ndarray) -> np.ndarray:
    """(rows, codebooks, PART): dimensions in groups, the last filled up with zeros."""
    return np.pad(x, ((0, 0), (0, -x.shape[1] % PART))).reshape(len(x), -1, PART)


def _decoded(centroids: np.ndarray, books: np.ndarray, lists: np.ndarray, codes: np.ndarray) -> np.ndarray:
    rest = books[np.arange(len(books))[None, :], codes].reshape(len(codes), -1)
    return centroids[lists] + rest[:, : centroids.shape[1]]


def _stack(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _unit(rows: DataFrame, vec_col: str) -> DataFrame:
    """Rows that have a vector of a length above 0, as `v` of length 1."""
    usable = F.col(vec_col).isNotNull() & (vector.norm(F.col(vec_col)) > 0)
    size = vector.norm(F.col(vec_col))
    return rows.where(usable).withColumn("v", F.transform(vec_col, lambda x: x.cast("double") / size)).drop(vec_col)


def build(rows: DataFrame, n_lists: int = 64, id_col: str = "id", vec_col: str = "embedding", sample: int = SAMPLE, seed: int = 7) -> Index:
    """Rows without a vector, or with one of length 0, aren't found by cosine and don't enter."""
    spark = rows.sparkSession
    own = keep(_unit(rows, vec_col), "index-rows")
    fit = np.array([r[0] for r in own.select("v").orderBy(F.xxhash64(id_col), id_col).limit(sample).collect()], np.float64)
    if not len(fit):
        return Index(own, spark.createDataFrame([], f"list int, {id_col} {dict(own.dtypes)[id_col]}, code binary, error double"), np.zeros((1, 1)), np.zeros((1, 1, PART)), id_col)
    centroids = _kmeans(fit, n_lists, seed)
    shared = spark.sparkContext.broadcast(_parts(fit - centroids[_nearest(fit, centroids)[0]]))

    def train(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for part in frame["id"]:
                book = _kmeans(shared.value[:, part], WORDS, seed + int(part))
                yield pd.DataFrame({"part": [part], "book": [book.ravel().tolist()]})

    m = shared.value.shape[1]
    found = spark.range(0, m, 1, m).mapInPandas(train, "part long, book array<double>").collect()  # m small codebooks
    books = np.zeros((m, min(WORDS, len(fit)), PART))
    for r in found:
        books[r["part"]] = np.array(r["book"]).reshape(-1, PART)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            v = _stack(batch.column(1))
            lists = _nearest(v, centroids)[0]
            rest = _parts(v - centroids[lists])
            codes = np.stack([_nearest(rest[:, j], books[j])[0] for j in range(m)], axis=1).astype(np.uint8)
            error = np.linalg.norm(v - _decoded(centroids, books, lists, codes), axis=1)
            packed = pa.array(np.ascontiguousarray(codes).view(f"V{m}").ravel().tolist(), pa.binary())
            yield pa.record_batch([pa.array(lists.astype(np.int32)), batch.column(0), packed, pa.array(error)], names=["list", id_col, "code", "error"])

    kind = dict(own.dtypes)[id_col]
    coded = own.select(id_col, "v").mapInArrow(encode, f"list int, `{id_col}` {kind}, code binary, error double")
    return Index(own, keep(coded.sortWithinPartitions("list"), "index-codes"), centroids, books, id_col)


def write(index: Index, path: str) -> None:
    """Keep an index as three tables under a path."""
    index.rows.write.parquet(f"{path}/rows")
    index.codes.write.parquet(f"{path}/codes")
    model = [("centroids", list(index.centroids.shape), index.centroids.ravel().tolist()), ("books", list(index.books.shape), index.books.ravel().tolist())]
    index.rows.sparkSession.createDataFrame(model, "name string, shape array<long>, numbers array<double>").write.parquet(f"{path}/model")


def read(spark: SparkSession, path: str, id_col: str = "id") -> Index:
    model = {r["name"]: np.array(r["numbers"]).reshape(r["shape"]) for r in spark.read.parquet(f"{path}/model").collect()}
    return Index(spark.read.parquet(f"{path}/rows"), spark.read.parquet(f"{path}/codes"), model["centroids"], model["books"], id_col)


class _Best:
    """The k least upper bounds of each query, and the rows that they leave."""

    def __init__(self, n: int, k: int):
        self.upper = np.full((n, k), np.inf)
        self.parts: list[tuple] = []
        self.held = 0

    def add(self, low: np.ndarray, high: np.ndarray, ids: pa.Array, allowed: np.ndarray | None) -> None:
        """low, high: bounds by query and row."""
        if allowed is not None:
            high = np.where(allowed, high, np.inf)
            low = np.where(allowed, low, np.inf)
        k = self.upper.shape[1]
        both = np.hstack([self.upper, high])
        self.upper = np.partition(both, k - 1, axis=1)[:, :k]
        q, at = np.nonzero((low <= self.worst()[:, None]) & np.isfinite(low))
        self.parts.append((q, ids.take(pa.array(at)), low[q, at], high[q, at]))
        self.held += len(q)

    def worst(self) -> np.ndarray:
        return self.upper.max(1) + SLACK

    def left(self) -> tuple:
        q, low, high = (np.concatenate([p[i] for p in self.parts]) for i in (0, 2, 3))
        ids = pa.concat_arrays([p[1] for p in self.parts])
        at = np.flatnonzero(low <= self.worst()[q])
        return q[at], ids.take(pa.array(at)), low[at], high[at]

    def given(self, most: int) -> Iterator[tuple]:
        """What is left, if more than `most` rows are held, in pieces of HELD rows; it is held no longer."""
        if self.held <= most:
            return
        found = self.left()
        self.parts, self.held = [], 0
        for lo in range(0, len(found[0]), HELD):
            yield tuple(x[lo : lo + HELD] for x in found)


def candidates(index: Index, q: np.ndarray, k: int, probes: int | None = None) -> DataFrame:
    """(n, id): the rows that must be compared exactly with the n-th query; q: unit vectors as rows."""
    spark = index.rows.sparkSession
    near = None
    codes = index.codes
    if probes is not None and probes < len(index.centroids):
        away = (index.centroids**2).sum(1) - 2 * (q @ index.centroids.T)
        near = np.zeros(away.shape, bool)
        np.put_along_axis(near, np.argsort(away, axis=1, kind="stable")[:, :probes], True, axis=1)
        codes = codes.where(F.col("list").isin(np.flatnonzero(near.any(0)).tolist()))
    shared = spark.sparkContext.broadcast((q, near, index.centroids, index.books))
    id_col, kind = index.id_col, dict(index.codes.dtypes)[index.id_col]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, near, centroids, books = shared.value
        best, step = _Best(len(q), k), max(1, LOOKED // max(1, len(q)))
        m = len(books)
        for batch in batches:
            for lo in range(0, batch.num_rows, step):
                part = batch.slice(lo, step)
                lists = part.column(0).to_numpy()
                raw = np.frombuffer(b"".join(part.column(2).to_pylist()), np.uint8).reshape(-1, m)
                v = _decoded(centroids, books, lists, raw)
                away = np.sqrt(np.maximum(0, 1 + (v**2).sum(1)[None, :] - 2 * (q @ v.T)))
                error = part.column(3).to_numpy()[None, :]
                best.add(away - error, away + error, part.column(1), near[:, lists] if near is not None else None)
                yield from map(packed, best.given(HELD))
        yield from map(packed, best.given(0))

    def packed(found: tuple) -> pa.RecordBatch:
        at, ids, low, high = found
        return pa.record_batch([pa.array(at), ids, pa.array(low), pa.array(high)], names=["n", id_col, "low", "high"])

    found = codes.select("list", id_col, "code", "error").mapInArrow(scan, f"n long, `{id_col}` {kind}, low double, high double")
    each = Window.partitionBy("n")
    found = found.withColumn("place", F.row_number().over(each.orderBy("high")))
    found = found.withColumn("worst", F.max(F.when(F.col("place") <= k, F.col("high"))).over(each))
    return found.where(F.col("low") <= F.col("worst") + 2 * SLACK).select("n", id_col)


def search(index: Index, queries: DataFrame, k: int = 8, probes: int = 4, exact: bool = True, query_id: str = "query_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, id, similarity, rank) of the k rows nearest to each query (query_id, embedding); ties go to the lower id.

    exact: over all lists; otherwise over each query's `probes` nearest ones."""
    id_col = index.id_col
    kind = dict(index.rows.dtypes)[id_col]
    own = keep(_unit(queries.select(query_id, vec_col), vec_col), "queries")
    per = max(1, GROUP // (4 * index.centroids.shape[1]))
    n_groups = -(-own.count() // per)
    out = None
    for g in range(n_groups):
        mine = own if n_groups == 1 else own.where(F.pmod(F.xxhash64(query_id), F.lit(n_groups)) == g)
        rows = mine.collect()  # about GROUP bytes
        if not rows:
            continue
        q = np.array([r["v"] for r in rows], np.float64)
        names = mine.sparkSession.createDataFrame([(i, r[query_id]) for i, r in enumerate(rows)], f"n long, {query_id} {dict(own.dtypes)[query_id]}")
        shared = mine.sparkSession.sparkContext.broadcast(q)

        def compare(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    sim = np.einsum("ij,ij->i", shared.value[batch.column(0).to_numpy()], _stack(batch.column(2)))
                    yield pa.record_batch([batch.column(0), batch.column(1), pa.array(sim)], names=["n", id_col, "similarity"])

        met = candidates(index, q, k, None if exact else probes).join(index.rows.select(id_col, "v"), id_col).select("n", id_col, "v")
        met = met.mapInArrow(compare, f"n long, `{id_col}` {kind}, similarity double")
        rank = F.row_number().over(Window.partitionBy("n").orderBy(F.desc("similarity"), id_col))
        met = met.withColumn("rank", rank).where(F.col("rank") <= k).join(F.broadcast(names), "n")
        out = met if out is None else out.unionByName(met)
    if out is None:
        schema = f"{query_id} {dict(own.dtypes)[query_id]}, {id_col} {kind}, similarity double, rank int"
        return queries.sparkSession.createDataFrame([], schema)
    return out.select(query_id, id_col, "similarity", "rank")


def recall(found: DataFrame, truth: DataFrame, query_id: str = "query_id", id_col: str = "id") -> float:
    """Share of the true neighbours that were found."""
    hit = truth.select(query_id, id_col).join(found.select(query_id, id_col).distinct(), [query_id, id_col], "left_semi").count()
    return hit / max(1, truth.count())
