"""Importance resampling towards a target distribution: hashed features weigh a document, noise by its id makes the
draw, and a parallel sort gives the drawn documents their exact ranks.

Features are the runs of one to `ngram` consecutive words, hashed into buckets.  Counts of the buckets over all
documents and all target texts give each bucket a gain (an array), and a document's weight is the sum of the gains of
its features.  With noise of the Gumbel law added, the highest scores are a draw without replacement.

Ranks come from parallel sorting by regular sampling.  Each task sorts its rows into a run and writes it; every step-th
row of each run is a regular sample; equidistant samples are the splitters; runs are cut at the splitters and counted,
prefix counts give each segment its first rank, and the segments that reach into the draw are exchanged, merged where
they arrive, and numbered.  Rows below the draw are never exchanged.  Shi and Schaeffer (1992).

Bounds: the driver holds one count for each bucket and MOST_SAMPLES keys.  Equal keys are told apart by their place in
the runs, so no segment is larger than a share of the rows plus a step for each run, whatever ties there are.

Defined results: null and empty texts have no features and weight 0; a null id is hashed as an empty one and comes
behind other ids in ties; rows that share an id are separate documents, with ties by the number of features and then
in any order; no documents give no rows; a target without texts gives gains all the same; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import give_back, materialise, pieces, shuffle_width
from .spans import crc32_spans, words_joined

#: Keys that the driver chooses the splitters from, at most.
MOST_SAMPLES = 200_000
#: Samples of each segment, at least (as far as MOST_SAMPLES goes).
OVERSAMPLE = 64
RUN_BITS = 33


def _features(batch: pa.RecordBatch, column: str, ngram: int, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bucket of every feature, features of each row) for runs of rows; features of a row stand together."""
    for lo, hi, raw, offsets in pieces(batch, column):
        joined, starts, ends, own = words_joined(raw, offsets)
        found, rows = [], []
        for n in range(1, ngram + 1):
            first = np.flatnonzero(own[: len(own) - n + 1] == own[n - 1 :]) if len(own) >= n else np.empty(0, np.int64)
            found.append(crc32_spans(joined, starts[first], ends[first + n - 1]) % np.uint32(buckets))
            rows.append(own[first])
        bucket, row = np.concatenate(found).astype(np.int64), np.concatenate(rows)
        if ngram > 1:
            order = np.argsort(row, kind="stable")
            bucket, row = bucket[order], row[order]
        yield bucket, np.bincount(row, minlength=hi - lo)


def bucket_counts(texts: DataFrame, text_col: str = "text", ngram: int = 1, buckets: int = 10_000) -> np.ndarray:
    """Features of each bucket over all texts; every task adds up its own before anything is sent."""

    def count(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for bucket, _ in _features(batch, "t", ngram, buckets):
                total += np.bincount(bucket, minlength=buckets)
        give_back()
        at = np.flatnonzero(total)
        yield pa.record_batch({"bucket": pa.array(at), "n": pa.array(total[at])})

    rows = texts.select(F.col(text_col).alias("t")).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(buckets, np.int64)
    out[rows["bucket"].to_numpy()] = rows["n"].to_numpy()
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln((t + 1)(S + B) / ((s + 1)(T + B)))) of each of the B buckets."""
    b = len(source)
    ratio = (target + 1.0) * float(source.sum() + b) / ((source + 1.0) * float(target.sum() + b))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def weights(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text", ngram: int = 1) -> DataFrame:
    """id, n_features, weight."""

    def weigh(batches):
        for batch in batches:
            n, w = [], []
            for bucket, sizes in _features(batch, "t", ngram, len(gain)):
                ends = np.cumsum(sizes)
                sums = np.concatenate([[0], np.cumsum(gain[bucket])])
                n.append(sizes)
                w.append(sums[ends] - sums[ends - sizes])
            if n:
                yield pa.record_batch({id_col: batch.column(0), "n_features": pa.array(np.concatenate(n)), "weight": pa.array(np.concatenate(w))})
        give_back()

    own = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).alias("t"))
    return own.mapInArrow(weigh, f"{id_col} long, n_features long, weight long")


def noise(key: Column, seed: int = 2024) -> Column:
    """Gumbel noise in thousandths, from the first 32 bits of sha256(seed:key)."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def _segments(keys: list[np.ndarray], splitters: list[np.ndarray]) -> np.ndarray:
    """Number of splitters that aren't above each row, by binary search over the keys in their order."""
    lo = np.zeros(len(keys[0]), np.int64)
    hi = np.full(len(keys[0]), len(splitters[0]), np.int64)
    while len(lo) and (open_ := lo < hi).any():
        mid = np.where(open_, (lo + hi) // 2, 0)
        above, same = np.zeros(len(lo), bool), np.ones(len(lo), bool)  # the splitter against the row
        for k, s in zip(keys, splitters, strict=True):
            v = s[mid]
            above |= same & (v > k)
            same &= v == k
        hi = np.where(open_ & above, mid, hi)
        lo = np.where(open_ & ~above, mid + 1, lo)
    return lo


ORDER = ("k0", "k1", "k2", "k3", "run", "at")


def ranked(rows: DataFrame, takes_part: Column, order: list[Column], share: int) -> DataFrame:
    """rows and `rank`: 1, 2, 3... by `order` (up to four whole numbers, ascending) for the first share percent of the
    rows that take part, null for the others."""
    spark = rows.sparkSession
    width = shuffle_width(spark)
    order = [*order, *[F.lit(0)] * (4 - len(order))]
    own = rows.withColumns({f"k{i}": c.cast("long") for i, c in enumerate(order)}).withColumn("part", F.coalesce(takes_part, F.lit(False)))
    own = own.sortWithinPartitions(F.desc("part"), *(f"k{i}" for i in range(4)))
    place = F.monotonically_increasing_id()
    runs = materialise(own.withColumns({"run": F.shiftright(place, RUN_BITS), "at": place.bitwiseAND((1 << RUN_BITS) - 1)}), "runs")
    taking = runs.where("part")
    n, n_runs = taking.agg(F.count("*"), F.count_distinct("run")).first()
    drawn = n * share // 100
    plain = [F.col(c) for c in rows.columns]
    if not drawn:
        return runs.select(*plain, F.lit(None).cast("long").alias("rank"))
    step = max(1, n // min(MOST_SAMPLES, max(OVERSAMPLE, n_runs) * width))
    sample = taking.where(F.col("at") % step == 0).select(*ORDER).toArrow()
    sample = [sample[c].to_numpy() for c in ORDER]
    by = np.lexsort(sample[::-1])
    cuts = by[np.unique(np.arange(1, width) * len(by) // width)]
    splitters = [c[cuts] for c in sample]

    def cut(batches):
        for batch in batches:
            found = _segments([batch.column(c).to_numpy() for c in ORDER], splitters)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found.astype(np.int32))], [*batch.schema.names, "segment"])

    schema = ", ".join(f"`{c}` {t}" for c, t in taking.dtypes)
    segmented = taking.mapInArrow(cut, f"{schema}, segment int")
    sizes = dict(segmented.groupBy("segment").count().collect())  # a row for each segment
    firsts, before = [], 0
    for s in range(len(cuts) + 1):
        firsts.append((s, before))
        before += sizes.get(s, 0)
    last = max(s for s, first in firsts if first < drawn)
    first = F.broadcast(spark.createDataFrame(firsts[: last + 1], "segment int, first long"))  # a row for each segment

    def number(batches):
        at, seen = -1, 0
        for batch in batches:
            own = batch.column("segment").to_numpy()
            new = np.flatnonzero(np.concatenate([own[:1] != at, own[1:] != own[:-1]]))
            start = np.zeros(len(own), np.int64)  # rows of the same segment before this batch, less the place where it begins here
            start[:] = seen
            for a in new:
                start[a:] = -a
            place = np.arange(len(own)) + start + 1
            if len(own):
                at, seen = own[-1], int(place[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(place)], [*batch.schema.names, "place"])

    near = segmented.where(F.col("segment") <= last).repartitionById(last + 1, F.col("segment")).sortWithinPartitions("segment", *ORDER)
    merged = near.mapInArrow(number, f"{schema}, segment int, place long").join(first, "segment")
    rank = F.col("first") + F.col("place")
    above = merged.select(*plain, F.when(rank <= drawn, rank).alias("rank"))
    below = segmented.where(F.col("segment") > last).select(*plain, F.lit(None).cast("long").alias("rank"))
    return above.unionByName(below).unionByName(runs.where("not part").select(*plain, F.lit(None).cast("long").alias("rank")))


def resample(docs: DataFrame, target: DataFrame, share: int = 10, least: int = 20, ngram: int = 1, buckets: int = 10_000, seed: int = 2024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_features, weight, score, rank of every document; rank is null where it isn't drawn.

    share: percent of the documents of `least` words at least that is drawn."""
    gain = gains(bucket_counts(docs, text_col, ngram, buckets), bucket_counts(target, text_col, ngram, buckets))
    own = weights(docs, gain, id_col, text_col, ngram)
    own = own.withColumn("score", F.col("weight") + noise(F.col(id_col), seed))
    enough = sum(max(0, least - k) for k in range(ngram))  # features of a text of `least` words
    order = [-F.col("score"), F.col(id_col).isNull().cast("int"), F.coalesce(F.col(id_col), F.lit(0)), F.col("n_features")]
    return ranked(own, F.col("n_features") >= enough, order, share).select(id_col, "n_features", "weight", "score", "rank")


def draw(docs: DataFrame, target: DataFrame, share: int = 10, least: int = 20, ngram: int = 1, buckets: int = 10_000, seed: int = 2024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The drawn documents, with all their columns; rows that share a drawn id come along."""
    out = resample(docs, target, share, least, ngram, buckets, seed, id_col, text_col).where("rank is not null").select(F.col(id_col).alias("__drawn")).distinct()
    return docs.join(out, docs[id_col].cast("long").eqNullSafe(out["__drawn"]), "left_semi")


#: DuckDB: CRC-32 of a string, through the table of its 256 bytes; `t` is a table of one row with the list.
CRC_TABLE = """crc_table AS (
  SELECT list(list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) ORDER BY i) AS t
  FROM (SELECT i::BIGINT AS i FROM range(256) AS r(i)))"""


def crc_sql(text: str) -> str:
    """SQL of the CRC-32 of a string expression; `t` must be in scope."""
    codes = f"list_transform(range(octet_length(encode({text}))), lambda i: ('0x' || substr(hex(encode({text})), 2 * i + 1, 2))::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {codes}), lambda c, b: xor(c // 256, t[(xor(c, b) % 256) + 1])), 4294967295)"


SQL = f"""
WITH {CRC_TABLE},
w AS (
  SELECT 'd' AS side, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS word FROM documents
  UNION ALL
  SELECT 'b', NULL, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) FROM benchmark
),
v AS (SELECT word, {crc_sql("word")} % 10000 AS bucket FROM (SELECT DISTINCT word FROM w), crc_table),
c AS (SELECT bucket, count(*) FILTER (WHERE side = 'd') AS s, count(*) FILTER (WHERE side = 'b') AS t FROM w JOIN v USING (word) GROUP BY bucket),
n AS (SELECT sum(s)::DOUBLE AS s_all, sum(t)::DOUBLE AS t_all FROM c),
g AS (SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (s_all + 10000) / ((s + 1)::DOUBLE * (t_all + 10000))))::BIGINT AS gain FROM c, n),
d AS (SELECT doc_id, count(*) AS n_features, sum(gain)::BIGINT AS weight FROM w JOIN v USING (word) JOIN g USING (bucket) WHERE side = 'd' GROUP BY doc_id),
e AS (SELECT doc_id, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
             ('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT AS h FROM documents LEFT JOIN d USING (doc_id)),
f AS (SELECT doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5) / 4294967296)))::BIGINT AS score FROM e),
r AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS k, count(*) OVER (PARTITION BY n_features >= 20) AS n FROM f)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND k <= 10 * n // 100 THEN k END AS rank FROM r
"""
