"""Quality rules: text statistics, two fixed rules, and an isolation forest over the statistics.

`statistics` counts everything over whole texts.  `fit_forest` takes random-split trees, counts in all good rows how
many pass each node, and calibrates the score above which a document is an anomaly on all labelled rows: the cut with
the best balanced accuracy among those that reject at most `max_false` of the good rows.  `apply_rules` scores every
document.

Defined results: null or empty text has zero words and fails the first rule; rows with equal text get equal verdicts,
so repeated rows and ties don't matter; a null id is kept as it is; without labels (an empty table) no
document is an anomaly and only the fixed rules act; extra columns are ignored here and kept by `filter_documents`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.shared import discard, keep

from . import textvec as tv
from .common import give_back, pieces

#: Scores that the cut tells apart, and the features of a row.
BINS, DIMS = 100_000, 6
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Statistics beside the contract's own, for the forest only.
MORE = ("n_chars", "n_lines", "n_upper", "n_punct", "n_bars", "n_digits", "n_sentence_ends")


def _per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def _table(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


SYMBOLS = _table(b"#*$%&|<>")
UPPER = _table(bytes(range(65, 91)))
PUNCT = _table(b"!?;:,.\"'()[]{}-_=+/\\^~`@")
BARS = _table(b"|!")
DIGITS = _table(b"0123456789")
STOPS = _table(b".!?")


def statistics(raw: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """BASE and MORE for each text of one run of texts."""
    n = len(offsets) - 1
    heads = (raw & 0xC0) != 0x80
    solid = ~tv.SPACE[raw]
    starts, _, own, hashes = tv.words(raw, offsets)
    out = {"n_words": np.bincount(own, minlength=n), "word_chars": _per_text(heads & solid, offsets)}
    out["n_symbols"] = _per_text(SYMBOLS[raw], offsets)

    body = raw != 10
    lo, hi = tv.runs(body, offsets)
    filled = np.add.reduceat(solid.astype(np.int64), lo)[: len(lo)] > 0 if len(lo) else np.empty(0, bool)
    if len(lo):  # reduceat runs to the next start; what lies between is only line ends
        line_own = tv.owner(lo, offsets)
        line_hash = tv.in_text(tv.span_hash(raw, body, lo, hi), line_own)[filled]
        line_own = line_own[filled]
    else:
        line_own, line_hash = np.empty(0, np.int64), np.empty(0, tv.U)
    order = np.argsort(line_hash, kind="stable")
    same = np.zeros(len(order), bool)
    same[1:] = line_hash[order][1:] == line_hash[order][:-1]
    out["n_dup_lines"] = np.bincount(line_own[order][same], minlength=n)

    gram, at = tv.grams(hashes, own, 5)
    gram = tv.in_text(gram, own[at])
    order = np.argsort(gram, kind="stable")
    twice = np.zeros(len(order), bool)
    if len(order) > 1:
        eq = gram[order][1:] == gram[order][:-1]
        twice[1:] |= eq
        twice[:-1] |= eq
    step = np.zeros(len(own) + 5, np.int64)
    np.add.at(step, at[order][twice], 1)
    np.add.at(step, at[order][twice] + 5, -1)
    out["n_repeat_words"] = np.bincount(own[np.cumsum(step)[: len(own)] > 0], minlength=n)

    out["n_chars"] = _per_text(heads, offsets)
    out["n_lines"] = np.bincount(line_own, minlength=n)
    for name, chars in (("n_upper", UPPER), ("n_punct", PUNCT), ("n_bars", BARS), ("n_digits", DIGITS), ("n_sentence_ends", STOPS)):
        out[name] = _per_text(chars[raw], offsets)
    return {k: v.astype(np.int64) for k, v in out.items()}


def features(s: dict[str, np.ndarray]) -> np.ndarray:
    """Rule statistics as shares from 0 to 1 that don't grow with a text's length, a row for each text."""
    words, chars = np.maximum(s["n_words"], 1), np.maximum(s["n_chars"], 1)
    return np.minimum(1, np.column_stack([
        s["word_chars"] / words / 25,
        s["n_symbols"] / words,
        s["n_dup_lines"] / np.maximum(s["n_lines"], 1),
        s["n_repeat_words"] / words,
        s["n_upper"] / chars * 2,
        s["n_bars"] / words,
    ]))


@dataclass
class Forest:
    """Isolation trees as arrays: split feature, split value, left child (right is left + 1), path length at leaves."""

    feature: np.ndarray
    value: np.ndarray
    left: np.ndarray
    length: np.ndarray
    depth: int
    norm: float
    cut: float = np.inf

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for t in range(len(self.feature)):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                f = self.feature[t][node]
                inner = f >= 0
                right = x[rows, np.maximum(f, 0)] >= self.value[t][node]
                node = np.where(inner, self.left[t][node] + right, node)
            total += self.length[t][node]
        return 2.0 ** (-total / len(self.feature) / self.norm)


def _expected(n: int) -> float:
    """Mean path length of an unsuccessful search among n points."""
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


def plan(dims: int, trees: int = 128, depth: int = 10, seed: int = 11) -> Forest:
    """Random splits over each node's box, not over its points' range: a split through an empty part of the box cuts
    off a leaf without points at once, so values that no fitted row has get short paths.  The splits need no rows; the
    node i has the children 2 i + 1 and 2 i + 2."""
    rng = np.random.default_rng(seed)
    nodes = 2 ** (depth + 1) - 1
    feature, value = np.full((trees, nodes), -1), np.zeros((trees, nodes))
    left = np.broadcast_to(2 * np.arange(nodes) + 1, (trees, nodes)).copy()
    low, high = np.zeros((trees, 1, dims)), np.ones((trees, 1, dims))
    for level in range(depth):
        f = rng.integers(dims, size=low.shape[:2])
        at = f[..., None]
        lo, hi = np.take_along_axis(low, at, 2), np.take_along_axis(high, at, 2)
        v = lo + rng.random(lo.shape) * (hi - lo)
        here = slice(2**level - 1, 2 ** (level + 1) - 1)
        feature[:, here], value[:, here] = f, v[..., 0]
        below, above = high.copy(), low.copy()
        np.put_along_axis(below, at, v, 2)
        np.put_along_axis(above, at, v, 2)
        low = np.stack([low, above], 2).reshape(trees, -1, dims)
        high = np.stack([below, high], 2).reshape(trees, -1, dims)
    return Forest(feature, value, left, np.zeros((trees, nodes)), depth, 1.0)


def reached(forest: Forest, x: np.ndarray) -> np.ndarray:
    """How many rows pass each node of a planned forest."""
    out = np.zeros(forest.feature.shape, np.int64)
    rows = np.arange(len(x))
    for t in range(len(out)):
        node = np.zeros(len(x), np.int64)
        out[t, 0] = len(x)
        for _ in range(forest.depth):
            node = forest.left[t][node] + (x[rows, forest.feature[t][node]] >= forest.value[t][node])
            out[t] += np.bincount(node, minlength=out.shape[1])
    return out


def settle(forest: Forest, counts: np.ndarray, size: int = 256) -> Forest:
    """The planned forest with its leaves: nodes that at most one of `size` rows passes, as the share of all rows says."""
    n = max(1, int(counts[0, 0]))
    size = min(size, n)
    share = np.rint(counts * (size / n)).astype(np.int64)
    level = np.frexp(np.arange(counts.shape[1]) + 1.0)[1] - 1
    ends = (share <= 1) | (level == forest.depth)[None, :]
    rest = np.array([_expected(k) for k in range(size + 1)])[share]
    return Forest(np.where(ends, -1, forest.feature), forest.value, forest.left, np.where(ends, level[None, :] + rest, 0.0), forest.depth, max(_expected(size), 1.0))


def grow(x: np.ndarray, trees: int = 128, size: int = 256, depth: int = 10, seed: int = 11) -> Forest:
    planned = plan(x.shape[1], trees, depth, seed)
    return settle(planned, reached(planned, x), size)


def best_cut(bins: np.ndarray, good: np.ndarray, bad: np.ndarray, max_false: float = 0.02) -> float:
    """The cut between two bins of scores, ascending, with their numbers of good and bad rows; inf (nothing is an
    anomaly) without rows of both kinds."""
    if not good.sum() or not bad.sum():
        return np.inf
    cuts = np.append((bins[1:] + bins[:-1]) / 2, np.inf) / BINS
    false = 1 - np.cumsum(good) / good.sum()
    hit = 1 - np.cumsum(bad) / bad.sum()
    return float(cuts[int(np.argmax(np.where(false <= max_false, hit - 2 * false, -3)))])


def _bin(score: np.ndarray) -> np.ndarray:
    return np.floor(score * BINS).astype(np.int64)


def calibrate(forest: Forest, x: np.ndarray, good: np.ndarray, max_false: float = 0.02) -> Forest:
    """Set the cut by labelled rows."""
    bins, at = np.unique(_bin(forest.score(x)), return_inverse=True)
    forest.cut = best_cut(bins + 0.5, np.bincount(at[good], minlength=len(bins)), np.bincount(at[~good], minlength=len(bins)), max_false)
    return forest


def base_failed(s: dict[str, np.ndarray]) -> np.ndarray:
    return (s["n_words"] < 10) | (100 * s["n_repeat_words"] > 20 * s["n_words"])


def _stat_batches(batches: Iterator[pa.RecordBatch], id_col: str, text_col: str, forest: Forest | None, keep: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, raw, offsets in pieces(batch, text_col):
            s = statistics(raw, offsets)
            failed = base_failed(s)
            score = np.zeros(hi - lo)
            kept = ~failed
            if forest is not None:
                score = forest.score(features(s))
                kept &= score < forest.cut
            part = batch.slice(lo, hi - lo)
            cols = {c: part.column(part.schema.get_field_index(c)) for c in keep}
            cols |= {k: pa.array(s[k]) for k in BASE + MORE}
            cols |= {"base_failed": pa.array(failed), "anomaly_score": pa.array(score), "kept": pa.array(kept)}
            yield pa.RecordBatch.from_pydict(cols)
    give_back()


STATS = ", ".join(f"{c} long" for c in BASE + MORE) + ", base_failed boolean, anomaly_score double, kept boolean"


def score_documents(docs: DataFrame, forest: Forest | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, statistics, base_failed, anomaly_score and kept for every document, in one pass without a shuffle."""
    kind = dict(docs.dtypes)[id_col]
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(
        lambda it: _stat_batches(it, id_col, text_col, forest, [id_col]), f"`{id_col}` {kind}, {STATS}"
    )


def _fit(stats: DataFrame, labels: DataFrame) -> Forest | None:
    """The forest over all good rows of a table of statistics, its cut by all labelled rows that pass the fixed rules.

    Splits are planned beforehand, so each task counts the rows that pass each node, and counts add up; the cut comes
    from the numbers of good and bad rows at each of BINS scores.  Only labels and statistics are joined, no texts."""
    own = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.max(F.col("quality").cast("int")).alias("__label"))
    rows = keep(stats.where("not base_failed").select("doc_id", *BASE, *MORE).distinct().join(own, "doc_id").drop("doc_id"), "labelled")
    planned = plan(DIMS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for batch in batches:
            total = total + reached(planned, _matrix(batch))
        if not np.isscalar(total):
            at = np.flatnonzero(total)
            yield pa.record_batch([pa.array(at), pa.array(total.ravel()[at])], names=["node", "n"])

    found = rows.where("__label = 1").mapInArrow(count, "node long, n long").groupBy("node").agg(F.sum("n")).collect()  # 128 trees of 2,047 nodes at most
    if not found:
        discard(rows)
        return None
    counts = np.zeros(planned.feature.size, np.int64)
    counts[[r[0] for r in found]] = [r[1] for r in found]
    forest = settle(planned, counts.reshape(planned.feature.shape))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([pa.array(_bin(forest.score(_matrix(batch)))), pa.array(batch.column("__label").to_numpy() == 1)], names=["bin", "good"])

    binned = rows.mapInArrow(score, "bin long, good boolean").groupBy("bin").agg(F.count_if("good"), F.count_if(~F.col("good"))).orderBy("bin").collect()  # BINS rows at most
    bins, good, bad = np.array(binned, np.float64).reshape(-1, 3).T
    forest.cut = best_cut(bins + 0.5, good, bad)
    discard(rows)
    return forest


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return features({c: batch.column(c).to_numpy() for c in BASE + MORE})


def fit_forest(docs: DataFrame, labels: DataFrame) -> Forest | None:
    """None without good rows."""
    return _fit(score_documents(docs, None), labels)


def apply_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """score_documents by a forest over these documents; texts are read once, for statistics that are kept."""
    stats = keep(score_documents(docs, None), "statistics")
    forest = _fit(stats, labels)
    if forest is None:
        return stats

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = forest.score(_matrix(batch))
            told = {"anomaly_score": pa.array(score), "kept": pa.array(~batch.column("base_failed").to_numpy(zero_copy_only=False) & (score < forest.cut))}
            yield pa.RecordBatch.from_pydict({c: told.get(c, batch.column(c)) for c in batch.schema.names})

    return stats.mapInArrow(judge, stats.schema)


def filter_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs whose text is kept, all columns as they were."""
    forest = fit_forest(docs, labels)

    def kept_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, raw, offsets in pieces(batch, "text"):
                s = statistics(raw, offsets)
                kept = ~base_failed(s)
                if forest is not None:
                    kept &= forest.score(features(s)) < forest.cut
                yield batch.slice(lo, hi - lo).filter(pa.array(kept))
        give_back()

    return docs.mapInArrow(kept_rows, docs.schema)
