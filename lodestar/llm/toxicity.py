"""Toxicity: a weighted lexicon matched by Aho-Corasick over folded text, normalised by length, with exception phrases.

Folding lower-cases, maps homoglyphs and digit substitutions to letters and drops zero-width characters.  Lexicon
entries are word beginnings or whole words; entries and weights are learned from labelled texts by description
length (`learn_lexicon`), and a logistic curve over the weighted hits and the text's length turns them into a score.
A hit that lies inside an exception phrase doesn't count.

The fit reads at most `SAMPLE` labelled rows (lowest by hash of the id); scoring reads every whole text.

Defined results: null and empty texts have no hits and get the curve's value for none; equal texts get equal scores,
so ties and repeated rows are harmless; a null id is kept and is never held out; without labels of both kinds every
score is 0; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_array

#: Most labelled rows that the lexicon and the curve are fitted on.
SAMPLE = 8000

# Cyrillic and Greek letters that look like Latin ones, digits and signs used in their place, characters without width.
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "н": "h", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s"}
NO_WIDTH = "­​‌‍⁠﻿"
FOLD = str.maketrans(HOMOGLYPHS | DIGITS | dict.fromkeys(NO_WIDTH))
#: Phrases inside which a hit is harmless.
EXCEPTIONS = ("clown fish", "clownfish", "pond scum", "trash can", "trash bin", "sore loser", "worthless check")
WORD = re.compile(r"[^\W_]+")


def fold(text: str) -> str:
    """Full-width forms become ASCII too, as they are 0xFEE0 above it."""
    text = text.lower().translate(FOLD)
    if "！" <= max(text, default=""):
        text = "".join(chr(ord(c) - 0xFEE0) if "！" <= c <= "～" else c for c in text).lower().translate(FOLD)
    return text


@dataclass
class Lexicon:
    """Entries with weights ("$" at the end of an entry: a whole word) and the curve's coefficients."""

    weights: dict[str, float] = field(default_factory=dict)
    exceptions: tuple[str, ...] = EXCEPTIONS
    curve: tuple[float, ...] = ()
    mean: tuple[float, ...] = ()
    spread: tuple[float, ...] = ()


class Matcher:
    """The automaton of a lexicon; built once in each task."""

    def __init__(self, lexicon: Lexicon) -> None:
        import ahocorasick

        self.lexicon = lexicon
        found: dict[str, list] = {}
        for entry, weight in lexicon.weights.items():
            found.setdefault(entry.rstrip("$"), [0.0, 0.0, False])[1 if entry.endswith("$") else 0] = weight
        for phrase in lexicon.exceptions:
            found.setdefault(fold(phrase), [0.0, 0.0, False])[2] = True
        self.auto = ahocorasick.Automaton()
        for key, (start, whole, harmless) in found.items():
            self.auto.add_word(key, (len(key), start, whole, harmless))
        if found:
            self.auto.make_automaton()
        self.empty = not found

    def hits(self, text: str) -> tuple[float, int, int]:
        """Weighted hits, hits and words of a folded text."""
        n = len(text)
        if self.empty or not n:
            return 0.0, 0, len(text.split())
        at: dict[int, float] = {}
        safe: list[tuple[int, int]] = []
        for end, (size, start_weight, whole_weight, harmless) in self.auto.iter(text):
            lo = end - size + 1
            if lo and text[lo - 1].isalnum():
                continue
            closed = end + 1 >= n or not text[end + 1].isalnum()
            if harmless and closed:
                safe.append((lo, end))
            weight = whole_weight if closed and whole_weight else start_weight
            if weight and weight > at.get(lo, 0.0):
                at[lo] = weight
        for lo, hi in safe:
            for k in [k for k in at if lo <= k <= hi] if at else ():
                del at[k]
        return sum(at.values()), len(at), len(text.split())

    def features(self, text: str) -> tuple[float, float, float]:
        weight, hits, words = self.hits(fold(text))
        return np.log1p(weight), np.log1p(100.0 * weight / (words + 20)), np.log1p(hits)

    def score(self, x: np.ndarray) -> np.ndarray:
        c = self.lexicon
        if not c.curve:
            return np.zeros(len(x))
        z = (x - np.array(c.mean)) / np.array(c.spread)
        return 1 / (1 + np.exp(-np.clip(c.curve[0] + z @ np.array(c.curve[1:]), -30, 30)))


def learn_lexicon(texts: list[str], toxic: np.ndarray, least: int = 3, longest: int = 14, cost: float = 20.0, odds: float = 1.5) -> dict[str, float]:
    """Word beginnings (3 letters at least) and whole words that pay for themselves.

    A word counts at most three times in a text.  An entry gains its occurrences in toxic texts times its log odds,
    less `cost`; of an entry and what starts with it, whichever gains more in all is taken."""
    counts, total = (Counter(), Counter()), [0, 0]
    seen: Counter = Counter()
    for text, label in zip(texts, toxic, strict=True):
        own = {w: min(c, 3) for w, c in Counter(WORD.findall(fold(text))).items() if len(w) > 2}
        counts[int(label)].update(own)
        total[int(label)] += sum(own.values())
        if label:
            seen.update({p for w in own for p in (*(w[:k] for k in range(3, min(len(w), longest) + 1)), w + "$")})
    mass: dict[str, list[int]] = {p: [0, 0] for p, c in seen.items() if c >= least}
    for label in (0, 1):
        for w, c in counts[label].items():
            for p in (*(w[:k] for k in range(3, min(len(w), longest) + 1)), w + "$"):
                if p in mass:
                    mass[p][label] += c
    weight = {p: float(np.log((b + 0.5) / (total[1] + 1)) - np.log((a + 0.5) / (total[0] + 1))) for p, (a, b) in mass.items()}
    best: dict[str, tuple[float, list[str]]] = {}
    below: dict[str, list[str]] = {}
    for p in mass:
        parent = p[:-1]
        below.setdefault(parent, []).append(p)
    for p in sorted(mass, key=len, reverse=True):
        inner = [best[q] for q in below.get(p, ()) if q in best]
        rest = (sum(g for g, _ in inner), [e for _, es in inner for e in es])
        gain = mass[p][1] * weight[p] - cost if weight[p] >= odds else -1.0
        best[p] = max(((gain, [p]), rest, (0.0, [])), key=lambda x: x[0]) if gain > rest[0] + 1e-9 or not inner else max((rest, (0.0, [])), key=lambda x: x[0])
    chosen = [e for p in best if p[:-1] not in mass for e in best[p][1]]
    return {e: round(weight[e], 4) for e in sorted(chosen)}


def fit_curve(lexicon: Lexicon, texts: list[str], toxic: np.ndarray, ridge: float = 0.05) -> Lexicon:
    """Logistic regression by Newton's method."""
    matcher = Matcher(lexicon)
    x = np.array([matcher.features(t) for t in texts])
    mean, spread = x.mean(0), np.maximum(x.std(0), 1e-6)
    z = np.column_stack([np.ones(len(x)), (x - mean) / spread])
    b = np.zeros(z.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
        pull = ridge * np.r_[0, np.ones(len(b) - 1)]
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(pull + 1e-9), z.T @ (toxic - p) - pull * b)
        b += np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-8:
            break
    lexicon.curve, lexicon.mean, lexicon.spread = tuple(map(float, b)), tuple(map(float, mean)), tuple(map(float, spread))
    return lexicon


def held_out(column: str = "doc_id") -> Column:
    """True where the crc32 of the id as text leaves no remainder by 5."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, limit: int, where: Column | None = None) -> DataFrame:
    """At most `limit` labelled documents, the lowest by hash of their id: (doc_id, label, text).

    The ids are bounded by `limit`, so they are broadcast to the scan of documents."""
    own = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).select("doc_id", F.col(label).cast("int").alias("__label"))
    if where is not None:
        own = own.where(where)
    own = own.groupBy("doc_id").agg(F.max("__label").alias("__label"))
    own = own.orderBy(F.xxhash64(F.col("doc_id")), F.col("doc_id")).limit(limit)
    return docs.select("doc_id", "text").join(F.broadcast(own), "doc_id").select("doc_id", "__label", "text")


def fit(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE) -> Lexicon:
    rows = labelled_sample(docs, labels, "toxic", limit, ~held_out()).toPandas().dropna(subset=["text"]).sort_values(["doc_id", "text"])
    toxic = rows["__label"].to_numpy().astype(float)
    if not len(rows) or toxic.min() == toxic.max():
        return Lexicon()
    texts = rows["text"].tolist()
    return fit_curve(Lexicon(learn_lexicon(texts, toxic)), texts, toxic)


def score_documents(docs: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, score, predicted, hits, weight and words of every document, in one pass without a shuffle."""
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(lexicon)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                found = np.array([matcher.features(t) for t in text_array(part, text_col).to_pylist()]).reshape(-1, 3)
                score = matcher.score(found)
                yield pa.RecordBatch.from_pydict({
                    id_col: part.column(0), "held_out": part.column(2), "score": pa.array(score), "predicted": pa.array((score >= 0.5).astype(np.int32)),
                    "hits": pa.array(np.rint(np.expm1(found[:, 2])).astype(np.int64)), "weight": pa.array(np.expm1(found[:, 0])),
                })

    own = docs.select(F.col(id_col), F.col(text_col), held_out(id_col).alias("__held"))
    return own.mapInArrow(run, f"`{id_col}` {kind}, held_out boolean, score double, predicted int, hits long, weight double")


def toxicity(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE) -> DataFrame:
    return score_documents(docs, fit(docs, labels, limit))
