"""Personal data: base patterns, and a skip-chain conditional random field that adds what they miss.

Base spans (email, ip, card, phone) are found by pattern in whole texts, leftmost and non-overlapping for each kind.
The field's nodes are the base spans, which are observed, and all other tokens with a digit or an at sign.  Each node
has label scores from its shape; neighbours in the text share a transition potential; equal tokens, however far
apart, and similar ones (one digit apart, or the local part of an address) share a potential that rewards one label.
Loopy sum-product messages pass until they settle (a bound that grows with the nodes guards against fields that swing),
and a token whose label is sure enough, and that is tied to a base span, becomes an added span.

The potentials are fitted here: `train` counts the contexts of nodes over all documents (label, shapes, neighbours,
ties: a table of bounded size) with base spans as labels, and `fit` finds the potentials of most pseudo-likelihood.

Defined results: null and empty texts have no spans; equal texts get equal spans, so ties and repeated rows are
harmless; a null id is kept; without documents the potentials are flat and nothing is added; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_array

KINDS = ("email", "ip", "card", "phone")
LABELS = (*KINDS, "none")
NONE = len(KINDS)

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a run of digits that fails at its head fails from every digit in it, so only heads are tried
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
NOT_DIGIT = re.compile(r"[^0-9]+")
EDGE = "*$%&#|!?,;:.'\"()[]{}<>="


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Every match holds one at sign, and its local part is the whole run before it since the last match."""
    out, last = [], 0
    at = text.find("@")
    while at >= 0:
        lo = at
        while lo > last and text[lo - 1] in LOCAL:
            lo -= 1
        end = None
        if lo < at:
            m = DOMAIN.match(text, at + 1)
            end = m.end() if m else None
        if end:
            out.append((lo, end))
            last = end
        at = text.find("@", max(at + 1, last))
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by kind, then start; code points, end exclusive."""
    out = [(0, a, b) for a, b in emails(text)] if "@" in text else []
    if DIGIT.search(text):
        out += [(1, m.start(), m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in CARD.finditer(text):
            digits = NOT_DIGIT.sub("", m[0])
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append((2, m.start(), m.end()))
        if "+" in text:
            out += [(3, m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= len(NOT_DIGIT.sub("", m[0])) <= 15]
    return out


@dataclass
class Node:
    label: int  # of a base span, else NONE
    start: int
    end: int
    text: str


def nodes(text: str, base: list[tuple[int, int, int]]) -> list[Node]:
    """Base spans and the other tokens with a digit or an at sign, in the order of the text."""
    out = [Node(k, a, b, text[a:b]) for k, a, b in base]
    taken = sorted((a, b) for _, a, b in base)
    at = 0
    for m in TOKEN.finditer(text):
        core = m[0].strip(EDGE)
        if not DIGIT.search(core) and "@" not in core:
            continue
        lo = m.start() + m[0].find(core)
        while at < len(taken) and taken[at][1] <= m.start():
            at += 1
        if at < len(taken) and taken[at][0] < m.end():
            continue
        out.append(Node(NONE, lo, lo + len(core), core))
    return sorted(out, key=lambda n: (n.start, n.label))


def shape(text: str) -> list[str]:
    digits = NOT_DIGIT.sub("", text)
    n = len(digits)
    size = next(s for s, most in (("0", 0), ("1-3", 3), ("4-6", 6), ("7-8", 8), ("9-12", 12), ("13-19", 19), ("20+", 1 << 60)) if n <= most)
    letters = sum(c.isalpha() for c in text)
    return [
        f"digits={size}", f"dots={min(text.count('.'), 4)}", f"at={'@' in text}", f"plus={text[:1] == '+'}",
        f"letters={min(letters, 3)}", f"luhn={13 <= n <= 19 and luhn(digits)}", f"brackets={'(' in text}",
    ]


def keys(node: Node) -> tuple[str, list[str]]:
    """What equal tokens have in common, and what similar ones share."""
    plain = "".join(c for c in node.text.lower() if c.isalnum())
    near = []
    if plain.isdigit() and 9 <= len(plain) <= 19:
        near = [f"{plain[:i]}_{plain[i + 1 :]}" for i in range(len(plain))]
    local = node.text.partition("@")[0].lower()
    if len(local) >= 5:
        near.append(f"@{local}")
    return plain, near


def edges(found: list[Node]) -> list[tuple[int, int, int]]:
    """(a, b, type): 0 neighbours, 1 equal tokens, 2 similar ones.  Each token is tied to the last one before it that
    shares a key, so equal tokens form a chain and edges grow with tokens, not with pairs."""
    out = [(i - 1, i, 0) for i in range(1, len(found))]
    same: dict[str, int] = {}
    alike: dict[str, int] = {}
    for i, node in enumerate(found):
        plain, near = keys(node)
        if plain in same:
            out.append((same[plain], i, 1))
        same[plain] = i
        tied = set()
        for key in near:
            j = alike.get(key)
            if j is not None and j not in tied and found[j].text != node.text:
                tied.add(j)
                out.append((j, i, 2))
            alike[key] = i
    return out


@dataclass
class Field:
    """Log potentials: of shapes by label, of neighbours, and the reward of one label for equal and similar tokens."""

    prior: np.ndarray
    shapes: dict[str, np.ndarray]
    next: np.ndarray
    equal: float
    similar: float

    def scores(self, node: Node) -> np.ndarray:
        out = self.prior.copy()
        for s in shape(node.text):
            out += self.shapes.get(s, 0.0)
        if node.label != NONE:
            out[node.label] += 50.0
        return out

    def marginals(self, found: list[Node], ties: list[tuple[int, int, int]]) -> np.ndarray:
        """Loopy sum-product: all messages at once, halfway to their new values in each round, until they settle."""
        own = np.array([self.scores(n) for n in found])
        if ties:
            table = np.stack([self.next, self.equal * np.eye(len(LABELS)), self.similar * np.eye(len(LABELS))])
            a, b, kind = np.array(ties).T
            src, dst = np.concatenate([a, b]), np.concatenate([b, a])
            pot = np.concatenate([table[kind], table[kind].transpose(0, 2, 1)])
            back = np.concatenate([np.arange(len(a)) + len(a), np.arange(len(a))])
            sent = np.zeros((len(src), len(LABELS)))
            belief = own
            for _ in range(100 + 8 * len(found)):
                out = (belief[src] - sent[back])[:, :, None] + pot
                top = out.max(1, keepdims=True)
                new = np.log(np.exp(out - top).sum(1)) + top[:, 0]
                new -= new.max(1, keepdims=True)
                moved = np.abs(new - sent).max()
                sent = 0.5 * (sent + new)
                belief = own.copy()
                np.add.at(belief, dst, sent)
                if moved < 1e-3:
                    break
            own = belief
        p = np.exp(own - own.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)


#: Ties to base spans beyond so many count as so many, in the fit alone; messages use all.
TIES = 3
#: The Gaussian that holds the fitted potentials: near 0, those of equal and similar tokens near these means.
VARIANCE = 25.0
MEANS = (8.0, 7.0)


def contexts(text: str) -> Iterator[tuple]:
    """What the fit needs of each node: label, neighbours' labels (-1: none), ties to base spans by label, shapes.

    A node without a label that is tied to a base span may be what base patterns miss: it teaches nothing and is left out."""
    base = base_spans(text)
    if not base and not DIGIT.search(text) and "@" not in text:
        return
    found = nodes(text, base)
    tied = [[[0] * NONE, [0] * NONE] for _ in found]
    for a, b, kind in edges(found):
        for i, j in ((a, b), (b, a)):
            if kind and found[j].label != NONE:
                own = tied[i][kind - 1]
                own[found[j].label] = min(own[found[j].label] + 1, TIES)
    for i, n in enumerate(found):
        if n.label == NONE and any(map(any, tied[i])):
            continue
        left = found[i - 1].label if i else -1
        right = found[i + 1].label if i + 1 < len(found) else -1
        yield n.label, left, right, tuple(tied[i][0]), tuple(tied[i][1]), tuple(shape(n.text))


def fit(counts: dict[tuple, int], steps: int = 400) -> Field:
    """The potentials of most pseudo-likelihood: of each node's label given its shapes, its neighbours and its ties.

    Each node counts twice: by its shapes and neighbours, and, with a prior of its own, by its ties alone, as base spans
    are known by their shapes already: so ties get the weight that they have where a shape says nothing.  Gradient ascent with adaptive steps; the
    likelihood is concave."""
    k = len(LABELS)
    rows = list(counts)
    names = sorted({s for r in rows for s in r[5]})
    place = {s: i for i, s in enumerate(names)}
    if not rows:
        return Field(np.zeros(k), {}, np.zeros((k, k)), *MEANS)
    y, left, right = (np.array([r[i] for r in rows]) for i in range(3))
    weight = np.array(list(counts.values()), float)
    weight /= weight.sum()
    equal, similar = (np.pad(np.array([r[i] for r in rows], float), ((0, 0), (0, 1))) for i in (3, 4))
    own = np.array([[place[s] for s in r[5]] for r in rows])
    target = np.eye(k)[y]
    at = {"prior": np.zeros(k), "untied": np.zeros(k), "shapes": np.zeros((len(names), k)), "next": np.zeros((k + 1, k + 1)), "tie": np.array(MEANS)}
    square = {n: np.zeros_like(v) for n, v in at.items()}
    pull = 1.0 / (VARIANCE * max(1.0, float(sum(counts.values()))))

    def gap(scores: np.ndarray) -> np.ndarray:
        p = np.exp(scores - scores.max(1, keepdims=True))
        return (target - p / p.sum(1, keepdims=True)) * weight[:, None]

    for step in range(steps):
        a = gap(at["prior"] + at["shapes"][own].sum(1) + at["next"][left, :k] + at["next"][:k, right].T)
        b = gap(at["untied"] + at["tie"][0] * equal + at["tie"][1] * similar)
        up = {n: -pull * (v - MEANS if n == "tie" else v) for n, v in at.items()}
        up["prior"] = up["prior"] + a.sum(0)
        up["untied"] = up["untied"] + b.sum(0)
        up["tie"] = up["tie"] + np.array([(b * equal).sum(), (b * similar).sum()])
        for j in range(own.shape[1]):
            np.add.at(up["shapes"], own[:, j], a)
        np.add.at(up["next"], left, np.pad(a, ((0, 0), (0, 1))))
        np.add.at(up["next"].T, right, np.pad(a, ((0, 0), (0, 1))))
        up["next"][k] = up["next"][:, k] = 0.0
        for n in at:
            square[n] = 0.95 * square[n] + 0.05 * up[n] ** 2
            at[n] = at[n] + 0.1 * (1 - step / steps) * up[n] / (np.sqrt(square[n]) + 1e-9)
    return Field(at["prior"], {s: at["shapes"][i] for s, i in place.items()}, at["next"][:k, :k], float(max(at["tie"][0], 0.0)), float(max(at["tie"][1], 0.0)))


def train(docs: DataFrame, text_col: str = "text") -> Field:
    """Counts of the contexts of all documents, of bounded kinds, are added up; no text leaves its task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                for text in text_array(batch.slice(at, 1024), text_col).to_pylist():
                    counts.update(contexts(text))
        yield pa.RecordBatch.from_pydict({"key": pa.array([json.dumps(x) for x in counts], pa.string()), "n": pa.array(list(counts.values()), pa.int64())})

    rows = docs.select(F.col(text_col)).mapInArrow(run, "key string, n long").groupBy("key").agg(F.sum("n").alias("n")).collect()

    def key(x: str) -> tuple:
        return tuple(tuple(v) if isinstance(v, list) else v for v in json.loads(x))

    return fit(dict(sorted((key(r[0]), r[1]) for r in rows)))


def added_spans(text: str, base: list[tuple[int, int, int]], field: Field, sure: float = 0.9) -> list[tuple[int, int, int]]:
    found = nodes(text, base)
    if all(n.label != NONE for n in found):
        return []
    ties = edges(found)
    p = field.marginals(found, ties)
    seen = _evidence(found, ties)
    return [(int(p[i, :NONE].argmax()), n.start, n.end) for i, n in enumerate(found) if seen[i] and n.label == NONE and p[i, :NONE].max() >= sure]


def _evidence(found: list[Node], ties: list[tuple[int, int, int]]) -> list[bool]:
    """Which nodes are tied to a base span, through others or by themselves: shapes alone add nothing."""
    up = list(range(len(found)))

    def root(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for a, b, kind in ties:
        if kind:
            up[root(a)] = root(b)
    told = {root(i) for i, n in enumerate(found) if n.label != NONE}
    return [root(i) in told for i in range(len(found))]


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


def find(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, base counts by kind, digest of the base spans, all spans, and how many were added; one pass, no shuffle."""
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                n = np.zeros((part.num_rows, 4), np.int64)
                digest, spans, extra = [], [], []
                for i, text in enumerate(text_array(part, text_col).to_pylist()):
                    base = base_spans(text)
                    for k, _, _ in base:
                        n[i, k] += 1
                    more = added_spans(text, base, field) if DIGIT.search(text) or "@" in text else []
                    digest.append(hashlib.sha256(joined(base).encode()).hexdigest())
                    spans.append(joined(base + more))
                    extra.append(len(more))
                yield pa.RecordBatch.from_pydict({id_col: part.column(0)} | {f"n_{k}": pa.array(n[:, j]) for j, k in enumerate(KINDS)} | {"base_sha256": pa.array(digest, pa.string()), "spans": pa.array(spans, pa.string()), "n_added": pa.array(extra, pa.int64())})

    counts = ", ".join(f"n_{k} long" for k in KINDS)
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"`{id_col}` {kind}, {counts}, base_sha256 string, spans string, n_added long")


def redact(text: str, spans: str) -> str:
    """The text with each span replaced by its kind; of overlapping spans the first stays."""
    out, last = [], 0
    for kind, a, b in sorted((x.split(":") for x in spans.split(",") if x), key=lambda x: int(x[1])):
        if int(a) >= last:
            out += [text[last : int(a)], f"[{kind.upper()}]"]
            last = int(b)
    return "".join(out) + text[last:]


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return find(docs, train(docs, text_col), id_col, text_col)
