"""Benchmark decontamination by pigeonhole edit matching.

Items and documents are brought to a normal form in UTF-8 bytes: letters lower-cased (ASCII and U+00C0 to U+00DE), every run
of other ASCII signs and white space one blank.  An item of m bytes has an error budget of k = floor(rate * m) edits
and is split into k + 1 pieces: a passage within k edits holds at least one of them unchanged.  Aho-Corasick finds all
piece hits in a whole document; around each hit Myers' bit-parallel algorithm (in blocks of 64 bits, many candidates
at once) gives the least distance of the item to any stretch of the document, and those within the budget are matches.

Items are a stated query set, taken in blocks of at most `BLOCK_ITEMS` items and `BLOCK_BYTES` bytes (or one longer
item) against all documents; one block at a time is in the driver and sent along with its pass.  Where there are
several, each pass writes its rows to the shared folder before the next block is read.

Defined results: null or blank items and documents match nothing; items shorter than `1 / rate` bytes must be there
exactly, as whole words; repeated items and documents match alike and rows are distinct; a null doc_id or
item_id is kept; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, materialise, pieces

U = np.uint64
#: Edits allowed for each byte of an item.
RATE = 0.08
#: Items and bytes of a block; a worker's bit tables take 32 to 64 times the bytes.
BLOCK_ITEMS = 1000
BLOCK_BYTES = 1 << 21
#: Candidates that Myers' algorithm takes at once.
BATCH = 4096

BLANK = np.ones(256, bool)
BLANK[[*range(48, 58), *range(97, 123), *range(128, 256)]] = False


def normal_bytes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Normal forms end to end, their offsets, and the place in raw of each byte kept."""
    low = np.where((raw >= 65) & (raw <= 90), raw | 0x20, raw).astype(np.uint8)
    if len(raw) > 1:
        after = np.flatnonzero((raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E) & (raw[1:] != 0x97)) + 1
        low[after] += 0x20
    blank = BLANK[low]
    low[blank] = 32
    keep = np.ones(len(raw), bool)
    keep[1:] = ~(blank[1:] & blank[:-1])
    heads = offsets[:-1][offsets[:-1] < len(raw)]
    keep[heads] = ~blank[heads]  # no blank at the head of a text
    total = np.concatenate([[0], np.cumsum(keep)])
    return low[keep], total[offsets], np.flatnonzero(keep)


def normal(text: str) -> bytes:
    data = np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8)
    return normal_bytes(data, np.array([0, len(data)]))[0].tobytes().rstrip(b" ")


@dataclass
class Items:
    """A block of items: ids, normal forms, budgets."""

    ids: list
    forms: list[bytes]
    rate: float = RATE

    def __post_init__(self) -> None:
        pairs = [(i, f) for i, f in zip(self.ids, self.forms, strict=True) if f]
        self.ids, self.forms = [i for i, _ in pairs], [f for _, f in pairs]
        self.budgets = [int(self.rate * len(f)) for f in self.forms]


class Finder:
    """The automaton over all pieces of a block and the bit tables of its items."""

    def __init__(self, items: Items) -> None:
        import ahocorasick

        self.items = items
        found: dict[str, list[tuple[int, int]]] = {}
        for n, (form, k) in enumerate(zip(items.forms, items.budgets, strict=True)):
            text = form.decode("latin-1")
            cuts = [len(text) * j // (k + 1) for j in range(k + 2)]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                found.setdefault(text[lo:hi], []).append((n, lo))
        self.auto = ahocorasick.Automaton()
        for piece, where in found.items():
            self.auto.add_word(piece, (len(piece), where))
        if found:
            self.auto.make_automaton()
        self.size = np.array([len(f) for f in items.forms], np.int64)
        self.budget = np.array(items.budgets, np.int64)
        # items of one width, a power of two of 64-bit words, share a table: one long item widens no other's
        self.width = 1 << np.ceil(np.log2(np.maximum((self.size + 63) // 64, 1))).astype(np.int64)
        self.place = np.zeros(len(items.forms), np.int64)
        self.tables: dict[int, np.ndarray] = {}
        for width in np.unique(self.width).tolist():
            own = np.flatnonzero(self.width == width)
            self.place[own] = np.arange(len(own))
            table = self.tables[width] = np.zeros((len(own), 256, width), U)
            for k, n in enumerate(own.tolist()):
                form = np.frombuffer(items.forms[n], np.uint8)
                at = np.arange(len(form))
                np.bitwise_or.at(table, (k, form, at // 64), U(1) << (at % 64).astype(U))

    def candidates(self, form: bytes) -> Iterator[tuple[int, int, int]]:
        """(item, from, to): stretches of a normal form around piece hits; near ones of an item are joined."""
        if not self.items.forms:
            return
        seen: dict[int, list[int]] = {}
        for end, (size, where) in self.auto.iter(form.decode("latin-1")):
            for n, offset in where:
                seen.setdefault(n, []).append(end - size + 1 - offset)
        for n, at in seen.items():
            k, m = self.items.budgets[n], len(self.items.forms[n])
            at.sort()
            lo = hi = at[0]
            for x in [*at[1:], None]:
                if x is not None and x - lo <= max(k, 8):
                    hi = x
                    continue
                yield n, max(lo - k, 0), min(hi + m + k, len(form))
                lo = hi = x

    def distances(self, which: np.ndarray, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Least distance of item which[i] to a stretch of texts[i], and where the first such stretch ends; the items
        have one width."""
        words = int(self.width[which[0]])
        table, which_row = self.tables[words], self.place[which]
        n, longest = len(texts), max(map(len, texts), default=0)
        chars = np.zeros((longest, n), np.uint8)
        for i, t in enumerate(texts):
            chars[: len(t), i] = np.frombuffer(t, np.uint8)
        last, bit = (self.size[which] - 1) // 64, U(1) << ((self.size[which] - 1) % 64).astype(U)
        pv, mv = np.full((words, n), ~U(0)), np.zeros((words, n), U)
        score = self.size[which].copy()
        best, where = score.copy(), np.zeros(n, np.int64)
        one, top = U(1), U(63)
        with np.errstate(over="ignore"):
            for j in range(longest):
                eqs = table[which_row, chars[j]]
                up, down = np.zeros(n, U), np.zeros(n, U)
                for w in range(words):
                    eq, p, m = eqs[:, w], pv[w], mv[w]
                    xv = eq | m
                    eq = eq | down
                    xh = (((eq & p) + p) ^ p) | eq
                    ph, mh = m | ~(xh | p), p & xh
                    here = last == w
                    score += np.where(here, ((ph & bit) != 0).astype(np.int64) - ((mh & bit) != 0), 0)
                    out_up, out_down = ph >> top, mh >> top
                    ph, mh = (ph << one) | up, (mh << one) | down
                    pv[w], mv[w] = mh | ~(xv | ph), ph & xv
                    up, down = out_up, out_down
                less = score < best
                best[less], where[less] = score[less], j + 1
        return best, where


    def search(self, raw: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, int, int, tuple]]:
        """(text, item, distance, end, forms) of the stretches within an item's budget; end is a place in the normal form."""
        low, at, place = normal_bytes(raw, offsets)
        data = low.tobytes()
        row, which, starts, texts = [], [], [], []
        for i in range(len(offsets) - 1):
            form = data[at[i] : at[i + 1]].rstrip(b" ")
            for n, a, b in self.candidates(form):
                row.append(i)
                which.append(n)
                starts.append(a)
                texts.append(form[a:b])
        order = sorted(range(len(texts)), key=lambda i: (self.width[which[i]], len(texts[i])))
        k = 0
        while k < len(order):
            width = self.width[which[order[k]]]
            end = k + 1
            while end < min(len(order), k + BATCH) and self.width[which[order[end]]] == width:
                end += 1
            part = order[k:end]
            k = end
            found, ends = self.distances(np.array([which[i] for i in part]), [texts[i] for i in part])
            for i, d, e in zip(part, found.tolist(), ends.tolist(), strict=True):
                n, to = which[i], starts[i] + e
                if d <= self.budget[n] and (self.budget[n] or _whole(data[at[row[i]] : at[row[i] + 1]], to - int(self.size[n]), to)):
                    yield row[i], n, d, to, (at, place)


def find(docs: DataFrame, items: Items, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, item_id, distance, budget, match_end) of each document and item that match; match_end in code points."""
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(items)
        names = pa.array(items.ids, pa.int64())
        for batch in batches:
            for lo, _, raw, offsets in pieces(batch, text_col):
                best: dict[tuple[int, int], tuple[int, int]] = {}
                for r, n, d, end, (at, place) in finder.search(raw, offsets):
                    best[r, n] = min(best.get((r, n), (d, end)), (d, end))
                if best:
                    rows, which = [r for r, _ in best], [n for _, n in best]
                    heads = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
                    ends = [int(heads[place[at[r] + e - 1] + 1] - heads[offsets[r]]) for (r, _), (_, e) in best.items()]
                    yield pa.RecordBatch.from_arrays([
                        batch.column(0).take(pa.array([lo + r for r in rows])), names.take(pa.array(which)), pa.array([d for d, _ in best.values()], pa.int32()),
                        pa.array([int(finder.budget[n]) for n in which], pa.int32()), pa.array(ends, pa.int64()),
                    ], names=[id_col, "item_id", "distance", "budget", "match_end"])
        give_back()

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"`{id_col}` {kind}, item_id long, distance int, budget int, match_end long")


def _whole(form: bytes, lo: int, hi: int) -> bool:
    return (lo <= 0 or form[lo - 1] == 32) and (hi >= len(form) or form[hi] == 32)


def item_blocks(benchmark: DataFrame, rate: float = RATE) -> Iterator[tuple[Items, bool]]:
    """The items in blocks, one at a time through the driver, and whether a block is the only one."""
    ids, forms, size, first = [], [], 0, True
    for r in benchmark.select(F.col("item_id").cast("long"), "text").distinct().orderBy("item_id", "text").toLocalIterator():
        form = normal(r[1])
        if ids and (len(ids) == BLOCK_ITEMS or size + len(form) > BLOCK_BYTES):
            yield Items(ids, forms, rate), False
            ids, forms, size, first = [], [], 0, False
        ids.append(r[0])
        forms.append(form)
        size += len(form)
    if ids:
        yield Items(ids, forms, rate), first


def matches(docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """All (doc_id, item_id) whose document holds the item within its budget."""
    out = None
    for items, only in item_blocks(benchmark, rate):
        found = find(docs, items)
        found = found if only else materialise(found, "matches")
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = find(docs, Items([], [], rate))
    return out.groupBy("doc_id", "item_id").agg(F.min(F.struct("distance", "budget", "match_end")).alias("m")).select("doc_id", "item_id", "m.distance", "m.budget", "m.match_end")


def filter_documents(docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """The rows of docs that hold no item, all columns as they were; a pass for each block of items, no shuffle."""
    for items, only in item_blocks(benchmark, rate):

        def keep(batches: Iterator[pa.RecordBatch], items: Items = items) -> Iterator[pa.RecordBatch]:
            finder = Finder(items)
            for batch in batches:
                for lo, hi, raw, offsets in pieces(batch, "text"):
                    clean = np.ones(hi - lo, bool)
                    for r, *_ in finder.search(raw, offsets):
                        clean[r] = False
                    yield batch.slice(lo, hi - lo).filter(pa.array(clean))
            give_back()

        kept = docs.mapInArrow(keep, docs.schema)
        docs = kept if only else materialise(kept, "clean")
    return docs
