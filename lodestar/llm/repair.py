"""Re-Pair grammar compression of id sequences, in rounds.

A round counts adjacent pairs exactly, gives the most frequent ones a new symbol each, and replaces their
occurrences; where two overlap the more frequent one wins.  Rounds go on until no pair is frequent.  Pairs never hold the barrier id, so a document that ends
with it begins and ends at a symbol and can be decoded alone.  Larsson and Moffat, "Off-line dictionary-based
compression" (2000), in batches.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass

import numpy as np

U = np.uint64
MAGIC = b"LRP1"
_HEAD = struct.Struct("<4sIIQQIB")


def compress(seq: np.ndarray, first: int, barrier: int, least: int = 24) -> tuple[np.ndarray, np.ndarray]:
    """The shortened sequence and the rules: symbol first + k expands to rules[k].  Ends when no pair occurs least times.

    The sequence is linked both ways and closed up when a third of it is gone.  After the first round only pairs beside
    new symbols, and frequent ones that weren't replaced, are counted: no other pair can have become frequent.  A pair
    that gets fewer than half of `least` places, as better ones take them, waits for a later round."""
    seq = np.append(seq.astype(np.uint32), np.uint32(barrier))  # the last cell ends both directions
    rules = np.empty((0, 2), np.int64)
    after, before, alive = _linked(len(seq))
    active = np.flatnonzero((seq[:-1] != barrier) & (seq[1:] != barrier))
    gone = 0
    while len(active):
        key = _frequent(seq, after, active, first + len(rules), least)
        active, key = active[key[0]], key[1]
        pair, count = np.unique(key, return_counts=True)
        often = count >= least
        if not often.any():
            break
        pair, count = pair[often], count[often]
        order = np.lexsort((pair, -count))
        rank = np.empty(len(pair), np.int64)
        rank[order] = np.arange(len(pair))
        where = np.minimum(np.searchsorted(pair, key), len(pair) - 1)
        hit = pair[where] == key
        active, r = active[hit], rank[where[hit]]  # what is not frequent now never will be
        keep = _apart(active, r, after)
        used = np.bincount(r[keep], minlength=len(pair))
        keep &= (used >= max(1, least // 2))[r]
        at, r = active[keep], r[keep]
        taken = np.unique(r)
        symbol = first + len(rules) + np.searchsorted(taken, r)
        shift = 16 if key.dtype == np.uint32 else 32
        own = pair[order[taken]].astype(U)
        rules = np.concatenate([rules, np.column_stack([own >> U(shift), own & U((1 << shift) - 1)]).astype(np.int64)])
        drop = after[at]
        over = after[drop]
        seq[at], after[at], before[over], alive[drop] = symbol, over, at, False
        gone += len(at)
        fresh = np.zeros(len(seq), bool)
        fresh[at] = fresh[before[at]] = True
        fresh[active[alive[active]]] = True  # frequent pairs that were left
        active = np.flatnonzero(fresh[:-1])
        active = active[(seq[active] != barrier) & (seq[after[active]] != barrier)]
        if 3 * gone > len(seq):
            place = np.cumsum(alive, dtype=np.int64) - 1
            active, seq = place[active], seq[alive]
            after, before, alive = _linked(len(seq))
            gone = 0
    return seq[alive][:-1].astype(np.int64), rules


def _linked(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Next and previous place of each, the last place standing for both ends, and whether each is there."""
    after = np.minimum(np.arange(1, n + 1), n - 1)
    before = np.arange(-1, n - 1)
    before[0] = n - 1
    return after, before, np.ones(n, bool)


def _frequent(seq: np.ndarray, after: np.ndarray, active: np.ndarray, symbols: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Which active places may hold a frequent pair, and the keys of those.  Keys have 32 bits while symbols have 16."""
    small = symbols <= 1 << 16
    a, b = seq[active], seq[after[active]]
    key = (a << np.uint32(16)) | b if small else (a.astype(U) << U(32)) | b
    bits = 20 if len(active) > 1 << 16 else 16
    with np.errstate(over="ignore"):
        cell = (a * np.uint32(0x9E3779B1) + b * np.uint32(0x85EBCA77)) >> np.uint32(32 - bits)
    # a cell counts its pairs together: no frequent pair is missed
    often = np.bincount(cell, minlength=1 << bits)[cell] >= least
    return often, key[often]


def _apart(at: np.ndarray, r: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Places, ascending, that don't overlap: the better rank stays, and every other one of a run of equal pairs."""
    keep = np.ones(len(at), bool)
    touch = after[at[:-1]] == at[1:]
    head = np.ones(len(at), bool)
    head[1:] = ~(touch & (r[1:] == r[:-1]))
    start = np.maximum.accumulate(np.where(head, np.arange(len(at)), 0))
    keep &= (np.arange(len(at)) - start) % 2 == 0
    keep[1:] &= ~touch | (r[1:] <= r[:-1])
    keep[:-1] &= ~touch | (r[:-1] <= r[1:])
    return keep


def lengths(rules: np.ndarray, first: int) -> np.ndarray:
    """Ids in the expansion of each rule."""
    out = [1] * first
    for a, b in rules.tolist():
        out.append(out[a] + out[b])
    return np.array(out[first:], np.int64)


def _levels(rules: np.ndarray, first: int) -> list[np.ndarray]:
    """Rules by depth, the shallowest first."""
    depth = [0] * first
    for a, b in rules.tolist():
        depth.append(1 + max(depth[a], depth[b]))
    own = np.array(depth[first:], np.int64)
    order = np.argsort(own, kind="stable")
    return np.split(order, np.flatnonzero(np.diff(own[order])) + 1)


def _spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Places start, start + 1, ... of stretches, end to end."""
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


def expand(seq: np.ndarray, rules: np.ndarray, first: int, long: np.ndarray) -> np.ndarray:
    """All symbols of a sequence down to ids: the rules are expanded once, the deeper from the shallower ones."""
    seq = seq.astype(np.int64)
    if not len(seq) or not len(rules):
        return seq
    size = np.concatenate([np.ones(first, np.int64), long])
    start = np.cumsum(size) - size
    flat = np.arange(int(size.sum()))  # the ids themselves come first
    for own in _levels(rules, first):
        a, b = rules[own, 0], rules[own, 1]
        flat[_spread(start[first + own], size[a])] = flat[_spread(start[a], size[a])]
        flat[_spread(start[first + own] + size[a], size[b])] = flat[_spread(start[b], size[b])]
    return flat[_spread(start[seq], size[seq])]


def expand_few(seq: np.ndarray, rules: np.ndarray, first: int) -> np.ndarray:
    """The same for a short sequence, without the rules it doesn't hold; a pass for each level of the grammar."""
    seq = seq.astype(np.int64)
    while len(seq) and len(rules):
        inner = seq >= first
        if not inner.any():
            break
        at = np.arange(len(seq)) + np.concatenate([[0], np.cumsum(inner)[:-1]])
        out = np.empty(len(seq) + int(inner.sum()), np.int64)
        out[at[~inner]] = seq[~inner]
        out[at[inner]] = rules[seq[inner] - first, 0]
        out[at[inner] + 1] = rules[seq[inner] - first, 1]
        seq = out
    return seq


@dataclass
class Shard:
    """Documents' ids as a grammar; `bounds` are symbol offsets of documents, `lengths` the rules' expansion lengths."""

    doc_ids: np.ndarray
    has_id: np.ndarray
    bounds: np.ndarray
    rules: np.ndarray
    lengths: np.ndarray
    symbols: np.ndarray
    first: int
    n_ids: int

    @staticmethod
    def of(doc_ids: np.ndarray, has_id: np.ndarray, ids: np.ndarray, offsets: np.ndarray, first: int, barrier: int) -> Shard:
        symbols, rules = compress(ids, first, barrier)
        long = lengths(rules, first)
        size = np.where(symbols >= first, long[np.maximum(symbols - first, 0)], 1) if len(rules) else np.ones(len(symbols), np.int64)
        bounds = np.searchsorted(np.concatenate([[0], np.cumsum(size)]), offsets)
        return Shard(doc_ids, has_id, bounds, rules, long, symbols, first, len(ids))

    def to_bytes(self) -> bytes:
        width = 2 if self.first + len(self.rules) <= 1 << 16 else 4
        body = b"".join((
            _HEAD.pack(MAGIC, len(self.doc_ids), len(self.rules), len(self.symbols), self.n_ids, self.first, width),
            self.doc_ids.astype("<i8").tobytes(), np.packbits(self.has_id).tobytes(), self.bounds.astype("<u8").tobytes(),
            self.rules.astype("<u4").tobytes(), self.lengths.astype("<u4").tobytes(), self.symbols.astype(f"<u{width}").tobytes(),
        ))
        return body + struct.pack("<I", zlib.crc32(body))

    @staticmethod
    def from_bytes(data: bytes) -> Shard:
        if data[:4] != MAGIC or struct.unpack("<I", data[-4:])[0] != zlib.crc32(data[:-4]):
            raise ValueError("not a token shard, or a damaged one")
        _, docs, n_rules, n_symbols, n_ids, first, width = _HEAD.unpack_from(data)
        at = _HEAD.size

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, n, at)
            at += out.nbytes
            return out

        doc_ids = take("<i8", docs)
        has_id = np.unpackbits(take("u1", (docs + 7) // 8))[:docs].astype(bool)
        bounds = take("<u8", docs + 1).astype(np.int64)
        rules = take("<u4", 2 * n_rules).reshape(-1, 2).astype(np.int64)
        long = take("<u4", n_rules).astype(np.int64)
        return Shard(doc_ids, has_id, bounds, rules, long, take(f"<u{width}", n_symbols).astype(np.int64), first, n_ids)

    def document(self, k: int) -> np.ndarray:
        """Ids of the k-th document alone."""
        return expand_few(self.symbols[self.bounds[k] : self.bounds[k + 1]], self.rules, self.first)

    def starts(self) -> np.ndarray:
        """Id offsets of the documents, from expansion lengths alone."""
        size = np.ones(len(self.symbols), np.int64)
        inner = self.symbols >= self.first
        size[inner] = self.lengths[self.symbols[inner] - self.first]
        return np.concatenate([[0], np.cumsum(size)])[self.bounds]

    def all_ids(self) -> np.ndarray:
        return expand(self.symbols, self.rules, self.first, self.lengths)
