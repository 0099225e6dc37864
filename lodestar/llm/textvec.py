"""Vectorised words, lines and shingles over the UTF-8 bytes of many texts at once.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D within one text.  Hashes are 64-bit polynomial
hashes over a random byte table, finished with a bit mixer; they depend on content alone.
"""

from __future__ import annotations

import numpy as np

U = np.uint64


def _stream(n: int, seed: int) -> np.ndarray:
    """n pseudo-random 64-bit numbers by rule (a Weyl sequence through `mix`)."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=U) * U(0x9E3779B97F4A7C15) + U(seed))


def mix(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
        return h ^ (h >> U(31))


BYTES = _stream(256, 7)
BASE = U(0xD6E8FEB86659FD93)
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_powers = np.ones(1, U)


def powers(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        size = max(n, 1 << 16)
        with np.errstate(over="ignore"):
            _powers = np.concatenate([np.ones(1, U), np.cumprod(np.full(size, BASE, U))])
    return _powers


def lower_ascii(raw: np.ndarray) -> np.ndarray:
    return np.where((raw >= 65) & (raw <= 90), raw | 0x20, raw).astype(np.uint8)


def runs(mask: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of true bytes that don't cross a text's end."""
    n = len(mask)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.ones(n, bool)
    before[1:] = ~mask[:-1]
    starts = np.flatnonzero(mask & (before | edge[:n]))
    after = np.ones(n, bool)
    after[:-1] = ~mask[1:]
    ends = np.flatnonzero(mask & (after | edge[1:])) + 1
    return starts, ends


def owner(starts: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Index of the text in which each of these ascending positions lies."""
    cuts = np.searchsorted(starts, offsets)
    return np.repeat(np.arange(len(offsets) - 1), np.diff(cuts))


_INVERSE = U(pow(int(BASE), -1, 1 << 64))
_backward = np.ones(1, U)
#: Runs of texts beyond this size would make the tables of powers too large; their spans are hashed one power row each.
SUMS_UP_TO = 1 << 23


def backward_powers(n: int) -> np.ndarray:
    """Powers of BASE's inverse."""
    global _backward
    if len(_backward) < n:
        with np.errstate(over="ignore"):
            _backward = np.concatenate([np.ones(1, U), np.cumprod(np.full(max(n, 1 << 16), _INVERSE, U))])
    return _backward


def prefix_sums(raw: np.ndarray) -> np.ndarray:
    """Sums from which the hash of any stretch follows."""
    out = np.empty(len(raw) + 1, U)
    out[0] = 0
    with np.errstate(over="ignore"):
        np.cumsum(BYTES[raw] * powers(len(raw) + 1)[: len(raw)], out=out[1:])
    return out


def stretch_hash(sums: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Hash of raw[lo:hi] without its length, not yet mixed."""
    with np.errstate(over="ignore"):
        return (sums[hi] - sums[lo]) * backward_powers(len(sums) + 1)[lo]


def span_hash(raw: np.ndarray, mask: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each span; spans are disjoint, in order, and cover exactly the true bytes of mask."""
    if not len(starts):
        return np.empty(0, U)
    lens = ends - starts
    if len(raw) <= SUMS_UP_TO:
        with np.errstate(over="ignore"):
            return mix(stretch_hash(prefix_sums(raw), starts, ends) + lens.astype(U))
    first = np.concatenate([[0], np.cumsum(lens)[:-1]])
    within = np.arange(first[-1] + lens[-1]) - np.repeat(first, lens)
    with np.errstate(over="ignore"):
        return mix(np.add.reduceat(BYTES[raw[mask]] * powers(int(lens.max()) + 1)[within], first) + lens.astype(U))


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """starts, ends, owners and hashes of all words."""
    mask = ~SPACE[raw]
    starts, ends = runs(mask, offsets)
    return starts, ends, owner(starts, offsets), span_hash(raw, mask, starts, ends)


def grams(hashes: np.ndarray, own: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of n words inside one text, and the index of each window's first word."""
    if len(hashes) < n:
        return np.empty(0, U), np.empty(0, np.int64)
    at = np.flatnonzero(own[: len(own) - n + 1] == own[n - 1 :])
    with np.errstate(over="ignore"):
        h = np.zeros(len(at), U)
        for k in range(n):
            h = mix(h * BASE + hashes[at + k] + U(k + 1))
    return h, at


def in_text(h: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Make hashes of different texts differ."""
    with np.errstate(over="ignore"):
        return mix(h + own.astype(U) * U(0xA24BAED4963EE407))
