"""Words of letters and digits, and CRC-32 of many stretches of bytes at once."""

from __future__ import annotations

import zlib

import numpy as np

from .textvec import lower_ascii, owner, runs

#: Longer stretches are hashed one by one.
LONG = 64
#: Letters, digits and all bytes beyond ASCII, after lower-casing.
LETTERS = np.zeros(256, bool)
LETTERS[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def _table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(0xEDB88320), c >> 1).astype(np.uint32)
    return c


TABLE = _table()


def crc32_spans(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Unsigned CRC-32 of raw[start:end], for each stretch."""
    lens = ends - starts
    order = np.argsort(-np.minimum(lens, LONG + 1), kind="stable")  # longest first: those still open at a byte are the first ones
    n_long = int((lens > LONG).sum())
    at, left = starts[order][n_long:], np.sort(lens[order][n_long:])
    crc = np.full(len(at), 0xFFFFFFFF, np.uint32)
    for j in range(int(left[-1]) if len(left) else 0):
        m = len(left) - int(np.searchsorted(left, j, "right"))
        crc[:m] = TABLE[(crc[:m] ^ raw[at[:m] + j]) & 255] ^ (crc[:m] >> 8)
    out = np.empty(len(lens), np.uint32)
    out[order[n_long:]] = ~crc
    for i in order[:n_long]:
        out[i] = zlib.crc32(raw[starts[i] : ends[i]].tobytes())
    return out


def words_joined(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased words of letters and digits, one blank between two of a text: bytes, starts, ends and owners."""
    raw = lower_ascii(raw)
    mask = LETTERS[raw]
    starts, ends = runs(mask, offsets)
    own = owner(starts, offsets)
    behind = np.zeros(len(raw) + 1, bool)
    behind[ends[:-1][own[1:] == own[:-1]]] = True  # the byte behind a word that isn't its text's last
    keep = mask | behind[:-1]
    place = np.concatenate([[0], np.cumsum(keep)])
    return np.where(mask, raw, np.uint8(32))[keep], place[starts], place[ends], own
