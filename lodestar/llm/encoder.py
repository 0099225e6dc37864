"""Whole texts to ids with the tokenizers library, a word at a time.

The tokenizer drops white space, lower-cases, and never joins letters and punctuation, so a text's ids are the ids of
its parts end to end: white-space separated words, cut between ASCII punctuation (but the apostrophe) and Latin letters.
Each worker encodes each different part once and gathers the rest with numpy; the parts a worker remembers are bounded,
older ones are encoded again.  Runs of texts that hold "<|", which may begin a special token, are cut at white space only
and keep their case.
"""

from __future__ import annotations

import itertools
import os
import re

import numpy as np
import pandas as pd

from . import textvec as tv

#: Parts remembered by a worker (some 45 bytes each).
REMEMBER = 1_000_000

#: Parts that are one piece for the tokenizer: its model takes them as they are, without normaliser and splitter.
ONE_PIECE = re.compile("[a-zß-öø-ÿ]+")

LETTER = np.zeros(256, bool)
LETTER[[*range(65, 91), *range(97, 123)]] = True
PUNCT = np.zeros(256, bool)
PUNCT[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) != "'"]] = True


def parts(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and owners of the parts of all texts."""
    mask = ~tv.SPACE[raw]
    starts, ends = tv.runs(mask, offsets)
    if len(raw) > 1:
        lead = np.zeros(len(raw), bool)  # first byte of a two-byte letter U+00C0 to U+00FF
        lead[:-1] = (raw[:-1] == 0xC3) & (raw[1:] != 0x97) & (raw[1:] != 0xB7)
        begins = LETTER[raw] | lead
        stops = LETTER[raw]
        stops[1:] |= lead[:-1]
        punct = PUNCT[raw]
        cut = np.flatnonzero((punct[:-1] & begins[1:]) | (stops[:-1] & punct[1:])) + 1
        edge = np.zeros(len(raw) + 1, bool)
        edge[starts] = edge[cut] = True
        starts = np.flatnonzero(edge)
        edge[:] = False
        edge[ends] = edge[cut] = True
        ends = np.flatnonzero(edge)
    return starts, ends, tv.owner(starts, offsets)


class WordEncoder:
    """ordinary: the strings of special tokens in a text are plain text."""

    def __init__(self, path: str, ordinary: bool = False) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.mark = Tokenizer.from_file(path)
        self.alone = Tokenizer.from_file(path)
        self.alone.encode_special_tokens = ordinary
        self.sep_text, self.sep = max(((t.content, i) for i, t in self.mark.get_added_tokens_decoder().items()), key=lambda x: x[1])
        # the characters that stand for bytes in the model's alphabet: printable Latin-1 as it is, the others from U+0100 on
        same = {*range(33, 127), *range(161, 173), *range(174, 256)}
        rest = iter(range(256, 512))
        self.bytes_of = [chr(b) if b in same else chr(next(rest)) for b in range(256)]
        self._forget()

    def _forget(self) -> None:
        self.keys = np.empty(0, tv.U)
        self.slot = np.empty(0, np.int64)
        self.start = np.empty(0, np.int64)
        self.size = np.empty(0, np.int64)
        self.ids = np.empty(0, np.int32)

    def _encode(self, words: list[str]) -> list:
        """Parts of one piece go to the model, other plain parts meet in one text with a special token between any two,
        and those that may hold a special token are encoded one by one."""
        out: list = [None] * len(words)
        plain, fits, tokenize, bytes_of = [], ONE_PIECE.fullmatch, self.mark.model.tokenize, self.bytes_of
        for i, w in enumerate(words):
            low = w.lower()
            if fits(low):
                out[i] = [t.id for t in tokenize(low if low.isascii() else "".join([bytes_of[c] for c in low.encode()]))]
            elif "<|" in w:
                out[i] = self.alone.encode(w, add_special_tokens=False).ids
            else:
                plain.append(i)
        for at in range(0, len(plain), 200):
            part = plain[at : at + 200]
            ids = np.array(self.mark.encode(f" {self.sep_text} ".join(words[i] for i in part), add_special_tokens=False).ids, np.int32)
            for i, x in zip(part, np.split(ids, np.flatnonzero(ids == self.sep)), strict=True):
                out[i] = (x[1:] if len(x) and x[0] == self.sep else x).tolist()
        return out

    def encode(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and len + 1 offsets."""
        if b"<|" in raw.tobytes():
            starts, ends, own, h = tv.words(raw, offsets)
        else:
            raw = tv.lower_ascii(raw)
            starts, ends, own = parts(raw, offsets)
            h = tv.span_hash(raw, ~tv.SPACE[raw], starts, ends)
        back, different = pd.factorize(h)
        order = np.argsort(different)  # a sorted search stays in the cache
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        back, different = rank[back], different[order]
        if len(self.keys) > REMEMBER:
            self._forget()
        at = np.searchsorted(self.keys, different)
        known = np.zeros(len(different), bool)
        if len(self.keys):
            known = self.keys[np.minimum(at, len(self.keys) - 1)] == different
        if not known.all():
            first = np.empty(len(different), np.int64)
            first[back[::-1]] = np.arange(len(h))[::-1]
            fresh = first[~known]
            data = raw.tobytes()
            got = self._encode([data[i:j].decode("utf-8", "replace") for i, j in zip(starts[fresh].tolist(), ends[fresh].tolist(), strict=True)])
            size = np.array([len(x) for x in got], np.int64)
            self.start = np.concatenate([self.start, len(self.ids) + np.concatenate([[0], np.cumsum(size)[:-1]])])
            self.slot = np.insert(self.slot, at[~known], len(self.size) + np.arange(len(got)))
            self.keys = np.insert(self.keys, at[~known], different[~known])
            self.size = np.concatenate([self.size, size])
            self.ids = np.concatenate([self.ids, np.fromiter(itertools.chain.from_iterable(got), np.int32, int(size.sum()))])
            at = np.searchsorted(self.keys, different)
        slot = self.slot[at][back] if len(h) else np.empty(0, np.int64)
        size = self.size[slot]
        ends_at = np.cumsum(size)
        total = int(ends_at[-1]) if len(size) else 0
        ids = self.ids[np.repeat(self.start[slot] - (ends_at - size), size) + np.arange(total)]
        words_before = np.searchsorted(own, np.arange(len(offsets)))
        return ids, np.concatenate([[0], ends_at])[words_before]


_shared: dict[tuple[str, bool], WordEncoder] = {}


def shared(path: str, ordinary: bool = False) -> WordEncoder:
    """The encoder of this Python worker: it lives on from task to task with what it remembers."""
    key = (path, ordinary)
    if key not in _shared:
        _shared[key] = WordEncoder(path, ordinary)
    return _shared[key]
