"""Suffix-array dedup: every byte covered by a long string that also starts elsewhere is removed.

Texts are UTF-8 bytes; a match of `size` bytes (400) never crosses documents; all its places go.

Every window of `size` bytes has one anchor: its k-byte string of least hash (the first of equals).  Anchors depend on
content alone, so equal windows have equal anchors at equal distances, and a text has about 2 in `size - k` bytes.
The windows of one anchor lie side by side and span its segment.

1. `_anchors`: anchors of all documents with fingerprints of the k-byte string and of the whole segment, packed by
   bucket of the former.  Segments that are equal inside a task are settled there, and only one of them travels on.
2. `_settle`: in a bucket, equal segments are covered whole.  A segment like no other, whose anchor string occurs
   elsewhere, is at the edge of a match: it and one segment of each other kind are asked for.
3. `_match`: their bytes meet by anchor string.  Each batch that arrives becomes a sparse suffix array (the suffixes
   at its anchors, sorted); it is merge-scanned against the arrays of the existing levels, where the neighbours of each
   suffix, extended to the left as well, give long matches; then levels of equal size merge, geometrically
   (`SuffixLevels`).  What neighbours alone can't decide, in classes of three or more, is settled exactly by
   fingerprints of windows.
4. `_hot_windows`, `_hot_settle`: an anchor string with more than HOT different surroundings would make one task large,
   so the fingerprints of its windows are dealt over all tasks, repeated ones reduced before.
5. Covered stretches meet their documents and are cut out.

Fingerprints have 64 bits each and are only compared below an equal anchor string's fingerprint.

Defined results: null and empty texts have 0 bytes; texts shorter than `size` keep all; repeated rows count as places of
their own and lose what they share; a null id is kept; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .common import discard, give_back, materialise, pieces, shuffle_width, text_array

U = np.uint64
SIZE = 400
K = 32
#: Members of an anchor string's class beyond which its windows are spread over all tasks instead.
HOT = 1000
#: Lists of stretches, one row for each document that has any, are broadcast up to so many bytes and joined by a shuffle beyond.
BROADCAST_BYTES = 24 << 20
BROADCAST_ROWS = 300_000

ANCHOR = np.dtype([("kmer", "<u8"), ("seg", "<u8"), ("uid", "<u8"), ("lo", "<u4"), ("span", "<u2"), ("at", "<u2")])
WANT = np.dtype([("kmer", "<u8"), ("lo", "<u4"), ("span", "<u2"), ("at", "<u2")])
STRETCH = np.dtype([("lo", "<u4"), ("hi", "<u4")])
WINDOW = np.dtype([("hash", "<u8"), ("uid", "<u8"), ("lo", "<u4"), ("known", "u1")])
#: Set in `span` where the anchor's own segment is settled already.
KNOWN = 1 << 15

def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least of each `width` consecutive values."""
    n = len(x) - width + 1
    full = np.concatenate([x, np.full(-len(x) % width, np.iinfo(np.uint64).max, U)]).reshape(-1, width)
    ahead = np.minimum.accumulate(full, 1).ravel()
    behind = np.minimum.accumulate(full[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def anchors(raw: np.ndarray, size: int = SIZE, k: int = K) -> np.ndarray:
    """ANCHOR rows of one text without uid."""
    if len(raw) < size:
        return np.empty(0, ANCHOR)
    sums = tv.prefix_sums(raw)
    at = np.arange(len(raw) - k + 1)
    kmers = tv.mix(tv.stretch_hash(sums, at, at + k))
    best = _sliding_min((kmers >> U(32) << U(32)) | at.astype(U), size - k + 1) & U(0xFFFFFFFF)
    lo = np.flatnonzero(np.r_[True, best[1:] != best[:-1]])
    hi = np.r_[lo[1:], len(best)] - 1
    a = best[lo].astype(np.int64)
    out = np.empty(len(lo), ANCHOR)
    out["kmer"], out["lo"], out["span"], out["at"] = kmers[a], lo, hi - lo, a - lo
    with np.errstate(over="ignore"):
        out["seg"] = tv.mix(tv.stretch_hash(sums, lo, hi + size) + (((hi - lo) << 16) | (a - lo)).astype(U))
    return out


def _packed(keys: np.ndarray, rows: np.ndarray) -> Iterator[tuple[int, bytes]]:
    if not len(keys):
        return
    order = np.argsort(keys, kind="stable")
    keys, rows = keys[order], rows[order]
    cuts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    for i, j in zip(cuts, np.r_[cuts[1:], len(keys)], strict=True):
        yield int(keys[i]), rows[i:j].tobytes()


FOUND = "kind int, bucket int, uid long, rows binary"


def _found(kind: int, keyed: list[tuple[int, bytes]], by_bucket: bool = False) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(keyed), 4096):
        part = keyed[at : at + 4096]
        keys = np.array([x for x, _ in part], U).view(np.int64)
        none = pa.nulls(len(part))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(part), kind, np.int32)), pa.array(keys.astype(np.int32)) if by_bucket else none.cast(pa.int32()), none.cast(pa.int64()) if by_bucket else pa.array(keys), pa.array([x for _, x in part], pa.binary())],
            names=["kind", "bucket", "uid", "rows"],
        )


def _stretches(entries: np.ndarray, size: int) -> Iterator[pa.RecordBatch]:
    """Kind 1: whole segments, by document."""
    s = np.empty(len(entries), STRETCH)
    s["lo"] = entries["lo"]
    s["hi"] = entries["lo"] + (entries["span"] & (KNOWN - 1)) + size
    yield from _found(1, list(_packed(entries["uid"], s)))


def _anchors(docs: DataFrame, buckets: int, size: int, k: int) -> DataFrame:
    """Kind 0: anchors by bucket; kind 1: stretches that are settled inside the task."""

    def flush(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        e = np.concatenate(held)
        e = e[np.lexsort((e["seg"], e["kmer"]))]
        head = np.r_[True, (e["kmer"][1:] != e["kmer"][:-1]) | (e["seg"][1:] != e["seg"][:-1])]
        group = np.cumsum(head) - 1
        twice = np.bincount(group)[group] > 1
        yield from _stretches(e[twice], size)
        e["span"][twice] |= KNOWN
        e = e[head]
        yield from _found(0, list(_packed(e["kmer"] % U(buckets), e)), True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            uid = batch.column(0).to_numpy(zero_copy_only=False).view(U)
            for lo, hi, raw, offsets in pieces(batch, "text"):
                for i in range(hi - lo):
                    e = anchors(raw[offsets[i] : offsets[i + 1]], size, k)
                    if len(e):
                        e["uid"] = uid[lo + i]
                        held.append(e)
                        rows += len(e)
                if rows > 400_000:
                    yield from flush(held)
                    held, rows = [], 0
        if held:
            yield from flush(held)
        held = []
        give_back()

    return docs.select("uid", "text").mapInArrow(run, FOUND)


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[list[bytes]]:
    """Rows of (bucket, binary), sorted by bucket: what each bucket holds."""
    held, now = [], None
    for batch in batches:
        for b, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if held and b != now:
                yield held
                held = []
            now = b
            held.append(x.as_buffer().to_pybytes())
    if held:
        yield held


def _settle(found: DataFrame, size: int, hot: int) -> DataFrame:
    """Kind 1: stretches of equal segments; kind 2: segments whose bytes are needed; kind 3: those of hot classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _by_bucket(batches):
            e = np.frombuffer(b"".join(held), ANCHOR)
            e = e[np.lexsort((e["seg"], e["kmer"]))]
            kmer_head = np.r_[True, e["kmer"][1:] != e["kmer"][:-1]]
            head = kmer_head | np.r_[True, e["seg"][1:] != e["seg"][:-1]]
            group, cls = np.cumsum(head) - 1, np.cumsum(kmer_head) - 1
            known = (e["span"] & KNOWN) > 0
            twice = np.bincount(group)[group] > 1
            yield from _stretches(e[twice & ~known], size)
            alone = ~twice & ~known
            kinds = np.bincount(cls[head], minlength=cls[-1] + 1)
            open_class = (kinds > 1) & (np.bincount(cls, weights=alone, minlength=len(kinds)) > 0)
            chosen = np.flatnonzero(head & open_class[cls])
            need = e[chosen]
            want = np.empty(len(need), WANT)
            for name in WANT.names:
                want[name] = need[name]
            # the flag now says that the segment is settled and only serves as a partner
            want["span"] = np.where((twice | known)[chosen], want["span"] | KNOWN, want["span"])
            many = (kinds > hot)[cls[chosen]]
            for kind, part in ((2, ~many), (3, many)):
                yield from _found(kind, list(_packed(need["uid"][part], want[part])))

    return found.select("bucket", "rows").mapInArrow(run, FOUND)


def _common(a: bytes, b: bytes) -> int:
    """Length of the longest common prefix."""
    n = min(len(a), len(b))
    x = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (x.bit_length() + 7) // 8


class SuffixLevels:
    """A logarithmic family of sparse suffix arrays.

    A level is a sorted list of (suffix, member).  `add` sorts a batch's suffixes and merge-scans them with each level:
    where neighbours of the merged list extend to `size` bytes in all, it calls match(member, member, left, right).
    Then levels of equal size merge."""

    def __init__(self, lefts: list[bytes], size: int, match) -> None:
        self.lefts, self.size, self.match, self.levels = lefts, size, match, []

    def _pair(self, a: tuple[bytes, int], b: tuple[bytes, int]) -> None:
        right = _common(a[0], b[0])
        if right:
            left = _common(self.lefts[a[1]], self.lefts[b[1]])
            if left + right >= self.size:
                self.match(a[1], b[1], left, right)

    def _scan(self, suffixes: list[tuple[bytes, int]], first: int) -> None:
        """Neighbours of which one at least is new and, where `first` is given, one is not."""
        for a, b in zip(suffixes[:-1], suffixes[1:], strict=True):
            if (a[1] < first) != (b[1] < first) or not first:
                self._pair(a, b)

    def add(self, batch: list[tuple[bytes, int]]) -> None:
        """Members are numbered upwards from batch to batch."""
        batch = sorted(batch)
        first = min((m for _, m in batch), default=0)
        self._scan(batch, 0)
        for level in self.levels:
            self._scan(sorted(level + batch), first)  # two sorted runs: one linear merge
        self.levels.append(batch)
        while len(self.levels) > 1 and len(self.levels[-1]) * 2 > len(self.levels[-2]):
            last = self.levels.pop()
            self.levels[-1] = sorted(self.levels[-1] + last)


def _segments(docs: DataFrame, want: DataFrame, buckets: int, size: int) -> DataFrame:
    """(bucket, rows): by anchor string, the wanted segments with their bytes: count, uid and WANT of each, then bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, bytes, bytes]] = []
        volume = 0

        def flush() -> Iterator[pa.RecordBatch]:
            held.sort(key=lambda x: x[0])
            keys = np.array([x[0] for x in held])
            cuts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]).tolist()
            for i, j in zip(cuts, [*cuts[1:], len(held)], strict=True):
                rows = (j - i).to_bytes(8, "little") + b"".join(x[1] for x in held[i:j]) + b"".join(x[2] for x in held[i:j])
                yield pa.RecordBatch.from_arrays([pa.array([held[i][0]], pa.int32()), pa.array([rows], pa.binary())], names=["bucket", "rows"])

        for batch in batches:
            texts = text_array(batch, "text")
            for i, (uid, rows) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2), strict=True)):
                data = texts[i].as_buffer().to_pybytes()
                own = np.frombuffer(rows.as_buffer(), WANT)
                head = uid.to_bytes(8, "little", signed=True)
                for w in own:
                    lo, span = int(w["lo"]), int(w["span"]) & (KNOWN - 1)
                    held.append((int(w["kmer"] % U(buckets)), head + w.tobytes(), data[lo : lo + span + size]))
                    volume += span + size
                if volume > 8 << 20:
                    yield from flush()
                    held, volume = [], 0
        if held:
            yield from flush()
        held = []
        give_back()

    return docs.join(want, "uid").select("uid", "text", "rows").mapInArrow(run, "bucket int, rows binary")


MEMBER = np.dtype([("uid", "<u8"), ("kmer", "<u8"), ("lo", "<u4"), ("span", "<u2"), ("at", "<u2")])


def _match(segments: DataFrame, size: int) -> DataFrame:
    """Kind 1: stretches of the segments at the edges of matches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _by_bucket(batches):
            members, datas = [], []
            for rows in held:
                n = int.from_bytes(rows[:8], "little")
                members.append(np.frombuffer(rows, MEMBER, n, 8))
                datas.append(rows[8 + n * MEMBER.itemsize :])
            m = np.concatenate(members)
            span = (m["span"] & (KNOWN - 1)).astype(np.int64)
            known = (m["span"] & KNOWN) > 0
            ends = np.cumsum(span + size)
            starts = ends - span - size
            raw = np.frombuffer(b"".join(datas), np.uint8)
            covered = _match_levels(m, members, raw, starts, ends, span, size)
            _match_exact(m, raw, starts, span, size, covered)
            # covered: a flag for each window, at its place in raw; the last size - 1 bytes of a segment begin none
            own = ~known
            flag = np.repeat(own, span + size) & covered
            lo, hi = tv.runs(flag, np.concatenate([starts, ends[-1:]]))
            who = np.searchsorted(starts, lo, "right") - 1
            s = np.empty(len(lo), STRETCH)
            s["lo"] = m["lo"][who] + (lo - starts[who])
            s["hi"] = m["lo"][who] + (hi - 1 - starts[who]) + size
            yield from _found(1, list(_packed(m["uid"][who], s)))
        give_back()

    return segments.mapInArrow(run, FOUND)


def _match_levels(m, members, raw, starts, ends, span, size) -> np.ndarray:
    data = raw.tobytes()
    at = (starts + m["at"]).tolist()
    lo, hi = starts.tolist(), ends.tolist()
    spans, offsets = span.tolist(), m["at"].tolist()
    covered = np.zeros(len(raw), bool)
    lefts = [data[a:b][::-1] for a, b in zip(lo, at, strict=True)]

    def match(a: int, b: int, left: int, right: int) -> None:
        for i in (a, b):  # windows from `left` before the anchor on that end within `right` of it, among the anchor's own
            first, last = max(offsets[i] - left, 0), min(offsets[i] + right - size, spans[i])
            if last >= first:
                covered[lo[i] + first : lo[i] + last + 1] = True

    levels = SuffixLevels(lefts, size, match)
    done = 0
    for part in members:
        levels.add([(data[at[i] : hi[i]], i) for i in range(done, done + len(part))])
        done += len(part)
    return covered


def _match_exact(m, raw, starts, span, size, covered) -> None:
    """Windows that neighbours left open, in classes of three members or more, by fingerprint."""
    _, cls, count = np.unique(m["kmer"], return_inverse=True, return_counts=True)
    shut = np.add.reduceat(covered, starts) == span + 1
    open_class = np.bincount(cls, weights=~shut, minlength=len(count)) > 0
    todo = np.flatnonzero((count[cls] > 2) & open_class[cls])
    todo = todo[np.argsort(cls[todo], kind="stable")]
    total = np.cumsum(span[todo] + 1)
    sums = tv.prefix_sums(raw) if len(todo) else None
    i = 0
    while i < len(todo):
        j = int(np.searchsorted(total, (total[i - 1] if i else 0) + (1 << 21), "right"))
        j = max(j, i + 1)
        while j < len(todo) and cls[todo[j]] == cls[todo[j - 1]]:
            j += 1
        part = todo[i:j]
        n = span[part] + 1
        p = np.repeat(starts[part] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        with np.errstate(over="ignore"):
            h = tv.mix(tv.mix(tv.stretch_hash(sums, p, p + size)) + np.repeat(m["kmer"][part], n))
        order = np.argsort(h, kind="stable")
        same = h[order][1:] == h[order][:-1]
        twice = np.zeros(len(p), bool)
        twice[1:] |= same
        twice[:-1] |= same
        covered[p[order[twice]]] = True
        i = j


def _hot_windows(docs: DataFrame, want: DataFrame, buckets: int, size: int) -> DataFrame:
    """Kind 4: fingerprints of all windows of the wanted segments, by bucket of the fingerprint; kind 1: stretches of
    those that repeat inside a task, of which only one travels on.  So a class of any size is spread over all tasks."""

    def flush(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        w = np.concatenate(held)
        w = w[np.argsort(w["hash"], kind="stable")]
        head = np.r_[True, w["hash"][1:] != w["hash"][:-1]]
        group = np.cumsum(head) - 1
        twice = np.bincount(group)[group] > 1
        yield from _window_stretches(w[twice & (w["known"] == 0)], size)
        w["known"][twice] = 1
        w = w[head]
        yield from _found(4, list(_packed(w["hash"] % U(buckets), w)), True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            texts = text_array(batch, "text")
            uids = batch.column(0).to_numpy(zero_copy_only=False).view(U)
            for i, packed in enumerate(batch.column(2)):
                raw = np.frombuffer(texts[i].as_buffer().to_pybytes(), np.uint8)
                for x in np.frombuffer(packed.as_buffer(), WANT):
                    lo, n = int(x["lo"]), (int(x["span"]) & (KNOWN - 1)) + 1
                    w = np.empty(n, WINDOW)
                    at = np.arange(n)
                    with np.errstate(over="ignore"):
                        w["hash"] = tv.mix(tv.mix(tv.stretch_hash(tv.prefix_sums(raw[lo : lo + n - 1 + size]), at, at + size)) + x["kmer"])
                    w["uid"], w["lo"], w["known"] = uids[i], lo + at, int(x["span"]) >= KNOWN
                    held.append(w)
                    rows += n
                if rows > 500_000:
                    yield from flush(held)
                    held, rows = [], 0
        if held:
            yield from flush(held)
        held = []
        give_back()

    return docs.join(want, "uid").select("uid", "text", "rows").mapInArrow(run, FOUND)


def _window_stretches(w: np.ndarray, size: int) -> Iterator[pa.RecordBatch]:
    s = np.empty(len(w), STRETCH)
    s["lo"], s["hi"] = w["lo"], w["lo"] + size
    yield from _found(1, list(_packed(w["uid"], s)))


def _hot_settle(windows: DataFrame, size: int) -> DataFrame:
    """Kind 1: stretches of windows whose fingerprint occurs again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _by_bucket(batches):
            w = np.frombuffer(b"".join(held), WINDOW)
            w = w[np.argsort(w["hash"], kind="stable")]
            group = np.cumsum(np.r_[True, w["hash"][1:] != w["hash"][:-1]]) - 1
            yield from _window_stretches(w[(np.bincount(group)[group] > 1) & (w["known"] == 0)], size)
        give_back()

    return windows.mapInArrow(run, FOUND)


def _gathered(found: DataFrame, merge: bool) -> DataFrame:
    """(uid, rows): what was found for each document as one binary; stretches are merged where they touch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for lists in batch.column(1):
                rows = b"".join(x.as_buffer().to_pybytes() for x in lists.values)
                if merge:
                    s = np.sort(np.frombuffer(rows, STRETCH), order=["lo", "hi"])
                    high = np.maximum.accumulate(s["hi"])
                    head = np.flatnonzero(np.r_[True, s["lo"][1:] > high[:-1]])
                    joined = np.empty(len(head), STRETCH)
                    joined["lo"], joined["hi"] = s["lo"][head], high[np.r_[head[1:] - 1, len(s) - 1]]
                    rows = joined.tobytes()
                out.append(rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["uid", "rows"])

    return found.groupBy("uid").agg(F.collect_list("rows").alias("lists")).mapInArrow(run, "uid long, rows binary")


def _maybe_broadcast(lists: DataFrame) -> DataFrame:
    n = lists.agg(F.count("*"), F.sum(F.length("rows"))).first()
    return F.broadcast(lists) if n[0] <= BROADCAST_ROWS and (n[1] or 0) <= BROADCAST_BYTES else lists


def covered_stretches(docs: DataFrame, size: int = SIZE, k: int = K, hot: int | None = None) -> DataFrame:
    """(uid, rows): packed stretches to remove, for documents (uid, text) that have any."""
    width = shuffle_width(docs.sparkSession)

    def dealt(rows: DataFrame) -> DataFrame:
        return rows.repartition(width, "bucket").sortWithinPartitions("bucket")

    first = materialise(_anchors(docs, 4 * width, size, k), "anchors")
    second = materialise(_settle(dealt(first.where("kind = 0").select("kind", "bucket", "rows")), size, HOT if hot is None else hot), "settled")
    want = materialise(_gathered(second.where("kind = 2").select("uid", "rows"), False), "wanted")
    segments = _segments(docs, _maybe_broadcast(want), 4 * width, size)
    found = [first, second, materialise(_match(dealt(segments), size), "matched")]
    if not second.where("kind = 3").isEmpty():
        much = materialise(_gathered(second.where("kind = 3").select("uid", "rows"), False), "wanted")
        windows = materialise(_hot_windows(docs, _maybe_broadcast(much), 4 * width, size), "windows")
        found += [windows, materialise(_hot_settle(dealt(windows.where("kind = 4").select("bucket", "rows")), size), "hot")]
    every = [x.where("kind = 1").select("uid", "rows") for x in found]
    out = materialise(_gathered(reduce(DataFrame.unionByName, every), True), "stretches")
    discard(want, *found)
    return out


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, k: int = K, with_text: bool = False, hot: int | None = None) -> DataFrame:
    """id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, kept (binary), text (the same as a string, with
    U+FFFD where a cut parts a character) and spans (byte offsets)."""
    own = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    own = own.select("id", "text", F.xxhash64("id", "text").alias("uid"))
    gone = covered_stretches(own.select("uid", "text"), size, k, hot)
    kind = dict(docs.dtypes)[id_col]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = text_array(batch, "text")
            out: dict[str, list] = {c: [] for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "text", "spans")}
            for text, rows in zip(texts, batch.column(2), strict=True):
                data = text.as_buffer().to_pybytes()
                kept, spans = data, []
                if rows.is_valid:
                    s = np.frombuffer(rows.as_buffer(), STRETCH)
                    spans = [x for pair in s.tolist() for x in pair]
                    edges = [0, *spans, len(data)]
                    kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                out["n_bytes"].append(len(data))
                out["n_removed"].append(len(data) - len(kept))
                out["n_spans"].append(len(spans) // 2)
                out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
                if with_text:
                    out["kept"].append(kept)
                    out["text"].append(kept.decode("utf-8", "replace"))
                    out["spans"].append(spans)
            cols = {id_col: batch.column(0)} | {c: pa.array(out[c], pa.int64()) for c in ("n_bytes", "n_removed", "n_spans")} | {"kept_sha256": pa.array(out["kept_sha256"], pa.string())}
            if with_text:
                cols |= {"kept": pa.array(out["kept"], pa.binary()), "text": pa.array(out["text"], pa.string()), "spans": pa.array(out["spans"], pa.list_(pa.int64()))}
            yield pa.RecordBatch.from_pydict(cols)
        give_back()

    met = own.join(_maybe_broadcast(gone), "uid", "left").select("id", "text", "rows")
    schema = f"`{id_col}` {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary, text string, spans array<long>" * with_text
    return met.mapInArrow(cut, schema)
