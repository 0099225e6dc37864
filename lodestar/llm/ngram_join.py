"""N-gram Jaccard join: size-banded tiles, hashed bitmap signatures, exact sorted-array intersection.

Words are runs without white space, A-Z lower-cased; a document's set holds its distinct n-word shingles (the whole
sequence as one shingle where it has fewer words).  Two documents link when their sets' Jaccard similarity is at least
the threshold.  Every link between different sets is found:

1. `sets`: size, a 128-bit fingerprint, a few min-hashes and a bitmap of each document's set, and how often shingles fall in
   each of 2**HIST hash cells (a table of fixed size over all documents).  Equal sets become one vertex.
2. `tiles`: shingles ordered by (cell count, hash), rare ones first; two sets that link share a shingle in their first
   n - ceil(t n) + 1 (prefix filter).  Prefixes meet by shingle, as packed arrays; the sets that share one are cut
   into size bands, and a tile holds two neighbouring bands.
3. min-hash stars and small tiles give first pairs.  A pair is checked by bitmap first: each set has a parity bitmap
   of 4 bits or more an element, and the differing bits bound the overlap from above; what passes is intersected exactly.
4. Tiles whose members aren't yet connected are compared with bitmaps, only across components and in blocks.  First a
   block gives one pair for each two components with pairs well within the bound; these are checked exactly and join
   most of what belongs together.  Then, over the tiles that are still mixed, a block gives the pairs that bitmaps don't
   rule out, as long as they are PAIRS for each member at most; beyond that it names the members of such pairs, which
   come back with their sets: pairs are intersected in the block, and only the links that tie its components together
   leave it.  So neither copies in thousands nor thousands of
   documents just below the bound make rows of pairs, and no link is lost.

64-bit hashes stand for shingles; the fingerprint of a set has 128 bits.

Defined results: null and blank texts have no set and link with nothing; repeated rows and rows that share an id count
as one document; rows with a null id link with nothing and get a null component; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .common import discard, give_back, materialise, pieces, shuffle_width
from .components import components

U = np.uint64
#: Bits of a shingle's hash that choose its cell.
HIST = 18
#: Min-hashes of each set for the first stars.
STARS = 6
#: Tiles of up to so many members give all their pairs at once.
SMALL = 4
#: Vertices of a tile are compared in blocks of so many.
BLOCK = 1024
#: Pairs whose differing bits are at most this share of what is allowed all but certainly link.
SURE = 0.8
#: Pairs near the bound that a block gives for each member; beyond that they are intersected in the block.
PAIRS = 4
#: Elements of a set that count as one member of a block: long sets make smaller blocks.
WEIGHT = 1024
#: Candidate ids are broadcast to the scan up to this number (16 MB of ids) and joined by a shuffle beyond it.
BROADCAST_IDS = 2_000_000


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, n: int = 5) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    _, _, own, h = tv.words(tv.lower_ascii(raw), offsets)
    texts = len(offsets) - 1
    count = np.bincount(own, minlength=texts)
    gram, at = tv.grams(h, own, n)
    cuts = np.searchsorted(own[at], np.arange(texts + 1))
    first = np.concatenate([[0], np.cumsum(count)])
    out = []
    for i in range(texts):
        if count[i] >= n:
            out.append(np.unique(gram[cuts[i] : cuts[i + 1]]))
        elif count[i]:
            one = U(count[i])
            for x in h[first[i] : first[i + 1]]:
                with np.errstate(over="ignore"):
                    one = tv.mix(np.array([one * tv.BASE + x], U))[0]
            out.append(np.array([one], U))
        else:
            out.append(np.empty(0, U))
    return out


def _signed(x) -> np.ndarray:
    return np.asarray(x, U).view(np.int64)


_SALT = tv._stream(STARS, 101)


def _fingerprints(sets: list[np.ndarray], seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two 64-bit sums and STARS minima for each set."""
    sizes = np.array([len(s) for s in sets])
    one, two, low = np.zeros(len(sets), U), np.zeros(len(sets), U), np.zeros((len(sets), STARS), U)
    full = np.flatnonzero(sizes)
    if len(full):
        flat = np.concatenate([sets[i] for i in full]) ^ U(seed)
        at = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
        with np.errstate(over="ignore"):
            one[full] = tv.mix(np.add.reduceat(tv.mix(flat), at) + sizes[full].astype(U))
            two[full] = np.add.reduceat(tv.mix(flat ^ U(0x5851F42D4C957F2D)), at)
            for k in range(STARS):
                low[full, k] = np.minimum.reduceat(tv.mix(flat ^ _SALT[k]), at)
    return one, two, low


def sets(docs: DataFrame, id_col: str, text_col: str, n: int, seed: int = 0) -> DataFrame:
    """A row for each document, and a last row of each task with its cell counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(1 << HIST, np.uint32)
        schema = pa.schema([("id", pa.int64()), ("size", pa.int64()), ("fp", pa.int64()), ("fq", pa.int64()), ("low", pa.list_(pa.int64())), ("bits", pa.binary()), ("cells", pa.binary())])
        for batch in batches:
            for lo, hi, raw, offsets in pieces(batch, "text"):
                own = shingle_sets(raw, offsets, n)
                flat = np.concatenate(own)
                cells += np.bincount((flat >> U(64 - HIST)).astype(np.int64), minlength=1 << HIST).astype(np.uint32)
                one, two, low = _fingerprints(own, seed)
                sizes = np.array([len(s) for s in own], np.int64)
                minima = pa.ListArray.from_arrays(np.arange(hi - lo + 1, dtype=np.int32) * STARS, pa.array(_signed(low.ravel())))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(sizes), pa.array(_signed(one)), pa.array(_signed(two)), minima, pa.array([bitmap(x) for x in own], pa.binary()), pa.nulls(hi - lo, pa.binary())], schema=schema)
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([-1]), pa.array([0]), pa.array([0]), pa.array([None], pa.list_(pa.int64())), pa.nulls(1, pa.binary()), pa.array([cells.tobytes()], pa.binary())], schema=schema)

    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return own.mapInArrow(run, "id long, size long, fp long, fq long, low array<long>, bits binary, cells binary")


def _cell_counts(found: DataFrame) -> np.ndarray:
    """Sum of all tasks' cells: of fixed size, added up in the executors first."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << HIST, np.uint64)
        for batch in batches:
            for x in batch.column(0):
                part = np.frombuffer(x.as_py(), np.uint8)
                total += np.frombuffer(part, np.uint32 if part.size == 4 << HIST else np.uint64)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["cells"])

    own = found.where("size = -1").select("cells").mapInArrow(add, "cells binary").repartition(8).mapInArrow(add, "cells binary")
    return sum((np.frombuffer(r[0], np.uint64) for r in own.collect()), np.zeros(1 << HIST, np.uint64))


def _prefix(s: np.ndarray, cells: np.ndarray, percent: int) -> np.ndarray:
    """The shingles of a set by which every set that links with it can be found; those alone in their cell can't be shared."""
    count = cells[(s >> U(64 - HIST)).astype(np.int64)]
    order = np.argsort((np.minimum(count, U((1 << 24) - 1)) << U(40)) | (s >> U(24)), kind="stable")
    take = order[: len(s) - (len(s) * percent + 99) // 100 + 1]
    return s[take[count[take] > 1]]


POSTING = np.dtype([("token", "<u8"), ("fp", "<u8"), ("size", "<u4")])


def _postings(docs: DataFrame, cells, id_col: str, text_col: str, n: int, percent: int, buckets: int, seed: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        counts = cells.value
        for batch in batches:
            for _, _, raw, offsets in pieces(batch, "text"):
                own = shingle_sets(raw, offsets, n)
                one, _, _ = _fingerprints(own, seed)
                for s, fp in zip(own, one, strict=True):
                    if len(s):
                        t = _prefix(s, counts, percent)
                        p = np.empty(len(t), POSTING)
                        p["token"], p["fp"], p["size"] = t, fp, len(s)
                        held.append(p)
                        rows += len(t)
                if rows > 1_500_000:
                    yield from _pack(held, buckets)
                    held, rows = [], 0
        yield from _pack(held, buckets)
        held = []
        give_back()

    own = docs.where(F.col(id_col).isNotNull()).select(F.col(text_col).alias("text"))
    return own.mapInArrow(run, "bucket int, postings binary")


def _pack(held: list[np.ndarray], buckets: int) -> Iterator[pa.RecordBatch]:
    if not held:
        return
    p = np.concatenate(held)
    b = (p["token"] % U(buckets)).astype(np.int64)
    order = np.lexsort((p["fp"], p["token"], b))
    p, b = p[order], b[order]
    fresh = np.ones(len(p), bool)
    fresh[1:] = (p["token"][1:] != p["token"][:-1]) | (p["fp"][1:] != p["fp"][:-1])
    p, b = p[fresh], b[fresh]
    cuts = np.flatnonzero(np.r_[True, b[1:] != b[:-1]])
    ends = np.r_[cuts[1:], len(b)]
    yield pa.RecordBatch.from_arrays([pa.array(b[cuts].astype(np.int32)), pa.array([p[i:j].tobytes() for i, j in zip(cuts, ends, strict=True)], pa.binary())], names=["bucket", "postings"])


def _tiles(postings: DataFrame, percent: int) -> DataFrame:
    """Of each bucket: pairs of small tiles (a, b) and larger tiles as packed members, each once a bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [], None
        for batch in batches:
            for b, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if b != now and held:
                    yield from _meet(held, percent)
                    held = []
                now = b
                held.append(np.frombuffer(x.as_buffer(), POSTING).copy())
        if held:
            yield from _meet(held, percent)
        held = []
        give_back()

    return postings.mapInArrow(run, "a long, b long, g1 long, g2 long, members binary")


MEMBER = np.dtype([("fp", "<u8"), ("size", "<u4")])


def _meet(held: list[np.ndarray], percent: int) -> Iterator[pa.RecordBatch]:
    p = np.concatenate(held)
    p = p[np.lexsort((p["fp"], p["size"], p["token"]))]
    fresh = np.ones(len(p), bool)
    fresh[1:] = (p["token"][1:] != p["token"][:-1]) | (p["fp"][1:] != p["fp"][:-1])
    p = p[fresh]
    cuts = np.flatnonzero(np.r_[True, p["token"][1:] != p["token"][:-1]])
    ends = np.r_[cuts[1:], len(p)]
    many = ends - cuts > 1
    one, two = [], []
    tiles: dict[bytes, np.ndarray] = {}
    band_base = np.log(100 / percent)
    for i, j in zip(cuts[many], ends[many], strict=True):
        size = p["size"][i:j].astype(np.int64)
        if j - i <= SMALL:
            x, y = np.triu_indices(j - i, 1)
            ok = 100 * size[x] >= percent * size[y]
            one.append(p["fp"][i:j][x[ok]])
            two.append(p["fp"][i:j][y[ok]])
            continue
        band = np.floor(np.log(size) / band_base).astype(np.int64)
        for k in np.unique(band):
            lo, hi = np.searchsorted(band, k), np.searchsorted(band, k + 1, "right")
            above = np.searchsorted(band, k, "right")
            if hi - lo < 2 or hi == above and lo and band[lo - 1] == k - 1:
                continue  # one member, or held by the tile of the band below
            own = np.empty(hi - lo, MEMBER)
            own["fp"], own["size"] = p["fp"][i + lo : i + hi], size[lo:hi]
            tiles[own.tobytes()] = own
    if one:
        a, b = np.concatenate(one), np.concatenate(two)
        low, high = np.minimum(a, b), np.maximum(a, b)
        pairs = np.unique(np.rec.fromarrays([low, high], names="a,b"))
        n = len(pairs)
        none = pa.nulls(n, pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(_signed(np.ascontiguousarray(pairs.a))), pa.array(_signed(np.ascontiguousarray(pairs.b))), none, none, pa.nulls(n, pa.binary())], names=["a", "b", "g1", "g2", "members"])
    items = list(tiles.items())
    for at in range(0, len(items), 256):
        part = items[at : at + 256]
        g1, g2, _ = _fingerprints([x["fp"] for _, x in part])
        none = pa.nulls(len(part), pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, pa.array(_signed(g1)), pa.array(_signed(g2)), pa.array([k for k, _ in part], pa.binary())], names=["a", "b", "g1", "g2", "members"])


def _bits(size: int) -> int:
    """Bits of a set's bitmap: a power of two, 4 or more for each element, and 8 or more up to 4096 bits and 1024 at
    least, as chance weighs more in small sets.  It never falls as the size grows."""

    def power(n: int) -> int:
        return 1 << int(n - 1).bit_length()

    return max(1024, power(4 * size), min(power(8 * size), 4096))


def bitmap(s: np.ndarray) -> bytes:
    """Parity of the elements in each cell; a larger map folds to a smaller one by xor of its halves."""
    bits = _bits(len(s))
    odd = np.bincount((s & U(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _fold(x: np.ndarray, size: int) -> np.ndarray:
    while len(x) > size:
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return x


def may_link(a: bytes, b: bytes, na: int, nb: int, percent: int) -> bool:
    """Differing bits are at most differing elements; so many at most are allowed."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    size = min(len(x), len(y))
    d = int(np.bitwise_count(_fold(x, size) ^ _fold(y, size)).sum())
    return (100 + percent) * d <= (100 - percent) * (na + nb)


def links(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Exact: both sorted and distinct."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    both = int((b[np.minimum(at, len(b) - 1)] == a).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def _elements(docs: DataFrame, reps: DataFrame, id_col: str, text_col: str, n: int, seed: int) -> DataFrame:
    """Packed set of each vertex in reps (fp, rep), from the text of the document that stands for it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, raw, offsets in pieces(batch, "text"):
                own = shingle_sets(raw, offsets, n)
                one, _, _ = _fingerprints(own, seed)
                want = batch.column(0).slice(lo, hi - lo).to_numpy(zero_copy_only=False)
                hit = np.flatnonzero((_signed(one) == want) & np.array([len(s) > 0 for s in own], bool))
                yield pa.RecordBatch.from_arrays([pa.array(_signed(one)[hit]), pa.array([own[i].tobytes() for i in hit], pa.binary())], names=["fp", "elements"])

    kept = reps = materialise(reps, "reps")
    if reps.count() <= BROADCAST_IDS:
        reps = F.broadcast(reps)
    text = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("rep"), F.col(text_col).alias("text"))
    found = text.join(reps, "rep").select("fp", "text").mapInArrow(run, "fp long, elements binary")
    out = materialise(found.dropDuplicates(["fp"]), "elements")
    discard(kept)
    return out


def _both(pairs: DataFrame, table: DataFrame, *cols: tuple[str, str]) -> DataFrame:
    """Columns of both vertices of each pair."""
    for side in ("a", "b"):
        pairs = pairs.join(table.select(F.col("fp").alias(side), *(F.col(c).alias(f"{short}{side}") for c, short in cols)), side)
    return pairs


def _verify(pairs: DataFrame, vertices: DataFrame, docs: DataFrame, id_col: str, text_col: str, n: int, percent: int, seed: int) -> DataFrame:
    """Of distinct pairs (a, b) those that link: by bitmaps first, then by the sets of those that bitmaps leave."""

    def by_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = batch.to_pydict()
            keep = [may_link(*x, percent) for x in zip(c["ba"], c["bb"], c["na"], c["nb"], strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    def exactly(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ea, eb = batch.column(2), batch.column(3)
            keep = [links(np.frombuffer(x.as_buffer(), U), np.frombuffer(y.as_buffer(), U), percent) for x, y in zip(ea, eb, strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    near = _both(pairs, vertices, ("bits", "b"), ("size", "n")).where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
    near = materialise(near.select("a", "b", "ba", "bb", "na", "nb").mapInArrow(by_bits, "a long, b long"), "near")
    ends = near.select(F.col("a").alias("fp")).union(near.select("b")).distinct()
    elements = _elements(docs, vertices.select("fp", "rep").join(ends, "fp"), id_col, text_col, n, seed)
    out = materialise(_both(near, elements, ("elements", "e")).select("a", "b", "ea", "eb").mapInArrow(exactly, "a long, b long"), "links")
    discard(near, elements)
    return out


def _members(tiles: DataFrame) -> DataFrame:
    """A row for each tile and member: tile (g1, g2), its members' weight in all, fp and weight."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for g1, g2, x in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
                m = np.frombuffer(x.as_buffer(), MEMBER)
                n = len(m)
                weight = 1 + m["size"].astype(np.int64) // WEIGHT
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, g1.as_py())), pa.array(np.full(n, g2.as_py())), pa.array(np.full(n, weight.sum())), pa.array(_signed(m["fp"].copy())), pa.array(weight)], names=["g1", "g2", "members", "fp", "weight"])

    return tiles.select("g1", "g2", "members").mapInArrow(explode, "g1 long, g2 long, members long, fp long, weight long")


def _blocks(members: DataFrame) -> DataFrame:
    """Members (with component) of the tiles that hold more than one component, once for each pair of blocks (i, j).

    A small tile is one block.  In others the largest component has blocks of its own, which are only compared with
    those of the rest: a tile of a large component and few others is linear in its members.  Members meet their tile's
    row by block, never all of a tile in one task."""
    kinds = members.groupBy("g1", "g2", "members", "component").agg(F.sum("weight").alias("n"))
    mixed = kinds.groupBy("g1", "g2", "members").agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.max("n").alias("n"), F.count("*").alias("kinds")).where("kinds > 1")
    one = F.col("members") <= BLOCK
    mixed = mixed.select("g1", "g2", F.when(~one, F.col("main")).alias("main"), F.when(one, 0).otherwise(F.ceil(F.col("n") / BLOCK)).cast("int").alias("k"), F.when(one, 1).otherwise(F.ceil((F.col("members") - F.col("n")) / BLOCK)).cast("int").alias("rest"), F.explode(F.sequence(F.lit(0), F.floor(F.col("members") / BLOCK).cast("int"))).alias("salt"))
    hashed = F.xxhash64("fp")
    out = members.withColumn("salt", F.pmod(hashed, F.floor(F.col("members") / BLOCK) + 1).cast("int")).join(mixed, ["g1", "g2", "salt"])
    inner = F.coalesce(F.col("component") == F.col("main"), F.lit(False))
    out = out.withColumn("inner", inner).withColumn("block", F.when(F.col("inner"), F.pmod(hashed, F.greatest("k", F.lit(1)))).otherwise(F.col("k") + F.pmod(hashed, F.greatest("rest", F.lit(1)))).cast("int"))
    others = F.sequence(F.when(F.col("inner"), F.col("k")).otherwise(0), F.col("k") + F.col("rest") - 1)
    sides = F.transform(others, lambda t: F.struct(F.least("block", t).alias("i"), F.greatest("block", t).alias("j")))
    return out.select("g1", "g2", "block", "fp", "component", F.explode(sides).alias("s")).select("g1", "g2", "s.i", "s.j", "block", "fp", "component")


class _Block:
    """Members of a pair of blocks in the order of size, and the partners that bitmaps leave to each."""

    def __init__(self, fp: np.ndarray, comp: np.ndarray, block: np.ndarray, size: np.ndarray, maps: list[np.ndarray], percent: int):
        self.order = np.lexsort((fp, size))
        self.fp, self.block, self.size, self.percent = fp[self.order], block[self.order], size[self.order], percent
        _, self.label = np.unique(comp[self.order], return_inverse=True)
        self.maps = [maps[k] for k in self.order]
        self.words = np.array([len(x) for x in self.maps])
        kinds, first = np.unique(self.words, return_index=True)
        # sizes ascend, and so do the maps' widths: each width's rows lie side by side
        self.span = {int(w): (int(lo), int(hi)) for w, lo, hi in zip(kinds, first, [*first[1:], len(self.words)], strict=True)}
        self.table = {w: np.stack(self.maps[lo:hi]) for w, (lo, hi) in self.span.items()}
        self.folded: dict[tuple[int, int], np.ndarray] = {}
        self.two = len(np.unique(self.block)) > 1
        self.highest = np.searchsorted(self.size, self.size * 100 // percent, "right")

    def partners(self, x: int, share: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
        """Later members of other components that may link with x, and by how many bits they differ from it; share: of the
        bits that are allowed."""
        hi = int(self.highest[x])
        apart = self.label[x + 1 : hi] != self.label[x]
        y = x + 1 + np.flatnonzero(apart & (self.block[x + 1 : hi] != self.block[x]) if self.two else apart)
        mine, gap = self.maps[x], np.empty(len(y), np.int64)
        for w in np.unique(self.words[y]).tolist():
            theirs = self.table[w]
            if w != len(mine):
                if (w, len(mine)) not in self.folded:
                    self.folded[w, len(mine)] = np.bitwise_xor.reduce(theirs.reshape(len(theirs), -1, len(mine)), 1)
                theirs = self.folded[w, len(mine)]
            at = self.words[y] == w
            gap[at] = np.bitwise_count(theirs[y[at] - self.span[w][0]] ^ mine).sum(1)
        ok = (100 + self.percent) * gap <= share * (100 - self.percent) * (self.size[y] + self.size[x])
        return y[ok], gap[ok]

    def unite(self, x: int, labels: np.ndarray) -> None:
        self.label[np.isin(self.label, np.append(labels, self.label[x]))] = self.label[x]

    def sure(self) -> list[tuple[int, int]]:
        """Of each two components that meet well within the bound one pair; the two then count as one."""
        out = []
        for x in range(len(self.fp) - 1):
            y, gap = self.partners(x, SURE)
            if len(y):
                near = np.lexsort((gap, self.label[y]))
                met, first = np.unique(self.label[y[near]], return_index=True)
                out += [(int(self.fp[x]), int(self.fp[t])) for t in y[near[first]]]
                self.unite(x, met)
        return out

    def open(self, most: int) -> tuple[np.ndarray, list[tuple[int, int]]]:
        """Pairs that bitmaps leave, if they are `most` for each member at most; else the members of such pairs, by their place
        in what came in."""
        hit, pairs, few = np.zeros(len(self.fp), bool), [], True
        for x in range(len(self.fp) - 1):
            y, _ = self.partners(x)
            hit[y] = True
            hit[x] |= len(y) > 0
            few = few and len(pairs) + len(y) <= most * len(self.fp)
            if few:
                pairs += [(int(self.fp[x]), int(self.fp[t])) for t in y]
        return (self.order[:0], pairs) if few else (self.order[hit], [])

    def linked(self, elements: list[np.ndarray]) -> list[tuple[int, int]]:
        """Links between components, found by exact intersection, the closest bitmaps first; each makes two components one."""
        sets = [elements[k] for k in self.order]
        out = []
        for x in range(len(self.fp) - 1):
            y, gap = self.partners(x)
            for t in y[np.argsort(gap, kind="stable")]:
                if self.label[t] != self.label[x] and links(sets[x], sets[t], self.percent):
                    out.append((int(self.fp[x]), int(self.fp[t])))
                    self.unite(x, self.label[t : t + 1])
        return out


def _block_of(group: pa.Table, percent: int) -> _Block:
    maps = [np.frombuffer(x.as_buffer(), np.uint64) for x in group.column("bits").combine_chunks()]
    return _Block(*(group.column(c).to_numpy() for c in ("fp", "component", "block", "size")), maps, percent)


def _pair_table(found: list[tuple[int, int]]) -> pa.Table:
    return pa.table({"a": pa.array([min(p) for p in found], pa.int64()), "b": pa.array([max(p) for p in found], pa.int64())})


def _sure_pairs(blocks: DataFrame, vertices: DataFrame, percent: int) -> DataFrame:
    """Distinct (a, b) of the blocks that all but certainly link and tie components together."""
    members = blocks.join(vertices.select("fp", "size", "bits"), "fp").select("g1", "g2", "i", "j", "block", "fp", "component", "size", "bits")
    found = members.groupBy("g1", "g2", "i", "j").applyInArrow(lambda group: _pair_table(_block_of(group, percent).sure()), "a long, b long")
    return materialise(found.distinct(), "sure")


def _links_across(blocks: DataFrame, vertices: DataFrame, docs: DataFrame, id_col: str, text_col: str, n: int, percent: int, seed: int) -> DataFrame:
    """(a, b): links that tie the components of each block together, by exact intersection of all pairs across them that
    bitmaps leave."""
    columns = ["g1", "g2", "i", "j", "block", "fp", "component", "size", "bits"]
    kinds = "g1 long, g2 long, i int, j int, block int, fp long, component long, size long, bits binary"
    members = blocks.join(vertices.select("fp", F.col("size").cast("long").alias("size"), "bits"), "fp").select(F.col("g1"), F.col("g2"), F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j"), F.col("block").cast("int").alias("block"), "fp", "component", "size", "bits")

    def sift(group: pa.Table) -> pa.Table:
        at, pairs = _block_of(group, percent).open(PAIRS)
        found = _pair_table(pairs)
        kept = group.select(columns).take(pa.array(at))
        return pa.concat_tables([kept, found], promote_options="default").select([*columns, "a", "b"])

    left = materialise(members.groupBy("g1", "g2", "i", "j").applyInArrow(sift, f"{kinds}, a long, b long"), "open")
    pairs = left.where("a is not null").select("a", "b").distinct()
    few = _verify(pairs, vertices, docs, id_col, text_col, n, percent, seed)
    left = left.where("a is null").drop("a", "b")
    if left.isEmpty():
        return few
    elements = _elements(docs, vertices.select("fp", "rep").join(left.select("fp").distinct(), "fp"), id_col, text_col, n, seed)

    def intersect(group: pa.Table) -> pa.Table:
        sets = [np.frombuffer(x.as_buffer(), U) for x in group.column("elements").combine_chunks()]
        return _pair_table(_block_of(group, percent).linked(sets))

    found = left.join(elements, "fp").select(*columns, "elements").groupBy("g1", "g2", "i", "j").applyInArrow(intersect, "a long, b long")
    out = materialise(found.unionByName(few).distinct(), "across")
    discard(elements, few)
    return out


def _rows_of_sets(docs: DataFrame, id_col: str, text_col: str, n: int) -> tuple[DataFrame, DataFrame, int]:
    """All rows of `sets`, its vertices (fp, rep, size, bits), and the seed with which no two sets share a fingerprint.

    Vertices are known by 64 bits; where two sets of one fingerprint differ in the other 64, all is made anew with
    the next seed, so sets count as equal only if 128 bits are."""
    seed = 0
    while True:
        found = materialise(sets(docs, id_col, text_col, n, seed), f"shingles-{seed}")
        vertex = found.where("size > 0 and id is not null")
        reps = materialise(vertex.groupBy("fp").agg(F.min("id").alias("rep"), F.min("fq").alias("x"), F.max("fq").alias("y")), "reps")
        if reps.where("x <> y").isEmpty():
            break
        seed += 1
    vertices = vertex.select("fp", F.col("id").alias("rep"), "size", "bits").join(reps.select("fp", "rep"), ["fp", "rep"]).dropDuplicates(["fp"])
    return found, materialise(vertices, "vertices"), seed


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 75) -> DataFrame:
    """id, n_shingles and component_id (the least id reachable by links) of every row, and its set's fingerprint."""
    spark = docs.sparkSession
    found, vertices, seed = _rows_of_sets(docs, id_col, text_col, n)
    cells = spark.sparkContext.broadcast(_cell_counts(found))  # 2 MB at any input
    rows = found.where("size >= 0").drop("cells")
    vertex = rows.where("size > 0 and id is not null")

    low = vertex.select("fp", F.posexplode("low").alias("k", "low"))
    stars = low.join(low.groupBy("k", "low").agg(F.min("fp").alias("lead"), F.max("fp").alias("last")).where("lead <> last"), ["k", "low"])
    stars = stars.where("fp <> lead").select(F.least("fp", "lead").alias("a"), F.greatest("fp", "lead").alias("b")).distinct()

    width = shuffle_width(spark)
    postings = _postings(docs, cells, id_col, text_col, n, percent, 4 * width, seed)
    met = materialise(_tiles(postings.repartition(width, "bucket").sortWithinPartitions("bucket"), percent), "tiles")
    small = met.where("g1 is null").select("a", "b")
    members = materialise(_members(met.where("g1 is not null").select("g1", "g2", "members").dropDuplicates(["g1", "g2"])), "members")
    # min() and max() order fingerprints as signed, tiles as unsigned: put both the same way round
    pairs = materialise(stars.unionByName(small.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))).distinct(), "pairs")

    linked = _verify(pairs, vertices, docs, id_col, text_col, n, percent, seed)
    own = components(linked, "clusters")
    discard(met, pairs, linked)

    def mixed(own: DataFrame) -> tuple[DataFrame, DataFrame]:
        placed = materialise(members.join(own.withColumnRenamed("v", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp")), "placed")
        return placed, _blocks(placed)

    def joined(own: DataFrame, fresh: DataFrame) -> DataFrame:
        return components(own.select(F.col("v").alias("a"), F.col("component").alias("b")).unionByName(fresh), "clusters")

    placed, blocks = mixed(own)
    sure = _sure_pairs(blocks, vertices, percent)
    if not sure.isEmpty():
        fresh = _verify(sure, vertices, docs, id_col, text_col, n, percent, seed)
        own = joined(own, fresh)
        discard(placed, fresh)
        placed, blocks = mixed(own)
    fresh = _links_across(blocks, vertices, docs, id_col, text_col, n, percent, seed)
    if not fresh.isEmpty():
        own = joined(own, fresh)
    discard(placed, sure, fresh)
    # in ids: a set's members are one component, and so are the rows that share an id
    shared = vertex.groupBy("id").agg(F.min("fp").alias("x"), F.max("fp").alias("y")).where("x <> y")
    shared = materialise(vertex.join(shared.select("id", "x"), "id").where("fp <> x").select(F.col("fp").alias("a"), F.col("x").alias("b")), "shared")
    if not shared.isEmpty():
        own = components(own.select(F.col("v").alias("a"), F.col("component").alias("b")).unionByName(shared), "components")
    labelled = vertices.select("fp", "rep").join(own.withColumnRenamed("v", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = labelled.groupBy("component").agg(F.min("rep").alias("component_id"))
    by_set = labelled.join(least, "component").select("fp", "component_id")
    out = rows.join(by_set, "fp", "left")
    return out.select(
        F.col("id").alias(id_col), F.col("size").alias("n_shingles"), F.when((F.col("size") > 0) & F.col("id").isNotNull(), F.col("component_id")).otherwise(F.col("id")).alias("component_id"), F.col("fp").alias("set_id")
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 75) -> DataFrame:
    """The rows of docs without those that link to a document of lesser id, all columns as they were.

    Rows that share an id are one document and stay or go together; rows with a null id or without words stay."""
    found = classes(docs, id_col, text_col, n, percent)
    gone = found.where(F.col("component_id") < F.col(id_col)).select(F.col(id_col).alias("__gone")).distinct()
    gone = materialise(gone, "gone")
    if gone.count() <= BROADCAST_IDS:
        gone = F.broadcast(gone)
    return docs.join(gone, docs[id_col].cast("long") == gone["__gone"], "left_anti")
