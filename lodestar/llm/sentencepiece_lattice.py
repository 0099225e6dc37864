"""SentencePiece encoding and decoding over a relational lattice.

A text gets a blank in front and is cut into units between any two characters that stand side by side in no piece of
the vocabulary, so no piece crosses a cut and the best paths of the units make the best path of the text.  The distinct
units of each block of documents meet in one table; there

- each unit of at most `UNIT` characters is exploded into its substrings up to the longest piece,
- these are equi-joined to the piece table (bounded by the vocabulary, so it is broadcast),
- the edges that match are grouped by unit, and
- a fold over the end positions (Viterbi, with Spark's higher-order `aggregate`) keeps the best path to each: most
  weight, then fewest pieces, then the greatest list of ids.

Longer units (rare) are folded one by one in Python, from the last character to the first, in time that grows with
their length (`best_path`); the result is the same.  The units' ids go back to their blocks, where documents, held as unit numbers, gather them.  A character without a
piece becomes its byte pieces.  Weights are whole numbers: of a model of ranks (byte-pair encoding) the logarithm of a
Zipf law over its ranks, of a unigram model its scores, in millionths.

Defined results: null and empty texts have no pieces; every text decodes to itself (a literal U+2581 is encoded as
bytes); equal texts get equal ids; a null id is kept; extra columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import md5
from itertools import count, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, give_back, materialise, shuffle_width, text_array

#: Most characters of a unit that is folded in columns.
UNIT = 32
#: Distinct units of a block.
BLOCK_UNITS = 600_000
#: Units of the documents that are held together as one payload.
PAYLOAD_UNITS = 300_000
#: Weight of a character without a piece.
UNKNOWN = -25_000_000
#: Tasks of the lattice for each shuffle partition: a unit's edges are some forty times its size, and they are sorted.
FINE = 6
#: Lengths at which longer substrings are cut off unless a piece begins so.
STEPS = (3, 4, 5, 6, 8)
#: Most pieces of a vocabulary; its table is broadcast.
MOST_PIECES = 1_000_000


@dataclass
class Vocabulary:
    """pieces with a blank for the word mark, ids, whole weights, and the id of byte 0 (bytes follow)."""

    pieces: list[str]
    ids: list[int]
    weights: list[int]
    byte_zero: int

    @staticmethod
    def load(path: str) -> Vocabulary:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.vocab_size()
        if n > MOST_PIECES:
            raise ValueError(f"{n} pieces; at most {MOST_PIECES} are broadcast")
        byte_zero = model.piece_to_id("<0x00>")
        own = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        names = [model.id_to_piece(i).replace("▁", " ") for i in own]
        scores = [model.get_score(i) for i in own]
        if all(float(s).is_integer() for s in scores):
            order = sorted(range(len(own)), key=lambda k: (-scores[k], own[k]))
            rank = np.empty(len(own))
            rank[order] = np.arange(len(own))
            logs = -np.log(rank + 2)
            logs -= np.log(np.exp(logs).sum())
            scores = logs.tolist()
        return Vocabulary(names, own, [round(1e6 * s) for s in scores], byte_zero)

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(zip(self.pieces, self.ids, self.weights, strict=True)), "piece string, piece_id int, weight long")

    def pairs(self) -> list[str]:
        """All two characters that stand side by side in a piece."""
        return sorted({p[i : i + 2] for p in self.pieces for i in range(len(p) - 1)})

    def lookup(self) -> dict[str, tuple[int, int]]:
        """Weight and id of each piece."""
        out: dict[str, tuple[int, int]] = {}
        for p, i, w in zip(self.pieces, self.ids, self.weights, strict=True):
            out[p] = max(out.get(p, (w, i)), (w, i))
        return out

    def names(self) -> pa.LargeBinaryArray:
        """What each id stands for."""
        names = [b""] * (1 + max([*self.ids, self.byte_zero + 255]))
        for b in range(256):
            names[self.byte_zero + b] = bytes([b])
        for i, p in zip(self.ids, self.pieces, strict=True):
            names[i] = p.encode()
        return pa.array(names, pa.large_binary())

    def decode(self, ids) -> str:
        if not len(ids):
            return ""
        names = dict(zip(self.ids, self.pieces, strict=True))
        out = b"".join(names[i].encode() if i in names else bytes([i - self.byte_zero]) for i in ids)
        return out.decode("utf-8")[1:]


class Cuts:
    """Cuts texts into units.  Pairs are known by a hash cell: two in one cell leave a unit longer, never cut a piece."""

    def __init__(self, pairs: list[str]) -> None:
        self.inner = np.zeros(1 << 20, bool)
        if pairs:
            x = np.frombuffer("".join(pairs).encode("utf-32-le"), "<u4")
            self.inner[self.cell(x[::2], x[1::2])] = True

    @staticmethod
    def cell(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (a * np.uint32(0x9E3779B1) + b * np.uint32(0x85EBCA77)) >> np.uint32(12)

    def cut(self, text: str) -> list[str]:
        x = np.frombuffer(text.encode("utf-32-le"), "<u4")
        ends = np.flatnonzero(~self.inner[self.cell(x[:-1], x[1:])]) + 1
        return [text[a:b] for a, b in pairwise([0, *ends.tolist(), len(text)])]


def best_path(unit: str, lookup: dict[str, tuple[int, int]], longest: int) -> list[int]:
    """What `viterbi` finds, for a unit of any length.  From the end on, paths that tie differ in their first id."""
    n = len(unit)
    weight, less, step, ids = [0] * (n + 1), [0] * (n + 1), [0] * n, [0] * n
    for lo in range(n - 1, -1, -1):
        best = None
        for hi in range(lo + 1, min(n, lo + longest) + 1):
            found = lookup.get(unit[lo:hi])
            if found is None:
                if hi > lo + 1:
                    continue
                found = UNKNOWN, -ord(unit[lo])
            way = weight[hi] + found[0], less[hi] - 1, found[1], hi
            if best is None or way > best:
                best = way
        weight[lo], less[lo], ids[lo], step[lo] = best
    out, at = [], 0
    while at < n:
        out.append(ids[at])
        at = step[at]
    return out


def _long_paths(units: DataFrame, vocabulary: Vocabulary, longest: int) -> DataFrame:
    """(block, number, path) of units of any length, each by itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = None
        for batch in batches:
            for k in range(batch.num_rows):
                lookup = lookup or vocabulary.lookup()
                path = best_path(batch.column(2)[k].as_py(), lookup, longest)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1), batch.column(1).slice(k, 1), pa.array([path], pa.list_(pa.int32()))], names=["block", "number", "path"])

    return units.select("block", "number", "unit").mapInArrow(run, "block long, number int, path array<int>")


def viterbi(units: DataFrame, pieces: DataFrame, longest: int) -> DataFrame:
    """(unit, path) of each distinct unit; path holds ids, or minus the code point of a character without a piece.

    units must hold each unit once; where it is partitioned by unit already, nothing is shuffled."""
    starts = units.select("unit", F.length("unit").alias("n")).select("unit", "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("lo"))
    # lengths beyond a step are exploded only where the step's characters begin a longer piece
    most, before = F.lit(STEPS[0]), F.lit(True)
    for i, step in enumerate(STEPS):
        heads = pieces.where(F.length("piece") > step).select(F.substring("piece", 1, step).alias(f"head{i}")).distinct().withColumn(f"long{i}", F.lit(True))
        starts = starts.withColumn(f"head{i}", F.when(before, F.col("unit").substr(F.col("lo") + 1, F.lit(step)))).join(F.broadcast(heads), f"head{i}", "left")
        before = F.col(f"long{i}")
        most = F.when(before, F.lit(STEPS[i + 1] if i + 1 < len(STEPS) else longest)).otherwise(most)
    parts = starts.select("unit", "n", "lo", F.explode(F.sequence(F.lit(1), F.least(most, F.col("n") - F.col("lo")))).alias("size"))
    parts = parts.select("unit", "n", "lo", "size", F.col("unit").substr(F.col("lo") + 1, F.col("size")).alias("piece"))
    met = parts.join(F.broadcast(pieces), "piece", "left").where("piece_id is not null or size = 1")
    edge = F.struct(
        (F.col("lo") + F.col("size")).alias("hi"), F.col("lo"), F.coalesce("weight", F.lit(UNKNOWN)).alias("w"), F.coalesce("piece_id", -F.ascii("piece")).alias("id")
    )
    grouped = met.groupBy("unit").agg(F.first("n").alias("n"), F.collect_list(edge).alias("edges"))
    start = F.array(F.struct(F.lit(0).cast("long").alias("w"), F.lit(0).alias("less"), F.array().cast("array<int>").alias("ids")))

    def step(best, hi):
        def path(e):
            before = F.get(best, e["lo"])
            return F.struct((before["w"] + e["w"]).alias("w"), (before["less"] - 1).alias("less"), F.concat(before["ids"], F.array(e["id"])).alias("ids"))

        return F.concat(best, F.array(F.array_max(F.transform(F.filter("edges", lambda e: e["hi"] == hi), path))))

    best = F.aggregate(F.sequence(F.lit(1), F.col("n")), start, step, lambda acc: F.get(acc, F.size(acc) - 1)["ids"])
    return grouped.select("unit", best.alias("path"))


_HEAD = struct.Struct("<II")


def _payload(keys: list, counts: list[int], flat: np.ndarray) -> bytes:
    import zstandard

    names = np.array([k or 0 for k in keys], "<i8").tobytes() + np.array([k is not None for k in keys], "u1").tobytes() + np.array(counts, "<u4").tobytes()
    planes = flat.astype("<u4").view("u1").reshape(-1, 4).T[:3]
    return zstandard.ZstdCompressor(level=3).compress(_HEAD.pack(len(keys), len(flat)) + names + np.ascontiguousarray(planes).tobytes())


def _opened(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(data)
    docs, n = _HEAD.unpack_from(raw)
    at = _HEAD.size
    keys = np.frombuffer(raw, "<i8", docs, at)
    has = np.frombuffer(raw, "u1", docs, at + 8 * docs).astype(bool)
    counts = np.frombuffer(raw, "<u4", docs, at + 9 * docs).astype(np.int64)
    planes = np.frombuffer(raw, "u1", 3 * n, at + 13 * docs).reshape(3, n).astype(np.int64)
    return keys, has, counts, planes[0] | planes[1] << 8 | planes[2] << 16


def numbered() -> dict[str, int]:
    """A dictionary that gives each new key the next number."""
    return defaultdict(count().__next__)


def _blocks(docs: DataFrame, pairs: list[str]) -> DataFrame:
    """Distinct units of each block (kind 0: number, unit) and its documents as numbers (kind 1: payload)."""
    schema = pa.schema([("kind", pa.int32()), ("block", pa.int64()), ("number", pa.int32()), ("unit", pa.string()), ("payload", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 20
        cuts = Cuts(pairs)
        known = numbered()
        keys, counts, held, rows = [], [], [], 0

        def documents() -> pa.RecordBatch:
            flat = np.concatenate(held) if held else np.empty(0, np.uint32)
            return pa.RecordBatch.from_arrays([pa.array([1], pa.int32()), pa.array([block]), pa.nulls(1, pa.int32()), pa.nulls(1, pa.string()), pa.array([_payload(keys, counts, flat)], pa.binary())], schema=schema)

        def units() -> Iterator[pa.RecordBatch]:
            every = list(known)
            for at in range(0, len(every), 20_000):
                part = every[at : at + 20_000]
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(part), np.int32)), pa.array(np.full(len(part), block)), pa.array(np.arange(at, at + len(part), dtype=np.int32)), pa.array(part), pa.nulls(len(part), pa.binary())], schema=schema)

        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                for key, text in zip(part.column(0).to_pylist(), text_array(part, "text").to_pylist(), strict=True):
                    found = cuts.cut(f" {text}") if text else []
                    own = np.fromiter(map(known.__getitem__, found), np.uint32, len(found))
                    keys.append(key)
                    counts.append(len(own))
                    held.append(own)
                    rows += len(own)
                    if rows > PAYLOAD_UNITS or len(known) > BLOCK_UNITS:
                        yield documents()
                        keys, counts, held, rows = [], [], [], 0
                    if len(known) > BLOCK_UNITS:
                        yield from units()
                        known, block = numbered(), block + 1
        if keys:
            yield documents()
        yield from units()
        known, held = numbered(), []
        give_back()

    return docs.mapInArrow(run, "kind int, block long, number int, unit string, payload binary")


def _packed(paths: DataFrame) -> DataFrame:
    """(block, table): of each block the units of a task as one binary: numbers, sizes and ids of their paths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        held, rows = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            block, number, size, flat = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.lexsort((number, block))
            start = np.cumsum(size) - size
            cuts = np.flatnonzero(np.r_[True, block[order][1:] != block[order][:-1]])
            for part in np.split(order, cuts[1:]):
                n = size[part]
                ids = flat[np.repeat(start[part] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
                data = len(part).to_bytes(8, "little") + _planes(np.diff(number[part], prepend=0)) + _planes(n) + _planes(ids)
                yield pa.RecordBatch.from_arrays([pa.array([block[part[0]]]), pa.array([zstandard.ZstdCompressor(level=3).compress(data)], pa.binary())], names=["block", "table"])

        for batch in batches:
            path = batch.column(2)
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy(), np.asarray(path.value_lengths().to_numpy(zero_copy_only=False), np.int64), path.flatten().to_numpy(zero_copy_only=False)))
            rows += batch.num_rows
            if rows > 500_000:
                yield from flush()
                held, rows = [], 0
        if held:
            yield from flush()
        held = []
        give_back()

    return paths.select("block", "number", "path").mapInArrow(run, "block long, table binary")


def _planes(x: np.ndarray) -> bytes:
    """32-bit numbers as four planes of bytes, which compress better apart."""
    return np.ascontiguousarray(x.astype("<i4").view("u1").reshape(-1, 4).T).tobytes()


def _unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    import zstandard

    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), "u1")
    n = int(raw[:8].view("<i8")[0])

    def numbers(lo: int, hi: int) -> np.ndarray:
        return np.ascontiguousarray(raw[lo:hi].reshape(4, -1).T).view("<i4").ravel()

    return np.cumsum(numbers(8, 8 + 4 * n)).astype(np.int64), numbers(8 + 4 * n, 8 + 8 * n).astype(np.int64), numbers(8 + 8 * n, len(raw))


def _table(numbers: list[np.ndarray], sizes: list[np.ndarray], flats: list[np.ndarray], byte_zero: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the units of a block, by number: where in the third array their ids start, and how many they are.  Characters
    without a piece become bytes, in arrays: a block has millions of ids, and lists of them would take some 100 bytes each."""
    number, size, flat = np.concatenate(numbers), np.concatenate(sizes), np.concatenate(flats)
    odd = flat < 0
    if odd.any():
        code = -flat[odd]
        grown = np.ones(len(flat), np.int8)
        grown[odd] = 1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF)
        ends = np.concatenate([[0], np.cumsum(grown, dtype=np.int64)])
        size = np.diff(ends[np.concatenate([[0], np.cumsum(size)])])
        flat = np.repeat(flat, grown)
        flat[flat < 0] = np.frombuffer(code.astype("<u4").tobytes().decode("utf-32-le").encode(), "u1").astype(np.int32) + byte_zero
    start = np.zeros(len(number), np.int64)
    length = np.zeros(len(number), np.int64)
    start[number] = np.cumsum(size) - size
    length[number] = size
    return start, length, flat


#: Grouped edges are sorted once and stay in the units' order for the join that follows.
SORTED = "spark.sql.execution.useObjectHashAggregateExec"


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True, decoded: bool = False) -> DataFrame:
    """id, n_tokens, ids_crc32 (of the ids as little-endian 32-bit numbers) and, if asked for, ids and text_md5 of the
    text that they decode to."""
    spark = docs.sparkSession
    vocabulary = Vocabulary.load(model)
    byte_zero = vocabulary.byte_zero
    longest = max(map(len, vocabulary.pieces))
    width = shuffle_width(spark)
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    held = materialise(_blocks(own, vocabulary.pairs()), "units", by="kind", compression="zstd")
    whole = held.where("kind = 0")
    units = whole.where(F.length("unit") <= UNIT).select("block", "number", "unit").repartition(FINE * width, "unit")
    # asking for all columns lets this branch read the same exchange as the join below
    different = units.groupBy("unit").agg(F.min("block").alias("block"), F.min("number").alias("number")).where("block >= 0 and number >= 0")
    paths = viterbi(different.select("unit"), vocabulary.table(spark), longest)
    before = spark.conf.get(SORTED, "true")
    spark.conf.set(SORTED, "false")
    try:
        every = units.join(paths, "unit").select("block", "number", "path").unionByName(_long_paths(whole.where(F.length("unit") > UNIT), vocabulary, longest))
        found = materialise(_packed(every), "paths", compression="uncompressed")
    finally:
        spark.conf.set(SORTED, before)
    discard(held, part="kind=0")
    # the units of a block come before its documents
    every = found.select("block", "table", F.lit(None).cast("binary").alias("payload"))
    every = every.unionByName(held.where("kind = 1").select("block", F.lit(None).cast("binary").alias("table"), "payload"))
    every = every.repartition(width, "block").sortWithinPartitions(F.col("block"), F.col("payload").isNotNull())

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, numbers, sizes, flats = None, [], [], []
        table = None
        names = vocabulary.names() if decoded else None

        def documents(data: bytes) -> pa.RecordBatch:  # its arrays are gone before the next payload's are made
            keys, valid, counts, seq = _opened(data)
            start, length, flat = table if table is not None else (np.empty(0, np.int64),) * 3
            n = length[seq]
            end = np.cumsum(n)
            total = int(end[-1]) if len(end) else 0
            ids = flat[np.repeat(start[seq] - (end - n), n) + np.arange(total)].astype("<u4")
            at = np.concatenate([[0], end])[np.concatenate([[0], np.cumsum(counts)])]
            view = memoryview(ids).cast("B") if total else memoryview(b"")
            check = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            cols = [pa.array(keys, mask=~valid), pa.array(np.diff(at)), pa.array(check, pa.int64())]
            if with_ids or decoded:
                lists = pa.ListArray.from_arrays(at.astype(np.int32), pa.array(ids.astype(np.int32)))
            if with_ids:
                cols.append(lists)
            if decoded:
                cols.append(pa.array([md5(t.encode()).hexdigest() for t in _texts(lists, names).to_pylist()], pa.string()))
            return pa.RecordBatch.from_arrays(cols, names=["id", "n_tokens", "ids_crc32", *["ids"] * with_ids, *["text_md5"] * decoded])

        for batch in batches:
            for k in range(batch.num_rows):
                block, packed, payload = batch.column(0)[k].as_py(), batch.column(1)[k], batch.column(2)[k]
                if block != now:
                    now, numbers, sizes, flats, table = block, [], [], [], None
                if packed.is_valid:
                    number, size, flat = _unpacked(packed.as_buffer().to_pybytes())
                    numbers.append(number)
                    sizes.append(size)
                    flats.append(flat)
                    continue
                if table is None and numbers:
                    table, numbers, sizes, flats = _table(numbers, sizes, flats, byte_zero), [], [], []
                yield documents(payload.as_buffer().to_pybytes())
                give_back()
        numbers, sizes, flats, table = [], [], [], None
        give_back()

    out = every.mapInArrow(gather, "id long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids + ", text_md5 string" * decoded)
    return out.withColumnRenamed("id", id_col)


def _texts(ids: pa.ListArray, names: pa.LargeBinaryArray) -> pa.StringArray:
    """The texts of lists of ids, null for null; names holds the bytes of each id."""
    # the pieces of all ids end to end; a text begins where its ids begin
    data = names.take(ids.flatten())
    at = np.concatenate([[0], np.cumsum(pc.fill_null(ids.value_lengths(), 0).to_numpy(zero_copy_only=False), dtype=np.int64)])
    starts = np.frombuffer(data.buffers()[1], np.int64, len(data) + 1, 8 * data.offset) if len(data) else np.zeros(1, np.int64)
    texts = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ids), [None, pa.py_buffer(starts[at].tobytes()), data.buffers()[2] or pa.py_buffer(b"")])
    texts = pc.utf8_slice_codeunits(texts.cast(pa.large_string()), 1).cast(pa.string())
    return pc.if_else(ids.is_valid(), texts, pa.scalar(None, pa.string()))


def decode(encoded: DataFrame, model: str, id_col: str = "doc_id") -> DataFrame:
    """id and text of ids."""
    vocabulary = Vocabulary.load(model)
    kind = dict(encoded.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = vocabulary.names()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), _texts(batch.column(1), names)], names=[id_col, "text"])

    return encoded.select(F.col(id_col), "ids").mapInArrow(run, f"`{id_col}` {kind}, text string")


def round_trip(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode: id, n_tokens, ids_crc32, ids, and text_md5 of the text that `decode` makes of ids; the ids are
    decoded in the worker that has them, which saves a second worker's memory."""
    return encode(docs, model, id_col, text_col, decoded=True)
