"""Near duplicates among vectors by lattice hashing: random projections decoded to points of the E8 lattice.

Vectors are projected onto `blocks` groups of eight random directions in each of several tables, and each group is
decoded to its nearest E8 point; a table's points together are a cell.  A vector lives in its own cell and also visits
the PROBES cells that lie nearest otherwise (one group's point moved by one of the 240 shortest lattice vectors).  Two
vectors meet in a table if one lives where the other lives or visits; vectors that meet in any table are compared by
cosine in double precision.  Andoni and Indyk (2006); Conway and Sloane (1982).

How many groups follows from the largest class's size, so that a cell of unrelated vectors stays small; how many tables
from a simulation of pairs just at the threshold, so that they meet with probability TARGET at least (`plan`).

Scale: equal vectors are one representative.  Only (cell, vector) rows are shuffled first, and cells with one dweller
and nobody else go; vectors are sent to the cells that are left.  A cell of more than BLOCK members is dealt out as
pairs of blocks, so no task holds more than two blocks.  Pairs are compared as products of blocks and never leave the
task: what leaves it is a count for each member and, for the components, one link for each member but the first of
each linked group.  A pair that meets in several tables is counted in the first of them.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components, and rows with a null label
or a null id, link with nothing and are their own component; vectors of unlike length aren't compared; equal vectors
and repeated rows are linked with each other; no rows give no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import give_back, materialise
from .components import components
from .textvec import mix

U = np.uint64
#: Width of a lattice cell, in standard deviations of a projected unit vector's coordinates.
WIDTH = 2.0
#: Cells that a vector visits besides its own, in each table.
PROBES = 2
#: Pairs at the threshold meet with this probability at least.
TARGET = 0.998
#: Members of a cell that are compared as one block.
BLOCK = 4096
#: Rows of one product; cells of up to SMALL members are compared many at a time.
STRIP, SMALL = 256, 64
#: A cell of one group holds about one in so many unrelated vectors, and may hold so many before another group is added.
SPREAD, CROWD = 250, 64


def _shortest() -> np.ndarray:
    """The 240 shortest vectors of E8: two coordinates of 1 or -1, or all of 1/2 or -1/2 with an even number of minuses."""
    out = []
    for i in range(8):
        for j in range(i):
            for a in (1, -1):
                for b in (1, -1):
                    v = np.zeros(8)
                    v[i], v[j] = a, b
                    out.append(v)
    halves = np.array(np.meshgrid(*[[0.5, -0.5]] * 8)).reshape(8, -1).T
    return np.vstack([np.array(out), halves[(halves < 0).sum(1) % 2 == 0]])


SHORTEST = _shortest()


def _nearest_d8(x: np.ndarray) -> np.ndarray:
    """Whole numbers with an even sum: rounded, and where the sum is odd the worst rounding turned the other way."""
    r = np.rint(x)
    odd = np.flatnonzero(r.sum(-1) % 2)
    gap = x[odd] - r[odd]
    worst = np.abs(gap).argmax(-1)
    r[odd, worst] += np.where(gap[np.arange(len(odd)), worst] >= 0, 1, -1)
    return r


def decode(x: np.ndarray) -> np.ndarray:
    """The nearest E8 point of each row of eight: the nearer of the whole and the half-odd one."""
    whole, half = _nearest_d8(x), _nearest_d8(x - 0.5) + 0.5
    return np.where((((x - whole) ** 2).sum(1) <= ((x - half) ** 2).sum(1))[:, None], whole, half)


def _directions(dim: int, table: int, blocks: int) -> np.ndarray:
    return np.random.default_rng([2024, dim, table]).standard_normal((dim, 8 * blocks))


def _hash(points: np.ndarray) -> np.ndarray:
    """64 bits for each row of lattice points (twice their coordinates are whole)."""
    h = np.zeros(len(points), U)
    with np.errstate(over="ignore"):
        for c in np.rint(2 * points).astype(np.int64).T:
            h = mix(h * U(0x9E3779B97F4A7C15) + c.astype(U) + U(1))
    return h


def cells(unit: np.ndarray, table: int, blocks: int, probes: int = PROBES) -> np.ndarray:
    """(rows, 1 + probes): the cell of each unit vector and those that it visits, nearest first."""
    n, dim = unit.shape
    at = unit @ _directions(dim, table, blocks) / WIDTH  # of deviation 1 / WIDTH
    home = np.hstack([decode(at[:, 8 * b : 8 * b + 8]) for b in range(blocks)])
    out = np.empty((n, 1 + probes), U)
    out[:, 0] = _hash(home)
    if probes:
        rest = at - home
        gain = np.hstack([rest[:, 8 * b : 8 * b + 8] @ SHORTEST.T for b in range(blocks)])  # the nearer, the greater
        top = np.argpartition(-gain, probes, axis=1)[:, :probes]
        top = np.take_along_axis(top, np.argsort(-np.take_along_axis(gain, top, 1), axis=1, kind="stable"), 1)
        for p in range(probes):
            moved = home.reshape(n, blocks, 8).copy()
            moved[np.arange(n), top[:, p] // 240] += SHORTEST[top[:, p] % 240]
            out[:, 1 + p] = _hash(moved.reshape(n, -1))
    with np.errstate(over="ignore"):
        return mix(out + U(table + 1) * U(0xA24BAED4963EE407))


def _meets(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether one of each pair lives where the other lives or visits; a, b: (pairs, 1 + probes) of one table."""
    return (b == a[:, :1]).any(1) | (a == b[:, :1]).any(1)


@dataclass(frozen=True)
class Plan:
    blocks: int
    tables: int


def plan(dim: int, n: int, threshold: float, target: float = TARGET, blocks: int | None = None, pairs: int = 4000) -> Plan:
    """Groups by the size of the largest class, tables by a simulation of pairs just at the threshold."""
    blocks = blocks or min(max(1, dim // 8), max(1, math.ceil(math.log(max(n, 2) / CROWD) / math.log(SPREAD))))
    rng = np.random.default_rng([2024, dim, 99])
    a, b = rng.standard_normal((2, pairs, dim))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    if dim == 1:
        return Plan(blocks, 1)
    b -= (a * b).sum(1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    b = threshold * a + math.sqrt(max(0.0, 1 - threshold**2)) * b
    met, tables = np.zeros(pairs, bool), 0
    while met.mean() < target and tables < 64:
        met |= _meets(cells(a, tables, blocks), cells(b, tables, blocks))
        tables += 1
    return Plan(blocks, tables)


def _usable(vec: Column, label: Column, key: Column) -> Column:
    finite = F.forall(vec, lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x))
    return key.isNotNull() & label.isNotNull() & vec.isNotNull() & (F.size(vec) > 0) & F.coalesce(finite, F.lit(False)) & F.exists(vec, lambda x: x != 0)


def _matrix(col: pa.Array) -> np.ndarray:
    """Vectors of one length as rows of length 1, in double precision."""
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(col), -1)
    flat = flat / np.abs(flat).max(1, keepdims=True)  # squares neither overflow nor vanish
    return flat / np.linalg.norm(flat, axis=1, keepdims=True)


def _by_length(batch: pa.RecordBatch, column: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    col = batch.column(column)
    sizes = np.diff(np.asarray(col.offsets))
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        yield at, _matrix(col.take(pa.array(at)))


def links(reps: DataFrame, threshold: float, own: Plan) -> DataFrame:
    """a, b, n: for each linked pair of representatives (rid, class, v, copies) what it adds to either's count (b null), and
    links that tie each linked group together (n null)."""
    width = 1 + PROBES

    def place(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            codes = np.zeros((batch.num_rows, own.tables * width), U)
            for at, unit in _by_length(batch, "v"):
                codes[at] = np.hstack([cells(unit, t, own.blocks) for t in range(own.tables)])
            with np.errstate(over="ignore"):
                codes = mix(codes ^ (batch.column("class").to_numpy().astype(U)[:, None] * U(0xD6E8FEB86659FD93)))
            ends = pa.array(np.arange(len(codes) + 1, dtype=np.int32) * codes.shape[1])
            listed = pa.ListArray.from_arrays(ends, pa.array(codes.view(np.int64).ravel()))
            yield pa.record_batch({"rid": batch.column("rid"), "v": batch.column("v"), "copies": batch.column("copies"), "codes": listed})
        give_back()

    kind = dict(reps.dtypes)["v"]
    placed = materialise(reps.select("rid", "class", "v", "copies").mapInArrow(place, f"rid long, v {kind}, copies long, codes array<long>"), "lattice")
    rows = placed.select("rid", F.posexplode("codes").alias("k", "cell")).select("cell", "rid", (F.col("k") % width == 0).alias("home"))
    crowds = rows.groupBy("cell").agg(F.count("*").alias("n"), F.max("home").alias("lived_in")).where("n > 1 and lived_in")
    met = rows.join(crowds.select("cell", "n"), "cell")
    n_blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    mine = F.pmod(F.xxhash64("rid"), n_blocks).cast("int")
    others = F.explode(F.sequence(F.lit(0), n_blocks - 1))
    met = met.select("cell", "rid", mine.alias("mine"), others.alias("other"))
    met = met.select("cell", F.least("mine", "other").alias("x"), F.greatest("mine", "other").alias("y"), "mine", "rid")
    sent = met.join(placed, "rid")
    sent = sent.repartition("cell", "x", "y").sortWithinPartitions("cell", "x", "y", "rid")

    def compare(batches):
        for tile in _tiles(batches):
            yield from _compare(tile, threshold, width)
        give_back()

    return sent.mapInArrow(compare, "a long, b long, n long")


#: Rows of tiles that are compared at once, where they are small.
GATHER = 4096


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole tiles, of GATHER rows or one large tile each, from rows in the order of tiles."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        key = [batch.column(c).to_numpy() for c in ("cell", "x", "y")]
        last = np.flatnonzero(np.any([k[1:] != k[:-1] for k in key], axis=0))
        if held:
            before = [held[-1].column(c)[-1].as_py() for c in ("cell", "x", "y")]
            if rows >= GATHER and before != [k[0] for k in key]:
                yield pa.Table.from_batches(held)
                held, rows = [], 0
            elif rows >= GATHER and len(last):  # the open tile ends in this batch
                held.append(batch.slice(0, int(last[0]) + 1))
                yield pa.Table.from_batches(held)
                batch, held, rows = batch.slice(int(last[0]) + 1), [], 0
        held.append(batch)
        rows += batch.num_rows
    if held:
        yield pa.Table.from_batches(held)


def _compare(tile: pa.Table, threshold: float, width: int) -> Iterator[pa.RecordBatch]:
    tile = tile.combine_chunks()
    sizes = np.diff(np.asarray(tile["v"].chunk(0).offsets))
    for size in np.unique(sizes):  # a cell is of one length
        yield from _compare_rows(tile.take(pa.array(np.flatnonzero(sizes == size))).combine_chunks(), threshold, width)


def _compare_rows(tile: pa.Table, threshold: float, width: int) -> Iterator[pa.RecordBatch]:
    cell, x, y, mine, rid, copies = (tile[c].to_numpy() for c in ("cell", "x", "y", "mine", "rid", "copies"))
    codes = tile["codes"].chunk(0).flatten().to_numpy().reshape(len(rid), -1)
    unit = _matrix(tile["v"].chunk(0))
    new = np.concatenate([[True], (cell[1:] != cell[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])])
    starts = np.flatnonzero(new)
    ends = np.append(starts[1:], len(rid))
    counts = np.zeros(len(rid), np.int64)
    group = np.arange(len(rid))  # union-find over the rows

    def take(p: np.ndarray, q: np.ndarray) -> None:
        """Count the linked pairs that meet in no cell before this one."""
        ok = (rid[p] != rid[q]) & ((x[p] == y[p]) | (mine[p] != mine[q]))
        p, q = p[ok], q[ok]
        for a in range(0, len(p), 1 << 16):
            s, t = p[a : a + (1 << 16)], q[a : a + (1 << 16)]
            first = _first(codes[s], codes[t], cell[s], width)
            s, t = s[first], t[first]
            np.add.at(counts, s, copies[t])
            np.add.at(counts, t, copies[s])
            _unite(group, s, t)

    end_of = np.repeat(np.where(ends - starts <= SMALL, ends, starts), ends - starts)  # rows of large cells have no partner here
    for step in range(1, SMALL):
        p = np.flatnonzero(np.arange(len(rid)) + step < end_of)
        if not len(p):
            break
        take(*(at[np.einsum("ij,ij->i", unit[p], unit[p + step]) >= threshold] for at in (p, p + step)))
    for lo, hi in zip(starts, ends, strict=True):
        for i in range(lo, hi if hi - lo > SMALL else lo, STRIP):
            p, q = np.nonzero(unit[i : min(i + STRIP, hi)] @ unit[i:hi].T >= threshold)
            later = p < q
            take(p[later] + i, q[later] + i)
    some = np.flatnonzero(counts)
    yield pa.record_batch({"a": pa.array(rid[some]), "b": pa.nulls(len(some), pa.int64()), "n": pa.array(counts[some])})
    root = _roots(group)
    tied = np.flatnonzero(root != np.arange(len(root)))
    yield pa.record_batch({"a": pa.array(rid[tied]), "b": pa.array(rid[root[tied]]), "n": pa.nulls(len(tied), pa.int64())})


def _first(a: np.ndarray, b: np.ndarray, cell: np.ndarray, width: int) -> np.ndarray:
    """Whether `cell` is the first in which each pair meets: of the first table, and there the lesser of two cells."""
    done, first = np.zeros(len(a), bool), np.zeros(len(a), bool)
    for t in range(0, a.shape[1], width):
        u, v = a[:, t : t + width], b[:, t : t + width]
        in_a, in_b = (v == u[:, :1]).any(1), (u == v[:, :1]).any(1)  # they meet where a lives, where b lives
        where = np.where(in_a & in_b, np.minimum(u[:, 0], v[:, 0]), np.where(in_a, u[:, 0], v[:, 0]))
        met = in_a | in_b
        first |= ~done & met & (where == cell)
        done |= met
    return first


def _roots(group: np.ndarray) -> np.ndarray:
    while True:
        up = group[group]
        if (up == group).all():
            return group
        group = up


def _unite(group: np.ndarray, p: np.ndarray, q: np.ndarray) -> None:
    """Tie the groups of p and q together, in place: each root to the least it meets, until all agree."""
    while len(p):
        flat = _roots(group)
        group[:] = flat
        a, b = flat[p], flat[q]
        apart = a != b
        p, q, a, b = p[apart], q[apart], a[apart], b[apart]
        np.minimum.at(group, np.maximum(a, b), np.minimum(a, b))


def near_duplicates(rows: DataFrame, threshold: float = 0.98, blocks: int | None = None, target: float = TARGET, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """id, n_links (other rows linked directly), component_id (least id reachable by links, itself included), kept (the id is its
    component's) of every row; rows are compared within a label only."""
    own = rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.col(vec_col).alias("v"))
    own = own.withColumn("usable", _usable(F.col("v"), F.col("label"), F.col("id")))
    own = own.withColumns({"h1": F.xxhash64("label", "v"), "h2": F.xxhash64("v", F.lit("|"), "label")})
    good = own.where("usable")
    grouped = good.groupBy("label", "v", "h1", "h2").agg(F.min("id").alias("least"), F.count("*").alias("copies"))
    klass = F.xxhash64("label", F.size("v"))
    reps = materialise(grouped.select(F.monotonically_increasing_id().alias("rid"), klass.alias("class"), "v", "h1", "h2", "least", "copies"), "vectors")
    sizes = reps.groupBy("class").agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dim"))
    sizes = sizes.groupBy("dim").agg(F.max("n").alias("n")).collect()  # a row for each length of vectors
    edges = None
    if sizes:
        plans = [plan(r["dim"], r["n"], threshold, target, blocks) for r in sizes]
        found = materialise(links(reps, threshold, Plan(max(p.blocks for p in plans), max(p.tables for p in plans))), "links")
        counts = found.where("b is null").groupBy(F.col("a").alias("rid")).agg(F.sum("n").alias("n"))
        edges = components(found.where("b is not null").select("a", "b"), "vectors")
        part = edges.withColumnRenamed("v", "rid").join(reps.select("rid", "least"), "rid")
        least = part.groupBy("component").agg(F.min("least").alias("low"))
        part = part.join(least, "component").select("rid", "low")
        info = reps.select("rid", "h1", "h2", "least", "copies").join(counts, "rid", "left").join(part, "rid", "left")
        info = info.select("h1", "h2", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("low", "least").alias("component"))
        joined = own.select("id", F.when(F.col("usable"), F.col("h1")).alias("h1"), "h2").join(info, ["h1", "h2"], "left")
    else:
        joined = own.select("id", F.lit(None).cast("long").alias("n_links"), F.lit(None).cast("long").alias("component"))
    component = F.coalesce("component", "id")
    return joined.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e,
         vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AS usable
  FROM embeddings),
l AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v AS a JOIN v AS b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
      WHERE a.usable AND b.usable AND list_cosine_similarity(a.e, b.e) >= 0.98),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS low FROM r GROUP BY a),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n.n, 0)::BIGINT AS n_links, least(vec_id, coalesce(low, vec_id)) AS component_id, vec_id <= coalesce(low, vec_id) AS kept
FROM v LEFT JOIN c ON c.a = v.vec_id LEFT JOIN n ON n.a = v.vec_id
"""
