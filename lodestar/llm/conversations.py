"""Repair of conversations whose turns were lost, emptied, cut, repeated or put under the wrong role.

A conversation is right when its roles read `(s?(ua)+)?` by their initials: system at most once and first, then user and
assistant in turns.  Edits of rows cost: Keep 0, Rerole to user or assistant 2, Delete 3 (the only one for blank and
duplicate rows), Insert of an empty user or assistant row 2, and 1 for each truncated row that stays.  The cheapest
edits win, and among equals the one whose string of initials is least in ASCII.

Method: a Viterbi search over the four states of the pattern (nothing yet, after system, after user, after assistant).
The survivors' paths are a tree of back pointers with counted references: a path that no survivor ends in is released
up to the branch it left, a chain is held as one string of edits, and as soon as all survivors share an ancestor the
edits up to it are emitted.  A survivor that another one undercuts by more than it could ever make good is dropped at
once.  Ties are settled by the complete edits since the paths parted: rows are consumed in step, so two paths differ
before the edit of the last row or not at all, and the survivors' order carries over from row to row.

Scale: rows are shuffled once, by conversation, sorted there, and pass one task as a stream; only undecided rows are
held, their edits as one character each, their texts beyond WINDOW bytes in a scratch file of the task.  A digest over
a whole conversation is sequential by definition, so a conversation isn't split; its length doesn't matter to memory.

Defined results: a null role or text counts as one blank; null turns come first; rows of one turn stand in the order of
role and text; a null conversation id is a conversation of its own; repeated rows are duplicates; a conversation all of
whose rows are lost has no edits; no rows give no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import pickle
import tempfile
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .resampling import CRC_TABLE, crc_sql

#: Bytes of undecided texts that a task holds in memory.
WINDOW = 16 << 20
#: White space, and the marks that end a whole sentence.
SPACE, ENDS = " \t\n\x0b\x0c\r", ".!?"
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
COST = {"K": 0, "R": 2, "D": 3, "I": 2}
#: By how much the rest may cost more from one state (row) than from another (column).
LAG = ((0, 0, 2, 0), (4, 0, 2, 4), (5, 2, 0, 2), (3, 0, 2, 0))


def damage(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, lost: by crc32(conv_id:turn) % 20 a row is lost (0), emptied (1), loses its marks (2), is
    repeated (3) or put under the user (4).  A lost row stays as one without role and text."""
    key = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    fault = F.crc32(key.cast("binary")) % 20
    text = F.coalesce(F.col("text").cast("string"), F.lit(" "))
    role = F.when(fault == 4, F.lit("user")).otherwise(F.coalesce(F.col("role").cast("string"), F.lit(" ")))
    text = F.when(fault == 1, F.lit("")).when(fault == 2, F.regexp_replace(text, f"[{ENDS}]", "")).otherwise(text)
    lost = fault == 0
    row = F.struct(F.when(~lost, F.col("turn")).alias("turn"), F.when(~lost, role).alias("role"), F.when(~lost, text).alias("text"), lost.alias("lost"))
    return rows.select(F.col("conv_id"), F.explode(F.array_repeat(row, F.when(fault == 3, 2).otherwise(1))).alias("row")).select("conv_id", "row.*")


def faults(rows: DataFrame) -> DataFrame:
    """Rows with `fault`: blank, duplicate, truncated or null; one partition holds whole conversations, in order."""
    rest = F.rtrim(F.col("text"), F.lit(SPACE))
    earlier = F.row_number().over(Window.partitionBy("conv_id", "role", "text", "lost").orderBy("turn")) > 1
    fault = F.when(rest == "", "blank").when(earlier, "duplicate").when(~F.right(rest, F.lit(1)).isin(*ENDS), "truncated")
    lost = F.col("lost") if "lost" in rows.columns else F.lit(False)
    there = ~F.col("lost")
    own = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text", lost.alias("lost"))
    own = own.select("conv_id", "turn", *(F.when(there, F.coalesce(F.col(c), F.lit(" "))).alias(c) for c in ("role", "text")), "lost")
    own = own.repartition("conv_id").withColumn("fault", F.when(there, fault))
    return own.sortWithinPartitions("conv_id", "turn", "role", "text", F.coalesce(F.col("fault") == "duplicate", F.lit(False)))


class Path:
    """A stretch of edits behind those of `parent`; `kids` are the stretches behind it that a survivor still needs."""

    __slots__ = ("edits", "kids", "parent")

    def __init__(self, parent: Path | None, edits: str):
        self.parent, self.edits, self.kids = parent, bytearray(edits.encode()), []
        if parent is not None:
            parent.kids.append(self)


class Waiting:
    """Undecided rows, first in first out; those beyond `most` bytes wait in a scratch file."""

    def __init__(self, most: int = WINDOW):
        self.near, self.late, self.bytes, self.most = deque(), deque(), 0, most
        self.file, self.read, self.stored = None, 0, 0

    def append(self, row: tuple, size: int) -> None:
        self.late.append(row)
        self.bytes += size + 100
        if self.bytes > self.most:
            self.file = self.file or tempfile.TemporaryFile()
            self.file.seek(self.stored)
            pickle.dump(self.late, self.file)
            self.stored = self.file.tell()
            self.late, self.bytes = deque(), 0

    def pop(self) -> tuple:
        if not self.near and self.read < self.stored:
            self.file.seek(self.read)
            self.near = pickle.load(self.file)  # noqa: S301  what this task has written itself
            self.read = self.file.tell()
        elif not self.near:
            self.near, self.late, self.bytes = self.late, deque(), 0
        return self.near.popleft()


class Decoder:
    """Edits of one conversation.  `step` takes a row's role initial and fault, `row` whatever is to come out with its
    edit; both it and `end` give (edit, row, repaired role) of what is decided."""

    def __init__(self, window: int = WINDOW):
        self.root = Path(None, "")
        self.rows = Waiting(window)
        self.state = NOTHING  # of the emitted edits
        #: state: (cost, order of the path among the survivors, inserts behind the path, path)
        self.alive = self._inserts({NOTHING: (0, 0, 0, self.root)})

    @staticmethod
    def _inserts(alive: dict) -> dict:
        for to, sources in ((USER, (NOTHING, SYSTEM, ASSISTANT)), (ASSISTANT, (USER,))):
            for s in sources:
                if s in alive:
                    cost, order, n, path = alive[s]
                    new = (cost + COST["I"], order, n + 1, path)
                    if to not in alive or new[:3] < alive[to][:3]:
                        alive[to] = new
        return alive

    def step(self, initial: str, fault: str | None, row: tuple, size: int = 0) -> Iterator[tuple]:
        self.rows.append(row, size)
        gone, extra = fault in ("blank", "duplicate"), int(fault == "truncated")
        best: dict[int, tuple] = {}

        def offer(to: int, at: tuple, edit: str) -> None:
            cost, order, n, path = at
            new = (cost + COST[edit] + (extra if edit != "D" else 0), order, "I" * n + edit, path)
            if to not in best or new[:3] < best[to][:3]:
                best[to] = new

        for s, at in self.alive.items():
            offer(s, at, "D")
            if gone:
                continue
            if s == USER:
                offer(ASSISTANT, at, "R")
                if initial == "a":
                    offer(ASSISTANT, at, "K")
            else:
                offer(USER, at, "R")
                if initial == "u":
                    offer(USER, at, "K")
                elif initial == "s" and s == NOTHING:
                    offer(SYSTEM, at, "K")
        best = {s: x for s, x in best.items() if all(x[0] <= y[0] + LAG[t][s] for t, y in best.items())}
        self._grow(best)
        return self._decided()

    def _grow(self, best: dict[int, tuple]) -> None:
        """Hang the new edits onto the paths, release what no survivor needs, and number the survivors in their order."""
        heads = {id(at[3]): at[3] for at in self.alive.values()}
        uses: dict[int, int] = {}
        for x in best.values():
            uses[id(x[3])] = uses.get(id(x[3]), 0) + 1
        placed = {}
        for s, (cost, order, edits, path) in best.items():
            if uses[id(path)] == 1 and path is not self.root and not path.kids:
                path.edits += edits.encode()
                placed[s] = (cost, order, edits, path)
            else:
                placed[s] = (cost, order, edits, Path(path, edits))
        for key, path in heads.items():
            if key not in uses and path is not self.root:
                self._release(path)
        for x in placed.values():
            self._join(x[3])
        keys = sorted({x[1:3] for x in placed.values()})
        self.alive = self._inserts({s: (cost, keys.index((order, edits)), 0, path) for s, (cost, order, edits, path) in placed.items()})

    def _release(self, path: Path) -> None:
        while path is not self.root and not path.kids:
            parent = path.parent
            parent.kids.remove(path)
            path = parent

    def _join(self, path: Path) -> None:
        """Chains become one stretch."""
        while path.parent is not None and path.parent is not self.root and len(path.parent.kids) == 1:
            parent = path.parent
            parent.edits += path.edits
            path.edits, path.parent = parent.edits, parent.parent
            path.parent.kids[path.parent.kids.index(parent)] = path

    def _decided(self) -> Iterator[tuple]:
        while len(self.root.kids) == 1:
            path = self.root.kids[0]
            edits, path.edits = path.edits, bytearray()
            self.root, path.parent = path, None
            yield from self._emit(edits.decode())

    def _emit(self, edits: str) -> Iterator[tuple]:
        for edit in edits:
            if edit == "D":
                yield edit, self.rows.pop(), None
                continue
            row = self.rows.pop() if edit != "I" else None
            if edit == "K" and row[1][:1] == "s":
                self.state, role = SYSTEM, row[1]
            else:
                self.state = ASSISTANT if self.state == USER else USER
                role = row[1] if edit == "K" else "user" if self.state == USER else "assistant"
            yield edit, row, role

    def end(self) -> Iterator[tuple]:
        _, _, n, path = min((self.alive[s] for s in (NOTHING, ASSISTANT) if s in self.alive), key=lambda x: x[:3])
        parts = ["I" * n]
        while path is not None and path is not self.root:
            parts.append(path.edits.decode())
            path = path.parent
        yield from self._emit("".join(reversed(parts)))


EDITS = "turn long, role string, text string, fault string, edit string, repaired_role string"


def edits(rows: DataFrame, window: int = WINDOW) -> DataFrame:
    """conv_id, turn, role, text, fault, edit, repaired_role: one row for each edit, in order within each conversation.

    repaired_role is null for deleted rows; inserted rows have no turn, role or text before.  Rows that are marked as lost
    come out with a null edit, so that no conversation disappears."""
    kind = dict(rows.dtypes)["conv_id"]

    def run(batches):
        now, decoder, out = None, None, []

        def put(conv, decided):
            for edit, row, role in decided:
                turn, old, text, fault = row or (None, None, None, None)
                out.append((conv, turn, old, text, fault, edit, role))

        def flush(schema):
            cols = list(zip(*out, strict=True)) if out else [[]] * 7
            names = ["conv_id", "turn", "role", "text", "fault", "edit", "repaired_role"]
            types = [schema.field("conv_id").type, pa.int64(), *[pa.string()] * 5]
            out.clear()
            return pa.record_batch([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)

        schema = None
        for batch in batches:
            schema = batch.schema
            held = 0
            for conv, turn, role, text, lost, fault in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "lost", "fault")), strict=True):
                if decoder is None or conv != now:
                    if decoder is not None:
                        put(now, decoder.end())
                    now, decoder = conv, Decoder(window)
                if lost:
                    out.append((conv, None, None, None, None, None, None))
                    continue
                held += len(text)
                put(conv, decoder.step(role[:1], fault, (turn, role, text, fault), len(text)))
                if held > WINDOW:
                    yield flush(schema)
                    held = 0
            yield flush(schema)
        if decoder is not None:
            for decided in _portions(decoder.end(), 4096):
                put(now, decided)
                yield flush(schema)

    return faults(rows).mapInArrow(run, f"conv_id {kind}, {EDITS}")


def _portions(items: Iterator, n: int) -> Iterator[list]:
    part = []
    for x in items:
        part.append(x)
        if len(part) == n:
            yield part
            part = []
    yield part


def repaired(rows: DataFrame) -> DataFrame:
    """conv_id, place, role, text of the repaired conversations; rows marked as lost are missing rows."""
    kept = edits(rows).where("repaired_role is not null").withColumn("__at", F.monotonically_increasing_id())
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("__at"))
    return kept.select("conv_id", place.cast("long").alias("place"), F.col("repaired_role").alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


class _Sums:
    """Counts and digest of one conversation's edits, as they stream by."""

    def __init__(self):
        self.low = self.high = self.last = self.before = None
        self.turns = self.illegal = self.cost = 0
        self.faults = {"blank": 0, "duplicate": 0, "truncated": 0}
        self.audit, self.sha, self.first = [], hashlib.sha256(), True

    def add(self, turn, role, text, fault, edit, new) -> None:
        self.audit.append(edit)
        self.cost += COST[edit] + (fault == "truncated" and edit != "D")
        if edit != "I":
            if turn is not None:
                self.turns += turn != self.last
                self.low = turn if self.low is None else self.low
                self.high = self.last = turn
            if fault:
                self.faults[fault] += 1
            if self.before is not None:
                self.illegal += self.before + role[:1] not in ("su", "ua", "au")
            self.before = role[:1]
        if new is not None:
            self.sha.update(f"{'' if self.first else chr(10)}{new}:{text or ''}".encode())
            self.first = False

    def row(self, conv) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return (conv, gaps, *self.faults.values(), self.illegal, self.cost, "".join(self.audit), self.sha.hexdigest())


DIGEST = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def digest(rows: DataFrame, window: int = WINDOW) -> DataFrame:
    """Faults, cost, edits and the repaired text's hash of each conversation; reads the edits as they come, without a shuffle."""
    kind = dict(rows.dtypes)["conv_id"]
    names = ["conv_id", *(x.split()[0] for x in DIGEST.split(", "))]

    def run(batches):
        now, sums, schema = None, None, None
        for batch in batches:
            out = []
            for conv, turn, role, text, fault, edit, new in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if sums is None or conv != now:
                    if sums is not None:
                        out.append(sums.row(now))
                    now, sums = conv, _Sums()
                if edit is not None:
                    sums.add(turn, role, text, fault, edit, new)
            schema = pa.schema([("conv_id", batch.schema.field("conv_id").type), *((n, pa.int64()) for n in names[1:7]), *((n, pa.string()) for n in names[7:])])
            if out:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)
        if sums is not None:
            yield pa.record_batch([pa.array([x], t) for x, t in zip(sums.row(now), schema.types, strict=True)], schema=schema)

    return edits(rows, window).mapInArrow(run, f"conv_id {kind}, {DIGEST}")


def _best(*options: str) -> str:
    return f"list_sort([{', '.join(options)}])[1]"


def _edit(s: str, edit: str, cost: str, line: str = "''", when: str = "true") -> str:
    text = f"CASE WHEN {line} = '' THEN {s}.t WHEN {s}.t = '' THEN {line} ELSE {s}.t || chr(10) || {line} END" if line != "''" else f"{s}.t"
    return f"{{'c': CASE WHEN {when} THEN {s}.c + {cost} ELSE 1000000000 END, 'a': {s}.a || '{edit}', 't': {text}}}"


_STAY = "2 + r.cut"
_SQL_STEP = {
    "n0": _best(_edit("b.s0", "D", "3")),
    "n1": _best(_edit("b.s1", "D", "3"), _edit("b.s0", "K", "r.cut", "r.line", "r.i = 's' AND NOT r.gone")),
    "n2": _best(_edit("b.s2", "D", "3"), *(x for s in ("b.s0", "b.s1", "b.s3") for x in (_edit(s, "K", "r.cut", "r.line", "r.i = 'u' AND NOT r.gone"), _edit(s, "R", _STAY, "r.as_user", "NOT r.gone")))),
    "n3": _best(_edit("b.s3", "D", "3"), _edit("b.s2", "K", "r.cut", "r.line", "r.i = 'a' AND NOT r.gone"), _edit("b.s2", "R", _STAY, "r.as_assistant", "NOT r.gone")),
}
_NONE = "{'c': 1000000000, 'a': '', 't': ''}"
_CUT = "rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"

SQL = f"""
WITH RECURSIVE {CRC_TABLE},
k AS MATERIALIZED (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         {crc_sql("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS f
  FROM conversations, crc_table),
d AS MATERIALIZED (
  SELECT conv_id, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN f = 1 THEN '' WHEN f = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM k, unnest(range(CASE WHEN f = 3 THEN 2 ELSE 1 END)) AS u(x) WHERE f <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n FROM d),
p AS MATERIALIZED (
  SELECT *, CASE WHEN {_CUT} = '' THEN 'blank'
              WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 THEN 'duplicate'
              WHEN right({_CUT}, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault
  FROM o),
r AS MATERIALIZED (
  SELECT conv_id, n, left(role, 1) AS i, fault IN ('blank', 'duplicate') AS gone, (fault = 'truncated')::BIGINT AS cut,
         role || ':' || text AS line, 'user:' || text AS as_user, 'assistant:' || text AS as_assistant FROM p),
v AS (
  SELECT conv_id, 0::BIGINT AS n, {{'c': 0::BIGINT, 'a': '', 't': ''}} AS s0, {{'c': 1000000000::BIGINT, 'a': '', 't': ''}} AS s1,
         {{'c': 2::BIGINT, 'a': 'I', 't': 'user:'}} AS s2, {{'c': 4::BIGINT, 'a': 'II', 't': 'user:' || chr(10) || 'assistant:'}} AS s3
  FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL
  SELECT conv_id, n, n0, n1, m2, {_best("n3", _edit("m2", "I", "2", "'assistant:'"))} FROM (
    SELECT *, {_best("n2", *(_edit(s, "I", "2", "'user:'") for s in ("n0", "n1", "n3")))} AS m2 FROM (
      SELECT b.conv_id, r.n, {", ".join(f"{x} AS {n}" for n, x in _SQL_STEP.items())}
      FROM v AS b JOIN r ON r.conv_id IS NOT DISTINCT FROM b.conv_id AND r.n = b.n + 1))),
e AS (SELECT conv_id, {_best("s0", "s3")} AS s FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY n DESC) AS z FROM v) WHERE z = 1),
q AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank,
         count(*) FILTER (WHERE fault = 'duplicate') AS duplicate, count(*) FILTER (WHERE fault = 'truncated') AS truncated,
         count(*) FILTER (WHERE left(before, 1) || left(role, 1) NOT IN ('su', 'ua', 'au')) AS illegal
  FROM (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY n) AS before FROM p) GROUP BY conv_id)
SELECT e.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
       coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, e.s.c::BIGINT AS cost, e.s.a AS audit, sha256(e.s.t) AS repaired_sha256
FROM e LEFT JOIN q ON q.conv_id IS NOT DISTINCT FROM e.conv_id
"""
