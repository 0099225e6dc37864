"""Line dedup, in DataFrame functions only: overlapping windows of three lines, later occurrences removed.

A text's lines are what stands between line feeds.  Each three consecutive lines, not all blank, are a window, known
by two 64-bit hashes.  Windows are counted over all documents; of those that occur again the first in the order of
(doc_id, text hash, line) stays, and every later occurrence removes its three lines; covered lines are merged and the
rest is joined again.

Shuffles: one row of hashes for each window (counted where it is read first), one for the windows that repeat, and the
texts once, to meet their removals.  A window that a third of all documents share is counted before it is shuffled,
and its occurrences meet its first place in a broadcast or in a join that adaptive execution splits.

Defined results: a null text stays null and has no lines; an empty text has one blank line; texts of one or two lines
stay as they are; a text all of whose lines go becomes ""; rows with the same id and text are one place, and each gets
the same result; null ids come last in the order; extra columns of any name are kept by `remove_repeats`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: Repeated windows are broadcast up to this number (some 30 MB) and joined by a shuffle beyond it.
BROADCAST_WINDOWS = 500_000
WORD = r"[^\x20\x09-\x0D]"


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _windows(docs: DataFrame) -> DataFrame:
    """(absent, id, mark, pos, h1, h2) of every window; docs: columns id and text."""
    at = F.sequence(F.lit(0), F.size("lines") - 3)

    def window(i: Column) -> Column:
        a, b, c = (F.get("lines", i + k) for k in range(3))
        solid = F.concat(a, b, c).rlike(WORD)
        return F.when(solid, F.struct(i.alias("pos"), F.xxhash64(a, b, c).alias("h1"), F.xxhash64(c, F.lit("|"), a, b).alias("h2")))

    own = docs.where("text is not null").select("id", F.xxhash64("text").alias("mark"), _lines(F.col("text")).alias("lines")).where(F.size("lines") >= 3)
    own = own.select("id", "mark", F.explode(F.transform(at, window)).alias("w")).where("w is not null")
    return own.select(F.col("id").isNull().alias("absent"), "id", "mark", "w.pos", "w.h1", "w.h2")


def removals(docs: DataFrame) -> DataFrame:
    """(id, mark, at): sorted first lines of the windows that go, for the texts that lose any."""
    spark = docs.sparkSession
    windows = _windows(docs)
    place = F.struct("absent", "id", "mark", "pos")
    counted = windows.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min(place).alias("first")).where("n > 1")
    firsts = materialise(counted.select("h1", "h2", "first"), "windows")
    if firsts.count() <= BROADCAST_WINDOWS:
        firsts = F.broadcast(firsts)
    later = windows.join(firsts, ["h1", "h2"]).where(~place.eqNullSafe(F.col("first")))
    return later.groupBy("id", "mark").agg(F.array_sort(F.collect_set("pos")).alias("at"))


def _gaps(at: Column, n: Column) -> Column:
    """Stretches of lines between the merged windows, as (from, to)."""

    def gap(i: Column) -> Column:
        lo = F.when(i == 0, F.lit(0)).otherwise(F.get(at, i - 1) + 3)
        hi = F.when(i == F.size(at), n).otherwise(F.get(at, i))
        return F.struct(lo.alias("lo"), hi.alias("hi"))

    return F.filter(F.transform(F.sequence(F.lit(0), F.size(at)), gap), lambda g: g["hi"] > g["lo"])


def _reduced(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """row (all columns of docs), text, n_lines, n_removed."""
    own = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    gone = removals(own.select("id", "text")).withColumnRenamed("id", "gone_id").withColumnRenamed("mark", "gone_mark")
    own = own.select("row", "id", F.xxhash64("text").alias("mark"))
    met = own.join(gone, own["id"].eqNullSafe(gone["gone_id"]) & (own["mark"] == gone["gone_mark"]), "left")
    text = F.col("row")[text_col]
    lines = _lines(text)
    rest = F.flatten(F.transform(_gaps(F.col("at"), F.size(lines)), lambda g: F.slice(lines, g["lo"] + 1, g["hi"] - g["lo"])))
    met = met.select("row", text.alias("text"), F.when(text.isNull(), F.lit(0)).otherwise(F.size(lines)).alias("n_lines"), F.when(F.col("at").isNotNull(), rest).alias("rest"))
    return met.select(
        "row",
        F.when(F.col("rest").isNull(), F.col("text")).otherwise(F.array_join("rest", "\n")).alias("text"),
        F.col("n_lines").cast("long").alias("n_lines"),
        F.when(F.col("rest").isNull(), F.lit(0)).otherwise(F.col("n_lines") - F.size("rest")).cast("long").alias("n_removed"),
    )


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, text without later occurrences, n_lines before, n_removed."""
    return _reduced(docs, id_col, text_col).select(F.col("row")[id_col].alias(id_col), F.col("text").alias(text_col), "n_lines", "n_removed")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the same columns and the texts that are left; documents all of whose lines went are dropped."""
    out = _reduced(docs, id_col, text_col).where("n_lines = 0 or n_removed < n_lines")
    return out.select(*(F.col("text").alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns))


SQL = r"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
w AS (
  SELECT doc_id, p, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, p) AS k
  FROM (SELECT doc_id, p, ls[p] AS a, ls[p + 1] AS b, ls[p + 2] AS c FROM d, unnest(range(1, len(ls) - 1)) AS t(p))
  WHERE regexp_matches(a || b || c, '[^\x20\x09-\x0D]')
),
gone AS (SELECT DISTINCT doc_id, p + o AS p FROM w, (VALUES (0), (1), (2)) AS v(o) WHERE k > 1),
x AS (SELECT doc_id, p, ls[p] AS line FROM d, unnest(range(1, len(ls) + 1)) AS t(p)),
y AS (
  SELECT x.doc_id, count(*) AS n_lines, count(g.p) AS n_removed,
         coalesce(string_agg(line, chr(10) ORDER BY x.p) FILTER (WHERE g.p IS NULL), '') AS kept
  FROM x LEFT JOIN gone AS g ON g.doc_id = x.doc_id AND g.p = x.p GROUP BY x.doc_id
)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE y.kept END AS text,
       coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed
FROM d LEFT JOIN y ON y.doc_id = d.doc_id
"""
