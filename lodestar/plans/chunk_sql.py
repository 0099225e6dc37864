"""SQL of the chunker's rules for DuckDB: recursive queries that go over texts and blocks one step at a time."""

from __future__ import annotations

from lodestar.functions.text import SPACE
from lodestar.operators.chunking import MARKS, SEPARATORS, Limits


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def strip(column: str) -> str:
    return f"regexp_replace({column}, {quoted(f'^{SPACE}+|{SPACE}+$')}, '', 'g')"


def tail(column: str, n: int) -> str:
    return f"regexp_replace(right({column}, {n}), {quoted(f'(?s)^[^{MARKS}]*[{MARKS}](.)')}, '\\1')"


def parts(source: str, size: int, overlap: int, name: str = "parts") -> str:
    """CTEs that end with name(id, part, text), for the source's id and text."""
    p = name
    out = [f"{p}_c0 AS (SELECT DISTINCT id, unnest([0, length(text)]) AS pos FROM {source} WHERE text <> '')"]
    for k, mark in enumerate(SEPARATORS, 1):
        bits = f"string_split(text, {quoted(mark)})"
        out += [
            f"{p}_e{k} AS (SELECT id, (sum(length(x) + {len(mark)}) OVER (PARTITION BY id ORDER BY j))::BIGINT AS pos FROM (SELECT id, unnest({bits}) AS x, unnest(range(len({bits}))) AS j FROM {source}))",
            f"{p}_s{k} AS (SELECT id, pos AS lo, lead(pos) OVER (PARTITION BY id ORDER BY pos) AS hi FROM {p}_c{k - 1})",
            f"{p}_c{k} AS MATERIALIZED (SELECT id, pos FROM {p}_c{k - 1} UNION SELECT e.id, e.pos FROM {p}_e{k} AS e ASOF JOIN {p}_s{k} AS s ON s.id = e.id AND e.pos > s.lo WHERE e.pos < s.hi AND s.hi - s.lo > {size})",
        ]
    n = len(SEPARATORS)
    return ",\n".join(
        [
            *out,
            f"{p}_s AS (SELECT id, pos AS lo, lead(pos) OVER (PARTITION BY id ORDER BY pos) AS hi FROM {p}_c{n})",
            f"{p}_c AS (SELECT id, pos FROM {p}_c{n} UNION SELECT id, unnest(range(lo + {size}, hi, {size})) FROM {p}_s WHERE hi - lo > {size})",
            f"{p}_l AS MATERIALIZED (SELECT id, text, places FROM {source} JOIN (SELECT id, list(pos ORDER BY pos) AS places FROM {p}_c GROUP BY id) USING (id))",
            f"""{p}_r AS (
  SELECT id, 0 AS n, 1::BIGINT AS place, ''::VARCHAR AS part, ''::VARCHAR AS held FROM {p}_l
  UNION ALL
  SELECT id, n + 1, goes_to, part, {tail('part', overlap)} FROM (
    SELECT id, n, goes_to, held || substring(text, places[place]::INT + 1, (places[goes_to] - places[place])::INT) AS part FROM (
      SELECT r.id, n, place, held, text, places, greatest(place + 1, len(list_filter(places, lambda x: x <= places[place] + {size} - length(held)))) AS goes_to
      FROM {p}_r AS r JOIN {p}_l AS l ON l.id = r.id WHERE place < len(places))))""",
            f"{name} AS (SELECT id, row_number() OVER (PARTITION BY id ORDER BY n) - 1 AS part, part AS text FROM {p}_r WHERE {strip('part')} <> '')",
        ]
    )


def chunks(blocks: str, limits: Limits) -> str:
    """CTEs that end with chunks(doc, chunk_index, text, page_start, page_end, path, kind, how), for blocks of the columns doc,
    ord, text (null for none), page, path (one string), kind and level."""
    size, half = limits.size, limits.size // 2
    passage = "{'t': " + strip("text") + ", 'a': CASE WHEN first = 0 THEN 1 ELSE first END, 'z': CASE WHEN last <> 0 THEN last WHEN first <> 0 THEN first ELSE 1 END, 'p': path, 'k': kind}"
    none = "NULL::STRUCT(t VARCHAR, a BIGINT, z BIGINT, p VARCHAR, k VARCHAR)"
    gathered = f"""bl AS MATERIALIZED (
  SELECT doc, row_number() OVER (PARTITION BY doc ORDER BY ord) AS n, t, coalesce(page, 0)::BIGINT AS page, path AS own_path, kind AS own_kind, CASE WHEN kind = 'heading' THEN coalesce(level, 0) ELSE 0 END::BIGINT AS own_level
  FROM (SELECT *, {strip("coalesce(text, '')")} AS t FROM {blocks}) WHERE t <> ''),
ga AS (
  SELECT DISTINCT doc, 0::BIGINT AS n, ''::VARCHAR AS text, 0::BIGINT AS length, 0::BIGINT AS fresh, 0::BIGINT AS first, 0::BIGINT AS last, ''::VARCHAR AS path, ''::VARCHAR AS kind, 0::BIGINT AS level, {none} AS x, {none} AS y FROM bl
  UNION ALL
  SELECT doc, n, CASE WHEN due THEN carried ELSE text END, CASE WHEN due THEN length(carried) ELSE length END, CASE WHEN due THEN 0 ELSE fresh END, first, last, path, kind, level, x, CASE WHEN due THEN {passage} END
  FROM (SELECT *, own_level = 0 AND length >= {size} AS due, CASE WHEN length({strip('text')}) <= {limits.split_above} THEN {tail(strip('text'), limits.overlap)} ELSE '' END AS carried FROM (
    SELECT doc, n, own_level, CASE WHEN text = '' THEN t ELSE text || chr(10) || t END AS text, length + length(t) + 1 AS length, fresh + length(t) AS fresh,
           CASE WHEN fresh = 0 THEN page ELSE first END AS first, CASE WHEN fresh = 0 THEN page ELSE greatest(last, page) END AS last, CASE WHEN fresh = 0 THEN own_path ELSE path END AS path,
           CASE WHEN fresh = 0 THEN own_kind ELSE kind END AS kind, CASE WHEN own_level > 0 THEN own_level ELSE level END AS level, x
    FROM (SELECT doc, n, t, page, own_path, own_kind, own_level, CASE WHEN turn THEN '' ELSE text END AS text, CASE WHEN turn THEN 0 ELSE length END AS length, CASE WHEN turn THEN 0 ELSE fresh END AS fresh,
                 first, last, path, kind, level, CASE WHEN turn AND fresh > 0 THEN {passage} END AS x
      FROM (SELECT ga.doc, bl.n, bl.t, bl.page, own_path, own_kind, own_level, ga.text, ga.length, ga.fresh, ga.first, ga.last, ga.path, ga.kind, ga.level,
                   own_level > 0 AND ga.text <> '' AND (ga.level = 0 OR own_level < ga.level OR (own_level = ga.level AND ga.length >= {half})) AS turn
            FROM ga JOIN bl ON bl.doc = ga.doc AND bl.n = ga.n + 1))))),
gz AS (SELECT doc, n, text, fresh, first, last, path, kind, row_number() OVER (PARTITION BY doc ORDER BY n DESC) AS z FROM ga),
ro AS MATERIALIZED (
  SELECT doc || ':' || row_number() OVER (PARTITION BY doc ORDER BY n, o) AS id, doc, row_number() OVER (PARTITION BY doc ORDER BY n, o) AS r, v.t AS text, v FROM (
    SELECT doc, n, 0 AS o, x AS v FROM ga UNION ALL SELECT doc, n, 1, y FROM ga UNION ALL SELECT doc, n, 2, {passage} FROM gz WHERE z = 1 AND fresh > 0) WHERE v IS NOT NULL),
lo AS (SELECT id, text FROM ro WHERE length(text) > {limits.split_above})"""
    cut = f"""c1 AS (SELECT ro.id, doc, r, coalesce(p.part, 0) AS k, {strip('coalesce(p.text, ro.text)')} AS text, CASE WHEN p.id IS NULL THEN 'structural' ELSE 'recursive' END AS how, v FROM ro LEFT JOIN lp AS p ON p.id = ro.id),
ov AS (SELECT id || ':' || k AS id, text FROM c1 WHERE length(text) > {limits.most})"""
    piece = "STRUCT(t VARCHAR, a BIGINT, z BIGINT, p VARCHAR, k VARCHAR, h VARCHAR)"
    empty = f"NULL::{piece}"

    def join(a: str, b: str, first: str) -> str:
        return f"{{'t': {a}.t || chr(10) || {b}.t, 'a': {first}.a, 'z': greatest({a}.z, {b}.z), 'p': {a}.p, 'k': {a}.k, 'h': {a}.h}}"

    def fits(a: str, b: str) -> str:
        return f"coalesce(length({a}.t) + length({b}.t) <= {limits.most}, false)"

    evened = f"""c2 AS MATERIALIZED (
  SELECT doc, row_number() OVER (PARTITION BY doc ORDER BY r, k, m) AS i, {{'t': text, 'a': v.a, 'z': v.z, 'p': v.p, 'k': v.k, 'h': how}} AS p, whole FROM (
    SELECT doc, r, k, coalesce(q.part, 0) AS m, coalesce(q.text, c1.text) AS text, CASE WHEN q.id IS NULL THEN how ELSE 'fallback' END AS how, q.id IS NOT NULL AS whole, v FROM c1 LEFT JOIN op AS q ON q.id = c1.id || ':' || k)),
ev AS (
  SELECT DISTINCT doc, 0::BIGINT AS i, {empty} AS last, {empty} AS late, {empty} AS gone FROM c2
  UNION ALL
  SELECT doc, i, CASE WHEN NOT short THEN now WHEN {fits('last', 'now')} THEN {join('last', 'now', 'last')} ELSE last END, CASE WHEN short AND NOT {fits('last', 'now')} THEN now END, CASE WHEN NOT short THEN last END
  FROM (SELECT *, NOT whole AND length(now.t) < {limits.least} AS short FROM (
    SELECT doc, i, whole, CASE WHEN into_next THEN {join('p', 'late', 'late')} ELSE p END AS now, CASE WHEN late IS NOT NULL AND NOT into_next AND {fits('last', 'late')} THEN {join('last', 'late', 'last')} ELSE last END AS last
    FROM (SELECT ev.doc, c2.i, c2.p, whole, last, late, late IS NOT NULL AND NOT whole AND {fits('c2.p', 'late')} AS into_next FROM ev JOIN c2 ON c2.doc = ev.doc AND c2.i = ev.i + 1)))),
ez AS (SELECT doc, i, CASE WHEN {fits('last', 'late')} THEN {join('last', 'late', 'last')} ELSE last END AS v FROM (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY i DESC) AS z FROM ev) WHERE z = 1),
chunks AS (SELECT doc, row_number() OVER (PARTITION BY doc ORDER BY i, o) - 1 AS chunk_index, v.t AS text, v.a AS page_start, v.z AS page_end, v.p AS path, v.k AS kind, v.h AS how
  FROM (SELECT doc, i, 0 AS o, gone AS v FROM ev UNION ALL SELECT doc, i, 1, v FROM ez) WHERE v IS NOT NULL)"""
    return ",\n".join([gathered, parts("lo", size, limits.overlap, "lp"), cut, parts("ov", size, limits.overlap, "op"), evened])
