"""Conversation repair, lattice hashing of vectors, and importance resampling, each against a plain version."""

import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.llm import conversations, lattice_dedup, queries, resampling, spans

SF = "/root/testdata/sf0.001"

# 11

RIGHT = re.compile(r"(s?(ua)+)?")


def cheapest(rows):
    """Least (cost, edits) over all edit scripts; rows: (initial, fault)."""
    best = None

    def go(i, s, cost, edits, inserts):
        nonlocal best
        if best and (cost, "") > (best[0], ""):
            return
        if i == len(rows) and s in "-a":
            best = min(best, (cost, edits)) if best else (cost, edits)
        up = "a" if s == "u" else "u"
        if inserts < 3:
            go(i, up, cost + 2, edits + "I", inserts + 1)
        if i < len(rows):
            initial, fault = rows[i]
            more = fault == "truncated"
            go(i + 1, s, cost + 3, edits + "D", 0)
            if fault not in ("blank", "duplicate"):
                go(i + 1, up, cost + 2 + more, edits + "R", 0)
                if initial == up or initial == "s" and s == "-":
                    go(i + 1, initial, cost + more, edits + "K", 0)

    go(0, "-", 0, "", 0)
    return best


def decoded(rows, window=200):
    d, out = conversations.Decoder(window), []
    for i, (initial, fault) in enumerate(rows):
        out += d.step(initial, fault, (i, initial, "t", fault), 3)
    return [*out, *d.end()]


def test_edits_are_the_cheapest_and_least():
    rng = random.Random(5)
    some = [[(rng.choice("uuaasx"), rng.choice([None, None, None, "blank", "duplicate", "truncated"])) for _ in range(rng.randint(0, 6))] for _ in range(400)]
    for rows in [*some, *([(c, None) for c in word] for n in range(5) for word in itertools.product("uas", repeat=n))]:
        out = decoded(rows)
        cost = sum(conversations.COST[e] + (r is not None and r[3] == "truncated" and e != "D") for e, r, _ in out)
        assert (cost, "".join(e for e, _, _ in out)) == cheapest(rows), rows
        assert RIGHT.fullmatch("".join(role[0] for _, _, role in out if role))
        assert [r[0] for _, r, _ in out if r] == list(range(len(rows)))


def test_settled_edits_leave_and_undecided_ones_wait_outside_memory():
    d, settled = conversations.Decoder(1000), 0
    for i in range(3000):  # a right conversation is settled within a few rows
        c = "ua"[i % 2]
        settled += len(list(d.step(c, None, (i, c, "t", None), 10)))
        assert settled >= i - 4 and len(d.rows.near) + len(d.rows.late) <= 5
    assert d.rows.file is None
    d, out = conversations.Decoder(1000), []
    for i in range(3000):  # users alone: the end decides between two readings
        out += d.step("u", None, (i, "u", "t", None), 10)
        assert len(d.rows.near) + len(d.rows.late) <= 30
    waiting = [d.root]
    for p in waiting:
        waiting += p.kids
    assert len(waiting) <= 7 and d.rows.file is not None
    out += d.end()
    assert [r[0] for _, r, _ in out if r] == list(range(3000)) and "".join(e for e, _, _ in out) == "KR" * 1500


TALK = [
    (1, 0, "system", "Be brief."), (1, 1, "user", "Hi?"), (1, 2, "assistant", "Hello."), (1, 3, "user", "Hi?"), (1, 3, "user", "Hi?"), (1, 4, "assistant", "no mark"), (2, None, "user", "first?"), (2, None, None, None),
    (2, 7, "assistant", "x."), (None, 0, "user", "lost?"), (None, 1, "assistant", "\t \n"), (3, 5, "assistant", "só é.\n"), (3, 2, "user", "long " * 5000 + "!"), (3, 2, "user", "other."), (4, 0, "tool", "ok."), (4, 1, "", ""), (5, 3, "Ünknown", "u."), (5, 3, "user", "v."),
]


def plain_digest(talk, conv):
    rows = []
    for c, turn, role, text in talk:
        if c != conv:
            continue
        f = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if f == 1 else re.sub("[.!?]", "", text) if f == 2 else text
        rows += [(turn, "user" if f == 4 else role, text)] * (0 if f == 0 else 2 if f == 3 else 1)
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    seen, own = set(), []
    for turn, role, text in rows:
        rest = text.strip(" \t\n\x0b\x0c\r")
        own.append((turn, role, text, "blank" if not rest else "duplicate" if (role, text) in seen else "truncated" if rest[-1] not in ".!?" else None))
        seen.add((role, text))
    turns = [r[0] for r in own if r[0] is not None]
    cost, edits = cheapest([(r[1][:1], r[3]) for r in own])
    lines, state, todo = [], "-", list(own)
    for e in edits:
        row = todo.pop(0) if e != "I" else (None, None, "", None)
        if e != "D":
            state = row[1][:1] if e == "K" else "a" if state == "u" else "u"
            lines.append(f"{row[1] if e == 'K' else {'u': 'user', 'a': 'assistant'}[state]}:{row[2]}")
    count = [sum(r[3] == f for r in own) for f in ("blank", "duplicate", "truncated")]
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(own))
    return (conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *count, illegal, cost, edits, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def talk_frame(spark):
    return spark.createDataFrame(TALK, "conv_id long, turn long, role string, text string").withColumns({c: F.lit(1) for c in ("lost", "fault", "edit", "row", "cost")})


def test_conversations(spark):
    got = sorted((tuple(r) for r in conversations.digest(conversations.damage(talk_frame(spark))).collect()), key=repr)
    assert got == sorted((plain_digest(TALK, c) for c in {t[0] for t in TALK}), key=repr)
    assert conversations.digest(conversations.damage(talk_frame(spark).limit(0))).collect() == []


def test_conversation_of_which_all_is_lost(spark):
    gone = [i for i in range(100) if zlib.crc32(f"{i}:0".encode()) % 20 == 0][:2]
    df = spark.createDataFrame([(i, 0, "user", "x.") for i in gone], "conv_id long, turn long, role string, text string")
    empty = hashlib.sha256(b"").hexdigest()
    assert sorted(tuple(r) for r in conversations.digest(conversations.damage(df)).collect()) == [(i, 0, 0, 0, 0, 0, 0, "", empty) for i in gone]
    assert conversations.repaired(conversations.damage(df)).collect() == []


def test_repaired_rows(spark):
    rows = spark.createDataFrame([(1, 0, "assistant", "Hello."), (1, 1, "user", "Why?"), (1, 2, "user", "So?")], "conv_id long, turn long, role string, text string")
    out = conversations.repaired(rows).orderBy("conv_id", "place").collect()
    assert [(r["place"], r["role"], r["text"]) for r in out] == [(1, "user", ""), (2, "assistant", "Hello."), (3, "user", "Why?"), (4, "assistant", "So?")]


# 12


def plain_links(items, threshold=0.98):
    """(id, links, component, kept) by comparing every pair."""
    unit = []
    for key, v, label in items:
        ok = key is not None and label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)
        x = np.array(v, np.float64) / max(map(abs, v)) if ok else None
        unit.append(x / np.linalg.norm(x) if ok else None)
    links, least = [0] * len(items), [i[0] for i in items]
    pairs = [(a, b) for a, b in itertools.combinations(range(len(items)), 2) if unit[a] is not None and unit[b] is not None and items[a][2] == items[b][2] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= threshold]
    for a, b in pairs:
        links[a] += 1
        links[b] += 1
    for _ in items:
        for a, b in pairs:
            least[a] = least[b] = min(least[a], least[b])
    return sorted(((i[0], n, c, i[0] == c) for i, n, c in zip(items, links, least, strict=True)), key=repr)


def made_vectors():
    rng = np.random.default_rng(3)
    base = rng.standard_normal((12, 64))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    items = [(100 + i, (base[i % 12] + rng.standard_normal(64) * 0.012).tolist(), i % 3 if i % 12 else None) for i in range(240)]
    same = base[1].tolist()
    items += [(i, same, 1) for i in (7, 8, 8, 9)] + [(5, (base[1] * 1e-200).tolist(), 1), (6, (base[1] * 1e200).tolist(), 1), (None, same, 1), (11, same, None), (12, same, 2)]
    items += [(20, None, 1), (21, [], 1), (22, [0.0] * 64, 1), (23, [*same[:-1], None], 1), (24, [*same[:-1], float("nan")], 1), (25, [*same[:-1], float("inf")], 1), (26, [1.0, 2.0], 1), (27, [1.0, 2.001], 1), (28, [3.0], 1), (29, [0.5], 1)]
    return items


def test_lattice_dedup(spark):
    items = made_vectors()
    df = spark.createDataFrame(items, "vec_id long, embedding array<double>, label int").withColumns({c: F.lit("x") for c in ("rid", "cell", "v", "h1", "component", "n", "a", "least")})
    got = sorted((tuple(r) for r in lattice_dedup.near_duplicates(df).collect()), key=repr)
    assert got == plain_links(items)
    assert lattice_dedup.near_duplicates(df.limit(0)).collect() == []
    assert sorted(tuple(r) for r in lattice_dedup.near_duplicates(df.where("vec_id in (20, 22)")).collect()) == [(20, 0, 20, True), (22, 0, 22, True)]


def test_large_cells_are_dealt_out_as_blocks(spark, monkeypatch):
    monkeypatch.setattr(lattice_dedup, "BLOCK", 40)
    monkeypatch.setattr(lattice_dedup, "SMALL", 8)
    monkeypatch.setattr(lattice_dedup, "STRIP", 16)
    monkeypatch.setattr(lattice_dedup, "GATHER", 50)
    rng = np.random.default_rng(4)
    base = rng.standard_normal(64)
    base /= np.linalg.norm(base)
    items = [(i, (base + rng.standard_normal(64) * 0.0125).tolist(), 0) for i in range(300)]
    df = spark.createDataFrame(items, "vec_id long, embedding array<float>, label int")
    items = [(r["vec_id"], r["embedding"], r["label"]) for r in df.collect()]
    assert sorted((tuple(r) for r in lattice_dedup.near_duplicates(df).collect()), key=repr) == plain_links(items)


def test_decoding_finds_the_nearest_lattice_point():
    x = np.random.default_rng(5).standard_normal((500, 8)) * 3
    p = lattice_dedup.decode(x)
    twice = np.rint(2 * p).astype(int)
    assert ((twice % 2 == 0).all(1) | (twice % 2 == 1).all(1)).all() and (twice.sum(1) % 4 == 0).all()
    assert len(np.unique(lattice_dedup.SHORTEST, axis=0)) == 240 and np.allclose((lattice_dedup.SHORTEST**2).sum(1), 2)
    away = ((x - p) ** 2).sum(1)
    assert (away <= 1 + 1e-9).all()  # the covering radius
    for v in lattice_dedup.SHORTEST:  # the relevant vectors of norm 2
        assert (away <= ((x - p - v) ** 2).sum(1) + 1e-9).all()


@pytest.mark.parametrize("blocks", [1, 2, 3])
def test_pairs_at_the_threshold_meet(blocks):
    own = lattice_dedup.plan(64, 10_000, 0.98, blocks=blocks)
    rng = np.random.default_rng(6)
    a, b = rng.standard_normal((2, 3000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(1, keepdims=True) * a
    b = 0.98 * a + math.sqrt(1 - 0.98**2) * b / np.linalg.norm(b, axis=1, keepdims=True)
    met = np.zeros(3000, bool)
    for t in range(own.tables):
        met |= lattice_dedup._meets(lattice_dedup.cells(a, t, blocks), lattice_dedup.cells(b, t, blocks))
    assert met.mean() >= 0.99


# 13

LETTERS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_features(text, ngram=1):
    words = LETTERS.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return words, [zlib.crc32(" ".join(words[i : i + n]).encode()) for n in range(1, ngram + 1) for i in range(len(words) - n + 1)]


def plain_resample(docs, target, share, least, ngram=1, buckets=10_000):
    s, t = ([0] * buckets for _ in range(2))
    for counts, texts in ((s, [d[1] for d in docs]), (t, target)):
        for text in texts:
            for h in plain_features(text, ngram)[1]:
                counts[h % buckets] += 1
    gain = [math.floor(1000 * math.log((t[b] + 1) * (sum(s) + buckets) / ((s[b] + 1) * (sum(t) + buckets)))) for b in range(buckets)]
    out = []
    for key, text in docs:
        words, own = plain_features(text, ngram)
        weight = sum(gain[h % buckets] for h in own)
        h = int(hashlib.sha256(f"2024:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        out.append((key, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words) >= least))
    order = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    drawn = [(*r[:4], k + 1 if k < len(order) * share // 100 else None) for k, r in enumerate(order)]
    return sorted([*drawn, *((*r[:4], None) for r in out if not r[4])], key=repr)


def made_docs():
    rng = random.Random(7)
    words = ["alpha", "Beta", "g4mma", "дельта", "日本語", "x" * 70, "é"]
    docs = [(i % 250 if i % 17 else 3, " ".join(rng.choice(words) for _ in range(rng.randint(0, 40))).replace(" ", rng.choice([" ", "-", "\n. "]))) for i in range(400)]
    return [*docs, (None, "alpha beta " * 20), (1000, None), (1001, ""), (1002, "..."), (1003, "word " * 30000), (1004, "Z" * 5000), *[(5, "alpha " * 25)] * 120]


@pytest.mark.parametrize(("share", "ngram", "buckets"), [(10, 1, 10_000), (60, 2, 500), (100, 3, 97)])
def test_resampling(spark, monkeypatch, share, ngram, buckets):
    monkeypatch.setattr(resampling, "MOST_SAMPLES", 60)
    docs, target = made_docs(), ["alpha beta alpha", None, "", "日本語 g4mma"]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(7).withColumns({c: F.lit("x") for c in ("rank", "run", "at", "k0", "segment", "part", "score", "bucket", "weight")})
    goal = spark.createDataFrame([(t,) for t in target], "text string")
    out = resampling.resample(df, goal, share, 20, ngram, buckets)
    assert sorted((tuple(r) for r in out.collect()), key=repr) == plain_resample(docs, target, share, 20, ngram, buckets)


def test_resampling_without_rows(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    one = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    assert resampling.resample(none, none.select("text")).collect() == []
    assert [r["rank"] for r in resampling.resample(one, none.select("text"), 100, 3).collect()] == [1]
    assert [r["rank"] for r in resampling.resample(one, none.select("text"), 100, 4).collect()] == [None]
    assert resampling.draw(one, none.select("text"), 100, 3).collect() == one.collect()


def test_crc_of_stretches():
    rng = np.random.default_rng(8)
    raw = rng.integers(0, 256, 5000).astype(np.uint8)
    starts = rng.integers(0, 5000, 300)
    ends = np.minimum(5000, starts + rng.integers(0, 200, 300))
    assert spans.crc32_spans(raw, starts, ends).tolist() == [zlib.crc32(raw[a:b].tobytes()) for a, b in zip(starts, ends, strict=True)]


@pytest.mark.parametrize("name", ["op11_conversations", "op12_embedding_dedup", "op13_resampling"])
def test_query_equals_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(queries.oracle_sql()[name])
    got = queries.queries()[name](spark, SF).select(*want.columns)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == sorted(want.fetchall(), key=repr)
