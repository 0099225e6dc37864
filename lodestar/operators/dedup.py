"""Exact and near duplicates: hashes, SimHash bands, and the greedy order-dependent verdicts."""

from __future__ import annotations

import itertools
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.functions.fingerprint import BANDS, hamming, simhash_of
from lodestar.functions.text import content_hash, normal, normal_nfkc
from lodestar.shared import discard, keep

#: What a row with a key costs, in pairs that are compared.
ROW = 16
#: Numbers of fingerprints whose keys are tried.
SPREAD = (1, 1 << 18, 1 << 22, 1 << 26, 1 << 30)
#: Rows of a key that one task takes, pairs that a task compares, and tasks at most.
TILE, PAIRS, TASKS = 4096, 4e6, 20_000


def exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", within: list[str] | None = None, compatible: bool = True) -> DataFrame:
    """id, content_hash, kept_id: the first id of each normal form; null texts count as empty.

    Hashes are made once and kept; only they are shuffled, and reduced before they are.  A hash of many rows is split by
    adaptive execution in the join."""
    keys = [*(within or []), "content_hash"]
    hashed = keep(docs.select(F.col(id_col), *(within or []), content_hash(F.coalesce(F.col(text_col), F.lit("")), compatible).alias("content_hash")), "hashes")
    first = hashed.groupBy(*keys).agg(F.min(id_col).alias("kept_id"))
    return hashed.join(first, keys)


def key_masks(most: int, n: int) -> list[int]:
    """Bits that two fingerprints must share, in one of these ways, if they share a band and differ in `most` bits at most.

    Beside the band the other 48 bits are cut into blocks, of which all but `most` are the same; a key is a band with so
    many blocks.  The shortest keys are taken that are still long enough for n fingerprints to be spread over them."""
    enough = math.log2(max(n, 1)) + 2
    for blocks in (0, *range(most + 1, most + 4)):
        same = max(0, blocks - most)
        masks = []
        for band in range(BANDS):
            own = 0xFFFF << (16 * band)
            rest = [i for i in range(64) if not own >> i & 1]
            cuts = [sum(1 << i for i in rest[len(rest) * b // blocks : len(rest) * (b + 1) // blocks]) for b in range(blocks)]
            masks += [own | sum(some) for some in itertools.combinations(cuts, same)]
        if min(m.bit_count() for m in masks) >= enough:
            break
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def cheapest_masks(prints: DataFrame, most: int, within: list[str]) -> tuple[list[int], float]:
    """The masks with the fewest pairs to compare (a row with a key counts as ROW of them), as counted over all
    fingerprints, and how many they are: keys get longer as long as that makes them fewer."""
    best, least, n = [], math.inf, prints.count()
    for size in SPREAD:
        masks = key_masks(most, size)
        if masks == best:
            continue
        if ROW * n * len(masks) >= least:
            break
        cost = _groups(_keyed(prints, masks, within, []), within).agg(F.sum(F.col("n").cast("double") * (F.col("n") + ROW))).first()[0] or 0.0
        if cost >= least:
            break
        best, least = masks, cost
    return best, least


def _keyed(prints: DataFrame, masks: list[int], within: list[str], keep_cols: list[str]) -> DataFrame:
    keys = F.array(*(F.struct(F.lit(j).alias("way"), F.col("simhash").bitwiseAND(F.lit(m)).alias("part")) for j, m in enumerate(masks)))
    return prints.select(*within, "simhash", *keep_cols, F.explode(keys).alias("k")).select(*within, "simhash", *keep_cols, "k.way", "k.part")


def _groups(keyed: DataFrame, within: list[str]) -> DataFrame:
    return keyed.groupBy(*within, "way", "part").agg(F.count("*").alias("n"))


def near_prints(prints: DataFrame, most: int, within: list[str], keep_cols: list[str]) -> DataFrame:
    """Rows x and y (as simhash, keep_cols and simhash2, keep_cols with a 2) of one namespace whose fingerprints share a
    16-bit band and differ in 1 to `most` bits; each pair comes once, x being the lesser fingerprint.

    Tasks are dealt by pairs to compare, as rows are few bytes: by these Spark would put all in one task, or gather the
    keys in the driver to broadcast them.  Of a key with more than TILE rows each task takes the pairs of one stripe of
    its rows with all of them."""
    masks, cost = cheapest_masks(prints, most, within)
    keyed = _keyed(prints, masks, within, keep_cols)
    wide = _groups(keyed, within).where(F.col("n") > TILE).select(*within, "way", "part", F.ceil(F.col("n") / TILE).cast("int").alias("stripes"))
    keyed = keyed.join(F.broadcast(wide), [*within, "way", "part"], "left").withColumn("stripes", F.coalesce("stripes", F.lit(1)))
    keys = [*within, "way", "part", "stripe"]
    tasks = max(1, min(TASKS, round(cost / PAIRS)))
    flat = keyed.withColumn("stripe", F.pmod(F.xxhash64("simhash"), "stripes").cast("int")).drop("stripes").repartition(tasks, *keys)
    other = keyed.withColumn("stripe", F.explode(F.sequence(F.lit(0), F.col("stripes") - 1))).drop("stripes").repartition(tasks, *keys)
    other = other.withColumnsRenamed({c: f"{c}2" for c in ("simhash", *keep_cols)})
    differ = F.col("simhash").bitwiseXOR(F.col("simhash2"))
    met = flat.hint("merge").join(other.hint("merge"), keys).where((F.col("simhash") < F.col("simhash2")) & (F.bit_count(differ) <= most))
    first = F.coalesce(*(F.when(differ.bitwiseAND(F.lit(m)) == 0, j) for j, m in enumerate(masks)))
    return met.where(F.col("way") == first).drop("way", "part", "stripe")


def band_pairs(prints: DataFrame, most: int = 3, id_col: str = "doc_id", within: list[str] | None = None) -> DataFrame:
    """(a, b, distance), a < b: fingerprints that share a 16-bit band and differ in `most` bits at most.

    Equal fingerprints meet once, as one representative each; zero fingerprints (no features) pair with nothing."""
    within = within or []
    own = keep(prints.where("simhash <> 0").groupBy(*within, "simhash").agg(F.min(id_col).alias("rep")), "prints")
    near = near_prints(own, most, within, ["rep"])
    return near.select(*within, F.least("rep", "rep2").alias("a"), F.greatest("rep", "rep2").alias("b"), hamming(F.col("simhash"), F.col("simhash2")).alias("distance"))


def greedy(items: DataFrame, least: int = 150, most: int = 3, within: str = "document_id", order: str = "ord", text_col: str = "text", compatible: bool = True, md5: bool = False) -> DataFrame:
    """Verdict of each item in its order (kept, short, exact or near), with its content_hash and simhash.

    Only kept items are compared with, so an item near a dropped one alone stays.  In each round the items that no open
    pair has as its later one are kept, their partners go, and with these go their pairs; what is left without a pair is
    kept.  Null texts are empty."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    text = normal_nfkc(text) if compatible else normal(text)
    base = items.select(within, order, text.alias("norm"))
    base = keep(base.select(within, order, F.length("norm").alias("n"), F.sha2("norm", 256).alias("content_hash"), simhash_of("norm", md5).alias("simhash")), "greedy")
    long = base.where(F.col("n") >= least)
    first = long.groupBy(within, "content_hash").agg(F.min(order).alias("rep"), F.first("simhash").alias("simhash"))
    near = _near_items(first.where("simhash <> 0"), most, within) if most > 0 else None
    decided = long.join(first.drop("simhash"), [within, "content_hash"])
    decided = decided.join(near, [within, "rep"], "left") if near is not None else decided.withColumn("near", F.lit(None).cast("boolean"))
    verdict = F.when(F.col("near"), "near").when(F.col(order) == F.col("rep"), "kept").otherwise("exact")
    out = decided.select(within, order, verdict.alias("verdict"), "content_hash", "simhash")
    return out.unionByName(base.where(F.col("n") < least).select(within, order, F.lit("short").alias("verdict"), "content_hash", "simhash"))


def _near_items(reps: DataFrame, most: int, within: str) -> DataFrame:
    """(within, rep, near = true) of the items that go because of a kept earlier one."""
    reps = keep(reps, "reps")  # it is read for each count of keys
    same = reps.groupBy(within, "simhash").agg(F.min("rep").alias("rep"))  # later ones of a fingerprint go as that of the first is near itself
    twins = reps.join(same.withColumnRenamed("rep", "early"), [within, "simhash"]).where(F.col("early") < F.col("rep")).select(within, "early", F.col("rep").alias("late"))
    pairs = near_prints(reps, most, [within], ["rep"]).select(within, F.least("rep", "rep2").alias("early"), F.greatest("rep", "rep2").alias("late"))
    pairs = keep(twins.unionByName(pairs), "pairs")
    gone: DataFrame | None = None
    while not pairs.isEmpty():
        late = pairs.select(within, F.col("late").alias("early")).distinct()
        now = pairs.join(late, [within, "early"], "left_anti").select(within, "late").distinct()
        now = keep(now, "near")
        left = pairs.join(now, [within, "late"], "left_anti").join(now.withColumnRenamed("late", "early"), [within, "early"], "left_anti")
        last, pairs = pairs, keep(left, "pairs")
        discard(last)
        gone = now if gone is None else gone.unionByName(now)
    discard(pairs)
    if gone is None:
        gone = reps.limit(0).select(within, F.col("rep").alias("late"))
    else:
        discard(reps)
    return gone.select(within, F.col("late").alias("rep"), F.lit(True).alias("near"))


def stats(verdicts: DataFrame, within: str = "document_id") -> DataFrame:
    """Counts by verdict and the share dropped, four places."""
    counts = [F.count_if(F.col("verdict") == v).alias(v) for v in ("kept", "exact", "near", "short")]
    out = verdicts.groupBy(within).agg(F.count("*").alias("total"), *counts)
    return out.withColumn("dedup_rate", F.round(F.try_divide(F.col("total") - F.col("kept"), F.col("total")), 4))
