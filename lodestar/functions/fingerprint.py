"""SimHash fingerprints, their distance, bands, and the features they are made of."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .text import normal, normal_nfkc

BITS = 64
BANDS = 4
#: Hashes whose bits are counted at once.
STEP = 100_000
_WORD = re.compile(r"[a-z0-9]+")


def features(normalised: str, size: int = 3) -> list[bytes]:
    """Of a normal form the ASCII runs of two or more, and n-grams of the rest (all of it where it is shorter)."""
    rest = _WORD.sub("", normalised)
    grams = [rest[i : i + size] for i in range(len(rest) - size + 1)] or ([rest] if rest else [])
    return [x.encode() for x in [*(w for w in _WORD.findall(normalised) if len(w) >= 2), *grams]]


def votes(hashes: list[bytes]) -> int:
    """The signed 64-bit number whose bits most of the 8-byte hashes have; none gives 0."""
    total = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), STEP):
        own = np.frombuffer(b"".join(hashes[at : at + STEP]), np.uint8).reshape(-1, 8)
        total += np.unpackbits(own, axis=1).sum(0, dtype=np.int64)
    return int(np.packbits(2 * total > len(hashes)).view(">i8")[0])


def all_votes(hashes: list[bytes], sizes: list[int]) -> list[int]:
    """`votes` of many texts at once, whose hashes follow each other, so many of each text."""
    if len(sizes) == 1:
        return [votes(hashes)]
    n = np.array(sizes)
    out, some = np.zeros(len(n), np.int64), n > 0
    if some.any():
        bits = np.unpackbits(np.frombuffer(b"".join(hashes), np.uint8).reshape(-1, 8), axis=1)
        total = np.add.reduceat(bits, (np.cumsum(n) - n)[some], axis=0, dtype=np.int64)
        out[some] = np.packbits(2 * total > n[some, None], axis=1).view(">i8")[:, 0]
    return out.tolist()


@lru_cache(1 << 16)
def _md5(feature: bytes) -> bytes:
    return hashlib.md5(feature, usedforsecurity=False).digest()[:8]


@lru_cache(1 << 16)
def _blake2b(feature: bytes) -> bytes:
    return hashlib.blake2b(feature, digest_size=8).digest()


def _prints(texts: pd.Series, digest: Callable[[bytes], bytes]) -> pd.DataFrame:
    prints, counts, hashes, sizes = [], [], [], []
    for text in texts:
        own = [digest(x) for x in features(text or "")]
        if sizes and len(hashes) + len(own) > STEP:
            prints += all_votes(hashes, sizes)
            hashes, sizes = [], []
        hashes += own
        sizes.append(len(own))
        counts.append(len(own))
    if sizes:
        prints += all_votes(hashes, sizes)
    return pd.DataFrame({"simhash": pd.Series(prints, dtype="int64"), "n_features": pd.Series(counts, dtype="int64")})


PRINT = StructType([StructField("simhash", LongType()), StructField("n_features", LongType())])


@F.pandas_udf(PRINT)
def _print_md5(texts: pd.Series) -> pd.DataFrame:
    return _prints(texts, _md5)


@F.pandas_udf(PRINT)
def _print_blake2b(texts: pd.Series) -> pd.DataFrame:
    return _prints(texts, _blake2b)


def simhash(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", compatible: bool = True, md5: bool = False) -> DataFrame:
    """(id, simhash, n_features) of normal forms: a bit is set where more features have it than not; no features give 0.

    Features are hashed by BLAKE2b or by the first half of MD5, and their bits are counted as a matrix, one document at a
    time in Arrow batches; nothing is shuffled.  compatible: of NFKC forms.  Null texts count as empty."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    text = normal_nfkc(text) if compatible else normal(text)
    own = docs.select(F.col(id_col), text.alias("__normal"))
    return own.select(F.col(id_col), (_print_md5 if md5 else _print_blake2b)("__normal").alias("p")).select(id_col, "p.simhash", "p.n_features")


def simhash_md5(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return simhash(docs, id_col, text_col, md5=True)


def simhash_of(normalised: Column | str, md5: bool = False) -> Column:
    """The fingerprint of a normal form, signed: of BLAKE2b or MD5 hashes."""
    return (_print_md5 if md5 else _print_blake2b)(normalised)["simhash"]


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def band(h: Column, i: int) -> Column:
    """The i-th 16-bit band, least significant first."""
    return F.shiftrightunsigned(h, 16 * i).bitwiseAND(65535).cast("int")


def bands(h: Column) -> Column:
    return F.array(*(F.struct(F.lit(i).alias("band"), band(h, i).alias("value")) for i in range(BANDS)))
