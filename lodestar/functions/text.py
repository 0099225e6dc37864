"""Text expressions: normal forms, keys, sentence splitting, heading and noise patterns.

All are Column expressions; `*_nfkc` variants need Python (no built-in NFKC) and are named so that neither stands in
for the other silently.
"""

from __future__ import annotations

import mimetypes
import re
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Character classes and patterns that results depend on (Java and RE2 syntax, white space spelt out).
SPACE = r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
#: The characters of SPACE.
BLANKS = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
DECORATION = r"[…·•▪◦●○■□◆▲★☆※\x{3000}\-—–_=~`|]+"
SENTENCE_MARKS = "。！？!?；;…\n"
TAIL_MARKS = "。！？!?；;\n"
#: Every character that DECORATION or SPACE matches, for a single pass of translate().
DROPPED = "…·•▪◦●○■□◆▲★☆※-—–_=~`|" + BLANKS
SENTENCE_END = r"[。！？!?；;”\"）)\]】]$"
HEADINGS = (
    r"^第[一二三四五六七八九十百零〇0-9]+[章节回幕part部分篇]",
    r"^[一二三四五六七八九十]+[、.．]",
    r"^[0-9]+(\.[0-9]+){0,3}([、.．]|" + SPACE + ")",
    r"^[（(][一二三四五六七八九十0-9]+[)）]",
    r"^(?i:chapter|part|section|act)" + SPACE + r"+(?i:[0-9IVXLC]+)",
)
PAGE_NUMBER = f"^([-—–]{SPACE}*)?(第{SPACE}*)?[0-9]{{1,4}}({SPACE}*(页|/{SPACE}*[0-9]{{1,4}}))?{SPACE}*([-—–])?$"
TWO_SIGNS = r"[\p{L}\p{N}][^\p{L}\p{N}]*[\p{L}\p{N}]"
LIST_ITEM = r"^([•·▪◦●○■□◆▲★*✓]|[-–—]" + SPACE + r"|[0-9]+[.)、]" + SPACE + r"|[a-zA-Z][.)]" + SPACE + ")"
TITLE_EXTENSION = r"(?i)\.(pdf|docx?|txt|epub|pptx?|md|rtf)$"
TITLE_NUMBER = r"[（(] *[0-9]+ *[）)] *$"
TITLE_COPY = r"(?i) *(副本|copy)$"
KEYWORD_DROPPED = r'[*,()"\\]'


def strip(c: Column) -> Column:
    """Without white space at either end, Unicode white space included."""
    return F.trim(c, F.lit(BLANKS))


def normal(c: Column) -> Column:
    """Without decoration and white space, lower case; no NFKC."""
    return F.lower(F.translate(c, DROPPED, ""))


@F.pandas_udf(StringType())
def nfkc(s: pd.Series) -> pd.Series:
    """NFKC of each text, in Arrow batches."""
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def normal_nfkc(c: Column) -> Column:
    return normal(nfkc(c))


def content_hash(c: Column, compatible: bool = True) -> Column:
    """SHA-256 of the normal form; compatible: of the NFKC form."""
    return F.sha2(normal_nfkc(c) if compatible else normal(c), 256)


def question_hash(c: Column) -> Column:
    """SHA-256 of the trimmed question as it is written."""
    return F.sha2(strip(c), 256)


def compare_key(c: Column) -> Column:
    """For repeated page lines: no white space, runs of digits as #, lower case."""
    return F.lower(F.regexp_replace(F.regexp_replace(c, f"{SPACE}+", ""), "[0-9]+", "#"))


def title_key(c: Column) -> Column:
    """What titles of one work have in common: no extension, copy mark or copy number; sequel numbers stay."""
    key = F.regexp_replace(F.lower(strip(c)), TITLE_EXTENSION, "")
    for _ in range(3):
        key = strip(F.regexp_replace(F.regexp_replace(key, TITLE_NUMBER, ""), TITLE_COPY, ""))
    return F.coalesce(key, F.lit(""))


def title_key_of(title: str) -> str:
    """title_key of one title, for plans that are built around it."""
    blank = "".join(c for c in DROPPED if not c.isprintable() or c.isspace())
    key = re.sub(TITLE_EXTENSION.removeprefix("(?i)"), "", (title or "").strip(blank).lower(), flags=re.IGNORECASE)
    for _ in range(3):
        key = re.sub(TITLE_NUMBER, "", key)
        key = re.sub(TITLE_COPY.removeprefix("(?i)"), "", key, flags=re.IGNORECASE).strip(blank)
    return key


def keyword(text: str) -> str:
    """A search keyword without list and quote signs; % and _ stay wildcards."""
    return "".join(c for c in text if c not in '*,()"\\').strip()


@F.pandas_udf(StringType())
def plain_ascii(s: pd.Series) -> pd.Series:
    """NFKD of each text without what isn't ASCII, so letters lose their marks; in Arrow batches."""
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKD", x).encode("ascii", "ignore").decode())


def slug(c: Column) -> Column:
    """ASCII words joined by hyphens, 48 characters at most; letters lose their marks, other letters are dropped.

    Titles in other scripts go through operators.slugs.transliterate first."""
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(plain_ascii(c)), "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, 48)


def library_code(title: Column, ident: Column) -> Column:
    """The code under which a title's parts are stored: its slug, or the id where that is empty."""
    return F.lower(F.coalesce(F.nullif(slug(title), F.lit("")), ident))


def is_heading_like(c: Column) -> Column:
    text = strip(c)
    return (F.length(text) > 0) & (F.length(text) <= 40) & text.rlike("|".join(f"(?:{p})" for p in HEADINGS))


def is_noise(c: Column) -> Column:
    """Blank, a page number, or at most one letter or digit; two of these are found near a text's begin."""
    text = strip(c)
    return (text == "") | ~text.rlike(TWO_SIGNS) | text.rlike(PAGE_NUMBER)


def ends(c: Column, pattern: str) -> Column:
    """Whether a text has `pattern`, one character and $, at its end (or before its last line break): only the last
    three characters are searched."""
    return F.substring(c, -3, 3).rlike(pattern)


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value made once; inside a fold nothing else keeps it from being made anew for each use."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def sentences(c: Column) -> Column:
    """Split after each sentence mark; trimmed, blanks dropped."""
    parts = F.transform(F.split(F.regexp_replace(c, f"([{SENTENCE_MARKS}])", "$1\x1e"), "\x1e", -1), strip)
    return F.filter(parts, lambda x: x != "")


def tail_overlap(c: Column, n: int) -> Column:
    """The last n characters, from behind the first sentence mark in them unless that is their end."""
    if n <= 0:
        return F.lit("")
    rest = f"^[^{TAIL_MARKS}]*[{TAIL_MARKS}]([\\s\\S]+)$"
    return bound(F.substring(c, -n, n), lambda tail: bound(F.regexp_extract(tail, rest, 1), lambda found: F.when(found != "", found).otherwise(tail)))


def split_path(c: Column) -> Column:
    """A path kept as one string: split at commas, trimmed, blanks dropped."""
    return F.filter(F.transform(F.split(c, ","), strip), lambda x: x != "")


def clean_list(c: Column) -> Column:
    """Trimmed, without blanks and repeats; the first place counts."""
    return F.array_distinct(F.filter(F.transform(c, strip), lambda x: x != ""))


@F.pandas_udf(StringType())
def nfc(s: pd.Series) -> pd.Series:
    """NFC of each text, in Arrow batches."""
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


def safe_filename(c: Column, most: int = 200) -> Column:
    """The last path element, unsafe signs as _, dots collapsed, cut before its extension; null where nothing is left."""
    name = F.element_at(F.split(F.regexp_replace(strip(c), r"\\", "/"), "/"), -1)
    name = F.regexp_replace(F.regexp_replace(name, r'[:*?"<>|\x00-\x1f]', "_"), r"\.{2,}", ".")
    name = F.regexp_replace(name, r"^[. ]+|[. ]+$", "")
    ext = F.regexp_extract(name, r"[^.].*?(\.[^.]*)$", 1)
    name = F.when(F.length(name) > most, F.concat(F.substring(name, F.lit(1), F.lit(most) - F.length(ext)), ext)).otherwise(name)
    return F.nullif(name, F.lit(""))


def extension(c: Column) -> Column:
    """What follows the last dot of a name, lower case; names that only begin with dots have none."""
    return F.lower(F.regexp_extract(c, r"[^.].*?\.([^.]*)$", 1))


UNTYPED = "application/octet-stream"


def content_type(name: Column, told: Column) -> Column:
    """The type as told, else that of the extension in Python's own table, whatever files of types the machine has."""
    known = F.create_map(*(F.lit(x) for ext, kind in sorted(mimetypes.MimeTypes().types_map[True].items()) for x in (ext[1:], kind)))
    own = F.nullif(F.nullif(told, F.lit("")), F.lit(UNTYPED))
    return F.coalesce(own, F.try_element_at(known, extension(name)), F.lit(UNTYPED))


def object_key(user: Column, name: Column, at: Column, unique: Column, prefix: str = "uploads") -> Column:
    """prefix/user/year/month/unique.extension"""
    ext = extension(name)
    tail = F.when(ext == "", unique).otherwise(F.concat(unique, F.lit("."), ext))
    return F.concat_ws("/", F.lit(prefix.strip("/")), user.cast("string"), F.date_format(at, "yyyy/MM"), tail)


# Fixed value: the instruction that Chinese models of this family expect before a query.
QUERY_PREFIX = "为这个句子生成表示以用于检索相关文章："


def query_text(c: Column, model: str) -> Column:
    """A query as its embedding model expects it."""
    low = model.lower()
    return F.concat(F.lit(QUERY_PREFIX), c) if "bge" in low and "zh" in low else c


def asked(c: Column, most: int = 500) -> tuple[Column, Column]:
    """What is kept of a user's question, and the hash of the whole of it."""
    return F.substring(c, 1, most), content_hash(c)
