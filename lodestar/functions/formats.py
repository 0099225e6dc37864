"""Display texts and small status expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Display words and category names.
CATEGORIES = {"rule": "规则", "plot": "剧情", "role": "角色", "character": "人物", "clue": "线索", "flow": "流程", "timeline": "时间线", "other": "其他"}
PEOPLE, MALE, FEMALE, ANY, MINUTES, HOURS = "人", "男", "女", "任意", "分钟", "小时"


def players_text(low: Column, high: Column, male: Column, female: Column, flexible: Column) -> Column:
    """A head count with its make-up; null where a bound is null, zero and null parts left out."""
    head = F.when(low == high, F.concat(low.cast("string"), F.lit(PEOPLE))).otherwise(F.concat(low.cast("string"), F.lit("-"), high.cast("string"), F.lit(PEOPLE)))

    def part(n: Column, word: str) -> Column:
        return F.when(F.coalesce(n, F.lit(0)) != 0, F.concat(n.cast("string"), F.lit(word))).otherwise(F.lit(""))

    rest = F.concat(part(male, MALE), part(female, FEMALE), part(flexible, ANY))
    return F.when(low.isNotNull() & high.isNotNull(), F.when(rest == "", head).otherwise(F.concat(head, F.lit("（"), rest, F.lit("）"))))


def _hours(m: Column) -> Column:
    whole = (m / 60).cast("int")
    return F.when(m % 60 == 0, whole.cast("string")).otherwise(F.format_string("%.1f", m / F.lit(60.0)))


def _one(m: Column) -> Column:
    return F.when(m < 60, F.concat(m.cast("string"), F.lit(MINUTES))).otherwise(F.concat(_hours(m), F.lit(HOURS)))


def duration_text(low: Column, high: Column) -> Column:
    """Minutes below an hour, else hours with one decimal where they aren't whole."""
    both = F.when((low >= 60) & (high >= 60), F.concat(_hours(low), F.lit("-"), _hours(high), F.lit(HOURS))).otherwise(F.concat(_one(low), F.lit("-"), _one(high)))
    return F.when(low.isNotNull() & high.isNotNull(), F.when(low == high, _one(low)).otherwise(both))


def category_text(c: Column) -> Column:
    out = F.when(F.lit(False), F.lit(""))
    for code, name in CATEGORIES.items():
        out = out.when(c == code, F.lit(name))
    return out.otherwise(c)


def page_range(a: Column, b: Column) -> Column:
    """a-b; null where either is null."""
    return F.concat(a.cast("string"), F.lit("-"), b.cast("string"))


def breadcrumb(path: Column, text: Column) -> Column:
    """The text to embed: its section path in brackets on a line of its own, if it has one."""
    return F.when(F.size(path) > 0, F.concat(F.lit("【"), F.array_join(path, " > "), F.lit("】\n"), text)).otherwise(text)


def coarse_progress(*pairs: tuple[Column, Column]) -> Column:
    """Percent of the first pair (done, total) whose total is positive, one decimal, at most 100; else 0."""
    out = F.when(F.lit(False), F.lit(0.0))
    for done, total in pairs:
        out = out.when(total > 0, F.least(F.lit(100.0), F.round(F.try_divide(done * F.lit(100.0), total), 1)))
    return out.otherwise(F.lit(0.0))


def import_status(has_guide: Column, indexed: Column, job: Column, embedded: Column, chunks: Column, upload: Column | None = None) -> Column:
    """The overall state of an import; rules in order, the first that holds counts."""
    upload = F.lit(None).cast("string") if upload is None else upload
    done = job.isin("completed", "skipped") | (~job.isin("failed", "cancelled") & (chunks > 0) & (embedded >= chunks))
    parse = (
        F.when(job.isNull(), F.when(has_guide & indexed, F.lit("done")).otherwise(F.lit("pending")))
        .when(done, F.lit("done"))
        .when(job.isin("failed", "cancelled"), job)
        .otherwise(F.lit("active"))
    )
    return (
        F.when(upload == "uploading", F.lit("uploading"))
        .when(upload == "failed", F.lit("failed"))
        .when(~has_guide, F.lit("no_guide"))
        .when(parse == "active", F.lit("parsing"))
        .when(parse == "failed", F.lit("failed"))
        .when(parse == "cancelled", F.lit("pending"))
        .when(parse == "done", F.when(indexed, F.lit("ready")).otherwise(F.lit("parsed")))
        .when(indexed, F.lit("ready"))
        .otherwise(F.lit("pending"))
    )


def has_guide(extra: Column) -> Column:
    """Whether a JSON object has the guide key at all; JSON null counts as there."""
    return F.expr("false") if extra is None else F.try_variant_get(F.try_parse_json(extra), "$.dmGuide", "variant").isNotNull()


def guide_key(extra: Column) -> Column:
    """The guide's object key in any of its three shapes; null where blank or of a wrong type."""
    v = F.try_parse_json(extra)
    found = None
    for name in ("dmGuide", "dm_guide"):
        text = F.when(F.schema_of_variant(F.try_variant_get(v, f"$.{name}", "variant")) == "STRING", F.try_variant_get(v, f"$.{name}", "string"))
        inner = F.coalesce(F.try_variant_get(v, f"$.{name}.objectKey", "string"), text)
        key = F.nullif(F.trim(inner), F.lit(""))
        found = key if found is None else F.coalesce(found, key)
    return found
