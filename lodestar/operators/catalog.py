"""Catalogue queries: facets, keyword search, sorting and paging, labels, dictionaries, validation, merging rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions.text import clean_list, keyword, strip, title_key_of


def like_any(columns: list[str], word: str, exact_in: str | None = None) -> Column:
    """Any column holds the keyword (case aside; % and _ are wildcards), or the array holds it exactly."""
    word = keyword(word)
    if not word:
        return F.lit(True)
    found = reduce(lambda a, b: a | b, (F.coalesce(F.col(c).ilike(f"%{word}%"), F.lit(False)) for c in columns))
    return found | F.coalesce(F.array_contains(exact_in, word), F.lit(False)) if exact_in else found


def overlaps(column: str, wanted: list[str]) -> Column:
    own = [w for w in ("".join(c for c in x if c not in ",{}").strip() for x in wanted) if w]
    return F.arrays_overlap(F.col(column), F.array(*map(F.lit, own))) if own else F.lit(True)


def within(low: str, high: str, x: int) -> Column:
    return (F.col(low) <= x) & (F.col(high) >= x)


def facets(
    rows: DataFrame, *, status: str | None = "published", created_by: str | None = None, any_of: dict[str, list[str]] | None = None, one_of: dict[str, list] | None = None,
    inside: dict[tuple[str, str], int] | None = None, at_least: dict[str, float] | None = None, recommended: bool = False, guide: bool | None = None, word: str | None = None,
    word_columns: tuple[str, ...] = ("title", "summary", "author", "publisher"), alias_column: str | None = "aliases",
) -> DataFrame:
    """Rows that meet every facet given; one filter, so all of it that can be reaches the scan."""
    from lodestar.functions.formats import has_guide

    out = F.lit(True)
    if "deleted_at" in rows.columns:
        out &= F.col("deleted_at").isNull()
    if status is not None:
        out &= F.col("status") == status
    if created_by is not None:
        out &= F.col("created_by") == created_by
    for c, values in (any_of or {}).items():
        out &= overlaps(c, values)
    for c, values in (one_of or {}).items():
        out &= F.col(c).isin(values)
    for (low, high), x in (inside or {}).items():
        out &= within(low, high, x)
    for c, x in (at_least or {}).items():
        out &= F.col(c) >= x
    if recommended:
        out &= F.col("is_recommended")
    if guide is not None:
        out &= has_guide(F.col("extra")) if guide else ~has_guide(F.col("extra"))
    if word:
        out &= like_any(list(word_columns), word, alias_column)
    return rows.where(out)


def sorts(play: str = "play_count", rating: str = "rating", created: str = "created_at", year: str = "published_year", title: str = "title", ident: str = "id") -> dict[str, list[Column]]:
    """The five orders; each ends with the id, so pages don't shift."""
    return {
        "hot": [F.desc_nulls_last(play), F.desc_nulls_last(rating), F.asc(ident)],
        "rating": [F.desc_nulls_last(rating), F.desc_nulls_last(play), F.asc(ident)],
        "newest": [F.desc_nulls_last(created), F.asc(ident)],
        "year": [F.desc_nulls_last(year), F.desc_nulls_last(play), F.asc(ident)],
        "title": [F.asc_nulls_last(title), F.asc(ident)],
    }


def page(rows: DataFrame, order: list[Column], limit: int = 20, offset: int = 0) -> DataFrame:
    """A page: limit from 1 to 100, offset 0 or more."""
    return rows.orderBy(*order).offset(max(0, offset)).limit(min(100, max(1, limit)))


def page_with_total(rows: DataFrame, order: list[Column], limit: int = 20, offset: int = 0) -> DataFrame:
    """A page whose rows also carry the number of all rows and whether more follow.

    The count is an aggregate of its own over the filtered rows; the page sorts no more than offset + limit rows a task."""
    limit, offset = min(100, max(1, limit)), max(0, offset)
    total = rows.agg(F.count("*").alias("total"))
    out = page(rows, order, limit, offset).crossJoin(F.broadcast(total))  # one row
    return out.withColumn("has_more", F.col("total") > offset + limit)


def name_rank(title: str, aliases: str, word: str) -> Column:
    """0: the title itself, 1: an alias, 2: the title begins with it, 3: elsewhere (case aside)."""
    low = word.strip().lower()
    alias = F.exists(F.coalesce(F.col(aliases), F.array().cast("array<string>")), lambda a: F.lower(F.trim(a)) == low)
    name = F.lower(F.trim(title))
    return F.when(name == low, 0).when(alias, 1).when(F.startswith(name, F.lit(low)), 2).otherwise(3)


def search_names(rows: DataFrame, word: str, limit: int = 20) -> DataFrame:
    """Rows whose title holds a name or that have it as an alias: best match first, then the hot order."""
    found = rows.where(like_any(["title"], word, "aliases"))
    return found.orderBy(name_rank("title", "aliases", word), *sorts()["hot"]).limit(min(50, max(1, limit)))


def find_existing(rows: DataFrame, title: str) -> DataFrame:
    """The row that a new title most likely repeats: a stored title that equals it or its key (case aside; % and _ stay
    wildcards), or an alias that equals the key.  Of several the most played one."""
    raw = keyword(title)
    key = F.lit(title_key_of(title))
    same = F.col("title").ilike(raw) | F.col("title").ilike(keyword(title_key_of(title))) | F.exists("aliases", lambda a: a == key)
    found = rows.where(F.coalesce(same, F.lit(False)) & F.col("deleted_at").isNull() & F.lit(bool(raw)))
    return found.orderBy(F.desc("play_count"), F.desc_nulls_last("rating"), "id").limit(1)


def by_ids(rows: DataFrame, ids: list[str] | DataFrame, ident: str = "id") -> DataFrame:
    """Rows of the ids given (a list, or a table with that column); repeats, blanks and deleted rows don't count."""
    if "deleted_at" in rows.columns:
        rows = rows.where(F.col("deleted_at").isNull())
    if isinstance(ids, DataFrame):
        own = ids.select(strip(F.col(ident).cast("string")).alias("__id")).where("__id <> ''").distinct()
        return rows.join(own, F.col(ident).cast("string") == F.col("__id"), "left_semi")
    own = list(dict.fromkeys(i.strip() for i in ids if i and i.strip()))
    return rows.where(F.col(ident).isin(own)) if own else rows.limit(0)


# dictionaries


def option_rows(tree: dict[str, list[dict]]) -> list[dict]:
    """Flatten {category: [option]} into rows; the order in the list gives sort_order in tens."""
    return [{"category_code": c, "sort_order": (k + 1) * 10} | o for c, options in tree.items() for k, o in enumerate(options)]


def with_defaults(rows: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """Columns that are missing or null take their default."""
    return rows.withColumns({c: F.coalesce(F.col(c), F.lit(v)) if c in rows.columns else F.lit(v) for c, v in defaults.items()})


def or_seed(rows: DataFrame, seed: DataFrame) -> DataFrame:
    """Rows, or the seed where there are none."""
    return seed if rows.isEmpty() else rows


def option_tree(categories: DataFrame, options: DataFrame) -> DataFrame:
    """Each active category with its active options in order as an array (empty where it has none)."""
    live = options.where("is_active").groupBy("category_code").agg(F.array_sort(F.collect_list(F.struct("sort_order", "code", "label"))).alias("options"), F.count("*").alias("n_options"))
    out = categories.where("is_active").join(live, categories["code"] == live["category_code"], "left")
    empty = F.array().cast("array<struct<sort_order:int,code:string,label:string>>")
    return out.select("code", "name", F.coalesce("options", empty).alias("options"), F.coalesce("n_options", F.lit(0)).alias("n_options"))


def search_options(options: DataFrame, word: str, hot: bool = False) -> DataFrame:
    """Options whose label, description or an alias holds a word, as one text."""
    text = F.lower(F.concat_ws(" ", "label", F.coalesce("description", F.lit("")), F.array_join("aliases", " ")))
    found = options.where(F.contains(text, F.lit(word.strip().lower())))
    return (found.where("is_hot") if hot else found).orderBy("category_code", "sort_order", "code")


def find_options(options: DataFrame, word: str = "", category: str | None = None, hot: bool = False, inactive: bool = False) -> DataFrame:
    """Options whose label or description holds a word, or that have it as an alias; in dictionary order."""
    found = options if inactive else options.where("is_active")
    found = found.where(F.col("category_code") == category) if category else found
    found = found.where("is_hot") if hot else found
    return found.where(like_any(["label", "description"], word, "aliases")).orderBy("category_code", "sort_order", "code")


def label_of(rows: DataFrame, options: DataFrame, column: str, category: str, out: str) -> DataFrame:
    """The label of a code; null for an unknown one."""
    own = options.where(F.col("category_code") == category).select(F.col("code").alias(column), F.col("label").alias(out))
    return rows.join(own, column, "left")


def labels_of(rows: DataFrame, options: DataFrame, column: str, category: str, out: str, ident: str = "id", echo: bool = False) -> DataFrame:
    """Labels of an array of codes: in dictionary order without unknown codes, or (echo) in their own order with
    unknown codes as they are."""
    own = options.where(F.col("category_code") == category).select(F.col("code").alias("__code"), "label", "sort_order")
    flat = rows.select(ident, F.posexplode(column).alias("__pos", "__code")).join(own, "__code", "left")
    if echo:
        item = F.struct(F.col("__pos").alias("k"), F.coalesce("label", "__code").alias("label"))
    else:
        flat = flat.where("label is not null")
        item = F.struct(F.col("sort_order").alias("k"), F.col("label"))
    named = flat.groupBy(ident).agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["label"]).alias(out))
    return rows.join(named, ident, "left").withColumn(out, F.coalesce(out, F.array().cast("array<string>")))


def unknown_codes(rows: DataFrame, options: DataFrame, columns: dict[str, str], ident: str = "id") -> DataFrame:
    """Violations: (id, column, codes) for codes that a category doesn't have; arrays and single codes alike."""
    out = None
    for column, category in columns.items():
        many = dict(rows.dtypes)[column].startswith("array")
        flat = rows.select(ident, F.explode(column).alias("__code") if many else F.col(column).alias("__code")).where("__code is not null")
        known = options.where(F.col("category_code") == category).select(F.col("code").alias("__code"))
        bad = flat.join(known, "__code", "left_anti").groupBy(ident).agg(F.array_join(F.array_sort(F.collect_set("__code")), ", ").alias("codes")).withColumn("column", F.lit(column))
        out = bad if out is None else out.unionByName(bad)
    return out.select(ident, "column", "codes")


def range_violations(rows: DataFrame, pairs: list[tuple[str, str, int]], ident: str = "id") -> DataFrame:
    """Rows with half a range, one in the wrong order, or one beyond its most."""

    def bad(low: str, high: str, most: int) -> Column:
        a, b = F.col(low), F.col(high)
        return (a.isNull() != b.isNull()) | F.coalesce((a > b) | (a < 0) | (b > most), F.lit(False))

    wrong = F.array_compact(F.array(*(F.when(bad(*p), F.lit(p[0])) for p in pairs)))
    return rows.select(ident, wrong.alias("wrong")).where(F.size("wrong") > 0)


def gender_violations(rows: DataFrame, ident: str = "id") -> DataFrame:
    """Rows whose roles add up to more than the most players; rows without male and female counts, or without a most, are right."""
    total = sum((F.coalesce(F.col(c), F.lit(0)) for c in ("male_count", "female_count", "flexible_count")), F.lit(0))
    told = F.col("male_count").isNotNull() | F.col("female_count").isNotNull()
    return rows.select(ident, total.alias("total"), "player_max", told.alias("told")).where("told and total > player_max").drop("told")


def unknown_columns(rows: DataFrame, known: list[str], ident: str = "id") -> DataFrame:
    """(id, problem) of rows with a value in a column that isn't known."""
    extra = sorted(set(rows.columns) - set(known))
    if not extra:
        return rows.select(ident, F.lit("").alias("problem")).limit(0)
    names = F.array_compact(F.array(*(F.when(F.col(c).isNotNull(), c) for c in extra)))
    return rows.select(ident, F.concat(F.lit("unknown fields: "), F.array_join(names, ", ")).alias("problem"), F.size(names).alias("n")).where("n > 0").drop("n")


def merge_rows(old: DataFrame, new: DataFrame, ident: str, scalars: list[str], arrays: list[str], fill_only: bool = False) -> DataFrame:
    """New values merged into old rows: fill_only keeps what is there, else new scalars win; arrays are united in order."""
    o, n = old.alias("o"), new.alias("n")
    joined = o.join(n, ident, "left")

    def scalar(c: str) -> Column:
        a, b = F.col(f"o.{c}"), F.col(f"n.{c}")
        if dict(old.dtypes)[c] == "string":
            a, b = F.nullif(strip(a), F.lit("")), F.nullif(strip(b), F.lit(""))
        return (F.coalesce(a, b) if fill_only else F.coalesce(b, a)).alias(c)

    def array(c: str) -> Column:
        empty = F.array().cast(dict(old.dtypes)[c])
        return F.array_union(F.coalesce(F.col(f"o.{c}"), empty), F.coalesce(clean_list(F.col(f"n.{c}")), empty)).alias(c)

    return joined.select(ident, *map(scalar, scalars), *map(array, arrays))


def link_rows(old: DataFrame, new: DataFrame, ident: str, scalars: list[str], aliases: str = "aliases", title: str = "title") -> DataFrame:
    """Old rows that a new import is linked to: empty fields are filled, nothing is overwritten, and the title key under
    which it came becomes an alias unless it is the title's own."""
    from lodestar.functions.text import title_key

    filled = merge_rows(old, new, ident, scalars, [], fill_only=True)
    keys = new.select(ident, title_key(F.col(title)).alias("__key"))
    told = old.select(ident, F.coalesce(aliases, F.array().cast("array<string>")).alias("__was"), title_key(F.col(title)).alias("__own"))
    both = filled.join(told, ident).join(keys, ident, "left")
    more = F.coalesce((F.col("__key") != "") & (F.col("__key") != F.col("__own")), F.lit(False))
    return both.withColumn(aliases, F.when(more, F.array_union("__was", F.array("__key"))).otherwise(F.col("__was"))).drop("__was", "__own", "__key")


def patch_rows(old: DataFrame, changes: DataFrame, ident: str, fields: list[str], fixed: tuple[str, ...] = ("id", "code")) -> tuple[DataFrame, DataFrame]:
    """Rows after changes that say in `told` (array of names) which of their fields are set: a field that isn't told
    stays, one that is told as null becomes null.  Second, (id, problem) of changes to fixed or unknown fields, to rows
    that aren't there, and changes that tell nothing; such a change is left out as a whole."""
    told = F.array_distinct(F.coalesce("told", F.array().cast("array<string>")))
    own = changes.withColumn("told", told).join(old.select(ident, F.lit(True).alias("__known")), ident, "left")
    wrong = F.array_sort(F.array_except("told", F.array(*map(F.lit, fields))))
    barred = F.array_intersect("told", F.array(*map(F.lit, fixed)))
    problem = (
        F.when(F.col("__known").isNull(), "not found").when(F.size("told") == 0, "nothing to change").when(F.size(barred) > 0, F.concat(F.lit("fixed: "), F.array_join(F.array_sort(barred), ", ")))
        .when(F.size(wrong) > 0, F.concat(F.lit("unknown: "), F.array_join(wrong, ", ")))
    )
    own = own.withColumn("problem", problem)
    good = own.where("problem is null").select(ident, F.col("told").alias("__told"), *(F.col(c).alias(f"__{c}") for c in fields))
    joined = old.join(good, ident, "left")
    out = joined.select(*(F.when(F.array_contains("__told", c), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if c in fields else F.col(c) for c in old.columns))
    return out, own.where("problem is not null").select(ident, "problem")


def null_gaps(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(name, total, missing) of each column, in one pass."""
    out = rows.agg(F.count("*").alias("total"), *(F.count_if(F.col(c).isNull()).alias(f"m{i}") for i, c in enumerate(columns)))
    return out.select("total", F.inline(F.array(*(F.struct(F.lit(c).alias("name"), F.col(f"m{i}").alias("missing")) for i, c in enumerate(columns))))).select("name", "total", "missing")


def length_profile(rows: DataFrame, within: str, length: str, short: int = 150) -> DataFrame:
    """Of each group: n, the elements at half and at nine tenths of the sorted lengths, and the whole percent of short ones.

    Lengths are counted first, so the window runs over different lengths, not over rows."""
    counts = rows.groupBy(within, F.col(length).cast("long").alias("v")).agg(F.count("*").alias("c"))
    w = Window.partitionBy(within).orderBy("v")
    placed = counts.withColumn("to", F.sum("c").over(w)).withColumn("n", F.sum("c").over(Window.partitionBy(within)))
    at = [F.min(F.when(F.col("to") > F.floor(F.col("n") * q), F.col("v"))) for q in (0.5, 0.9)]
    share = F.sum(F.when(F.col("v") < short, F.col("c")).otherwise(0)) * 100 / F.first("n")
    return placed.groupBy(within).agg(F.first("n").alias("n"), at[0].alias("p50"), at[1].alias("p90"), F.floor(share).alias("short_percent"))


def merge_json(old: Column, new: Column) -> Column:
    """One level of two JSON objects, the new one's keys winning; values keep their JSON text."""
    kind = "map<string,variant>"
    a, b = (F.from_json(F.coalesce(c, F.lit("{}")), kind) for c in (old, new))
    kept = F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k))
    return F.to_json(F.map_concat(kept, b))


def leaderboard(requests: DataFrame) -> DataFrame:
    """Pending requests by (match_key, title, code, id), most first, then by lower title."""
    out = requests.where(F.col("status") == "pending").groupBy("match_key", "script_title", "script_code", "script_id").agg(F.count("*").alias("n"))
    return out.orderBy(F.desc("n"), F.lower("script_title"), "match_key")


def visible(rows: DataFrame, user: str | None, owner: str = "user_id", public: str | None = "is_public") -> DataFrame:
    """Row-level security: one's own rows, and public ones."""
    own = F.lit(False) if user is None else F.col(owner) == user
    return rows.where(own | F.col(public) if public else own)


def visible_through(rows: DataFrame, parents: DataFrame, key: str, user: str | None, ident: str = "id", owner: str = "user_id", public: str | None = None) -> DataFrame:
    """Rows whose parent the user may see, as the parts of an upload: an EXISTS over the parents."""
    seen = visible(parents, user, owner, public).select(F.col(ident).alias(key))
    return rows.join(seen, key, "left_semi")


def attach(old: DataFrame, new: DataFrame, ident: str, extra: str = "extra", status: str = "status") -> DataFrame:
    """Old rows that an import is linked to: its guide (dmGuide or dm_guide in `extra`) is attached, whatever was there,
    the other keys of `extra` stay, and drafts and rows that were offline or without a status are published.

    Rows without an import stay as they are."""
    told = F.coalesce(F.get_json_object("__extra", "$.dmGuide"), F.get_json_object("__extra", "$.dm_guide"))
    kind = "map<string,variant>"
    own = F.from_json("__extra", kind)
    guide = F.coalesce(F.try_element_at(own, F.lit("dmGuide")), F.try_element_at(own, F.lit("dm_guide")))
    joined = old.join(new.select(ident, F.col(extra).alias("__extra"), F.lit(True).alias("__linked")), ident, "left")
    merged = F.when(told.isNotNull(), merge_json(F.col(extra), F.to_json(F.create_map(F.lit("dmGuide"), guide)))).otherwise(F.col(extra))
    hidden = F.coalesce(F.col(status).isin("draft", "offline"), F.lit(True))
    shown = F.when(F.col("__linked") & hidden, F.lit("published")).otherwise(F.col(status))
    return joined.withColumns({extra: merged, status: shown}).select(*old.columns)


def distinct_rank(order: list[Column], *partition: str) -> Column:
    return F.dense_rank().over(Window.partitionBy(*partition).orderBy(*order))


def autocomplete(rows: DataFrame, word: str, limit: int = 10) -> DataFrame:
    """Few columns of the rows that a name finds, with whether each has a guide."""
    from lodestar.functions.formats import guide_key

    found = rows.where(like_any(["title"], word, "aliases")).orderBy(*sorts()["hot"]).limit(min(20, max(1, limit)))
    return found.select("id", "code", "title", "author", "cover_url", guide_key(F.col("extra")).isNotNull().alias("has_guide"))


def items(rows: DataFrame, options: DataFrame, labels: dict[str, str], arrays: dict[str, str]) -> DataFrame:
    """Catalogue rows as they are shown: labels of codes (an unknown code of an array stands for itself, a single one
    gives null), texts of players and duration, and defaults for what is missing."""
    from lodestar.functions.formats import duration_text, guide_key, players_text

    for column, category in labels.items():
        rows = label_of(rows, options, column, category, f"{column}_label")
    for column, category in arrays.items():
        rows = labels_of(rows, options, column, category, f"{column}_labels", echo=True)
    return rows.select(
        "*", players_text(*(F.col(c) for c in ("player_min", "player_max", "male_count", "female_count", "flexible_count"))).alias("players_text"),
        duration_text(F.col("duration_min"), F.col("duration_max")).alias("duration_text"), guide_key(F.col("extra")).isNotNull().alias("has_guide"),
    ).fillna({"play_count": 0, "rating_count": 0})


def seed_violations(rows: DataFrame, options: DataFrame, columns: dict[str, str], pairs: list[tuple[str, str, int]], known: list[str] | None = None) -> DataFrame:
    """(id, problem) of rows to be loaded: fields that aren't known, codes used twice, unknown dictionary codes, ranges,
    ratings beyond 0 to 10."""
    twice = rows.groupBy("code").agg(F.count("*").alias("n")).where("n > 1").select("code")
    out = rows.join(twice, "code", "left_semi").select("id", F.lit("code used twice").alias("problem"))
    if known is not None:
        out = out.unionByName(unknown_columns(rows, known))
    out = out.unionByName(unknown_codes(rows, options, columns).select("id", F.concat(F.lit("unknown "), "column", F.lit(": "), "codes").alias("problem")))
    out = out.unionByName(range_violations(rows, pairs).select("id", F.concat(F.lit("range: "), F.array_join("wrong", ", ")).alias("problem")))
    return out.unionByName(rows.where("rating < 0 or rating > 10").select("id", F.lit("rating").alias("problem")))
