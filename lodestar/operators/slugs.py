"""Titles in other scripts as syllables, by a dictionary that is given as a table.

All substrings of a title up to the dictionary's longest term are joined to it, the longest term at each place stays,
and a fold from left to right takes the terms that don't overlap one taken before.  Titles are short; the dictionary may
be of any size, as Spark chooses how to join it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.functions.text import slug


def transliterate(rows: DataFrame, dictionary: DataFrame, column: str, out: str) -> DataFrame:
    """rows with `out`: the column with the dictionary's terms (term, syllables: array) replaced, the longest from the left
    first, and hyphens around each syllable.  Characters without a term stay; a null stays null; blank terms are ignored,
    and of several entries for one term the least counts."""
    terms = dictionary.where("term <> ''").groupBy("term").agg(F.min("syllables").alias("syllables"))
    longest = terms.agg(F.max(F.length("term"))).first()[0] or 0
    titles = rows.select(F.col(column).alias("__title")).where("__title is not null").distinct()
    at = titles.select("__title", F.explode(F.sequence(F.lit(1), F.length("__title"))).alias("at")).where("__title <> ''")
    some = at.select("__title", "at", F.explode(F.sequence(F.lit(1), F.least(F.lit(max(longest, 1)), F.length("__title") - F.col("at") + 1))).alias("n"))
    some = some.withColumn("term", F.substring(F.col("__title"), F.col("at"), F.col("n")))
    best = some.join(terms, "term").groupBy("__title", "at").agg(F.max(F.struct("n", "syllables")).alias("t"))
    found = best.groupBy("__title").agg(F.map_from_entries(F.collect_list(F.struct("at", "t"))).alias("found"))
    start = F.struct(F.lit("").alias("text"), F.lit(1).alias("next"))

    def step(s, i):
        t = F.try_element_at("found", i)
        taken = F.struct(F.concat(s["text"], F.lit("-"), F.array_join(t["syllables"], "-"), F.lit("-")).alias("text"), (i + t["n"]).alias("next"))
        plain = F.struct(F.concat(s["text"], F.substring(F.col("__title"), i, F.lit(1))).alias("text"), (i + 1).alias("next"))
        return F.when(i < s["next"], s).when(t.isNotNull(), taken).otherwise(plain)

    read = F.aggregate(F.sequence(F.lit(1), F.length("__title")), start, step, lambda s: s["text"])
    found = found.select("__title", read.alias(out))
    return rows.join(found, rows[column] == found["__title"], "left").withColumn(out, F.coalesce(F.col(out), F.col(column))).drop("__title")


def slugs(rows: DataFrame, dictionary: DataFrame, column: str = "title", out: str = "slug") -> DataFrame:
    """rows with the slug of a title, transliterated first."""
    return transliterate(rows, dictionary, column, out).withColumn(out, slug(F.col(out)))
