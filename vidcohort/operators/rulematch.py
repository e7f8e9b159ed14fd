"""Keyword rules from a table: which rules fit each text, by a filter join on leading q-grams.

A keyword is a substring of the text, not a word of it. Rules may be many thousands, so they are rows and not part of the plan:
each keyword is indexed by its first ``Q`` characters (all of it, if it is shorter). A text is read once; of its distinct
q-grams only those that lead some keyword are kept, they join the keywords, which are broadcast (no more than the rules have), and
each of the few pairs that are left is verified. The text itself is not shuffled, and is repeated only for the grams that are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Q = 3


def keywords(rules: DataFrame) -> DataFrame:
    """(ord, keyword, gram) of rules (ord, keywords: array); empty keywords fit every text and have an empty gram."""
    rows = rules.select("ord", F.explode("keywords").alias("keyword")).where("keyword is not null").distinct()
    return rows.withColumn("gram", F.left("keyword", F.lit(Q)))


def grams(text: Column, n: int) -> Column:
    """All runs of ``n`` characters, one from each place."""
    return F.regexp_extract_all(text, F.lit(rf"(?s)(?=(.{{{n}}}))"), F.lit(1))


def matches(texts: DataFrame, rules: DataFrame, key: str = "id") -> DataFrame:
    """(key, ord), a row for every rule that fits a text of ``texts`` (key, text), each once."""
    words = keywords(rules)
    led = words.agg(F.collect_set("gram").alias("g")).scalar()  # leading grams: no more than rules
    sizes = [r.n for r in words.select(F.length("gram").alias("n")).distinct().collect()]  # at most Q + 1
    text = F.coalesce("text", F.lit(""))
    own = F.flatten(F.array(F.array(F.lit("")), *[grams(text, n) for n in sorted(sizes) if n]))
    kept = texts.select(key, text.alias("text"), F.explode(F.array_intersect(own, led)).alias("gram"))
    # the rules go to the texts: dealt by gram, all texts with a common one would be in one task
    return kept.join(F.broadcast(words), "gram").where(F.contains("text", "keyword")).select(key, "ord").distinct()


def first_rule(texts: DataFrame, rules: DataFrame, key: str = "id") -> DataFrame:
    """(key, payload…): for every text the payload of the fitting rule of least ord; of the rule without keywords, if none fits.

    ``rules`` has ord, keywords and payload columns; its default has null keywords. Keys have to be unique.
    """
    payload = [c for c in rules.columns if c not in ("ord", "keywords")]
    least = matches(texts, rules.where("keywords is not null"), key).groupBy(key).agg(F.min("ord").alias("ord"))
    default = rules.where("keywords is null").agg(F.min("ord").alias("ord")).scalar()
    found = texts.select(key).join(least, key, "left").withColumn("ord", F.coalesce("ord", default))
    return found.join(rules.select("ord", *payload), "ord", "left").select(key, *payload)


def all_rules(texts: DataFrame, rules: DataFrame, most: int, key: str = "id") -> DataFrame:
    """(key, ords): the first ``most`` fitting rules of every text in their order; empty if none fits."""
    found = matches(texts, rules, key).groupBy(key).agg(F.slice(F.array_sort(F.collect_set("ord")), 1, most).alias("ords"))
    return texts.select(key).join(found, key, "left").withColumn("ords", F.coalesce("ords", F.array().cast("array<int>")))
