"""URL filtering by association rules.

URLs become small sets of tokens (scheme, host labels, path parts, query keys). FP-growth mines the token sets of the
labelled pages of each verdict by themselves, so that support is a share of the verdict's own pages and a bad host is
found however rare it is among all pages. A frequent set, counted in all labelled pages, is a rule if at least
``MIN_ROWS`` pages have it, the verdict's share among them (confidence) is ``MIN_CONFIDENCE`` or more and ``MIN_LIFT``
times the verdict's share of all labelled pages or more, unless a smaller set is at least as sure.

Tokens that stand in exactly the same labelled pages are one item (``folds``): sets that differ by them alone have the same
counts, and of the 2^n sets of n such tokens only those of one token each could be rules. A page has the item if it has any of them,
which is what these rules would find.

Rules are matched through an inverted index from token to rule: a rule fires if as many of its tokens are found as it
has. The surest rule that fires decides; ties go to allow; without any rule the verdict is allow. Given host and path
rules come first; the longest that fits wins.

All of it is DataFrame work. Null URLs and those without ``://`` have empty host and path, no token and the verdict
allow. Every row of pages is judged by its URL alone, whatever its id, repeats included; a page that has several labels
is blocked if one of them says so, and counts once for each row that repeats its id. Pages without a label are judged
like the rest. URLs of any length are taken whole. Without labels nothing is mined; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vidcohort.llm.common import cut, read_table

#: (host, path, verdict) of the given rules.
GIVEN = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Share of the verdict's labelled pages, share of the verdict among a rule's pages, the same over that of all pages, pages.
MIN_SUPPORT, MIN_CONFIDENCE, MIN_LIFT, MIN_ROWS = 0.01, 0.6, 1.2, 30
#: Rules up to which the index is sent to every executor; beyond it, the join is left to Spark.
INDEX_ROWS = 20_000


def host(url: Column) -> Column:
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(F.coalesce(found, F.lit("")), UPPER, LOWER)


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def given_rule(host: Column, path: Column, rules=GIVEN) -> Column:
    """Struct of the longest fitting rule's text and verdict, or null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for h, p, verdict in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def tokens(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens of a URL; digits are folded, so that page numbers do not make tokens of their own."""
    fold = lambda c: F.regexp_replace(F.lower(c), "[0-9]+", "0")
    tagged = lambda tag, parts: F.transform(F.filter(parts, lambda x: x != ""), lambda x: F.concat(F.lit(tag), fold(x)))
    scheme = F.regexp_extract(url, r"(?s)^(.*?)://", 1)
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    keys = F.transform(F.split(query, "&"), lambda x: F.substring_index(x, "=", 1))
    parts = [tagged("scheme:", F.array(scheme)), tagged("host:", F.split(host, r"\.")), tagged("path:", F.split(path, r"[/.]")), tagged("key:", keys)]
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.concat(*parts)))


def folds(labelled: DataFrame, least: float) -> DataFrame:
    """(token, item) of the tokens of at least so many rows of ``labelled`` (items) that stand in the same rows as a smaller token, the item.

    Rows are compared by their number and two 64-bit sums of hashes, so that nothing is gathered.
    """
    rows = cut(labelled.select(F.monotonically_increasing_id().alias("row"), "items"))
    each = rows.select("row", F.explode("items").alias("token")).groupBy("token").agg(
        F.count("*").alias("n"), F.bit_xor(F.xxhash64("row")).alias("one"), F.bit_xor(F.xxhash64("row", F.lit("fold"))).alias("two")
    )
    same = each.where(F.col("n") >= least).groupBy("n", "one", "two").agg(F.min("token").alias("item"), F.collect_set("token").alias("tokens"))
    return same.where("size(tokens) > 1").select(F.explode("tokens").alias("token"), "item").where("token <> item")


def folded(items: Column, known: dict[str, str]) -> Column:
    """``items`` with the tokens of ``known`` replaced."""
    if not known:
        return items
    table = F.create_map(*[F.lit(x) for pair in sorted(known.items()) for x in pair])
    return F.array_distinct(F.transform(items, lambda x: F.coalesce(F.try_element_at(table, x), x)))


def least_rows(n: int, min_support: float, min_confidence: float, min_rows: int) -> float:
    """Rows of its own verdict that a rule needs, of ``n``."""
    return max(min_support * n, min_confidence * min_rows)


def frequent(baskets: DataFrame, support: float) -> DataFrame:
    """(antecedent, n) sorted token sets of at least that share of the rows of ``baskets`` (items), and of how many.

    Rarer tokens can be in no such set and are dropped before the mining, which also bounds the items of a row that
    FP-growth has to deal with.
    """
    rows = baskets.count()
    often = baskets.select(F.explode("items").alias("item")).groupBy("item").count().where(F.col("count") >= support * rows)
    known = F.array(*[F.lit(r["item"]) for r in often.select("item").collect()]).cast("array<string>")  # at most (tokens a URL) / support
    rows = cut(baskets.select(F.array_intersect("items", known).alias("items")))
    sets = FPGrowth(itemsCol="items", minSupport=support).fit(rows).freqItemsets
    return sets.select(F.array_sort("items").alias("antecedent"), F.col("freq").alias("n"))


def matched(sets: DataFrame, rules: DataFrame) -> DataFrame:
    """(items, rule_id): the rules (rule_id, antecedent) all of whose tokens are in a set of tokens (items)."""
    index = cut(rules.select("rule_id", F.size("antecedent").alias("need"), F.explode("antecedent").alias("token")))
    if index.count() <= INDEX_ROWS:
        index = F.broadcast(index)
    hits = sets.select("items", F.explode("items").alias("token")).join(index, "token")
    return hits.groupBy("items", "rule_id", "need").agg(F.count("*").alias("found")).where("found = need").select("items", "rule_id")


def mine(
    labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, min_lift: float = MIN_LIFT, min_rows: int = MIN_ROWS
) -> DataFrame:
    """(rule_id, antecedent, verdict, confidence) from rows of items and verdict."""
    spark = labelled.sparkSession
    labelled = cut(labelled)
    totals = {"allow": 0, "block": 0} | {r["verdict"]: r["count"] for r in labelled.groupBy("verdict").count().collect()}
    sets = {v: labelled.where(F.col("verdict") == v) for v in totals}
    least = {v: least_rows(n, min_support, min_confidence, min_rows) for v, n in totals.items()}
    mined = {}
    for v, n in totals.items():
        # mined to half the support: a set that is frequent with one verdict then mostly has its count with the other
        empty = spark.createDataFrame([], "antecedent array<string>, n bigint")
        mined[v] = (frequent(sets[v], least[v] / 2 / n) if n >= least[v] else empty).withColumnRenamed("n", v)
    both = cut(mined["allow"].join(mined["block"], "antecedent", "full"))
    rules = spark.createDataFrame([], "antecedent array<string>, verdict string, n double, confidence double, rule_id bigint")
    for v, other in (("allow", "block"), ("block", "allow")):
        sure = max(min_confidence, min_lift * totals[v] / max(1, sum(totals.values()))) - 1e-9
        own, rest = F.col(v), F.col(other)
        found = both.where((own >= least[v]) & (rest.isNull() | (own >= sure * (own + rest)))).withColumn("rule_id", F.xxhash64("antecedent"))
        found = cut(found)
        # the rest is counted through the index
        distinct = sets[other].groupBy("items").agg(F.count("*").alias("times"))
        counts = matched(distinct.select("items"), found.where(rest.isNull())).join(distinct, "items").groupBy("rule_id").agg(F.sum("times").alias("counted"))
        found = found.join(counts, "rule_id", "left").withColumn("n", own + F.coalesce(rest, "counted", F.lit(0)))
        found = found.withColumns({"verdict": F.lit(v), "confidence": own / F.col("n"), "rule_id": F.xxhash64(F.lit(v), "antecedent")})
        rules = rules.unionByName(found.where((F.col("n") >= min_rows) & (F.col("confidence") >= sure)).select(rules.columns))
    rules = cut(rules.select("rule_id", "antecedent", "verdict", "confidence"))
    # a rule goes if one with fewer tokens, all of them among its own, is at least as sure of the same verdict
    parts = rules.select(F.col("antecedent").alias("long"), "verdict", F.col("confidence").alias("sure"), F.explode("antecedent").alias("token"))
    short = rules.select(F.col("antecedent").alias("short"), "verdict", "confidence", F.explode("antecedent").alias("token"))
    covered = (
        parts.join(short, ["verdict", "token"])
        .where("size(short) < size(long) and confidence >= sure")
        .groupBy("verdict", "long", "short").agg(F.count("*").alias("n"))
        .where("n = size(short)").select("verdict", F.col("long").alias("antecedent")).distinct()
    )
    return cut(rules.join(covered, ["verdict", "antecedent"], "left_anti").select("rule_id", "antecedent", "verdict", "confidence"))


def fired(sets: DataFrame, rules: DataFrame) -> DataFrame:
    """(items, verdict) for the distinct token sets on which a rule fires."""
    best = F.max(F.struct("confidence", (F.col("verdict") == "allow").alias("allow"))).alias("best")
    hits = matched(sets, rules).join(rules.select("rule_id", "verdict", "confidence"), "rule_id")
    return hits.groupBy("items").agg(best).select("items", F.when(F.col("best.allow"), "allow").otherwise("block").alias("verdict"))


def judge(
    pages: DataFrame, labels: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, min_lift: float = MIN_LIFT, min_rows: int = MIN_ROWS
) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every row of ``pages`` (page_id, url).

    ``labels`` (doc_id, quality, toxic) marks pages by id: block if toxic or of low quality.
    """
    split = pages.select("page_id", "url", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    split = split.withColumn("given", given_rule(F.col("host"), F.col("path")))
    split = split.withColumn("items", tokens(F.col("url"), F.col("host"), F.col("path")))
    marks = labels.where("doc_id is not null").groupBy("doc_id").agg(
        F.max(((F.col("toxic") == 1) | (F.col("quality") == 0)).cast("int")).alias("bad")
    ).where("bad is not null")
    labelled = split.join(marks, split["page_id"] == marks["doc_id"]).where("size(items) > 0").select(
        "items", F.when(F.col("bad") == 1, "block").otherwise("allow").alias("verdict")
    )
    labelled = cut(labelled)
    fewest = min([least_rows(r["count"], min_support, min_confidence, min_rows) for r in labelled.groupBy("verdict").count().collect()], default=1)
    known = {r["token"]: r["item"] for r in folds(labelled, fewest / 2).collect()}  # of frequent tokens: at most (tokens a URL) / support
    split = split.withColumn("items", folded(F.col("items"), known))
    rules = mine(labelled.withColumn("items", folded(F.col("items"), known)), min_support, min_confidence, min_lift, min_rows)
    used = rules.select(F.explode("antecedent").alias("token")).distinct().agg(F.sort_array(F.collect_set("token"))).first()[0]
    if used:  # tokens of kept rules: at most (tokens a URL) / min_support
        known = F.array(*map(F.lit, used))
        split = split.withColumn("items", F.array_sort(F.array_intersect("items", known)))
        sets = split.where("given is null").select("items").distinct()
        # a plain table on this side lets the skew join split the pages
        found = cut(fired(sets, rules).withColumnRenamed("verdict", "mined"))
        split = split.join(found, "items", "left")
    else:
        split = split.withColumn("mined", F.lit(None).cast("string"))
    return split.select(
        "page_id", "host", "path", F.col("given.rule").alias("rule"),
        F.coalesce("given.verdict", "mined", F.lit("allow")).alias("verdict"),
    )


def op6_urlfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict of every page."""
    return judge(read_table(spark, sf_dir, "pages").select("page_id", "url"), read_table(spark, sf_dir, "labels"))
