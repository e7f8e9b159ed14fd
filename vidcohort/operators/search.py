"""Top results by shared words, from an index that never counts what cannot be a result.

The index holds classes (titles with the same words). Words are ordered from rare to frequent; a word is *frequent* if
more than ``SHARE`` of the classes have it, so that there are at most (words a title) / ``SHARE`` of them, however large the
corpus is. A rare word is a key of its own; frequent words are keys only in pairs. A class that shares two words or more with
a query shares a rare word or two frequent ones, so the keys lose none of them. A pair of query and class is taken at the
key of their first common words alone, where all of them are counted at once from both word lists; nothing is shuffled
to count, and nothing has to be made distinct.

1. Keys with the query's rarest word give a first top list, and with it a bound: the overlap and views of its last place.
2. Other keys join under that bound: behind the key's words no more can be shared than either side has left, and a class
   that can only tie needs the views of the last place.
3. Only queries whose list could still end with one shared word look at frequent words alone, and there only at the most seen
   classes of each word, twice as many as there are places: fewer than ``most`` of these can be known already.

A title with over ``LONG`` frequent words has them as single keys in all steps, so that its keys are no more than its words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vidcohort.sources.stored import cut

SHARE, LONG = 0.001, 40


def frequent_words(heads: DataFrame, share: float = SHARE) -> DataFrame:
    """(token, df) of the words that more than ``share`` of the classes have."""
    n = heads.agg(F.count("*").alias("n"))
    counts = heads.select(F.explode("words").alias("token")).groupBy("token").agg(F.count("*").alias("df"))
    return counts.where(F.col("df") > n.scalar() * share)


def ordered(rows: DataFrame, frequent: DataFrame, *keys: str) -> DataFrame:
    """(keys, words, n_rare): the words of ``rows`` (keys, words) with the rare ones first, then by frequency."""
    tokens = rows.select(*keys, F.explode("words").alias("token")).join(frequent, "token", "left")
    one = F.struct(F.coalesce("df", F.lit(0)).alias("df"), "token")
    return tokens.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["token"]).alias("words"), F.count_if(F.col("df").isNull()).cast("int").alias("n_rare"))


def long_title() -> Column:
    return F.size("words") - F.col("n_rare") > LONG


def _keys(single: Column, paired: Column) -> Column:
    """Keys (a, b, first, last): the first ``single`` words alone, and the words behind the first ``paired`` ones in pairs; places count from 0."""
    size = F.size("words")
    one = F.transform(F.slice("words", 1, single), lambda x, i: F.struct(x.alias("a"), F.lit("").alias("b"), i.alias("first"), i.alias("last")))
    rest = F.slice("words", paired + 1, size)
    pairs = F.flatten(F.transform(rest, lambda x, i: F.transform(
        F.slice(rest, i + 2, size), lambda y, j: F.struct(x.alias("a"), y.alias("b"), (paired + i).alias("first"), (paired + i + j + 1).alias("last"))
    )))
    return F.concat(one, pairs)


def class_keys(classes: DataFrame) -> DataFrame:
    """A row for every key of every class, with all that ranks the class."""
    single = F.when(long_title(), F.size("words")).otherwise(F.col("n_rare"))
    found = F.explode(_keys(single, single)).alias("k")
    return classes.select("class", "mark", "most_seen", "words", long_title().alias("long"), found).select("k.a", "k.b", (F.size("words") - F.col("k.last") - 1).alias("left"), "class", "mark", "most_seen", "words", "long")


def query_keys(asked: DataFrame) -> DataFrame:
    """A row for every key of every query: its words alone (rare ones, and those of long titles) and its frequent ones in pairs."""
    keys = F.explode(_keys(F.size("words"), F.col("n_rare"))).alias("k")
    return asked.select("q", F.col("words").alias("asked"), "n_rare", keys).select("q", "asked", "n_rare", "k.a", "k.b", "k.first", (F.size("asked") - F.col("k.last") - 1).alias("ahead"))


def counted(pairs: DataFrame) -> DataFrame:
    """Of the joined keys, those of the first common words of a query and a class, with the number of all of these."""
    # made once a pair: a plain column would be put into each of the conditions below
    rows = pairs.withColumn("common", F.explode(F.array(F.array_intersect("asked", "words"))))
    head, second = F.col("common")[0], F.try_element_at("common", F.lit(2))
    alone = F.col("long") | (F.array_position("asked", head) <= F.col("n_rare"))
    mine = (F.col("a") == head) & (F.col("b") == F.when(alone, F.lit("")).otherwise(second))
    return rows.where(mine).select("q", "class", "mark", "most_seen", F.size("common").cast("long").alias("overlap"))


def places(pairs: DataFrame, most: int) -> DataFrame:
    best = Window.partitionBy("q").orderBy(F.desc("overlap"), F.desc("most_seen"), "class", "mark")
    return pairs.withColumn("n", F.row_number().over(best)).where(F.col("n") <= most)


def search(asked: DataFrame, heads: DataFrame, most: int, share: float = SHARE) -> DataFrame:
    """(q, class, mark, overlap): the first ``most`` classes of each query.

    ``asked`` has q and words, ``heads`` class, mark, most_seen and words, both without repeats. More shared words come first,
    then more views, then the smaller class.
    """
    frequent = cut(frequent_words(heads, share))
    classes = cut(ordered(heads, frequent, "class", "mark", "most_seen"))
    keys = class_keys(classes)
    tasks = int(heads.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    queries = cut(ordered(asked, frequent, "q").repartition(tasks))  # few and small, but each meets many classes
    wanted = query_keys(queries)

    first = cut(places(counted(wanted.where("first = 0").join(keys, ["a", "b"])), most))
    bound = first.where(F.col("n") == most).select("q", F.col("overlap").alias("least"), F.col("most_seen").alias("seen"))
    can = F.when(F.col("b") == "", 1).otherwise(2) + F.least("ahead", "left")
    may = F.col("least").isNull() | (can > F.col("least")) | ((can == F.col("least")) & (F.col("seen").isNull() | (F.col("most_seen") >= F.col("seen"))))
    more = counted(wanted.where("first > 0").join(bound, "q", "left").join(keys, ["a", "b"]).where(may))
    second = cut(places(first.drop("n").unionByName(more), most))

    done = second.where((F.col("n") == most) & (F.col("overlap") > 1)).select("q")
    seen_most = Window.partitionBy("token").orderBy(F.desc("most_seen"), "class", "mark")
    short = classes.where(~long_title()).select("class", "mark", "most_seen", "words", F.explode(F.slice("words", F.col("n_rare") + 1, F.size("words"))).alias("token"))
    tops = short.withColumn("n", F.row_number().over(seen_most)).where(F.col("n") <= 2 * most).drop("n")
    rest = queries.join(done, "q", "left_anti").select("q", F.col("words").alias("asked"), F.explode(F.slice("words", F.col("n_rare") + 1, F.size("words"))).alias("token"))
    last = rest.join(tops, "token").withColumn("overlap", F.size(F.array_intersect("asked", "words")).cast("long")).where("overlap = 1")
    return places(second.drop("n").unionByName(last.select("q", "class", "mark", "most_seen", "overlap")), most).select("q", "class", "mark", "overlap")
