"""Spelling variants: near words by bidirectional FM-index search schemes.

1. ``vocabulary``: runs of letters of all texts, counted with map-side sums.
2. ``members``: words of c letters and of c - 1 letters meet in class c. If two of them differ by one code point, then
   either the left half is equal or the right half is, so that each word is sent to both; a pair whose left halves are
   equal belongs to the left one alone. Words with an equal half are a group. Groups of more than ``GROUP`` words (a common
   half) are split by the same argument over what is still open, until they are small or only one code point is open.
3. ``nearest``: groups are packed into buckets by letters. A bucket is the FM-index over its delimited words in both directions;
   a group's half is matched exactly outwards to the delimiter, then the search goes on across the other half allowing one
   error. Every word is searched, in every one of its groups. A word's counts and best words are then brought together.
4. ``roots``: chains of forms are followed by pointer jumping; they are no longer than log5 of the largest count.

Null texts have no word; a null doc_id is written as an empty string. Texts and runs of any length are taken whole. Repeated rows count
again. Extra columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vidcohort.llm.common import cut, drop_cut, give_back, read_table
from vidcohort.llm.fmindex import DELETE, INSERT, REPLACE, FMIndex

#: Capitals that are lowered, and the checksum's divisor.
UPPER, LOWER, DAMAGED = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", 199
LEAST_LETTERS, LEAST_COUNT, FACTOR = 6, 5, 5
#: Words of a group, and letters of a bucket (on average).
GROUP, BUCKET = 4096, 1 << 17


def runs(docs: DataFrame) -> DataFrame:
    """(word): the lower-cased runs of letters, damaged by the checksum of document and run; those too short are left out."""
    found = F.regexp_extract_all(F.col("text").cast("string"), F.lit(r"[A-Za-zÀ-ÿ]{%d,}" % LEAST_LETTERS), F.lit(0))
    named = docs.select(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":")).alias("head"), F.explode(found).alias("run"))
    low = named.select("head", F.translate("run", UPPER, LOWER).alias("run"))
    hashed = low.select("run", F.crc32(F.concat("head", "run").cast("binary")).alias("h"))
    word = F.expr(f"if(h % {DAMAGED} = 0, concat(substring(run, 1, cast(h % length(run) as int)), substring(run, cast(h % length(run) as int) + 2)), run)")
    return hashed.select(word.alias("word")).where(F.length("word") >= LEAST_LETTERS)


def vocabulary(docs: DataFrame) -> DataFrame:
    """(word, n) of the words that occur often enough."""
    return runs(docs).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_COUNT)


def members(words: DataFrame, group: int = GROUP) -> DataFrame:
    """(word, n, c, a, b, bar): each word with its groups.

    Group members have ``c`` or ``c - 1`` letters, the first ``a`` and the last ``b`` of which are the same for all. A
    pair belongs to the group only if its first ``bar`` letters differ (no condition if ``bar`` is -1).
    """
    size = F.length("word")
    classes = words.select("word", "n", F.explode(F.array(size, size + 1)).alias("c"))
    left, right = _halves(F.lit(0), F.lit(0), F.lit(-1))
    now = cut(classes.select("word", "n", "c", F.explode(F.array(left, right)).alias("x")).select("word", "n", "c", "x.*"))
    whole = None
    while True:
        keyed = now.withColumn("key", _key())
        heavy = keyed.where("a + b < c - 1").groupBy("key").count().where(F.col("count") > group).select("key")
        heavy = cut(heavy)  # a plain table on this side lets the skew join split a group
        if heavy.isEmpty():
            return now if whole is None else whole.unionByName(now)
        small = keyed.join(heavy, "key", "left_anti").drop("key")
        left, right = _halves(F.col("a"), F.col("b"), F.col("bar"))
        parts = keyed.join(heavy, "key").select("word", "n", "c", F.explode(F.array(left, right)).alias("x")).select("word", "n", "c", "x.*")
        small, parts = cut(small), cut(parts)
        drop_cut(now)
        drop_cut(heavy)
        whole, now = small if whole is None else whole.unionByName(small), parts


def _halves(a, b, bar):
    """The two ways in which what is open between ``a`` letters and ``b`` letters can be half equal."""
    open_ = F.col("c") - 1 - a - b
    more = F.floor((open_ + 1) / 2).cast("int")
    left = F.struct((a + more).cast("int").alias("a"), b.cast("int").alias("b"), bar.cast("int").alias("bar"))
    bars = F.when(bar < 0, a + more).otherwise(F.least(bar, a + more))
    right = F.struct(a.cast("int").alias("a"), (b + open_ + 1 - more).cast("int").alias("b"), bars.cast("int").alias("bar"))
    return left, right


def _key():
    """128 bits of a member's group."""
    fixed = [F.expr("substring(word, 1, a)"), F.expr("right(word, b)")]
    return F.md5(F.concat_ws("/", "c", "a", "b", *fixed).cast("binary"))


def search(words: list[str], rows: list[tuple[str, int, int, int, int]]) -> list[list[int]]:
    """Numbers in ``words`` of the near words of each row (word, c, a, b, bar) within its group."""
    index = FMIndex(words)
    out: list[list[int]] = [[] for _ in rows]
    for right in (True, False):  # to the right behind an equal left part, else to the left
        asked = []
        for k, (w, c, a, b, _) in enumerate(rows):
            if (a > 0) == right:
                asked += [(k, kind) for kind in ((REPLACE, DELETE) if len(w) == c else (INSERT,))]
        if not asked:
            continue
        fixed = [rows[k][0][: rows[k][2]] if right else rows[k][0][len(rows[k][0]) - rows[k][3] :] for k, _ in asked]
        distinct = {x: i for i, x in enumerate(dict.fromkeys(fixed))}
        lo, size = index.exact(list(distinct), right=not right)
        which = np.array([distinct[x] for x in fixed])
        rests, middle = [], []
        for (k, _), x in zip(asked, fixed):
            w, _, a, b, _ = rows[k]
            rests.append(w[a:] if right else w[len(w) - len(x) - 1 :: -1] if len(w) > len(x) else "")
            middle.append(len(w) - a - b)
        kinds = np.array([kind for _, kind in asked])
        for q, v in zip(*(x.tolist() for x in index.near(rests, np.array(middle), kinds, lo[which], size[which], right))):
            k = asked[q][0]
            w, bar = rows[k][0], rows[k][4]
            if bar < 0 or words[v][:bar] != w[:bar]:
                out[k].append(v)
    return out


def nearest(words: DataFrame, group: int = GROUP, bucket: int = BUCKET) -> DataFrame:
    """(word, n, n_near, best): near words in all, and the commonest of them, of the words that have some."""
    found = members(words, group)
    letters = found.agg(F.sum(F.length("word"))).first()[0] or 0
    found = found.withColumn("bucket", F.pmod(F.xxhash64(_key()), F.lit(max(1, letters // bucket))))

    def run(g: pd.DataFrame) -> pd.DataFrame:
        counts = dict(zip(g["word"], g["n"]))
        listed = sorted(counts, key=lambda w: (-counts[w], w))  # the best of several is the first
        rows = list(zip(g["word"], g["c"], g["a"], g["b"], g["bar"]))
        near = search(listed, rows)
        out = [(r[0], counts[r[0]], len(v), counts[listed[min(v)]], listed[min(v)]) for r, v in zip(rows, near) if v]
        give_back()
        return pd.DataFrame(out, columns=["word", "n", "n_near", "best_n", "best"])

    kind = "word string, n long, n_near long, best_n long, best string"
    return found.groupBy("bucket").applyInPandas(run, kind).groupBy("word", "n").agg(
        F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("less"), "best")).alias("best")
    )


def forms(words: DataFrame, **sizes: int) -> DataFrame:
    """(word, form, n, n_near, form_n) of every word."""
    near = nearest(words, **sizes).select("word", "n_near", F.col("best.best").alias("form"), (-F.col("best.less")).alias("form_n"))
    joined = words.join(near, "word", "left")
    big = F.col("form_n") >= FACTOR * F.col("n")
    return joined.select(
        "word", F.when(big, F.col("form")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(big, F.col("form_n")).alias("form_n")
    )


def roots(links: DataFrame) -> DataFrame:
    """(word, root) from (word, form): the last word of each chain, by doubling the steps that are known."""
    now = cut(links.select("word", F.col("form").alias("root")))
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        new = cut(now.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        drop_cut(now)
        now = new.select("word", "root")
        if new.where("moved").isEmpty():
            return now


def variants(docs: DataFrame, **sizes: int) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of ``docs``."""
    words = cut(vocabulary(docs))
    found = cut(forms(words, **sizes))
    last = roots(found.where("form is not null"))
    return found.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents with their near words, forms and roots."""
    return variants(read_table(spark, sf_dir, "documents"))
