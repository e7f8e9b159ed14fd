"""Substring deduplication by hashing lines and sentences.

1. ``units``: a text is cut after each line end and after each ``.``, ``!`` or ``?`` that a blank follows; blanks after
   a cut belong to the unit before it, so the units of a text add up to the text. A unit is normalised (A-Z
   lower-cased, runs of blanks folded, ends trimmed) and digested (128 bits).
2. ``repeats``: digests are grouped over all documents. The earliest occurrence by doc_id and position stays; a later
   one, in the same or in another document, is a repeat.
3. A run of consecutive repeats with ``run_words`` words or more together is removed, with its offsets in the original
   text (characters). Shorter runs recur by chance (a heading, a common sentence) and stay; with ``run_words=1`` every
   repeat goes.

Null and empty texts have no unit. A unit without a word (blanks at the start of a text) is neither compared nor
removed. There is no bound on a text's length: a task holds one batch of texts and their units. Rows that repeat a
doc_id rank alike: a unit goes only if it stands in a smaller doc_id or earlier in its own row. Rows without doc_id are
neither compared nor changed. An empty table gives an empty result.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vidcohort.llm.common import cut, read_table

#: Words from which on a run of repeated units is a repeated passage.
RUN_WORDS = 30
_end = re.compile(r"(?:[.!?][ \t\r\x0b\x0c]|\n)[ \t\r\x0b\x0c\n]*")


def cuts(text: str) -> list[int]:
    """Offsets at which the units of a text end."""
    ends = [m.end() for m in _end.finditer(text)]
    return ends if not text or ends and ends[-1] == len(text) else [*ends, len(text)]


def unit_digest(unit: str) -> tuple[bytes, int]:
    """128-bit digest of the normalised unit and its number of words."""
    words = unit.encode("utf-8", "surrogatepass").lower().split()
    return xxhash.xxh3_128_digest(b" ".join(words)), len(words)


def _texts(docs: DataFrame) -> DataFrame:
    """doc_id, text and its hash, which tells apart rows that share an id."""
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("sign"))


def units(docs: DataFrame) -> DataFrame:
    """(doc_id, sign, pos, words, digest) of the units that have a word; a unit that repeats one of its own text has no digest."""

    def run(batches):
        for b in batches:
            ids, signs, pos, words, digests = [], [], [], [], []
            for i, t, sign in zip(b["doc_id"], b["text"], b["sign"]):
                t, at, own = t or "", 0, set()
                for k, end in enumerate(cuts(t)):
                    digest, n = unit_digest(t[at:end])
                    at = end
                    if n:
                        ids.append(i)
                        signs.append(sign)
                        pos.append(k)
                        words.append(n)
                        digests.append(None if digest in own else digest)
                        own.add(digest)
            yield pd.DataFrame({"doc_id": np.array(ids, np.int64), "sign": np.array(signs, np.int64), "pos": np.array(pos, np.int32), "words": np.array(words, np.int32), "digest": digests})

    return _texts(docs).where("doc_id is not null").mapInPandas(run, "doc_id long, sign long, pos int, words int, digest binary")


def repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, sign, gone): positions and words of the repeated units, for the documents that have some.

    Digests are counted with map-side sums; only those of several documents are joined back, and a hot digest is split
    by the skew join, as each of its rows is compared with one document only.
    """
    all_units = cut(units(docs))
    first = all_units.where("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    first = cut(first.where("first < last").drop("last"))  # a plain table on this side lets the skew join split the other one
    others = all_units.join(first, "digest").where("doc_id > first").select("doc_id", "sign", "pos", "words")
    gone = others.unionByName(all_units.where("digest is null").select("doc_id", "sign", "pos", "words"))
    return gone.groupBy("doc_id", "sign").agg(F.collect_set(F.struct("pos", "words")).alias("gone"))


def spans(text: str, gone, run_words: int) -> list[tuple[int, int, int]]:
    """(start, end, units) of the runs of repeats that are long enough."""
    out, ends = [], cuts(text)
    first, last, words = 0, -2, 0
    for pos, n in [*sorted((x["pos"], x["words"]) for x in gone), (len(ends) + 1, 0)]:
        if pos != last + 1:
            if last >= 0 and words >= run_words:
                out.append((ends[first - 1] if first else 0, ends[last], last - first + 1))
            first, words = pos, 0
        last, words = pos, words + n
    return out


def cleaned(docs: DataFrame, run_words: int = RUN_WORDS) -> DataFrame:
    """(doc_id, kept, n_units, n_removed, removed) of every row: the remaining text, units in all and gone, and the removed spans.

    ``removed`` has start and end offsets in the original text.
    """

    @F.pandas_udf("kept string, n_units long, n_removed long, removed array<struct<start:long,end:long>>")
    def run(texts: pd.Series, gones: pd.Series) -> pd.DataFrame:
        rows = []
        for t, gone in zip(texts, gones):
            t = t or ""
            out = [] if gone is None else spans(t, gone, run_words)
            at, kept = 0, []
            for start, end, _ in out:
                kept.append(t[at:start])
                at = end
            rows.append(("".join([*kept, t[at:]]), len(cuts(t)), sum(n for *_, n in out), [{"start": s, "end": e} for s, e, _ in out]))
        return pd.DataFrame(rows, columns=["kept", "n_units", "n_removed", "removed"])

    docs = _texts(docs)
    return docs.join(repeats(docs), ["doc_id", "sign"], "left").select("doc_id", run("text", "gone").alias("x")).select("doc_id", "x.*")


def op8_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units kept and removed of every document."""
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return cleaned(read_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_units", "n_removed", F.size("removed").cast("long").alias("n_spans"), removed.alias("removed_chars"), F.md5("kept").alias("kept_md5")
    )


#: The same for texts without the character 1, which marks the cuts here.
ORACLE_SQL = rf"""
WITH cut AS (
  SELECT doc_id, string_split(regexp_replace(coalesce(text, ''), '((?:[.!?][ \t\r\x0b\x0c]|\n)[ \t\r\x0b\x0c\n]*)', '\1' || chr(1), 'g'), chr(1)) AS parts FROM documents
), pieces AS (
  SELECT doc_id, unnest(parts) AS unit, unnest(range(len(parts))) AS pos FROM cut
), normed AS (
  SELECT *, trim(regexp_replace(translate(unit, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\r\x0b\x0c\n]+', ' ', 'g'), ' ') AS norm
  FROM pieces WHERE unit <> ''
), ranked AS (
  SELECT *, CASE WHEN norm = '' THEN 0 ELSE len(string_split(norm, ' ')) END AS words,
         norm <> '' AND row_number() OVER (PARTITION BY norm ORDER BY doc_id, pos) > 1 AS again
  FROM normed
), islands AS (
  SELECT *, pos - row_number() OVER (PARTITION BY doc_id, again ORDER BY pos) AS island FROM ranked
), judged AS (
  SELECT *, again AND sum(words) OVER (PARTITION BY doc_id, again, island) >= {RUN_WORDS} AS gone FROM islands
), documented AS (
  SELECT doc_id, count(*) AS n_units, sum(CASE WHEN gone THEN 1 ELSE 0 END)::BIGINT AS n_removed,
         count(DISTINCT CASE WHEN gone THEN island END) AS n_spans,
         sum(CASE WHEN gone THEN length(unit) ELSE 0 END)::BIGINT AS removed_chars,
         md5(coalesce(string_agg(unit, '' ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_md5
  FROM judged GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_units, 0) AS n_units, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       coalesce(removed_chars, 0) AS removed_chars, coalesce(kept_md5, md5('')) AS kept_md5
FROM documents d LEFT JOIN documented USING (doc_id)
"""
