"""Language identification with hyperdimensional profiles.

Each letter has a random vector of +1 and -1. A letter trigram is bound from the permuted vectors of
its letters (rotate the first by two, the second by one, multiply); a text is the bundle (sum) of its
trigram vectors, a language the bundle of its training texts. Texts go to the language with the
largest cosine. As bundles are linear, the products of every trigram vector with every prototype are
taken once, and a text needs only its trigram counts; its own length in the space is taken from its
counts, since bound vectors of different trigrams are orthogonal but for noise of order 1/sqrt(dims),
and it is the same for all languages, so that it never decides between them.

Words are runs of letters; anything else is one blank. Null texts and texts without a letter get
``und`` and score 0; so does every text if nothing was learned. Ties go to the first language in
sorted order. Rows with null lang are never learned from. Texts of any length are read whole, about a
million characters at a time. Rows that repeat a doc_id are judged one by one, and learned from as often;
rows without doc_id are judged, with held_out null, and never learned from. An empty table gives an empty
result. What is collected and sent to the tasks is a number for each language and each trigram seen with
any, so it grows with the number of lang values and not with the texts.
"""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vidcohort.llm.common import fold_remainder, read_table, tidy

#: Letter codes: 0 is blank, 1-26 are a-z, other letters share the rest by code point.
SYMBOLS = 64
TRIGRAMS = SYMBOLS**3
DIMS = 4096
#: Characters that are handled at once.
CHUNK = 1 << 20
NONE = "und"


@functools.cache
def symbol_table() -> np.ndarray:
    """Symbol of each code point."""
    table = np.zeros(0x110000, np.uint8)
    letters = np.array([i for i in range(0x110000) if chr(i).isalpha()])
    table[letters] = 27 + letters % 37
    table[ord("a") : ord("z") + 1] = np.arange(1, 27)
    return table


def trigram_counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, trigram, count) arrays over some texts."""
    lowered = [t.lower() for t in texts]
    joined = "".join(f" {t} " for t in lowered)
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
    owner = np.repeat(np.arange(len(texts)), np.fromiter((len(t) + 2 for t in lowered), np.int64, len(texts)))
    sym = symbol_table()[codes]
    keep = np.ones(len(sym), bool)
    keep[1:] = (sym[1:] != 0) | (sym[:-1] != 0) | (owner[1:] != owner[:-1])
    sym, owner = sym[keep].astype(np.int64), owner[keep]
    whole = (owner[2:] == owner[:-2]) & (sym[1:-1] + sym[2:] + sym[:-2] > 0)
    key = (((owner[:-2] * SYMBOLS + sym[:-2]) * SYMBOLS + sym[1:-1]) * SYMBOLS + sym[2:])[whole]
    key, count = np.unique(key, return_counts=True)
    return key // TRIGRAMS, key % TRIGRAMS, count


def chunks(texts):
    """(positions, texts) of the texts that are not null, about ``CHUNK`` characters at a time."""
    at, part, size = [], [], 0
    for i, t in enumerate(texts):
        if isinstance(t, str):
            at.append(i)
            part.append(t)
            size += len(t)
            if size >= CHUNK:
                yield np.array(at), part
                at, part, size = [], [], 0
    if at:
        yield np.array(at), part


def letter_vectors(seed: int = 11) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 2, (SYMBOLS, DIMS)).astype(np.int8) * 2 - 1


def bound(trigrams: np.ndarray, letters: np.ndarray) -> np.ndarray:
    """Vectors of trigrams."""
    first, second = np.roll(letters, 2, axis=1), np.roll(letters, 1, axis=1)
    a, b, c = trigrams // SYMBOLS**2, trigrams // SYMBOLS % SYMBOLS, trigrams % SYMBOLS
    return first[a] * second[b] * letters[c]


def train(docs: DataFrame) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, the place of every trigram in a table, and that table: a trigram's product with each language's
    prototype. The last place is of all trigrams that were never seen.

    ``docs`` has text and lang. Trigram counts are summed by task and then by Spark; the driver gets at
    most one row a language and trigram (``TRIGRAMS`` is the bound).
    """

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            langs = b["lang"].to_numpy()
            for at, part in chunks(b["text"]):
                owner, tri, n = trigram_counts(part)
                of = langs[at][owner]
                for lang in set(of):
                    if lang not in sums:
                        sums[lang] = np.zeros(TRIGRAMS, np.int64)
                    own = of == lang
                    sums[lang] += np.bincount(tri[own], weights=n[own], minlength=TRIGRAMS).astype(np.int64)
            if len(sums) > 32:
                yield from flush(sums)
        yield from flush(sums)

    def flush(sums):
        for lang, n in sums.items():
            seen = np.flatnonzero(n)
            yield pd.DataFrame({"lang": lang, "trigram": seen.astype(np.int32), "n": n[seen]})
        sums.clear()

    known = docs.where("lang is not null and text is not null").select("text", "lang")
    counts = known.mapInPandas(tidy(count), "lang string, trigram int, n long").groupBy("lang", "trigram").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(counts["lang"].unique())
    seen = np.unique(counts["trigram"].to_numpy())
    table = np.zeros((len(seen) + 1, max(1, len(langs))), np.float32)
    place = np.full(TRIGRAMS, len(seen), np.int32)
    place[seen] = np.arange(len(seen))
    letters = letter_vectors()
    profile = np.zeros((len(seen), len(langs)), np.float32)
    for k, lang in enumerate(langs):
        own = counts[counts["lang"] == lang]
        profile[np.searchsorted(seen, own["trigram"]), k] = own["n"] / np.sqrt(np.square(own["n"].astype(float)).sum())
    prototypes = np.zeros((DIMS, len(langs)), np.float32)
    for i in range(0, len(seen), 1024):
        prototypes += bound(seen[i : i + 1024], letters).astype(np.float32).T @ profile[i : i + 1024]
    prototypes /= np.maximum(np.linalg.norm(prototypes, axis=0), 1e-12)
    for i in range(0, len(seen), 1024):
        table[i : i + 1024][: len(seen) - i, : len(langs)] = bound(seen[i : i + 1024], letters).astype(np.float32) @ prototypes / np.sqrt(DIMS)
    return langs, place, table


def predict(texts, langs: list[str], place: np.ndarray, table: np.ndarray) -> pd.DataFrame:
    """(lang, score) of each text."""
    lang, score = np.full(len(texts), NONE, object), np.zeros(len(texts))
    if not langs:
        return pd.DataFrame({"lang": lang, "score": score})
    for at, part in chunks(texts):
        owner, tri, n = trigram_counts(part)
        size = np.sqrt(np.bincount(owner, weights=np.square(n), minlength=len(part)))
        cosines = np.stack([np.bincount(owner, weights=n * table[place[tri], k], minlength=len(part)) for k in range(len(langs))], axis=1, dtype=float)
        cosines /= np.maximum(size, 1)[:, None]
        best = cosines.argmax(axis=1)
        some = size > 0
        lang[at[some]] = np.array(langs, object)[best[some]]
        score[at[some]] = np.clip(cosines.max(axis=1)[some], 0, 1)
    return pd.DataFrame({"lang": lang, "score": score})


def language(spark: SparkSession, model: tuple[list[str], np.ndarray, np.ndarray]):
    """A function from a text column to a struct of lang and score."""
    shared = spark.sparkContext.broadcast(model)  # at most TRIGRAMS floats a language

    @F.pandas_udf("lang string, score double")
    def run(texts: pd.Series) -> pd.DataFrame:
        return predict(texts, *shared.value)

    return run


def learned(spark: SparkSession, docs: DataFrame):
    """The predictor learned from the training folds of ``docs``."""
    return language(spark, train(docs.where(fold_remainder(F.col("doc_id"), 5) != 0)))


def keep_identified(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose language was identified, by a model of all rows with text and lang: nothing is held out here."""
    return docs.where(language(spark, train(docs))(F.col("text"))["lang"] != NONE)


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language and cosine of every document."""
    docs = read_table(spark, sf_dir, "documents")
    found = docs.select(
        "doc_id",
        (fold_remainder(F.col("doc_id"), 5) == 0).alias("held_out"),
        learned(spark, docs)(F.col("text")).alias("p"),
    )
    return found.select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"))
