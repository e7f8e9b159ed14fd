"""Language-model scoring with a weighted backoff automaton.

Tokens are words (A-Z lower-cased) and one end a text. All words, pairs and triples of the training texts are counted;
nothing is left out however rare it is. The states are the root, every word and every pair of words seen; a text starts
in the state of an end. An arc leads from a state to the longest state that ends in the new token; its weight is the
smoothed probability

    p(w | ab) = (count(abw) + PRIOR[1] * p(w | b)) / (count(ab) + PRIOR[1])
    p(w | b)  = (count(bw) + PRIOR[0] * p(w)) / (count(b) + PRIOR[0])
    p(w)      = (count(w) + ADD) / (tokens + ADD * (types + 1))

and a token without an arc goes along the failure arc, of weight PRIOR / (count + PRIOR), to the state without its first
word. So the model sums to one in every state. A text is scored in one traversal from left to right.

The automaton grows with the corpus, so it is nowhere whole; counts lie in buckets by the n-gram's own hash, so that a
frequent context spreads over all of them. 1. ``sources``: runs of texts are tokenized once and written. 2. ``counted``:
a source sends its distinct n-grams and their training counts to the buckets, which add them up and answer each source;
an n-gram of a third of all texts is one row a source. 3. Each source builds the states and arcs that its texts meet and
traverses them. The number of buckets follows the number of tokens, so a task's size stays; words are told apart by 48
bits and their bucket, pairs and triples by 40. ``SOURCE`` is what an executor's memory allows: the larger a source, the
fewer and the larger are the rows that go to the buckets.

Null texts are empty texts: one end token. A text of any length is scored whole. Without training rows every token has
the unsmoothed probability 1 of an empty model (log 0). Rows that repeat a doc_id, or have none, are scored one by one;
those without are held out of neither part, so never learned from. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vidcohort.llm.common import cut, fold_remainder, give_back, partitions, read_table, tidy

ADD = 0.1
#: Weight, in occurrences, of the shorter context in the probability after a word and after a pair of words.
PRIOR = (1024.0, 4.0)
#: Characters that are tokenized at once, and that a source holds at most (a longer text is a source of its own).
CHUNK, SOURCE = 1 << 20, 1 << 22
#: Tokens for each bucket of n-grams; each brings up to three.
BUCKET_TOKENS = 300_000
#: Bits that tell words apart within a bucket, and pairs and triples.
WORD_BITS, GRAM_BITS = 48, 40
END = np.uint64(0x5EED0E9D0A11CE55)
BASE = 0x9E3779B97F4A7C15
_space = np.zeros(256, bool)
_space[[9, 10, 11, 12, 13, 32]] = True
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse, up to n."""
    if not _powers or len(_powers[0]) < n:
        n = max(n, CHUNK + (1 << 17))
        _powers[:] = [np.cumprod(np.append(np.uint64(1), np.full(n - 1, x, np.uint64))) for x in (BASE, pow(BASE, -1, 1 << 64))]
    return _powers[0], _powers[1]


def tokenize(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of the tokens of some texts, ends included."""
    data = [t.encode("utf-8", "surrogatepass").lower() for t in texts]
    raw = np.frombuffer(b"\n" + b"\n".join(data) + b"\n", np.uint8)
    blank = _space[raw]
    starts = np.flatnonzero(blank[:-1] & ~blank[1:]) + 1
    stops = np.flatnonzero(~blank[:-1] & blank[1:]) + 1
    up, down = powers(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], out=sums[1:])
    h = (sums[stops] - sums[starts]) * down[starts] + (stops - starts).astype(np.uint64)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    ends = np.cumsum([len(d) + 1 for d in data]) + 1
    of = np.searchsorted(ends, starts, side="right")
    words = np.bincount(of, minlength=len(texts))
    out, owner = np.full(len(h) + len(texts), END), np.repeat(np.arange(len(texts)), words + 1)
    out[np.arange(len(h)) + of] = h
    return out, owner


def chunked(texts, size: int = CHUNK):
    """(first, texts): consecutive texts, nulls as empty, about ``size`` characters at a time."""
    first, part, held = 0, [], 0
    for i, t in enumerate(texts):
        part.append(t if isinstance(t, str) else "")
        held += len(part[-1])
        if held >= size:
            yield first, part
            first, part, held = i + 1, [], 0
    if part:
        yield first, part


class Places:
    """Position of keys in a sorted array of distinct keys, or -1."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.append(keys, np.uint64(2**64 - 1))
        self.shift = np.uint64(64 - max(1, min(22, len(keys).bit_length() + 1)))
        self.head = np.searchsorted(keys, np.arange(1 << int(64 - self.shift), dtype=np.uint64) << self.shift)

    def find(self, h: np.ndarray) -> np.ndarray:
        at = self.head[h >> self.shift]
        while (low := self.keys[at] < h).any():
            at = at + low
        return np.where((self.keys[at] == h) & (at < len(self.keys) - 1), at, -1)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def planes(x: np.ndarray) -> bytes:
    """Numbers, none below zero, as bytes: how many each has, then the lowest byte of all, and so on; as most are small, this packs well."""
    width = max(1, -(-int(x.max(initial=0)).bit_length() // 8))
    return bytes([width]) + np.ascontiguousarray(x.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def read_planes(blob: bytes) -> np.ndarray:
    parts = np.frombuffer(blob, np.uint8, offset=1).reshape(blob[0], -1)
    out = np.zeros((parts.shape[1], 8), np.uint8)
    out[:, : len(parts)] = parts.T
    return out.view("<i8").ravel()


class Grams:
    """The distinct words, pairs and triples of a source, with their hashes and the place of each token's own.

    ``words`` has the hashes of the source's words and ``tokens`` the word of each token; ``starts`` are the first tokens
    of texts. A pair starts with the token before, at the start of a text with an end; a triple needs a token before that
    in the same text, or, at the second token, the end.
    """

    def __init__(self, words: np.ndarray, tokens: np.ndarray, starts: np.ndarray):
        n = len(words)
        end = int(np.flatnonzero(words == END)[0])
        before = np.roll(tokens, 1)
        before[starts] = end
        pair, self.pair = np.unique(before * n + tokens, return_inverse=True)
        triple, self.triple = np.unique(np.roll(self.pair, 1) * n + tokens, return_inverse=True)
        self.first = np.zeros(len(tokens), bool)  # a text's first token has no triple
        self.first[starts] = True
        self.word, self.before = tokens, before
        self.pair_before = np.roll(self.pair, 1)
        two = mixed(words[pair // n] * np.uint64(BASE) + words[pair % n] + np.uint64(2))
        three = mixed(two[triple // n] * np.uint64(BASE) + words[triple % n] + np.uint64(3))
        self.sizes = (n, len(pair), len(triple))
        self.hashes = np.concatenate([words, two, three])

    def counts(self, some: np.ndarray) -> np.ndarray:
        """How often each occurs at the tokens ``some``."""
        n, p, t = self.sizes
        parts = [(self.word, n, some), (self.pair, p, some), (self.triple, t, some & ~self.first)]
        return np.concatenate([np.bincount(at[use], minlength=size) for at, size, use in parts])

    def dealt(self, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(order, edges, keys): the n-grams by bucket, words first, each by its key, and the keys in that order."""
        to = (self.hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
        gram = np.arange(len(self.hashes)) >= self.sizes[0]
        keys = self.hashes & np.where(gram, np.uint64((1 << GRAM_BITS) - 1), np.uint64((1 << WORD_BITS) - 1))
        if buckets < 1 << 63 - WORD_BITS - 1:
            order = np.argsort(to << np.uint64(WORD_BITS + 1) | gram.astype(np.uint64) << np.uint64(WORD_BITS) | keys, kind="stable")
        else:
            order = np.lexsort((keys, gram, to))
        return order, np.searchsorted(to[order], np.arange(buckets + 1, dtype=np.uint64)), keys[order].astype(np.int64)

    def traverse(self, counts: np.ndarray, n: int, v: int) -> tuple[np.ndarray, np.ndarray]:
        """(log10 of the words' own probability, weight of the way) of each token, given the corpus counts of the n-grams.

        The state after a token is that of the longest of its n-grams that is known, so it is the last pair or word. All
        tokens take their steps at once: first the failure arcs of the states that have no arc, then the arcs.
        """
        one, two, three = np.split(counts.astype(float), np.cumsum(self.sizes)[:2])
        total = n + ADD * (v + 1)
        root = (one + ADD) / total
        after_word = (two[self.pair] + PRIOR[0] * root[self.word]) / (one[self.before] + PRIOR[0])
        context = np.where(self.first, 0.0, two[self.pair_before])
        after_pair = (np.where(self.first, 0.0, three[self.triple]) + PRIOR[1] * after_word) / (context + PRIOR[1])
        at_pair, at_word = context > 0, one[self.before] > 0
        arc3, arc2 = at_pair & ~self.first & (three[self.triple] > 0), at_word & (two[self.pair] > 0)
        own = np.log10(root)[self.word]
        way = np.where(arc3, np.log10(after_pair), 0.0)
        way += np.where(at_pair & ~arc3, np.log10(PRIOR[1] / (context + PRIOR[1])), 0.0)
        way += np.where(~arc3 & arc2, np.log10(after_word), 0.0)
        way += np.where(~arc3 & at_word & ~arc2, np.log10(PRIOR[0] / (one[self.before] + PRIOR[0])), 0.0)
        return own, way + np.where(~arc3 & ~arc2, own, 0.0)


SOURCES = "source long, n_tokens long, rows binary, lengths binary, learned binary, words binary, tokens binary"


def sources(docs: DataFrame) -> DataFrame:
    """One row a run of texts: ids (as text, nulls empty), tokens a text, which are learned from, word hashes, tokens as words."""

    def run(batches):
        source = TaskContext.get().partitionId() << 32  # the same again if the task is
        for b in batches:
            ids, learned = b["row"].to_numpy(), b["train"].to_numpy(bool)
            for first, part in chunked(b["text"], SOURCE):
                hashes, lengths = [], []
                for _, piece in chunked(part):
                    h, owner = tokenize(piece)
                    hashes.append(h)
                    lengths.append(np.bincount(owner, minlength=len(piece)))
                words, tokens, times = np.unique(np.concatenate(hashes), return_inverse=True, return_counts=True)
                order = np.argsort(-times, kind="stable")  # frequent words have small numbers
                place = np.empty(len(order), np.int64)
                place[order] = np.arange(len(order))
                end = first + len(part)
                source += 1
                yield pd.DataFrame({
                    "source": [source], "n_tokens": [len(tokens)], "rows": [",".join("" if i is None else i for i in ids[first:end]).encode()],
                    "lengths": [planes(np.concatenate(lengths))], "learned": [learned[first:end].tobytes()],
                    "words": [words[order].astype("<u8").tobytes()], "tokens": [planes(place[tokens])],
                })

    text = F.col("row").cast("long").cast("string").alias("row")  # numbers with nulls would turn into floats in Python
    return docs.select(text, F.col("text").cast("string").alias("text"), F.coalesce("train", F.lit(False)).alias("train")).mapInPandas(tidy(run), SOURCES)


def grams(words: bytes, tokens: bytes, lengths: bytes) -> tuple[Grams, np.ndarray]:
    """The n-grams of a source and the tokens a text."""
    size = read_planes(lengths)
    return Grams(np.frombuffer(words, "<u8"), read_planes(tokens), np.cumsum(size) - size), size


def counted(runs: DataFrame, buckets: int) -> DataFrame:
    """(source, bucket, counts, tokens, types): corpus counts of each source's n-grams of a bucket, in the source's order.

    A row without a source has the number of training tokens and of different ones of the bucket.
    """

    def send(batches):
        for b in batches:
            for source, words, tokens, lengths, learned in zip(b["source"], b["words"], b["tokens"], b["lengths"], b["learned"]):
                own, size = grams(words, tokens, lengths)
                times = own.counts(np.repeat(np.frombuffer(learned, bool), size))
                order, edges, keys = own.dealt(buckets)
                words_before = np.append(0, np.cumsum(order < own.sizes[0]))
                times = times[order]
                rows = []
                for k in np.flatnonzero(np.diff(edges)).tolist():
                    i, j = edges[k], edges[k + 1]  # in a bucket words come first
                    m = i + int(words_before[j] - words_before[i])
                    rows.append((k, source, planes(np.diff(keys[i:m], prepend=0)), planes(np.diff(keys[m:j], prepend=0)), planes(times[i:j])))
                yield pd.DataFrame(rows, columns=["bucket", "source", "words", "grams", "times"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        keys, times, words = [], [], []
        for first, second, own in zip(pdf["words"], pdf["grams"], pdf["times"]):
            first, second = np.cumsum(read_planes(first)), np.cumsum(read_planes(second))
            keys.append(np.append(first, second | 1 << 62))  # a word is never taken for another n-gram
            times.append(read_planes(own))
            words.append(np.arange(len(keys[-1])) < len(first))
        sizes = [len(k) for k in keys]
        keys, times, words = np.concatenate(keys), np.concatenate(times), np.concatenate(words)
        _, first, back = np.unique(keys, return_index=True, return_inverse=True)
        sums = np.bincount(back, weights=times).astype(np.int64)
        out = [(s, planes(x), 0, 0) for s, x in zip(pdf["source"], np.split(sums[back], np.cumsum(sizes)[:-1]))]
        own = sums[words[first]]
        out = pd.DataFrame([*out, (None, None, int(own.sum()), int((own > 0).sum()))], columns=["source", "counts", "tokens", "types"])
        give_back()
        return out.assign(bucket=int(pdf["bucket"].iloc[0])).astype({"source": "Int64"})

    sent = runs.select("source", "words", "tokens", "lengths", "learned").mapInPandas(tidy(send), "bucket int, source long, words binary, grams binary, times binary")
    return sent.groupBy("bucket").applyInPandas(add, "source long, bucket int, counts binary, tokens long, types long")


def score(docs: DataFrame) -> DataFrame:
    """(row, n_tokens, n_known, train_tokens, base_score, score) of ``docs`` (row, text, train), learning from the rows with train."""
    spark = docs.sparkSession
    runs = cut(sources(docs), "zstd")
    total = runs.agg(F.sum("n_tokens")).first()[0] or 0
    buckets = max(partitions(spark), -(-total // BUCKET_TOKENS))
    answers = cut(counted(runs, buckets), "zstd")
    n, v = answers.where("source is null").agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("types"), F.lit(0))).first()

    def finish(texts: pd.DataFrame, counts: pd.DataFrame) -> pd.DataFrame:
        t = texts.iloc[0]
        own, size = grams(t["words"], t["tokens"], t["lengths"])
        found = np.empty(len(own.hashes), np.int64)
        found[own.dealt(buckets)[0]] = np.concatenate([read_planes(x) for x in counts.sort_values("bucket")["counts"]])
        base, way = own.traverse(found, n, v)
        heads = np.cumsum(size) - size
        give_back()
        known = np.add.reduceat((found[own.word] > 0).astype(np.int64), heads)
        return pd.DataFrame({
            "row": t["rows"].decode().split(","), "n_tokens": size, "n_known": known,
            "base_score": np.add.reduceat(base, heads), "score": np.add.reduceat(way, heads),
        })

    kind = "row string, n_tokens long, n_known long, base_score double, score double"
    own = answers.where("source is not null").select("source", "bucket", "counts")
    out = runs.select("source", "rows", "lengths", "words", "tokens").groupBy("source").cogroup(own.groupBy("source")).applyInPandas(finish, kind)
    return out.withColumns({"row": F.nullif("row", F.lit("")).cast("long"), "train_tokens": F.lit(n).cast("long")})


def op9_lmscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every document."""
    docs = read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("row"), F.col("text").cast("string").alias("text"))
    fold = fold_remainder(F.col("row"), 10)
    held_out = (fold == 0).alias("held_out")
    return score(docs.withColumn("train", fold != 0)).select(F.col("row").alias("doc_id"), held_out, "n_tokens", "n_known", "train_tokens", "base_score", "score")
