"""Benchmark decontamination by latent semantic retrieval.

1. How rare the benchmark's words are is counted over all documents: not by documents, of which many
   may be copies, but by distinct contexts (the words before and after), estimated by registers that
   merge by maximum. A passage that stands in a third of all documents counts once.
2. Passages (24 words, one every 12) of a bounded sample of documents and of all benchmark items form a
   TF-IDF matrix; a randomised SVD of it is taken with distributed products (each task multiplies its
   own passages, the driver sums one words-by-rank matrix a task), which gives a latent space.
3. Every passage of every document is weighed. One with less than ``MIN_ENERGY`` of its weight in
   benchmark words cannot be mostly of an item. The rest is projected and compared with all passages of
   the benchmark: the cosine, relative to what the item's passage itself would get in this space.
   Those at ``MIN_COSINE`` or more are candidates. Items shorter than a block (12 words) are too small a
   part of a passage for that; their candidates are the passages with enough of their words.
4. For a candidate the longest common subsequence of the item's words with the words around the
   passage is taken, unless too few of the item's words are there at all. A document is contaminated by
   an item if ``MIN_LCS`` of the item's words are found in order, or ``MIN_LCS_ANSWER`` of them and the
   item's answer, its last sentence, word for word; for items shorter than a block, within a stretch of
   twice the item's length.

The benchmark is handled in blocks of about ``BLOCK`` items or ``BLOCK_CHARS`` characters, so what is collected and
broadcast is bounded by that (and by the longest item) and not by the benchmark. Words are runs of letters and digits, A-Z lower-cased. Null and empty
texts and items, and items under ``MIN_WORDS`` words, never match. Rows that repeat an id are judged
one by one, and so are rows without an id. If several places of a document match an item, the best counts. Texts are
searched whole, about a million characters at a time and a longer text by itself. Without documents or without items
nothing is found.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vidcohort.llm.common import cut, drop_cut, read_table, tidy
from vidcohort.llm.lmscore import Places, chunked, powers

STEP, WINDOW = 12, 2  # words a block, blocks a passage
RANK, ROUNDS = 320, 2
REGISTERS = 16
MIN_WORDS = 5
MIN_ENERGY, MIN_COSINE = 0.3, 0.4
MIN_LCS, MIN_LCS_ANSWER = 0.75, 0.5
SAMPLE_DOCS, SAMPLE_TASKS = 1_000, 4
#: How much more than the sample the benchmark's passages weigh in the latent space.
OWN_SHARE = 4.0
BLOCK, BLOCK_CHARS = 2_000, 1_000_000
#: Blocks of the benchmark that one pass over the documents looks for.
TOGETHER = 4
#: Passages that are weighed or multiplied at once.
PASSAGES = 512

_word = np.zeros(256, bool)
_word[128:] = True
_word[ord("0") : ord("9") + 1] = True
_word[ord("a") : ord("z") + 1] = True


def words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of the words of some texts."""
    data = [t.encode("utf-8", "surrogatepass").lower() for t in texts]
    raw = np.frombuffer(b"\n" + b"\n".join(data) + b"\n", np.uint8)
    inside = _word[raw]
    starts = np.flatnonzero(~inside[:-1] & inside[1:]) + 1
    stops = np.flatnonzero(inside[:-1] & ~inside[1:]) + 1
    up, down = powers(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], out=sums[1:])
    h = (sums[stops] - sums[starts]) * down[starts] + (stops - starts).astype(np.uint64)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    ends = np.cumsum([len(d) + 1 for d in data]) + 1
    return h ^ (h >> np.uint64(29)), np.searchsorted(ends, starts, side="right")


def passages(owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, last) token of the passages of the texts that the tokens belong to."""
    n = len(owner)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    head = np.flatnonzero(np.diff(owner, prepend=owner[0] - 1))
    size = np.diff(np.append(head, n))
    count = np.maximum(1, -(-size // STEP) - WINDOW + 1)
    text = np.repeat(np.arange(len(head)), count)
    first = head[text] + (np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)) * STEP
    return first, np.minimum(first + STEP * WINDOW, (head + size)[text])


def matrix(first: np.ndarray, last: np.ndarray, places: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Sum of the rows of ``table`` of each passage's words; its last row, of words that are not in it, is zero."""
    if not len(first):
        return np.zeros((0, table.shape[1]), table.dtype)
    size = last - first
    at = np.repeat(first - np.cumsum(size) + size, size) + np.arange(size.sum())
    return np.add.reduceat(table[places[at]], np.cumsum(size) - size, axis=0)


def lcs(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, by bit rows."""
    at: dict[int, int] = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for y in b:
        u = row & at.get(y, 0)
        row = ((row + u) | (row - u)) & full
    return len(a) - row.bit_count()


class Retrieval:
    """A block of the benchmark in latent space."""

    def __init__(self, ids: list[int], texts: list[str]):
        keep = [(i, t) for i, t in zip(ids, texts) if t and len(words([t])[0]) >= MIN_WORDS]
        self.ids = [i for i, _ in keep]
        self.items = [words([t])[0].tolist() for _, t in keep]
        self.answers = []
        for (_, t), own in zip(keep, self.items):
            ends = [s for s in t.rstrip(" \n.!?").replace("!", ".").replace("?", ".").replace("\n", ".").split(".") if s.strip()]
            answer = words([ends[-1]])[0].tolist() if ends else []
            self.answers.append(answer if 2 <= len(answer) < len(own) else own[-5:])
        flat, owner = words([t for _, t in keep]) if keep else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        self.vocabulary = Places(np.unique(flat))
        self.size = len(self.vocabulary.keys) - 1
        self.flat = self.vocabulary.find(flat)
        self.first, self.last = passages(owner)
        self.item_of = owner[self.first] if len(self.first) else owner
        self.item_words = owner
        # the short items that each word of the vocabulary is in, and how often
        short = np.array([len(x) < STEP for x in self.items], bool)
        key, times = np.unique((self.flat * len(keep) + owner)[short[owner]], return_counts=True)
        self.short_item, self.short_times = key % max(1, len(keep)), times
        self.short_head = np.searchsorted(key // max(1, len(keep)), np.arange(self.size + 1))

    def weigh(self, contexts: np.ndarray, docs: int) -> None:
        """Weights of the words from their rarity in the corpus and in the benchmark; words outside the
        benchmark get that of its rarer quarter."""
        items = np.bincount(np.unique(self.item_words * self.size + self.flat) % self.size, minlength=self.size)
        corpus = np.maximum(np.log((1 + docs) / (0.5 + contexts)), 0.3)
        own = np.sqrt(corpus * np.log(1 + len(self.ids) / items))
        self.weight = np.append(own, np.quantile(own, 0.75))

    def energy(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Running sums of the weight of benchmark words and of all."""
        w = np.square(self.weight[places])
        return np.append(0, np.cumsum(np.where(places >= 0, w, 0))), np.append(0, np.cumsum(w))

    def set_space(self, basis: np.ndarray) -> None:
        self.table = np.vstack([basis * self.weight[:-1, None], np.zeros(basis.shape[1])]).astype(np.float32)
        own = matrix(self.first, self.last, self.flat, self.table)
        inside = self.energy(self.flat)[0]
        size = np.sqrt(inside[self.last] - inside[self.first])
        self.index = (own * (size / np.maximum(np.square(own).sum(axis=1), 1e-9))[:, None]).astype(np.float32)

    def candidates(self, texts: list[str]):
        """(text, item, cosine, words around, ...) of the passages near an item."""
        h, owner = words(texts)
        places = self.vocabulary.find(h)
        first, last = passages(owner)
        heads = np.searchsorted(owner, np.arange(len(texts) + 1))
        for p, item, share in self.short_candidates(places, first, last):
            text = int(owner[first[p]])
            yield text, item, share, h, int(first[p]), int(last[p]), int(heads[text]), int(heads[text + 1])
        inside, everything = self.energy(places)
        some = inside[last] - inside[first] >= MIN_ENERGY * (everything[last] - everything[first])
        first, last = first[some], last[some]
        for i in range(0, len(first), PASSAGES):
            f, l = first[i : i + PASSAGES], last[i : i + PASSAGES]
            own = matrix(f, l, places, self.table)
            own = (own / np.sqrt(np.maximum(inside[l] - inside[f], 1e-9))[:, None]).astype(np.float32)
            cosine = own @ self.index.T
            p, q = np.nonzero(cosine >= MIN_COSINE)
            for a, b in zip(p.tolist(), q.tolist()):
                text = int(owner[f[a]])
                yield text, int(self.item_of[b]), float(cosine[a, b]), h, int(f[a]), int(l[a]), int(heads[text]), int(heads[text + 1])

    def short_candidates(self, places: np.ndarray, first: np.ndarray, last: np.ndarray):
        """(passage, item, cosine) of the passages that have enough words of an item shorter than a block.

        Such an item is too small a part of a passage for the gates of the latent space; the cosine is that
        of the item and its own words in the passage.
        """
        if not len(self.short_item):
            return
        weight = np.square(self.weight)
        n_items = len(self.items)
        energy = np.zeros(n_items)
        word = np.repeat(np.arange(self.size), np.diff(self.short_head))
        np.add.at(energy, self.short_item, weight[word] * self.short_times)
        length = np.array([len(x) for x in self.items])
        for i in range(0, len(first), 512):
            f, l = first[i : i + 512], last[i : i + 512]
            size = l - f
            at = np.repeat(f - np.cumsum(size) + size, size) + np.arange(size.sum())
            of = np.repeat(np.arange(len(f)), size)[places[at] >= 0]
            key = np.unique(of * self.size + places[at][places[at] >= 0])  # a word counts once a passage
            of, word = key // self.size, key % self.size
            count = self.short_head[word + 1] - self.short_head[word]
            post = np.repeat(self.short_head[word] - np.cumsum(count) + count, count) + np.arange(count.sum())
            pair, back = np.unique(np.repeat(of, count) * n_items + self.short_item[post], return_inverse=True)
            there = np.bincount(back, weights=self.short_times[post], minlength=len(pair))
            share = np.bincount(back, weights=weight[np.repeat(word, count)] * self.short_times[post], minlength=len(pair))
            enough = np.flatnonzero(there >= MIN_LCS_ANSWER * length[pair % n_items])
            for k in enough.tolist():
                item = int(pair[k] % n_items)
                yield i + int(pair[k] // n_items), item, float(np.sqrt(share[k] / energy[item]))

    def matches(self, texts: list[str]) -> list[dict[int, tuple[float, float, bool]]]:
        """For each text, the items it contains with cosine, share of the item found in order, and answer found."""
        found: list[dict[int, tuple[float, float, bool]]] = [{} for _ in texts]
        for text, item, cosine, h, first, last, start, stop in self.candidates(texts):
            own = self.items[item]
            if found[text].get(item, (0, 0.0))[1] == 1.0:
                continue
            around = h[max(start, first - len(own)) : min(stop, last + len(own))].tolist()
            there = set(around)
            if sum(x in there for x in own) < MIN_LCS_ANSWER * len(own):
                continue  # a common subsequence is no longer than the words in common
            if len(own) < STEP:  # few words are in order by chance in a long stretch
                n = len(own)
                stretches = [around[i : i + 2 * n] for i in range(0, max(1, len(around) - n), n)]
                around = max(stretches, key=lambda x: lcs(own, x))
            share = lcs(own, around) / len(own)
            if share < MIN_LCS_ANSWER:
                continue
            answer = self.answers[item]
            n = len(answer)
            said = any(around[i : i + n] == answer for i in range(len(around) - n + 1))
            if (share >= MIN_LCS or said) and share > found[text].get(item, (0, 0.0))[1]:
                found[text][item] = (cosine, share, said)
        return found


def context_counts(docs: DataFrame, model: Retrieval) -> tuple[np.ndarray, int]:
    """In about how many different contexts each benchmark word stands, and the number of documents.

    A context's hash picks a register of the word, which keeps the largest number of leading zeros seen.
    """
    vocabulary, size = model.vocabulary, model.size

    def run(batches):
        ranks, n = np.zeros(size * REGISTERS, np.int8), 0
        for b in batches:
            for _, part in chunked(b["text"]):
                h, owner = words(part)
                n += len(part)
                at = vocabulary.find(h)
                some = np.flatnonzero(at >= 0)
                if not len(some):
                    continue
                before = np.where(some > 0, h[some - 1], 0) * (owner[some - 1] == owner[some])
                after = np.append(h, np.uint64(0))[some + 1] * (np.append(owner, -1)[some + 1] == owner[some])
                x = (before * np.uint64(3) + after) * np.uint64(0x9E3779B97F4A7C15)
                x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
                zeros = 61 - np.frexp(((x >> np.uint64(4)) | np.uint64(1)).astype(float))[1]
                np.maximum.at(ranks, at[some] * REGISTERS + (x % np.uint64(REGISTERS)).astype(np.int64), zeros.astype(np.int8))
        seen = np.flatnonzero(ranks)
        yield pd.DataFrame({"register": np.append(seen, -1), "rank": np.append(ranks[seen].astype(np.int64), n)})

    sent = docs.select("text").mapInPandas(tidy(run), "register long, rank long").groupBy("register")
    rows = sent.agg(F.max("rank").alias("rank"), F.sum("rank").alias("n")).toPandas()  # REGISTERS rows a word
    ranks, total = np.zeros(size * REGISTERS), 0
    for register, rank, n in zip(rows["register"], rows["rank"], rows["n"]):
        if register < 0:
            total = int(n)
        else:
            ranks[register] = rank
    ranks = ranks.reshape(size, REGISTERS)
    estimate = 0.673 * REGISTERS**2 / (2.0**-ranks).sum(axis=1)
    empty = (ranks == 0).sum(axis=1)
    few = REGISTERS * np.log(REGISTERS / np.maximum(empty, 1))
    return np.where((estimate <= 2.5 * REGISTERS) & (empty > 0), few, estimate), total


def sampled(docs: DataFrame) -> DataFrame:
    """The texts of about ``SAMPLE_DOCS`` documents."""
    draw = F.pmod(F.xxhash64("text", F.lit("passages")), F.lit(1 << 30)) / float(1 << 30)
    return cut(docs.select("text").where(draw < SAMPLE_DOCS / max(1, docs.count())).repartition(SAMPLE_TASKS))


def latent_space(sample: DataFrame, model: Retrieval) -> np.ndarray:
    """Right singular vectors of the passages of sampled documents (text) and of the benchmark."""
    rank = min(RANK, model.size)

    def unit(rows, first, last, places):
        inside = model.energy(places)[0]
        return rows / np.sqrt(np.maximum(inside[last] - inside[first], 1))[:, None]

    def product(places, first, last, basis):
        """Gram product of the passages with ``basis``, ``PASSAGES`` of them at a time, and their number."""
        wide = np.vstack([basis * model.weight[:-1, None], np.zeros(basis.shape[1])]).astype(np.float32)
        out = np.zeros(basis.shape, np.float32)
        for i in range(0, len(first), PASSAGES):
            f, l = first[i : i + PASSAGES], last[i : i + PASSAGES]
            y = unit(unit(matrix(f, l, places, wide), f, l, places), f, l, places).astype(np.float32)
            size = l - f
            at = np.repeat(f - np.cumsum(size) + size, size) + np.arange(size.sum())
            row, word = np.repeat(np.arange(len(f)), size), places[at]
            order = np.argsort(word, kind="stable")
            order = order[np.searchsorted(word[order], 0) :]
            if len(order):
                word = word[order]
                head = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
                out[word[head]] += np.add.reduceat(y[row[order]], head, axis=0) * model.weight[word[head], None].astype(np.float32)
        return out, len(first)

    basis = np.linalg.qr(np.random.default_rng(5).standard_normal((model.size, rank)))[0]
    for _ in range(ROUNDS):

        def run(batches, basis=basis):
            out, energy = np.zeros(basis.shape, np.float32), 0.0
            for b in batches:
                for _, part in chunked(b["text"]):
                    h, owner = words(part)
                    first, last = passages(owner)
                    o, e = product(model.vocabulary.find(h), first, last, basis)
                    out, energy = out + o, energy + e
            yield pd.DataFrame({"out": [out.astype("<f4").tobytes()], "energy": [energy]})

        own, energy = product(model.flat, model.first, model.last, basis)
        parts = sample.mapInPandas(tidy(run), "out binary, energy double").collect()  # SAMPLE_TASKS matrices
        rest = sum(np.frombuffer(p["out"], "<f4").reshape(basis.shape).astype(float) for p in parts)
        scale = OWN_SHARE * max(1.0, sum(p["energy"] for p in parts)) / max(1.0, energy)
        basis = np.linalg.qr(own * scale + rest)[0]
    return basis


def models(spark: SparkSession, docs: DataFrame, benchmark: DataFrame):
    """A retrieval model, as a broadcast, for each block of the benchmark."""
    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    n, chars = items.agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    blocks = max(1, -(-n // BLOCK), -(-chars // BLOCK_CHARS))
    sample = sampled(docs) if n else None
    for k in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).orderBy("item_id", "text").toPandas()
        model = Retrieval(part["item_id"].tolist(), part["text"].tolist())
        if model.size:
            model.weigh(*context_counts(docs, model))
            model.set_space(latent_space(sample, model))
            yield spark.sparkContext.broadcast(model)
    if sample is not None:
        drop_cut(sample)


def contaminated(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, cosine, lcs, answer) of the documents (doc_id, text) that contain a benchmark item.

    ``TOGETHER`` blocks of the benchmark are looked for in one pass over the documents.
    """
    # ids go through Python as text, where nulls would turn numbers into floats
    docs = docs.select(F.col("doc_id").cast("long").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"))
    kind = "doc_id string, item_id long, cosine double, lcs double, answer boolean"
    out = spark.createDataFrame([], kind)
    found = list(models(spark, docs, benchmark))
    for k in range(0, len(found), TOGETHER):

        def run(batches, own=found[k : k + TOGETHER]):
            for b in batches:
                ids = b["doc_id"].to_numpy()
                rows = []
                for first, part in chunked(b["text"]):
                    for model in own:
                        for j, hits in enumerate(model.value.matches(part)):
                            rows += [(ids[first + j], model.value.ids[item], *x) for item, x in hits.items()]
                yield pd.DataFrame(rows, columns=["doc_id", "item_id", "cosine", "lcs", "answer"])

        out = out.unionByName(docs.mapInPandas(tidy(run), kind))
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))


def keep_clean(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that contain no benchmark item."""
    for model in models(spark, docs, benchmark):
        docs = docs.where(_clean(model)("text"))
    return docs


def _clean(model):
    @F.pandas_udf("boolean")
    def clean(texts: pd.Series) -> pd.Series:
        out = np.ones(len(texts), bool)
        for first, part in chunked(texts):
            out[first : first + len(part)] = [not x for x in model.value.matches(part)]
        return pd.Series(out)

    return clean


def op4_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item."""
    return contaminated(spark, read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
