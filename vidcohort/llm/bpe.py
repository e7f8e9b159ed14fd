"""Byte-level BPE: encoding and decoding with a published vocabulary.

A text is cut at the special tokens, then into pre-tokens by the vocabulary's pattern. The bytes of a
pre-token form a doubly linked list of symbols; a priority queue holds the ranks of the merges that
neighbours allow, lowest rank and leftmost first; entries whose symbols have changed since are
skipped. Decoding concatenates the vocabulary's byte strings. Repeated pre-tokens are taken from a
bounded cache of the worker. Null texts are empty texts; an empty text has no tokens. Every row is coded
by itself, whatever its id, repeats included; a text of any length is coded whole. An empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator
from itertools import chain, islice

import pandas as pd
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vidcohort.llm.common import give_back, read_table

#: Fixed value: the pre-token pattern of the byte-level vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CACHED_TOKENS, CACHED_LENGTH = 1 << 17, 48
#: Entries that a worker keeps from one task to the next.
KEPT_TOKENS = 1 << 16


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in the vocabulary file, to the byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Codec(dict):
    """Pre-token to ids; a missing key is encoded, and kept while there is room."""

    def __init__(self, file: str):
        super().__init__()
        with open(file, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        vocab = spec["model"]["vocab"]
        self.bytes = {i: bytes(letters[c] for c in token) for token, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes |= {i: t.encode() for t, i in self.special.items()}
        self.text = {i: str(i) for i in self.bytes}
        self.symbol = [0] * 256
        for c, b in letters.items():
            self.symbol[b] = vocab[c]
        self.merges = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges.setdefault(vocab[a] << 32 | vocab[b], (rank, vocab[a + b]))
        self.split = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")").split if self.special else None
        self.find = regex.compile(PATTERN).findall

    def __missing__(self, token: str) -> tuple[int, ...]:
        ids = self.merge(token.encode())
        if len(self) < CACHED_TOKENS and len(token) <= CACHED_LENGTH:
            self[token] = ids
        return ids

    def forget(self) -> None:
        """Drop all but the oldest ``KEPT_TOKENS`` entries, so that an idle worker holds little."""
        for token in list(islice(self, KEPT_TOKENS, None)):
            del self[token]

    def merge(self, data: bytes) -> tuple[int, ...]:
        symbol = [self.symbol[b] for b in data]
        n, merges = len(symbol), self.merges
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = []
        for i in range(n - 1):
            if m := merges.get(symbol[i] << 32 | symbol[i + 1]):
                queue.append((m[0], i, m[1]))
        heapq.heapify(queue)
        while queue:
            rank, i, made = heapq.heappop(queue)
            j = after[i]
            if symbol[i] < 0 or j >= n or merges.get(symbol[i] << 32 | symbol[j]) != (rank, made):
                continue  # stale: a neighbour was merged away
            symbol[i], symbol[j] = made, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if m := merges.get(made << 32 | symbol[k]):
                    heapq.heappush(queue, (m[0], i, m[1]))
            if (h := before[i]) >= 0 and (m := merges.get(symbol[h] << 32 | made)):
                heapq.heappush(queue, (m[0], h, m[1]))
        return tuple(s for s in symbol if s >= 0)

    def encode(self, text: str) -> list[int]:
        if self.split is None or not any(s in text for s in self.special):
            return list(chain.from_iterable(map(self.__getitem__, self.find(text))))
        ids: list[int] = []
        for part in self.split(text):
            if part in self.special:
                ids.append(self.special[part])
            elif part:
                ids.extend(chain.from_iterable(map(self.__getitem__, self.find(part))))
        return ids

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")


_codecs: dict[str, Codec] = {}


def codec(file: str) -> Codec:
    """The worker's codec of a vocabulary file."""
    if file not in _codecs:
        _codecs[file] = Codec(file)
    return _codecs[file]


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def coded(spark: SparkSession, docs: DataFrame, file: str | None = None) -> DataFrame:
    """doc_id and text of ``docs`` with tokens array<int> and decoded string."""
    name = _ship(spark, file)

    @F.pandas_udf("tokens array<int>, decoded string")
    def run(texts: pd.Series) -> pd.DataFrame:
        own = codec(SparkFiles.get(name))
        ids = [own.encode(t or "") for t in texts]
        return pd.DataFrame({"tokens": ids, "decoded": [own.decode(x) for x in ids]})

    return docs.select("doc_id", "text", run(F.col("text")).alias("coded")).select("doc_id", "text", "coded.*")


def _ship(spark: SparkSession, file: str | None) -> str:
    """Send the vocabulary file to the executors; its name there."""
    file = file or vocabulary()
    spark.sparkContext.addFile(file)
    return file.rsplit("/", 1)[-1]


def digests(spark: SparkSession, docs: DataFrame, file: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row of ``docs``.

    The ids are digested where they are made, so that they are not carried on as rows.
    """
    name = _ship(spark, file)

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = codec(SparkFiles.get(name))
        text = own.text.__getitem__
        for texts in parts:
            rows = []
            for t in texts:
                ids = own.encode(t or "")
                listed = ",".join(map(text, ids)).encode()
                rows.append((len(ids), hashlib.sha256(listed).hexdigest(), hashlib.sha256(own.decode(ids).encode()).hexdigest()))
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])
        own.forget()
        give_back()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), run(F.col("text").cast("string")).alias("x")).select("doc_id", "x.*")


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document."""
    return digests(spark, read_table(spark, sf_dir, "documents"))
