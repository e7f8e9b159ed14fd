"""Toxicity by non-negative positive-unlabelled learning.

Features of a text are its distinct words, and their first four and five bytes, hashed to a table of
``DIMS`` places. Confirmed toxic texts are the positives; unlabelled texts are all training texts,
whatever their label. Only features that are more frequent among the positives than chance explains,
by ``MIN_LIFT`` times at least, are used; they are compared with the negatives as they are estimated,
the unlabelled less the prior's share of the positives. A linear classifier is trained by Adam on the risk
``prior * R(P, +) + max(0, R(U, -) - prior * R(P, -))`` with the logistic loss; where the second part
goes below zero its gradient is reversed, which keeps a flexible model from fitting the positives that
hide among the unlabelled. The prior is the share of toxic texts among the labelled training texts.

The classifier is fitted on a bounded sample: about ``MAX_POSITIVE`` positives and ``MAX_UNLABELLED``
unlabelled texts, chosen by a hash of the id, in up to ``MAX_SHARDS`` shards that are trained in
parallel and averaged. Every text is scored, whole.

Null and empty texts have no feature and get the score of the bias. Without positives nothing is
learned and every score is the prior. A document with several labels is toxic if one of them says so.
Texts of any length are read whole, about a million characters at a time. Rows that repeat a doc_id
are scored one by one, and copies among the samples count once. Rows without doc_id are scored, with
held_out null, and never learned from. Without documents there is no row.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vidcohort.llm.common import fold_remainder, read_table, tidy
from vidcohort.llm.lmscore import powers

BITS = 20
DIMS = 1 << BITS
MAX_POSITIVE, MAX_UNLABELLED, MAX_SHARDS = 8_000, 24_000, 4
MIN_LIFT = 3.0
CHUNK = 1 << 20

_letter = np.zeros(256, bool)
_letter[ord("a") : ord("z") + 1] = True
_letter[128:] = True


def word_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) arrays, repeats included, over some texts."""
    data = [t.encode("utf-8", "surrogatepass").lower() for t in texts]
    ends = np.cumsum([len(d) + 1 for d in data])
    raw = np.frombuffer(b"\n".join(data) + b"\n" + bytes(8), np.uint8)
    inside = _letter[raw]
    starts = np.flatnonzero(inside[1:] & ~inside[:-1]) + 1
    if inside[0]:
        starts = np.append(0, starts)
    stops = np.flatnonzero(inside[:-1] & ~inside[1:]) + 1
    width = np.minimum(stops - starts, 8).astype(np.uint64)
    lead = np.ndarray(len(raw) - 7, "<u8", raw, strides=(1,))[starts] & (np.uint64(2**64 - 1) >> (np.uint64(64) - width * np.uint64(8)))
    up, down = powers(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], out=sums[1:])
    whole = (sums[stops] - sums[starts]) * down[starts] + (stops - starts).astype(np.uint64)
    owner = np.searchsorted(ends, starts, side="right")
    kinds = (lead & np.uint64(0xFFFFFFFF), lead & np.uint64(0xFFFFFFFFFF), whole)
    mixed = [((k + np.uint64(i + 1)) * np.uint64(0x9E3779B97F4A7C15)) for i, k in enumerate(kinds)]
    mixed = [((m ^ (m >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - BITS) for m in mixed]
    return np.tile(owner, 3), np.concatenate(mixed).astype(np.int64)


def chunks(texts):
    """(positions, texts), about ``CHUNK`` characters at a time; nulls and empty texts are left out."""
    at, part, size = [], [], 0
    for i, t in enumerate(texts):
        if isinstance(t, str) and t:
            at.append(i)
            part.append(t)
            size += len(t)
            if size >= CHUNK:
                yield np.array(at), part
                at, part, size = [], [], 0
    if at:
        yield np.array(at), part


def fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, epochs: int = 300) -> tuple[np.ndarray, np.ndarray, float]:
    """(features, weights, bias) of one classifier."""
    n_p, n_u = len(positive), len(unlabelled)
    in_p = np.bincount(np.concatenate([*positive, np.zeros(0, np.int64)]), minlength=DIMS)
    in_u = np.bincount(np.concatenate([*unlabelled, np.zeros(0, np.int64)]), minlength=DIMS)
    among_u, among_p = (in_u + 0.5) / (n_u + 1), in_p / n_p
    among_n = np.maximum((among_u - prior * among_p) / (1 - prior), 0.5 / (n_u + 1))
    expected = n_p * among_n
    lift = in_p / expected
    # Chernoff bound on so many positives by chance, for as many features as were seen
    chance = in_p * np.log(np.maximum(lift, 1)) - in_p + expected
    used = np.flatnonzero((lift >= MIN_LIFT) & (chance >= np.log(max(2, (in_p > 0).sum()))))
    place = np.full(DIMS, -1)
    place[used] = np.arange(len(used))

    def sparse(rows):
        row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        col = place[np.concatenate([*rows, np.zeros(0, np.int64)])]
        return row[col >= 0], col[col >= 0]

    (pr, pc), (ur, uc) = sparse(positive), sparse(unlabelled)
    w, bias = np.zeros(len(used)), np.log(prior / (1 - prior))
    m, v = np.zeros(len(used) + 1), np.zeros(len(used) + 1)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    for step in range(1, epochs + 1):
        zp = np.bincount(pr, weights=w[pc], minlength=n_p) + bias
        zu = np.bincount(ur, weights=w[uc], minlength=n_u) + bias
        sp, su = sigmoid(zp), sigmoid(zu)
        rest = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        turn = 1.0 if rest >= 0 else -1.0
        gp = prior * (sp - 1) / n_p if turn > 0 else np.zeros(n_p)
        gp = gp - turn * prior * sp / n_p
        gu = turn * su / n_u
        g = np.append(
            np.bincount(pc, weights=gp[pr], minlength=len(used)) + np.bincount(uc, weights=gu[ur], minlength=len(used)) + 1e-5 * w,
            gp.sum() + gu.sum(),
        )
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
        w, bias = w - move[:-1], bias - move[-1]
    return used, w, float(bias)


def sample_features(docs: DataFrame) -> DataFrame:
    """(shard_key, toxic, features) of the sampled texts."""

    def run(batches):
        for b in batches:
            toxic = b["toxic"].to_numpy()
            for at, part in chunks(b["text"]):
                owner, f = word_features(part)
                key = np.unique(owner * DIMS + f)
                cuts = np.searchsorted(key, np.arange(len(part) + 1) * DIMS)
                yield pd.DataFrame({"toxic": toxic[at], "features": [(key[i:j] % DIMS).astype(np.int32) for i, j in zip(cuts[:-1], cuts[1:])]})

    return docs.select("text", "toxic").mapInPandas(tidy(run), "toxic boolean, features array<int>")


def train(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, float]:
    """Weights of all places and the bias, from training documents (doc_id, text) and labels (doc_id, toxic)."""
    marks = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg((F.max("toxic") == 1).alias("toxic"))
    marks = marks.where(fold_remainder(F.col("doc_id"), 5) != 0)
    known, toxic = marks.agg(F.count("*"), F.sum(F.col("toxic").cast("int"))).first()
    prior = min(0.5, max(1e-3, (toxic or 0) / known)) if known else 1e-3
    if not toxic:
        return np.zeros(DIMS, np.float32), float(np.log(prior / (1 - prior)))
    docs = docs.where(fold_remainder(F.col("doc_id"), 5) != 0).select("doc_id", "text")
    total = docs.count()
    draw = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 30)) / float(1 << 30)
    drawn = marks.where("toxic").where(draw < MAX_POSITIVE / toxic)  # about MAX_POSITIVE ids at most
    hits = docs.join(F.broadcast(drawn), "doc_id")
    rest = docs.where(draw < MAX_UNLABELLED / max(1, total)).withColumn("toxic", F.lit(False))
    rows = sample_features(hits.unionByName(rest))
    rows = rows.withColumn("key", F.xxhash64("features")).dropDuplicates(["toxic", "key"])  # copies count once
    shards = max(1, min(MAX_SHARDS, toxic // 1000))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        is_p = pdf["toxic"].to_numpy(bool)
        rows = [np.asarray(f, np.int64) for f in pdf["features"]]
        p, u = [r for r, x in zip(rows, is_p) if x], [r for r, x in zip(rows, is_p) if not x]
        if not p or not u:
            return pd.DataFrame({"features": [[]], "weights": [[]], "bias": [np.log(prior / (1 - prior))]})
        used, w, bias = fit(p, u, prior)
        return pd.DataFrame({"features": [used.tolist()], "weights": [w.tolist()], "bias": [bias]})

    kind = "features array<int>, weights array<double>, bias double"
    models = rows.withColumn("shard", F.pmod("key", F.lit(shards))).groupBy("shard").applyInPandas(one, kind).collect()  # DIMS bounds a row
    weights = np.zeros(DIMS, np.float32)
    for x in models:
        weights[np.array(x["features"], np.int64)] += np.array(x["weights"], np.float32) / len(models)
    return weights, float(np.mean([x["bias"] for x in models])) if models else float(np.log(prior / (1 - prior)))


def score_texts(texts, weights: np.ndarray, bias: float) -> np.ndarray:
    logit = np.full(len(texts), bias)
    used = weights != 0
    for at, part in chunks(texts):
        owner, f = word_features(part)
        some = used[f]
        key = np.unique(owner[some] * DIMS + f[some])
        logit[at] += np.bincount(key // DIMS, weights=weights[key % DIMS], minlength=len(part))
    return 1 / (1 + np.exp(-np.clip(logit, -40, 40)))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and prediction of every document."""
    docs = read_table(spark, sf_dir, "documents")
    model = spark.sparkContext.broadcast(train(docs, read_table(spark, sf_dir, "labels")))  # DIMS floats

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(score_texts(texts, *model.value))

    out = docs.select("doc_id", (fold_remainder(F.col("doc_id"), 5) == 0).alias("held_out"), score("text").alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
