"""Contrast of a subject's features with what is dominant among top and lower performers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vidcohort.functions import rules as r
from vidcohort.functions import text as t
from vidcohort.operators.features import FEATURES, UNKNOWN

DESCRIPTIVE = ["dominant_lighting", "dominant_color_feel"]
SIGNALS = ["aligned_with_top", "risk_signal", "missing_winning_feature"]


def dominant_values(rows: DataFrame) -> DataFrame:
    """(subject_id, grp, feature, value, count, total, is_dominant) from rows (subject_id, grp, pos, feature, value).

    The value that most known values have, the first by pos if tied; it is dominant if it was seen twice
    and no other as often. Groups without a known value are left out.
    """
    known = rows.where(F.col("value") != UNKNOWN)
    counts = known.groupBy("subject_id", "grp", "feature", "value").agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    by = Window.partitionBy("subject_id", "grp", "feature")
    order = by.orderBy(F.desc("n"), "first")
    ranked = counts.withColumns({"place": F.row_number().over(order), "next": F.lead("n").over(order), "total": F.sum("n").over(by)})
    tied = F.coalesce(F.col("next") == F.col("n"), F.lit(False))
    return ranked.where("place = 1").select("subject_id", "grp", "feature", "value", F.col("n").alias("count"), "total", ((F.col("n") >= 2) & ~tied).alias("is_dominant"))


def evidence(group: str, value: Column, count: Column, total: Column, dominant: Column) -> Column:
    say = lambda k: t.fill(r.EVIDENCE[k], group=F.lit(group), value=value, count=count.cast("string"), total=total.cast("string"))
    return F.when(total == 0, say("none")).when(~dominant, say("unclear")).otherwise(say("clear"))


def status(descriptive: Column, user: Column, top: Column, top_dominant: Column, lower: Column, lower_dominant: Column) -> Column:
    none = "insufficient_evidence"
    return (
        F.when(user == UNKNOWN, none)
        .when(descriptive & top_dominant, F.when(user == top, "observed_alignment").otherwise("observed_difference"))
        .when(descriptive | ~top_dominant | ~lower_dominant, none)
        .when(top == lower, "non_discriminative")
        .when(user == top, "aligned_with_top")
        .when(user == lower, "risk_signal")
        .otherwise("missing_winning_feature")
    )


def _named() -> dict[str, Column]:
    """What the texts of a row of the contrast are filled with."""
    return {"label": F.col("label"), "user": F.col("user_value"), "top": F.col("top_dominant_value"), "lower": F.col("lower_dominant_value")}


def explanation() -> Column:
    c = F.col
    say = lambda k: t.fill(r.EXPLANATION[k], **_named())
    told = lambda out, k: out.when(c("status") == k, say(k))
    out = F.when(c("user_value") == UNKNOWN, say("unknown"))
    out = told(told(out, "observed_alignment"), "observed_difference")
    out = out.when(~c("top_is_dominant"), say("no_top")).when(~c("descriptive") & ~c("lower_is_dominant"), say("no_lower"))
    for k in ("non_discriminative", *SIGNALS):
        out = told(out, k)
    return out.otherwise(say("other"))


def feature_contrast(users: DataFrame, dominants: DataFrame) -> DataFrame:
    """A row for each subject and feature from users (subject_id, feature, value) and dominant values.

    The users' long table already has every feature of every subject, so both groups are left joins.
    """
    def side(grp):
        picked = {f"{grp}_dominant_value": "value", f"{grp}_evidence_count": "count", f"{grp}_evidence_total": "total", f"{grp}_is_dominant": "is_dominant"}
        return dominants.where(F.col("grp") == grp).select("subject_id", "feature", *[F.col(c).alias(n) for n, c in picked.items()])

    rows = users.select("subject_id", "feature_ord", "feature", F.col("value").alias("user_value"))
    for grp in ("top", "lower"):
        rows = rows.join(side(grp).hint("merge"), ["subject_id", "feature"], "left")
        rows = rows.withColumns({
            f"{grp}_dominant_value": F.coalesce(f"{grp}_dominant_value", F.lit(UNKNOWN)), f"{grp}_evidence_count": F.coalesce(f"{grp}_evidence_count", F.lit(0)),
            f"{grp}_evidence_total": F.coalesce(f"{grp}_evidence_total", F.lit(0)), f"{grp}_is_dominant": F.coalesce(f"{grp}_is_dominant", F.lit(False)),
        })
    labels = F.create_map(*[F.lit(x) for pair in FEATURES for x in pair])
    rows = rows.withColumns({"label": labels[F.col("feature")], "descriptive": F.col("feature").isin(DESCRIPTIVE)})
    for grp, name in (("top", "Top benchmarks"), ("lower", "Lower benchmarks")):
        rows = rows.withColumn(f"{grp}_evidence", evidence(name, *[F.col(f"{grp}_{c}") for c in ("dominant_value", "evidence_count", "evidence_total", "is_dominant")]))
    rows = rows.withColumn("status", status(F.col("descriptive"), F.col("user_value"), F.col("top_dominant_value"), F.col("top_is_dominant"), F.col("lower_dominant_value"), F.col("lower_is_dominant")))
    rows = rows.withColumn("explanation", explanation())
    return rows.select(
        "subject_id", "feature_ord", "feature", "label", "user_value", "top_dominant_value", "top_evidence_count", "top_evidence_total", "top_evidence",
        "lower_dominant_value", "lower_evidence_count", "lower_evidence_total", "lower_evidence", "status", "explanation",
    )


def recommended() -> Column:
    """Whether a row of the contrast gives a suggestion."""
    return F.col("status").isin("missing_winning_feature", "risk_signal")


def suggestion() -> list[Column]:
    """The columns of a suggestion, from a row of the contrast."""
    return [F.col("feature_ord"), *[t.fill(template, **_named()).alias(name) for name, template in r.SUGGESTION.items()]]


def recommendations(contrast: DataFrame) -> DataFrame:
    """A suggestion for each feature that a subject misses or that speaks against it."""
    return contrast.where(recommended()).select("subject_id", *suggestion())


def confidence(subjects: DataFrame, members: DataFrame, contrast: DataFrame) -> DataFrame:
    """(subject_id, top_count, lower_count, n_top, n_lower, usable, aligned, missing, risks, confidence, confidence_reason).

    ``members`` has subject_id, grp and status; failed ones count in n_top and n_lower only. The contrast is grouped once, for this and for the verdict.
    """
    fine = F.coalesce("status", F.lit("")) != "failed"
    sides = [(g, F.col("grp") == g) for g in ("top", "lower")]
    n = members.groupBy("subject_id").agg(*[F.count_if(x & fine).alias(f"{g}_count") for g, x in sides], *[F.count_if(x).alias(f"n_{g}") for g, x in sides])
    of = lambda *kinds: F.count_if(F.col("status").isin(*kinds))
    counts = contrast.groupBy("subject_id").agg(
        of(*SIGNALS).alias("usable"), of("aligned_with_top").alias("aligned"), of("missing_winning_feature").alias("missing"), of("risk_signal").alias("risks"),
    )
    rows = subjects.select("subject_id").join(n.hint("merge"), "subject_id", "left").join(counts.hint("merge"), "subject_id", "left")
    rows = rows.fillna(0, ["top_count", "lower_count", "n_top", "n_lower", "usable", "aligned", "missing", "risks"])
    t, low, u = F.col("top_count"), F.col("lower_count"), F.col("usable")
    level = F.when((t >= 3) & (low >= 3) & (u >= 2), "moderate").when((t >= 2) & (low >= 2) & (u >= 1), "limited").otherwise("low")
    reasons = F.create_map(*[F.lit(x) for pair in r.CONFIDENCE.items() for x in pair])
    return rows.withColumn("confidence", level).withColumn("confidence_reason", reasons[F.col("confidence")])


def verdict(levels: DataFrame) -> DataFrame:
    """(subject_id, aligned, missing, risks, final_verdict) from the table of ``confidence``."""
    say = lambda k: t.fill(r.VERDICT[k], **{c: F.col(c).cast("string") for c in ("risks", "missing", "aligned")})
    text = F.when(F.col("confidence") == "low", say("low"))
    for k in ("risks", "missing", "aligned"):
        text = text.when(F.col(k) > 0, say(k))
    return levels.select("subject_id", "aligned", "missing", "risks", text.otherwise(say("none")).alias("final_verdict"))
