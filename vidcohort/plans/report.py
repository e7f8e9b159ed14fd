"""The whole report of a table of subjects, and its sections as tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vidcohort.operators import cohort, contrast, features, semantic
from vidcohort.plans import narrative
from vidcohort.sources import ingest, published
from vidcohort.sources.stored import cut, drop_cut, gathered

ANALYSED = 3
# The warnings that are told.
NO_VIDEO = "Could not fetch video data from YouTube."
NO_TOP = "No top performers intros could be analyzed."
NO_LOWER = "No lower performers intros could be analyzed."
#: Sections that a subject has only if its intro was acquired.
INTRO_SECTIONS = ["vision", "narrative", "feature_report", "intro_observation"]


def cohort_features(performers: DataFrame, benchmark_summaries: DataFrame) -> DataFrame:
    """(subject_id, grp, pos, video_id, features…): the first three of each group with the features of their intros.

    Videos that could not be acquired (acquisition_status skipped) are left out, failed ones stay as failed rows.
    """
    first = performers.where(F.col("rank") <= ANALYSED).select("subject_id", "grp", F.col("rank").alias("pos"), "video_id")
    rows = first.join(benchmark_summaries.hint("merge"), "video_id", "left")
    state = F.coalesce("acquisition_status", F.lit("success"))
    return rows.where(state != "skipped").withColumn("status", F.when(state == "failed", "failed"))


def contrast_parts(users: DataFrame, members: DataFrame, subjects: DataFrame) -> dict[str, DataFrame]:
    """Dominant values, contrast, confidence and verdict from the subjects' and the cohorts' summaries."""
    fine = members.where(F.coalesce("status", F.lit("")) != "failed")
    dominant = contrast.dominant_values(features.feature_long(fine, ["subject_id", "grp", "pos"]))
    table = contrast.feature_contrast(features.feature_long(users, ["subject_id"]), dominant)
    levels = contrast.confidence(subjects, members, table)
    return {"dominant": dominant, "contrast": table, "confidence": levels, "verdict": contrast.verdict(levels)}


def acquired(evidence: DataFrame) -> Column:
    """Whether an intro may be analysed: acquired, with frames."""
    return (F.coalesce("acquisition_status", F.lit("failed")) == "success") & (F.coalesce("n_frames", F.lit(0)) > 0)


def status(subjects: DataFrame, context: DataFrame, evidence: DataFrame, levels: DataFrame) -> DataFrame:
    """(subject_id, status, warnings, has_intro) of each subject.

    ``context`` has subject_id and status: a subject whose video or channel is missing has failed, with one warning.
    ``evidence`` has subject_id, acquisition_status, n_frames and warnings: an intro that was not acquired leaves its
    warnings and makes the report partial. A group warns if it has no member at all; one with failed members only does not.
    """
    rows = gathered("subject_id", {
        "subject": subjects.select("subject_id", F.lit(True).alias("asked")), "context": context.select("subject_id", F.col("status").alias("found")),
        "evidence": evidence.select("subject_id", acquired(evidence).alias("has_intro"), F.col("warnings").alias("said")), "levels": levels.select("subject_id", "n_top", "n_lower"),
    })
    rows = rows.where("subject is not null").select("subject_id", "context.found", "evidence.has_intro", "evidence.said", "levels.n_top", "levels.n_lower")
    failed = F.coalesce("found", F.lit("failed")) == "failed"
    has_intro = F.coalesce("has_intro", F.lit(False)) & ~failed
    said = F.when(has_intro, F.array().cast("array<string>")).otherwise(F.coalesce("said", F.array().cast("array<string>")))
    few = F.array_compact(F.array(F.when(F.coalesce("n_top", F.lit(0)) == 0, F.lit(NO_TOP)), F.when(F.coalesce("n_lower", F.lit(0)) == 0, F.lit(NO_LOWER))))
    rows = rows.select("subject_id", has_intro.alias("has_intro"), failed.alias("failed"), F.when(failed, F.array(F.lit(NO_VIDEO))).otherwise(F.concat(said, few)).alias("warnings"))
    state = F.when(F.col("failed"), "failed").when(F.size("warnings") > 0, "partial").otherwise("success")
    return rows.select("subject_id", state.alias("status"), "warnings", "has_intro")


def report(state: DataFrame, parts: dict[str, DataFrame], sections: dict[str, DataFrame]) -> DataFrame:
    """One nested row a subject: status, warnings and a struct for each section; a failed subject has no section."""
    item = F.struct("feature_ord", "feature", "label", "user_value", "status", "explanation")
    tip = F.when(contrast.recommended(), F.struct(*contrast.suggestion()))
    listed = parts["contrast"].groupBy("subject_id").agg(
        F.array_sort(F.collect_list(item)).alias("feature_comparison"), F.array_sort(F.collect_list(tip)).alias("recommendations")
    )
    judged = {"listed": listed, "level": parts["confidence"].select("subject_id", "confidence", "confidence_reason"), "verdict": parts["verdict"].select("subject_id", "final_verdict")}
    out = gathered("subject_id", {"state": state} | sections | judged).where("state is not null")
    patterns = F.when(F.col("listed").isNotNull() & F.col("level").isNotNull() & F.col("verdict").isNotNull(), F.struct("listed.*", "level.*", "verdict.*"))
    shown = F.col("state.status") != "failed"
    every = {n: F.col(n) for n in sections} | {"patterns": patterns}
    return out.select(
        "subject_id", "state.status", "state.warnings", *[F.when(shown & F.col("state.has_intro") if n in INTRO_SECTIONS else shown, c).alias(n) for n, c in every.items()]
    )


def write_report(rows: DataFrame, path: str, run: str | None = None) -> str:
    """The report by status, and a table of each section beside it, of the subjects that have it; the run that it is published as.

    All tables of a run are written under its own folder; then one manifest is put in place. A run that dies before that
    is never seen, and readers keep the tables of the last run that was published, all of them of that run.
    """
    spark, run = rows.sparkSession, run or uuid.uuid4().hex
    number, before = published.latest(spark, path)
    if before.get("run") == run:
        return run
    rows = cut(rows)
    folder = f"run-{run}-{uuid.uuid4().hex[:8]}"
    rows.write.partitionBy("status").parquet(f"{path}/{folder}/report")
    sections = [f.name for f in rows.schema.fields if f.dataType.typeName() == "struct"]
    for name in sections:
        rows.where(F.col(name).isNotNull()).select("subject_id", f"{name}.*").write.parquet(f"{path}/{folder}/{name}")
    drop_cut(rows)
    published.publish(spark, path, number, {"run": run, "sections": ["report", *sections], "folders": [{"folder": folder}]})
    return run


def read_report(spark: SparkSession, path: str, section: str = "report") -> DataFrame:
    """A table of the last run that was published."""
    _, content = published.latest(spark, path)
    if section not in content.get("sections", []):
        raise ValueError(f"{path} has no published {section}")
    return spark.read.parquet(f"{path}/{content['folders'][0]['folder']}/{section}")


def values(rows: DataFrame, key: str = "subject_id") -> DataFrame:
    """(key, section, path, value): every value of the nested columns of ``rows`` as one row, whatever they hold.

    Structs are entered by name, arrays by place (from 0), maps by key; values are texts. A null has no row, an empty array none either.
    """
    def entries(c: Column, kind: T.DataType, path: Column) -> Column:
        """Array of (path, value)."""
        if isinstance(kind, T.StructType):
            parts = [entries(c[f.name], f.dataType, F.concat(path, F.lit("." + f.name))) for f in kind.fields]
            return F.flatten(F.array(*parts)) if parts else F.array().cast("array<struct<path:string,value:string>>")
        if isinstance(kind, T.ArrayType):
            inner = F.transform(c, lambda x, i: entries(x, kind.elementType, F.concat(path, F.lit("."), i.cast("string"))))
            return F.flatten(F.coalesce(inner, F.array().cast("array<array<struct<path:string,value:string>>>")))
        if isinstance(kind, T.MapType):
            listed = F.transform(F.map_entries(c), lambda e: entries(e["value"], kind.valueType, F.concat(path, F.lit("."), e["key"].cast("string"))))
            return F.flatten(F.coalesce(listed, F.array().cast("array<array<struct<path:string,value:string>>>")))
        return F.array(F.struct(path.alias("path"), c.cast("string").alias("value")))

    sections = [f for f in rows.schema.fields if f.name != key]
    every = F.array(*[F.struct(F.lit(f.name).alias("section"), entries(F.col(f.name), f.dataType, F.lit("")).alias("v")) for f in sections])
    found = rows.select(key, F.explode(every).alias("s")).select(key, "s.section", F.explode("s.v").alias("v"))
    return found.where("v.value is not null").select(key, "section", F.ltrim("v.path", F.lit(".")).alias("path"), "v.value")


def texts(videos: DataFrame, channels: DataFrame, titles: DataFrame) -> DataFrame:
    """Videos with what the text rules look at: channel title, description and top titles; channels without uploads have none."""
    c = channels.select("channel_id", F.col("title").alias("_title"), F.col("description").alias("channel_description"), "subscribers")
    rows = videos.join(c, "channel_id", "left").join(titles, "channel_id", "left")
    return rows.withColumn("channel_title", F.coalesce("_title", "channel_title")).drop("_title")


def member_lists(members: DataFrame) -> DataFrame:
    """(subject_id, top_performers, lower_performers): the members of both groups in order, with their features."""
    one = F.struct("pos", "video_id", "status", "frames_analyzed", "scene_change_count", *features.CLASSES)
    lists = [F.array_sort(F.collect_list(F.when(F.col("grp") == g, one))).alias(f"{g}_performers") for g in ("top", "lower")]
    return members.groupBy("subject_id").agg(*lists)


def compared(subjects: DataFrame, members: DataFrame, observations: DataFrame | None) -> DataFrame:
    """Positions of the subjects' observations against those of their members that were acquired; none without observations."""
    own = subjects.select("subject_id", F.lit("user").alias("grp"), F.lit(0).alias("pos"), F.col("subject_id").alias("video_id"))
    if observations is None:
        nothing = [F.lit(None).cast("string").alias(n) for n in semantic.FIELDS]
        observations = own.select("video_id", F.lit("failed").alias("status"), *nothing).where("false")
    fine = members.where(F.coalesce("status", F.lit("")) != "failed").select("subject_id", "grp", "pos", "video_id")
    return semantic.field_positions(own.unionByName(fine), observations)


def run(
    subjects: DataFrame, videos: DataFrame, channels: DataFrame, recent: DataFrame, context: DataFrame, users: DataFrame, benchmarks: DataFrame,
    evidence: DataFrame, answers: DataFrame, frames: DataFrame, mode: str = "title", observations: DataFrame | None = None,
) -> DataFrame:
    """All sections of all subjects in one job.

    ``users`` and ``evidence`` (acquisition_status, n_frames, warnings) are of the subjects' own intros, ``answers``
    (subject_id, text) what a model said of them and ``frames`` (subject_id, frame_no, origin) what it saw. ``observations``
    (video_id, status, fields) of all videos are compared, if there are any.
    """
    groups = cohort.cohorts(subjects, videos, mode, stored=True)
    members = cut(cohort_features(groups["performers"], benchmarks))
    seen = evidence.where(acquired(evidence)).select("subject_id", F.lit(True).alias("_seen"))
    # an intro that was not acquired has no value of any feature
    known = users.join(seen.hint("merge"), "subject_id", "left")
    known = known.select(*[F.when(F.col("_seen"), F.col(c)).alias(c) if c in dict(features.FEATURES) else F.col(c) for c in users.columns])
    parts = contrast_parts(known, members, subjects)
    parts = parts | {"contrast": cut(parts["contrast"])}
    levels = cut(contrast.confidence(subjects, members, parts["contrast"]))
    parts = parts | {"confidence": levels, "verdict": contrast.verdict(levels)}
    own = cut(texts(subjects.drop("channel_title").withColumn("channel_title", F.col("channel_id")), channels, narrative.top_titles(recent)))
    keyed = lambda df: df.withColumnRenamed("video_id", "subject_id")
    facts = subjects.select("subject_id", "channel_id")
    upload = F.struct("pos", "video_id", "title", "views", "likes", "comments")
    uploads = recent.groupBy("channel_id").agg(F.array_sort(F.collect_list(upload)).alias("recent_videos"))  # at most RECENT a channel
    sections = {
        "video": subjects.select("subject_id", *[c for c in subjects.columns if c not in ("subject_id", "k")]),
        "channel": facts.join(channels.hint("merge"), "channel_id"),
        "recent_videos": facts.join(uploads.hint("merge"), "channel_id").select("subject_id", "recent_videos"),
        "category": groups["queries"].groupBy("subject_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("qpos", "query"))), lambda x: x["query"]).alias("queries")),
        "benchmark": cohort.cohort_summary(subjects, groups),
        "benchmark_features": member_lists(members),
        "content_dna": keyed(narrative.content_dna(own)),
        "growth_snapshot": keyed(narrative.growth_snapshot(own)),
        "vision": narrative.vision_stub(frames, "subject_id"),
        "narrative": keyed(narrative.narrative(own)),
        "feature_report": users.select("subject_id", "frames_analyzed", "scene_changes", "scene_change_count", *features.CLASSES),
        "intro_observation": ingest.observations(evidence.select("subject_id", "n_frames"), answers, "subject_id"),
        "semantic_comparison": semantic.comparison(subjects, compared(subjects, members, observations)),
    }
    return report(status(subjects, context, evidence, levels), parts, sections)
