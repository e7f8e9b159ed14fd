"""Registered queries over the given tables, one for each operator."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vidcohort.functions import rules as r
from vidcohort.functions import text as t
from vidcohort.operators import cohort, contrast, evidence, features, frames, hypotheses, jobs, rulematch
from vidcohort.plans import narrative, report
from vidcohort.sources import fixtures, ingest
from vidcohort.sources.featurestore import FeatureStore
from vidcohort.sources.fixtures import table
from vidcohort.sources.stored import cut, shared_dir


def _cohorts(spark: SparkSession, sf: str, mode: str = "title") -> tuple[DataFrame, dict[str, DataFrame]]:
    return _cohorts_of(cut(fixtures.videos(spark, sf)), mode)


def _cohorts_of(videos: DataFrame, mode: str = "title", stored: bool = False) -> tuple[DataFrame, dict[str, DataFrame]]:
    subjects = fixtures.subjects(videos)
    return subjects, cohort.cohorts(subjects, videos, mode, stored)


def _numbered(spark: SparkSession, sf: str, rows: DataFrame) -> DataFrame:
    """Videos with the number of the intro that stands in for theirs."""
    users = table(spark, sf, "events").agg((F.max("user_id") + 1).alias("n"))
    return rows.withColumn("video_no", F.col("k") % users.scalar())


def _users(spark: SparkSession, sf: str, videos: DataFrame | None = None) -> DataFrame:
    """Summaries of the subjects' own intros."""
    subjects = _numbered(spark, sf, fixtures.subjects(videos or fixtures.videos(spark, sf)))
    intros = features.intro_features(fixtures.frame_metrics(spark, sf))
    return features.feature_summary(subjects.select("subject_id", "video_no"), intros).drop("video_no")


def _benchmarks(spark: SparkSession, sf: str, videos: DataFrame | None = None) -> DataFrame:
    """Summaries of all videos' intros, of the frames that a benchmark has."""
    short = fixtures.frame_metrics(spark, sf).where(F.col("frame_no") <= fixtures.BENCHMARK_FRAMES)
    videos = _numbered(spark, sf, videos or fixtures.videos(spark, sf)).select("video_id", "video_no")
    return features.feature_summary(videos, features.intro_features(short)).drop("video_no").withColumn("acquisition_status", F.lit("success"))


def _members(spark: SparkSession, sf: str, videos: DataFrame) -> tuple[DataFrame, DataFrame]:
    subjects, parts = _cohorts_of(videos, stored=True)
    return subjects, cut(report.cohort_features(parts["performers"], _benchmarks(spark, sf, videos)))


def _parts(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    videos = cut(fixtures.videos(spark, sf))
    subjects, members = _members(spark, sf, videos)
    return report.contrast_parts(_users(spark, sf, videos), members, subjects.select("subject_id"))


def _recent(spark: SparkSession, sf: str, videos: DataFrame | None = None) -> DataFrame:
    videos = videos or fixtures.videos(spark, sf)
    return ingest.recent_uploads(videos.select("channel_id", "video_id", F.col("k").alias("item_pos")), videos)


def _context(spark: SparkSession, sf: str, videos: DataFrame | None = None) -> DataFrame:
    videos = videos or fixtures.videos(spark, sf)
    requests = fixtures.subjects(videos).select("subject_id", F.concat(F.lit(t.WATCH), F.col("video_id")).alias("url"))
    return ingest.video_context(requests, videos, fixtures.channels(videos), _recent(spark, sf, videos))


def _intros(spark: SparkSession, sf: str, videos: DataFrame) -> DataFrame:
    """(subject_id, video_no, acquisition_status, n_frames, warnings) of the subjects' own intros."""
    subjects = _numbered(spark, sf, fixtures.subjects(videos)).select("subject_id", "video_no")
    return subjects.join(fixtures.intro_evidence(spark, sf).hint("merge"), "video_no", "left")


def _answers(spark: SparkSession, sf: str, videos: DataFrame) -> DataFrame:
    """(subject_id, text): what a model said of the subjects' intros; some have no answer."""
    conversations = table(spark, sf, "conversations").agg((F.max("conv_id") + 1).alias("n"))
    subjects = fixtures.subjects(videos).select("subject_id", (F.col("k") % conversations.scalar()).alias("conv_id"))
    return subjects.join(fixtures.answers(spark, sf), "conv_id").select("subject_id", "text")


def full_report(spark: SparkSession, sf: str) -> DataFrame:
    """The whole report of every subject."""
    videos = cut(fixtures.videos(spark, sf))
    recent = cut(_recent(spark, sf, videos))
    intros = cut(_intros(spark, sf, videos))
    name = F.concat(F.lit("frame_"), F.lpad(F.col("frame_no").cast("string"), 3, "0")).alias("origin")
    seen = intros.join(fixtures.frame_metrics(spark, sf).select("video_no", "frame_no", name).hint("merge"), "video_no").select("subject_id", "frame_no", "origin")
    return report.run(
        fixtures.subjects(videos), videos, fixtures.channels(videos), recent, _context(spark, sf, videos), _users(spark, sf, videos), _benchmarks(spark, sf, videos),
        intros, _answers(spark, sf, videos), seen, observations=fixtures.video_observations(spark, sf, videos),
    )


def report_values(spark: SparkSession, sf: str) -> DataFrame:
    """Every value of every subject's report, in all sections."""
    return report.values(full_report(spark, sf))


def report_status(spark: SparkSession, sf: str) -> DataFrame:
    """Status and warnings of every subject's report."""
    videos = cut(fixtures.videos(spark, sf))
    subjects, members = _members(spark, sf, videos)
    groups = [F.count_if(F.col("grp") == g).alias(f"n_{g}") for g in ("top", "lower")]
    rows = report.status(subjects, _context(spark, sf, videos), _intros(spark, sf, videos), members.groupBy("subject_id").agg(*groups))
    return rows.withColumn("warnings", F.array_join("warnings", "; "))


def observation_status(spark: SparkSession, sf: str) -> DataFrame:
    videos = cut(fixtures.videos(spark, sf))
    rows = ingest.observations(_intros(spark, sf, videos), _answers(spark, sf, videos), "subject_id")
    return rows.select("subject_id", "status", "opening_type", "visual_focus", "confidence", "warning")


def _semantic(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Subjects, and the positions of their observations."""
    videos = cut(fixtures.videos(spark, sf))
    subjects, members = _members(spark, sf, videos)
    return subjects, report.compared(subjects, members, fixtures.video_observations(spark, sf, videos))


def semantic_fields(spark: SparkSession, sf: str) -> DataFrame:
    """Typical observations of both groups, field by field, and the subject's distance to them."""
    rows = _semantic(spark, sf)[1]
    return rows.select("subject_id", "field", "top_medoid", "lower_medoid", F.round("top_distance", 9).alias("top_distance"), F.round("lower_distance", 9).alias("lower_distance"), "position")


def semantic_comparison(spark: SparkSession, sf: str) -> DataFrame:
    rows = report.semantic.comparison(*_semantic(spark, sf))
    return rows.select("subject_id", "status", *[F.array_join(c, "; ").alias(c) for c in ("semantic_differences", "user_position", "warnings")])


def job_states(spark: SparkSession, sf: str) -> DataFrame:
    """Reports of a user's job; one event in fifty ends it."""
    i, user = F.col("event_id"), F.col("user_id")
    state = F.element_at(F.array(*map(F.lit, jobs.STATES)), F.when(i % 50 == 0, 5 + user % 3).otherwise(1 + i % 4).cast("int"))
    return jobs.current(table(spark, sf, "events").select(user.alias("job_id"), i.alias("seq"), state.alias("state")))


def _job_reports(spark: SparkSession, sf: str) -> DataFrame:
    """Reports that mostly go through the states in their order; some come twice, some out of order."""
    i, user = F.col("event_id"), F.col("user_id")
    order = Window.partitionBy("user_id").orderBy("event_id")
    rows = table(spark, sf, "events").select("user_id", "event_id").withColumn("n", F.row_number().over(order) - 1)
    place = F.when(i % 9 == 0, 1 + i % 7).when(F.col("n") < 8, 1 + F.expr("n div 2")).otherwise(5 + user % 3).cast("int")
    return rows.select(user.alias("job_id"), i.alias("seq"), F.element_at(F.array(*map(F.lit, jobs.STATES)), place).alias("state"))


def job_transitions(spark: SparkSession, sf: str) -> DataFrame:
    return jobs.settled(_job_reports(spark, sf))


def display_formats(spark: SparkSession, sf: str) -> DataFrame:
    return fixtures.videos(spark, sf).select("video_id", t.title_case(F.col("title")).alias("shown_title"), t.thousands(F.col("views")).alias("shown_views"))


def feature_shapes(spark: SparkSession, sf: str) -> DataFrame:
    """Summaries read from JSON items of both shapes."""
    rows = _users(spark, sf)
    summary = F.struct(F.struct(*[c for c in rows.columns if c != "subject_id"]).alias("feature_summary"))
    item = F.when(F.col("subject_id").endswith("0"), F.to_json(summary)).otherwise(F.to_json(F.struct(summary.alias("features"))))
    return rows.select("subject_id", features.summary_of(item).alias("s")).select("subject_id", "s.*")


def safe_int(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("event_id")
    s = F.get_json_object("props", "$.k")
    x = F.when(i % 4 == 0, s).when(i % 4 == 1, F.concat(F.lit(" "), s, F.lit(" "))).when(i % 4 == 2, F.concat(s, F.lit(".7"))).otherwise(F.concat(F.lit("x"), s))
    return table(spark, sf, "events").select("event_id", t.safe_int(x).alias("n"))


def clean_text(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", F.md5(t.clean_markup(F.col("html"))).alias("clean_md5"))


def video_id_loose(spark: SparkSession, sf: str) -> DataFrame:
    return fixtures.urls(spark, sf).select("page_id", t.video_id_loose(F.col("url")).alias("video_id"))


def video_id_strict(spark: SparkSession, sf: str) -> DataFrame:
    return fixtures.urls(spark, sf).select("page_id", t.video_id_strict(F.col("url")).alias("video_id"))


def canonical_url(spark: SparkSession, sf: str) -> DataFrame:
    url = t.canonical_url(F.col("url"))
    return fixtures.urls(spark, sf).select("page_id", url.alias("url"), F.when(url.isNull(), "invalid_youtube_url").alias("error_type"))


def normalize_text(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.md5(t.normalized(F.col("text"))).alias("normalized_md5"))


def word_set(spark: SparkSession, sf: str) -> DataFrame:
    words = t.word_set(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", F.size(words).alias("n_words"), F.md5(F.array_join(F.array_sort(words), " ")).alias("words_md5"))


def title_query(spark: SparkSession, sf: str) -> DataFrame:
    return hypotheses.subject_queries(fixtures.subjects(fixtures.videos(spark, sf)))


def query_hypotheses(spark: SparkSession, sf: str) -> DataFrame:
    return hypotheses.subject_queries(fixtures.subjects(fixtures.videos(spark, sf)), "hypotheses")


def token_overlap(spark: SparkSession, sf: str) -> DataFrame:
    videos = fixtures.videos(spark, sf)
    return cohort.token_overlap(hypotheses.subject_queries(fixtures.subjects(videos)), videos)


def candidate_search(spark: SparkSession, sf: str) -> DataFrame:
    videos = cut(fixtures.videos(spark, sf))
    return cohort.candidate_search(hypotheses.subject_queries(fixtures.subjects(videos)), videos)


def query_scores(spark: SparkSession, sf: str) -> DataFrame:
    return _cohorts(spark, sf, "hypotheses")[1]["scores"]


def best_query(spark: SparkSession, sf: str) -> DataFrame:
    return _cohorts(spark, sf, "hypotheses")[1]["best"]


def clean_cohort(spark: SparkSession, sf: str) -> DataFrame:
    return _cohorts(spark, sf)[1]["cleaned"].select("subject_id", "pos", "video_id", "overlap", "views", "rank")


PERFORMER = ["subject_id", "grp", "rank", "video_id", "views", "overlap"]


def top_performers(spark: SparkSession, sf: str) -> DataFrame:
    return _cohorts(spark, sf)[1]["performers"].where("grp = 'top'").select(PERFORMER)


def lower_performers(spark: SparkSession, sf: str) -> DataFrame:
    return _cohorts(spark, sf)[1]["performers"].where("grp = 'lower'").select(*PERFORMER, "reason")


def lower_strict(spark: SparkSession, sf: str) -> DataFrame:
    return lower_performers(spark, sf).where(F.col("reason") == cohort.STRICT).select(PERFORMER)


def lower_fallback(spark: SparkSession, sf: str) -> DataFrame:
    return lower_performers(spark, sf).where(F.col("reason") == cohort.FALLBACK).select(PERFORMER)


def cohort_summary(spark: SparkSession, sf: str) -> DataFrame:
    subjects, parts = _cohorts(spark, sf)
    score = F.aggregate("query_scores", F.lit(0).cast("bigint"), lambda a, x: F.greatest(a, x["score"]))
    return cohort.cohort_summary(subjects, parts).select(
        "subject_id", "query", score.alias("score"), "candidate_count", "cleaned_count", "lower_performer_reason",
        F.array_join("top_ids", ",").alias("top_ids"), F.array_join("lower_ids", ",").alias("lower_ids"),
    )


def recent_uploads(spark: SparkSession, sf: str) -> DataFrame:
    return _recent(spark, sf)


def video_context(spark: SparkSession, sf: str) -> DataFrame:
    return _context(spark, sf)


def ingest_videos(spark: SparkSession, sf: str) -> DataFrame:
    """Videos from responses as they land: nested JSON with counts as text."""
    v = fixtures.videos(spark, sf)
    snippet = F.struct(
        F.col("title"), F.lit("").alias("description"), F.col("channel_id").alias("channelTitle"), F.col("channel_id").alias("channelId"), F.lit("2024").alias("publishedAt"),
        F.create_map(F.lit("high"), F.struct(F.concat(F.lit("https://img/"), "video_id").alias("url"))).alias("thumbnails"),
    )
    counts = F.struct(F.col("views").cast("string").alias("viewCount"), F.col("likes").cast("string").alias("likeCount"), F.col("comments").cast("string").alias("commentCount"))
    item = F.struct(F.col("video_id").alias("id"), snippet.alias("snippet"), counts.alias("statistics"))
    raw = v.select(F.to_json(F.struct(F.array(item).alias("items"))).alias("value"))
    return ingest.videos(raw).select("video_id", "title", "channel_id", "views", "likes", "comments", "thumbnail")


def ingest_channels(spark: SparkSession, sf: str) -> DataFrame:
    c = fixtures.channels(fixtures.videos(spark, sf))
    item = F.struct(
        F.col("channel_id").alias("id"), F.struct(F.col("title")).alias("snippet"), F.struct(F.col("subscribers").cast("string").alias("subscriberCount")).alias("statistics"),
        F.struct(F.struct(F.concat(F.lit("u"), "channel_id").alias("uploads")).alias("relatedPlaylists")).alias("contentDetails"),
    )
    raw = c.select(F.to_json(F.struct(F.array(item).alias("items"))).alias("value"))
    return ingest.channels(raw).select("channel_id", "title", "subscribers", "uploads_playlist_id")


def parse_observations(spark: SparkSession, sf: str) -> DataFrame:
    rows = ingest.parse_observations(fixtures.observations_raw(spark, sf), ["conv_id", "turn"])
    return rows.select("conv_id", "turn", "status", "opening_type", "visual_focus", "confidence")


def frame_diff(spark: SparkSession, sf: str) -> DataFrame:
    return features.frame_diff(fixtures.frame_grids(spark, sf)).withColumn("diff", F.round("diff", 6))


def _pictures(spark: SparkSession, sf: str) -> DataFrame:
    """8 x 8 pictures whose three channels are shades of the gray grids."""
    grids = fixtures.frame_grids(spark, sf)
    shade = F.transform("gray_grid", lambda x: F.lpad(F.hex(F.floor(x).cast("bigint")), 2, "0"))
    half = F.transform("gray_grid", lambda x: F.lpad(F.hex(F.floor(x / 2).cast("bigint")), 2, "0"))
    pixels = F.zip_with(shade, half, lambda a, b: F.concat(b, a, a))
    return grids.select(
        F.col("video_no").cast("string").alias("video_id"), F.col("frame_no").cast("int").alias("frame_no"), F.lit(8).alias("height"), F.lit(8).alias("width"),
        F.lit(3).alias("nChannels"), F.unhex(F.array_join(pixels, "")).alias("data"),
    )


def frame_metrics(spark: SparkSession, sf: str) -> DataFrame:
    rows = frames.frame_metrics(_pictures(spark, sf))
    return rows.select("video_id", "frame_no", F.round("luma", 6).alias("luma"), "mean_hue", "valid_px", F.size("gray_grid").alias("grid_px"))


def frame_grid(spark: SparkSession, sf: str) -> DataFrame:
    """The sampled grid of every picture: its cells, each with a weight of its place."""
    cells = F.transform("gray_grid", lambda v, i: F.floor(v.cast("double") * 1000) * (i % 97 + 1))
    total = F.aggregate(cells, F.lit(0).cast("bigint"), lambda a, x: a + x)
    return frames.frame_metrics(_pictures(spark, sf)).select("video_id", "frame_no", F.size("gray_grid").alias("grid_px"), total.alias("weighted"), F.array_max("gray_grid").cast("double").alias("highest"))


def majority_class(spark: SparkSession, sf: str) -> DataFrame:
    rows = fixtures.frame_metrics(spark, sf)
    return features.majority_class(rows, "video_no", features.color_feel(F.col("mean_hue"), F.col("valid_px")), "dominant_color_feel")


def intro_features(spark: SparkSession, sf: str) -> DataFrame:
    return features.intro_features(fixtures.frame_metrics(spark, sf))


def feature_summary(spark: SparkSession, sf: str) -> DataFrame:
    return _users(spark, sf)


def feature_long(spark: SparkSession, sf: str) -> DataFrame:
    return features.feature_long(_users(spark, sf), ["subject_id"])


def cohort_features(spark: SparkSession, sf: str) -> DataFrame:
    names = ["frames_analyzed", "scene_changes", "scene_change_count", *features.CLASSES]
    return _members(spark, sf, cut(fixtures.videos(spark, sf)))[1].select("subject_id", "grp", "pos", "video_id", *names)


def dominant_values(spark: SparkSession, sf: str) -> DataFrame:
    return _parts(spark, sf)["dominant"]


def feature_contrast(spark: SparkSession, sf: str) -> DataFrame:
    return _parts(spark, sf)["contrast"]


def recommendations(spark: SparkSession, sf: str) -> DataFrame:
    return contrast.recommendations(_parts(spark, sf)["contrast"])


def confidence(spark: SparkSession, sf: str) -> DataFrame:
    return _parts(spark, sf)["confidence"].select("subject_id", "top_count", "lower_count", "usable", "confidence", "confidence_reason")


def verdict(spark: SparkSession, sf: str) -> DataFrame:
    return _parts(spark, sf)["verdict"]


def _lower_title() -> Column:
    return F.lower(t.text(F.col("title")))


def content_world(spark: SparkSession, sf: str) -> DataFrame:
    return fixtures.keyword_videos(spark, sf).select("doc_id", narrative.content_world(_lower_title()).alias("world"))


def emotional_style(spark: SparkSession, sf: str) -> DataFrame:
    return fixtures.keyword_videos(spark, sf).select("doc_id", narrative.emotional_style(_lower_title()).alias("s")).select("doc_id", "s.*")


def audience_pull(spark: SparkSession, sf: str) -> DataFrame:
    return fixtures.keyword_videos(spark, sf).select("doc_id", narrative.audience_pull(_lower_title()).alias("s")).select("doc_id", "s.*")


def repeatable_patterns(spark: SparkSession, sf: str) -> DataFrame:
    return fixtures.keyword_videos(spark, sf).select("doc_id", F.array_join(narrative.repeatable_patterns(_lower_title()), "; ").alias("patterns"))


def emotional_center(spark: SparkSession, sf: str) -> DataFrame:
    both = F.lower(F.concat_ws(" ", "title", "description"))
    return fixtures.keyword_videos(spark, sf).select("doc_id", narrative.emotional_center(both).alias("s")).select("doc_id", "s.*")


def top_titles(spark: SparkSession, sf: str) -> DataFrame:
    return narrative.top_titles(_recent(spark, sf)).select("channel_id", F.array_join("top_titles", " / ").alias("top_titles"))


def content_dna(spark: SparkSession, sf: str) -> DataFrame:
    videos = fixtures.videos(spark, sf)
    return narrative.content_dna(report.texts(fixtures.subjects(videos), fixtures.channels(videos), narrative.top_titles(_recent(spark, sf))))


def growth_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    videos = fixtures.videos(spark, sf)
    return narrative.growth_snapshot(videos.join(fixtures.channels(videos).select("channel_id", "subscribers"), "channel_id"))


def narrative_texts(spark: SparkSession, sf: str) -> DataFrame:
    rows = narrative.narrative(fixtures.keyword_videos(spark, sf).withColumnRenamed("doc_id", "video_id"))
    return rows.withColumn("emotional_currency", F.array_join("emotional_currency", ", "))


def vision_stub(spark: SparkSession, sf: str) -> DataFrame:
    name = F.concat(F.lit("frame_"), F.lpad(F.col("frame_no").cast("string"), 3, "0"))
    rows = fixtures.frame_metrics(spark, sf).select(F.col("video_no").cast("string").alias("video_id"), "frame_no", name.alias("origin"))
    return narrative.vision_stub(rows).withColumn("frames_analyzed", F.array_join("frames_analyzed", ","))


def _evidence(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    state = F.when(F.col("event_id") % 3 == 0, "failed").otherwise("success")
    return e.select(F.col("user_id").alias("video_id"), F.col("event_type").alias("method"), (F.col("user_id") % 4).cast("string").alias("platform"), state.alias("status"), F.col("value").alias("frames"), F.when(F.col("user_id") % 2 == 0, "captions").alias("captions"))


def evidence_best(spark: SparkSession, sf: str) -> DataFrame:
    return evidence.best_method(evidence.completeness(evidence.unified([_evidence(spark, sf)])), ["purchase", "click"]).select("video_id", "method", "schema_version", "completeness")


def evidence_failures(spark: SparkSession, sf: str) -> DataFrame:
    return evidence.failure_rates(_evidence(spark, sf)).withColumn("failure_rate", F.round("failure_rate", 9))


def _windows(spark: SparkSession, sf: str) -> DataFrame:
    """(video_id, intro_seconds, video_no): the benchmark window of every video and the longer one of every subject."""
    videos = _numbered(spark, sf, cut(fixtures.videos(spark, sf)))
    one = lambda rows, n: rows.select("video_id", F.lit(n).alias("intro_seconds"), "video_no")
    return one(videos, fixtures.BENCHMARK_FRAMES).unionByName(one(fixtures.subjects(videos), fixtures.SUBJECT_FRAMES))


def _stored(spark: SparkSession, sf: str, asked: DataFrame) -> FeatureStore:
    """A store that two runs have filled with the intros that could be acquired; the first of them was sent twice."""
    store = FeatureStore(spark, f"{shared_dir(spark).rstrip('/')}/store-{uuid.uuid4().hex}", ["video_id", "intro_seconds"], 8)
    rows = asked.join(fixtures.intro_evidence(spark, sf).where("acquisition_status = 'success'"), "video_no").select("video_id", "intro_seconds", "n_frames")
    for run, seconds in (("benchmarks", fixtures.BENCHMARK_FRAMES), ("subjects", fixtures.SUBJECT_FRAMES), ("benchmarks", fixtures.BENCHMARK_FRAMES)):
        store.upsert(rows.where(F.col("intro_seconds") == seconds), run)
    return store


def evidence_missing(spark: SparkSession, sf: str) -> DataFrame:
    """Windows that the store of acquired intros does not have."""
    asked = cut(_windows(spark, sf))
    return _stored(spark, sf, asked).missing(asked).select("video_id", "intro_seconds")


def evidence_reuse(spark: SparkSession, sf: str) -> DataFrame:
    """What the store has of the windows that are asked for."""
    asked = cut(_windows(spark, sf))
    return _stored(spark, sf, asked).known(asked).select("video_id", "intro_seconds", "n_frames")


def landed_quality(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.quality(ingest.checked(fixtures.responses(fixtures.videos(spark, sf)), ingest.VIDEO_ITEMS))


def landed_rejected(spark: SparkSession, sf: str) -> DataFrame:
    rows = ingest.put_aside(ingest.checked(fixtures.responses(fixtures.videos(spark, sf)), ingest.VIDEO_ITEMS))
    return rows.groupBy("origin", "reason", "item_pos").agg(F.count("*").alias("n"), F.max(F.length("value")).alias("longest"))


def landed_videos(spark: SparkSession, sf: str) -> DataFrame:
    """The videos of the items that can be used."""
    rows = ingest.videos(ingest.usable(ingest.checked(fixtures.responses(fixtures.videos(spark, sf)), ingest.VIDEO_ITEMS)))
    return rows.select("video_id", "title", "channel_id", "views")


def _rules(spark: SparkSession, rules: list[tuple], default: tuple, names: list[str]) -> DataFrame:
    rows = [(i, list(words), *rest) for i, (*rest, words) in enumerate(rules)] + [(len(rules), None, *default)]
    return spark.createDataFrame(rows, "ord int, keywords array<string>, " + ", ".join(f"{n} string" for n in names))


def _keyword_texts(spark: SparkSession, sf: str) -> DataFrame:
    return fixtures.keyword_videos(spark, sf).select("doc_id", _lower_title().alias("text"))


def content_world_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Content worlds by rules that are rows."""
    return rulematch.first_rule(_keyword_texts(spark, sf), _rules(spark, r.CONTENT_WORLDS, r.DEFAULT_WORLD, ["world"]), "doc_id")


def audience_pull_rules(spark: SparkSession, sf: str) -> DataFrame:
    return rulematch.first_rule(_keyword_texts(spark, sf), _rules(spark, r.AUDIENCE_PULLS, r.DEFAULT_PULL, ["pull", "why"]), "doc_id")


def cohort_states(spark: SparkSession, sf: str) -> DataFrame:
    """Members of the cohorts where some benchmark intros have failed (they stay, marked) and some were skipped (they go)."""
    return _some_failed(spark, sf)[1].select("subject_id", "grp", "pos", "video_id", "status")


def _some_failed(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    videos = cut(fixtures.videos(spark, sf))
    states = _numbered(spark, sf, videos).select("video_id", fixtures.benchmark_states(F.col("video_no")).alias("acquisition_status"))
    summaries = _benchmarks(spark, sf, videos).drop("acquisition_status").join(states, "video_id")
    subjects, parts = _cohorts_of(videos, stored=True)
    return subjects, cut(report.cohort_features(parts["performers"], summaries))


def dominant_acquired(spark: SparkSession, sf: str) -> DataFrame:
    """Dominant values where failed and skipped benchmarks do not count."""
    subjects, members = _some_failed(spark, sf)
    return report.contrast_parts(_users(spark, sf), members, subjects.select("subject_id"))["dominant"]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    plain = [
        safe_int, clean_text, video_id_loose, video_id_strict, canonical_url, normalize_text, word_set, title_query, query_hypotheses, token_overlap,
        candidate_search, query_scores, best_query, clean_cohort, top_performers, lower_performers, lower_strict, lower_fallback, cohort_summary,
        recent_uploads, video_context, ingest_videos, ingest_channels, parse_observations, frame_diff, frame_metrics, majority_class, intro_features,
        feature_summary, feature_long, cohort_features, dominant_values, feature_contrast, recommendations, confidence, verdict, content_world,
        emotional_style, audience_pull, repeatable_patterns, emotional_center, top_titles, content_dna, growth_snapshot, vision_stub,
        evidence_best, evidence_failures, evidence_missing, report_status, observation_status, semantic_comparison, job_states, display_formats, feature_shapes,
        semantic_fields, job_transitions, evidence_reuse, landed_quality, landed_rejected, landed_videos, content_world_rules, audience_pull_rules,
        cohort_states, dominant_acquired, report_values, frame_grid,
    ]
    return {f.__name__: f for f in plain} | {"narrative": narrative_texts, "report": full_report}
