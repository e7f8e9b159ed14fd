"""Intro features from per-frame measurements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: A difference between two frames from which the scene counts as changed.
SCENE_CHANGE = 25.0
UNKNOWN = "unknown"
#: Features in the order in which they are compared, with the names they are told by.
FEATURES = [
    ("dominant_lighting", "lighting"), ("dominant_color_feel", "color feel"), ("human_presence", "human presence"), ("text_overlay", "text overlay"),
    ("scene_type", "scene type"), ("visual_energy", "visual energy"), ("motion_level", "motion level"), ("scene_change_count", "scene changes"), ("pacing_level", "pacing level"),
]
CLASSES = ["dominant_lighting", "dominant_color_feel", "motion_level", "pacing_level", "visual_energy", "human_presence", "text_overlay", "scene_type"]


def lighting(luma: Column) -> Column:
    return F.when(luma < 75, "dark").when(luma > 170, "bright").otherwise("medium")


def color_feel(hue: Column, valid: Column) -> Column:
    """From the mean hue (0-179) of saturated pixels; without any it is neutral."""
    warm, cool = (hue < 25) | (hue > 150), (hue >= 80) & (hue <= 140)
    return F.when(valid.isNull() | (valid <= 0) | hue.isNull(), "neutral").when(warm, "warm").when(cool, "cool").otherwise("neutral")


def motion(diff: Column) -> Column:
    return F.when(diff < 8, "low").when(diff < 22, "medium").otherwise("high")


def pacing(changes: Column, frames: Column) -> Column:
    ratio = changes / F.greatest(frames - 1, F.lit(1))
    return F.when(frames <= 1, UNKNOWN).when(ratio < 0.2, "slow").when(ratio < 0.45, "medium").otherwise("fast")


def energy(motion: Column, pacing: Column) -> Column:
    points = F.when(motion == "medium", 1).when(motion == "high", 2).otherwise(0) + F.when(pacing == "medium", 1).when(pacing == "fast", 2).otherwise(0)
    return F.when(points <= 1, "low").when(points <= 3, "medium").otherwise("high")


def overlay(density: Column) -> Column:
    return F.when(density > 0.13, "present").when(density < 0.03, "absent").otherwise(UNKNOWN)


def human(faces: Column) -> Column:
    return F.when(faces > 0, "present").otherwise(UNKNOWN)


def scene_type(human: Column, overlay: Column, motion: Column, pacing: Column) -> Column:
    return (
        F.when((human == "present") & (overlay == "present"), "reaction")
        .when((human == "present") & motion.isin("low", "medium"), "commentary")
        .when((motion == "high") & (pacing == "fast"), "montage")
        .when(motion.isin("medium", "high") & (human == UNKNOWN), "movie_scene")
        .otherwise(UNKNOWN)
    )


def majority_class(frames: DataFrame, key: str, value: Column, name: str) -> DataFrame:
    """(key, name): most frequent known value of each key, the first seen if tied; keys without one are left out."""
    rows = frames.select(key, "frame_no", value.alias("value")).where(F.col("value").isNotNull() & ~F.col("value").isin("", UNKNOWN))
    counts = rows.groupBy(key, "value").agg(F.count("*").alias("n"), F.min("frame_no").alias("first"))
    return counts.groupBy(key).agg(F.max_by("value", F.struct("n", -F.col("first"))).alias(name))


def frame_diff(grids: DataFrame) -> DataFrame:
    """(video_no, frame_no, diff): mean absolute difference of each gray grid from the one before; null at the first."""
    before = F.lag("gray_grid").over(Window.partitionBy("video_no").orderBy("frame_no"))
    rows = grids.where("gray_grid is not null").withColumn("before", before)
    total = F.aggregate(F.zip_with("gray_grid", "before", lambda a, b: F.abs(a - b)), F.lit(0.0), lambda s, x: s + x)
    return rows.select("video_no", "frame_no", (total / F.size("gray_grid")).alias("diff"))


def intro_features(frames: DataFrame, key: str = "video_no") -> DataFrame:
    """A row of features for each key with frames (key, frame_no, luma, diff, mean_hue, valid_px, edge_density, face_count).

    All class columns come out of one grouping: known values are counted by a map of value to (count,
    -first frame), so that the frames are shuffled once.
    """
    classes = {"dominant_color_feel": color_feel(F.col("mean_hue"), F.col("valid_px")), "text_overlay": overlay(F.col("edge_density")), "human_presence": human(F.col("face_count"))}
    values = {"dominant_color_feel": ["warm", "cool", "neutral"], "text_overlay": ["present", "absent"], "human_presence": ["present"]}
    seen = frames.withColumns({f"_{n}": c for n, c in classes.items()})
    diffs = F.when(F.col("frame_no") > F.col("_first"), F.col("diff"))
    seen = seen.withColumn("_first", F.min("frame_no").over(Window.partitionBy(key)))
    aggs = [F.count("*").alias("frames_analyzed"), F.avg("luma").alias("_luma"), F.avg(diffs).alias("_diff"), F.count_if(diffs >= SCENE_CHANGE).alias("scene_change_count")]
    for n, kinds in values.items():
        for v in kinds:
            hit = F.col(f"_{n}") == v
            aggs += [F.struct(F.count_if(hit).alias("n"), (-F.min(F.when(hit, F.col("frame_no")))).alias("f"), F.lit(v).alias("v")).alias(f"_{n}_{v}")]
    rows = seen.groupBy(key).agg(*aggs)
    for n, kinds in values.items():
        best = F.greatest(*[F.col(f"_{n}_{v}") for v in kinds]) if len(kinds) > 1 else F.col(f"_{n}_{kinds[0]}")
        rows = rows.withColumn(n, F.when(best["n"] > 0, best["v"]).otherwise(UNKNOWN))
    changes = F.col("scene_change_count")
    rows = rows.withColumns({
        "dominant_lighting": lighting(F.col("_luma")), "motion_level": motion(F.coalesce("_diff", F.lit(0.0))), "pacing_level": pacing(changes, F.col("frames_analyzed")),
    })
    rows = rows.withColumns({
        "visual_energy": energy(F.col("motion_level"), F.col("pacing_level")),
        "scene_type": scene_type(F.col("human_presence"), F.col("text_overlay"), F.col("motion_level"), F.col("pacing_level")),
        "scene_changes": changes,
    })
    return rows.select(key, "frames_analyzed", "scene_changes", "scene_change_count", *CLASSES)


def feature_summary(videos: DataFrame, features: DataFrame, key: str = "video_no") -> DataFrame:
    """A summary for each video: unknown classes and no scene changes, where it has no frame."""
    rows = videos.join(features.hint("merge"), key, "left")
    changes = F.coalesce("scene_changes", "scene_change_count", F.lit(0))
    fixed = {"frames_analyzed": F.coalesce("frames_analyzed", F.lit(0)), "scene_changes": changes, "scene_change_count": F.coalesce("scene_change_count", changes)}
    return rows.withColumns(fixed | {c: F.coalesce(c, F.lit(UNKNOWN)) for c in CLASSES})


SUMMARY = "struct<frames_analyzed:bigint,scene_changes:bigint,scene_change_count:bigint," + ",".join(f"{c}:string" for c in CLASSES) + ">"


def summary_of(item: Column) -> Column:
    """The summary in a JSON item of either shape: ``feature_summary`` at the top, or else inside ``features``; null if there is none."""
    shapes = F.from_json(item, f"struct<feature_summary:{SUMMARY},features:struct<feature_summary:{SUMMARY}>>")
    return F.coalesce(shapes["feature_summary"], shapes["features"]["feature_summary"])


def feature_long(summaries: DataFrame, ids: list[str]) -> DataFrame:
    """(ids, feature_ord, feature, value): a row for each feature, values as lower-case text."""
    pairs = F.array(*[F.struct(F.lit(i).alias("feature_ord"), F.lit(f).alias("feature"), F.col(f).cast("string").alias("raw")) for i, (f, _) in enumerate(FEATURES)])
    rows = summaries.select(*ids, F.inline(pairs))
    value = F.coalesce(F.nullif(F.lower(F.trim("raw")), F.lit("")), F.lit(UNKNOWN))
    return rows.select(*ids, "feature_ord", "feature", value.alias("value"))
