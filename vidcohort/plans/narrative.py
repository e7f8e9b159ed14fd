"""Texts about videos: content, growth and meaning, from keyword rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vidcohort.functions import rules as r
from vidcohort.functions import text as t


def first_rule(c: Column, rules: list[tuple], default: tuple, names: list[str]) -> Column:
    """Struct of the payload of the first rule of which a keyword is in ``c``."""
    pack = lambda row: F.struct(*[F.lit(x).alias(n) for x, n in zip(row, names)])
    out = F
    for *payload, keywords in rules:
        out = out.when(t.any_of(c, keywords), pack(payload))
    return out.otherwise(pack(default))


def content_world(c: Column) -> Column:
    return first_rule(c, r.CONTENT_WORLDS, r.DEFAULT_WORLD, ["world"])["world"]


def emotional_style(c: Column) -> Column:
    return first_rule(c, r.EMOTIONAL_STYLES, r.DEFAULT_STYLE, ["label", "feeling", "viewer_feeling"])


def audience_pull(c: Column) -> Column:
    return first_rule(c, r.AUDIENCE_PULLS, r.DEFAULT_PULL, ["pull", "why"])


def emotional_center(c: Column) -> Column:
    return first_rule(c, r.EMOTIONAL_CENTERS, r.DEFAULT_CENTER, ["center", "audience_desire", "creator_advantage", "growth_direction"])


def repeatable_patterns(c: Column) -> Column:
    found = F.array_compact(F.array(*[F.when(t.any_of(c, k), F.lit(p)) for p, k in r.PATTERNS]))
    return F.when(F.size(found) > 0, F.slice(found, 1, 4)).otherwise(F.array(*map(F.lit, r.DEFAULT_PATTERNS)))


def top_titles(recent: DataFrame, most: int = 10) -> DataFrame:
    """(channel_id, top_titles): titles of the most seen of the recent uploads (channel_id, pos, title, views)."""
    rows = F.transform(F.array_sort(F.collect_list(F.struct((-F.coalesce("views", F.lit(0))).alias("v"), "pos", "title"))), lambda x: F.coalesce(x["title"], F.lit("")))
    return recent.groupBy("channel_id").agg(F.slice(rows, 1, most).alias("top_titles"))


def low(c: Column) -> Column:
    return F.lower(t.text(c))


def texts(titles: Column) -> dict[str, Column]:
    """The texts that the rules look at; ``titles`` are a channel's top titles."""
    some = F.coalesce(titles, F.array().cast("array<string>"))
    eight, ten = F.array_join(F.slice(some, 1, 8), " "), F.array_join(F.slice(some, 1, 10), " ")
    c = {n: t.text(F.col(n)) for n in ("title", "description", "channel_title", "channel_description")}
    join = lambda *parts: F.lower(F.concat_ws(" ", *parts))
    return {
        "world": join(c["title"], c["description"], c["channel_title"], c["channel_description"], eight),
        "style": join(c["title"], c["description"], eight),
        "pull": join(ten, c["title"]),
        "patterns": join(c["title"], ten),
        "center": join(c["title"], c["description"]),
    }


def content_dna(videos: DataFrame) -> DataFrame:
    """Five texts for each video (video_id, title, description, channel_title, channel_description, top_titles)."""
    at = texts(F.col("top_titles"))
    style, pull = emotional_style(at["style"]), audience_pull(at["pull"])
    known = {
        "channel": F.coalesce("channel_title", F.lit("This creator")), "title": F.coalesce("title", F.lit("this video")),
        "world": content_world(at["world"]), "label": style["label"], "feeling": style["feeling"], "viewer_feeling": style["viewer_feeling"],
        "pull": pull["pull"], "why": pull["why"],
    }
    lines = F.transform(repeatable_patterns(at["patterns"]), lambda p: F.concat(F.lit("• "), F.upper(F.substring(p, 1, 1)), F.lower(F.substring(p, 2, 200))))
    pattern = F.concat(F.lit(r.PATTERN_HEAD), F.array_join(lines, "\n"), F.lit(r.PATTERN_TAIL))
    out = [t.squeeze(t.fill(template, **known)).alias(name) for name, template in r.DNA.items()]
    return videos.select("video_id", *out, pattern.alias("repeatable_pattern"))


def growth_snapshot(videos: DataFrame) -> DataFrame:
    """Four texts for each video (video_id, title, views, likes, comments, subscribers)."""
    n = {c: F.coalesce(c, F.lit(0)).cast("double") for c in ("views", "likes", "comments", "subscribers")}
    rate = F.when(n["views"] > 0, (n["likes"] + n["comments"]) / n["views"] * 100).otherwise(F.lit(0.0))
    momentum = F.when(n["views"] > n["subscribers"] * 0.25, r.MOMENTUM[0]).when(n["views"] > n["subscribers"] * 0.1, r.MOMENTUM[1]).otherwise(r.MOMENTUM[2])
    strongest = F.when(t.any_of(low(F.col("title")), r.MOMENT_WORDS), r.STRENGTH[0]).otherwise(r.STRENGTH[1])
    chance = F.when(rate < 2, r.OPPORTUNITY[0]).when(rate < 5, r.OPPORTUNITY[1]).otherwise(r.OPPORTUNITY[2])
    return videos.select(
        "video_id", rate.alias("engagement_rate"), momentum.alias("current_momentum"), strongest.alias("strongest_area"),
        chance.alias("growth_opportunity"), F.lit(r.NEXT_MOVE).alias("next_best_move"),
    )


def narrative(videos: DataFrame) -> DataFrame:
    """Context, scene, insight and meaning texts of each video (video_id, title, description)."""
    center = emotional_center(F.lower(F.concat_ws(" ", t.text(F.col("title")), t.text(F.col("description")))))
    rows = videos.select("video_id", center.alias("c")).select("video_id", "c.*")
    known = {"center": F.col("center"), "desire": F.col("audience_desire"), "advantage": F.col("creator_advantage"), "direction": F.col("growth_direction")}
    known |= {f"{k}_lower": F.lower(c) for k, c in known.items()}
    known |= {k: F.lit(v.lower()) for k, v in r.VISION_STUB.items()}
    out = [t.fill(template, **known).alias(name) for name, template in r.NARRATIVE.items()]
    return rows.select("video_id", *rows.columns[1:], F.array(*map(F.lit, r.CURRENCY)).alias("emotional_currency"), *out)


def vision_stub(frames: DataFrame, key: str = "video_id") -> DataFrame:
    """Frame counts, first ten frames and fixed texts for each video (key, frame_no, origin)."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct("frame_no", "origin"))), lambda x: x["origin"])
    rows = frames.groupBy(key).agg(listed.alias("f"))
    fixed = [F.lit(v).alias(k) for k, v in r.VISION_STUB.items()]
    return rows.select(
        key, F.size("f").cast("bigint").alias("frame_count"), F.slice("f", 1, 10).alias("frames_analyzed"), *fixed,
        F.lit(True).alias("is_placeholder"), F.lit(r.VISION_NOTE).alias("note"),
    )
