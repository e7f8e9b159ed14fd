"""Landed responses to tables: videos, channels, recent uploads, frames, model answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from vidcohort.functions import text as t

RECENT = 12
_thumb = T.MapType(T.StringType(), T.StructType([T.StructField("url", T.StringType())]))


def _fields(*names: str) -> list[T.StructField]:
    return [T.StructField(n, T.StringType()) for n in names]


_snippet = T.StructType([*_fields("title", "description", "channelTitle", "channelId", "publishedAt"), T.StructField("thumbnails", _thumb)])
VIDEO_ITEMS = T.StructType([T.StructField("items", T.ArrayType(T.StructType([
    T.StructField("id", T.StringType()), T.StructField("snippet", _snippet),
    T.StructField("statistics", T.StructType(_fields("viewCount", "likeCount", "commentCount"))),
    T.StructField("contentDetails", T.StructType(_fields("duration"))),
])))])
CHANNEL_ITEMS = T.StructType([T.StructField("items", T.ArrayType(T.StructType([
    T.StructField("id", T.StringType()), T.StructField("snippet", _snippet),
    T.StructField("statistics", T.StructType(_fields("subscriberCount", "viewCount", "videoCount"))),
    T.StructField("contentDetails", T.StructType([T.StructField("relatedPlaylists", T.StructType(_fields("uploads")))])),
])))])
OBSERVATION = T.StructType(_fields(
    "opening_type", "attention_focus", "first_meaningful_action", "movement_progression", "emotional_impression", "visual_focus", "confidence",
))


def thumbnail(thumbs: Column, sizes: list[str]) -> Column:
    """URL of the first size there is; empty if there is none."""
    return F.coalesce(*[F.try_element_at(thumbs, F.lit(s))["url"] for s in sizes], F.lit(""))


def _items(raw: DataFrame, schema: T.StructType) -> DataFrame:
    """One row an item; ``raw`` is a JSON text column ``value`` or already has ``items``."""
    if "items" not in raw.columns:
        raw = raw.select(F.from_json("value", schema)["items"].alias("items"))
    return raw.select(F.explode("items").alias("i")).select("i.*")


def read_landed(spark: SparkSession, path: str, schema: T.StructType, streaming: bool = False) -> DataFrame:
    """Landed JSON responses as rows of items; no inference, so the schema never depends on the data."""
    reader = spark.readStream if streaming else spark.read
    return reader.schema(schema).option("multiLine", True).json(path)


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    """(origin, value) of landed files, each as it is, for ``checked``; Spark reads no file without bytes."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("origin"), F.col("content").cast("string").alias("value"))


#: Why something is put aside, in the order in which it is looked at.
REASONS = ["not_json", "no_items", "no_id", "no_snippet"]


def checked(raw: DataFrame, schema: T.StructType) -> DataFrame:
    """(origin, item_pos, reason, item, value): every item of the responses (origin, value), and every response without items.

    ``reason`` is null for an item that can be used. A response that is no JSON, or has another shape, is one row with its
    text and no item; so is one without items. Nothing is dropped.
    """
    told = T.StructType([*schema.fields, T.StructField("_bad", T.StringType())])
    parsed = F.from_json("value", told, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    rows = raw.select("origin", "value", parsed.alias("r"))
    whole = F.when(F.col("r").isNull() | F.col("r._bad").isNotNull(), REASONS[0]).when(F.size(F.coalesce("r.items", F.array())) == 0, REASONS[1])
    rows = rows.select("origin", "value", whole.alias("whole"), F.posexplode_outer(F.when(whole.isNull(), F.col("r.items"))).alias("item_pos", "item"))
    item = F.when(F.trim(F.coalesce("item.id", F.lit(""))) == "", REASONS[2]).when(F.col("item.snippet").isNull(), REASONS[3])
    reason = F.coalesce("whole", item)
    return rows.select("origin", "item_pos", reason.alias("reason"), "item", F.when(reason.isNotNull(), F.col("value")).alias("value"))


def usable(rows: DataFrame) -> DataFrame:
    """The items that can be used, for ``videos`` and ``channels``."""
    return rows.where("reason is null").select(F.array("item").alias("items"))


def put_aside(rows: DataFrame) -> DataFrame:
    """(origin, item_pos, reason, value) of the rest, with the text of the response."""
    return rows.where("reason is not null").select("origin", "item_pos", "reason", "value")


def quality(rows: DataFrame) -> DataFrame:
    """(origin, usable, not_json, no_items, no_id, no_snippet): counts by origin."""
    return rows.groupBy("origin").agg(F.count_if(F.col("reason").isNull()).alias("usable"), *[F.count_if(F.col("reason") == r).alias(r) for r in REASONS])


def videos(raw: DataFrame) -> DataFrame:
    i = _items(raw, VIDEO_ITEMS)
    s, n = F.col("snippet"), F.col("statistics")
    return i.select(
        F.col("id").alias("video_id"), t.clean_markup(s["title"]).alias("title"), t.clean_markup(s["description"]).alias("description"),
        t.clean_markup(s["channelTitle"]).alias("channel_title"), s["channelId"].alias("channel_id"), s["publishedAt"].alias("published_at"),
        thumbnail(s["thumbnails"], ["maxres", "high", "medium", "default"]).alias("thumbnail"),
        t.safe_int(n["viewCount"]).alias("views"), t.safe_int(n["likeCount"]).alias("likes"), t.safe_int(n["commentCount"]).alias("comments"),
        F.col("contentDetails.duration").alias("duration"),
    )


def channels(raw: DataFrame) -> DataFrame:
    i = _items(raw, CHANNEL_ITEMS)
    s, n = F.col("snippet"), F.col("statistics")
    return i.select(
        F.col("id").alias("channel_id"), t.clean_markup(s["title"]).alias("title"), t.clean_markup(s["description"]).alias("description"),
        s["publishedAt"].alias("published_at"), thumbnail(s["thumbnails"], ["high", "medium", "default"]).alias("thumbnail"),
        t.safe_int(n["subscriberCount"]).alias("subscribers"), t.safe_int(n["viewCount"]).alias("total_views"), t.safe_int(n["videoCount"]).alias("video_count"),
        F.col("contentDetails.relatedPlaylists.uploads").alias("uploads_playlist_id"),
    )


def recent_uploads(playlist: DataFrame, videos: DataFrame, most: int = RECENT) -> DataFrame:
    """(channel_id, pos, video_id, title, views, likes, comments): first items of each channel's list that have details.

    ``playlist`` has channel_id, video_id and item_pos. Items without an id do not take a place.
    """
    order = Window.partitionBy("channel_id").orderBy("item_pos", "video_id")
    first = playlist.where(t.text(F.col("video_id")) != "").withColumn("pos", F.row_number().over(order)).where(F.col("pos") <= most)
    facts = videos.select("video_id", "title", "views", "likes", "comments")
    return first.join(facts, "video_id").select("channel_id", "pos", "video_id", "title", "views", "likes", "comments")


def video_context(requests: DataFrame, videos: DataFrame, channels: DataFrame, recent: DataFrame) -> DataFrame:
    """A row a request (subject_id, url): its video, channel and number of recent uploads; failed without a video or channel."""
    asked = requests.withColumn("video_id", F.coalesce(t.video_id_loose(F.col("url")), F.trim("url")))
    c = channels.select("channel_id", F.col("title").alias("channel_name"), F.col("subscribers"))
    n = recent.groupBy("channel_id").agg(F.count("*").alias("recent_count"))
    rows = asked.join(videos.select("video_id", "title", "views", "channel_id", F.lit(True).alias("found")).hint("merge"), "video_id", "left")
    rows = rows.join(c, "channel_id", "left").join(n, "channel_id", "left")
    status = F.when(F.col("found").isNull(), "failed").when(F.col("channel_name").isNull(), "failed").otherwise("success")
    return rows.select("subject_id", "video_id", "title", "views", "channel_id", "channel_name", "subscribers", F.coalesce("recent_count", F.lit(0)).alias("recent_count"), status.alias("status"))


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    """(video_id, frame_no, origin, height, width, data) of image files ``<video>_intro/frame_NNN.jpg``; broken files are dropped."""
    rows = spark.read.format("image").option("dropInvalid", True).option("recursiveFileLookup", True).load(path).select("image.*")
    return rows.select(
        F.regexp_extract("origin", r"([^/]+)_intro/[^/]*$", 1).alias("video_id"),
        F.regexp_extract("origin", r"frame_(\d+)", 1).cast("int").alias("frame_no"), "origin", "height", "width", "nChannels", "data",
    )


# Fixed value: what is told of an intro without frames.
NO_FRAMES = "No intro frames available for VLM observation."


def observations(intros: DataFrame, answers: DataFrame, key: str) -> DataFrame:
    """The observation of each intro (key, n_frames) from a model's answers (key, text).

    An intro without frames has failed, whatever the answers say; so has one without an answer.
    """
    said = parse_observations(intros.select(key, "n_frames").join(answers.select(key, "text").hint("merge"), key, "left"), [key, "n_frames"])
    no_frames = F.coalesce("n_frames", F.lit(0)) <= 0
    fields = [F.when(~no_frames, F.col(n)).alias(n) for n in OBSERVATION.names[:-1]]
    return said.select(
        key, F.when(no_frames, "failed").otherwise(F.col("status")).alias("status"), *fields,
        F.when(no_frames, "low").otherwise(F.col("confidence")).alias("confidence"), F.when(no_frames, NO_FRAMES).otherwise(F.col("warning")).alias("warning"),
    )


def parse_observations(raw: DataFrame, ids: list[str]) -> DataFrame:
    """Answers of a model (ids, text) as columns; broken JSON and missing text give a failed row with a warning."""
    body = t.json_text(F.col("text"))
    valid = F.try_parse_json(body).isNotNull() & (body != "")
    o = F.from_json(body, OBSERVATION)
    rows = raw.select(*ids, valid.alias("valid"), F.when(valid, o).alias("o"))
    return rows.select(
        *ids, F.when(F.col("valid"), "success").otherwise("failed").alias("status"), *[F.col(f"o.{n}").alias(n) for n in OBSERVATION.names[:-1]],
        F.coalesce("o.confidence", F.lit("low")).alias("confidence"), F.when(~F.col("valid"), "VLM observation failed").alias("warning"),
    )
