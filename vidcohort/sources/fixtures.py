"""Stand-in views over the given tables, which hold no videos."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: One of so many videos is a subject.
SUBJECT_EVERY = 20
SUBJECT_FRAMES, BENCHMARK_FRAMES = 15, 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A video for every part; views, likes and comments follow its order lines."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(
        F.sum("l_quantity").cast("bigint").alias("quantity"),
        F.sum(F.when(F.col("l_returnflag") == "R", 1).otherwise(0)).alias("likes"),
        F.count_distinct("l_orderkey").alias("comments"),
    )
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type", "p_brand")
    return parts.join(lines.hint("merge"), F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("p_partkey").alias("k"),
        F.concat(F.lit("v"), F.lpad(F.col("p_partkey").cast("string"), 10, "0")).alias("video_id"),
        F.concat("p_name", F.lit(" | "), "p_type", F.lit(" - m"), F.substring("p_brand", 7, 100)).alias("title"),
        F.lit("").alias("description"),
        F.col("p_brand").alias("channel_id"),
        F.col("p_brand").alias("channel_title"),
        (F.col("quantity") * (F.col("p_partkey") % 11)).alias("views"),
        "likes",
        "comments",
    )


def channels(videos: DataFrame) -> DataFrame:
    """Channels of the videos; subscribers follow their mean views."""
    number = F.expr("cast(substr(channel_id, 7) as int)")
    return videos.groupBy("channel_id").agg(F.avg("views").alias("mean")).select(
        "channel_id", F.col("channel_id").alias("title"), F.lit("").alias("description"),
        F.floor(F.col("mean") * (2 + number % 12)).cast("bigint").alias("subscribers"),
    )


def subjects(videos: DataFrame) -> DataFrame:
    return videos.where(F.col("k") % SUBJECT_EVERY == 0).withColumn("subject_id", F.col("video_id"))


def frame_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A frame for each of a user's first events."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "value")
    rows = e.withColumn("frame_no", F.row_number().over(order)).where(F.col("frame_no") <= SUBJECT_FRAMES)
    user, event = F.col("user_id"), F.col("event_id")
    return rows.select(
        user.alias("video_no"), "frame_no",
        (F.col("value") * 0.5 + (user % 7) * 35).alias("luma"),
        (F.col("value") * (0.04 + (user % 5) * 0.08)).alias("diff"),
        ((user * 31 + event % 40) % 180).cast("double").alias("mean_hue"),
        (event % 10).alias("valid_px"),
        (((user * 7 + event * 3) % 20).cast("double") / 100).alias("edge_density"),
        F.when(user % 3 == 0, event % 2).otherwise(0).alias("face_count"),
    )


def frame_grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten 8 x 8 gray grids a video from the embeddings."""
    return table(spark, sf_dir, "embeddings").select(
        F.expr("vec_id div 10").alias("video_no"), (F.col("vec_id") % 10).alias("frame_no"),
        F.transform("embedding", lambda x: F.greatest(F.lit(0.0), F.least(F.lit(255.0), 128 + 400 * x.cast("double")))).alias("gray_grid"),
    )


def urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every shape of a video URL, by page; the id is taken from the page's own URL, and one page in eight keeps its own."""
    i = F.col("page_id")
    v = F.substring(F.md5(F.coalesce("url", F.lit(""))), 1, 11)
    forms = [("https://www.youtube.com/watch?v=", "&t=3"), ("https://youtu.be/", "?si=x"), ("https://m.youtube.com/shorts/", ""), ("https://youtube.com/embed/", "?a=b"), ("https://music.youtube.com/live/", ""), ("http://www.youtube.com/v/", ""), ("", "")]
    out = F.col("url")
    for k, (before, after) in enumerate(forms):
        out = F.when(i % 8 == k, F.concat(F.lit(before), v, F.lit(after))).otherwise(out)
    return table(spark, sf_dir, "pages").select("page_id", out.alias("url"))


def observations_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of a model: fenced, bare and broken JSON from assistant turns."""
    c = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    body = F.concat(F.lit('{"opening_type":"t'), F.col("turn").cast("string"), F.lit('","visual_focus":"w'), F.length("text").cast("string"), F.lit('","confidence":"high"}'))
    shaped = F.when(F.col("conv_id") % 7 == 0, F.concat(F.lit("```json\n{"), body, F.lit("\n```"))).when(F.col("conv_id") % 5 == 0, body).otherwise(F.concat(F.lit("```json\n"), body, F.lit("\n```")))
    return c.select("conv_id", "turn", shaped.alias("text"))


def keyword_videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents with a keyword after them as titles, their sources as descriptions."""
    from vidcohort.functions.rules import SAMPLE_KEYWORDS

    word = F.element_at(F.array(*map(F.lit, SAMPLE_KEYWORDS)), (F.col("doc_id") % len(SAMPLE_KEYWORDS) + 1).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(F.coalesce("text", F.lit("")), F.lit(" "), word).alias("title"), F.col("source").alias("description"))


def intro_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(video_no, acquisition_status, n_frames, warnings): one intro in ten could not be acquired."""
    rows = table(spark, sf_dir, "events").groupBy("user_id").agg(F.least(F.count("*"), F.lit(SUBJECT_FRAMES)).alias("n"))
    failed = F.col("user_id") % 10 == 9
    return rows.select(
        F.col("user_id").alias("video_no"), F.when(failed, "failed").otherwise("success").alias("acquisition_status"),
        F.when(failed, 0).otherwise(F.col("n")).cast("bigint").alias("n_frames"),
        F.when(failed, F.array(F.lit("The intro could not be acquired."))).otherwise(F.array().cast("array<string>")).alias("warnings"),
    )


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, text): the first answer of each conversation."""
    first = F.min_by("text", "turn").alias("text")
    return observations_raw(spark, sf_dir).groupBy("conv_id").agg(first)


def field_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, text): the first answer of each conversation as a model's JSON, its words dealt to the fields in turn; one in seven is broken."""
    from vidcohort.operators.semantic import FIELDS

    first = table(spark, sf_dir, "conversations").where("role = 'assistant'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("said"))
    every = lambda i: F.filter(F.split("said", " "), lambda w, p: p % len(FIELDS) == i)
    dealt = [F.array_join(every(i), " ").alias(n) for i, n in enumerate(FIELDS)]
    body = F.to_json(F.struct(*dealt, F.lit("high").alias("confidence")))
    shaped = F.when(F.col("conv_id") % 7 == 0, F.concat(F.lit("{"), body)).otherwise(F.concat(F.lit("```json\n"), body, F.lit("\n```")))
    return first.select("conv_id", shaped.alias("text"))


def video_observations(spark: SparkSession, sf_dir: str, videos: DataFrame) -> DataFrame:
    """(video_id, status, fields) of all videos; conversations stand in for what a model said of them."""
    from vidcohort.sources import ingest

    n = table(spark, sf_dir, "conversations").agg((F.max("conv_id") + 1).alias("n"))
    said = ingest.parse_observations(field_answers(spark, sf_dir), ["conv_id"])
    return videos.select("video_id", (F.col("k") % n.scalar()).alias("conv_id")).join(said, "conv_id").drop("conv_id")


def responses(videos: DataFrame) -> DataFrame:
    """(origin, value): responses as they land, of up to two videos each; some are cut off, of another shape, or have items without an id."""
    k = F.col("k")
    snippet = F.struct("title", F.col("channel_id").alias("channelId"))
    one = F.struct(F.when(k % 17 != 0, F.col("video_id")).alias("id"), F.when(k % 19 != 0, snippet).alias("snippet"), F.struct(F.col("views").cast("string").alias("viewCount")).alias("statistics"))
    pairs = videos.groupBy(F.expr("k div 2").alias("r")).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", one.alias("item")))), lambda x: x["item"]).alias("items"))
    body = F.to_json(F.struct("items"))
    r = F.col("r")
    value = F.when(r % 13 == 0, F.substring(body, 1, 25)).when(r % 11 == 0, F.lit('{"items":[]}')).when(r % 7 == 0, F.lit('{"error":"quota"}')).otherwise(body)
    return pairs.select(F.concat(F.lit("f"), (r % 50).cast("string")).alias("origin"), value.alias("value"))


def benchmark_states(video_no: Column) -> Column:
    """What became of a benchmark's intro: one in ten failed, one in ten was skipped."""
    return F.when(video_no % 10 == 9, "failed").when(video_no % 10 == 8, "skipped").otherwise("success")
