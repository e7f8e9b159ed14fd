import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from vidcohort.functions import text as t
from vidcohort.operators import evidence, frames
from vidcohort.sources import ingest
from vidcohort.streaming import incremental

ID = "dQw4w9WgXcQ"


def column(spark, values, fn):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r.y for r in df.withColumn("y", fn(F.col("x"))).orderBy("i").collect()]


def test_text_functions(spark):
    assert column(spark, ["12", " 12 ", "12.7", "x", "", None, "-3"], t.safe_int) == [12, 12, 0, 0, 0, 0, -3]
    assert column(spark, ["<b>a</b> &amp;quot;x&#39;", None, "  a<br\n>b ", "a\r<i>b"], t.clean_markup) == ['a "x\'', "", "a<br\n>b", "a\rb"]
    assert column(spark, ["  A-b C!! 9 ", None], t.normalized) == ["a b c 9", ""]
    assert column(spark, ["a A b", "", None], t.word_set) == [["a", "b"], [], []]
    assert column(spark, ["a  \n b ", None], t.squeeze) == ["a b", ""]


def test_loose_ids(spark):
    urls = {
        f"https://youtu.be/{ID}/": ID, f" https://WWW.youtube.com/watch?v={ID}&t=1 ": ID, f"https://m.youtube.com/shorts/{ID}?x": ID, f"https://youtube.com/embed/a/{ID}": "a",
        "https://notyoutube.com/watch?v=short": "short", "https://youtube.com/live/x": None, "https://example.org/?v=x": None, "plain": None, "https://youtube.com/watch?v=&x=1": None,
        "https://youtube.com/watch?v=a%20b": "a b",
    }
    assert dict(zip(urls, column(spark, list(urls), t.video_id_loose))) == urls


def test_strict_ids(spark):
    urls = {
        ID: ID, f"https://youtu.be/{ID}/x": ID, "https://youtu.be/short": None, f"https://www.youtube.com/watch?v={ID}": ID, f"https://youtube.com/watch?v=bad&x=/shorts/{ID}": None,
        f"https://youtube.com/shorts/{ID}?v=bad": ID, f"https://music.youtube.com/live/{ID}": ID, "https://youtube.com/v/short": None, f"https://evil.youtube.com.org/v/{ID}": None, "": None,
    }
    assert dict(zip(urls, column(spark, list(urls), t.video_id_strict))) == urls
    assert column(spark, [ID, "x"], t.canonical_url) == [t.WATCH + ID, None]


def hypotheses_model(title, description=""):
    import re

    clean = re.sub(r"\s+", " ", re.sub(r"[^a-zA-Z0-9\s|:\-']", " ", re.sub(r"http\S+", " ", title or ""))).strip()
    query = lambda s: re.sub(r"\s+", " ", re.sub(r"[^a-zA-Z0-9\s]", " ", s)).strip()
    strong = lambda s: " ".join(w for w in s.split() if w.lower() not in t.WEAK_WORDS)
    found = []
    for part in [*re.split(r"[|:-]", clean), clean]:
        for s in (strong(query(part)), query(part)):
            if len(s.split()) >= 2 and s.lower() not in [x.lower() for x in found]:
                found.append(s)
    whole = query(title or description or "")
    return found[:8] or [x for x in [strong(whole) or whole] if x]


def test_hypotheses(spark):
    titles = ["Big Cat - official trailer | The Wild Life: part 2", "big cat | BIG CAT", "trailer", "", None, "one-two", "A b - c d - e f - g h - i j - k l", "see http://x.y/z now it's on", "Full Video"]
    df = spark.createDataFrame([(i, x, "some words") for i, x in enumerate(titles)], "i int, t string, d string")
    got = [r.q for r in df.withColumn("q", t.hypotheses(F.col("t"), F.col("d"))).orderBy("i").collect()]
    assert got == [hypotheses_model(x, "some words") for x in titles]


def test_observations(spark):
    texts = ['```json\n{"opening_type": "x"}\n```', '{"confidence": "high", "visual_focus": "y"}', "```\n{}\n```", "{broken", "", None, '```json\n{"a": 1}']
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, text string")
    rows = sorted(ingest.parse_observations(df, ["i"]).collect(), key=lambda r: r.i)
    assert [r.status for r in rows] == ["success", "success", "success", "failed", "failed", "failed", "success"]
    assert rows[0].opening_type == "x" and rows[0].confidence == "low" and rows[1].confidence == "high" and rows[3].warning


def test_landed_responses_and_stream(spark, tmp_path):
    item = lambda i, thumbs, views="7": {"id": i, "snippet": {"title": "<b>T</b>", "thumbnails": thumbs}, "statistics": {"viewCount": views}, "contentDetails": {"duration": "PT1S"}}
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text(json.dumps({"items": [item("a", {"default": {"url": "d"}, "high": {"url": "h"}}), item("b", {})]}))
    (tmp_path / "in/b.json").write_text(json.dumps({"items": []}))
    rows = {r.video_id: r for r in ingest.videos(ingest.read_landed(spark, str(tmp_path / "in"), ingest.VIDEO_ITEMS)).collect()}
    assert rows.keys() == {"a", "b"} and rows["a"].thumbnail == "h" and rows["b"].thumbnail == "" and rows["a"].views == 7 and rows["a"].likes == 0 and rows["a"].title == "T"
    for views, extra in ((8, "b"), (5, "c")):
        (tmp_path / f"in/{extra}2.json").write_text(json.dumps({"items": [item(extra, {}), item("a", {}, str(views)), item("a", {}, "1"), item(None, {})]}))
        incremental.stream_videos(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
    got = incremental.latest_videos(spark, str(tmp_path / "out")).collect()
    assert sorted((r.video_id, r.views) for r in got) == [("a", 5), ("b", 7), ("c", 7)]


def test_missing_channel_gives_a_failed_row(spark):
    videos = spark.createDataFrame([("a", "t", 5, "c1"), ("b", "t", 5, "gone"), ("c", "t", 5, None)], "video_id string, title string, views long, channel_id string")
    channels = spark.createDataFrame([("c1", "C", 9)], "channel_id string, title string, subscribers long")
    recent = spark.createDataFrame([], "channel_id string, video_id string")
    asked = spark.createDataFrame([(i, i) for i in ("a", "b", "c", "none")], "subject_id string, url string")
    got = {r.subject_id: r.status for r in ingest.video_context(asked, videos, channels, recent).collect()}
    assert got == {"a": "success", "b": "failed", "c": "failed", "none": "failed"}


def test_frames_and_pixels(spark, tmp_path):
    import struct
    import zlib

    def png(path, rgb, w=32, h=20):
        raw = b"".join(b"\0" + bytes(rgb) * w for _ in range(h))
        chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
        path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))

    folder = tmp_path / "v1_intro"
    folder.mkdir()
    png(folder / "frame_001.png", (255, 0, 0))
    png(folder / "frame_002.png", (0, 0, 255))
    (folder / "frame_003.png").write_bytes(b"broken")
    rows = sorted(frames.frame_metrics(ingest.read_frames(spark, str(tmp_path))).collect(), key=lambda r: r.frame_no)
    assert [(r.video_id, r.frame_no) for r in rows] == [("v1", 1), ("v1", 2)]
    assert rows[0].luma == pytest.approx(76) and rows[0].mean_hue == 0 and rows[1].luma == pytest.approx(29) and rows[1].mean_hue == 120
    assert rows[0].valid_px == 640 and len(rows[0].gray_grid) == 160 * 90 and np.allclose(rows[0].gray_grid, 76)


def test_evidence(spark):
    a = spark.createDataFrame([("v", "clip", "failed", 3), ("w", "clip", "ok", 2)], "video_id string, method string, status string, frames int")
    b = spark.createDataFrame([("v", "page", "ok", "t"), ("w", "page", "ok", "t")], "video_id string, method string, status string, thumbnails string")
    rows = evidence.completeness(evidence.unified([a, b]))
    assert {r.completeness for r in rows.collect()} == {0.25}
    assert {(r.video_id, r.method) for r in evidence.best_method(rows, ["clip", "page"]).collect()} == {("v", "page"), ("w", "clip")}
    rates = {(r.method, r.platform): r.failure_rate for r in evidence.failure_rates(rows.withColumn("platform", F.lit("p"))).collect()}
    assert rates["clip", "p"] == 0.5 and rates[None, None] == 0.25


def test_small_pictures_are_measured_a_few_at_a_time(spark):
    """A picture of 8 x 8 has a grid of 14,400 cells, so that ten thousand at once would take over a gigabyte."""
    bound = frames.at_once(8, 8) * frames.GRID_HEIGHT * frames.GRID_WIDTH * 8
    assert bound <= frames.AT_ONCE and frames.at_once(10_000, 10_000) == 1
    pixels = spark.range(300).selectExpr("cast(id as string) video_id", "cast(id as int) frame_no", "8 height", "8 width", "3 nChannels", "unhex(repeat(lpad(hex(id % 256), 2, '0'), 192)) data")
    rows = {r.frame_no: r for r in frames.frame_metrics(pixels).select("frame_no", "luma", F.size("gray_grid").alias("n"), F.array_max("gray_grid").alias("high")).collect()}
    assert len(rows) == 300 and all((r.luma, r.n, r.high) == (i % 256, 14_400, i % 256) for i, r in rows.items())
