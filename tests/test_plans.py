"""The local plan, adapters, sinks and streams on small tables; and the registry's contract."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from quillspark.functions import text as X
from quillspark.operators.options import LocalOptions
from quillspark.plans import local
from quillspark.sources import adapters, names, sinks
from quillspark.streaming import sessions


@pytest.fixture
def tables(spark):
    units = spark.createDataFrame([("v", 1, "u1", "Once upon a time.", 0.0, 3.0, "asr"), ("v", 2, "u2", "The cat went home.", 4.0, 7.0, "asr")], "video string, unit_seq int, unit_id string, text string, start double, end double, source string").withColumn("normalized", X.local_clean(F.col("text")))
    lines = [(i, t, i * 0.5) for i, t in enumerate(["once upon a time"] * 6 + ["the cat went home"] * 6)]
    obs = spark.createDataFrame([("v", i, ts, t, t, 0.9, 0.9, len(t.split()), "") for i, t, ts in lines], "video string, obs_seq int, ts double, text string, normalized string, conf double, ink double, word_count int, page_id string")
    pages = spark.createDataFrame([("v", 1, "page-0001", 0.0, 8.0, "scene")], "video string, page_seq int, page_id string, start double, end double, source string")
    stories = spark.createDataFrame([("v", 0.0, 100.0)], "video string, story_start double, story_end double")
    return units, obs, pages, stories


def test_local_plan(tables, tmp_path):
    units, obs, pages, stories = tables
    got = local.run(units, obs, pages, stories, LocalOptions(captions="off")).orderBy("ts").collect()
    assert [r["chosen"] for r in got] == ["once upon a time", "the cat went home"]
    forced = local.run(units, obs, pages, stories, LocalOptions(captions="force")).collect()
    assert {r["output"] for r in forced} == {"caption"} and len(forced) == 2
    assert local.scan_frames(units, pages, stories, LocalOptions()).count() == 64


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("v", 1, 1.25, "u1", "a|b", "ab", 10.0, "clean", ["x:1", "y"], "p")], "video string, sel_seq int, ts double, unit_id string, transcript string, chosen string, score double, status string, warnings array<string>, page_id string")
    sinks.write_review(rows, str(tmp_path))
    back = spark.read.option("header", True).csv(f"{tmp_path}/review").first()
    assert (back["timestamp"], back["warnings"], back["index"]) == ("1.250", "x:1;y", "1")
    assert "a\\|b" in spark.read.text(f"{tmp_path}/index").first()["value"]


def test_adapters(spark):
    frames = spark.createDataFrame([("v", 0), ("v", 250)], "video string, ms long")
    got = adapters.observe(frames, adapters.ocr_backend("fake")).collect()
    assert len(got) == 2 and got[0]["boxes"][0]["text"]
    with pytest.raises(ValueError):
        adapters.ocr_backend("none")
    assert adapters.transcribe(frames.select("video").distinct(), adapters.FakeSpeech()).count() == 3


def test_names(spark):
    rows = spark.createDataFrame([("a/b.MP4",), ("a/b.mp4.part",), ("x.vtt",)], "p string")
    assert [r[0] for r in rows.select(names.is_video(F.col("p"))).collect()] == [True, False, False]


def test_stream_of_sessions(spark, tmp_path):
    rows = [("v", s, "one two" if s < 4 else "later words here", 2 + (s >= 4)) for s in (0, 3, 9, 100)]
    df = spark.createDataFrame(rows, "video string, s int, text string, word_count int")
    df.select("video", F.timestamp_seconds("s").alias("at"), "text", "word_count").write.parquet(f"{tmp_path}/in")
    sessions.start(sessions.gap_sessions(sessions.read(spark, f"{tmp_path}/in")), f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination(60)
    got = sorted((r["n"], r["text"]) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == [(1, "later words here"), (2, "one two")]


def test_registry():
    known, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(known) and len(known) > 70
    assert callable(__spark_entry__.entry)


@pytest.fixture
def long_documents(spark, tmp_path):
    """Two observations a quarter of an hour apart whose documents differ from character 161 on."""
    start = "the same first words of it " * 6
    spark.createDataFrame([(0, start + "a cat went home " * 40), (1, start + "other birds flew south " * 40)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    events = [(k, 7, "purchase", float(k), f"2024-01-01 00:{15 * k:02d}:00") for k in range(2)]
    rows = spark.createDataFrame(events, "event_id long, user_id long, event_type string, value double, at string")
    rows.select("event_id", "user_id", "event_type", "value", F.col("at").cast("timestamp_ntz").alias("ts")).write.parquet(f"{tmp_path}/events.parquet")
    return str(tmp_path)


def test_whole_texts(spark, long_documents):
    from quillspark.plans import interval_queries as plans

    # alike over their first 160 characters, so one session; not as whole texts
    assert plans.sessionise_full(spark, long_documents).count() == 2
    assert {r["n"] for r in plans._unit_texts(spark, long_documents).select(F.length("text").alias("n")).collect()} == {162 + 640, 162 + 920}


def test_lookups(spark):
    from quillspark.sources import lookup

    rows = [("d", "a-x1.mp4", 5, 1), ("d", "x1.mkv", 5, 3), ("d", "a-x1.mp4.part", 5, 9), ("d", "b-x1.webm", 0, 8), ("d", "a-x1.en.vtt", 2, 1), ("d", "a-x1.vtt", 2, 5), ("d", "a-x1.en.orig.vtt", 2, 6), ("d/e", "y.mov", 1, 1)]
    files = spark.createDataFrame(rows, "folder string, name string, size int, modified int")
    ids = spark.createDataFrame([("x1",), ("x",)], "video_id string")
    assert {r["video_id"]: r["name"] for r in lookup.cached_videos(ids, files).collect()} == {"x1": "x1.mkv", "x": None}
    assert {r["video_id"]: r["caption"] for r in lookup.cached_captions(ids, files).collect()} == {"x1": "a-x1.en.vtt", "x": "a-x1.en.vtt"}
    beside = lookup.captions_beside(spark.createDataFrame([("d", "a-x1.mp4"), ("d/e", "y.mov")], "folder string, name string"), files)
    assert {r["name"]: r["caption"] for r in beside.collect()} == {"a-x1.mp4": "a-x1.en.vtt", "y.mov": None}
    sources = spark.createDataFrame([("d/",), ("d/e/y.mov",), ("http://a/b/",), ("nothing",)], "source string")
    kinds = lambda recursive: sorted((r["source"], r["kind"], r["name"] or "") for r in lookup.expand_sources(sources, files, recursive).collect())
    assert kinds(False) == [("d", "folder", "a-x1.mp4"), ("d", "folder", "b-x1.webm"), ("d", "folder", "x1.mkv"), ("d/e/y.mov", "file", "y.mov"), ("http://a/b/", "url", ""), ("nothing", "unsupported", "")]
    assert ("d", "folder", "y.mov") in kinds(True)


def test_cached_observations(spark):
    from quillspark.sources import cache

    box = '{"text": "a", "confidence": 0.5, "x": 1, "y": 2, "width": 3, "height": 4, "page_width": 5, "page_height": 6}'
    rows = spark.createDataFrame([(1, f'{{"timestamp": 2.5, "text": "A", "normalized_text": "a", "boxes": [{box}]}}'), (2, "null"), (3, None)], "id int, json string")
    got = {r["id"]: r["o"] for r in rows.select("id", cache.decode(F.col("json"), F.lit("new.jpg")).alias("o")).collect()}
    assert got[2] is None and got[3] is None
    assert (got[1]["frame_path"], got[1]["timestamp"], got[1]["avg_confidence"], got[1]["boxes"][0]["ink_score"], got[1]["ad_boxes"]) == ("new.jpg", 2.5, 0.0, 0.0, [])
    keys = spark.createDataFrame([(1,), (2,)], "k int")
    held = spark.createDataFrame([(1, 2, "old", 1), (1, 2, "new", 5), (2, 1, "x", 1)], "k int, version int, payload string, written int")
    assert sorted((r["k"], r["hit"], r["payload"]) for r in cache.lookup(keys, held, ["k"]).collect()) == [(1, True, "new"), (2, False, None)]
