"""Operators against plain sequential models and golden cases."""

import random

from pyspark.sql import functions as F

from quillspark.operators import folds, intervals, legacy, select
from quillspark.operators.options import LegacyOptions
from quillspark.sources import cache, vtt


def test_merge_equals_sequential(spark):
    g = random.Random(1)
    rows = [(v, float(s), float(s + g.randint(0, 6))) for v in range(5) for s in (g.randint(0, 60) for _ in range(20))]
    got = sorted(tuple(r) for r in intervals.merge(spark.createDataFrame(rows, "video int, start double, end double"), 0.25).select("video", "start", "end").collect())
    want = []
    for video in range(5):
        out = []
        for _, start, end in sorted(r for r in rows if r[0] == video):
            if out and start <= out[-1][1] + 0.25:
                out[-1][1] = max(out[-1][1], end)
            else:
                out.append([start, end])
        want += [(video, *o) for o in out]
    assert got == sorted(want)


def test_windows_of_a_story_without_units(spark):
    s = spark.createDataFrame([(1, 0.0, 9.0)], "video int, story_start double, story_end double")
    u = spark.createDataFrame([], "video int, start double, end double")
    assert [tuple(r) for r in intervals.make_windows(u, s, 2.0).select("start", "end").collect()] == [(0.0, 9.0)]


def test_gap_names(spark):
    p = spark.createDataFrame([(1, 1, "page-0001", 2.0, 4.0, "scene"), (1, 2, "page-0002", 6.0, 8.0, "scene")], "video int, page_seq int, page_id string, start double, end double, source string")
    s = spark.createDataFrame([(1, 0.0, 10.0), (2, 0.0, 1.0)], "video int, story_start double, story_end double")
    got = sorted((r["video"], r["page_id"], r["start"], r["end"]) for r in intervals.fill_page_gaps(p, s).where("source = 'gap'").collect())
    assert got == [(1, "page-gap-0001", 0.0, 2.0), (1, "page-gap-0002", 4.0, 6.0), (1, "page-gap-0003", 8.0, 10.0), (2, "page-gap-0001", 0.0, 1.0)]


def test_page_boundary_takes_the_earlier_page(spark):
    o = spark.createDataFrame([(1, 1, 4.0), (1, 2, 99.0)], "video int, obs_seq int, ts double")
    p = spark.createDataFrame([(1, 1, "a", 0.0, 4.0), (1, 2, "b", 4.0, 8.0)], "video int, page_seq int, page_id string, start double, end double")
    assert {r["obs_seq"]: r["page_id"] for r in intervals.assign_pages(o, p, 3.0).collect()} == {1: "a", 2: ""}


def test_sentences(spark):
    rows = [("v", "u1", "Where is", "where is", 1.0, 2.0, "asr"), ("v", "u2", "the big", "the big", 2.3, 3.0, "asr"), ("v", "u3", "kitty", "kitty", 3.2, 4.0, "asr")]
    u = spark.createDataFrame(rows, "video string, unit_id string, text string, normalized string, start double, end double, source string")
    got = folds.sentences(u).collect()
    assert [(r["text"], r["start"], r["end"], r["source"]) for r in got] == [("Where is the big kitty.", 1.0, 4.0, "asr-caption")]


def test_vtt(spark):
    body = "WEBVTT\n\n00:01.000 --> 00:02.000\nWhere is kitty\n\n00:03.000 --> 00:04,000\n[Music]\n\n1\n00:00:05.000 --> 00:06.500\nSubscribe now.\n"
    files = spark.createDataFrame([("v", body)], "video string, value string")
    cues = vtt.parse(files)
    assert [(r["start"], r["end"], r["text"]) for r in cues.orderBy("start").collect()] == [(1.0, 2.0, "Where is kitty"), (5.0, 6.5, "Subscribe now.")]
    s = spark.createDataFrame([("v", 0.0, 99.0)], "video string, story_start double, story_end double")
    assert [r["normalized"] for r in vtt.units(cues, s).collect()] == ["where is kitty"]


SEL = "video string, sel_seq int, unit_id string, ts double, page_id string, chosen string, score double, status string, warnings array<string>"


def pruned(spark, *rows):
    df = spark.createDataFrame([("v", i, *r, "clean", []) for i, r in enumerate(rows)], SEL)
    return [r["unit_id"] for r in folds.prune_selections(df).orderBy("ts").collect()]


def test_prune_selections(spark):
    text = "the little cat went home"
    assert pruned(spark, ("a", 10.0, "", text, 80.0), ("b", 42.0, "", text, 90.0)) == ["a", "b"]
    assert pruned(spark, ("a", 10.0, "", text, 80.0), ("b", 10.25, "", text, 120.0)) == ["b"]
    assert pruned(spark, ("asr-1", 10.0, "", text, 80.0), ("ocr-missing-2", 12.0, "", "the little cat went", 120.0)) == ["asr-1"]


def test_story_units_end(spark):
    rows = [("v", f"u{i}", "", n, float(s), float(s) + 3, "asr") for i, (n, s) in enumerate([("once upon a time there", 40), ("the cat walked far away", 60), ("the end", 80), ("more words after it all", 90)])]
    u = spark.createDataFrame(rows, "video string, unit_id string, text string, normalized string, start double, end double, source string")
    s = spark.createDataFrame([("v", 0.0, 100.0)], "video string, story_start double, story_end double")
    assert sorted(r["unit_id"] for r in select.story_units(u, s, select.jaccard_of).collect()) == ["u0", "u1", "u2"]


def test_even_sample(spark):
    rows = [("v", i, "one two three") for i in range(10)]
    got = select.even_sample(spark.createDataFrame(rows, "video string, unit_seq int, normalized string"), 4)
    assert sorted(r["unit_seq"] for r in got.collect()) == [0, 3, 6, 9]


CAND = "video string, cand_seq int, ts double, text string, normalized string, word_count int, conf double, contrast double, ad_overlay double, edge_crop double, group_index int, group_start double, group_end double, group_frames int, stable_neighbors int, score double, output_source string, thumbnail array<double>"


def candidates(spark, *rows):
    return spark.createDataFrame([("v", i, ts, t, t, len(t.split()), 0.96, 0.9, 0.0, crop, i, ts, ts, frames, near, 100.0, source, [10.0] * 12) for i, (ts, t, crop, frames, near, source) in enumerate(rows)], CAND)


def test_prune_transitions(spark):
    o = LegacyOptions()
    fragment = candidates(spark, (20.0, "i am not", 0.0, 3, 1, "scan"), (22.0, "i am not scared at all", 0.0, 9, 3, "scan"))
    assert [r["cand_seq"] for r in legacy.prune_transitions(fragment, o).collect()] == [1]
    rebuilt = candidates(spark, (20.0, "we can go with", 0.0, 9, 3, "reconstructed"), (30.0, "we can go with you now", 0.0, 9, 3, "scan"))
    assert [r["cand_seq"] for r in legacy.prune_transitions(rebuilt, o).collect()] == [1]
    far = candidates(spark, (20.0, "i am not", 0.0, 3, 1, "scan"), (60.0, "i am not scared at all", 0.0, 9, 3, "scan"))
    assert legacy.prune_transitions(far, o).count() == 2


def test_groups_representatives_and_dedupe(spark):
    o = LegacyOptions(fps=4.0)
    rows = candidates(spark, (20.0, "the cat sat", 0.0, 1, 0, "scan"), (20.5, "the cat sat down", 0.0, 1, 0, "scan"), (40.0, "other words entirely here", 0.0, 1, 0, "scan"))
    grouped = folds.group_candidates(rows, o)
    assert {r["cand_seq"]: (r["group_index"], r["group_frames"]) for r in grouped.collect()} == {0: (0, 2), 1: (0, 2), 2: (1, 1)}
    best = legacy.representatives(legacy.stable_neighbors(grouped, select.jaccard_of, o), o)
    assert sorted(r["cand_seq"] for r in best.collect()) == [1, 2]
    twice = candidates(spark, (20.0, "the cat sat", 0.0, 1, 0, "scan"), (90.0, "the cat sat", 0.0, 1, 0, "scan"))
    assert folds.dedupe_candidates(twice, o).count() == 1


def test_refine_folds_in_order(spark):
    rows = spark.createDataFrame([("v", 1, 50.0, 4, False)], "video string, cand_seq int, base_score double, word_count int, warned boolean")
    probes = spark.createDataFrame([("v", 1, 0, 4, 60.0, "a"), ("v", 1, 1, 5, 55.0, "b"), ("v", 1, 2, 4, 56.0, "c")], "video string, cand_seq int, probe int, words int, score double, payload string")
    assert legacy.refine(rows, probes).first()["refined"]["payload"] == "b"


def test_cached_null_is_a_hit(spark):
    keys = spark.createDataFrame([(1,), (2,), (3,)], "k int")
    held = spark.createDataFrame([(1, 2, None), (2, 1, "x")], "k int, version int, payload string")
    assert {r["k"]: r["hit"] for r in cache.lookup(keys, held, ["k"]).collect()} == {1: True, 2: False, 3: False}
    assert sorted(r["k"] for r in cache.misses(keys, held, ["k"]).collect()) == [2, 3]


def test_share_tokens():
    assert folds.share_tokens(list("abcd"), [2, 5]) == [["a", "b"], ["c", "d"]]
    assert folds.share_tokens(list("abcdef"), [1, 1, 1]) == [["a", "b"], ["c", "d"], ["e", "f"]]


def test_order_does_not_matter(spark):
    rows = [(1, i, float(i % 7), float(i % 7) + 1) for i in range(30)]
    a = spark.createDataFrame(rows, "video int, i int, start double, end double").drop("i")
    assert sorted(intervals.merge_windows(a).collect()) == sorted(intervals.merge_windows(a.orderBy(F.rand(3)).repartition(7)).collect())
