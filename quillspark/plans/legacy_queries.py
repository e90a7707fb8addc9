"""Queries over the legacy engine: turns of a conversation are candidate frames, half a second apart."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import folds, legacy
from ..operators.options import LegacyOptions
from . import views
from .registry import query, sql_legacy, sql_words

OPTIONS = LegacyOptions(story_start=0.0, story_end=12.0)


def candidates(spark, sf_dir):
    c = views.read(spark, sf_dir, "conversations").where("text is not null")
    k, clean = F.col("turn"), X.legacy_clean(F.col("text"))
    share = lambda n, m: F.pmod(k * n + F.col("conv_id"), F.lit(m)) / F.lit(float(m))
    return c.select(
        F.col("conv_id").alias("video"), k.alias("cand_seq"), (k * 0.5).alias("ts"), "text", clean.alias("normalized"), X.word_count(clean).alias("word_count"), share(7, 16).alias("conf"), share(5, 32).alias("contrast"),
        F.lit(0.0).alias("ad_overlay"), share(3, 8).alias("edge_crop"), F.floor(k / 2).cast("int").alias("group_index"), F.floor(k / 2).cast("double").alias("group_start"), (F.floor(k / 2) + 0.5).alias("group_end"),
        (F.pmod(k, F.lit(5)) + 1).cast("int").alias("group_frames"), F.pmod(k, F.lit(3)).cast("int").alias("stable_neighbors"), (share(11, 64) * 128.0).alias("score"), F.lit("original").alias("output_source"),
        F.array(*[F.pmod(k * n + 5, F.lit(256)).cast("float") for n in (1, 3, 9, 27)]).alias("thumbnail"),
    )


CANDIDATES = f"""c AS MATERIALIZED (SELECT conv_id AS video, turn AS cand_seq, turn * 0.5::DOUBLE AS ts, {sql_legacy('text')} AS normalized, len({sql_words(sql_legacy('text'))}) AS word_count, list_distinct({sql_words(sql_legacy('text'))}) AS k,
  ((turn * 7 + conv_id) % 16) / 16.0::DOUBLE AS conf, ((turn * 5 + conv_id) % 32) / 32.0::DOUBLE AS contrast, ((turn * 3 + conv_id) % 8) / 8.0::DOUBLE AS edge_crop, turn // 2 AS group_index, turn % 3 AS stable_neighbors FROM conversations WHERE text IS NOT NULL)"""


@query("legacy_neighbors", f"""WITH {CANDIDATES}, m AS (SELECT *, max(word_count) OVER (PARTITION BY video, group_index) AS most FROM c),
 p AS (SELECT a.video, a.cand_seq, count(*) AS n FROM m a JOIN m b ON a.video = b.video AND a.group_index = b.group_index AND a.cand_seq <> b.cand_seq AND abs(a.ts - b.ts) <= 0.75 AND b.word_count >= greatest(1, b.most)
  WHERE CASE WHEN len(a.k) = 0 OR len(b.k) = 0 THEN 0 ELSE len(list_intersect(a.k, b.k)) / len(list_distinct(list_concat(a.k, b.k)))::DOUBLE END >= 0.05 GROUP BY a.video, a.cand_seq)
 SELECT c.video, c.cand_seq, coalesce(n, 0)::INT AS stable_neighbors FROM c LEFT JOIN p USING (video, cand_seq)""")
def legacy_neighbors(spark, sf_dir):
    from dataclasses import replace

    from ..operators.select import jaccard_of

    return legacy.stable_neighbors(candidates(spark, sf_dir), jaccard_of, replace(OPTIONS, group_overlap=0.05)).select("video", "cand_seq", "stable_neighbors")


@query("legacy_representatives", f"""WITH {CANDIDATES}, g AS (SELECT *, min(ts) OVER v AS s, max(ts) OVER v AS e, max(word_count) OVER v AS most, count(*) OVER v AS n, max(contrast) OVER v AS top FROM c WINDOW v AS (PARTITION BY video, group_index)),
 k1 AS (SELECT *, word_count >= CASE WHEN most <= 3 THEN greatest(2, most - 1) ELSE greatest(2, most) END AS full_ FROM g), k2 AS (SELECT *, full_ OR NOT bool_or(full_) OVER (PARTITION BY video, group_index) AS ok FROM k1),
 k3 AS (SELECT *, ok AND contrast >= top * 0.7::DOUBLE AS bright FROM k2), k4 AS (SELECT *, bool_or(bright) OVER (PARTITION BY video, group_index) AS any_ FROM k3),
 k5 AS (SELECT * FROM k4 WHERE (top <= 0 AND ok) OR (top > 0 AND (bright OR (NOT any_ AND n = 1 AND ok)))),
 k6 AS (SELECT *, ts BETWEEN s + 0.75 AND e - 0.75 AND e - s > 0.75 * 2.2::DOUBLE AS mid FROM k5), k7 AS (SELECT *, bool_or(mid) OVER (PARTITION BY video, group_index) AS anymid FROM k6),
 k8 AS (SELECT *, conf * 42 + contrast * 28 + contrast / greatest(top, 0.001) * 12 + word_count / greatest(1, most)::DOUBLE * 10 + stable_neighbors * 4 + least(word_count, 18) * 0.8::DOUBLE - greatest(0.0, 0.75 - least(ts - s, e - ts)) * 14 - edge_crop * 36 AS score FROM k7 WHERE NOT anymid OR mid)
 SELECT video, cand_seq, round(score, 4) AS score FROM (SELECT *, row_number() OVER (PARTITION BY video, group_index ORDER BY round(score, 6) DESC, cand_seq) AS r FROM k8) WHERE r = 1""")
def legacy_representatives(spark, sf_dir):
    return legacy.representatives(candidates(spark, sf_dir), OPTIONS).select("video", "cand_seq", F.round("score", 4).alias("score"))


@query("legacy_groups")
def legacy_groups(spark, sf_dir):
    return folds.group_candidates(candidates(spark, sf_dir), OPTIONS).select("video", "cand_seq", "group_index", "group_frames", "group_start", "group_end")


@query("legacy_pruned")
def legacy_pruned(spark, sf_dir):
    return legacy.prune_transitions(candidates(spark, sf_dir), OPTIONS).select("video", "cand_seq")


@query("legacy_deduped")
def legacy_deduped(spark, sf_dir):
    return folds.dedupe_candidates(candidates(spark, sf_dir), OPTIONS).select("video", "cand_seq")


def _titles(rows):
    return rows.where("cand_seq = 0").select("video", X.title_tokens(F.col("normalized")).alias("title"))


@query("legacy_trimmed")
def legacy_trimmed(spark, sf_dir):
    rows = candidates(spark, sf_dir)
    return legacy.trim_edges(rows, _titles(rows), OPTIONS).select("video", "cand_seq")


@query("legacy_probes", f"""WITH {CANDIDATES}, o AS (SELECT unnest([0, 0.25, 0.5, 0.75, 1, 1.25, 1.5, 2, 2.5, 3, -0.25, -0.5])::DOUBLE AS off, unnest(range(12)) AS probe)
 SELECT video, cand_seq, CAST(round_even(t * 1000, 0) AS BIGINT) AS probe_ms, min(probe)::INT AS probe FROM (SELECT c.*, probe, round_even(ts + off, 3) AS t FROM c, o)
 WHERE t >= greatest(group_index::DOUBLE - 2.5, 0.0) AND t <= least(group_index + 0.5::DOUBLE + 2.5, 12.0) GROUP BY video, cand_seq, t""")
def legacy_probes(spark, sf_dir):
    return legacy.refinement_probes(candidates(spark, sf_dir), OPTIONS).select("video", "cand_seq", "probe_ms", "probe")
