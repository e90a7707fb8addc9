"""Queries over windows, pages, sessions and joins in time."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import words as W
from ..operators import folds, intervals, select, shared
from . import views
from .registry import query, sql_any, sql_jaccard, sql_local, sql_words

_U = f"u AS MATERIALIZED ({views.UNITS}), s AS ({views.STORIES})"
_O = f"o AS MATERIALIZED ({views.OBSERVATIONS})"
#: Observations with the words of their documents, and pairs of documents with what they share.
_W = f"{views.WORDS}, {views.SHARED}, o AS MATERIALIZED ({views.OBSERVED_WORDS})"
_P = f"p AS MATERIALIZED ({views.PAGES})"


def _merge(source: str, gap: str) -> str:
    return f"""SELECT video, min(start) AS start, max("end") AS "end" FROM (SELECT *, sum(fresh) OVER (PARTITION BY video ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS island FROM (
  SELECT *, CASE WHEN start > max("end") OVER (PARTITION BY video ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + {gap}::DOUBLE THEN 1
  WHEN max("end") OVER (PARTITION BY video ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) IS NULL THEN 1 ELSE 0 END AS fresh FROM ({source}))) GROUP BY video, island"""


_PADDED = 'SELECT u.video, greatest(story_start, start - 2.0) AS start, least(story_end, "end" + 2.0) AS "end" FROM u JOIN s USING (video)'


def _us(spark, sf_dir):
    u = views.units(spark, sf_dir)
    return u, views.stories(u)


@query("make_windows", f"WITH {_U} {_merge(_PADDED, '0.25')}")
def make_windows(spark, sf_dir):
    u, s = _us(spark, sf_dir)
    return intervals.make_windows(u, s, 2.0)


@query("merge_windows", f"WITH {_U} " + _merge('SELECT video, start, "end" - 1.5 + unit_seq % 2 AS "end" FROM u WHERE "end" - 1.5 + unit_seq % 2 > start', "0.05"))
def merge_windows(spark, sf_dir):
    u, _ = _us(spark, sf_dir)
    return intervals.merge_windows(u.select("video", "start", (F.col("end") - 1.5 + F.col("unit_seq") % 2).alias("end")))


_SHORT = 'SELECT video, page_seq, page_id, start, start + ("end" - start) * 0.75 AS "end", source FROM p'


def _short_pages(spark, sf_dir):
    return views.pages(spark, sf_dir).withColumn("end", F.col("start") + (F.col("end") - F.col("start")) * 0.75)


@query("page_intervals", f"WITH {_P}, st AS ({views.PAGE_STORIES}) SELECT p.video, page_id, greatest(story_start, start) AS start, least(story_end, \"end\") AS \"end\", source FROM p JOIN st USING (video) WHERE least(story_end, \"end\") > greatest(story_start, start)")
def page_intervals(spark, sf_dir):
    cuts = views.read(spark, sf_dir, "events").where("event_type = 'signup'").select(F.col("user_id").alias("video"), views._hours(F.col("ts")).alias("ts"))
    return intervals.pages_from_cuts(cuts, views.page_stories(spark, sf_dir)).drop("page_seq")


_GAPS = f"""WITH {_P}, q AS ({_SHORT}), st AS ({views.PAGE_STORIES}),
 c AS (SELECT q.video, q.start, greatest(story_start, coalesce(max("end") OVER (PARTITION BY q.video ORDER BY start, page_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), story_start)) AS cursor FROM q JOIN st USING (video)),
 l AS (SELECT st.video, story_end, greatest(story_start, coalesce(max("end"), story_start)) AS cursor FROM st LEFT JOIN q USING (video) GROUP BY st.video, story_start, story_end),
 g AS (SELECT video, cursor AS start, start AS "end" FROM c WHERE start > cursor + 0.05::DOUBLE UNION ALL SELECT video, cursor, story_end FROM l WHERE cursor < story_end - 0.05::DOUBLE)
 SELECT video, page_id, start, "end", source FROM q UNION ALL SELECT video, printf('page-gap-%04d', row_number() OVER (PARTITION BY video ORDER BY start)), start, "end", 'gap' FROM g"""


@query("fill_page_gaps", _GAPS)
def fill_page_gaps(spark, sf_dir):
    return intervals.fill_page_gaps(_short_pages(spark, sf_dir), views.page_stories(spark, sf_dir))


_WIN = "w AS (SELECT video, ts AS start, ts + 2.0 AS \"end\" FROM o)"


def _obs_windows(spark, sf_dir):
    return views.observations(spark, sf_dir).select("video", F.col("ts").alias("start"), (F.col("ts") + 2.0).alias("end"))


_GROWN = """SELECT w.video, greatest(story_start, q.start) AS start, least(story_end, q."end") AS "end" FROM w JOIN q ON w.video = q.video AND least(w."end", q."end") - greatest(w.start, q.start) > 0 JOIN st ON st.video = w.video
 UNION ALL SELECT video, start, "end" FROM w WHERE NOT EXISTS (SELECT 1 FROM q WHERE q.video = w.video AND least(w."end", q."end") - greatest(w.start, q.start) > 0)"""


@query("expand_unit_pages", f"WITH {_O}, {_P}, q AS ({_SHORT}), st AS ({views.PAGE_STORIES}), {_WIN}, z AS ({_GROWN}) {_merge('SELECT DISTINCT * FROM z WHERE \"end\" > start', '0.05')}")
def expand_unit_pages(spark, sf_dir):
    return intervals.expand_windows_to_pages(_obs_windows(spark, sf_dir), _short_pages(spark, sf_dir), views.page_stories(spark, sf_dir), "unit-pages")


@query("expand_all_pages", f"WITH {_O}, {_P}, q AS ({_SHORT}), {_WIN}, z AS (SELECT video, start, \"end\" FROM q UNION ALL SELECT video, start, \"end\" FROM w WHERE video NOT IN (SELECT video FROM q)) {_merge('SELECT DISTINCT * FROM z WHERE \"end\" > start', '0.05')}")
def expand_all_pages(spark, sf_dir):
    return intervals.expand_windows_to_pages(_obs_windows(spark, sf_dir), _short_pages(spark, sf_dir), views.page_stories(spark, sf_dir), "all-pages")


@query("sampled_milliseconds", f"WITH {_U} SELECT DISTINCT video, CAST(round_even(round_even(start + i / 8.0::DOUBLE, 3) * 1000, 0) AS BIGINT) AS ms FROM (SELECT video, start, unnest(range(0, greatest(1, ceil((\"end\" - start) * 8.0)::BIGINT))) AS i FROM u WHERE \"end\" > start)")
def sampled_milliseconds(spark, sf_dir):
    return intervals.distinct_samples(_us(spark, sf_dir)[0], 8.0)


@query("page_assign", f"WITH {_O}, {_P} SELECT o.video, obs_seq, coalesce(min_by(p.page_id, p.page_seq), '') AS page_id FROM o LEFT JOIN p ON p.video = o.video AND ts BETWEEN p.start AND p.\"end\" GROUP BY o.video, obs_seq")
def page_assign(spark, sf_dir):
    return intervals.assign_pages(views.observations(spark, sf_dir), views.pages(spark, sf_dir), 168.0).select("video", "obs_seq", "page_id")


def _shared(a: str, b: str) -> str:
    """Left join of the words that two rows' documents share."""
    return f"LEFT JOIN ov ON ov.x = {a} AND ov.y = {b}"


def _alike(a: str, b: str) -> str:
    """Jaccard of two numbers of distinct words, next to _shared()."""
    return f"(CASE WHEN coalesce({a}, 0) = 0 OR coalesce({b}, 0) = 0 THEN 0.0 ELSE coalesce(ov.c, 0) / ({a} + {b} - coalesce(ov.c, 0))::DOUBLE END)"


_SESSION = """r AS (SELECT *, lag(ts) OVER w AS lt, lag(page_id) OVER w AS lp {also} FROM o WINDOW w AS (PARTITION BY video ORDER BY ts, obs_seq)),
 i AS (SELECT *, sum(CASE WHEN lt IS NOT NULL AND (page_id = '' OR lp = '' OR page_id = lp) AND ts - lt <= 6.0 {alike} THEN 0 ELSE 1 END) OVER (PARTITION BY video ORDER BY ts, obs_seq ROWS UNBOUNDED PRECEDING) AS island FROM r {join})"""


def _observed(spark, sf_dir):
    """Observations that carry document ids, and their Jaccard index."""
    sets = views.coded_documents(spark, sf_dir)
    return views.observations(spark, sf_dir, sets), shared.SharedWords(sets, shared.jaccard)


def _sessions(spark, sf_dir, alike):
    o, measure = _observed(spark, sf_dir)
    return select.units_from_observations(o, measure, 6.0, alike)


@query("sessionise_gap", f"WITH {_O}, {_SESSION.format(also='', alike='', join='')}, g AS (SELECT video, island, min(ts) AS start, max(ts) AS \"end\", count(*) AS n FROM i GROUP BY video, island) SELECT video, start, \"end\", n FROM g")
def sessionise_gap(spark, sf_dir):
    from pyspark.sql import Window

    o = views.observations(spark, sf_dir)
    w = Window.partitionBy("video").orderBy("ts", "obs_seq")
    lag = lambda c: F.lag(c).over(w)
    joined = lag("ts").isNotNull() & select._pages_agree(F.col("page_id"), lag("page_id")) & (F.col("ts") - lag("ts") <= 6.0)
    return intervals.islands(o, joined, ["ts", "obs_seq"]).groupBy("video", "island").agg(F.min("ts").alias("start"), F.max("ts").alias("end"), F.count(F.lit(1)).alias("n")).drop("island")


_RUNS = _SESSION.format(also=", lag(doc_id) OVER w AS ld, lag(nk) OVER w AS ln", alike=f"AND {_alike('nk', 'ln')} >= 0.1", join=_shared("doc_id", "ld"))


@query("sessionise_jaccard", f"""WITH {_W}, {_RUNS},
 g AS (SELECT video, island, count(*) AS n, min(ts) AS start, max(ts) AS "end", arg_max(doc_id, row(word_count, ink, conf, ts, -obs_seq)) AS c, arg_max(nk, row(word_count, ink, conf, ts, -obs_seq)) AS nc FROM i GROUP BY video, island),
 h AS (SELECT *, lag(c) OVER v AS b, lead(c) OVER v AS a, lag(nc) OVER v AS nb, lead(nc) OVER v AS na FROM g WINDOW v AS (PARTITION BY video ORDER BY island)),
 q AS (SELECT h.*, coalesce(y.c, 0) AS cb, coalesce(z.c, 0) AS ca FROM h LEFT JOIN ov y ON y.x = h.b AND y.y = h.c LEFT JOIN ov z ON z.x = h.a AND z.y = h.c)
 SELECT video, start, "end", row_number() OVER (PARTITION BY video ORDER BY island) AS unit_seq FROM q WHERE NOT coalesce(n <= 1 AND nb > 0 AND na > 0 AND cb = nb AND ca = na AND nc > greatest(nb, na), false)""")
def sessionise_jaccard(spark, sf_dir):
    return _sessions(spark, sf_dir, 0.1).select("video", "start", "end", F.col("unit_seq").cast("long"))


@query("sessionise_full")
def sessionise_full(spark, sf_dir):
    """Sessions by state similarity.  Its second part is at most 0.55, so at 0.70 and more it is the Jaccard index of the words."""
    rows = _sessions(spark, sf_dir, 0.70).join(views.documents(spark, sf_dir).select("doc_id", "text", "normalized"), "doc_id")
    return rows.select("video", "unit_seq", "unit_id", "text", "normalized", "start", "end", "source")


_STAB = f"""WITH {_W}, pr AS (SELECT a.video, a.obs_seq, {_alike('a.nk', 'b.nk')} AS m FROM o a JOIN o b ON a.video = b.video AND a.obs_seq <> b.obs_seq AND abs(a.ts - b.ts) <= 24.0 AND (a.page_id = '' OR b.page_id = '' OR a.page_id = b.page_id) {_shared('a.doc_id', 'b.doc_id')}),
 t AS (SELECT video, obs_seq, avg(m) * least(1.0, count(*) / 2.0) AS stability FROM pr WHERE m >= 0.05 GROUP BY video, obs_seq) SELECT o.video, o.obs_seq, round(coalesce(stability, 0.0), 6) AS stability FROM o LEFT JOIN t USING (video, obs_seq)"""


@query("stability_jaccard", _STAB)
def stability_jaccard(spark, sf_dir):
    o, measure = _observed(spark, sf_dir)
    s = select.stability(o, measure, 24.0, 0.05)
    return s.select("video", "obs_seq", F.round("stability", 6).alias("stability"))


_EDGE = f"""WITH {_O}, {_P}, a AS (SELECT o.video, obs_seq, ts, min_by(p.page_id, p.page_seq) AS page_id FROM o LEFT JOIN p ON p.video = o.video AND ts BETWEEN p.start AND p."end" GROUP BY o.video, obs_seq, ts),
 e AS (SELECT a.*, p.start IS NULL AS nopage, greatest(0.001, p."end" - p.start) AS d, least(ts - p.start, p."end" - ts) AS gap FROM a LEFT JOIN p USING (video, page_id))
 SELECT video, obs_seq, round(CASE WHEN nopage THEN 0.5 ELSE greatest(0.0, least(1.0, gap / least(1.2, greatest(0.25, d * 0.22::DOUBLE)))) END, 6) AS page_score, NOT nopage AND d < 0.75 AS short_page, NOT nopage AND gap < least(0.35, d * 0.2::DOUBLE) AS page_edge FROM e"""


@query("page_edges", _EDGE)
def page_edges(spark, sf_dir):
    p = views.pages(spark, sf_dir)
    rows = select.page_edges(intervals.assign_pages(views.observations(spark, sf_dir), p, 168.0), p)
    return rows.select("video", "obs_seq", F.round("page_score", 6).alias("page_score"), select.short_page().alias("short_page"), select.page_edge().alias("page_edge"))


_TIERS = f"""ou AS (SELECT user_id AS video, event_id AS unit_seq, {views.HOURS} AS start, {views.HOURS} + 12.0 AS "end" FROM events WHERE event_type = 'purchase'),
 a AS MATERIALIZED (SELECT o.video, o.obs_seq, any_value(o.ts) AS ts, coalesce(min_by(p.page_id, p.page_seq), '') AS page_id, any_value(o.doc_id) AS doc_id, any_value(o.nk) AS nk, any_value(o.conf) AS conf, any_value(o.ink) AS ink, any_value(o.word_count) AS word_count FROM o LEFT JOIN p ON p.video = o.video AND o.ts BETWEEN p.start AND p."end" GROUP BY o.video, o.obs_seq),
 up AS (SELECT DISTINCT ou.video, unit_seq, page_id FROM ou JOIN p ON p.video = ou.video AND least("end" + 2.0, p."end") - greatest(ou.start - 2.0, p.start) > 0),
 t AS (SELECT up.video, unit_seq, obs_seq, 1 AS tier FROM up JOIN a USING (video, page_id) UNION ALL SELECT ou.video, unit_seq, obs_seq, 2 FROM ou JOIN a ON a.video = ou.video AND ts BETWEEN start - 2.0 AND "end" + 2.0
  UNION ALL SELECT ou.video, unit_seq, obs_seq, 3 FROM ou JOIN a ON a.video = ou.video),
 tiers AS (SELECT DISTINCT video, unit_seq, obs_seq, tier FROM (SELECT *, min(tier) OVER (PARTITION BY video, unit_seq) AS least FROM t) WHERE tier = least)"""
_TIERS = _TIERS.replace('least("end" + 2.0', 'least(ou."end" + 2.0')


def _event_units(spark, sf_dir):
    e = views.read(spark, sf_dir, "events").where("event_type = 'purchase'")
    start = views._hours(F.col("ts"))
    return e.select(F.col("user_id").alias("video"), F.col("event_id").alias("unit_seq"), F.format_string("u-%06d", "event_id").alias("unit_id"), start.alias("start"), (start + 12.0).alias("end"), F.col("event_id"))


def _unit_texts(spark, sf_dir):
    """Units with the text of a whole document, next to the one that an observation at their time shows."""
    d = views.documents(spark, sf_dir)
    n = d.agg(F.count(F.lit(1)).alias("n"))
    u = _event_units(spark, sf_dir).crossJoin(F.broadcast(n)).withColumn("doc_id", F.pmod("event_id", "n"))
    return u.join(d, "doc_id").withColumn("source", F.lit("asr")).drop("doc_id", "n", "event_id")


def _paged(spark, sf_dir):
    p = views.pages(spark, sf_dir)
    return intervals.assign_pages(views.observations(spark, sf_dir), p, 168.0), p


@query("candidate_tiers", f"WITH {_W}, {_P}, {_TIERS} SELECT video, unit_seq, tier, count(*) AS n FROM tiers GROUP BY video, unit_seq, tier")
def candidate_tiers(spark, sf_dir):
    o, p = _paged(spark, sf_dir)
    rows = select.candidates(_event_units(spark, sf_dir), o, p, 2.0, 168.0)
    return rows.groupBy("video", "unit_seq", "tier").agg(F.count(F.lit(1)).alias("n"))


_SCORE = f"""uk AS (SELECT e.event_id AS unit_seq, dn.doc_id, dn.nk FROM events e JOIN dn ON dn.doc_id = e.event_id % (SELECT count(*) FROM documents)),
 st AS (SELECT x.video, x.obs_seq, avg(m) * least(1.0, count(*) / 2.0) AS stability FROM (SELECT a.video, a.obs_seq, {_alike('a.nk', 'b.nk')} AS m FROM a JOIN a b ON a.video = b.video AND a.obs_seq <> b.obs_seq AND abs(a.ts - b.ts) <= 0.75 AND (a.page_id = '' OR b.page_id = '' OR a.page_id = b.page_id) {_shared('a.doc_id', 'b.doc_id')}) x WHERE m >= 0.82 GROUP BY x.video, x.obs_seq),
 f AS (SELECT t.video, t.unit_seq, t.obs_seq, CASE WHEN uk.nk = 0 THEN 0.0 ELSE coalesce(ov.c, 0) / uk.nk::DOUBLE END AS cov, CASE WHEN a.nk = 0 THEN 0.0 ELSE (a.nk - coalesce(ov.c, 0)) / a.nk::DOUBLE END AS extra,
  a.conf, a.ink, a.word_count, coalesce(st.stability, 0.0) AS stab, p.start IS NULL AS nopage, greatest(0.001, p."end" - p.start) AS d, least(a.ts - p.start, p."end" - a.ts) AS gap
  FROM tiers t JOIN uk USING (unit_seq) JOIN a USING (video, obs_seq) {_shared('uk.doc_id', 'a.doc_id')} LEFT JOIN st USING (video, obs_seq) LEFT JOIN p ON p.video = a.video AND p.page_id = a.page_id),
 sc AS (SELECT video, unit_seq, obs_seq, cov * 80.0 + conf * 18.0 + ink * 34.0 + stab * 20.0 + CASE WHEN nopage THEN 0.5 ELSE greatest(0.0, least(1.0, gap / least(1.2, greatest(0.25, d * 0.22::DOUBLE)))) END * 4.0 + least(word_count, 30) * 0.5 - extra * 30.0
  - CASE WHEN NOT nopage AND d < 0.75 THEN 20.0 ELSE 0.0 END - CASE WHEN NOT nopage AND gap < least(0.35, d * 0.2::DOUBLE) THEN 8.0 ELSE 0.0 END AS score FROM f)"""


@query("select_top1", f"WITH {_W}, {_P}, {_TIERS}, {_SCORE} SELECT video, unit_seq, arg_max(obs_seq, row(round(score, 6), -obs_seq)) AS obs_seq, round(max(score), 4) AS score FROM sc GROUP BY video, unit_seq")
def select_top1(spark, sf_dir):
    """Page join, candidate tiers, stability and score with token measures; the best observation of each unit."""
    o, measure = _observed(spark, sf_dir)
    p = views.pages(spark, sf_dir)
    o = intervals.assign_pages(o, p, 168.0)
    total = views.read(spark, sf_dir, "documents").agg(F.count(F.lit(1)).alias("total"))
    u = _event_units(spark, sf_dir).crossJoin(F.broadcast(total)).withColumn("unit_doc", F.pmod("event_id", "total")).drop("total")
    u = u.join(measure.sets.select(F.col("doc_id").alias("unit_doc"), F.col("n").alias("unit_n")), "unit_doc")
    rated = select.page_edges(o.join(select.stability(o, measure), ["video", "obs_seq"]), p)
    pairs = select.candidates(u, o, p, 2.0, 168.0).join(u.select("video", "unit_seq", "unit_doc", "unit_n", "start"), ["video", "unit_seq"])
    both = pairs.join(rated, ["video", "obs_seq"])
    counted = shared.SharedWords(measure.sets, lambda c, n, m: c).add(both, "shared", ("unit_doc", "unit_n"), ("doc_id", "n"), F.floor(F.col("start") / 720.0)).drop("start")
    part = lambda c, of: F.when(F.col(of) == 0, F.lit(0.0)).otherwise(c / F.greatest(F.col(of), F.lit(1)))
    rows = select.score(counted.withColumn("unit_shared", F.lit(0)), lambda _, c: part(c, "unit_n"), lambda _, c: part(F.col("n") - c, "n"), "shared")
    best = select.best_per_unit(rows.withColumn("exact", F.col("score")).withColumn("score", F.round("score", 6)))
    return best.select("video", "unit_seq", "obs_seq", F.round("exact", 4).alias("score"))


@query("select_full")
def select_full(spark, sf_dir):
    """The whole selection with fuzzy measures: best frame, text choice, coalesced frames and pruned repeats."""
    o, p = _paged(spark, sf_dir)
    chosen = select.selected_text(select.select_frames(_unit_texts(spark, sf_dir), o, p))
    rows = chosen.withColumn("frame", F.concat_ws("-", "video", "obs_seq")).withColumn("sel_seq", F.col("unit_seq"))
    return folds.prune_selections(select.coalesce_same_frame(rows)).select("video", "unit_id", "ts", "page_id", "status", F.round("score", 6).alias("score"))


_COAL = """WITH r AS (SELECT user_id AS video, event_id % 4 AS frame, event_id, CASE WHEN event_id % 3 = 0 THEN ['low-ink'] WHEN event_id % 3 = 1 THEN ['extra-text', 'low-coverage'] ELSE [] END AS w, event_id % 97 AS score FROM events)
 SELECT video, frame, max(score)::DOUBLE AS score, array_to_string(list_sort(list_distinct(flatten(list(list_filter(w, lambda x: x <> 'extra-text'))))), ';') AS warnings FROM r GROUP BY video, frame"""


@query("coalesce_frames", _COAL)
def coalesce_frames(spark, sf_dir):
    """Selections that share a frame: the union of warnings and the best score, where the observation holds their words."""
    e = views.read(spark, sf_dir, "events")
    w = F.when(F.col("event_id") % 3 == 0, F.array(F.lit("low-ink"))).when(F.col("event_id") % 3 == 1, F.array(F.lit("extra-text"), F.lit("low-coverage"))).otherwise(F.array().cast("array<string>"))
    text = F.lit("a story line")
    rows = e.select(F.col("user_id").alias("video"), (F.col("event_id") % 4).cast("string").alias("frame"), F.lit(0.0).alias("ts"), F.lit("").alias("page_id"), F.col("event_id").alias("sel_seq"), F.format_string("u-%d", "event_id").alias("unit_id"), text.alias("transcript"), text.alias("chosen"), (F.col("event_id") % 97).cast("double").alias("score"), w.alias("warnings"), F.when(F.size(w) == 0, "clean").otherwise("needs_review").alias("status"), text.alias("text"), text.alias("normalized"), F.lit(3).alias("word_count"))
    # groups of one keep their extra-text warning; here every frame has several, and the sums below are the same either way
    out = select.coalesce_same_frame(rows)
    return out.select("video", F.col("frame").cast("long").alias("frame"), "score", F.array_join(F.filter("warnings", lambda x: x != "extra-text"), ";").alias("warnings"))


_MISS = f"""WITH {_U}, n AS (SELECT video, count(*) AS n FROM u WHERE source <> 'ocr-temporal' GROUP BY video), k AS (SELECT *, list_distinct({sql_words('normalized')}) AS k FROM u),
 a AS (SELECT * FROM k WHERE source = 'ocr-temporal' AND "end" - start >= 0.75 AND len({sql_words('normalized')}) >= 3 AND NOT {sql_any(chr(39) + ' ' + chr(39) + ' || normalized || ' + chr(39) + ' ' + chr(39), W.LOCAL_REJECT_PHRASES)}),
 c AS (SELECT a.video, a.unit_seq FROM a JOIN k b ON a.video = b.video AND b.source <> 'ocr-temporal' WHERE (greatest(0, least(a."end", b."end" + 8) - greatest(a.start, b.start)) >= 0.35 AND {sql_jaccard('b.k', 'a.k')} >= 0.62)
  OR ({sql_jaccard('b.k', 'a.k')} >= 0.80 AND greatest(0, greatest(a.start, b.start) - least(a."end", b."end" + 8)) <= 2.0)),
 m AS (SELECT a.*, coalesce(n.n, 0) + row_number() OVER (PARTITION BY a.video ORDER BY a.unit_seq) AS i FROM a LEFT JOIN n USING (video) WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.video = a.video AND c.unit_seq = a.unit_seq))
 SELECT video, unit_id, source FROM u WHERE source <> 'ocr-temporal' UNION ALL SELECT video, printf('ocr-missing-%04d', i), source || '+missing' FROM m"""


@query("missing_anti_join", _MISS)
def missing_anti_join(spark, sf_dir):
    u, _ = _us(spark, sf_dir)
    own = u.where("source <> 'ocr-temporal'").withColumn("end", F.col("end") + 8.0)
    return select.missing_units(own, u.where("source = 'ocr-temporal'"), select.jaccard_of).select("video", "unit_id", "source")


_NEAR = f"""WITH {_W}, q AS (SELECT *, obs_seq % 7 = 0 AS ads, (obs_seq % 16) / 16.0::DOUBLE AS noise FROM o)
 SELECT a.video, a.obs_seq, arg_min(b.obs_seq, row(b.noise, CASE WHEN b.ts > a.ts THEN 1 ELSE 0 END, abs(b.ts - a.ts), b.obs_seq)) AS nearest_seq FROM q a JOIN q b ON a.video = b.video AND a.obs_seq <> b.obs_seq AND NOT b.ads AND a.page_id = b.page_id AND abs(a.ts - b.ts) <= 24.0
 {_shared('a.doc_id', 'b.doc_id')} WHERE {_alike('a.nk', 'b.nk')} >= 0.1 GROUP BY a.video, a.obs_seq"""


@query("nearest_clean_frame", _NEAR)
def nearest_clean_frame(spark, sf_dir):
    o, measure = _observed(spark, sf_dir)
    o = o.withColumn("has_ads", F.col("obs_seq") % 7 == 0).withColumn("noise", (F.col("obs_seq") % 16) / 16.0)
    return select.nearest_clean(o, measure, 24.0, 0.1)


@query("subtitle_dedupe", f"""WITH {_U}, d AS (SELECT video, unit_seq, CASE WHEN unit_seq % 4 < 3 THEN 'same text' ELSE normalized END AS normalized, start, start + 9.75 + (unit_seq % 2) AS "end" FROM u),
 r AS (SELECT *, sum(CASE WHEN normalized = l THEN 0 ELSE 1 END) OVER (PARTITION BY video ORDER BY start, "end", unit_seq ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT *, lag(normalized) OVER (PARTITION BY video ORDER BY start, "end", unit_seq) AS l FROM d)),
 p AS (SELECT *, sum(CASE WHEN m IS NULL OR start > m + 0.25 THEN 1 ELSE 0 END) OVER (PARTITION BY video, run ORDER BY start, "end", unit_seq ROWS UNBOUNDED PRECEDING) AS part FROM (SELECT *, max("end") OVER (PARTITION BY video, run ORDER BY start, "end", unit_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM r))
 SELECT video, min(unit_seq) AS unit_seq, min(start) AS start, max("end") AS "end" FROM p GROUP BY video, run, part""")
def subtitle_dedupe(spark, sf_dir):
    u, _ = _us(spark, sf_dir)
    rows = u.select("video", "unit_seq", F.when(F.col("unit_seq") % 4 < 3, "same text").otherwise(F.col("normalized")).alias("normalized"), "start", (F.col("start") + 9.75 + F.col("unit_seq") % 2).alias("end"))
    return intervals.dedupe_equal_units(rows).select("video", "unit_seq", "start", "end")


@query("even_samples", f"""WITH {_U}, c AS (SELECT video, unit_seq, row_number() OVER (PARTITION BY video ORDER BY unit_seq) - 1 AS i, count(*) OVER (PARTITION BY video) AS n FROM u WHERE len({sql_words('normalized')}) >= 3)
 SELECT video, unit_seq FROM c WHERE n <= 3 OR i IN (round_even(0 * (n - 1) / 2.0::DOUBLE, 0), round_even(1 * (n - 1) / 2.0::DOUBLE, 0), round_even(2 * (n - 1) / 2.0::DOUBLE, 0))""")
def even_samples(spark, sf_dir):
    return select.even_sample(_us(spark, sf_dir)[0], 3).select("video", "unit_seq")


_SUPPORT = f"""WITH {_U}, k AS (SELECT *, list_distinct({sql_words('normalized')}) AS k FROM u), a AS (SELECT * FROM k WHERE len({sql_words('normalized')}) >= 2), b AS (SELECT video, start AS ts, k FROM k WHERE unit_seq % 2 = 0),
 near AS (SELECT a.video, a.unit_seq, a.k AS x, b.k AS y FROM a JOIN b ON a.video = b.video AND ts BETWEEN start - 2.0 AND "end" + 2.0),
 far AS (SELECT a.video, a.unit_seq, a.k AS x, b.k AS y FROM a JOIN b ON a.video = b.video WHERE NOT EXISTS (SELECT 1 FROM near WHERE near.video = a.video AND near.unit_seq = a.unit_seq)),
 m AS (SELECT *, CASE WHEN len(x) = 0 THEN 0 ELSE len(list_intersect(x, y)) / len(x)::DOUBLE END AS c, CASE WHEN len(y) = 0 THEN 0 ELSE len(list_intersect(x, y)) / len(y)::DOUBLE END AS r, {sql_jaccard('x', 'y')} AS j FROM (SELECT * FROM near UNION ALL SELECT * FROM far)),
 g AS (SELECT video, count(DISTINCT unit_seq) AS supported FROM m WHERE (c >= 0.55 AND r >= 0.55) OR (j >= 0.78 AND greatest(c, r) >= 0.45) GROUP BY video),
 t AS (SELECT video, count(*) AS n_units FROM u GROUP BY video)
 SELECT t.video, n_units, coalesce(supported, 0) AS supported, coalesce(supported, 0) = 0 OR (n_units >= 4 AND coalesce(supported, 0) / n_units::DOUBLE < 0.25) AS use_captions FROM t LEFT JOIN g USING (video)"""


@query("caption_decisions", _SUPPORT)
def caption_decisions(spark, sf_dir):
    u, _ = _us(spark, sf_dir)
    o = u.where("unit_seq % 2 = 0").select("video", F.col("start").alias("ts"), "normalized")
    return select.caption_decision(u, o, exact=True)


@query("caption_units")
def caption_units(spark, sf_dir):
    return folds.sentences(_us(spark, sf_dir)[0], 12.0).select("video", "unit_id", "start", "end", "source", F.md5(F.col("text").cast("binary")).alias("text"))


@query("story_units")
def story_units(spark, sf_dir):
    from ..functions import fuzzy

    u, s = _us(spark, sf_dir)
    return select.story_units(u, s, fuzzy.local_similarity_col).select("video", "unit_id", "start", "end")


@query("refined_units")
def refined_units(spark, sf_dir):
    u = _unit_texts(spark, sf_dir)
    return select.refine_with_ocr(u, _paged(spark, sf_dir)[0], 12.0, 168.0).select("video", "unit_id", "source", F.md5(F.col("normalized").cast("binary")).alias("normalized"))


@query("run_local")
def run_local(spark, sf_dir):
    """The whole local plan over conversations: each turn is a unit, the even ones are seen on frames too."""
    from ..operators.options import LocalOptions
    from . import local

    u, s = _us(spark, sf_dir)
    seen = u.where("unit_seq % 2 = 0")
    o = seen.select("video", F.col("unit_seq").alias("obs_seq"), F.col("start").alias("ts"), "text", "normalized", F.lit(0.9).alias("conf"), F.lit(0.8).alias("ink"), X.word_count(F.col("normalized")).alias("word_count"), F.lit("").alias("page_id"))
    p = u.select("video", F.col("unit_seq").alias("page_seq"), F.format_string("page-%04d", "unit_seq").alias("page_id"), "start", (F.col("start") + 10.0).alias("end"), F.lit("scene").alias("source"))
    rows = local.run(u, o, p, s, LocalOptions())
    return rows.select("video", "unit_id", "ts", "output", "status", F.round("score", 6).alias("score"), F.md5(F.col("chosen").cast("binary")).alias("chosen"))
