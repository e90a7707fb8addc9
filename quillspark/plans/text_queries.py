"""Queries over texts, names and URLs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import fuzzy
from ..functions import text as X
from ..functions import words as W
from ..sources import cache, lookup, names, vtt
from .registry import NOISY, listed, lit, query, sql_any, sql_jaccard, sql_legacy, sql_local, sql_tokens_local, sql_words
from .views import read


def _docs(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", "text")


def _legacy(spark, sf_dir):
    return _docs(spark, sf_dir).withColumn("c", X.legacy_clean(F.col("text")))


LEGACY_C = f"(SELECT doc_id, text, {sql_legacy('text')} AS c FROM documents)"
LEGACY_T = f"(SELECT doc_id, c, {sql_words('c')} AS t FROM {LEGACY_C})"
LOCAL_C = f"(SELECT doc_id, text, {sql_local('text')} AS c FROM documents)"


@query("clean_text_local", f"SELECT doc_id, md5({sql_local('text')}) AS clean FROM documents")
def clean_text_local(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.md5(X.local_clean(F.col("text")).cast("binary")).alias("clean"))


@query("clean_text_legacy", f"SELECT doc_id, md5({sql_legacy('text')}) AS clean FROM documents")
def clean_text_legacy(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.md5(X.legacy_clean(F.col("text")).cast("binary")).alias("clean"))


@query("token_set_size", f"SELECT doc_id, len(w) AS words, len(list_distinct(w)) AS distinct_words, len(w) >= 2 AS enough FROM (SELECT doc_id, {sql_tokens_local('text')} AS w FROM documents)")
def token_set_size(spark, sf_dir):
    rows = _docs(spark, sf_dir).select("doc_id", X.tokens(X.local_clean(F.col("text"))).alias("w"))
    return rows.select("doc_id", F.size("w").cast("long").alias("words"), F.size(F.array_distinct("w")).cast("long").alias("distinct_words"), (F.size("w") >= 2).alias("enough"))


@query("reject_phrase_local", f"SELECT doc_id, {sql_any(chr(39) + ' ' + chr(39) + ' || c || ' + chr(39) + ' ' + chr(39), W.LOCAL_REJECT_PHRASES)} AS rejected FROM {LOCAL_C}")
def reject_phrase_local(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", X.local_reject(X.local_clean(F.col("text"))).alias("rejected"))


@query("reject_phrase_legacy", f"SELECT doc_id, {sql_any(chr(39) + ' ' + chr(39) + ' || c || ' + chr(39) + ' ' + chr(39) + ' || c || ' + chr(39) + ' ' + chr(39), W.FRAME_REJECT_PHRASES)} AS rejected FROM {LEGACY_C}")
def reject_phrase_legacy(spark, sf_dir):
    return _legacy(spark, sf_dir).select("doc_id", X.legacy_reject(F.col("c"), F.col("c")).alias("rejected"))


@query("noise_ratio", f"SELECT doc_id, CASE WHEN len(t) = 0 THEN 1.0 ELSE round(len(list_filter(t, lambda w: {NOISY})) / len(t)::DOUBLE, 6) END AS noise FROM {LEGACY_T}")
def noise_ratio(spark, sf_dir):
    return _legacy(spark, sf_dir).select("doc_id", F.round(X.noise_ratio(X.tokens(F.col("c"))), 6).alias("noise"))


@query("noisy_ocr", f"SELECT doc_id, n >= 0.34 OR (doc_id % 2 = 0 AND n >= 0.20) AS noisy FROM (SELECT doc_id, CASE WHEN len(t) = 0 THEN 1.0 ELSE len(list_filter(t, lambda w: {NOISY})) / len(t)::DOUBLE END AS n FROM {LEGACY_T})")
def noisy_ocr(spark, sf_dir):
    conf = F.when(F.col("doc_id") % 2 == 0, 0.5).otherwise(0.9)
    return _legacy(spark, sf_dir).select("doc_id", X.noisy_ocr(X.tokens(F.col("c")), conf).alias("noisy"))


@query("trailing_fragment", f"SELECT doc_id, coalesce(t[-1] IN {listed(W.TRAILING_FRAGMENT_TOKENS)}, false) AS fragment FROM {LEGACY_T}")
def trailing_fragment(spark, sf_dir):
    return _legacy(spark, sf_dir).select("doc_id", X.trailing_fragment(X.tokens(F.col("c"))).alias("fragment"))


_KEPT = "len(t) - coalesce(list_position(list_transform(list_reverse(t), lambda w: NOT {0}), true) - 1, len(t))"


@query("trim_noisy_suffix", f"SELECT doc_id, CASE WHEN len(t) = 0 THEN 0 ELSE {_KEPT.format(NOISY)} END AS kept FROM {LEGACY_T}")
def trim_noisy_suffix(spark, sf_dir):
    return _legacy(spark, sf_dir).select("doc_id", F.size(X.trim_noisy(X.tokens(F.col("c")))).cast("long").alias("kept"))


@query("trim_fragment_suffix", f"SELECT doc_id, CASE WHEN len(t) = 0 THEN 0 ELSE {_KEPT.format('(w IN ' + listed(W.TRAILING_FRAGMENT_TOKENS) + ')')} END AS kept FROM {LEGACY_T}")
def trim_fragment_suffix(spark, sf_dir):
    return _legacy(spark, sf_dir).select("doc_id", F.size(X.trim_fragment(X.tokens(F.col("c")))).cast("long").alias("kept"))


@query("useful_fallback_words", f"SELECT doc_id, len(list_filter(t, lambda w: len(w) > 3 OR w IN {listed(W.USEFUL_SHORT_WORDS)})) AS useful FROM {LEGACY_T}")
def useful_fallback_words(spark, sf_dir):
    return _legacy(spark, sf_dir).select("doc_id", F.size(F.filter(X.tokens(F.col("c")), X.useful_fallback_word)).cast("long").alias("useful"))


_VOWELS, _CONS = "len(regexp_replace(w, '[^aeiou]', '', 'g'))", "len(regexp_replace(w, '[^b-df-hj-np-tv-z]', '', 'g'))"


@query("keep_unmatched_tokens", f"SELECT doc_id, len(list_filter(w_, lambda w: NOT (len(w) >= 5 AND {_CONS} <= 1 AND {_VOWELS} >= len(w) - 1) AND (len(w) > 3 OR w IN {listed(W.LOCAL_SHORT_WORDS)}))) AS kept, len(list_filter(w_, lambda w: len(w) > 3 OR w IN {listed(W.LOCAL_SHORT_WORDS)})) AS stripped FROM (SELECT doc_id, {sql_words('c')} AS w_ FROM {LOCAL_C})")
def keep_unmatched_tokens(spark, sf_dir):
    clean = X.local_clean(F.col("text"))
    rows = _docs(spark, sf_dir).select("doc_id", clean.alias("c"))
    return rows.select("doc_id", F.size(F.filter(X.tokens(F.col("c")), X.keep_unmatched_token)).cast("long").alias("kept"), X.word_count(X.strip_ocr_noise(F.col("c"))).cast("long").alias("stripped"))


@query("refinement_tokens", f"SELECT doc_id, CASE WHEN len(g) = 0 THEN len(list_distinct(t)) ELSE len(g) END AS n FROM (SELECT doc_id, t, list_distinct(list_filter(t, lambda w: len(w) > 1 AND w NOT IN {listed(W.OCR_GLITCH_WORDS)})) AS g FROM {LEGACY_T})")
def refinement_tokens(spark, sf_dir):
    return _legacy(spark, sf_dir).select("doc_id", F.size(X.refinement_tokens(X.tokens(F.col("c")))).cast("long").alias("n"))


_TITLE = f"list_distinct(list_filter({{0}}, lambda w: len(w) > 1 AND w NOT IN {listed(W.TITLE_IGNORE_WORDS)}))"


@query("title_overlap", f"""SELECT d.doc_id, round(CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0.0 ELSE len(list_intersect(a, b)) / least(len(a), len(b))::DOUBLE END, 6) AS overlap
 FROM (SELECT doc_id, {_TITLE.format('t')} AS a FROM {LEGACY_T}) d JOIN (SELECT item_id, {_TITLE.format(sql_words(sql_legacy('text')))} AS b FROM benchmark) q ON q.item_id = d.doc_id % (SELECT count(*) FROM benchmark)""")
def title_overlap(spark, sf_dir):
    titles = read(spark, sf_dir, "benchmark").select("item_id", X.title_tokens(X.legacy_clean(F.col("text"))).alias("title"))
    n = titles.agg(F.count(F.lit(1)).alias("n"))
    rows = _legacy(spark, sf_dir).crossJoin(F.broadcast(n)).withColumn("item_id", F.pmod("doc_id", "n"))
    return rows.join(titles, "item_id").select("doc_id", F.round(X.title_overlap(F.col("c"), F.col("title")), 6).alias("overlap"))


@query("slug_words", f"""SELECT doc_id, coalesce(nullif(left(trim(regexp_replace(array_to_string(t[1:8], '-'), '[^a-z0-9-]+', '-', 'g'), '-'), 80), ''), 'story-text') AS slug FROM {LEGACY_T}""")
def slug_words(spark, sf_dir):
    return _legacy(spark, sf_dir).select("doc_id", X.slug_words(F.col("c")).alias("slug"))


@query("slug_names", "SELECT page_id, coalesce(nullif(left(trim(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '-'), 80), ''), 'video') AS slug FROM pages")
def slug_names(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", X.slug_name(F.col("url")).alias("slug"))


@query("unique_dirs", """SELECT page_id, CASE WHEN n = 1 THEN slug ELSE slug || '-' || n END AS name FROM (SELECT page_id, slug, row_number() OVER (PARTITION BY slug ORDER BY page_id) AS n
 FROM (SELECT page_id, coalesce(nullif(trim(regexp_replace(lower(regexp_extract(url, '//([^/]+)', 1)), '[^a-z0-9]+', '-', 'g'), '-'), ''), 'video') AS slug FROM pages))""")
def unique_dirs(spark, sf_dir):
    from ..operators.intervals import unique_names

    slug = X.slug_name(F.regexp_extract("url", "//([^/]+)", 1))
    return unique_names(read(spark, sf_dir, "pages").select("page_id", slug.alias("slug")), "slug", "page_id").select("page_id", "name")


@query("sentence_text", r"""SELECT doc_id, regexp_matches(trim(text, ' '), '[.!?]["'')\]]*$') AS complete, md5(CASE WHEN t <> '' AND NOT regexp_matches(t, '[.!?]$') THEN t || '.' ELSE t END) AS sentence
 FROM (SELECT doc_id, text, trim(regexp_replace(text, '\s+', ' ', 'g'), ' ') AS t FROM documents)""")
def sentence_text(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", X.sentence_complete(F.col("text")).alias("complete"), F.md5(X.sentence_text(F.col("text")).cast("binary")).alias("sentence"))


@query("plural_variants", "SELECT a.item_id, count(*) AS pairs FROM (SELECT DISTINCT item_id, unnest(string_split(lower(text), ' ')) AS w FROM benchmark) a JOIN (SELECT DISTINCT item_id, unnest(string_split(lower(text), ' ')) AS w FROM benchmark) b ON a.item_id = b.item_id AND (a.w = b.w || 's' OR b.w = a.w || 's') GROUP BY a.item_id")
def plural_variants(spark, sf_dir):
    w = read(spark, sf_dir, "benchmark").select("item_id", F.explode(F.split(F.lower("text"), " ")).alias("w")).distinct()
    # words meet their plurals by equality; the operator has the last word
    longer = w.select("item_id", F.col("w").alias("one"), F.concat("w", F.lit("s")).alias("w")).join(w, ["item_id", "w"]).where(X.plural_variant(F.col("one"), F.col("w")))
    return longer.groupBy("item_id").agg((F.count(F.lit(1)) * 2).alias("pairs"))


@query("url_kinds", "SELECT page_id, regexp_matches(url, '^https?://[^/?#]+') AS is_url FROM pages")
def url_kinds(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", names.is_url(F.col("url")).alias("is_url"))


_URLS = ["https://youtu.be/abc123?t=4", "https://www.youtube.com/watch?v=xyz_9&x=1", "https://m.youtube.com/shorts/s-1/", "https://youtube.com/embed/e1?x=2", "https://youtube.com/playlist?list=1", "http://example.org/watch?v=no", "not a url", "https://youtu.be/"]
_IDS = ["abc123", "xyz_9", "s-1", "e1", None, None, None, None]


@query("youtube_ids", "SELECT * FROM (VALUES " + ", ".join(f"({k}, {lit(i) if i else 'NULL'})" for k, i in enumerate(_IDS)) + ") t(id, video_id)")
def youtube_ids(spark, sf_dir):
    rows = spark.createDataFrame(list(enumerate(_URLS)), "id int, url string")
    return rows.select("id", names.youtube_id(F.col("url")).alias("video_id"))


@query("best_captions", "SELECT page_id % 10 AS stem, max_by(page_id, (CASE WHEN page_id % 3 = 0 THEN 2 ELSE 0 END - CASE WHEN page_id % 5 = 0 THEN 1 ELSE 0 END) * 1000000 + page_id) AS page_id FROM pages GROUP BY 1")
def best_captions(spark, sf_dir):
    path = F.concat(F.lit("clip"), F.when(F.col("page_id") % 3 == 0, ".en").otherwise(""), F.when(F.col("page_id") % 5 == 0, ".orig.").otherwise("."), F.lit("vtt"))
    rows = read(spark, sf_dir, "pages").select("page_id", (F.col("page_id") % 10).alias("stem"), path.alias("path"))
    return rows.groupBy("stem").agg(F.max_by("page_id", F.struct(names.caption_rank(F.col("path")), "page_id")).alias("page_id"))


@query("video_fingerprints", "SELECT page_id, left(sha1(url || '|' || octet_length(encode(html)) || '|' || page_id), 20) AS fingerprint FROM pages")
def video_fingerprints(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", names.fingerprint(F.col("url"), F.octet_length("html"), F.col("page_id")).alias("fingerprint"))


@query("cue_texts", r"""SELECT page_id, md5(trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '^<v\s+[^>]+>', '', 'i'), '<[^>]+>', '', 'g'), '\{[^}]+\}', ' ', 'g'), '\[[^\]]+\]', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), '\s+', ' ', 'g'), ' ')) AS cue FROM pages""")
def cue_texts(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", F.md5(vtt.cue_text(F.col("html")).cast("binary")).alias("cue"))


_CUE = r"""trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, '^<v\s+[^>]+>', '', 'i'), '<[^>]+>', '', 'g'), '\{{[^}}]+\}}', ' ', 'g'), '\[[^\]]+\]', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), '\s+', ' ', 'g'), ' ')"""
_SPOKEN = r"regexp_replace(replace(replace(text, '<', ''), '>', ''), '\s+', ' ', 'g')"
_CUES = f"""SELECT conv_id AS video, turn * 10.0 AS start, turn * 10.0 + 2.5 AS "end", {_CUE.format(f"translate({_SPOKEN}, '’‘“”', '''''""')")} AS text FROM conversations WHERE trim({_SPOKEN}, ' ') <> ''"""


def _vtt_files(spark, sf_dir):
    c = read(spark, sf_dir, "conversations").select("conv_id", "turn", F.regexp_replace(F.regexp_replace("text", "[<>]", ""), r"\s+", " ").alias("text"))
    stamp = lambda s: F.format_string("%02d:%02d:%06.3f", F.floor(s / 3600).cast("int"), F.floor(s / 60).cast("int") % 60, F.pmod(s, F.lit(60.0)))
    line = F.concat(stamp(F.col("turn") * 10.0), F.lit(" --> "), stamp(F.col("turn") * 10.0 + 2.5), F.lit("\n"), "text", F.lit("\n\n"))
    files = c.groupBy(F.col("conv_id").alias("video")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("l")))), lambda x: x["l"]), "").alias("body"))
    return files.select("video", F.concat(F.lit("WEBVTT\n\n"), "body").alias("value"))


@query("vtt_parse", f'SELECT video, start, "end", md5(text) AS text FROM ({_CUES}) WHERE text <> \'\'')
def vtt_parse(spark, sf_dir):
    return vtt.parse(_vtt_files(spark, sf_dir)).select("video", "start", "end", F.md5(F.col("text").cast("binary")).alias("text"))


@query("vtt_times", "SELECT turn, turn * 61.5 + 0.25 AS seconds FROM (SELECT DISTINCT turn FROM conversations)")
def vtt_times(spark, sf_dir):
    t = read(spark, sf_dir, "conversations").select("turn").distinct()
    s = F.col("turn") * 61.5 + 0.25
    text = F.format_string("%02d:%02d:%06.3f", F.floor(s / 3600).cast("int"), F.floor(s / 60).cast("int") % 60, F.pmod(s, F.lit(60.0)))
    return t.select("turn", vtt.seconds(F.translate(text, ".", ",")).alias("seconds"))


@query("token_jaccard", f"""SELECT d.doc_id, q.item_id, round({sql_jaccard('a', 'b')}, 6) AS jaccard FROM (SELECT doc_id, list_distinct({sql_tokens_local('text')}) AS a FROM documents) d
 JOIN (SELECT item_id, list_distinct({sql_tokens_local('text')}) AS b FROM benchmark) q ON q.item_id = d.doc_id % (SELECT count(*) FROM benchmark)""")
def token_jaccard(spark, sf_dir):
    rows = _paired(spark, sf_dir)
    return rows.select("doc_id", "item_id", F.round(X.jaccard(F.array_distinct(X.tokens(F.col("a"))), F.array_distinct(X.tokens(F.col("b")))), 6).alias("jaccard"))


def _paired(spark, sf_dir):
    items = read(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("item"), X.local_clean(F.col("text")).alias("b"))
    n = items.agg(F.count(F.lit(1)).alias("n"))
    d = _docs(spark, sf_dir).crossJoin(F.broadcast(n)).select("doc_id", "text", X.local_clean(F.col("text")).alias("a"), F.pmod("doc_id", "n").alias("item_id"))
    return d.join(items, "item_id")


@query("fuzzy_measures")
def fuzzy_measures(spark, sf_dir):
    """All character and coverage measures of whole texts against benchmark items; checked against a plain model in the tests."""
    rows = _paired(spark, sf_dir).select("doc_id", "item_id", fuzzy.measures_col(F.col("a"), F.col("b")).alias("m"))
    return rows.select("doc_id", "item_id", "m.*")


@query("reference_repair")
def reference_repair(spark, sf_dir):
    rows = _paired(spark, sf_dir)
    return rows.select("doc_id", "item_id", fuzzy.repair_col(False, False)(F.col("text"), F.col("a"), F.col("b")).alias("repaired"))


@query("polished_transcripts")
def polished_transcripts(spark, sf_dir):
    from ..operators.legacy import polish

    rows = _docs(spark, sf_dir).withColumn("polished", X.legacy_clean(F.col("text")))
    return polish(rows).select("doc_id", F.md5(F.col("transcript").cast("binary")).alias("transcript"))


@query("cache_join", """SELECT d.doc_id, l.doc_id IS NOT NULL AND l.toxic = 0 AS hit, CASE WHEN l.toxic = 0 AND l.quality = 1 THEN d.n_chars END AS payload FROM documents d LEFT JOIN labels l USING (doc_id)""")
def cache_join(spark, sf_dir):
    """A cached null is a hit; another version isn't."""
    from ..sources.cache import lookup

    keys = read(spark, sf_dir, "documents").select("doc_id", "n_chars")
    cache = read(spark, sf_dir, "labels").join(keys, "doc_id").select("doc_id", F.col("toxic").alias("version"), F.when(F.col("quality") == 1, F.col("n_chars")).alias("payload"))
    return lookup(keys.select("doc_id"), cache, ["doc_id"], 0).select("doc_id", "hit", "payload")


@query("rollup_counts", "SELECT lang, source, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY ROLLUP (lang, source)")
def rollup_counts(spark, sf_dir):
    return read(spark, sf_dir, "documents").rollup("lang", "source").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))


@query("longest_per_language", "SELECT lang, doc_id, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS r FROM documents) WHERE r <= 3")
def longest_per_language(spark, sf_dir):
    w = Window.partitionBy("lang").orderBy(F.desc("n_chars"), "doc_id")
    return read(spark, sf_dir, "documents").withColumn("r", F.row_number().over(w)).where("r <= 3").select("lang", "doc_id", "n_chars")


def _listing(spark, sf_dir):
    """Pages as files of two folders: videos and captions of ten ids."""
    k, end = F.col("page_id"), F.when(F.col("page_id") % 4 == 0, ".mp4.part").when(F.col("page_id") % 2 == 0, ".mp4").when(F.col("page_id") % 3 == 0, ".en.vtt").otherwise(".orig.vtt")
    name = F.concat(F.when(k % 5 == 0, F.lit("")).otherwise(F.lit("a-clip-")), F.lit("v-"), (k % 10).cast("string"), end)
    return read(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("f"), (k % 3).cast("string")).alias("folder"), name.alias("name"), (k % 7).alias("size"), (k * 37 % 1009).alias("modified"))


_FILES = """f AS (SELECT page_id, 'f' || page_id % 3 AS folder, CASE WHEN page_id % 5 = 0 THEN '' ELSE 'a-clip-' END || 'v-' || page_id % 10 || CASE WHEN page_id % 4 = 0 THEN '.mp4.part' WHEN page_id % 2 = 0 THEN '.mp4' WHEN page_id % 3 = 0 THEN '.en.vtt' ELSE '.orig.vtt' END AS name, page_id % 7 AS size, page_id * 37 % 1009 AS modified FROM pages),
 ids AS (SELECT DISTINCT 'v-' || page_id % 12 AS video_id FROM pages), c AS (SELECT *, CASE WHEN name LIKE '%.en%' THEN 2 ELSE 0 END - CASE WHEN name LIKE '%.orig.%' THEN 1 ELSE 0 END AS rank FROM f WHERE name LIKE '%.vtt' AND size > 0)"""


def _ids(spark, sf_dir):
    return read(spark, sf_dir, "pages").select(F.concat(F.lit("v-"), (F.col("page_id") % 12).cast("string")).alias("video_id")).distinct()


@query("cached_videos", f"WITH {_FILES} SELECT video_id, max_by(name, row(modified, name)) AS name FROM ids LEFT JOIN f ON name LIKE '%.mp4' AND size > 0 AND (name LIKE '%-' || video_id || '.%' OR name LIKE video_id || '.%') GROUP BY video_id")
def cached_videos(spark, sf_dir):
    return lookup.cached_videos(_ids(spark, sf_dir), _listing(spark, sf_dir)).select("video_id", "name")


@query("cached_captions", f"WITH {_FILES} SELECT video_id, max_by(name, row(rank, modified, name)) AS caption FROM ids LEFT JOIN c ON name LIKE '%-' || video_id || '%.vtt' GROUP BY video_id")
def cached_captions(spark, sf_dir):
    return lookup.cached_captions(_ids(spark, sf_dir), _listing(spark, sf_dir))


@query("captions_beside", f"WITH {_FILES}, v AS (SELECT DISTINCT folder, name FROM f WHERE name LIKE '%.mp4') SELECT v.folder, v.name, max_by(c.name, row(rank, modified, c.name)) AS caption FROM v LEFT JOIN c ON c.folder = v.folder AND starts_with(c.name, left(v.name, len(v.name) - 4)) GROUP BY v.folder, v.name")
def captions_beside(spark, sf_dir):
    files = _listing(spark, sf_dir)
    return lookup.captions_beside(files.where(names.is_video(F.col("name"))).select("folder", "name").distinct(), files)


@query("expanded_sources", f"""WITH {_FILES}, s AS (SELECT DISTINCT CASE WHEN page_id % 4 = 0 THEN url WHEN page_id % 4 = 1 THEN 'f' || page_id % 5 ELSE folder || '/' || name END AS source FROM pages JOIN f USING (page_id)), v AS (SELECT DISTINCT folder, name FROM f WHERE name LIKE '%.mp4')
 SELECT source, 'url' AS kind, NULL AS name FROM s WHERE regexp_matches(source, '^https?://[^/?#]+') UNION ALL SELECT source, 'file', name FROM s JOIN v ON source = folder || '/' || name UNION ALL SELECT source, 'folder', name FROM s JOIN v ON source = folder
 UNION ALL SELECT source, 'unsupported', NULL FROM s WHERE NOT regexp_matches(source, '^https?://[^/?#]+') AND source NOT IN (SELECT folder || '/' || name FROM v) AND source NOT IN (SELECT folder FROM v)""")
def expanded_sources(spark, sf_dir):
    k, files = F.col("page_id"), _listing(spark, sf_dir)
    source = F.when(k % 4 == 0, F.col("url")).when(k % 4 == 1, F.concat(F.lit("f"), (k % 5).cast("string"))).otherwise(F.concat_ws("/", "folder", "name"))
    sources = files.join(read(spark, sf_dir, "pages").select("page_id", "url"), "page_id").select(source.alias("source"))
    return lookup.expand_sources(sources, files.select("folder", "name").distinct()).select("source", "kind", "name")


@query("cached_observations", "SELECT doc_id, n_chars::DOUBLE AS timestamp, 0 AS word_count, '' AS page_id, md5(text) AS text, 'frame-' || doc_id AS frame_path FROM documents WHERE text IS NOT NULL")
def cached_observations(spark, sf_dir):
    """Observations as cached JSON with optional fields left out, read back for another frame."""
    rows = read(spark, sf_dir, "documents").where("text is not null")
    old = F.struct(F.lit("old").alias("frame_path"), F.col("n_chars").cast("double").alias("timestamp"), "text", F.lit("").alias("normalized_text"))
    back = rows.select("doc_id", cache.decode(cache.encode(old), F.concat(F.lit("frame-"), F.col("doc_id").cast("string"))).alias("o"))
    return back.select("doc_id", "o.timestamp", "o.word_count", "o.page_id", F.md5(F.col("o.text").cast("binary")).alias("text"), "o.frame_path")
