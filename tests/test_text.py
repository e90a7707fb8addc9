"""Golden vectors of text functions and fuzzy measures."""

import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from quillspark.functions import fuzzy
from quillspark.functions import text as X
from quillspark.operators.options import LegacyOptions, LocalOptions, parse_float_list, parse_frame_rate, scan_fps, skips_asr


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "text, clean",
    [
        ("DOÉS A BEARPOO INTHE WOODS", "does a bear poo in the woods"),
        ("It'sa SeashelL Day", "it's a seashell day"),
        ("100,000 species", "100000 species"),
        ("ﬁne ½ Straße Ⅷ", "fine 12 strae viii"),
        ("", ""),
        ("VOOKS 'quoted' x b3 a", "quoted a"),
    ],
)
def test_local_clean(spark, text, clean):
    assert one(spark, X.local_clean(F.lit(text))) == clean


def test_legacy_clean(spark):
    assert one(spark, X.legacy_clean(F.lit("Café 12 a1 I am life"))) == "caf i am"
    assert one(spark, X.legacy_clean(F.lit("I am not scared of it we"))) == "i am not scared of it"


def test_clean_is_the_inline_form_for_every_character(spark):
    g, odd = random.Random(3), [*"abiwexyz019,,.-’‘“”éÉñßﬁÅKİΣςⅧ½１，\n\t\x00", *"''''"]
    codes = [c for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"a{chr(c)}b {chr(c)}1 " for c in codes[k : k + 512]) for k in range(0, len(codes), 512)]
    texts += ["".join(g.choice(odd) for _ in range(g.randint(0, 40))) for _ in range(5000)] + ["I am not scared of 12 we", "I am not scared we!", "INTHE BEARPOO,1,2,3", None]
    d = spark.createDataFrame([(t,) for t in texts], "t string")
    for fast, plain in ((X.local_clean, X.local_clean_inline), (X.legacy_clean, X.legacy_clean_inline)):
        assert d.where(~fast(F.col("t")).eqNullSafe(plain(F.col("t")))).count() == 0


def test_clean_of_whole_texts_uses_no_regular_expressions(spark):
    for clean in (X.local_clean, X.legacy_clean):
        plan = spark.range(1).select(F.col("id").cast("string").alias("t")).select(clean(F.col("t")))._jdf.queryExecution().optimizedPlan().toString()
        assert "regexp" not in plan  # their cost a match was most of the query's


@pytest.mark.parametrize("text", ["Popular Titles Age Elementary", "Ask your grown-up and start exploring more fun stories"])
def test_reject(spark, text):
    assert one(spark, X.local_reject(X.local_clean(F.lit(text))))


def test_repair():
    def fix(text, reference, **k):
        clean = " ".join("".join(c if c.isalnum() or c == "'" else " " for c in text.lower()).split())
        wanted = " ".join("".join(c if c.isalnum() or c == "'" else " " for c in reference.lower()).split())
        return fuzzy.repair(text, clean, wanted, **k)

    assert fix("Mommu, Mommy, hat.", "Mommy, Mommy, what?") == "mommy mommy what"
    assert fix("Mommu, Mommy, hat.", "Mommy, Mommy, look at that!", insert=True) == "mommy mommy look at that"
    assert fix("one", "one two") == "one"


def test_measures():
    assert fuzzy.local_similarity("", "a") == 0 and fuzzy.local_similarity("a b", "a b") == 1
    assert fuzzy.coverage("the hat", "the hat is big") == 1
    assert fuzzy.extra_share("the hat", "the hat is big") == 0.5
    assert fuzzy.words_match("hat", "that") and not fuzzy.words_match("at", "it")
    assert fuzzy.matched_words({"hat", "that"}, {"hat", "what"}) == 1


def test_characters_are_those_of_difflib():
    g = random.Random(3)
    for _ in range(300):
        letters = g.choice(["ab ", "abcdefgh ", "etaoinshrdlu ", "aé日😀 "])
        a, b = ("".join(g.choice(letters) for _ in range(g.choice(sizes))) for sizes in ((0, 3, 40, 300, 900), (0, 2, 30, 199, 200, 320)))
        if g.random() < 0.3:
            b = (b + a[: g.randint(0, 80)] + b)[:400]
        assert fuzzy.character_ratio(a, b) == SequenceMatcher(None, a, b).ratio()
        words = a[:40].split()
        assert fuzzy.matches(words, b.split()) == [[k for k, other in enumerate(b.split()) if fuzzy.words_match(word, other)] for word in words]


@pytest.mark.parametrize("name", ["fuzzy_measures", "reference_repair"])
def test_long_texts_have_rows(spark, tmp_path, name):
    from quillspark.plans import text_queries

    spark.createDataFrame([(0, "the hat is big"), (1, "some other words " * 200 + "that is big")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, "the hat is big"), (1, "the hat is big")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = getattr(text_queries, name)(spark, str(tmp_path)).orderBy("doc_id").collect()
    assert [r["doc_id"] for r in rows] == [0, 1]
    if name == "fuzzy_measures":
        text = "some other words " * 200 + "that is big"
        assert rows[1]["near"] == max(2 / 8, SequenceMatcher(None, text, "the hat is big").ratio()) and rows[1]["coverage"] == 0.75
        assert rows[1]["local"] == fuzzy.local_similarity(text, "the hat is big")
    else:
        assert rows[1]["repaired"].endswith(" hat is big")


def test_polish():
    assert fuzzy.accepts_polish("the big dog zzzz", "the big dog")
    assert not fuzzy.accepts_polish("the big dog", "some other words")


def test_empty_tokens(spark):
    assert one(spark, X.tokens(F.lit(""))) == []
    assert one(spark, X.noise_ratio(X.tokens(F.lit("")))) == 1.0
    assert one(spark, X.trailing_fragment(X.tokens(F.lit("")))) is False


def test_options():
    assert scan_fps("dense-windowed", 4, 8) == 8 and scan_fps("native", 4, 8, 25.0) == 25.0 and scan_fps("sampled", 4, 8) == 4
    assert parse_frame_rate("30000/1001") == pytest.approx(29.97, abs=0.01) and parse_frame_rate("0/0") is None and parse_frame_rate("x") is None
    assert parse_float_list("1,2") == [0.0, 1.0, 2.0]
    assert skips_asr("auto", "off", "faster") and not skips_asr("auto", "auto", "faster")
    assert LegacyOptions().most_gap == 2.5
    with pytest.raises(ValueError):
        LocalOptions(quality="best")


def test_word_matches_need_no_difflib(monkeypatch):
    g = random.Random(6)
    words = ["".join(g.choice("abc") for _ in range(g.randint(1, 9))) for _ in range(150)] + ["hat", "that", "é" * 64, "x" * 70, "x" * 69 + "y", "a" * 300]
    want = {(a, b): SequenceMatcher(None, a, b).ratio() for a in words for b in words}
    least = lambda a, b: fuzzy.MATCH_AT.get(max(min(len(a), len(b)), 1), fuzzy.LONG_MATCH)
    tail = lambda a, b: sorted((len(a), len(b))) == [3, 4] and (a.endswith(b) or b.endswith(a))
    found = fuzzy.matches(words, words)
    for k, a in enumerate(words):
        assert found[k] == [j for j, b in enumerate(words) if a == b or tail(a, b) or want[a, b] >= least(a, b)]
    fuzzy.ratio.cache_clear(), fuzzy.words_match.cache_clear()
    monkeypatch.setattr(fuzzy, "SequenceMatcher", None)  # one for each pair of words took most of the time
    short = [w for w in words if len(w) <= 24]
    assert all(fuzzy.ratio(a, b) == want[a, b] for a in short for b in short if a != b)
    fuzzy.coverage(" ".join(short), " ".join(short[::-2]))
