"""Text normalisation and token predicates as column expressions.

Two families, because their rules differ: ``local_*`` folds accents into ASCII
and keeps numbers; ``legacy_*`` lets accents split words and drops numbers.  Whole
texts are cleaned in Arrow batches (``cleaning``); the rest are built-in
expressions, so they stay in the JVM.  Null stays null unless said otherwise.
"""

from __future__ import annotations

import functools
import json
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import cleaning
from . import words as W


@functools.cache
def _folds() -> tuple[str, str, dict[str, str]]:
    """Single-letter ASCII folds for translate(), and characters that fold to several letters; from the Unicode tables."""
    one_from, one_to, many = [], [], {}
    for code in [*range(0x80, 0xD800), *range(0xE000, 0x110000)]:
        c = chr(code)
        folded = unicodedata.normalize("NFKD", c).encode("ascii", "ignore").decode()
        if len(folded) == 1:
            one_from.append(c)
            one_to.append(folded)
        elif folded:
            many[c] = folded
    return "".join(one_from), "".join(one_to), many


def straight_quotes(c: Column) -> Column:
    return F.translate(c, "’‘“”", "''\"\"")


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def ascii_fold(c: Column) -> Column:
    """Compatibility decomposition with all that isn't ASCII dropped: accents join their letter, ß goes."""
    source, target, many = _folds()
    table = F.from_json(F.lit(json.dumps(many)), "map<string,string>")  # one node, folded once by the optimizer

    def spell(x: Column) -> Column:
        spelled = F.array_join(F.transform(F.split(x, ""), lambda y: F.coalesce(F.try_element_at(table, y), y)), "")
        # most texts hold no more than European letters and quotes, of which none is spelled; the rest is looked up in a table
        odd = x.rlike("[^\\x00-\\u00BB\\u00BF-\\u0131\\u0134-\\u017F\\u2010-\\u201F]")
        return F.when(odd & (F.translate(x, "".join(many), "") != x), spelled).otherwise(x)

    fold = lambda x: F.regexp_replace(F.translate(let(x, spell), source, target), r"[^\x00-\x7F]", "")
    return let(c, lambda x: F.when(x.rlike(r"[^\x00-\x7F]"), fold(x)).otherwise(x))


#: Around a word between spaces.
_FROM, _TO = "(?<![^ ])", "(?![^ ])"


def _kept_words(c: Column, dropped: list[str]) -> Column:
    """Words of a lower-cased text, one space between them, without quotes around them and without those that ``dropped`` (patterns) match."""
    # spaces are left alone until the end: each match costs
    apart = F.regexp_replace(c, "[^a-z0-9' ]+", " ")
    bare = let(apart, lambda x: F.when(x.contains("'"), F.regexp_replace(x, f"'+{_TO}|{_FROM}'+", "")).otherwise(x))
    kept = F.regexp_replace(bare, f"{_FROM}(?:{'|'.join([*dropped, cleaning.NO_WORDS])}){_TO}", "")
    return F.btrim(F.regexp_replace(kept, "  +", " "))


def local_clean_inline(c: Column) -> Column:
    """local_clean() of built-in functions, for short texts and inside lambdas."""
    text = F.regexp_replace(F.lower(ascii_fold(straight_quotes(c))), r"(?<=[0-9]),(?=[0-9])", "")
    table = F.from_json(F.lit(json.dumps({k: " ".join(v) for k, v in W.FUSED_TOKENS.items()})), "map<string,string>")
    fused = "(^| )(" + "|".join(W.FUSED_TOKENS) + ")( |$)"
    split = lambda j: F.array_join(F.transform(F.split(j, " "), lambda t: F.coalesce(F.try_element_at(table, t), t)), " ")
    return let(_kept_words(text, W.LOCAL_IGNORE_WORDS), lambda j: F.when(j.rlike(fused), split(j)).otherwise(j))


def _cleaned(f):
    @F.pandas_udf(T.StringType())
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else f(x) for x in texts], dtype="object")

    return run


_local_col, _legacy_col = _cleaned(cleaning.local), _cleaned(cleaning.legacy)


def local_clean(c: Column) -> Column:
    return _local_col(c)


def legacy_clean_inline(c: Column) -> Column:
    """legacy_clean() of built-in functions."""
    words = _kept_words(F.lower(straight_quotes(c)), [*W.LEGACY_IGNORE_WORDS, "[0-9]+"])
    return F.regexp_replace(words, "^(i am not scared(?: .*)?) we$", "$1")


def legacy_clean(c: Column) -> Column:
    return _legacy_col(c)


def tokens(clean: Column) -> Column:
    """Words of a cleaned text; none for the empty text."""
    return F.filter(F.split(clean, " "), lambda t: t != "")


def token_set(clean: Column) -> Column:
    return F.array_distinct(tokens(clean))


def word_count(clean: Column) -> Column:
    return F.size(tokens(clean))


def contains_any(padded: Column, phrases: list[str]) -> Column:
    """Whether any phrase is a substring: one pass of an alternation of literals."""
    return padded.rlike("|".join(phrases))


def local_reject(clean: Column) -> Column:
    return contains_any(F.concat(F.lit(" "), clean, F.lit(" ")), W.LOCAL_REJECT_PHRASES)


def legacy_reject(raw_clean: Column, normalized: Column) -> Column:
    return contains_any(F.concat(F.lit(" "), raw_clean, F.lit(" "), normalized, F.lit(" ")), W.FRAME_REJECT_PHRASES)


def reject_frame(normalized: Column, raw_clean: Column, ts: Column, o) -> Column:
    """Frames outside the story, with frame or title phrases, or without text; ``o`` holds the legacy options."""
    padded = F.concat(F.lit(" "), raw_clean, F.lit(" "))
    story = (ts >= o.story_start) & (ts < o.story_end)
    intro = F.lit(o.include_title_intro) & (ts >= o.title_start) & (ts < o.title_end)
    titled = contains_any(padded, W.TITLE_REJECT_PHRASES) | (raw_clean.contains("i am not scared") & raw_clean.rlike("illustrated|anna"))
    return (~story & ~intro) | (intro & ~normalized.contains("i am not scared")) | contains_any(padded, W.FRAME_REJECT_PHRASES) | (~intro & titled) | (normalized == "")


def useful_fallback_word(clean: Column) -> Column:
    return (clean != "") & ~clean.isin(W.LEGACY_IGNORE_WORDS) & ((F.length(clean) > 3) | clean.isin(W.USEFUL_SHORT_WORDS))


def keep_unmatched_token(t: Column) -> Column:
    vowels, letters = F.regexp_count(t, F.lit("[aeiou]")), F.regexp_count(t, F.lit("[b-df-hj-np-tv-z]"))
    glued = (F.length(t) >= 5) & (letters <= 1) & (vowels >= F.length(t) - 1)
    return ~glued & ((F.length(t) > 3) | t.isin(W.LOCAL_SHORT_WORDS))


def ocr_noise_token(t: Column) -> Column:
    return (F.length(t) <= 3) & ~t.isin(W.LOCAL_SHORT_WORDS)


def strip_ocr_noise(clean: Column) -> Column:
    return F.array_join(F.filter(tokens(clean), lambda t: ~ocr_noise_token(t)), " ")


def noisy_token(t: Column) -> Column:
    return (t == "") | t.isin(W.OCR_GLITCH_WORDS) | ((F.length(t) <= 2) & ~t.isin(W.ALLOWED_SHORT_TOKENS)) | ((F.length(t) >= 4) & ~t.rlike("[aeiou]"))


def noise_ratio(toks: Column) -> Column:
    """Share of noisy tokens; 1 where there are none."""
    return F.when(F.size(toks) == 0, F.lit(1.0)).otherwise(F.size(F.filter(toks, noisy_token)) / F.greatest(F.size(toks), F.lit(1)))


def noisy_ocr(toks: Column, confidence: Column) -> Column:
    ratio = noise_ratio(toks)
    return (ratio >= 0.34) | ((confidence < 0.75) & (ratio >= 0.20))


def trailing_fragment(toks: Column) -> Column:
    return F.coalesce(F.try_element_at(toks, F.lit(-1)).isin(W.TRAILING_FRAGMENT_TOKENS), F.lit(False))


def trim_suffix(toks: Column, drop) -> Column:
    """Tokens up to the last that ``drop`` doesn't take."""
    place = F.array_max(F.transform(toks, lambda t, i: F.when(drop(t), F.lit(0)).otherwise(i + 1)))
    return F.slice(toks, 1, F.coalesce(place, F.lit(0)))


def trim_noisy(toks: Column) -> Column:
    return trim_suffix(toks, noisy_token)


def trim_fragment(toks: Column) -> Column:
    return trim_suffix(toks, lambda t: t.isin(W.TRAILING_FRAGMENT_TOKENS))


def refinement_tokens(toks: Column) -> Column:
    good = F.array_distinct(F.filter(toks, lambda t: (F.length(t) > 1) & ~t.isin(W.OCR_GLITCH_WORDS)))
    return F.when(F.size(good) == 0, F.array_distinct(toks)).otherwise(good)


def title_tokens(stem_clean: Column) -> Column:
    return F.array_distinct(F.filter(tokens(stem_clean), lambda t: (F.length(t) > 1) & ~t.isin(W.TITLE_IGNORE_WORDS)))


def title_overlap(normalized: Column, title: Column) -> Column:
    """Shared words over the smaller set; 0 if either is empty."""
    own = title_tokens(normalized)
    return F.when((F.size(own) == 0) | (F.size(title) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(own, title)) / F.greatest(F.least(F.size(own), F.size(title)), F.lit(1)))


def plural_variant(a: Column, b: Column) -> Column:
    return (a == F.concat(b, F.lit("s"))) | (b == F.concat(a, F.lit("s")))


def sentence_complete(text: Column) -> Column:
    return F.trim(text).rlike(r"[.!?][\"')\]]*$")


def sentence_text(text: Column) -> Column:
    flat = F.btrim(F.regexp_replace(text, r"\s+", " "))
    return F.when((flat != "") & ~flat.rlike("[.!?]$"), F.concat(flat, F.lit("."))).otherwise(flat)


def slug_words(legacy: Column, most: int = 8) -> Column:
    slug = F.btrim(F.regexp_replace(F.array_join(F.slice(tokens(legacy), 1, most), "-"), "[^a-z0-9-]+", "-"), F.lit("-"))
    return F.coalesce(F.nullif(F.left(slug, F.lit(80)), F.lit("")), F.lit("story-text"))


def slug_name(value: Column, fallback: str = "video") -> Column:
    plain = F.btrim(F.regexp_replace(F.lower(value), "[^a-z0-9]+", "-"), F.lit("-"))
    return F.coalesce(F.nullif(F.left(plain, F.lit(80)), F.lit("")), F.lit(fallback))


def reconstructed_line(toks: Column) -> Column:
    """Punctuate redrawn words: a doubled word gets commas, other lines a full stop."""
    shown = F.transform(toks, reconstructed_token)
    text = F.array_join(shown, " ")
    doubled = (F.size(shown) == 2) & (F.lower(F.get(shown, F.lit(0))) == F.lower(F.get(shown, F.lit(1))))
    ended = F.when((text != "") & ~text.rlike("[.!?,]$"), F.concat(text, F.lit("."))).otherwise(text)
    return F.when(doubled, F.concat(F.array_join(shown, ", "), F.lit(","))).otherwise(ended)


def reconstructed_token(t: Column) -> Column:
    return F.when(t == "i", F.lit("I")).when(t == "mommy", F.lit("Mommy")).otherwise(t)


def containment(a: Column, b: Column) -> Column:
    """Shared words over the smaller set of two token arrays; 0 if either is empty."""
    a, b = F.array_distinct(a), F.array_distinct(b)
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.greatest(F.least(F.size(a), F.size(b)), F.lit(1)))


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    union = F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(both / F.greatest(union, F.lit(1)))
