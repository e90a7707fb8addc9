"""Registration of named queries, and the SQL pieces their checks are made of."""

from __future__ import annotations

from ..functions import words as W

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def listed(values) -> str:
    return "(" + ", ".join(map(lit, values)) + ")"


QUOTES = "translate({0}, '’‘“”', '''''\"\"')"
MIXED = "(regexp_matches(w, '[a-z]') AND regexp_matches(w, '[0-9]'))"


def sql_tokens_local(x: str) -> str:
    folded = f"lower(regexp_replace(strip_accents({QUOTES.format(x)}), '[^\\x00-\\x7F]', '', 'g'))"
    for _ in range(2):  # digits on both sides may be shared
        folded = f"regexp_replace({folded}, '([0-9]),([0-9])', '\\1\\2', 'g')"
    bare = f"list_transform(string_split(regexp_replace({folded}, '[^a-z0-9'']+', ' ', 'g'), ' '), lambda w: trim(w, ''''))"
    kept = f"list_filter({bare}, lambda w: w <> '' AND w NOT IN {listed(W.LOCAL_IGNORE_WORDS)} AND NOT {MIXED} AND (len(w) > 1 OR w IN ('a', 'i')))"
    cases = " ".join(f"WHEN {lit(k)} THEN [{', '.join(map(lit, v))}]" for k, v in W.FUSED_TOKENS.items())
    return f"flatten(list_transform({kept}, lambda w: CASE w {cases} ELSE [w] END))"


def sql_local(x: str) -> str:
    return f"coalesce(array_to_string({sql_tokens_local(x)}, ' '), '')"


def sql_legacy(x: str) -> str:
    bare = f"list_transform(string_split(regexp_replace(lower({QUOTES.format(x)}), '[^a-z0-9'']+', ' ', 'g'), ' '), lambda w: trim(w, ''''))"
    kept = f"list_filter({bare}, lambda w: w <> '' AND NOT regexp_full_match(w, '[0-9]+') AND NOT {MIXED} AND w NOT IN {listed(W.LEGACY_IGNORE_WORDS)} AND (len(w) > 1 OR w IN ('a', 'i')))"
    return f"regexp_replace(coalesce(array_to_string({kept}, ' '), ''), '^(i am not scared(?: .*)?) we$', '\\1')"


def sql_words(clean: str) -> str:
    return f"list_filter(string_split({clean}, ' '), lambda w: w <> '')"


def sql_any(padded: str, phrases) -> str:
    return f"regexp_matches({padded}, {lit('|'.join(phrases))})"


NOISY = f"(w IN {listed(W.OCR_GLITCH_WORDS)} OR (len(w) <= 2 AND w NOT IN {listed(W.ALLOWED_SHORT_TOKENS)}) OR (len(w) >= 4 AND NOT regexp_matches(w, '[aeiou]')))"


def sql_jaccard(a: str, b: str) -> str:
    """Of two lists of distinct words."""
    return f"(CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0 ELSE len(list_intersect({a}, {b})) / len(list_distinct(list_concat({a}, {b})))::DOUBLE END)"
