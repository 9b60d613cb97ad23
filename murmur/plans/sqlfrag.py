"""Fragments for the oracle SQL texts (DuckDB dialect, RE2 regexes).

RE2's ``\\w``/``\\s``/``\\b`` are ASCII-only, so the oracle spells out the
Unicode classes Spark's ``(?U)`` mode uses.
"""

from __future__ import annotations

from collections.abc import Sequence

from murmur.functions import presets
from murmur.functions.text import default_stopwords

WS = r"[\t\n\x0B\f\r \x{85}\p{Z}]"
NWS = r"[^\t\n\x0B\f\r \x{85}\p{Z}]"
WORD = r"[\p{L}\p{M}\p{Nd}\p{Pc}]"


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def str_list(items: Sequence[str]) -> str:
    return "[" + ", ".join(q(i) for i in items) + "]"


def kw_match(col: str, keywords: Sequence[str]) -> str:
    kws = list(dict.fromkeys(k.lower() for k in keywords))
    ors = " OR ".join(f"contains(lower({col}), {q(k)})" for k in kws)
    return f"coalesce(({ors}), false)"


def word_token_count(col: str) -> str:
    return (f"len(list_filter(string_split_regex(coalesce({col}, ''), '{WS}+'), "
            f"lambda w: regexp_matches(w, '^{WORD}')))")


def substantive(col: str, n: int = 5) -> str:
    return f"(CASE WHEN {col} IS NULL THEN false ELSE {word_token_count(col)} >= {n} END)"


def non_blank(col: str) -> str:
    return f"coalesce(regexp_matches({col}, '{NWS}'), false)"


def light_clean(col: str) -> str:
    t = f"regexp_replace(coalesce({col}, ''), 'http{NWS}+|www\\.{NWS}+', ' ', 'g')"
    t = f"regexp_replace({t}, '@{WORD}+', ' ', 'g')"
    return f"trim(regexp_replace({t}, '{WS}+', ' ', 'g'))"


def normalised(col: str) -> str:
    t = f"lower(coalesce({col}, ''))"
    t = f"regexp_replace({t}, 'http{NWS}+|www\\.{NWS}+', ' ', 'g')"
    t = f"regexp_replace({t}, '@{WORD}+', ' ', 'g')"
    t = f"regexp_replace({t}, '#({WORD}+)', '\\1', 'g')"
    return f"regexp_replace({t}, '[^a-z]+', ' ', 'g')"


def tokens(col: str, extra_stop: Sequence[str] = (), min_chars: int = 2) -> str:
    stop = sorted(set(default_stopwords()) | set(extra_stop))
    return (f"list_filter(string_split({normalised(col)}, ' '), "
            f"lambda w: length(w) >= {min_chars} AND NOT list_contains({str_list(stop)}, w))")


def topic_tokens(col: str) -> str:
    # Lemmatisation is identity by default, so the post-lemma re-filter is a no-op
    # on the already filtered list; it is kept to state the rule.
    extra = sorted(set(presets.TOPIC_STOPWORDS))
    return (f"list_filter({tokens(col, presets.TOPIC_STOPWORDS, 3)}, "
            f"lambda w: NOT list_contains({str_list(extra)}, w))")


def padded_boundary(col: str) -> str:
    return f"(' ' || regexp_replace(lower(coalesce({col}, '')), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g') || ' ')"


def re2_pattern(pattern: str) -> str:
    """Rewrite a Python/Java-Unicode regex for RE2: Unicode classes, emulated \\b.

    Only leading/trailing ``\\b`` occur in the theme presets; a boolean "matches
    somewhere" test may consume the boundary character.
    """
    body = pattern
    lead = body.startswith(r"\b")
    trail = body.endswith(r"\b")
    if lead:
        body = body[2:]
    if trail:
        body = body[:-2]
    body = body.replace(r"\w", WORD).replace(r"\s", WS).replace(r"\d", r"\p{Nd}")
    if lead:
        body = rf"(?:^|[^\p{{L}}\p{{M}}\p{{Nd}}\p{{Pc}}])" + f"(?:{body})"
    if trail:
        body = f"(?:{body})" + rf"(?:[^\p{{L}}\p{{M}}\p{{Nd}}\p{{Pc}}]|$)"
    return body


def theme_sql(col: str, pattern: str) -> str:
    return f"coalesce(regexp_matches({col}, {q(re2_pattern(pattern))}, 'i'), false)"


def slug(name: str) -> str:
    import re
    return "theme_" + re.sub(r"[^a-z0-9]+", "_", name.lower()).strip("_")
