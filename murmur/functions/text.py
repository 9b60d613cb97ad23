"""Column expressions for text work — all native Spark functions (codegen, no UDF).

Regexes use ``(?U)`` so ``\\w``, ``\\s`` and ``\\b`` are Unicode-aware as in the
original Python pipeline (the test corpora are accented French/German/Spanish).
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from murmur.functions import presets

# http\S+|www\.\S+, with one look at a character that begins neither
URL_RE = r"(?U)[hw](?:(?<=h)ttp|(?<=w)ww\.)\S+"
MENTION_RE = r"(?U)@\w+"
HASHTAG_RE = r"(?U)#(\w+)"
NON_LATIN_RE = r"(?U)[^a-z\s]"
WS_RE = r"(?U)\s+"


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def text_or_empty(col: Column | str) -> Column:
    """Null text is the empty string, never the word ``None``/``nan``."""
    return F.coalesce(_c(col).cast("string"), F.lit(""))


def light_clean(col: Column | str) -> Column:
    """URLs and @mentions to spaces, whitespace collapsed, trimmed; case kept."""
    t = F.regexp_replace(text_or_empty(col), URL_RE, " ")
    t = F.regexp_replace(t, MENTION_RE, " ")
    return F.trim(F.regexp_replace(t, WS_RE, " "))


def default_stopwords() -> tuple[str, ...]:
    neg = set(presets.NEGATORS)
    return tuple(w for w in presets.BASIC_STOPWORDS if w not in neg)


def normalised_for_tokens(col: Column | str) -> Column:
    """lower -> URLs -> mentions -> '#tag' to 'tag' -> non a-z to space."""
    t = F.lower(text_or_empty(col))
    t = F.regexp_replace(t, URL_RE, " ")
    t = F.regexp_replace(t, MENTION_RE, " ")
    t = F.regexp_replace(t, HASHTAG_RE, "$1")
    return F.regexp_replace(t, NON_LATIN_RE, " ")


def tokens(col: Column | str, extra_stop: Iterable[str] = (), min_chars: int = 2,
           stopwords: Sequence[str] | None = None, lemmas: Column | None = None) -> Column:
    """Token array: stop filter and length test happen *before* lemmatisation.

    ``lemmas`` is an optional map column ``form -> lemma``; identity otherwise.
    """
    stop = sorted(set(default_stopwords() if stopwords is None else stopwords) | set(extra_stop))
    words = F.split(normalised_for_tokens(col), WS_RE)

    def keep(w: Column) -> Column:
        cond = (F.length(w) >= F.lit(max(min_chars, 1)))
        if stop:
            # A literal IN list of this size is planned as a hash-set probe.
            cond = cond & ~w.isin(*stop)
        return cond

    kept = F.filter(words, keep)
    if lemmas is not None:
        kept = F.transform(kept, lambda w: F.coalesce(F.element_at(lemmas, w), w))
    return kept


def preprocess(col: Column | str) -> Column:
    """Cleaned, space-joined string (the ``text_clean`` column)."""
    return F.array_join(tokens(col, min_chars=2), " ")


def topic_tokens(col: Column | str, extra_stop: Sequence[str] = presets.TOPIC_STOPWORDS,
                 min_chars: int = 3, lemmas: Column | None = None) -> Column:
    """Topic-model tokens: extra stop words, 3+ chars, re-filtered after lemmas."""
    toks = tokens(col, extra_stop=extra_stop, min_chars=min_chars, lemmas=lemmas)
    if lemmas is None:
        return toks  # identity lemmas: the re-filter cannot remove anything
    extra = sorted(set(extra_stop))
    return F.filter(toks, lambda w: ~w.isin(*extra))


def keyword_match(col: Column | str, keywords: Sequence[str]) -> Column:
    """Case-insensitive substring match of any keyword; non-strings never match.

    One pattern of the keywords' prefix tree (``keyword_patterns``) over the text
    lower-cased once, instead of an alternation that tries every keyword at every place.
    """
    return many_keywords_match(col, keywords)


MAX_KEYWORDS = 100_000
PATTERN_CHARS = 20_000
# Branches that are tried one by one; more are halved by a look at the next character.
BRANCHES = 4


def quoted_char(c: str) -> str:
    return c if c.isalnum() else f"\\x{{{ord(c):x}}}"


def either(branches: list[tuple[str, str]]) -> str:
    """Any of the (first character, pattern) branches."""
    if len(branches) == 1:
        return branches[0][1]
    if len(branches) <= BRANCHES:
        return "(?:" + "|".join(p for _, p in branches) + ")"
    halves = branches[:len(branches) // 2], branches[len(branches) // 2:]
    return "(?:" + "|".join(f"(?=[{''.join(quoted_char(c) for c, _ in own)}]){either(own)}" for own in halves) + ")"


def _factored(words: list[str], at: int = 0) -> str:
    """Pattern of sorted words that agree before ``at``. A word that begins others stands for them: who contains them
    contains it."""
    if len(words[0]) == at:
        return ""
    parts = []
    start = 0
    for i in range(1, len(words) + 1):
        if i == len(words) or words[i][at] != words[start][at]:
            own = words[start][at]
            parts.append((own, quoted_char(own) + _factored(words[start:i], at + 1)))
            start = i
    return either(parts)


def keyword_patterns(keywords: Iterable[str]) -> list[str]:
    """Patterns that together find any of the lower-cased keywords, common beginnings written once.

    They follow the keywords' prefix tree, so that a place in a text meets a few branches per character, not every keyword.
    Sorted keywords are cut into patterns of at most about ``PATTERN_CHARS`` characters, which a plan can hold as text.
    Empty keywords are left out; more than ``MAX_KEYWORDS`` raise.
    """
    words = sorted({k.lower() for k in keywords if k})
    if len(words) > MAX_KEYWORDS:
        raise ValueError(f"{len(words)} keywords; at most {MAX_KEYWORDS}")
    out, own, held = [], [], 0
    for w in words:
        if own and held + len(w) > PATTERN_CHARS:
            out.append(_factored(own))
            own, held = [], 0
        own.append(w)
        held += len(w)
    return out + ([_factored(own)] if own else [])


def many_keywords_match(col: Column | str, keywords: Iterable[str]) -> Column:
    """``keyword_match`` for thousands of keywords: false for null texts and without keywords."""
    found = F.lit(False)
    for pattern in keyword_patterns(keywords):
        found = found | F.lower(_c(col)).rlike(pattern)
    return F.coalesce(found, F.lit(False))


def word_token_count(col: Column | str) -> Column:
    """Whitespace tokens whose first character is a word character."""
    return F.regexp_count(text_or_empty(col), F.lit(r"(?U)(?<!\S)\w"))


def substantive(col: Column | str, min_tokens: int = 5) -> Column:
    return F.when(_c(col).isNull(), F.lit(False)).otherwise(word_token_count(col) >= min_tokens)


def non_blank(col: Column | str) -> Column:
    """True when the text has a non-whitespace character (Python ``strip() != ''``)."""
    return F.coalesce(_c(col).rlike(r"(?U)\S"), F.lit(False))


def theme_flag(col: Column | str, pattern: str) -> Column:
    return F.coalesce(_c(col).rlike("(?iU)" + pattern), F.lit(False))


def theme_flags(col: Column | str, themes: Mapping[str, str] = presets.THEMES) -> dict[str, Column]:
    return {name: theme_flag(col, pat) for name, pat in themes.items()}


def preview(col: Column | str, n: int = presets.PREVIEW_CHARS) -> Column:
    return F.substring(F.regexp_replace(text_or_empty(col), WS_RE, " "), 1, n)


def picker_label(id_col: Column | str, label_col: Column | str, text_col: Column | str) -> Column:
    return F.concat_ws(" | ", _c(id_col).cast("string"), _c(label_col).cast("string"), preview(text_col))


def prompt_text(comment: Column | str, title: Column | str) -> Column:
    """The annotator's input text; the parent title is cut to 300 characters."""
    t = F.substring(text_or_empty(title), 1, presets.PROMPT_TITLE_CHARS)
    return F.concat(
        F.lit(presets.PROMPT_HEAD + "\n\n" + presets.PROMPT_TITLE_HEADER + "\n"), t,
        F.lit("\n\n" + presets.PROMPT_COMMENT_HEADER + "\n"), text_or_empty(comment))


def bigrams(toks: Column) -> Column:
    """Adjacent word pairs of a token array, space-joined."""
    n = F.greatest(F.size(toks) - 1, F.lit(0))
    return F.zip_with(F.slice(toks, 1, n), F.slice(toks, 2, n),
                      lambda a, b: F.concat_ws(" ", a, b))


def ngrams(toks: Column, n_max: int = 2) -> Column:
    """Word n-grams for ``ngram_range=(1, n_max)``; unigrams first, then bigrams."""
    if n_max == 1:
        return toks
    if n_max != 2:
        raise ValueError("ngram_range up to (1, 2) is supported")
    return F.concat(toks, bigrams(toks))


def padded_boundary_text(col: Column | str, space: str = " ") -> Column:
    """Lower-cased text with every non letter/digit run as one ``space``, space-padded.

    ``contains(' ' + phrase + ' ')`` on it is a whole-word phrase test that
    behaves identically in any engine with Unicode classes.
    """
    # The plain letters are named first: they need no look-up of their Unicode category.
    t = F.regexp_replace(F.lower(text_or_empty(col)), r"[^a-z0-9\p{L}\p{N}]+", space)
    return F.concat(F.lit(space), t, F.lit(space))
