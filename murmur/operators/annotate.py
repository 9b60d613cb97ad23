"""Annotation: codebook lexicon labeller, model-output parsing, routing, adjudication.

The original pipeline asked a language model per comment over HTTP. Here the
default annotator is deterministic and distributed: the codebook's signal
phrases evaluated as native expressions. A per-row plug-in annotator is still
possible through ``annotate_with`` (``mapInPandas``), with failures turned into
an ``ERROR`` row instead of a failed job.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from murmur.functions import presets
from murmur.functions import text as tx

ANNOTATION_FIELDS = ("label", "confidence", "rationale", "rule_applied")


def _spaced(phrases: Sequence[str]) -> list[str]:
    """Phrases as they stand in text whose words are two spaces apart."""
    return [p.lower().replace(" ", "  ") for p in dict.fromkeys(phrases)]


def negation_prefix(negators: Sequence[str] = presets.CODEBOOK_NEGATORS,
                    between: Sequence[str] = presets.CODEBOOK_BETWEEN) -> str:
    return f"(?:{'|'.join(_spaced(negators))})  (?:(?:{'|'.join(_spaced(between))})  )?"


def signal_pattern(phrases: Sequence[str]) -> str:
    """One signal phrase, with the negator before it if there is one; longer phrases are tried first, so that
    "surveillance state" is one signal and not also "surveillance". For text whose words are two spaces apart:
    every match takes one space on either side, so neighbouring signals are both found."""
    ordered = sorted(_spaced(phrases), key=lambda p: (-len(p), p))
    return f" (?:{negation_prefix()})?(?:{'|'.join(ordered)}) "


def _longest_first(phrases: Sequence[str]) -> str:
    """Pattern of the phrases' prefix tree; of phrases that begin each other the longest is tried first."""
    def of(words: list[str]) -> str:
        by_first = {c: [w[1:] for w in words if w[:1] == c] for c in sorted({w[0] for w in words if w})}
        inner = tx.either([(c, tx.quoted_char(c) + of(own)) for c, own in by_first.items()]) if by_first else ""
        return f"(?:{inner})?" if inner and "" in words else inner
    return of(_spaced(phrases))


def fast_signal_pattern(phrases: Sequence[str]) -> str:
    """Finds what ``signal_pattern`` finds, by a few branches per character."""
    negated = f"(?:{_longest_first(presets.CODEBOOK_NEGATORS)})  (?:(?:{_longest_first(presets.CODEBOOK_BETWEEN)})  )?"
    return f" (?:{negated})?(?:{_longest_first(phrases)}) "


def lexicon_annotate(df: DataFrame, text_col: str = "text",
                     negative: Sequence[str] = presets.CODEBOOK_NEGATIVE,
                     positive: Sequence[str] = presets.CODEBOOK_POSITIVE,
                     neutral: Sequence[str] = presets.CODEBOOK_NEUTRAL,
                     fixed: Sequence[str] = presets.CODEBOOK_FIXED,
                     short_words: int = presets.SHORT_COMMENT_WORDS) -> DataFrame:
    """Adds ``ai_label``, ``ai_confidence``, ``ai_rationale``, ``ai_rule_applied`` by the codebook's rules.

    Signals are the different phrases found, the longest first at each place
    (``signal_pattern``). A negated signal counts for the other side (rule 3).
    Short comments without signal are UNCERTAIN/LOW (rule 8); the side with
    more signals is the label, HIGH when ahead by 2 or more, else MEDIUM (rule
    2); equal sides are NEUTRAL/LOW; without evaluative signal NEUTRAL, MEDIUM
    with informational phrasing, else LOW. The rule named is 3 where a negated
    signal is on the deciding side, else 6 where a term of fixed orientation
    is, else 2.
    """
    spaced = tx.padded_boundary_text(text_col, "  ")
    found = F.array_distinct(F.regexp_extract_all(spaced, F.lit(fast_signal_pattern([*negative, *positive, *neutral])), F.lit(0)))
    prefix = f"^ {negation_prefix()}"
    hits = F.transform(found, lambda h: F.struct(
        h.rlike(prefix).alias("negated"), F.trim(F.regexp_replace(h, prefix, "")).alias("phrase")))

    def among(h: Column, phrases: Sequence[str]) -> Column:
        return h["phrase"].isin(*_spaced(phrases))

    def side(h: Column, own: Sequence[str], other: Sequence[str]) -> Column:
        return (among(h, own) & ~h["negated"]) | (among(h, other) & h["negated"])

    def count(hits_col: Column, test) -> Column:
        return F.size(F.filter(hits_col, test))

    # The hits are made once; the counters come out of a one-row generator, so that a filter on the labels (routing)
    # is evaluated on these integers instead of being rewritten into copies of the search.
    df = df.withColumn("_hits", hits)
    h = F.col("_hits")
    counters = F.struct(
        count(h, lambda x: side(x, negative, positive)).alias("_neg"),
        count(h, lambda x: side(x, positive, negative)).alias("_pos"),
        count(h, lambda x: among(x, neutral)).alias("_neu"),
        count(h, lambda x: side(x, negative, positive) & x["negated"]).alias("_neg3"),
        count(h, lambda x: side(x, positive, negative) & x["negated"]).alias("_pos3"),
        count(h, lambda x: side(x, negative, positive) & among(x, fixed)).alias("_neg6"),
        count(h, lambda x: side(x, positive, negative) & among(x, fixed)).alias("_pos6"),
        tx.word_token_count(text_col).alias("_words"))
    out = df.select("*", F.inline(F.array(counters))).drop("_hits")
    neg, pos, neu, words = F.col("_neg"), F.col("_pos"), F.col("_neu"), F.col("_words")
    no_signal = (neg == 0) & (pos == 0)
    short = no_signal & (words < short_words)
    label = (F.when(short, F.lit("UNCERTAIN"))
              .when(neg > pos, F.lit("NEGATIVE"))
              .when(pos > neg, F.lit("POSITIVE"))
              .otherwise(F.lit("NEUTRAL")))
    margin = F.abs(neg - pos)
    confidence = (F.when(short, F.lit("LOW"))
                   .when(margin >= 2, F.lit("HIGH"))
                   .when(margin == 1, F.lit("MEDIUM"))
                   .when(no_signal & (neu > 0), F.lit("MEDIUM"))
                   .otherwise(F.lit("LOW")))
    decided3 = ((neg > pos) & (F.col("_neg3") > 0)) | ((pos > neg) & (F.col("_pos3") > 0))
    decided6 = ((neg > pos) & (F.col("_neg6") > 0)) | ((pos > neg) & (F.col("_pos6") > 0))
    rule = (F.when(short, F.lit("Rule 8: very short comment without signal"))
             .when(decided3, F.lit("Rule 3: negation"))
             .when(decided6, F.lit("Rule 6: term with fixed orientation"))
             .when(neg > pos, F.lit("Rule 2: negative signals dominate"))
             .when(pos > neg, F.lit("Rule 2: positive signals dominate"))
             .when(~no_signal, F.lit("Rule 2: balanced mixed sentiment"))
             .when(neu > 0, F.lit("NEUTRAL definition: informational phrasing"))
             .otherwise(F.lit("NEUTRAL definition: no evaluative signal")))
    rationale = F.format_string("negative=%d positive=%d neutral=%d words=%d", neg, pos, neu, words)
    return out.withColumns({"ai_label": label, "ai_confidence": confidence, "ai_rationale": rationale,
                            "ai_rule_applied": rule}).drop("_neg", "_pos", "_neu", "_neg3", "_pos3", "_neg6", "_pos6", "_words")


JSON_OBJECT_RE = r'(?s)\{[^{}]*"label"[^{}]*\}'
FENCE_RE = r"```json|```"


def parse_annotation(raw: Column) -> Column:
    """Struct(label, confidence, rationale, rule_applied, parse_ok) from free text.

    First flat ``{...}`` holding ``"label"`` (else the whole text), code fences
    removed, trimmed, parsed; anything that is not a JSON object becomes the
    fixed parse-failure record. Keys absent from a valid object are null.
    """
    return F.struct(*_fields(_reply(raw)))


def parse_annotations(df: DataFrame, raw: str) -> DataFrame:
    """``df`` with the fields of ``parse_annotation`` of column ``raw`` in its place.

    A reply is parsed once: its fields come out of a one-row generator, so that a filter on them (routing) is evaluated on
    the fields instead of being rewritten into copies of the parser.
    """
    kept = [c for c in df.columns if c != raw]
    return df.select(*kept, _reply(F.col(raw)).alias("_v")).select(*kept, F.inline(F.array(F.struct(*_fields(F.col("_v"))))))


def _reply(raw: Column) -> Column:
    """The reply's JSON value; null where there is none."""
    text = F.coalesce(raw, F.lit(""))
    found = F.regexp_extract(text, JSON_OBJECT_RE, 0)
    cand = F.when(found != "", found).otherwise(F.regexp_replace(text, r"(?U)^\s+|\s+$", ""))
    cand = F.regexp_replace(F.regexp_replace(cand, FENCE_RE, ""), r"(?U)^\s+|\s+$", "")
    return F.try_parse_json(cand)


def _fields(v: Column) -> list[Column]:
    is_obj = v.isNotNull() & F.schema_of_variant(v).startswith("OBJECT")
    fail = presets.PARSE_FAILURE
    fields = [F.when(is_obj, F.try_variant_get(v, f"$.{k}", "string")).otherwise(F.lit(fail[i])).alias(k)
              for i, k in enumerate(ANNOTATION_FIELDS)]
    return [*fields, is_obj.alias("parse_ok")]


REVIEW_SCHEMA_COLS = ("human_label", "human_notes")


def _in(col: str, values: Sequence[str]) -> Column:
    return F.coalesce(F.col(col).isin(*values), F.lit(False))


def review_mask(label_col: str = "ai_label", conf_col: str = "ai_confidence") -> Column:
    return _in(label_col, presets.REVIEW_LABELS) | F.coalesce(F.col(conf_col) == "LOW", F.lit(False))


def confirmed_mask(label_col: str = "ai_label", conf_col: str = "ai_confidence") -> Column:
    # A null label is "not in" the review labels, as with a pandas negated isin.
    return ~_in(label_col, presets.REVIEW_LABELS) & _in(conf_col, presets.CONFIRMED_CONFIDENCE)


def route(annotated: DataFrame, label_col: str = "ai_label", conf_col: str = "ai_confidence") -> DataFrame:
    """Adds ``route`` in {review, confirmed, unrouted} (null confidence can be unrouted)."""
    return annotated.withColumn(
        "route", F.when(review_mask(label_col, conf_col), F.lit("review"))
                  .when(confirmed_mask(label_col, conf_col), F.lit("confirmed"))
                  .otherwise(F.lit("unrouted")))


def review_queue(annotated: DataFrame, **kw) -> DataFrame:
    return annotated.filter(review_mask(**kw)).withColumns(
        {"human_label": F.lit(""), "human_notes": F.lit("")})


def confirmed_labels(annotated: DataFrame, **kw) -> DataFrame:
    return annotated.filter(confirmed_mask(**kw))


def label_counts(df: DataFrame, label_col: str, labels: Sequence[str]) -> DataFrame:
    """Value counts re-indexed to a closed label set (absent labels -> 0)."""
    counts = df.groupBy(F.col(label_col).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    grid = df.sparkSession.range(1).select(F.explode(F.array(*[F.lit(x) for x in labels])).alias("label"))
    return grid.join(counts, "label", "left").select("label", F.coalesce("n", F.lit(0)).alias("n"))


def adjudicate(confirmed: DataFrame, reviewed: DataFrame, key: str) -> DataFrame:
    """Final corpus: confirmed rows keep the AI label; reviewed rows with a human
    label take it (human overrides AI); reviewed rows still blank are left out."""
    human = F.nullif(F.trim(F.coalesce(F.col("human_label"), F.lit(""))), F.lit(""))
    rev = reviewed.filter(human.isNotNull()).select(
        key, "ai_label", human.alias("final_label"), F.lit("human").alias("label_source"))
    conf = confirmed.select(key, "ai_label", F.col("ai_label").alias("final_label"),
                            F.lit("ai").alias("label_source"))
    return conf.unionByName(rev)


def agreement(df: DataFrame, ai_col: str = "ai_label", human_col: str = "human_label") -> DataFrame:
    """Agreement on the spot-checked rows (those with both labels)."""
    checked = df.filter(F.col(ai_col).isNotNull() & F.col(human_col).isNotNull())
    return checked.agg(F.count(F.lit(1)).alias("n_checked"),
                       F.count_if(F.col(ai_col) == F.col(human_col)).alias("n_agree"),
                       F.avg((F.col(ai_col) == F.col(human_col)).cast("double")).alias("agreement_rate"))


ANNOTATION_STRUCT = T.StructType([T.StructField(k, T.StringType()) for k in ANNOTATION_FIELDS])


def annotate_with(df: DataFrame, fn: Callable[[dict], dict], key: str, text_col: str = "text",
                  title_col: str | None = None) -> DataFrame:
    """Plug-in annotator ``record -> {label, confidence, rationale, rule_applied}``.

    Runs in Arrow batches on the executors. A reply that is no JSON (``ValueError``
    of a parser) is the fixed parse-failure record; a failed connection and any
    other exception are ``ERROR``/``LOW`` rows of their own rule names, with the
    message cut to ``presets.ERROR_MESSAGE_CHARS`` characters.
    """
    cols = [key, text_col] + ([title_col] if title_col else [])
    out_schema = T.StructType([df.schema[key]] + [T.StructField(f"ai_{k}", T.StringType())
                                                  for k in ANNOTATION_FIELDS])

    def run(batches):
        for pdf in batches:
            rows = []
            for rec in pdf.to_dict("records"):
                try:
                    res = fn(rec) or {}
                except json.JSONDecodeError:
                    res = dict(zip(ANNOTATION_FIELDS, presets.PARSE_FAILURE, strict=True))
                except Exception as e:  # noqa: BLE001 - recorded as an ERROR annotation
                    rule = presets.CONNECTION_FAILURE_RULE if isinstance(e, ConnectionError) else presets.OTHER_FAILURE_RULE
                    res = {"label": "ERROR", "confidence": "LOW", "rationale": str(e)[:presets.ERROR_MESSAGE_CHARS],
                           "rule_applied": rule}
                rows.append({key: rec[key], **{f"ai_{k}": res.get(k) for k in ANNOTATION_FIELDS}})
            yield pd.DataFrame(rows, columns=[f.name for f in out_schema.fields])

    return df.select(*cols).mapInPandas(run, out_schema)
