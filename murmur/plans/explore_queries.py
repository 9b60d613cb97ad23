"""Exploration queries: ``events`` (dated; sentiment stand-in = ``event_type``)
and ``documents`` (theme flags; sentiment stand-in = ``lang``)."""

from __future__ import annotations

from pyspark.sql import functions as F

from murmur.functions import presets
from murmur.functions import text as tx
from murmur.operators import explore as ex
from murmur.plans import sqlfrag as S
from murmur.plans.registry import query
from murmur.plans.sampling_queries import DOC_LABELS
from murmur.sources.tables import read_table

EVENT_TYPES = ("click", "error", "purchase", "signup", "view")
FACETS = ex.Facets(sentiments=("click", "purchase", "view"), date_from="2024-01-05", date_to="2024-01-20")
_FACET_SQL = ("event_type IN ('click', 'purchase', 'view') "
              "AND CAST(ts AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-20'")
_THEMES = {S.slug(k): v for k, v in presets.THEMES.items()}


def _events(spark, base):
    return read_table(spark, base, "events")


@query("faceted_filter", f"SELECT event_id, event_type, user_id, value FROM events WHERE {_FACET_SQL}")
def faceted_filter(spark, base):
    e = _events(spark, base).select("event_id", "event_type", "user_id", "value", "ts")
    return ex.faceted_filter(e, FACETS, "event_type", "ts").drop("ts")


@query("theme_facet", f"""
SELECT doc_id, lang FROM (SELECT doc_id, lang, {S.theme_sql('text', list(presets.THEMES.values())[0])} AS a,
  {S.theme_sql('text', list(presets.THEMES.values())[1])} AS b, {S.non_blank('text')} AND length(text) < 1500 AS short FROM documents)
WHERE lang IN ('en', 'fr') AND (a OR b OR short)
""")
def theme_facet(spark, base):
    """The theme facet: any of the chosen flags (two themes, and a flag for short texts, which the test texts raise)."""
    names = list(presets.THEMES)[:2]
    d = read_table(spark, base, "documents").select("doc_id", "lang", "text")
    flags = {f"_t{i}": tx.theme_flag("text", presets.THEMES[n]) for i, n in enumerate(names)}
    d = d.withColumns(flags | {"_short": tx.non_blank("text") & (F.length("text") < 1500)})
    picked = ex.faceted_filter(d, ex.Facets(sentiments=("en", "fr"), themes=[*flags, "_short"]), "lang", None)
    return picked.select("doc_id", "lang")


@query("label_shares", "SELECT label, round(coalesce(avg(CASE WHEN event_type = label THEN 1.0 ELSE 0.0 END) "
       "* 100, 0.0), 9) AS share_pct FROM (VALUES " + ", ".join(f"('{x}')" for x in EVENT_TYPES)
       + f") g(label) LEFT JOIN (SELECT event_type FROM events WHERE {_FACET_SQL}) f ON true GROUP BY label")
def label_shares(spark, base):
    e = ex.faceted_filter(_events(spark, base).select("event_type", "ts"), FACETS, "event_type", "ts")
    s = ex.label_shares(e, "event_type", EVENT_TYPES)
    return s.select("label", F.round("share_pct", 9).alias("share_pct"))


@query("weekly_volume", """
SELECT strftime(date_trunc('week', ts), '%Y-%m-%d') AS week, event_type, count(*) AS comments
FROM events WHERE ts IS NOT NULL GROUP BY ALL
""")
def weekly_volume(spark, base):
    w = ex.weekly_volume(_events(spark, base).select("ts", "event_type"), "ts", "event_type")
    return w.select(F.date_format("week", "yyyy-MM-dd").alias("week"), "event_type", "comments")


def _doc_themes(spark, base):
    d = read_table(spark, base, "documents", spread_key="doc_id").select("doc_id", "lang", "text")
    return d.select("doc_id", "lang", *[tx.theme_flag("text", p).alias(c) for c, p in _THEMES.items()])


_THEME_CTE = "WITH t AS (SELECT doc_id, lang, " + ", ".join(
    f"{S.theme_sql('text', p)} AS {c}" for c, p in _THEMES.items()) + " FROM documents)"


@query("theme_prevalence", _THEME_CTE + " " + " UNION ALL ".join(
    f"SELECT {S.q(c)} AS theme, count(*) FILTER (WHERE {c}) AS comments, "
    f"round(count(*) FILTER (WHERE {c}) * 100.0 / count(*), 9) AS percentage FROM t" for c in _THEMES))
def theme_prevalence(spark, base):
    p = ex.theme_prevalence(_doc_themes(spark, base), list(_THEMES))
    return p.select("theme", "comments", F.round("percentage", 9).alias("percentage"))


@query("theme_sentiment", _THEME_CTE + ", g AS (SELECT * FROM (VALUES " + ", ".join(
    f"({S.q(c)})" for c in _THEMES) + ") a(theme), (VALUES " + ", ".join(f"('{x}')" for x in DOC_LABELS)
    + ") b(sentiment)) SELECT g.theme, g.sentiment, CAST((SELECT count(*) FROM t WHERE t.lang = g.sentiment AND CASE g.theme "
    + " ".join(f"WHEN {S.q(c)} THEN {c}" for c in _THEMES) + " END) AS BIGINT) AS comments FROM g")
def theme_sentiment(spark, base):
    return ex.theme_sentiment(_doc_themes(spark, base), list(_THEMES), "lang", DOC_LABELS)


@query("date_range", """
SELECT strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS min_date, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS max_date
FROM events WHERE ts IS NOT NULL
""")
def date_range(spark, base):
    r = ex.date_range(_events(spark, base).select("ts"), "ts")
    return r.select(*[F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) for c in ("min_date", "max_date")])


# Mixed-format date strings derived from the event timestamps: the layout goes by event type and event_id;
# error events carry their JSON payload, which is not a date.
_LAYOUTS = (("event_type = 'click' AND event_id % 2 = 0", "yyyy-MM-dd HH:mm:ss", "%Y-%m-%d %H:%M:%S", ""),
            ("event_type = 'click'", "yyyy-MM-dd HH:mm:ss.SSS", "%Y-%m-%d %H:%M:%S.%g", ""),
            ("event_type = 'view' AND event_id % 3 = 0", "yyyy-MM-dd'T'HH:mm:ss'Z'", "%Y-%m-%dT%H:%M:%SZ", ""),
            ("event_type = 'view' AND event_id % 3 = 1", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'", "%Y-%m-%dT%H:%M:%S.%gZ", ""),
            ("event_type = 'view'", "yyyy-MM-dd'T'HH:mm:ss", "%Y-%m-%dT%H:%M:%S", "+02:00"),
            ("event_type = 'purchase'", "yyyy/MM/dd HH:mm", "%Y/%m/%d %H:%M", ""),
            ("event_type = 'signup'", "yyyy-MM-dd", "%Y-%m-%d", ""))
PARSE_FORMATS = ("yyyy/MM/dd HH:mm",)


@query("parse_dates", """
WITH r AS (
  SELECT event_id, event_type, ts, CASE """ + " ".join(
    f"WHEN {when} THEN strftime(ts, '{fmt}') || '{offset}'" for when, _, fmt, offset in _LAYOUTS) + """ ELSE props END AS date_raw
  FROM events
)
SELECT event_id, date_raw, CASE
    WHEN event_type = 'view' AND event_id % 3 = 2 THEN strftime(ts - INTERVAL 2 HOUR, '%Y-%m-%d %H:%M:%S')
    WHEN event_type IN ('click', 'view') THEN strftime(ts, '%Y-%m-%d %H:%M:%S')
    WHEN event_type = 'purchase' THEN strftime(date_trunc('minute', ts), '%Y-%m-%d %H:%M:%S')
    WHEN event_type = 'signup' THEN strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') END AS date_utc
FROM r
""")
def parse_dates(spark, base):
    e = _events(spark, base).select("event_id", "event_type", "props", F.col("ts").cast("timestamp").alias("ts"))
    raw = F.col("props")
    for when, layout, _, offset in reversed(_LAYOUTS):
        raw = F.when(F.expr(when), F.concat(F.date_format("ts", layout), F.lit(offset))).otherwise(raw)
    e = e.withColumn("date_raw", raw)
    parsed = ex.parse_mixed_timestamp("date_raw", PARSE_FORMATS)
    return e.select("event_id", "date_raw", F.date_format(parsed, "yyyy-MM-dd HH:mm:ss").alias("date_utc"))
