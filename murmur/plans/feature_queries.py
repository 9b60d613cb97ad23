"""Feature queries over ``documents`` tokens and ``embeddings`` vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from murmur.functions import presets
from murmur.functions import text as tx
from murmur.operators import features as fx
from murmur.plans import sqlfrag as S
from murmur.plans.registry import query
from murmur.sources.tables import read_table

NUM_WORDS = presets.NUM_WORDS
MAXLEN = presets.MAX_SEQUENCE_LEN


def doc_tokens(spark, base, topic: bool = False, *cols):
    d = read_table(spark, base, "documents", spread_key="doc_id").select("doc_id", "text", *cols)
    t = tx.topic_tokens("text") if topic else tx.tokens("text")
    return d.select("doc_id", *cols, t.alias("tokens"))


_TOK_CTE = f"WITH toks AS (SELECT doc_id, {S.tokens('text')} AS t FROM documents)"


@query("tfidf", _TOK_CTE + """,
tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS term FROM toks) GROUP BY ALL),
n AS (SELECT count(*) AS n FROM documents),
v AS (SELECT term, ln((1 + (SELECT n FROM n)) / (1 + count(*))) + 1 AS idf FROM tf GROUP BY term HAVING count(*) >= 2),
w AS (SELECT doc_id, tf.term, (1 + ln(tf)) * idf AS w FROM tf JOIN v ON tf.term = v.term)
SELECT doc_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 9) AS tfidf FROM w
""")
def tfidf(spark, base):
    t = fx.tfidf(doc_tokens(spark, base), "doc_id", "tokens", min_df=2)
    return t.select("doc_id", "term", F.round("tfidf", 9).alias("tfidf"))


_VOCAB_CTE = _TOK_CTE + f""",
counts AS (SELECT term, count(*) AS n FROM (SELECT unnest(t) AS term FROM toks) GROUP BY term),
vocab AS (
  SELECT term, n, word_id FROM (SELECT term, n, row_number() OVER (ORDER BY n DESC, term) + 1 AS word_id FROM counts)
  WHERE word_id < {NUM_WORDS}
)"""


def _vocab(spark, base):
    return fx.vocab_rank(doc_tokens(spark, base), "tokens", NUM_WORDS)


@query("vocab_rank", _VOCAB_CTE + " SELECT term, n, word_id FROM vocab")
def vocab_rank(spark, base):
    return _vocab(spark, base)


@query("pad_sequences", _VOCAB_CTE + f""",
heads AS (SELECT doc_id, t[1:{MAXLEN}] AS h FROM toks),
ex AS (SELECT doc_id, unnest(h) AS w, generate_subscripts(h, 1) AS pos FROM heads),
ids AS (SELECT ex.doc_id, list(coalesce(v.word_id, 1) ORDER BY ex.pos) AS s
        FROM ex LEFT JOIN vocab v ON ex.w = v.term GROUP BY ex.doc_id),
full_ids AS (SELECT d.doc_id, coalesce(i.s, []) AS s FROM documents d LEFT JOIN ids i ON d.doc_id = i.doc_id)
SELECT doc_id, array_to_string(list_concat(s, list_transform(range({MAXLEN} - len(s)), lambda i: 0)), ',')
       AS sequence FROM full_ids
""")
def pad_sequences(spark, base):
    p = fx.pad_sequences(doc_tokens(spark, base), "doc_id", "tokens", _vocab(spark, base), MAXLEN)
    return p.select("doc_id", F.array_join("sequence", ",").alias("sequence"))


@query("doc_frequency", f"""
WITH toks AS (SELECT doc_id, {S.topic_tokens('text')} AS t FROM documents),
df AS (SELECT term, count(*) AS doc_freq FROM (SELECT DISTINCT doc_id, unnest(t) AS term FROM toks) GROUP BY term)
SELECT term, doc_freq FROM df
WHERE doc_freq >= 5 AND doc_freq <= CAST(floor(0.5 * (SELECT count(*) FROM documents)) AS BIGINT)
""")
def doc_frequency(spark, base):
    from murmur.operators.topics import dictionary
    return dictionary(doc_tokens(spark, base, True), "tokens", no_below=5, no_above=0.5).select(
        "term", F.col("df").alias("doc_freq"))


@query("top_terms_per_group", f"""
WITH toks AS (SELECT lang, {S.topic_tokens('text')} AS t FROM documents),
c AS (SELECT lang, term, count(*) AS n FROM (SELECT lang, unnest(t) AS term FROM toks) GROUP BY ALL)
SELECT lang, rank, term, n FROM (
  SELECT lang, term, n, row_number() OVER (PARTITION BY lang ORDER BY n DESC, term) AS rank FROM c
) WHERE rank <= {presets.TOP_WORDS}
""")
def top_terms_per_group(spark, base):
    from murmur.operators.topics import top_terms
    return top_terms(doc_tokens(spark, base, True, "lang"), "lang", "tokens", presets.TOP_WORDS)


@query("standardise", """
WITH ex AS (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS x, generate_subscripts(embedding, 1) - 1 AS dim
            FROM embeddings),
st AS (SELECT dim, avg(x) AS mean, stddev_samp(x) AS sd FROM ex GROUP BY dim)
SELECT vec_id, CAST(ex.dim AS INTEGER) AS dim,
       round(CASE WHEN sd > 0 THEN (x - mean) / sd ELSE 0.0 END, 9) AS z
FROM ex JOIN st ON ex.dim = st.dim
""")
def standardise(spark, base):
    e = read_table(spark, base, "embeddings").select("vec_id", "embedding")
    z = fx.standardise_long(e, "vec_id", "embedding")
    return z.select("vec_id", F.col("dim").cast("int"), F.round("z", 9).alias("z"))


_SOFTMAX_CTE = """
WITH x AS (SELECT vec_id, label, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS x FROM embeddings),
sm AS (
  SELECT vec_id, label, x, list_max(x) AS m,
         list_sum(list_transform(x, lambda v: exp(v - list_max(x)))) AS s FROM x
),
soft AS (
  SELECT vec_id, label, CAST(list_position(x, m) - 1 AS INTEGER) AS predicted_index, 1.0 / s AS top_probability FROM sm
)"""


def softmax_table(spark, base):
    e = read_table(spark, base, "embeddings").select("vec_id", "label", "embedding")
    p = fx.softmax(F.col("embedding"))
    return e.select("vec_id", "label", fx.first_argmax(p).cast("int").alias("predicted_index"),
                    F.array_max(p).alias("top_probability"))


@query("softmax_scores", _SOFTMAX_CTE + """
SELECT vec_id, predicted_index, round(top_probability, 9) AS top_probability FROM soft
""")
def softmax_scores(spark, base):
    return softmax_table(spark, base).select("vec_id", "predicted_index",
                                             F.round("top_probability", 9).alias("top_probability"))


SCORE_LABELS = ("NEGATIVE", "NEUTRAL", "POSITIVE", "UNCERTAIN")


@query("label_scores", """
WITH x AS (SELECT vec_id, list_transform(embedding[1:3], lambda v: exp(CAST(v AS DOUBLE) - CAST(list_max(embedding[1:3]) AS DOUBLE))) AS e
           FROM embeddings),
g AS (SELECT * FROM (VALUES ('NEGATIVE', 1), ('NEUTRAL', 2), ('POSITIVE', 3), ('UNCERTAIN', 4)) v(label, i))
SELECT vec_id, label, round(coalesce(e[i] / list_sum(e), 0.0), 9) AS score FROM x, g
""")
def label_scores(spark, base):
    """Scores of three logits by label name; the fourth label has no logit and gets 0."""
    e = read_table(spark, base, "embeddings").select("vec_id", fx.softmax(F.slice("embedding", 1, 3)).alias("p"))
    scores = F.map_from_arrays(F.array(*[F.lit(x) for x in SCORE_LABELS[:3]]), F.col("p"))
    out = fx.label_scores(e, "vec_id", scores, SCORE_LABELS)
    return out.select("vec_id", "label", F.round("score", 9).alias("score"))


@query("dominant_topic", """
WITH a AS (SELECT vec_id, list_transform(embedding, lambda v: abs(CAST(v AS DOUBLE))) AS a FROM embeddings),
p AS (SELECT vec_id, list_transform(a, lambda v: v / list_sum(a)) AS p FROM a)
SELECT vec_id, CAST(list_position(p, list_max(p)) - 1 AS INTEGER) AS dominant_topic,
       round(list_max(p), 9) AS topic_probability FROM p
""")
def dominant_topic(spark, base):
    from murmur.operators.topics import dominant_topic as dom
    e = read_table(spark, base, "embeddings").select("vec_id", "embedding")
    dist = e.select("vec_id", fx.l1_normalise(F.col("embedding")).alias("p"))
    d = dom(dist, "p")
    return d.select("vec_id", "dominant_topic", F.round("topic_probability", 9).alias("topic_probability"))
