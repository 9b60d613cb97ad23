"""The signal search by prefix tree against the plain alternation."""

import random

from murmur.functions import presets
from murmur.functions import text as tx
from murmur.operators import annotate as an
from pyspark.sql import functions as F

PHRASES = [*presets.CODEBOOK_NEGATIVE, *presets.CODEBOOK_POSITIVE, *presets.CODEBOOK_NEUTRAL]


def test_tree_finds_what_the_alternation_finds(spark):
    # the annotator's search tried every phrase at every word.
    rng = random.Random(3)
    words = [*PHRASES, *presets.CODEBOOK_NEGATORS, *presets.CODEBOOK_BETWEEN, "surveillances", "é", "x,", "\U0001d400", "state", "no.", "-"]
    texts = [None, "", " ", *(" ".join(rng.choices(words, k=rng.randint(1, 9))).upper() for _ in range(400))]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    plain = F.regexp_replace(tx.padded_boundary_text("text"), " ", "  ")
    fast = tx.padded_boundary_text("text", "  ")
    rows = df.select(plain.alias("p"), fast.alias("f"), F.regexp_extract_all(plain, F.lit(an.signal_pattern(PHRASES)), F.lit(0)).alias("a"),
                     F.regexp_extract_all(fast, F.lit(an.fast_signal_pattern(PHRASES)), F.lit(0)).alias("b")).collect()
    assert all(r.p == r.f and r.a == r.b for r in rows) and sum(len(r.a) for r in rows) > 400
    used = an.lexicon_annotate(df)._jdf.queryExecution().analyzed().toString()
    assert an.signal_pattern(PHRASES)[:40] not in used


def test_a_reply_is_parsed_once(spark):
    # the filter on the label held copies of the parser, and so did every field.
    import __spark_entry__ as E
    plan = E.queries()["review_queue"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parseJson") <= 2  # one for each of the two sources
