"""Lemma tables: the broadcast form equals the joined one and moves no tokens."""

import pytest

import __spark_entry__ as E
from murmur.operators import textops

SF = "/root/testdata/sf0.001"


def test_broadcast_equals_join(spark, monkeypatch):
    rows = [(1, ["cats", "x", "cats", "dogs"]), (2, []), (3, None), (4, ["x", None, "dogs"]), (5, ["cat"])]
    df = spark.createDataFrame(rows, "id long, t array<string>")
    some = spark.createDataFrame([("cats", "cat"), ("dogs", "dog"), (None, "x"), ("x", None)], "form string, lemma string")
    want = {1: (["cat", "x", "cat", "dog"], 3), 2: ([], 0), 3: (None, 0), 4: (["x", None, "dog"], 1), 5: (["cat"], 0)}
    for limit in (textops.BROADCAST_LEMMA_BYTES, 0):
        monkeypatch.setattr(textops, "BROADCAST_LEMMA_BYTES", limit)
        got = {r.id: (r.lemmatised, r.n_changed) for r in textops.apply_lemmas(df, "id", "t", some).collect()}
        assert got == want
    monkeypatch.undo()
    assert {r.id: r.lemmatised for r in textops.apply_lemmas(df, "id", "t", some.limit(0)).collect()} == dict(rows)
    with pytest.raises(ValueError):
        textops.apply_lemmas(df, "id", "t", some.union(some))


def test_lemma_join_moves_no_tokens(spark):
    # tokens were shuffled by form and by document, and the texts cut into words three times.
    plan = E.queries()["lemma_join"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
