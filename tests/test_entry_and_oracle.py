"""Driver contract and the SQL-oracle sweep on the smallest scale factor."""

import os

import pytest

SF = "/root/testdata/sf0.001"


def test_entry(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.columns == ["conv_id", "turn", "comment_keyword_match", "post_title_keyword_match",
                          "substantive_comment", "keyword_eligible", "keyword_match_source"]
    assert df.count() > 0


def test_every_oracle_key_is_a_query():
    import __spark_entry__ as E
    assert set(E.oracle_sql()) <= set(E.queries())


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")
def test_oracle_sweep(spark):
    import __spark_entry__ as E
    from tests.oracle_compare import compare
    names = sorted(E.oracle_sql())
    res = compare(spark, SF, names, verbose=False)
    bad = {k: v for k, v in res.items() if v != "OK"}
    assert not bad, bad
