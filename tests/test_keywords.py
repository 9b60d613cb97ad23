"""Many-keyword patterns against plain containment."""

import random
import time

import pytest

from murmur.functions import presets
from murmur.functions import text as tx


def test_patterns_equal_containment(spark):
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdeé.+ (\\\\", k=rng.randint(1, 5))) for _ in range(60)][10:] + ["abc", "abcd", "C++", ""]
    words = [w for w in words if len(w) != 1]
    texts = [None, "", "x c++ y", "ABCD", "zzz"] + ["".join(rng.choices("abcdeéfgh.+ (\\\\", k=rng.randint(0, 12))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {r.id: r.m for r in df.select("id", tx.many_keywords_match("text", words).alias("m")).collect()}
    want = {i: t is not None and any(w.lower() in t.lower() for w in words if w) for i, t in enumerate(texts)}
    assert got == want and 0 < sum(want.values()) < len(want)
    assert not any(r.m for r in df.select(tx.many_keywords_match("text", []).alias("m")).collect())


def test_ten_thousand_keywords(spark):
    rng = random.Random(6)
    words = list({"".join(rng.choices("abcdefghijklmnopqrst", k=8)) for _ in range(10_000)})
    patterns = tx.keyword_patterns(words)
    assert len(patterns) < 6 and all(len(p) < 65_000 for p in patterns)
    texts = [" ".join("".join(rng.choices("abcdefghijklmnopqrst", k=7)) for _ in range(400)) for _ in range(40)]
    hit = [t[:900] + rng.choice(words) + t[900:] if i % 4 == 0 else t for i, t in enumerate(texts)]

    def run(copies):  # texts of several lengths with the planted word at the end
        df = spark.createDataFrame([(i, t * (copies - 1) + h) for i, (t, h) in enumerate(zip(texts, hit, strict=True))], "id int, text string").cache()
        df.count()
        start = time.time()
        found = {r.id for r in df.filter(tx.many_keywords_match("text", words)).select("id").collect()}
        return found, time.time() - start
    run(1)
    (one, short), (ten, long) = run(4), run(40)
    assert one == ten == {i for i in range(40) if any(w in hit[i] for w in words)} and set(range(0, 40, 4)) <= one
    assert long < 40 * max(short, 0.05)  # ten times the text; squares would be a hundred times


def test_too_many_keywords_raise(monkeypatch):
    monkeypatch.setattr(tx, "MAX_KEYWORDS", 2)
    with pytest.raises(ValueError):
        tx.keyword_patterns(["a", "b", "c"])


def test_a_place_meets_few_branches(spark):
    # the preset's alternation tried all of its 90 keywords at every place of a text.
    pattern, = tx.keyword_patterns(presets.SELECTION_KEYWORDS)
    branches, most = [1], 1
    for c in pattern:
        if c == "(":
            branches.append(1)
        elif c == ")":
            branches.pop()
        elif c == "|":
            branches[-1] += 1
            most = max(most, branches[-1])
    assert branches == [1] and most <= tx.BRANCHES
    texts = [f"x {k.upper()}y" for k in presets.SELECTION_KEYWORDS] + [k[:-1] for k in presets.SELECTION_KEYWORDS] + [None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").select("id", tx.keyword_match("text", presets.SELECTION_KEYWORDS).alias("m"))
    assert r"\Q" not in df._jdf.queryExecution().analyzed().toString()
    want = {i: t is not None and any(k in t.lower() for k in presets.SELECTION_KEYWORDS) for i, t in enumerate(texts)}
    assert {r.id: r.m for r in df.collect()} == want
