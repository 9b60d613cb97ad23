"""Whitening, quality classifier, lexical search."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from murmur.llm import lexical, quality, queries, whiten
from murmur.llm.common import ship

SF = "/root/testdata/sf0.01"


@pytest.fixture(autouse=True)
def _shipped(spark):
    ship(spark)


# --- whitening -------------------------------------------------------------------

def test_factor_and_rotations_give_the_eigenvectors():
    rng = np.random.default_rng(1)
    for n, rank in ((1, 1), (5, 5), (8, 3), (33, 33)):
        rows = rng.normal(size=(200, rank)) @ rng.normal(size=(rank, n)) * 10.0 ** rng.integers(-3, 3, n)
        a = rows.T @ rows
        lower, order = whiten.pivoted_cholesky(a)
        assert lower.shape == (n, rank) and np.allclose(np.triu(lower, 1), 0)
        assert np.allclose(lower @ lower.T, a[order][:, order], rtol=1e-9, atol=1e-9 * a.diagonal().max())
        u = whiten.one_sided_jacobi(lower)
        want = np.linalg.eigvalsh(a)[::-1][:rank]
        assert np.allclose((u * u).sum(axis=0), want, rtol=1e-8, atol=1e-12 * want[0])
        gram = u.T @ u
        assert np.abs(gram - np.diag(gram.diagonal())).max() <= 1e-12 * want[0]


def brute_whitening(vectors):
    x = np.floor(256 * np.array(vectors, dtype=np.float64)).astype(np.int64)
    own = np.unique(x, axis=0)
    n, s = len(own), own.sum(axis=0)
    gap = own - s / n
    values, axes = np.linalg.eigh(gap.T @ gap / n)
    values, axes = values[::-1], axes[:, ::-1]
    deviation = [sum((n * int(v) - int(t)) ** 2 for v, t in zip(row, s, strict=True)) for row in x]
    return n, deviation, ((x - s / n) @ axes[:, :4]) / np.sqrt(values[:4]), values[:4] / values.sum()


def test_whitening_against_brute_force(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    got = queries.QUERIES["op11_whitening"](spark, SF).collect()
    n, deviation, whitened, explained = brute_whitening([r.embedding for r in rows])
    assert len(got) == 4 * len(rows)
    at = {r.vec_id: i for i, r in enumerate(rows)}
    sign = {}
    for r in got:
        i, c = at[r.vec_id], r.component - 1
        assert (r.n, r.deviation) == (n, deviation[i])
        assert r.explained == pytest.approx(explained[c], rel=1e-9) and 0 <= r.identity_error < 1e-9
        side = sign.setdefault(c, math.copysign(1, r.whitened * whitened[i, c])) if abs(whitened[i, c]) > 1e-3 else sign.get(c, 1)
        assert r.whitened * side == pytest.approx(whitened[i, c], abs=1e-8)


def test_whitening_edges(spark):
    nan, inf = float("nan"), float("inf")
    rng = random.Random(3)
    good = [[rng.gauss(0, 2) for _ in range(3)] for _ in range(40)]
    rows = [(i, v, "x") for i, v in enumerate(good)] + [(i, v, "x") for i, v in enumerate(good)] * 2  # copies count once
    rows += [(None, good[0], None), (100, None, "x"), (101, [1.0, None, 2.0], "x"), (102, [nan, 1.0, 1.0], "x"),
             (103, [inf, 0.0, 0.0], "x"), (104, [1e300, 0.0, 0.0], "x"), (105, [], "x"), (106, [1.0, 2.0], "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, component string")
    got = whiten.whiten(df).collect()
    n, deviation, _, explained = brute_whitening(good)
    assert n == 40 and len(got) == (3 * 40 + 1) * 3  # three components; the lone vector of two entries has none
    assert {r.vec_id for r in got} == {None, *range(40)}
    assert all(r.n == 40 and (r.vec_id is None or r.deviation == deviation[r.vec_id]) for r in got)
    assert {r.component: pytest.approx(r.explained) for r in got} == {i + 1: explained[i] for i in range(3)}
    assert whiten.whiten(df.limit(0)).count() == 0
    assert whiten.whiten(spark.createDataFrame([(1, [0.5, 0.5])] * 3, "vec_id long, embedding array<float>")).count() == 0
    # Deviations beyond 64 bits are null; large entries go through exact sums; a variance below rounding is none.
    huge = spark.createDataFrame([(1, [1e15, 1.0]), (2, [-1e15, 0.5]), (3, [3e15, 0.0])], "vec_id long, embedding array<double>")
    far = {r.vec_id: r for r in whiten.whiten(huge).collect()}
    # The first row's long entry is the mean, so its deviation is that of the second entry.
    assert {k: r.deviation for k, r in far.items()} == {1: (3 * 256 - 384) ** 2, 2: None, 3: None}
    assert all(r.component == 1 and r.identity_error < 1e-9 for r in far.values())
    with pytest.raises(ValueError):
        whiten.whiten(spark.createDataFrame([(i, [1.0] * i) for i in range(1, 67)], "vec_id long, embedding array<double>"))


# --- quality ---------------------------------------------------------------------

def own_features(text):
    """Features by loops over one text, as (kind, value) pairs."""
    words = text.split()
    grams = [("g", text[i:i + n]) for n in quality.GRAMS for i in range(len(text) - n + 1)]
    return grams + [("w", w) for w in words] + [("p", tuple(sorted(p)) if p[0] != p[1] else "same") for p in zip(words, words[1:], strict=False)]


def test_features_against_loops():
    texts = ["Ab ab\tAb  ab ab", None, "", "x", "é　ñ 漢字 漢字 漢字", "a b b a", " lead and trail \n"]
    slots, owners = quality.feature_slots(texts)
    for i, text in enumerate(texts):
        own = Counter(own_features(text or ""))
        found = Counter(slots[owners == i].tolist())
        assert sorted(own.values()) == sorted(found.values())  # as many features, each as often
        for word in set((text or "").split()):  # a word's features are the same buckets wherever it stands
            assert set(quality.feature_slots([word])[0].tolist()) <= set(found)
    repeated, _ = quality.feature_slots(["q q", "zz zz"])
    assert len(set(repeated.tolist()) & set(quality.feature_slots(["other other"])[0].tolist())) >= 1


def test_folded_scores_equal_the_network():
    texts = ["good words in a row " * 3, "BAD!! BAD!! WORSE!!", "good calm words", "AWFUL!! NOISE!!", "calm row of words", "X!! Y!! Z!!"]
    rows = [(int(not t.isupper()), *f) for t, f in zip(texts, quality.feature_counts(texts), strict=True)]
    model = quality.train(rows, (3, 3), epochs=30)
    assert ((model.scores(texts) >= 0.5) == [bool(r[0]) for r in rows]).all()
    for text, (_, buckets, counts) in zip(texts, rows, strict=True):
        odds = sum(model.table[b] * c for b, c in zip(buckets, counts, strict=True)) / counts.sum() + model.bias
        assert model.scores([text])[0] == pytest.approx(1 / (1 + math.exp(-odds)), abs=1e-12)
    assert model.scores(texts).tolist() == quality.train(rows, (3, 3), epochs=30).scores(texts).tolist()


def test_quality_on_held_out_labels(spark):
    got = {r.doc_id: r for r in queries.QUERIES["op12_quality"](spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").count()
    assert len(got) == docs and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items())
    labels = [(r.doc_id, r.quality) for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if got[r.doc_id].held_out]
    assert sum(got[i].predicted == q for i, q in labels) / len(labels) > 0.95
    bad, fine = [got[i].score for i, q in labels if q == 0], [got[i].score for i, q in labels if q == 1]
    assert sum(a < b for a in bad for b in fine) / (len(bad) * len(fine)) > 0.97


def test_quality_edges(spark):
    docs = [(i, ("LOUD!! NOISE!! " if i % 2 else "quiet plain words ") * (1 + i % 5), 1, "q") for i in range(60)]
    docs += [(None, "plain words", 1, "q"), (60, None, 1, "q"), (61, "", 1, "q"), (62, "w " * 200_000, 1, "q"), (0, docs[0][1], 1, "q")]
    labels = [(i, 1 - i % 2, 7.0) for i in range(60)] + [(None, 1, 7.0), (3, None, 7.0), (5, 9, 7.0), (999, 0, 7.0), (0, 1, 7.0)]
    df = spark.createDataFrame(docs, "doc_id long, text string, quality int, score string")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, score double")
    got = quality.score_quality(df, lab).collect()
    assert len(got) == len(docs) and all(0 <= r.score <= 1 for r in got)
    assert all(r.predicted == 1 - r.doc_id % 2 for r in got if r.doc_id is not None and r.doc_id < 60)
    assert not next(r for r in got if r.doc_id is None).held_out
    scores = {r.doc_id: r.score for r in got}
    assert scores[60] == scores[61]  # no features: the prior
    assert quality.score_quality(df.limit(0), lab).count() == 0
    assert {r.score for r in quality.score_quality(df, lab.limit(0)).collect()} == {0.5}
    ones = quality.score_quality(df, lab.filter("quality = 1")).collect()
    assert len({r.score for r in ones}) == 1 and ones[0].score > 0.5


def test_labels_of_held_out_rows_change_nothing(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(300)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    swapped = labels.selectExpr("doc_id", "if(crc32(cast(cast(doc_id AS string) AS binary)) % 3 = 1, 1 - quality, quality) AS quality")
    a, b = (sorted((r.doc_id, r.score) for r in quality.score_quality(docs, x).collect()) for x in (labels, swapped))
    assert a == b


# --- lexical search --------------------------------------------------------------

def brute_search(docs, items, k=10):
    """Scores of all documents by the stated formula."""
    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    own = [(i, Counter(words(t))) for i, t in docs]
    n_docs, total = sum(1 for _, c in own if c), sum(sum(c.values()) for _, c in own)
    df = Counter(w for _, c in own for w in c)
    out = {}
    for key, text in set(items):
        scored = []
        for place, (i, c) in enumerate(own):
            n = sum(c.values())
            if n:
                m = 100 - 75 + (75 * n * n_docs) // total
                s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((1000000000 * c[w]) // (1000 * c[w] + 8 * m))
                        for w in words(text) if c[w])
                if s > 0:
                    scored.append((-s, i is None, i or 0, place, i))
        out[key, text] = [(r + 1, x[4], -x[0]) for r, x in enumerate(sorted(scored)[:k])]
    return out


def test_terms():
    text = "Ab-c_9 ÉCOLE\x00École漢 x\x7fy `z`"
    assert [t.decode() for t in lexical.terms(text.encode())] == ["ab", "c", "9", "École", "École漢", "x", "y", "z"]
    assert lexical.terms(None) == [] and lexical.terms(b" .,!") == []


@pytest.mark.parametrize("window,long_share", [(7, 2), (64, 8), (1 << 20, 1), (16, 10 ** 9)])
def test_shard_search_against_all_sums(window, long_share):
    rng = np.random.default_rng(window)
    rows, vocabulary = 500, 60
    lengths = rng.integers(20, 300, rows)
    lists = [np.flatnonzero(rng.random(rows) < p) for p in rng.beta(0.4, 1.5, vocabulary)]
    present = np.array([t for t, x in enumerate(lists) if len(x)])
    docs = np.concatenate([lists[t] for t in present]).astype(np.int32)
    tfs = rng.integers(1, 9, len(docs)).astype(np.int32)
    shard = lexical.Shard(lengths, present, np.array([len(lists[t]) for t in present]), docs, tfs, 5000, 800_000, window, long_share)
    m = lexical.length_terms(lengths, 5000, 800_000)
    for _ in range(40):
        query = [(int(t), int(rng.integers(0, 9000))) for t in rng.choice(vocabulary, rng.integers(1, 30), replace=False)]
        score = np.zeros(rows, dtype=np.int64)
        for t, w in query:
            if t in shard.span:
                a, b = shard.span[t]
                score[docs[a:b]] += w * (10 ** 9 * tfs[a:b].astype(np.int64) // (1000 * tfs[a:b].astype(np.int64) + 8 * m[docs[a:b]]))
        want = [(int(i), int(score[i])) for i in np.lexsort((np.arange(rows), -score))[:10] if score[i] > 0]
        assert shard.top(query) == want


def test_search_against_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = defaultdict(list)
    for r in queries.QUERIES["op13_lexical_search"](spark, SF).collect():
        got[r.item_id].append((r["rank"], r.doc_id, r.score))
    want = brute_search(docs, items)
    assert {k: sorted(v) for k, v in got.items()} == {k: v for (k, _), v in want.items() if v}


def test_search_edges_shards_and_passes(spark):
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(30)]
    docs = [(i, " ".join(rng.choices(vocabulary, weights=range(1, 31), k=rng.randint(1, 40)))) for i in range(300)]
    docs += [(i, docs[5][1]) for i in range(300, 420)] + [(7, docs[7][1]), (None, docs[5][1]), (500, None), (501, ""), (502, " ,;"),
                                                          (503, "W3 w4\tw3 " * 20_000)]
    items = [(i, " ".join(rng.choices(vocabulary, k=12))) for i in range(8)]
    items += [(0, items[0][1]), (90, None), (91, "..."), (92, "unknown"), (93, docs[5][1]), (None, "w1 w1 w2")]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("doc_id", "text", "'x' AS score", "1 AS rank", "2 AS raw").repartition(5)
    ask = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "'y' AS doc_id")
    want = {k: v for (k, _), v in brute_search(docs, [x for x in items if x[1]]).items() if v}
    for params in ({}, {"pass_bytes": 100, "shard_hits": 200}):
        got = defaultdict(list)
        for r in lexical.search(df, ask, **params).collect():
            got[r.item_id].append((r["rank"], r.doc_id, r.score))
        assert {k: sorted(v) for k, v in got.items()} == want
    assert lexical.search(df.limit(0), ask).count() == 0 and lexical.search(df, ask.limit(0)).count() == 0


def test_length_terms_beyond_64_bits():
    lengths = np.array([1, 10 ** 9, 3 * 10 ** 10])
    assert lexical.length_terms(lengths, 10 ** 10, 10 ** 13).tolist() == [25 + 75 * int(n) * 10 ** 10 // 10 ** 13 for n in lengths]
