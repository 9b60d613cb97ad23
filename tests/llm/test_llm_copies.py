"""Near duplicates, repeated passages, decontamination, and the pipeline, against brute force."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from murmur.llm import decontaminate, minhash, passages, queries
from murmur.llm.common import Words, ship, shingles

SF = "/root/testdata/sf0.01"


@pytest.fixture(autouse=True)
def _shipped(spark):
    ship(spark)


def words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def kmers(text):
    w, seen, out = words(text), Counter(), []
    for i in range(max(1, len(w) - 4) if w else 0):
        g = tuple(w[i:i + 5])
        out.append((g, seen[g]))
        seen[g] += 1
    return out


def aligned(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    n = table[-1][-1]
    return n / (len(a) + len(b) - n)


def classes(docs):
    """Least id of each document's class by exhaustive comparison."""
    parent = {i: i for i, _ in docs}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i
    k = {i: kmers(t) for i, t in docs}
    s = {i: set(v) for i, v in k.items()}
    text = dict(docs)
    ids = [i for i, _ in docs if text[i] is not None]
    for x, a in enumerate(ids):
        for b in ids[x + 1:]:
            if not s[a] or not s[b]:
                same = not s[a] and not s[b] and text[a] == text[b]
            else:
                both = len(s[a] & s[b])
                same = both >= 0.8 * (len(s[a]) + len(s[b]) - both) and aligned(k[a], k[b]) >= 0.8
            if same:
                parent[max(root(a), root(b))] = min(root(a), root(b))
    return {i: root(i) for i, _ in docs}


def near_copies(seed, n_bases=12, copies=14):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    docs, i = [], 0
    for _ in range(n_bases):
        base = [rnd.choice(vocabulary) for _ in range(rnd.randrange(6, 160))]
        for c in range(copies):
            own = list(base)
            for _ in range(rnd.randrange(0, 1 + len(base) // 40) if c else 0):
                at = rnd.randrange(len(own))
                own[at:at + rnd.randrange(2)] = [rnd.choice(vocabulary)]
            docs.append((i, " ".join(own)))
            i += 1
    return docs


def test_order_sketches_and_alignment():
    a = " ".join(f"a{i}" for i in range(60))
    b = " ".join(a.split()[30:] + a.split()[:30])  # the same words, halves swapped
    k, offsets = minhash.labelled_kmers(Words([a, a + " tail", b, "", "x", "one two"]))
    sketch = minhash.order_sketches(k, offsets)
    assert sketch.shape == (5, minhash.SKETCHES)
    assert (sketch[0] == sketch[1]).mean() > 0.5 and (sketch[0] == sketch[2]).mean() < 0.5
    part = [k[offsets[i]:offsets[i + 1]] for i in range(6)]
    assert minhash.aligned_similarity(part[0], part[0]) == 1
    assert minhash.aligned_similarity(part[0], part[1]) == 56 / 57
    assert minhash.aligned_similarity(part[0], part[2]) < 0.8 and minhash.aligned_similarity(part[0], part[3]) == 0
    same, off = minhash.labelled_kmers(Words(["a a a a a a a"]))
    assert len(set(same.tolist())) == 3 == off[1]


def test_near_duplicates_against_brute_force(spark):
    docs = near_copies(1) + [(900, None), (901, None), (902, ""), (903, ""), (904, "!!"), (905, "x"), (906, "X"), (907, "one two three"),
                            (908, "one two three four"), (909, "long word " * 30_000), (910, "long word " * 30_000 + "end")]
    df = spark.createDataFrame(docs + docs[:3], "doc_id long, text string").withColumn("node", F.lit("clash"))
    got = minhash.near_duplicates(df).collect()
    assert len(got) == len(docs) + 3
    small = classes([d for d in docs if d[0] < 909])
    assert {r.doc_id: r.class_id for r in got if r.doc_id < 909} == small
    assert {r.class_id for r in got if r.doc_id >= 909} == {909}
    kept = minhash.one_of_each(df)
    assert kept.columns == df.columns
    want = sorted(i for i, c in classes([d for d in docs if d[0] < 909]).items() if i == c) + [909]
    assert sorted(r.doc_id for r in kept.collect()) == want
    assert minhash.near_duplicates(df.limit(0)).count() == 0 and minhash.one_of_each(df.limit(0)).count() == 0


def test_near_duplicate_rounds_lose_no_link(spark, monkeypatch):
    """With one sketch of one k-mer all documents fall into few buckets, so the rounds must find every link."""
    rnd = random.Random(4)
    shared = "q0 q1 q2 q3 q4"
    docs = [(i, " ".join([t, shared])) for i, (_, t) in enumerate(near_copies(2, 10, 4))]
    rnd.shuffle(docs)
    original = minhash.order_sketches
    monkeypatch.setattr(minhash, "order_sketches", lambda k, o: np.zeros((int((np.diff(o) > 0).sum()), 1), dtype=np.uint64))
    rows, found, _ = _linked_locally(spark, docs)
    assert original is not minhash.order_sketches
    by_node = {r.node: r.label for r in found.collect()}
    groups = defaultdict(set)
    for r in rows.collect():
        groups[by_node[r.node]].add(r.doc_id)
    want = defaultdict(set)
    for i, c in classes(docs).items():
        want[c].add(i)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def _linked_locally(spark, docs):
    """linked_classes with the sketches made on the driver (so that a patched sketch takes effect)."""
    import pandas as pd
    from pyspark.sql import functions as f

    df = spark.createDataFrame(docs, "doc_id long, text string")

    def sketched(frame, key_col, text_col):
        pdf = frame.withColumn("raw", f.xxhash64("text")).toPandas()
        w = Words(pdf.text.tolist())
        k, o = minhash.labelled_kmers(w)
        sk = minhash.signed(minhash.order_sketches(k, o))
        out = pd.DataFrame({"doc_id": pdf.doc_id, "raw": pdf.raw, "node": minhash.signed(minhash.text_keys(w)), "sketch": [x.tolist() for x in sk]})
        return spark.createDataFrame(out, minhash._SKETCHED)
    before = minhash.sketched
    minhash.sketched = sketched
    try:
        return minhash.linked_classes(df)
    finally:
        minhash.sketched = before


def test_components_of_long_paths(spark):
    edges = [(i, i + 1) for i in range(0, 300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(2001, 2000)]
    got = dict(minhash.components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert {got[i] for i in range(301)} == {0} and {got[1000 + i] for i in range(200)} == {1000} and got[2001] == 2000


def plain_windows(values, least):
    out = []

    def split(lo, hi):
        if hi - lo + 1 < least:
            return
        c = min(range(lo, hi + 1), key=lambda i: values[i])
        out.append((lo, c, hi))
        split(lo, c - 1)
        split(c + 1, hi)
    split(0, len(values) - 1)
    return sorted(out)


def test_compact_windows_are_the_cartesian_tree():
    texts = [" ".join(f"t{random.Random(s).randrange(10 ** 6)}x{i}" for i in range(n)) for s, n in enumerate((3, 12, 40, 150, 0, 9))]
    grams, offsets = shingles(Words(texts))
    f, text, left, centre, right = passages.compact_windows(grams, offsets, hashes=2, least=8)
    a, b = passages.seeds(2, 41), passages.seeds(2, 59)
    for h in range(2):
        for t in range(len(texts)):
            own = f == h
            mine = sorted(zip(left[own & (text == t)].tolist(), centre[own & (text == t)].tolist(), right[own & (text == t)].tolist()))
            part = grams[offsets[t]:offsets[t + 1]]
            assert mine == plain_windows(((part ^ a[h]) * b[h]).tolist(), 8)
    x = passages.pack(left, centre, right)
    assert all((u == v).all() for u, v in zip(passages.unpack(x), (left, centre, right)))


def planted(seed=7):
    rnd = random.Random(seed)
    fresh = lambda n: [f"v{rnd.randrange(10 ** 9)}" for _ in range(n)]
    shared = [fresh(n) for n in (51, 60, 90, 200)]
    docs, want = [], defaultdict(set)
    for i in range(120):
        own = fresh(rnd.randrange(0, 150))
        if i % 3 == 0:
            p = rnd.randrange(4)
            passage = list(shared[p])
            if i % 2 and len(passage) >= 90:
                passage[45] = "changed"
            at = rnd.randrange(len(own) + 1)
            own[at:at] = passage
            want[p].add(i)
        docs.append((i, " ".join(own)))
    docs += [(500, " ".join(fresh(60)))]
    docs += [(501, docs[-1][1].upper()), (502, "short copy"), (503, "short copy"), (504, None), (505, ""), (506, " ".join(shared[0][:45] + fresh(100)))]
    return docs, want


def test_repeated_passages(spark):
    docs, want = planted()
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("spans", F.lit("clash"))
    got = {r.doc_id: r for r in passages.repeated(df).collect()}
    expected = {i for ids in want.values() if len(ids) > 1 for i in ids} | {500, 501}
    assert set(got) == expected
    for ids in want.values():
        assert len({got[i].class_id for i in ids if i in got}) <= 1
    text = dict(docs)
    for i, r in got.items():
        w = words(text[i])
        for s in r.spans:
            assert 0 <= s.first_word < s.end_word <= len(w) and s.end_word - s.first_word >= 50
        assert r["words"] == sum(s.end_word - s.first_word for s in r.spans)
    assert [(s.first_word, s.end_word) for s in got[500].spans] == [(0, 60)]
    assert passages.repeated(df.limit(0)).count() == 0


def test_hot_passage_keeps_every_document(spark):
    rnd = random.Random(9)
    hot = " ".join(f"h{i}" for i in range(55))
    docs = [(i, " ".join(f"u{rnd.randrange(10 ** 9)}" for _ in range(rnd.randrange(80))) + " " + hot + " " + str(rnd.random())) for i in range(400)]
    got = passages.repeated(spark.createDataFrame(docs, "doc_id long, text string").repartition(16)).collect()
    assert len(got) == 400 and {r.class_id for r in got} == {0}


def test_rare_passage_with_a_frequent_sentence(spark):
    rnd = random.Random(4)
    fresh = lambda n: [f"w{rnd.randrange(10 ** 9)}" for _ in range(n)]
    docs, rare = [], []
    for _ in range(3):
        sentence = fresh(45)
        passage = fresh(3) + sentence + fresh(3)
        docs += [fresh(30) + sentence + fresh(30) for _ in range(100)]
        for _ in range(2):
            rare.append(len(docs))
            docs.append(fresh(30) + passage + fresh(30))
        docs += [fresh(30) + sentence + fresh(30) for _ in range(100)]
    df = spark.createDataFrame([(i, " ".join(d)) for i, d in enumerate(docs)], "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in passages.repeated(df).collect()}
    assert sorted(got) == rare
    for x, y in zip(rare[0::2], rare[1::2]):
        assert got[x].class_id == got[y].class_id == x and got[x].spans == got[y].spans == [(30, 81)]


def test_only_texts_that_share_a_run_are_split_into_windows(spark, monkeypatch):
    docs, want = planted()
    df = spark.createDataFrame(docs, "doc_id long, text string")
    split, whole = [], passages.window_rows
    monkeypatch.setattr(passages, "window_rows", lambda texts: split.append(texts.select("node").distinct().count()) or whole(texts))
    once = sorted(map(str, passages.repeated(df).collect()))
    assert all(len(ids) > 1 for ids in want.values())
    assert split == [sum(map(len, want.values())) + 1]  # and the one with 45 words of a passage
    monkeypatch.setattr(passages, "MARKS", 64)  # all texts are marked
    assert sorted(map(str, passages.repeated(df).collect())) == once and split[0] == split[1]


def test_verified_passages_share_a_run_of_22_words():
    rnd, found = random.Random(12), 0
    for _ in range(300):
        a = [rnd.randrange(10 ** 6) for _ in range(rnd.randrange(50, 300))]
        b = list(a)
        for _ in range(rnd.randrange(1, 7)):
            at, n = rnd.randrange(len(b)), rnd.randrange(0, 3)
            b[at:at + rnd.randrange(0, 3)] = [rnd.randrange(10 ** 6) for _ in range(n)]
        x, y = (shingles(Words([" ".join(f"w{i}" for i in t)]))[0] for t in (a, b))
        places = {g: i for i, g in enumerate(y.tolist())}
        diagonals = np.array([places[g] - i for i, g in enumerate(x.tolist()) if g in places] or [0])
        runs = {tuple(b[i:i + 22]) for i in range(len(b) - 21)}
        for s, e, *_ in passages.repeated_passages(x, y, diagonals):
            found += 1
            assert any(tuple(a[i:i + 22]) in runs for i in range(s, e + 4 - 21))
    assert found > 100


def test_runs_of_18_shingles_are_seen_in_sparse_ones():
    rng = np.random.default_rng(5)
    for _ in range(400):
        x, y = (rng.integers(0, 1 << 16, rng.integers(18, 120)).astype(np.uint16) for _ in range(2))
        i, j = rng.integers(0, len(x) - 17), rng.integers(0, len(y) - 17)
        assert not passages.shares_run(x[::passages.SPARSE], y, np.array([j - i]))
        y[j:j + 18] = x[i:i + 18]
        assert passages.shares_run(x[::passages.SPARSE], y, np.array([j - i + 1, j - i]))


def test_joined_windows_against_all_pairs(monkeypatch):
    rng = np.random.default_rng(3)
    owner, f = np.sort(rng.integers(0, 6, 300)), rng.integers(0, 3, 300)
    sides = []
    for _ in range(2):
        centre = rng.integers(30, 400, 300)
        sides.append((centre - rng.integers(0, 30, 300), centre, centre + rng.integers(0, 60, 300)))

    def meet(i, j):
        if owner[i] != owner[j] or f[i] == f[j]:
            return False
        for left, centre, right in sides:
            lo, hi = max(left[i], left[j]), min(right[i], right[j])
            if not (lo <= min(centre[i], centre[j]) and max(centre[i], centre[j]) <= hi and hi - lo + 1 >= 20):
                return False
        return True

    want = [any(meet(i, j) for j in range(300)) for i in range(300)]
    assert 0 < sum(want) < 300
    order = rng.permutation(300)
    a, b = (passages.pack(*side)[order] for side in sides)
    for near, compared in ((32, 1 << 16), (0, 7), (2, 100)):
        monkeypatch.setattr(passages, "NEAR", near)
        monkeypatch.setattr(passages, "COMPARED", compared)
        assert passages.joined_windows(f[order], a, b, owner[order], 20).tolist() == [want[i] for i in order]


def contained(docs, items):
    out = set()
    for d, t in docs:
        have = set(tuple(w) for w in zip(*[words(t)[k:] for k in range(5)]))
        for i, x in items:
            w = words(x)
            own = [tuple(w[k:k + 5]) for k in range(len(w) - 4)]
            if own and sum(g in have for g in own) >= 0.8 * len(own):
                out.add((d, i))
    return out


def test_decontamination_against_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = queries.QUERIES["op4_contamination"](spark, SF).collect()
    assert {(r.doc_id, r.item_id) for r in got} == contained(docs, items) and len(got) == len({(r.doc_id, r.item_id) for r in got}) > 10


def test_decontamination_edges(spark, monkeypatch):
    rnd = random.Random(2)
    item = " ".join(f"q{i}" for i in range(30))
    long = " ".join(f"z{i}" for i in range(500))
    bench = spark.createDataFrame([(1, item + "? yes it is so"), (2, None), (3, ""), (4, "tiny item"), (5, long), (6, item + "? yes it is so"), (7, "?!")],
                                  "item_id long, text string")
    filler = lambda n: " ".join(f"f{rnd.randrange(999)}" for _ in range(n))
    docs = [(1, filler(70) + " " + item + " yes it is so " + filler(300)), (2, None), (3, ""), (4, "a tiny item here"), (5, "tiny other item"),
            (6, filler(9000) + " " + long), (7, item), (8, filler(50)), (9, item.replace("q15 ", "other ") + " yes it is so"), (1, item + " yes it is so")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("score", F.lit("clash"))
    want = sorted([(1, 1), (1, 6), (1, 1), (1, 6), (4, 4), (6, 5), (9, 1), (9, 6)])
    assert sorted((r.doc_id, r.item_id) for r in decontaminate.contaminated(df, bench).collect()) == want
    monkeypatch.setattr(decontaminate, "PASS_ITEMS", 2)  # several passes give the same
    assert sorted((r.doc_id, r.item_id) for r in decontaminate.contaminated(df, bench).collect()) == want
    clean = decontaminate.clean_documents(df, bench)
    assert clean.columns == df.columns and sorted(r.doc_id for r in clean.collect()) == [2, 3, 5, 7, 8]
    assert decontaminate.contaminated(df, bench.limit(0)).count() == 0 and decontaminate.clean_documents(df, bench.limit(0)).count() == len(docs)
    assert decontaminate.contaminated(df.limit(0), bench).count() == 0


def test_wand_equals_exhaustive_scores():
    rnd = random.Random(8)
    vocabulary = [f"w{i}" for i in range(120)]
    items = [(i, " ".join(rnd.choice(vocabulary) for _ in range(rnd.randrange(5, 30)))) for i in range(50)]
    frequency = Counter(h for _, t in items for h in set(Words([t]).hashes.tolist()))
    index = decontaminate.Index(items, frequency, len(items), sum(len(t.split()) for _, t in items) / len(items))
    (group,) = index.classes
    group.threshold *= 0.5
    group.block_low *= 0.5
    for _ in range(60):
        query = group.ids(Words([" ".join(rnd.choice(vocabulary) for _ in range(40))]).hashes)
        scores = np.zeros(len(items))
        for t in np.unique(query[query >= 0]):
            np.add.at(scores, group.postings[t][0], group.postings[t][1])
        got = dict(group.wand(query))
        assert set(got) == set(np.flatnonzero(scores >= group.threshold).tolist())
        assert all(abs(got[i] - scores[i]) < 1e-9 for i in got)


def test_pipeline(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    extra = docs.limit(300).withColumn("node", F.lit(1)).withColumn("hash", F.lit(None).cast("string"))
    more = spark.createDataFrame([(10_000, None, "en", "src1", 0, 1, None), (10_001, "", None, None, 0, 1, None), (10_002, "123 !!", "en", None, 6, 1, None)],
                                 extra.schema)
    extra.unionByName(more).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    frame = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, frame, str(tmp_path))
        assert (out.columns == extra.columns) or name == "sharding"
        out.write.parquet(str(tmp_path / f"s{k}"))
        frame = spark.read.parquet(str(tmp_path / f"s{k}"))
        seen[name] = frame.collect()
    first = {r.doc_id for r in seen["language"]}
    assert first == {r.doc_id for r in extra.collect()}
    want = classes([(r.doc_id, r.text) for r in seen["language"] if len(r.text) < 4000])
    kept = {r.doc_id for r in seen["near_duplicates"]}
    assert all((i in kept) == (i == c) for i, c in want.items())
    dirty = {d for d, _ in contained([(r.doc_id, r.text) for r in seen["near_duplicates"]], bench)}
    assert {r.doc_id for r in seen["decontamination"]} == kept - dirty
    assert max(Counter(r.doc_id for r in seen["mixing"]).values()) <= 2
    assert Counter(r.doc_id for r in seen["sharding"]) == Counter(r.doc_id for r in seen["mixing"])
    assert all(0 <= r["shard"] < 8 for r in seen["sharding"])
    empty = corpus_pipeline.STAGES
    frame = extra.limit(0)
    for _, stage in empty:
        frame = stage(spark, frame, str(tmp_path))
    assert frame.count() == 0
