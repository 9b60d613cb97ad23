"""Sharding, mixing, personal data, nearest neighbours."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from murmur.llm import ann, mixing, pii, queries, sharding
from murmur.llm.common import ship

SF = "/root/testdata/sf0.01"
DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(autouse=True)
def _shipped(spark):
    ship(spark)


def rendezvous(key, weights):
    def cost(i, w):
        u = (int(hashlib.md5(f"{'' if key is None else key}/{i}".encode()).hexdigest()[:13], 16) + 0.5) / 16 ** 13
        return -math.log(u) / w
    return min((cost(i, w), i) for i, w in enumerate(weights) if w)[1]


def test_sharding_against_brute_force(spark):
    got = queries.QUERIES["op5_sharding"](spark, SF).collect()
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert len(got) == len(text)
    slots = defaultdict(list)
    for r in got:
        raw = (text[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32, r.law) == (len(raw) + 1, zlib.crc32(raw), "key")
        assert (r["shard"], r.grown_shard) == (rendezvous(r.doc_id, [1] * 8), rendezvous(r.doc_id, [1] * 9))
        assert r.grown_shard in (r["shard"], 8)
        slots[r["shard"]].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and len(slots) == 8


def test_sharding_edges(spark):
    rows = [(None, None, "x")] * 5 + [(7, "a", "x")] * 300 + [(7, "b", "y"), (8, "", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard string")
    got = sharding.shard_documents(df).collect()
    assert len(got) == len(rows) and len({r["shard"] for r in got if r.doc_id == 7}) == 1
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    weighted = sharding.assign_shards(spark.range(8000).withColumn("Shard", F.lit("q")), "id", [3.0, 0.0, 1.0]).groupBy("shard").count().collect()
    assert {r["shard"] for r in weighted} == {0, 2} and abs(dict(weighted)[0] / 8000 - 0.75) < 0.03
    assert sharding.shard_documents(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        sharding.shard_of(F.lit(1), [0.0])


def test_mixing_oracle(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = con.execute(queries.ORACLE_SQL["op9_mixing"]).df().sort_values("doc_id").reset_index(drop=True)
    got = queries.QUERIES["op9_mixing"](spark, SF).toPandas().sort_values("doc_id").reset_index(drop=True)
    assert (got[want.columns] == want).all().all()
    per = got.groupby("source").agg(size=("size", "sum"), target=("target", "max"), taken=("taken", "sum"))
    assert abs(per.target.sum() - 1.5 * got["size"].sum()) < 1e-6 and (per.target <= 2 * per["size"] + 1e-9).all()
    assert (got.taken <= 2 * got["size"]).all() and ((per.taken - per.target).abs() <= got["size"].max()).all()


def water_fill(sizes, weights, total, cap=2.0):
    target = {k: 0.0 for k in sizes}
    open_, left = set(sizes), total
    while open_:
        w = sum(weights[k] for k in open_)
        full = {k for k in open_ if left * weights[k] / w >= cap * sizes[k]}
        if not full:
            for k in open_:
                target[k] = left * weights[k] / w
            break
        for k in full:
            target[k] = cap * sizes[k]
        left -= sum(target[k] for k in full)
        open_ -= full
    return target


def test_mixing_edges(spark):
    rnd = random.Random(3)
    rows = [(i, "w " * rnd.randrange(30), "en", rnd.choice(["a", "b", "ä", None, "zz"]), 1) for i in range(600)]
    rows += [(900, None, "en", "nul", 1), (901, "", "en", None, 1), (902, "long " * 50_000, "en", "b", 1)] + [(903, "same same", "en", "a", 1)] * 200
    df = spark.createDataFrame(rows, DOC).withColumn("hash", F.lit("clash")).withColumn("boundary", F.lit("0"))
    got = mixing.mix_sources(df).collect()
    assert len(got) == len(rows)
    sizes = Counter()
    for _, t, _, s, _ in rows:
        sizes[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None]
    want = water_fill(sizes, {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}, 1.5 * sum(sizes.values()))
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 and r.taken <= 2 * r["size"]
    out = mixing.mixed_rows(df)
    assert out.columns == df.columns
    words = sum(len((r.text or "").split()) for r in out.collect())
    assert words == sum(r.taken for r in got)
    assert mixing.mix_sources(df.limit(0)).count() == 0 and mixing.mixed_rows(df.limit(0)).count() == 0
    assert sorted(map(str, mixing.mix_sources(df.repartition(7)).collect())) == sorted(map(str, got))


def test_mixing_without_broadcast(spark, monkeypatch):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    want = sorted(map(str, mixing.mix_sources(df).collect()))
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert sorted(map(str, mixing.mix_sources(df).collect())) == want


KINDS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def plain_spans(text):
    out = []
    for place, (kind, pattern) in enumerate(KINDS.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")),
                    "card": 14 <= len(digits) <= 19 and luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]:
                out.append((m.start(), place, kind, m.end()))
    return sorted(out)


def test_personal_data_against_brute_force(spark):
    rnd = random.Random(1)
    parts = ["a", "b@", ".", "1", "23", "4111 1111 1111 1111", "+", "-", " ", "(", ")", "é", "😀", "%", "_", "\n", "255", "c.d",
             "@x.y", "0", "4242424242424242", "+1 (212) 555-0100"]
    rows = [(i, "".join(rnd.choice(parts) for _ in range(rnd.randrange(40)))) for i in range(1500)]
    rows += [(5001, None), (5002, ""), (5003, "1 " * 20_000 + "a@b.c"), (5004, "a." * 20_000 + "@" + "b." * 20_000 + "c"),
             (5005, "+1 " + "( " * 20_000), (5006, "x 1.2.3.4 " * 3000), (None, "a@b.cd"), (7, "a@b.cd"), (7, "a@b.cd")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("spans", F.lit("clash"))
    got = pii.find_personal_data(df).collect()
    want = Counter()
    for i, t in rows:
        s = plain_spans(t)
        listed = ",".join(f"{k}:{a}:{b}" for a, _, k, b in s)
        want[(i, *(sum(x[2] == k for x in s) for k in KINDS), hashlib.sha256(listed.encode()).hexdigest())] += 1
    assert want == Counter((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in got)
    for r in got:
        kept = [x for x in r.spans.split(",") if x and not x.startswith("term:")]
        assert hashlib.sha256(",".join(kept).encode()).hexdigest() == r.base_sha256
    assert pii.find_personal_data(df.limit(0)).count() == 0


def test_disclosing_terms(spark):
    rows = [(i, f"Zebulon of kraxhaus writes from bob@x.org the day {i}", 1) for i in range(5)] + \
           [(10 + i, f"the day of work and writes nothing {i}", 2) for i in range(50)] + [(99, None, 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, rid int")
    got = {r.doc_id: r.spans for r in pii.find_personal_data(df).collect()}
    assert {"term:0:7", "term:11:19", "email:32:41"} <= set(got[0].split(",")) and got[10] == "" and got[99] == ""
    assert "term:8:10" not in got[0] and "term:20:26" not in got[0]  # "of" and "writes" are everywhere
    clean = {r.doc_id: r.text for r in pii.sanitise(df).collect()}
    assert "[EMAIL]" in clean[0] and "Zebulon" not in clean[0] and "kraxhaus" not in clean[0] and " writes " in clean[0]
    assert clean[10] == rows[5][1] and clean[99] is None and pii.sanitise(df).columns == df.columns
    general = {r.doc_id: r.text for r in pii.sanitise(df, remove=2.0).collect()}
    assert general[0].startswith("[NAME] of [WORD] ")


def test_disclosing_terms_anywhere_in_the_text(spark):
    far = "plain filler text " * 30
    rows = [(i, f"Zebulon {far}bob@x.org {far}Yours, Zebulon") for i in range(5)]
    # Beside the address in some of its texts only, but in all of them.
    rows += [(10 + i, f"Quillon {far if i % 2 else ''}ann@x.org {far}") for i in range(6)]
    # In two texts of an address, and in ten others.
    rows += [(20 + i, f"{'Marrow' if i < 2 else ''} {far}cat@x.org") for i in range(4)] + [(30 + i, f"Marrow {far}") for i in range(10)]
    rows += [(50 + i, far) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.spans.split(",") for r in pii.find_personal_data(df).collect()}
    clean = {r.doc_id: r.text for r in pii.sanitise(df).collect()}
    for i, text in rows:
        terms = [f"term:{m.start()}:{m.end()}" for m in re.finditer("Zebulon|Quillon|Yours", text)]
        assert [s for s in got[i] if s.startswith("term:")] == terms
        assert not re.search("Zebulon|Quillon|@", clean[i]) and ("Marrow" in clean[i]) == ("Marrow" in text)


def nearest_plain(rows, every, k):
    good = {i: np.asarray(v, float) for i, v in rows if v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    out = {}
    for q, x in good.items():
        if q % every == 0:
            near = sorted((math.sqrt(float(((v - x) ** 2).sum())), i) for i, v in good.items() if i != q and len(v) == len(x))
            out[q] = near[:k]
    return out


def test_nearest_edges(spark):
    rnd = np.random.default_rng(5)
    rows = [(i, [float(np.float32(x)) for x in rnd.normal(size=8)]) for i in range(1, 400)]
    hot = rows[0][1]
    rows += [(1000 + i, hot) for i in range(300)] + [(2000, None), (2100, []), (2200, [0.0] * 8), (2300, [float("nan")] * 8),
                                                   (2400, [1.0, None] + [0.0] * 6), (2500, [float("inf")] * 8), (2600, [1.0, 2.0]), (2700, [2.0, 2.0])]
    rows += [rows[5]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("shard", F.lit("clash"))
    got = defaultdict(list)
    for r in ann.nearest(df, shard_rows=128).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.score, r.vec_id))
    want = nearest_plain(dict(rows).items(), 100, 10)
    assert set(got) == {q for q in want if want[q]}
    hits = sum(len({i for _, i in got[q]} & {i for _, i in want[q]}) for q in got)
    assert hits / sum(map(len, want.values())) >= 0.9
    assert [i for _, i in got[1100]] == [1, *range(1000, 1009)] and got[2600] == [(1.0, 2700)]
    for q, near in got.items():
        assert near == sorted(near) and q not in [i for _, i in near]
    assert ann.nearest(df.limit(0)).count() == 0


def test_nearest_recall(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()]
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    got = ann.nearest(df, shard_rows=512).collect()
    want = nearest_plain(rows, 100, 10)
    vec = {i: np.asarray(v, float) for i, v in rows}
    assert len(got) == 10 * len(want)
    assert sum((r.score, r.vec_id) in want[r.query_id] or r.vec_id in {i for _, i in want[r.query_id]} for r in got) >= 0.9 * len(got)
    assert all(abs(r.score - math.sqrt(((vec[r.query_id] - vec[r.vec_id]) ** 2).sum())) < 1e-12 for r in got)
