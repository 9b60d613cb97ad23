"""HTML extraction, WARC records, language identification."""

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from murmur.llm import html_text, langid, queries, warc
from murmur.llm.common import Words, scratch_path, ship, shingles

SF = "/root/testdata/sf0.01"


@pytest.fixture(autouse=True)
def _shipped(spark):
    ship(spark)


def test_words_and_shingles():
    w = Words(["Hello, WÖRLD! 12a", None, "", "x", " one  two three four five six"])
    assert w.counts().tolist() == [3, 0, 0, 1, 6]
    assert list(zip(w.begin.tolist(), w.end.tolist()))[:3] == [(0, 5), (7, 12), (14, 17)]
    assert Words(["hello"]).hashes[0] == w.hashes[0] and Words(["wörld"]).hashes[0] == w.hashes[1]
    grams, offsets = shingles(w)
    assert np.diff(offsets).tolist() == [1, 0, 0, 1, 2]
    assert shingles(Words(["two THREE four, five six"]))[0][0] == grams[offsets[4] + 1]


@pytest.mark.parametrize("page, text", [
    (None, ""), ("", ""), ("no markup  at\nall", "no markup at all"),
    ("<body><nav><a>x</a></nav><article><h1>T &amp; U</h1><p>a<b>b</b>\n c<br>d<p>e</article><footer>f</footer>", "T & U\nab c d\ne"),
    ("<article><p>one</p><div class='ad'>buy</div><p>two</p><script>var t='</p>';</script><p>three</article>", "one\ntwo\nthree"),
    ("<article><p>one</p><!-- <p>no</p> --><form><p>mail</p></form><aside>s</aside></article><section id=comments><article>c</article></section>", "one"),
    ("<main><header>h</header><p>text</p><div hidden>x</div><p class=cookie-notice>c</p><ul><li>i<li>j</ul></main>", "text\ni\nj"),
    ("<article><p>&lt;b&gt; &#233;&nbsp;x &amp;amp;</p></article>", "<b> é x &amp;"),
    ("<article><p>cut off <b>here", "cut off here"),
    ("<div class=menu><a>Home</a></div><div><p>" + "long text " * 20 + "</p><p>ok</p></div>", ("long text " * 20).strip() + "\nok"),
    ("<article><style>p{}</style><p>a</p></article><article class='related'><p>b</p></article>", "a"),
])
def test_main_text(page, text):
    assert html_text.main_text(page) == text


def test_main_text_is_linear_in_long_pages():
    body = "".join(f"<p>paragraph {i}</p>" for i in range(50_000))
    assert html_text.main_text(f"<article>{body}</article>").count("\n") == 49_999
    assert html_text.main_text("<" * 200_000) == "<" * 200_000
    assert html_text.main_text("<div>" * 20_000 + "deep") == "deep"


@pytest.mark.parametrize("page", [
    "<a " * 200_000, "<span>" * 50_000 + "</p>" * 50_000, "<span>" * 50_000 + "<div></div>" * 50_000, "<![CDATA[" * 100_000,
    "<b><div>" + "<span>" * 50_000 + "</b>" * 50_000, '<a "' * 100_000 + ">", "<b>" * 30_000 + "<li>" * 30_000, "<!--" * 100_000,
    "<script><" * 50_000, "<p>" * 100_000, "<td " * 100_000 + ">"])
def test_time_is_linear(page):
    """Each of these took minutes when open tags or elements were searched again from every tag."""
    import time
    t = time.process_time()
    html_text.main_text(page)
    assert time.process_time() - t < 10


WORDS = "some words of text " * 8


@pytest.mark.parametrize("tag,stays", [
    ('section id="discussion"', True), ('section class="search-results"', True), ('p class="alert-level"', True),
    ('div class="social-history"', True), ('div class="comment-list"', False), ('div class="advert box"', False),
    ('aside', False), ('div role="complementary"', False)])
def test_names_inside_an_article(tag, stays):
    page = f"<article><p>{WORDS}</p><{tag}>inner {WORDS}</{tag.split()[0]}><p>short end</p></article>"
    got = html_text.main_text(page).split("\n")
    assert got[0] == WORDS.strip() and got[-1] == "short end" and len(got) == 2 + stays


def test_vague_names_are_judged_by_the_distribution():
    links = "".join(f"<p><a href=x>{WORDS}</a></p>" for _ in range(3))
    for inner in ("<p>Share</p><p>Print</p>", links):
        assert html_text.main_text(f'<article><p>{WORDS}</p><div class="social-media">{inner}</div></article>') == WORDS.strip()


def test_the_distribution_chooses_the_container():
    menu = "<ul>" + "<li><a href=x>somewhere else</a></li>" * 20 + "</ul>"
    page = f"<article>teaser</article>{menu}<div><p>{WORDS}</p><p>{WORDS}</p></div>"
    assert html_text.main_text(page) == "\n".join([WORDS.strip()] * 2)
    page = f"<div>Home</div>{menu}<main><p>{WORDS}</p><div class=ad>buy</div><p>end</p></main>{menu}<p>imprint</p>"
    assert html_text.main_text(page) == f"{WORDS.strip()}\nend"
    assert html_text.main_text("<main><p>tiny</p></main>") == "tiny"
    assert html_text.main_text("<script>'<a \"'</script><p>after</p>") == "after"
    assert html_text.main_text("a > b < c <!-- open") == "a > b < c"


def test_extraction_over_a_table(spark):
    rows = [(1, "u", None, "n"), (2, None, "<article>a</article>", None), (2, None, "<article>a</article>", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    out = html_text.extract_main_text(df).collect()
    assert sorted((r.page_id, r.text, r.n_chars) for r in out) == [(1, "", 0), (2, "a", 1), (2, "a", 1)]
    assert html_text.extract_main_text(df.limit(0)).count() == 0
    whole = queries.QUERIES["op1_html_text"](spark, SF)
    pages = spark.read.parquet(f"{SF}/pages.parquet").toPandas().set_index("page_id")
    got = whole.toPandas()
    assert len(got) == len(pages)
    for r in got.itertuples():
        assert r.text == html_text.main_text(pages.html[r.page_id]) and r.n_chars == len(r.text)


@pytest.mark.parametrize("size", [1, 7, 64 * 1024])
def test_chunks_hold_no_mark(size):
    for payload in (b"", b"abc\r\n", b"WARC/1.1\r\n" * 3 + b"x", "é".encode() * 50_001, b"WARC/1.1" * 5, b"\xff" * 9):
        pieces = list(warc.chunks(payload, size))
        assert b"".join(pieces) == payload and pieces and all(len(p) <= max(size, 4) for p in pieces)
        assert not any(warc.MARK in p for p in pieces)


def test_warc_round_trip(spark):
    long = "é" * 100_001 + "WARC/1.1\r\nWARC/1.1\r\n"
    rows = [(1, "u", None), (2, "u", ""), (3, "u", "abc\r\n"), (4, "u", "x" * 2000), (5, "u\r\nx", "x" * 2000), (6, None, long),
            (7, "u", "WARC/1.1\r\n\r\nWARC-Type: response\r\n\r\n"), (None, "u", "é\r\n\r\nWARC/1.1\r\n"), (8, "u", long),
            (9, "u", "y" * 70_000 + "\r\n\r\n"), (9, "u", "y" * 70_000 + "\r\n\r\n"), (10, "u", "x" * 999), (11, "u", "x" * 999)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    out = warc.round_trip(spark, df, scratch_path(spark, "w")).collect()
    want = [(i, len((h or "").encode()), hashlib.sha1((h or "").encode()).hexdigest()) for i, _, h in rows]
    assert sorted(map(str, want)) == sorted(str((r.record_id, r.payload_bytes, r.payload_digest)) for r in out)
    kind = {(r.record_id, r.record_type, r.refers_to) for r in out}
    assert {(4, "revisit", 5), (5, "response", None), (6, "revisit", 8), (8, "response", None), (10, "response", None),
            (11, "response", None), (9, "response", None)} <= kind
    assert warc.round_trip(spark, df.limit(0), scratch_path(spark, "w")).count() == 0


def test_damaged_archive_fails(spark):
    path = scratch_path(spark, "w")
    df = spark.createDataFrame([(1, "u", "<p>payload</p>")], "page_id long, url string, html string")
    warc.write_archives(warc.record_chunks(warc.with_revisits(df, "page_id", "html", "url")), path)
    raw = "".join(r.value + "\r\n\r\n" for r in spark.read.option("lineSep", "\r\n\r\n").text(path).collect())
    for bad in (raw.replace("payload</p>", "Payload</p>"), raw.replace("payload</p>", "pay</p>")):
        broken = scratch_path(spark, "w")
        spark.createDataFrame([(bad.removesuffix("\r\n\r\n"),)], "value string").write.option("lineSep", "\r\n\r\n").text(broken)
        with pytest.raises(Exception, match="differs|damaged"):
            warc.read_payloads(spark, broken).collect()


def test_warc_query_against_brute_force(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").toPandas()
    payload = {r.page_id: (r.html or "").encode() for r in pages.itertuples()}
    keeper = {}
    for i, p in payload.items():
        if len(p) >= 1000:
            keeper[p] = max(i, keeper.get(p, i))
    got = queries.QUERIES["op2_warc"](spark, SF).collect()
    assert len(got) == len(payload)
    for r in got:
        p = payload[r.page_id]
        k = keeper.get(p, r.page_id)
        assert (r.payload_bytes, r.payload_digest) == (len(p), hashlib.sha1(p).hexdigest())
        assert (r.record_type, r.refers_to) == (("response", None) if k == r.page_id else ("revisit", k))


def test_presence_kernel_against_sets():
    def grams(t):
        out, last = [], " "
        for c in t.lower():
            c = c if c.isalpha() else " "
            if c != " " or last != " ":
                out.append(c)
            last = c
        s = "".join(out)
        return {s[i:i + n] for n in langid.ORDERS for i in range(len(s) - n + 1)}
    texts = ["the cat sat", "The dog!! sat 12", "völlig anders", "x"]
    bits, has = langid.presence(texts)
    assert has.all()
    k = langid.kernel(bits, bits)
    for i, a in enumerate(texts):
        for j, b in enumerate(texts):
            x, y = grams(a + "\0"), grams(b + "\0")
            if x and y:
                assert abs(k[i, j] - len(x & y) / (len(x) * len(y)) ** 0.5) < 0.15


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = queries.QUERIES["op3_language"](spark, SF).toPandas().merge(docs.select("doc_id", "lang").toPandas(), on="doc_id")
    assert len(got) == docs.count()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in got.doc_id]).all()
    assert (got[got.held_out].lang == got[got.held_out].lang_pred).mean() > 0.97
    assert got.score.between(0, 1).all() and set(got.lang_pred) <= set(got.lang)


def test_language_edges(spark):
    rows = [(i, "the cat and the dog " * 3, "en", "p") for i in range(40)] + [(100 + i, "der hund und die katze " * 3, "de", "p") for i in range(40)]
    rows += [(200, None, "en", "p"), (201, "", None, "p"), (202, "12 34 !!", "de", "p"), (203, "der Hund und die Katze " * 20_000, None, "p"),
             (None, "the dog", None, "p")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    got = {r.doc_id: r for r in langid.identify(df).collect()}
    assert [got[i].lang_pred for i in (200, 201, 202, 203, None)] == ["und", "und", "und", "de", "en"]
    assert [got[i].score for i in (200, 201, 202)] == [0, 0, 0] and got[None].held_out is False
    kept = langid.known_language(df)
    assert kept.columns == df.columns and kept.count() == len(rows) - 3
    assert langid.identify(df.limit(0)).count() == 0
    none = langid.identify(df.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r.lang_pred for r in none} == {"und"}
