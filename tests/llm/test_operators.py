"""Each operator against a brute-force version, an exact round trip or held-out accuracy, on the smallest tables and on fixtures."""

import collections
import gzip
import math
import os
import random
import re
import uuid
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corvane.llm import common as C
from corvane.llm import components, html, jaccard, maglev, mixing, neardup, quality, queries, toxicity, viterbi, warc, wavelet

DATA = "/root/testdata/sf0.001"
here = pytest.mark.skipif(not os.path.isdir(DATA), reason="driver tables are not here")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def documents(spark):
    return [tuple(r) for r in C.table(spark, DATA, "documents").select("doc_id", "text", "lang", "source").collect()]


# ---- 1


@pytest.mark.parametrize("n", [0, 1, 5, 70_000, 140_001])
def test_wavelet_lookups(n):
    rng = np.random.default_rng(n)
    ids = rng.zipf(1.3, n) % 49_000
    s = wavelet.Shard(wavelet.build(ids, np.array([n]), np.array([3]), np.array([True])))
    assert (s.decode() == ids).all() and s.count(48_999 if n == 0 else 49_407) == 0
    for i in rng.integers(0, n, 25 if n else 0).tolist():
        v = int(ids[i])
        before = int((ids[:i] == v).sum())
        assert (s.access(i), s.rank(v, i), s.select(v, before), s.count(v)) == (v, before, i, int((ids == v).sum()))
    for bad in (n, -1):
        with pytest.raises(IndexError):
            s.access(bad)
    with pytest.raises(IndexError):
        s.select(49_407, 0)


@here
def test_wavelet_holds_what_the_tokenizer_says(spark, documents):
    t = wavelet.ids_of(None).t
    start, want = 0, []
    for doc_id, text, *_ in sorted(documents):
        ids = [*t.encode(text, add_special_tokens=False).ids, 1]
        want.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, queries.op1_wavelet_matrix(spark, DATA).collect())) == want


def test_words_are_encoded_as_in_their_text():
    import pyarrow as pa

    odd = ["don't  x<|endoftext|>y\tΣΑΣ. İx 3rd's 'S THE. á b", "", "  \n ", None, "🙂🙂, éte. ok?! ÀÉ.,;", "a\x1cb c\x85d e　f", "ȺȾ ſt ﬁ"]
    e = wavelet.ids_of(None)
    ids, n = e.of(pa.array(odd, pa.string()), 1)
    want = [[*e.t.encode(x or "", add_special_tokens=False).ids, 1] for x in odd]
    assert ids.tolist() == [i for w in want for i in w] and n.tolist() == [len(w) for w in want]


# ---- 2

PAGE = """<html><head><title>T</title><style>p{}</style></head><body><header><a href=1>Home</a></header><nav><ul><li><a href=1>A</a><li><a href=2>B</a></ul></nav>
<div class="cookie-notice">We use cookies on this site, please agree to them.</div><article><h1>The   title &amp; more</h1><p>First <b>bold<i> words</b> here.<br>Next&nbsp;line &lt;x&gt; &#233;.</p>
<script>if (a < b) { document.write("<p>no</p>") }</script><div class="ad">Buy this now, it is cheap and good for you.</div><p>Second.</p><form><label>Mail</label><input></form><aside>Side words.</aside>
<ul><li>one item</li><li>two items</li></ul><section id="comments"><p>A reader says something long and friendly here.</p></section></article><div class="sidebar"><p>Related things to read on other pages.</p></div><footer>&copy; me</footer></body></html>"""


def test_main_text_of_a_page():
    assert html.main_text(PAGE)[0] == "The title & more\nFirst bold words here. Next line <x> é.\nSecond.\none item\ntwo items"


@pytest.mark.parametrize("name", ["layout has-sidebar", "no-sidebar", "overflow-hidden", "post-form", "share-enabled"])
def test_wrapper_names_do_not_lose_the_article(name):
    para = "word " * 40
    inner = f"<h1>The heading</h1><p>{para}</p><p>A short one.</p><div class='sidebar'><p>{para}</p></div>"
    for tag in ("article", "main"):
        page = f"<body><nav class='menu'><a href=1>A</a></nav><div class='{name}'><{tag}>{inner}</{tag}></div><footer>me</footer></body>"
        assert html.main_text(page)[0].split("\n") == ["The heading", para.strip(), "A short one."]
    assert para.strip() in html.main_text(f"<body><div class='{name}'><p>{para}</p><p>{para}</p></div></body>")[0]
    assert html.main_text(f"<body><div class='sidebar'><article><p>{para}</p></article></div><aside><main><p>{para}</p></main></aside></body>")[0] == ""


def test_page_without_article_element():
    para = "This paragraph has enough plain words to be taken for the text of a page, as anyone would agree on reading it. " * 2
    page = f"<div id=top><a href=1>Home</a> <a href=2>News</a></div><div><h2>A heading here</h2><p>{para}</p><p>{para}</p></div><div class=footer>Contact us by mail or phone at any time of the day.</div>"
    assert html.main_text(page)[0].split("\n")[1:] == [para.strip()] * 2


@here
def test_pages_give_their_articles(spark):
    for r in C.table(spark, DATA, "pages").collect():
        inner = r.html.split("<article>")[1].split("</article>")[0].split("<footer")[0].replace("<b>", "").replace("</b>", "").replace("<br>", " ")
        want = "\n".join(t for t in (" ".join(html.html.unescape(p).split()) for p in re.split(r"</?(?:p|h1)>", inner)) if t)
        assert html.main_text(r.html)[0] == want


W60 = " ".join(["word"] * 60)


@pytest.mark.parametrize(
    "page",
    [
        f"<div class='page sidebar-right'><article><p>{W60}</p></article></div>",
        f"<article class='post comments-open'><div class='entry has-comments'><p>{W60}</p></div></article>",
        f"<form id=aspnetForm><nav><a href=1>x</a></nav><article><p>{W60}</p></article></form>",
        f"<article><p>{W60}</p></article><section class=comments><article class=comment><p>{W60} {W60} {W60}</p></article></section>",
        f"<main><article><p>{W60}</p></article><aside><article><p>A teaser of another text.</p></article></aside></main>",
        f"<div class=widget-layout><div><a href=1>x</a></div><p>{W60}</p></div>",
        f"<article><p>{W60}</p></article><footer><a href=1>About</a></footer><div><p>Another part.</p></div>",
        f"<article><p>{W60}</p><h3>Read on</h3><ul><li><a href=1>One thing</a><li><a href=2>Another</a><li><a href=3>A third</a></ul></article>",
    ],
)
def test_names_of_parts_do_not_decide_alone(page):
    assert html.main_text(page)[0] == W60


def test_headline_and_short_pages():
    assert html.main_text(f"<article><div class='article-header'><h1>The headline</h1></div><p>{W60}</p></article>")[0] == f"The headline\n{W60}"
    assert html.main_text("<body><p>Two short words here.</p><p>And these four more.</p></body>")[0] == "Two short words here.\nAnd these four more."
    assert html.main_text(f"<article><p>{W60}</p><p>Bye.</p></article><footer><a href=1>About</a></footer>")[0] == f"{W60}\nBye."
    assert html.main_text(f"<div hidden><article><p>{W60}</p></article></div><p>Out of sight.</p>")[0] == "Out of sight."


def test_neighbours_decide():
    """The same block is text among text and none among links."""
    short, link = "<p>Five words are said here</p>", "<p><a href=1>a link of five words</a></p>"
    for inner, kept in ((f"<p>{W60}</p>{short}<p>{W60}</p>", True), (f"<p>{W60}</p>{link * 2}{short}{link * 2}", False)):
        assert ("Five words are said here" in html.main_text(f"<body>{inner}</body>")[0]) == kept
    one, many = f"<article><p>{W60}</p>{link}<p>{W60}</p></article>", f"<article><p>{W60}</p>{link * 3}<p>{W60}</p></article>"
    assert "a link" in html.main_text(one)[0] and html.main_text(many)[0].count("a link") < 3


def test_tree_learns_its_table_and_holds_on_other_pages():
    x, y, page = html.labelled_rows()
    assert np.mean([html.tree()(r) == bool(v) for r, v in zip(x, y, strict=True)]) > 0.97
    right = 0
    for k in np.unique(page):
        other = html.Tree(x[page != k], y[page != k])
        right += sum(other(r) == bool(v) for r, v in zip(x[page == k], y[page == k], strict=True))
    assert right / len(y) > 0.93


# ---- 3


def test_table_is_even_and_stable():
    names = maglev.shard_names(40)
    full = maglev.fill(names, 1009)
    counts = collections.Counter(full)
    assert set(counts) == set(range(40)) and max(counts.values()) - min(counts.values()) <= 1
    less = maglev.fill(names[:-1], 1009)
    moved = sum(a != b for a, b in zip(full, less, strict=True) if a != 39)
    assert moved / 1009 < 0.15
    heavy = collections.Counter(maglev.fill(names, 1009, [2] + [1] * 39))
    assert heavy[0] > 1.8 * heavy[1]
    for bad in ([], ["a", "a"]):
        with pytest.raises(ValueError):
            maglev.fill(bad, 1009)
    with pytest.raises(ValueError):
        maglev.fill(["a"], 1000)


@here
def test_every_document_has_its_slots_shard(spark):
    import hashlib

    table, names = maglev.fill(maglev.shard_names()), maglev.shard_names()
    got = queries.op3_permutation_table(spark, DATA).collect()
    assert len(got) == 200
    for r in got:
        slot = int(hashlib.md5(str(r.doc_id).encode()).hexdigest()[:15], 16) % maglev.SLOTS
        assert (r.slot, r.shard, r.shard_name) == (slot, table[slot], names[table[slot]])


@here
def test_placement_against_a_plain_table(spark):
    """Every shard's whole preference list, turns in order, slots by hashlib: all documents."""
    import hashlib

    def number(what, name):
        return int.from_bytes(hashlib.md5(f"{what}:{name}".encode()).digest()[:8], "big")

    size, names = maglev.SLOTS, maglev.shard_names()
    prefers = [iter([(number("offset", n) + j * (number("skip", n) % (size - 1) + 1)) % size for j in range(size)]) for n in names]
    table = {}
    while len(table) < size:
        for k, slots in enumerate(prefers):
            if len(table) < size:
                table[next(s for s in slots if s not in table)] = k
    want = []
    for (doc_id,) in C.table(spark, DATA, "documents").select("doc_id").collect():
        slot = int(hashlib.md5(str(doc_id).encode()).hexdigest()[:15], 16) % size
        want.append((doc_id, slot, table[slot], names[table[slot]]))
    assert sorted(map(tuple, queries.op3_permutation_table(spark, DATA).collect())) == sorted(want)


@pytest.mark.parametrize("key", ["slot", "Shard", "shard_name", "t_slot", "k_value", "a.b"])
def test_keys_of_any_name(spark, key):
    got = maglev.place(spark.createDataFrame([(7, 1), (None, 2)], "a long, b long").toDF(key, "k_slot"), key)
    assert len(set(got.columns)) == 4 and sorted((r[0], r[1]) for r in got.collect() if r[0]) == [(7, r[1]) for r in got.collect() if r[0]]


# ---- 4


def test_derivatives_refer_to_their_response():
    raw = warc.response(5, "http://x/y", "<html><head><title>A &amp; b</title></head><body><p>Hello <a href='/z'>there</a></p><script>no</script></body>")
    meta, conv = map(warc.parse, warc.derive(raw))
    source = warc.parse(raw)[0]
    for h, block in (meta, conv):
        assert h["warc-refers-to"] == source["warc-record-id"] and h["warc-target-uri"] == "http://x/y" and h["warc-date"] == source["warc-date"]
        assert h["warc-block-digest"] == warc.digest(block) and h["x-source-payload-digest"] == source["warc-payload-digest"] and h["warc-record-id"] != source["warc-record-id"]
    assert conv[1].decode() == "Hello there"
    fields = meta[1].decode()
    assert "http-status: HTTP/1.1 200 OK" in fields and "title: A & b" in fields and "outlink: /z" in fields and "http-header-content-type: text/html; charset=utf-8" in fields
    assert warc.derive(raw.replace(b"Hello", b"Jello")) is None and warc.derive(warc.derive(raw)[0]) is None and warc.parse(raw[:-30]) is None


def test_members_round_trip_and_stop_where_cut(tmp_path):
    raws = [warc.response(k, f"http://x/{k}", "<p>" + "word " * k) for k in range(50)]
    data = b"".join(map(warc.member, raws))
    (tmp_path / "f").write_bytes(data)
    with open(tmp_path / "f", "rb") as f:
        assert list(warc.members(f, 777)) == raws
    assert gzip.decompress(data) == b"".join(raws)
    (tmp_path / "f").write_bytes(data[:-5])
    with open(tmp_path / "f", "rb") as f:
        assert list(warc.members(f, 777)) == raws[:-1]


def test_damage_costs_its_record_only(tmp_path):
    raws = [warc.response(k, f"http://x/{k}", " ".join(f"<p>w{k * j}" for j in range(200))) for k in range(60)]
    packed = [warc.member(r) for r in raws]
    for hit in (0, 1, 30, 59):
        for bad in (packed[hit][: len(packed[hit]) // 2], packed[hit][:20] + b"\x00\xff" * 8 + packed[hit][36:], b"no gzip at all", packed[hit][:-8] + b"12345678"):
            (tmp_path / "f").write_bytes(b"".join([*packed[:hit], bad, *packed[hit + 1 :]]))
            for step in (100, 1 << 17):
                lost = []
                with open(tmp_path / "f", "rb") as f:
                    assert list(warc.members(f, step, lost)) == [r for k, r in enumerate(raws) if k != hit]
                assert len(lost) == 1


def test_skipped_records_are_counted_and_a_rerun_leaves_the_same_files(spark, tmp_path):
    pages = spark.createDataFrame([(k, f"http://x/{k}", "<p>" + "word " * k) for k in range(30)], "page_id long, url string, html string").repartition(3)
    made = warc.write_responses(pages, f"file://{tmp_path}/in")
    path = made.orderBy("path").first().path.removeprefix("file://")
    n = made.orderBy("path").first().n
    data = open(path, "rb").read()
    starts = [m.start() for m in re.finditer(re.escape(warc.MAGIC), data)]
    at = starts[len(starts) // 2] + 40
    open(path, "wb").write(data[:at] + b"\x00\xff\x00\xff" + data[at + 4 :] + warc.member(warc.record([("WARC-Type", "warcinfo")], b"x")))
    first = warc.write_derivatives(made, f"file://{tmp_path}/out")
    rows = {r.path: (r.n, r.skipped) for r in first.collect()}
    assert sum(n for n, _ in rows.values()) == 29 and sorted(s for _, s in rows.values()) == [0] * (len(rows) - 1) + [2] and n > 2
    files = {p.name: p.read_bytes() for p in (tmp_path / "out").iterdir()}
    again = warc.write_derivatives(made.repartition(1), f"file://{tmp_path}/out")  # dealt otherwise
    assert {r.path: (r.n, r.skipped) for r in again.collect()} == rows and {p.name: p.read_bytes() for p in (tmp_path / "out").iterdir()} == files
    read = warc.read_records(made).collect()
    assert collections.Counter(r.record_type for r in read) == {"response": 29, "damaged": 1, "warcinfo": 1}
    assert warc.read_records(first).count() == 58


def visible(page):
    """Plain text of simple pages by the standard library's parser, words only."""
    from html.parser import HTMLParser

    class P(HTMLParser):
        out, off = [], 0

        def handle_starttag(self, tag, attrs):
            self.off += tag in ("script", "style", "title")
            self.out.append(" ")

        def handle_endtag(self, tag):
            self.off -= tag in ("script", "style", "title")
            self.out.append(" ")

        def handle_data(self, data):
            self.out.append("" if self.off else data)

    p = P()
    p.out = []
    p.feed(page)
    p.close()
    return "".join(p.out).split()


@here
def test_records_against_a_plain_reading(spark):
    """Conversion texts, ids and digests of all pages, made here with other means."""
    import base64
    import hashlib

    pages = {r.page_id: r for r in C.table(spark, DATA, "pages").collect()}
    made = warc.write_derivatives(warc.write_responses(C.table(spark, DATA, "pages"), C.fresh_path(spark, "w")), C.fresh_path(spark, "w"))
    assert made.agg(F.sum("n"), F.sum("skipped")).first()[:] == (len(pages), 0)
    got = warc.read_records(made, with_block=True).collect()
    assert len(got) == 2 * len(pages) and len({r.record_id for r in got}) == len(got)
    for r in got:
        page, block = pages[r.page_id], r.block.encode()
        assert r.block_digest == "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode() and r.content_length == len(block)
        assert r.refers_to == f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, page.url + chr(0) + str(page.page_id))}>"
        if r.record_type == "conversion":
            assert r.block.split() == visible(page.html) and r.n_chars == len(r.block)
        else:
            fields = dict(x.split(": ", 1) for x in r.block.split("\r\n") if ": " in x)
            assert fields["title"] == " ".join(html.html.unescape(page.html.split("<title>")[1].split("</title>")[0]).split()) and int(fields["links"]) == page.html.count("<a ")


@here
def test_two_records_for_every_page(spark):
    got = queries.op4_warc_derivatives(spark, DATA).collect()
    pages = {r.page_id: r for r in C.table(spark, DATA, "pages").collect()}
    assert collections.Counter((r.page_id, r.record_type) for r in got) == {(p, t): 1 for p in pages for t in ("metadata", "conversion")}
    for r in got:
        page = pages[r.page_id]
        assert r.target_uri == page.url and r.source_digest == warc.digest(page.html.encode()) and r.refers_to == warc.record_id(page.url, str(r.page_id))
        if r.record_type == "conversion":
            assert r.n_chars == len("\n".join(b.text for b in html.blocks(page.html)[0]))


# ---- 5


def base_figures(text):
    words = WORD.findall(text or "")
    at = collections.defaultdict(list)
    for i in range(len(words) - 2):
        at[tuple(words[i : i + 3])].append(i)
    repeat = {i + k for xs in at.values() if len(xs) > 1 for i in xs for k in range(3)}
    full = [x for x in (text or "").split("\n") if WORD.search(x)]
    n, r = len(words), len(repeat)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(full) - len(set(full)), r, n < 50 or 100 * r > 50 * n


@here
def test_quality_base_and_distances(spark, documents):
    got = {r.doc_id: r for r in queries.op5_distribution_divergence(spark, DATA).collect()}
    hist = {}
    for doc_id, text, lang, _ in documents:
        r = got[doc_id]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base_figures(text)
        left, classes = text, []
        for _, rx in quality.CLASSES:
            import regex

            after = regex.sub(rx, "", left)
            classes.append(len(left) - len(after))
            left = after
        words = collections.Counter(w.lower() for w in WORD.findall(text))
        common = [words[w] for w in quality.COMMON_WORDS[lang]]
        hist[doc_id] = (lang, [*classes, len(left)], [*common, r.n_words - sum(common)], r.base_failed)
    refs = {lang: [np.sum([h[k] for h in hist.values() if h[0] == lang and not h[3]], axis=0) for k in (1, 2)] for lang in quality.COMMON_WORDS}

    def js(p, q):
        p, q = np.array(p) / max(sum(p), 1), np.array(q) / max(sum(q), 1)
        m = (p + q) / 2
        return math.sqrt(max(0, sum(0.5 * a * math.log2(a / c) for a, c in zip(p, m, strict=True) if a) + sum(0.5 * b * math.log2(b / c) for b, c in zip(q, m, strict=True) if b)))

    for doc_id, (lang, classes, common, failed) in hist.items():
        r = got[doc_id]
        a = js(classes, refs[lang][0]) if sum(classes) >= quality.MIN_CHARS_FOR_CLASSES else None
        b = js(common, refs[lang][1]) if r.n_words >= quality.MIN_WORDS_FOR_COMMON else None
        assert r.class_distance == (None if a is None else pytest.approx(a, abs=1e-6)) and r.common_distance == (None if b is None else pytest.approx(b, abs=1e-6))
        assert r.kept == (not failed and (a or 0) <= quality.MAX_CLASS_DISTANCE and (b or 0) <= quality.MAX_COMMON_DISTANCE)


@here
def test_quality_parts_labelled_documents(spark):
    sf = DATA.replace("0.001", "0.01")
    got = queries.op5_distribution_divergence(spark, sf).join(C.table(spark, sf, "labels"), "doc_id").where("not base_failed").collect()
    good, bad = [r.kept for r in got if r.quality == 1], [r.kept for r in got if r.quality == 0]
    assert sum(good) / len(good) > 0.99 and sum(bad) / len(bad) < 0.3


def test_word_lists_of_other_languages_come_from_the_data(spark):
    rng = random.Random(8)
    common, rare = [f"co{x}" for x in "abcdefgh"], [f"ra{x}{y}" for x in "abcdefghijklmnop" for y in "abcdefghijklmnop"]
    plain = [" ".join(rng.choice(common) if rng.random() < 0.5 else rng.choice(rare) for _ in range(200)) for _ in range(30)]
    odd = " ".join(rng.choice(rare) for _ in range(200))
    rows = [(k, t, "xx") for k, t in enumerate([*plain, odd])] + [(99, "one two", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    words = quality.frequent_words(docs, k=8)
    assert {k: sorted(v) for k, v in words.items()} == {"xx": common}
    kept = {r.doc_id: r.kept for r in quality.verdicts(docs, words).collect()}
    assert [k for k, v in kept.items() if not v and k < 99] == [30] and all(r.kept for r in quality.verdicts(docs).where("doc_id < 99").collect())
    assert {r.doc_id for r in quality.keep(docs, words).collect()} == set(range(30)) and quality.frequent_words(docs.limit(0)) == {}


# ---- 6


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_mixing_against_sorting(spark, seed):
    import duckdb
    import pandas as pd

    rng = random.Random(seed)
    rows = [(i, "w " * (rng.choice([0, 1, 5, 40, 300]) if i % 50 else 20_000), rng.choice(["b", "a", "ä", None, "big", "big", "big", "big", "z", "zz"])) for i in range(600)]
    documents = pd.DataFrame(rows, columns=["doc_id", "text", "source"])  # noqa: F841  DuckDB sees it
    got = sorted(map(tuple, mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()))
    assert got == sorted(duckdb.sql(mixing.ORACLE).fetchall())
    by = collections.defaultdict(lambda: [0, 0.0, 0, 0])
    for (_, _, source), r in zip(rows, got, strict=True):
        x = by[source]
        x[0], x[1], x[2], x[3] = r[2], r[3], x[2] + r[4], max(x[3], r[1])
    assert sum(x[1] for x in by.values()) == pytest.approx(1.5 * sum(x[0] for x in by.values()))
    assert all(x[1] <= 2 * x[0] and abs(x[2] - x[1]) <= x[3] for x in by.values())


@here
def test_mixing_query_against_its_sql(spark):
    import duckdb

    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    assert sorted(map(tuple, queries.op6_hash_threshold_mixing(spark, DATA).collect())) == sorted(c.sql(mixing.ORACLE).fetchall())


# ---- 7


def test_chain_feeds_earlier_probabilities():
    rng = np.random.default_rng(5)
    rows, labels = [], []
    for _ in range(600):
        a, b = rng.random() < 0.4, rng.random() < 0.5
        rows.append(np.array(sorted({1} if a else {2}) + [10 + int(x) for x in rng.integers(0, 40, 6)]))
        labels.append([a, a and b, a and not b])
    labels = np.array(labels, float)
    labels[:20, 0] = np.nan
    models = toxicity.fit_chain(rows, labels, np.arange(600) % toxicity.FOLDS)
    assert len(models[1].extra) == 1 and models[1].extra[0] > 0.5 and len(models[2].extra) == 2
    p = toxicity.Chain(models).probs([{toxicity.Chain(models).choice[1]}, {toxicity.Chain(models).choice.get(2, 10**6)} & set(toxicity.Chain(models).choice.values())])
    assert p[0, 0] > 0.9 > 0.1 > p[1, 0] and p[1, 1] < 0.1


@here
def test_toxic_documents_held_out(spark):
    sf = DATA.replace("0.001", "0.1")
    docs, labels = C.table(spark, sf, "documents"), C.table(spark, sf, "labels")
    chain = toxicity.train(docs, labels.where("doc_id % 2 = 0"))
    got = toxicity.scores(docs, chain).join(labels.where("doc_id % 2 = 1"), "doc_id").where("quality = 1").collect()
    caught, spared = [r.rejected for r in got if r.toxic == 1], [r.kept for r in got if r.toxic == 0]
    assert sum(caught) / len(caught) > 0.9 and sum(spared) / len(spared) > 0.995


@here
def test_scores_against_a_plain_chain(spark, documents):
    """All documents: labels, folds, features and the chain's products taken apart row by row."""
    import pandas as pd

    labels = pd.read_parquet(f"{DATA}/labels.parquet")
    texts = {d[0]: d[1] for d in documents}
    found = {k: {f for w in set((t or "").split()) for f in toxicity.word_features(w)} for k, t in texts.items()}
    fold = {r.i: r.f for r in spark.createDataFrame([(int(k),) for k in labels.doc_id], "i long").select("i", F.pmod(F.xxhash64("i", F.lit(12)), F.lit(toxicity.FOLDS)).alias("f")).collect()}
    rows = [r for r in labels.sort_values("doc_id").itertuples() if r.doc_id in texts]
    toxic, quality_ = (np.array([float(getattr(r, c)) for r in rows]) for c in ("toxic", "quality"))
    y = np.column_stack([toxic, np.where(toxic == 0, 0.0, toxic * (quality_ == 1)), np.where(toxic == 0, 0.0, toxic * (quality_ == 0))])
    models = toxicity.fit_chain([np.array(sorted(found[r.doc_id])) for r in rows], y, np.array([fold[r.doc_id] for r in rows]))
    got = {r.doc_id: r for r in queries.op7_classifier_chain(spark, DATA).collect()}
    assert len(got) == len(documents)
    for k in texts:
        before = []
        for m in models:
            score = m.bias + sum(m.weights[m.choice[f]] for f in found[k] if f in m.choice) + sum(a * b for a, b in zip(m.extra, before, strict=True))
            before.append(1 / (1 + math.exp(-max(-30, min(30, score)))))
        assert got[k][1:4] == pytest.approx(before, abs=1e-9) and got[k].rejected == (max(before) >= toxicity.THRESHOLD) == (not got[k].kept)


def test_repeated_documents_teach_once(spark):
    docs = spark.createDataFrame([(1, "b")] * 50 + [(1, "a"), (2, "c")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (1, 0, 1)], "doc_id long, toxic int, quality int")
    got = toxicity.sample(docs, labels).collect()
    assert sorted((r.doc_id, r.toxic, r.quality, np.frombuffer(r.feats, np.uint32).tolist()) for r in got) == [(1, 1.0, 0.0, [zlib.crc32(b"a")]), (2, 0.0, 1.0, [zlib.crc32(b"c")])]


# ---- 8


def vectors(seed, n, dim=16):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(8, dim))
    rows = []
    for i in range(n):
        v = base[i % 8] + rng.normal(size=dim) * rng.choice([0, 0.02, 0.1, 0.3, 1.0])
        rows.append((i, [float(x) for x in v.astype(np.float32) * rng.choice([0.5, 1, 3])], int(i % 3) if i % 17 else None))
    return rows + [(n + k, rows[3][1], rows[3][2]) for k in range(20)]


@pytest.mark.parametrize("tile", [7, 1024])
def test_neardup_against_all_pairs(spark, monkeypatch, tile):
    monkeypatch.setattr(neardup, "TILE", tile)
    rows = vectors(4, 300)
    got = sorted(map(tuple, neardup.duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()))
    m = np.array([r[1] for r in rows])
    cos = m @ m.T / np.outer(np.linalg.norm(m, axis=1), np.linalg.norm(m, axis=1))
    label = np.array([-i - 1 if r[2] is None else r[2] for i, r in enumerate(rows)])
    linked = (cos >= 0.98) & (label[:, None] == label[None]) & ~np.eye(len(rows), dtype=bool)
    root = components.linked_roots(linked)
    assert got == [(i, int(linked[i].sum()), int(root[i]), bool(root[i] == i)) for i in range(len(rows))]


def test_repeated_ids_and_labels_in_one_tile(spark, monkeypatch):
    """Rows that share a vec_id keep their own vectors; many labels share tiles; a component has its least vec_id."""
    monkeypatch.setattr(neardup, "TILE", 5)
    rows = [(i % 50, v, k if k is None else i % 40) for i, (_, v, k) in enumerate(vectors(6, 200))]
    got = collections.Counter(tuple(r)[:3] for r in neardup.duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect())
    m = np.array([r[1] for r in rows])
    cos = m @ m.T / np.outer(np.linalg.norm(m, axis=1), np.linalg.norm(m, axis=1))
    label = np.array([-i - 1 if r[2] is None else r[2] for i, r in enumerate(rows)])
    linked = (cos >= 0.98) & (label[:, None] == label[None]) & ~np.eye(len(rows), dtype=bool)
    root = components.linked_roots(linked)
    least = {r: min(rows[i][0] for i in np.flatnonzero(root == r)) for r in set(root)}
    assert got == collections.Counter((rows[i][0], int(linked[i].sum()), least[root[i]]) for i in range(len(rows)))


def test_bounds_lose_nothing():
    rng = np.random.default_rng(1)
    a = rng.normal(size=(60, 64))
    b = np.concatenate([a[:30] + rng.normal(size=(30, 64)) * 0.1, rng.normal(size=(30, 64))])
    a, b = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in (a, b))
    assert (neardup.reachable(a, b, 0.9) >= (a @ b.T >= 0.9)).all()
    assert not (neardup.reachable(a, b, 0.9) & (a @ b.T < 0.9 - 1e-6)).any()


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(k, k + 1) for k in range(1000, 1060)] + [(2000, 2000 + k) for k in range(1, 200)] + [(5, 5)]
    u = components.Union(2300)
    u.join_all(*np.array([(min(e), max(e)) for e in edges]).T)
    got = dict(map(tuple, components.connected(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {x: u.find(x) for e in edges if e[0] != e[1] for x in e}
    assert components.connected(spark.createDataFrame([], "a long, b long")).collect() == []


# ---- 9


def brute_classes(rows):
    def shingled(t):
        w = WORD.findall(t or "")
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())

    sets = {k: shingled(t) for k, t in rows}
    keys, up, links = sorted(sets), {k: k for k in sets}, collections.Counter()

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 10 * both >= 8 * (len(sets[a]) + len(sets[b]) - both):
                links[a] += 1
                links[b] += 1
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return sorted((k, find(k), links[k], len(sets[k])) for k in keys)


@here
def test_jaccard_against_all_pairs(spark, documents):
    assert sorted(map(tuple, queries.op9_chosen_path_join(spark, DATA).collect())) == brute_classes([(d[0], d[1]) for d in documents])


def near_copies(seed, groups, size, words=120):
    rng = random.Random(seed)
    rows, passage = [], " ".join(f"shared{k}" for k in range(30))
    for g in range(groups):
        base = [f"g{g}w{rng.randrange(10**6)}" for _ in range(words)]
        for _ in range(size):
            w = list(base)
            for _ in range(rng.choice([0, 1, 2, 3, 6])):
                w[rng.randrange(words)] = f"x{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(w) + (f" {passage}" if rng.random() < 0.3 else "")))
    return rows


def test_jaccard_on_groups_larger_than_a_leaf_or_a_tile(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "LIMIT", 8)
    monkeypatch.setattr(jaccard, "TILE", 10)
    rows = near_copies(1, 6, 30) + [(1000 + k, t) for k, (_, t) in enumerate(near_copies(2, 40, 1))]
    got = sorted(map(tuple, jaccard.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert got == brute_classes(rows)


def test_texts_that_share_a_doc_id_are_not_lost(spark):
    same = "a b c d e f g h"
    rows = [(1, same, "x"), (1, "q w e r t y u i o p", "y"), (2, same, "z"), (3, "k l m n o p q r s t", "x"), (1, same, "w"), (3, "k l m n o p q r s t", "x"), (4, "", "x"), (4, None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = collections.Counter(map(tuple, jaccard.classes(docs).collect()))
    assert found == {(1, 1, 2, 4): 2, (1, 1, 0, 6): 1, (2, 1, 2, 4): 1, (3, 3, 1, 6): 2, (4, 4, 0, 0): 2}
    left = [tuple(r) for r in jaccard.one_of_each(docs).collect()]
    assert sorted(r[:2] for r in left if r[0] < 4) == [(1, same), (1, "q w e r t y u i o p"), (3, "k l m n o p q r s t")] and sorted(str(r[1]) for r in left if r[0] == 4) == ["", "None"]
    again = jaccard.one_of_each(docs.orderBy(F.desc("lang")).repartition(3))
    assert sorted(map(str, left)) == sorted(str(tuple(r)) for r in again.collect())  # also which of the rows that share doc_id and text


def test_one_of_each_keeps_the_least_of_every_class_of_repeated_ids(spark):
    rows = [(k % 40, t) for k, t in near_copies(3, 12, 8)]  # 40 ids, 96 texts
    texts = sorted({t for _, t in rows})
    of = {c[0]: c[1] for c in brute_classes(list(enumerate(texts)))}
    least = {}
    for k, t in rows:
        at = of[texts.index(t)]
        least[at] = min(least.get(at, k), k)
    got = [tuple(r) for r in jaccard.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted((of[texts.index(t)], k) for k, t in got) == sorted(least.items())


def test_recall_at_the_threshold(spark, monkeypatch):
    """Pairs of Jaccard 0.80, every bucket split to the last level: the recall that the README states."""
    monkeypatch.setattr(jaccard, "LIMIT", 1)
    rng, rows = random.Random(9), []
    for k in range(4000):
        w = [f"{rng.randrange(10**8)}" for _ in range(94)]  # 90 shingles
        x = w[:]
        x[84], x[89] = "new", "newer"  # ten shingles differ: 80 shared of 100
        rows += [(2 * k, " ".join(w)), (2 * k + 1, " ".join(x))]
    sets = [(set(jaccard.shingles(a[1]).tolist()), set(jaccard.shingles(b[1]).tolist())) for a, b in zip(rows[::2], rows[1::2], strict=True)]
    linked = [k for k, (a, b) in enumerate(sets) if 10 * len(a & b) >= 8 * len(a | b)]
    found = {r.doc_id // 2 for r in jaccard.classes(spark.createDataFrame(rows, "doc_id long, text string")).where("n_links = 1").collect()}
    assert len(linked) == 4000 and found <= set(linked) and len(found) >= 0.998 * len(linked)


def test_runs_follow_the_recall():
    assert jaccard.runs_for(0.9) < jaccard.runs_for(0.9999) and jaccard.RUNS == jaccard.runs_for(jaccard.RECALL)


# ---- 10


def lattice(v, text):
    t = viterbi.marked(text)
    best, back = [0.0] + [-math.inf] * len(t), [None] * (len(t) + 1)
    for j in range(1, len(t) + 1):
        for i in range(max(0, j - v.longest), j):
            arc = v.arcs.get(t[i:j])
            score = best[i] + (arc[0] if arc else v.fallback if j == i + 1 else -math.inf)
            if score > best[j]:
                best[j], back[j] = score, (i, arc[1] if arc else -1)
    path, k = [], len(t)
    while k:
        path.append((back[k][0], back[k][1]))
        k = back[k][0]
    return [x for i, a in reversed(path) for x in ([a] if a >= 0 else v.spell(t[i]))]


TEXTS = ["  a▁b\n\n ñ日本語𝄞 x", "▁", " ", "\n", "a" * 300, "=-" * 200, "representation of responsibility", "\x00\x7f é", "----------------" * 5 + "x"]


@pytest.mark.parametrize("text", TEXTS)
def test_streaming_equals_the_whole_lattice(text):
    e = viterbi.encoder()
    want = lattice(e.v, text)
    assert np.frombuffer(e.encode(text), "<u4").tolist() == want and e.decode(e.encode(text)) == text
    for step in (1, 3, 50):
        assert list(viterbi.encode_stream(e.v, [text[k : k + step] for k in range(0, len(text), step)])) == want


@here
def test_documents_encode_as_the_lattice_says(documents, monkeypatch):
    """Whole documents, and every id comes out of the streaming search the first time its stretch is met."""
    e, searched = viterbi.Encoder(viterbi.encoder().path), []
    run = viterbi.Stream._run
    monkeypatch.setattr(viterbi.Stream, "_run", lambda s, until, out: searched.append(s.text) or run(s, until, out))
    for _, text, *_ in documents:
        assert np.frombuffer(e.encode(text), "<u4").tolist() == lattice(e.v, text or "")
    assert set(searched) >= {x for d in documents for x in viterbi._STRETCH.findall(viterbi.marked(d[1] or ""))}


def test_window_is_bounded():
    e = viterbi.encoder()
    s, held = viterbi.Stream(e.v), 0
    for k in range(400):
        list(s.push(f"word{k}" + "▁" * (k % 2)))
        held = max(held, len(s.text))
    assert held < 12 * e.v.longest


def test_encoding_works_on_a_bounded_portion_of_a_batch():
    """One batch of Spark's rows, whose texts are long: what is held and given out at a time stays small, and no row is lost."""
    import pyarrow as pa

    class Docs:
        selectExpr = lambda self, *columns: self
        mapInArrow = lambda self, run, schema: run

    texts = ["word and word " * n for n in (0, 3, 40_000, 1, 100_000, 200_000, 2, 30_000)]
    rows = [(k, x or None) for k, x in enumerate(texts * 3)]
    batch = pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int64()), pa.array([x for _, x in rows])], ["doc_id", "text"])
    empty = batch.slice(0, 0)
    got = list(viterbi.encoded(Docs(), with_ids=True)(iter([empty, batch.slice(0, 5), batch.slice(5)])))
    sizes = {k: len((x or "").encode()) for k, x in rows}
    assert all(b.num_rows == 1 or sum(sizes[k] for k in b.column(0).to_pylist()) <= C.PORTION_BYTES for b in got)
    e = viterbi.encoder()
    found = [(k, np.array(ids, "<u4").tobytes(), same) for b in got for k, ids, same in zip(b.column(0).to_pylist(), b.column(4).to_pylist(), b.column(3).to_pylist(), strict=True)]
    assert found == [(k, e.encode(x), True) for k, x in rows]


# ---- pipeline


@here
def test_pipeline_against_plain_steps(spark, documents):
    got = sorted((r.doc_id, tuple(r.ids)) for r in corpus_pipeline.run(spark, DATA).collect())
    chain = toxicity.train(C.table(spark, DATA, "documents"), C.table(spark, DATA, "labels"))
    feats = toxicity.Features(chain.choice)
    left = [d for d in documents if chain.probs([feats.of(d[1])]).max() < toxicity.THRESHOLD]
    kept = {r.doc_id for r in quality.verdicts(spark.createDataFrame(left, "doc_id long, text string, lang string, source string")).where("kept").collect()}
    left = [d for d in left if d[0] in kept]
    stands = {c[0] for c in brute_classes([(d[0], d[1]) for d in left]) if c[0] == c[1]}
    left = [d for d in left if d[0] in stands]
    import duckdb
    import pandas as pd

    documents = pd.DataFrame(left, columns=["doc_id", "text", "lang", "source"])  # noqa: F841
    copies = {r[0]: r[5] for r in duckdb.sql(mixing.ORACLE).fetchall()}
    e = viterbi.encoder()
    want = sorted((d[0], tuple(np.frombuffer(e.encode(d[1]), "<u4").tolist())) for d in left for _ in range(copies[d[0]]))
    assert got == want and got


def test_stage_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality rules", "n-gram jaccard join", "mixing sources", "sentencepiece encoding"]
    assert {q for q in queries.QUERIES} >= {f.__name__ for f in queries.QUERIES.values()} and F is not None
