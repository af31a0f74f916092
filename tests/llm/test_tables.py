import base64
import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from firnline.llm import html, langid, mixing, sharding, urls, warc
from firnline.llm.decontam import uncontaminated_rows
from firnline.operators.ranks import with_positions
from tests.llm.conftest import make_docs, prose


def unit(*parts):
    return int(hashlib.md5(":".join("~" if p is None else str(p) for p in parts).encode()).hexdigest()[:13], 16) / 2 ** 52


@pytest.mark.parametrize("epochs", [1.0, 40.0])
def test_mixing(spark, docs, rows, no_docs, epochs):
    weights = spark.createDataFrame([("s0", 1.0), ("s1", 3.0), ("hot", 0.5), (None, 0.25), ("none such", 9.0)], "source string, weight double")
    got = mixing.mixed(docs, weights, epochs=epochs)
    assert set(docs.columns) - {"_part"} <= set(got.columns)
    size = collections.Counter()
    for _, t, _, s in rows:
        size[s] += len((t or "").encode()) + 16
    given = {"s0": 1.0, "s1": 3.0, "hot": 0.5, None: 0.25}
    want = collections.Counter()
    for i, _, _, s in rows:
        if s not in given or i is None:
            continue
        rate = given[s] / sum(given.values()) * sum(n for k, n in size.items() if k in given) * epochs / size[s]
        parts = math.ceil(rate / 16)
        for j in range(parts):
            u, k, p = unit(42, i, "count", *([] if parts == 1 else [j])), 0, math.exp(-rate / parts)
            total = p
            while total <= u:
                k += 1
                p *= rate / parts / k
                total += p
            want[i, s] += k
    found = got.collect()
    assert collections.Counter((r.doc_id, r.source) for r in found if r.doc_id is not None) == +want
    assert all(1 <= r.copy <= r.n_copies for r in found) and len(found) == sum(r.n_copies for r in found if r.copy == 1)
    order = sorted(found, key=lambda r: r.position)
    assert [r.position for r in order] == list(range(len(found)))
    keys = [unit(42, r.doc_id, "order", r.copy) for r in order if r.doc_id is not None]
    assert keys == sorted(keys)
    assert mixing.mixed(no_docs).count() == 0


def test_rows_without_id_are_mixed_one_by_one(spark):
    docs = make_docs(spark, [(None, f"t{i}", "en", "s") for i in range(3000)] + [(i, "x", "en", "s") for i in range(3000)])
    found = sorted(mixing.mixed(docs, epochs=2.0).collect(), key=lambda r: r.position)
    drawn = collections.Counter(r.text for r in found if r.doc_id is None)
    counts = collections.Counter(drawn.values())
    # A Poisson variable of mean 2 (all sizes are nearly equal): nobody is left out or drawn alike with all others.
    assert 5000 < sum(drawn.values()) < 7500 and len(counts) > 4 and 0.2 < counts[1] / 3000 < 0.35
    # And they are spread over the whole order.
    half = sum(r.doc_id is None for r in found[:len(found) // 2])
    assert 0.4 < half / (len(found) // 2) < 0.6


def test_positions_with_one_hot_value(spark):
    df = spark.range(5000).select((F.col("id") % 7 == 0).cast("int").alias("k"), F.xxhash64("id").alias("tie"))
    got = with_positions(df, ["k", "tie"]).orderBy("position").collect()
    assert [r.position for r in got] == list(range(5000)) and got[0].n_rows == 5000
    assert [(r.k, r.tie) for r in got] == sorted((r.k, r.tie) for r in got)


@pytest.mark.parametrize(("n", "bits"), [(2, 4), (3, 3), (4, 2)])
def test_hilbert_visits_every_cell_by_single_steps(spark, n, bits):
    cells = spark.range(1 << n * bits).select(*[(F.floor(F.col("id") / (1 << bits * i)) % (1 << bits)).cast("long").alias(f"l{i}") for i in range(n)])
    found = sharding.hilbert(cells, [f"l{i}" for i in range(n)], bits).orderBy("hilbert").collect()
    assert [r.hilbert for r in found] == list(range(1 << n * bits))
    assert all(sum(abs(a[i] - b[i]) for i in range(n)) == 1 for a, b in zip(found, found[1:]))


def test_shards(spark, docs, rows, no_docs):
    got = sharding.shards(docs, 7).collect()
    assert len(got) == len(rows)
    by = collections.defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values()) and set(by) == set(range(7))
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(r.size == len((r.text or "").encode()) + 16 and r.text_crc32 == zlib.crc32((r.text or "").encode()) for r in got)
    runs = [(r.shard, r.hilbert) for r in sorted(got, key=lambda r: (r.shard, r.slot))]
    assert runs == sorted(runs)
    assert sharding.shards(no_docs).count() == 0
    few = sharding.placement(make_docs(spark, rows[:3])).collect()
    assert len({r.shard for r in few}) == 3 and all(r.slot == 0 and r.law == "rows" for r in few)


def brute_probability(word, pieces, model, unknown):
    """Sum over all segmentations, written out."""
    if not word:
        return 1.0
    total = 0.0
    for k in range(1, len(word) + 1):
        p = model.get(word[:k]) if word[:k] in pieces else unknown if k == 1 else None
        if p:
            total += p * brute_probability(word[k:], pieces, model, unknown)
    return total


def test_forward_sums_all_segmentations():
    pieces = sorted({"▁", "a", "b", "ab", "▁a", "ba", "bab", "▁ab"})
    rng = np.random.default_rng(1)
    model = rng.random((len(pieces) + 1, 2)) * 0.1
    lattice = langid.Lattice(pieces)
    words = ["a", "ab", "bab", "abab", "xa", "babab", "aÿb"]
    got = langid.log_probabilities(words, lattice, langid._scaled(model, pieces))
    for i, w in enumerate(words):
        for k in range(2):
            want = brute_probability("▁" + w, set(pieces), dict(zip(pieces, model[:, k])), model[-1, k])
            assert got[i, k] == pytest.approx(math.log(want))
    uses = langid.expected_counts(["ab"], np.array([2.0]), lattice, langid._scaled(model, pieces)[:, :1])
    sizes = np.array([len(p) for p in pieces] + [1])
    assert float(uses @ sizes) == pytest.approx(2 * 3)


def test_long_words_are_scored_whole(monkeypatch):
    pieces = sorted({"▁", "a", "b", "c", "ab", "▁a", "ba", "bab", "▁ab", "cabab"})
    rng = np.random.default_rng(2)
    lattice = langid.Lattice(pieces)
    table = langid._scaled(rng.random((len(pieces) + 1, 3)) * 0.1, pieces)
    words = ["".join(rng.choice(list("abcx"), n)) for n in (1, 2, 9, 60, 99, 100)]
    want = langid.log_probabilities(words, lattice, table)
    for long, segment in ((0, 1), (5, 7), (50, 1000)):
        monkeypatch.setattr(langid, "LONG", long)
        monkeypatch.setattr(langid, "SEGMENT", segment)
        assert np.allclose(langid.log_probabilities(words, lattice, table), want)
    # A run of any length is one word, and its parts add up to nearly the whole.
    run = "ab" * 20_000
    assert langid.words_of(f"x {run} y") == ["x", run, "y"]
    whole = langid.log_probabilities([run, run + run], lattice, table)
    assert np.isfinite(whole).all() and np.allclose(whole[1] / whole[0], 2, rtol=1e-3)


def test_all_letter_pieces_are_used():
    import sentencepiece
    model = sentencepiece.SentencePieceProcessor(model_file=langid.VOCABULARY)
    every = {model.id_to_piece(i) for i in range(model.get_piece_size())}
    every = {p for p in every if p == p.lower() and p.removeprefix(langid.MARK).isalpha()}
    pieces = langid.load_pieces()
    assert every <= set(pieces) and max(map(len, every)) > 5
    assert langid.Lattice(pieces).longest == max(map(len, every))


def test_identify(docs, rows, no_docs, spark):
    got = langid.identify(docs).collect()
    assert len(got) == len(rows)
    text = {i: (t, lang) for i, t, lang, _ in rows}
    for r in got:
        t, lang = text[r.doc_id] if r.doc_id is not None else (None, None)
        if r.doc_id is not None:
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
            assert (r.lang_pred == "und") == (not any(c.isalpha() for c in t or ""))
        assert 0 <= r.score <= 1
    long = [r for r in got if r.doc_id is not None and len(text[r.doc_id][0] or "") > 200 and r.doc_id != 307]
    assert all(r.lang_pred == text[r.doc_id][1] for r in long if r.held_out) and any(r.held_out for r in long)
    assert langid.identify(no_docs).count() == 0
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {(r.lang_pred, r.score) for r in langid.identify(unlabelled).collect()} == {("und", 0.0)}
    kept = langid.identified(docs)
    assert "odd name.x" in kept.columns and kept.count() == sum(any(c.isalpha() for c in t or "") for _, t, _, _ in rows)


PAGES = [(1, "http://a/x", "<p>é</p>"), (2, None, "<p>é</p>"), (3, "u r\r\nl %41", None), (4, "http://b", ""), (0, "http://c", "<p>é</p>"),
         (5, "http://d", "x" * 300_000), (None, "http://e", "y"), (6, "", "y"), (6, "", "y"), (7, "z", "\x1f\u008b\x08 WARC/1.1\r\n")]


@pytest.mark.parametrize("split", [97, 1500, 1 << 20])
def test_warc_round_trip(spark, split):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").repartition(3)
    archives = warc.write_warc(pages, archive_bytes=600)
    got = warc.read_warc(archives, split).collect()
    want = collections.Counter()
    first = {}
    for i, _, h in PAGES:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    for i, u, h in PAGES:
        body = (h or "").encode()
        again = i is not None and first[h or ""] < i
        want[i, u, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if again else "response",
             first[h or ""] if again else None, None if again else body] += 1
    assert collections.Counter((r.page_id, r.url, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to,
                                None if r.payload is None else bytes(r.payload)) for r in got) == want
    assert warc.round_trip(pages.where("false")).count() == 0


def test_false_magic_is_no_record(tmp_path):
    inner = warc.record(9, "u", "response", b"inner", 5, warc.digest(b"inner"), None)
    noise = bytes(np.random.default_rng(0).integers(0, 256, 5000, np.uint8)) + warc.MAGIC
    # Incompressible content is stored as it is, so a whole archived record lies inside another.
    outer = warc.record(1, "u", "response", noise + inner + noise, 0, "", None)
    data = outer + warc.record(2, "u", "response", b"b", 1, warc.digest(b"b"), None)
    path = tmp_path / "x.warc.gz"
    path.write_bytes(data)
    for split in (50, 333, 4000):
        with open(path, "rb") as f:
            ids = [r["page_id"] for s in range(0, len(data), split) for r in warc.records_in(f, len(data), s, min(s + split, len(data)))]
        assert ids == [1, 2]


def test_main_text():
    fits = [html.verdict(html.trained(), f) == ("«" in t) for page in html.LABELLED for t, f in html.blocks(page)]
    assert sum(fits) / len(fits) > 0.95
    page = """<html><head><title>T</title></head><body><nav><a href='/'>Home</a></nav><div class="cookie-bar">We use cookies &amp; more</div>
<article><h1>Head&nbsp; line</h1><p>Short.<p>A <b>bold</b>\n word &lt;b&gt;<script>var s = "</p>";</script> tail<br>end<!-- <p>no</p> --></p><div class='ad'>Buy it</div></article>
<section id="comments"><p>A reader says that this is a very long remark about nothing at all, and goes on and on.</p></section><footer>F</footer></body></html>"""
    assert html.main_text(page) == "Head line\nShort.\nA bold word <b> tail end"
    assert html.main_text(None) == html.main_text("") == html.main_text("<p></p>") == ""
    assert html.main_text('<article><p title="a > b">x</p><p unclosed="y>z</p>').startswith("x")


# Main text is marked with «», as in the labelled table; none of these pages is in it.
HELD_OUT = (
    """<nav><a href="/">Home</a><a href="/p">Plants</a></nav><article><h1>«Moss in shade»</h1><p>«Moss needs no soil.»</p><p>«A wall that stays damp for most of the year is enough, and it will
come by itself if nobody scrubs the stones.»</p><p>«Wait.»</p></article><div class="ad">Seeds at half price only this week in all shops</div><footer>Garden pages</footer>""",
    """<div><a href="/">Front page</a> <a href="/w">World</a></div><h1>«Bridge reopens»</h1><p>«The bridge over the narrows was opened to cars again on Tuesday, three weeks sooner than planned by the county.»</p>
<p>«Lorries have to wait.»</p><p>«They may cross once the last of the cables has been tested under load, which the engineers hope to do in the coming month.»</p><p><a href="/n">Next story</a></p><p>Write to us</p>""",
    """<p><a href="/1">All the books that we lend to schools</a></p><p><a href="/2">How to become a reader and what it costs for a family of four</a></p><p><a href="/3">Where to find us in the old town</a></p>""",
    """<div class="topbar navigation"><a href="/">Shop</a></div><div id="content"><h2>«Care»</h2><p>«Wash cold.»</p><p>«Dry the jacket flat and in the shade, and never close to a stove or a heater that is on.»</p></div>
<div class="cookie">This site keeps small files on your device, please agree to that or leave</div><div id="comments"><p>Mine has lasted for ten winters now and is still as warm as on the first day.</p></div>""",
    """<article class="related"><h2>«Salt»</h2><p>«Salt was carried over this pass for a thousand years, by mules and on the backs of men.»</p><p>«The path is still there.»</p></article><aside><p>Walks near you, with maps and times, in our summer leaflet for hikers and families</p></aside>""",
    """<div>Search</div><div><a href="/a">About</a></div><div>«The observatory on the hill has been without a roof since the storm, and the telescope is wrapped in sails.»</div><div>«It was cloudy anyway.»</div>
<div>«A new dome is being built by the yard that made the old one in my grandfather's time, from the same drawings, they say.»</div><div><a href="/g">Give</a></div><div>Imprint</div>""",
    """<main><h1>«Timetable»</h1><p>«Ferries leave at six, nine and noon.»</p><p>«On Sundays the first one is at nine, and there is none after dark from October to March.»</p><p><a href="/fares">Fares</a> <a href="/map">Map</a></p></main><footer><a href="/i">Imprint</a></footer>""",
)


def test_the_tree_on_pages_it_has_not_seen():
    right = kept = main = 0
    for page in HELD_OUT:
        for text, features in html.blocks(page):
            words_, said, true = len(text.split()), html.verdict(html.trained(), features), "«" in text
            right, kept, main = right + words_ * (said and true), kept + words_ * said, main + words_ * true
    # Share of the words kept that are main text, and of the main text's words that are kept.
    print(right / kept, right / main)
    assert right / kept > 0.9 and right / main > 0.9, (right / kept, right / main)


def splits(tree):
    return {html.FEATURES[tree[0]], *splits(tree[2]), *splits(tree[3])} if isinstance(tree, tuple) else set()


def test_the_tree_goes_by_words_and_links():
    used = splits(html.trained())
    assert "links" in used and used & {"links_before", "links_after"} and used & {"words", "words_before", "words_after"}
    # Without a name of a zone on the page: short paragraphs among long ones stay, the first as well.
    page = "".join(f"<p>{'word ' * n}</p>" for n in (31, 31, 13, 31, 9, 31))
    assert [len(x.split()) for x in html.main_text(page).split("\n")] == [31, 31, 13, 31, 9, 31]
    assert html.main_text(f"<p><a href='x'>{'w ' * 40}</a></p><p><a href='y'>{'w ' * 30}</a></p>") == ""
    assert html.main_text('<article class="featured related"><p>Short one.</p><p>Some more text.</p></article>') == "Short one.\nSome more text."
    # The zone alone does not decide: a list of links in main text is none, and text may be where no zone is named.
    got = html.main_text("<article><h1>Head</h1><p>One two three.</p><p>" + "text " * 20 + "</p><ul><li><a href='1'>See this one too</a></li><li><a href='2'>And that other one</a></li></ul></article>")
    assert got == "Head\nOne two three.\n" + " ".join(["text"] * 20)


def test_features_of_blocks_by_hand():
    page = "<div>a b c</div><p>d <a href='x'>e f</a> g</p><article><h2><a>h</a></h2>i j</article><nav>k</nav>"
    found = [(text.split(), [int(x) for x in f[6:]]) for text, f in html.blocks(page)]
    assert found == [(["a", "b", "c"], [0, 0, 0]), (["d", "e", "f", "g"], [0, 0, 0]), (["h"], [1, 0, 1]), (["i", "j"], [1, 0, 0]), (["k"], [0, 1, 0])]
    own = [(3, 0.0), (4, 0.5), (1, 1.0), (2, 0.0), (1, 0.0)]
    for i, (_, f) in enumerate(html.blocks(page)):
        before, after = own[max(i - 1, 0)], own[min(i + 1, 4)]
        assert f[:6] == [before[0], own[i][0], after[0], before[1], own[i][1], after[1]]


def test_content_that_is_no_markup():
    def around(inside):
        return html.main_text(f"<article><p>Before</p>{inside}<p>Article</p></article><script>last()</script>")
    for inside in ("<script>for(i=0;i<n;i++){}</script>", "<script>var s = '<!--';</script>", "<style>a:after{content:'<!--'}</STYLE >",
                   "<SCRIPT>if(a<b){x='<script>'}</SCRIPT>", "<script>a<b</script><script>c<d</script>", "<template><script>i<n;</script></template>",
                   "<textarea>1 <b 2</textarea>", "<noscript><img src='a></noscript>", "<svg><svg><path d='a'/></svg><title>t</title></svg>",
                   "<script>x='</scripts>'</script>"):
        assert around(inside) == "Before\nArticle", inside
    assert around("<script>never ends") == "Before\nArticle" or around("<script>never ends") == "Before"


def test_extract(spark):
    pages = spark.createDataFrame([(1, "u", "<article><p>é 🙂</p></article>"), (1, "u", None), (None, None, "<article>" + "<p>word</p>" * 20_000)],
                                  "page_id long, url string, html string").withColumn("text", F.lit("clash")).withColumn("n_chars", F.lit(1))
    got = sorted((r.page_id or 0, r.text or "", r.n_chars) for r in html.extract(pages).collect())
    assert got == [(0, "\n".join(["word"] * 20_000), 99_999), (1, "", 0), (1, "é 🙂", 3)]
    assert html.extract(pages.where("false")).count() == 0


def test_foreign_records(tmp_path):
    def member(head, block=b""):
        press = zlib.compressobj(6, zlib.DEFLATED, 31)
        return press.compress(head.replace("\n", "\r\n").encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + press.flush()
    http = b"HTTP/1.1 200 OK\r\nA: b\r\n\r\n<p>x</p>"
    data = b"".join([
        member("WARC/1.0\nWARC-Type: warcinfo\nWARC-Record-ID: <urn:uuid:a>\nContent-Length: 3", b"a:b"),
        member("WARC/1.0\nwarc-type:response\nWARC-TARGET-URI: http://a/\nwarc-record-id: <urn:uuid:b>\ncontent-length: %d" % len(http), http),
        member("WARC/1.1\nWARC-Type: request\nContent-Length: 0"), member("WARC/1.1\nContent-Length: 0"), member("WARC/1.1\nWARC-Type: metadata"),
        member("WARC/1.1\nWARC-Type: revisit\nWARC-Payload-Digest: sha1:ABC\nWARC-Refers-To: <urn:uuid:b>\nContent-Length: 0"),
        member("WARC/1.1\nWARC-Type: resource\nContent-Length: 2", b"hi")])
    path = tmp_path / "x.warc.gz"
    path.write_bytes(data)
    with open(path, "rb") as f:
        got = list(warc.records_in(f, len(data), 0, len(data)))
    assert [(r["record_type"], r["page_id"], r["url"], r["payload_bytes"], r["payload"]) for r in got] == [
        ("warcinfo", None, None, None, None), ("response", None, "http://a/", 8, b"<p>x</p>"), ("request", None, None, None, None),
        ("revisit", None, None, None, None), ("resource", None, None, 2, b"hi")]
    assert got[3]["payload_digest"] == "ABC" and got[1]["payload_digest"] == warc.digest(b"<p>x</p>")


def test_ranges_are_read_by_many_tasks(spark):
    pages = spark.createDataFrame([(i, f"http://a/{i}", prose("en", 300, i)) for i in range(60)], "page_id long, url string, html string")
    archives = warc.write_warc(pages, archive_bytes=20_000)
    n = sum(-(-r.size // 2000) for r in archives.collect())
    assert n > 15 and warc.read_warc(archives, 2000).rdd.getNumPartitions() == n


def plain_rule(url):
    m = re.search(r"://([^/?#]*)([^?#]*)", url or "", re.S)
    host, path = (m[1].translate({c: c + 32 for c in range(65, 91)}), m[2]) if m else ("", "")
    fits = [(len(h + p), h + p, v) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fits)[1:] if fits else (None, None)


def test_urls(spark):
    good = [f"http://site{i}.example.org/en/{i + 2}" for i in range(2, 60)] + [f"https://m{i}.com/fr/{i}" for i in range(30)]
    bad = [f"http://cheap{i}.com/de/pills-{i}" for i in range(60)]
    odd = [None, "", "no scheme", "http://", "HTTP://EXAMPLE.ORG/es/x?y#z", "http://example.org/en/1#a", "x://org", "http://xorg/", "a://b://c.org/d",
           "http://cheap99.net/de/pills-99", "http://site99.example.net/en/77", "http://é.org/ü"]
    pages = spark.createDataFrame(list(enumerate(good + bad + odd)) + [(0, good[0]), (None, odd[5])], "page_id long, url string").withColumn("host", F.lit("clash"))
    got = urls.judged(pages)
    found = got.collect()
    assert len(found) == len(good + bad + odd) + 2
    for r in found:
        if r.page_id is None:
            continue
        host, path, (rule, verdict) = plain_rule((good + bad + odd)[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule) and r.verdict == (verdict or r.verdict) and r.verdict in ("allow", "block")
    by = {r.page_id: r for r in found}
    n = len(good + bad)
    assert by[n + 9].score < 0 < by[n + 10].score and by[n + 9].score < by[n + 10].score
    assert urls.judged(pages.where("false")).count() == 0


def test_interpolated_ratios_by_hand(spark):
    counted = spark.createDataFrame([("^^^^a", 3, 1), ("^^^ab", 2, 0), ("^^^a$", 1, 1), ("^^ab$", 2, 0)], "gram string, good long, bad long")
    wanted = spark.createDataFrame([(g,) for g in ("^^^^a", "^^^ab", "zzzzz", "^^^a$")], "gram string")
    got = {r.gram: r.ratio for r in urls.gram_ratios(counted, wanted).collect()}

    def p(gram, which):
        now = 1 / 256
        for k in range(5):
            tail, context = gram[4 - k:], gram[4 - k:4]
            uses = [(g, c[which]) for g, c in (("^^^^a", (3, 1)), ("^^^ab", (2, 0)), ("^^^a$", (1, 1)), ("^^ab$", (2, 0)))]
            n = sum(c for g, c in uses if g[4 - k:] == tail)
            total = sum(c for g, c in uses if g[4 - k:4] == context)
            kinds = len({g[4] for g, c in uses if c and g[4 - k:4] == context})
            now = (n + kinds * now) / (total + kinds) if total else now
        return now
    assert got == {g: round((math.log(p(g, 0)) - math.log(p(g, 1))) * 1e6) for g in got}


def test_pipeline(spark, docs, rows, tmp_path):
    root = str(tmp_path)
    docs.write.parquet(f"{root}/documents.parquet")
    item = [(1, " ".join((rows[7][1] or "").split()[5:25]))]
    spark.createDataFrame(item, "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    benchmark = spark.read.parquet(f"{root}/benchmark.parquet")
    now = spark.read.parquet(f"{root}/documents.parquet")
    names = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before, result = now, stage(spark, now, root)
        path = f"{root}/stage{k}"
        result.write.parquet(path)
        now = spark.read.parquet(path)
        if k < 3:
            assert [c for c in now.columns] == [c for c in names if c != "score" or k == -1] or set(now.columns) <= set(names)
        ids = collections.Counter(r.doc_id for r in now.select("doc_id").collect())
        if name == "language":
            assert ids == collections.Counter(i for i, t, _, _ in rows if any(c.isalpha() for c in t or ""))
        if name == "near_duplicates":
            assert max(ids.values()) == 1 and 5 in ids and not any(200 <= (i or 0) < 240 for i in ids)
        if name == "decontamination":
            assert 7 not in ids and ids == collections.Counter(r.doc_id for r in uncontaminated_rows(before, benchmark).select("doc_id").collect())
        if name == "mixing":
            assert set(ids) <= {r.doc_id for r in before.select("doc_id").collect()}
        if name == "sharding":
            assert ids == collections.Counter(r.doc_id for r in before.select("doc_id").collect())
    whole = corpus_pipeline.run(spark, root)
    assert collections.Counter((r.doc_id, r.shard, r.slot) for r in whole.collect()) == collections.Counter((r.doc_id, r.shard, r.slot) for r in now.collect())
    assert prose("en", 3, 1) and whole.columns == now.columns
