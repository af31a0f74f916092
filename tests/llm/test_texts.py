import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from firnline.llm import decontam, quality, simhash, substrings
from firnline.llm.windows import Words, letter_words, plain_words
from tests.llm.conftest import make_docs, prose

SPACE = re.compile(r"[\x20\x09-\x0D]+")
LETTER = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def words(text):
    return [w for w in SPACE.split(text or "") if w]


def base(text):
    w = words(text)
    triples = collections.defaultdict(list)
    for i in range(len(w) - 2):
        triples[tuple(w[i:i + 3])].append(i)
    covered = {i + k for v in triples.values() if len(v) > 1 for i in v for k in range(3)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered))


def test_base_counts(docs, rows):
    got = collections.Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
                              for r in quality.base_counts(docs).collect())
    assert got == collections.Counter((i, *base(t)) for i, t, _, _ in rows)


def test_quality_keeps_what_resembles_trusted_text(spark, no_docs):
    rows = [(i, prose("en", 80, i), "en", "s") for i in range(200)] + [(1000 + i, prose("de", 80, i).upper(), "de", "s") for i in range(20)]
    docs = make_docs(spark, rows + [(2000, None, None, None)])
    labels = spark.createDataFrame([(i, 1, 0) for i in range(0, 200, 2)] + [(1000, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.quality(docs, labels).collect()}
    assert len(got) == 221
    assert sum(got[i].kept for i in range(200)) >= 198 and not any(got[1000 + i].kept for i in range(20))
    assert got[2000].score is None and not got[2000].kept and got[2000].base_failed
    assert quality.quality(no_docs, labels).count() == 0
    # Without a trusted document only the base rules decide.
    assert all(r.kept != r.base_failed for r in quality.quality(docs, labels.where("false")).collect())


def plain_scores(texts, copies, trusted):
    """Mean log ratio of each text; text i occurs copies[i] times, trusted[i] of them are trusted."""
    def cells(text):
        c = [zlib.crc32(w.encode()) for w in words(text)]
        return [x % quality.BUCKETS for x in c] + [(x * 31 + y + 7) % quality.BUCKETS for x, y in zip(c, c[1:])]
    raw, good = collections.Counter(), collections.Counter()
    for text, n, g in zip(texts, copies, trusted):
        for cell in cells(text):
            raw[cell] += n
            good[cell] += g
    share = lambda c, cell: math.log((c[cell] + 1) / (sum(c.values()) + quality.BUCKETS))
    llr = {cell: round((share(good, cell) - share(raw, cell)) * 1e6) for cell in raw}
    return [sum(llr[c] for c in cells(t)) / (len(cells(t)) * 1e6) for t in texts]


@pytest.mark.parametrize("broadcast", ["10m", "-1"])
def test_quality_is_fitted_on_all_trusted_documents(spark, broadcast):
    # 24,000 trusted documents; text 1 is that of the 4,000 with the largest hashes, text 2 of 500 raw documents.
    texts = [" ".join(f"{kind}{i}" for i in range(50)) for kind in ("plain", "late", "junk")]
    ranked = sorted(range(24_000), key=lambda i: zlib.crc32(str(i).encode()))
    late = spark.createDataFrame([(i,) for i in ranked[20_000:]], "doc_id long").withColumn("late", F.lit(1))
    pick = F.when(F.col("doc_id") >= 24_000, 2).otherwise(F.coalesce("late", F.lit(0)))
    docs = spark.range(24_500).withColumnRenamed("id", "doc_id").join(late, "doc_id", "left").select(
        "doc_id", F.get(F.array(*map(F.lit, texts)), pick).alias("text"))
    labels = spark.range(24_000).select(F.col("id").cast("int").alias("doc_id"), F.lit(1).alias("quality"), F.lit(0).alias("toxic"))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        got = quality.quality(docs, labels).groupBy("score", "kept").count().collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    scores = plain_scores(texts, [20_000, 4_000, 500], [20_000, 4_000, 0])
    assert sorted((r["count"], r.score, r.kept) for r in got) == [
        (500, pytest.approx(scores[2]), False), (4_000, pytest.approx(scores[1]), True), (20_000, pytest.approx(scores[0]), True)]


def test_threshold_is_exact(spark):
    values = list(np.random.default_rng(3).normal(0, 1, 1999)) + [0.25] * 1002
    df = spark.createDataFrame([(float(v), i) for i, v in enumerate(values)], "score double, doc_id long").repartition(5)
    for share in (0.0, 0.002, 0.3337, 1.0):
        assert quality.least_score(df, share) == pytest.approx(2 * np.quantile(values, share) - np.median(values), rel=1e-12)
    # Between two equal scores the threshold is that score; rounding must not lift it above.
    same = df.withColumn("score", F.lit(-0.1))
    assert {quality.least_score(same.where(f"doc_id < {n}"), p) for n in (1, 2, 6, 3000) for p in (0.002, 0.1, 0.7)} == {-0.1}
    assert quality.least_score(df.where("false")) is None


def plain_fingerprint(text):
    w = words((text or "").translate(LOWER))
    grams = [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    ones = [0] * 64
    for g in grams:
        h = xxhash.xxh64_intdigest(g.encode(), 42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(grams))


def plain_components(marked):
    prints = sorted({f for _, f in marked})
    up = {f: f for f in prints}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x
    for i, a in enumerate(prints):
        for b in prints[i + 1:]:
            if (a ^ b).bit_count() <= 2:
                up[max(root(a), root(b))] = min(root(a), root(b))
    least = {}
    for i, f in marked:
        if i is not None:
            least[root(f)] = min(i, least.get(root(f), i))
    return [(i, f"{f:016x}", least.get(root(f))) for i, f in marked]


def test_near_duplicates(docs, rows, no_docs):
    got = collections.Counter(tuple(r) for r in simhash.near_duplicates(docs).select("doc_id", "fingerprint", "component_id").collect())
    assert got == collections.Counter(plain_components([(i, plain_fingerprint(t)) for i, t, _, _ in rows]))
    assert simhash.near_duplicates(no_docs).count() == 0


def test_golay_keys_lose_no_link():
    rng = np.random.default_rng(5)
    fps = rng.integers(-(1 << 63), 1 << 63, 400, np.int64)
    keys = simhash.keys_of(fps)
    for _ in range(40):
        a, b = rng.integers(0, 64, 2)
        other = (fps.view(np.uint64) ^ np.uint64(1 << int(a)) ^ np.uint64((1 << int(b)) if b != a else 0)).view(np.int64)
        met = keys[:, :, None] == simhash.keys_of(other)[:, None, :]
        assert (met & (keys[:, :, None] >= 0)).any((1, 2)).all()
    assert len(np.unique(simhash.decode(np.arange(1 << 23, dtype=np.uint32)), return_counts=True)[1]) == 4096


def test_links_in_a_large_group(spark):
    # A ball of neighbours around one point: every pair is 2 bits apart, far more of them share a key than are compared pairwise.
    ball = [1 << b for b in range(63)] + [3 << b for b in range(60)] + [5 << b for b in range(60)] + [0, -1]
    fps = spark.createDataFrame([(f,) for f in sorted(set(ball))], "fp long")
    old, simhash.PAIRWISE = simhash.PAIRWISE, 8
    try:
        edges = simhash.links(fps)
        found = {r.node: r.root for r in simhash.components(edges).collect()}
    finally:
        simhash.PAIRWISE = old
    assert -1 not in found and len(set(found.values())) == 1 and len(found) == len(set(ball)) - 1
    assert all(0 < ((r.a ^ r.b) & (1 << 64) - 1).bit_count() <= 2 for r in edges.collect())


def test_keep_first(docs, rows):
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    found = plain_components([(i, plain_fingerprint(t)) for i, t, _, _ in rows])
    assert collections.Counter(r.doc_id for r in kept.collect()) == collections.Counter({c for i, _, c in found if i == c})


def plain_repeats(rows):
    first = {}
    for i, t, _, _ in rows:
        w = words(t)
        for k in range(len(w) - 12):
            if i is not None:
                first[tuple(w[k:k + 13])] = min(i, first.get(tuple(w[k:k + 13]), i))
    out = []
    for i, t, _, _ in rows:
        w = words(t)
        gone = {k + j for k in range(len(w) - 12) if i is not None and first[tuple(w[k:k + 13])] < i for j in range(13)}
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return collections.Counter(out)


def test_repeats(docs, rows, no_docs):
    got = substrings.digest(substrings.without_repeats(docs))
    assert collections.Counter(tuple(r) for r in got.collect()) == plain_repeats(rows)
    assert substrings.without_repeats(no_docs).count() == 0


def test_a_full_sketch_loses_nothing(docs, rows):
    # So few cells that nearly every window is taken for repeated.
    old = substrings.MIN_CELLS, substrings.MAX_CELLS, substrings.GATHER
    substrings.MIN_CELLS = substrings.MAX_CELLS = 64
    try:
        got = substrings.digest(substrings.without_repeats(docs)).collect()
    finally:
        substrings.MIN_CELLS, substrings.MAX_CELLS, substrings.GATHER = old
    assert collections.Counter(tuple(r) for r in got) == plain_repeats(rows)


def plain_contamination(rows, items):
    windows = collections.defaultdict(set)
    for item, t in items:
        w = LETTER.findall((t or "").translate(LOWER))
        n = min(10, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[i:i + n])].add(item)
    sizes = {len(w) for w in windows}
    out = []
    for i, t, _, _ in rows:
        w = LETTER.findall((t or "").translate(LOWER))
        hit, of = set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if found := windows.get(tuple(w[k:k + n])):
                    hit.update(range(k, k + n))
                    of.update(found)
        names = ",".join(sorted(str(x) for x in of if x is not None))
        out.append((i, len(w), len(hit), len([x for x in of if x is not None]), hashlib.sha256(names.encode()).hexdigest(), bool(hit)))
    return collections.Counter(out)


def test_contamination(spark, docs, rows, no_docs):
    items = [(1, " ".join(words(rows[3][1])[10:30])), (2, " ".join(words(rows[3][1])[12:24]).upper()), (3, "Null, ID -- text"), (4, None), (5, ""),
             (6, "nothing of this is in any of the documents at all anywhere"), (7, "fluss wasser"), (8, "same"), (9, "same"), (10, prose("en", 40, 999))]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = collections.Counter(tuple(r) for r in decontam.contamination(docs, benchmark).collect())
    assert got == plain_contamination(rows, items)
    clean = decontam.uncontaminated_rows(docs, benchmark)
    assert clean.columns == docs.columns and clean.count() == sum(n for r, n in plain_contamination(rows, items).items() if not r[-1])
    assert decontam.contamination(no_docs, benchmark).count() == 0
    assert decontam.contamination(docs, benchmark.where("false")).where("contaminated or n_items > 0").count() == 0


def test_a_third_without_id_is_judged_row_by_row(spark):
    texts = [prose("en", 60, 900 + i) for i in range(30)]
    rows = [(None if i % 3 == 0 else i % 5, t, "en", "s") for i, t in enumerate(texts)]
    items = [(i, " ".join(texts[i].split()[5:25])) for i in (3, 4, 9, 10)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = decontam.contamination(make_docs(spark, rows).repartition(3), benchmark).collect()
    assert collections.Counter(tuple(r) for r in got) == plain_contamination(rows, items)
    assert sum(r.contaminated for r in got) == 4 and all(r.n_hit <= r.n_words for r in got)


def test_words_of_a_batch():
    texts = ["a bb  ccc\n", "", "Ä-b c", " x " * 5]
    clean = [plain_words(t.encode()) for t in texts]
    w = Words(clean)
    assert w.counts.tolist() == [3, 0, 2, 5] and w.left.tolist() == [3, 2, 1, 2, 1, 5, 4, 3, 2, 1]
    two = w.hashes(2)
    assert two[5] == two[6] == two[8] and two[0] != two[1] and Words([b"bb ccc"]).hashes(2)[0] == two[1]
    assert letter_words("A1-é,B".encode()) == "a1 é b".encode()


def test_hashes_of_structured_words():
    # A Thue-Morse word and its complement have equal polynomial hashes modulo a power of two, whatever the base is.
    morse = "".join("ab"[i.bit_count() % 2] for i in range(2048))
    other = morse.translate({97: 98, 98: 97})
    tail = [f"t{i}" for i in range(12)]
    a, b = (Words([" ".join([w, *tail]).encode()]) for w in (morse, other))
    assert a.hashes(13)[0] != b.hashes(13)[0] and a.second(13)[0] != b.second(13)[0]
    # The same in words.
    x, y = (Words([" ".join(w[:13]).encode()]) for w in (morse, other))
    assert x.hashes(13)[0] != y.hashes(13)[0]
    r = np.random.default_rng(1)
    texts = {" ".join(r.choice(["a", "b", "aa", "ab", "", "\x01"], 3)) for _ in range(4000)}
    words_ = [" ".join(t.split()) for t in texts]
    distinct = {t for t in words_ if t.count(" ") == 2}
    found = {int(Words([t.encode()]).hashes(3)[0]) for t in distinct}
    assert len(found) == len(distinct)


def test_windows_that_only_differ_in_a_structured_word_stay(spark):
    morse = "".join("ab"[i.bit_count() % 2] for i in range(2048))
    other, tail = morse.translate({97: 98, 98: 97}), " ".join(f"t{i}" for i in range(12))
    rows = [(1, f"{morse} {tail}", "en", "s"), (2, f"{other} {tail}", "en", "s"), (3, f"{other} {tail}", "en", "s")]
    got = substrings.digest(substrings.without_repeats(make_docs(spark, rows)))
    assert collections.Counter(tuple(r) for r in got.collect()) == plain_repeats(rows)


def test_winnowing_finds_every_long_span():
    rng = np.random.default_rng(3)
    for t in range(1, 11):
        shared = [f"w{x}" for x in rng.integers(0, 9, t)]
        kept = set()
        for _ in range(2):
            around = [[f"v{x}" for x in rng.integers(0, 5, 12)] for _ in range(2)]
            found = decontam.winnow(Words([" ".join(around[0] + shared + around[1]).encode()]), t)[1]
            kept = kept & set(found.tolist()) if kept else set(found.tolist())
        assert kept


def test_null_text_is_clean(spark):
    one = make_docs(spark, [(1, None, None, None)])
    got = decontam.contamination(one, spark.createDataFrame([(1, "a b")], "item_id long, text string")).first()
    assert (got.n_words, got.contaminated) == (0, False) and got.items_sha256 == hashlib.sha256(b"").hexdigest()
    assert one.select(F.col("text")).first()[0] is None


def edited(text, places):
    w = text.split()
    for p in places:
        w[p] = f"edit{p}"
    return " ".join(w)


def test_keep_first_keeps_one_row_of_each_component(spark):
    r = np.random.default_rng(8)
    texts = [" ".join(f"w{x}" for x in r.integers(0, 5000, 600)) for _ in range(40)]
    rows = list(enumerate(texts))
    # Edits of few words flip few bits; chains of edits connect by their links.
    for i in range(40):
        rows += [(100 + i, edited(texts[i], [50])), (200 + i, edited(texts[i], [20, 580])), (300 + i, edited(texts[i], range(0, 600, 20)))]
    chain = texts[0]
    for k in range(6):
        chain = edited(chain, [90 * k + 8])
        rows.append((400 + k, chain))
    found = plain_components([(i, plain_fingerprint(t)) for i, t in rows])
    least = {c for _, _, c in found}
    assert 60 <= len(least) < 160
    got = simhash.keep_first(make_docs(spark, [(i, t, "en", "s") for i, t in rows]).repartition(4))
    assert sorted(x.doc_id for x in got.collect()) == sorted(least)


@pytest.mark.parametrize("bits", [1, 2])
def test_links_at_fewer_bits(spark, bits):
    r = np.random.default_rng(bits)
    centres = r.integers(-(1 << 62), 1 << 62, 30)
    near = {int(c) ^ (1 << int(i)) ^ (1 << int(j)) for c in centres for i, j in r.integers(0, 62, (6, 2))} | {int(c) for c in centres}
    fps = spark.createDataFrame([(f,) for f in sorted(near)], "fp long")
    close = {(a, b) for a in near for b in near if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= bits}
    for pairwise in (64, 1):
        old, simhash.PAIRWISE = simhash.PAIRWISE, pairwise
        try:
            edges = {(x.a, x.b) for x in simhash.links(fps, bits).collect()}
        finally:
            simhash.PAIRWISE = old
        assert edges <= close and (pairwise == 1 or edges == close)
        whole = None
        for links in (close, edges):
            parts = {f: {f} for f in near}
            for a, b in links:
                if parts[a] is not parts[b]:
                    parts[a] |= parts[b]
                    for x in parts[b]:
                        parts[x] = parts[a]
            groups = {frozenset(x) for x in parts.values()}
            assert whole is None or groups == whole
            whole = groups


def test_rows_without_or_with_one_id_are_rows_of_their_own(spark):
    texts = [prose("en", 60, 40 + i) for i in range(6)]
    rows = [(None, t) for t in texts[:3]] + [(7, t) for t in texts[3:]] + [(None, texts[0]), (9, texts[1]), (None, texts[5])]
    docs = make_docs(spark, [(i, t, "en", "s") for i, t in rows]).repartition(3)
    kept = simhash.keep_first(docs).collect()
    assert collections.Counter((r.doc_id, r.text) for r in kept) == collections.Counter(
        [(None, texts[0]), (9, texts[1]), (None, texts[2]), (7, texts[3]), (7, texts[4]), (7, texts[5])])
    benchmark = spark.createDataFrame([(1, " ".join(texts[2].split()[5:25])), (2, " ".join(texts[4].split()[5:25]))], "item_id long, text string")
    clean = decontam.uncontaminated_rows(docs, benchmark)
    assert clean.columns == docs.columns
    assert collections.Counter((r.doc_id, r.text) for r in clean.collect()) == collections.Counter(x for x in rows if x[1] not in (texts[2], texts[4]))
