import collections
import hashlib

import numpy as np
import pytest
import xxhash

from firnline.llm import piecewise
from tests.llm.conftest import make_docs, prose


def plain_fingerprint(text):
    data = (text or "").encode()
    rolled = []
    for i in range(len(data)):
        h = 0
        for k in range(min(piecewise.WINDOW, i + 1)):
            h += xxhash.xxh32_intdigest(data[i - k:i - k + 1], 1) * piecewise.STEP ** k
        h %= 1 << 32
        h ^= h >> 15
        h = h * piecewise.SPREAD % (1 << 32)
        h ^= h >> 13
        rolled.append(h)

    def pieces(size):
        out, start = [], 0
        for i, h in enumerate(rolled):
            if h % size == 0 and len(out) < piecewise.PIECES - 1:
                out.append(data[start:i + 1])
                start = i + 1
        return out + [data[start:]] if data[start:] else out
    size = 2
    while size * piecewise.PIECES < len(data):
        size *= 2
    while size > 2 and sum(h % size == 0 for h in rolled) + 1 < piecewise.FEW:
        size //= 2
    letters = ["".join(piecewise.LETTERS[xxhash.xxh32_intdigest(p, 0) % 64] for p in pieces(s)) for s in (size, 2 * size)]
    return f"{size}:{letters[0]}:{letters[1]}"


def plain_likeness(a, b):
    def short(s):
        out = ""
        for c in s:
            if not (len(out) >= 3 and out[-3:] == c * 3):
                out += c
        return out

    def of(x, y):
        x, y = short(x), short(y)
        if not any(x[i:i + 7] in y for i in range(len(x) - 6)):
            return 0.0
        now = list(range(len(y) + 1))
        for i, c in enumerate(x):
            last, now = now, [i + 1]
            for j, d in enumerate(y):
                now.append(min(last[j + 1] + 1, now[j] + 1, last[j] + (0 if c == d else 2)))
        return 1 - now[-1] / (len(x) + len(y))
    if a == b:
        return 1.0
    sides = [(int(s), [x, y]) for s, x, y in (a.split(":"), b.split(":"))]
    common = [of(sides[0][1][i], sides[1][1][j]) for i in (0, 1) for j in (0, 1) if sides[0][0] << i == sides[1][0] << j]
    return max(common, default=0.0)


def test_fingerprint_by_hand(monkeypatch):
    texts = ["", None, "a", "ab", "é🙂" * 40, prose("en", 400, 1), prose("de", 3000, 2), "x" * 5000, "ab" * 900, prose("en", 20, 3)]
    want = [plain_fingerprint(t) for t in texts]
    assert [piecewise.fingerprint(t) for t in texts] == want
    monkeypatch.setattr(piecewise, "SLICE", 100)
    assert [piecewise.fingerprint(t) for t in texts] == want


def test_likeness_by_hand():
    r = np.random.default_rng(6)
    prints = [piecewise.fingerprint(prose("en", int(r.integers(1, 900)), i)) for i in range(12)]
    for i in range(12):
        text = prose("en", 300, 100 + i)
        prints += [piecewise.fingerprint(t) for t in (text, text[:900] + prose("en", 200, 200 + i), text[500:], "q" * 400 + text)]
    for a in prints:
        for b in prints:
            assert piecewise.likeness(a, b) == pytest.approx(plain_likeness(a, b))
            assert piecewise.likeness(a, b) == piecewise.likeness(b, a)


def test_likeness_follows_the_edit():
    words = [f"w{i}" for i in range(3000)]
    r = np.random.default_rng(7)
    own, other = " ".join(r.choice(words, 800)), " ".join(r.choice(words, 800))
    near = [piecewise.likeness(piecewise.fingerprint(own), piecewise.fingerprint(own[:k * len(own) // 8] + other[k * len(other) // 8:])) for k in range(9)]
    assert near[0] == 0 and near[8] == 1 and near[7] > 0.8 and 0.35 < near[4] < 0.7 and all(a <= b + 0.1 for a, b in zip(near, near[1:]))


def plain_rows(rows):
    """rows: (doc_id, text) in order."""
    out = []
    for k, (i, t) in enumerate(rows):
        t, after = t or "", rows[(k + 1) % len(rows)][1] or ""
        half = len(t) // 2
        edited = t[:len(t) - half] + after[:half]
        a, b, c = (piecewise.fingerprint(x) for x in (t, edited, after))
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), a, b, piecewise.likeness(a, b), piecewise.likeness(a, c)))
    return out


def test_edited_likeness(spark, rows, no_docs):
    # Ties of an id are in the order of the file, so these are written in one.
    plain = sorted([(i, t) for i, t, _, _ in rows], key=lambda r: (r[0] is None, r[0] or 0))
    docs = make_docs(spark, [(i, t, "en", "s") for i, t in plain]).coalesce(1)
    for parts in ("1", "4", "50"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        try:
            got = piecewise.edited_likeness(docs).collect()
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
        assert collections.Counter(tuple(r) for r in got) == collections.Counter(plain_rows(plain))
    assert piecewise.edited_likeness(no_docs).count() == 0
    one = make_docs(spark, [(3, "abcdef ghij", "en", "s")])
    assert [tuple(r) for r in piecewise.edited_likeness(one).collect()] == plain_rows([(3, "abcdef ghij")])
    marked = piecewise.with_fingerprints(docs, name="odd name.y")
    assert all(r["odd name.y"] == piecewise.fingerprint(r.text) for r in marked.collect())


def test_a_third_without_id(spark):
    texts = [prose("en", 30 + i % 7, i) for i in range(300)]
    docs = make_docs(spark, [(None if i % 3 == 0 else 1000 - i, t, "en", "s") for i, t in enumerate(texts)]).repartition(6)
    got = piecewise.edited_likeness(docs).collect()
    assert len(got) == 300 and sum(r.doc_id is None for r in got) == 100
    assert collections.Counter(r.fingerprint for r in got) == collections.Counter(piecewise.fingerprint(t) for t in texts)
    ids = sorted(i for i in (1000 - k for k in range(300) if k % 3))
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    for i, j in zip(ids, ids[1:]):
        own, after = texts[1000 - i], texts[1000 - j]
        half = len(own) // 2
        assert by[i].edited_sha256 == hashlib.sha256((own[:len(own) - half] + after[:half]).encode()).hexdigest()
