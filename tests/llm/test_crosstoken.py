import collections
import hashlib

import numpy as np
import pytest

from firnline.llm import crosstoken
from tests.llm.conftest import make_docs, prose

ODD = ["", None, " ", "  two  spaces \n\n\t tab", "▁ mark ▁x", "<|endoftext|> and <s> </s> <unk> <0x41>", "é🙂ü ß İ x y", "\x00 zero", "naïve don't we'll 12345",
       "a" * 3000, " " * 3000, "ab" * 2000, "日本語の文", "line\r\nline", "ﬁ ligature ½ ①", "﻿bom", "é combining"]


@pytest.fixture(scope="module")
def sides():
    import sentencepiece
    from tokenizers import Tokenizer
    a = Tokenizer.from_file(crosstoken.BYTE_BPE)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=crosstoken.PIECE_BPE)


def plain_tokens(sides, text):
    """[(id, bytes)] of both sides, by the libraries' own means."""
    if not text:
        return [], []
    a, b = sides
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    back, k = {chr(i): i for i in plain}, 0
    for i in range(256):
        if i not in plain:
            back[chr(256 + k)] = i
            k += 1
    left = [(i, bytes(back[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
    right = []
    for i in b.encode(text):
        p = b.id_to_piece(i)
        right.append((i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()))
    whole = (" " + text).encode()
    return (left, right) if b"".join(x for _, x in left) == whole == b"".join(x for _, x in right) else ([], [])


def plain_alignment(sides, rows):
    links, out = [], []
    for _, text in rows:
        left, right = plain_tokens(sides, text)
        spans = []
        for side in (left, right):
            at, found = 0, []
            for i, piece in side:
                found.append((i, at, at + len(piece)))
                at += len(piece)
            spans.append(found)
        links.append([(a, b) for a, s, e in spans[0] for b, u, v in spans[1] if s < v and u < e] if len(left) < 800 else
                     [(a, b) for a, s, e in spans[0] for b, u, v in spans[1][max(0, s // 16 - 5):] if s < v and u < e])
        common = sorted({e for _, _, e in spans[0]} & {e for _, _, e in spans[1]})
        groups, start = [], 0
        for end in common:
            groups.append("|".join(",".join(str(i) for i, s, e in side if start <= s and e <= end) for side in spans) if len(left) < 9000 else "")
            start = end
        out.append((len(left), len(right), len(common), hashlib.sha256(";".join(groups).encode()).hexdigest() if left else ""))
    count = collections.Counter(x for found in links for x in found)
    most = collections.defaultdict(int)
    for (_, b), n in count.items():
        most[b] = max(most[b], n)
    return [(i, *o[:3], len(f), sum(count[x] == most[x[1]] for x in f), sum(count[x] for x in f), o[3]) for (i, _), o, f in zip(rows, out, links)], count, links


def test_encoders_agree(sides):
    fast = crosstoken.ByteLevel(crosstoken._read(crosstoken.BYTE_BPE))
    r = np.random.default_rng(9)
    texts = [t for t in ODD if t] + [prose("de", 200, i) for i in range(5)]
    texts += ["".join(chr(c) for c in r.integers(0, 0x3000, 200)) for _ in range(60)] + ["".join(r.choice(list("ab 1.\n'sé🙂 "), 80)) for _ in range(200)]
    for t in texts:
        assert fast.encode(t) == sides[0].encode(t, add_special_tokens=False).ids == fast.encode_slowly(t)
    assert b"".join(fast.pieces[i] for i in fast.encode("é🙂 \x00")) == "é🙂 \x00".encode()


def test_sets():
    r = np.random.default_rng(1)
    for n in (0, 1, 511, 512, 513, 8192):
        a, b = np.sort(r.choice(8192, n, False)), np.sort(r.choice(8192, n, False))
        assert crosstoken.unpack(crosstoken.pack(a)).tolist() == a.tolist() and len(crosstoken.pack(a)) == min(2 * n, 1024)
        assert crosstoken.unpack(crosstoken.merged([crosstoken.pack(a), crosstoken.pack(b)])).tolist() == sorted({*a.tolist(), *b.tolist()})


@pytest.mark.parametrize("gather", [4_000_000, 500])
def test_alignment(spark, sides, rows, no_docs, gather, monkeypatch):
    plain = [(i, t) for i, t, _, _ in rows if i != 306] + [(400 + k, t) for k, t in enumerate(ODD)] + [(500, "again " * 40)] + [(None, "no id")] * 3
    docs = make_docs(spark, [(i, t, "en", "s") for i, t in plain]).repartition(3)
    monkeypatch.setattr(crosstoken, "GATHER", gather)
    monkeypatch.setattr(crosstoken, "PIECE_BYTES", 3000)
    got, scores = crosstoken.aligned(docs)
    want, count, links = plain_alignment(sides, plain)
    assert collections.Counter(tuple(r) for r in got.collect()) == collections.Counter(want)
    found = {(r.a_id, r.b_id): (r.n_docs, r["count"]) for r in scores.collect()}
    docs_of = collections.Counter(x for f in links for x in set(f))
    assert found == {x: (docs_of[x], n) for x, n in count.items()}
    if gather == 500:
        return
    assert crosstoken.alignment(no_docs).count() == 0
    nothing = crosstoken.alignment(make_docs(spark, [(1, None, None, None), (1, "", "en", "s")])).collect()
    assert [tuple(r) for r in nothing] == [(1, 0, 0, 0, 0, 0, 0, "")] * 2
    crosstoken.BROADCAST_PAIRS, old = 0, crosstoken.BROADCAST_PAIRS
    try:
        assert collections.Counter(tuple(r) for r in crosstoken.alignment(docs).collect()) == collections.Counter(want)
    finally:
        crosstoken.BROADCAST_PAIRS = old


def test_planes_hold_multiplicities():
    rows = np.array([5, 6, 8192 * 3 + 1])
    doc = np.array([0] * 9 + [1] * 4 + [2] * 2)
    pair = np.array([7 << 32 | 1] * 8 + [9 << 32 | 2] + [7 << 32 | 1] * 4 + [7 << 32 | 1] * 2)
    found = collections.Counter()
    for batch in crosstoken._planes(rows, doc, pair):
        for r in batch.to_pylist():
            for p in crosstoken.unpack(r["rows"]).tolist():
                found[r["pair"] >> 32, r["pair"] & 0xFFFFFFFF, (r["block"] << crosstoken.BLOCK) + p] += 1 << max(0, r["plane"] - 1)
    assert found == {(7, 1, 5): 8, (9, 2, 5): 1, (7, 1, 6): 4, (7, 1, 8192 * 3 + 1): 2}
