"""Alignment of two tokenizers over a corpus, with pair counts from inverted bitmaps."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firnline.llm.rows import with_row_key
from firnline.llm.text import col
from firnline.session import bound_batches, cut_lineage

BYTE_BPE = "/opt/tokenizers/byte_bpe_50k.json"
PIECE_BPE = "/opt/tokenizers/piece_bpe_32k.model"
#: Bits of a row number within its block of documents. A bitmap of a block has 2^BLOCK bits; sets of fewer rows than
#: fill half of it as 16-bit numbers are kept as those.
BLOCK = 13
_WIDE = (1 << BLOCK) // 8
#: Text bytes aligned at a time, and links gathered before their bitmaps are made.
PIECE_BYTES, GATHER = 1 << 20, 4_000_000
#: Pairs whose scores are broadcast at most (some 24 bytes each); more are joined by a shuffle.
BROADCAST_PAIRS = 2_000_000

# Fixed value: how the byte-level tokenizer splits a text.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Bytes that stand for themselves as characters of a byte-level token; the others follow from 256 on.
_PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]


def _byte_of_character() -> dict[str, int]:
    rest = [b for b in range(256) if b not in _PLAIN]
    return {chr(b): b for b in _PLAIN} | {chr(256 + k): b for k, b in enumerate(rest)}


class ByteLevel:
    """A byte-level BPE tokenizer given as JSON. ``pieces`` has the bytes of each id.

    Ids follow the order of merges, so the vocabulary serves as ranks for a
    faster encoder; texts that one cannot take go to the slower.
    """

    def __init__(self, data: bytes):
        import tiktoken
        model = json.loads(data)
        merges = [m if isinstance(m, str) else " ".join(m) for m in model["model"]["merges"]]
        vocabulary = model["model"]["vocab"]
        if model["pre_tokenizer"]["type"] != "ByteLevel" or model["pre_tokenizer"]["add_prefix_space"] or model.get("normalizer"):
            raise ValueError("not a plain byte-level tokenizer")
        if any(vocabulary[m.replace(" ", "")] != 256 + k for k, m in enumerate(merges)):
            raise ValueError("ids do not follow the order of merges")
        of = _byte_of_character()
        special = {t["content"] for t in model["added_tokens"]}
        ranks = {bytes(of[c] for c in t): i for t, i in vocabulary.items() if t not in special}
        self.pieces = [b""] * (max(vocabulary.values()) + 1)
        for t, i in ranks.items():
            self.pieces[i] = t
        self._fast = tiktoken.Encoding("byte level", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        self._data, self._slow = data, None

    def encode(self, text: str) -> list[int]:
        try:
            return self._fast.encode_ordinary(text)
        except Exception:  # the pattern's engine gives up on very long runs of white space
            return self.encode_slowly(text)

    def encode_slowly(self, text: str) -> list[int]:
        if self._slow is None:
            from tokenizers import Tokenizer
            self._slow = Tokenizer.from_str(self._data.decode())
            self._slow.encode_special_tokens = True
        return self._slow.encode(text, add_special_tokens=False).ids


class Pieces:
    """A sentence-piece model. ``pieces`` has the bytes of each id, the mark of a word as a space."""

    def __init__(self, data: bytes):
        import sentencepiece
        self._model = sentencepiece.SentencePieceProcessor(model_proto=data)
        n = self._model.get_piece_size()
        names = [self._model.id_to_piece(i) for i in range(n)]
        self.pieces = [bytes([int(t[3:5], 16)]) if self._model.is_byte(i) else t.replace("▁", " ").encode() for i, t in enumerate(names)]

    def encode(self, text: str) -> list[int]:
        return self._model.encode(text, num_threads=1)


@lru_cache(2)
def _aligner(a: bytes, b: bytes) -> Aligner:
    return Aligner(ByteLevel(a), Pieces(b))


class Aligner:
    """Groups and links of the tokens of two tokenizers, for many texts at a time."""

    def __init__(self, a, b):
        self.a, self.b = a, b
        if max(len(a.pieces), len(b.pieces)) > 1 << 25:
            raise ValueError("ids of more than 25 bits")
        self._size = [np.array([len(p) for p in t.pieces], np.int64) for t in (a, b)]
        # Numbers with what follows them: a comma, a bar between the sides, a semicolon between groups, nothing.
        most = max(len(a.pieces), len(b.pieces))
        self._names = [f"{i}{end}".encode() for end in (",", "|", ";", "") for i in range(most)]
        self._most = most

    def tokens(self, text: str | None) -> tuple[list[int], list[int]]:
        """Ids of both sides; none if the text is empty or a side's bytes are not those of the text behind a space."""
        if text:
            data = b" " + text.encode()
            a = self.a.encode(" " + text)
            if b"".join([self.a.pieces[i] for i in a]) == data:
                b = self.b.encode(text)
                if b"".join([self.b.pieces[i] for i in b]) == data:
                    return a, b
        return [], []

    def align(self, texts: list) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
        """Counts and group digests of each text; and text number, a id and b id of each link.

        Both sides of all texts are laid end to end. Between two ends of tokens
        that follow each other lies a part of one a and one b token: a link.
        Ends of both sides end a group.
        """
        found = [self.tokens(t) for t in texts]
        ids = [np.array([i for f in found for i in f[side]], np.int64) for side in (0, 1)]
        n = [np.array([len(f[side]) for f in found], np.int64) for side in (0, 1)]
        if not len(ids[0]):
            none = np.zeros(len(texts), np.int64)
            return {"n_a": none, "n_b": none, "n_groups": none, "n_links": none, "groups": [""] * len(texts)}, *(np.zeros(0, np.int64) for _ in range(3))
        ends = [np.cumsum(self._size[side][ids[side]]) for side in (0, 1)]
        last = np.cumsum(n[0])
        stop = np.where(last > 0, ends[0][last - 1], 0)  # byte at which each text ends
        common = np.intersect1d(*ends, assume_unique=True)
        every = np.union1d(*ends)
        doc = np.searchsorted(stop, every)
        at = [np.searchsorted(e, every) for e in ends]
        groups = np.diff(np.searchsorted(common, stop, "right"), prepend=0)
        links = np.bincount(doc, minlength=len(texts))
        counts = {"n_a": n[0], "n_b": n[1], "n_groups": groups, "n_links": links, "groups": self._digests(ids, ends, common, n)}
        return counts, doc, ids[0][at[0]], ids[1][at[1]]

    def _digests(self, ids: list, ends: list, common: np.ndarray, n: list) -> list[str]:
        group = [np.searchsorted(common, e) for e in ends]
        first = [np.concatenate([[0], np.searchsorted(e, common, "right")]) for e in ends]  # token at which each group starts
        order = np.empty(len(ids[0]) + len(ids[1]), np.int64)
        close = [np.zeros(len(i), bool) for i in ids]  # the last token of its side in a group
        for c, f in zip(close, first):
            c[f[1:] - 1] = True
        place = [np.arange(len(ids[0])) + first[1][group[0]], np.arange(len(ids[1])) + first[0][group[1] + 1]]
        order[place[0]] = ids[0] + np.where(close[0], self._most, 0)
        order[place[1]] = ids[1] + np.where(close[1], 2 * self._most, 0)
        stops = np.cumsum(n[0] + n[1])
        some = np.flatnonzero(n[0])
        order[stops[some] - 1] += self._most  # nothing behind the last one
        names = self._names
        out = [""] * len(n[0])
        for i in some.tolist():
            out[i] = hashlib.sha256(b"".join([names[k] for k in order[stops[i] - n[0][i] - n[1][i]:stops[i]].tolist()])).hexdigest()
        return out


def pack(places: np.ndarray) -> bytes:
    """A set of row numbers of a block: ascending 16-bit numbers, or a bit for each row of the block if that is shorter."""
    if 2 * len(places) < _WIDE:
        return places.astype("<u2").tobytes()
    bits = np.zeros(1 << BLOCK, bool)
    bits[places] = True
    return np.packbits(bits, bitorder="little").tobytes()


def unpack(data: bytes) -> np.ndarray:
    if len(data) < _WIDE:
        return np.frombuffer(data, "<u2").astype(np.int64)
    return np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little"))


def merged(sets: list[bytes]) -> bytes:
    """Union of sets of one block."""
    hit = np.zeros(1 << BLOCK, bool)
    for s in sets:
        hit[unpack(s)] = True
    return pack(np.flatnonzero(hit))


def sizes(sets: pa.Array) -> np.ndarray:
    """Rows in each set."""
    wide = sets.cast(pa.binary()).to_pylist()
    return np.array([len(s) // 2 if len(s) < _WIDE else int.from_bytes(s).bit_count() for s in wide], np.int64)


_BITS = pa.schema([("pair", pa.int64()), ("block", pa.int64()), ("plane", pa.int32()), ("rows", pa.binary())])
_DOCS = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()),
                   ("groups_sha256", pa.string())])
_BOTH = pa.schema([*_DOCS, *_BITS])


def _planes(rows: np.ndarray, doc: np.ndarray, pair: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Bitmaps of links by pair and block of documents: plane 0 has the rows with such a link, plane k those whose further links have bit k - 1."""
    of, low = rows >> BLOCK, rows & ((1 << BLOCK) - 1)
    for block in np.unique(of).tolist():
        mine = (of == block)[doc]
        key, times = _counted(pair[mine], low[doc[mine]])
        more, plane = times - 1, 0
        while plane == 0 or (more >> (plane - 1)).any():
            chosen = key if plane == 0 else key[(more >> (plane - 1) & 1).astype(bool)]
            if len(chosen):
                yield _sets(chosen, block, plane)
            plane += 1


def _counted(pair: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs and rows as one number, the row in its last BLOCK bits, and how often they are met."""
    key = (pair >> 32) << (BLOCK + 25) | (pair & ((1 << 32) - 1)) << BLOCK | low
    key.sort()
    starts = np.flatnonzero(np.diff(key, prepend=-1))
    return key[starts], np.diff(np.append(starts, len(key)))


def _sets(key: np.ndarray, block: int, plane: int) -> pa.RecordBatch:
    own, place = key >> BLOCK, (key & ((1 << BLOCK) - 1)).astype("<u2")
    starts = np.flatnonzero(np.diff(own, prepend=-1))
    cuts = np.append(starts, len(own))
    lists = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer((2 * cuts).astype(np.int32).tobytes()), pa.py_buffer(place.tobytes())])
    wide = 2 * np.diff(cuts) >= _WIDE
    if wide.any():
        bits = [pack(place[a:b]) if w else None for a, b, w in zip(cuts[:-1].tolist(), cuts[1:].tolist(), wide.tolist())]
        lists = pc.coalesce(pa.array(bits, pa.binary()), lists)
    pair = own[starts] >> 25 << 32 | own[starts] & ((1 << 25) - 1)
    return pa.RecordBatch.from_arrays([pa.array(pair), pa.array(np.full(len(starts), block)), pa.array(np.full(len(starts), plane, np.int32)), lists], schema=_BITS)


def _aligned(shared):
    """For each document its counts, and bitmaps of the pairs of its links."""
    def fill(batch: pa.RecordBatch) -> pa.RecordBatch:
        have = dict(zip(batch.schema.names, batch.columns))
        return pa.RecordBatch.from_arrays([have.get(f.name, pa.nulls(batch.num_rows, f.type)) for f in _BOTH], schema=_BOTH)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        align = _aligner(*shared.value).align
        held, size = [], 0

        def flush():
            rows = np.concatenate([h[0] for h in held])
            first = np.cumsum([0, *(len(h[0]) for h in held)])
            doc = np.concatenate([h[1] + f for h, f in zip(held, first)])
            for batch in _planes(rows, doc, np.concatenate([h[2] for h in held])):
                yield fill(batch)

        for part in parts:
            numbers = part.column("row").to_numpy()
            start, texts, waiting = 0, [], 0
            for i, t in enumerate(part.column("text")):
                texts.append(t.as_py())
                waiting += len(texts[-1] or "")
                if waiting >= PIECE_BYTES or i + 1 == part.num_rows:
                    counts, doc, a, b = align(texts)
                    rows = numbers[start:i + 1]
                    docs = pa.RecordBatch.from_arrays([pa.array(rows), part.column("doc_id").slice(start, len(rows)), *(pa.array(counts[n]) for n in
                                                      ("n_a", "n_b", "n_groups", "n_links")), pa.array(counts["groups"], pa.string())], schema=_DOCS)
                    yield fill(docs)
                    held.append((rows, doc, a << 32 | b))
                    size += len(doc)
                    start, texts, waiting = i + 1, [], 0
                if size >= GATHER:
                    yield from flush()
                    held, size = [], 0
        if size:
            yield from flush()
    return run


def _united(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sets of one pair, block and plane, which follow each other, as one, with its size."""
    names = ["pair", "block", "plane"]

    def united(batch: pa.RecordBatch, starts: np.ndarray) -> pa.RecordBatch:
        cuts = np.append(starts, batch.num_rows)
        sets = batch.column("rows")
        several = np.flatnonzero(np.diff(cuts) > 1).tolist()
        one = sets.take(pa.array(starts))
        if several:
            joined = one.to_pylist()
            for k in several:
                joined[k] = merged(sets.slice(cuts[k], cuts[k + 1] - cuts[k]).to_pylist())
            one = pa.array(joined, pa.binary())
        return pa.RecordBatch.from_arrays([*(batch.column(n).take(pa.array(starts)) for n in names), one, pa.array(sizes(one))], [*names, "rows", "n"])

    left = None
    for part in parts:
        if left is not None:
            part = pa.Table.from_batches([left, part]).combine_chunks().to_batches()[0]
        if not part.num_rows:
            continue
        new = np.zeros(part.num_rows, bool)
        new[0] = True
        for n in names:
            v = part.column(n).to_numpy()
            new[1:] |= v[1:] != v[:-1]
        starts = np.flatnonzero(new)
        left = part.slice(starts[-1])
        if len(starts) > 1:
            yield united(part.slice(0, starts[-1]), starts[:-1])
    if left is not None:
        yield united(left, np.zeros(1, np.int64))


def _returned(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Scores of the pairs, added up at the rows of each block. All sets of a block are in one partition."""
    blocks: dict[int, int] = {}
    sums = np.zeros((0, 2, 1 << BLOCK), np.int64)
    for part in parts:
        if not part.num_rows:
            continue
        numbers = part.column("block").to_numpy()
        for b in np.unique(numbers).tolist():
            if b not in blocks:
                blocks[b] = len(blocks)
        if len(blocks) > len(sums):
            sums = np.concatenate([sums, np.zeros((max(len(sums), len(blocks) - len(sums)), 2, 1 << BLOCK), np.int64)])
        sets = [unpack(s) for s in part.column("rows").to_pylist()]
        times = 1 << np.maximum(part.column("plane").to_numpy().astype(np.int64) - 1, 0)
        count, best = part.column("count").to_numpy() * times, part.column("best").to_numpy(zero_copy_only=False) * times
        many = [len(s) for s in sets]
        place = np.concatenate(sets)
        block = np.repeat([blocks[b] for b in numbers.tolist()], many)
        np.add.at(sums, (block, 0, place), np.repeat(count, many))
        np.add.at(sums, (block, 1, place), np.repeat(best, many))
    for b, k in blocks.items():
        place = np.flatnonzero(sums[k, 0])
        yield pa.RecordBatch.from_arrays([pa.array((b << BLOCK) + place), pa.array(sums[k, 1][place]), pa.array(sums[k, 0][place])], ["row", "n_best", "count_sum"])


def _read(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def pair_scores(planes: DataFrame) -> DataFrame:
    """(pair, n_docs, count, best): documents and links of each pair of ids, and whether no other a id has more links with the b id."""
    times = F.expr("shiftleft(1L, greatest(plane - 1, 0))")
    pairs = planes.groupBy("pair").agg(F.sum(F.when(F.col("plane") == 0, F.col("n"))).alias("n_docs"), F.sum(F.col("n") * times).alias("count"))
    pairs = cut_lineage(pairs.withColumn("b", F.col("pair").bitwiseAND(F.lit((1 << 32) - 1))))
    most = pairs.groupBy("b").agg(F.max("count").alias("most"))
    return pairs.join(most, "b").select("pair", F.shiftrightunsigned("pair", 32).cast("int").alias("a_id"), F.col("b").cast("int").alias("b_id"),
                                        "n_docs", "count", (F.col("count") == F.col("most")).alias("best"))


def aligned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", a_path: str = BYTE_BPE, b_path: str = PIECE_BPE) -> tuple[DataFrame, DataFrame]:
    """(one row for each row of ``docs``, one for each pair of ids), see ``alignment`` and ``pair_scores``.

    Each text is encoded once. The bitmaps of its links, by pair and block of
    documents, are united and counted; the counts go back along the bitmaps.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    keyed = with_row_key(docs, "_row")
    texts = keyed.select(F.col("_row").alias("row"), col(keyed, id_col).cast("long").alias("doc_id"), col(keyed, text_col).alias("text"))
    shared = spark.sparkContext.broadcast((_read(a_path), _read(b_path)))  # the files, a few MB
    bits = "pair long, block long, plane int, rows binary"
    found = cut_lineage(texts.mapInArrow(_aligned(shared), "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, " + bits))
    sets = found.where("pair is not null").select("pair", "block", "plane", "rows")
    planes = cut_lineage(sets.repartition("pair", "block").sortWithinPartitions("pair", "block", "plane").mapInArrow(_united, bits + ", n long"))
    scores = cut_lineage(pair_scores(planes))
    known = scores.select("pair", "count", "best")
    if scores.count() <= BROADCAST_PAIRS:
        known = F.broadcast(known)
    back = (planes.join(known, "pair").select("block", "plane", "rows", "count", "best").repartition("block")
            .mapInArrow(_returned, "row long, n_best long, count_sum long"))
    zero = F.lit(0).cast("long")
    result = found.where("pair is null").join(back, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256")
    return result, scores.drop("pair")


def alignment(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", a_path: str = BYTE_BPE, b_path: str = PIECE_BPE) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every row of ``docs``.

    A space and the text is encoded by both tokenizers. Groups end where
    tokens of both end; a link is an occurrence of an a and a b token that
    overlap. count_sum adds up the corpus-wide links of each link's pair of ids,
    n_best counts the links whose pair has most of its b id's. Texts that are
    null, empty or not given back by both sides have zeros and an empty
    digest. Rows are told apart by a key of their own, so ids may repeat or be
    null; other columns are ignored; an empty table stays empty.
    """
    return aligned(docs, id_col, text_col, a_path, b_path)[0]
