"""Removal of word windows that an earlier document has, behind a count-min prefilter."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from firnline.llm.text import col
from firnline.llm.windows import Words, batches, mix, pieces, plain_words

#: Words of a window.
WINDOW = 13
#: Rows of the sketch, and its cells in each row for one expected window.
DEPTH, CELLS_EACH = 2, 3
#: Bounds of the cells in a row. The upper one bounds what is broadcast: DEPTH bits for each cell. A corpus that
#: outgrows it lets more windows through to the exact pass, down to all of them; none is lost.
MIN_CELLS, MAX_CELLS = 1 << 20, 1 << 29
#: Cells of the sketch that travel and are merged together.
BLOCK = 1 << 20
#: Windows that a task gathers before it looks for equal ones, and cells before it sends their sketch.
GATHER, SEND = 1_000_000, 5_000_000
#: Windows estimated repeated travel in arrays, one for each bucket of hashes. A bucket stands for this many bytes
#: of text, within bounds.
BUCKET_BYTES, MIN_BUCKETS, MAX_BUCKETS = 1 << 21, 64, 1 << 16
#: Ways that windows known to be repeated are spread over.
SPREAD = 64

_SKETCH = pa.schema([("row", pa.int32()), ("block", pa.int32()), ("cells", pa.binary())])
_FOUND = pa.schema([("bucket", pa.int32()), ("h", pa.list_(pa.int64())), ("g", pa.list_(pa.int16())), ("salt", pa.list_(pa.int8())), ("doc", pa.list_(pa.int64()))])


def _windows(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(hash, second hash, doc id) of the windows of many texts at a time; of equal windows of one text once."""
    held: list[tuple] = []
    size = 0
    for part in parts:
        ids = part.column("doc").to_numpy(zero_copy_only=False).astype(np.int64)
        for first, words in pieces(part.column("text"), plain_words):
            ok = words.left >= WINDOW
            if ok.any():
                h, g = words.hashes(WINDOW)[ok], words.second(WINDOW)[ok]
                held.append((h, g, ids[first + words.doc[ok]]))
                size += len(h)
            if size >= GATHER:
                yield _distinct(held)
                held, size = [], 0
    if held:
        yield _distinct(held)


def _distinct(held: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    h, g, doc = (np.concatenate(x) for x in zip(*held))
    order = np.lexsort((doc, h))
    h, g, doc = h[order], g[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (g[1:] != g[:-1]) | (doc[1:] != doc[:-1])
    return h[new], g[new], doc[new]


def _cells(h: np.ndarray, row: int, width: int) -> np.ndarray:
    return (mix(h, row + 1) >> np.uint64(32)) * np.uint64(width) >> np.uint64(32)


def _pack(values: np.ndarray) -> bytes:
    """Ascending numbers as compressed differences, byte plane by byte plane."""
    steps = np.diff(values, prepend=np.uint32(0)).astype("<u4")
    return zlib.compress(steps.view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def _unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(data), np.uint8).reshape(4, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u4").ravel(), dtype=np.uint32)


def _sketches(width: int):
    """Per task and batch: for each block of cells those hit, doubled, plus 1 if hit more than once."""
    def pack(row: int, held: list[np.ndarray]) -> dict:
        cells, counts = np.unique(np.concatenate(held), return_counts=True)
        cuts = np.flatnonzero(np.diff(cells // BLOCK)) + 1
        blocks = (cells[np.concatenate([np.zeros(1, np.int64), cuts])] // BLOCK).astype(np.int32)
        marked = cells % np.uint32(BLOCK) << np.uint32(1) | (counts > 1).astype(np.uint32)
        return {"row": np.full(len(blocks), row, np.int32), "block": blocks, "cells": [_pack(x) for x in np.split(marked, cuts)]}

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            held: list[list[np.ndarray]] = [[] for _ in range(DEPTH)]
            for h, _, _ in _windows(parts):
                for row in range(DEPTH):
                    held[row].append(_cells(h, row, width).astype(np.uint32))
                if sum(map(len, held[0])) >= SEND:
                    for row in range(DEPTH):
                        yield pack(row, held[row])
                        held[row] = []
            if held[0]:
                yield from (pack(row, x) for row, x in enumerate(held))
        yield from batches(rows(), _SKETCH)
    return run


def _merge(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Add up the sketches of each block, which arrive one after another; give the cells hit twice or more as bits."""
    def rows():
        at, hits = None, np.zeros(BLOCK, np.uint8)
        for part in parts:
            for row, block, data in zip(*(part.column(c).to_pylist() for c in ("row", "block", "cells"))):
                if at != (row, block):
                    if at is not None:
                        yield at, hits
                    at, hits = (row, block), np.zeros(BLOCK, np.uint8)
                marked = _unpack(data)
                cell = marked >> 1
                hits[cell] = np.minimum(hits[cell] + 1 + (marked & 1).astype(np.uint8), 2)
        if at is not None:
            yield at, hits
    yield from batches(({"row": [r], "block": [b], "cells": [np.packbits(hits >= 2, bitorder="little").tobytes()]}
                        for (r, b), hits in rows()), _SKETCH)


def count_min(texts: DataFrame, size: int) -> tuple[int, list[np.ndarray]]:
    """(cells in a row, for each row a bit per cell that two or more windows hit), over all ``size`` bytes of ``texts``.

    The number of cells follows the bytes of text. Tasks send sketches of what
    they read, which are merged block by block.
    """
    width = int(min(max(MIN_CELLS, CELLS_EACH * size // 6), MAX_CELLS))
    merged = (texts.mapInArrow(_sketches(width), "row int, block int, cells binary")
              .repartition("row", "block").sortWithinPartitions("row", "block")
              .mapInArrow(_merge, "row int, block int, cells binary"))
    bits = [np.zeros(-(-width // BLOCK) * BLOCK // 8, np.uint8) for _ in range(DEPTH)]
    for r in merged.toLocalIterator():
        bits[r.row][r.block * BLOCK // 8:(r.block + 1) * BLOCK // 8] = np.frombuffer(r.cells, np.uint8)
    return width, bits


def _estimated_repeated(width: int, buckets: int, shared):
    """Windows that the sketch takes for repeated, as arrays by bucket of the hash.

    Each has its hash, 16 further bits of it, a salt and the document. Of equal
    windows met together the one of the smallest document has salt 0. The
    others are in a larger document than that one, so they are repeated for
    certain, and are salted to be told apart.
    """
    def lists(values: np.ndarray, cuts: np.ndarray, kind: pa.DataType) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(values, kind))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value

        def rows():
            for h, g, doc in _windows(parts):
                twice = np.ones(len(h), bool)
                for row in range(DEPTH):
                    cell = _cells(h, row, width)
                    twice &= (bits[row][cell >> np.uint64(3)] >> (cell & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
                h, g, doc = h[twice], g[twice], doc[twice]
                if not len(h):
                    continue
                again = np.zeros(len(h), bool)
                again[1:] = (h[1:] == h[:-1]) & (g[1:] == g[:-1])
                bucket = ((h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)
                # What is repeated for certain is not looked up again, so it may go to any bucket.
                salt = np.where(again, 1 + mix(doc.view(np.uint64)) % np.uint64(SPREAD), 0).astype(np.int8)
                bucket = np.where(again, (bucket + salt.astype(np.int32) * 7919) % buckets, bucket).astype(np.int32)
                order = np.lexsort((doc, bucket))
                h, g, salt, doc, bucket = h[order], g[order], salt[order], doc[order], bucket[order]
                starts = np.flatnonzero(np.diff(bucket, prepend=-1))
                cuts = np.append(starts, len(h))
                yield {"bucket": bucket[starts], "h": lists(h.view(np.int64), cuts, pa.int64()), "g": lists(g.view(np.int16), cuts, pa.int16()),
                       "salt": lists(salt, cuts, pa.int8()), "doc": lists(doc, cuts, pa.int64())}
        yield from batches(rows(), _FOUND)
    return run


def repeated_windows(texts: DataFrame) -> DataFrame:
    """(doc, h): every window of a document ``doc`` that also starts in a document with a smaller id."""
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    width, bits = count_min(texts, size)
    buckets = int(min(max(MIN_BUCKETS, size // BUCKET_BYTES), MAX_BUCKETS))
    shared = texts.sparkSession.sparkContext.broadcast(bits)
    found = texts.mapInArrow(_estimated_repeated(width, buckets, shared),
                             "bucket int, h array<long>, g array<short>, salt array<byte>, doc array<long>")
    each = found.repartition("bucket").select("bucket", F.inline(F.arrays_zip("h", "g", "salt", "doc")))
    least = F.min("doc").over(Window.partitionBy("bucket", "h", "g", "salt"))
    return each.withColumn("least", least).where("salt > 0 or doc > least").select("doc", "h")


def _cut(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in parts:
        gone, n, cut, texts = part.column("gone"), [], [], []
        for i, t in enumerate(part.column("text").cast(pa.binary())):
            text = plain_words(t.as_py() or b"")
            hit = 0
            if gone[i].is_valid and text:
                words = Words([text])
                starts = np.flatnonzero((words.left >= WINDOW) & np.isin(words.hashes(WINDOW).view(np.int64), gone[i].values.to_numpy()))
                change = np.zeros(len(words.start) + WINDOW, np.int64)
                np.add.at(change, starts, 1)
                np.add.at(change, starts + WINDOW, -1)
                covered = np.cumsum(change)[:len(words.start)] > 0
                hit = int(covered.sum())
                every = text.split(b" ")
                total = len(every)
                text = b" ".join([w for w, c in zip(every, covered.tolist()) if not c])
            else:
                total = text.count(b" ") + 1 if text else 0
            n.append(total)
            cut.append(hit)
            texts.append(text.decode("utf-8", "replace"))
        yield pa.RecordBatch.from_arrays([part.column("doc"), pa.array(n, pa.int64()), pa.array(cut, pa.int64()), pa.array(texts, pa.string())],
                                         ["doc", "n_words", "n_removed", "kept"])


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed and kept_text of every row of ``docs``.

    Removed is each word covered by a window of WINDOW words that also starts
    in a document with a smaller id; all windows are judged on the input. Rows
    with one id are one document for this. A null id is neither smaller nor
    larger than another, so such rows neither remove nor lose words. Null and
    short texts have no windows. Other columns are ignored. Windows are equal
    if 80 bits of hash are.
    """
    texts = docs.select(col(docs, id_col).cast("long").alias("doc"), col(docs, text_col).alias("text"))
    known = texts.where("doc is not null and text is not null")
    gone = repeated_windows(known).groupBy(F.col("doc").alias("_doc")).agg(F.collect_list("h").alias("gone"))
    return (texts.join(gone, F.col("doc") == F.col("_doc"), "left").select("doc", "text", "gone")
            .mapInArrow(_cut, "doc long, n_words long, n_removed long, kept string")
            .withColumnsRenamed({"doc": "doc_id", "kept": "kept_text"}))


def digest(kept: DataFrame) -> DataFrame:
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))
