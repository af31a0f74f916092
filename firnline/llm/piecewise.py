"""Context-triggered piecewise hashing (Kornblum 2006): a rolling hash cuts a text, a letter stands for each piece."""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firnline.llm.rows import with_row_key
from firnline.llm.text import col
from firnline.operators.ranks import with_positions

#: Bytes that decide on a cut, pieces of a signature at most (the last one goes to the end of the text), and pieces
#: under which a smaller block size is taken.
WINDOW, PIECES, FEW = 7, 64, 32
#: Two signatures need a run of this many pieces in common; shorter ones are found by chance.
RUN = 7
#: Equal letters in a row beyond this many say little and are left out of a comparison.
REPEATS = 3
#: Runs of the order by id that documents are dealt into, at most: their first keys are sent to all tasks.
MAX_RUNS = 1 << 16
#: Bytes of a text that are hashed at a time.
SLICE = 1 << 20

# The letters of a signature, and odd multipliers of the hashes.
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
STEP, SPREAD = 0x01000193, 0x2C1B3C6D
# A number for each byte.
_BYTES = np.array([xxhash.xxh32_intdigest(bytes([b]), 1) for b in range(256)], np.uint32)


def levels(data: bytes) -> np.ndarray:
    """For each byte the times 2 divides a hash of it and the WINDOW - 1 bytes before: a cut at block size 2^k has k or more."""
    out = np.zeros(len(data), np.uint8)
    for start in range(0, len(data), SLICE):
        before = min(start, WINDOW - 1)
        values = _BYTES[np.frombuffer(data, np.uint8, min(SLICE, len(data) - start) + before, start - before)]
        h = values.copy()
        for k in range(1, min(WINDOW, len(values))):
            h[k:] += values[:-k] * np.uint32(pow(STEP, k, 1 << 32))
        h ^= h >> np.uint32(15)
        h *= np.uint32(SPREAD)
        h ^= h >> np.uint32(13)
        out[start:start + SLICE] = np.bitwise_count((h & (~h + np.uint32(1))) - np.uint32(1))[before:]
    return out


def signature(data: bytes, cuts: np.ndarray) -> str:
    """A letter for each piece of ``data``, which ends after each place in ``cuts``."""
    ends = (cuts[:PIECES - 1] + 1).tolist()
    if data and (not ends or ends[-1] < len(data)):
        ends.append(len(data))
    digest = xxhash.xxh32_intdigest
    return "".join([LETTERS[digest(data[a:b], 0) & 63] for a, b in zip([0, *ends], ends)])


def fingerprint(text: str | None) -> str:
    """Block size and the signatures at it and at its double, parted by colons.

    The block size is the power of two at which PIECES pieces are expected, or
    the next smaller ones while there are fewer than FEW. A null text is empty.
    """
    data = (text or "").encode()
    found = levels(data)
    counts = np.bincount(found, minlength=34)[::-1].cumsum()[::-1]  # places of each level or more
    k = max(1, (-(-len(data) // PIECES) - 1).bit_length())
    while k > 1 and counts[min(k, 33)] + 1 < FEW:
        k -= 1
    at = np.flatnonzero(found >= k)
    return f"{1 << k}:{signature(data, at)}:{signature(data, at[found[at] > k])}"


def _short(s: str) -> str:
    """Without the letters that stand behind REPEATS equal ones."""
    return "".join(c for i, c in enumerate(s) if i < REPEATS or s[i - REPEATS:i] != c * REPEATS)


def likeness_of_signatures(a: str, b: str) -> float:
    """1 minus the edit distance (insertions and deletions; a change is both) as a share of both lengths."""
    a, b = _short(a), _short(b)
    runs = {a[i:i + RUN] for i in range(len(a) - RUN + 1)}
    if not any(b[i:i + RUN] in runs for i in range(len(b) - RUN + 1)):
        return 0.0
    # Longest common subsequence, a bit for each letter of a (Hyyro 2004).
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    every = (1 << len(a)) - 1
    row = every
    for c in b:
        met = row & places.get(c, 0)
        row = ((row + met) | (row - met)) & every
    return 2 * (len(a) - row.bit_count()) / (len(a) + len(b))


def likeness(a: str, b: str) -> float:
    """Of two fingerprints, from 0 to 1: the best of the signatures at a common block size; 0 if there is none, 1 if they are equal."""
    if a == b:
        return 1.0
    (m, a1, a2), (n, b1, b2) = a.split(":"), b.split(":")
    m, n = int(m), int(n)
    if m == n:
        return max(likeness_of_signatures(a1, b1), likeness_of_signatures(a2, b2))
    if m == 2 * n:
        return likeness_of_signatures(a1, b2)
    return likeness_of_signatures(a2, b1) if n == 2 * m else 0.0


def _dealt(bounds: list[tuple]):
    """Rows with the run they stand in; the first row of a run once more as the end of the run before."""
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            at, runs, tails = [], [], []
            for i, (d, r) in enumerate(zip(part.column("doc_id").to_pylist(), part.column("_row").to_pylist())):
                key = (d is None, d or 0, r)
                k = bisect_right(bounds, key) - 1
                at.append(i)
                runs.append(k)
                tails.append(False)
                if bounds[k] == key:
                    at.append(i)
                    runs.append((k or len(bounds)) - 1)
                    tails.append(True)
            kept = part.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(runs, pa.int32()), pa.array(tails)], [*kept.schema.names, "_run", "_tail"])
    return run


_RESULT = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
                     ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])


def _compared(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row of a sorted run with the one behind it; the last row of a run is only that."""
    before = None
    for part in parts:
        out = []
        for doc, text, tail in zip(part.column("doc_id"), part.column("text"), part.column("_tail").to_pylist()):
            text = text.as_py() or ""
            own = fingerprint(text)
            if before:
                first, whole, print_ = before
                half = len(whole) // 2
                edited = whole[:len(whole) - half] + text[:half]
                changed = fingerprint(edited)
                out.append((first, len(whole), hashlib.sha256(edited.encode()).hexdigest(), print_, changed, likeness(print_, changed), likeness(print_, own)))
            before = None if tail else (doc.as_py(), text, own)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _RESULT)], schema=_RESULT)


def edited_likeness(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next of every row of ``docs``.

    The edited text has its last half (rounded down) replaced by as many first
    characters of the next document, all if it has fewer. Documents are in the
    order of their ids, nulls last, rows with one id by file and place; after
    the last comes the first, so a single one follows itself. Null texts are
    empty. Other columns are ignored; an empty table stays empty.

    Texts are shuffled once. The keys alone are put in order first, which
    gives the first key of each run; the text it belongs to is sent to the end
    of the run before too.
    """
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    keyed = with_row_key(docs, "_row")
    rows = keyed.select(col(keyed, id_col).cast("long").alias("doc_id"), "_row", col(keyed, text_col).alias("text"))
    spark = docs.sparkSession
    runs = min(MAX_RUNS, max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows.rdd.getNumPartitions()))
    keys = rows.select(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0).cast("long")).alias("id"), "_row")
    placed = with_positions(keys, ["none", "id", "_row"])
    first = placed.where(F.col("position") % F.ceil(F.col("n_rows") / runs) == 0).orderBy("position").select("none", "id", "_row").collect()
    if not first:  # at most one key for each run
        return spark.createDataFrame([], schema)
    dealt = rows.mapInArrow(_dealt([tuple(r) for r in first]), "doc_id long, _row long, text string, _run int, _tail boolean")
    return (dealt.repartition(len(first), "_run").sortWithinPartitions("_run", "_tail", F.col("doc_id").asc_nulls_last(), "_row")
            .select("doc_id", "text", "_tail").mapInArrow(_compared, schema))


def with_fingerprints(docs: DataFrame, text_col: str = "text", name: str = "fingerprint") -> DataFrame:
    """``docs`` with the fingerprint of each text (null: that of the empty text), without a shuffle."""
    @F.pandas_udf("string")
    def prints(texts):
        return texts.map(fingerprint)
    return docs.withColumn(name, prints(F.coalesce(col(docs, text_col), F.lit(""))))
