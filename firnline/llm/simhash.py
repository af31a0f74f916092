"""SimHash near-duplicates, found through nearby codewords of the binary Golay code."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firnline.llm.graph import components
from firnline.llm.rows import with_row_key, without_keys
from firnline.llm.text import col
from firnline.session import cut_lineage

#: Words of a shingle, and differing bits at which fingerprints still link. The keys below are complete for 2.
SHINGLE, MAX_BITS = 3, 2
#: Fingerprints that share a key are compared pairwise up to this many. In larger groups each would meet more
#: others than it has neighbouring points (65), so there links are found through those points. Both ways are exact.
PAIRWISE = 64

# Fixed value: generator polynomial of the perfect [23, 12, 7] Golay code.
GENERATOR = 0b101011100011
WORD, CHECK = 23, 11

_BITS = np.array([[b >> i & 1 for i in range(8)] for b in range(256)], np.float64)
_LANES = np.arange(8, dtype=np.int64) * 256


def fingerprint(text: bytes | None, size: int = SHINGLE) -> int:
    """64-bit SimHash of the shingles of ``size`` words of a text, repeats included; 0 without words.

    A to Z are lowered; fewer words are one shingle.
    """
    found = text.lower().split() if text else []
    if not found:
        return 0
    data = b" ".join(found)
    ends = np.cumsum([len(w) + 1 for w in found]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    hashes = [digest(data[a:b], 42) for a, b in zip(starts, ends[size - 1:].tolist())] if len(found) >= size else [digest(data, 42)]
    lanes = np.array(hashes, np.uint64).view(np.uint8).reshape(-1, 8)
    seen = np.bincount((lanes + _LANES).ravel(), minlength=2048).reshape(8, 256)
    bits = (seen @ _BITS).ravel() * 2 > len(hashes)
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


def _fingerprints(size: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            found = np.array([fingerprint(t.as_py(), size) for t in part.column("text").cast(pa.binary())], np.uint64)
            rest = [n for n in part.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays([*(part.column(n) for n in rest), pa.array(found.view(np.int64))], [*rest, "fp"])
    return run


def with_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE) -> DataFrame:
    return docs.select(col(docs, id_col).cast("long").alias("doc_id"), col(docs, text_col).alias("text")).mapInArrow(
        _fingerprints(size), "doc_id long, fp long")


def _remainder(word: int) -> int:
    for i in range(WORD - 1, CHECK - 1, -1):
        if word >> i & 1:
            word ^= GENERATOR << (i - CHECK)
    return word


def _golay_tables() -> tuple[np.ndarray, np.ndarray]:
    """Remainders of all bytes at their three places, and the error of up to three bits for each remainder."""
    rest = np.array([[_remainder((b << 8 * k) & ((1 << WORD) - 1)) for b in range(256)] for k in range(3)], np.uint32)
    error = np.zeros(1 << CHECK, np.uint32)
    for weight in range(4):
        for places in combinations(range(WORD), weight):
            e = sum(1 << p for p in places)
            error[_remainder(e)] = e
    return rest, error


_TABLES: list[np.ndarray] = []


def decode(words: np.ndarray) -> np.ndarray:
    """Index (12 bits) of the codeword nearest to each 23-bit word. The code is perfect: one is within 3 bits."""
    if not _TABLES:
        _TABLES.extend(_golay_tables())
    rest, error = _TABLES
    left = rest[0][words & 255] ^ rest[1][words >> 8 & 255] ^ rest[2][words >> 16]
    return (words ^ error[left]) >> CHECK


def nearby(words: np.ndarray) -> np.ndarray:
    """Codeword indices of each word and of all its one-bit neighbours: 6 columns, -1 where there are fewer.

    Two words that differ in two bits or fewer have a common neighbour (or are
    neighbours), so they share an index. A word within 2 bits of a codeword has
    one index, any other has 6.
    """
    found = np.stack([decode(words), *(decode(words ^ np.uint32(1 << i)) for i in range(WORD))], 1).astype(np.int64)
    found.sort(1)
    new = np.ones(found.shape, bool)
    new[:, 1:] = found[:, 1:] != found[:, :-1]
    out = np.full((len(found), 6), -1, np.int64)
    row, k = np.nonzero(new)
    out[row, (np.cumsum(new, 1) - 1)[row, k]] = found[row, k]
    return out


def keys_of(fps: np.ndarray) -> np.ndarray:
    """Up to 18 keys of each fingerprint, -1 where there are fewer.

    The segments have 23, 23 and 18 bits. Two errors leave one segment without
    any, and at most two in each other: a key is an exact segment with a nearby
    codeword of another.
    """
    u = fps.view(np.uint64)
    low = (u & np.uint64((1 << 23) - 1)).astype(np.uint32)
    mid = (u >> np.uint64(23) & np.uint64((1 << 23) - 1)).astype(np.uint32)
    high = (u >> np.uint64(46)).astype(np.int64)
    near_low, near_mid = nearby(low), nearby(mid)
    out = []
    for kind, (exact, near) in enumerate(((low, near_mid), (mid, near_low), (high, near_low))):
        key = (kind << 60) | (exact.astype(np.int64)[:, None] << 12) | near
        out.append(np.where(near < 0, -1, key))
    return np.concatenate(out, 1)


def _keys(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in parts:
        fps = part.column("fp").to_numpy(zero_copy_only=False).astype(np.int64)
        keys = keys_of(fps)
        row, k = np.nonzero(keys >= 0)
        yield pa.RecordBatch.from_arrays([pa.array(keys[row, k]), pa.array(fps[row])], ["key", "fp"])


def _apart(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def links(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Edges (a, b) that connect exactly the distinct fingerprints ``fp`` at ``max_bits`` differing bits or fewer, 2 at most.

    Small groups with a common key give their close pairs; in larger ones each
    fingerprint is linked to the smallest that shares a point one bit away,
    which is 65 rows for each however large the group is.
    """
    if not 1 <= max_bits <= MAX_BITS:
        raise ValueError(f"the keys find links of 1 to {MAX_BITS} bits")
    keyed = cut_lineage(fps.mapInArrow(_keys, "key long, fp long"))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    met = keyed.join(sizes, "key")
    few = met.where(F.col("n") <= PAIRWISE)
    pairs = (few.select("key", F.col("fp").alias("a")).join(few.select("key", F.col("fp").alias("b")), "key")
             .where((F.col("a") < F.col("b")) & (_apart(F.col("a"), F.col("b")) <= max_bits)).select("a", "b"))
    one = F.expr("shiftleft(1L, cast(i as int))")
    flips = F.explode(F.sequence(F.lit(-1), F.lit(63))).alias("i")
    points = (met.where(F.col("n") > PAIRWISE).select("fp").distinct().select("fp", flips)
              .select("fp", F.when(F.col("i") < 0, F.col("fp")).otherwise(F.col("fp").bitwiseXOR(one)).alias("point")))
    if max_bits == 1:  # a common neighbour is two bits wide: only the point itself counts for one of the two
        around = (points.alias("x").join(points.where("fp = point").alias("y"), "point").where("x.fp > y.fp")
                  .select(F.col("y.fp").alias("a"), F.col("x.fp").alias("b")))
        return pairs.union(around).distinct()
    least = points.groupBy("point").agg(F.min("fp").alias("least"), F.max("fp").alias("most")).where("least < most")
    around = points.join(least, "point").where("fp > least").select(F.col("least").alias("a"), F.col("fp").alias("b"))
    return pairs.union(around).distinct()


def _rooted(distinct: DataFrame, max_bits: int) -> DataFrame:
    """``distinct`` (one row for each ``fp``) with the component ``root`` of each fingerprint."""
    roots = cut_lineage(components(links(distinct.select("fp"), max_bits)))
    return distinct.join(roots, distinct["fp"] == roots["node"], "left").withColumn("root", F.coalesce("root", "fp")).drop("node")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE,
                    max_bits: int = MAX_BITS) -> DataFrame:
    """doc_id, fingerprint and component_id of every row of ``docs``.

    component_id is the smallest doc_id reachable over links between
    fingerprints; null only if all ids of a component are null. Texts that are
    null or have no words have fingerprint zero and are linked like others.
    Repeated rows give repeated results; other columns are ignored; an empty
    table gives an empty result.
    """
    marked = cut_lineage(with_fingerprints(docs, id_col, text_col, size))
    distinct = cut_lineage(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    rooted = _rooted(distinct, max_bits)
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of = rooted.select("fp", "root").join(smallest, "root").select("fp", "component_id")
    return marked.join(of, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, size: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """``docs`` without near copies: of each component of linked fingerprints one row, with all columns.

    That with the smallest doc_id stays, nulls last; of several with it the first
    by file and place. Rows are told apart by a key of their own, so different
    texts with the same id or none stay. Texts without words are copies of each
    other. An empty table stays empty.
    """
    keyed = with_row_key(docs, "_row")
    plain = keyed.select(F.col("_row").alias("row"), col(keyed, "doc_id").cast("long").alias("doc_id"), col(keyed, "text").alias("text"))
    marked = cut_lineage(plain.mapInArrow(_fingerprints(size), "row long, doc_id long, fp long"))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
    distinct = cut_lineage(marked.groupBy("fp").agg(least.alias("first")))
    keep = _rooted(distinct, max_bits).groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.row").alias("row"))
    gone = cut_lineage(marked.join(cut_lineage(keep), "row", "left_anti").select(F.col("row").alias("_row")))
    return without_keys(keyed, "_row", gone).drop("_row")
