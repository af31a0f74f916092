"""Shards cut from a Hilbert-curve order over several metadata dimensions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firnline.llm.ranks import without
from firnline.llm.text import crc32
from firnline.operators.ranks import with_positions

#: Shards by default, and bits of each dimension's level.
SHARDS, BITS = 40, 5


def text_size(text: Column) -> Column:
    """UTF-8 bytes of a text (null: none) plus 16, the size of a row."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 16


def size_level(size: Column, bits: int = BITS) -> Column:
    """Two levels for each doubling of a size from 16 on, up to the last level."""
    digits = F.bin(size)
    return F.least(2 * (F.length(digits) - 5) + F.substring(digits, 2, 1).cast("int"), F.lit((1 << bits) - 1)).cast("long")


def name_level(value: Column, bits: int = BITS) -> Column:
    """Level of a name, by its hash: equal names are together, however many there are. Null is level 0."""
    return F.coalesce(F.pmod(crc32(value), F.lit(1 << bits)), F.lit(0).cast("long"))


def hilbert(df: DataFrame, levels: list[str], bits: int = BITS, name: str = "hilbert") -> DataFrame:
    """``df`` with the index of each row's levels on the Hilbert curve over all of them.

    The levels are longs below 2^bits. Axes are turned bit by bit and then Gray
    coded (Skilling 2004); the index interleaves the resulting bits.
    """
    n = len(levels)
    high = f"shiftleft(1L, {bits - 1} - s div {n})"
    bit = f"(x[s % {n}] & {high}) != 0"
    swap = f"((x[0] ^ x[s % {n}]) & ({high} - 1))"
    turn = (f"aggregate(sequence(0, {(bits - 1) * n - 1}), array({', '.join(f'`{c}`' for c in levels)}), (x, s) -> transform(x, (v, k) -> "
            f"CASE WHEN {bit} THEN CASE WHEN k = 0 THEN v ^ ({high} - 1) ELSE v END "
            f"WHEN s % {n} != 0 AND (k = 0 OR k = s % {n}) THEN v ^ {swap} ELSE v END))")
    turned = df.withColumn("_turned", F.expr(turn))
    gray = ["^".join(f"_turned[{j}]" for j in range(i + 1)) for i in range(n)]
    turned = turned.withColumn("_gray", F.expr(f"array({', '.join(gray)})"))
    flip = " ^ ".join(f"CASE WHEN _gray[{n - 1}] & {1 << q} != 0 THEN {(1 << q) - 1}L ELSE 0L END" for q in range(1, bits))
    turned = turned.withColumn("_flip", F.expr(flip))
    index = " + ".join(f"shiftleft(shiftright(_gray[{i}] ^ _flip, {q}) & 1L, {q * n + n - 1 - i})" for q in range(bits) for i in range(n))
    return turned.withColumn(name, F.expr(index)).drop("_turned", "_gray", "_flip")


def shards(docs: DataFrame, n_shards: int = SHARDS, bits: int = BITS) -> DataFrame:
    """All rows of ``docs`` with size, text_crc32, their place on the curve, shard and slot.

    Dimensions are language, source and size. Rows go by curve index, then
    text_crc32 and doc_id, and are cut into runs whose row counts differ by one
    at most (law ``rows``); slot counts from 0 in a shard. With fewer rows than
    shards some shards are empty. Null values have a level of their own side,
    null and empty texts size 16; repeated rows take a slot each. Columns of
    ``docs`` with the names of new ones are replaced.
    """
    new = ("size", "text_crc32", "hilbert", "law", "shard", "slot", "grown_shard", "lang_level", "source_level", "size_level",
           "_part", "_seq", "_n", "_offset", "n_rows", "position", "_turned", "_gray", "_flip")
    text = F.col("text")
    marked = (without(docs, *new).withColumn("size", text_size(text)).withColumn("text_crc32", F.coalesce(crc32(text), F.lit(0).cast("long")))
              .withColumn("lang_level", name_level(F.col("lang"), bits)).withColumn("source_level", name_level(F.col("source"), bits))
              .withColumn("size_level", size_level(F.col("size"), bits)))
    return cut_runs(hilbert(marked, ["lang_level", "source_level", "size_level"], bits), n_shards)


def cut_runs(marked: DataFrame, n_shards: int) -> DataFrame:
    placed = with_positions(marked, ["hilbert", "text_crc32", "doc_id", "size"])
    shard = F.expr(f"position * {n_shards}L div n_rows")
    start = F.expr(f"(shard * n_rows + {n_shards - 1}L) div {n_shards}L")
    return (placed.withColumn("shard", shard.cast("int")).withColumn("slot", F.col("position") - start)
            .withColumn("law", F.lit("rows")).withColumn("grown_shard", F.lit(None).cast("int")).drop("position", "n_rows"))


def placement(docs: DataFrame, n_shards: int = SHARDS, bits: int = BITS) -> DataFrame:
    """The columns of ``shards`` without the text, which only gives its size and hash and is not shuffled."""
    text = F.col("text")
    marked = docs.select("doc_id", text_size(text).alias("size"), F.coalesce(crc32(text), F.lit(0).cast("long")).alias("text_crc32"),
                         name_level(F.col("lang"), bits).alias("lang_level"), name_level(F.col("source"), bits).alias("source_level"))
    marked = hilbert(marked.withColumn("size_level", size_level(F.col("size"), bits)), ["lang_level", "source_level", "size_level"], bits)
    return cut_runs(marked, n_shards).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard", "hilbert")
