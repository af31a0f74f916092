"""Row keys that do not depend on ids, and a bounded filter in front of a join."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firnline.session import cut_lineage

#: Cells of a sieve: 2 MB of bits however many keys it has to let through.
CELLS = 1 << 24
# Fixed value: rows of a file that its part of a key can count.
FILE_ROWS = 40


def with_row_key(docs: DataFrame, name: str) -> DataFrame:
    """``docs`` with a long ``name`` that is another for each row and stays when the rows are read again.

    Rows of files are numbered by file and place. Rows that are still to be
    computed have neither, so they are written first.
    """
    try:
        placed = docs.select("*", F.col("_metadata.file_path").alias("_path"), F.col("_metadata.row_index").alias("_at"))
    except AnalysisException:
        docs = cut_lineage(docs)
        placed = docs.select("*", F.col("_metadata.file_path").alias("_path"), F.col("_metadata.row_index").alias("_at"))
    # As many rows as there are files, which the driver has listed for the scan.
    files = sorted(r[0] for r in placed.select("_path").distinct().collect())
    numbers = docs.sparkSession.createDataFrame(list(enumerate(files)), "_file long, _path string")
    # Not more rows than the driver holds already; a shuffle by file would move every text.
    return placed.join(F.broadcast(numbers), "_path").withColumn(name, F.shiftleft("_file", FILE_ROWS) + F.col("_at")).drop("_path", "_at", "_file")


def _marked(rows: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """``rows`` with _met: true for all whose ``key`` is in ``wanted``, and for a few others, more the more are wanted."""
    cell = F.pmod(F.xxhash64(key), F.lit(CELLS))
    bits = wanted.select(cell.alias("_cell")).groupBy(F.floor(F.col("_cell") / 64).alias("_word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(_cell % 64 as int))")).alias("_bits"))
    # Bounded by CELLS, so it can be broadcast.
    found = rows.withColumn("_cell", cell).withColumn("_word", F.floor(F.col("_cell") / 64)).join(F.broadcast(cut_lineage(bits)), "_word", "left")
    met = F.coalesce(F.expr("shiftrightunsigned(_bits, cast(_cell % 64 as int)) & 1 = 1"), F.lit(False))
    return found.withColumn("_met", met).drop("_cell", "_word", "_bits")


def sieved(rows: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """``rows`` without most of those whose ``key`` is not in the column ``key`` of ``wanted``.

    Loses no wanted row. It saves the shuffle of the rest and is no
    replacement of the join.
    """
    return _marked(rows, key, wanted).where("_met").drop("_met")


def without_keys(rows: DataFrame, key: str, gone: DataFrame) -> DataFrame:
    """``rows`` whose ``key`` is not in the column ``key`` of ``gone``; only those that may be in it are shuffled."""
    found = _marked(rows, key, gone)
    stay = found.where("_met").join(gone, key, "left_anti")
    return found.where("not _met").unionByName(stay).drop("_met")


def flagged(rows: DataFrame, key: str, wanted: DataFrame, name: str) -> DataFrame:
    """``rows`` with a boolean ``name``: whether ``key`` is in the column ``key`` of ``wanted``, which has no key twice.

    Only those that may be in it are shuffled.
    """
    found = _marked(rows, key, wanted)
    known = found.where("_met").drop("_met").join(wanted.select(key, F.lit(True).alias(name)), key, "left")
    return (found.where("not _met").drop("_met").withColumn(name, F.lit(False))
            .unionByName(known.withColumn(name, F.coalesce(F.col(name), F.lit(False)))))
