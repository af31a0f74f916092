"""Words, hashes and row handling shared by the corpus operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The white space that separates words, as characters and as a pattern.
SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"


def col(df: DataFrame, name: str) -> Column:
    """Column ``name`` of ``df``, whatever characters the name has."""
    return df["`" + name.replace("`", "``") + "`"]


def words(text: Column) -> Column:
    """Words of a text as an array; null has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE_RUN), lambda w: w != "")


def crc32(value: Column) -> Column:
    """Unsigned CRC-32 of the UTF-8 bytes of a value as text, as long."""
    return F.crc32(value.cast("string").cast("binary"))


def unit(*parts) -> Column:
    """Uniform number in [0, 1) that depends on the values alone; 52 bits of MD5, equal in every engine."""
    pieces = [F.coalesce(p.cast("string"), F.lit("~")) if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    digits = F.substring(F.md5(F.concat_ws(":", *pieces).cast("binary")), 1, 13)
    return F.conv(digits, 16, 10).cast("bigint").cast("double") / F.lit(float(2 ** 52))


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


# DuckDB text of a CRC-32 over the UTF-8 bytes of a string; `crc_table` has one row with the 256 steps.
CRC_TABLE_SQL = """crc_table AS (
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce(range(8), lambda a, x: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, i) AS v
    FROM range(256) AS r(i)))"""


def crc_sql(value: str) -> str:
    """CRC-32 in DuckDB of the text expression ``value``, in a query that also reads crc_table as c."""
    data = f"list_transform(regexp_extract_all(hex(encode({value})), '..'), lambda h: ('0x' || h)::BIGINT)"
    return f"xor(list_reduce({data}, lambda a, b: xor(a >> 8, c.t[(xor(a, b) & 255) + 1]), 4294967295::BIGINT), 4294967295::BIGINT)"
