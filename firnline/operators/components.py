"""Connected components of a graph that lives in a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firnline.session import Scratch, cut_lineage


def _state(edges: DataFrame) -> tuple:
    """Equal for equal sets of edges."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root): every node of ``edges(a, b)`` with the smallest node that a path leads to.

    Stars are contracted (large-star and small-star steps, Kiveris et al.
    2014): a node's larger neighbours move to its smallest one, then its
    smaller ones do. There are never more edges than at first, and the rounds
    grow with the logarithm of the size of a component. A round's tables are
    deleted when the next one is written. Loops and repeated edges do no harm.
    """
    with Scratch(edges.sparkSession) as scratch:
        now = scratch.cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct())
        state = _state(now)
        while state[0]:
            both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
            least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
            large = scratch.cut(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct())
            least = large.groupBy("u").agg(F.min("v").alias("m"))
            small = large.join(least, "u").select(F.inline(F.array(
                F.struct(F.col("v").alias("a"), F.col("m").alias("b")), F.struct(F.col("u").alias("a"), F.col("m").alias("b")))))
            after = scratch.cut(small.where("a != b").distinct().toDF("u", "v"))
            scratch.free(now, large)
            now, before = after, state
            state = _state(now)
            if state == before:
                break
        return cut_lineage(now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
            now.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct())
