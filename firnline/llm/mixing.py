"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firnline.llm.ranks import without
from firnline.llm.rows import with_row_key
from firnline.llm.text import unit
from firnline.operators.ranks import with_positions
from firnline.session import cut_lineage

SEED = 42
#: Without given weights a source weighs its bytes to this power: small sources gain, large ones lose.
POWER = 0.5
#: Rates above this are drawn as a sum of equal parts, each inverted by itself; so the table of a source stays short.
PART = 16
#: Entries of that table. Beyond 80 a Poisson variable of mean 16 has a probability under 1e-25.
STEPS = 80


def rates(docs: DataFrame, weights: DataFrame | None = None, epochs: float = 1.0, power: float = POWER) -> DataFrame:
    """(source, rate, parts, cdf): mean repetitions of a document of each source, for shares of bytes by weight.

    The output has ``epochs`` times the bytes of the input. ``weights`` has
    (source, weight); sources without one get none. The cumulative Poisson
    probabilities are those of one part.
    """
    sizes = docs.groupBy("source").agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 16).alias("bytes"))
    if weights is None:
        weighed = sizes.withColumn("weight", F.pow("bytes", F.lit(power)))
    else:
        given = weights.select(F.col("source").alias("_source"), F.col("weight").cast("double").alias("weight"))
        weighed = sizes.join(given, F.col("source").eqNullSafe(F.col("_source"))).where("weight > 0")
    total = weighed.agg(F.sum("weight").alias("all_weight"), F.sum("bytes").alias("all_bytes"))
    mean = F.expr(f"weight / all_weight * all_bytes * {float(epochs)!r}D / bytes")
    found = weighed.join(F.broadcast(total)).select("source", mean.alias("rate")).withColumn("parts", F.ceil(F.col("rate") / PART).cast("int"))
    cdf = F.expr(f"aggregate(sequence(1, {STEPS}), named_struct('p', exp(-rate / parts), 'cdf', array(exp(-rate / parts))), "
                 "(a, k) -> named_struct('p', a.p * (rate / parts) / k, 'cdf', concat(a.cdf, array(element_at(a.cdf, -1) + a.p * (rate / parts) / k))), "
                 "a -> a.cdf)")
    return found.withColumn("cdf", cdf)


def mixed(docs: DataFrame, weights: DataFrame | None = None, epochs: float = 1.0, power: float = POWER, seed: int = SEED) -> DataFrame:
    """Rows of ``docs`` repeated by a Poisson count with their source's rate, in a global random order.

    Adds n_copies, copy (from 1) and position (from 0). The count inverts the
    distribution at a number in [0, 1) that is a hash of seed and doc_id; the
    order is by a hash of seed, doc_id and copy, then by file and place. So
    equal ids get equal counts. Rows without an id are drawn and placed by file
    and place instead, each by itself. A null source is a source. Columns of ``docs``
    with the names of new ones are replaced; an empty table stays empty.
    """
    return replicate(with_row_key(docs, "_row"), rates(docs, weights, epochs, power), seed)


def mixed_ids(docs: DataFrame, weights: DataFrame | None = None, epochs: float = 1.0, power: float = POWER, seed: int = SEED) -> DataFrame:
    """doc_id, source, n_copies, copy and position of ``mixed``, without shuffling texts."""
    return replicate(with_row_key(docs, "_row").select("doc_id", "source", "_row"), rates(docs, weights, epochs, power), seed)


def replicate(docs: DataFrame, rate: DataFrame, seed: int) -> DataFrame:
    """``mixed`` for rows with a key ``_row`` of their own, which is dropped."""
    found = cut_lineage(rate).withColumnRenamed("source", "_source")
    kept = without(docs, "n_copies", "copy", "position", "_source", "rate", "parts", "cdf", "_key", "_part", "_seq", "_offset", "n_rows")
    drawn = kept.join(found, kept["source"].eqNullSafe(found["_source"]))
    # A row without an id goes by its own key, or they would all be drawn alike and stand together.
    own = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("row "), F.col("_row").cast("string")))
    place = unit(seed, own, "count")
    if_one = F.size(F.filter("cdf", lambda c: c <= F.col("_u")))
    many = F.aggregate(F.sequence(F.lit(0), F.col("parts") - 1), F.lit(0), lambda a, j: a + F.size(
        F.filter("cdf", lambda c: c <= unit(seed, own, "count", j))))
    counted = drawn.withColumn("_u", place).withColumn("n_copies", F.when(F.col("parts") == 1, if_one).otherwise(many))
    copies = (counted.where("n_copies > 0").drop("_source", "rate", "parts", "cdf", "_u")
              .withColumn("copy", F.explode(F.expr("sequence(1, n_copies)")))
              .withColumn("_key", unit(seed, own, "order", F.col("copy"))))
    return with_positions(copies, ["_key", "doc_id", "copy", "_row"]).drop("_key", "_row", "n_rows")
