"""Agglomerative clustering of stations, cut at a height.

Stations at one place are merged first (their dissimilarity is zero) and count
with their number. Only pairs of places not above the cut are ever joined, and
their connected components hold the clusters: with a reducible linkage no merge
below the cut crosses from one component to another. A component all of whose
pairs are within the cut is one cluster of the linkages that are means or
maxima of dissimilarities. In the others the tree is grown in rounds, all
components of all groups at once: every cluster finds its nearest neighbour
among the pairs not above the cut, all mutual nearest neighbours merge, and the
pairs are regrouped. This gives the clusters of the one-merge-at-a-time tree,
each round is a handful of aggregates and joins, and neither a group nor a
component is ever in one task. (The method is that of Sumengen et al. 2021,
"Scaling Hierarchical Agglomerative Clustering to Billion-sized Datasets".)

Centroid and median linkage are not reducible (a merge can bring two clusters
closer than either part was), so they can't be grown this way and are left out.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firnline.functions import geodesy as geo
from firnline.functions.labels import cluster_label
from firnline.operators.components import components
from firnline.operators.ranks import with_positions
from firnline.operators.spatial import dissimilarity_pairs
from firnline.session import Scratch, cut_lineage

REDUCIBLE = ("single", "complete", "average", "mcquitty", "ward.D", "ward.D2")
#: Linkages that are never above the largest dissimilarity of their members.
BOUNDED = ("complete", "average", "mcquitty")


def _mutual_nearest(pairs: DataFrame) -> DataFrame:
    """Pairs (lo, hi) that are the best pair of both their ends, ties by name."""
    one = F.struct("d", "u", "v")
    ends = pairs.select(F.explode(F.array("u", "v")).alias("x"), one.alias("p"))
    best = ends.groupBy("x").agg(F.min("p").alias("p"))
    return (best.groupBy("p").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") == 2)
            .select(F.col("p.u").alias("lo"), F.col("p.v").alias("hi")))


def _renamed(pairs: DataFrame, merges: DataFrame) -> DataFrame:
    """Pairs with both ends replaced by their merged cluster, as a < b."""
    for end, new in (("u", "_nu"), ("v", "_nv")):
        m = merges.select(F.col("hi").alias(end), F.col("lo").alias(new))
        pairs = pairs.join(m, end, "left").withColumn(new, F.coalesce(new, end))
    return (pairs.where(F.col("_nu") != F.col("_nv"))
            .withColumns({"a": F.least("_nu", "_nv"), "b": F.greatest("_nu", "_nv")}).drop("_nu", "_nv"))


def _with_parts(pairs: DataFrame, merges: DataFrame) -> DataFrame:
    """Add the second part of each end (null where the end was not merged)."""
    for end in ("a", "b"):
        pairs = pairs.join(merges.select(F.col("lo").alias(end), F.col("hi").alias(f"_{end}2")), end, "left")
    return pairs


def _expected() -> Column:
    return (F.when(F.col("_a2").isNull(), 1).otherwise(2) * F.when(F.col("_b2").isNull(), 1).otherwise(2))


def _complete_merges(pairs: DataFrame, scratch: Scratch) -> list[DataFrame]:
    """Merges (lo, hi) of each round. Complete linkage needs nothing but the pairs up to the cut."""
    rounds = []
    while not (merges := scratch.cut(_mutual_nearest(pairs))).isEmpty():
        rounds.append(merges)
        # A missing pair of parts lies above the cut, so the whole does too.
        grouped = _renamed(pairs, merges).groupBy("a", "b").agg(F.max("d").alias("d"), F.count(F.lit(1)).alias("_n"))
        whole = _with_parts(grouped, merges).where(F.col("_n") == _expected())
        after = scratch.cut(whole.select(F.col("a").alias("u"), F.col("b").alias("v"), "d"))
        scratch.free(pairs)
        pairs = after
    return rounds


def _score(dist_adj: float, elev_adj: float, a: str, b: str) -> Column:
    km = geo.chord_to_km(geo.chord(geo.cols(a), geo.cols(b)), geo.PAIR_RADIUS_KM)
    return km / dist_adj + F.abs(F.col(f"{a}e") - F.col(f"{b}e")) / elev_adj


def _linkage_distance(method: str) -> Column:
    """Linkage of clusters u, v from their cross sum s, weights nu, nv and inner sums tu, tv."""
    nu, nv = F.col("nu"), F.col("nv")
    if method == "mcquitty":
        return F.col("s")
    mean = F.col("s") / (nu * nv)
    if method == "average":
        return mean
    inner = F.col("tu") / (2 * nu * nu) + F.col("tv") / (2 * nv * nv)
    return 2 * nu * nv / (nu + nv) * (mean - inner)


def _summed_merges(pairs: DataFrame, places: DataFrame, h: float, method: str, dist_adj: float, elev_adj: float,
                   scratch: Scratch) -> list[DataFrame]:
    """Merges (lo, hi) of each round of average, mcquitty and ward linkage, from weighted sums of dissimilarities.

    A pair of clusters is stored only while its linkage is not above the cut.
    When parts merge, the sums of stored pairs add up; the sum of a pair that
    was not stored is taken from the members of its two clusters, and only
    where another pair of the same parts was stored (else the merged linkage
    is above the cut as well).
    """
    squared = method == "ward.D2"
    top = h * h if squared else h
    half = 0.5 if method == "mcquitty" else 1.0
    members = scratch.cut(places.select(
        F.col("node").alias("cluster"), "node", "px", "py", "pz", "pe",
        (F.lit(1.0) if method == "mcquitty" else F.col("n").cast("double")).alias("w")))
    clusters = scratch.cut(places.select(F.col("node").alias("cluster"), F.col("n").cast("double").alias("n"),
                                         F.lit(0.0).alias("t")))

    def with_linkage(sums: DataFrame) -> DataFrame:
        for end in ("u", "v"):
            sums = sums.join(clusters.select(F.col("cluster").alias(end), F.col("n").alias(f"n{end}"),
                                             F.col("t").alias(f"t{end}")), end)
        return scratch.cut(sums.withColumn("d", _linkage_distance(method)).where(F.col("d") <= top)
                           .select("u", "v", "s", "d"))

    first = pairs.withColumn("_delta", F.col("d") * F.col("d") if squared else F.col("d"))
    weight = members.select("node", "w")
    for end in ("u", "v"):
        first = first.join(weight.select(F.col("node").alias(end), F.col("w").alias(f"w{end}")), end)
    pairs = with_linkage(first.select("u", "v", (F.col("wu") * F.col("wv") * F.col("_delta")).alias("s")))

    rounds = []
    while not (merges := scratch.cut(_mutual_nearest(pairs))).isEmpty():
        rounds.append(merges)
        inner = merges.join(pairs.select(F.col("u").alias("lo"), F.col("v").alias("hi"), "s"), ["lo", "hi"])
        share = F.when(F.col("_a2").isNull(), 1.0).otherwise(half) * F.when(
            F.col("_b2").isNull(), 1.0).otherwise(half)

        grouped = _renamed(pairs, merges).groupBy("a", "b").agg(
            F.sum("s").alias("s"), F.count(F.lit(1)).alias("_n"))
        parts = scratch.cut(_with_parts(grouped, merges).withColumn("_whole", F.col("_n") == _expected()))

        # Members of the pairs of parts that were not stored.
        gaps = parts.where(~F.col("_whole")).select(
            "a", "b", F.explode(F.filter(F.array("a", "_a2"), lambda c: c.isNotNull())).alias("pa"), "_b2")
        gaps = gaps.withColumn("pb", F.explode(F.filter(F.array("b", "_b2"), lambda c: c.isNotNull())))
        gaps = gaps.select("a", "b", F.least("pa", "pb").alias("u"), F.greatest("pa", "pb").alias("v"))
        gaps = gaps.join(pairs.select("u", "v"), ["u", "v"], "left_anti")
        side = {e: members.select(F.col("cluster").alias(e), *[F.col(f"p{c}").alias(f"{e}{c}") for c in "xyze"],
                                  F.col("w").alias(f"w{e}")) for e in ("u", "v")}
        met = gaps.join(side["u"], "u").join(side["v"], "v")
        delta = _score(dist_adj, elev_adj, "u", "v")
        delta = delta * delta if squared else delta
        extra = met.groupBy("a", "b").agg(F.sum(F.col("wu") * F.col("wv") * delta).alias("_more"))
        merged = scratch.cut(parts.join(extra, ["a", "b"], "left").select(
            F.col("a").alias("u"), F.col("b").alias("v"),
            ((F.col("s") + F.coalesce("_more", F.lit(0.0))) * share).alias("s")))

        mine = inner.select(F.col("lo").alias("cluster"), F.col("s").alias("_cross"))
        gone = merges.select(F.col("hi").alias("cluster"), F.col("lo").alias("_new"))
        halved = merges.select(F.explode(F.array("lo", "hi")).alias("cluster"), F.lit(half).alias("_f"))
        old = members, clusters, parts, merged, pairs
        members = scratch.cut(
            members.join(halved, "cluster", "left").join(gone, "cluster", "left")
            .withColumn("w", F.col("w") * F.coalesce("_f", F.lit(1.0)))
            .withColumn("cluster", F.coalesce("_new", "cluster")).drop("_f", "_new"))
        clusters = scratch.cut(
            clusters.join(gone, "cluster", "left").withColumn("cluster", F.coalesce("_new", "cluster"))
            .groupBy("cluster").agg(F.sum("n").alias("n"), F.sum("t").alias("t"))
            .join(mine, "cluster", "left")
            .select("cluster", "n", (F.col("t") + 2 * F.coalesce("_cross", F.lit(0.0))).alias("t")))
        pairs = with_linkage(merged)
        scratch.free(*old)
    return rounds


def _linked(places: DataFrame, pairs: DataFrame, h: float, method: str, dist_adj: float, elev_adj: float) -> DataFrame:
    """(node, cluster) of the places that are in a cluster with others; ``pairs(u, v, d)`` are those up to the cut."""
    if pairs.isEmpty():
        return pairs.select(F.col("u").alias("node"), F.col("v").alias("cluster"))
    roots = components(pairs.select(F.col("u").alias("a"), F.col("v").alias("b")))
    if method == "single":
        return roots.withColumnRenamed("root", "cluster")
    with Scratch(places.sparkSession) as scratch:
        rooted = scratch.cut(pairs.join(roots.withColumnRenamed("node", "u"), "u"))
        known = roots.select("node", "root")
        if method in BOUNDED:
            full = (rooted.groupBy("root").agg(F.count(F.lit(1)).alias("_m"))
                    .join(roots.groupBy("root").agg(F.count(F.lit(1)).alias("_k")), "root")
                    .where(F.col("_m") * 2 == F.col("_k") * (F.col("_k") - 1)).select("root"))
            full = scratch.cut(full)
            done = [roots.join(full, "root", "left_semi").select(F.col("root").alias("a"), F.col("node").alias("b"))]
            rooted, known = rooted.join(full, "root", "left_anti"), roots.join(full, "root", "left_anti")
        else:
            done = []
        open_pairs = scratch.cut(rooted.select("u", "v", "d"))
        if open_pairs.isEmpty():
            rounds = []
        elif method == "complete":
            rounds = _complete_merges(open_pairs, scratch)
        else:
            rounds = _summed_merges(open_pairs, places.join(known.select("node"), "node", "left_semi"), h, method, dist_adj, elev_adj, scratch)
        links = done + [r.select(F.col("lo").alias("a"), F.col("hi").alias("b")) for r in rounds]
        if not links:
            return roots.where("false").withColumnRenamed("root", "cluster")
        return components(reduce(DataFrame.union, links)).withColumnRenamed("root", "cluster")


def cluster_stations(stations: DataFrame, dist_adj: float, elev_adj: float, h: float,
                     method: str = "complete", group: str | None = None, id: str = "ID",
                     lon: str = "LONGITUDE", lat: str = "LATITUDE", elev: str = "ELEVATION",
                     out: str = "CLUST", label: bool = False) -> DataFrame:
    """Add the cluster of each station, numbered from 1 within its group by smallest id.

    Dissimilarity is km / dist_adj + |elevation gap| / elev_adj, the tree is cut
    at ``h`` inclusive. A null coordinate is an error. With ``label`` the result
    is text, "<group>.<number>" with four digits.
    """
    if method not in REDUCIBLE:
        raise ValueError(f"unknown linkage {method!r}")
    if label and group is None:
        raise ValueError("labels need a group")
    null = F.col(lon).isNull() | F.col(lat).isNull() | F.col(elev).isNull()
    checked = stations.withColumn(elev, F.when(
        null, F.raise_error(F.lit("station without coordinates or elevation")).cast("double")
    ).otherwise(F.col(elev).cast("double")))
    keyed = checked.withColumn("_g", F.lit("") if group is None else F.col(group))
    keys = ["_g", lon, lat, elev]
    places = cut_lineage(geo.add_vector(
        keyed.groupBy(*keys).agg(F.min(id).alias("node"), F.count(F.lit(1)).alias("n")), "p", lon, lat)
        .withColumn("pe", F.col(elev)))

    pairs = dissimilarity_pairs(places, dist_adj, elev_adj, h, "node", lon, lat, elev, ["_g"]).select(
        F.col("ID1").alias("u"), F.col("ID2").alias("v"), F.col("SCORE").alias("d"))
    found = _linked(places, cut_lineage(pairs), h, method, dist_adj, elev_adj)
    placed = places.select(*keys, "node").join(found, "node", "left").withColumn("cluster", F.coalesce("cluster", "node"))
    first = placed.groupBy("_g", "cluster").agg(F.min("node").alias("_first"))
    # Numbers are places in one global order, counted from the first of the group.
    ranked = with_positions(first, ["_g", "_first"], "_at").drop("n_rows")
    starts = ranked.groupBy(F.col("_g").alias("_g0")).agg(F.min("_at").alias("_zero"))
    numbers = ranked.join(starts, F.col("_g").eqNullSafe(F.col("_g0"))).withColumn("_no", F.col("_at") - F.col("_zero") + 1)
    numbered = placed.join(numbers.select("cluster", "_no"), "cluster").select(
        *[F.col(k).alias(f"_{k}_") for k in keys], "_no")
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}_"))
    number = F.col("_no").cast("int")
    return keyed.join(numbered, same).withColumn(
        out, cluster_label(group, number) if label else number).select(*stations.columns, out)
