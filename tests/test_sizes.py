from pyspark.sql import functions as F

from firnline.operators import spatial
from firnline.session import Scratch, cut_lineage


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_many_rows_of_few_bytes_are_not_broadcast(spark):
    """1.2 million rows of equal values are some 10 kB of Parquet and 40 MB of memory."""
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    rows = spark.range(1_200_000).select((F.col("id") % 10).alias("k"), F.lit("r").alias("name"))
    other = spark.range(30_000_000).select((F.col("id") % 7).alias("k"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "256k")
    try:
        with Scratch(spark) as scratch:
            for table in (cut_lineage(rows), scratch.cut(rows)):
                assert "Broadcast" not in plan(other.join(table, "k"))
        assert "Broadcast" in plan(other.join(cut_lineage(rows.limit(5)), "k"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_places_of_many_polygons_are_not_broadcast(spark):
    ring = "region_id string, poly_id int, ring_id int, points array<struct<x: double, y: double>>"
    from firnline.sources.tables import polygon_edges
    box = [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0)]
    edges = polygon_edges(spark.createDataFrame([(f"r{i}", 1, 1, box) for i in range(12)], ring))
    places = spark.range(20_000).select((F.col("id") % 100 / 10).alias("LONGITUDE"), (F.floor(F.col("id") / 100) / 20).alias("LATITUDE"), "id")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "2m")
    try:
        joined = spark.range(0, 30_000_000).select((F.col("id") % 10 / 10).alias("LONGITUDE"), F.lit(1.0).alias("LATITUDE")).join(
            spatial.point_in_polygon(places, edges), ["LONGITUDE", "LATITUDE"])
        assert "Broadcast" not in plan(joined)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
