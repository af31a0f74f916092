"""Tables by name, and the station views that the queries build on them.

The driver's tables are not weather records, so each station table is a view
over them: suppliers (or parts) are stations, line items are daily
observations, nations are states.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

OBS_TIES = ("k_order", "k_line", "k_part", "k_supp")
OBS_ORDER = ("DATE", *OBS_TIES)


class Catalog:
    """Lazily reads ``<root>/<name>.parquet``; attribute access returns the table."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}.parquet")

    def register(self, *names: str) -> None:
        for name in names:
            self.table(name).createOrReplaceTempView(name)

    def _observations(self, id_column: str, zero_up_to: int) -> DataFrame:
        li = self.table("lineitem")
        q = F.col("l_quantity")
        value = (F.when(q <= zero_up_to, F.lit(0.0))
                 .when(F.col("l_orderkey") % 499 == 0, q * 100).otherwise(q))
        mflag = F.when(F.col("l_discount") >= 0.095, "P").when(F.col("l_discount") >= 0.085, "T")
        tax = F.col("l_tax")
        qflag = (F.when(tax >= 0.075, "G").when(tax < 0.005, F.lit(None).cast("string"))
                 .when(tax < 0.015, " ").otherwise(""))
        return li.select(
            F.col(id_column).alias("ID"), F.col("l_shipdate").cast("date").alias("DATE"),
            F.when(F.col("l_returnflag") == "A", "WESD").otherwise("SNWD").alias("ELEMENT"),
            value.alias("VALUE"), mflag.alias("MFLAG"), qflag.alias("QFLAG"),
            F.col("l_linestatus").alias("SFLAG"),
            F.col("l_orderkey").alias("k_order"), F.col("l_linenumber").alias("k_line"),
            F.col("l_partkey").alias("k_part"), F.col("l_suppkey").alias("k_supp"))

    @property
    def obs(self) -> DataFrame:
        """Dense observations, one station per supplier."""
        return self._observations("l_suppkey", 5)

    @property
    def obs_sparse(self) -> DataFrame:
        """Sparse observations with many zeros, one station per part."""
        return self._observations("l_partkey", 25)

    @property
    def stations(self) -> DataFrame:
        s, n = self.table("supplier"), self.table("nation")
        k, nk = F.col("s_suppkey"), F.col("n_nationkey")
        return s.join(n, F.col("s_nationkey") == nk).select(
            k.alias("ID"),
            (30 + (k * 53 % 200) / 10.0).alias("LATITUDE"),
            (-125 + (k * 37 % 600) / 10.0).alias("LONGITUDE"),
            (k * 97 % 3000).cast("double").alias("ELEVATION"),
            F.col("n_name").alias("STATE"), F.col("s_name").alias("NAME"),
            F.concat_ws(".", F.col("n_regionkey") + 1, nk % 3 + 1, nk % 15 + 1).alias("ECO3"),
            F.when(nk % 5 != 0, (40 + nk % 10).cast("double")).alias("STATE_MAX"),
            F.concat(F.lit("C"), k % 4).alias("COUNTY"))

    @property
    def county_maxes(self) -> DataFrame:
        n = self.table("nation").select(F.col("n_name").alias("STATE"))
        return (n.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(3))))
                .withColumn("DAYS", F.explode(F.sequence(F.lit(1), F.lit(10))))
                .select("STATE", F.concat(F.lit("C"), "i").alias("COUNTY"), "DAYS",
                        (20 + 2 * F.col("DAYS")).cast("double").alias("COUNTY_MAX")))

    @property
    def places(self) -> DataFrame:
        """Many places with a value, one per customer."""
        k = F.col("c_custkey")
        return self.table("customer").select(
            k.alias("ID"), (-125 + (k * 37 % 6007) / 100.0).alias("LONGITUDE"),
            (30 + (k * 53 % 2003) / 100.0).alias("LATITUDE"),
            (k * 89 % 3001).cast("double").alias("ELEVATION"), F.col("c_acctbal").alias("VALUE"))

    def grid_spec(self):
        from firnline.operators.grid import GridSpec
        n = self._grid_side()
        return GridSpec(-125.0, 30.0, 60.0 / (n - 1), 20.0 / (n - 1))

    def _grid_side(self) -> int:
        # The row count comes from the file footers.
        return math.ceil(math.sqrt(self.table("part").count()))

    @property
    def grid(self) -> DataFrame:
        """A square climate grid over the stations, one cell per part."""
        n, s = self._grid_side(), self.grid_spec()
        k = F.col("p_partkey")
        row, col, size = F.floor(k / n), k % n, F.col("p_size")
        return self.table("part").select(
            row.alias("row"), col.alias("col"), (F.lit(s.x0) + col * s.dx).alias("x"),
            (F.lit(s.y0) + row * s.dy).alias("y"),
            F.when(size >= 6, F.col("p_retailprice")).alias("PPTWT"),
            size.cast("double").alias("TD"), (size - 10).cast("double").alias("MAT"))

    def rectangles(self, rows) -> DataFrame:
        """Edge table of rectangles (id, x0, y0, x1, y1), one polygon each."""
        from firnline.sources.tables import polygon_edges
        rings = [(r, 1, 1, [(a, b), (c, b), (c, d), (a, d)]) for r, a, b, c, d in rows]
        schema = ("region_id string, poly_id int, ring_id int, "
                  "points array<struct<x: double, y: double>>")
        return polygon_edges(self.spark.createDataFrame(rings, schema))
