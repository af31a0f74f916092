"""Yearly CSV files, station inventory, review lists, polygon and grid tables, sinks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from firnline.schema import EDGES, MISSING_VALUE, STATIONS, YEARLY_CSV
from firnline.sources.scans import ELEMENTS

# Column widths of the station inventory.
INVENTORY_WIDTHS = [11, 9, 10, 7, 3, 31, 4, 4, 6]


def get_year_data(spark: SparkSession, source: str, years, elements=ELEMENTS,
                  spread: int | None = None) -> DataFrame:
    """Observations from ``<year>.csv`` or ``<year>.csv.gz`` files without a header.

    Years without a file are skipped. A compressed file is one task whatever its
    size; ``spread`` redistributes the rows over that many partitions after the
    filters.
    """
    glob = "{" + ",".join(str(y) for y in years) + "}.csv*"
    raw = (spark.read.schema(YEARLY_CSV).option("dateFormat", "yyyyMMdd")
           .option("ignoreMissingFiles", "true").option("pathGlobFilter", glob).csv(source))
    rows = raw.where(F.col("ELEMENT").isin(*elements) & (F.col("VALUE") != MISSING_VALUE)
                     & F.col("DATE").isNotNull()).drop("TIME")
    return rows if spread is None else rows.repartition(spread)


def write_year_data(obs: DataFrame, folder: str) -> None:
    """Observations as files ``<year>.csv.gz``, which a year fills alone, as the format has it."""
    spark = obs.sparkSession
    rows = obs.select("ID", F.date_format("DATE", "yyyyMMdd").alias("DATE"), "ELEMENT", F.col("VALUE").cast("bigint").alias("VALUE"),
                      "MFLAG", "QFLAG", "SFLAG", F.lit("0700").alias("TIME"), F.year("DATE").alias("_year"))
    parts = f"{folder.rstrip('/')}/_parts"
    rows.repartition("_year").write.partitionBy("_year").option("compression", "gzip").csv(parts)
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path
    store = jvm_path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    for f in store.globStatus(jvm_path(f"{parts}/_year=*/part-*")):  # a file for each year
        year = f.getPath().getParent().getName().split("=")[1]
        store.rename(f.getPath(), jvm_path(f"{folder}/{year}.csv.gz"))
    store.delete(jvm_path(parts), True)


def missing_years(spark: SparkSession, source: str, years: list[int]) -> DataFrame:
    """Requested years without a file."""
    present = (spark.read.format("binaryFile").option("pathGlobFilter", "*.csv*").load(source)
               .select(F.regexp_extract("path", r"([^/]+)\.csv(\.gz)?$", 1).alias("YEAR")))
    wanted = spark.createDataFrame([(str(y),) for y in years], "YEAR string")
    return wanted.join(present, "YEAR", "left_anti").select(F.col("YEAR").cast("int").alias("YEAR"))


def parse_inventory(lines: DataFrame, column: str = "value") -> DataFrame:
    """Station table from fixed-width inventory lines; blank fields are null."""
    line, at, out = F.col(column), 1, []
    for field, width in zip(STATIONS.fields, INVENTORY_WIDTHS):
        text = F.trim(line.substr(at, width))
        out.append(F.when(text != "", text).try_cast(field.dataType).alias(field.name))
        at += width
    return lines.select(*out)


def read_inventory(spark: SparkSession, path: str) -> DataFrame:
    return parse_inventory(spark.read.text(path))


def list_files(spark: SparkSession, source: str, pattern: str) -> list[str]:
    """Paths in ``source`` whose name matches a regular expression, in name order."""
    found = (spark.read.format("binaryFile").load(source).select("path")
             .where(F.regexp_extract("path", "([^/]+)$", 1).rlike(pattern)))
    return sorted(r.path for r in found.collect())


def read_review_lists(spark: SparkSession, paths) -> DataFrame:
    """Hand-made CSV lists with differing columns as one table of strings.

    Columns are matched by name and missing ones are null; ``_path`` names the
    file. There are a handful of such files, one plan branch each.
    """
    parts = [spark.read.option("header", "true").csv(p).withColumn("_path", F.lit(p)) for p in paths]
    if not parts:
        raise FileNotFoundError("no review lists")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def read_csv(spark: SparkSession, path: str, schema=None) -> DataFrame:
    reader = spark.read.option("header", "true")
    return (reader.schema(schema) if schema else reader).csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", "true").csv(path)


def save_table(df: DataFrame, path: str, partition_by=()) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def save_observations(obs: DataFrame, path: str) -> None:
    """Observations laid out by element and year, so that scans prune folders."""
    dated = obs.withColumn("YEAR", F.year("DATE"))
    (dated.repartition("ELEMENT", "YEAR", F.pmod(F.hash("ID"), F.lit(64))).sortWithinPartitions("ID", "DATE")
     .write.mode("overwrite").partitionBy("ELEMENT", "YEAR").parquet(path))


def read_polygon_edges(spark: SparkSession, path: str) -> DataFrame:
    """Polygon layer as an edge table."""
    return spark.read.schema(EDGES).parquet(path)


def polygon_edges(rings: DataFrame) -> DataFrame:
    """Edge table from rows (region_id, poly_id, ring_id, points), points an array of (x, y).

    A ring closes itself when its last point differs from its first.
    """
    p = F.col("points")
    closed = F.when(p[0] != F.element_at(p, -1), F.concat(p, F.slice(p, 1, 1))).otherwise(p)
    steps = F.transform(F.sequence(F.lit(0), F.size("_c") - 2), lambda i: F.struct(
        i.cast("int").alias("seq"), F.get("_c", i)["x"].alias("x1"), F.get("_c", i)["y"].alias("y1"),
        F.get("_c", i + 1)["x"].alias("x2"), F.get("_c", i + 1)["y"].alias("y2")))
    return (rings.withColumn("_c", closed).select("region_id", "poly_id", "ring_id", F.explode(steps).alias("e"))
            .select("region_id", "poly_id", "ring_id", "e.seq", "e.x1", "e.y1", "e.x2", "e.y2"))


def read_grid(spark: SparkSession, path: str) -> DataFrame:
    """Grid layer as a table of cells: row, col, x, y and one column per variable."""
    return spark.read.parquet(path)
