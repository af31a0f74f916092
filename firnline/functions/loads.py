"""Conversion of snow depth and water equivalent to loads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Unit factors.
CM_WATER_TO_KPA = 0.09806665
MM_WATER_TO_KPA = 0.0098064
INCH_TO_MM = 25.4
INCH_TO_CM = 2.54
KPA_TO_PSF = 20.89
PSF_TO_KPA = 0.04788

# Bulk density parameters per snow climate class
# (class, largest density, initial density, k1, k2). The ephemeral class is
# the mean of the first three.
SNOW_CLASSES = [
    ("Alpine", 0.5975, 0.2237, 0.0012, 0.0038),
    ("Maritime", 0.5979, 0.2578, 0.0010, 0.0038),
    ("Prairie", 0.5940, 0.2332, 0.0016, 0.0031),
    ("Tundra", 0.3630, 0.2425, 0.0029, 0.0049),
    ("Taiga", 0.2170, 0.2170, 0.0000, 0.0000),
]

# The two branches of the depth-only relation, depth in inches.
RMCD_BREAK = 22.0
RMCD_SHALLOW_SLOPE = 0.9
RMCD_DEEP_SLOPE = 2.36
RMCD_DEEP_OFFSET = 31.9


def snow_class_rows() -> list[tuple]:
    first = SNOW_CLASSES[:3]
    mean = tuple(sum(row[i] for row in first) / 3 for i in range(1, 5))
    return SNOW_CLASSES + [("Ephemeral", *mean)]


def snow_classes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        snow_class_rows(), "climate string, pmax double, po double, k1 double, k2 double")


def sturm_load(depth_cm: Column, day: Column, pmax, po, k1, k2) -> Column:
    """Load in kPa from depth, season day and the class parameters."""
    density = (pmax - po) * (1 - F.exp(-k1 * depth_cm - k2 * day)) + po
    return depth_cm * density * CM_WATER_TO_KPA


def rmcd_load(depth_cm: Column) -> Column:
    """Load in kPa from depth alone."""
    inches = depth_cm / INCH_TO_CM
    psf = F.when(inches < RMCD_BREAK, inches * RMCD_SHALLOW_SLOPE).otherwise(
        inches * RMCD_DEEP_SLOPE - RMCD_DEEP_OFFSET)
    return psf * PSF_TO_KPA


def to_cm(element: Column, value: Column) -> Column:
    """Archive units to centimetres: depths are mm, other elements tenths of mm."""
    return F.when(element == "SNWD", value * 0.1).otherwise(value * 0.01)
