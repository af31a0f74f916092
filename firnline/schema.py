"""Schemas of the core tables."""

from pyspark.sql import types as T

OBSERVATIONS = T.StructType([
    T.StructField("ID", T.StringType()),
    T.StructField("DATE", T.DateType()),
    T.StructField("ELEMENT", T.StringType()),
    T.StructField("VALUE", T.DoubleType()),
    T.StructField("MFLAG", T.StringType()),
    T.StructField("QFLAG", T.StringType()),
    T.StructField("SFLAG", T.StringType()),
])

YEARLY_CSV = T.StructType(OBSERVATIONS.fields + [T.StructField("TIME", T.StringType())])

STATIONS = T.StructType([
    T.StructField("ID", T.StringType()),
    T.StructField("LATITUDE", T.DoubleType()),
    T.StructField("LONGITUDE", T.DoubleType()),
    T.StructField("ELEVATION", T.DoubleType()),
    T.StructField("STATE", T.StringType()),
    T.StructField("NAME", T.StringType()),
    T.StructField("GSN_FLAG", T.StringType()),
    T.StructField("HCN_CRN_FLAG", T.StringType()),
    T.StructField("WMO_ID", T.StringType()),
])

EDGES = T.StructType([
    T.StructField("region_id", T.StringType()),
    T.StructField("poly_id", T.IntegerType()),
    T.StructField("ring_id", T.IntegerType()),
    T.StructField("seq", T.IntegerType()),
    T.StructField("x1", T.DoubleType()),
    T.StructField("y1", T.DoubleType()),
    T.StructField("x2", T.DoubleType()),
    T.StructField("y2", T.DoubleType()),
])

# The missing-value marks of the archive formats.
MISSING_VALUE = -9999.0
MISSING_COORDINATE = -999.9
MISSING_ELEVATION_BELOW = -100.0
