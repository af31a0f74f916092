"""Columns that take the place of others."""

from __future__ import annotations

from pyspark.sql import DataFrame


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without columns that have one of these names in any case, so that new ones can take them."""
    taken = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in taken])
