"""Joins of tables that grow with their graph."""

from __future__ import annotations

from pyspark.sql import DataFrame


def shuffled(df: DataFrame) -> DataFrame:
    """df, for a join by node or edge: its rows meet the others where they are shuffled to. Files of a few MB hold many times
    that in rows, and a broadcast would send these through the driver, round after round.
    """
    return df.hint("merge")
