"""Computing costly columns once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def compute_once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that later filters and projections reuse instead of recomputing.

    A filter on a projected column is pushed below the projection by copying its
    expression; with parsing on top of parsing those copies multiply. A one-row
    generator is a boundary that expressions are not copied across.
    """
    made = F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()])))
    return df.select(*[c for c in df.columns if c not in columns], made)
