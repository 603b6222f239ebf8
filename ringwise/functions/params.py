"""One-row parameter frames as scalar subqueries.

A fitted parameter row (segment cuts, feature parameters) is attached to the
row plan as one scalar subquery - computed once, no join and no collect.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def scalar_row(params: DataFrame) -> Column:
    """A struct Column holding the single row of ``params`` (fields by name)."""
    return params.select(F.struct(*params.columns).alias("_p")).scalar()
