"""Array to rows.

The outer generators are used on purpose: before an inner one the optimizer adds
a filter on the array's size, which evaluates the array expression a second
time.  Empty arrays leave one null row, dropped right after.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unnest(df: DataFrame, keep: list[Column | str], values: Column | str, name: str, pos: str = "pos") -> DataFrame:
    """One row per array element with its position (from 0, bigint)."""
    rows = df.select(*keep, F.posexplode_outer(values).alias(pos, name)).where(F.col(pos).isNotNull())
    return rows.withColumn(pos, F.col(pos).cast("bigint"))


def computed(df: DataFrame, keep: list[Column | str], **values: Column) -> DataFrame:
    """``keep`` and costly values that filters ask.

    The optimizer moves a filter below the projection that makes its column, and the value is made once for every condition and once more for
    the rows that stay.  No filter moves below a generator that makes the column, so here each value is made once.
    """
    return unnest_structs(df, keep, F.array(F.struct(*[v.alias(name) for name, v in values.items()])))


def unnest_structs(df: DataFrame, keep: list[Column | str], values: Column) -> DataFrame:
    """One row per struct of an array, its fields as columns."""
    rows = df.select(*keep, F.explode_outer(values).alias("__s")).where(F.col("__s").isNotNull())
    return rows.select(*[c for c in rows.columns if c != "__s"], "__s.*")
