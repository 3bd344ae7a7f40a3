"""Ranks and running sums that no single task has to hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def distributed_rank(df: DataFrame, by: list[str], bucket: Column, order: list, name: str = "rank") -> DataFrame:
    """Number the rows of each group from 0, in ``order``, as column ``name``.

    ``bucket`` splits a group and must rise with ``order``: counts per bucket are
    summed up, then rows are numbered inside their bucket.  A group that holds a
    third of all rows is thus dealt over as many tasks as it has buckets.
    The columns in ``by`` must not be null.
    """
    rows = df.withColumn("__bucket", bucket)
    keys = [*by, "__bucket"]
    counts = rows.groupBy(*keys).agg(F.count("*").alias("__n"))
    before = Window.partitionBy(*by).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*keys, F.coalesce(F.sum("__n").over(before), F.lit(0)).cast("long").alias("__start"))
    inside = Window.partitionBy(*keys).orderBy(*order)
    return (
        rows.join(starts, keys)
        .withColumn(name, F.col("__start") + F.row_number().over(inside).cast("long") - 1)
        .drop("__bucket", "__start")
    )
