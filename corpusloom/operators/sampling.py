"""Bounded samples of ids for fitting models."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Groups whose sizes are sent to every task.
MAX_GROUPS = 10_000
#: Values of the hash that decides.
RANGE = 1 << 40


def hash_sample(ids: DataFrame, most: int, by: tuple[str, ...] = ()) -> DataFrame:
    """The ``most`` ids with the least hash, of each group of ``by`` if given.

    ``ids`` has a column ``id`` and those of ``by``; repeated rows count once.  A
    first pass counts, and only ids whose hash is below four times the share that
    is wanted are ranked, so the tasks send about four times the sample, however
    many tasks and rows there are.
    """
    mark = F.pmod(F.xxhash64("id"), F.lit(RANGE))
    least = float(RANGE) * (4 * most + 64)
    if not by:
        near = ids.where(mark <= F.lit(least / max(1, ids.count()))).select("id").distinct()
        return near.orderBy(mark, "id").limit(most)
    sizes = ids.groupBy(*by).agg(F.count("*").alias("__n"))
    few = sizes.limit(MAX_GROUPS + 1).count() <= MAX_GROUPS  # then no id is shuffled before the hash has passed it
    near = ids.join(F.broadcast(sizes) if few else sizes, [*by]).where(mark <= F.lit(least) / F.col("__n")).select("id", *by).distinct()
    order = Window.partitionBy(*by).orderBy(mark, "id")
    return near.withColumn("__k", F.row_number().over(order)).where(F.col("__k") <= most).drop("__k")
