"""Positions inside a group, without ever sorting one whole group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_position(
    df: DataFrame,
    keys: list[str],
    order: list[str | Column],
    *,
    block: Column,
    position: str = "position",
    total: str | None = None,
) -> DataFrame:
    """0-based position of each row in its group, and the size of the group if asked for.

    ``block`` must never fall when rows are put in ``order``; it cuts a group into pieces that are
    sorted apart. Blocks are then counted, the counts summed along the group, and each block told
    where it starts. Keys and block must not be null. A group that holds a third of all rows is spread over as many tasks as it has
    blocks; only its block counts meet in one place.
    """
    blocked = df.withColumn("_block", block)
    piece = [*keys, "_block"]
    starts = blocked.groupBy(*piece).agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    columns = {"_start": F.coalesce(F.sum("_rows").over(before), F.lit(0))}
    if total:
        columns[total] = F.sum("_rows").over(Window.partitionBy(*keys))
    starts = starts.withColumns(columns).drop("_rows")

    inside = F.row_number().over(Window.partitionBy(*piece).orderBy(*order)) - 1
    joined = blocked.join(starts, piece, "left")
    return joined.withColumn(position, F.col("_start") + inside).drop("_block", "_start")
