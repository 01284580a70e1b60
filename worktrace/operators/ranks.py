"""Positions in an order, without a window over a whole video and without one task for all rows.

Rows are dealt by ranges of (group, order), written once, and numbered inside their
partition. What lies before a partition is a sum over one small row per partition and
group, so a long video or the whole table is numbered by as many tasks as it fills.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from worktrace.sources.storage import materialise

#: Rows of per-partition counts that are broadcast at most.
BROADCAST_ROWS = 500_000


def numbered(rows: DataFrame, by: Sequence[str], order: Sequence[str], name: str = "rank", total: str | None = None) -> DataFrame:
    """`rows` with their position (from 0, long) within equal `by`, in the order of `order`, and the number of rows there as `total`.

    Without `by` the whole table is one group. Nulls come first and are equal to each other. Rows that `order` does not tell apart
    are in some order of their own: give columns that do for the same result on a rerun.
    """
    keys = [*by, *order]
    sorted_rows = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    # the upper bits of the id are the partition, the lower ones the row's number in it
    at = F.monotonically_increasing_id()
    written = materialise(sorted_rows.withColumns({"_part": F.shiftright(at, 33).cast("int"), "_at": at.bitwiseAND(F.lit((1 << 33) - 1))}), "ranks")
    runs = written.groupBy("_part", *by).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    # one row per partition and group: a group has as many as the partitions it fills, and so has the table if there is no group
    within = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))
    before = F.coalesce(F.sum("_n").over(within.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    groups = [F.col(c).alias(f"_by_{i}") for i, c in enumerate(by)]
    runs = runs.select(F.col("_part").alias("_p"), *groups, "_first", before.alias("_before"), F.sum("_n").over(within).alias("_total"))
    runs = materialise(runs, "rank-runs")
    on = F.col("_part") == F.col("_p")
    for i, c in enumerate(by):
        on = on & F.col(c).eqNullSafe(F.col(f"_by_{i}"))
    joined = written.join(F.broadcast(runs) if runs.count() <= BROADCAST_ROWS else runs, on)
    out = joined.withColumn(name, F.col("_before") + F.col("_at") - F.col("_first"))
    return out.select(*rows.columns, name, *([F.col("_total").alias(total)] if total else []))


def dense_ids(rows: DataFrame, order: Sequence[str], name: str = "id", first: int = 1) -> DataFrame:
    """`rows` with ids first, first + 1, ... without gaps, in the order of `order`; the same on a rerun if that order is total."""
    return numbered(rows, [], order, "_id").withColumn(name, F.col("_id") + first).drop("_id")
