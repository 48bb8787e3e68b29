"""Places of turns in their conversations, found without gathering a conversation in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.llm.common import stored


def numbered(rows: DataFrame, group: list[str], order: list[Column], name: str) -> DataFrame:
    """Adds each row's place from 0 in its group by `order`, and `_pid`, the range it lies in; the rows are stored.

    Rows are dealt by ranges of (group, order), so a hot group covers many ranges. Only a range's first group can
    have begun in an earlier range, so there is at most one offset for each range, and the broadcast has that bound.
    `order` ascends, NULL first; equal rows go in any order. Groups must not be NULL.
    """
    order = [*order, F.monotonically_increasing_id()]  # so that equal rows can lie in several ranges
    keys = [f"_o{i}" for i in range(len(order))]
    dealt = rows.select("*", *[c.alias(k) for c, k in zip(order, keys)])
    dealt = stored(dealt.repartitionByRange(*group, *keys).withColumn("_pid", F.spark_partition_id()))
    offsets = (dealt.groupBy(*group, "_pid").agg(F.count(F.lit(1)).alias("_n"))
               .withColumn("_before", F.sum("_n").over(Window.partitionBy(*group).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)))
               .filter(F.col("_before") > 0).drop("_n"))
    inside = Window.partitionBy("_pid", *group).orderBy(*keys)
    placed = dealt.withColumn("_in", F.row_number().over(inside) - 1).join(F.broadcast(offsets), [*group, "_pid"], "left")
    return stored(placed.withColumn(name, F.col("_in") + F.coalesce("_before", F.lit(0))).drop("_in", "_before", *keys))
