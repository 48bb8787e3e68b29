"""Plan shapes that hold when one group carries a large share of all rows.

A plain window sends a whole group to one task. The helpers here either fold
the group map-side (`first_per_key`), cut it map-side before the last shuffle
(`top_per_group`) or scan it in blocks whose totals are joined back
(`running_total`, `next_position`), so no task ever holds an unbounded group.
"""

import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SALTS = 64
BLOCK = 4096


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """First row of each key by `order`, ties broken by the remaining columns.

    An aggregate, so copies of a hot key are folded before the shuffle.
    """
    rest = [c for c in df.columns if c not in keys]
    ranked = [o.alias(f"_o{i}") for i, o in enumerate(order)]
    picked = df.groupBy(*keys).agg(
        F.min(F.struct(*ranked, *[F.col(c) for c in rest])).alias("_first"))
    return picked.select(
        *[F.col(c) if c in keys else F.col(f"_first.{c}").alias(c) for c in df.columns])


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], k: int,
                  rank: str = "rank") -> DataFrame:
    """Rows ranked 1..k of each group by ascending `order`, with the rank in column `rank`.

    Two rounds: first per slice of the group, then over the at most k * SALTS
    survivors. `rank <= k` is a literal limit, so Spark also cuts each round
    map-side. Slices follow the input partitions, which lets that first cut see
    all rows its task holds of a group; the result does not depend on them.
    """
    salted = df.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
    by_slice = Window.partitionBy(*keys, "_salt").orderBy(*order)
    by_group = Window.partitionBy(*keys).orderBy(*order)
    return (salted.withColumn(rank, F.row_number().over(by_slice)).filter(F.col(rank) <= k)
            .withColumn(rank, F.row_number().over(by_group)).filter(F.col(rank) <= k)
            .drop("_salt"))


def running_total(df: DataFrame, group: list[str], block: list[Column], order: list[Column],
                  value: Column, out: str) -> DataFrame:
    """Sum of `value` over the rows before this one, per group, in (block, order) order.

    `block` must be a non-null prefix of the total order. Each block is scanned
    by its own task; block sums are scanned per group and joined back.
    """
    names = [f"_b{i}" for i in range(len(block))]
    keyed = df.select("*", *[b.alias(n) for b, n in zip(block, names)], value.alias("_v"))
    inside = (Window.partitionBy(*group, *names).orderBy(*order)
              .rowsBetween(Window.unboundedPreceding, -1))
    across = (Window.partitionBy(*group).orderBy(*names)
              .rowsBetween(Window.unboundedPreceding, -1))
    offsets = (keyed.groupBy(*group, *names).agg(F.sum("_v").alias("_sum"))
               .withColumn("_before", F.coalesce(F.sum("_sum").over(across), F.lit(0)))
               .drop("_sum"))
    scanned = keyed.withColumn("_in", F.coalesce(F.sum("_v").over(inside), F.lit(0)))
    joined = null_safe_join(scanned, offsets, group + names)
    return joined.withColumn(out, F.col("_in") + F.col("_before")).drop("_in", "_before", "_v", *names)


def running_total_in_place(df: DataFrame, group: list[str], block: list[Column], dealt: str, order: list[Column],
                           value: Column, out: str) -> DataFrame:
    """`running_total` over rows that are already dealt out by the column `dealt`, the last part of their blocks: they do not move again.

    Only the block sums move. What stands before a block comes back as one more row of it, read before its others.
    """
    names = [f"_b{i}" for i in range(len(block))]
    keyed = df.select("*", *[b.alias(n) for b, n in zip(block, names)], value.cast("long").alias("_v"), F.lit(True).alias("_own"))
    across = Window.partitionBy(*group).orderBy(*names, dealt).rowsBetween(Window.unboundedPreceding, -1)
    inside = (Window.partitionBy(*group, *names, dealt).orderBy("_own", *order)
              .rowsBetween(Window.unboundedPreceding, -1))
    sums = keyed.groupBy(*group, *names, dealt).agg(F.sum("_v").alias("_sum"))
    starts = sums.select(*group, *names, dealt, F.coalesce(F.sum("_sum").over(across), F.lit(0)).alias("_v"),
                         F.lit(False).alias("_own")).repartition(dealt)
    together = keyed.unionByName(starts, allowMissingColumns=True)
    return together.withColumn(out, F.sum("_v").over(inside)).filter("_own").drop("_v", "_own", *names)


def next_position(df: DataFrame, group: list[str], page: str, order: list[str], mark: Column,
                  out: str, value: Column) -> DataFrame:
    """`value` of the nearest later row of the group where `mark` holds (NULL if none).

    Rows are looked up inside a block of BLOCK pages; rows past the last mark of
    their block take the first mark of the next marked block.
    """
    blocked = df.withColumn("_blk", F.floor(F.col(page) / BLOCK))
    flagged = blocked.withColumn("_val", F.when(mark, value))
    # The nearest later mark, read backwards, so that each row is looked at once.
    after = (Window.partitionBy(*group, "_blk").orderBy(*[F.col(o).desc() for o in order])
             .rowsBetween(Window.unboundedPreceding, -1))
    first_mark = F.when(F.col("_val").isNotNull(), F.struct(*order, F.col("_val").alias("_v")))
    marked = flagged.groupBy(*group, "_blk").agg(F.min(first_mark).getField("_v").alias("_head"))
    later = (Window.partitionBy(*group).orderBy(F.col("_blk").desc())
             .rowsBetween(Window.unboundedPreceding, -1))
    ahead = (marked.withColumn("_ahead", F.last("_head", ignorenulls=True).over(later))
             .drop("_head"))
    return (flagged.withColumn("_near", F.last("_val", ignorenulls=True).over(after))
            .join(ahead, group + ["_blk"], "left")
            .withColumn(out, F.coalesce("_near", "_ahead"))
            .drop("_blk", "_val", "_near", "_ahead"))


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join on keys that may be NULL, keeping the left key columns."""
    renamed = reduce(lambda d, k: d.withColumnRenamed(k, f"_r_{k}"), keys, right)
    condition = reduce(lambda a, b: a & b,
                       [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys])
    return left.join(renamed, condition, how).drop(*[f"_r_{k}" for k in keys])


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the folder the session names (a scratch folder only in local mode)."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="paperloom-ckpt-"))
    return df.checkpoint()


def stored_table(df: DataFrame) -> DataFrame:
    """The rows written below the session's shared folder and read again, so that lineage ends and the planner knows their size."""
    path = scratch_folder(df)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scratch_folder(df_or_spark) -> str:
    """A new folder for written tables below the session's shared folder (local scratch in local mode)."""
    spark = getattr(df_or_spark, "sparkSession", df_or_spark)
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return f"{shared.rstrip('/')}/paperloom-{uuid.uuid4().hex}"
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    return tempfile.mkdtemp(prefix="paperloom-") + "/out"
