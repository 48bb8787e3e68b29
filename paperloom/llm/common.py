"""Plan shapes and small helpers that the operators of this subpackage share."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paperloom.plans.scale import scratch_folder

UPPER, LOWER = string.ascii_uppercase, string.ascii_lowercase
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def ascii_lower(col: Column) -> Column:
    """Lower-cases A-Z only, whatever the locale."""
    return F.translate(col, UPPER, LOWER)


def stored(df: DataFrame) -> DataFrame:
    """The rows written to the session's shared folder and read again: lineage ends, sizes are known to the planner."""
    path = scratch_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remainder(doc_id: Column, by: int) -> Column:
    """crc32 of the id as text, modulo `by`; an unknown id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % by


def with_position(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Adds each row's place, from 0, in the total order `order`.

    Rows are dealt out by ranges of the order, stored (so that a rerun task
    cannot move a boundary), numbered inside each range and shifted by the sizes
    of the ranges before it. Only the range sizes, one row for each range, meet
    in one task.
    """
    names = [f"_o{i}" for i in range(len(order))]
    dealt = df.select("*", *[c.alias(n) for c, n in zip(order, names)])
    dealt = stored(dealt.repartitionByRange(*[F.col(n) for n in names]).withColumn("_pid", F.spark_partition_id()))
    across = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    starts = (dealt.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
              .withColumn("_start", F.coalesce(F.sum("_n").over(across), F.lit(0))).drop("_n"))
    inside = Window.partitionBy("_pid").orderBy(*names)
    return (dealt.withColumn("_in", F.row_number().over(inside) - 1).join(F.broadcast(starts), "_pid")
            .withColumn(name, F.col("_in") + F.col("_start")).drop("_pid", "_in", "_start", *names))
