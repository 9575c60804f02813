"""Positions in an order, without a task that sees all rows of a group.

Rows are range-partitioned by group and order and checkpointed, so that partitions
stay as they are; a row's number is the number of rows before its partition (prefix
sums over one row for each partition) plus its place inside. Within groups the same is
done with one row for each group and partition: a group that fills many partitions is
counted by all of them.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

_PLACE = (1 << 33) - 1  # monotonically_increasing_id counts a partition's rows in its lower bits


def positions(df: DataFrame, order: list, by: tuple = (), name: str = "position") -> DataFrame:
    """``df`` with ``name``: 1, 2, ... in ``order`` (within each group ``by``). The order
    has to be total for a defined result; rows that it doesn't tell apart are numbered anyhow."""
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(c) for c in by]
    held = materialize(df.repartitionByRange(parts, *keys, *order).sortWithinPartitions(*keys, *order))
    placed = held.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit(_PLACE)))
    if by:
        same = [F.col(c).eqNullSafe(F.col(f"_g_{c}")) for c in by]
        groups = placed.groupBy("_part", *by).agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_from"))
        before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
        groups = groups.withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_from"))
        groups = groups.select(F.col("_part").alias("_g_part"), *[F.col(c).alias(f"_g_{c}") for c in by], "_base")
        match = F.col("_part") == F.col("_g_part")
        for s in same:
            match = match & s
        out = placed.join(groups, match)
    else:
        totals = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
        before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
        totals = totals.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
        out = placed.join(F.broadcast(totals), "_part")
    return out.select(*df.columns, (F.col("_base") + F.col("_at") + 1).cast("bigint").alias(name))
