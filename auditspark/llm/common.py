"""Helpers shared by the training-data operators.

* ``cut``: write a table to the shared folder and read it again (lineage cut
  that survives lost executors).
* ``ordered_prefix``: exclusive running sums over a global order without a
  single-partition window.
* ``tiles`` / ``whole_groups``: bounded work units for pairs within buckets.
"""
from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, ``spark.checkpoint.dir``.

    A folder of its own is made only for a local session that names none.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        d = tempfile.mkdtemp(prefix="llm-shared-", dir=os.environ.get("TMPDIR", "/tmp"))
        spark.conf.set("spark.checkpoint.dir", d)
    return d


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses."""
    return f"{shared_dir(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a Parquet table in the shared folder, and read again."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cut_by(df: DataFrame, key: str, name: str) -> DataFrame:
    """As ``cut``, in one bucket of ``key`` for each shuffle partition: joins and
    aggregates by ``key`` read it without a shuffle."""
    spark = df.sparkSession
    path = new_path(spark, name)
    known = "llm_" + uuid.uuid4().hex
    (df.write.format("parquet").option("path", path).option("compression", "zstd").bucketBy(parallelism(spark), key).sortBy(key)
     .saveAsTable(known))
    out = spark.table(known)
    out.schema  # resolved; the session's catalogue need not keep the name
    spark.sql(f"DROP TABLE {known}")
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, name: str) -> str:
    """``name`` behind as many underscores as make it no column of ``df``."""
    taken = {c.lower() for c in df.columns}
    name = f"_{name}"
    while name.lower() in taken:
        name = f"_{name}"
    return name


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ordered_prefix(df: DataFrame, order: list, sums: dict[str, str], name: str) -> DataFrame:
    """``df`` with exclusive running sums over the total order ``order``.

    ``sums`` maps a new column to the column it sums. Rows are range-partitioned
    by the order and written once, so a recomputed task cannot see other range
    bounds; only one row of totals for each partition is summed globally.
    """
    spark = df.sparkSession
    ranged = cut(df.repartitionByRange(parallelism(spark), *order).withColumn("_part", F.spark_partition_id()), name)
    totals = ranged.groupBy("_part").agg(*[F.sum(c).alias(f"_t_{k}") for k, c in sums.items()])
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("_part", *[F.coalesce(F.sum(f"_t_{k}").over(before), F.lit(0)).alias(f"_b_{k}") for k in sums])
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = ranged.join(F.broadcast(bases), "_part")  # one row for each of the shuffle partitions
    for k, c in sums.items():
        out = out.withColumn(k, (F.col(f"_b_{k}") + F.coalesce(F.sum(c).over(inside), F.lit(0))).cast("long"))
    return out.drop("_part", *[f"_b_{k}" for k in sums])


def tiles(rows: DataFrame, key: list[str], member: str, limit: int) -> DataFrame:
    """Rows of every bucket ``key`` with at least two rows, dealt into tiles.

    A bucket of up to ``limit`` rows is one tile. A larger one is split into
    sub-blocks by the hash of ``member``, and every pair of sub-blocks is a tile
    of its own: each pair of the bucket meets in some tile, and no task gets more
    than about two sub-blocks at once. Adds ``_tile`` (the lower sub-block in the
    upper bits) and ``_block``, the row's own sub-block.
    """
    sizes = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).where("_n >= 2")
    many = rows.join(sizes, key).withColumn("_s", F.ceil(F.col("_n") / F.lit(limit)).cast("int"))
    sub = many.withColumn("_i", F.pmod(F.xxhash64(F.lit(7), F.col(member)), F.col("_s")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("_s") - 1))
    both = sub.withColumn("_j", other)
    tile = F.least("_i", "_j").cast("long") * F.lit(1 << 31) + F.greatest("_i", "_j")
    return both.withColumn("_tile", tile).withColumnRenamed("_i", "_block").drop("_n", "_s", "_j")


def deal(rows: DataFrame, key: list[str]) -> DataFrame:
    """Rows with all of a group (``key``) in one partition, sorted by the group."""
    return rows.repartition(parallelism(rows.sparkSession), *key).sortWithinPartitions(*key)


def whole_groups(batches: Iterator[pa.RecordBatch], key: list[str], rows: int = 1 << 16) -> Iterator[pa.Table]:
    """Tables of complete groups from batches sorted by ``key``, about ``rows`` each."""
    held: list[pa.RecordBatch] = []
    n = 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        n += b.num_rows
        if n < rows:
            continue
        t = pa.Table.from_batches(held).combine_chunks()
        last = t.num_rows - 1
        same = None
        for k in key:
            col = t.column(k)
            eq = pa.compute.equal(col, col[last])
            same = eq if same is None else pa.compute.and_(same, eq)
        start = pa.compute.index(same, True).as_py()
        if start:
            yield t.slice(0, start)
            rest = t.slice(start).combine_chunks()
            held, n = rest.to_batches(), rest.num_rows
        else:
            held, n = t.to_batches(), 0  # one group so far: look again after as many rows more
    if held:
        yield pa.Table.from_batches(held).combine_chunks()
