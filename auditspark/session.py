"""SparkSession helpers.

The engine never hard-codes cluster paths: the lineage-cutting directory comes
from ``spark.checkpoint.dir`` (set by the cluster); tests set their own.
"""
from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.driver.memory": "16g",
    # maps merged from several manifest sections: later section wins
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
}


def build_session(master: str = "local[8]", shuffle_partitions: int = 8, app: str = "auditspark",
                  extra: dict | None = None) -> SparkSession:
    b = SparkSession.builder.master(master).appName(app)
    conf = dict(DEFAULT_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    configure(spark)
    return spark


def configure(spark: SparkSession) -> SparkSession:
    """Session settings the operators rely on (safe to call repeatedly)."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.mapKeyDedupPolicy", "LAST_WIN")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared lineage-cut folder: the cluster's ``spark.checkpoint.dir``.

    Raises where neither that setting nor the context names one: a folder of this
    machine alone would be missing on the executors. Only a local session, whose
    executors are this process, gets a folder of its own.
    """
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not d and spark.sparkContext.master.startswith("local["):
        d = tempfile.mkdtemp(prefix="auditspark-shared-")
        spark.conf.set("spark.checkpoint.dir", d)
    if not d:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir(d)
    return d


def tasks(spark: SparkSession) -> int:
    """Into how many tasks rows are dealt that are few bytes, but much work (paths to list and
    read, rows to parse): a fixed number, as they must not be put together by their size."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def written(df: DataFrame) -> DataFrame:
    """As ``materialize``, for a table of many columns of which each reader wants a few:
    Parquet in the shared folder."""
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/written-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialize(df: DataFrame) -> DataFrame:
    """``df`` computed once, in the shared folder: what is read from it more than once
    isn't planned again, and lost executors don't matter."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
