"""The folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``. In a single-process session without it, a temporary one is set; on a cluster its absence is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="lorebase-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def keep(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` computed once, written to the shared folder and read from there."""
    path = f"{shared_dir(rows.sparkSession)}/lorebase/{name}-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def spread(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` dealt by a key to at least a few tasks for each core, however few bytes they come to: a worker gets a whole task's rows in one batch."""
    spark = rows.sparkSession
    return rows.repartition(max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), key)
