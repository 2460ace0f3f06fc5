"""Where tables written mid-job go: the folder every executor sees."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh path below the folder named in `spark.checkpoint.dir`.

    Only a session on a `local` master may go without that setting; it then gets a
    temporary folder, as in tests. On a cluster the missing setting is an error.
    """
    conf = spark.sparkContext.getConf()
    root = conf.get(CHECKPOINT_CONF) or spark.conf.get(CHECKPOINT_CONF, None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {CHECKPOINT_CONF} to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="claimcheck-llm-")
        spark.conf.set(CHECKPOINT_CONF, root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """`df` as a table in the shared folder: run once, safe from lost executors, lineage cut."""
    path = shared_dir(df.sparkSession, name)
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
