"""Session settings that make Spark SQL answer evidence queries the way they were written."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DATA_VIEW = "data"

SESSION_CONFS = {
    "spark.sql.ansi.enabled": "true",
    # "Churn" must be a column, not the string 'Churn'.
    "spark.sql.ansi.doubleQuotedIdentifiers": "true",
    # SELECT ... FROM text.`/etc/passwd` must not resolve.
    "spark.sql.runSQLOnFiles": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Claim tables are small in bytes and heavy in text rules: keep all cores busy on them.
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "4KB",
}


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh path under the cluster's checkpoint folder, for tables written mid-job.

    Only a session on a `local` master may go without `spark.checkpoint.dir`: elsewhere each
    executor would write to a disk of its own.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="claimcheck-"))
    return f"{sc.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Run `df` once and go on from a table written in the shared folder.

    Later steps survive lost executors without running it again, read only the columns
    they need, and know its size when a join is planned.
    """
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def adopt(spark: SparkSession, df: DataFrame) -> DataFrame:
    """`df` bound to `spark`, whichever session it was made in."""
    name = f"adopted_{uuid.uuid4().hex}"
    df.createGlobalTempView(name)
    try:
        return spark.table(f"global_temp.{name}")
    finally:
        spark.catalog.dropGlobalTempView(name)


class ClaimSession:
    """A child session holding one dataset as the view `data`.

    Views and settings stay inside the child, so several datasets can be checked
    side by side even though each of them is called `data`.
    seconds: how long one evidence text may run by itself; None sets no limit.
    """

    def __init__(self, spark: SparkSession, seconds: float | None = None):
        self.spark = spark.newSession()
        self.seconds = seconds
        for key, value in SESSION_CONFS.items():
            self.spark.conf.set(key, value)

    def adopt(self, df: DataFrame) -> DataFrame:
        """The same DataFrame, bound to this session."""
        return adopt(self.spark, df)

    def register(self, df: DataFrame) -> DataFrame:
        """Expose `df` as the view `data` and return it bound to this session."""
        data = self.adopt(df)
        data.createOrReplaceTempView(DATA_VIEW)
        return data

    @property
    def data(self) -> DataFrame:
        return self.spark.table(DATA_VIEW)
