"""Cutting a plan's lineage with a table in the cluster's shared folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where the session names none, a temporary one on local masters; a cluster's
    executors would each write to a disk of their own and read only part of it again, so there it is an error."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", "") or spark.conf.get("spark.checkpoint.dir", "") or ""
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not (own := getattr(spark.sparkContext, "_webloom_dir", "")):
        own = spark.sparkContext._webloom_dir = tempfile.mkdtemp(prefix="webloom-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
    return own


def keep(df: DataFrame) -> DataFrame:
    """Write df once and read it again: later uses see the same rows, without computing them anew,
    and the loss of an executor can't lose them. The files go when the application ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/webloom-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_drop, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def _drop(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:
        pass
