"""The folder that driver and executors share, and tables written there to cut lineage.

The cluster names the folder in ``spark.checkpoint.dir``. Only where that is unset and everything runs on
one machine, as in tests, a temporary folder stands in for it; on a cluster that is an error.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not path:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="isoloom-")
        sc.setCheckpointDir(path)
    return path


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/isoloom/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: what follows doesn't recompute it.

    A lost executor loses nothing of it, unlike localCheckpoint or cache.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.isoloom_path = path
    return table


def spread(df: DataFrame, name: str) -> DataFrame:
    """:func:`materialise` for tables that grow with the input: their joins are sort-merge joins.

    Files of numbers and names pack so well that a large table passes for small, and would go through the driver as a broadcast, in
    loops once a round.
    """
    table = materialise(df, name)
    hinted = table.hint("merge")
    hinted.isoloom_path = table.isoloom_path
    return hinted


def discard(df: DataFrame) -> None:
    """Delete the files of a table made by :func:`materialise` or :func:`spread` that nothing reads any more."""
    spark = df.sparkSession
    if name := getattr(df, "isoloom_path", None):
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
