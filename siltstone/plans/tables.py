"""Scans and written intermediate tables.

A plan that uses one expensive result twice writes it to the shared folder named by
``spark.checkpoint.dir`` (all executors see that folder, so a lost executor costs a re-read and
never a re-computation).  Only where the setting is absent and the session is local, as in tests, a
temporary folder is used; on a cluster its absence is an error, for no machine sees another's disk.
"""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; set for this session where the cluster names none."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    folder = spark.conf.get("spark.checkpoint.dir", conf)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="siltstone-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and return a scan of the written table (deleted when the JVM ends)."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)
    return spark.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Make this package importable on the executors, once per application.

    The driver serves the archive to the executors itself; nothing needs to be installed there.
    """
    context = spark.sparkContext
    if getattr(context, "_siltstone_shipped", False):
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    name = os.path.join(tempfile.gettempdir(), f"siltstone-{uuid.uuid4().hex}")
    context.addPyFile(shutil.make_archive(name, "zip", os.path.dirname(package), "siltstone"))
    context._siltstone_shipped = True


def scan(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    """Parquet scan of one table, projected to ``columns``."""
    ship(spark)
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return df.select(*columns) if columns else df


def spread(df: DataFrame) -> DataFrame:
    """Use every core for CPU-bound work on an input that has fewer files than cores.

    Inputs with at least as many files as cores are left alone: they pay no shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if len(df.inputFiles()) >= cores else df.repartition(cores * 2)
