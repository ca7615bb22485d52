"""What the operators of this folder read from or set on a Spark session."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from helixgrid.shipping import ship

#: Rows and bytes an Arrow batch holds at most: texts can be long, and a Python worker holds whole batches.
ARROW_ROWS = 512
ARROW_BYTES = 2 << 20


def prepare(spark: SparkSession) -> SparkSession:
    """Ships the package to Python workers and bounds Arrow batches for long texts.

    The settings stay on the session, since DataFrames are computed after the call that made them. The last one lets
    Spark remove the shuffle files of a query or checkpoint when it has ended, not when the driver next collects garbage.
    """
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local session (tests) gets one made where it is unset."""
    got = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    sc = spark.sparkContext
    if not got:
        known = sc._jsc.sc().getCheckpointDir()
        if not known.isDefined() and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        got = known.get() if known.isDefined() else "file://" + tempfile.mkdtemp(prefix="helixgrid-")
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(got)
    return got


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A new folder name below the shared one."""
    return os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")


def unused(df: DataFrame, name: str) -> str:
    """A name that no column has, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder that fresh_dir() named, whatever store it lies in."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def cut(df: DataFrame) -> DataFrame:
    """The same rows, read from the shared folder: a lost executor costs no more than what follows."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
