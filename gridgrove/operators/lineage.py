"""Cutting lineage in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_checkpoint(df: DataFrame) -> DataFrame:
    """df with its lineage cut, in the session's shared folder; without one, as in tests, a temporary folder is made where all runs on one machine.

    A checkpoint keeps the size that was estimated for df, and joins multiply sizes: in a loop the estimate's digits would
    double with each round. So the rows are taken over without it; the real sizes are known when a plan runs.
    """
    spark = df.sparkSession
    shared_folder(spark)
    done = df.checkpoint()
    rows = spark._jsparkSession.internalCreateDataFrame(done._jdf.queryExecution().toRdd(), done._jdf.schema(), False)
    return DataFrame(rows, spark)


def shared_folder(spark: SparkSession) -> str:
    """The folder of checkpoints, set where it hasn't been."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not context.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
            import tempfile

            folder = tempfile.mkdtemp(prefix="shared-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def shared_table(df: DataFrame) -> DataFrame:
    """The same for many rows, as Parquet, which takes a fraction of a checkpoint's disk; the files go when the program ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)

    def drop() -> None:
        try:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the session has ended before
            pass

    atexit.register(drop)
    return spark.read.schema(df.schema).parquet(path)
