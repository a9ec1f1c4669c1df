"""Tables in the folder that all executors share: they cut lineage and survive the loss of any executor."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Bytes that a Parquet writer holds before it writes them out; tasks of one executor write side by side.
ROW_GROUP = 16 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where it is unset, a folder of this machine's own, on a local master only."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='factlens-')}"
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def saved(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it back: later steps survive the loss of any executor.

    What the table was made from is then garbage; collecting it lets Spark delete the
    shuffle files at once, so disk holds those of one step at a time.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    df.write.option("parquet.block.size", ROW_GROUP).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.table_path = path
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of saved() that no later step reads."""
    for table in tables:
        spark = table.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table.table_path)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
