"""Tables in the folder that driver and executors share, to cut lineage between rounds of a loop."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset and Spark runs in one process, a local folder that is then set for the session.

    On a cluster an unset folder is an error: executors would write to disks that the others cannot read.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        context = spark.sparkContext._jsc.sc()
        if context.getCheckpointDir().isDefined():
            return context.getCheckpointDir().get()
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="quillgrid-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def materialize(df: DataFrame, name: str) -> DataFrame:
    """df written as a table in the shared folder and read back."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/quillgrid/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def by_key(rows: DataFrame) -> DataFrame:
    """rows for a join by key: the size of a compressed file, from which Spark would choose a broadcast, tells little of its rows."""
    return rows.hint("merge")


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """rows dealt out by keys over as many partitions as a shuffle has, at least three a core.

    A small file of short rows is read by one task, however long each row then takes; windows by the keys need no other shuffle.
    """
    spark = rows.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism)
    return rows.repartition(n, *keys)


def discard(*tables: DataFrame) -> None:
    """Delete tables of materialize that no later step reads."""
    for df in tables:
        files = df.inputFiles()
        if files:
            folder = df.sparkSession._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
            if folder.getParent().getName() == "quillgrid":
                folder.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)
