"""Tables in the folder that the cluster shares for checkpoints."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT = "spark.checkpoint.dir"


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; a local one only on a local master whose session names none."""
    context = spark.sparkContext
    folder = spark.conf.get(CHECKPOINT, None) or context.getConf().get(CHECKPOINT) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local["):
            raise ValueError(f"{CHECKPOINT} must name a folder that the driver and all executors share")
        context.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='tidemark-')}")
        folder = context.getCheckpointDir()
    return f"{folder.rstrip('/')}/tidemark/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """The rows written to the shared folder and read back: computed once, however often they are used."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_staged(df: DataFrame) -> None:
    """Delete the files of a staged table that nothing reads any more."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/tidemark/" in folder:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
