"""Where iterative operators cut their lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder named by spark.checkpoint.dir, else in the context's checkpoint
    folder. In local mode a folder of this machine serves where neither is set; on a
    cluster that is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        context = spark.sparkContext
        if not context._jsc.sc().getCheckpointDir().isDefined():
            if not context._jsc.sc().isLocal():
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="quillspark-"))
        folder = context._jsc.sc().getCheckpointDir().get()
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Writes df in the shared folder and reads it again, so that later plans see real sizes."""
    path = fresh_path(df.sparkSession, "cut")
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.cut_path = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Deletes what cut() wrote, where no plan reads it any more."""
    for df in tables:
        context = df.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(df.cut_path)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def source_key(df: DataFrame) -> tuple | None:
    """What df is made of: its application, its plan, and the files it reads with their sizes and
    times. None where it reads no files, as the rows of such a table can't be told apart."""
    files = df.inputFiles()
    if not files:
        return None
    context = df.sparkSession.sparkContext
    stamps = []
    for name in sorted(files):
        path = context._jvm.org.apache.hadoop.fs.Path(name)
        status = path.getFileSystem(context._jsc.hadoopConfiguration()).getFileStatus(path)
        stamps.append((name, status.getLen(), status.getModificationTime()))
    return (context.applicationId, df.semanticHash(), *stamps)
