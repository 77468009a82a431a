"""Effects of micro-batches that happen once, however often a batch is tried.

A batch is written in a folder of its own, named by writer and number, which a second try overwrites
as a whole; readers take the folders that were written to their end. So an append that failed half
way leaves nothing to see, and one whose commit was lost is replaced by the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.query import StreamingQuery

from quillspark.sources import versions

Effect = Callable[[DataFrame, int], None]


def append_once(rows: DataFrame, path: str, writer: str, batch: int) -> None:
    """Appends the rows of a batch to the log at path."""
    rows.write.mode("overwrite").parquet(f"{path}/writer={writer}/batch={batch}")


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of a log, with writer and batch."""
    done = [f"{path}/{w}/{b}" for w in versions.names(spark, path) for b in versions.names(spark, f"{path}/{w}") if versions.complete(spark, f"{path}/{w}/{b}")]
    full = f"{schema}, writer string, batch long"
    if not done:
        return spark.createDataFrame([], full)
    return spark.read.schema(full).option("basePath", path).parquet(*done)


def effects(stream: DataFrame, checkpoint: str, *steps: Effect) -> StreamingQuery:
    """Runs the steps on each micro-batch, in order, over what is there now. A batch is kept while they
    run, so all see the same rows; each step has to be such that a second time changes nothing (append_once,
    or keyed.Table.upsert with writer and batch)."""

    def run(df: DataFrame, batch: int) -> None:
        held = df.persist()
        try:
            for step in steps:
                step(held, batch)
        finally:
            held.unpersist()

    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(run).start()
