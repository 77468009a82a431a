"""Readers and writers."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK = "chunk_id string, pian string, ji string, zhang string, chunk_index int, original_text string, enriched_text string, context_prefix string"
LINE_ENDS = "\\r\\n|[\\n\\r\\x0B\\x0C\\x1C-\\x1E\\x85\\u2028\\u2029]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def decoded_files(spark: SparkSession, path: str, encoding: str = "gb18030") -> DataFrame:
    """(path, text, replaced): whole files, bad bytes replaced and counted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [b.as_py().decode(encoding, "replace") for b in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array([t.count("�") for t in texts], pa.int64())], names=["path", "text", "replaced"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, text string, replaced long")


def lines(files: DataFrame) -> DataFrame:
    """(doc, line_no, line) of files (path, text)."""
    return files.select(F.col("path").alias("doc"), F.posexplode(F.split("text", LINE_ENDS)).alias("line_no", "line"))


def chunks(spark: SparkSession, path: str) -> DataFrame:
    """A pretty-printed JSON array of chunks."""
    return spark.read.schema(CHUNK).option("multiLine", True).json(path)


def write_chunks(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def append_log(df: DataFrame, path: str) -> None:
    """JSON lines, appended."""
    df.write.mode("append").json(path)


def compatible(columns: list[str], wanted: list[str], optional: tuple[str, ...] = ()) -> bool:
    """Whether a stored table can be used: the wanted columns, optional ones may lack."""
    missing = set(wanted) - set(columns)
    if missing - set(optional):
        raise ValueError(f"stored table lacks {sorted(missing - set(optional))}")
    return not missing
