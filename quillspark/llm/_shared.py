"""Session helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or else the
    context's checkpoint folder. In local mode, where neither is set, a fresh folder of this
    machine becomes the checkpoint folder; on a cluster that is an error."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        if not context._jsc.sc().isLocal():
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="quillspark-"))
    return context._jsc.sc().getCheckpointDir().get()


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it again: lineage is cut,
    and a lost executor costs no recomputation of what lies before."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quillspark-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete staged tables that no plan reads any more."""
    for df in tables:
        context = df.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(df.staged_path)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def sha256_hex(c: Column) -> Column:
    return F.sha2(c.cast("binary"), 256)


#: Values that hold over this share of all rows are few enough to be broadcast: less than SHARE of them exist.
SHARE = 1 << 14


def spread_join(rows: DataFrame, small: DataFrame, key: str, found: str = "found", share: int = SHARE) -> DataFrame:
    """rows with found, a struct of the other columns of small: a stored table with one row for
    each value of key and n, how many rows have it; null where small has none.

    Values with more than one of `share` rows are less than `share` in number at any size of the
    tables, so these alone are broadcast. Their rows, and those whose key is null, are dealt
    out by their place in the input; all others are shuffled by key."""
    total = small.agg(F.sum("n")).first()[0] or 0
    often, other = F.col("n") * share > F.lit(total), F.struct(*[c for c in small.columns if c != key])
    hot = small.where(often).select(key, other.alias("__hot"))
    cold = small.where(~often).select(key, F.lit(0).cast("long").alias("__salt"), other.alias("__cold"))
    out = rows.join(F.broadcast(hot), key, "left")
    apart = F.col("__hot").isNotNull() | F.col(key).isNull()
    out = out.withColumn("__salt", F.when(apart, F.monotonically_increasing_id() + 1).otherwise(F.lit(0).cast("long")))
    out = out.join(cold.hint("merge"), [key, "__salt"], "left")
    return out.select(*rows.columns, F.coalesce("__hot", "__cold").alias(found))


def schema_of(df: DataFrame, *names: str) -> str:
    """DDL of the named columns of df, for the output of mapInArrow."""
    return ", ".join(f"`{n}` {df.schema[n].dataType.simpleString()}" for n in names)


def unused(df: DataFrame, name: str) -> str:
    """A column name made of name that df does not have, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    name = f"__{name}"
    while name.lower() in taken:
        name += "_"
    return name


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """Jobs that run inside hand so many rows at a time to Python, which bounds what whole
    texts take there and in the buffers of the JVM."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def share_limit(share: int, n: int) -> int:
    """The largest 63-bit hash that is drawn where about `share` of n rows are wanted."""
    return (1 << 63) - 1 if share >= n else ((share << 63) // n)


def drawn(hash: Column, limit: Column) -> Column:
    """Whether a row with this 64-bit hash is drawn; no share is too small for it to be seen."""
    return hash.bitwiseAND(F.lit((1 << 63) - 1)) <= limit
