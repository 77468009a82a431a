"""Stored tables as folders: append with checks, merges into what is there, deletes and samples."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from quillspark.functions.vectors import checked
from quillspark.operators import graph, keyed, memory
from quillspark.sources import versions
from quillspark.sources.readers import compatible


def append(rows: DataFrame, path: str, vector: str | None = None, size: int = 0) -> None:
    """Append rows; a vector of another size fails the write. A run again appends again."""
    (rows.withColumn(vector, checked(F.col(vector), size)) if vector else rows).write.mode("append").parquet(path)


def replace(rows: DataFrame, path: str) -> None:
    """Overwrite the table, also with rows that were read from it. The new rows are written beside it and
    take its place by renaming; a failure before that leaves the old ones, and one between the
    two names leaves both folders."""
    spark, mark = rows.sparkSession, uuid.uuid4().hex
    new, old = f"{path}-new-{mark}", f"{path}-old-{mark}"
    rows.write.parquet(new)
    fs, here = versions.hadoop(spark, path)
    if fs.exists(here) and not fs.rename(here, versions.hadoop(spark, old)[1]):
        raise OSError(f"{path} can't be moved")
    if not fs.rename(versions.hadoop(spark, new)[1], here):
        raise OSError(f"{new} can't be moved to {path}")
    versions.delete(spark, old)
    spark.catalog.refreshByPath(path)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read(spark: SparkSession, path: str, wanted: list[str], optional: tuple[str, ...] = ()) -> DataFrame:
    """The table, if it has the wanted columns."""
    df = spark.read.parquet(path)
    compatible(df.columns, wanted, optional)
    return df


def truncate(spark: SparkSession, path: str) -> None:
    replace(spark.read.parquet(path).limit(0), path)


def delete(spark: SparkSession, path: str, keys: DataFrame, on: list[str]) -> int:
    """Delete the rows with these keys; how many went."""
    kept, gone = memory.delete_keys(spark.read.parquet(path), keys, on)
    replace(kept, path)
    return gone


def clear_user(spark: SparkSession, user: str, edges: str, memories: str, profile: str) -> int:
    """Forget a user: their edges (how many is returned), memories and profile."""
    who = spark.range(1).select(F.lit(user).alias("user"))
    for path in (memories, profile):
        delete(spark, path, who, ["user"])
    return delete(spark, edges, who, ["user"])


def upsert_edges(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Merged edges (src, relation, dst, description, source_chunk_ids) of those there and new
    ones: evidence of the new ones is appended where it is not there, their description counts."""
    rows = existing.withColumn("__o", F.lit(0)).unionByName(new.withColumn("__o", F.lit(1)))
    lists = F.transform(F.array_sort(F.collect_list(F.struct("__o", "source_chunk_ids"))), lambda s: s["source_chunk_ids"])
    return rows.groupBy("src", "relation", "dst").agg(F.max_by("description", "__o").alias("description"), F.array_distinct(F.flatten(lists)).alias("source_chunk_ids"))


def upsert_graph(spark: SparkSession, path: str, triples: DataFrame) -> None:
    """Merge triples into the stored edges."""
    new = graph.merge_edges(triples)
    replace(upsert_edges(spark.read.parquet(path), new) if exists(spark, path) else new, path)


def create_database(spark: SparkSession, name: str) -> bool:
    """Creates a database of the catalog; whether it was not there."""
    there = spark.catalog.databaseExists(name)
    if not there:
        spark.sql(f"CREATE DATABASE IF NOT EXISTS `{name}`")
    return not there


def recreate(spark: SparkSession, path: str, keys: list[str], schema: str, buckets: int = 64) -> keyed.Table:
    """An empty keyed table at path, whatever was there."""
    versions.delete(spark, path)
    return keyed.table(spark, path, keys, schema, buckets)


EDGES = "src string, relation string, dst string, description string, source_chunk_ids array<string>"


def edge_table(spark: SparkSession, path: str, buckets: int = 64) -> keyed.Table:
    """The graph's edges by their key, of which an upsert rewrites the buckets of its own edges only."""
    return keyed.table(spark, path, ["src", "relation", "dst"], EDGES, buckets)


def upsert_triples(table: keyed.Table, triples: DataFrame, writer: str | None = None, batch: int | None = None) -> bool:
    """Merges triples into stored edges, a batch of a writer once; whether anything was written."""

    def merge(both: DataFrame) -> DataFrame:
        return upsert_edges(both.where("not __new").drop("__new"), both.where("__new").drop("__new"))

    new = graph.merge_edges(triples)
    new = new.select(*[F.col(c).cast("string").alias(c) for c in ("src", "relation", "dst", "description")], F.col("source_chunk_ids").cast("array<string>").alias("source_chunk_ids"))
    return table.upsert(new, merge, writer, batch)


def scalars(df: DataFrame) -> list[str]:
    """The columns that are no vectors."""
    return [f.name for f in df.schema.fields if not isinstance(f.dataType, ArrayType)]


def sample(df: DataFrame, key: str, n: int) -> DataFrame:
    """The first n rows by key that have one, without vectors."""
    return df.where(F.col(key).isNotNull() & (F.trim(F.col(key).cast("string")) != "")).select(*scalars(df)).orderBy(key).limit(n)


def catalog(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """(name, columns, rows) of stored tables; a table that is not there has none."""
    found = [(n, spark.read.parquet(p)) for n, p in paths.items() if exists(spark, p)]
    rows = [(n, sorted(df.columns), df.count()) for n, df in found]
    return spark.createDataFrame(rows, "name string, columns array<string>, rows long")
