"""Sharding along a Hilbert curve.

Several metadata dimensions are quantised to a grid, each row gets its index on the
Hilbert curve through that grid, rows are sorted by it, and the sorted sequence is cut
into runs of equal row counts (law `rows`: counts at most one apart). Neighbours on the
curve are close in every dimension at once, so min/max statistics of each run prune
files under predicates on any of them.

Plan: only (doc_id, size, crc, index) is sorted, by range partitions; a row's global
rank is its place in its partition plus the rows of the partitions before, of which the
driver sees one count each. Ties on the curve are broken by a hash of the text, so equal
cells split evenly and equal texts of one cell lie side by side; then by doc_id.

Defined results: a null text has 16 bytes and the CRC of no bytes; a null in a dimension
is a value of its own; repeated rows each get a place; fewer rows than shards leave some
shards empty; an empty table gives an empty table; further columns are left alone.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm._shared import discard, partitions, staged, table, unused


def hilbert_index(coords: np.ndarray, bits: int) -> np.ndarray:
    """Index on the Hilbert curve of integer points, coords[dimension, point] < 2**bits
    (Skilling 2004). dimensions * bits may be 62 at most."""
    x = coords.astype(np.int64).copy()
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(dims):
            on = (x[i] & q) != 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(on, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        flip = np.where(x[dims - 1] & q, flip ^ (q - 1), flip)
        q >>= 1
    x ^= flip
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            out = (out << 1) | ((x[i] >> b) & 1)
    return out


def category(c: Column, bits: int) -> Column:
    """A grid coordinate for a category: one cell for each value, up to collisions."""
    return F.pmod(F.xxhash64(F.coalesce(c.cast("string"), F.lit("\0null"))), F.lit(1 << bits))


def magnitude(c: Column, bits: int) -> Column:
    """A grid coordinate for a size: cells evenly spaced on a log scale up to 2**40."""
    log = F.log2(F.greatest(c, F.lit(0)).cast("double") + 1)
    return F.coalesce(F.least((log / 40 * (1 << bits)).cast("long"), F.lit((1 << bits) - 1)), F.lit(0))


def with_curve(df: DataFrame, dimensions: list[Column], bits: int, name: str) -> DataFrame:
    @F.pandas_udf("long")
    def index(first: pd.Series, *rest: pd.Series) -> pd.Series:
        return pd.Series(hilbert_index(np.stack([c.to_numpy() for c in (first, *rest)]), bits))

    return df.withColumn(name, index(*[d.cast("long") for d in dimensions]))


def with_rank(df: DataFrame, order: list[str]) -> tuple[DataFrame, int]:
    """df with __rank, its rows' places (from 0) in the given order, and their number.
    The driver sees one count for each range partition."""
    ranged = df.repartitionByRange(partitions(df.sparkSession), *order).sortWithinPartitions(*order)
    placed = staged(ranged.withColumn("__at", F.monotonically_increasing_id()), "ranked")
    part, place = F.shiftright("__at", 33), F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    counts = sorted((r["part"], r["n"]) for r in placed.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())
    before, total = [], 0
    for p, n in counts:
        before.append((p, total))
        total += n
    if not before:
        return placed.withColumn("__rank", F.lit(0).cast("long")).drop("__at"), 0
    # one pair for each range partition, as many as spark.sql.shuffle.partitions at most
    offsets = F.broadcast(df.sparkSession.createDataFrame(pa.table({"__part": [p for p, _ in before], "__before": [n for _, n in before]})))
    return placed.join(offsets, part == F.col("__part")).withColumn("__rank", F.col("__before") + place).drop("__at", "__part", "__before"), total


def hilbert_shards(docs: DataFrame, n_shards: int = 40, bits: int = 8, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, text_crc32, curve (Hilbert index of lang, source and size), shard,
    and slot (place in the shard) for every row of docs, and the columns carry of docs."""
    text = F.coalesce(F.col("text"), F.lit(""))
    size = F.octet_length(text).cast("long") + 16
    dims = [category(F.col("lang"), bits), category(F.col("source"), bits), magnitude(size, bits)]
    base = docs.select("doc_id", *carry, size.alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("tie"), *[d.alias(f"d{i}") for i, d in enumerate(dims)])
    base = with_curve(base, [F.col(f"d{i}") for i in range(len(dims))], bits, "curve").drop(*[f"d{i}" for i in range(len(dims))])
    ranked, total = with_rank(staged(base, "curve"), ["curve", "tie", "doc_id"])
    shard = F.expr(f"__rank * {n_shards}L div {max(total, 1)}L")
    first = F.expr(f"(shard * {total}L + {n_shards - 1}L) div {n_shards}L")
    return ranked.withColumn("shard", shard.cast("int")).withColumn("slot", F.col("__rank") - first).drop("__rank", "tie")


def write_shards(docs: DataFrame, path: str, n_shards: int = 40, bits: int = 8) -> None:
    """Write docs as one folder for each shard, sorted by slot inside, with curve and slot.
    Rows meet their place by a number that a stored copy of docs gives them, so repeated
    rows are each written once. Columns of docs with the names curve, shard and slot are
    replaced."""
    docs = docs.drop("curve", "shard", "slot")
    row = unused(docs, "row")
    stored = staged(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    places = hilbert_shards(stored, n_shards, bits, (row,)).select(row, "curve", "shard", "slot")
    joined = stored.join(places, row).drop(row)
    joined.repartition(n_shards, "shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    discard(stored)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = hilbert_shards(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
