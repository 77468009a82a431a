"""Dense numbers and running totals over a whole table, without a window over all of its rows."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.sources.staging import cut


def running_totals(rows: DataFrame, value: Column, *order: str, within: str | None = None, name: str = "before") -> DataFrame:
    """rows with `name`, the sum of value over all rows before in the order of the columns; within:
    over those before that have the same value of that column. Nulls are first and count 0.

    Rows are dealt out by ranges of the order and stored. Each range is added up; the driver adds
    up the totals of the ranges (one number for each range, and for each value that crosses
    from one to the next), and a window runs inside a range alone."""
    spark = rows.sparkSession
    keys = [within, *order] if within else list(order)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(n, *keys).withColumns({"__range": F.spark_partition_id(), "__v": F.coalesce(value.cast("long"), F.lit(0))})
    stored = cut(dealt)
    group = [within] if within else []
    inside = Window.partitionBy("__range", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = stored.withColumn(name, F.coalesce(F.sum("__v").over(inside), F.lit(0)))
    if within:
        # only a value that goes on from an earlier range has something before it there
        spans = stored.groupBy(within, "__range").agg(F.sum("__v").alias("s"))
        many = spans.groupBy(within).agg(F.count("*").alias("n")).where("n > 1").select(F.col(within).alias("__w"))
        crossing = spans.join(many, F.col(within).eqNullSafe(F.col("__w"))).drop("__w").collect()  # fewer than two for each range
        seen: dict = {}
        offsets = []
        for r in sorted(crossing, key=lambda r: r["__range"]):
            offsets.append((r[within], r["__range"], seen.get(r[within], 0)))
            seen[r[within]] = offsets[-1][2] + r["s"]
        table = spark.createDataFrame(offsets, f"__w {rows.schema[within].dataType.simpleString()}, __r int, __o long")
        same = (F.col("__range") == F.col("__r")) & F.col(within).eqNullSafe(F.col("__w"))
    else:
        sums = {r["__range"]: r["s"] for r in stored.groupBy("__range").agg(F.sum("__v").alias("s")).collect()}
        found = sorted(sums)
        offsets = list(zip(found, accumulate([0, *[sums[p] for p in found]]), strict=False))
        table, same = spark.createDataFrame(offsets, "__r int, __o long"), F.col("__range") == F.col("__r")
    out = out.join(F.broadcast(table), same, "left")  # as many rows as ranges, or twice as many
    return out.withColumn(name, F.col(name) + F.coalesce("__o", F.lit(0))).select(*rows.columns, name)


def numbered(rows: DataFrame, *order: str, within: str | None = None, name: str = "number") -> DataFrame:
    """rows with a number from 0 in the order of the columns, which no two rows share."""
    return running_totals(rows, F.lit(1), *order, within=within, name=name)
