"""From lines to chapters, from sentences to chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.functions.vectors import cosine
from quillspark.operators.numbering import running_totals


def chapters(lines: DataFrame) -> DataFrame:
    """lines (doc, line_no, line) to (doc, chapter_no, pian, ji, zhang, content). A part
    heading resets volume and chapter, a volume heading the chapter; text outside a
    chapter is dropped, a chapter without text keeps an empty content."""
    norm = lines.select("doc", "line_no", T.normalize_line(F.col("line")).alias("line")).where("line <> ''")
    marks = norm.withColumn("heading", T.is_heading(F.col("line")))
    parts = marks.select("doc", "line_no", "heading", F.posexplode(F.when(F.col("heading"), T.heading_segments(F.col("line"))).otherwise(F.array("line"))).alias("seg_no", "seg"))
    unit = F.when(F.col("heading"), F.regexp_extract("seg", f"^第[{T.NUMERAL}]+([{T.UNITS}])", 1))
    rows = parts.withColumn("unit", unit)
    order = Window.partitionBy("doc").orderBy("line_no", "seg_no").rowsBetween(Window.unboundedPreceding, 0)
    count = lambda u: F.count_if(F.col("unit") == u).over(order)
    rows = rows.withColumn("p", count("篇")).withColumn("j", count("集")).withColumn("z", count("章"))
    last = lambda u, *keys: F.last(F.when(F.col("unit") == u, F.col("seg")), True).over(Window.partitionBy("doc", *keys).orderBy("line_no", "seg_no").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("pian", last("篇")).withColumn("ji", last("集", "p")).withColumn("zhang", last("章", "p", "j"))
    body = rows.where("zhang is not null")
    content = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("heading"), F.struct("line_no", "seg")))), lambda s: s["seg"]), "\n")
    return body.groupBy("doc", F.col("z").alias("chapter_no")).agg(
        F.coalesce(F.first("pian"), F.lit("")).alias("pian"), F.coalesce(F.first("ji"), F.lit("")).alias("ji"), F.first("zhang").alias("zhang"), content.alias("content")
    )


def breaks(units: DataFrame, percentile: float = 90.0) -> DataFrame:
    """units (group, pos, vector) with sim to the next unit and brk: sim strictly below
    the group's (100 - percentile)th percentile, by 1e-9 at least."""
    near = Window.partitionBy("group").orderBy("pos")
    rows = units.withColumn("sim", F.round(cosine(F.col("vector"), F.lead("vector").over(near)), 6))
    cut = F.percentile("sim", F.lit(1 - percentile / 100)).over(Window.partitionBy("group"))
    return rows.withColumn("brk", F.coalesce(F.col("sim") < cut - 1e-9, F.lit(False))).drop("vector")


def packs(units: Column, max_len: int) -> Column:
    """Greedy packing of array<struct<txt,len,brk>> to array<array<txt>>: a unit that
    would overflow a chunk starts the next one and skips its break; else a break closes
    the chunk after the unit."""
    none = F.array().cast("array<string>")
    start = F.struct(F.array().cast("array<array<string>>").alias("done"), none.alias("cur"), F.lit(0).cast("long").alias("n"))

    def step(a: Column, u: Column) -> Column:
        over = (F.size(a["cur"]) > 0) & (a["n"] + u["len"] > max_len)
        grown = F.concat(a["cur"], F.array(u["txt"]))
        cut = F.struct(F.concat(a["done"], F.array(a["cur"])).alias("done"), F.array(u["txt"]).alias("cur"), u["len"].cast("long").alias("n"))
        close = F.struct(F.concat(a["done"], F.array(grown)).alias("done"), none.alias("cur"), F.lit(0).cast("long").alias("n"))
        go_on = F.struct(a["done"].alias("done"), grown.alias("cur"), (a["n"] + u["len"]).cast("long").alias("n"))
        return F.when(over, cut).when(u["brk"], close).otherwise(go_on)

    return F.aggregate(units, start, step, lambda a: F.when(F.size(a["cur"]) > 0, F.concat(a["done"], F.array(a["cur"]))).otherwise(a["done"]))


def chunk_units(units: DataFrame, max_len: int) -> DataFrame:
    """units (group, pos, txt, len, brk) to (group, chunk_index, parts)."""
    rows = units.groupBy("group").agg(F.array_sort(F.collect_list(F.struct("pos", "txt", "len", "brk"))).alias("u"))
    return rows.select("group", F.posexplode(packs(F.col("u"), max_len)).alias("chunk_index", "parts"))


def chunk_ids(counts: DataFrame) -> DataFrame:
    """counts (group, n) with first_no, the number of chunks in the groups before; ids
    are format_string('chunk_%06d', first_no + chunk_index)."""
    return running_totals(counts, F.col("n"), "group", name="first_no")
