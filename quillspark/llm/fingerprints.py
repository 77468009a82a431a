"""Document fingerprints: threshold-scaled sketches, in DataFrame functions only.

A document's sketch keeps every distinct hash of its five-word shingles below a fixed
fraction of the hash range. Sketches of unions are unions of sketches, and containment
and Jaccard of very unequal documents are estimated without bias from the overlap. So
that no document with words has an empty sketch, one without a hash below the threshold
keeps its smallest hash; merge() drops such a guard where it is not needed.

A text of 1 to 4 words has its whole sequence as one shingle; one without words has the
empty sketch, and two empty sketches are alike (1.0). A null text is an empty one.

The next document in descending doc_id is found without a global sort: rows go to
buckets of doc_id, a few for each shuffle partition, cut at quantiles as a range partitioner
does; a window leads inside each bucket, and the last row of a bucket takes the first of
the next non-empty one, whose key was found on narrow columns. A doc_id that fills several
buckets, or rows without one, is cut on by the hash of the text. Rows without doc_id come
last, ties follow the hash of the text; equal rows are any order. A doc_id that is no number
is ordered by its hash. Texts are shuffled once, and each is sketched once, behind that shuffle.
"""

from __future__ import annotations

import bisect

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from quillspark.llm._shared import partitions, sha256_hex, table

SHINGLE = 5
FRACTION = 4  # one hash in so many is kept
_LIMIT = -(1 << 63) + (1 << 64) // FRACTION


def _bind(value: Column, body) -> Column:
    """body(value), with value computed once for each row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def sketch(text: Column) -> Column:
    """The sorted distinct shingle hashes under the threshold."""
    words = F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")

    def shingles(w: Column) -> Column:
        heads = F.slice(w, F.lit(1), F.greatest(F.size(w) - (SHINGLE - 1), F.lit(1)))
        return F.transform(heads, lambda x, i: F.xxhash64(x, *[F.get(w, i + F.lit(k)) for k in range(1, SHINGLE)]))

    def kept(h: Column) -> Column:
        low = F.filter(h, lambda x: x < F.lit(_LIMIT))
        return _bind(low, lambda a: F.when((F.size(a) == 0) & (F.size(h) > 0), F.array(F.array_min(h))).otherwise(F.sort_array(F.array_distinct(a))))

    return _bind(_bind(F.transform(words, lambda w: F.xxhash64(w)), shingles), kept)


def merge(a: Column, b: Column) -> Column:
    """The sketch of two documents' shingles together."""
    both = F.array_union(a, b)
    low = F.filter(both, lambda x: x < F.lit(_LIMIT))
    return F.when((F.size(low) == 0) & (F.size(both) > 0), F.array(F.array_min(both))).otherwise(F.sort_array(low))


def jaccard(a: Column, b: Column) -> Column:
    common = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - common
    return F.when(union == 0, F.lit(1.0)).otherwise(common / union)


def containment(a: Column, b: Column) -> Column:
    """The share of a's shingles that b has."""
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def to_string(s: Column) -> Column:
    return F.array_join(s.cast("array<string>"), " ")


def _bucket(key: Column, tie: Column, cuts: list[int]) -> Column:
    """How many cuts are below (key, tie), by binary search among the distinct ones. A cut
    that occurs several times divides the rows of its key evenly by their tie."""
    if not cuts:
        return F.lit(0).cast("long")
    values = sorted(set(cuts))
    array = lambda x: F.lit(x) if len(x) > 1 else F.array(F.lit(x[0]))
    at, before, times = array(values), array([bisect.bisect_left(cuts, v) for v in values] + [len(cuts)]), array([cuts.count(v) for v in values] + [1])
    steps = F.sequence(F.lit(1), F.lit(len(values).bit_length()))
    start = F.struct(F.lit(0).alias("lo"), F.lit(len(values)).alias("hi"))

    def halve(acc: Column, _: Column) -> Column:
        mid = ((acc["lo"] + acc["hi"]) / 2).cast("int")
        above = F.coalesce(F.get(at, mid) < key, F.lit(False))
        open_ = acc["lo"] < acc["hi"]
        return F.struct(F.when(open_ & above, mid + 1).otherwise(acc["lo"]).alias("lo"), F.when(open_ & ~above, mid).otherwise(acc["hi"]).alias("hi"))

    def place(i: Column) -> Column:
        # the share of the 2**63 values of tie that lie below
        share = F.floor(tie / F.lit(float(1 << 63)) * F.get(times, i)).cast("long")
        inside = F.least(share, F.get(times, i).cast("long") - 1)
        return F.get(before, i).cast("long") + F.when(F.coalesce(F.get(at, i) == key, F.lit(False)), inside).otherwise(F.lit(0).cast("long"))

    return _bind(F.aggregate(steps, start, halve, lambda acc: acc["lo"]), place)


def order_key(docs: DataFrame, key: str) -> Column:
    """A long that orders key; null is least."""
    kind = docs.schema[key].dataType
    number = F.col(key).cast("long") if isinstance(kind, NumericType) else F.xxhash64(key)
    return F.when(F.col(key).isNull(), F.lit(-(1 << 63))).otherwise(number)


def with_next(docs: DataFrame, key: str) -> DataFrame:
    """docs (columns key and text) with sketch, next_text and next_sketch: those of the next
    row in descending key, in the first row after the last one. The driver sees one
    quantile and one key for each bucket, never a row's content."""
    spark = docs.sparkSession
    keyed = docs.withColumn("__key", order_key(docs, key)).withColumn("__tie", F.xxhash64("text").bitwiseAND(F.lit((1 << 63) - 1)))
    parts = partitions(spark)
    buckets = 8 * parts  # several for each partition, so that they are dealt out evenly
    cuts = []
    if buckets > 1:
        shares = [i / buckets for i in range(1, buckets)]
        cuts = keyed.agg(F.percentile_approx("__key", F.array(*map(F.lit, shares)), F.lit(max(10_000, 10 * buckets)))).first()[0]
    rows = keyed.withColumn("__bucket", _bucket(F.col("__key"), F.col("__tie"), sorted(int(c) for c in cuts or [])))
    top = F.max(F.struct("__key", "__tie")).alias("top")
    heads = sorted((r["b"], r["top"]["__key"], r["top"]["__tie"]) for r in rows.groupBy(F.col("__bucket").alias("b")).agg(top).collect())
    order = [F.desc("__key"), F.desc("__tie")]
    dealt = rows.repartition(parts, "__bucket").sortWithinPartitions("__bucket", *order).withColumn("sketch", sketch(F.col("text")))
    led = dealt.withColumn("__next", F.lead(F.struct("text", "sketch")).over(Window.partitionBy("__bucket").orderBy(*order)))
    following = F.col("__next")
    if heads:
        # a bucket's first row follows the last one of the next higher bucket
        after = [b for b, _, _ in heads[1:]] + [heads[0][0]]
        small = spark.createDataFrame(pa.table({"__key": [k for _, k, _ in heads], "__tie": [t for _, _, t in heads], "__for": after}))
        # one row for each bucket, as many as shuffle partitions
        first = keyed.join(F.broadcast(small), ["__key", "__tie"]).groupBy(F.col("__for").alias("__bucket")).agg(F.min("text").alias("__text"))
        first = first.withColumn("__head", F.struct(F.col("__text").alias("text"), sketch(F.col("__text")).alias("sketch"))).drop("__text")
        led = led.join(first.hint("merge"), "__bucket", "left")
        following = F.coalesce("__next", "__head")
    return led.select(*docs.columns, "sketch", following["text"].alias("next_text"), following["sketch"].alias("next_sketch"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """docs with their sketch (array of long)."""
    return docs.withColumn("sketch", sketch(F.coalesce(F.col("text"), F.lit(""))))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = with_next(docs, "doc_id")
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half))
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), "sketch", edited.alias("edited"), jaccard(F.col("sketch"), F.col("next_sketch")).alias("near_next"))
    rows = rows.withColumn("edited_sketch", sketch(F.col("edited")))
    return rows.select(
        "doc_id", "n_chars", sha256_hex(F.col("edited")).alias("edited_sha256"), to_string(F.col("sketch")).alias("fingerprint"),
        to_string(F.col("edited_sketch")).alias("edited_fingerprint"), jaccard(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"), "near_next",
    )
