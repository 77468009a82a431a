"""Line deduplication over the whole corpus.

Lines are normalised to keys, hashed to 128 bits, and counted by distinct documents; a
key of `min_chars` code points found in `min_docs` documents loses all its lines except
in the document with the largest doc_id. The rest is reassembled by position.

Plan: a map-side pass emits the distinct keys of each document as hashes (no text); one
exchange on (key, document) and one on key count documents, both behind map-side
combining, so a line that a third of all documents share costs each task one row. The
keys over the threshold are a stored table, which is joined to the occurrences: of very
common keys by broadcast, so that no task takes all their lines. What is found is gathered
as one list for each document, which meets its text in one shuffle.

Defined results: a null text is one empty line and stays null in the output text; rows
with one doc_id are one document for counting and each keep or lose the same keys; rows
without doc_id count together as one document that comes before all others (equal texts
of them share a list of keys to drop); an empty table gives an empty table; further
columns are kept, whatever their names, but for n_lines and n_dropped, which are replaced.
Keys are equal if their 128-bit hashes are.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm._shared import schema_of, sha256_hex, spread_join, staged, table, unused

_BLANK = b" \t\n\x0b\x0c\r"


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """The 16-byte hash of a line's key, None for a key that is too short."""
    key = line.strip(_BLANK)
    if len(key) < min_chars or (len(key) < 4 * min_chars and len(key.decode("utf-8", "replace")) < min_chars):
        return None
    return xxhash.xxh3_128_digest(key.lower())  # on bytes only A-Z change


def occurrences(docs: DataFrame, min_chars: int) -> DataFrame:
    """(doc_id, own, key), each key once for each row of docs; own tells rows without doc_id
    apart by their text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, at, keys = batch.column(0), [], []
            for i, text in enumerate(batch.column(1).cast(pa.large_binary())):
                text = text.as_py()
                if text:
                    found = {line_key(line, min_chars) for line in text.split(b"\n")} - {None}
                    keys += found
                    at += [i] * len(found)
            at = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([ids.take(at), batch.column(2).take(at), pa.array(keys, pa.binary())], names=["doc_id", "own", "key"])

    return docs.select("doc_id", "text", own_key().alias("own")).mapInArrow(run, f"{schema_of(docs, 'doc_id')}, own long, key binary")


def own_key() -> Column:
    return F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.lit(0).cast("long"))


def line_dedup(docs: DataFrame, min_docs: int = 3, min_chars: int = 20) -> DataFrame:
    """docs with text reassembled, and n_lines, n_dropped (long)."""
    docs = docs.drop("n_lines", "n_dropped")
    rows = occurrences(docs, min_chars)
    once = rows.groupBy("key", "doc_id").agg(F.count("*").alias("n"))
    shared = (
        once.groupBy("key").agg(F.sum("n").alias("n"), F.count("*").alias("docs"), F.max("doc_id").alias("keeper"))
        .where(F.col("docs") >= min_docs).select("key", "n", "keeper")
    )
    same, own, drop = (unused(docs, x) for x in ("id", "own", "drop"))
    lists = (
        spread_join(rows, staged(shared, "keys"), "key").where(F.col("found").isNotNull() & ~F.col("doc_id").eqNullSafe(F.col("found.keeper")))
        .groupBy(F.col("doc_id").alias(same), F.col("own").alias(own)).agg(F.collect_set("key").alias(drop))
    )
    joined = docs.join(lists, docs["doc_id"].eqNullSafe(lists[same]) & (own_key() == lists[own]), "left").select(*docs.columns, drop)
    names, at = docs.columns, docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, n_lines, n_dropped = [], [], []
            drops = batch.column(len(names))
            for text, drop in zip(batch.column(at).cast(pa.large_binary()), drops, strict=True):
                text = text.as_py()
                lines = (text or b"").split(b"\n")
                n_lines.append(len(lines))
                if drop.is_valid:
                    gone = set(drop.as_py())
                    lines = [line for line in lines if line_key(line, min_chars) not in gone]
                    n_dropped.append(n_lines[-1] - len(lines))
                    text = b"\n".join(lines)
                else:
                    n_dropped.append(0)
                texts.append(text)
            columns = [batch.column(i) for i in range(len(names))]
            columns[at] = pa.array(texts, pa.large_binary()).cast(pa.large_utf8()).cast(columns[at].type)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], names=[*names, "n_lines", "n_dropped"])

    return joined.mapInArrow(run, f"{schema_of(docs, *names)}, n_lines long, n_dropped long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", sha256_hex(F.coalesce("text", F.lit(""))).alias("kept_sha256"))


ORACLE = r"""
WITH lines AS (
  SELECT doc_id, pos, string_split(coalesce(text, ''), chr(10))[pos] AS line
  FROM documents, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS u(pos)),
keyed AS (
  SELECT doc_id, pos, line,
    translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
shared AS (
  SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 20
  GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
marked AS (
  SELECT keyed.*, (shared.k IS NOT NULL AND keyed.doc_id <> shared.keeper) AS gone
  FROM keyed LEFT JOIN shared ON keyed.k = shared.k)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
