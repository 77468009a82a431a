"""A stored inverted index in segments: appended to, deleted from, merged, and read by the terms of a
query only.

Under the path the caller gives lie

* `segments/<name>/postings`: (bucket, term, ids, tfs, dls), in folders by a hash of the term, as
  many as the segment's postings ask for, sorted by term inside; a row has the postings of a
  term in some thousands of documents, so rows are sorted and moved by the list;
* `segments/<name>/docs`: (id, dl, terms, tfs), a row for each document with its distinct terms. A merge
  makes its postings of these: what is gone leaves by document, not by posting;
* `gone/<name>`: (segment, id) of documents that were deleted or replaced later;
* `versions/<number>`: the manifest, a row for each segment (name, buckets, documents, terms) and each
  folder of deletions (what went of the counts). A change writes its folders first and then, as
  one Parquet table, the next manifest. A reader takes the highest one that is complete, so a
  change that fails half way is not seen, and readers of an older version go on with it.

One writer at a time. Searching an index equals searching one that is built anew of the live rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.config import DEFAULT
from quillspark.functions import tokens
from quillspark.operators import retrieval
from quillspark.sources import versions
from quillspark.sources.staging import cut, dropped, fresh_path, source_key

#: Postings of a folder of a segment; those whose lists are made at once.
FOLDER, LISTS = 1 << 22, 1 << 21
MANIFEST = "kind string, name string, buckets int, n long, texts long, total long, id_type string"


def _bucket(term: Column, buckets: int | Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets) if isinstance(buckets, int) else buckets).cast("int")


def _docs(id_type: str) -> str:
    return f"id {id_type}, dl long, terms array<string>, tfs array<int>"


def _lists(id_type: str) -> str:
    return f"term string, ids array<{id_type}>, tfs array<int>, dls array<int>"


@dataclass(frozen=True)
class Index:
    """One version of the index at a path; entries are the rows of its manifest."""

    path: str
    version: int
    entries: tuple[dict, ...]

    @property
    def segments(self) -> list[dict]:
        return [e for e in self.entries if e["kind"] == "segment"]

    @property
    def n(self) -> int:
        """Documents, those without a text too."""
        return sum(e["n"] for e in self.entries)

    @property
    def avgdl(self) -> float:
        return sum(e["total"] for e in self.entries) / max(1, sum(e["texts"] for e in self.entries))

    def _id_type(self) -> str:
        return self.entries[0]["id_type"] if self.entries else "long"

    def gone(self, spark: SparkSession) -> DataFrame | None:
        """(segment, id) of what no longer counts."""
        names = [e["name"] for e in self.entries if e["kind"] == "gone"]
        if not names:
            return None
        return spark.read.schema(f"segment string, id {self._id_type()}").parquet(*[f"{self.path}/gone/{n}" for n in names])

    def postings(self, spark: SparkSession, words: list[str]) -> DataFrame:
        """The live postings of words: the folders of other terms are not read, and inside one
        the statistics of sorted row groups leave out most."""
        words, out = list(dict.fromkeys(w.lower() for w in words)), None
        for e in self.segments:
            rows = spark.read.schema(f"{_lists(e['id_type'])}, bucket int").parquet(f"{self.path}/segments/{e['name']}/postings")
            if words:
                rows = rows.where(F.col("bucket").isin(*[_bucket(F.lit(w), e["buckets"]) for w in words]) & F.col("term").isin(*words))
            each = (rows if words else rows.limit(0)).select("term", "bucket", F.explode(F.arrays_zip("ids", "tfs", "dls")).alias("p"))
            rows = each.select(F.col("p.ids").alias("id"), F.col("p.dls").cast("long").alias("dl"), "term", F.col("p.tfs").cast("long").alias("tf"), "bucket", F.lit(e["name"]).alias("segment"))
            out = rows if out is None else out.unionByName(rows)
        if out is None:
            return spark.createDataFrame([], "id long, dl long, term string, tf long, bucket int, segment string")
        gone = self.gone(spark)
        return out if gone is None else out.join(gone, ["segment", "id"], "left_anti")

    def documents(self, spark: SparkSession, *terms: str) -> DataFrame:
        """(segment, id, dl) of the live documents, with terms and tfs if named; dl is null without a text."""
        out = None
        for e in self.segments:
            rows = spark.read.schema(_docs(e["id_type"])).parquet(f"{self.path}/segments/{e['name']}/docs").select("id", "dl", *terms, F.lit(e["name"]).alias("segment"))
            out = rows if out is None else out.unionByName(rows)
        if out is None:
            return spark.createDataFrame([], f"{_docs('long')}, segment string").select("id", "dl", *terms, "segment")
        gone = self.gone(spark)
        return out if gone is None else out.join(gone, ["segment", "id"], "left_anti")


def at(spark: SparkSession, path: str) -> Index:
    """The newest complete version at path; an index without segments where there is none."""
    version, rows = versions.newest(spark, path, MANIFEST)
    return Index(path, version, _ordered(rows))


def _ordered(entries: list[dict]) -> tuple[dict, ...]:
    return tuple(sorted(entries, key=lambda e: (e["kind"] != "segment", e["name"])))


def _commit(spark: SparkSession, before: Index, entries: list[dict]) -> Index:
    versions.commit(spark, before.path, before.version + 1, entries, MANIFEST)
    return Index(before.path, before.version + 1, _ordered(entries))


def _counted(docs: DataFrame) -> DataFrame:
    """(id, dl, terms, tfs) of docs (id, text): the distinct terms of each row and how often it has them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, texts in tokens.blocks(batch):
                n, key, names, tf = tokens.term_counts(texts)
                width = max(1, len(names))
                ends = pa.array(np.searchsorted(key, np.arange(len(n) + 1) * width).astype(np.int32))
                dl = pa.array(n, mask=np.array(texts.is_null()))
                found = pa.ListArray.from_arrays(ends, names.take(pa.array(key % width)))
                yield pa.RecordBatch.from_arrays([ids, dl, found, pa.ListArray.from_arrays(ends, pa.array(tf.astype(np.int32)))], names=["id", "dl", "terms", "tfs"])

    return docs.select("id", F.lower("text").alias("text")).mapInArrow(run, _docs(docs.schema["id"].dataType.simpleString()))


def _inverted(counted: DataFrame) -> DataFrame:
    """(term, ids, tfs, dls) of counted rows: a row for each term in some thousands of documents."""

    def lists(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks()
        ids, dl, terms, tfs = (t[c].combine_chunks() for c in ("id", "dl", "terms", "tfs"))
        doc = np.repeat(np.arange(len(ids)), np.array(terms.value_lengths().fill_null(0)))
        found = terms.flatten().dictionary_encode()
        term = np.array(found.indices)
        order = np.argsort(term, kind="stable")
        doc, ends = doc[order], pa.array(np.searchsorted(term[order], np.arange(len(found.dictionary) + 1)).astype(np.int32))
        columns = [ids.take(pa.array(doc)), pa.array(np.array(tfs.flatten())[order]), pa.array(np.array(dl.fill_null(0)).astype(np.int32)[doc])]
        return pa.RecordBatch.from_arrays([found.dictionary, *(pa.ListArray.from_arrays(ends, c) for c in columns)], names=["term", "ids", "tfs", "dls"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += len(batch.column(2).flatten())
            if n >= LISTS:
                yield lists(held)
                held, n = [], 0
        if n:
            yield lists(held)

    return counted.mapInArrow(run, _lists(counted.schema["id"].dataType.simpleString()))


def _deal(spark: SparkSession, path: str, name: str, id_type: str) -> dict:
    """Writes the postings of a segment whose docs are written; its entry. One shuffle deals the lists
    out by folder and documents, so a frequent term is no one task's."""
    docs = spark.read.schema(_docs(id_type)).parquet(f"{path}/segments/{name}/docs")
    r = docs.agg(F.count("*").alias("n"), F.count("dl").alias("texts"), F.sum("dl").alias("total"), F.sum(F.size("tfs")).alias("postings")).first()
    buckets = max(1, -(-(r["postings"] or 0) // FOLDER))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = _inverted(docs).withColumn("bucket", _bucket(F.col("term"), buckets))
    dealt = rows.repartition(parts, "bucket", F.pmod(F.xxhash64(F.get("ids", F.lit(0))), F.lit(max(1, parts // buckets))))
    dealt.sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{path}/segments/{name}/postings")
    return {"kind": "segment", "name": name, "buckets": buckets, "n": r["n"], "texts": r["texts"], "total": r["total"] or 0, "id_type": id_type}


def _forget(spark: SparkSession, index: Index, ids: DataFrame) -> dict | None:
    """Writes which live documents have one of ids; the entry that takes them off the counts."""
    live = index.documents(spark)
    name = uuid.uuid4().hex
    path = f"{index.path}/gone/{name}"
    found = live.join(ids.select("id").distinct(), "id", "left_semi")
    counts = cut(found)
    r = counts.agg(F.count("*").alias("n"), F.count("dl").alias("texts"), F.sum("dl").alias("total")).first()
    if r["n"]:
        counts.select("segment", "id").write.parquet(path)
    dropped(counts)
    return {"kind": "gone", "name": name, "buckets": 0, "n": -r["n"], "texts": -r["texts"], "total": -(r["total"] or 0), "id_type": index._id_type()} if r["n"] else None


def append(index: Index, docs: DataFrame) -> Index:
    """The next version, with docs (id, text) as a segment more; documents that had one of their ids
    are replaced. Of rows with one id the one with the greatest text counts."""
    spark, name, id_type = docs.sparkSession, uuid.uuid4().hex, docs.schema["id"].dataType.simpleString()
    path = f"{index.path}/segments/{name}/docs"
    rows = docs.select("id", "text").where("id is not null")
    _counted(rows).write.parquet(path)
    ids = spark.read.schema(_docs(id_type)).parquet(path).select("id")
    if not ids.groupBy("id").count().where("count > 1").isEmpty():  # only then texts are compared
        _counted(rows.groupBy("id").agg(F.max("text").alias("text"))).write.mode("overwrite").parquet(path)
        ids = spark.read.schema(_docs(id_type)).parquet(path).select("id")
    entries = list(index.entries)
    if index.segments and (old := _forget(spark, index, ids)):
        entries.append(old)
    return _commit(spark, index, [*entries, _deal(spark, index.path, name, id_type)])


def delete(index: Index, ids: DataFrame) -> Index:
    """The next version, without the documents of ids (id)."""
    old = _forget(ids.sparkSession, index, ids) if index.segments else None
    return _commit(ids.sparkSession, index, [*index.entries, old]) if old else index


def merge(spark: SparkSession, index: Index, most: int = 1) -> Index:
    """The next version with at most `most` segments: the smallest ones become one, without what is
    gone. Folders of merged segments stay for readers of older versions; vacuum() drops them."""
    if len(index.segments) <= most and not any(e["kind"] == "gone" for e in index.entries):
        return index
    by_size = sorted(index.segments, key=lambda e: e["total"])
    few = by_size if most <= 1 else by_size[: len(by_size) - most + 1]
    names = {e["name"] for e in few}
    part = Index(index.path, index.version, tuple(e for e in index.entries if e["kind"] == "gone" or e["name"] in names))
    gone, name = index.gone(spark), uuid.uuid4().hex
    part.documents(spark, "terms", "tfs").drop("segment").write.parquet(f"{index.path}/segments/{name}/docs")
    made = _deal(spark, index.path, name, index._id_type())
    kept = [e for e in index.segments if e["name"] not in names]
    entries = [*kept, made]
    if kept and gone is not None:  # deletions that other segments still have
        left = gone.join(spark.createDataFrame([(e["name"],) for e in kept], "segment string"), "segment", "left_semi")
        live = Index(index.path, index.version, tuple(kept)).documents(spark).join(left, ["segment", "id"], "left_semi")
        r = live.agg(F.count("*").alias("n"), F.count("dl").alias("texts"), F.sum("dl").alias("total")).first()
        if r["n"]:
            again = uuid.uuid4().hex
            left.select("segment", "id").write.parquet(f"{index.path}/gone/{again}")
            entries.append({"kind": "gone", "name": again, "buckets": 0, "n": -r["n"], "texts": -r["texts"], "total": -(r["total"] or 0), "id_type": index._id_type()})
    return _commit(spark, index, entries)


def vacuum(spark: SparkSession, index: Index) -> int:
    """Deletes the folders and manifests that only older versions name; how many folders went."""
    used, n = {e["name"] for e in index.entries}, 0
    for kind in ("segments", "gone"):
        for name in versions.names(spark, f"{index.path}/{kind}"):
            if name not in used:
                n += versions.delete(spark, f"{index.path}/{kind}/{name}")
    versions.forget(spark, index.path, index.version)
    return n


def build(docs: DataFrame, path: str | None = None) -> Index:
    """A new index of docs (id, text), at path or else in the shared folder."""
    return append(Index(path or fresh_path(docs.sparkSession, "index"), 0, ()), docs)


_built: dict[tuple, Index] = {}


def of(docs: DataFrame) -> Index:
    """An index of docs for this application: built again where the plan of docs, or a file that it
    reads, is another. A table that reads no files has no key and is always built."""
    key = source_key(docs)
    if key is None:
        return build(docs)
    if key not in _built:
        _built[key] = build(docs)
    return _built[key]


def bm25_topk(spark: SparkSession, index: Index, words: list[str], k: int = DEFAULT.top_k_recall) -> DataFrame:
    """(id, score, rank) by BM25 for the given words; none match without words."""
    rows = index.postings(spark, words)
    df = rows.groupBy("term").agg(F.count("*").alias("df"))  # one row for each word of the query
    idf = F.log(1 + (F.lit(index.n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    b, k1 = DEFAULT.bm25_b, DEFAULT.bm25_k1
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.lit(max(index.avgdl, 1e-9))))
    scored = rows.join(F.broadcast(df), "term").groupBy("id").agg(F.round(F.sum(part), 6).alias("score"))
    return retrieval.ranked(scored, k, F.desc("score"), F.asc("id"))


def text_match(spark: SparkSession, index: Index, words: list[str]) -> DataFrame:
    """(id) of the rows that hold any of the words."""
    return index.postings(spark, words).select("id").distinct()
