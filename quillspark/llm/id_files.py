"""Token ids in compressed binary files.

Texts are encoded once, dealt out by ranges of doc_id and, in ascending order, written to files of
some millions of ids, which end with a document. A file is one binary value in the format of
_idcoder: an adaptive context-mixing range coder over blocks that start afresh and carry
checksums, so a block can be read or found damaged apart from all others. Beside it lie the
doc_ids and numbers of ids of its documents, its range (part), its place there (seq) and the ids of
the range before it (first). The files are the rows of a Parquet table, since that is what Spark's writers commit atomically: a lost
executor or a task that runs twice leaves no half files, and any store that Spark reads will do.

Reading decodes the files of a split one by one. Where a document starts among the ids of the whole
corpus follows from the totals of the ranges, added up on the driver (one number for each).

Defined results: a null or empty text has the end id alone; rows without doc_id come first, rows
with one doc_id in the order of a hash of their texts, repeated rows are written each; a text of any
length is one document in one file, whose other documents make no difference to its ids; an empty
table gives no files and no rows; further columns are ignored. The doc_id is an integer.
A damaged file raises _idcoder.Corrupt. Ids come from the vocabulary file of the tokenizers library,
whose ranks are read by a faster library where they lie beside it; both give the same ids.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import _idcoder, _pieces
from quillspark.llm._shared import partitions, small_batches, staged, table
from quillspark.llm.best_fit_packing import tokenizer_path

END = 2
FILE_IDS = 1 << 23
#: Texts after which a file may end, rows of a batch that crosses to Python.
TEXTS, ROWS = 64, 1000
#: Bytes of texts that are encoded together, up to TEXTS of them more.
TOGETHER = 1 << 24


def groups(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[list[pa.RecordBatch]]:
    """Slices of so many rows, in groups that end once they have TOGETHER bytes."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        for a in range(0, batch.num_rows, rows):
            held.append(batch.slice(a, rows))
            size += held[-1].nbytes
            if size >= TOGETHER:
                yield held
                held, size = [], 0
    if held:
        yield held


def files(docs: DataFrame, path: str | None = None, end: int = END, file_ids: int = FILE_IDS, block: int = _idcoder.BLOCK) -> DataFrame:
    """(part, seq, first, n_ids, doc_ids, lengths, data): the files of docs (doc_id, text), unwritten."""
    path = path or tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, first = TaskContext.get().partitionId(), 0, 0
        held: list[np.ndarray] = []
        held_lengths: list[np.ndarray] = []
        docs_held: list[pa.Array] = []
        total = 0

        def file() -> pa.RecordBatch:
            ids = np.concatenate(held)
            lengths = pa.array([np.concatenate(held_lengths)], pa.list_(pa.int64()))
            doc_ids = pa.array([[x for a in docs_held for x in a.to_pylist()]], pa.list_(pa.int64()))
            columns = [pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([first], pa.int64()), pa.array([len(ids)], pa.int64()), doc_ids, lengths, pa.array([_idcoder.encode(ids, block)], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names=["part", "seq", "first", "n_ids", "doc_ids", "lengths", "data"])

        for group in groups(batches, TEXTS):
            ids, lengths = _pieces.encode(pa.concat_arrays([some.column(1).cast(pa.large_string()) for some in group]), path, end)
            at = row = 0
            for some in group:
                docs_held.append(some.column(0))
                held_lengths.append(lengths[row : row + some.num_rows])
                row += some.num_rows
                n = int(held_lengths[-1].sum())
                held.append(ids[at : at + n])
                at += n
                total += n
                if total >= file_ids:
                    yield file()
                    first += total
                    held, held_lengths, docs_held, total, seq = [], [], [], 0, seq + 1
        if held:
            yield file()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("h"))
    dealt = rows.repartitionByRange(partitions(docs.sparkSession), "doc_id", "h").sortWithinPartitions("doc_id", "h")
    return dealt.select("doc_id", "text").mapInArrow(run, "part int, seq int, first long, n_ids long, doc_ids array<long>, lengths array<long>, data binary")


def write(docs: DataFrame, path: str, **options) -> None:
    """The files of docs as a table under path; options as in files()."""
    with small_batches(docs.sparkSession, ROWS):
        files(docs, **options).write.parquet(path)


def with_starts(stored: DataFrame) -> DataFrame:
    """A stored table of files with start, the ids of all files before."""
    sums = {r["part"]: r["n"] for r in stored.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()}  # one number for each range
    spark = stored.sparkSession
    before = np.concatenate([[0], np.cumsum([sums[p] for p in sorted(sums)])]).tolist()
    offsets = spark.createDataFrame(list(zip(sorted(sums), before, strict=False)), "part int, before long")
    return stored.join(F.broadcast(offsets), "part").withColumn("start", F.col("first") + F.col("before"))


def read(stored: DataFrame, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and ids) of every document, decoded from its file."""
    names = ["doc_id", "start", "n_tokens", "ids_crc32", *["ids"] * with_ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_ids, lengths, start, data in zip(*(batch.column(i) for i in range(4)), strict=True):
                ids = _idcoder.decode(data.as_buffer().to_pybytes()).astype("<u4")
                n = np.array(lengths.values)
                ends = np.cumsum(n)
                parts = [ids[a:b] for a, b in zip(ends - n, ends, strict=True)]
                crc = [zlib.crc32(x) for x in parts]
                columns = [doc_ids.values, pa.array(start.as_py() + ends - n), pa.array(n), pa.array(crc, pa.int64())]
                if with_ids:
                    columns.append(pa.array([x.astype(np.int32) for x in parts], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    rows = with_starts(stored).select("doc_ids", "lengths", "start", "data")
    return rows.mapInArrow(run, f"doc_id long, start long, n_tokens long, ids_crc32 long{', ids array<int>' if with_ids else ''}")


def stored_files(docs: DataFrame, **options) -> DataFrame:
    """The files of docs in the shared folder."""
    with small_batches(docs.sparkSession, ROWS):
        return staged(files(docs, **options), "id-files")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(stored_files(table(spark, sf_dir, "documents").select("doc_id", "text")))
