"""Vector code compression: a codebook for each part of the vector, searched by a VA-file.

Vectors become integers floor(scale * x) and are cut into consecutive parts of equal size. Each
part position has a codebook, which starts as that part of the rows with the smallest vec_ids
and is refined by a few rounds of exact integer means. A vector is stored as one byte for each
part: the index of the nearest entry.

The nearest entry is found as in a vector approximation file. Every coordinate of the entries
is quantised to a few bits, so an entry is a box of cells. For each query part a table holds
the least and the greatest squared distance to every cell of every dimension; summed along an
entry's cells they bound its distance from below and above. Only entries whose lower bound
does not exceed the least upper bound are compared by integer distances, ties to the
lower index. Nothing is approximate in the result.

Plan: rows are turned into integers once and stored. Each round is one pass over them that
returns sums and counts for every entry of every codebook from each task, added up behind
map-side combining: no vector is shuffled, whatever copies or labels it shares, and the driver
holds the codebooks alone (parts x entries x part size). Errors by label are summed map-side and
joined back with frequent labels apart (spread_join).

Defined results: rows whose vector is null, or holds a null or a non-finite component, are
dropped, as are those of another length than the first kept row has; rows without a vec_id
come last in the order that fills the codebooks, rows with one vec_id in the order of their
components, and all are coded; with fewer rows than entries the codebooks are smaller; a length
that is no multiple of the parts gives the first parts one component more; null labels count as
one label; an empty table gives an empty table; components are limited to 64 bits and an error
beyond 64 bits is the largest long; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm._shared import schema_of, spread_join, staged, table

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Bits of a cell, and query parts whose tables are held at once.
CELL_BITS, BLOCK = 3, 1024
#: Components under this size keep sums of squares exact in doubles and longs; others take Python's integers.
EXACT = 1 << 22
MOST = (1 << 63) - 1


@dataclass
class Approximation:
    """The cells of one codebook (entries x size): hot is the one-hot matrix of every entry's
    cells, low and high are what the entries in a cell span in each dimension."""

    entries: np.ndarray
    low: np.ndarray
    high: np.ndarray
    hot: np.ndarray

    @classmethod
    def of(cls, entries: np.ndarray, bits: int = CELL_BITS) -> Approximation:
        n, size = entries.shape
        cells = 1 << bits
        # marks by rank: about as many entries in every cell of a dimension
        order = entries.argsort(axis=0, kind="stable")
        cell = np.empty((n, size), np.int64)
        np.put_along_axis(cell, order, np.repeat((np.arange(n) * cells // max(1, n))[:, None], size, axis=1), axis=0)
        low, high = np.zeros((size, cells)), np.zeros((size, cells))
        hot = np.zeros((size * cells, n))
        for d in range(size):
            for c in np.unique(cell[:, d]):
                inside = entries[cell[:, d] == c, d]
                low[d, c], high[d, c] = inside.min(), inside.max()
            hot[d * cells + cell[:, d], np.arange(n)] = 1.0
        return cls(entries, low, high, hot)

    def bounds(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(lower, upper) of the squared distances of query parts x to every entry."""
        below, above = self.low[None] - x[:, :, None], x[:, :, None] - self.high[None]
        least = np.maximum(np.maximum(below, above), 0.0)
        most = np.maximum(-below, -above)
        flat = (len(x), -1)
        return np.square(least).reshape(flat) @ self.hot, np.square(most).reshape(flat) @ self.hot

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, squared distance) of the nearest entry to each query part."""
        index, error = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
        for a in range(0, len(x), BLOCK):
            part = x[a : a + BLOCK]
            lower, upper = self.bounds(part.astype(float))
            q, e = np.nonzero(lower <= upper.min(axis=1, keepdims=True))
            d = np.square(part[q] - self.entries[e]).sum(axis=1)
            first = np.searchsorted(q, np.arange(len(part)))  # at least one candidate for each
            error[a : a + BLOCK] = np.minimum.reduceat(d, first)
            best = np.flatnonzero(d == error[a + q])
            _, at = np.unique(q[best], return_index=True)  # candidates ascend, so ties go to the lower index
            index[a : a + BLOCK] = e[best[at]]
        return index, error


def _by_hand(entries: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """nearest() of components of any size, by Python's integers."""
    rows = [[int(v) for v in row] for row in entries]
    found = [min((sum((int(a) - b) ** 2 for a, b in zip(row, e, strict=True)), i) for i, e in enumerate(rows)) for row in x]
    return np.array([i for _, i in found], np.int64), np.array([min(d, MOST) for d, _ in found], object)


def bounds_of(size: int, parts: int) -> list[tuple[int, int]]:
    """The range of components of each part."""
    ends = np.cumsum([size // parts + (i < size % parts) for i in range(parts)]).tolist()
    return list(zip([0, *ends[:-1]], ends, strict=True))


@dataclass
class Codebooks:
    """entries[part]: one row of integer components for each entry."""

    entries: list[np.ndarray]

    def sha256(self) -> str:
        return hashlib.sha256(",".join(str(int(v)) for book in self.entries for v in book.ravel()).encode()).hexdigest()

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(indexes [rows, parts], errors [rows, parts]) of integer vectors."""
        index, error, a = [], [], 0
        for book in self.entries:
            part = x[:, a : a + book.shape[1]]
            a += book.shape[1]
            largest = max((abs(int(f)) for v in (part, book) if v.size for f in (v.min(), v.max())), default=0)
            i, d = Approximation.of(book).nearest(part) if largest < EXACT else _by_hand(book, part)
            index.append(i)
            error.append(d)
        return np.stack(index, axis=1), np.stack(error, axis=1)

    def decode(self, codes: list[str]) -> np.ndarray:
        """The integer vectors that codes stand for."""
        at = np.frombuffer(bytes.fromhex("".join(codes)), np.uint8).reshape(len(codes), len(self.entries))
        return np.concatenate([book[at[:, p]] for p, book in enumerate(self.entries)], axis=1)


def integers(vectors: DataFrame, vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """vec_id, label and ints (array<long>) of the rows whose vectors count."""
    v = F.col(vector).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    label = F.col("label") if "label" in vectors.columns else F.lit(None).cast("int").alias("label")
    kept = vectors.where(F.col(vector).isNotNull() & F.coalesce(finite, F.lit(False)))
    return kept.select("vec_id", label, F.transform(v, lambda x: F.floor(x * scale).cast("long")).alias("ints"))


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), size)


def fit(rows: DataFrame, size: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks:
    """Codebooks of a stored table of rows (vec_id, ints), all of `size` components."""
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "ints").limit(entries).select("ints").collect()  # as many rows as entries
    start = np.array([r["ints"] for r in first], np.int64).reshape(len(first), size)
    ranges = bounds_of(size, parts)
    books = Codebooks([start[:, a:b].copy() for a, b in ranges])
    for _ in range(rounds if len(first) else 0):
        shared = rows.sparkSession.sparkContext.broadcast(books)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            now = shared.value
            # for each entry how many parts it has, and their sums
            total = [np.zeros((len(b), 1 + b.shape[1]), object) for b in now.entries]
            for batch in batches:
                x = _matrix(batch.column(0), size)
                index, _ = now.assign(x)
                for p, (a, b) in enumerate(ranges):
                    order = np.argsort(index[:, p], kind="stable")
                    used, at, times = np.unique(index[order, p], return_index=True, return_counts=True)
                    part = x[order, a:b]
                    if part.size and max(abs(int(part.min())), abs(int(part.max()))) >= EXACT:
                        part = part.astype(object)
                    total[p][used, 0] += times.astype(object)
                    if b > a:
                        total[p][used, 1:] += np.add.reduceat(part, at, axis=0).astype(object)
            flat = np.concatenate([t.ravel() for t in total])
            at = np.flatnonzero(flat != 0)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array([Decimal(v) for v in flat[at]], pa.decimal128(38))], names=["at", "v"])

        sums = rows.select("ints").mapInArrow(run, "at long, v decimal(38,0)").groupBy("at").agg(F.sum("v").cast("decimal(38,0)").alias("v"))
        found = {r["at"]: int(r["v"]) for r in sums.collect()}  # one number for each component of the codebooks and each entry
        shared.unpersist()
        at, after = 0, []
        for book in books.entries:
            new = book.copy()
            for e in range(len(book)):
                n = found.get(at, 0)
                if n:
                    new[e] = [found.get(at + 1 + d, 0) // n for d in range(book.shape[1])]
                at += 1 + book.shape[1]
            after.append(new)
        books = Codebooks(after)
    return books


def encode(rows: DataFrame, books: Codebooks, size: int) -> DataFrame:
    """vec_id, label, code, error of every row."""
    shared = rows.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            index, errors = shared.value.assign(_matrix(batch.column(2), size))
            codes = index.astype(np.uint8)
            text = [bytes(c).hex() for c in codes]
            error = [min(int(sum(map(int, e))), MOST) for e in errors] if errors.dtype == object else errors.sum(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text, pa.string()), pa.array(error, pa.int64())], names=["vec_id", "label", "code", "error"])

    return rows.select("vec_id", "label", "ints").mapInArrow(run, f"{schema_of(rows, 'vec_id', 'label')}, code string, error long")


def compress(vectors: DataFrame, vector: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, Codebooks]:
    """(vec_id, label, code, error of every row that counts; the codebooks)."""
    rows = integers(vectors, vector, scale)
    head = rows.orderBy(F.col("vec_id").asc_nulls_last(), "ints").select(F.size("ints")).first()
    size = head[0] if head else 0
    rows = staged(rows.where(F.size("ints") == size), "integers")
    books = fit(rows, size, parts, entries, rounds)
    return encode(rows, books, size), books


def with_label_error(codes: DataFrame) -> DataFrame:
    """codes with label_error, the error summed over rows of one label, nulls together."""
    named = staged(codes.withColumn("__label", F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit(""))), "codes")
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(MOST).cast("decimal(38,0)")).cast("long")
    by_label = staged(named.groupBy("__label").agg(F.count("*").alias("n"), total.alias("label_error")), "label-errors")
    return spread_join(named, by_label, "__label").select(*codes.columns, F.col("found.label_error").alias("label_error"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, books = compress(table(spark, sf_dir, "embeddings"))
    return with_label_error(codes).select("vec_id", "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))


def _oracle() -> str:
    """The rounds written out: each assigns by cross distance within a part and takes means."""
    parts, entries = PARTS, ENTRIES
    steps = [f"""
WITH kept AS (
  SELECT row_number() OVER () AS row_id, vec_id, label,
    list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS ints
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS (
  SELECT row_id, p, ints[p * (len(ints) // {parts}) + 1 : (p + 1) * (len(ints) // {parts})] AS x FROM kept, range({parts}) AS r(p)),
ranked AS (SELECT row_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept),
b0 AS (SELECT p, e, x AS y FROM parts JOIN ranked USING (row_id) WHERE e < {entries})"""]
    nearest = """
a{i} AS (
  SELECT row_id, p, min(struct_pack(d := d, e := e)) AS s FROM (
    SELECT row_id, p, e, list_sum(list_transform(list_zip(x, y), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d
    FROM parts JOIN b{i} USING (p)) GROUP BY row_id, p)"""
    for i in range(ROUNDS):
        steps.append(nearest.format(i=i))
        steps.append(f"""
m{i} AS (
  SELECT p, e, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY d) AS y FROM (
    SELECT p, e, d, sum(v) AS s, count(*) AS n FROM (
      SELECT p, a{i}.s.e AS e, unnest(x) AS v, unnest(range(len(x))) AS d FROM parts JOIN a{i} USING (row_id, p)) GROUP BY p, e, d)
  GROUP BY p, e),
b{i + 1} AS (SELECT b{i}.p, b{i}.e, coalesce(m{i}.y, b{i}.y) AS y FROM b{i} LEFT JOIN m{i} ON b{i}.p = m{i}.p AND b{i}.e = m{i}.e)""")
    steps.append(nearest.format(i=ROUNDS))
    return ",".join(steps) + f""",
codes AS (
  SELECT row_id, string_agg(lower(printf('%02x', s.e)), '' ORDER BY p) AS code, CAST(sum(s.d) AS BIGINT) AS error
  FROM a{ROUNDS} GROUP BY row_id),
books AS (
  SELECT sha256(string_agg(t, ',' ORDER BY p, e)) AS h FROM (SELECT p, e, array_to_string(list_transform(y, lambda v: CAST(v AS VARCHAR)), ',') AS t FROM b{ROUNDS}))
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256
FROM kept JOIN codes USING (row_id), books
"""


ORACLE = _oracle()
