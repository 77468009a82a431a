"""A stored vector index: rows in the cells of centroids, searched with bounds.

Centroids are fitted by spherical k-means on a bounded sample; every row is stored in the folder of its
nearest centroid, sorted by its distance to it. Distances are those of the vectors scaled to length one,
whose order is that of the cosine. For a query at distance d of a centroid, a row at distance r
of it is at least |d - r| away, so a cell is at least d - radius away.

An exact search reads the nearest cells first, and then, with the k-th best score found there, only the
cells, and inside them only the ranges of r, that the bounds leave. A search with `probes` reads so many of
the nearest cells and no more; recall() measures what that finds. Rows that have no place
among the cells (null or zero vectors, null components, another length) lie in a folder of their own,
which an exact search always reads.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.config import DEFAULT
from quillspark.functions.vectors import cosine
from quillspark.operators import retrieval
from quillspark.sources.staging import cut, dropped, fresh_path, source_key

#: Rows of the sample for each centroid, and in all; most centroids; passes of k-means.
PER_CELL, SAMPLE, MOST_CELLS, PASSES = 64, 100_000, 4096, 10
NOWHERE = -1
#: Distances that a task computes at once; queries with a cell that it hands on at once.
DISTANCES, SENT = 1 << 20, 10_000
#: Scores are rounded to six places, and sums of floats differ in their last bits.
_SLACK = 2e-6


@dataclass(frozen=True)
class Cells:
    """path: rows in folders cell=...; for each centroid the number of its rows and their least and
    greatest distance."""

    path: str
    schema: str
    centroids: np.ndarray
    rows: np.ndarray
    nearest: np.ndarray
    radius: np.ndarray

    def read(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(self.schema).parquet(self.path)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-300)


def _distance(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 1.0 + np.square(centroids).sum(axis=1) - 2.0 * (x @ centroids.T)))


def kmeans(x: np.ndarray, cells: int, seed: int = 7) -> np.ndarray:
    """Centroids of unit vectors x; one that loses all of its rows starts again at a far one."""
    rng = np.random.default_rng(seed)
    centroids = x[rng.choice(len(x), min(cells, len(x)), replace=False)]
    for _ in range(PASSES):
        d = _distance(x, centroids)
        own = d.argmin(axis=1)
        total = np.zeros_like(centroids)
        np.add.at(total, own, x)
        empty = np.bincount(own, minlength=len(centroids)) == 0
        total[empty] = x[np.argsort(-d.min(axis=1), kind="stable")[: empty.sum()]]
        centroids = _unit(total)
    return centroids


def _few(batches: Iterator[pa.RecordBatch], cells: int) -> Iterator[pa.RecordBatch]:
    """batches in slices whose distances to all cells are at most DISTANCES."""
    n = max(1, DISTANCES // max(1, cells))
    for batch in batches:
        for low in range(0, batch.num_rows, n):
            yield batch.slice(low, n)


def _placed(vectors: DataFrame, size: int) -> DataFrame:
    v = F.col("vector").cast("array<double>")
    norm = F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x)
    fits = (F.size("vector") == size) & (norm > 0) & (norm < float("inf"))  # a null or NaN component gives null or a NaN, which is no less
    return vectors.withColumn("__fits", F.coalesce(fits, F.lit(False)))


def build(vectors: DataFrame, path: str | None = None, cells: int | None = None) -> Cells:
    """The index of vectors (id, vector, ...), at path or else in the shared folder. Centroids: the square
    root of the number of rows, unless told, and MOST_CELLS at most."""
    spark, path = vectors.sparkSession, path or fresh_path(vectors.sparkSession, "cells")
    sizes = vectors.groupBy(F.size("vector").alias("size")).agg(F.count("*").alias("n")).where("size > 0").orderBy(F.desc("n"), "size").first()
    size = sizes["size"] if sizes else 0
    marked = _placed(vectors, size)
    n = min(MOST_CELLS, cells or max(1, int((sizes["n"] if sizes else 0) ** 0.5)))
    head = marked.where("__fits").orderBy(F.xxhash64("id"), "id").limit(min(SAMPLE, n * PER_CELL)).select("vector").toArrow()["vector"]
    sample = np.array(head.combine_chunks().flatten().to_numpy(zero_copy_only=False), float).reshape(-1, max(1, size))
    centroids = kmeans(_unit(sample), n) if len(sample) else np.zeros((0, max(1, size)))
    shared, at = spark.sparkContext.broadcast(centroids), marked.columns.index("vector")
    fits_at, names = marked.columns.index("__fits"), [*vectors.columns, "dist", "cell"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        for batch in _few(batches, len(c)):
            cell, dist = np.full(batch.num_rows, NOWHERE), np.zeros(batch.num_rows)
            fits = np.flatnonzero(batch.column(fits_at).to_numpy(zero_copy_only=False))
            if len(fits) and len(c):
                flat = batch.column(at).take(pa.array(fits)).flatten().to_numpy(zero_copy_only=False)
                d = _distance(_unit(flat.astype(float).reshape(len(fits), -1)), c)
                cell[fits] = d.argmin(axis=1)
                dist[fits] = d.min(axis=1)
            columns = [x for i, x in enumerate(batch.columns) if i != fits_at]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(dist), pa.array(cell.astype(np.int32))], names=names)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in vectors.schema.fields) + ", dist double, cell int"
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # a cell is dealt out over so many tasks as there are for each, whatever share of the rows it has
    dealt = marked.mapInArrow(run, schema).repartition(parts, "cell", F.pmod(F.xxhash64("id"), F.lit(max(1, 4 * parts // max(1, n)))))
    dealt.sortWithinPartitions("cell", "dist").write.partitionBy("cell").parquet(path)
    found = {r["cell"]: r for r in spark.read.schema(schema).parquet(path).groupBy("cell").agg(F.count("*").alias("n"), F.min("dist").alias("low"), F.max("dist").alias("high")).collect()}
    column = lambda name, missing: np.array([found[i][name] if i in found else missing for i in range(len(centroids))])
    return Cells(path, schema, centroids, column("n", 0), column("low", 0.0), column("high", 0.0))


_built: dict[tuple, Cells] = {}


def of(vectors: DataFrame) -> Cells:
    """The index of vectors for this application, as index.of()."""
    key = source_key(vectors)
    if key is None:
        return build(vectors)
    if key not in _built:
        _built[key] = build(vectors)
    return _built[key]


def _scored(rows: DataFrame, query: list[float], k: int) -> DataFrame:
    q = F.array(*[F.lit(float(x)) for x in query])
    return retrieval.ranked(rows.select("id", F.round(cosine(F.col("vector"), q), 6).alias("score")), k, F.desc("score"), F.asc("id"))


def search(spark: SparkSession, cells: Cells, query: list[float] | None, k: int = DEFAULT.top_k_recall, probes: int | None = None, where: str | None = None) -> DataFrame:
    """(id, score, rank) as retrieval.dense_topk() of the rows of where (SQL on the other columns); with
    probes, of the rows in so many of the nearest cells."""
    rows = cells.read(spark).drop("cell") if query is None else cells.read(spark)
    rows = rows.where(where) if where else rows
    if query is None:
        return rows.select("id", F.lit(None).cast("double").alias("score")).orderBy("id").limit(0).withColumn("rank", F.lit(0))
    x = np.array(query, float)
    if len(x) != cells.centroids.shape[1] or not len(cells.centroids) or not 0 < np.square(x).sum() < np.inf:
        return _scored(rows, query, k)
    d = _distance(_unit(x)[None], cells.centroids)[0]
    order = [int(i) for i in np.argsort(np.maximum(0.0, d - cells.radius), kind="stable") if cells.rows[i]]
    near = [int(i) for i in np.argsort(d, kind="stable") if cells.rows[i]]
    if probes is not None:
        return _scored(rows.where(F.col("cell").isin(near[:probes])), query, k)
    # as many of the nearest as hold k rows; where() may leave fewer, then more are read
    first, held = [], 0
    for i in near:
        first.append(i)
        held += int(cells.rows[i])
        if held >= 2 * k:
            break
    best = _scored(rows.where(F.col("cell").isin(first)), query, k).where("score is not null").collect()  # k rows
    if len(best) < k:
        return _scored(rows, query, k)
    reach = float(np.sqrt(max(0.0, 2.0 - 2.0 * (best[-1]["score"] - _SLACK)))) + _SLACK
    ranges = [(i, float(d[i]) - reach, float(d[i]) + reach) for i in order if d[i] - cells.radius[i] <= reach and cells.nearest[i] - d[i] <= reach]
    # the ranges are a table, so their number makes no expression deeper
    table = [(NOWHERE, -np.inf, np.inf), *ranges]
    bounds = spark.createDataFrame([(int(i), float(low), float(high)) for i, low, high in table], "cell int, low double, high double")
    inside = rows.where(F.col("cell").isin([i for i, _, _ in table])).join(F.broadcast(bounds), "cell")  # a row for each cell
    return _scored(inside.where(F.col("dist").between(F.col("low"), F.col("high"))), query, k)


def cells_read(cells: Cells, query: list[float], reach: float) -> int:
    """How many cells a search has to read that looks no further than reach."""
    d = _distance(_unit(np.array(query, float))[None], cells.centroids)[0]
    return int(((d - cells.radius <= reach) & (cells.rows > 0)).sum())


def search_each(cells: Cells, queries: DataFrame, k: int = DEFAULT.top_k_recall, probes: int = 8) -> DataFrame:
    """(query, id, score, rank): for every row of queries (query, vector) the best k of the rows in its
    nearest `probes` cells. A query goes to the blocks of its own cells only; every block of rows meets
    the queries of its cell in one task."""
    spark, size = queries.sparkSession, cells.centroids.shape[1]
    marked = _placed(queries.select("query", "vector"), size).where("__fits").drop("__fits")
    blocks = np.maximum(1, -(-cells.rows // retrieval.ROW_BLOCK))
    nearest = spark.sparkContext.broadcast((cells.centroids, cells.rows, blocks))
    kind, query_block = queries.schema["query"].dataType.simpleString(), retrieval.QUERY_BLOCK

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids, rows, n_blocks = nearest.value
        for batch in _few(batches, len(rows)):
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, -1)
            d = np.where(rows > 0, _distance(_unit(x), centroids), np.inf)
            own = np.argsort(d, axis=1, kind="stable")[:, : min(probes, int((rows > 0).sum()))]
            at, cell = np.repeat(np.arange(len(x)), own.shape[1]), own.ravel()
            times = n_blocks[cell]
            at, cell = np.repeat(at, times), np.repeat(cell, times)
            block = np.arange(len(cell)) - np.repeat(np.cumsum(times) - times, times)
            yield from sent(batch, at, cell, block)

    def sent(batch: pa.RecordBatch, at: np.ndarray, cell: np.ndarray, block: np.ndarray) -> Iterator[pa.RecordBatch]:
        for low in range(0, len(at), SENT):  # a vector is repeated for every cell it goes to
            took, part = batch.take(pa.array(at[low : low + SENT])), slice(low, low + SENT)
            yield pa.RecordBatch.from_arrays([*took.columns, pa.array(cell[part].astype(np.int32)), pa.array(block[part].astype(np.int32))], names=["query", "vector", "cell", "block"])

    left = marked.mapInArrow(place, f"query {kind}, vector {queries.schema['vector'].dataType.simpleString()}, cell int, block int")
    n_blocks = F.array(*[F.lit(int(b)) for b in blocks]) if len(blocks) else F.array(F.lit(1))
    stored = cells.read(spark).where(F.col("cell") >= 0)
    right = stored.select("id", "vector", "cell", F.pmod(F.xxhash64("id"), F.element_at(n_blocks, F.col("cell") + 1)).cast("int").alias("block"))
    ids = stored.schema["id"].dataType.simpleString()

    def run(q: pa.Table, v: pa.Table) -> pa.Table:
        q, v = q.combine_chunks(), v.sort_by("id").combine_chunks()
        if not len(q) or not len(v):
            return pa.table({"query": q["query"].slice(0, 0), "id": v["id"].slice(0, 0), "score": pa.array([], pa.float64())})
        (a, _), (b, _) = retrieval._matrix(q["vector"], size), retrieval._matrix(v["vector"], size)
        out = []
        for low in range(0, len(a), query_block):  # a hot cell's queries in blocks
            part = a[low : low + query_block]
            scores = (part @ b.T) / (np.linalg.norm(part, axis=1)[:, None] * np.linalg.norm(b, axis=1))
            out.append(retrieval._best(q["query"].slice(low, len(part)).combine_chunks(), v["id"].combine_chunks(), scores, np.ones(scores.shape, bool), k))
        return pa.concat_tables(out)

    return retrieval._ranked_each(left.groupBy("cell", "block").cogroup(right.groupBy("cell", "block")).applyInArrow(run, f"query {kind}, id {ids}, score double"), k)


def probes_for(cells: Cells, vectors: DataFrame, queries: DataFrame, k: int = 10, share: float = 0.95, sample: int = 200) -> int:
    """In how many of a query's nearest cells that share of its k best rows lies, measured by an exact
    search for a sample of the queries (query, vector); vectors (id, vector) are the rows."""
    spark = queries.sparkSession
    drawn = cut(_placed(queries.select("query", "vector"), cells.centroids.shape[1]).where("__fits").orderBy(F.xxhash64("query"), "query").limit(sample).drop("__fits"))
    exact = retrieval.dense_topk_each(vectors, drawn, k)
    where = cells.read(spark).select("id", "cell")
    rows = exact.join(where, "id").join(F.broadcast(drawn), "query").select("vector", "cell").collect()  # k for each of the sample
    dropped(drawn)
    if not rows:
        return 1
    d = np.where(cells.rows > 0, _distance(_unit(np.array([r["vector"] for r in rows], float)), cells.centroids), np.inf)
    own = d[np.arange(len(rows)), np.maximum([r["cell"] for r in rows], 0)]
    return int(np.quantile((d < own[:, None]).sum(axis=1) + 1, share, method="higher"))


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """(queries, recall): the share of exact (query, id) that found has."""
    both = exact.select("query", "id").join(found.select("query", "id", F.lit(1).alias("hit")), ["query", "id"], "left")
    return both.agg(F.count_distinct("query").alias("queries"), (F.count("hit") / F.count("*")).alias("recall"))
