"""Connected components of an edge table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm._shared import discard, staged


def local_forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) of every node but the roots: stars as the edges' components."""
    names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(names))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        while (new[new] != new).any():
            new = new[new]
        if (new == root).all():
            break
        root = new
    leaf = root != np.arange(len(names))
    return names[leaf], names[root[leaf]]


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root) for every node on an edge (a, b): root is the smallest node of its
    component. Every task first reduces its own edges to stars, some at a time; then
    large-star and small-star steps (Kiveris et al. 2014) alternate on stored tables until
    every node has one root that is a root itself. Every step groups by a node behind
    map-side combining, and no more rows than edges exist at any time."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most, held, size = 1 << 20, [np.zeros((2, 0), np.int64)], 0
        for batch in batches:
            held.append(np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()]))
            size += batch.num_rows
            if size >= most:
                stars = np.stack(local_forest(*np.concatenate(held, axis=1)))
                if stars.shape[1] >= most // 2:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in stars], names=["a", "b"])
                    stars = stars[:, :0]
                held, size = [stars], stars.shape[1]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in local_forest(*np.concatenate(held, axis=1))], names=["a", "b"])

    def small_star(e: DataFrame) -> DataFrame:
        down = e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        joined = down.join(low.hint("merge"), "u")
        return joined.select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(low.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct()

    def large_star(e: DataFrame) -> DataFrame:
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        return both.join(low.hint("merge"), "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()

    now = staged(edges.where("a <> b").select("a", "b").mapInArrow(local, "a long, b long"), name)
    while True:
        both = now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")))
        placed = staged(both.groupBy("node").agg(F.min("root").alias("root"), F.max("root").alias("other")), name)
        if placed.where("root <> other").isEmpty():
            discard(now)
            return placed.select("node", "root")
        discard(placed)
        before, now = now, staged(small_star(large_star(now)), name)
        discard(before)
