"""Merged edges stored both ways by node, so that an expansion reads its frontier only.

Rows (u, v, eid, chunks) lie in folders by a hash of u, as many as the rows ask for, sorted by u inside.
A hop over few nodes names their folders and the nodes themselves in the scan; a hop over many joins
them, on folder and node. Edges that memory made and edges without evidence are not stored, as no path
may use them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.config import DEFAULT
from quillspark.operators import graph
from quillspark.sources.staging import cut, fresh_path, source_key

#: Rows of a folder; nodes that a scan names one by one.
FOLDER, NAMED = 1 << 20, 4000


@dataclass(frozen=True)
class Adjacency:
    path: str
    schema: str
    buckets: int

    def bucket(self, node: Column) -> Column:
        return F.pmod(F.xxhash64(node), F.lit(self.buckets)).cast("int")

    def read(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(self.schema).parquet(self.path)

    def around(self, spark: SparkSession, nodes: DataFrame) -> DataFrame:
        """The rows (u, v, eid, chunks) of nodes (u), each node once."""
        few = [r["u"] for r in nodes.limit(NAMED + 1).collect()]
        rows = self.read(spark)
        if not few:
            return rows.limit(0).drop("bucket")
        if len(few) <= NAMED:
            kind = self.schema.split(",")[0].split()[1]
            folders = spark.createDataFrame([(u,) for u in few], f"u {kind}").select(self.bucket(F.col("u")).alias("b")).distinct()
            return rows.where(F.col("bucket").isin([r["b"] for r in folders.collect()]) & F.col("u").isin(few)).drop("bucket")
        wanted = nodes.select("u", self.bucket(F.col("u")).alias("bucket"))
        return rows.join(wanted, ["bucket", "u"], "left_semi").drop("bucket")


def _both_ways(rows: DataFrame) -> DataFrame:
    """(u, v, eid, chunks) of (src, dst, eid, chunks). A loop is one row: both ways of it are the same way."""
    ways = F.when(F.col("src") == F.col("dst"), F.array(F.struct(F.col("src").alias("u"), F.col("dst").alias("v")))).otherwise(F.array(F.struct(F.col("src").alias("u"), F.col("dst").alias("v")), F.struct(F.col("dst").alias("u"), F.col("src").alias("v"))))
    return rows.select(F.explode(ways).alias("w"), "eid", "chunks").select("w.u", "w.v", "eid", "chunks")


@dataclass(frozen=True)
class Unmerged:
    """Triples (src, relation, dst, description, chunk, seq) that are not stored: a search merges the edges at
    its frontier only. For single searches of tables that no search had before."""

    triples: DataFrame

    def around(self, spark: SparkSession, nodes: DataFrame) -> DataFrame:
        """The rows (u, v, eid, chunks) of nodes (u), each node once, as Adjacency.around()."""
        few = [r["u"] for r in nodes.limit(NAMED + 1).collect()]
        if len(few) <= NAMED:
            at = lambda rows, c: rows.where(F.col(c).isin(few))
            other = self.triples.where(~F.col("src").isin(few)) if few else self.triples
        else:
            at = lambda rows, c: rows.join(nodes.select(F.col("u").alias(c)), c, "left_semi")
            other = self.triples.join(nodes.select(F.col("u").alias("src")), "src", "left_anti")
        touched = at(self.triples, "src").unionByName(at(other, "dst")).where("src is not null and dst is not null")
        edges = graph.merge_edges(touched).where("size(source_chunk_ids) > 0")
        rows = edges.select("src", "dst", F.xxhash64("src", "relation", "dst").alias("eid"), F.col("source_chunk_ids").alias("chunks"))
        return at(_both_ways(rows), "u")


def build(edges: DataFrame, path: str | None = None) -> Adjacency:
    """edges (src, relation, dst, source_chunk_ids, maybe created_by), merged, at path or else in the
    shared folder."""
    spark, path = edges.sparkSession, path or fresh_path(edges.sparkSession, "adjacency")
    rows = edges.where("src is not null and dst is not null and size(source_chunk_ids) > 0")
    if "created_by" in edges.columns:
        rows = rows.where(F.coalesce("created_by", F.lit("")) != "Agent_Memory")
    rows = rows.select("src", "dst", F.xxhash64("src", "relation", "dst").alias("eid"), F.col("source_chunk_ids").alias("chunks"))
    both = cut(_both_ways(rows))
    kinds = {f.name: f.dataType.simpleString() for f in both.schema.fields}
    out = Adjacency(path, f"u {kinds['u']}, v {kinds['v']}, eid long, chunks {kinds['chunks']}, bucket int", max(1, -(-both.count() // FOLDER)))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # a hub's rows are dealt out by its edges
    dealt = both.withColumn("bucket", out.bucket(F.col("u"))).repartition(parts, "bucket", F.pmod("eid", F.lit(max(1, parts // out.buckets))))
    dealt.sortWithinPartitions("bucket", "u").write.partitionBy("bucket").parquet(path)
    return out


_built: dict[tuple, Adjacency] = {}


def of(edges: DataFrame) -> Adjacency:
    """The stored adjacency of edges for this application, as index.of()."""
    key = source_key(edges)
    if key is None:
        return build(edges)
    if key not in _built:
        _built[key] = build(edges)
    return _built[key]


def evidence(stored: Adjacency | Unmerged, seeds: DataFrame, cap: int = DEFAULT.graph_chunk_cap) -> DataFrame:
    """(chunk, score, freq): evidence of all paths of one or two edges from the seeds (id, score), either
    way along an edge, no edge twice in a path: what graph.evidence() gives for the edges. Each hop reads
    the rows of its frontier."""
    spark = seeds.sparkSession
    first = stored.around(spark, seeds.select(F.col("id").alias("u")).where("u is not null").distinct())
    one = cut(first.join(seeds.select(F.col("id").alias("u"), "score"), "u").select("score", "eid", F.col("v").alias("w"), F.col("chunks").alias("c1")))
    second = stored.around(spark, one.select(F.col("w").alias("u")).distinct())
    two = one.join(second.select(F.col("u").alias("w"), F.col("eid").alias("eid2"), F.col("chunks").alias("c2")), "w").where("eid <> eid2")
    chunks = one.select("score", F.explode("c1").alias("chunk")).unionByName(two.select("score", F.explode(F.concat("c1", "c2")).alias("chunk")))
    found = chunks.groupBy("chunk").agg(F.max("score").alias("score"), F.count("*").alias("freq"))
    return found.orderBy(F.desc("score"), F.desc("freq"), "chunk").limit(cap)
