"""The two build phases: from files to stored chunks, and from chunks to a stored graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.config import DEFAULT
from quillspark.functions import models
from quillspark.functions import text as T
from quillspark.operators import assist, chunking, graph, ingest, store
from quillspark.sources import readers
from quillspark.sources.staging import cut


def chunk_chapters(chapters: DataFrame, max_tokens: int = DEFAULT.max_chunk_tokens, counters: tuple = ()) -> DataFrame:
    """chapters (doc, chapter_no, pian, ji, zhang, content) as chunks: chunk_id, doc, pian, ji, zhang,
    chunk_index, original_text. Sentences are packed greedily, with a break where two that
    follow are least alike."""
    key = F.struct("doc", "chapter_no")
    sentences = chapters.select(key.alias("group"), F.posexplode(T.sentences(F.col("content"))).alias("pos", "text"))
    units = ingest.token_lengths(sentences, counters).withColumn("vector", models.embed(F.col("text")))
    breaks = chunking.breaks(units.select("group", "pos", "vector", F.col("text").alias("txt"), F.col("n_tokens").alias("len")))
    packed = chunking.chunk_units(breaks, max_tokens).select("group.doc", "group.chapter_no", "chunk_index", F.array_join("parts", "").alias("original_text"))
    counts = packed.groupBy("doc", "chapter_no").agg(F.count("*").alias("n"))
    firsts = chunking.chunk_ids(counts.select(F.struct("doc", "chapter_no").alias("group"), "n")).select("group.doc", "group.chapter_no", "first_no")
    rows = packed.join(firsts, ["doc", "chapter_no"]).join(chapters.select("doc", "chapter_no", "pian", "ji", "zhang"), ["doc", "chapter_no"])
    return rows.select(F.format_string("chunk_%06d", F.col("first_no") + F.col("chunk_index")).alias("chunk_id"), "doc", "pian", "ji", "zhang", "chunk_index", "original_text")


def ingest_files(spark: SparkSession, files: DataFrame, chunk_path: str, model: models.Model = models.rules, counters: tuple = ()) -> DataFrame | None:
    """files (path, text) to stored chunks with their context; counters as for token_lengths(). None,
    and nothing written, where no chapter is found."""
    chapters = cut(chunking.chapters(readers.lines(files)))
    if chapters.isEmpty():
        return None
    chunks = chunk_chapters(chapters, counters=counters)
    keyed = chapters.select("doc", "pian", "ji", "zhang", F.struct("doc", "chapter_no").alias("ord"), "content")
    done = assist.enrich(ingest.with_context(chunks, keyed, ["doc", "pian", "ji", "zhang"]), model).drop("document", "doc")
    readers.write_chunks(done, chunk_path)
    return spark.read.schema(readers.CHUNK).json(chunk_path)


def build_graph(spark: SparkSession, chunk_path: str, edge_path: str, files: DataFrame | None = None, model: models.Model = models.rules) -> DataFrame | None:
    """Stored chunks to merged edges, in what is stored already; the totals of the extraction.
    Without stored chunks the files are ingested first; None where that finds nothing."""
    if not store.exists(spark, chunk_path):
        if files is None or ingest_files(spark, files, chunk_path, model) is None:
            return None
    chunks = spark.read.schema(readers.CHUNK).json(chunk_path).select(F.col("chunk_id").alias("chunk"), F.col("original_text").alias("text"))
    found = assist.extract(ingest.usable_chunks(chunks), model)
    found = cut(found.withColumn("status", F.when(F.col("status") == "error", "error").otherwise("ok")))  # a blank answer is no failure
    edges = found.select("chunk", F.posexplode("graph.edges").alias("i", "e"))
    order = F.struct("chunk", "i")
    triples = edges.select(F.col("e.source").alias("src"), F.col("e.relation").alias("relation"), F.col("e.target").alias("dst"), F.col("e.description").alias("description"), "chunk", order.alias("seq"))
    store.upsert_graph(spark, edge_path, triples)
    return ingest.extraction_totals(found)
