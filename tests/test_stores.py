"""Headings, the stored index, stored tables and the build phases."""

import pytest
from pyspark.sql import functions as F

from quillspark.functions import models
from quillspark.functions import text as T
from quillspark.operators import index, ingest, memory, retrieval, store
from quillspark.plans import phases
from quillspark.sources import readers
from quillspark.streaming import state  # noqa: F401  imports without a stream

HEADINGS = {
    "第一章（上）": ["第一章（上"], "第一篇第一集 甲": ["第一篇", "第一集 甲"], "第一章《雪》": ["第一章《雪"], "第三章，起": ["第三章，起"], "第一章|甲": ["第一章|甲"], "-第一章 甲": ["第一章 甲"],
    "第一章 甲 -": ["第一章 甲"], "第一章 甲·": ["第一章 甲"], "  第一篇　甲 第二章\t乙 ": ["第一篇 甲", "第二章 乙"], "【第八章】": ["第八章"], "第12章": ["第12章"],
}
BODY = ["第一章、甲", "第一篇中", "第3章里", "", "   ", "序 第一章", "章第一", "第一章" + "长" * 40, "他说第一章 甲"]


def test_headings(spark):
    rows = spark.createDataFrame([(x,) for x in [*HEADINGS, *BODY]], "line string").select("line", T.is_heading(F.col("line")).alias("h"), T.heading_segments(F.col("line")).alias("s")).collect()
    assert {r["line"] for r in rows if r["h"]} == set(HEADINGS)
    assert {r["line"]: r["s"] for r in rows if r["h"]} == HEADINGS


def test_index_reads_the_terms_of_a_query_only(spark):
    docs = spark.createDataFrame([(1, "red apple apple"), (2, "green apple"), (3, "blue sky 天空"), (4, None), (5, "")], "id long, text string")
    built = index.build(docs)
    assert built.n == 5 and built.avgdl == pytest.approx((3 + 2 + 4) / 4)
    plan = built.postings(spark, ["Apple", "天"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan.replace("isnotnull(bucket#", "[bucket#") or "bucket" in plan.split("PartitionFilters")[1][:200]
    assert {(r["id"], r["term"], r["tf"]) for r in built.postings(spark, ["Apple", "天"]).collect()} == {(1, "apple", 2), (2, "apple", 1), (3, "天", 1)}
    want = [tuple(r) for r in retrieval.bm25_topk(docs.where("text is not null"), ["apple", "red"]).select("id", "rank").collect()]
    assert [tuple(r) for r in index.bm25_topk(spark, built, ["apple", "red"]).select("id", "rank").collect()] == want
    assert {r["id"] for r in index.text_match(spark, built, ["sky", "green"]).collect()} == {2, 3}
    assert index.bm25_topk(spark, built, []).count() == 0
    assert index.bm25_topk(spark, index.build(docs.limit(0)), ["apple"]).count() == 0


def test_stored_tables(spark, tmp_path):
    at = lambda name: str(tmp_path / name)
    rows = spark.createDataFrame([("a", [1.0, 2.0], "x"), ("", [0.0, 1.0], "y")], "id string, vector array<double>, user string")
    store.append(rows, at("v"), "vector", 2)
    store.append(rows, at("v"), "vector", 2)
    assert store.read(spark, at("v"), ["id", "vector"]).count() == 4
    with pytest.raises(Exception, match="wrong vector length"):
        store.append(rows, at("w"), "vector", 3)
    with pytest.raises(ValueError, match="lacks"):
        store.read(spark, at("v"), ["name"])
    assert [tuple(r) for r in store.sample(spark.read.parquet(at("v")), "id", 1).collect()] == [("a", "x")]
    assert store.delete(spark, at("v"), spark.createDataFrame([("x",)], "user string"), ["user"]) == 2
    assert {r["name"]: (r["columns"], r["rows"]) for r in store.catalog(spark, {"v": at("v"), "none": at("none")}).collect()} == {"v": (["id", "user", "vector"], 2)}
    store.truncate(spark, at("v"))
    assert spark.read.parquet(at("v")).count() == 0
    for name in ("edges", "memories", "profile"):
        store.replace(spark.createDataFrame([("u", 1), ("u", 2), ("w", 3)], "user string, x int"), at(name))
    assert store.clear_user(spark, "u", at("edges"), at("memories"), at("profile")) == 2
    assert all(spark.read.parquet(at(n)).count() == 1 for n in ("edges", "memories", "profile"))


def test_phases(spark, tmp_path):
    chunks, edges = str(tmp_path / "chunks"), str(tmp_path / "edges")
    none = spark.createDataFrame([("p", "no chapter here\nat all")], "path string, text string")
    assert phases.build_graph(spark, chunks, edges, none) is None and not store.exists(spark, chunks)
    text = "第一篇 甲\n第一章 乙\nAnna met Bert。Bert saw Carl！\n第二章 丙\nDora。\n"
    files = spark.createDataFrame([("p", text)], "path string, text string")
    totals = phases.build_graph(spark, chunks, edges, files).first()
    assert (totals["succeeded"], totals["failed"], totals["nodes"], totals["edges"]) == (2, 0, 4, 2)
    stored = spark.read.schema(readers.CHUNK).json(chunks).orderBy("chunk_id").collect()
    assert [r["chunk_id"] for r in stored] == ["chunk_000000", "chunk_000001"] and stored[0]["enriched_text"].startswith("【上下文背景】")
    assert {(r["src"], r["dst"]) for r in spark.read.parquet(edges).collect()} == {("Anna", "Bert"), ("Bert", "Carl")}
    phases.build_graph(spark, chunks, edges)  # again: nothing is added twice
    assert spark.read.parquet(edges).count() == 2


def test_models_take_batches_and_retry_rows(spark):
    def service(task, payloads):
        if any("bad" in p for p in payloads):
            raise RuntimeError("down")
        return [p.upper() for p in payloads]

    rows = spark.createDataFrame([("a",), ("bad",), (None,), ("b",), (" ",)], "p string").coalesce(1)
    got = [tuple(r["x"]) for r in rows.select(models.complete("t", F.col("p"), service).alias("x")).collect()]
    assert got == [("A", "ok"), (None, "error"), (None, "empty"), ("B", "ok"), (None, "empty")]
    pairs = spark.createDataFrame([("q", "one"), ("q", None)], "q string, t string")
    assert [r[0] for r in pairs.select(models.rerank(F.col("q"), F.col("t"), lambda x: [float(len(t)) for _, t in x])).collect()] == [3.0, 0.0]


def test_counters_and_judgements(spark):
    def missing(_):
        raise ImportError("no vocabulary")

    texts = spark.createDataFrame([("ab, 天空!",), (None,)], "text string")
    assert [r["n_tokens"] for r in ingest.token_lengths(texts, (missing,)).collect()] == [5, 0]
    assert [r["n_tokens"] for r in ingest.token_lengths(texts, (missing, lambda c: F.lit(7))).collect()] == [7, 7]
    nan = float("nan")
    first, second = (spark.createDataFrame(x, "id int, score double") for x in ([(1, nan), (2, 0.5), (3, None), (4, nan)], [(1, 0.25), (3, 0.75), (4, nan)]))
    assert {r["id"]: r["score"] for r in memory.judged(first, second).collect()} == {1: 0.25, 2: 0.5, 3: 0.75, 4: 0.0}
    log = spark.createDataFrame([(1, "q", " ", nan, 0.5)], "id int, query string, answer string, faithfulness double, context_precision double")
    r = memory.log_record(log).first()
    assert (r["answer"], r["faithfulness"]) == (memory.DEFAULT_REPLY, 0.0)
    assert spark.range(1).select(T.to_double(F.lit("x")), T.to_double(F.lit("1.5"))).first()[:] == (0.0, 1.5)


def test_readers(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("第一章\r\n正文\n".encode("gb18030") + b"\xff")
    files = readers.decoded_files(spark, str(tmp_path / "a.txt"))
    assert files.first()["replaced"] == 1
    assert [r["line"] for r in readers.lines(files).orderBy("line_no").collect()][:2] == ["第一章", "正文"]
    (tmp_path / "c.json").write_text('[\n {"chunk_id": "c1", "chunk_index": 0, "original_text": "x"}\n]')
    assert readers.chunks(spark, str(tmp_path / "c.json")).first()["chunk_id"] == "c1"
    for _ in range(2):
        readers.append_log(spark.createDataFrame([(1,)], "a int"), str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 2
