"""Operators without SQL: invariants, fallbacks, worked examples and streams."""

import json
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import assist, graph, memory, retrieval, webhook
from quillspark.streaming import state


def cliques(spark, sizes):
    rows, first = [], 0
    for n in sizes:
        rows += [(first + i, first + j, 1) for i in range(n) for j in range(i + 1, n)]
        first += n
    return spark.createDataFrame(rows, "a long, b long, weight long")


def tree(df):
    return [(r["level"], r["community_id"], r["member"]) for r in df.collect()]


def test_partition_separates_cliques_and_cuts_the_large(spark):
    edges = cliques(spark, [4, 5, 12]).select(F.col("a").cast("string").alias("a"), F.col("b").cast("string").alias("b"), "weight")
    nodes = spark.createDataFrame([(str(i),) for i in range(22)], "node string")
    got = {r["node"]: r["community"] for r in graph.partition(edges, nodes, 5, 1.0, 2.0).collect()}
    assert len(got) == 22
    assert max(Counter(got.values()).values()) <= 5
    assert len({got[str(i)] for i in range(4)}) == 1 and len({got[str(i)] for i in range(4, 9)}) == 1
    assert got["21"] == "21"
    members = lambda c: {n for n, x in got.items() if x == c}
    assert all(c == min(members(c)) for c in got.values())


def test_hierarchy_invariants_and_summaries(spark):
    edges = cliques(spark, [3, 3, 3]).unionByName(spark.createDataFrame([(0, 3, 1), (3, 6, 1), (None, 1, 1)], "a long, b long, weight long"))
    nodes = spark.createDataFrame([(i,) for i in range(9)], "node long")
    h = graph.hierarchy(edges, nodes)
    rows = tree(h)
    top = max(level for level, _, _ in rows)
    assert sorted(m for level, _, m in rows if level == 0) == [str(i) for i in range(9)]
    for level in range(1, top + 1):
        assert {m for x, _, m in rows if x == level} == {c for x, c, _ in rows if x == level - 1}
        assert len({c for x, c, _ in rows if x == level}) < len({c for x, c, _ in rows if x == level - 1}) or level == top
    assert tree(graph.hierarchy(edges, nodes)) and sorted(tree(graph.hierarchy(edges, nodes))) == sorted(rows)

    typed = nodes.select("node", F.lit("T").alias("type"), F.lit("d").alias("description"))
    made = graph.summaries(h, typed, edges.where("a is not null").withColumn("relations", F.array(F.lit("r"))))
    got = {r["community_id"]: r["summary"] for r in made.collect()}
    assert set(got) == {c for _, c, _ in rows}
    low = next(c for x, c, m in rows if x == 0 and m == "0")
    assert "0 T d" in got[low]
    if top:
        above = next(c for x, c, m in rows if x == 1 and m == low)
        assert low in got[above]
    below, ups = graph.community_tables(h, made)
    assert below.count() == len(got) and ups.count() == len(rows)


def test_hierarchy_of_one_and_of_no_node(spark):
    none = spark.createDataFrame([], "a long, b long, weight long")
    one = spark.createDataFrame([(7,), (None,)], "node long")
    assert tree(graph.hierarchy(none, one)) == [(0, "C_0_7", "7")]
    assert tree(graph.hierarchy(none, one.limit(0))) == []


def failing(task, payloads):
    raise RuntimeError("no service")


def blank(task, payloads):
    return ["  "] * len(payloads)


def test_enrich_falls_back(spark):
    c = spark.createDataFrame([("Doc line", "one"), ("Doc line", " "), ("Doc line", None)], "document string, original_text string")
    got = lambda m: [(r["context_prefix"], r["enriched_text"]) for r in assist.enrich(c, m).collect()]
    empty = (assist.EMPTY_CONTEXT, "")
    assert got(assist.models.rules) == [("Doc line", assist.CONTEXT_LABEL + "Doc line\none"), empty, empty]
    assert got(failing) == [(assist.FAILED_CONTEXT, "one"), empty, empty]
    assert got(blank) == [(assist.NO_CONTEXT, f"{assist.CONTEXT_LABEL}{assist.NO_CONTEXT}\none"), empty, empty]


def test_route_and_extract_fall_back(spark):
    q = spark.createDataFrame([("Tell me about Ann", "h"), (None, None)], "query string, history string")
    bad = lambda task, p: ['{"reasoning":"x","mode":"OTHER","rewritten_query":"y"}'] * len(p)
    for model in (failing, blank, bad):
        got = [tuple(r["route"]) for r in assist.route(q, model).collect()]
        assert got == [(assist.ROUTE_FALLBACK, "LOCAL", "Tell me about Ann", []), (assist.ROUTE_FALLBACK, "LOCAL", "", [])]
    fenced = lambda task, p: ['```json\n{"reasoning":"x","mode":"GLOBAL","rewritten_query":"y"}\n```'] * len(p)
    assert tuple(assist.route(q, fenced).first()["route"]) == ("x", "GLOBAL", "y", [])
    texts = spark.createDataFrame([("c", "Ann met Bob"), ("d", None)], "chunk string, text string")
    assert [len(r["graph"]["nodes"]) for r in assist.extract(texts).collect()] == [2, 0]
    assert [len(r["graph"]["edges"]) for r in assist.extract(texts, failing).collect()] == [0, 0]


def test_profiles_and_write_back(spark):
    e = spark.createDataFrame(
        [("a", "T", "old", ["x", " x ", "y", None]), ("b", None, "old", ["  "]), ("c", "T", "", [""]), ("d", "T", "keep", []), ("", "T", "", ["z"])],
        "id string, type string, description string, all_descriptions array<string>",
    )
    p = assist.profiles(e, failing)
    assert {r["id"]: r["summary"] for r in p.collect()} == {"a": "x；y", "b": "old", "c": "c是小说中的T，当前缺少稳定描述。"}
    got = {r["id"]: r for r in assist.write_profiles(e, p, clear=True).collect()}
    assert got["a"]["description"] == "x；y" and got["a"]["all_descriptions"] is None and len(got["a"]["embedding"]) == 64
    assert got["d"]["description"] == "keep" and got["d"]["all_descriptions"] == [] and got["d"]["embedding"] is None


def test_community_summary_placeholders(spark):
    c = spark.createDataFrame([("a", ["x"]), ("b", []), ("c", None)], "community_id string, content array<string>")
    got = lambda m: [r["summary"] for r in assist.summarize(c, m).collect()]
    assert got(assist.models.rules) == ["x", assist.NO_CONTENT, assist.NO_CONTENT]
    assert got(failing)[0] == assist.FAILED_SUMMARY and got(blank)[0] == assist.NO_SUMMARY


@pytest.mark.parametrize(
    "text, want",
    [(' "one two! onetwo! 2" ', "one two!2"), ("a。a。b！c？d；e", "a。b！c？d；"), ("a!!", "a!!"), ("x.5 y", "x.5 y"), ("", ""), (None, ""), ("“”", "")],
)
def test_clean_summary(spark, text, want):
    assert spark.range(1).select(T.clean_summary(F.lit(text)).alias("s")).first()["s"] == want


def test_no_memory_and_entities(spark):
    df = spark.createDataFrame([(t,) for t in ["None", "无", "这是闲聊", "", None, "kept"]], "t string")
    assert [r["n"] for r in df.select(T.no_memory(F.col("t")).alias("n")).collect()] == [True, True, True, True, True, False]
    one = spark.range(1).select(T.entity_keywords(F.array(F.lit(" 1a "), F.lit("1a"), F.lit("me")), F.lit("txt"), "me").alias("k"))
    assert one.first()["k"] == ["1a"]


@pytest.mark.parametrize("text, want", [("删除记忆", "help"), ("清空记忆 ： 2", "2"), ("删除记忆21", "12"), ("删除记忆3", None), ("", None)])
def test_memory_command(spark, text, want):
    assert spark.range(1).select(webhook.memory_command(F.lit(text)).alias("c")).first()["c"] == want


def test_webhook_statuses(spark):
    new = lambda **m: json.dumps({"header": {"event_type": webhook.RECEIVE, "token": "t"}, "event": {"message": m}})
    cases = [
        (new(message_type="text", content='{"text":"@_user_1  hi   you"}'), "message", "hi you"),
        (new(message_type="text", content="plain"), "message", "plain"),
        (new(message_type="text", content='{"other":1}'), "empty", ""),
        (new(message_type="image", content="{}"), "not_text", ""),
        (json.dumps({"event": {"type": "message", "content": '{"text":"old"}'}}), "message", "old"),
        (json.dumps({"event": {"type": "joined"}}), "other", None),
        (json.dumps({"encrypt": "x"}), "encrypted", None),
        (json.dumps({"challenge": "c", "token": "t"}), "challenge", None),
        (json.dumps({"challenge": "c"}), "refused", None),
        (json.dumps({"token": "no", "event": {"type": "message", "text": "x"}}), "refused", "x"),
        ("not json", "invalid", None), ("[1]", "invalid", None), (None, "invalid", None),
    ]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i long, payload string")
    got = {r["i"]: (r["status"], r["text"]) for r in webhook.parse(df, "t").collect()}
    assert [got[i] for i in range(len(cases))] == [c[1:] for c in cases]
    assert webhook.parse(df).where("i = 0").first()["user_id"] == webhook.UNKNOWN_USER


def test_dispatch_and_context(spark):
    def source(name):
        return lambda k: spark.createDataFrame([(i, f"{name}{i}") for i in range(min(k, 2))], "pos int, text string")

    search = {n: source(n) for n in ("local", "global", "memory", "user_graph")}
    assert retrieval.dispatch("DIRECT", [], search) is None and retrieval.dispatch("odd", [], search) is None
    assert retrieval.context(None) == ""
    sections = lambda mode, e: [r["section"] for r in retrieval.dispatch(mode, e, search).select("section_no", "section").distinct().orderBy("section_no").collect()]
    assert sections("local", ["x"]) == ["chunks"]
    assert sections("GLOBAL", [" 当前用户 "]) == ["summaries", "details", "user_graph"]
    assert sections("MEMORY", ["当前用户"]) == ["memories", "related"]
    text = retrieval.context(retrieval.dispatch("MEMORY", [], search))
    assert text == f"{retrieval.TITLES['memories']}\nmemory0\n---\nmemory1{retrieval.SECTION_BREAK}{retrieval.TITLES['related']}\nlocal0\n---\nlocal1"


def test_user_graph_recall_without_entity_index(spark):
    edges = spark.createDataFrame([("u", 1, "Agent_Memory", [10, 11]), ("u", 2, None, [12]), ("v", 1, "Agent_Memory", [13])], "user string, target long, created_by string, evidence array<long>")
    memories = spark.createDataFrame([(10, [1.0, 0.0], "ten"), (11, [0.9, 0.1], " "), (12, [1.0, 0.0], "no"), (13, [1.0, 0.0], "no")], "id long, vector array<double>, summary string")
    query = spark.createDataFrame([([1.0, 0.0],)], "vector array<double>")
    got = retrieval.user_graph_recall(edges, memories, query, None, "u").collect()
    assert [(r["id"], r["summary"], r["rank"]) for r in got] == [(10, "ten", 0)]


def stream_of(spark, tmp_path, batches, schema):
    """A stream of one file, and so one micro-batch, for each list of rows."""
    import os
    import time

    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / f"in{i}"))
        name = next(f for f in os.listdir(tmp_path / f"in{i}") if f.endswith(".parquet"))
        (tmp_path / "in").mkdir(exist_ok=True)
        os.rename(tmp_path / f"in{i}" / name, tmp_path / "in" / f"{i}.parquet")
        os.utime(tmp_path / "in" / f"{i}.parquet", (time.time() - 100 + i, time.time() - 100 + i))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def finish(df, tmp_path):
    out = str(tmp_path / "out")
    df.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(out).awaitTermination()
    return df.sparkSession.read.parquet(out)


def test_ttl_dedupe_stream_equals_the_batch_form(spark, tmp_path):
    seconds = [[("k", 0, "a"), ("", 0, "x")], [("k", 500, "b"), ("k", 600, "c"), (None, 500, "y")], [("k", 601, "d"), ("j", 601, "e")], [("k", 650, "f"), ("", 650, "z")], [("k", 5000, "g"), ("j", 5001, "h")], [("k", 5400, "i")]]
    flat = [r for b in seconds for r in b]
    batches = [[(k, F_ts(at), i) for k, at, i in b] for b in seconds]
    stream = stream_of(spark, tmp_path, batches, "key string, at timestamp, id string")
    got = {r["id"]: r["accepted"] for r in finish(state.ttl_dedupe(stream), tmp_path).collect()}
    want = {r["id"]: r["accepted"] for r in memory.ttl_dedupe(spark.createDataFrame(flat, "key string, at long, id string"), 600).collect()}
    assert got == want
    assert [got[i] for i in "abcdfgi"] == [True, False, False, True, False, True, False]


def F_ts(seconds):
    import datetime

    return datetime.datetime.fromtimestamp(1_700_000_000 + seconds)


def test_sessions_keep_the_last_messages_and_reset(spark, tmp_path):
    rows = [[("u", i, "user", f"m{i}", None) for i in range(5)], [("u", i, "user", f"m{i}", False) for i in range(5, 9)] + [("v", 0, "user", "n", None)], [("u", 9, "user", "forget", True), ("u", 10, "user", "m10", None)]]
    stream = stream_of(spark, tmp_path, rows, "user string, seq long, role string, text string, reset boolean")
    got = {(r["user"], r["seq"]): [t for _, t in json.loads(r["history"])] for r in finish(state.sessions(stream), tmp_path).collect()}
    assert got[("u", 0)] == [] and got[("u", 8)] == [f"m{i}" for i in range(2, 8)]
    assert got[("u", 9)] == [f"m{i}" for i in range(3, 9)] and got[("u", 10)] == [] and got[("v", 0)] == []


def test_topk_of_every_query_is_that_of_each_alone(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 3)
    monkeypatch.setattr(retrieval, "ROW_BLOCK", 5)
    monkeypatch.setattr(retrieval, "TERM_BLOCK", 7)
    monkeypatch.setattr(retrieval, "SLICE", 2)
    rng = random.Random(3)
    rows = [(i, [rng.choice([-1.0, 0.0, 0.5, 2.0]) for _ in range(3)], " ".join(rng.choice("ab cd ef gh ij".split()) for _ in range(rng.randrange(6)))) for i in range(20)]
    rows += [(20, None, None), (21, [0.0, 0.0, 0.0], "zz"), (22, rows[0][1], rows[0][2]), (23, [1.0, 2.0], "AB ab cd")]
    df = spark.createDataFrame(rows, "id long, vector array<float>, text string")
    asked = df.where("id % 3 = 0 or id > 19")
    words = asked.selectExpr("id as query", "split(coalesce(text, ''), ' ') as words")
    dense = retrieval.dense_topk_each(df.select("id", "vector"), asked.selectExpr("id as query", "vector"), 4).collect()
    sparse = retrieval.bm25_topk_each(df.select("id", "text"), words, 4).collect()
    cells = lambda found: sorted((r["rank"], r["id"], r["score"]) for r in found)
    for i, w in ((r["query"], r["words"]) for r in words.collect()):
        assert cells(r for r in dense if r["query"] == i) == cells(retrieval.dense_topk(df.select("id", "vector"), df.where(f"id = {i}"), 4).collect())
        assert cells(r for r in sparse if r["query"] == i) == cells(retrieval.bm25_topk(df.select("id", "text"), w, 4).collect())
