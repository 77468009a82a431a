"""Registered queries on tables whose size or values the small test tables do not have, against their SQL."""

import duckdb

from quillspark.plans import registry


def rows(table):
    return sorted(map(tuple, table), key=repr)


def same(spark, folder, name, **tables):
    """Writes tables (SQL of DuckDB) to folder; whether the query's rows are those of its SQL."""
    con = duckdb.connect()
    for t, sql in tables.items():
        con.execute(f"COPY ({sql}) TO '{folder}/{t}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    got, want = registry.queries()[name](spark, str(folder)), con.sql(registry.oracle_sql()[name])
    return rows(got.select(*want.columns).collect()) == rows(want.fetchall())


def test_times_within_a_second_of_the_limit_are_rounded_as_in_sql(spark, tmp_path):
    events = """SELECT i AS event_id, TIMESTAMP '2024-01-01 00:00:00.4' + to_milliseconds(i // 2 * 600_100 + (i % 2) * 400) AS ts, i % 3 AS user_id, 'view' AS event_type, 1.0 AS value, '{}' AS props FROM range(400) r(i)"""
    assert same(spark, tmp_path, "ttl_dedupe", events=events)


def test_totals_name_every_failed_chunk(spark, tmp_path):
    assert same(spark, tmp_path, "extraction_totals", documents="SELECT i * 25 AS doc_id, 'Alice met Bob' AS text, 'en' AS lang, 's' AS source, 13 AS n_chars FROM range(2400) r(i)")


def test_filtered_search_over_more_cells_than_an_expression_can_nest(spark, tmp_path):
    import numpy as np

    from quillspark.operators import cells, retrieval

    x = np.random.default_rng(3).normal(size=(2000, 32))
    v = spark.createDataFrame([(i, r.tolist(), i % 10) for i, r in enumerate(x)], "id long, vector array<double>, label int")
    stored = cells.build(v, cells=500)
    got = cells.search(spark, stored, x[0].tolist(), 20, where="label <> 3").collect()
    assert got == retrieval.dense_topk(v.where("label <> 3"), v.where("id = 0"), 20).collect()


def test_connected_parts_of_a_large_graph_are_divided_as_groups(spark, monkeypatch):
    from pyspark.sql import functions as F

    from quillspark.operators import graph, leiden

    monkeypatch.setattr(leiden, "GROUP", 1000)

    def never(*_):
        raise AssertionError("no part is larger than a group")

    monkeypatch.setattr(leiden, "leiden", never)
    # five rings of 60 nodes, and pairs
    rows = [(f"r{r}_{i:02d}", f"r{r}_{(i + s) % 60:02d}", 1.0) for r in range(5) for i in range(60) for s in (1, 2)] + [(f"p{i}", f"q{i}", 1.0) for i in range(40)]
    edges = spark.createDataFrame(rows, "a string, b string, weight double")
    nodes = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    got = {r["node"]: r["community"] for r in graph.partition(edges, nodes, 30, 0.2, 3.0).collect()}
    assert set(got) == {r["node"] for r in nodes.collect()}
    sizes = {c: sum(x == c for x in got.values()) for c in got.values()}
    assert max(sizes.values()) <= 30 and all(got[f"p{i}"] == got[f"q{i}"] == f"p{i}" for i in range(40))
    assert all(n.split("_")[0] == c.split("_")[0] for n, c in got.items() if n[0] == "r")


def test_connected_follows_long_paths(spark):
    from quillspark.operators import leiden

    rows = [(f"{p}{i:04d}", f"{p}{i + 1:04d}") for p in "xy" for i in range(300)]
    edges = spark.createDataFrame(rows + [(b, a) for a, b in rows], "a string, b string")
    nodes = edges.select(edges.a.alias("node")).distinct()
    assert {(r["node"][0], r["part"]) for r in leiden.connected(edges, nodes).collect()} == {("x", "x0000"), ("y", "y0000")}


def test_evidence_of_unmerged_triples_is_that_of_the_stored_edges(spark, monkeypatch):
    import random

    from quillspark.operators import adjacency, graph

    rng = random.Random(5)
    rows = [(rng.randrange(30), rng.choice("ab"), rng.choice([None, *range(30)]), "x", rng.randrange(50), i) for i in range(300)]
    t = spark.createDataFrame(rows, "src long, relation string, dst long, description string, chunk long, seq long")
    seeds = spark.createDataFrame([(1, 0.5), (2, 0.25), (99, 1.0)], "id long, score double")
    want = adjacency.evidence(adjacency.build(graph.merge_edges(t)), seeds, 1000).collect()
    for named in (4000, 1):
        monkeypatch.setattr(adjacency, "NAMED", named)
        assert adjacency.evidence(adjacency.Unmerged(t), seeds, 1000).collect() == want


def test_a_scan_among_some_documents_equals_an_index_of_these(spark):
    from quillspark.operators import index, retrieval

    docs = spark.createDataFrame([(i, None if i == 7 else f"red w{i % 3} " + "blue " * (i % 5)) for i in range(40)], "id long, text string")
    some = docs.where("id % 3 <> 1")
    want = index.bm25_topk(spark, index.build(some), ["red", "Blue", "none"], 12).collect()
    assert retrieval.bm25_topk(docs, ["red", "Blue", "none"], 12, among=some.select("id")).collect() == want


def test_a_model_gets_bounded_calls(spark):
    from pyspark.sql import functions as F

    from quillspark.functions import models

    out = spark.range(3000).coalesce(1).select(models.complete("x", F.col("id").cast("string"), lambda task, p: [str(len(p))] * len(p)).alias("a"))
    assert max(int(r["a"]["value"]) for r in out.collect()) <= models.CALL


def test_postings_are_not_shuffled_for_blocks_of_queries(spark, monkeypatch):
    import random

    from pyspark.sql import functions as F

    from quillspark.operators import retrieval

    for name, n in (("ROW_BLOCK", 5), ("TERM_BLOCK", 12), ("SLICE", 3)):
        monkeypatch.setattr(retrieval, name, n)
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choices(["w%d" % j for j in range(30)], k=rng.randrange(12))) if i % 7 else None) for i in range(90)]
    docs = spark.createDataFrame(rows, "id long, text string").repartition(3)
    words = {q: rng.sample(["W%d" % j for j in range(33)], 4) for q in range(40)}
    asked = spark.createDataFrame(list(words.items()), "query long, words array<string>")
    found = retrieval.bm25_topk_each(docs, asked, 5)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CoGroup" not in plan and "Join" not in plan  # documents are gone through where they lie
    got = found.collect()
    for q in range(0, 40, 4):
        want = retrieval.bm25_topk(docs, words[q], 5).collect()
        assert sorted((r["rank"], r["id"], r["score"]) for r in got if r["query"] == q) == sorted((r["rank"], r["id"], r["score"]) for r in want)
    ranked = [got_ for got_ in (found, found.withColumn("id", F.col("id") + 1))]
    local = retrieval.local_each(docs, asked, [(df.select("query", "id", "rank"), 1.0) for df in ranked], 8, 0.2, 4)
    joins = local._jdf.queryExecution().executedPlan().toString()
    assert "term#" not in joins  # no row for each posting
    assert 0 < local.count() <= 160
