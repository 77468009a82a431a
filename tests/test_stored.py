"""Stored structures: segments of postings, cells of vectors, adjacency, keyed tables, numbers, communities."""

import math
import os
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillspark.functions import text, tokens, variants
from quillspark.operators import adjacency, cells, graph, index, keyed, leiden, numbering, retrieval, search, store
from quillspark.sources.staging import source_key

WORDS = "ab cd ef gh ij kl mn".split()


def texts(spark, seed, ids):
    rng = random.Random(seed)
    return spark.createDataFrame([(i, None if rng.random() < 0.1 else " ".join(rng.choices(WORDS, k=rng.randrange(6)))) for i in ids], "id long, text string")


def found(spark, built, words):
    return [tuple(r) for r in index.bm25_topk(spark, built, words, 50).collect()]


def test_segments_equal_a_rebuild(spark, tmp_path):
    path = str(tmp_path / "index")
    live = {}
    built = index.at(spark, path)
    assert (built.version, built.n) == (0, 0) and found(spark, built, ["ab"]) == []
    for step, ids in enumerate([range(0, 30), range(25, 45), range(3, 8)]):
        rows = texts(spark, step, ids)
        built = index.append(built, rows)
        live |= {r["id"]: r["text"] for r in rows.collect()}
    gone = spark.createDataFrame([(4,), (40,), (999,)], "id long")
    built = index.delete(built, gone)
    live = {i: t for i, t in live.items() if i not in (4, 40)}
    fresh = index.build(spark.createDataFrame(list(live.items()), "id long, text string"))
    assert (built.n, built.avgdl) == (len(live), fresh.avgdl)
    once_more = index.at(spark, path)
    assert once_more == built and len(built.segments) == 3
    merged = index.merge(spark, built, 2)
    whole = index.merge(spark, merged)
    assert (len(merged.segments), len(whole.segments)) == (2, 1) and not [e for e in whole.entries if e["kind"] == "gone"]
    for words in (["ab"], ["cd", "kl", "zz"], WORDS, []):
        want = found(spark, fresh, words)
        assert all(found(spark, x, words) == want for x in (built, once_more, merged, whole))
    assert index.vacuum(spark, whole) > 0
    assert found(spark, index.at(spark, path), WORDS) == found(spark, fresh, WORDS)
    assert index.delete(whole, gone) is whole


def test_terms_over_bytes_equal_the_pattern(spark):
    odd = ["", None, "a", "天", "ab天天c_1", "天", "x", "É İK ſ ß é", "\u4dff\u4e00\u9fff\ua000\u3400", "😀a😀", "a\u0000b-C", "ends a", "begins", " ", "\U00020000天"]
    rng = random.Random(5)
    rows = [(i, t) for i, t in enumerate([*odd, *("".join(rng.choices("aZ_9 -.é天\u9fff\ua000😀\n", k=rng.randrange(40))) for _ in range(300))])]
    docs = spark.createDataFrame(rows, "id long, text string").coalesce(1)
    want = docs.select("id", text.terms(F.col("text")).alias("t"), F.lower("text").alias("l")).orderBy("id").collect()
    got = tokens.split_terms(pa.array([r["l"] for r in want])[0:]).to_pylist()
    assert [[x.decode() for x in g] for g in got] == [r["t"] or [] for r in want]
    got = tokens.split_terms(pa.array([r["l"] for r in want])[3:9]).to_pylist()
    assert [[x.decode() for x in g] for g in got] == [r["t"] or [] for r in want][3:9]
    assert sorted(map(tuple, retrieval.counted(docs).collect())) == sorted(map(tuple, retrieval.postings(docs).select("id", "dl", "term", "tf").collect()))


def test_an_index_moves_lists_and_not_postings(spark, monkeypatch):
    """Rows that are stored are lists of a term in many documents; small ones give the same."""
    docs = spark.createDataFrame([(i, f"common w{i % 7} 天 common") for i in range(400)], "id long, text string").coalesce(1)
    built = index.build(docs)
    (segment,) = built.segments
    stored = spark.read.parquet(f"{built.path}/segments/{segment['name']}/postings")
    assert stored.count() == 9 and stored.selectExpr("sum(size(ids))").first()[0] == 1200
    monkeypatch.setattr(index, "LISTS", 1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    try:
        small = index.build(docs)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert spark.read.parquet(f"{small.path}/segments/{small.segments[0]['name']}/postings").count() > 100
    for words in (["common"], ["w3", "天"]):
        assert found(spark, small, words) == found(spark, built, words) != []


def test_rows_of_one_id_and_ids_that_are_texts(spark, tmp_path):
    docs = spark.createDataFrame([("a", "ab cd"), ("a", "ab ef ef"), ("b", None), ("b", "kl"), ("c", None), ("c", None), (None, "mn"), ("d", "")], "id string, text string")
    built = index.append(index.at(spark, str(tmp_path / "t")), docs)
    assert (built.n, built.avgdl) == (4, 4 / 3)
    assert {tuple(r) for r in built.postings(spark, WORDS).select("id", "dl", "term", "tf").collect()} == {("a", 3, "ab", 1), ("a", 3, "ef", 2), ("b", 1, "kl", 1)}
    less = index.merge(spark, index.delete(built, docs.where("id = 'a'").select("id")))
    assert (less.n, [r["id"] for r in less.postings(spark, WORDS).collect()]) == (3, ["b"])
    assert [r["id"] for r in less.documents(spark).where("dl is null").collect()] == ["c"]


def test_an_unfinished_change_is_not_seen(spark, tmp_path):
    path = str(tmp_path / "index")
    built = index.append(index.at(spark, path), texts(spark, 1, range(9)))
    index.append(built, texts(spark, 2, range(20, 25)))
    os.remove(tmp_path / "index" / "versions" / "2" / "_SUCCESS")
    assert index.at(spark, path) == built


def test_indexes_of_other_tables_are_others(spark, tmp_path):
    rows = spark.createDataFrame([(1, "ab"), (2, "ab cd")], "id long, text string")
    rows.write.parquet(str(tmp_path / "t"))
    t = spark.read.parquet(str(tmp_path / "t"))
    ids = lambda df, w: {r["id"] for r in index.text_match(spark, index.of(df), [w]).collect()}
    assert ids(t, "ab") == {1, 2} and ids(t.where("id = 1"), "ab") == {1}
    assert index.of(t) is index.of(spark.read.parquet(str(tmp_path / "t")))
    assert ids(rows, "ab") == {1, 2} and ids(spark.createDataFrame([(7, "ab")], "id long, text string"), "ab") == {7}
    assert source_key(rows) is None
    spark.createDataFrame([(3, "ab ab ab")], "id long, text string").coalesce(1).write.mode("overwrite").parquet(str(tmp_path / "t"))
    assert ids(spark.read.parquet(str(tmp_path / "t")), "ab") == {3}


def clustered(spark, seed=1, n=600):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, 8))
    rows = [(i, (centres[i % 12] * (1 + i % 3) + rng.normal(size=8) * 0.15).tolist(), i % 5) for i in range(n)]
    rows += [(n, None, 0), (n + 1, [0.0] * 8, 1), (n + 2, [1.0, 2.0], 2), (n + 3, [None] * 8, 3)] + [(n + 4 + i, rows[5][1], 4) for i in range(30)]
    return spark.createDataFrame(rows, "id long, vector array<float>, label int")


def test_cells_search_is_exact_and_reads_few(spark):
    v = clustered(spark)
    stored = cells.build(v, cells=24)
    assert stored.rows.sum() == 630 and spark.read.parquet(stored.path).where("cell = -1").count() == 4
    for i in (0, 5, 77, 601):
        q = v.where(f"id = {i}").first()["vector"]
        one = v.where(f"id = {i}").select("vector")
        for where in (None, "label = 2"):
            want = retrieval.dense_topk((v.where(where) if where else v).select("id", "vector"), one, 20).collect()
            got = cells.search(spark, stored, list(q), 20, where=where)
            assert [tuple(r) for r in got.collect()] == [tuple(r) for r in want]
    plan = cells.search(spark, stored, list(v.where("id = 0").first()["vector"]), 10)._jdf.queryExecution().executedPlan().toString()
    read = plan.split("cell#")[1:]
    assert "PartitionFilters" in plan and read
    q = v.where("id % 20 = 0 and id < 600").select(F.col("id").alias("query"), "vector")
    probes = cells.probes_for(stored, v.select("id", "vector"), q, 10)
    assert probes < 12
    found = cells.search_each(stored, q, 10, probes)
    row = cells.recall(found, retrieval.dense_topk_each(v.select("id", "vector"), q, 10)).first()
    assert row["queries"] == 30 and row["recall"] >= 0.9
    assert cells.cells_read(stored, list(v.where("id = 0").first()["vector"]), 0.5) < 24


def test_cells_of_nothing(spark):
    v = clustered(spark).where("vector is null")
    assert cells.search(spark, cells.build(v), [1.0, 2.0], 3).count() == 1  # a row without a score
    assert cells.search(spark, cells.build(v.limit(0)), [1.0], 3).count() == 0


def test_adjacency_gives_the_evidence_of_the_edges(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(rng.randrange(30), rng.choice("xy"), rng.randrange(30), [rng.randrange(90) for _ in range(rng.randrange(3))], rng.choice([None, None, "Agent_Memory"])) for _ in range(150)]
    rows += [(1, "x", i, [i], None) for i in range(40, 70)] + [(None, "x", 1, [5], None)]
    edges = spark.createDataFrame(rows, "src long, relation string, dst long, source_chunk_ids array<long>, created_by string").dropDuplicates(["src", "relation", "dst"]).where("src is null or src <> dst").cache()
    seeds = spark.createDataFrame([(1, 0.9), (2, 0.5), (77, 0.1)], "id long, score double")
    monkeypatch.setattr(adjacency, "FOLDER", 20)
    want = [tuple(r) for r in graph.evidence(edges.where("src is not null"), seeds, 40).collect()]
    stored = adjacency.build(edges)
    assert stored.buckets > 5
    assert [tuple(r) for r in adjacency.evidence(stored, seeds, 40).collect()] == want
    plan = stored.around(spark, seeds.select(F.col("id").alias("u")))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "Join" not in plan
    monkeypatch.setattr(adjacency, "NAMED", 1)
    assert [tuple(r) for r in adjacency.evidence(stored, seeds, 40).collect()] == want


def files(path):
    return {os.path.join(d, f): os.path.getmtime(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet") and "/data/" in d}


def test_keyed_tables_rewrite_what_they_touch(spark, tmp_path):
    path = str(tmp_path / "t")
    t = keyed.table(spark, path, ["id"], "id long, name string, tags array<string>", buckets=8)
    rows = lambda ids, name: spark.createDataFrame([(i, name, ["a"]) for i in ids], "id long, name string, tags array<string>")
    assert t.upsert(rows(range(50), "old"), writer="w", batch=0)
    before = files(path)
    assert t.upsert(rows([3], "new"), writer="w", batch=1)
    after = files(path)
    assert all(after[f] == m for f, m in before.items())  # nothing that was there is touched
    assert 0 < len({f.split("bucket=")[1][0] for f in after if f not in before}) == 1
    assert not t.upsert(rows([3], "again"), writer="w", batch=1)  # a batch is taken once
    assert files(path) == after
    again = keyed.table(spark, path)
    assert again == t and {r["id"]: r["name"] for r in again.read(spark).collect()} == {i: "new" if i == 3 else "old" for i in range(50)}
    with pytest.raises(ValueError, match="stored table"):
        keyed.table(spark, path, ["name"])
    assert t.delete(spark.createDataFrame([(3,), (99,)], "id long")) == 1
    assert t.delete(spark.createDataFrame([("old",)], "name string").where("name = 'none'")) == 0
    grown = t.upsert(rows([7, 8], "x"), lambda both: both.groupBy("id").agg(F.concat_ws("+", F.array_sort(F.collect_list("name"))).alias("name"), F.first("tags").alias("tags")))
    assert grown and {r["name"] for r in t.read(spark).where("id in (7, 8)").collect()} == {"old+x"}
    t.vacuum(spark)
    assert t.read(spark).count() == 49 and t.delete(spark.createDataFrame([("old",)], "name string")) == 47
    t.clear(spark)
    assert t.read(spark).count() == 0


def test_a_failed_upsert_changes_nothing(spark, tmp_path):
    t = keyed.table(spark, str(tmp_path / "t"), ["id"], "id long, v string", buckets=4)
    t.upsert(spark.createDataFrame([(i, "old") for i in range(9)], "id long, v string"))
    bad = spark.createDataFrame([(1, "new")], "id long, v string")
    with pytest.raises(Exception, match="no"):
        t.upsert(bad, lambda both: both.where(F.when(F.col("id") >= 0, F.raise_error(F.lit("no")).cast("boolean"))).drop("__new"))
    assert {r["v"] for r in t.read(spark).collect()} == {"old"} and t.read(spark).count() == 9
    t.upsert(bad)
    assert t.read(spark).where("v = 'new'").count() == 1


@pytest.mark.parametrize("within", [None, "g"])
def test_running_totals(spark, within):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", None]), i, rng.choice([None, 1, 5])) for i in rng.sample(range(500), 200)]
    df = spark.createDataFrame(rows, "g string, i long, n long").repartition(3)
    out = numbering.running_totals(df, F.col("n"), "i", within=within)
    got = {(r["g"], r["i"]): r["before"] for r in out.collect()}
    want, sums = {}, {}
    for g, i, n in sorted(rows, key=lambda r: r[1]):
        key = g if within else 0
        want[(g, i)] = sums.get(key, 0)
        sums[key] = want[(g, i)] + (n or 0)
    assert got == want
    assert "SinglePartition" not in out._jdf.queryExecution().executedPlan().toString()
    assert sorted(r["number"] for r in numbering.numbered(df, "i").collect()) == list(range(200))
    assert numbering.numbered(df.limit(0), "i", within=within).count() == 0


def quality(k, a, b, w, label, g):
    inside = w[label[a] == label[b]].sum()
    return inside - g * (np.bincount(label, weights=k) ** 2).sum()


def planted(seed, n=160, size=20, inside=0.5, outside=0.02):
    rng = np.random.default_rng(seed)
    c = np.arange(n) // size
    a, b = np.nonzero(np.triu(rng.random((n, n)) < np.where(c[:, None] == c[None], inside, outside), 1))
    return c, np.concatenate([a, b]), np.concatenate([b, a])


def parts_of(a, b, label):
    return len(np.unique(leiden._split(a, b, label)))


def test_leiden_finds_planted_communities_and_never_worse():
    for seed in range(3):
        c, a, b = planted(seed)
        w = np.ones(len(a))
        k = np.bincount(a, weights=w, minlength=len(c))
        g = 1 / k.sum()
        label = leiden.solve(k, a, b, w, g)
        assert quality(k, a, b, w, label, g) >= quality(k, a, b, w, c, g) - 1e-6
        assert parts_of(a, b, label) == len(np.unique(label))  # connected
        again = label.tolist()
        assert leiden.local_moves(*leiden._csr(len(k), a, b, w), k.tolist(), g, again, leiden.deque(range(len(k)))) == 0  # none moves any more


def test_most_moves_of_a_group_are_made_in_batches(monkeypatch):
    rng = np.random.default_rng(2)
    n = 3000
    a, b = rng.integers(0, n, 40_000), rng.integers(0, n, 40_000)
    a, b = a[a != b], b[a != b]
    a, b, w = np.concatenate([a, b]), np.concatenate([b, a]), np.ones(2 * len(a))
    k = np.bincount(a, weights=w, minlength=n)
    g, moves, found = 1 / k.sum(), [], {}
    one_by_one = leiden.local_moves

    def counted(*args):
        moves.append(one_by_one(*args))
        return moves[-1]

    monkeypatch.setattr(leiden, "local_moves", counted)
    for few in (1 << 40, 1 << 13):
        monkeypatch.setattr(leiden, "FEW", few, raising=False)
        moves.clear()
        label = leiden.solve(k, a, b, w, g)
        found[few] = sum(moves), quality(k, a, b, w, label, g)
        assert parts_of(a, b, label) == len(np.unique(label))
    assert found[1 << 13][0] < found[1 << 40][0] / 4
    assert found[1 << 13][1] > 0.97 * found[1 << 40][1]


def test_refinement_keeps_parts_connected():
    c, a, b = planted(4)
    w = np.ones(len(a))
    k = np.bincount(a, weights=w, minlength=len(c))
    # a community that falls apart: two cliques without an edge between them
    label = np.where(np.isin(c, [0, 5]), 0, c + 1)
    keep = ~((np.isin(c[a], [0, 5])) & (np.isin(c[b], [0, 5])) & (c[a] != c[b]))
    a, b, w = a[keep], b[keep], w[keep]
    part = np.array(leiden.refine(*leiden._csr(len(k), a, b, w), k.tolist(), 1 / k.sum(), label.tolist(), random.Random(1)))
    assert parts_of(a, b, part) == len(np.unique(part))
    assert all(len(set(label[part == p])) == 1 for p in np.unique(part))


@pytest.mark.parametrize("group, hub", [(1 << 18, 1 << 16), (300, 15)])
def test_partition_by_groups_and_by_all_tasks(spark, monkeypatch, group, hub):
    monkeypatch.setattr(leiden, "GROUP", group)
    monkeypatch.setattr(leiden, "BLOCK", 200)
    monkeypatch.setattr(leiden, "HUB", hub)
    c, a, b = planted(1, 120, 20, 0.6, 0.01)
    once = a < b
    edges = spark.createDataFrame([(f"n{x}", f"n{y}", 1) for x, y in zip(a[once].tolist(), b[once].tolist())], "a string, b string, weight long")
    nodes = spark.createDataFrame([(f"n{i}",) for i in range(121)], "node string")
    got = {r["node"]: r["community"] for r in graph.partition(edges, nodes, 30, 0.2, 3.0).collect()}
    assert len(got) == 121 and got["n120"] == "n120"
    label = np.unique([got[f"n{i}"] for i in range(120)], return_inverse=True)[1]
    w, k = np.ones(len(a)), np.bincount(a, minlength=120).astype(float)
    assert parts_of(a, b, label) == len(np.unique(label)) and max(np.bincount(label)) <= 30
    g = 1 / k.sum()
    assert quality(k, a, b, w, label, g) >= 0.9 * quality(k, a, b, w, c, g)


def test_deep_merge(spark):
    cases = [
        ('{"a":{"b":{"c":1,"d":2}},"x":[1]}', '{"a":{"b":{"c":9}},"x":[2],"y":null}', '{"a":{"b":{"c":9,"d":2}},"x":[2],"y":null}'),
        ('{"a":{"b":1}}', '{"a":3}', '{"a":3}'), ('{"a":3}', '{"a":{"b":1}}', '{"a":{"b":1}}'), (None, '{"a":1}', '{"a":1}'), ('{"a":1}', "broken{", '{"a":1}'), (None, None, None), ("[1]", "[2,3]", "[2,3]"),
    ]
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(cases)], "i int, a string, b string")
    got = {r["i"]: r["m"] for r in df.select("i", variants.deep_merge(F.col("a"), F.col("b")).alias("m")).collect()}
    assert [got[i] for i in range(len(cases))] == [c[2] for c in cases]


def test_summaries_are_stored_and_searched_below_the_gate(spark, tmp_path):
    rows = [(f"C_{level}_{i}", level, f"topic{i} word" if i else " ") for level in range(5) for i in range(4)]
    made = spark.createDataFrame(rows, "community_id string, level int, summary string")
    stored = search.stored_summaries(spark, made, str(tmp_path / "s"))
    assert {(r["level"], r["community_id"][-1]) for r in stored.read(spark).collect()} == {(lv, i) for lv in (0, 1) for i in "123"}
    best = search.summaries(spark, stored, "topic2", 3).orderBy("pos").collect()
    assert [r["community_id"] for r in best][:2] == ["C_0_2", "C_1_2"] and best[0]["score"] > best[2]["score"]
    search.stored_summaries(spark, made.where("community_id <> 'C_0_2'"), str(tmp_path / "s"))
    assert stored.read(spark).where("community_id = 'C_0_2'").count() == 0
    assert search.delete_levels(spark, stored, [1]) == 3 and stored.read(spark).count() == 2


def test_memories_are_those_of_one_user(spark):
    vector = lambda t: search.question_vector(spark, t).first()["vector"]
    rows = [("u", 1, "red apple", vector("red apple")), ("u", 2, "blue sky", vector("blue sky")), ("v", 3, "red apple", vector("red apple")), ("u", None, "red", vector("red")), ("u", 4, "red wine", None)]
    turns = spark.createDataFrame(rows, "user string, id long, summary string, vector array<float>")
    assert [r["id"] for r in search.memories(spark, turns, "u", "red apple", 2).orderBy("pos").collect()] == [1, 4]
    assert search.memories(spark, turns, "nobody", "red").count() == 0 and math.isfinite(1)


def test_triples_are_merged_into_their_buckets(spark, tmp_path):
    t = store.edge_table(spark, str(tmp_path / "g"), 8)
    triples = lambda rows: spark.createDataFrame(rows, "src string, relation string, dst string, description string, chunk string, seq int")
    assert store.upsert_triples(t, triples([("a", "r", "b", "old", "c1", 1), ("a", "r", "b", "mid", "c2", 2), ("x", "r", "y", "x", "c1", 3)]), "w", 0)
    assert store.upsert_triples(t, triples([("a", "r", "b", "new", "c2", 1), ("a", "r", "b", "newer", "c3", 2)]), "w", 1)
    assert not store.upsert_triples(t, triples([("a", "r", "b", "again", "c9", 1)]), "w", 1)
    got = {(r["src"], r["dst"]): (r["description"], r["source_chunk_ids"]) for r in t.read(spark).collect()}
    assert got == {("a", "b"): ("newer", ["c1", "c2", "c3"]), ("x", "y"): ("x", ["c1"])}


def test_replace_keeps_the_old_rows_until_the_new_are_there(spark, tmp_path):
    path = str(tmp_path / "r")
    store.replace(spark.createDataFrame([(1,)], "x int"), path)
    bad = spark.read.parquet(path).select(F.raise_error(F.lit("no")).cast("int").alias("x"))
    with pytest.raises(Exception, match="no"):
        store.replace(bad, path)
    assert [r["x"] for r in spark.read.parquet(path).collect()] == [1]
    store.replace(spark.read.parquet(path).select((F.col("x") + 1).alias("x")), path)
    assert [r["x"] for r in spark.read.parquet(path).collect()] == [2]


def test_databases_and_recreated_tables(spark, tmp_path):
    assert store.create_database(spark, "quill_test") and not store.create_database(spark, "quill_test")
    spark.sql("DROP DATABASE quill_test")
    path, schema = str(tmp_path / "t"), "id long, v string"
    t = store.recreate(spark, path, ["id"], schema, 4)
    t.upsert(spark.createDataFrame([(1, "a")], schema))
    assert t.read(spark).count() == 1
    again = store.recreate(spark, path, ["v"], schema, 2)
    assert again.read(spark).count() == 0 and again.keys == ("v",)


def test_fusion_and_reranking_of_each_query_are_those_of_one(spark):
    lists = {q: [[(i, r) for r, i in enumerate(random.Random(10 * q + n).sample(range(12), 6))] for n in (0, 1)] for q in (1, 2)}
    docs = spark.createDataFrame([(i, " ".join(random.Random(i).choices(WORDS, k=5)) if i else None) for i in range(12)], "id long, text string")
    both = [spark.createDataFrame([(q, i, r) for q in lists for i, r in lists[q][n]] + [(1, None, 9)], "query long, id long, rank int") for n in (0, 1)]
    asked = spark.createDataFrame([(1, ["ab", "CD", "ab"]), (2, ["kl"])], "query long, words array<string>")
    got = retrieval.local_each(docs, asked, [(both[0], 1.0), (both[1], 2.0)], 7, 0.3, 4).collect()
    for q, words in ((1, ["ab", "cd"]), (2, ["kl"])):
        one = retrieval.fuse([(df.where(f"query = {q}"), w) for df, w in zip(both, (1.0, 2.0))]).withColumn("rrf", F.round("rrf", 6))
        first = retrieval.ranked(one, 7, F.desc("rrf"), F.asc("first_list"), F.asc("first_rank")).select("id", "rank")
        best = retrieval.rerank(docs.join(first, "id").withColumn("text", F.coalesce("text", F.lit(""))), retrieval.overlap_score(F.col("text"), words), 0.3, 4)
        want = [(r["id"], r["score"]) for r in best.orderBy(F.desc("score"), "rank").collect()]
        assert [(r["id"], r["score"]) for r in sorted(got, key=lambda r: r["pos"]) if r["query"] == q] == want
