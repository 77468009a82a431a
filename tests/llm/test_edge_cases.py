"""Defined results in the cases that tables of real use hold: nulls, repeated rows, clashing names, cycles, hot keys."""

import hashlib
import random
import re
import struct
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quillspark.llm import best_fit_packing, chat_formatting, fingerprints, hilbert_sharding, jaccard_join, language_id, line_dedup, quality_rules, source_mixing, substring_dedup
from quillspark.llm._graph import components, local_forest
from quillspark.llm._shared import spread_join

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, k=5):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))) if w else frozenset()


def near_copies(seed, n):
    """Texts about the threshold: groups of near copies, a common passage, short sets."""
    rng = random.Random(seed)
    base = [[f"b{g}w{rng.randrange(400)}" for _ in range(rng.choice([8, 30, 120]))] for g in range(4)]
    passage = [f"p{i}" for i in range(40)]
    out = []
    for i in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.randrange(1 + len(w) // 12)):
            w[rng.randrange(len(w))] = f"n{rng.randrange(9)}"
        if rng.random() < 0.4:
            w = passage + w[: rng.randrange(len(w))]
        out.append(" ".join(w))
    return out


def class_of(texts):
    """The component of every text, by brute force."""
    sets = [shingles(t) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and find(i) != find(j) and 100 * len(a & b) >= 75 * len(a | b):
                root[find(i)] = find(j)
    return [find(i) for i in range(len(texts))]


@pytest.mark.parametrize("hot, block", [(2, 512), (4096, 3)])
def test_jaccard_join_deals_out_hot_signatures_and_blocks(spark, hot, block):
    texts = near_copies(5, 120)
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in enumerate(texts)], "doc_id long, text string, class int, set int").repartition(4)
    groups = defaultdict(list)
    for i, c in enumerate(class_of(texts)):
        groups[c].append(i)
    want = {i: (len(shingles(texts[i])), min(g)) for g in groups.values() for i in g}
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_join(docs, hot=hot, block=block).collect()}
    assert got == want


def test_allocations_find_every_pair_within_the_threshold():
    rng = np.random.default_rng(3)
    for _ in range(60):
        n = int(rng.integers(3, 200))
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64) * np.uint64(2))
        keep = rng.random(len(a)) > rng.random() * 0.2
        b = np.unique(np.concatenate([a[keep], rng.integers(0, 2**63, rng.integers(0, 1 + n // 8)).astype(np.uint64) * np.uint64(2)]))
        common = len(np.intersect1d(a, b))
        if not len(b) or not jaccard_join.linked(common, len(a), len(b)) or common == len(a) == len(b):
            continue
        h, first = np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)])
        costs = jaccard_join.Costs(rng.integers(0, 60, 1 << jaccard_join.CELL_BITS).astype(np.uint8), 1.0)
        every = np.full(2 << (jaccard_join.CELL_BITS - 3), 255, np.uint8)
        seen = defaultdict(lambda: defaultdict(set))
        for docs, sig, flag in jaccard_join.entries(h, first, costs, every):
            for d, s, f in zip(docs.tolist(), sig.tolist(), flag.tolist(), strict=True):
                seen[s][d].add(f)
        meets = [m for m in seen.values() if len(m) == 2]
        subset, deep = {0, 1, 2}, {4, 6}
        assert any((m[x] & {1, 2}) and (m[y] & subset) or (2 in m[x] and m[y] & deep) or (6 in m[x] and m[y] & subset) for m in meets for x, y in ((0, 1), (1, 0)))


def test_representatives_go_by_row(spark):
    long = " ".join(f"w{i}" for i in range(60))
    near = long + " end"
    rows = [(1, long), (1, "another text altogether"), (2, near), (None, near + " more"), (None, "alone"), (None, None), (3, None), (4, "twice the same"), (4, "twice the same"), (5, "another text altogether")]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, __id string, key int")
    out = jaccard_join.keep_representatives(docs)
    assert out.columns == docs.columns
    got = Counter((r["doc_id"], r["text"]) for r in out.collect())
    assert got == Counter([(1, long), (1, "another text altogether"), (None, "alone"), (None, None), (3, None), (4, "twice the same")])
    every = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_join(docs).collect()}
    assert (None, 58, 1) in every and (None, 1, None) in every and (None, 0, None) in every
    assert jaccard_join.keep_representatives(docs.limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(200)] + [(rng.randrange(1000, 1400), rng.randrange(1000, 1400)) for _ in range(150)] + [(5, 5)]
    root = {}
    for x, y in edges:
        root.setdefault(x, x), root.setdefault(y, y)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x, y in edges:
        x, y = find(x), find(y)
        root[max(x, y)] = min(x, y)
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long").repartition(7)).collect()}
    assert got == {x: find(x) for x in root if any(x in e and e[0] != e[1] for e in edges)}
    a, b = np.array([4, 9, 2]), np.array([9, 7, 3])
    assert dict(zip(*map(list, local_forest(a, b)), strict=True)) == {9: 4, 7: 4, 3: 2}


def test_factors_read_the_same_in_their_block(spark):
    rng = random.Random(2)
    passages = [[f"p{k}.{i}" for i in range(rng.randrange(30, 90))] for k in range(6)]
    texts = [" ".join(sum(([f"u{i}.{j}"] * rng.randrange(3) + rng.choice(passages)[rng.randrange(10) :] for j in range(4)), [])) for i in range(60)]
    texts += [texts[3], texts[3], None, "", "a b"]
    names = "doc_id long, text string, found int, n_words int, spans string, __key int, key int"
    docs = spark.createDataFrame([(i, t, 1, 2, "3", 4, 5) for i, t in enumerate(texts)], names).repartition(3)
    out = substring_dedup.substring_dedup(docs).withColumn("own", F.xxhash64("text")).collect()
    assert set(out[0].asDict()) == {"doc_id", "text", "found", "spans", "__key", "key", "own", "n_words", "n_removed", "factors", "deduped"}
    words = {r["own"]: WORD.findall(r["text"] or "") for r in out}
    count = 0
    for r in out:
        w, end = words[r["own"]], 0
        covered = set()
        for f in r["factors"]:
            assert f["length"] >= 35 and f["start"] >= end
            end = f["start"] + 1
            there = words[f["block"]][f["address"] : f["address"] + f["length"]]
            assert w[f["start"] : f["start"] + f["length"]] == there
            copies = sum(x["own"] == r["own"] for x in out)
            assert (f["block"], f["address"]) != (r["own"], f["start"]) or copies > 1
            covered |= set(range(f["start"], f["start"] + f["length"]))
            count += 1
        assert len(covered) == r["n_removed"]
    assert count > 100


def test_clashing_columns_of_line_dedup(spark):
    line = "a line of more than twenty characters"
    rows = [(i, f"{line}\nown {i}") for i in range(4)] + [(None, f"{line}\nnone"), (None, f"other\n{line}"), (None, f"other\n{line}")]
    docs = spark.createDataFrame([(i, t, "a", 1, 2, "b") for i, t in rows], "doc_id long, text string, __drop string, n_lines int, n_dropped int, __id string")
    out = line_dedup.line_dedup(docs)
    assert out.columns == ["doc_id", "text", "__drop", "__id", "n_lines", "n_dropped"]
    got = Counter((r["doc_id"], r["text"], r["__drop"], r["n_dropped"]) for r in out.collect())
    want = [(i, f"own {i}", "a", 1) for i in range(3)] + [(3, f"{line}\nown 3", "a", 0), (None, "none", "a", 1), (None, "other", "a", 1), (None, "other", "a", 1)]
    assert got == Counter(want)


def test_shards_of_repeated_rows_and_nulls(spark, tmp_path):
    rows = [(1, "x", None, "s", 7)] * 6 + [(None, None, "en", None, 7)] * 3 + [(2, "y", "en", "s", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, slot int")
    hilbert_sharding.write_shards(docs, str(tmp_path / "out"), 3)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert Counter((r["doc_id"], r["text"], r["lang"], r["source"]) for r in back.collect()) == Counter(r[:4] for r in rows)
    slots = sorted((r["shard"], r["slot"]) for r in back.collect())
    assert len(set(slots)) == 10


def test_cycles_and_repeated_nodes(spark):
    rows = [(1, 0, 2, "user", "a", 1.0), (1, 1, 0, "assistant", "b", 1.0), (1, 2, 1, "user", "c", 1.0), (1, 3, 2, "assistant", "d", 1.0)]
    rows += [(2, 0, 0, "user", "self", None), (3, 5, 4, "user", "x", 2.0), (3, 4, 5, "assistant", "y", 2.0)]
    rows += [(4, 0, None, "user", "q", 0.0), (4, 0, None, "user", "q", 0.0), (4, 1, 0, "assistant", "r", 0.0), (5, None, None, "user", "none", None)]
    messages = spark.createDataFrame(rows, "conv_id long, node long, parent long, role string, text string, score double").withColumn("c", F.lit("clash"))
    got = {r["conv_id"]: [t for _, t in chat_formatting.parse_turns(r["formatted"])] for r in chat_formatting.format_trees(messages).collect()}
    assert got == {1: ["a", "b", "c", "d"], 2: ["self"], 3: ["y", "x"], 4: ["q", "r"], 5: ["none"]}
    deep = spark.range(3000).select(F.lit(9).alias("conv_id"), F.col("id").alias("node"), F.when(F.col("id") > 0, F.col("id") - 1).alias("parent"), F.lit("user").alias("role"), F.col("id").cast("string").alias("text"), F.lit(0.5).alias("score"))
    turns = chat_formatting.parse_turns(chat_formatting.format_trees(deep).first()["formatted"])
    assert [t for _, t in turns] == [str(i) for i in range(3000)]


def sketch_by_hand(text):
    def signed(x):
        return x - (1 << 64) if x >> 63 else x

    w = [xxhash.xxh64_intdigest(x.encode(), 42) for x in WORD.findall(text)]
    h = set()
    for i in range(max(1, len(w) - 4) if w else 0):
        seed = 42
        for x in w[i : i + 5]:
            seed = xxhash.xxh64_intdigest(struct.pack("<Q", x), seed)
        h.add(signed(seed))
    low = {x for x in h if x < fingerprints._LIMIT}
    return low or ({min(h)} if h else set())


def test_fingerprint_columns_against_brute_force(spark, sf):
    rows = sorted(((r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{sf}/documents.parquet").collect()), reverse=True)

    def alike(a, b):
        return len(a & b) / len(a | b) if a | b else 1.0

    got = {r["doc_id"]: r for r in fingerprints.query(spark, sf).collect()}
    for k, (i, t) in enumerate(rows):
        following = rows[(k + 1) % len(rows)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + following[:half]
        own, new, nxt = sketch_by_hand(t), sketch_by_hand(edited), sketch_by_hand(following)
        assert got[i]["fingerprint"] == " ".join(map(str, sorted(own))) and got[i]["edited_fingerprint"] == " ".join(map(str, sorted(new)))
        assert got[i]["near_edited"] == pytest.approx(alike(own, new)) and got[i]["near_next"] == pytest.approx(alike(own, nxt))


def test_fingerprints_of_repeated_and_null_ids(spark):
    rows = [(7, f"text number {i} of many") for i in range(40)] + [(None, f"no id {i}") for i in range(20)] + [(8, "same"), (8, "same"), (1, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").na.fill("", ["text"])
    got = fingerprints.with_next(docs, "doc_id").collect()
    assert len(got) == len(rows)
    assert Counter(r["next_text"] for r in got) == Counter(t or "" for _, t in rows)
    assert fingerprints.with_next(docs.select(F.concat(F.lit("d"), "doc_id").alias("doc_id"), "text"), "doc_id").count() == len(rows)


def test_samples_hold_repeated_rows_once(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    hot = docs.where("lang is not null and doc_id % 5 <> 0").limit(1)
    many = docs.unionByName(hot.join(F.broadcast(spark.range(3000)), how="cross").select(docs.columns))
    drawn = language_id.sample(many.where(language_id.learnable()), 100_000).count()
    assert drawn <= docs.count()
    labelled = source_mixing.domain_labels(spark.read.parquet(f"{sf}/labels.parquet")).withColumn("copies", F.lit(1))
    mixed = source_mixing.mix_documents(many.withColumn("__u", F.lit("clash")), labelled)
    assert mixed.columns == [*docs.columns, "__u"]
    nulls = spark.createDataFrame([(1, None, "x", "s", 0), (None, "", None, None, None)], docs.schema)
    assert source_mixing.source_mixing(nulls, labelled).count() == 2


def test_quality_of_null_strata_and_clashing_columns(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    odd = docs.withColumn("lang", F.when(F.col("doc_id") % 2 == 0, F.col("lang"))).withColumn("kept", F.lit(1)).withColumn("severity", F.lit(2)).withColumn("__good", F.lit(3))
    kept = quality_rules.filter_documents(odd, labels, alpha=0.5, delta=0.5)
    assert kept.columns == odd.columns
    by_rule = quality_rules.quality_rules(odd, labels, alpha=0.5, delta=0.5)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(r["doc_id"] for r in by_rule.where("kept").collect())


@pytest.mark.parametrize("k, n, p", [(0, 10, 0.3), (3, 10, 0.3), (9, 10, 0.99), (10, 10, 0.5), (2, 500, 0.02), (40, 3000, 0.02), (0, 1, 0.5)])
def test_binomial_tail(k, n, p):
    from math import comb

    assert quality_rules._betainc_upper(k, n, p) == pytest.approx(sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)), rel=1e-9)
    assert quality_rules._betainc_upper(20_000, 1_000_000, 0.02) == pytest.approx(0.5, abs=0.01)


def test_plan_of_many_lengths_is_near_the_bound():
    rng = np.random.default_rng(0)
    hist = Counter(np.clip(rng.lognormal(5.5, 1, 50_000).astype(int), 1, 2048).tolist())
    plan = best_fit_packing.plan_bins(hist)
    assert Counter({x: n for x, n in hist.items()}) == sum((Counter({x: k * times}) for f, times in plan for x, k in f), Counter())
    assert all(sum(x * k for x, k in f) <= 2048 for f, _ in plan)
    assert 0 <= best_fit_packing.gap(plan) <= best_fit_packing.size(plan) // 1000


def test_fillings_come_best_first_and_whole():
    hist = {7: 2, 5: 1, 3: 3, 2: 1}
    got = list(best_fit_packing.fillings(hist, 12, 12))
    assert got[0] in {(7, 5), (5, 7)} and [12 - sum(f) for f in got] == sorted(12 - sum(f) for f in got)
    assert all(Counter(f)[x] <= n for f in got for x, n in hist.items())


def test_pipeline_against_its_parts_by_hand(spark, sf, tmp_path):
    """run() on a table with planted junk, shared lines and near copies."""
    import corpus_pipeline

    real = [r.asDict() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    line = "this very line stands in many of the documents of the table"
    rng = random.Random(9)
    body = [[f"w{rng.randrange(4000)}" for _ in range(120)] for _ in range(12)]
    planted = [{"doc_id": 10_000 + i, "text": " ".join(b) + f"\n{line}", "lang": "en", "source": "plant", "n_chars": 0} for i, b in enumerate(body)]
    planted += [{"doc_id": 20_000 + i, "text": " ".join([*b, f"end{i}"]), "lang": "en", "source": "plant", "n_chars": 0} for i, b in enumerate(body)]
    planted += [{"doc_id": 30_000, "text": "spam " * 200, "lang": "en", "source": "plant", "n_chars": 0}, {"doc_id": 30_001, "text": None, "lang": None, "source": None, "n_chars": None}]
    folder = str(tmp_path)
    schema = spark.read.parquet(f"{sf}/documents.parquet").schema
    spark.createDataFrame(real + planted, schema).write.parquet(f"{folder}/documents.parquet")
    spark.read.parquet(f"{sf}/labels.parquet").write.parquet(f"{folder}/labels.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")

    stats = {r["doc_id"]: r for r in quality_rules.quality_rules(docs, labels).collect()}
    kept = {r["doc_id"]: r["text"] for r in docs.collect() if stats[r["doc_id"]]["kept"]}
    assert not {30_000, 30_001} & set(kept) and set(range(10_000, 10_012)) <= set(kept)

    def key(x):
        return x.strip(" \t\n\x0b\x0c\r").translate(LOWER)

    holders = defaultdict(set)
    for i, t in kept.items():
        for x in t.split("\n"):
            if len(key(x)) >= 20:
                holders[key(x)].add(i)
    kept = {i: "\n".join(x for x in t.split("\n") if not (len(holders[key(x)]) >= 3 and i != max(holders[key(x)]))) for i, t in kept.items()}
    ids = sorted(kept)
    groups = defaultdict(list)
    for i, c in zip(ids, class_of([kept[i] for i in ids]), strict=True):
        groups[c].append(i)
    single = {min(g) for g in groups.values()}
    single |= {i for i in ids if not shingles(kept[i])}
    assert not set(range(20_000, 20_012)) & single
    after = spark.createDataFrame([r.asDict() | {"text": kept[r["doc_id"]], "n_chars": len(kept[r["doc_id"]])} for r in docs.collect() if r["doc_id"] in single], schema)
    mixed = Counter(r["doc_id"] for r in source_mixing.mix_documents(after, source_mixing.domain_labels(labels)).collect())
    assert set(range(10_000, 10_012)) & set(mixed)
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(best_fit_packing.tokenizer_path())
    want = Counter()
    for i, copies in mixed.items():
        n = len(tokenizer.encode(kept[i], add_special_tokens=False).ids) + 1
        head = n % 2048 or 2048
        for k in range(-(-n // 2048)):
            want[i, k, 0 if k == 0 else head + 2048 * (k - 1), head if k == 0 else 2048] += copies
    out = corpus_pipeline.run(spark, folder).collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"]) for r in out) == want
    places = defaultdict(list)
    for r in out:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for p in places.values():
        at = 0
        for o, n in sorted(p):
            assert o == at
            at += n
        assert at <= 2048


@pytest.mark.parametrize("share", [2, 8, 1 << 14])
def test_spread_join_equals_a_left_join(spark, tmp_path, share):
    rng = random.Random(share)
    keys = [1] * 150 + [None] * 40 + [rng.randrange(2, 60) for _ in range(200)]
    rows = spark.createDataFrame([(i, k) for i, k in enumerate(keys)], "id long, key long").repartition(5)
    counts = Counter(k for k in keys if k is not None and k % 3)
    spark.createDataFrame([(k, n, f"v{k}") for k, n in counts.items()], "key long, n long, value string").write.parquet(f"{tmp_path}/small")
    small = spark.read.parquet(f"{tmp_path}/small")
    got = sorted((r["id"], r["key"], r["value"]) for r in spread_join(rows, small, "key", share=share).select("id", "key", "found.value").collect())
    assert got == [(i, k, f"v{k}" if k in counts else None) for i, k in enumerate(keys)]
    assert spread_join(rows, small.limit(0), "key").where("found is null").count() == len(keys)
    dealt = spread_join(rows, small, "key", share=8)
    joined = [line for line in dealt._jdf.queryExecution().executedPlan().toString().splitlines() if "BroadcastHashJoin" in line]
    assert joined and spread_join(rows.limit(0), small, "key").count() == 0
