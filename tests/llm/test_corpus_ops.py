"""Brute-force versions of the operators that compare documents, and of the learned ones."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from quillspark.llm import best_fit_packing, jaccard_join, language_id, source_mixing, substring_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def rows(spark, sf):
    rng = random.Random(7)
    real = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    base = [f"v{rng.randrange(300)}" for _ in range(160)]
    out = real + [(1000, None), (1001, ""), (1002, " \n"), (1003, "a b c"), (1004, "a B c"), (1005, "x " * 5000), (1006, real[0][1]), (1006, real[0][1])]
    for i in range(60):  # a group of near copies about the threshold, and short sets
        w = list(base)
        for _ in range(rng.randrange(12)):
            w[rng.randrange(len(w))] = f"n{rng.randrange(50)}"
        out.append((2000 + i, " ".join(w)))
        out.append((3000 + i, " ".join(f"s{rng.randrange(2)}" for _ in range(rng.randrange(1, 12)))))
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, key string").repartition(3)


def test_jaccard_join(docs, rows):
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_join(docs).collect())
    sets = {}
    for i, t in rows:
        w = WORD.findall((t or "").translate(LOWER))
        sets[i] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    assert got == Counter((i, len(sets[i]), find(i)) for i, _ in rows)
    kept = [r["doc_id"] for r in jaccard_join.keep_representatives(docs).collect()]
    assert sorted(kept) == sorted(i for i in ids if find(i) == i)
    assert jaccard_join.jaccard_join(docs.limit(0)).count() == 0


def test_parity_never_exceeds_the_difference():
    rng = np.random.default_rng(1)
    for _ in range(200):
        x = rng.integers(0, 2**63, rng.integers(1, 60)).astype(np.uint64)
        y = np.concatenate([x[: len(x) // 2], rng.integers(0, 2**63, rng.integers(1, 200)).astype(np.uint64)])
        a, b = (np.frombuffer(jaccard_join.parity(v), np.uint8) for v in (x, y))
        size = min(len(a), len(b))
        assert np.bitwise_count(jaccard_join.fold(a, size) ^ jaccard_join.fold(b, size)).sum() <= len(set(x.tolist()) ^ set(y.tolist()))


def test_substring_dedup(docs, rows):
    out = substring_dedup.substring_dedup(docs)
    assert out.columns[:3] == docs.columns
    got = Counter((r["doc_id"], r["n_words"], r["n_removed"], r["deduped"]) for r in out.collect())
    words = [(i, WORD.findall(t or "")) for i, t in rows]
    starts = Counter(tuple(w[j : j + 35]) for _, w in words for j in range(len(w) - 34))
    want = Counter()
    for i, w in words:
        gone = {k for j in range(len(w) - 34) if starts[tuple(w[j : j + 35])] > 1 for k in range(j, j + 35)}
        want[i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)] += 1
    assert got == want
    assert substring_dedup.substring_dedup(docs.limit(0)).count() == 0


def test_packing_round_trip(spark, docs, rows):
    from tokenizers import Tokenizer

    path = best_fit_packing.tokenizer_path()
    tokenizer = Tokenizer.from_file(path)
    packed = best_fit_packing.pack_documents(docs, path, 256, with_ids=True).collect()
    whole = defaultdict(list)
    bins = defaultdict(list)
    for r in packed:
        assert len(r["ids"]) == r["length"] and zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"]
        whole[r["doc_id"]].append((r["start"], r["ids"]))
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, t in rows:
        if i != 1006:
            parts = sorted(whole[i])
            assert sum((p for _, p in parts), []) == [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
            assert all(len(p) == 256 for _, p in parts[1:])
    for places in bins.values():
        at = 0
        for o, n in sorted(places):
            assert o == at
            at += n
        assert at <= 256
    hist = Counter(r["length"] for r in packed)
    assert len(bins) <= 1.01 * best_fit_packing.lower_bound(hist, 256)
    assert best_fit_packing.pack_documents(docs.limit(0)).count() == 0


def test_plan_is_optimal_on_small_instances():
    def best(items, cap):
        least = [len(items)]

        def go(i, room):
            if len(room) >= least[0]:
                return
            if i == len(items):
                least[0] = len(room)
                return
            for k in range(len(room)):
                if room[k] >= items[i] and room[k] not in room[:k]:
                    go(i + 1, [*room[:k], room[k] - items[i], *room[k + 1 :]])
            go(i + 1, [*room, cap - items[i]])

        go(0, [])
        return least[0]

    for seed in range(80):
        rng = random.Random(seed)
        items = sorted((rng.randint(1, 30) for _ in range(rng.randint(1, 10))), reverse=True)
        plan = best_fit_packing.plan_bins(Counter(items), 30, nodes=3000)
        assert Counter(x for f, n in plan for x, k in f for _ in range(k * n)) == Counter(items)
        assert best_fit_packing.size(plan) == best(items, 30)


def test_language_id(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r["doc_id"]: r for r in language_id.query(spark, sf).collect()}
    held = [(r["doc_id"], r["lang"]) for r in docs.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert all(got[i]["held_out"] for i, _ in held) and sum(r["held_out"] for r in got.values()) == len(held)
    assert sum(got[i]["lang_pred"] == lang for i, lang in held) >= 0.9 * len(held)
    odd = spark.createDataFrame([(1, None, "en"), (2, "12 !", None), (None, "the and of", "en")], "doc_id long, text string, lang string")
    model = language_id.fit(docs)
    assert [(r["lang_pred"], r["score"]) for r in language_id.predict(odd, model).orderBy("doc_id").collect()][1:] == [("und", 0.0)] * 2
    assert {r["lang_pred"] for r in language_id.predict(odd, language_id.fit(docs.limit(0))).collect()} == {"und"}


def test_source_mixing(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    labelled = source_mixing.domain_labels(labels)
    out = source_mixing.source_mixing(docs, labelled).toPandas()
    p, r = np.stack(out["posterior"]), out["rate"].to_numpy()
    assert len(out) == docs.count() and np.allclose(p.sum(axis=1), 1) and (r >= 0).all()
    have = (out["tokens"].to_numpy() * r) @ p
    model = source_mixing.fit(docs, labelled)
    want = np.array([source_mixing.TARGETS.get(d, 0.0) for d in model.domains])
    assert np.abs(have / have.sum() - want / want.sum()).max() < 0.02
    mixed = source_mixing.mix_documents(docs, labelled)
    assert mixed.columns == docs.columns and mixed.count() == out["copies"].sum()
    assert source_mixing.mix_documents(docs, labelled.limit(0)).count() == docs.count()
    assert source_mixing.source_mixing(docs.limit(0), labelled).count() == 0


@pytest.mark.parametrize("toxic, low", [(10, 40), (5, 40), (40, 10), (40, 5), (5, 5), (0, 100)])
def test_scarce_unwanted_domains_cost_no_clean_document(spark, toxic, low):
    domains, n = ["clean", "low_quality", "toxic"], [1000 - toxic - low, low, toxic]
    hot = [[float(i == k) for i in range(3)] for k in range(3)]
    rows = spark.createDataFrame([(7, hot[k]) for k in range(3) for _ in range(n[k])], "tokens long, posterior array<double>")
    solution = source_mixing.solve(rows, domains, source_mixing.TARGETS)
    clean, *rest = solution.rates(np.array(hot))
    assert clean > 0.98
    for rate, have in zip(rest, n[1:], strict=True):  # all of a scarce domain, no more than the ceiling of a large one
        most = n[0] * 0.02 / 0.96
        assert abs(rate * have - min(have, most)) < 0.1 * most


def test_pipeline(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, sf)
        assert after.columns == docs.columns
        docs = spark.createDataFrame(after.toPandas(), docs.schema)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
