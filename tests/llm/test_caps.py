"""No cap or rounding changes a result: small shares, hard targets, tight packings."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from quillspark.llm import best_fit_packing, language_id, source_mixing
from quillspark.llm._linear import softmax
from quillspark.llm._shared import share_limit


def test_no_language_is_lost_at_any_size(spark):
    for n in (10, 10**6, 10**9, 10**13):
        assert share_limit(1, n) > 0 and abs(share_limit(500, max(n, 500)) / 2**63 - min(1, 500 / max(n, 500))) < 1e-9
    rows = spark.range(3_000_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("ab "), F.col("id").cast("string")).alias("text"), F.lit("en").alias("lang"))
    rows = rows.unionByName(spark.createDataFrame([(5_000_000, "cd", "fr")], "doc_id long, text string, lang string"))
    drawn = [r["lang"] for r in language_id.sample(rows, 6).select("lang").collect()]
    assert "fr" in drawn and 0 < drawn.count("en") < 20  # one in a million is wanted


def test_mixing_reaches_attainable_targets_and_reports_others(spark):
    rng = np.random.default_rng(0)
    p = rng.dirichlet([0.5] * 3, 300)
    tokens = rng.integers(5, 500, 300)
    rows = spark.createDataFrame([(int(t), [float(x) for x in q]) for t, q in zip(tokens, p)], "tokens long, posterior array<double>")
    for targets, budget in (({"a": 0.6, "b": 0.3, "c": 0.1}, None), ({"a": 0.2, "b": 0.2, "c": 0.6}, 150_000.0)):
        s = source_mixing.solve(rows, ["a", "b", "c"], targets, budget)
        r = s.rates(p)
        total = (r * tokens) @ p
        assert (r >= 0).all() and s.distance <= 1e-3
        assert np.allclose(total, s.reached, rtol=1e-9) and np.abs(total / total.sum() - [targets[d] for d in "abc"]).max() <= 2e-3
    far = source_mixing.solve(spark.createDataFrame([(10, [0.5, 0.5]), (30, [0.4, 0.6])], "tokens long, posterior array<double>"), ["a", "b"], {"a": 0.9, "b": 0.1}, 40.0)
    # by hand: nothing but the first document is nearest to (36, 4) on rates that are not negative
    best = min((((0.5 * 10 * x + 0.4 * 30 * y - 36) ** 2 + (0.5 * 10 * x + 0.6 * 30 * y - 4) ** 2), x, y) for x in np.linspace(0, 8, 161) for y in np.linspace(0, 2, 41))
    assert far.distance > 0.1 and abs(np.square(far.reached - far.target).sum() - best[0]) < 0.02 * best[0]


def test_packing_meets_the_bound_on_triplets():
    for seed in range(2):
        rng, hist = random.Random(seed), {}
        for _ in range(20):
            a = b = 0
            while not 250 < 2048 - a - b < 1300:
                a, b = rng.randrange(300, 900), rng.randrange(300, 900)
            for x in (a, b, 2048 - a - b):
                hist[x] = hist.get(x, 0) + 1
        plan = best_fit_packing.plan_bins(hist)
        assert best_fit_packing.size(plan) == best_fit_packing.lower_bound(hist, 2048) == 20
        assert best_fit_packing.gap(plan) == 0
    left = best_fit_packing.plan_bins({x: 3 for x in range(301, 1500, 7)}, nodes=1)
    assert best_fit_packing.gap(left) >= 0


def test_language_features_by_hand():
    """n-grams of letters, everything else one space each, counted as the model sees them."""
    text = "Ab, é1"
    points = np.frombuffer(text.lower().encode("utf-32-le"), np.uint32)
    found = language_id.features(points, np.array([0, len(points)]))
    shown = "ab  é "
    for order, (h, first) in enumerate(found, 1):
        grams = [shown[i : i + order] for i in range(len(shown) - order + 1)]
        assert first.tolist() == [0, len(grams)]
        by_gram = {}
        for g, x in zip(grams, h.tolist()):
            assert by_gram.setdefault(g, x) == x
        assert len(set(by_gram.values())) == len(by_gram)


def test_language_posterior_and_frequencies_by_hand(spark):
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("aba", "x"), ("abc", "x"), ("ccc", "y"), (None, "y"), ("ba ba", None)])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    df = language_id.document_frequencies(docs)
    one = language_id.features(np.frombuffer("a".encode("utf-32-le"), np.uint32), np.array([0, 1]))[0][0][0]
    assert df[one] == 3  # documents with an a
    rng = np.random.default_rng(1)
    model = language_id.Model(["x", "y"], rng.normal(size=(1 << language_id.BITS, 2)).astype(np.float32), 0.7)
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.predict(docs, model).collect()}
    for i, text, _ in rows:
        if text is None:
            assert got[i] == ("und", 0.0)
            continue
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        grams = [h for hs, _ in language_id.features(points, np.array([0, len(points)])) for h in hs]
        p = softmax(np.mean([model.weights[h].astype(float) for h in grams], axis=0) / 0.7)
        assert got[i][0] == "xy"[int(p.argmax())] and math.isclose(got[i][1], p.max(), rel_tol=1e-5)
