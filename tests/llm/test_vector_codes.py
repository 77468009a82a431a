"""Vector codes against a brute-force version: exact integers, ties, odd rows."""

import hashlib
import math
import random

import numpy as np
import pytest

from quillspark.llm import vector_codes


def brute(rows, parts=4, entries=256, rounds=4):
    """rows (vec_id, vector, label) -> ({(vec_id, ints): (code, error)}, books)."""
    kept = [(i, [math.floor(1024 * x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] if r[0] is not None else 0, r[1]))
    kept = [r for r in kept if len(r[1]) == len(kept[0][1])]
    ranges = vector_codes.bounds_of(len(kept[0][1]), parts)
    books = [[r[1][a:b] for r in kept[:entries]] for a, b in ranges]

    def near(book, x):
        return min((sum((s - t) ** 2 for s, t in zip(x, e)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p, (a, b) in enumerate(ranges):
            groups = {}
            for r in kept:
                groups.setdefault(near(books[p], r[1][a:b])[1], []).append(r[1][a:b])
            books[p] = [[sum(c) // len(c) for c in zip(*groups[k])] if k in groups else e for k, e in enumerate(books[p])]
    out = []
    for i, x, label in kept:
        found = [near(books[p], x[a:b]) for p, (a, b) in enumerate(ranges)]
        out.append((i, label, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found)))
    return out, books


def table(spark, rows):
    return spark.createDataFrame([(i, v, label, 7) for i, v, label in rows], "vec_id long, embedding array<float>, label int, n int").repartition(3)


def compare(spark, rows, entries=256):
    want, books = brute(rows, entries=entries)
    codes, found = vector_codes.compress(table(spark, rows), entries=entries)
    got = [tuple(r) for r in vector_codes.with_label_error(codes).collect()]
    by_label = {}
    for _, label, _, error in want:
        by_label[label] = by_label.get(label, 0) + error
    assert sorted(got, key=repr) == sorted(((i, label, c, e, by_label[label]) for i, label, c, e in want), key=repr)
    assert found.sha256() == hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()


@pytest.mark.parametrize("size, entries", [(8, 256), (16, 12), (7, 20)])
def test_equals_brute_force(spark, size, entries):
    rng = random.Random(size)
    rows = [(i * 3 % 101, [float(np.float32(rng.gauss(0, 0.4))) for _ in range(size)], rng.choice([None, 1, 2])) for i in range(90)]
    rows += [(500 + i, rows[7][1], 1) for i in range(30)]  # one common vector
    rows += [(600, None, 1), (601, [None] * size, 2), (602, [float("nan")] * size, None), (603, [float("inf")] * size, 1), (None, rows[3][1], None), (604, [0.5], 1), (0, rows[5][1], 2)]
    compare(spark, rows, entries)


def test_ties_and_large_components(spark):
    grid = [(i, [float(i % 3), 0.0, float(i % 2), 0.0], None) for i in range(40)]  # distances tie everywhere
    compare(spark, grid, 5)
    rng = random.Random(2)
    compare(spark, [(i, [float(np.float32(rng.gauss(0, 9000))) for _ in range(4)], 1) for i in range(30)], 6)


def test_empty_table_and_decoding(spark):
    codes, books = vector_codes.compress(table(spark, [(1, None, 1)]))
    assert vector_codes.with_label_error(codes).count() == 0
    codes, books = vector_codes.compress(table(spark, [(i, [i / 8, 0.25, -i / 8, 1.0], 1) for i in range(9)]))
    rows = codes.orderBy("vec_id").collect()
    assert [r["error"] for r in rows] == [0] * 9  # every vector is an entry
    assert books.decode([r["code"] for r in rows]).tolist() == [[128 * i, 256, -128 * i, 1024] for i in range(9)]


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(4)
    entries = rng.integers(-900, 900, (256, 16))
    x = entries[rng.integers(0, 256, 500)] + rng.integers(-60, 60, (500, 16))
    approximation = vector_codes.Approximation.of(entries)
    lower, upper = approximation.bounds(x.astype(float))
    exact = np.square(x[:, None] - entries[None]).sum(axis=2)
    assert (lower <= exact).all() and (exact <= upper).all()
    assert (lower <= upper.min(axis=1, keepdims=True)).mean() < 0.5
    index, error = approximation.nearest(x)
    assert (index == exact.argmin(axis=1)).all() and (error == exact.min(axis=1)).all()
