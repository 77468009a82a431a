"""Phrases against a brute-force count, with every path through the partitions."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from quillspark.llm import phrase_mining

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least, top, longest=5):
    n, f = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for m in range(1, longest + 1):
                f.update((lang, tuple(w[i : i + m])) for i in range(len(w) - m + 1))
    found = {k: v for k, v in f.items() if len(k[1]) > 1 and v >= least}
    inside = set()
    for (lang, w), v in found.items():
        for m in range(2, len(w)):
            for i in range(len(w) - m + 1):
                if v >= f[lang, w[i : i + m]]:
                    inside.add((lang, w[i : i + m]))
    out = {}
    for (lang, w), a in found.items():
        if (lang, w) not in inside:
            cuts = [(1000 * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w))]
            score, k = min(cuts)
            out.setdefault(lang, []).append((" ".join(w), a, f[lang, w[:k]], f[lang, w[k:]], n[lang], score))
    rows = []
    for lang, found in out.items():
        found.sort(key=lambda x: (-x[5], -x[1], x[0].encode()))
        rows += [(lang, i, *x) for i, x in enumerate(found[:top], 1)]
    return sorted(rows)


def texts(seed, n):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)] + ["É", "ab", "the", "The", "of"]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    passages = [[rng.choice(vocabulary) for _ in range(rng.randrange(2, 9))] for _ in range(12)]
    out = []
    for _ in range(n):
        words = []
        for _ in range(rng.randrange(0, 25)):
            words += rng.choice(passages) if rng.random() < 0.4 else rng.choices(vocabulary, weights, k=3)
        text = "".join(w + rng.choice([" ", " ", " ", "  ", "\t", ", ", ".", "\n", "\x0b", "\x0c", "\r\n"]) for w in words)
        out.append((text, rng.choice(["en", "en", "de", None])))
    return [*out, (None, "en"), ("", None), ("the " * 3000, "en"), ("x x x x. x x", "und"), *[(out[0][0], "en")] * 5]


@pytest.mark.parametrize("n_ranks, bucket, parcel", [(1 << 21, 1 << 20, 1 << 20), (9, 150, 300), (0, 1 << 20, 1)])
def test_equals_brute_force(spark, n_ranks, bucket, parcel):
    rows = texts(n_ranks + 1, 250)
    docs = spark.createDataFrame([(t, lang, 1, "q") for t, lang in rows], "text string, lang string, n int, gram string").repartition(5)
    got = phrase_mining.collocations(docs, least=12, top=40, n_ranks=n_ranks, bucket=bucket, parcel=parcel).collect()
    assert sorted(tuple(r) for r in got) == brute(rows, 12, 40)


def test_empty_and_without_candidates(spark):
    docs = spark.createDataFrame([("a b c", "en")], "text string, lang string")
    assert phrase_mining.collocations(docs.limit(0)).count() == 0
    assert phrase_mining.collocations(docs).count() == 0


def test_scores_are_exact_beyond_64_bits(spark):
    a, n, x, y = 3_000_000_000_001, 90_000_000_000_017, 4_000_000_000_003, 5_000_000_000_009
    h = [11, 22]
    gram = b"".join(int(v).to_bytes(8, "big") for v in h)
    grams = spark.createDataFrame([("en", bytearray(gram), a)], "lang string, gram binary, a long")
    words = spark.createDataFrame([(11, "en", bytearray(b"p"), x), (22, "en", bytearray(b"q"), y), (0, "en", None, n)], "hash long, lang string, word binary, n long")
    (row,) = phrase_mining.scored(grams, words).collect()
    assert (row["l"], row["r"], row["n"], row["score"]) == (x, y, n, 1000 * a * n // (x * y))


def test_each_phrase_is_counted_by_its_pivot_once():
    """A fragment's words before the pivot are more frequent, those after not rarer."""
    known = phrase_mining.Dictionary(np.arange(100, 110, dtype=np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), 4)
    keys = known.keys(np.array([100, 104, 999, 109], np.uint64))
    assert keys.tolist() == [0, 4, (1 << 64) - 1, 9]
