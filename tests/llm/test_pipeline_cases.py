"""The pipeline over tables with nulls, repeated rows, very long texts, and over empty ones."""

import random

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, class int"
LABELS = "doc_id long, quality int, toxic int"


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choices("abcdefghijklmnop", k=rng.randrange(2, 9))) for _ in range(n))


def run(spark, folder, documents, labels):
    import corpus_pipeline

    for name, rows, schema in (("documents", documents, DOCUMENTS), ("labels", labels, LABELS)):
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return corpus_pipeline.run(spark, str(folder)).collect()


def test_nulls_repeated_rows_and_long_texts(spark, tmp_path):
    texts = {i: prose(i, 120) for i in range(1, 6)}
    rows = [(i, t, "en", "s", len(t), 1) for i, t in texts.items()]
    rows += [rows[0], rows[0]]  # repeated rows
    rows += [(9, texts[2] + " tail", "en", "s", 1, None), (2, prose(77, 90), "de", None, 1, 1)]  # a near copy, a doc_id twice
    rows += [(20, None, "en", "s", None, 1), (21, "", None, None, 0, 1), (22, "short one", "en", "s", 9, 1), (None, prose(88, 100), None, None, 1, 1)]
    rows += [(30, prose(99, 9000), "en", "s", 1, 1)]  # longer than a sequence
    got = run(spark, tmp_path, rows, [(1, 1, 0), (None, 0, 0), (3, None, 1)])
    pieces = {}
    for r in got:
        pieces.setdefault(r["doc_id"], []).append(r)
    assert set(pieces) == {1, 2, 3, 4, 5, 30, None}
    assert len(pieces[1]) == 1 and len(pieces[2]) == 2 and len(pieces[30]) > 5
    at = {}
    for r in got:
        at.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in at.values():
        ends = 0
        for offset, length in sorted(places):
            assert offset == ends
            ends += length
        assert ends <= 2048


def test_empty_tables(spark, tmp_path):
    assert run(spark, tmp_path, [], []) == []
