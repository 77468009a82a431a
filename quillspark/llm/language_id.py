"""Language identification.

Sparse multinomial logistic regression on TF-IDF of hashed character n-grams (orders 1
to 3 of lower-cased letters, everything else as one space), trained with FTRL-proximal
under elastic-net penalties and calibrated by a temperature on rows held back from the
training sample.

Document frequencies cover every learnable document. The regression is fitted on a
bounded sample: about `train_docs` documents in all, an equal share for each language,
chosen by a hash of doc_id and text, repeated rows once. Prediction reads every whole text.

Defined results: a null text or one without a letter is `und` with score 0; rows without
a language or without doc_id are predicted but never learned from; without learnable
rows everything is `und`; repeated rows are predicted each; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm._linear import ftrl, softmax, temperature
from quillspark.llm._shared import drawn, schema_of, share_limit, table

BITS = 16
ORDERS = 3
BLOCK_CHARS = 1 << 18
UNKNOWN = "und"
_MULTIPLIERS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
_letters: np.ndarray | None = None


def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _letters


def blocks(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, code points, offsets) of small runs of rows."""
    texts = [(t or "").lower() for t in column.to_pylist()]
    a = 0
    while a < len(texts):
        b, size = a, 0
        while b < len(texts) and (b == a or size + len(texts[b]) <= BLOCK_CHARS):
            size += len(texts[b])
            b += 1
        points = np.frombuffer("".join(texts[a:b]).encode("utf-32-le"), np.uint32)
        yield a, b, points, np.concatenate([[0], np.cumsum([len(t) for t in texts[a:b]])])
        a = b


def features(points: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each order: the feature of every n-gram, and offsets by document."""
    is_letter = letters()[points]
    c = np.where(is_letter, points, np.uint32(32)).astype(np.uint64) + np.uint64(1)
    out, size = [], np.diff(offsets)
    for order in range(1, ORDERS + 1):
        n = max(0, len(c) - order + 1)
        h = np.full(n, order * 0xD6E8FEB86659FD93 % (1 << 64), np.uint64)
        for k in range(order):
            h += c[k : k + n] * _MULTIPLIERS[k]
            h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        inside = np.ones(n, bool)
        for k in range(1, order):  # n-grams that would run into the next document
            cut = offsets[1:] - k
            inside[cut[(cut >= 0) & (cut < n)]] = False
        counts = np.maximum(size - order + 1, 0)
        out.append(((h >> np.uint64(64 - BITS)).astype(np.int64)[inside], np.concatenate([[0], np.cumsum(counts)])))
    return out


def has_letter(points: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(letters()[points])])
    return total[offsets[1:]] > total[offsets[:-1]]


@dataclass
class Model:
    langs: list[str]
    weights: np.ndarray  # idf times weight, [feature, language]
    temperature: float

    def logits(self, points: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        out = np.zeros((len(offsets) - 1, len(self.langs)))
        grams = np.zeros(len(offsets) - 1)
        for h, first in features(points, offsets):
            filled = np.flatnonzero(np.diff(first))
            if len(filled):
                out[filled] += np.add.reduceat(self.weights[h], first[filled], axis=0)
            grams += np.diff(first)
        return out / np.maximum(grams, 1)[:, None]


def learnable() -> F.Column:
    remainder = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    return F.coalesce(remainder != 0, F.lit(False)) & F.col("lang").isNotNull() & F.col("text").isNotNull()


def document_frequencies(docs: DataFrame) -> np.ndarray:
    """Over every row of docs; the driver sees one count for each of 2**BITS features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, seen = np.zeros(1 << BITS, np.int64), np.zeros(1 << BITS, bool)
        for batch in batches:
            for _, _, points, offsets in blocks(batch.column(0)):
                grams = features(points, offsets)
                for d in range(len(offsets) - 1):
                    seen[:] = False
                    for h, first in grams:
                        seen[h[first[d] : first[d + 1]]] = True
                    df += seen
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(df[at])], names=["feature", "df"])

    rows = docs.select("text").mapInArrow(run, "feature long, df long").groupBy("feature").agg(F.sum("df").alias("df")).toArrow()
    out = np.zeros(1 << BITS)
    out[rows.column("feature").to_numpy()] = rows.column("df").to_numpy()
    return out


def sample(docs: DataFrame, train_docs: int) -> DataFrame:
    """(lang, features, counts): about train_docs rows, an equal share for each language."""
    sizes = {r["lang"]: r["n"] for r in docs.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    share = max(1, train_docs // max(1, len(sizes)))
    limit = F.lit(-1).cast("long")
    if sizes:
        limits = [x for lang, n in sizes.items() for x in (F.lit(lang), F.lit(share_limit(share, n)))]
        limit = F.try_element_at(F.create_map(*limits), F.col("lang"))
    rows = docs.select("lang", "text", F.xxhash64("doc_id", "text", F.lit(17)).alias("row"))
    chosen = rows.where(drawn(F.col("row"), limit)).groupBy("lang", "row").agg(F.min("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, n = [], []
            for _, _, points, offsets in blocks(batch.column(1)):
                grams = features(points, offsets)
                for d in range(len(offsets) - 1):
                    h, c = np.unique(np.concatenate([h[f[d] : f[d + 1]] for h, f in grams]), return_counts=True)
                    at.append(h.astype(np.uint16).tobytes())
                    n.append(c.astype(np.uint32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(at, pa.binary()), pa.array(n, pa.binary())], names=["lang", "at", "n"])

    return chosen.select("lang", "text").mapInArrow(run, "lang string, at binary, n binary")


def fit(docs: DataFrame, train_docs: int = 2000) -> Model:
    """A model of the learnable rows of docs."""
    rows = docs.select("doc_id", "text", "lang").where(learnable())
    df = document_frequencies(rows)
    chosen = sorted(zip(*(c.to_pylist() for c in sample(rows, train_docs).toArrow().columns), strict=True))
    langs = sorted({lang for lang, _, _ in chosen})
    if not langs:
        return Model([], np.zeros((1 << BITS, 0)), 1.0)
    idf = np.log((1 + df.max(initial=0)) / (1 + df)) + 1
    x, y = [], np.array([langs.index(lang) for lang, _, _ in chosen])
    for _, at, n in chosen:
        at, n = np.frombuffer(at, np.uint16).astype(np.int64), np.frombuffer(n, np.uint32)
        x.append((at, n / max(1, n.sum()) * idf[at] * SCALE))
    back = np.arange(len(x)) % 5 == 4
    w = ftrl([r for r, b in zip(x, back, strict=True) if not b], y[~back], 1 << BITS, len(langs))
    held = np.array([v @ w[at] for (at, v), b in zip(x, back, strict=True) if b]).reshape(-1, len(langs))
    return Model(langs, (w * idf[:, None] * SCALE).astype(np.float32), temperature(held, y[back]))


SCALE = 30.0


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score for every row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2**16 x languages weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        names = pa.array([*m.langs, UNKNOWN])
        for batch in batches:
            lang, score = np.full(batch.num_rows, len(m.langs)), np.zeros(batch.num_rows)
            for a, b, points, offsets in blocks(batch.column(1)) if m.langs else ():
                known = has_letter(points, offsets)
                p = softmax(m.logits(points, offsets) / m.temperature)
                lang[a:b] = np.where(known, p.argmax(axis=1), len(m.langs))
                score[a:b] = np.where(known, p.max(axis=1), 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), names.take(pa.array(lang)), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"{schema_of(docs, 'doc_id')}, lang_pred string, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = predict(docs, fit(docs))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return out.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
