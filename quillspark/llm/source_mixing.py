"""Mixing to target weights with soft domain membership.

A classifier (sparse multinomial logistic regression on hashed words, calibrated) is
fitted on a labelled table and gives every document a posterior over domains. Projected
gradient then finds nonnegative document rates r minimising the squared distance between
the expected domain totals sum_i r_i tokens_i p_i and the targets, from r = 1. Every
gradient is a combination of the posteriors with one coefficient for each domain, and each
step is taken in the metric of the documents whose rate is not zero (their Gram matrix, a
little of the identity added); so the state of the descent is one number for each domain,
a document's rate is max(0, 1 - p . state), and an iteration is one pass over a narrow table
that returns the totals and the Gram matrix. Nothing is shuffled and no text is read again.
The descent ends within the tolerance, or where no step comes nearer: then the targets can't
be met with these documents. How far off it ended is Solution.distance.

Unless a budget is given it is the largest total that needs no wanted domain more than
once, so rates stay near 1 or below; the targets of UNWANTED domains are ceilings beside
it, and one that holds less keeps what it has and costs the others nothing. A given
budget is met in the given shares. Rates become whole copies: the integer part, and one
more with the probability of the rest, decided by a hash of the row.

Defined results: a null or empty text has no tokens, the prior as posterior, and its
rate decides about it as about any other; a null or missing label teaches nothing;
without labels every rate is 1; labels for domains without a target get target 0;
repeated rows have equal rates and copies; an empty table gives an empty table; further
columns are kept by mix_documents().
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm._linear import ftrl, softmax, temperature
from quillspark.llm._shared import discard, drawn, schema_of, share_limit, staged, table, unused
from quillspark.llm._words import text_blocks, words_of

BITS = 18
#: Target share of expected tokens for each domain of the labels table.
TARGETS = {"clean": 0.96, "low_quality": 0.02, "toxic": 0.02}
#: Domains that bound no budget: as much of them as the target allows, not as it asks for.
UNWANTED = {"low_quality", "toxic"}


def present(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, row after the last, words, distinct features, offsets by row)."""
    for a, b, data, offsets in text_blocks(column):
        words = words_of(data, offsets, lower=True)
        key = np.unique((words.doc.astype(np.int64) << BITS) | (words.hashes >> np.uint64(64 - BITS)).astype(np.int64))
        yield a, b, words.counts, key & ((1 << BITS) - 1), np.searchsorted(key >> BITS, np.arange(b - a + 1))


def _scale(n: np.ndarray) -> np.ndarray:
    return 10 / np.sqrt(np.maximum(n, 1))


@dataclass
class Model:
    domains: list[str]
    weights: np.ndarray
    prior: np.ndarray
    temperature: float

    def posteriors(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(tokens, posterior by domain) of every row of a text column."""
        tokens, out = np.zeros(len(column), np.int64), np.tile(self.prior, (len(column), 1))
        for a, b, counts, at, first in present(column):
            tokens[a:b] = counts
            filled = np.flatnonzero(np.diff(first))
            if len(filled):
                z = np.add.reduceat(self.weights[at], first[filled], axis=0) * _scale(np.diff(first)[filled])[:, None]
                out[a + filled] = softmax(z / self.temperature)
        return tokens, out


def domain_labels(labels: DataFrame) -> DataFrame:
    """doc_id and domain of the labels table: toxic, else low_quality, else clean."""
    domain = F.when(F.col("toxic") > 0, "toxic").when(F.col("quality") > 0, "clean").otherwise("low_quality")
    known = labels.where("doc_id is not null and quality is not null and toxic is not null")
    return known.select("doc_id", domain.alias("domain")).groupBy("doc_id").agg(F.max("domain").alias("domain"))


def fit(docs: DataFrame, labelled: DataFrame, train_docs: int = 3000) -> Model | None:
    """A classifier on about train_docs labelled documents, an equal share for each
    domain; labelled has doc_id and domain. None without labelled documents."""
    counts = {r["domain"]: r["n"] for r in labelled.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    share = max(1, train_docs // max(1, len(counts)))
    limit = F.lit(-1).cast("long")
    for d, n in counts.items():
        limit = F.when(F.col("domain") == d, F.lit(share_limit(share, n))).otherwise(limit)
    chosen = labelled.where(drawn(F.xxhash64("doc_id", F.lit(29)), limit))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [at[f[d] : f[d + 1]].astype(np.uint32).tobytes() for _, _, _, at, f in present(batch.column(1)) for d in range(len(f) - 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary())], names=["domain", "at"])

    # chosen holds about train_docs ids, whatever the size of the tables; rows that repeat one count once
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "domain").agg(F.min("text").alias("text")).select("domain", "text")
    rows = sorted(zip(*(c.to_pylist() for c in texts.mapInArrow(run, "domain string, at binary").toArrow().columns), strict=True))
    domains = sorted({d for d, _ in rows})
    if not domains:
        return None
    y = np.array([domains.index(d) for d, _ in rows])
    x = [(at, np.full(len(at), _scale(np.array(len(at))))) for at in (np.frombuffer(at, np.uint32).astype(np.int64) for _, at in rows)]
    back = np.arange(len(x)) % 5 == 4
    w = ftrl([r for r, b in zip(x, back, strict=True) if not b], y[~back], 1 << BITS, len(domains), alpha=0.3)
    held = np.array([v @ w[at] for (at, v), b in zip(x, back, strict=True) if b]).reshape(-1, len(domains))
    # labels are drawn evenly, documents are not: shift to the labelled shares
    prior = np.array([counts[d] for d in domains], float)
    return Model(domains, w.astype(np.float32), prior / prior.sum(), temperature(held, y[back]))


def reweigh(p: np.ndarray, prior: np.ndarray) -> np.ndarray:
    """Posteriors under even classes, for classes with the given shares."""
    q = p * prior
    return q / np.maximum(q.sum(axis=1, keepdims=True), 1e-300)


def posteriors(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, tokens, posterior (array by domain), and u (uniform hash of the row)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2**18 x domains weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            tokens, p = m.posteriors(batch.column(1))
            p = reweigh(p, m.prior * len(m.domains))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(tokens), pa.FixedSizeListArray.from_arrays(pa.array(p.ravel()), len(m.domains)).cast(pa.list_(pa.float64())), batch.column(2)], names=["doc_id", "tokens", "posterior", "u"])

    return docs.select("doc_id", "text", uniform().alias("u")).mapInArrow(run, f"{schema_of(docs, 'doc_id')}, tokens long, posterior array<double>, u double")


def uniform() -> Column:
    return F.pmod(F.xxhash64("doc_id", "text", F.lit(41)), F.lit(1 << 30)) / F.lit(float(1 << 30))


@dataclass
class Solution:
    """state: coefficients by domain; distance: the largest miss of a target, as a share of the total."""

    domains: list[str]
    target: np.ndarray
    reached: np.ndarray
    state: np.ndarray
    distance: float

    def rates(self, p: np.ndarray) -> np.ndarray:
        return np.maximum(0.0, 1.0 - p @ self.state)


def solve(rows: DataFrame, domains: list[str], targets: dict[str, float], budget: float | None = None, tolerance: float = 1e-3) -> Solution:
    """rows (tokens, posterior) is read once for each step that is tried: a stored table."""
    k = len(domains)

    def totals(state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(expected totals by domain, Gram matrix of the documents with a rate)."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros(k + k * k)
            for batch in batches:
                p = batch.column(1).flatten().to_numpy().reshape(-1, k)
                t = batch.column(0).to_numpy().astype(float)
                r = np.maximum(0.0, 1.0 - p @ state)
                out += np.concatenate([(r * t) @ p, ((p * (t * (r > 0))[:, None]).T @ p).ravel()])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(out))), pa.array(out)], names=["i", "v"])

        got = {r["i"]: r["v"] for r in rows.select("tokens", "posterior").mapInArrow(run, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()}
        flat = np.array([got.get(i, 0.0) for i in range(k + k * k)])
        return flat[:k], flat[k:].reshape(k, k)

    state = np.zeros(k)
    have, gram = totals(state)  # every rate is 1; posteriors sum to 1
    want = np.array([max(0.0, targets.get(d, 0.0)) for d in domains])
    if not have.sum() or not want.sum():
        return Solution(domains, have, have, state, 0.0)
    want = want / want.sum()
    asked = [i for i in range(k) if want[i]]
    wanted = [i for i in asked if domains[i] not in UNWANTED] or asked
    total = budget if budget is not None else min(have[i] / want[i] for i in wanted)
    target = want * total
    if budget is None:
        target = np.minimum(target, have)
    at, ridge = have, RIDGE * np.trace(gram) / k * np.eye(k)
    far = lambda x: float(np.square(x - target).sum())
    while np.abs(at - target).max() > tolerance * total:
        step, scale = np.linalg.solve(gram + ridge, at - target), 1.0
        while scale > SMALLEST_STEP:
            reached, new = totals(state + scale * step)
            if far(reached) < (1 - 0.1 * scale) * far(at):
                break
            scale /= 2
        else:
            break  # no step comes nearer
        state, at, gram = state + scale * step, reached, new
    return Solution(domains, target, at, state, float(np.abs(at - target).max() / max(total, 1e-300)))


#: The share of the identity in a step's metric, and the smallest part of a step that is tried.
RIDGE, SMALLEST_STEP = 1e-6, 1e-4


def copies(rates: np.ndarray, u: np.ndarray) -> np.ndarray:
    whole = np.floor(rates)
    return (whole + (u < rates - whole)).astype(np.int64)


def source_mixing(docs: DataFrame, labelled: DataFrame, targets: dict[str, float] = TARGETS, budget: float | None = None) -> DataFrame:
    """doc_id, tokens, posterior, rate, copies for every row of docs."""
    model = fit(docs, labelled)
    if model is None:
        words = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), "[\\x20\\x09-\\x0D]+"), lambda w: w != ""))
        return docs.select("doc_id", words.cast("long").alias("tokens"), F.array().cast("array<double>").alias("posterior"), F.lit(1.0).alias("rate"), F.lit(1).cast("long").alias("copies"))
    rows = staged(posteriors(docs, model), "posteriors")
    solution = solve(rows, model.domains, targets, budget)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            r = solution.rates(batch.column(2).flatten().to_numpy().reshape(-1, len(solution.domains)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(r), pa.array(copies(r, batch.column(3).to_numpy()))], names=["doc_id", "tokens", "posterior", "rate", "copies"])

    return rows.mapInArrow(run, f"{schema_of(rows, 'doc_id')}, tokens long, posterior array<double>, rate double, copies long")


def mix_documents(docs: DataFrame, labelled: DataFrame, targets: dict[str, float] = TARGETS, budget: float | None = None) -> DataFrame:
    """The rows of docs, each as often as its copies say, with all their columns. Their
    posteriors are computed again beside the text, which so need not be shuffled."""
    model = fit(docs, labelled)
    if model is None:
        return docs
    rows = staged(posteriors(docs, model), "posteriors")
    solution = solve(rows, model.domains, targets, budget)
    discard(rows)
    shared = docs.sparkSession.sparkContext.broadcast((model, solution))
    at, names = docs.columns.index("text"), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, s = shared.value
        for batch in batches:
            _, p = m.posteriors(batch.column(at))
            n = copies(s.rates(reweigh(p, m.prior * len(m.domains))), batch.column(len(names)).to_numpy())
            if n.max(initial=0) <= 1:
                out = batch.filter(pa.array(n == 1))
            else:
                out = batch.take(pa.array(np.repeat(np.arange(len(n)), n)))
            yield out.select(range(len(names)))

    return docs.select("*", uniform().alias(unused(docs, "u"))).mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = source_mixing(table(spark, sf_dir, "documents"), domain_labels(table(spark, sf_dir, "labels")))
    return out.select("doc_id", "tokens", "posterior", "rate", "copies")
