"""Quality rules with risk-controlled thresholds.

Every document gets text statistics and four rule values (higher is worse). A ladder of
severities, fixed before any data is seen, sets one cutoff per rule; a document breaks a
severity if any rule value reaches its cutoff. For every stratum the labelled documents
of good quality are a holdout: a severity is certified if the exact (Clopper-Pearson)
upper bound of its false-rejection rate is at most `alpha`. Severities are tested from
the mildest on and testing stops at the first failure (fixed-sequence testing needs no
further correction inside a stratum); strata share `delta` by Bonferroni. So with
probability 1 - delta the severities reject no more than `alpha` of the good documents of
any stratum, among those that pass the base rules. What the base rules (fixed, and the
same for all) reject of the good ones is not under that bound; fit() reports its share by
stratum as base_rate. Of the certified severities the one is used that finds most labelled junk, less the good
documents it rejects. A stratum whose
holdout can certify nothing rejects nothing.

Defined results: a null text has no words and fails the base rules; a null stratum is a
stratum of its own; a null label is no label; several labels of one document count as
good only if all are; repeated rows are judged each for itself; an empty table gives an
empty table; further columns are left alone.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm._shared import schema_of, staged, table
from quillspark.llm._words import LEAD, SPACE, per_doc, text_blocks, windows, words_of

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True

#: Cutoff of each rule at severity 0 and at the last severity; between them evenly.
LADDER_STEPS = 48
LADDER = {"symbol_ratio": (1.0, 0.02), "upper_ratio": (1.0, 0.05), "repeat_ratio": (1.0, 0.05), "dup_line_ratio": (1.0, 0.1)}
STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, severity int"


def cutoffs(severity: int) -> dict[str, float]:
    return {k: a + (b - a) * severity / (LADDER_STEPS - 1) for k, (a, b) in LADDER.items()}


def text_stats(column: pa.Array) -> dict[str, np.ndarray]:
    """The statistics of STATS for a string column. severity: the mildest severity the
    document breaks, LADDER_STEPS if it breaks none."""
    out: dict[str, list[np.ndarray]] = {}
    texts = column.fill_null("") if column.null_count else column
    for a, b, data, offsets in text_blocks(column):
        words = words_of(data, offsets)
        lead = LEAD[data]
        body = ~SPACE[data]
        upper = (data >= 65) & (data <= 90)
        if len(data) > 1:  # the capital letters of Latin-1, C3 80 to C3 9E
            upper[1:] |= (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)
        at, h = windows(words, 3)
        covered = np.zeros(len(words.hashes) + 3, bool)
        if len(at):
            key = h ^ (words.doc[at].astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))
            order = np.argsort(key, kind="stable")
            same = key[order[1:]] == key[order[:-1]]
            twice = np.zeros(len(at), bool)
            twice[order[1:][same]] = True
            twice[order[:-1][same]] = True
            for i in range(3):
                covered[at[twice] + i] = True
        n_lines, dup_lines = np.zeros(b - a, np.int64), np.zeros(b - a, np.int64)
        for i, text in enumerate(texts.slice(a, b - a).to_pylist()):
            lines = text.split("\n")
            n_lines[i] = len(lines)
            if len(lines) > 1:
                dup_lines[i] = sum((n - 1) for line, n in Counter(lines).items() if n > 1 and line.strip(" \t\n\x0b\x0c\r"))
        got = {
            "n_words": words.counts,
            "word_chars": per_doc(lead & body, offsets),
            "n_symbols": per_doc(SYMBOLS[data], offsets),
            "n_dup_lines": dup_lines,
            "n_repeat_words": per_doc(covered[: len(words.hashes)], words.first),
        }
        n = np.maximum(got["n_words"], 1)
        rules = {
            "symbol_ratio": np.minimum(1, got["n_symbols"] / n),
            "upper_ratio": np.minimum(1, per_doc(upper, offsets) / np.maximum(got["word_chars"], 1)),
            "repeat_ratio": got["n_repeat_words"] / n,
            "dup_line_ratio": dup_lines / np.maximum(n_lines, 1),
        }
        first = np.full(b - a, LADDER_STEPS, np.int64)
        for k, (mild, strict) in LADDER.items():
            step = np.ceil((mild - rules[k]) / (mild - strict) * (LADDER_STEPS - 1) - 1e-9).astype(np.int64)
            first = np.minimum(first, np.clip(step, 0, LADDER_STEPS))
        got["base_failed"] = (got["n_words"] < 50) | (100 * got["n_repeat_words"] > 50 * got["n_words"])
        got["severity"] = first
        for k, v in got.items():
            out.setdefault(k, []).append(v)
    return {k: np.concatenate(v) for k, v in out.items()}


def with_stats(docs: DataFrame, *keep: str) -> DataFrame:
    """The columns keep of docs and those of STATS."""
    names = list(dict.fromkeys([*keep, "text"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                stats = text_stats(batch.column("text"))
                types = {"base_failed": pa.bool_(), "severity": pa.int32()}
                yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), *(pa.array(v, types.get(k, pa.int64())) for k, v in stats.items())], names=[*keep, *stats])

    return docs.select(*names).mapInArrow(run, f"{schema_of(docs, *keep)}, {STATS}")


def _betainc_upper(k: int, n: int, p: float) -> float:
    """P(X <= k) for X binomial (n, p)."""
    if k >= n or p <= 0:
        return 1.0
    if p >= 1:
        return 0.0
    a, b = n - k, k + 1  # the regularised incomplete beta function at 1 - p
    return _beta(a, b, 1 - p) if 1 - p < (a + 1) / (a + b + 2) else 1 - _beta(b, a, p)


def _beta(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function by its continued fraction (Lentz)."""
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c = 1e-300, 1.0
    d = 1 / (1 - (a + b) * x / (a + 1) or tiny)
    out, m = d, 0
    while True:
        m += 1
        for term in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + term * d or tiny)
            c = 1 + term / c or tiny
            out *= c * d
        if abs(c * d - 1) < 1e-14:
            return min(1.0, front * out)


def upper_bound(k: int, n: int, delta: float) -> float:
    """Clopper-Pearson upper bound of a rate at confidence 1 - delta after k of n."""
    if k >= n:
        return 1.0
    lo, hi = k / n, 1.0
    for _ in range(50):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if _betainc_upper(k, n, mid) > delta else (lo, mid)
    return hi


@dataclass(frozen=True)
class Selection:
    """Severity for each certified stratum, and what the choice rests on."""

    severity: dict[str | None, int]
    report: list[dict]


def select_severities(counts: dict[str | None, dict[tuple[int, int], int]], alpha: float, delta: float) -> Selection:
    """counts[stratum][good (1 or 0), severity]: labelled documents past the base rules."""
    chosen, report = {}, []
    for stratum, hist in sorted(counts.items(), key=lambda x: (x[0] is None, str(x[0]))):
        n = sum(v for (good, _), v in hist.items() if good)
        best, k, found = None, 0, 0
        for s in range(LADDER_STEPS):
            k += hist.get((1, s), 0)
            found += hist.get((0, s), 0)
            # the binomial tail at alpha against delta is the Clopper-Pearson test
            if not n or _betainc_upper(k, n, alpha) > delta / len(counts):
                break
            if found > k and (best is None or found - k > best[1] - best[2]):
                best = (s, found, k)
        if best:
            chosen[stratum] = best[0]
            report.append({"stratum": stratum, "severity": best[0], "good": n, "false": best[2], "bound": upper_bound(best[2], n, delta / len(counts)), "junk_found": best[1]})
    return Selection(chosen, report)


def fit(stats: DataFrame, labels: DataFrame, stratum: str, alpha: float = 0.02, delta: float = 0.05) -> Selection:
    """Only counts by stratum, label and severity reach the driver: strata x 2 x 50 rows."""
    good = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("__good"))
    step = F.when(F.col("base_failed"), F.lit(-1)).otherwise(F.col("severity"))
    rows = (
        stats.select("doc_id", F.col(stratum).alias("__stratum"), step.alias("__severity")).join(good, "doc_id")
        .groupBy("__stratum", "__good", "__severity").agg(F.count("*").alias("__n")).collect()
    )
    counts: dict = {}
    base: dict = {}
    for r in rows:
        label = int(r["__good"] > 0)
        if label:
            failed, n = base.get(r["__stratum"], (0, 0))
            base[r["__stratum"]] = (failed + r["__n"] * (r["__severity"] < 0), n + r["__n"])
        if r["__severity"] >= 0:
            hist = counts.setdefault(r["__stratum"], {})
            key = (label, r["__severity"])
            hist[key] = hist.get(key, 0) + r["__n"]
    selection = select_severities(counts, alpha, delta)
    for x in selection.report:
        failed, n = base[x["stratum"]]
        x["base_rate"] = failed / n
    return selection


def verdict(selection: Selection, stratum: str) -> F.Column:
    """Kept or not, from the columns base_failed, severity and the stratum."""
    known = {k: s for k, s in selection.severity.items() if k is not None}
    limit = F.lit(-1)
    if known:  # one look-up in a map, however many strata
        limit = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in known.items() for x in pair]), F.col(stratum)), limit)
    if None in selection.severity:
        limit = F.when(F.col(stratum).isNull(), F.lit(selection.severity[None])).otherwise(limit)
    return ~F.col("base_failed") & (F.col("severity") > limit)


def quality_rules(docs: DataFrame, labels: DataFrame, stratum: str = "lang", alpha: float = 0.02, delta: float = 0.05) -> DataFrame:
    """doc_id, stratum, the statistics, and kept for every row of docs."""
    stats = staged(with_stats(docs, "doc_id", stratum), "quality")
    selection = fit(stats, labels, stratum, alpha, delta)
    return stats.withColumn("kept", verdict(selection, stratum))


def filter_documents(docs: DataFrame, labels: DataFrame, stratum: str = "lang", alpha: float = 0.02, delta: float = 0.05) -> DataFrame:
    """The rows of docs that are kept, with all their columns. The statistics of the
    kept rows are computed again beside the text, which so need not be shuffled."""
    selection = fit(staged(with_stats(docs, "doc_id", stratum), "quality"), labels, stratum, alpha, delta)
    limits = dict(selection.severity)
    at = docs.columns.index("text"), docs.columns.index(stratum)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                stats = text_stats(batch.column(at[0]))
                limit = np.array([limits.get(x, -1) for x in batch.column(at[1]).to_pylist()])
                yield batch.filter(pa.array(~stats["base_failed"] & (stats["severity"] > limit)))

    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "severity")

