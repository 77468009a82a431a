"""Substring deduplication by relative Lempel-Ziv parsing.

The whole corpus is the reference: every text is a block of it, and the index knows for
every run of `window` words (a seed) that occurs twice another place where it starts: the
first by block and address (that of the seed itself aside), so that the seeds of a shared
passage name one block. A document is parsed greedily from the left. Where its seed occurs
elsewhere a factor (start, length, block, address) starts there; it grows word by word
while the next seed is found at the next address of the same block; where that ends, the
seeds across the boundary are looked up in turn, and the next factor starts at the first
that occurs elsewhere. Words between are literals. Every factor is `window` words or
longer, reads the same in its block, and becomes a duplicate span, so a word is removed
exactly if some window that covers it also starts elsewhere.

The index is built in two steps so that unique text is hardly moved. Each seed has an
anchor, the smallest hash of its 8-word grams; equal seeds have equal anchors, and about
one word in fourteen is an anchor. Only seeds whose anchor occurs twice are indexed. Both
steps move packed arrays, one row for each map batch and target partition. Of an anchor
or seed that occurs more than twice in a batch two occurrences go to the partition of its
hash; the others are answered on the spot, by the first, so a passage that a third of all
documents hold costs each batch two entries there. Equal texts share one block (the hash
of the text), so copies of one text are parsed alike.

Defined results: a null text has no words; texts shorter than a window lose nothing;
windows are judged on the input; copies of a text of a window and more lose all words
(their factors may point to their own block: the copy); repeated rows are copies; an empty
table gives an empty table; further columns are kept, whatever their names, but for
n_words, n_removed, factors and deduped, which are replaced. Texts and seeds are equal if
their 64-bit hashes are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm._shared import partitions, schema_of, sha256_hex, staged, table, unused
from quillspark.llm._words import Words, hits, mix, text_blocks, windows, words_of

WINDOW = 35
GRAM = 8
_BASES = [pow(0x9FB21C651E98DF25, i + 1, 1 << 64) for i in range(GRAM)]


def sliding(x: np.ndarray, width: int, best) -> np.ndarray:
    """best (np.minimum or np.maximum) over x[i : i + width] for every i."""
    done, out = 1, x
    while done * 2 <= width:
        out = best(out[: len(out) - done], out[done:])
        done *= 2
    if done < width:
        out = best(out[: len(out) - (width - done)], out[width - done :])
    return out


def seeds(words: Words, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first words, hashes, anchors) of all windows inside documents, and the gram hash
    of every anchor position with its first word: (at, h, anchor, [position, gram])."""
    at, h = windows(words, window)
    if not len(at):
        return at, h, h, np.zeros((2, 0), np.uint64)
    n, width = len(words.hashes), window - GRAM + 1
    gram = np.zeros(n - GRAM + 1, np.uint64)
    for i, base in enumerate(_BASES):
        gram += words.hashes[i : i + len(gram)] * np.uint64(base)
    gram = mix(gram)
    low = sliding(gram, width, np.minimum)
    valid = np.zeros(len(gram) + width - 1, np.uint64)
    valid[at + width - 1] = low[at]
    position = np.flatnonzero(sliding(valid, width, np.maximum) == gram)
    return at, h, low[at], np.stack([position.astype(np.uint64), gram[position]])


def _blob(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x).tobytes()


#: kind 0: entries for the partition of their hash (a: hashes, b: positions); kind 1: answers
#: for the partition of their block (a: anchors; or position and address, b: reference blocks).
PACKED = "part int, kind int, keys binary, times binary, a binary, b binary"


def _packed(kind: int, part: np.ndarray, keys: np.ndarray, a: np.ndarray, b: np.ndarray | None, parts: int) -> Iterator[pa.RecordBatch]:
    """One row for each part, with runs of equal keys once."""
    part = part.astype(np.uint32 if parts >> 16 else np.uint16)
    by = np.argsort(part, kind="stable")
    part, keys, a = part[by], keys[by], a[by]
    b = None if b is None else b[by]
    ends = np.searchsorted(part, np.arange(parts + 1))
    rows = []
    for p in np.flatnonzero(np.diff(ends)).tolist():
        i, j = ends[p], ends[p + 1]
        new = np.flatnonzero(np.append(True, keys[i + 1 : j] != keys[i : j - 1]))
        rows.append((p, kind, _blob(keys[i:j][new]), _blob(np.diff(np.append(new, j - i)).astype(np.uint32)), _blob(a[i:j]), b"" if b is None else _blob(b[i:j])))
    if rows:
        types = [pa.int32(), pa.int32(), *[pa.binary()] * 4]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["part", "kind", "keys", "times", "a", "b"])


def _gathered(batches: Iterator[pa.RecordBatch]) -> tuple[dict[int, list], list[pa.RecordBatch]]:
    """(rows of kind 0 by part, batches of kind 1)."""
    groups: dict[int, list] = {}
    answers = []
    for batch in batches:
        kind = batch.column(1).to_numpy()
        answers.append(batch.filter(pa.array(kind == 1)))
        for row in zip(*(c.to_pylist() for c in batch.filter(pa.array(kind == 0)).columns), strict=True):
            groups.setdefault(row[0], []).append(row[2:])
    return groups, answers


def _unpacked(rows: list, a: type, b: type) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    keys = np.concatenate([np.repeat(np.frombuffer(r[0], np.int64), np.frombuffer(r[1], np.uint32)) for r in rows])
    return keys, np.concatenate([np.frombuffer(r[2], a) for r in rows]), np.concatenate([np.frombuffer(r[3], b) for r in rows])


def _groups(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, last) of the group of equal values of each place of a sorted array."""
    starts = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1])) if len(hashes) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(starts, len(hashes)))
    return np.repeat(starts, sizes), np.repeat(starts + sizes - 1, sizes)


def _once(*arrays: np.ndarray) -> np.ndarray:
    """Places of the first of equal tuples in sorted arrays."""
    new = np.ones(len(arrays[0]), bool)
    if len(new):
        new[1:] = np.any([x[1:] != x[:-1] for x in arrays], axis=0)
    return np.flatnonzero(new)


def anchor_batch(hashes: np.ndarray, keys: np.ndarray, parts: int, local: bool) -> Iterator[pa.RecordBatch]:
    """Anchors of a map batch (local) or of all of one partition: answers for those that are
    known to occur twice, the first two of each on to the partition of the hash if local."""
    by = np.lexsort((keys, hashes))
    hashes, keys = hashes[by], keys[by]
    first, last = _groups(hashes)
    rank = np.arange(len(hashes)) - first
    if local:
        sent = rank < 2
        yield from _packed(0, hashes[sent] % np.uint64(parts), keys[sent], hashes[sent], None, parts)
    done = rank >= 2 if local else last > first
    hashes, keys = hashes[done], keys[done]
    by = np.lexsort((hashes, keys))
    hashes, keys = hashes[by], keys[by]
    at = _once(keys, hashes)
    yield from _packed(1, np.mod(keys[at], parts), keys[at], hashes[at], None, parts)


def seed_batch(hashes: np.ndarray, keys: np.ndarray, positions: np.ndarray, parts: int, local: bool) -> Iterator[pa.RecordBatch]:
    """The same for seeds, where the answer names another place: the first one, or the last
    one for the first."""
    by = np.lexsort((positions, keys, hashes))
    hashes, keys, positions = hashes[by], keys[by], positions[by].astype(np.uint64)
    first, last = _groups(hashes)
    rank = np.arange(len(hashes)) - first
    if local:
        sent = rank < 2
        yield from _packed(0, hashes[sent] % np.uint64(parts), keys[sent], hashes[sent], positions[sent].astype(np.uint32), parts)
    done = np.flatnonzero(rank >= 2 if local else last > first)
    same = (keys[done] == keys[first[done]]) & (positions[done] == positions[first[done]])
    ref = np.where(same, last[done], first[done])
    place, block = (positions[done] << np.uint64(32)) | positions[ref], keys[ref]
    keys = keys[done]
    by = np.lexsort((block, place, keys))
    keys, place, block = keys[by], place[by], block[by]
    at = _once(keys, place >> np.uint64(32))
    yield from _packed(1, np.mod(keys[at], parts), keys[at], place[at], block[at], parts)


def by_key(answers: DataFrame, parts: int) -> DataFrame:
    """(key, a, b): the answers for each text, a sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[int, list] = {}
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                groups.setdefault(row[0], []).append(row[2:])
        while groups:
            keys, a, b = _unpacked(groups.popitem()[1], np.uint64, np.int64)
            by = np.lexsort((a, keys))
            keys, a, b = keys[by], a[by], b[by] if len(b) else b
            starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
            cuts = list(zip(starts, np.append(starts[1:], len(keys)), strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(keys[starts]), pa.array([_blob(a[i:j]) for i, j in cuts], pa.binary()), pa.array([_blob(b[i:j]) for i, j in cuts], pa.binary())], names=["key", "a", "b"])

    return answers.repartitionById(parts, "part").mapInArrow(run, "key long, a binary, b binary")


def repeated_anchors(docs: DataFrame, parts: int, window: int) -> DataFrame:
    """(key, a): for each text the anchors of it that occur twice in the corpus."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            keys = batch.column(1).to_numpy()
            for a, _, data, offsets in text_blocks(batch.column(0)):
                words = words_of(data, offsets)
                position, gram = seeds(words, window)[3]
                doc = np.searchsorted(words.first, position.astype(np.int64), "right") - 1
                held.append((gram, keys[a + doc]))
                size += len(gram)
                if size >= 1 << 20:
                    yield from anchor_batch(*map(np.concatenate, zip(*held, strict=True)), parts, True)
                    held, size = [], 0
        if size:
            yield from anchor_batch(*map(np.concatenate, zip(*held, strict=True)), parts, True)

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups, answers = _gathered(batches)
        yield from answers
        while groups:
            keys, hashes, _ = _unpacked(groups.popitem()[1], np.uint64, np.uint32)
            yield from anchor_batch(hashes, keys, parts, False)

    packed = docs.select("text", "key").mapInArrow(emit, PACKED)
    return by_key(packed.repartitionById(parts, "part").mapInArrow(reduce, PACKED), parts)


def repeated_seeds(known: DataFrame, parts: int, window: int) -> DataFrame:
    """(key, a, b): for each text the positions of its windows that also start elsewhere (upper
    half of a), each with the address (lower half) and the block (b) of one other place.
    known: text among other columns, last its hash and its repeated anchors."""
    column, at_key, at_anchors = known.columns.index("text"), len(known.columns) - 2, len(known.columns) - 1

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            keys = batch.column(at_key).to_numpy()
            for a, b, data, offsets in text_blocks(batch.column(column)):
                words = words_of(data, offsets)
                at, h, anchor, _ = seeds(words, window)
                if not len(at):
                    continue
                first = np.searchsorted(at, words.first)
                chosen = np.zeros(len(at), bool)
                for d in range(b - a):
                    if first[d] < first[d + 1]:
                        wanted = np.frombuffer(batch.column(at_anchors)[a + d].as_buffer(), np.uint64)
                        chosen[first[d] : first[d + 1]] = hits(wanted, anchor[first[d] : first[d + 1]])
                doc = words.doc[at[chosen]]
                held.append((h[chosen], keys[a + doc], at[chosen] - words.first[doc]))
                size += len(doc)
                if size >= 1 << 20:
                    yield from seed_batch(*map(np.concatenate, zip(*held, strict=True)), parts, True)
                    held, size = [], 0
        if size:
            yield from seed_batch(*map(np.concatenate, zip(*held, strict=True)), parts, True)

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups, answers = _gathered(batches)
        yield from answers
        while groups:
            keys, hashes, positions = _unpacked(groups.popitem()[1], np.uint64, np.uint32)
            yield from seed_batch(hashes, keys, positions, parts, False)

    return by_key(known.mapInArrow(emit, PACKED).repartitionById(parts, "part").mapInArrow(reduce, PACKED), parts)


def parse(places: np.ndarray, blocks: np.ndarray, window: int) -> np.ndarray:
    """[start, length, block, address] of the factors of a document, in words. places: its
    indexed seeds in order, position and address; blocks: where they are found. A factor
    goes on while the next seed follows at the next address of the same block."""
    positions, address = (places >> np.uint64(32)).astype(np.int64), (places & np.uint64(0xFFFFFFFF)).astype(np.int64)
    if not len(positions):
        return np.zeros((0, 4), np.int64)
    once = np.append(True, positions[1:] != positions[:-1])
    positions, address, blocks = positions[once], address[once], blocks[once]
    goes_on = (np.diff(positions) == 1) & (np.diff(address) == 1) & (blocks[1:] == blocks[:-1])
    starts = np.flatnonzero(np.append(True, ~goes_on))
    last = np.append(starts[1:], len(positions)) - 1
    return np.stack([positions[starts], positions[last] - positions[starts] + window, blocks[starts], address[starts]], axis=1)


ADDED = ("n_words", "n_removed", "factors", "deduped")


def substring_dedup(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs with n_words, n_removed, factors (array of start, length, block, address: the words
    of that length from address on in the text whose xxhash64 is block are the same), and
    deduped (the words that stay, joined by one space)."""
    docs = docs.drop(*ADDED)
    parts, names = partitions(docs.sparkSession), docs.columns
    anchors = staged(repeated_anchors(docs.select("text", F.xxhash64("text").alias("key")), parts, window), "anchors")
    key, same, a, b = (unused(docs, x) for x in ("key", "same", "a", "b"))
    keyed = docs.withColumn(key, F.xxhash64("text"))
    # both joins deal the same columns out by the texts' hash, so they are shuffled once
    known = keyed.join(anchors.select(F.col("key").alias(same), F.col("a").alias(a)), F.col(key) == F.col(same)).select(*names, key, a)
    found = repeated_seeds(known, parts, window)
    joined = keyed.join(found.toDF(same, a, b), F.col(key) == F.col(same), "left").select(*names, a, b)
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_removed, factors, kept = [], [], [], []
            places, blocks = batch.column(len(names)), batch.column(len(names) + 1)
            for a, b, data, offsets in text_blocks(batch.column(at)):
                words = words_of(data, offsets)
                for d in range(b - a):
                    i, j = words.first[d], words.first[d + 1]
                    n_words.append(j - i)
                    own = np.zeros((0, 4), np.int64)
                    if places[a + d].is_valid:
                        own = parse(np.frombuffer(places[a + d].as_buffer(), np.uint64), np.frombuffer(blocks[a + d].as_buffer(), np.int64), window)
                    gone = np.zeros(j - i + 1, np.int64)
                    np.add.at(gone, own[:, 0], 1)
                    np.add.at(gone, own[:, 0] + own[:, 1], -1)
                    stays = np.cumsum(gone[:-1]) == 0
                    n_removed.append(j - i - int(stays.sum()))
                    factors.append([{"start": x[0], "length": x[1], "block": x[2], "address": x[3]} for x in own.tolist()])
                    s, e = words.starts[i:j][stays], words.ends[i:j][stays]
                    text = data[offsets[d] : offsets[d + 1]].tobytes()
                    s, e = s - offsets[d], e - offsets[d]
                    kept.append(b" ".join(text.split()) if stays.all() else b" ".join([text[x:y] for x, y in zip(s.tolist(), e.tolist(), strict=True)]))
            columns = [batch.column(i) for i in range(len(names))]
            factor = pa.struct([(x, pa.int64()) for x in ("start", "length", "block", "address")])
            columns += [pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(factors, pa.list_(factor)), pa.array(kept, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, *ADDED])

    return joined.mapInArrow(run, f"{schema_of(docs, *names)}, n_words long, n_removed long, factors array<struct<start:long,length:long,block:long,address:long>>, deduped string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", sha256_hex(F.col("deduped")).alias("kept_sha256"))
