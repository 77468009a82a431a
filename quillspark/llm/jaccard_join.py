"""Exact set-similarity join on word shingles by universe partition.

Documents are sets of distinct five-word shingle hashes; two link when their Jaccard
similarity is at least 0.75, so sets of n1 and n2 shingles differ in at most
t = floor((n1 + n2) / 7) of them. Sizes fall into bands that double. In every band the
universe of hashes is cut into m equal segments, m = t + 1 for the largest pair of the
band and a quarter more; what a set holds of one segment is a subset (maybe empty). A
set belongs to the band of its size and, as the smaller partner, to the next band if a
partner there is possible.

Index: every subset of every set, and of its one-deletion neighbourhoods (the subset less
one shingle) all those that somebody asks for. Allocation: a set gives each segment a
level, 0 (not asked), 1 (its subset is looked up among the subsets: finds partners that
agree there) or 2 (its neighbourhood too: finds partners that differ by one shingle). The
levels add up to t + 1 at least, so a partner that is found nowhere differs by t + 1
shingles. Levels are chosen set by set at least cost: what a look-up would meet, by counts
over all documents in a table of fixed size. A common passage therefore makes no
candidates where rarer subsets or neighbourhoods suffice. m >= t + 1, so an allocation
always exists.

Plan: shingles are hashed once into a stored table (class, 48 bits of each hash: fewer bits
find more candidates, never fewer); equal sets are one class and go on once from each task. Signatures move packed, one row for each map batch and
target partition. A signature that very many sets have is dealt out by class over many
partitions. Of the classes that share a signature the first that asks is verified against
the others. Then all pairs of which one asks and that lie in different components are, in
blocks of members. So no link between components is lost, and no group of near copies is
expanded into all its pairs. Rows meet the class and the component of very many rows by
broadcast, all others by a shuffle.

Pairs are verified in two steps: on parity arrays (a bit for each hash, flipped; their
difference in bits bounds that of the sets from below), then on the full sets of 64-bit
shingle hashes, made again from the texts of the few that are left.

Defined results: a text of 1 to 4 words is one shingle; a null text or one without words
has none, is linked with nothing and is its own component; repeated rows are equal sets;
a null doc_id takes part like any other and has its component's smallest doc_id, if any;
an empty table gives an empty table; further columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm._graph import components
from quillspark.llm._shared import discard, partitions, schema_of, small_batches, spread_join, staged, table, unused
from quillspark.llm._words import hits, mix, shingle_sets, text_blocks, words_of

SHINGLE = 5
CELL_BITS = 22
SIG_BITS = 37
#: Signatures that occur more often than this, and than 16 times the mean of a cell, are dealt out over several partitions.
HOT = 4096
#: Members of a signature that one task compares with as many others at most.
BLOCK = 512
_ODD = np.uint64(0x9FB21C651E98DF25)
_LOW = np.uint64((1 << SIG_BITS) - 1)
_CELL = np.uint64((1 << CELL_BITS) - 1)


def linked(common: np.ndarray | int, n1: np.ndarray | int, n2: np.ndarray | int):
    return 100 * common >= 75 * (n1 + n2 - common)


def band_of(n: np.ndarray) -> np.ndarray:
    """Band b holds the sizes from 2**b up to the next power of two."""
    return np.frexp(np.maximum(n, 1))[1].astype(np.int64) - 1


def segments(band: int) -> int:
    """m: t + 1 of the largest pair in the band, and a quarter more to choose from."""
    need = 2 * ((2 << band) - 1) // 7 + 1
    return need + need // 4


def allocation(n: np.ndarray, band: int) -> np.ndarray:
    """t + 1 for sets of n shingles and their largest possible partner in the band."""
    return (n + np.minimum((2 << band) - 1, n * 4 // 3)) // 7 + 1


def class_ids(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A positive hash of each set; 0 for an empty one."""
    n = np.diff(first)
    out = np.zeros(len(n), np.uint64)
    filled = np.flatnonzero(n)
    if len(filled):
        out[filled] = mix(np.add.reduceat(mix(h ^ _ODD), first[filled]) ^ (n[filled].astype(np.uint64) * _ODD))
    return (out >> np.uint64(1)).astype(np.int64)


def parity(h: np.ndarray) -> bytes:
    """A bit array in which each hash flips one bit; at least four bits for each hash, a
    power of two. Two sets differ in no fewer hashes than their arrays differ in bits."""
    bits = max(64, 1 << int(4 * len(h) - 1).bit_length())
    flips = np.bincount((h & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(flips.astype(np.uint8), bitorder="little").tobytes()


def fold(x: np.ndarray, size: int) -> np.ndarray:
    """A parity array of fewer bytes, as the same hashes would give."""
    return np.bitwise_xor.reduce(x.reshape(-1, size), axis=0)


def sets_of(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    for a, b, data, offsets in text_blocks(column):
        yield a, b, *shingle_sets(words_of(data, offsets, lower=True), SHINGLE)


def set_rows(docs: DataFrame) -> DataFrame:
    """doc_id, key (hash of the text), n_shingles and class (0 for an empty set) of every
    row; parity array and set (48 bits of each hash) of the first row of each class in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = {0}
        for batch in batches:
            for a, b, h, first in sets_of(batch.column(1)):
                cls, bits, sets = class_ids(h, first), [], []
                short = h.view(np.uint8).reshape(-1, 8)[:, 2:].copy()  # the upper 48 bits
                for d, c in enumerate(cls.tolist()):
                    new = c not in seen
                    seen.add(c)
                    bits.append(parity(h[first[d] : first[d + 1]]) if new else None)
                    sets.append(short[first[d] : first[d + 1]].tobytes() if new else None)
                columns = [batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a), pa.array(np.diff(first)), pa.array(cls), pa.array(bits, pa.binary()), pa.array(sets, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "key", "n_shingles", "class", "parity", "set"])

    return docs.select("doc_id", "text", F.xxhash64("text").alias("key")).mapInArrow(run, f"{schema_of(docs, 'doc_id')}, key long, n_shingles long, class long, parity binary, set binary")


def set_blocks(column: pa.Array, limit: int = 1 << 17) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, hashes, offsets) of blocks of stored sets."""
    for a, b, data, offsets in text_blocks(column, 6 * limit):
        wide = np.zeros((len(data) // 6, 8), np.uint8)
        wide[:, 2:] = data.reshape(-1, 6)
        yield a, b, wide.view(np.uint64).ravel(), offsets // 6


#: Table values in eighths of a doubling: 0 for 0, then 1, 2, ... times 2**(1/8).
_EIGHTHS = np.concatenate([[0], np.exp2(np.arange(255) / 8)])


def eighths(counts: np.ndarray) -> np.ndarray:
    """Counts as one byte each, by the largest table value that is no greater."""
    return (np.searchsorted(_EIGHTHS, counts + 1e-6, "right") - 1).astype(np.uint8)


@dataclass
class Costs:
    """How often the signatures of each of 2**CELL_BITS cells occur (in eighths of a
    doubling), and the mean: a table of four megabytes at any size of the corpus. It
    serves to choose among allocations and to deal out, never to leave something out."""

    table: np.ndarray
    mean: float
    hot: int = HOT

    def count(self, sig: np.ndarray) -> np.ndarray:
        return _EIGHTHS.astype(np.float32)[self.table[(sig & _CELL).astype(np.int64)]]

    def meets(self, sig: np.ndarray) -> np.ndarray:
        """How many others a look-up meets. The noise of a cell's other signatures, up to
        four deviations over the mean, weighs nothing."""
        noise = np.float32(self.mean + 4 * self.mean**0.5)
        count = self.count(sig)
        return np.where(count > noise, count - np.float32(self.mean), 0)

    def shares(self, sig: np.ndarray) -> np.ndarray:
        """Over how many partitions a signature is dealt out."""
        limit = max(self.hot, 16 * self.mean)
        return np.maximum(1, np.ceil(self.count(sig) / limit)).astype(np.int64)


class Members:
    """The sets of a block that belong to one band, cut into segments: S has the signature
    of each subset (row after row, `m` of each set), D those of the neighbourhoods."""

    def __init__(self, h: np.ndarray, first: np.ndarray, docs: np.ndarray, band: int) -> None:
        self.docs, self.m = docs, segments(band)
        self.n = np.diff(first)[docs]
        at = np.repeat(first[docs] - np.concatenate([[0], np.cumsum(self.n)[:-1]]), self.n) + np.arange(self.n.sum())
        x = h[at]
        seg = (((x >> np.uint64(32)) * np.uint64(self.m)) >> np.uint64(32)).astype(np.int64)
        self.of = np.repeat(np.arange(len(docs)) * self.m, self.n) + seg
        value = mix(x * _ODD)
        starts = np.flatnonzero(np.append(True, self.of[1:] != self.of[:-1]))
        total = np.zeros(len(docs) * self.m, np.uint64)
        total[self.of[starts]] = np.add.reduceat(value, starts)
        salt = mix(np.arange(self.m, dtype=np.uint64) + np.uint64((band + 1) << 32))
        self.S = mix(total ^ np.tile(salt, len(docs)))
        self._rest = (total, value, salt, seg)
        self.size = np.zeros(len(total), np.int64)
        self.size[self.of[starts]] = np.diff(np.append(starts, len(x)))
        self.need = allocation(self.n, band)

    @cached_property
    def D(self) -> np.ndarray:
        total, value, salt, seg = self._rest
        return mix((total[self.of] - value) ^ salt[seg])

    def levels(self, costs: Costs) -> np.ndarray:
        """0, 1 or 2 for each segment of each set; they add up to `need`. The second step of a
        segment counts as no cheaper than its first, so the cheapest steps can be taken
        one by one."""
        jitter = (self.S & np.uint64(0xFFFFF)).astype(np.float32) * np.float32(1e-8)
        one = costs.meets(self.S) + 1.0 / (1 + self.size) + jitter
        two = 1.0 + np.bincount(self.of, costs.meets(self.D) + 1.0 / self.size[self.of], len(one)) + jitter
        two = np.maximum(np.where(self.size > 0, two, 4 * one + 1), one).reshape(-1, self.m)
        one = one.reshape(-1, self.m)
        last = np.take_along_axis(np.sort(one, axis=1), self.need[:, None] - 1, axis=1)
        out = (one <= last).astype(np.int64)
        for d in np.flatnonzero((two < last).any(axis=1)):  # sets for which a neighbourhood is worth it
            steps = np.argsort(np.concatenate([one[d], two[d]]), kind="stable")[: self.need[d]]
            out[d] = np.bincount(steps % self.m, minlength=self.m)
        return out.ravel()


def memberships(h: np.ndarray, first: np.ndarray) -> Iterator[Members]:
    """The bands of a block. Where t is 0 (up to 3 shingles) only equal sets link."""
    n = np.diff(first)
    own = band_of(n)
    for band in np.unique(np.concatenate([own[n > 0], own[n > 0] + 1])).tolist():
        if segments(band) == 1:
            continue
        docs = np.flatnonzero((n > 0) & ((own == band) | ((own == band - 1) & (n * 4 // 3 >= 1 << band))))
        if len(docs):
            yield Members(h, first, docs, band)


def _sliced(sets: DataFrame, zero: np.ndarray, add: Callable[[np.ndarray, np.ndarray, np.ndarray], None], pack: Callable[[np.ndarray], np.ndarray], merge: Callable[[list[np.ndarray]], np.ndarray]) -> tuple[np.ndarray, int]:
    """(a table of bytes of fixed size, sum of what it counts) over all sets: every task fills
    a table and packs it to bytes, slices of them are merged in as many tasks, and the
    driver puts the packed slices together."""
    slices = 16

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = zero.copy()
        for batch in batches:
            for _, _, h, first in set_blocks(batch.column(0)):
                add(total, h, first)
        yield pa.RecordBatch.from_arrays([pa.array(range(slices)), pa.array([pack(x).tobytes() for x in np.split(total, slices)])], names=["slice", "found"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                held[i] = merge(held.get(i), np.frombuffer(x.as_buffer(), np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array([int(x.sum()) for x in held.values()], pa.int64()), pa.array([pack(x).tobytes() for x in held.values()], pa.binary())], names=["slice", "total", "found"])

    rows = sets.mapInArrow(fill, "slice long, found binary").repartition(slices, "slice").mapInArrow(join, "slice long, total long, found binary").collect()
    out = np.zeros(len(zero), np.uint8)
    for r in rows:
        part = np.frombuffer(r["found"], np.uint8)
        out[r["slice"] * len(part) : (r["slice"] + 1) * len(part)] = part
    return out, sum(r["total"] for r in rows)


def costs(sets: DataFrame, hot: int = HOT) -> Costs:
    cells = 1 << CELL_BITS

    def add(total: np.ndarray, h: np.ndarray, first: np.ndarray) -> None:
        for part in memberships(h, first):
            np.add.at(total, (part.S & _CELL).astype(np.int64), np.uint32(1))

    def merge(held: np.ndarray | None, x: np.ndarray) -> np.ndarray:
        x = _EIGHTHS[x]
        return x if held is None else held + x

    table, total = _sliced(sets, np.zeros(cells, np.uint32), add, eighths, merge)
    return Costs(table, max(1.0, total / cells), hot)


def asked(sets: DataFrame, shared: Broadcast) -> np.ndarray:
    """Two tables of a bit for each of 2**CELL_BITS cells: subsets that are looked up among
    neighbourhoods, so that only those are indexed; and among the signatures that are dealt
    out those that anybody looks up."""

    def add(total: np.ndarray, h: np.ndarray, first: np.ndarray) -> None:
        for part in memberships(h, first):
            level = part.levels(shared.value)
            for table, sig in ((0, part.S[level == 2]), (1, part.S[level > 0]), (1, part.D[level[part.of] == 2])):
                byte, bit = _place(sig if table == 0 else sig[shared.value.shares(sig) > 1], table)
                np.bitwise_or.at(total, byte, bit)

    def merge(held: np.ndarray | None, x: np.ndarray) -> np.ndarray:
        return x if held is None else held | x

    return _sliced(sets, np.zeros(2 << (CELL_BITS - 3), np.uint8), add, lambda x: x, merge)[0]


def _place(sig: np.ndarray, table: int) -> tuple[np.ndarray, np.ndarray]:
    """(byte, bit) of signatures in a table of asked()."""
    cell = (sig >> np.uint64(64 - CELL_BITS)).astype(np.int64) + (table << CELL_BITS)
    return cell >> 3, np.left_shift(1, cell & 7).astype(np.uint8)


def entries(h: np.ndarray, first: np.ndarray, costs: Costs, wanted: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(documents, signatures, flags): the index and the look-ups of the sets of a block.
    Flags: the level of a subset; 4 for a neighbourhood, and 2 more if it looks up subsets."""

    def known(sig: np.ndarray, table: int) -> np.ndarray:
        byte, bit = _place(sig, table)
        return (wanted[byte] & bit) > 0

    for part in memberships(h, first):
        level = part.levels(costs).astype(np.uint64)
        some = (level > 0) | (costs.shares(part.S) == 1) | known(part.S, 1)
        yield part.docs[np.flatnonzero(some) // part.m], part.S[some], level[some]
        asks = level[part.of] == 2
        some = asks | (known(part.D, 0) & ((costs.shares(part.D) == 1) | known(part.D, 1)))
        if some.any():
            yield part.docs[part.of[some] // part.m], part.D[some], np.where(asks[some], np.uint64(6), np.uint64(4))


def packed_entries(sets: DataFrame, shared: Broadcast, parts: int) -> DataFrame:
    """(part, low, high, class, n, times): entries of one part in the order of their
    classes, SIG_BITS of each signature and the flags; class and n repeat as often as
    times says."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0
        known, wanted = shared.value

        def flush() -> pa.RecordBatch:
            cls, n, sig, flag = (np.concatenate(x) for x in zip(*held, strict=True))
            salt = np.mod(cls, known.shares(sig)).astype(np.uint64)
            part = (((sig >> np.uint64(SIG_BITS)) + salt) % np.uint64(parts)).astype(np.uint32 if parts >> 16 else np.uint16)
            word = ((sig & _LOW) << np.uint64(3)) | flag
            by = np.lexsort((cls, part))
            cls, n, word, part = cls[by], n[by], word[by], part[by]
            ends = np.searchsorted(part, np.arange(parts + 1))
            out = []
            for p in range(parts):
                a, b = ends[p], ends[p + 1]
                if a < b:
                    new = np.flatnonzero(np.append(True, cls[a + 1 : b] != cls[a : b - 1]))
                    out.append((p, word[a:b].astype(np.uint32).tobytes(), (word[a:b] >> np.uint64(32)).astype(np.uint8).tobytes(), cls[a:b][new].tobytes(), n[a:b][new].astype(np.int32).tobytes(), np.diff(np.append(new, b - a)).astype(np.uint16 if b - a < 1 << 16 else np.int32).tobytes()))
            names = ["part", "low", "high", "class", "n", "times"]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=names)

        for batch in batches:
            cls = batch.column(1).to_numpy()
            for a, _, h, first in set_blocks(batch.column(0)):
                for doc, sig, flag in entries(h, first, known, wanted):
                    held.append((cls[a + doc], np.diff(first)[doc].astype(np.int32), sig, flag))
                    size += len(sig)
                if size >= 1 << 19:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return sets.mapInArrow(run, "part long, low binary, high binary, class binary, n binary, times binary")


def candidates(packed: DataFrame, shared: Broadcast, parts: int) -> DataFrame:
    """(bucket, a, b, na, nb, asks): candidate pairs (bucket null), and the members of every
    signature that more than two classes have, or that was dealt out (b null). asks: 1
    for members that look the signature up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[int, list] = {}
        known = shared.value[0]
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                groups.setdefault(row[0], []).append(row[1:])
        while groups:
            part, rows = groups.popitem()
            word = np.concatenate([np.frombuffer(r[0], np.uint32).astype(np.uint64) | (np.frombuffer(r[1], np.uint8).astype(np.uint64) << np.uint64(32)) for r in rows])
            sizes = [len(r[0]) // 4 for r in rows]
            times = [np.frombuffer(r[4], np.uint16 if size < 1 << 16 else np.int32) for r, size in zip(rows, sizes, strict=True)]
            cls = np.concatenate([np.repeat(np.frombuffer(r[2], np.int64), t) for r, t in zip(rows, times, strict=True)])
            n = np.concatenate([np.repeat(np.frombuffer(r[3], np.int32), t) for r, t in zip(rows, times, strict=True)])
            del rows, times
            by = np.argsort(word)
            sig = word[by] >> np.uint64(3)
            hot = known.shares(sig) > 1  # cells are lower bits of what is left of a signature
            again = sig[1:] == sig[:-1]
            some = np.append(False, again) | np.append(again, False) | hot
            by, sig, hot = by[some], sig[some], hot[some]
            cls, n, flag = cls[by], n[by].astype(np.int64), (word[by] & np.uint64(7)).astype(np.int64)
            del word

            def groups_of(sig: np.ndarray) -> np.ndarray:
                new = np.append(True, sig[1:] != sig[:-1]) if len(sig) else np.zeros(0, bool)
                return np.cumsum(new) - 1

            # neighbourhoods count where some subset is looked up among them, or they look up subsets
            group = groups_of(sig)
            deep = np.bincount(group, (flag & 3) == 2) > 0 if len(group) else np.zeros(0, bool)
            keep = (flag < 4) | deep[group] | hot
            sig, cls, n, flag, hot = sig[keep], cls[keep], n[keep], flag[keep], hot[keep]
            asks = (flag & 3) > 0
            by = np.lexsort((cls, ~asks, sig))
            sig, cls, n, asks, hot = sig[by], cls[by], n[by], asks[by], hot[by]
            once = np.append(True, (sig[1:] != sig[:-1]) | (cls[1:] != cls[:-1])) if len(sig) else np.zeros(0, bool)
            sig, cls, n, asks, hot = sig[once], cls[once], n[once], asks[once], hot[once]
            group = groups_of(sig)
            sizes = np.bincount(group)
            first = np.cumsum(sizes) - sizes
            good = (((sizes > 1) & asks[first])[group] | hot) if len(group) else np.zeros(0, bool)
            centre = first[group]
            j = np.flatnonzero(good & asks[centre] & (centre < np.arange(len(sig))))
            i = centre[j]
            near = (n[i] * 4 >= n[j] * 3) & (n[j] * 4 >= n[i] * 3)
            i, j = i[near], j[near]
            names = ["bucket", "a", "b", "na", "nb", "asks"]
            swap = cls[i] > cls[j]
            i, j = np.where(swap, j, i), np.where(swap, i, j)
            pairs = np.unique(np.stack([cls[i], cls[j], n[i], n[j]]), axis=1) if len(i) else np.zeros((4, 0), np.int64)
            none = pa.nulls(pairs.shape[1], pa.int64())
            yield pa.RecordBatch.from_arrays([none, *(pa.array(x) for x in pairs), none], names=names)
            many = good & ((sizes > 2)[group] | hot)
            bucket = np.where(hot[many], -1 - sig[many].astype(np.int64), sig[many].astype(np.int64) * parts + part)
            none = pa.nulls(len(bucket), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(cls[many]), none, pa.array(n[many]), none, pa.array(asks[many].astype(np.int64))], names=names)

    tasks = partitions(packed.sparkSession)  # a task holds its parts packed, and works on one after the other
    return packed.repartitionById(tasks, (F.col("part") % tasks).cast("int")).mapInArrow(run, "bucket long, a long, b long, na long, nb long, asks long")


def sets_for(docs: DataFrame, classes: DataFrame, rows: DataFrame) -> DataFrame:
    """(class, set) of the given classes, from texts. The documents are first thinned by a
    bitmap of 2**21 cells of the texts' hashes, of which the driver sees 65 rows, so that
    few other texts are shuffled."""
    bits, key = 21, F.col("key").bitwiseAND(F.lit((1 << 21) - 1))
    wanted = staged(rows.where("set is not null").select("class", "key").join(classes.hint("merge"), "class").groupBy("class").agg(F.min("key").alias("key")), "wanted")
    cells = wanted.select(key.alias("c")).groupBy(F.bitmap_bucket_number("c").alias("at")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("c")).alias("bits"))
    known = np.zeros(((1 << bits) // 32768 + 2, 4096), np.uint8)
    for r in cells.collect():
        known[r["at"]] = np.frombuffer(r["bits"], np.uint8)

    def thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = batch.column(1).to_numpy() & ((1 << bits) - 1)
            # bucket k holds the cells from (k - 1) * 32768 + 1 on; cell 0 is in bucket 0
            at, place = np.where(c > 0, 1 + (c - 1) // 32768, 0), np.where(c > 0, (c - 1) % 32768, 0)
            yield batch.filter(pa.array(((known[at, place >> 3] >> (place & 7)) & 1).astype(bool)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = {0}
        for batch in batches:
            for _, _, h, first in sets_of(batch.column(0)):
                cls = class_ids(h, first).tolist()
                new = [d for d, c in enumerate(cls) if c not in seen and not seen.add(c)]
                yield pa.RecordBatch.from_arrays([pa.array([cls[d] for d in new], pa.int64()), pa.array([h[first[d] : first[d + 1]].tobytes() for d in new], pa.binary())], names=["class", "set"])

    near = docs.select("text", F.xxhash64("text").alias("key")).mapInArrow(thin, "text string, key long")
    sets = near.join(wanted.select("key").hint("merge"), "key", "left_semi").select("text").mapInArrow(run, "class long, set binary")
    out = staged(sets.dropDuplicates(["class"]), "sets")
    discard(wanted)
    return out


def screened(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """The pairs (a, b) that their parity arrays don't rule out: no link is lost."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y, n1, n2 in zip(batch.column(2), batch.column(3), batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint8), np.frombuffer(y.as_buffer(), np.uint8)
                size = min(len(x), len(y))
                x, y = fold(x, size), fold(y, size)
                good.append(int(np.bitwise_count(x ^ y).sum()) <= (n1 + n2) // 7)
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

    one = reps.select("class", "parity", "n").hint("merge")
    left = pairs.select("a", "b").join(one.toDF("a", "x", "n1"), "a")
    return left.join(one.toDF("b", "y", "n2"), "b").select("a", "b", "x", "y", "n1", "n2").mapInArrow(run, "a long, b long")


def verified(pairs: DataFrame, docs: DataFrame, rows: DataFrame, reps: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                good.append(bool(linked(int(hits(x, y).sum()), len(x), len(y))))
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

    close = staged(screened(pairs, reps), "close")
    if close.isEmpty():
        return close
    classes = close.select(F.col("a").alias("class")).unionByName(close.select(F.col("b").alias("class"))).distinct()
    sets = sets_for(docs, classes, rows)
    left = close.join(sets.toDF("a", "x").hint("merge"), "a")
    out = staged(left.join(sets.toDF("b", "y").hint("merge"), "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long"), "links")
    discard(close, sets)
    return out


def distinct_buckets(members: DataFrame) -> DataFrame:
    """members (bucket, node, n, asks) with one bucket of those that have the same members,
    as a passage or a group of near copies gives many of. A member of it asks if it does
    in any of them."""
    content = members.groupBy("bucket").agg(F.count("*").alias("size"), F.expr("bit_xor(xxhash64(node))").alias("x"), F.expr("bit_xor(xxhash64(node, 7))").alias("y")).where("size > 1")
    one = content.select("bucket", F.xxhash64("size", "x", "y").alias("same"))
    return staged(members.join(one.hint("merge"), "bucket").groupBy(F.col("same").alias("bucket"), "node").agg(F.max("n").alias("n"), F.max("asks").alias("asks")), "members")


def open_members(members: DataFrame, roots: DataFrame) -> DataFrame:
    """(bucket, node, n, asks, root) of buckets whose members lie in several components."""
    placed = members.join(roots.hint("merge"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed = placed.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.max("asks").alias("some")).where("lo <> hi and some = 1").select("bucket")
    return staged(placed.join(mixed.hint("merge"), "bucket").select("bucket", "node", "n", "asks", "root"), "open")


def block_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each value of the first three columns, one after the other, from batches
    that are sorted by them."""
    now, held = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.stack([batch.column(i).to_numpy() for i in range(3)])
        cuts = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
        for s, e in zip(cuts[:-1], cuts[1:], strict=True):
            this = tuple(key[:, s].tolist())
            if held and this != now:
                yield pa.Table.from_batches(held)
                held = []
            now = this
            held.append(batch.slice(s, e - s))
    if held:
        yield pa.Table.from_batches(held)


def _in_blocks(placed: DataFrame, with_: DataFrame, column: str, block: int) -> DataFrame:
    """(bucket, lo, hi, own, node, n, asks, root, column) sorted by the first three: the members
    of every bucket dealt into blocks of about `block`, once for each two blocks."""
    blocks = placed.groupBy("bucket").agg(F.ceil(F.count("*") / block).cast("long").alias("blocks"))
    rows = placed.join(blocks.hint("merge"), "bucket").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    rows = rows.select("bucket", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "node", "n", "asks", "root")
    rows = rows.join(with_.select(F.col("class").alias("node"), column).hint("merge"), "node").select("bucket", "lo", "hi", "own", "node", "n", "asks", "root", column)
    keys = ["bucket", "lo", "hi"]
    return rows.repartition(partitions(placed.sparkSession), *keys).sortWithinPartitions(*keys)


def _open_pairs(rows: pa.Table, bits: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers of the pairs of two blocks, one of which asks, in different components, that
    their parity arrays (bits) don't rule out; a bounded number at a time."""
    own, n, asks, root = (rows.column(c).to_numpy() for c in ("own", "n", "asks", "root"))
    low, high = rows.column("lo")[0].as_py(), rows.column("hi")[0].as_py()
    left, right = np.flatnonzero(own == low), np.flatnonzero(own == high)
    step = max(1, (1 << 19) // max(1, len(right) * bits.shape[1]))
    for a in range(0, len(left), step):
        i = left[a : a + step, None]
        good = (root[right] != root[i]) & ((asks[right] | asks[i]) > 0) & (n[right] * 4 >= n[i] * 3) & (n[i] * 4 >= n[right] * 3)
        if low == high:
            good &= right > i
        x, y = np.nonzero(good)
        x, y = i[x, 0], right[y]
        close = np.bitwise_count(bits[x] ^ bits[y]).sum(axis=1) <= (n[x] + n[y]) // 7
        if close.any():
            yield x[close], y[close]


def _folded(arrays: list[np.ndarray]) -> np.ndarray:
    size = min(map(len, arrays))
    return np.stack([x if len(x) == size else fold(x, size) for x in arrays]).view(np.uint64)


def near_members(placed: DataFrame, reps: DataFrame, block: int = BLOCK) -> DataFrame:
    """(bucket, node) of the members that some other of the bucket may link with, by their
    parity arrays; every two blocks of a bucket are compared in one place, and no pair is
    put out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in block_runs(batches):
            found = np.zeros(rows.num_rows, bool)
            for x, y in _open_pairs(rows, _folded([np.frombuffer(x.as_buffer(), np.uint8) for x in rows.column("parity")])):
                found[x] = found[y] = True
            if found.any():
                yield rows.select(["bucket", "node"]).filter(pa.array(found)).combine_chunks().to_batches()[0]

    near = _in_blocks(placed, reps, "parity", block).mapInArrow(run, "bucket long, node long").distinct()
    return placed.join(near.hint("merge"), ["bucket", "node"]).select("bucket", "node", "n", "asks")


def links_within(near: DataFrame, sets: DataFrame, block: int = BLOCK) -> DataFrame:
    """(a, b): for every two blocks of a bucket links that join all that any of their links
    do, verified on the sets. Pairs that links found before already join are not looked
    at again, so no more come out than there are members."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in block_runs(batches):
            node = rows.column("node").to_numpy()
            own = [np.frombuffer(x.as_buffer(), np.uint64) for x in rows.column("set")]
            root = np.unique(rows.column("root").to_numpy(), return_inverse=True)[1]
            out = []
            for x, y in _open_pairs(rows, _folded([np.frombuffer(parity(h), np.uint8) for h in own])):
                for i, j in zip(x.tolist(), y.tolist(), strict=True):
                    if root[i] != root[j] and linked(int(hits(own[i], own[j]).sum()), len(own[i]), len(own[j])):
                        root[root == root[j]] = root[i]
                        out.append((node[i], node[j]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["a", "b"])

    return staged(_in_blocks(near, sets, "set", block).mapInArrow(run, "a long, b long"), "links")


def linked_classes(docs: DataFrame, rows: DataFrame, hot: int = HOT, block: int = BLOCK) -> DataFrame:
    """(node, root) of every class that links with another; rows: set_rows(docs), stored."""
    spark = rows.sparkSession
    parts = 4 * partitions(spark)
    filled = rows.where("set is not null")
    known = costs(filled.select("set"), hot)
    shared = spark.sparkContext.broadcast(known)  # four megabytes
    wanted = asked(filled.select("set"), shared)
    shared.destroy()
    shared = spark.sparkContext.broadcast((known, wanted))  # five megabytes
    found = staged(candidates(packed_entries(filled.select("set", "class"), shared, parts), shared, parts), "candidates")
    shared.destroy()
    reps = staged(filled.groupBy("class").agg(F.max("n_shingles").alias("n"), F.max("parity").alias("parity")), "classes")
    tried = staged(found.where("bucket is null").select("a", "b").distinct(), "pairs")
    roots = components(verified(tried, docs, rows, reps))
    placed = open_members(distinct_buckets(found.where("bucket is not null").select("bucket", F.col("a").alias("node"), F.col("na").alias("n"), "asks")), roots)
    near = open_members(distinct_buckets(near_members(placed, reps, block)), roots)
    discard(found, reps, tried, placed)
    if near.isEmpty():
        return roots
    sets = sets_for(docs, near.select(F.col("node").alias("class")).distinct(), rows)
    more = links_within(near, sets, block)
    discard(near, sets)
    stars = roots.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))
    return components(stars.unionByName(more))


def rooted(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """A stored table of rows without their sets, with root: the same for all of a component,
    null for empty sets."""
    counts = rows.where("class <> 0").groupBy("class").agg(F.count("*").alias("n"))
    known = counts.join(roots.select(F.col("node").alias("class"), "root").hint("merge"), "class", "left").where("root is not null or n > 1")
    known = staged(known.select("class", "n", F.coalesce("root", "class").alias("root")), "known")
    out = rows.drop("parity", "set").withColumn("class", F.when(F.col("class") != 0, F.col("class")))
    out = spread_join(out, known, "class").withColumn("root", F.coalesce("found.root", "class")).drop("found")
    placed = staged(out, "placed")
    discard(known)
    return placed


def _placed(docs: DataFrame, hot: int = HOT, block: int = BLOCK) -> DataFrame:
    """doc_id, key, n_shingles, class, root of every row."""
    with small_batches(docs.sparkSession):
        rows = staged(set_rows(docs), "sets")
        placed = rooted(rows, linked_classes(docs, rows, hot, block))
        discard(rows)
        return placed


def jaccard_join(docs: DataFrame, hot: int = HOT, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs."""
    placed = _placed(docs, hot, block)
    least = placed.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("n")).where("n > 1")
    joined = spread_join(placed, staged(least, "least"), "root")
    return joined.select("doc_id", "n_shingles", F.coalesce("found.component_id", "doc_id").alias("component_id"))


def keep_representatives(docs: DataFrame) -> DataFrame:
    """docs with one row of each component: one with its smallest doc_id (nulls last), of
    several such rows one of those with the smallest hash of the text. A row goes only by
    its own component, whatever other rows share its doc_id; rows that link with nothing
    stay, equal texts of one doc_id once. Rows with empty sets all stay."""
    placed = _placed(docs).where("root is not null")
    own = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")
    best = placed.groupBy("root").agg(F.min(own).alias("best"), F.count("*").alias("n")).where("n > 1")
    judged = spread_join(placed, staged(best, "best"), "root").where("found is not null").select(own.alias("own"), F.col("found.best").alias("best"))
    names = {x: unused(docs, x) for x in ("id", "key", "row")}
    gone = judged.where("own <> best").select(F.col("own.doc_id").alias(names["id"]), F.col("own.key").alias(names["key"])).distinct()
    keyed = docs.withColumn(names["row"], F.xxhash64("text"))
    same = keyed["doc_id"].eqNullSafe(gone[names["id"]]) & (keyed[names["row"]] == gone[names["key"]])
    kept = keyed.join(gone, same, "left_anti")
    again = judged.where("own = best").groupBy("own").agg(F.count("*").alias("n")).where("n > 1").select(F.col("own.doc_id").alias(names["id"]), F.col("own.key").alias(names["key"]))
    if again.isEmpty():
        return kept.select(*docs.columns)
    same = kept["doc_id"].eqNullSafe(again[names["id"]]) & (kept[names["row"]] == again[names["key"]])
    once = kept.join(again, same, "left_semi").dropDuplicates(["doc_id", names["row"]])
    return kept.join(again, same, "left_anti").unionByName(once).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents"))
