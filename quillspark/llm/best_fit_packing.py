"""Best-fit packing of token sequences by bin completion.

Texts are tokenised once; only documents longer than a sequence are cut, into pieces of
full length after a first shorter one. The packing problem depends on the pieces only
through how many there are of each length, so it is planned on that histogram (2048
counts at any corpus size): bin completion takes the longest piece left, enumerates the
undominated fillings of the room beside it, prunes by the waste that the best plan so
far still allows, and takes best-fit decreasing of what is left as an incumbent at every
node. A filling is tried with as many copies as the pieces allow, then with one. The
search ends when the incumbent meets the lower bound, or after `nodes` nodes (the one limit
of the search, a parameter; by default EFFORT over the number of lengths that are there, as
a node costs that much) with the best plan found; every piece is packed either way. gap() tells how far a plan is from the lower bound.

The plan is a list of fillings with multiplicities. Pieces of one length are ranked
(salted, so that a length that a third of all pieces have is split over many tasks) and
look up their sequence and offset by rank. No text or token moves in a shuffle.

Defined results: a null or empty text is the one token 0; repeated rows are packed each;
an empty table packs nothing; further columns are ignored.
"""

from __future__ import annotations

import base64
import bisect
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.llm._shared import schema_of, staged, table

CAPACITY = 2048
END = 0
#: Lengths that the nodes of a search go over in all, some ten seconds on one core at most.
EFFORT = 500_000
Plan = list[tuple[tuple[tuple[int, int], ...], int]]  # (((length, copies), ...), times)


@lru_cache(maxsize=4)
def encoder(path: str):
    """texts -> lists of ids. The byte-level vocabulary file is read by the faster of
    two libraries where its ranks lie beside it; both give the same ids."""
    ranks = path.removesuffix(".json") + ".tiktoken"
    try:
        import public_tokenizers
        import tiktoken

        with open(ranks, "rb") as f:
            merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        coder = tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens={})
        return lambda texts: [coder.encode_ordinary(t) for t in texts]
    except (ImportError, OSError):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = True
        return lambda texts: [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids) for every piece of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in batches:
            texts = batch.column(1)
            for a in range(0, batch.num_rows, 64):
                at, piece, start, length, crc, kept = [], [], [], [], [], []
                for i, ids in enumerate(encode([t or "" for t in texts.slice(a, 64).to_pylist()]), a):
                    ids = np.array([*ids, END], "<u4")
                    ends = range(len(ids), 0, -capacity)
                    for k, e in enumerate(reversed(ends)):
                        s = max(0, e - capacity)
                        at.append(i)
                        piece.append(k)
                        start.append(s)
                        length.append(e - s)
                        crc.append(zlib.crc32(ids[s:e].tobytes()))
                        if with_ids:
                            kept.append(ids[s:e].astype(np.int32))
                columns = [batch.column(0).take(pa.array(at, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                yield pa.RecordBatch.from_arrays([*columns, *([pa.array(kept, pa.list_(pa.int32()))] if with_ids else [])], names=[*names, *["ids"] * with_ids])

    return docs.select("doc_id", "text").mapInArrow(run, f"{schema_of(docs, 'doc_id')}, piece int, start long, length long, ids_crc32 long{', ids array<int>' if with_ids else ''}")


def best_fit(hist: dict[int, int], capacity: int) -> Plan:
    """Best-fit decreasing, for all pieces of a length at once: each goes where it leaves
    least room, so a bin takes as many copies as it holds before the next one does."""
    bins: dict[int, list[tuple[tuple[tuple[int, int], ...], int]]] = {}
    rooms: list[int] = []

    def put(room: int, filling, times: int) -> None:
        if times:
            if room not in bins:
                bisect.insort(rooms, room)
                bins[room] = []
            bins[room].append((filling, times))

    for length in sorted(hist, reverse=True):
        left = hist[length]
        while left:
            i = bisect.bisect_left(rooms, length)
            if i == len(rooms):
                room, filling, times = capacity, (), left
            else:
                room = rooms[i]
                filling, times = bins[room].pop()
                if not bins[room]:
                    del bins[room], rooms[i]
            each = room // length
            full = min(times, left // each)
            put(room - each * length, (*filling, (length, each)), full)
            left -= full * each
            times -= full
            if left and times:  # the last of them, with fewer copies
                put(room - left * length, (*filling, (length, left)), 1)
                left, times = 0, times - 1
            if filling:
                put(room, filling, times)
    return [x for group in bins.values() for x in group]


def size(plan: Plan) -> int:
    return sum(times for _, times in plan)


def lower_bound(hist: dict[int, int], capacity: int) -> int:
    """Martello and Toth's L2: the most bins that any split into large, medium and small
    pieces proves to be needed."""
    lengths = np.array(sorted(hist, reverse=True), np.int64)
    if not len(lengths):
        return 0
    counts = np.array([hist[x] for x in lengths], np.int64)
    n, total = np.concatenate([[0], np.cumsum(counts)]), np.concatenate([[0], np.cumsum(counts * lengths)])

    def over(x: np.ndarray | int) -> np.ndarray:  # how many lengths exceed x
        return len(lengths) - np.searchsorted(lengths[::-1], x, "right")

    small = np.unique(np.append(lengths[lengths <= capacity // 2], 0))
    a, b = over(capacity - small), int(over(capacity // 2))
    c = np.where(small > 0, over(small - 1), len(lengths))
    a = np.minimum(a, b)
    free = (n[b] - n[a]) * capacity - (total[b] - total[a])
    rest = np.maximum(0, total[np.maximum(c, b)] - total[b] - free)
    return int((n[b] + -(-rest // capacity)).max())


def _fits(inner: tuple[int, ...], outer: tuple[int, ...]) -> bool:
    """Whether first-fit decreasing packs the pieces inner into bins of the sizes outer;
    then outer dominates: the bins it is taken from could exchange one for the other."""
    rooms = list(outer)
    for x in inner:
        at = next((i for i, room in enumerate(rooms) if room >= x), None)
        if at is None:
            return False
        rooms[at] -= x
    return True


def fillings(hist: dict[int, int], room: int, waste: int) -> Iterator[tuple[int, ...]]:
    """All sets of pieces that leave at most `waste` of the room free and that no set
    before dominates, best fit first and among equal ones long pieces first. The sums that
    the shorter lengths can reach (bit sets) keep the enumeration from dead ends."""
    lengths = sorted((x for x in hist if x <= room), reverse=True)
    mask = (1 << (room + 1)) - 1
    reach = [1] * (len(lengths) + 1)  # reach[i]: sums of pieces of lengths[i:]
    for i in range(len(lengths) - 1, -1, -1):
        sums, left, step = reach[i + 1], min(hist[lengths[i]], room // lengths[i]), 1
        while left:
            take = min(step, left)
            sums |= (sums << (take * lengths[i])) & mask
            left -= take
            step *= 2
        reach[i] = sums

    def exact(i: int, total: int) -> Iterator[tuple[int, ...]]:
        if not total:
            yield ()
            return
        for j in range(i, len(lengths)):
            x = lengths[j]
            if not reach[j] >> total & 1:
                return
            for copies in range(min(hist[x], total // x), 0, -1):
                if reach[j + 1] >> (total - copies * x) & 1:
                    for rest in exact(j + 1, total - copies * x):
                        yield (x,) * copies + rest

    kept: list[tuple[int, ...]] = []
    for free in range(min(waste, room) + 1):
        if reach[0] >> (room - free) & 1:
            for f in exact(0, room - free):
                if not any(_fits(f, g) for g in kept):
                    kept.append(f)
                    yield f


def in_lots(make: Callable[[], Iterator]) -> Iterator:
    """The items of make(), which is called anew for each lot, so that nothing but the lot is held while
    its items are in use. Lots double, so all calls together make few items twice."""
    first, lot = 0, 1
    while found := list(islice(make(), first, first + lot)):
        yield from found
        if len(found) < lot:
            return
        first, lot = first + lot, 2 * lot


def plan_bins(hist: dict[int, int], capacity: int = CAPACITY, nodes: int | None = None) -> Plan:
    """Fillings with multiplicities that hold all pieces in as few bins as was found in
    `nodes` nodes of the search; None: as many as EFFORT allows."""
    hist = {x: n for x, n in hist.items() if n}
    best = best_fit(hist, capacity)
    bound, total = lower_bound(hist, capacity), sum(x * n for x, n in hist.items())
    spent = 0
    nodes = nodes or EFFORT // (50 + len(hist))

    def search(left: dict[int, int], done: Plan, used: int, wasted: int) -> None:
        nonlocal best, spent
        spent += 1
        rest = best_fit(left, capacity)
        if used + size(rest) < size(best):
            best = [*done, *rest]
        del rest  # a path holds as little as it can: there are hundreds of nodes on it
        if not left or size(best) == bound or spent > nodes or used + lower_bound(left, capacity) >= size(best):
            return
        longest = max(left)
        waste = (size(best) - 1) * capacity - total - wasted

        def beside() -> Iterator[tuple[int, ...]]:
            return fillings({x: n - (x == longest) for x, n in left.items() if n - (x == longest)}, capacity - longest, waste)

        for f in in_lots(beside):
            need: dict[int, int] = {}
            for x in (longest, *f):
                need[x] = need.get(x, 0) + 1
            free = capacity - longest - sum(f)
            most = min(left[x] // k for x, k in need.items())
            for times in dict.fromkeys((most, 1)):
                if wasted + times * free <= (size(best) - 1) * capacity - total:
                    search({x: n - times * need[x] if x in need else n for x, n in left.items() if n != times * need.get(x, 0)}, [*done, (tuple(sorted(need.items(), reverse=True)), times)], used + times, wasted + times * free)
                if size(best) == bound or spent > nodes:
                    return

    if size(best) > bound:
        search(hist, [], 0, 0)
    return best


def gap(plan: Plan, capacity: int = CAPACITY) -> int:
    """By how many bins the plan exceeds the lower bound of what it packs."""
    hist: dict[int, int] = {}
    for filling, times in plan:
        for length, copies in filling:
            hist[length] = hist.get(length, 0) + copies * times
    return size(plan) - lower_bound(hist, capacity)


def runs(plan: Plan) -> np.ndarray:
    """[length, first rank, first sequence, offset] sorted: pieces of a length with ranks
    from the first on lie at that offset of consecutive sequences. As many rows as the
    plan has pieces in its fillings, whatever the number of documents."""
    out, ranks, sequence = [], {}, 0
    for filling, times in plan:
        offset = 0
        for length, copies in filling:
            for _ in range(copies):
                rank = ranks.get(length, 0)
                out.append((length, rank, sequence, offset))
                ranks[length] = rank + times
                offset += length
        sequence += times
    return np.array(sorted(out), np.int64).reshape(-1, 4)


def pack(parts: DataFrame, capacity: int = CAPACITY, rows_per_task: int = 200_000) -> DataFrame:
    """parts (doc_id, piece, length, ids_crc32, row, ...) with sequence_id and offset, without
    row, a number that no two rows share. parts is read several times: hand over a stored
    table."""
    hist = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.count("*").alias("n")).collect()}
    table_ = runs(plan_bins(hist, capacity))
    salts = max(1, sum(hist.values()) // rows_per_task)
    salted = parts.withColumn("__salt", F.pmod(F.xxhash64("row"), F.lit(salts)))
    counts = salted.groupBy("length", "__salt").agg(F.count("*").alias("__n"))
    before = counts.withColumn("__before", F.sum("__n").over(Window.partitionBy("length").orderBy("__salt")) - F.col("__n")).drop("__n")
    place = F.row_number().over(Window.partitionBy("length", "__salt").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = salted.withColumn("__place", place).join(before, ["length", "__salt"])
    ranked = ranked.withColumn("__rank", F.col("__before") + F.col("__place"))
    shared = parts.sparkSession.sparkContext.broadcast(table_)
    names = [c for c in parts.columns if c != "row"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = shared.value
        keys = (t[:, 0] << 48) + t[:, 1]
        for batch in batches:
            length, rank = batch.column(batch.schema.names.index("length")).to_numpy(), batch.column(batch.schema.names.index("__rank")).to_numpy()
            at = np.searchsorted(keys, (length << 48) + rank, "right") - 1
            columns = [batch.column(batch.schema.names.index(n)) for n in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(t[at, 2] + rank - t[at, 1]), pa.array(t[at, 3])], names=[*names, "sequence_id", "offset"])

    return ranked.mapInArrow(run, f"{schema_of(parts, *names)}, sequence_id long, offset long")


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id and ids of every sequence, from pieces packed with their ids."""
    rows = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    return rows.select("sequence_id", F.flatten(F.transform("p", lambda x: x["ids"])).alias("ids"))


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    found = pieces(docs, path or tokenizer_path(), capacity, with_ids)
    return pack(staged(found.withColumn("row", F.monotonically_increasing_id()), "pieces"), capacity)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pack_documents(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
