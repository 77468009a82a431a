"""Mining of phrase collocations by pivot partitioning, as in MG-FSM.

Texts are lower-cased (A-Z), cut into pieces at punctuation and line ends, and pieces into words.
Everything is counted by language: the identity of a word holds its language. A phrase of two
to `longest` words that occurs `least` times is a candidate; its score compares it with its two
parts at the weakest cut, and phrases that occur only inside a longer one are dropped.

Words are ordered by frequency. The pivot of a phrase is its rarest word (of equal words the
first), and only the partition of that word counts the phrase. For every word of a piece its
fragment is made: the run around it of words that are not rarer (before it: more frequent), at
most longest - 1 to either side; words under the least count end a run. So a fragment holds
every phrase that its pivot owns there, each occurrence is counted once, and frequent pivots,
which have the most fragments, have the shortest ones over the fewest words. Fragments go to
the buckets of their pivots as packed arrays; a bucket counts level by level, from two words on,
and extends only what is frequent. It puts out phrases of its own pivots that reach the least
count. Pivots with more fragments than a bucket takes are dealt out over several buckets, which
then put out all counts for them; these are added up behind map-side combining.

The most frequent `dictionary` words have their rank as an id; a rarer frequent word is sent as
its hash and found by a bitmap, where a false hit costs a look at it and changes no result. So what
is broadcast has a bound at any size of the vocabulary. Scores use exact decimals. Ranks are
cut by language within salted groups first, so no task ranks a whole language.

Defined results: a null or empty text has no words, a null language is `und`; rows count as often
as they are there, with or without doc_id; a piece without words and one of any length are as
they are; an empty table gives an empty table; further columns are ignored. Words are told
apart by 63-bit hashes of their language and bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.llm._shared import partitions, spread_join, staged, table
from quillspark.llm._words import mix, text_blocks, words_of

LONGEST, LEAST, TOP = 5, 100, 2000
#: Words with ranks for ids; bits of the bitmap of the others; fragments of a bucket, and of a task's parcel.
DICTIONARY, BITMAP, BUCKET, PARCEL = 1 << 21, 1 << 26, 1 << 20, 1 << 20
UNKNOWN = "und"
_BREAK = 10
_BLANK = np.uint64((1 << 64) - 1)
_RARE, _HASH = np.uint64(1 << 63), np.uint64((1 << 63) - 1)
#: Bytes as they are read: capitals lowered, what ends a piece as line ends.
_READ = np.arange(256, dtype=np.uint8)
_READ[65:91] += 32
_READ[[*b".,;:!?", 10, 11, 12, 13]] = _BREAK


@dataclass
class Block:
    """Words of a block of rows: hashes with their language, row, number of the piece, bytes."""

    hashes: np.ndarray
    row: np.ndarray
    piece: np.ndarray
    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray


def blocks(texts: pa.Array, langs: np.ndarray) -> Iterator[Block]:
    """langs: the hash of every row's language."""
    for a, _, data, offsets in text_blocks(texts):
        data = _READ[data]
        words = words_of(data, offsets)
        row = words.doc
        ends_piece = np.zeros(len(data) + 1, np.int64)
        np.cumsum(data == _BREAK, out=ends_piece[1:])
        piece = ends_piece[words.starts] + row  # rows end pieces too
        yield Block(mix(words.hashes + langs[a + row]) & _HASH, a + row, piece, data, words.starts, words.ends)


def _langs(column: pa.Array) -> np.ndarray:
    return mix(column.to_numpy(zero_copy_only=False).view(np.uint64).copy())


def _read(docs: DataFrame) -> DataFrame:
    lang = F.coalesce("lang", F.lit(UNKNOWN))
    return docs.select("text", lang.alias("lang"), F.xxhash64(lang).alias("lang_hash"))


def word_counts(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(hash, lang, word, n) of the words that occur least times, and a row with the hash 0 and no
    word for each language: all its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def merged() -> pa.Table:
            out = pa.concat_tables(held).group_by(["hash", "lang"]).aggregate([("word", "min"), ("n", "sum")])
            return pa.table({"hash": out["hash"], "lang": out["lang"].cast(pa.string()), "word": out["word_min"], "n": out["n_sum"]})

        for batch in batches:
            langs = batch.column(1)
            for block in blocks(batch.column(0), _langs(batch.column(2))):
                found, at, n = np.unique(block.hashes, return_index=True, return_counts=True)
                size = block.ends[at] - block.starts[at]
                flat = np.repeat(block.starts[at] - np.cumsum(size) + size, size) + np.arange(size.sum())
                word = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.py_buffer(block.data[flat].tobytes())])
                held.append(pa.table({"hash": found.view(np.int64), "lang": langs.take(pa.array(block.row[at])), "word": word, "n": n}))
                rows, n = np.unique(block.row, return_counts=True)
                total = pa.table({"lang": langs.take(pa.array(rows)), "n": n}).group_by("lang").aggregate([("n", "sum")])
                none = pa.nulls(total.num_rows, pa.binary())
                held.append(pa.table({"hash": np.zeros(total.num_rows, np.int64), "lang": total["lang"], "word": none, "n": total["n_sum"]}))
            if sum(t.num_rows for t in held) > 1 << 21:
                held = [merged()]
                if held[0].num_rows > 1 << 20:
                    yield from held.pop().to_batches()
        if held:
            yield from merged().to_batches()

    counted = _read(docs).mapInArrow(run, "hash long, lang string, word binary, n long")
    return counted.groupBy("hash", "lang").agg(F.min("word").alias("word"), F.sum("n").alias("n")).where(F.col("word").isNull() | (F.col("n") >= least))


@dataclass
class Dictionary:
    """The frequent words: hashes by rank, the most frequent first; bits of those without a rank;
    hot: in how many buckets each of the first words is dealt out."""

    hashes: np.ndarray
    bitmap: np.ndarray
    hot: np.ndarray
    buckets: int

    def __post_init__(self) -> None:
        self.order = np.argsort(self.hashes)
        self.sorted = self.hashes[self.order]

    def keys(self, hashes: np.ndarray) -> np.ndarray:
        """What words are ordered by: the rank, after all ranks hashes, blanks last."""
        out = np.full(len(hashes), _BLANK)
        known = np.zeros(len(hashes), bool)
        if len(self.sorted):
            at = np.minimum(np.searchsorted(self.sorted, hashes), len(self.sorted) - 1)
            known = self.sorted[at] == hashes
            out[known] = self.order[at[known]].astype(np.uint64)
        if len(self.bitmap):
            other = np.flatnonzero(~known)
            bit = hashes[other] % np.uint64(len(self.bitmap) * 64)
            other = other[self.bitmap[bit >> np.uint64(6)] >> (bit & np.uint64(63)) & np.uint64(1) == 1]
            out[other] = hashes[other] | _RARE
        return out


def dictionary_of(words: DataFrame, n_ranks: int = DICTIONARY, bucket: int = BUCKET, bits: int = BITMAP) -> Dictionary:
    """words: a stored table (hash, word, n). The driver sees n_ranks hashes and the bitmap."""
    words = words.where("word is not null")
    total = words.agg(F.count("*").alias("words"), F.sum("n").alias("n")).first()
    known = words.select("hash", "n").orderBy(F.desc("n"), "hash").limit(n_ranks).toArrow() if total["words"] else pa.table({"hash": pa.array([], pa.int64()), "n": pa.array([], pa.int64())})
    hashes, n = known["hash"].to_numpy().view(np.uint64).copy(), known["n"].to_numpy()
    order = np.lexsort((hashes, -n))
    hashes, n = hashes[order], n[order]
    bitmap = np.zeros(0, np.uint64)
    if total["words"] > n_ranks:
        bitmap = np.zeros(bits // 64, np.uint64)
        # hashes as unsigned numbers modulo the bits, a power of two
        bit = F.col("hash").bitwiseAND(F.lit(bits - 1))
        set_ = words.groupBy(F.shiftright(bit, 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(hash & 63 as int))")).alias("v")).toArrow()
        bitmap[set_["at"].to_numpy()] = set_["v"].to_numpy().view(np.uint64)
    buckets = max(1, partitions(words.sparkSession), -(-(total["n"] or 0) // bucket))
    hot = n[n > bucket]
    return Dictionary(hashes, bitmap, np.minimum(buckets, -(-hot // bucket)), buckets)


def fragments(docs: DataFrame, words: Dictionary, longest: int = LONGEST, parcel: int = PARCEL) -> DataFrame:
    """(bucket, lang, shape, low, high, rare): the fragments of a parcel for a bucket and language.
    shape: a byte for each fragment, the words before the pivot times 16 plus those after it; low
    and high: two bytes each of all their words' ids, where ids from the dictionary's size on are
    places in rare, a list of hashes."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(words)
    reach = longest - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = shared.value
        names: dict[str, int] = {}
        held: list[tuple[np.ndarray, ...]] = []
        task, n_parcels = TaskContext.get().partitionId(), 0

        def cut_block(keys: np.ndarray, piece: np.ndarray, lang: np.ndarray) -> None:
            n = len(keys)
            before, after = np.zeros(n, np.uint8), np.zeros(n, np.uint8)
            open_l = open_r = keys != _BLANK
            for s in range(1, min(reach, n - 1) + 1):
                same = piece[s:] == piece[:-s]
                open_l, open_r = open_l.copy(), open_r.copy()
                open_l[:s], open_r[n - s :] = False, False
                open_l[s:] &= same & (keys[:-s] < keys[s:])
                open_r[:-s] &= same & (keys[s:] <= keys[:-s])
                before += open_l
                after += open_r
            at = np.flatnonzero(before + after)
            size = before[at].astype(np.int64) + after[at] + 1
            flat = np.repeat(at - before[at] - np.cumsum(size) + size, size) + np.arange(size.sum())
            pivot = keys[at]
            spread = np.ones(len(at), np.int64)
            inside = pivot < np.uint64(len(d.hot))
            spread[inside] = d.hot[pivot[inside].astype(np.int64)]
            salt = (task * 31 + n_parcels) % spread
            bucket = (mix(pivot.copy()) % np.uint64(d.buckets)).astype(np.int64)
            held.append((lang[at] * d.buckets + (bucket + salt) % d.buckets, before[at] << 4 | after[at], size, keys[flat]))

        def parcels() -> Iterator[pa.RecordBatch]:
            group, shape, size, flat = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            if not len(group):
                return
            order = np.argsort(group, kind="stable")
            first = np.cumsum(size) - size
            size_ = size[order]
            flat = flat[np.repeat(first[order] - np.cumsum(size_) + size_, size_) + np.arange(size_.sum())]
            group, shape = group[order], shape[order]
            starts = np.flatnonzero(np.diff(group, prepend=-1))
            ends = np.append(starts[1:], len(group))
            word_end = np.concatenate([[0], np.cumsum(size_)])
            every = list(names)
            out: list[list] = [[], [], [], [], [], []]
            for i, j in zip(starts, ends, strict=True):
                ids = flat[word_end[i] : word_end[j]]
                is_rare = ids >= _RARE
                rare = np.unique(ids[is_rare])
                if len(rare):
                    ids = ids.copy()
                    ids[is_rare] = np.uint64(len(d.hashes)) + np.searchsorted(rare, ids[is_rare]).astype(np.uint64)
                ids = ids.astype(np.uint32)
                row = (int(group[i] % d.buckets), every[int(group[i] // d.buckets)], shape[i:j].tobytes(), (ids & np.uint32(0xFFFF)).astype(np.uint16).tobytes(), (ids >> np.uint32(16)).astype(np.uint16).tobytes(), rare.tobytes())
                for column, v in zip(out, row, strict=True):
                    column.append(v)
            types = (pa.int32(), pa.string(), *[pa.binary()] * 4)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=["bucket", "lang", "shape", "low", "high", "rare"])

        for batch in batches:
            lang = np.array([names.setdefault(x, len(names)) for x in batch.column(1).to_pylist()], np.int64)
            for block in blocks(batch.column(0), _langs(batch.column(2))):
                cut_block(d.keys(block.hashes), block.piece, lang[block.row])
                if sum(len(x[0]) for x in held) >= parcel:
                    yield from parcels()
                    n_parcels += 1
        if held:
            yield from parcels()

    return _read(docs).mapInArrow(run, "bucket int, lang string, shape binary, low binary, high binary, rare binary")


def _joined(column: pa.ChunkedArray, kind: type) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), kind) for x in column]


def mine(found: pa.Table, words: Dictionary, longest: int = LONGEST, least: int = LEAST) -> tuple[list[bytes], np.ndarray]:
    """(phrases as the hashes of their words, counts) of the pivots of one bucket and language:
    those with the least count, and all counts of pivots that are dealt out."""
    n_ranks = len(words.hashes)
    shape = np.concatenate(_joined(found["shape"], np.uint8))
    rares = _joined(found["rare"], np.uint64)
    rare = np.unique(np.concatenate(rares))
    ids = []
    for low, high, own in zip(_joined(found["low"], np.uint16), _joined(found["high"], np.uint16), rares, strict=True):
        part = low.astype(np.int64) | high.astype(np.int64) << 16
        if len(own):
            far = part >= n_ranks
            part[far] = n_ranks + np.searchsorted(rare, own)[part[far] - n_ranks]
        ids.append(part)
    ids = np.concatenate(ids)
    width = n_ranks + len(rare) + 1
    hashes = np.concatenate([words.hashes, rare & _HASH])
    before, after = (shape >> 4).astype(np.int64), (shape & 15).astype(np.int64)
    size = before + after + 1
    pivot_at = np.cumsum(size) - size + before
    pivot = ids[pivot_at]
    all_counts = pivot < len(words.hot)
    # group[j]: of each fragment the phrase with j words before the pivot, -1 where it isn't frequent
    group = {0: pivot}
    grams: list[bytes] = []
    counts: list[np.ndarray] = []
    for n in range(2, longest + 1):
        level = {}
        for j in range(n):
            right = n - 1 - j
            base = group.get(j) if right else group.get(j - 1)
            if base is None:
                continue
            ok = (before >= j) & (after >= right) & (base >= 0)
            if right and j:
                other = group.get(j - 1)
                ok &= other >= 0 if other is not None else False
            at = np.flatnonzero(ok)
            key = base[at] * width + ids[pivot_at[at] + (right or -j)]
            order = np.argsort(key)
            key = key[order]
            starts = np.flatnonzero(np.diff(key, prepend=-1))
            times = np.diff(np.append(starts, len(key)))
            one = at[order[starts]]
            kept = (times >= least) | all_counts[one]
            number = np.where(kept, np.cumsum(kept) - 1, -1)
            new = np.full(len(shape), -1, np.int64)
            new[at[order]] = np.repeat(number, times)
            if kept.any():
                level[j] = new
                where = pivot_at[one[kept]][:, None] + np.arange(-j, right + 1)
                flat = hashes[ids[where]].astype(">u8").tobytes()
                grams += [flat[i : i + 8 * n] for i in range(0, len(flat), 8 * n)]
                counts.append(times[kept])
        group = level
        if not group:
            break
    return grams, np.concatenate(counts) if counts else np.zeros(0, np.int64)


def phrases(docs: DataFrame, words: DataFrame, longest: int = LONGEST, least: int = LEAST, n_ranks: int = DICTIONARY, bucket: int = BUCKET, parcel: int = PARCEL) -> DataFrame:
    """(lang, gram, a): the phrases with their counts; gram has 8 bytes for each word. words: a
    stored word_counts()."""
    known = dictionary_of(words, n_ranks, bucket)
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def run(key: tuple, found: pa.Table) -> pa.Table:
        grams, n = mine(found, shared.value, longest, least)
        return pa.table({"lang": pa.array([key[1].as_py()] * len(grams), pa.string()), "gram": pa.array(grams, pa.binary()), "a": pa.array(n, pa.int64())})

    mined = fragments(docs, known, longest, parcel).groupBy("bucket", "lang").applyInArrow(run, "lang string, gram binary, a long")
    return mined.groupBy("lang", "gram").agg(F.sum("a").alias("a")).where(F.col("a") >= least)


def _words_in(gram: str = "gram") -> Column:
    return F.octet_length(gram) / 8


def _part(first: Column | int, count: Column) -> Column:
    return F.substring(F.col("gram"), first, count)


def maximal(grams: DataFrame) -> DataFrame:
    """grams without those that a longer phrase holds every time. The longer phrase of one word
    more is enough: counts between the two lie between theirs."""
    shorter = F.octet_length("gram") - 8
    inner = grams.where(F.octet_length("gram") >= 24).select("lang", F.explode(F.array(_part(F.lit(1), shorter), _part(F.lit(9), shorter))).alias("gram"), F.lit(None).cast("long").alias("a"), F.col("a").alias("longer"))
    rows = grams.select("lang", "gram", "a", F.lit(None).cast("long").alias("longer")).unionByName(inner)
    out = rows.groupBy("lang", "gram").agg(F.max("a").alias("a"), F.max("longer").alias("longer"))
    return out.where("a is not null and (longer is null or longer < a)").drop("longer")


def scored(grams: DataFrame, words: DataFrame, longest: int = LONGEST) -> DataFrame:
    """(lang, gram, a, l, r, n, score) of the phrases that stay; grams and words are stored."""
    kept = staged(maximal(grams), "maximal")
    cuts = kept.select("lang", "gram", "a", F.explode(F.sequence(F.lit(1), (_words_in() - 1).cast("int"))).alias("k"))
    sides = F.array(F.struct(F.lit(0).alias("side"), _part(F.lit(1), F.col("k") * 8).alias("part")), F.struct(F.lit(1).alias("side"), _part(F.col("k") * 8 + 1, F.octet_length("gram")).alias("part")))
    rows = cuts.select("lang", "gram", "a", "k", F.explode(sides).alias("s")).select("lang", "gram", "a", "k", "s.side", "s.part")
    one = words.where("word is not null").select(_bytes(F.col("hash")).alias("part"), F.col("n").alias("f"))
    counts = grams.select(F.col("gram").alias("part"), F.col("a").alias("f")).unionByName(one)
    wanted = rows.groupBy("part").agg(F.count("*").alias("n"))
    found = spread_join(rows, staged(wanted.join(counts, "part"), "parts"), "part")
    value = F.col("found.f")
    columns = [F.max(F.when((F.col("k") == k) & (F.col("side") == s), value)).alias(f"{'lr'[s]}{k}") for k in range(1, longest) for s in (0, 1)]
    both = found.groupBy("lang", "gram", "a").agg(*columns)
    totals = words.where("word is null").select("lang", F.col("n").alias("all"))
    by_lang = kept.groupBy("lang").agg(F.count("*").alias("n")).join(totals, "lang")
    both = spread_join(both, staged(by_lang, "languages"), "lang", "found").withColumn("n", F.col("found.all")).drop("found")

    def big(x: str) -> str:
        return f"cast({x} as decimal(19,0))"

    cut = [F.expr(f"case when l{k} is not null then named_struct('score', cast(cast(1000 as decimal(4,0)) * ({big('a')} * {big('n')}) as decimal(38,0)) div cast({big(f'l{k}')} * {big(f'r{k}')} as decimal(38,0)), 'k', {k}, 'l', l{k}, 'r', r{k}) end") for k in range(1, longest)]
    best = F.array_min(F.array_compact(F.array(*cut)))
    return both.withColumn("best", best).select("lang", "gram", "a", F.col("best.l").alias("l"), F.col("best.r").alias("r"), "n", F.col("best.score").alias("score"))


def _bytes(hash: Column) -> Column:
    return F.unhex(F.lpad(F.hex(hash), 16, "0"))


def collocations(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, top: int = TOP, n_ranks: int = DICTIONARY, bucket: int = BUCKET, parcel: int = PARCEL) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first `top` phrases of each language."""
    words = staged(word_counts(docs, least), "words")
    grams = staged(phrases(docs, words, longest, least, n_ranks, bucket, parcel), "grams")
    out = scored(grams, words, longest)
    order = [F.desc("score"), F.desc("a")]
    salt = F.pmod(F.xxhash64("gram"), F.lit(partitions(docs.sparkSession))).alias("salt")
    # first within groups of a language, then among what these leave; ties stay for the order of phrases
    near = out.select("*", salt).withColumn("i", F.rank().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("i") <= top).drop("salt")
    near = staged(near.withColumn("i", F.rank().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("i") <= top).drop("i"), "first")
    places = near.select("lang", "gram", F.explode(F.sequence(F.lit(0), (_words_in() - 1).cast("int"))).alias("p"))
    places = places.select("lang", "gram", "p", _part(F.col("p") * 8 + 1, F.lit(8)).alias("id"))
    text = places.join(words.where("word is not null").select(_bytes(F.col("hash")).alias("id"), F.col("word").cast("string").alias("w")), "id")
    phrase = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", "w"))), lambda s: s["w"]), " ")
    named = near.join(text.groupBy("gram").agg(phrase.alias("phrase")), "gram")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order, F.asc("phrase")))
    return named.withColumn("rank", rank.cast("long")).where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents").select("text", "lang"))


ORACLE = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
runs AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM pieces),
grams AS (
  SELECT lang, m, list_aggregate(ws[i : i + m - 1], 'string_agg', ' ') AS phrase
  FROM runs, range(1, 6) AS ms(m), unnest(range(1, len(ws) - m + 2)) AS pos(i)),
counts AS (SELECT lang, m, phrase, count(*) AS f FROM grams GROUP BY lang, m, phrase HAVING count(*) >= 100),
totals AS (SELECT lang, sum(len(ws)) AS n FROM runs GROUP BY lang),
candidates AS (SELECT lang, m, phrase, string_split(phrase, ' ') AS ws, f AS a FROM counts WHERE m >= 2),
kept AS (
  SELECT * FROM candidates c WHERE NOT EXISTS (
    SELECT 1 FROM candidates x WHERE x.lang = c.lang AND x.m = c.m + 1 AND x.a = c.a
      AND (array_to_string(x.ws[1 : c.m], ' ') = c.phrase OR array_to_string(x.ws[2 : c.m + 1], ' ') = c.phrase))),
cuts AS (
  SELECT lang, phrase, a, k, array_to_string(ws[1 : k], ' ') AS first_part, array_to_string(ws[k + 1 : m], ' ') AS rest
  FROM kept, unnest(range(1, m)) AS u(k)),
scored AS (
  SELECT cuts.lang, cuts.phrase, a, k, x.f AS l, y.f AS r, n,
    (CAST(1000 AS HUGEINT) * a * n) // (CAST(x.f AS HUGEINT) * y.f) AS score
  FROM cuts JOIN counts x ON x.lang = cuts.lang AND x.phrase = first_part
  JOIN counts y ON y.lang = cuts.lang AND y.phrase = rest JOIN totals ON totals.lang = cuts.lang),
best AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS i FROM scored)
SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best WHERE i = 1)
WHERE rank <= 2000
"""
