"""Files of ids: exact round trips, damage, places in the corpus."""

import json
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from quillspark.llm import _idcoder, _pieces, id_files

ROWS = [
    (5, "The cat sat on the mat, the cat sat on the mat again. " * 30), (3, None), (9, ""), (-2, "#"), (3, "same id"), (None, "no id"),
    (None, "no id"), (7, "naïve 日本語 <|endoftext|> text"), (11, "x" * 40_000), (12, " ".join(f"w{i % 97}" for i in range(9000))),
]


@pytest.mark.parametrize("n", [0, 1, 2, 63, 64, 65, 129, 4000])
def test_coder_round_trip(n):
    rng = np.random.default_rng(n)
    for ids in (rng.integers(0, 50_000, n), np.minimum(rng.zipf(1.2, n), (1 << 24) - 2), np.zeros(n, int), np.arange(n) % 7, np.tile([9, 9, 4, 50_256], n)[:n]):
        data = _idcoder.encode(ids.astype(np.int32), block=64)
        assert (_idcoder.decode(data) == ids).all()


def test_blocks_stand_alone_and_show_damage():
    ids = (np.random.default_rng(1).zipf(1.3, 1000) % 5000).astype(np.int32)
    data = _idcoder.encode(ids, block=128)
    assert (_idcoder.decode(data, range(3, 5)) == ids[384:640]).all()
    assert (_idcoder.decode(data, range(7, 8)) == ids[896:]).all()
    broken = bytearray(data)
    broken[-20] ^= 8  # in the last block
    assert (_idcoder.decode(bytes(broken), range(0, 7)) == ids[:896]).all()
    with pytest.raises(_idcoder.Corrupt, match="block 7"):
        _idcoder.decode(bytes(broken))
    for at in (0, 20, 60):
        broken = bytearray(data)
        broken[at] ^= 1
        with pytest.raises(_idcoder.Corrupt):
            _idcoder.decode(bytes(broken))


def test_rare_ids_among_common_ones():
    """Steps that take several words of the coder in some lanes and none in others."""
    rng = np.random.default_rng(6)
    for n, block in ((5000, 512), (3000, 5000), (70, 1)):
        ids = np.where(rng.random(n) < 0.02, rng.integers(0, 1 << 20, n), 3).astype(np.int32)
        assert (_idcoder.decode(_idcoder.encode(ids, block)) == ids).all()


def test_what_the_ids_alone_decide_is_made_for_many_steps(monkeypatch):
    """The encoder asks for slots and states once for several steps, not in each."""
    calls = []
    of = _idcoder.Model.__dict__.get("states_of")
    monkeypatch.setattr(_idcoder.Model, "states_of", lambda self, found: calls.append(len(found)) or of(self, found), raising=False)
    _idcoder.encode((np.arange(4000) % 97).astype(np.int32), block=1000)
    assert 0 < len(calls) <= 1000 / 8


def test_a_file_that_is_cut_off_is_found():
    ids = (np.random.default_rng(4).zipf(1.3, 1000) % 5000).astype(np.int32)
    data = _idcoder.encode(ids, block=128)
    for n in range(len(data) - 2, len(data) - 1200, -97):
        with pytest.raises(_idcoder.Corrupt):
            _idcoder.decode(data[:n])
    assert (_idcoder.decode(data[:-100], range(0, 5)) == ids[:640]).all()


def test_contexts_pay():
    """Repeated runs cost less than their ids do by order 0, and new ones hardly more."""
    rng = np.random.default_rng(2)
    run = rng.integers(0, 2000, 60)
    again = np.tile(run, 60).astype(np.int32)
    fresh = rng.integers(0, 2000, 3600).astype(np.int32)
    assert 8 * len(_idcoder.encode(again)) < 0.35 * len(again) * np.log2(60) + 8 * 4 * 60 + 600
    assert 8 * len(_idcoder.encode(fresh)) - 32 * len(np.unique(fresh)) < 1.05 * len(fresh) * 11


def test_documents_equal_the_tokenizer(spark, monkeypatch):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(id_files.tokenizer_path())
    tokenizer.encode_special_tokens = True
    monkeypatch.setattr(id_files, "TEXTS", 1)  # files end after any text
    docs = spark.createDataFrame([(i, t, 1, "p") for i, t in ROWS], "doc_id int, text string, start int, part string").repartition(4)
    stored = id_files.stored_files(docs, file_ids=500, block=256)
    assert stored.count() > 4
    rows = sorted((tuple(r) for r in id_files.read(stored, with_ids=True).collect()), key=lambda r: r[1])
    want = sorted([(i, [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]) for i, t in ROWS], key=lambda x: (x[0] is not None, x[0] or 0))
    assert [r[0] for r in rows] == [i for i, _ in want]
    assert sorted(map(repr, ((r[0], r[4]) for r in rows))) == sorted(map(repr, want))
    at = 0
    for _, start, n, crc, ids in rows:
        assert (start, n, crc) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += n
    assert id_files.read(id_files.stored_files(docs.limit(0))).count() == 0


def test_events_of_many_steps_are_prepared_at_once(monkeypatch):
    """The coder's arrays are made for several steps in one go, and the file is what it was."""
    ids = (np.random.default_rng(3).zipf(1.3, 4000) % 5000).astype(np.int32)
    where, calls = np.where, []
    monkeypatch.setattr(np, "where", lambda *a: calls.append(1) or where(*a))
    data = _idcoder.encode(ids, block=1000)
    monkeypatch.undo()
    assert len(calls) < 1000 and (_idcoder.decode(data) == ids).all()
    assert zlib.crc32(data) == 452601070


def test_pieces_equal_whole_texts():
    """Texts that are cut have the ids that the tokenizers library gives the whole texts."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(id_files.tokenizer_path())
    tokenizer.encode_special_tokens = True
    rng = random.Random(5)
    spaces = [*[" "] * 8, "  ", "\n", "\t", "\r\n", " \n", "\n ", "\x0b", "\x1c", "\x1f", "\x85", "\xa0", "\u1680", "\u180e", "\u2003", "\u2028", "\u202f", "\u205f", "\u3000", "\u200b", "\ufeff"]
    others = [*"aB.,!?'-_09", "the", "'s", "'S", "'re", "-'ll", "\u2019", "\xe9", "\u65e5\u672c", "\u0663", "\xbd", "\u03a9", "\u0436", "\x00", "\x7f", "<|endoftext|>", "\U0001f642"]
    texts = ["".join(rng.choice(spaces if rng.random() < 0.4 else others) for _ in range(rng.randrange(14))) for _ in range(8000)] + [None, "", " ", "  ", "\n"]
    want = [[*tokenizer.encode(t or "", add_special_tokens=False).ids, 2] for t in texts]
    for some, expected in ((pa.array(texts), want), (pa.array(texts, pa.large_string())[7:], want[7:])):
        ids, lengths = _pieces.encode(some, id_files.tokenizer_path(), 2)
        assert lengths.tolist() == [len(x) for x in expected]
        assert ids.tolist() == [i for x in expected for i in x]


def test_each_distinct_piece_is_encoded_once(monkeypatch):
    """Words that come again, in whatever text of a group, cost no more tokenizing."""
    of, given = _pieces.encoder, []
    monkeypatch.setattr(_pieces, "encoder", lambda path: lambda texts: given.extend(texts) or of(path)(texts))
    texts = [" ".join(f"word{chr(97 + (i * k) % 23)}{'.,'[k % 2]}" for k in range(200)) for i in range(50)]
    ids, lengths = _pieces.encode(pa.array(texts), id_files.tokenizer_path(), 2)
    assert len(lengths) == 50 and len(ids) == lengths.sum() > 50 * 200
    assert len(given) == len(set(given)) <= 2 * 23 + 2
    batches = [pa.RecordBatch.from_arrays([pa.array([t])], ["text"]) for t in ("a", "b" * 40, "c" * 70, "d")]
    monkeypatch.setattr(id_files, "TOGETHER", 40)
    assert [len(g) for g in id_files.groups(iter(batches), 64)] == [2, 1, 1]
    long = pa.RecordBatch.from_arrays([pa.array(["e" * 1000] * 150)], ["text"])  # a batch of long texts is divided
    assert [[x.num_rows for x in g] for g in id_files.groups(iter([long]), 64)] == [[64], [64], [22]]


def test_texts_of_other_patterns_stay_whole(tmp_path):
    with open(id_files.tokenizer_path(), encoding="utf-8") as f:
        told = json.load(f)
    assert _pieces.may_cut(id_files.tokenizer_path())
    for name, change in (("a", {"pre_tokenizer": None}), ("b", {"normalizer": {"type": "Lowercase"}}), ("c", {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True, "use_regex": True}})):
        (tmp_path / name).write_text(json.dumps(told | change))
        assert not _pieces.may_cut(str(tmp_path / name))
    data = np.frombuffer(b"a b. c", np.uint8)
    assert _pieces.cut(data, np.array([0, 6]), False).tolist() == [0, 6]
    assert _pieces.cut(data, np.array([0, 6]), True).tolist() == [0, 1, 3, 4, 6]
