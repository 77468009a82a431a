"""Ids of many texts by their distinct pieces.

The pattern of byte-level vocabularies never looks behind and lets no match go over two kinds of
places: before a space that something other than white space follows (the space belongs to what
follows, and white space before it is matched as at the end of a text), and between a letter and a
mark (the one match with both, a contraction, begins with its apostrophe). The texts are cut there,
so that no piece's ids depend on what is beside it; each distinct piece of a group of texts is
encoded once, and the ids of the texts are gathered from those. Texts of other tokenizers stay whole.
"""

from __future__ import annotations

import json
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from quillspark.llm.best_fit_packing import encoder

#: Pieces that are encoded at once.
PIECES = 4096
#: What a byte is: a letter, a mark other than the apostrophe (both ASCII), the first of a
#: character that is surely not white space (which is ASCII, or begins with C2, E1, E2 or E3).
_LETTER, _MARK, _SOLID = 1, 2, 4
_KIND = np.zeros(256, np.uint8)
_KIND[[*range(0x21, 0x7F), *range(0xC3, 0xE1), *range(0xE4, 0xF5)]] = _SOLID
_KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] |= _LETTER
_KIND[[b for b in range(0x21, 0x7F) if not chr(b).isalnum() and chr(b) != "'"]] |= _MARK


@lru_cache(maxsize=4)
def may_cut(path: str) -> bool:
    """Whether the tokenizer file has the pattern of byte-level vocabularies and nothing before it."""
    with open(path, encoding="utf-8") as f:
        told = json.load(f)
    pre = told.get("pre_tokenizer") or {}
    plain = not told.get("normalizer") and all(t["special"] for t in told.get("added_tokens", []))
    return plain and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space", True)


def cut(data: np.ndarray, offsets: np.ndarray, inside: bool) -> np.ndarray:
    """Where the pieces of texts in one array of bytes begin, and their end; inside: texts are cut."""
    begins = np.zeros(len(data) + 1, bool)
    if inside:
        kind = _KIND.take(data)
        begins[:-2] = (data[:-1] == 0x20) & (kind[1:] & _SOLID != 0)
        begins[1:-1] |= (kind[:-1] & _LETTER != 0) & (kind[1:] & _MARK != 0)
    begins[offsets] = True
    return np.flatnonzero(begins)


def encode(texts: pa.Array, path: str, end: int) -> tuple[np.ndarray, np.ndarray]:
    """(the ids of all texts in a row, each with the end id; how many each has), null as an empty text."""
    texts = texts.cast(pa.large_string())
    texts = pc.fill_null(texts, "") if texts.null_count else texts
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    begins = cut(data, offsets, may_cut(path))
    found = pa.LargeStringArray.from_buffers(len(begins) - 1, pa.py_buffer(begins), pa.py_buffer(data)).dictionary_encode()
    of, ids, n = encoder(path), [], []
    for a in range(0, len(found.dictionary), PIECES):
        some = of(found.dictionary.slice(a, PIECES).to_numpy(zero_copy_only=False).tolist())
        n += map(len, some)
        ids.append(np.fromiter(chain.from_iterable(some), np.int32, sum(n[a:])))
    # the end id is one more piece, after the last of each text
    ids, n = np.concatenate([*ids, [end]]).astype(np.int32), np.array([*n, 1])
    last = np.searchsorted(begins, offsets[1:])
    pieces = np.insert(found.indices.to_numpy(), last, len(n) - 1)
    first = np.concatenate([[0], last[:-1] + np.arange(1, len(last))])
    size = n.take(pieces)
    lengths = np.add.reduceat(size, first)
    place = np.repeat((np.cumsum(n) - n).take(pieces) - (np.cumsum(size) - size), size)
    place += np.arange(len(place))
    return ids.take(place), lengths
