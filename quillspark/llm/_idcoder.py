"""An adaptive context-mixing range coder for token ids, over many blocks at once.

A file of ids is cut into blocks of equal length that start from the same state and are coded
apart from each other, each with a checksum of its ids. All blocks advance by one id in each
step, so the work is on arrays with a place (a lane) for each block.

For the next id, order 2 (the two ids before) and order 1 (the id before) each name a candidate,
the id seen last in that context with a confidence. Two binary events are coded: it is
the candidate of order 2; if not, it is that of order 1. The probability of either is mixed in
the logistic domain: orders 2, 1 and 0 each give log odds for it, by their confidence or the
class of the candidate, and the coding error of the sum corrects all three in the block. An id that neither names is coded by order 0:
the adaptive distribution of classes (powers of two of the id's rank by frequency, a table in
the file's head), and its place in the class. Events drive a carrying range coder of 64 bits with
words of 16 bits. All arithmetic is on integers, so every machine decodes alike.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC = b"QSMIX\x01"
BLOCK = 2048
#: Slots of the context tables of a lane, as a power of two.
SLOT_BITS = 9
_EMPTY = 0xFFFFFF
_U = np.uint64
_LEAST_RANGE = _U(1 << 48)
#: Steps whose events are prepared for the coder at once.
TOGETHER = 16
#: Shares of 16 bits an event may have; at least 1/64 and 1/16 is left to what comes after.
_MOST = np.array([[65536 * 63 // 64], [65536 * 15 // 16]], np.int32)
_GAP = 16  # least share of a class, of 32768


#: Shares of 16 bits by log odds in units of 1/256, from -2047 to 2047.
SQUASH = np.clip(np.rint(65536 / (1 + np.exp(-np.arange(-2047, 2048) / 256))), 64, 65472).astype(np.int32)
#: The log odds (units of 1/256) that each order begins with: order 2 by its confidence (0: no
#: candidate), order 1 by its own and, from 8 on, where it names another id, order 0 by the class.
_START = [[-300, -160, 60, 220, 340, 460, 580, 700], [-200, -80, 40, 120, 180, 240, 300, 360, -60, -100, -140, -180, -220, -260, -300, -340], [0] * 32]
#: By confidence, from 8 on where the id came: where the slot begins to keep its id, and its next confidence.
_KEPT, _ID = np.uint32(3), np.uint32(0xFFFFFFF8)
_NEXT = np.array([1, 1, 1, 1, 2, 2, 3, 3, 1, 2, 3, 4, 5, 6, 7, 7], np.uint32)
#: Log odds are held with so many bits more; error (of 16 bits) moves them by this power of two less.
_FINE, _RATE = 4, 5


def class_of(ranks: np.ndarray) -> np.ndarray:
    """The bits of a rank: 0 for 0, 1 for 1, 2 for 2 and 3, ..."""
    return np.frexp(ranks.astype(np.float64))[1].astype(np.int32)


class Model:
    """The predictions of all lanes and how they adapt; coder and decoder share it."""

    def __init__(self, lanes: int, rank_class: np.ndarray, start: np.ndarray):
        """rank_class: the class of every id; start: where the classes begin, of 32768."""
        self.lanes, self.id_row = lanes, np.append(rank_class, 0).astype(np.int32) * np.int32(lanes)
        lane = np.arange(lanes)
        # the slots of both contexts in one row; a slot holds an id and, in three bits, its confidence
        self.slots = np.full(2 * lanes << SLOT_BITS, _EMPTY << 3, np.uint32)
        self.slot_base = (np.arange(2 * lanes) << SLOT_BITS).reshape(2, lanes)
        self.one = np.zeros(lanes, np.uint32)
        self.two = np.zeros(lanes, np.uint32)
        # log odds by event, order, state and lane in one row, and what finds their place
        odds = np.array([x for _ in range(2) for row in _START for x in row], np.int32) << _FINE
        self.odds = np.repeat(odds, lanes)
        sizes = [len(row) for row in _START]
        first = np.cumsum([0, *sizes, *sizes])[:6].reshape(2, 3).T
        self.place = first[:, :, None] * lanes + lane
        self.n_classes = len(start)
        self.classes = np.zeros((self.n_classes + 1, lanes), np.uint16)
        self.classes[:-1] = start[:, None]
        self.classes[-1] = 32768
        inner = np.arange(1, self.n_classes)
        self.inner, self.low = inner.astype(np.int16)[:, None], (inner * _GAP).astype(np.int16)[:, None]
        self.span = (32768 - (self.n_classes - inner) * _GAP - inner * _GAP).astype(np.int16)[:, None]
        self.lane = lane

    def slots_of(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Places of the slots of both contexts, after ids one and, before them, two."""
        h = np.empty((*one.shape[:-1], 2, self.lanes), np.uint32)
        np.multiply(one, np.uint32(0x9E3779B1), out=h[..., 1, :])
        np.bitwise_xor(h[..., 1, :], two, out=h[..., 0, :])
        h[..., 0, :] *= np.uint32(0x85EBCA6B)
        h >>= np.uint32(32 - SLOT_BITS)
        return h + self.slot_base

    def states_of(self, found: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(candidates, where the log odds begin by order and event, whether an event may be) by what the slots hold."""
        sure = (found & np.uint32(7)).view(np.int32) * np.int32(self.lanes)
        c = (found >> np.uint32(3)).view(np.int32)
        other = c[..., 0, :] != c[..., 1, :]
        at = np.empty((*found.shape[:-2], 3, 2, self.lanes), np.int64)
        at[..., 0, :, :] = sure[..., :1, :]
        at[..., 1, :, :] = sure[..., 1:, :]
        at[..., 1, 0, :] += other * np.int32(8 * self.lanes)
        at[..., 2, :, :] = self.id_row.take(c, mode="clip")
        named = sure != 0
        named[..., 1, :] &= other
        return c, at, named

    def mix(self, state: np.ndarray) -> np.ndarray:
        """Shares of 16 bits by the log odds alone, which correct() adapts then; state is used up."""
        state += self.place
        self.at = state
        self.x = self.odds.take(self.at, mode="clip")
        dot = self.x[0] + self.x[1]
        dot += self.x[2]
        dot >>= _FINE
        dot += 2047
        self.q = SQUASH.take(dot, mode="clip")
        return self.q

    def correct(self, aims: np.ndarray, seen: np.ndarray) -> None:
        """Moves the log odds of the last mix towards aims, where the event was coded."""
        error = aims - self.q
        error *= seen
        error >>= _RATE
        self.x += error
        self.odds[self.at] = self.x

    def shares_of(self, q: np.ndarray, named: np.ndarray) -> np.ndarray:
        """Shares of 16 bits of both events, of all ids; 0 where there is no candidate."""
        share = np.minimum(q, _MOST) * named
        rest = 65536 - share[..., 0, :]
        rest >>= 1
        share[..., 1, :] >>= 1
        share[..., 1, :] *= rest
        share[..., 1, :] >>= 14
        return share

    def predict(self) -> tuple[np.ndarray, np.ndarray]:
        """(candidates, shares of 16 bits) of the two events; a share of 0: no candidate."""
        self.slot = self.slots_of(self.one, self.two)
        self.found = self.slots.take(self.slot, mode="clip")
        c, state, self.named = self.states_of(self.found)
        return c, self.shares_of(self.mix(state), self.named)

    def update(self, ids: np.ndarray, hit: np.ndarray, k: np.ndarray, rest: np.ndarray) -> None:
        """ids are the ids that came, hit which event said so, k their classes where rest."""
        self.named[1] &= ~hit[0]
        self.correct(hit * np.int32(65535), self.named)
        u = ids.view(np.uint32)
        self.remember(self.slot, self.found, u << np.uint32(3))
        self.two, self.one = self.one, u
        self.adapt(k.astype(np.int16), -rest.astype(np.int16))

    def remember(self, slot: np.ndarray, found: np.ndarray, came: np.ndarray) -> None:
        """Puts into slots that held found the ids that came, which are shifted by three bits."""
        found = found ^ came  # under 8 where the id came; the confidence is as it was
        sure = found & np.uint32(7)
        sure |= np.left_shift(found < 8, 3, dtype=np.uint32)
        found &= np.multiply(sure >= _KEPT, _ID, dtype=np.uint32)
        found ^= came
        found |= _NEXT.take(sure, mode="clip")
        self.slots[slot] = found

    def adapt(self, k: np.ndarray, rest: np.ndarray) -> None:
        """Moves the classes towards k where all bits of rest are set."""
        inner = self.classes[1:-1].view(np.int16)
        step = k - self.inner
        step >>= 15  # all bits where the class begins after k
        step &= self.span
        step += self.low
        step -= inner
        step >>= 5
        step &= rest
        inner += step


def _first(counts: np.ndarray) -> np.ndarray:
    """Where classes with these counts begin, of 32768, none with less than the gap."""
    n = len(counts)
    free = 32768 - n * _GAP
    share = np.concatenate([[0], np.cumsum(counts)[:-1]]) * free // max(1, int(counts.sum()))
    return (share + np.arange(n) * _GAP).astype(np.uint16)


class _Coder:
    def __init__(self, lanes: int, words: int):
        self.low, self.range = np.zeros(lanes, _U), np.full(lanes, (1 << 64) - 1, _U)
        # words by place and lane, as lanes are at about the same place; at: where each lane writes next
        self.out, self.at, self.lanes = np.zeros(words * lanes, np.uint16), np.arange(lanes), lanes

    def room(self, words: int) -> None:
        """Makes room for so many words more."""
        while self.at.max() + words * self.lanes >= len(self.out):
            self.out = np.concatenate([self.out, np.zeros_like(self.out)])

    def add(self, delta: np.ndarray) -> None:
        low = self.low + delta
        carried = low < delta
        self.low = low
        if carried.any():
            at = self.at[carried] - self.lanes
            while len(at):
                word = self.out[at] + np.uint16(1)
                self.out[at] = word
                at = at[word == 0] - self.lanes

    def settle(self) -> None:
        small = self.range < _LEAST_RANGE
        # every lane writes; those that are not small write their place again later
        self.out[self.at] = self.low >> _U(48)
        self.at += small * self.lanes
        bits = np.left_shift(small, 4, dtype=_U)
        self.low <<= bits
        self.range <<= bits
        small = np.flatnonzero(self.range < _LEAST_RANGE)
        while len(small):
            self.out[self.at[small]] = self.low[small] >> _U(48)
            self.at[small] += self.lanes
            self.low[small] <<= _U(16)
            self.range[small] <<= _U(16)
            small = small[self.range[small] < _LEAST_RANGE]


def _lanes_of(n: int, block: int) -> int:
    return -(-n // block)


def _encode_lanes(ids: np.ndarray, ranks: np.ndarray, id_class: np.ndarray, start: np.ndarray) -> list[bytes]:
    """The words of every lane of ids [step, lane]."""
    steps, lanes = ids.shape
    model, coder = Model(lanes, id_class, start), _Coder(lanes, steps + 16)
    base = np.array([0, *(1 << np.arange(31))], np.int64)
    past = np.zeros((2, lanes), np.int32)
    for t in range(0, steps, TOGETHER):
        # what the model says of some steps, then all that the coder needs of it at once; what follows
        # from the ids alone is made for all of the steps
        part = ids[t : t + TOGETHER]
        m = len(part)
        past = np.concatenate([past, part])
        slots = model.slots_of(past[1:-1].view(np.uint32), past[:-2].view(np.uint32))
        past = past[-2:]
        came, found = part.view(np.uint32) << np.uint32(3), np.empty((m, 2, lanes), np.uint32)
        for i in range(m):
            model.slots.take(slots[i], mode="clip", out=found[i])
            model.remember(slots[i], found[i], came[i])
        c, states, named = model.states_of(found)
        hits = c == part[:, None]
        hits &= named
        np.greater(hits[:, 1], hits[:, 0], out=hits[:, 1])
        rests = hits[:, 0] == hits[:, 1]  # neither, as they are never both
        aims, seen = hits * np.int32(65535), named.copy()
        seen[:, 1] &= ~hits[:, 0]
        q = np.empty((m, 2, lanes), np.int32)
        k = id_class.take(part)
        places, k16, moved = k * np.int64(lanes) + model.lane, k.astype(np.int16), -rests.astype(np.int16)
        first, width = np.empty((m, lanes), np.uint16), np.empty((m, lanes), np.uint16)
        for i in range(m):
            q[i] = model.mix(states[i])
            model.correct(aims[i], seen[i])
            model.classes.take(places[i], mode="clip", out=first[i])
            places[i] += lanes
            model.classes.take(places[i], mode="clip", out=width[i])
            model.adapt(k16[i], moved[i])
        shares = model.shares_of(q, named).astype(np.int64)
        a, b = shares[:, 0], shares[:, 1]
        begin = np.where(hits[:, 0], 0, a + np.where(rests, b, 0)).view(_U)
        size = np.where(hits[:, 0], a, np.where(hits[:, 1], b, 65536 - a - b)).view(_U)
        width = np.where(rests, width - first, 1).astype(_U)
        first = (first * rests).astype(_U)
        fine, bits = rests * _U(15), np.maximum(k - 1, 0).astype(_U) * rests
        offsets = (ranks[t : t + TOGETHER] - base.take(k)).view(_U) * rests
        coder.room(4 * m)  # a step takes three words at most
        for i in range(m):
            r = coder.range >> _U(16)
            delta = r * begin[i]
            r *= size[i]
            r >>= fine[i]
            delta += r * first[i]
            r *= width[i]
            r >>= bits[i]
            delta += r * offsets[i]
            coder.range = r
            coder.add(delta)
            coder.settle()
    # one word more names a number inside the last range; what follows reads as zeros
    coder.add((_U(0) - coder.low) & (_LEAST_RANGE - _U(1)))
    coder.range[:] = 0
    last = coder.low >> _U(48)
    counts = (coder.at // max(1, lanes)).tolist()
    words = np.ascontiguousarray(coder.out.reshape(-1, lanes)[: max(counts, default=0)].T)
    out = []
    for lane, n in enumerate(counts):
        out.append(words[lane, :n].astype("<u2").tobytes() + int(last[lane]).to_bytes(2, "little"))
    return out


def _decode_lanes(words: np.ndarray, first: np.ndarray, end: np.ndarray, steps: int, by_rank: np.ndarray, id_class: np.ndarray, start: np.ndarray) -> np.ndarray:
    """ids [step, lane] of lanes whose words are words[first:end]."""
    lanes = len(first)
    model = Model(lanes, id_class, start)
    base = np.array([0, *(1 << np.arange(31))], np.int64)
    bits = np.maximum(np.arange(len(base)) - 1, 0).astype(_U)
    out = np.zeros((steps, lanes), np.int32)
    words, at = _side_by_side(words, first, end), np.arange(lanes)
    v, rng = np.zeros(lanes, _U), np.full(lanes, (1 << 64) - 1, _U)
    for _ in range(4):
        v = v << _U(16) | words.take(at, mode="clip")
        at += lanes
    top = len(by_rank) - 1
    for t in range(steps):
        c, share = model.predict()
        a, b = share.astype(_U)
        r = rng >> _U(16)
        ra = r * a
        rb = r * b
        off_a = v >= ra
        rest = v >= ra + rb
        hit = np.empty((2, lanes), bool)
        np.logical_not(off_a, out=hit[0])
        np.greater(off_a, rest, out=hit[1])
        # all bits set where it is not the first candidate, or neither
        not_a, neither = _U(0) - off_a.astype(_U), _U(0) - rest.astype(_U)
        v -= (ra & not_a) + (rb & neither)
        # the share of the event: a, else b, else what is left
        left = _U(65536) - a - b
        r *= a + ((b - a) & not_a) + ((left - b) & neither)
        r >>= neither & _U(15)
        np.maximum(r, _U(1), out=r)
        s = np.minimum(v // r, _U(32767)).astype(np.uint16)
        k = np.add.reduce((model.classes[1:-1] <= s).view(np.uint8), axis=0, dtype=np.uint8)
        flat = k * np.int64(lanes)
        flat += model.lane
        low = model.classes.take(flat, mode="clip")
        flat += lanes
        width = (model.classes.take(flat, mode="clip") - low).astype(_U)
        v -= r * (low & neither)
        r *= ((width - _U(1)) & neither) + _U(1)
        r >>= bits.take(k, mode="clip") & neither
        np.maximum(r, _U(1), out=r)
        off = v // r & neither
        v -= r * off
        off += base.take(k, mode="clip").view(_U)
        now = by_rank.take(np.minimum(off, _U(top)).view(np.int64))
        np.copyto(now, c[1], where=hit[1])
        np.copyto(now, c[0], where=hit[0])
        out[t] = now
        # every lane reads; those that are not small take nothing of it
        small = r < _LEAST_RANGE
        more = np.left_shift(small, 4, dtype=_U)
        v <<= more
        v |= words.take(at, mode="clip") * small
        r <<= more
        at += small * lanes
        small = np.flatnonzero(r < _LEAST_RANGE)
        while len(small):
            v[small] = v[small] << _U(16) | words.take(at[small], mode="clip")
            at[small] += lanes
            r[small] <<= _U(16)
            small = small[r[small] < _LEAST_RANGE]
        rng = r
        model.update(now, hit, k, rest)
    return out


def _side_by_side(words: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """words[first:end] of every lane as [place, lane], with zeros after them, as many as are read there."""
    rows = np.zeros((len(first), int((end - first).max(initial=0)) + 4), np.uint16)
    for row, a, b in zip(rows, first.tolist(), end.tolist(), strict=True):
        row[: b - a] = words[a:b]
    return np.ascontiguousarray(rows.T)


class Corrupt(ValueError):
    """A file or block whose checksum does not hold."""


def encode(ids: np.ndarray, block: int = BLOCK) -> bytes:
    """The file of ids, which are under 2**24 - 1."""
    ids = np.ascontiguousarray(ids, np.int32)
    n = len(ids)
    counts = np.bincount(ids) if n else np.zeros(0, np.int64)
    by_rank = np.lexsort((np.arange(len(counts)), -counts))[: np.count_nonzero(counts)].astype(np.int32)
    rank_of = np.zeros(len(counts), np.int64)
    rank_of[by_rank] = np.arange(len(by_rank))
    id_class = class_of(rank_of)
    class_counts = np.bincount(class_of(np.arange(len(by_rank))), weights=counts[by_rank]).astype(np.int64) if n else np.zeros(1, np.int64)
    start = _first(class_counts)
    lanes = _lanes_of(n, block)
    steps = min(block, n)
    grid = np.zeros(lanes * steps, np.int32)
    grid[:n] = ids
    if n < lanes * steps:
        grid[n:] = by_rank[0]  # the last block is filled up
    sums = [zlib.crc32(ids[i : i + block].astype("<u4").tobytes()) for i in range(0, n, block)]
    grid = np.ascontiguousarray(grid.reshape(lanes, steps).T) if n else grid.reshape(0, 0)
    payload = _encode_lanes(grid, rank_of[grid], id_class, start) if n else []
    sizes = np.array([len(p) // 2 for p in payload], "<u4")
    head = struct.pack("<QIIB", n, block, len(by_rank), len(start)) + start.astype("<u2").tobytes() + by_rank.astype("<u4").tobytes() + sizes.tobytes() + np.array(sums, "<u4").tobytes()
    return MAGIC + struct.pack("<II", len(head), zlib.crc32(head)) + head + b"".join(payload)


def decode(data: bytes, blocks: range | None = None) -> np.ndarray:
    """The ids of a file, or of some of its blocks alone; Corrupt where a checksum does not hold."""
    fixed = len(MAGIC) + 8
    if data[: len(MAGIC)] != MAGIC or len(data) < fixed:
        raise Corrupt("not a file of ids")
    size, crc = struct.unpack_from("<II", data, len(MAGIC))
    head = data[fixed : fixed + size]
    if zlib.crc32(head) != crc:
        raise Corrupt("the head's checksum does not hold")
    n, block, n_ids, n_classes = struct.unpack_from("<QIIB", head)
    if not n:
        return np.zeros(0, np.int32)
    at = struct.calcsize("<QIIB")
    start = np.frombuffer(head, "<u2", n_classes, at)
    by_rank = np.frombuffer(head, "<u4", n_ids, at := at + 2 * n_classes).astype(np.int32)
    lanes = _lanes_of(n, block)
    sizes = np.frombuffer(head, "<u4", lanes, at := at + 4 * n_ids).astype(np.int64)
    sums = np.frombuffer(head, "<u4", lanes, at + 4 * lanes)
    id_class = np.zeros(int(by_rank.max()) + 1, np.int32)
    id_class[by_rank] = class_of(np.arange(n_ids))
    words = np.frombuffer(data, "<u2", (len(data) - fixed - size) // 2, fixed + size)
    end = np.minimum(np.cumsum(sizes), len(words))  # the file may be cut off
    first = np.maximum(end - sizes, 0)
    chosen = np.arange(lanes) if blocks is None else np.arange(lanes)[blocks.start : blocks.stop]
    steps = min(block, n)
    grid = _decode_lanes(words, first[chosen], end[chosen], steps, by_rank, id_class, start)
    last = n - (lanes - 1) * block
    rows = np.ascontiguousarray(grid.T)
    for i, lane in enumerate(chosen):
        own = rows[i, : last if lane == lanes - 1 else steps]
        if zlib.crc32(own.astype("<u4").tobytes()) != sums[lane]:
            raise Corrupt(f"the checksum of block {lane} does not hold")
    flat = rows.reshape(-1)
    return flat[: len(flat) - (steps - last if lanes - 1 in chosen else 0)]
