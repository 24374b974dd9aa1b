"""A range coder for blocks of token ids, many blocks at a time.

Three predictors are mixed. For orders 2 and 1 a hashed context names one expected id with a
confidence; how often an expectation of that order and confidence came true in this block so far is
its weight. The weights of both orders (added up where they expect the same id) and of the
remainder drive one coding step; an id that neither order expects is coded under an order-0 model:
adaptive frequencies of its high byte, and of its low byte by class of the high one, renewed from
the counts so far at doubling intervals. Every block starts with an empty model, so any block
decodes alone.

Arrays run over the blocks ("lanes"): step t codes the t-th id of every block.
"""

from __future__ import annotations

import zlib

import numpy as np

#: Ids in a block, and blocks coded together at most.
BLOCK, LANES = 2048, 2048
#: Contexts kept for the orders 1 and 2, as powers of two.
ORDER1, ORDER2 = 10, 11
_SLOTS = (1 << ORDER1) + (1 << ORDER2)
#: One coding step has this many parts, as a power of two; what neither order expects keeps some.
_SCALE, _KEPT = 12, 64
_DIGIT = np.uint64(32)
_TOP, _BOTTOM = np.uint64(1 << 32), np.uint64(1 << 24)
#: Classes of high bytes, each with low byte frequencies of its own: ids 0, 1, below 8, the others.
_CLASS = np.searchsorted([1, 2, 8], np.arange(256), "right")
_CLASSES = 4
#: Weight of one occurrence in the order-0 frequencies, and when they are renewed.
_WEIGHT = 24
_RENEWED = frozenset(1 << k for k in range(4, 12))
_SIXTEENTHS = np.arange(16, 257, 16)
_NEXT = np.arange(1, 17)


class _Order0:
    """Cumulative frequencies of bytes, one table for each of `n` rows."""

    def __init__(self, n: int):
        self.counts = np.zeros(n * 256, np.uint16)
        self.table = np.tile(np.arange(257, dtype=np.uint16), (n, 1))
        self.flat = self.table.reshape(-1)

    def renew(self) -> None:
        weights = self.counts.reshape(-1, 256) * np.uint16(_WEIGHT) + np.uint16(1)
        np.cumsum(weights, axis=1, dtype=np.uint16, out=self.table[:, 1:])

    def span(self, rows: np.ndarray, byte: np.ndarray):
        at = rows * 257 + byte
        first = self.flat[at]
        self.counts[rows * 256 + byte] += 1
        return first, self.flat[at + 1] - first

    def total(self, rows: np.ndarray) -> np.ndarray:
        return self.flat[rows * 257 + 256]

    def find(self, rows: np.ndarray, value: np.ndarray) -> np.ndarray:
        """The byte whose range holds each value: first its sixteenth of the table, then the place there."""
        value = value[:, None]
        part = (self.flat[(rows * 257)[:, None] + _SIXTEENTHS] <= value).sum(1) * 16
        return part + (self.flat[(rows * 257 + part)[:, None] + _NEXT] <= value).sum(1)


class _Model:
    """Slots hold expected id | confidence << 16, cells count tries | hits << 16."""

    def __init__(self, lanes: int):
        lane = np.arange(lanes)
        self.slot_base = np.stack([lane * _SLOTS, lane * _SLOTS + (1 << ORDER1)])
        self.slots = np.zeros(lanes * _SLOTS, np.uint32)
        self.cell_base = np.stack([lane * 16, lane * 16 + 8])
        self.cells = np.full(lanes * 16, 1 << 16 | 2, np.uint32)
        self.high, self.low = _Order0(lanes), _Order0(lanes * _CLASSES)
        self.last = np.zeros((2, lanes), np.uint32)

    def look(self, m: int):
        """Of the first m lanes: the frequencies of the order 1 and order 2 expectations."""
        one, two = self.last[0, :m], self.last[1, :m]
        h = np.empty((2, m), np.uint32)
        np.multiply(one, np.uint32(0x9E3779B1), out=h[0])
        np.multiply((one * np.uint32(0x85EBCA77)) ^ (two * np.uint32(0xC2B2AE3D)), np.uint32(0x9E3779B1), out=h[1])
        h[0] >>= np.uint32(32 - ORDER1)
        h[1] >>= np.uint32(32 - ORDER2)
        self.at = self.slot_base[:, :m] + h
        slot = self.slots[self.at]
        self.guess, self.known = slot & np.uint32(0xFFFF), slot >> np.uint32(16)
        self.cell = self.cell_base[:, :m] + self.known
        self.count = self.cells[self.cell]
        self.use = self.known > 0
        p = ((self.count >> np.uint32(16)) << np.uint32(_SCALE)) // (self.count & np.uint32(0xFFFF))
        room = np.uint32((1 << _SCALE) - _KEPT)
        p2 = np.maximum(np.minimum(p[1], room), 1) * self.use[1]
        p1 = np.maximum((room - p2) * p[0] >> np.uint32(_SCALE), 1) * self.use[0]
        agree = (self.guess[0] == self.guess[1]) & self.use[0] & self.use[1]
        return p1 * ~agree, p2 + p1 * agree

    def learn(self, m: int, ids: np.ndarray) -> None:
        hit = self.guess == ids
        count = self.count + self.use + ((hit & self.use).astype(np.uint32) << np.uint32(16))
        full = (count & np.uint32(0xFFFF)) > 512
        if full.any():
            count[full] = (count[full] >> np.uint32(1) & np.uint32(0x7FFF7FFF)) + np.uint32(1 << 16 | 1)
        self.cells[self.cell] = count
        replace = ~hit & (self.known <= 1)
        trust = np.where(hit, np.minimum(self.known + np.uint32(1), 7), np.maximum(self.known >> np.uint32(1), 1))
        self.slots[self.at] = np.where(replace, ids, self.guess) | trust.astype(np.uint32) << np.uint32(16)
        self.last[1, :m] = self.last[0, :m]
        self.last[0, :m] = ids

    def step(self, t: int) -> None:
        if t in _RENEWED:
            self.high.renew()
            self.low.renew()


def encode(blocks: list[np.ndarray]) -> list[bytes]:
    """Each block of ids below 2**16 as bytes."""
    order = sorted(range(len(blocks)), key=lambda i: -len(blocks[i]))
    lengths = np.array([len(blocks[i]) for i in order])
    lanes, steps = len(order), int(lengths.max(initial=0))
    ids = np.zeros((steps, lanes), np.uint32)
    for lane, i in enumerate(order):
        ids[: len(blocks[i]), lane] = blocks[i]
    model = _Model(lanes)
    low, span = np.zeros(lanes, np.uint64), np.full(lanes, (1 << 64) - 1, np.uint64)
    out = np.zeros((lanes, steps * 2 + 4), np.uint32)
    filled = np.zeros(lanes, np.int64)

    def put(at, first, width, total):
        r = span[at] // total
        lo, sp = low[at] + first * r, r * width
        while True:
            settled = (lo ^ (lo + sp)) < _TOP
            open_ = np.flatnonzero(settled | (sp < _BOTTOM))
            if not len(open_):
                break
            o, s = lo[open_], sp[open_]
            s = np.where(settled[open_], s, -o & (_BOTTOM - np.uint64(1)))
            who = open_ if isinstance(at, slice) else at[open_]
            out[who, filled[who]] = o >> _DIGIT
            filled[who] += 1
            lo[open_], sp[open_] = o << _DIGIT, s << _DIGIT
        low[at], span[at] = lo, sp

    whole = np.uint32(1 << _SCALE)
    for t in range(steps):
        m = int(np.searchsorted(-lengths, -t, "left"))
        model.step(t)
        now = ids[t, :m]
        p1, p2 = model.look(m)
        is2 = (p2 > 0) & (now == model.guess[1])
        is1 = ~is2 & (p1 > 0) & (now == model.guess[0])
        rest = ~(is2 | is1)
        first = p2 * ~is2 + p1 * rest
        width = np.where(rest, whole - p2 - p1, np.where(is2, p2, p1))
        put(slice(0, m), first, width, np.uint64(1 << _SCALE))
        rest = np.flatnonzero(rest)
        if len(rest):
            high, byte = (now[rest] >> np.uint32(8)).astype(np.int64), (now[rest] & np.uint32(255)).astype(np.int64)
            rows = rest * _CLASSES + _CLASS[high]
            put(rest, *model.high.span(rest, high), model.high.total(rest))
            put(rest, *model.low.span(rows, byte), model.low.total(rows))
        model.learn(m, now)
    for _ in range(2):
        out[np.arange(lanes), filled] = low >> _DIGIT
        filled += 1
        low <<= _DIGIT
    made = [b""] * lanes
    for lane, i in enumerate(order):
        made[i] = out[lane, : filled[lane]].astype(">u4").tobytes()
    return made


def decode(payloads: list[bytes], lengths: list[int]) -> list[np.ndarray]:
    """The blocks of ids. Damaged payloads give other ids of the given lengths; checksums tell."""
    order = sorted(range(len(payloads)), key=lambda i: -lengths[i])
    sizes = np.array([lengths[i] for i in order])
    lanes, steps = len(order), int(sizes.max(initial=0))
    data = np.zeros((lanes, max(map(len, payloads), default=0) // 4 + 4), np.uint64)
    for lane, i in enumerate(order):
        words = np.frombuffer(payloads[i], ">u4", len(payloads[i]) // 4)
        data[lane, : len(words)] = words
    model = _Model(lanes)
    low, span = np.zeros(lanes, np.uint64), np.full(lanes, (1 << 64) - 1, np.uint64)
    code = data[:, 0] << _DIGIT | data[:, 1]
    read = np.full(lanes, 2, np.int64)
    ids = np.zeros((steps, lanes), np.uint32)
    last = data.shape[1] - 1

    def peek(at, total):
        r = np.maximum(span[at] // total, np.uint64(1))
        return r, np.minimum((code[at] - low[at]) // r, total - np.uint64(1)).astype(np.uint32)

    def take(at, r, first, width):
        lo, sp, co = low[at] + first * r, r * width, code[at]
        while True:
            settled = (lo ^ (lo + sp)) < _TOP
            open_ = np.flatnonzero(settled | (sp < _BOTTOM))
            if not len(open_):
                break
            o, s = lo[open_], sp[open_]
            s = np.where(settled[open_], s, np.maximum(-o & (_BOTTOM - np.uint64(1)), np.uint64(1)))
            who = open_ if isinstance(at, slice) else at[open_]
            if isinstance(at, slice):
                co = co.copy()
            co[open_] = co[open_] << _DIGIT | data[who, np.minimum(read[who], last)]
            read[who] += 1
            lo[open_], sp[open_] = o << _DIGIT, s << _DIGIT
        low[at], span[at], code[at] = lo, sp, co

    whole = np.uint32(1 << _SCALE)
    for t in range(steps):
        m = int(np.searchsorted(-sizes, -t, "left"))
        model.step(t)
        every = slice(0, m)
        p1, p2 = model.look(m)
        r, value = peek(every, np.uint64(1 << _SCALE))
        is2 = value < p2
        is1 = ~is2 & (value < p2 + p1)
        rest = ~(is2 | is1)
        first = p2 * ~is2 + p1 * rest
        width = np.where(rest, whole - p2 - p1, np.where(is2, p2, p1))
        take(every, r, first, width)
        now = np.where(is2, model.guess[1], model.guess[0])
        rest = np.flatnonzero(rest)
        if len(rest):
            found = []
            for order0, rows in ((model.high, lambda: rest), (model.low, lambda: rest * _CLASSES + _CLASS[found[0]])):
                rows = rows()
                r, value = peek(rest, order0.total(rows).astype(np.uint64))
                found.append(order0.find(rows, value))
                take(rest, r, *order0.span(rows, found[-1]))
            now[rest] = found[0] << 8 | found[1]
        ids[t, :m] = now
        model.learn(m, now)
    made = [np.empty(0, np.uint16)] * lanes
    for lane, i in enumerate(order):
        made[i] = ids[: sizes[lane], lane].astype(np.uint16)
    return made


def checksum(ids: np.ndarray) -> int:
    """CRC-32 of the ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(ids.astype("<u4").tobytes())


def joined_checksum(first: int, second: int, second_ids: int) -> int:
    """CRC-32 of two sequences of ids, one after the other, from the CRC-32 of each."""
    zeros = bytes(4 * second_ids)  # a CRC is linear: carry the first one over that many bytes
    return second ^ zlib.crc32(zeros, first) ^ zlib.crc32(zeros)
