"""Adaptive context-mixing range coder for token ids.

A block is coded by itself: models start empty, and a header carries the number of
ids and their crc32.  Its ids are dealt to up to 4096 lanes, each a run of
consecutive ids with a range coder of its own.  At step t every lane codes its t-th
id under one model shared by the block, which then learns from all of them, so one
numpy operation advances every lane.

Three predictions are mixed for each id: the id that last followed the lane's two
previous ids (order 2), the one that last followed the previous id (order 1), and
the block's id counts (order 0).  How far each is trusted is learned from how often
it was right at the same confidence.  All arithmetic is on integers, so that coder
and decoder agree on any machine.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC = b"CMX1"
HEAD = struct.Struct("<4sIIII")  # magic, alphabet, ids, lanes, crc32
LANES = 4096
STEPS = 64  # a lane is this long at least, but for short blocks
TOP_BITS, COUNT_BITS, TABLE_BITS = 8, 20, 18
SHIFT, HALF = np.uint64(TOP_BITS + COUNT_BITS), np.uint64(32)
TOP, BOTTOM, ONE = np.uint64(1 << 32), np.uint64(1 << 31), np.uint64(1)
#: Steps after which the order-0 counts are brought up to date; each 32nd step follows.
RECOUNT = frozenset((1, 2, 4, 8, 16))
RIGHT_CONTEXTS = 128


class Model:
    """What the block has taught so far; the same on both sides.

    A guess and the length of its run of hits (0 to 7) share one number: guess * 8 + run.
    """

    def __init__(self, alphabet: int, lanes: int, back: bool = False):
        if not 0 < alphabet <= 1 << (COUNT_BITS - 2):
            raise ValueError(f"an alphabet of {alphabet} ids; at most {1 << (COUNT_BITS - 2)} can be coded")
        self.alphabet = alphabet
        self.counts = np.zeros(alphabet, np.int64)
        self.unseen: list[np.ndarray] = []  # ids coded since the last recount
        self.after1 = np.zeros(alphabet, np.int32)
        self.after2 = np.zeros(1 << TABLE_BITS, np.int32)
        self.right = np.ones((RIGHT_CONTEXTS, 3), np.int64)
        self.right[:, 2] = 6
        self.previous = np.zeros(lanes, np.int64)
        self.slot = np.zeros(lanes, np.int64)
        self.step = 0
        self.edges = ((np.arange(alphabet + 1) << COUNT_BITS) // alphabet).astype(np.int32)
        self.back = back
        self.invert()
        self.reweigh()

    def recount(self) -> None:
        self.counts += np.bincount(np.concatenate(self.unseen), minlength=self.alphabet)
        self.unseen = []
        share = self.counts * ((1 << COUNT_BITS) - self.alphabet) // int(self.counts.sum()) + 1
        self.edges = np.zeros(self.alphabet + 1, np.int32)
        np.cumsum(share, out=self.edges[1:])
        self.edges[-1] = 1 << COUNT_BITS
        self.invert()

    def invert(self) -> None:
        """For a decoder, the id at each place between the first edge and the last."""
        if self.back:
            small = np.uint16 if self.alphabet <= 1 << 16 else np.int32  # so that more of it stays in the cache
            self.at = np.repeat(np.arange(self.alphabet, dtype=small), np.diff(self.edges))

    def reweigh(self) -> None:
        """Widths of the order-2 region and of both upper regions, in 256ths, by mixing context."""
        whole = self.right.sum(axis=1)
        two = np.maximum(1, self.right[:, 0] * 250 // whole)
        self.two = two.astype(np.int32)
        self.both = (two + np.maximum(1, self.right[:, 1] * 250 // whole)).astype(np.int32)

    def predict(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(order-2 id, order-1 id, width of the order-2 region, width of both upper regions)."""
        self.held2, self.held1 = self.after2.take(self.slot), self.after1.take(self.previous)
        p2, p1 = self.held2 >> 3, self.held1 >> 3
        self.runs2, self.runs1 = self.held2 & 7, self.held1 & 7
        context = self.runs2 << 3
        context |= self.runs1
        context |= (p1 == p2).view(np.int8).astype(np.int32) << 6
        self.context = context.astype(np.int64)
        return p2, p1, self.two.take(self.context), self.both.take(self.context)

    def learn(self, ids: np.ndarray, hit2: np.ndarray, hit1: np.ndarray) -> None:
        """hit2, hit1: whether each order's guess was right."""
        outcome = self.context * 4
        outcome += 2
        outcome -= hit1.view(np.int8)
        outcome[hit2] &= -4
        self.right += np.bincount(outcome, minlength=4 * RIGHT_CONTEXTS).reshape(-1, 4)[:, :3]
        fresh = ids << 3
        for table, at, run, hit in ((self.after2, self.slot, self.runs2, hit2), (self.after1, self.previous, self.runs1, hit1)):
            run += 1
            np.minimum(run, 7, out=run)
            run *= hit.view(np.int8)
            run |= fresh
            table[at] = run
        self.unseen.append(ids)
        slot = self.previous.astype(np.uint32)
        slot *= np.uint32(0x9E3779B1)
        slot += ids.view(np.uint32) * np.uint32(0x85EBCA77)
        slot >>= np.uint32(32 - TABLE_BITS)
        self.slot = slot.astype(np.int64)
        self.previous = ids.astype(np.int64)
        self.step += 1
        if self.step in RECOUNT or self.step % 32 == 0:
            self.recount()
        if self.step <= 8 or self.step % 4 == 0:
            self.reweigh()


def lanes_of(n: int) -> tuple[int, int]:
    lanes = max(1, min(LANES, -(-n // STEPS)))
    return lanes, -(-n // lanes)


def interval(model: Model, s: np.ndarray, in2: np.ndarray, in1: np.ndarray, two: np.ndarray, both: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(begin, size) of each id's interval; in2, in1: it is coded as the order-2 or the order-1 guess."""
    at = s.astype(np.int64)
    edge, rest = model.edges.take(at), 256 - both
    at += 1
    size = model.edges.take(at)
    size -= edge
    size *= rest
    begin = edge
    begin *= rest
    begin += both << COUNT_BITS
    at = np.flatnonzero(in2)
    begin[at], size[at] = 0, two.take(at) << COUNT_BITS
    at = np.flatnonzero(in1)
    low = two.take(at)
    begin[at], size[at] = low << COUNT_BITS, (both.take(at) - low) << COUNT_BITS
    return begin.astype(np.uint64), size.astype(np.uint64)


def unsettled(low: np.ndarray, wide: np.ndarray) -> np.ndarray:
    """Which lanes have 32 bits settled, or too narrow an interval."""
    return ((low ^ (low + wide)) < TOP) | (wide < BOTTOM)


def shifted(low: np.ndarray, wide: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both after 32 bits have left; a narrow interval across a carry is cut at it first."""
    narrow = np.flatnonzero((low ^ (low + wide)) >= TOP)
    if len(narrow):
        wide[narrow] = (~low[narrow] + ONE) & (BOTTOM - ONE)
    return low << HALF, wide << HALF


def encode(ids: np.ndarray, alphabet: int) -> bytes:
    """One block; ids below `alphabet`."""
    ids = np.ascontiguousarray(ids, np.uint32)
    n = len(ids)
    lanes, steps = lanes_of(n) if n else (0, 0)
    head = HEAD.pack(MAGIC, alphabet, n, lanes, zlib.crc32(ids.astype("<u4").tobytes()))
    if not n:
        return head
    if int(ids.max()) >= alphabet:
        raise ValueError("an id beyond the alphabet")
    table = np.zeros(lanes * steps, np.int32)
    table[:n] = ids
    table = table.reshape(lanes, steps).T.copy()
    model = Model(alphabet, lanes)
    low, wide = np.zeros(lanes, np.uint64), np.full(lanes, 2**64 - 1, np.uint64)
    out, put = np.zeros((lanes, 2 * steps + 4), np.uint32), np.zeros(lanes, np.int64)
    flat, base = out.reshape(-1), np.arange(lanes) * out.shape[1]
    for s in table:
        p2, p1, two, both = model.predict()
        hit2, hit1 = p2 == s, p1 == s
        begin, size = interval(model, s, hit2, hit1 & ~hit2, two, both)
        wide >>= SHIFT
        begin *= wide
        low += begin
        wide *= size
        at = np.flatnonzero(unsettled(low, wide))
        while len(at):
            lo = low[at]
            flat[base[at] + put[at]] = lo >> HALF
            put[at] += 1
            lo, wi = shifted(lo, wide[at])
            low[at], wide[at] = lo, wi
            at = at[unsettled(lo, wi)]
        model.learn(s, hit2, hit1)
    for _ in range(2):
        flat[base + put] = low >> HALF
        put += 1
        low <<= HALF
    body = out[np.arange(out.shape[1]) < put[:, None]]
    return head + put.astype("<u4").tobytes() + body.astype("<u4").tobytes()


def decode(block: bytes) -> np.ndarray:
    """The ids of a block; ValueError if it isn't what was written."""
    if len(block) < HEAD.size or block[:4] != MAGIC:
        raise ValueError("not a block of ids")
    _, alphabet, n, lanes, crc = HEAD.unpack_from(block)
    if not n:
        return np.zeros(0, np.uint32)
    if not lanes or (len(block) - HEAD.size) % 4 or len(block) < HEAD.size + 4 * lanes:
        raise ValueError("a block of ids was cut short")
    steps = -(-n // lanes)
    put = np.frombuffer(block, "<u4", lanes, HEAD.size).astype(np.int64)
    words = np.frombuffer(block, "<u4", -1, HEAD.size + 4 * lanes).astype(np.uint64)
    if len(words) != put.sum():
        raise ValueError("a block of ids was cut short")
    words = np.concatenate((words, np.zeros(2 * steps + 8, np.uint64)))
    at = np.cumsum(put) - put
    model = Model(alphabet, lanes, back=True)
    low, wide = np.zeros(lanes, np.uint64), np.full(lanes, 2**64 - 1, np.uint64)
    code = (words[at] << HALF) | words[at + 1]
    at += 2
    last = len(words) - 1
    table = np.zeros((steps, lanes), np.int32)
    whole = np.uint64((1 << (TOP_BITS + COUNT_BITS)) - 1)
    for t in range(steps):
        p2, p1, two, both = model.predict()
        wide >>= SHIFT
        value = np.minimum((code - low) // wide, whole).astype(np.int32)
        top = value >> COUNT_BITS
        in2, low_part = top < two, top < both
        s = np.where(in2, p2, p1)
        rest = np.flatnonzero(~low_part)
        some = both.take(rest)
        place = value.take(rest)
        place -= some << COUNT_BITS
        place //= 256 - some
        s[rest] = model.at.take(np.minimum(place, len(model.at) - 1))
        s = np.minimum(s, alphabet - 1)
        begin, size = interval(model, s, in2, low_part & ~in2, two, both)
        table[t] = s
        begin *= wide
        low += begin
        wide *= size
        go = np.flatnonzero(unsettled(low, wide))
        while len(go):
            read = at[go]
            code[go] = (code[go] << HALF) | words[np.minimum(read, last)]
            at[go] = read + 1
            lo, wi = shifted(low[go], wide[go])
            low[go], wide[go] = lo, wi
            go = go[unsettled(lo, wi)]
        model.learn(s, p2 == s, p1 == s)
    ids = table.T.reshape(-1)[:n].astype(np.uint32)
    if zlib.crc32(ids.astype("<u4").tobytes()) != crc:
        raise ValueError("a block of ids fails its checksum")
    return ids
