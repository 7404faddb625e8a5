"""An adaptive context-mixing range coder for token ids, many blocks at a time.

Every block starts from nothing and is coded by itself; numpy steps through
all blocks of a batch together, one id of each per step. The state of a block
is a few narrow rows, so that those of a whole batch stay in the processor's
caches.

Model: order 2 (the two ids before, hashed) and order 1 (the id before) each
predict the id that followed last time; order 0 is an adaptive distribution
over ranges of ids, even within a range, refreshed at fixed steps. The three
are mixed by adaptive weights, with one of their own for where both
predictions agree,
    P(x) = w2 [x = p2] + (1 - w2) w1 [x = p1] + (1 - w2)(1 - w1) Q0(x),
and the id's share of a 32-bit scale drives a range coder with 56-bit bounds,
16-bit output words and carries.

A coded block: number of ids and their CRC-32 (both little-endian, 4 bytes),
then the words (big-endian). Ids of 65,536 and more are split: the number of
ids has its top bit set, the length of the words of their lower 16 bits
follows (4 bytes), then these words and those of the upper bits, coded as a
block of their own. `decode` raises ValueError if the check fails.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

BLOCK, LONGEST = 4096, 8000
#: Fixed values of the format.
LOW_IDS = 1 << 16
WIDE = 1 << 31
T1_BITS, T2_BITS = 9, 10
SMALL, RANGES = 64, 64 + 248
EVERY = 512
RATE2, RATE1 = 4, 5
WIDTH = RANGES + 8
GROW = 1024

U = np.uint64
_EDGE, _TOP = U(1 << 40), U(40)
_LOW = U((1 << 40) - 1)
#: First id of each range and log2 of what its share is divided by: 32 ids below 2048, then 256.
FIRST = np.concatenate([np.arange(SMALL) * 32, 2048 + np.arange(RANGES - SMALL) * 256]).astype(np.int32)
MORE = np.where(np.arange(RANGES) < SMALL, 3, 0).astype(np.int32)
RANGE_OF = np.repeat(np.arange(RANGES), np.where(MORE > 0, 32, 256)).astype(np.int16)


class _Model:
    """The blocks' states, one row (or number) per block."""

    def __init__(self, lanes: int):
        row = np.arange(lanes, dtype=np.int64)
        self.r1, self.r2, self.rc, self.rg = row << T1_BITS, row << T2_BITS, row * WIDTH, row << 9
        self.t1 = np.zeros(lanes << T1_BITS, np.uint16)
        self.t2 = np.zeros(lanes << T2_BITS, np.uint16)
        # Weights in 4096ths: of order 2, of order 1 after it, and of both where they agree.
        self.w2, self.w1, self.both = (np.full(lanes, x, np.int64) for x in (256, 512, 512))
        self.counts = np.ones(lanes * WIDTH, np.uint16)
        self.cum = np.full(lanes * WIDTH, 4096, np.int16)
        self.start = np.zeros(lanes << 9, np.int16)
        self.a, self.b = np.zeros(lanes, np.uint32), np.zeros(lanes, np.uint32)

    def _refresh(self, m: int) -> None:
        """Order 0 of the first m blocks from the counts so far."""
        c = self.counts[: m * WIDTH].reshape(m, WIDTH)[:, :RANGES]
        share = c * (np.float32(4095 - RANGES) / c.sum(1, keepdims=True, dtype=np.float32))
        ends = np.cumsum(share.astype(np.int16) + np.int16(1), axis=1, dtype=np.int16)
        cum = self.cum[: m * WIDTH].reshape(m, WIDTH)
        cum[:, 0] = 0
        cum[:, 1:RANGES] = ends[:, :-1]
        # The last range that begins at or before each eighth of the scale.
        at = ((ends[:, :-1] + np.int16(7)) >> 3) + (np.arange(m, dtype=np.int32) * 513)[:, None]
        begun = np.bincount(at.reshape(-1), minlength=m * 513).reshape(m, 513)
        np.cumsum(begun[:, :512], axis=1, out=self.start[: m << 9].reshape(m, 512))

    def begin(self, t: int, m: int) -> None:
        """The predictions of the first m blocks."""
        if t % EVERY == 0 or (t >= 16 and t & (t - 1) == 0):
            self._refresh(m)
        a, b = self.a[:m], self.b[:m]
        self.i1 = (b * np.uint32(0x9E3779B1) >> np.uint32(32 - T1_BITS)) + self.r1[:m]
        self.i2 = (a * np.uint32(0x85EBCA6B) + b * np.uint32(0xC2B2AE35) >> np.uint32(32 - T2_BITS)) + self.r2[:m]
        self.p1, self.p2 = self.t1.take(self.i1, mode="clip"), self.t2.take(self.i2, mode="clip")
        self.agree = self.p1 == self.p2
        self.f2 = np.where(self.agree, self.both[:m], self.w2[:m])
        self.f1 = np.where(self.agree, 0, (4095 - self.f2) * self.w1[:m] + 4095 >> 12)  # leaves something to order 0
        self.f = self.f2 + self.f1
        self.fe = 4096 - self.f

    def learn(self, x: np.ndarray, m: int, hit2: np.ndarray, hit1: np.ndarray, escaped: np.ndarray, k: np.ndarray) -> None:
        """k: the ids' ranges' counts."""
        d = np.where(hit2, 4064, 32) - self.f2 >> RATE2
        agree = d * self.agree
        self.both[:m] += agree
        self.w2[:m] += d - agree
        w1 = self.w1[:m]
        w1 += (np.where(hit1, 4064, 32) - w1 >> RATE1) * (hit1 | escaped)
        self.t1[self.i1] = x
        self.t2[self.i2] = x
        self.counts[k] = self.counts.take(k, mode="clip") + escaped * np.uint16(8)
        self.a[:m] = self.b[:m]
        self.b[:m] = x

    def shares(self, escaped: np.ndarray, hit2: np.ndarray, inner: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each id's share of the scale begins, and its width."""
        begin = np.where(escaped, (self.f << 20) + self.fe * inner, np.where(hit2, 0, self.f2 << 20))
        width = np.where(escaped, self.fe * share, np.where(hit2, self.f2, self.f1) << 20)
        return begin.view(U), width.view(U)


def _plan(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Blocks from long to short, and how many are longer than each step."""
    order = np.argsort(-lengths, kind="stable")
    live = len(lengths) - np.searchsorted(np.sort(lengths), np.arange(lengths.max(initial=0)), "right")
    return order, live


def _words(ids: np.ndarray, at: np.ndarray) -> list[bytes]:
    """The words of the blocks ids[at[i]:at[i + 1]], ids below 65,536."""
    lengths = np.diff(at)
    order, live = _plan(lengths)
    lanes, longest = len(order), int(lengths.max(initial=0))
    steps = np.zeros((lanes, longest), np.uint16)
    for i, j in enumerate(order.tolist()):
        steps[i, : lengths[j]] = ids[at[j] : at[j + 1]]
    steps = np.ascontiguousarray(steps.T)
    model = _Model(lanes)
    low, span = np.zeros(lanes, U), np.full(lanes, (1 << 56) - 1, U)
    out = np.zeros((longest // 2 + GROW, lanes), np.uint32)
    flat = out.reshape(-1)
    n = np.arange(lanes)  # where each block's next word goes
    for t, m in enumerate(live.tolist()):
        if t % 256 == 0 and int(n.max(initial=0)) // max(1, lanes) + 600 > len(out):  # at most two words an id
            out = np.concatenate([out, np.zeros((GROW + len(out) // 2, lanes), np.uint32)])
            flat = out.reshape(-1)
        model.begin(t, m)
        x = steps[t, :m]
        hit2 = x == model.p2
        hit1 = (x == model.p1) & ~hit2
        escaped = ~(hit2 | hit1)
        bucket = RANGE_OF.take(x, mode="clip")
        k = model.rc[:m] + bucket
        c = model.cum.take(k, mode="clip").astype(np.int32)
        share = model.cum.take(k + 1, mode="clip") - c << MORE.take(bucket, mode="clip")
        begin, width = model.shares(escaped, hit2, (c << 8) + (x - FIRST.take(bucket, mode="clip")) * share, share)
        model.learn(x, m, hit2, hit1, escaped, k)
        lo, sp, to = low[:m], span[:m], n[:m]
        r = sp >> U(32)
        lo += r * begin
        np.multiply(r, width, out=sp)
        while (full := sp < _EDGE).any():
            flat[to] = lo >> _TOP  # written again, where it isn't full
            by = full * U(16)
            to += full * lanes
            np.left_shift(np.where(full, lo & _LOW, lo), by, out=lo)
            np.left_shift(sp, by, out=sp)
    for _ in range(4):
        flat[n] = low >> _TOP
        n += lanes
        low = (low & _LOW) << U(16)
    for i in range(int(n.max(initial=0)) // max(1, lanes), 0, -1):  # carries
        out[i - 1] += out[i] >> 16
    words = np.ascontiguousarray(out.astype(np.uint16).T).astype(">u2")
    many = (n // max(1, lanes)).tolist()
    done: list[bytes] = [b""] * lanes
    for i, j in enumerate(order.tolist()):
        done[j] = words[i, : many[i]].tobytes()
    return done


def encode(ids: np.ndarray, at: np.ndarray) -> list[bytes]:
    """Coded blocks ids[at[i]:at[i + 1]]; ids from 0 to 2**32 - 1."""
    ids = np.ascontiguousarray(ids)
    if len(ids) and not (0 <= int(ids.min()) and int(ids.max()) < 1 << 32):
        raise ValueError("ids must be below 2**32")
    at = np.asarray(at, np.int64)
    if len(at) > 1 and int(np.diff(at).max()) > LONGEST:
        raise ValueError(f"a block has at most {LONGEST} ids")
    wide = np.zeros(len(at) - 1, bool)
    high, high_at = None, at[:1]
    if len(ids) and int(ids.max()) >= LOW_IDS:
        wide = np.array([bool(len(x) and x.max() >= LOW_IDS) for x in (ids[a:b] for a, b in zip(at, at[1:], strict=False))])
        high = np.concatenate([ids[at[i] : at[i + 1]] for i in np.flatnonzero(wide)]).astype(np.int64) >> 16
        high_at = np.concatenate([[0], np.cumsum(np.diff(at)[wide])])
    words = _words((ids & 0xFFFF).astype(np.uint16) if high is not None else ids.astype(np.uint16), at)
    upper = iter(_words(high.astype(np.uint16), high_at) if high is not None else ())
    raw = memoryview(ids.astype("<u4").tobytes())
    blocks = []
    for i, (a, b) in enumerate(zip(at.tolist(), at[1:].tolist(), strict=False)):
        check = zlib.crc32(raw[4 * a : 4 * b])
        if wide[i]:
            blocks.append(struct.pack("<III", (b - a) | WIDE, check, len(words[i])) + words[i] + next(upper))
        else:
            blocks.append(struct.pack("<II", b - a, check) + words[i])
    return blocks


def _ids(words: list[bytes], lengths: np.ndarray) -> np.ndarray:
    """The ids below 65,536 of coded words, one block after another."""
    at = np.concatenate([[0], np.cumsum(lengths)])
    order, live = _plan(lengths)
    lanes = len(order)
    # A code begins with seven bytes; words follow.
    longest = max((len(w) - 6) // 2 for w in words) + 2 if words else 2
    rest = np.zeros((lanes, longest), ">u2")
    code = np.zeros(lanes, U)
    for i, j in enumerate(order.tolist()):
        w = words[j]
        code[i] = int.from_bytes(w[:7].ljust(7, b"\0"), "big")
        tail = w[7:] + b"\0" * (len(w) + 1 & 1)
        rest[i, : len(tail) // 2] = np.frombuffer(tail, ">u2")
    rest = np.ascontiguousarray(rest.astype(np.uint16).T).reshape(-1)
    steps = np.zeros((len(live), lanes), np.uint16)
    model = _Model(lanes)
    span = np.full(lanes, (1 << 56) - 1, U)
    n = np.arange(lanes)
    for t, m in enumerate(live.tolist()):
        model.begin(t, m)
        sp, co, to = span[:m], code[:m], n[:m]
        r = sp >> U(32)
        v = np.minimum(co // r, U((1 << 32) - 1)).view(np.int64)
        top = v >> 20
        hit2, escaped = top < model.f2, top >= model.f
        hit1 = ~(hit2 | escaped)
        u = np.maximum((v - (model.f << 20)) / model.fe, 0).astype(np.int32)
        goal = u >> 8
        k = model.rc[:m] + model.start.take(model.rg[:m] + (goal >> 3), mode="clip")
        for step in (4, 2, 1):
            k += (model.cum.take(k + step, mode="clip") <= goal) * step
        bucket = k - model.rc[:m]
        c = model.cum.take(k, mode="clip").astype(np.int32)
        share = model.cum.take(k + 1, mode="clip") - c << MORE.take(bucket, mode="clip")
        c <<= 8
        place = ((u - c) / share).astype(np.int32)
        x = np.where(escaped, (FIRST.take(bucket, mode="clip") + place).astype(np.uint16), np.where(hit2, model.p2, model.p1))
        begin, width = model.shares(escaped, hit2, c + place * share, share)
        steps[t, :m] = x
        model.learn(x, m, hit2, hit1, escaped, k)
        co -= r * begin
        np.multiply(r, width, out=sp)
        while (full := sp < _EDGE).any():
            by = full * U(16)
            np.left_shift(co, by, out=co)
            co |= rest.take(to, mode="clip") * full
            to += full * lanes
            np.left_shift(sp, by, out=sp)
    steps = np.ascontiguousarray(steps.T)
    ids = np.zeros(int(at[-1]), np.uint16)
    for i, j in enumerate(order.tolist()):
        ids[at[j] : at[j + 1]] = steps[i, : lengths[j]]
    return ids


def decode(blocks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all blocks one after another, and where each block's begin."""
    heads = [struct.unpack_from("<II", b) for b in blocks]
    lengths = np.array([h[0] & (WIDE - 1) for h in heads], np.int64)
    at = np.concatenate([[0], np.cumsum(lengths)])
    wide = [i for i, h in enumerate(heads) if h[0] & WIDE]
    words = [b[8:] for b in blocks]
    upper = []
    for i in wide:
        (size,) = struct.unpack_from("<I", words[i])
        upper.append(words[i][4 + size :])
        words[i] = words[i][4 : 4 + size]
    ids = _ids(words, lengths)
    if wide:
        high = _ids(upper, lengths[wide]).astype(np.uint32)
        ids = ids.astype(np.uint32)
        begin = 0
        for i in wide:
            ids[at[i] : at[i + 1]] |= high[begin : begin + lengths[i]] << np.uint32(16)
            begin += int(lengths[i])
    raw = memoryview(ids.astype("<u4").tobytes())
    for i, (_, check) in enumerate(heads):
        if zlib.crc32(raw[4 * int(at[i]) : 4 * int(at[i + 1])]) != check:
            raise ValueError(f"block {i} fails its check")
    return ids.astype(np.int64) if wide else ids.astype(np.int32), at
