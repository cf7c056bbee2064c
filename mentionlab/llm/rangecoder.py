"""Adaptive context-mixing range coder for numbers; many blocks are coded side by side with numpy.

Every block starts from the same empty model, so blocks are independent, and all blocks of a call advance together, one
number each per step: the model's state is an array over blocks.

Prediction of a number, in one block: the last that followed the two before (order 2), the last that followed the one
before (order 1), each with a confidence count, and a distribution over classes of numbers (order 0), a class being a
quarter of a power of two. Whether the candidate (order 2's, else order 1's) is right is predicted by three adaptive
logits, chosen by order 2's confidence, by order 1's confidence and whether it disagrees, and by neither; they are mixed
by adding them in the logistic domain, and each learns from the error of the mix. Order 0 is learned at steps that grow
apart. All arithmetic that decides is in integers (one division is of small whole numbers and exact), so any machine
decodes what another wrote.

Candidate and class share one interval of a 64-bit range coder that emits 32 bits at a time and carries; numbers of a class
are equally likely, so the bits inside it follow as they are. A coded block: how many words of 32 bits the coder has, these
words, the words of the bits (all little-endian).
"""

from __future__ import annotations

import math

import numpy as np

#: Numbers of a block; numbers are below 1 << ID_BITS.
BLOCK, ID_BITS = 2048, 17
_SLOTS = 10  # bits of a context table
_CLASSES, _EARLY, _REFRESH, _INC, _LIMIT = 64, (0, 8, 16, 32, 64), 128, 16, 1 << 13
_GATE, _SHARE = 12, 10  # bits of the candidate's probability and of a class's share
_TOTAL = _GATE + _SHARE
_LANES = 32  # blocks whose bits are packed together: what stays in the cache
_WORD, _U = np.uint64(32), np.uint64
_LOW = _U((1 << 32) - 1)

_v = np.arange(1 << ID_BITS, dtype=np.int64) + 4
_log = np.frexp(_v.astype(np.float64))[1].astype(np.int64) - 1
_width = (_log - 2).astype(np.int8)  # bits of a number inside its class
_class = (4 * (_log - 2) + ((_v >> _width) & 3)).astype(np.int8)
_first = np.zeros(_CLASSES, np.int32)  # first number of a class
_bits = np.zeros(_CLASSES, np.int64)
_first[_class[::-1]] = np.arange(1 << ID_BITS)[::-1]
_bits[_class] = _width

_SQUASH = np.array([max(1, min(4095, round(4096 / (1 + math.exp(-d / 256))))) for d in range(-2047, 2048)], np.int32)
_START = np.array([-4096 + 1434 * n for n in range(8)], np.int32)  # logits of confidences, times 4096


class _Model:
    """State of n blocks; the first `a` of them are active. A context's candidate and confidence share one number."""

    def __init__(self, n: int, decodes: bool):
        lane = np.arange(n)
        self.base, self.by8, self.by16, self.by64, self.by_share = lane << _SLOTS, lane * 8, lane * 16, lane * _CLASSES, lane << _SHARE
        self.tab1, self.tab2 = (np.zeros(n << _SLOTS, np.int32) for _ in range(2))
        self.s2, self.s1, self.s0 = np.tile(_START, n), np.tile(_START, 2 * n), np.zeros(n, np.int32)
        self.freq = np.full((n, _CLASSES), 4, np.int64)
        self.x1, self.h2 = np.full(n, (1 << ID_BITS) - 1), np.zeros(n, np.int64)
        self.learned, self.decodes = 0, decodes

    def learn(self, a: int, t: int, ids: np.ndarray) -> None:
        """Order 0 before step t: shares of classes, a power of two together, and for decoding the class of each place."""
        if t % _REFRESH and t not in _EARLY:
            return
        f = self.freq[:a]
        if t > self.learned:
            seen = _class[np.minimum(ids[self.learned : t, :a], (1 << ID_BITS) - 1)]
            f += _INC * np.bincount((seen + self.by64[:a]).ravel(), minlength=a * _CLASSES).reshape(a, _CLASSES)
            self.learned = t
            big = f.sum(axis=1) > _LIMIT
            f[big] = (f[big] + 1) >> 1
        share = 1 + f * ((1 << _SHARE) - _CLASSES) // f.sum(axis=1, keepdims=True)
        share[np.arange(a), f.argmax(axis=1)] += (1 << _SHARE) - share.sum(axis=1)
        self.share = ((np.cumsum(share, axis=1) - share) << _SHARE | share).astype(np.int32).ravel()
        if self.decodes:
            self.place = np.repeat(np.tile(np.arange(_CLASSES, dtype=np.int8), a), share.ravel())

    def predict(self, a: int) -> None:
        base, h1 = self.base[:a], self.x1[:a] * 10007
        self.i1 = (h1 >> 3 & ((1 << _SLOTS) - 1)) + base
        self.i2 = (h1 * 3 + self.h2[:a] >> 4 & ((1 << _SLOTS) - 1)) + base
        self.t1, self.t2 = self.tab1.take(self.i1, mode="clip"), self.tab2.take(self.i2, mode="clip")
        self.n1, self.n2, self.a1, self.a2 = self.t1 & 7, self.t2 & 7, self.t1 >> 3, self.t2 >> 3
        two, one = self.n2 > 0, self.n1 > 0
        self.has = two | one
        self.A = np.where(two, self.a2, self.a1)
        self.j2 = self.by8[:a] + self.n2
        self.j1 = self.by16[:a] + self.n1 + ((two & one & (self.a1 != self.a2)).view(np.int8) << 3)
        self.g2, self.g1 = self.s2.take(self.j2, mode="clip"), self.s1.take(self.j1, mode="clip")
        self.p = _SQUASH.take((self.g2 + self.g1 + self.s0[:a] >> 4) + 2047, mode="clip") * self.has

    def update(self, a: int, x: np.ndarray, isA: np.ndarray) -> None:
        step = ((isA.astype(np.int32) << _GATE) - self.p) * np.int32(20) >> 8  # none where there was no candidate
        self.s2[self.j2] = self.g2 + step
        self.s1[self.j1] = self.g1 + step
        self.s0[:a] += step
        fresh = x << 3 | 1
        for tab, i, t, c, n in ((self.tab1, self.i1, self.t1, self.a1, self.n1), (self.tab2, self.i2, self.t2, self.a2, self.n2)):
            tab[i] = np.where(c == x, t + (n < 7), np.where(n > 1, t - (n + 1 >> 1), fresh))  # right: one more, wrong: half
        np.multiply(self.x1[:a], 7919, out=self.h2[:a])
        self.x1[:a] = x


def _order(lengths: list[int]) -> np.ndarray:
    return np.argsort(-np.asarray(lengths, np.int64), kind="stable")


def _packed(ids: np.ndarray, sent: np.ndarray) -> list[bytes]:
    """The bits inside their classes of the numbers that are sent, as 32-bit words for each block."""
    n = ids.shape[1]
    rows, at = np.nonzero(sent.T)
    x = ids[at, rows]
    width = _bits[_class[x]]
    ends = np.cumsum(width)
    count = np.bincount(rows, minlength=n)
    bit = ends - width - np.concatenate(([0], ends))[np.cumsum(count) - count][rows]
    size = (np.bincount(rows, width, n).astype(np.int64) + 31) >> 5
    first = np.cumsum(size) - size
    value = (x - _first[_class[x]]).astype(np.uint64) << (64 - (bit & 31) - width - (width == 0)).astype(np.uint64)
    word = first[rows] + (bit >> 5)
    total = int(size.sum())
    out = np.bincount(word, value >> _WORD, total + 2)  # bits of a word are apart: sums below 2 ** 32 are exact
    out[1:] += np.bincount(word, value & _LOW, total + 1)[: len(out) - 1]
    words = out.astype("<u4")
    return [words[i : i + k].tobytes() for i, k in zip(first.tolist(), size.tolist())]


def encode(blocks: list[np.ndarray]) -> list[bytes]:
    """Each block of numbers as bytes."""
    if not blocks:
        return []
    order = _order([len(b) for b in blocks])
    lengths = np.array([len(blocks[i]) for i in order], np.int64)
    n, longest = len(blocks), int(lengths[0])
    ids = np.zeros((longest, n), np.int32)
    for k, i in enumerate(order):
        if len(blocks[i]) and int(blocks[i].max()) >> ID_BITS:
            raise ValueError(f"numbers must be below {1 << ID_BITS}")
        ids[: len(blocks[i]), k] = blocks[i]
    low, rng = np.zeros(n, _U), np.full(n, (1 << 64) - 1, _U)
    most = _TOTAL * longest // 32 + 8
    out, pos = np.zeros(n * most, _U), np.arange(n) + n  # words of a block lie n apart; the one before its first stays zero
    sent = np.zeros((longest, n), bool)
    model = _Model(n, False)
    a = n
    for t in range(longest):
        while lengths[a - 1] <= t:
            a -= 1
        x = ids[t, :a]
        model.learn(a, t, ids)
        model.predict(a)
        isA = model.has & (model.A == x)
        np.logical_not(isA, out=sent[t, :a])
        share = model.share.take(model.by64[:a] + _class.take(x), mode="clip")
        hit, rest = model.p << _SHARE, (1 << _GATE) - model.p
        start = np.where(isA, 0, hit + rest * (share >> _SHARE)).astype(_U)
        width = np.where(isA, hit, rest * (share & ((1 << _SHARE) - 1))).astype(_U)
        unit = rng[:a] >> _U(_TOTAL)
        start *= unit
        was = low[:a]
        was += start
        carry = np.flatnonzero(was < start)
        if len(carry):
            out[pos[carry] - n] += _U(1)
        np.multiply(width, unit, out=rng[:a])
        i = np.flatnonzero(rng[:a] <= _LOW)
        if len(i):
            li = low[i]
            pi = pos[i]
            out[pi] = li >> _WORD
            pos[i] = pi + n
            low[i] = li << _WORD
            rng[i] <<= _WORD
        model.update(a, x, isA)
    for _ in range(2):
        out[pos] = low >> _WORD
        pos += n
        low <<= _WORD
    out = out.reshape(most, n)
    for k in range(most - 1, 0, -1):
        out[k - 1] += out[k] >> _WORD
    words, counts = np.ascontiguousarray((out & _LOW).astype("<u4").T), pos // n
    raw = [b for k in range(0, n, _LANES) for b in _packed(ids[:, k : k + _LANES], sent[:, k : k + _LANES])]
    done: list[bytes] = [b""] * n
    for k, i in enumerate(order):
        if lengths[k]:
            done[i] = b"".join((int(counts[k] - 1).to_bytes(4, "little"), words[k, 1 : counts[k]].tobytes(), raw[k]))
    return done


def decode(blocks: list[bytes], lengths: list[int]) -> list[np.ndarray]:
    """The numbers of each block, given how many it has."""
    if not blocks:
        return []
    order = _order(lengths)
    sizes = np.array([lengths[i] for i in order], np.int64)
    n, longest = len(blocks), int(sizes[0])
    coded, raw = [], []
    for i in order:
        words = np.frombuffer(blocks[i], "<u4", len(blocks[i]) // 4)
        split = min(1 + int(words[0]), len(words)) if len(words) else 0
        coded.append(words[1:split])
        raw.append(words[split:])
    data = np.zeros((n, max(map(len, coded)) + 2), _U)
    bits = np.zeros((n, max(map(len, raw)) + 2), _U)
    for k in range(n):
        data[k, : len(coded[k])] = coded[k]
        bits[k, : len(raw[k])] = raw[k]
    bits[:, :-1] = bits[:, :-1] << _WORD | bits[:, 1:]  # the 64 bits from each word on
    rng, code = np.full(n, (1 << 64) - 1, _U), data[:, 0] << _WORD | data[:, 1]
    pos, bit = np.arange(n) * data.shape[1] + 2, np.arange(n) * (32 * bits.shape[1])
    data, bits = data.ravel(), bits.ravel()
    ids = np.zeros((longest, n), np.int32)
    model = _Model(n, True)
    a = n
    for t in range(longest):
        while sizes[a - 1] <= t:
            a -= 1
        model.learn(a, t, ids)
        model.predict(a)
        unit = rng[:a] >> _U(_TOTAL)
        at = (code[:a] // unit).astype(np.int64)
        hit, rest = model.p << _SHARE, (1 << _GATE) - model.p
        isA = at < hit
        place = ((at - hit) / rest).astype(np.int64)  # says nothing where the candidate is right
        c = model.place.take(model.by_share[:a] + place, mode="clip")
        share = model.share.take(model.by64[:a] + c, mode="clip")
        start = np.where(isA, 0, hit + rest * (share >> _SHARE)).astype(_U)
        width = np.where(isA, hit, rest * (share & ((1 << _SHARE) - 1))).astype(_U)
        start *= unit
        code[:a] -= start
        np.multiply(width, unit, out=rng[:a])
        i = np.flatnonzero(rng[:a] <= _LOW)
        if len(i):
            code[i] = code[i] << _WORD | data.take(pos[i], mode="clip")
            pos[i] += 1
            rng[i] <<= _WORD
        inside = _bits.take(c, mode="clip") * ~isA
        own = bit[:a]
        extra = bits.take(own >> 5, mode="clip") << (own & 31).astype(_U) >> (63 - inside).astype(_U) >> _U(1)
        own += inside
        x = np.where(isA, model.A, _first.take(c, mode="clip") + extra.astype(np.int32))
        model.update(a, x, isA)
        ids[t, :a] = x
    out: list[np.ndarray] = [np.zeros(0, np.int32)] * n
    for k, i in enumerate(order):
        out[i] = ids[: lengths[i], k].copy()
    return out
