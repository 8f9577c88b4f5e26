"""An adaptive context-mixing range coder for token ids, run on many blocks at once.

Ids are cut into blocks of BLOCK.  Each block starts from the same initial state
and is coded alone, so any block can be decoded, or lost, without the others;
a block carries its id count, its length and the CRC-32 of its ids.  The blocks
of a stream are coded in lockstep: every step codes one id of every block with
array operations.

Three orders predict the next id, each by id.  Order 2 and order 1 remember, by a
hash of the last two ids and of the last id, the id that followed and a
confidence; both learn after every id.  Order 0 is a distribution over all ids of
the stream: the header has each id's rounded log count, ids of like counts form
groups, and every block adapts the groups' shares to the ids it has seen (a
frequent id is a group of its own).  With p2 and p1 the remembered ids,

    P(x) = w2 [x = p2] + w1 [x = p1] + w0 P0(x).

The weights are learned in each block: how often predictions of each confidence
came true.  An id's interval is one piece of the line in the order of the ids'
ranks by count, and a 64-bit carry-less range coder takes it.
"""

from __future__ import annotations

import math
import struct
import zlib

import numpy as np

MAGIC = b"TSID"
VERSION = 2
BLOCK = 2048
LANES = 4096
MAX_VOCAB = 1 << 18
_U = np.uint64
_S1, _S2 = 9, 10  # log2 of the slots of orders 1 and 2
_A, _B, _C = np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B), np.uint32(0x27D4EB2F)
_TOP, _LOW, _BOT, _SIXTEEN = _U(48), _U((1 << 48) - 1), _U(1 << 48), _U(16)
_ONE = 1 << 12  # of a weight, of the groups' shares and of the shares within a group
_BITS = _U(36)  # log2 of the whole line
_LEVELS = 8  # confidences: 0 nothing seen, 1 seen once, then by hits
_PRIOR = np.linspace(0.01, 0.9, _LEVELS)
_GROUPS, _GROUP_IDS = 256, 2048
_GRAIN = 16  # of a count
_STRIDE = 32  # steps that are worked on together, few enough for a processor's cache
_START = 700  # ids that the initial shares of the groups are worth
_HEAD = struct.Struct("<4sHHIIQI")  # magic, version, block size, vocabulary, blocks, ids, bytes of the log counts
_BLOCK_HEAD = struct.Struct("<III")  # ids, 16-bit words, CRC-32 of the ids
_THREE, _SEVEN = np.uint32(3), np.uint32(7)


def log_counts(ids: np.ndarray, vocab: int) -> np.ndarray:
    """For each id 0, or one and four times the rounded binary logarithm of its count."""
    c = np.bincount(ids, minlength=vocab)
    return np.where(c > 0, 1 + np.rint(4 * np.log2(np.maximum(c, 1))), 0).astype(np.uint8)


def _pairs(left: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Left ends and sizes as the two parts of one number, so that one look-up finds both; whole numbers to 2**24 are exact."""
    out = np.empty(left.shape, np.complex64)
    out.real, out.imag = left, size
    return out


class Prior:
    """Ranks of the ids of a stream, their groups, and each id's share of its group."""

    def __init__(self, logs: np.ndarray):
        self.id_of = np.lexsort((np.arange(len(logs)), -logs.astype(np.int64)))[: int((logs > 0).sum())]
        n = len(self.id_of)
        self.rank = np.zeros(len(logs), np.uint32)
        self.rank[self.id_of] = np.arange(n)
        table = np.array([0, *(math.isqrt(math.isqrt(1 << (k + 24))) for k in range(160))], np.int64)
        w = table[np.minimum(logs[self.id_of], 160)]
        left = np.cumsum(w) - w
        parts = _GROUPS - -(-n // _GROUP_IDS)
        group = np.unique((left.astype(float) * (parts / max(1, int(w.sum())))).astype(np.int64) + np.arange(n) // _GROUP_IDS, return_inverse=True)[1]
        self.n = n_groups = int(group.max()) + 1 if n else 0
        sums = np.bincount(group, w, n_groups).astype(np.int64)
        sizes = np.bincount(group, minlength=n_groups)
        self.start = np.maximum(1, sums * (_START * _GRAIN) // max(1, int(sums.sum())))
        q = 1 + w * (_ONE - sizes[group]) // sums[group]
        first = np.cumsum(sizes) - sizes
        q[first] += _ONE - np.bincount(group, q, n_groups).astype(np.int64)
        cum = np.cumsum(q) - q
        own = cum - cum[first][group]
        self.group = group.astype(np.uint8)
        self.span = _pairs(own, q)  # of an id within its group
        self.inverse = np.repeat(np.arange(n, dtype=np.uint16 if n <= 1 << 16 else np.uint32), q)


def _epochs(steps: int) -> list[tuple[int, int, bool]]:
    """(first, last + 1, whether the groups' shares are renewed before) of the epochs of a block."""
    marks = sorted({m for m in (0, 16, 32, 64, 128, 192, *range(256, steps, 256), steps) if m <= steps})
    return [(a, b, a in (0, 32, 64, 128) or a % 256 == 0) for a, b in zip(marks[:-1], marks[1:])]


class _Model:
    """The state of a group of lanes; arrays over both orders have order 1 first, then order 2."""

    def __init__(self, lanes: int, prior: Prior):
        self.p, self.lanes = prior, lanes
        self.slots = np.zeros((lanes << _S1) + (lanes << _S2), np.uint32)
        self.right, self.seen = np.zeros(2 * lanes * _LEVELS), np.zeros(2 * lanes * _LEVELS)
        lane = np.arange(lanes)
        self.base = np.concatenate([lane << _S1, (lanes << _S1) + (lane << _S2)])
        self.level = np.arange(2 * lanes) * _LEVELS
        self.own, self.own2, self.units = lane * prior.n, np.tile(lane * prior.n, 2), lane * _ONE
        self.counts = np.tile(prior.start, (lanes, 1))

    def begin(self, renew: bool, inverse: bool) -> None:
        """Weights of an epoch, and the groups' shares."""
        share = (self.right.reshape(-1, _LEVELS) + 6 * _PRIOR) / (self.seen.reshape(-1, _LEVELS) + 6)
        self.share = np.floor(np.clip(share * _ONE, 4, _ONE - 128)).ravel()
        if renew:
            total = self.counts.sum(axis=1, keepdims=True)
            q = np.maximum(1, (2 * _ONE * self.counts + total) // (2 * total))
            top, more = q.argmax(axis=1), _ONE - q.sum(axis=1)
            bad = np.flatnonzero(q.max(axis=1) + more < 1)
            if len(bad):  # rounding up took too much: round down
                q[bad] = 1 + self.counts[bad] * (_ONE - self.p.n) // total[bad]
                top[bad], more[bad] = q[bad].argmax(axis=1), _ONE - q[bad].sum(axis=1)
            q[np.arange(self.lanes), top] += more
            self.span = _pairs(_ONE * (np.cumsum(q, axis=1) - q), q).ravel()
            if inverse:
                self.inv = np.repeat(np.tile(np.arange(self.p.n, dtype=np.uint8), self.lanes), q.ravel())

    def places(self, p1: np.ndarray, p2: np.ndarray, out: np.ndarray) -> None:
        """Slots of contexts of ranks (uint32); out is (..., 2 * lanes)."""
        n, a = self.lanes, p1 * _A
        out[..., :n] = a >> np.uint32(32 - _S1)
        a ^= p2 * _B
        a *= _C
        out[..., n:] = a >> np.uint32(32 - _S2)
        out += self.base

    def learn(self, e: np.ndarray, at: np.ndarray, x2: np.ndarray) -> None:
        """Slots `at` with entries e meet the ranks x2 (the ranks of the step, twice, shifted as in entries).

        A hit adds to the confidence; a miss halves one above 2 and else gives the slot to the new id.
        """
        low = e & _SEVEN
        own = e ^ low
        hit = own == x2
        own |= low >> np.uint32(1)
        np.copyto(own, x2 | np.uint32(1), where=low < _THREE)
        np.copyto(own, e + (low < _SEVEN), where=hit)
        self.slots[at] = own

    def weights(self, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(w0, w1, w2): whole numbers, w0 in parts of _ONE and the others of the whole line."""
        n = self.lanes
        s = self.share.take((e & _SEVEN) + self.level)
        w2 = s[..., n:]
        w1 = np.floor((1 - w2 * (1 / _ONE)) * s[..., :n])
        return _ONE - w1 - w2, w1 * (1 << 24), w2 * (1 << 24)

    def zero(self, x: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(left end, size) of ranks on the line of order 0, which has 2**24 parts; own: where the lanes' groups are."""
        group, within = self.span.take(self.p.group.take(x) + own), self.p.span.take(x)
        q = group.imag
        return (group.real + q * within.real).astype(float), (q * within.imag).astype(float)

    def intervals(self, x: np.ndarray, p: np.ndarray, w) -> tuple[np.ndarray, np.ndarray]:
        """(left end, size) of ranks on the whole line, given the remembered ids and the weights."""
        n, (w0, w1, w2) = self.lanes, w
        p1, p2 = p[..., :n], p[..., n:]
        left, size = self.zero(x, self.own)
        left = left * w0 + (w1 * (p1 < x) + w2 * (p2 < x))
        size = size * w0 + (w1 * (p1 == x) + w2 * (p2 == x))
        return left.astype(_U), size.astype(_U)

    def tally(self, x: np.ndarray, e: np.ndarray) -> None:
        """Take in how often the entries of some steps were right; x: their ranks, steps x lanes."""
        at = (e & _SEVEN) + self.level
        at <<= 1
        at.reshape(-1, 2, self.lanes)[...] |= (e >> _THREE).reshape(-1, 2, self.lanes) == x[:, None]
        n = np.bincount(at.ravel(), minlength=2 * len(self.seen)).reshape(-1, 2)
        self.seen += n[:, 0] + n[:, 1]
        self.right += n[:, 1]

    def end(self, x: np.ndarray) -> None:
        """Take in the groups of the ranks of an epoch."""
        at = (self.p.group.take(x) + self.own).ravel()
        self.counts += _GRAIN * np.bincount(at, minlength=self.counts.size).reshape(self.counts.shape)


def _rounds(low: np.ndarray, rng: np.ndarray):
    """Rounds of (lanes, top words) to shift out, until every range is 2**48 again."""
    todo = np.flatnonzero(rng < _BOT)
    while len(todo):
        a, b = low.take(todo), rng.take(todo)
        top = a >> _TOP
        split = top != (a + b) >> _TOP
        b = np.where(split, (~a + _U(1)) & _LOW, b) << _SIXTEEN
        low[todo], rng[todo] = a << _SIXTEEN, b
        yield todo, top
        todo = todo[b < _BOT]


def _encode_group(grid: np.ndarray, prior: Prior) -> list[bytes]:
    """grid: ranks, steps x lanes."""
    steps, lanes = grid.shape
    m = _Model(lanes, prior)
    low, rng = np.zeros(lanes, _U), np.full(lanes, (1 << 64) - 1, _U)
    # words of the same place of all lanes lie together, so that a step touches few pages
    out, pos = np.zeros((3 * steps + 8) * lanes, np.uint16), np.arange(lanes)
    before = np.zeros((steps + 2, lanes), np.uint32)
    before[2:] = grid
    for a, b, renew in _epochs(steps):
        m.begin(renew, False)
        for u in range(a, b, _STRIDE):
            v = min(b, u + _STRIDE)
            at, e = np.empty((v - u, 2 * lanes), np.int64), np.empty((v - u, 2 * lanes), np.uint32)
            m.places(before[u + 1 : v + 1], before[u:v], at)
            twice = np.concatenate([grid[u:v], grid[u:v]], axis=1) << _THREE
            for t in range(v - u):
                m.slots.take(at[t], out=e[t], mode="clip")
                m.learn(e[t], at[t], twice[t])
            left, size = m.intervals(grid[u:v].astype(np.int64), (e >> _THREE).astype(np.int64), m.weights(e))
            for t in range(v - u):
                r = rng >> _BITS
                low += r * left[t]
                rng = r * size[t]
                for todo, top in _rounds(low, rng):
                    i = pos.take(todo)
                    out[i] = top
                    pos[todo] = i + lanes
            m.tally(grid[u:v], e)
        m.end(grid[a:b])
    for _ in range(4):
        out[pos] = low >> _TOP
        low <<= _SIXTEEN
        pos += lanes
    used = (pos - np.arange(lanes)) // lanes
    own = np.ascontiguousarray(out.reshape(-1, lanes)[: used.max()].T)
    return [own[k, :n].astype("<u2").tobytes() for k, n in enumerate(used)]


def _decode_group(parts: list[np.ndarray], steps: int, prior: Prior) -> np.ndarray:
    lanes = len(parts)
    src = np.zeros((lanes, max(len(p) for p in parts) + 4), np.uint16)
    for k, p in enumerate(parts):
        src[k, : len(p)] = p
    src, lane = np.ascontiguousarray(src.T).ravel(), np.arange(lanes)
    m = _Model(lanes, prior)
    low, rng, code = np.zeros(lanes, _U), np.full(lanes, (1 << 64) - 1, _U), np.zeros(lanes, _U)
    for k in range(4):
        code = (code << _SIXTEEN) | src[k * lanes : (k + 1) * lanes]
    pos = 4 * lanes + lane
    grid = np.zeros((steps, lanes), np.uint32)
    p1, p2, whole, last = np.zeros(lanes, np.uint32), np.zeros(lanes, np.uint32), _U((1 << 36) - 1), float((1 << 24) - 1)
    at, x2 = np.empty(2 * lanes, np.int64), np.empty(2 * lanes, np.uint32)
    for a, b, renew in _epochs(steps):
        m.begin(renew, True)
        es = np.empty((_STRIDE, 2 * lanes), np.uint32)
        for t in range(a, b):
            m.places(p1, p2, at)
            e = m.slots.take(at, out=es[(t - a) % _STRIDE], mode="clip")
            p, w = (e >> _THREE).astype(np.int64), m.weights(e)
            (w0, w1, w2), q1, q2 = w, p[:lanes], p[lanes:]
            r = rng >> _BITS
            v = np.minimum((code - low) // r, whole).astype(float)
            # the pieces of the remembered ids on the whole line; ids that agree share one
            left, size = m.zero(p, m.own2)
            agree = q1 == q2
            l1 = left[:lanes] * w0 + w2 * (q2 < q1)
            l2 = left[lanes:] * w0 + w1 * (q1 < q2)
            s1 = size[:lanes] * w0 + w1 + w2 * agree
            s2 = size[lanes:] * w0 + w2 + w1 * agree
            past1, past2 = v >= l1 + s1, v >= l2 + s2
            # what is left is order 0
            more = w1 * past1 + w2 * past2
            z = np.minimum((v - more) / w0, last)
            i = (z * (1 / _ONE)).astype(np.int64)
            i += m.units
            g = m.inv.take(i).astype(np.int64)
            i = g + m.own
            group = m.span.take(i)
            left, q = group.real, group.imag
            g <<= 12
            g += ((np.floor(z).astype(np.float32) - left) / q).astype(np.int64)
            x = prior.inverse.take(g).astype(np.int64)
            within = prior.span.take(x)
            left = (left + q * within.real).astype(float) * w0 + more
            size = (q * within.imag).astype(float) * w0
            hit = (v >= l2) > past2
            for to, of in ((x, q2), (left, l2), (size, s2)):
                np.copyto(to, of, where=hit)
            hit = (v >= l1) > past1
            for to, of in ((x, q1), (left, l1), (size, s1)):
                np.copyto(to, of, where=hit)
            low += r * left.astype(_U)
            rng = r * size.astype(_U)
            p2 = p1
            p1 = grid[t] = x.astype(np.uint32)
            x2[:lanes] = p1 << _THREE
            x2[lanes:] = x2[:lanes]
            m.learn(e, at, x2)
            for todo, _ in _rounds(low, rng):
                i = pos.take(todo)
                code[todo] = (code.take(todo) << _SIXTEEN) | src.take(i, mode="clip")
                pos[todo] = i + lanes
            if (n := (t - a) % _STRIDE + 1) == _STRIDE or t + 1 == b:
                m.tally(grid[t + 1 - n : t + 1], es[:n])
        m.end(grid[a:b])
    return grid


def encode(ids: np.ndarray, vocab: int, block: int = BLOCK, lanes: int = LANES) -> bytes:
    """A self-contained stream: header and log counts, then blocks, each with its own checksum.

    The last block of several is filled up with its stream's commonest id, which costs next to nothing.
    """
    if vocab > MAX_VOCAB:
        raise ValueError(f"at most {MAX_VOCAB} ids")
    ids = np.asarray(ids, np.uint32)
    logs = log_counts(ids, vocab)
    if len(logs) > vocab:
        raise ValueError("an id is beyond the vocabulary")
    packed = zlib.compress(logs.tobytes(), 9)
    n_blocks = -(-len(ids) // block)
    out = [_HEAD.pack(MAGIC, VERSION, block, vocab, n_blocks, len(ids), len(packed)), packed]
    if n_blocks:
        prior, steps = Prior(logs), min(block, len(ids))
    for a in range(0, n_blocks, lanes):
        part = ids[a * block : (a + lanes) * block]
        n = -(-len(part) // block)
        grid = np.zeros(n * steps, np.uint32)
        grid[: len(part)] = prior.rank.take(part)
        for k, data in enumerate(_encode_group(np.ascontiguousarray(grid.reshape(n, steps).T), prior)):
            own = part[k * block : (k + 1) * block]
            out += [_BLOCK_HEAD.pack(len(own), len(data) // 2, zlib.crc32(own.astype("<u4").tobytes())), data]
    return b"".join(out)


def decode(data: bytes, lanes: int = LANES) -> np.ndarray:
    """The ids of a stream; ValueError if a block does not match its checksum."""
    magic, version, block, vocab, n_blocks, n_ids, n_logs = _HEAD.unpack_from(data)
    if magic != MAGIC or version != VERSION:
        raise ValueError("not a token-id stream")
    at, out, heads = _HEAD.size + n_logs, [], []
    try:
        logs = np.frombuffer(zlib.decompress(data[_HEAD.size : at]), np.uint8)
    except zlib.error as e:
        raise ValueError("the log counts are damaged") from e
    for _ in range(n_blocks):
        size, words, crc = _BLOCK_HEAD.unpack_from(data, at)
        at += _BLOCK_HEAD.size
        heads.append((size, crc, np.frombuffer(data, "<u2", words, at)))
        at += 2 * words
    if n_blocks:
        prior = Prior(logs)
    for a in range(0, n_blocks, lanes):
        own = heads[a : a + lanes]
        got = prior.id_of.take(np.ascontiguousarray(_decode_group([h[2] for h in own], min(block, n_ids), prior).T))
        for ids, (size, crc, _) in zip(got, own):
            if zlib.crc32(ids[:size].astype("<u4").tobytes()) != crc:
                raise ValueError("a block does not match its checksum")
            out.append(ids[:size])
    ids = np.concatenate(out).astype(np.int64) if out else np.zeros(0, np.int64)
    if len(ids) != n_ids:
        raise ValueError("the stream is cut short")
    return ids
