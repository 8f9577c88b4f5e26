"""Vectorised word scanning over Arrow text columns.

A *word* is a maximal run of bytes other than ``\\x20`` and ``\\x09-\\x0D``; UTF-8
continuation bytes never fall in that set, so scanning bytes equals scanning
code points.  A null text counts as an empty one.  Texts of any length are
scanned whole, in blocks that bound the working memory.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WORD = r"[^\x20\x09-\x0D]+"
SLICE_BYTES = 1 << 20
LONG_WORD = 256
_U = np.uint64
_MASK = (1 << 64) - 1
_M1, _M2 = _U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F)
KEEP = np.array([(1 << (8 * i)) - 1 for i in range(9)], _U)

SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def splitmix(x: int) -> int:
    x = (x + 0x9E3779B97F4A7C15) & _MASK
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & _MASK
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & _MASK
    return x ^ (x >> 31)


_SEED = np.array([splitmix(i + 1) for i in range(8)], _U)


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes so that every bit range is usable as a key."""
    h = (h ^ (h >> _U(32))) * _U(0xD6E8FEB86659FD93)
    h = (h ^ (h >> _U(29))) * _U(0xBF58476D1CE4E5B9)
    return h ^ (h >> _U(32))


def unmix(h: np.ndarray) -> np.ndarray:
    """The hashes that mix() took."""
    h = (h ^ (h >> _U(32))) * _U(pow(0xBF58476D1CE4E5B9, -1, 1 << 64))
    h = (h ^ (h >> _U(29)) ^ (h >> _U(58))) * _U(pow(0xD6E8FEB86659FD93, -1, 1 << 64))
    return h ^ (h >> _U(32))


def join(a: np.ndarray, b: np.ndarray, seed=_U(0)) -> np.ndarray:
    """Hash of a pair of hashes: one to one in either of them, and mixed, so that chains of it have no algebra of their own."""
    return mix(a * _M1 + b + seed)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte strings data[starts:ends].

    Strings are taken eight bytes at a time, so strings of one length up to eight
    bytes never collide; those beyond LONG_WORD bytes are hashed by BLAKE2b.
    """
    n = ends - starts
    whole = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(data) + 1, "<u8", buffer=whole, strides=(1,))
    h = mix((eight[starts] & KEEP[np.minimum(n, 8)]) ^ (n.astype(_U) * _M2))
    todo, at = np.flatnonzero(n > 8), 8
    while len(todo) and at < LONG_WORD:
        h[todo] = join(h[todo], eight[starts[todo] + at] & KEEP[np.minimum(n[todo] - at, 8)])
        at += 8
        todo = todo[n[todo] > at]
    for i in np.flatnonzero(n > LONG_WORD).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]], digest_size=8).digest(), "little")
    return h


def strings(arr) -> pa.Array:
    """One contiguous array of 64-bit-offset strings, nulls as empty texts."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    return pc.fill_null(arr.cast(pa.large_string()), "")


def byte_view(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a large_string array, offsets from zero."""
    n = len(arr)
    bufs = arr.buffers()
    offs = np.frombuffer(bufs[1], np.int64)[arr.offset : arr.offset + n + 1] if n else np.zeros(1, np.int64)
    if bufs[2] is None or offs[-1] == offs[0]:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    data = np.frombuffer(bufs[2], np.uint8)[offs[0] : offs[-1]]
    return data, offs - offs[0]


def slices(batch: pa.RecordBatch, text: str = "text", limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Cut a batch into runs of rows of about `limit` bytes of text; a longer text is a run of its own."""
    if not batch.num_rows:
        return
    arr = strings(batch.column(batch.schema.get_field_index(text)))
    offs = np.frombuffer(arr.buffers()[1], np.int64)[arr.offset : arr.offset + len(arr) + 1]
    a, n = 0, len(arr)
    while a < n:
        b = int(np.searchsorted(offs, offs[a] + limit, "right")) - 1
        b = min(n, max(a + 1, b))
        yield batch.slice(a, b - a), arr.slice(a, b - a)
        a = b


class Words:
    """Words of a run of texts: byte spans, 64-bit hashes, and the word range of each text."""

    __slots__ = ("data", "ends", "first", "hashes", "offs", "starts")

    def __init__(self, arr: pa.Array, lower: bool = False, hashed: bool = True, space: np.ndarray = SPACE):
        data, self.offs = byte_view(arr)
        if lower:
            data = LOWER[data]
        self.data = data
        n = len(data)
        doc = np.zeros(n + 1, bool)
        doc[self.offs] = True
        starts, ends, hashes, a = [], [], [], 0
        while a < n:
            b = _cut(data, a, n, space)
            s, e, h = _scan(data[a:b], doc[a:b], hashed, space)
            starts.append(s + a)
            ends.append(e + a)
            hashes.append(h)
            a = b
        self.starts = np.concatenate(starts) if starts else np.zeros(0, np.int64)
        self.ends = np.concatenate(ends) if ends else np.zeros(0, np.int64)
        self.hashes = np.concatenate(hashes) if hashes and hashed else np.zeros(0, _U)
        self.first = np.searchsorted(self.starts, self.offs)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def docs(self) -> np.ndarray:
        """The text that each word belongs to."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def room(self) -> np.ndarray:
        """Words from each word to the end of its text, itself included."""
        return np.repeat(self.first[1:], self.counts) - np.arange(len(self.starts))

    def text_words(self, i: int) -> list[bytes]:
        raw = self.data[self.offs[i] : self.offs[i + 1]].tobytes()
        return raw.split()


def _cut(data: np.ndarray, a: int, n: int, space: np.ndarray) -> int:
    b = a + SLICE_BYTES
    if b >= n:
        return n
    back = np.flatnonzero(space[data[max(a, b - 4096) : b]])
    if len(back):
        return max(a, b - 4096) + int(back[-1]) + 1
    while b < n:
        ahead = np.flatnonzero(space[data[b : b + SLICE_BYTES]])
        if len(ahead):
            return b + int(ahead[0])
        b += SLICE_BYTES
    return n


def _scan(data: np.ndarray, doc: np.ndarray, hashed: bool, space: np.ndarray):
    word = ~space[data]
    before = np.empty_like(word)
    before[0] = False
    before[1:] = word[:-1]
    start = word & (~before | doc)
    starts = np.flatnonzero(start)
    stop = np.empty_like(word)
    stop[-1] = True
    stop[:-1] = ~word[1:] | doc[1:]
    ends = np.flatnonzero(word & stop) + 1
    return starts, ends, span_hashes(data, starts, ends) if hashed else None


def ngrams(h: np.ndarray, n: int, family: int = 0) -> np.ndarray:
    """Hash of the n words from each word on, by pairs of halves; the last n - 1 entries are zero."""
    out = np.zeros(len(h), _U)
    m = len(h) - n + 1
    if m <= 0:
        return out
    seed, own, width, acc, at = _SEED[family], h, 1, None, 0
    while True:
        if n & width:
            acc = own[:m] if acc is None else join(acc, own[at : at + m], seed)
            at += width
        if 2 * width > n:
            break
        own = join(own[:-width], own[width:], seed)
        width *= 2
    out[:m] = mix(acc + seed)
    return out


def per_text(mask: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Sums of a mask or of small numbers over each text's range."""
    c = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
    return c[offs[1:]] - c[offs[:-1]]


def covered(starts: np.ndarray, length: int, n: int) -> np.ndarray:
    """Which of n positions lie in a window of `length` from one of `starts`."""
    d = np.zeros(n + 1, np.int64)
    np.add.at(d, starts, 1)
    np.add.at(d, np.minimum(starts + length, n), -1)
    return np.cumsum(d[:-1]) > 0


class HashTable:
    """Vectorised open-addressing map from 64-bit keys to their positions; -1 if absent."""

    def __init__(self, keys: np.ndarray, room: int = 0):
        """room: keys to leave place for."""
        bits = max(4, int(np.ceil(np.log2(max(1, 2 * len(keys), 2 * room)))))
        self.mask, self.shift = (1 << bits) - 1, _U(64 - bits)
        self.slots = np.full(1 << bits, -1, np.int32)
        self.keys = np.zeros(0, _U)
        self.extend(np.asarray(keys, _U))

    def extend(self, keys: np.ndarray) -> None:
        """Take `keys`, which begin with the keys held so far and may go on with new ones."""
        old = len(self.keys)
        if 2 * len(keys) > len(self.slots):
            self.__init__(keys, len(keys))
            return
        self.keys = keys
        todo = np.arange(old, len(keys), dtype=np.int32)
        at = (keys[old:] >> self.shift).astype(np.int64)
        while len(todo):
            free = self.slots[at] < 0
            self.slots[at[free]] = todo[free]
            lost = self.slots[at] != todo
            todo, at = todo[lost], (at[lost] + 1) & self.mask

    def find(self, q: np.ndarray) -> np.ndarray:
        out = np.full(len(q), -1, np.int64)
        if not len(self.keys):
            return out
        at = (q >> self.shift).astype(np.int64)
        got = self.slots[at]
        hit = got >= 0
        same = hit & (self.keys[got] == q)
        out[same] = got[same]
        todo = np.flatnonzero(hit & ~same)
        while len(todo):
            at[todo] = (at[todo] + 1) & self.mask
            got = self.slots[at[todo]]
            hit = got >= 0
            same = hit & (self.keys[got] == q[todo])
            out[todo[same]] = got[same]
            todo = todo[hit & ~same]
        return out
