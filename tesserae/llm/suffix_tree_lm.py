"""Language-model scoring with a probabilistic suffix tree over words.

The tree's states are contexts of up to DEPTH words.  A context is a candidate
if it occurs MIN_CONTEXT times in training; it is retained if its next-word
distribution diverges from that of its longest retained suffix: count * KL must
exceed a description-length penalty of half the log count for each stored next
word.  A next word is stored if the pair occurs MIN_PAIR times.  With C the count
of context s, C' its stored part and suf(s) its longest retained suffix,

    P(x|s) = c(s,x) / (C + MU) + (C - C' + MU) / (C + MU) * P(x|suf(s)),

down to the root, the add-one unigram; every state is a proper distribution.
A token is scored in the longest retained suffix of what precedes it.

Logarithms make that a sum: of the root's part, log10(c(x) + 1); of one number for
each retained context before the token, log10 of its factor of P(x|suf(s)); and of
one number for each stored pair.  So the model is a table of numbers by key
(*facts*), spread over the cluster by the key's hash, and a text's score is the sum
of what its keys have.  What is counted and stored grows with the corpus.

Words and runs of words are counted in packed shuffles of (hash, count), merged
within each task first, so a frequent key costs one entry per task.  A run is
counted only if its context is a candidate and the run without its first word
occurs MIN_PAIR times, without which it cannot either.  Facts of keys with a share HOT of all
tokens are broadcast, at most 1 / HOT of each kind, so that no key that is asked by
shuffle is a hot one.  Bitmaps of at most 2**MAX_BITS bits say which keys can have a
fact; a wrong yes costs a question and changes nothing.  Words and runs are told
apart by 64-bit hashes.

Disk is bounded by the largest step: texts are scored in up to PASSES passes, each by the whole
tree, so the questions of one are gone before the next one's, and files of a step's exchanges
and tables that nothing reads any more are removed at once.

Nulls and odd cases: a null or empty text is the end token alone; a null id
counts as training; repeated rows count and are scored each; without training
texts every token has probability one.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as K
from .common import BLOB_SCHEMA, blob_batch, bound_batches, bucket_of, buckets, by_kind, deal, forget, joined, regroup, repeatable, row_keys, written

DEPTH = 2
MIN_CONTEXT, MIN_PAIR = 16, 3
MU = 16.0
HOT = 2.0**-20
MAX_BITS, PIECE_BITS = 28, 19
FOLDS, FOLD = 7, 2
END = np.uint64(K.splitmix(0xE0D))
_U = np.uint64
_CONTEXT, _PAIR, _COUNT = (_U(K.splitmix(i)) for i in (0xC0, 0xA1, 0xC7))
_FLUSH = 1 << 22
PASSES = 2
_ZSTD, _SHORT = pa.Codec("zstd", 1), 64
_ROW = np.dtype([("row", "<u8"), ("id", "<i8"), ("has_id", "u1"), ("held", "u1"), ("n", "<i8"), ("known", "<i8"), ("base", "<f8"), ("more", "<f8")])
_NONE = np.zeros(0, _U)


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == FOLD, F.lit(False))


def token_stream(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first): the lower-cased words of each text followed by END; first has each text's range."""
    w = K.Words(arr, lower=True)
    n = len(arr)
    first = w.first + np.arange(n + 1)
    out = np.full(len(w.hashes) + n, END, _U)
    out[np.arange(len(w.hashes)) + w.docs()] = w.hashes
    return out, first


class _Tally:
    """Counts of 64-bit keys, merged when many are held."""

    def __init__(self):
        self.held, self.size = [], 0

    def add(self, keys: np.ndarray) -> None:
        u, c = np.unique(keys, return_counts=True)
        self.held.append((u, c.astype(np.uint32)))
        self.size += len(u)

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        out = merge_counts(self.held)
        self.held, self.size = [], 0
        return out


def merge_counts(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    if not parts:
        return np.zeros(0, _U), np.zeros(0, np.int64)
    k, c = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]).astype(np.int64)
    order = np.argsort(k, kind="stable")
    k, c = k[order], c[order]
    lead = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
    return k[lead], np.add.reduceat(c, lead) if len(lead) else c


def planes(x: np.ndarray) -> bytes:
    """Numbers as their lowest bytes, then their next ones, and so on; those that are as good as random as they are, the higher ones compressed."""
    if not len(x):
        return b""
    raw = np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T)
    if len(x) < _SHORT:
        return b"\0" + raw.tobytes()
    low = 6 if x.dtype.kind == "f" else min(x.itemsize - 1, int(np.log2(float(x.mean()) + 1)) // 8)
    return bytes([1 + low]) + len(x).to_bytes(4, "little") + raw[:low].tobytes() + _ZSTD.compress(raw[low:], asbytes=True)


def from_planes(raw: bytes, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    if raw and raw[0]:
        low, n = raw[0] - 1, int.from_bytes(raw[1:5], "little")
        raw = raw[: 5 + low * n] + _ZSTD.decompress(raw[5 + low * n :], (size - low) * n, asbytes=True)
        own = np.frombuffer(raw, np.uint8, offset=5)
    else:
        own = np.frombuffer(raw[1:], np.uint8)
    return np.ascontiguousarray(own.reshape(size, -1).T).view(dtype).ravel()


def ascending(k: np.ndarray) -> bytes:
    """Ascending keys by their differences."""
    return planes(np.diff(k, prepend=_U(0)))


def from_ascending(raw: bytes) -> np.ndarray:
    return np.cumsum(from_planes(raw, _U), dtype=_U)


def narrowed(keys: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order by bucket, the buckets, and of each mixed key what its bucket does not say, ascending in each."""
    m = K.mix(keys)
    bucket, rest = bucket_of(m, n), ((m >> _U(32)) // _U(n) << _U(32)) | (m & _U(0xFFFFFFFF))
    order = np.argsort(rest)
    order = order[np.argsort(bucket[order].astype(np.uint16) if n <= 1 << 16 else bucket[order], kind="stable")]
    return order, bucket[order], rest[order]


def widened(rest: np.ndarray, bucket: int, n: int) -> np.ndarray:
    """The mixed keys of a bucket again."""
    return ((rest >> _U(32)) * _U(n) + _U(bucket) << _U(32)) | (rest & _U(0xFFFFFFFF))


def cuts(ascending: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of equal numbers."""
    at = [0, *(np.flatnonzero(np.diff(ascending)) + 1).tolist(), len(ascending)]
    return list(zip(at[:-1], at[1:])) if len(ascending) else []


def deal_counts(k: np.ndarray, c: np.ndarray, n: int) -> list[tuple]:
    """Blobs of kind 0 of distinct keys, with counts or, if they all count once, without."""
    out = []
    for own, counted in ((c > 1, True), (c == 1, False)):
        order, bucket, rest = narrowed(k[own], n)
        count = c[own][order].astype(np.uint32)
        out += [(int(bucket[a]), 0, ascending(rest[a:b]), *([planes(count[a:b])] if counted else [])) for a, b in cuts(bucket)]
    return out


def counts_of(x: tuple, bucket: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    k, c = K.unmix(widened(from_ascending(x[0]), bucket, n)), from_planes(x[1], np.uint32)
    return k, c if len(c) else np.ones(len(k), np.uint32)


def deal_questions(kind: int, keys: np.ndarray, rows: np.ndarray, base: int, n: int) -> list[tuple]:
    """Questions (key, row): distinct keys, rows of each, then the rows less `base`, which are below 2**32."""
    if not len(keys):
        return []
    order, bucket, keys = narrowed(keys, n)
    rows = rows[order].astype(np.uint32)
    new = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]) | (bucket[1:] != bucket[:-1])]))
    ends = np.concatenate([new, [len(keys)]])
    size = np.diff(ends).astype(np.uint32)
    return [(int(bucket[new[a]]), kind, ascending(keys[new[a:b]]), planes(size[a:b]), planes(rows[ends[a] : ends[b]]), base.to_bytes(8, "little")) for a, b in cuts(bucket[new])]


def deal_words(key: np.ndarray, words: np.ndarray, n: int) -> list[tuple]:
    """Blobs of kind 1 of runs, a row of words each: the words of a blob once, places among them of the first words by differences, and of the others."""
    out = []
    for b, _, raw in deal(K.mix(key), n, 1, words):
        own = np.frombuffer(raw, _U).reshape(-1, words.shape[1])
        u, at = np.unique(own, return_inverse=True)
        at = at.reshape(own.shape).astype(np.uint32)
        at = at[np.argsort(at[:, 0], kind="stable")]
        out.append((b, 1, ascending(u), planes(np.diff(at[:, 0], prepend=np.uint32(0))), planes(at[:, 1:].T.ravel())))
    return out


def words_of(x: tuple, d: int) -> np.ndarray:
    first = np.cumsum(from_planes(x[1], np.uint32), dtype=np.int64)
    return from_ascending(x[0])[np.column_stack([first, from_planes(x[2], np.uint32).reshape(d - 1, -1).T])]


def run_hashes(words: np.ndarray) -> np.ndarray:
    """Hashes of runs, a row of words each."""
    d = words.shape[1]
    return K.ngrams(words.ravel(), d)[::d]


def run_parts(words: np.ndarray) -> np.ndarray:
    """The parts of runs, a row of words each: the runs that end before the last word, of 1, 2, ... words, then those that end with it; the first of these is the word."""
    d = words.shape[1]
    before = [run_hashes(words[:, d - 1 - j : d - 1]) for j in range(1, d)]
    return np.stack(before + [words[:, d - 1]] + [run_hashes(words[:, d - j :]) for j in range(2, d)], 1)


class Stream:
    """Tokens of a run of texts with the hashes of the runs of words that end at each."""

    def __init__(self, arr: pa.Array):
        self.h, self.first = token_stream(arr)
        self.doc = np.repeat(np.arange(len(arr)), np.diff(self.first))
        self.at = np.arange(len(self.h)) - self.first[self.doc]  # place in the text

    def grams(self, d: int) -> np.ndarray:
        """Hash of the d tokens up to each one; only where `at` is d - 1 or more."""
        out = np.zeros(len(self.h), _U)
        if len(out) >= d:
            out[d - 1 :] = K.ngrams(self.h, d)[: len(out) - d + 1]
        return out

    def contexts(self, grams: np.ndarray) -> np.ndarray:
        """The runs that end just before each token."""
        return np.concatenate([np.zeros(1, _U), grams[:-1]])


class Bitmap:
    """Which hashes may belong to a set."""

    def __init__(self, bits: int, packed: np.ndarray):
        self.bits, self.packed = bits, packed

    def __contains__(self, h):
        raise TypeError("use has()")

    def has(self, h: np.ndarray) -> np.ndarray:
        c = _cell(h, self.bits)
        return (self.packed[c >> 3] >> (7 - (c & 7)).astype(np.uint8) & 1).astype(bool)


def _cell(h: np.ndarray, bits: int) -> np.ndarray:
    return (K.mix(h) >> _U(64 - bits)).astype(np.int64)


def bitmap(blobs: DataFrame, keys_of, n: int) -> Bitmap:
    """The bitmap of the keys that keys_of gives for each blob; its size follows their number, up to 2**MAX_BITS bits."""
    spark = blobs.sparkSession

    def size(batches):
        yield pa.RecordBatch.from_arrays([pa.array([sum(len(keys_of(x)) for _, _, x in by_kind(batches))], pa.int64())], names=["n"])

    total = blobs.mapInArrow(size, "n long").agg(F.sum("n").alias("n")).first()["n"] or 0
    bits = int(np.clip(np.ceil(np.log2(16 * max(1, total))), 16, MAX_BITS))
    piece = min(bits, PIECE_BITS)

    def cells(batches):
        """A task merges its cells first: a row for each piece, not for each piece of each blob."""
        held, size = [], 0

        def flush():
            c = np.unique(np.concatenate(held)) if held else np.zeros(0, np.int64)
            held.clear()
            cut = np.concatenate([[0], np.flatnonzero(np.diff(c >> piece)) + 1, [len(c)]]) if len(c) else [0]
            return blob_batch([(int(c[a] >> piece) % n, 0, int(c[a] >> piece).to_bytes(4, "little"), zlib.compress((c[a:b] & ((1 << piece) - 1)).astype(np.uint32).tobytes(), 1)) for a, b in zip(cut[:-1], cut[1:])])

        for _, _, x in by_kind(batches):
            held.append(_cell(keys_of(x), bits))
            size += len(held[-1])
            if size > 2 * _FLUSH:
                size = 0
                yield flush()
        yield flush()

    def merge(batches):
        planes: dict[int, np.ndarray] = {}
        for _, _, x in by_kind(batches):
            planes.setdefault(int.from_bytes(x[0], "little"), np.zeros(1 << piece, bool))[np.frombuffer(zlib.decompress(x[1]), np.uint32)] = True
        yield blob_batch([(k, 0, np.packbits(v).tobytes()) for k, v in planes.items()])

    packed = np.zeros(1 << (bits - 3), np.uint8)
    # one job for all pieces, which are 2**MAX_BITS bits at most: toLocalIterator would run one after the other for each partition
    for r in regroup(blobs.mapInArrow(cells, BLOB_SCHEMA), n).mapInArrow(merge, BLOB_SCHEMA).select("bucket", "a").collect():
        packed[r["bucket"] << (piece - 3) : (r["bucket"] + 1) << (piece - 3)] = np.frombuffer(r["a"], np.uint8)
    return spark.sparkContext.broadcast(Bitmap(bits, packed))


def count_words(train: DataFrame, n: int) -> DataFrame:
    """Blobs (words, counts) of the training texts, each word in one."""

    def count(batches):
        tally = _Tally()
        for batch in batches:
            for _, arr in K.slices(batch):
                tally.add(token_stream(arr)[0])
            if tally.size > _FLUSH:
                yield blob_batch(deal_counts(*tally.take(), n))
        yield blob_batch(deal_counts(*tally.take(), n))

    def merge(batches):
        now, parts = None, []
        for now, _, x in by_kind(batches):
            parts.append(counts_of(x, now, n))
        k, c = merge_counts(parts)
        if len(k):
            yield blob_batch([(now, 0, k.tobytes(), c.tobytes())])

    return regroup(train.select("text").mapInArrow(count, BLOB_SCHEMA), n).mapInArrow(merge, BLOB_SCHEMA)


def count_runs(train: DataFrame, d: int, contexts, suffixes, found, counts: DataFrame | None, n: int) -> DataFrame:
    """One scan that counts the runs of d + 1 words whose first d words the bitmap `contexts` has and the last d `suffixes` (kind 0: runs, counts of MIN_PAIR or more),
    and joins to the runs of d words, counted before (`counts`, bitmap `found`), what they are made of (kind 1: runs, counts, run_parts).
    A task sends the words of such a run, of which the run and its parts are made again.
    """

    def scan(batches):
        tally, parts, held = _Tally(), [], 0

        def flush():
            rows = deal_counts(*tally.take(), n)
            if parts:
                key, words = (np.concatenate(x) for x in zip(*parts))
                parts.clear()
                key, i = np.unique(key, return_index=True)
                rows += deal_words(key, words[i], n)
            return rows

        for batch in batches:
            for _, arr in K.slices(batch):
                s = Stream(arr)
                if contexts is not None:
                    own = s.grams(d)
                    ok = np.flatnonzero(s.at >= d)
                    ok = ok[contexts.value.has(s.contexts(own)[ok])]
                    ok = ok[suffixes.value.has(own[ok])]
                    tally.add(s.grams(d + 1)[ok])
                if found is not None:
                    run = s.grams(d)
                    ok = np.flatnonzero((s.at >= d - 1) & found.value.has(run))
                    run, i = np.unique(run[ok], return_index=True)
                    parts.append((run, s.h[ok[i][:, None] + np.arange(1 - d, 1)]))
                    held += parts[-1][1].nbytes
            if tally.size > _FLUSH or held > 8 * _FLUSH:
                held = 0
                yield blob_batch(flush())
        yield blob_batch(flush())

    def merge(batches):
        now, tally, parts, known = None, [], [], (_NONE, np.zeros(0, np.int64))
        for now, kind, x in by_kind(batches):
            if kind == 0:
                tally.append(counts_of(x, now, n))
            elif kind == 1:
                parts.append(words_of(x, d))
            else:
                known = np.frombuffer(x[0], _U), np.frombuffer(x[1], np.int64)
        rows = []
        k, c = merge_counts(tally)
        ok = c >= MIN_PAIR
        if ok.any():
            rows.append((now, 0, k[ok].tobytes(), c[ok].tobytes()))
        if parts and len(known[0]):
            words = np.concatenate(parts)
            key, i = np.unique(run_hashes(words), return_index=True)
            at = np.minimum(np.searchsorted(known[0], key), len(known[0]) - 1)
            ok = known[0][at] == key
            rows.append((now, 1, key[ok].tobytes(), known[1][at[ok]].tobytes(), run_parts(words[i[ok]]).tobytes()))
        yield blob_batch(rows)

    blobs = train.select("text").mapInArrow(scan, BLOB_SCHEMA)
    if counts is not None:
        blobs = blobs.unionAll(counts.withColumn("kind", F.lit(2).cast("tinyint")))
    return written(regroup(blobs, n).mapInArrow(merge, BLOB_SCHEMA), "lm-runs")


def answers(asked: DataFrame, home, n: int) -> DataFrame:
    """Sums of facts: kind 0 blobs are facts (keys, values), kind -1 those of packed_facts, kinds 1 and 2 questions (deal_questions); others pass.

    Answers are blobs of kind 1, dealt by `home` of the row: (rows, sums, numbers of keys that have a fact) of the
    questions of kind 1, and (rows, sums) of those of kind 2.  A row of the exchange holds both, so there are at most
    n for each of the n tasks and some questions.
    """

    def run(batches):
        facts, asks, through = [(_NONE, np.zeros(0))], {1: [], 2: []}, []
        for bucket, kind, x in by_kind(batches):
            if kind < 0:
                facts.append((widened(from_ascending(x[0]), bucket, n), from_planes(x[1], np.float64)))
            elif kind == 0:
                facts.append((K.mix(np.frombuffer(x[0], _U)), np.frombuffer(x[1], np.float64)))
            elif kind < 3:
                asks[kind].append((bucket, *x))
            else:
                through.append((bucket, kind, *x))
                if len(through) >= 500:
                    yield blob_batch(through)
                    through = []
        yield blob_batch(through)
        keys, values = (np.concatenate(x) for x in zip(*facts))
        order = np.argsort(keys)
        keys, values = keys[order], values[order]

        def some(own):
            """Rows, sums and numbers of some questions."""
            total, at, size = [np.zeros(0)], [_NONE], 0
            while own and size < 4 * _FLUSH:
                bucket, h, count, rows, base = own.pop()
                h, rows = widened(from_ascending(h), bucket, n), from_planes(rows, np.uint32)
                value, ok = np.zeros(len(h)), np.zeros(len(h), bool)
                if len(keys):
                    i = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                    ok = keys[i] == h
                    value = np.where(ok, values[i], 0.0)
                count = from_planes(count, np.uint32)
                hit = np.repeat(ok, count)  # a key without a fact adds nothing
                at.append(rows[hit] + _U(int.from_bytes(base, "little")))
                total.append(np.repeat(value, count)[hit])
                size += len(rows)
            row, inv, many = np.unique(np.concatenate(at), return_inverse=True, return_counts=True)
            return row, np.bincount(inv, np.concatenate(total), len(row)), many.astype(np.uint32)

        while asks[1] or asks[2]:
            out = {}
            for kind in asks:
                for bucket, rows, sums, many in deal_replies(*some(asks[kind]), home, n):
                    out.setdefault(bucket, {})[kind] = rows, sums, many
            none = (b"", b"", b"")
            yield blob_batch([(b, 1, *x.get(1, none), len(x.get(2, none)[0]).to_bytes(4, "little") + b"".join(x.get(2, none)[:2])) for b, x in out.items()])

    return regroup(asked, n).mapInArrow(run, BLOB_SCHEMA)


def by_row(row: np.ndarray, n: int) -> np.ndarray:
    return bucket_of(K.mix(row), n)


def by_asker(row: np.ndarray, n: int) -> np.ndarray:
    """The bucket whose rows begin at (bucket + 1) * 2**40."""
    return (row >> _U(40)).astype(np.int32) - 1


def deal_replies(row: np.ndarray, sums: np.ndarray, many: np.ndarray, home, n: int) -> list[tuple]:
    """(bucket, rows by their differences, sums, numbers) of ascending rows."""
    if not len(row):
        return []
    bucket = home(row, n)
    order = np.argsort(bucket, kind="stable")
    bucket, row, sums, many = bucket[order], row[order], sums[order], many[order]
    cut = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(row)]])
    return [(int(bucket[a]), ascending(row[a:b]), planes(sums[a:b]), planes(many[a:b])) for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())]


def _sums(replies: list, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of ascending rows the sums and numbers of the replies of kind 1 and the sums of kind 2."""
    first, many, second = np.zeros(len(row)), np.zeros(len(row), np.int64), np.zeros(len(row))
    for rows, sums, count, more in replies:
        at = np.searchsorted(row, from_ascending(rows))  # distinct within a reply
        first[at] += from_planes(sums, np.float64)
        many[at] += from_planes(count, np.uint32)
        end = 4 + int.from_bytes(more[:4], "little")
        second[np.searchsorted(row, from_ascending(more[4:end]))] += from_planes(more[end:], np.float64)
    return first, many, second


def word_facts(words: DataFrame, n: int) -> DataFrame:
    """Facts of words, log10(count + 1), and their counts as facts of runs of one word."""

    def run(batches):
        for _, _, x in by_kind(batches):
            k, c = np.frombuffer(x[0], _U), np.frombuffer(x[1], np.int64)
            yield blob_batch(deal(K.mix(k), n, 0, k, np.log10(c + 1.0), c) + _count_facts(K.ngrams(k, 1), c, n))

    return words.mapInArrow(run, BLOB_SCHEMA)


def _count_facts(runs: np.ndarray, c: np.ndarray, n: int) -> list[tuple]:
    ok = c >= MIN_CONTEXT
    k = K.join(runs[ok], _COUNT)
    return deal(K.mix(k), n, 0, k, c[ok].astype(np.float64), np.zeros(int(ok.sum()), np.int64))


def level_facts(runs: DataFrame, d: int, facts: DataFrame, log_total: float, n: int) -> DataFrame:
    """Facts of the retained contexts of d words and of their stored pairs, with counts; runs are kind 1 blobs of d + 1 words."""

    def asking(batches):
        for bucket, _, x in by_kind(batches):
            run = np.frombuffer(x[0], _U)
            yield bucket, run, np.frombuffer(x[1], np.int64), np.frombuffer(x[2], _U).reshape(len(run), -1)

    def ask(batches):
        for bucket, run, _, m in asking(batches):
            base, at = (bucket + 1) << 40, np.arange(len(run))
            keys = [m[:, d]]  # the word
            for j in range(1, d):
                keys += [K.join(m[:, j - 1], _CONTEXT), K.join(m[:, d + j], _PAIR)]
            rows = deal_questions(1, np.concatenate(keys), np.tile(at, len(keys)), base, n)
            yield blob_batch(rows + deal_questions(2, K.join(m[:, d - 1], _COUNT), at, base, n))

    def stay(batches):
        """The runs of a bucket, which the answers come back to."""
        for bucket, run, c, m in asking(batches):
            yield blob_batch([(bucket, 3, run.tobytes(), planes(c), m[:, d - 1].tobytes())])

    def meet(batches):
        replies, own = [], []
        for now, kind, x in by_kind(batches):
            (own if kind == 3 else replies).append(x)
        if own:  # one of each bucket
            run, c, ctx = np.frombuffer(own[0][0], _U), from_planes(own[0][1], np.int64), np.frombuffer(own[0][2], _U)
            q, _, total = _sums(replies, np.arange(len(run)).astype(_U) + _U((now + 1) << 40))
            q = q - log_total
            ok = total >= MIN_CONTEXT
            yield blob_batch(deal(K.mix(ctx[ok]), n, 0, ctx[ok], run[ok], np.stack([c[ok].astype(float), q[ok], total[ok]], 1)))

    def learn(batches):
        got = [x for _, _, x in by_kind(batches)]
        ctx, run = joined([x[0] for x in got], _U), joined([x[1] for x in got], _U)
        num = joined([x[2] for x in got], np.float64).reshape(-1, 3)
        order = np.lexsort((run, ctx))
        ctx, run, (c, log_q, C) = ctx[order], run[order], num[order].T
        if not len(ctx):
            return
        lead = np.flatnonzero(np.concatenate([[True], ctx[1:] != ctx[:-1]]))
        size, total = np.diff(np.concatenate([lead, [len(ctx)]])), C[lead]
        q, rest = 10**log_q, total - np.add.reduceat(c, lead)
        rest_q = np.maximum(1 - np.add.reduceat(q, lead), 1e-12)
        gain = np.add.reduceat(c * np.log(c / C / q), lead) + np.where(rest > 0, rest * np.log(np.maximum(rest, 1) / total / rest_q), 0)
        keep = gain > 0.5 * size * np.log(total) + 3
        log_rest = np.log10((rest + MU) / (total + MU))
        key = K.join(ctx[lead][keep], _CONTEXT)
        rows = deal(K.mix(key), n, 0, key, log_rest[keep], total[keep].astype(np.int64))
        mine, back = np.repeat(keep, size), np.repeat(log_rest, size)
        more = np.log10(c / (C + MU) + 10**back * q) - log_q - back
        key = K.join(run[mine], _PAIR)
        yield blob_batch(rows + deal(K.mix(key), n, 0, key, more[mine], c[mine].astype(np.int64)))

    runs = runs.where("kind = 1")
    replied = answers(runs.mapInArrow(ask, BLOB_SCHEMA).unionAll(bare(facts)), by_asker, n)
    met = regroup(replied.unionAll(runs.mapInArrow(stay, BLOB_SCHEMA)), n).mapInArrow(meet, BLOB_SCHEMA)
    return written(regroup(met, n).mapInArrow(learn, BLOB_SCHEMA), "lm-level")


def bare(facts: DataFrame) -> DataFrame:
    """Facts without their counts, which only Model.hot reads."""
    return facts.withColumn("c", F.lit(b""))


def packed_facts(facts: DataFrame, hot, n: int) -> DataFrame:
    """What a text's tokens can ask for by shuffle, a blob of kind -1 for each bucket: no hot facts, and no totals (count 0), which only training asks for."""

    def pack(batches):
        now, got = None, [(_NONE, np.zeros(0))]
        table = K.HashTable(K.mix(hot.value[0]))
        for now, _, x in by_kind(batches):
            k = np.frombuffer(x[0], _U)
            ok = (np.frombuffer(x[2], np.int64) > 0) & (table.find(K.mix(k)) < 0)
            got.append((k[ok], np.frombuffer(x[1], np.float64)[ok]))
        k, value = (np.concatenate(x) for x in zip(*got))
        order, _, rest = narrowed(k, n)
        if len(k):
            yield blob_batch([(now, -1, ascending(rest), planes(value[order]))])

    return written(regroup(facts, n).mapInArrow(pack, BLOB_SCHEMA), "lm-facts")


class Model:
    """Tables of a trained tree: facts of words and of the tree, the training tokens and types."""

    def __init__(self, words: DataFrame, tree: list[DataFrame], tokens: int, types: int, n: int):
        self.words, self.tree, self.tokens, self.types, self.n = words, tree, tokens, types, n
        self.log_total = float(np.log10(max(1, tokens + types + 1)))

    def facts(self) -> DataFrame:
        out = self.words
        for t in self.tree:
            out = out.unionAll(t)
        return out

    def hot(self) -> tuple[np.ndarray, np.ndarray]:
        """Keys and values of the facts of what has a share HOT of the tokens: at most 1 / HOT for the words, and twice that for each level."""
        least = max(1, int(np.ceil(self.tokens * HOT)))

        def pick(batches):
            for _, _, x in by_kind(batches):
                ok = np.frombuffer(x[2], np.int64) >= least
                if ok.any():
                    yield blob_batch([(0, 0, np.frombuffer(x[0], _U)[ok].tobytes(), np.frombuffer(x[1], np.float64)[ok].tobytes())])

        got = [(r["a"], r["b"]) for r in self.facts().mapInArrow(pick, BLOB_SCHEMA).select("a", "b").collect()]
        return joined([bytes(a) for a, _ in got], _U), joined([bytes(b) for _, b in got], np.float64)


def _table_size(words: DataFrame) -> tuple[int, int]:
    def size(batches):
        c = [np.frombuffer(x[1], np.int64) for _, _, x in by_kind(batches)]
        yield pa.RecordBatch.from_arrays([pa.array([sum(map(len, c))], pa.int64()), pa.array([int(sum(x.sum() for x in c))], pa.int64())], names=["v", "n"])

    got = words.mapInArrow(size, "v long, n long").agg(F.sum("v").alias("v"), F.sum("n").alias("n")).first()
    return got["v"] or 0, got["n"] or 0


def train(docs: DataFrame, depth: int = DEPTH) -> Model:
    """The model of the training documents."""
    own = bound_batches(docs).where(~held_out(F.col("doc_id")))
    n = buckets(docs)
    words = written(count_words(own, n), "lm-words")
    types, tokens = _table_size(words)
    model = Model(written(word_facts(words, n), "lm-word-facts"), [], tokens, types, n)

    def often(x):
        k, c = np.frombuffer(x[0], _U), np.frombuffer(x[1], np.int64)
        return K.ngrams(k[(c >= MIN_CONTEXT) & (k != END)], 1)

    def some(x):
        k, c = np.frombuffer(x[0], _U), np.frombuffer(x[1], np.int64)
        return K.ngrams(k[c >= MIN_PAIR], 1)

    def as_facts(batches):
        for _, _, x in by_kind(batches):
            yield blob_batch(_count_facts(np.frombuffer(x[0], _U), np.frombuffer(x[1], np.int64), n))

    candidates, suffixes = bitmap(words, often, n), bitmap(words, some, n)
    forget(words)
    found, before, totals = None, None, {}
    for d in range(1, depth + 2):  # runs of d + 1 words are counted while the parts of those of d words are gathered
        runs = count_runs(own, d, candidates, suffixes, found, before and before.where("kind = 0"), n)
        if before is not None:
            forget(before)
        for x in (candidates, suffixes):
            if x is not None:
                x.destroy()
        candidates = None
        if d > 1:
            facts = model.facts().unionAll(totals[d - 1]) if d > 2 else model.facts()  # those of single words are with the words
            model.tree.append(level_facts(runs, d - 1, facts, model.log_total, n))
        if d > depth:
            forget(runs, *totals.values())
            break
        counts, before = runs.where("kind = 0"), runs
        found = suffixes = bitmap(counts, lambda x: np.frombuffer(x[0], _U), n)
        if d < depth:  # no longer runs are counted after that
            candidates = bitmap(counts, lambda x: np.frombuffer(x[0], _U)[np.frombuffer(x[1], np.int64) >= MIN_CONTEXT], n)
            totals[d + 1] = written(counts.mapInArrow(as_facts, BLOB_SCHEMA), "lm-totals")
    return model


def score(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every text."""
    docs = repeatable(docs.select("doc_id", "text"))
    spark, model = docs.sparkSession, train(docs, depth)
    n, log_total, train_tokens = model.n, model.log_total, model.tokens
    hot = spark.sparkContext.broadcast(model.hot())
    may = None
    if model.tree:
        tree = model.tree[0]
        for t in model.tree[1:]:
            tree = tree.unionAll(t)
        may = bitmap(tree, lambda x: np.frombuffer(x[0], _U), n)
    facts = packed_facts(model.facts(), hot, n)
    forget(model.words, *model.tree)

    def scan(batches):
        """Kinds: 1 words and 2 contexts and pairs with the row that asks; 3 rows with what is known of them."""
        table, values = K.HashTable(K.mix(hot.value[0])), hot.value[1]
        task, at = TaskContext.get().partitionId(), 0
        base = int(row_keys(task, 0, 1)[0])
        asks, own_rows, size = {1: [], 2: []}, [], 0

        def flush():
            held = np.concatenate([np.zeros(0, _ROW), *own_rows])
            own_rows.clear()
            rows = deal(K.mix(held["row"]), n, 3, held)
            for kind, own in asks.items():
                if own:
                    h, r = (np.concatenate(x) for x in zip(*own))
                    own.clear()
                    rows += deal_questions(kind, h, r, base, n)
            return rows

        for batch in batches:
            for part, arr in K.slices(batch):
                s = Stream(arr)
                out = np.zeros(len(arr), _ROW)
                out["row"] = row_keys(task, at, len(arr))
                at += len(arr)
                out["id"] = part.column(0).fill_null(0).to_numpy(zero_copy_only=False)
                out["has_id"] = part.column(0).is_valid().to_numpy(zero_copy_only=False)
                out["held"] = part.column(1).to_numpy(zero_copy_only=False)
                out["n"] = np.diff(s.first)

                def add(key, where, kind, field, out=out, s=s):
                    got = table.find(K.mix(key))
                    ok = got >= 0
                    out[field] += np.bincount(s.doc[where[ok]], values[got[ok]], len(out))
                    if kind == 1:
                        out["known"] += np.bincount(s.doc[where[ok]], minlength=len(out))
                    asks[kind].append((key[~ok], out["row"][s.doc[where[~ok]]] - _U(base)))
                    return int((~ok).sum())

                size += add(s.h, np.arange(len(s.h)), 1, "base")
                for d in range(1, len(model_levels) + 1):
                    ctx = K.join(s.contexts(s.grams(d)), _CONTEXT)
                    where = np.flatnonzero((s.at >= d) & may.value.has(ctx))
                    size += add(ctx[where], where, 2, "more")
                    pair = K.join(s.grams(d + 1)[where], _PAIR)
                    ok = may.value.has(pair)
                    size += add(pair[ok], where[ok], 2, "more")
                own_rows.append(out)
                size += len(out)
                if size > _FLUSH:
                    size = 0
                    yield blob_batch(flush())
        yield blob_batch(flush())

    def finish(batches):
        replies, own = [], []
        for _, kind, x in by_kind(batches):
            (own if kind == 3 else replies).append(x)
        out = joined([x[0] for x in own], _ROW).copy()
        out = out[np.argsort(out["row"], kind="stable")]
        base, known, more = _sums(replies, out["row"])
        base = out["base"] + base - out["n"] * log_total
        yield pa.RecordBatch.from_arrays([
            pa.array(out["id"], mask=out["has_id"] == 0), pa.array(out["held"].astype(bool)), pa.array(out["n"]), pa.array(out["known"] + known.astype(np.int64)),
            pa.array(np.full(len(out), train_tokens, np.int64)), pa.array(base), pa.array(base + out["more"] + more),
        ], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    model_levels = list(range(len(model.tree)))
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held"), "text")
    parts, passes = [], max(1, min(PASSES, -(-train_tokens // _FLUSH)))
    for i in range(passes):
        own = src.where(F.pmod(F.xxhash64("doc_id"), F.lit(passes)) == i)
        replied = answers(own.mapInArrow(scan, BLOB_SCHEMA).unionAll(facts), by_row, n)
        parts.append(written(regroup(replied, n).mapInArrow(finish, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"), "lm-scores"))
    forget(facts)
    for x in (hot, may):
        if x is not None:
            x.destroy()
    out = parts[0]
    for x in parts[1:]:
        out = out.unionAll(x)
    return out
