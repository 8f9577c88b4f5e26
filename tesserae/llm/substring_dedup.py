"""Removal of repeated passages: a count-min prefilter, then exact grouping.

A window is `WINDOW` consecutive words of one text; a word goes if a window over
it has the word sequence of a window that starts anywhere else.  Windows are
judged on the input.

Pass 1 counts *anchors*, not windows: the anchor of a window is the leftmost of
its `GRAM`-word shingles with the least hash, so equal windows have equal
anchors at equal offsets, and two occurrences of a window are two occurrences
of its anchor.  Each partition adds its anchors to a count-min sketch whose
cells saturate at two; the sketches are merged chunk by chunk.  A cell can only
overestimate, so a window whose anchor is estimated below two is unique.
Pass 2 sends only the other windows, as 96-bit hashes of 64-bit word hashes, to
be grouped exactly; a window that recurs within a task is settled there and sent
once for it, so a hot passage costs one entry per task.

The merged sketch has `DEPTH` rows of 2**bits bits, sized from the text and
bounded by MAX_BITS, which bounds the broadcast at DEPTH * 2**MAX_BITS / 8
bytes; above that more windows pass to the exact step, and none is lost.

Nulls and odd cases: a null or empty text has no words and keeps the hash of the
empty string; a text shorter than a window keeps all its words; overlapping
windows of a periodic text count as different starts; repeated rows lose
everything that a window covers; very long texts are scanned in one task; input
that is no plain scan is written first, as rows are numbered by task and place.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as K
from .common import BLOB_SCHEMA, blob_batch, bound_batches, bucket_of, buckets, by_kind, deal, id_bytes, id_value, joined, regroup, repeatable, row_keys

WINDOW, GRAM = 35, 8
DEPTH, MIN_BITS, MAX_BITS = 2, 20, 28
PIECE_BITS = 19  # cells of a piece that is merged at once
FLUSH = 1 << 21  # anchors that a task holds before it sends their cells
FLUSH_BYTES = 48 << 20  # windows and texts that a task holds before it settles them
_U = np.uint64
_ROW = (_U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F))


def window_anchors(w: K.Words, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts of windows, position of each one's anchor, shingle hashes)."""
    room = w.room()
    starts = np.flatnonzero(room >= window)
    g = K.ngrams(w.hashes, gram)
    if not len(starts):
        return starts, starts, g
    # sliding minimum of span shingles by doubling; ties go to the left
    span = window - gram + 1
    pos = np.arange(len(g))
    best, at, width = g.copy(), pos.copy(), 1
    while width < span:
        step = min(width, span - width)
        n = len(best) - step
        other = best[step:]
        take = other < best[:n]
        best = np.where(take, other, best[:n])
        at = np.where(take, at[step:], at[:n])
        width += step
    return starts, at[starts], g


def _cells(h: np.ndarray, row: int, bits: int) -> np.ndarray:
    return (K.mix(h * _ROW[row]) >> _U(64 - bits)).astype(np.int64)


def sketch(docs: DataFrame, bits: int, window: int, gram: int, n: int) -> DataFrame:
    """(bucket, a): for each piece of each row the bits of the cells that reached two, merged over all partitions."""
    piece = min(bits, PIECE_BITS)
    low = np.int64((1 << piece) - 1)

    def count(batches):
        cells, held = [[] for _ in range(DEPTH)], 0

        def flush():
            rows = []
            for row in range(DEPTH):
                if not cells[row]:
                    continue
                u, c = np.unique(np.concatenate(cells[row]), return_counts=True)
                cells[row].clear()
                if not len(u):
                    continue
                cut = np.concatenate([[0], np.flatnonzero(np.diff(u >> piece)) + 1, [len(u)]])
                for x, y in zip(cut[:-1], cut[1:]):
                    k = row << (MAX_BITS - PIECE_BITS) | int(u[x] >> piece)
                    own = np.diff(u[x:y] & low, prepend=0).astype(np.uint32)
                    rows.append((k % n, 0, k.to_bytes(4, "little"), zlib.compress(own.tobytes(), 1), np.packbits(c[x:y] > 1).tobytes()))
            return blob_batch(rows)

        for batch in batches:
            for _, arr in K.slices(batch):
                w = K.Words(arr)
                _, at, g = window_anchors(w, window, gram)
                h = g[np.unique(at)]
                held += len(h)
                for row in range(DEPTH):
                    cells[row].append(_cells(h, row, bits))
            if held > FLUSH:
                held = 0
                yield flush()
        yield flush()

    def merge(batches):
        planes: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for _, _, (k, cells, two, _) in by_kind(batches):
            once, more = planes.setdefault(int.from_bytes(k, "little"), (np.zeros(1 << piece, bool), np.zeros(1 << piece, bool)))
            u = np.cumsum(np.frombuffer(zlib.decompress(cells), np.uint32), dtype=np.int64)
            more[u[np.unpackbits(np.frombuffer(two, np.uint8), count=len(u)).astype(bool) | once[u]]] = True
            once[u] = True
        yield blob_batch([(k, 0, np.packbits(more).tobytes()) for k, (_, more) in planes.items()])

    return regroup(docs.select("text").mapInArrow(count, BLOB_SCHEMA), n).mapInArrow(merge, BLOB_SCHEMA)


def _sketch_bits(docs: DataFrame, bits: int | None) -> int:
    """Cells for eight times the expected anchors: a text has one for about 14 words, or 80 bytes."""
    if bits is None:
        size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
        bits = int(np.ceil(np.log2(max(1, size / 10))))
    return max(MIN_BITS, min(MAX_BITS, bits))


def dedup_passages(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, bits: int | None = None) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and kept (the words left, joined by one space) of every text."""
    spark, docs = bound_batches(docs).sparkSession, repeatable(docs.select("doc_id", "text"))
    n = buckets(docs)
    bits = _sketch_bits(docs, bits)
    piece = min(bits, PIECE_BITS)
    planes = [np.zeros(1 << (bits - 3), np.uint8) for _ in range(DEPTH)]
    # the merged sketch has DEPTH * 2**(bits - 3) bytes at most, whatever the input
    for r in sketch(docs, bits, window, gram, n).select("bucket", "a").toLocalIterator():
        row, k = divmod(r["bucket"], 1 << (MAX_BITS - PIECE_BITS))
        planes[row][k << (piece - 3) : (k + 1) << (piece - 3)] = np.frombuffer(r["a"], np.uint8)
    seen = spark.sparkContext.broadcast(planes)

    def repeated(h: np.ndarray) -> np.ndarray:
        out = np.ones(len(h), bool)
        for row in range(DEPTH):
            c = _cells(h, row, bits)
            out &= (seen.value[row][c >> 3] >> (7 - (c & 7)).astype(np.uint8) & 1).astype(bool)
        return out

    def scan(batches):
        """Kinds: 0 hashes settled in the task; 1 hashes that wait, with row and position; 2 texts that wait; 3 texts that are done."""
        task, first = TaskContext.get().partitionId(), 0
        wins: list[tuple] = []
        waiting: list[tuple] = []

        def flush():
            if not wins:
                return []
            h1, h2, row, pos = (np.concatenate(x) for x in zip(*wins))
            wins.clear()
            order = np.lexsort((h2, h1))
            h1, h2, row, pos = h1[order], h2[order], row[order], pos[order]
            new = np.ones(len(h1), bool)
            new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
            lead = np.flatnonzero(new)
            size = np.diff(np.concatenate([lead, [len(h1)]]))
            some, one = lead[size > 1], lead[size == 1]
            rows = deal(h1[some], n, 0, h1[some], h2[some]) + deal(h1[one], n, 1, h1[one], h2[one], row[one], pos[one])
            many = np.repeat(size > 1, size)
            r, p = row[many], pos[many]
            order = np.argsort(r, kind="stable")
            r, p = r[order], p[order]
            keys = np.array([x[0] for x in waiting], _U)
            a, b = np.searchsorted(r, keys), np.searchsorted(r, keys, "right")
            to = bucket_of(K.mix(keys), n)
            for i, (key, doc_id, text) in enumerate(waiting):
                rows.append((int(to[i]), 2, key.tobytes() + id_bytes(doc_id), zlib.compress(text, 1), p[a[i] : b[i]].tobytes()))
            waiting.clear()
            return rows

        held = 0
        for batch in batches:
            done = []
            for part, arr in K.slices(batch):
                w = K.Words(arr)
                keys = row_keys(task, first, len(arr))
                first += len(arr)
                starts, at, g = window_anchors(w, window, gram)
                s = starts[repeated(g[at])]
                doc = w.docs()[s]
                wins.append((K.ngrams(w.hashes, window, 0)[s], (K.ngrams(w.hashes, window, 1)[s] >> _U(32)).astype(np.uint32), keys[doc], (s - w.first[doc]).astype(np.uint32)))
                wait = np.zeros(len(arr), bool)
                wait[doc] = True
                to = bucket_of(K.mix(keys), n)
                for i, doc_id in enumerate(part.column(0).to_pylist()):
                    raw = w.data[w.offs[i] : w.offs[i + 1]].tobytes()
                    if wait[i]:
                        waiting.append((keys[i], doc_id, raw))
                        held += len(raw)
                    else:
                        done.append((int(to[i]), 3, *_final(doc_id, raw.split(), 0)))
                held += 24 * len(s)
                if held >= FLUSH_BYTES:
                    held = 0
                    yield blob_batch(flush())
            yield blob_batch(done)
        yield blob_batch(flush())

    def group(batches):
        """Exact counts of the windows of one bucket; an answer goes to each row that waits for a window that recurs."""
        settled, waits = [], []

        def answers():
            h1 = joined([x[0] for x in settled + waits], _U)
            h2 = joined([x[1] for x in settled + waits], np.uint32)
            known = sum(len(x[0]) for x in settled) // 8
            row, pos = joined([x[2] for x in waits], _U), joined([x[3] for x in waits], np.uint32)
            order = np.lexsort((h2, h1))
            a, b = h1[order], h2[order]
            same = np.zeros(len(a) + 1, bool)
            same[1:-1] = (a[1:] == a[:-1]) & (b[1:] == b[:-1])
            dup = order[same[:-1] | same[1:]]
            hit = dup[dup >= known] - known
            return deal(K.mix(row[hit]), n, 0, row[hit], pos[hit])

        through: list[tuple] = []
        for bucket, kind, x in by_kind(batches):
            if kind < 2:
                (waits if kind else settled).append(x)
                continue
            through.append((bucket, kind, *x))
            if len(through) >= 500:
                yield blob_batch(through)
                through = []
        yield blob_batch(through)
        if waits:
            yield blob_batch(answers())

    def finish(batches):
        replies, gone = [], None
        out: list[tuple] = []
        for _, kind, x in by_kind(batches):
            if kind == 0:
                replies.append(x)
                continue
            if gone is None:
                row, pos = joined([y[0] for y in replies], _U), joined([y[1] for y in replies], np.uint32)
                order = np.argsort(row, kind="stable")
                gone = row[order], pos[order]
            if kind == 2:
                key = np.frombuffer(x[0][:8], _U)[0]
                a, b = np.searchsorted(gone[0], key), np.searchsorted(gone[0], key, "right")
                words = zlib.decompress(x[1]).split()
                starts = np.concatenate([gone[1][a:b], np.frombuffer(x[2], np.uint32)]).astype(np.int64)
                cover = K.covered(starts, window, len(words))
                x = _final(id_value(x[0][8:]), [words[i] for i in np.flatnonzero(~cover)], int(cover.sum()))
            out.append(x)
            if len(out) >= 1000:
                yield _result(out)
                out = []
        yield _result(out)

    one = regroup(docs.select("doc_id", "text").mapInArrow(scan, BLOB_SCHEMA), n).mapInArrow(group, BLOB_SCHEMA)
    return regroup(one, n).mapInArrow(finish, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")


def _final(doc_id: int | None, kept: list[bytes], removed: int) -> tuple[bytes, bytes, bytes, bytes]:
    text = b" ".join(kept)
    return id_bytes(doc_id), (len(kept) + removed).to_bytes(8, "little") + removed.to_bytes(8, "little"), hashlib.sha256(text).hexdigest().encode(), zlib.compress(text, 1)


def _result(rows: list[tuple]) -> pa.RecordBatch:
    num = lambda i: pa.array([int.from_bytes(r[1][8 * i : 8 * i + 8], "little") for r in rows], pa.int64())
    return pa.RecordBatch.from_arrays([
        pa.array([id_value(r[0]) for r in rows], pa.int64()), num(0), num(1),
        pa.array([r[2].decode() for r in rows], pa.string()), pa.array([zlib.decompress(r[3]).decode() for r in rows], pa.string()),
    ], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])
