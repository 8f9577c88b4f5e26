"""Benchmark decontamination with SimHash windows and multi-index Hamming blocks.

For an item of n words, a document is cut into all windows of n words (the whole
document if it is shorter).  Similarity is the weighted Jaccard index of 5-word
shingles: a shingle weighs the log of its rarity among the items, times its
repeats.  The search for windows with similarity 0.8 or more has three steps.

1. A window that reaches the threshold misses less than (1 - t) of the item's
   weight, so it holds one of the item's rarest shingles that make up more than
   that.  Only windows over such a shingle are paired with the item; nothing is
   lost, and a document costs what its hits cost, however many items it holds.
2. The windows' weighted SimHash is compared in 8 blocks of 8 bits: fingerprints
   within RADIUS = 23 bits differ by at most 2 bits in some block, so pairs that
   meet in no block are out, and every pair within the radius stays.
3. The exact similarity verifies what is left.  A bound from prefix sums puts
   the windows of a pair in order, and those that cannot beat the best are skipped.

An item shorter than a shingle is one shingle.  Items of one text are searched
once.  Rarity is counted over all items, whatever the number of parts: the index
is broadcast only while its texts have at most MAX_BYTES (or are one item);
beyond that items are split by a hash of their text, with a pass for each part.
Shingles of one item weigh the same as unknown ones, so only shared ones are
kept, in slices of SLICE that a worker reads in turn if they are several.

Nulls and odd cases: a null or empty text or item matches nothing; a null id is
carried as null; repeated rows or items are reported each; words are compared
with A-Z lower-cased; an empty benchmark gives no rows; an output column whose
name is taken by a kept one gets an underscore.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkit as K
from .common import bound_batches, fresh_names, materialize

SHINGLE, THRESHOLD, RADIUS = 5, 0.8, 23
MAX_BYTES = 16 << 20
SLICE = 4 << 20  # shared shingles in memory at once
_U = np.uint64
_BITMAP = 22
_SPAN = 1 << 13  # windows fingerprinted at once
_PAIRS = 1 << 20  # (hit, item) pairs expanded at once
_CELLS = 1 << 20  # shingles of windows compared at once


def _signs(h: np.ndarray) -> np.ndarray:
    bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return bits.astype(np.float64) * 2 - 1


def _fold(sums: np.ndarray) -> np.ndarray:
    return np.packbits(sums > 0, axis=1, bitorder="little").view("<u8").ravel().astype(_U)


def within_radius(fps: np.ndarray, fp: np.ndarray) -> np.ndarray:
    """Which fingerprints differ in at most RADIUS bits, asked first block by block: in one of 8 the difference is at most RADIUS // 8."""
    diff = fps ^ fp
    out = np.flatnonzero((np.bitwise_count(diff.view(np.uint8).reshape(-1, 8)) <= RADIUS // 8).any(axis=1))
    return out[np.bitwise_count(diff[out]) <= RADIUS]


class Weights:
    """log(1 + items / items with the shingle), from the shared shingles and their counts; any other counts as in one item."""

    def __init__(self, n_items: int, slices: list):
        self.one, self.n, self.slices = float(np.log1p(n_items or 1)), n_items, slices  # slices: broadcasts of (sorted shingles, counts)

    def of(self, sh: np.ndarray) -> np.ndarray:
        out = np.full(len(sh), self.one)
        for s in self.slices:
            known, df = s.value
            at = np.minimum(np.searchsorted(known, sh), len(known) - 1)
            ok = known[at] == sh
            out[ok] = np.log1p(self.n / df[at[ok]])
            if len(self.slices) > 1:
                s.__dict__.pop("_value", None)  # one slice in memory at a time
        return out


class Index:
    """Items, their shingles and fingerprints, and the rare shingles that lead to them; grows with the items only."""

    def __init__(self, items: list[tuple[int, str]], weights: Weights, threshold: float = THRESHOLD, shingle: int = SHINGLE):
        self.threshold, self.weights = threshold, weights
        self.keys, sizes, grams, shingles, counts, item = [], [], [], [], [], []
        for key, text in items:
            w = K.Words(K.strings(pa.array([text], pa.string())), lower=True)
            h = w.hashes
            if not len(h):
                continue
            g = min(shingle, len(h))
            sh, c = np.unique(K.ngrams(h, g)[: len(h) - g + 1], return_counts=True)
            item.append(np.full(len(sh), len(self.keys)))
            self.keys.append(key)
            sizes.append(len(h))
            grams.append(g)
            shingles.append(sh)
            counts.append(c)
        self.n, self.gram = np.array(sizes, np.int64), np.array(grams, np.int64)
        none = np.zeros(0, np.int64)
        sh, c, item = np.concatenate([none.astype(_U), *shingles]), np.concatenate([none, *counts]), np.concatenate([none, *item])
        wt = weights.of(sh)
        self.total = np.bincount(item, wt * c, len(self.keys))
        self.fp = np.zeros(len(self.keys), _U)
        for k, (s, m) in enumerate(zip(shingles, counts)):
            self.fp[k] = _fold((_signs(s) * (weights.of(s) * m)[:, None]).sum(axis=0, keepdims=True))[0]
        # shingles of an item by a hash of both
        self.counts, self.salt = c, K.mix(np.arange(len(self.keys), dtype=_U) + _U(1))
        self.table = K.HashTable(K.join(self.salt[item], sh))
        # per shingle size: rare shingles, and the items that each leads to
        order = np.lexsort((sh, -wt, item))
        lead = np.searchsorted(item[order], np.arange(len(self.keys)))
        upto = np.cumsum((wt * c)[order])
        before = upto - (wt * c)[order]
        rare = order[before - before[lead][item[order]] <= (1 - threshold) * self.total[item[order]]] if len(order) else order
        self.rare = {}
        for g in sorted(set(grams)):
            own = rare[self.gram[item[rare]] == g]
            own = own[np.argsort(sh[own], kind="stable")]
            keys, first = np.unique(sh[own], return_index=True)
            bitmap = np.zeros(1 << _BITMAP, bool)
            bitmap[(keys >> _U(64 - _BITMAP)).astype(np.int64)] = True
            self.rare[g] = (K.HashTable(keys), bitmap, np.concatenate([first, [len(own)]]), item[own])

    def similarities(self, h: np.ndarray, starts: np.ndarray, m: int, k: int) -> np.ndarray:
        """Exact similarity of item k to the windows of m shingles from each start."""
        out = np.zeros(len(starts))
        for a in range(0, len(starts), max(1, _CELLS // m)):
            own = starts[a : a + max(1, _CELLS // m)]
            s = np.sort(h[own[:, None] + np.arange(m)], axis=1)
            new = np.ones(s.shape, bool)
            new[:, 1:] = s[:, 1:] != s[:, :-1]
            at = np.flatnonzero(new.ravel())
            row, u, c = at // m, s.ravel()[at], np.diff(np.concatenate([at, [s.size]]))
            w, hit = self.weights.of(u), self.table.find(K.join(self.salt[k], u))
            both = np.bincount(row, w * np.where(hit >= 0, np.minimum(c, self.counts[hit]), 0), len(own))
            out[a : a + len(own)] = both / (np.bincount(row, w * c, len(own)) + self.total[k] - both)
        return np.round(out, 9)  # equal windows compare equal however they sum

    def search(self, arr: pa.Array) -> list[tuple[int, int, float, int, int]]:
        """(text, item, similarity, first word, words) of the best window of every pair that reaches the threshold."""
        w = K.Words(arr, lower=True)
        best: dict[tuple[int, int], tuple] = {}
        for g, (table, bitmap, first, item) in self.rare.items():
            h = K.ngrams(w.hashes, g)
            maybe = np.flatnonzero(bitmap[(h >> _U(64 - _BITMAP)).astype(np.int64)] & (w.room() >= g))
            hit = table.find(h[maybe])
            at, hit = maybe[hit >= 0], hit[hit >= 0]
            upto = np.cumsum(first[hit + 1] - first[hit])
            a = 0
            while a < len(at):
                b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + _PAIRS, "right")))
                self._hits(w, h, g, at[a:b], hit[a:b], first, item, best)
                a = b
        return [(d, k, s, -p, n) for (d, k), (s, p, n) in sorted(best.items())]

    def _hits(self, w, h, g, at, hit, first, item, best) -> None:
        """Windows of items over the rare shingles `hit` at the words `at`."""
        n = first[hit + 1] - first[hit]
        p = np.repeat(at, n)
        k = item[np.repeat(first[hit] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))]
        d = np.searchsorted(w.first, p, "right") - 1
        last = np.maximum(w.first[d], w.first[d + 1] - self.n[k])  # last start of a window
        lo, hi = np.maximum(w.first[d], np.minimum(p - self.n[k] + g, last)), np.minimum(p, last)
        order = np.lexsort((lo, k, self.n[k], d))
        d, k, lo, hi = d[order], k[order], lo[order], hi[order]
        new = np.ones(len(d), bool)
        new[1:] = (d[1:] != d[:-1]) | (k[1:] != k[:-1]) | (lo[1:] > hi[:-1] + 1)
        lead = np.flatnonzero(new)
        d, k, lo, hi = d[lead], k[lead], lo[lead], hi[np.concatenate([lead[1:], [len(new)]]) - 1]
        # texts and item sizes in turn: items of one size share the windows' fingerprints
        cut = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (self.n[k[1:]] != self.n[k[:-1]]), [True]]))
        for a, b in zip(cut[:-1], cut[1:]):
            own = np.argsort(lo[a:b], kind="stable") + a
            self._windows(w, h, g, int(d[a]), k[own], lo[own], hi[own], best)

    def _windows(self, w, h, g, d, k, lo, hi, best) -> None:
        """Ranges (item, first start, last start) of one text and one item size, by first start."""
        a, z = int(w.first[d]), int(w.first[d + 1])
        m = min(int(self.n[k[0]]), z - a) - g + 1  # shingles of a window
        i, x = 0, int(lo[0])
        open_: list[int] = []
        while i < len(k) or open_:
            if not open_:
                x = max(x, int(lo[i]))
            end = x + _SPAN
            while i < len(k) and lo[i] < end:
                open_.append(i)
                i += 1
            y = min(end, max(int(hi[j]) for j in open_) + 1)
            own = h[x : y - 1 + m]
            wt = self.weights.of(own)
            sums = np.concatenate([np.zeros((1, 64)), np.cumsum(_signs(own) * wt[:, None], axis=0)])
            fps = _fold(np.round(sums[m:] - sums[:-m], 9))
            for j in open_:
                s, e = max(x, int(lo[j])), min(y, int(hi[j]) + 1)
                near = within_radius(fps[s - x : e - x], self.fp[k[j]])
                if len(near):
                    self._verify(h, g, d, int(k[j]), near + s, m, a, own, wt, x, best)
            open_ = [j for j in open_ if hi[j] >= y]
            x = y

    def _verify(self, h, g, d, k, starts, m, a, own, wt, x, best) -> None:
        """The best of the windows, the first of equals, into `best`: (similarity, -first word, words)."""
        lo, hi = int(starts[0]) - x, int(starts[-1]) - x + m
        hit = self.table.find(K.join(self.salt[k], own[lo:hi])) >= 0
        mine, all_ = (np.concatenate([[0.0], np.cumsum(v)]) for v in (np.where(hit, wt[lo:hi], 0.0), wt[lo:hi]))
        at = starts - x - lo
        both = np.minimum(mine[at + m] - mine[at], self.total[k])
        bound = np.round(both / (all_[at + m] - all_[at] + self.total[k] - both), 9)  # repeats beyond the item's only lower it
        rest, step, found = np.lexsort((starts, -bound)), 4, best.get((d, k))
        while len(rest):
            now, rest = rest[:step], rest[step:]
            for s, p in zip(self.similarities(h, starts[now], m, k).tolist(), (starts[now] - a).tolist()):
                if s >= self.threshold and (found is None or (s, -p) > found[:2]):
                    found = best[(d, k)] = (s, -p, m + g - 1)
            least = found[0] if found else self.threshold
            rest = rest[(bound[rest] > least + 1e-8) | ((bound[rest] > least - 1e-8) & (found is None or starts[rest] < a - found[1]))]
            step *= 2


def _items(benchmark: DataFrame) -> DataFrame:
    """item_id and text with a key of the text, written once."""
    own = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    return materialize(own.withColumn("key", F.xxhash64("text")).withColumn("size", F.octet_length("text").cast("long")), "benchmark")


def _parts(items: DataFrame, max_bytes: int) -> list[DataFrame]:
    """Distinct texts in parts of at most max_bytes, or of one hash bucket, which has one item unless items are small."""
    texts = items.dropDuplicates(["key", "text"]).select("key", "text", "size")
    whole = texts.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("n")).first()["n"]
    if whole <= max_bytes:
        return [texts]
    k = max(2, -(-16 * whole // max_bytes))  # buckets of a sixteenth of a part on average
    bucket = F.pmod(F.xxhash64("key"), F.lit(k))
    sizes = {r["b"]: r["n"] for r in texts.groupBy(bucket.alias("b")).agg(F.sum("size").alias("n")).collect()}
    out, first, held = [], 0, 0
    for b in range(k):
        n = sizes.get(b, 0)
        if held and held + n > max_bytes:
            out.append(texts.where((bucket >= first) & (bucket < b)))
            first, held = b, 0
        held += n
    return [*out, texts.where(bucket >= first)]


def _weights(items: DataFrame, shingle: int = SHINGLE, size: int = SLICE) -> Weights:
    """Counts over all items of the shingles that several have."""
    spark = items.sparkSession

    def shingles(batches):
        for batch in batches:
            for _, arr in K.slices(batch):
                w, out, words = K.Words(arr, lower=True), [np.zeros(0, _U)], 0
                for g in sorted({min(shingle, c) for c in w.counts.tolist()} - {0}):
                    h = K.ngrams(w.hashes, g)
                    for i in np.flatnonzero(np.minimum(shingle, w.counts) == g):
                        out.append(np.unique(h[w.first[i] : w.first[i + 1] - g + 1]))
                        words += 1
                flat = np.concatenate(out)
                yield pa.RecordBatch.from_arrays([pa.array(flat.view(np.int64)), pa.array(np.zeros(len(flat), np.int64))], names=["h", "n"])
                yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([words], pa.int64())], names=["h", "n"])

    each = bound_batches(items).select("text").mapInArrow(shingles, "h long, n long")
    counts = materialize(each.groupBy("h").agg(F.count("*").alias("df"), F.sum("n").alias("n")).where("h IS NULL OR df > 1"), "benchmark-shingles")
    n = counts.where("h IS NULL").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    shared = counts.where("h IS NOT NULL")
    k, out = -(-shared.count() // size), []
    for i in range(k):  # a slice on the driver at a time
        rows = shared.where(F.pmod(F.xxhash64("h"), F.lit(k)) == i).select("h", "df").toArrow()
        h, df = rows.column("h").to_numpy().view(_U), rows.column("df").to_numpy()
        order = np.argsort(h)
        out.append(spark.sparkContext.broadcast((h[order], df[order])))
    return Weights(n, out)


def _indexes(items: DataFrame, threshold: float, max_bytes: int):
    """A broadcast index of each part of the items."""
    weights = _weights(items)
    for part in _parts(items, max_bytes):
        rows = [(r["key"], r["text"]) for r in part.collect()]  # at most max_bytes of text, or one item
        yield items.sparkSession.sparkContext.broadcast(Index(rows, weights, threshold))


def contaminated(docs: DataFrame, benchmark: DataFrame, keep: list[str], threshold: float = THRESHOLD, max_bytes: int = MAX_BYTES) -> DataFrame:
    """The columns `keep` of docs, item_id, similarity, start_word and n_words of every pair at or above the threshold."""
    items = _items(benchmark)
    names = [f"c{i}" for i in range(len(keep))]
    more = (("key", T.LongType()), ("similarity", T.DoubleType()), ("start_word", T.LongType()), ("n_words", T.LongType()))
    schema = T.StructType([T.StructField(n, docs.schema[c].dataType) for n, c in zip(names, keep)] + [T.StructField(c, t) for c, t in more])
    src = bound_batches(docs).select(*[F.col(f"`{c}`").alias(n) for n, c in zip(names, keep)], F.col("text").alias("__text"))
    out = None
    for index in _indexes(items, threshold, max_bytes):

        def run(batches, index=index):
            for batch in batches:
                for own, arr in K.slices(batch, "__text"):
                    found = index.value.search(arr)
                    if found:
                        at = pa.array([f[0] for f in found], pa.int64())
                        cols = [own.column(i).take(at) for i in range(len(keep))]
                        cols += [pa.array([index.value.keys[f[1]] for f in found], pa.int64()), pa.array([f[2] for f in found], pa.float64()), pa.array([f[3] for f in found], pa.int64()), pa.array([f[4] for f in found], pa.int64())]
                        yield pa.RecordBatch.from_arrays(cols, names=[f.name for f in schema])

        got = src.mapInArrow(run, schema)
        out = got if out is None else out.unionAll(got)
    to = fresh_names(keep, ["item_id", "similarity", "start_word", "n_words"])
    pairs = out.join(items.select("key", "item_id"), "key").select(*names, "item_id", "similarity", "start_word", "n_words")
    return pairs.toDF(*keep, *to)


def clean_documents(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, max_bytes: int = MAX_BYTES) -> DataFrame:
    """The documents without a window that reaches the threshold, columns unchanged; one narrow pass for each index part."""
    src = bound_batches(docs)
    for index in _indexes(_items(benchmark), threshold, max_bytes):

        def run(batches, index=index):
            for batch in batches:
                for own, arr in K.slices(batch):
                    keep = np.ones(len(arr), bool)
                    keep[[f[0] for f in index.value.search(arr)]] = False
                    yield own.filter(pa.array(keep))

        src = src.mapInArrow(run, docs.schema)
    return src
