"""Near-duplicate removal by SimHash with covering LSH, checked exactly and completed over 5-word shingles.

Similarity is the Jaccard similarity of the sets of 5-word shingles and counts
from 0.8 on.  Texts with equal shingle sets are one class and enter once.

First the operator of simhash.py runs over the classes: fingerprints of 3-word
shingles, covering tables, components within 2 bits.  Classes of one component
are linked where their exact similarity is 0.8 or more.

A pair of similarity 0.8 can be further apart than any covering radius, so a
prefix search looks for the links between what these left apart.  Put any order
on all shingles: of two sets that similar, each has a common shingle among its
first n - ceil(0.8 n) + 1 of n, whatever was edited, inserted, cut or replaced.
Every class enters once for each shingle of that prefix, and classes of one
shingle meet if their sizes allow 0.8 and SimHashes of the sets are within LOOSE
of 256 bits.  The order only sets the cost: shingles that many of a SAMPLE of
texts share (HOT or more) come last, commonest very last, all others by hash.

Pairs are never listed.  A bucket gives a spanning forest of the pairs that meet
in it, the forests' components are the families, and a pair to be linked is
within one.  A family's sets, made again from the texts, are sent to one place;
of a family of more than CHUNK classes each pair of chunks is a block, so a class
is sent once for each CHUNK classes of its family.  A block compares its sets
exactly and skips what is linked already.  Shingles are told apart by 52-bit
hashes.

Nulls and odd cases: null, empty and blank texts are one class, so one of them
stays; a text of fewer than five words is one shingle; of each component the row
with the least id stays, null ids last, and of repeated rows one; an empty table
stays empty; columns may have any names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import simhash
from . import textkit as K
from .common import BLOB_SCHEMA, blob_batch, bound_batches, bucket_of, buckets, by_kind, deal, joined, materialize, plain_names, regroup
from .components import connected_components

SHINGLE = 5
SAMPLE, HOT, MOST_HOT = 4096, 8, 1 << 16
SIMHASH_SHINGLE, RADIUS = 3, 2
CHUNK = 256
WORDS5 = 4  # 64-bit words of the shingle fingerprint
LOOSE = 79  # of 256 bits: 38.8 at similarity 0.8, and seven standard errors of 5.7
_U = np.uint64
_BITS = _U(52)  # of a shingle's hash; the text within a slice takes the rest
_SALT = np.array([K.splitmix(1000 + i) for i in range(WORDS5)], _U)
#: each byte as eight byte-wide counters
_SPREAD = np.array([sum(((b >> k) & 1) << (8 * k) for k in range(8)) for b in range(256)], _U)
_MEMBER = np.dtype([("family", "<i8"), ("p", "<i4"), ("q", "<i4"), ("chunk", "<i4"), ("cls", "<i8"), ("root", "<i8")])
_ENTRY = np.dtype([("key", "<u8"), ("cls", "<i8"), ("size", "<u4"), ("five", "<u8", (WORDS5,))])


def set_simhash(h: np.ndarray, doc: np.ndarray, n_docs: int) -> np.ndarray:
    """SimHash of each document's hashes (doc ascending); zero for a document without any."""
    out = np.zeros(n_docs, _U)
    if not len(h):
        return out
    own, start, size = np.unique(doc, return_index=True, return_counts=True)
    within = np.arange(len(h)) - np.repeat(start, size)
    cut = np.flatnonzero(within % 255 == 0)  # byte counters hold 255
    sums = np.add.reduceat(_SPREAD[h.view(np.uint8).reshape(-1, 8)], cut, axis=0).view(np.uint8).reshape(len(cut), 64)
    first = np.searchsorted(cut, start)
    ones = np.add.reduceat(sums, first, axis=0, dtype=np.int64)
    out[own] = np.packbits(2 * ones > size[:, None], axis=1, bitorder="little").view("<u8").ravel()
    return out


def _whole(h: np.ndarray) -> int:
    x = 0
    for v in h:
        x = K.splitmix(x ^ int(v))
    return x


def shingle_sets(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(shingles, text) of the distinct shingles of each text, by text and shingle; at most 4096 texts."""
    w, n = K.Words(arr, lower=True), len(arr)
    doc = w.docs()
    ok = w.room() >= SHINGLE
    s, d = K.ngrams(w.hashes, SHINGLE)[ok], doc[ok]
    few = np.flatnonzero((w.counts < SHINGLE) & (w.counts > 0))
    if len(few):  # a short text is one shingle
        s = np.concatenate([s, np.array([_whole(w.hashes[w.first[i] : w.first[i + 1]]) for i in few], _U)])
        d = np.concatenate([d, few])
    assert n <= 1 << 12
    key = np.sort((d.astype(_U) << _BITS) | (s >> _U(12)))
    key = key[np.concatenate([[True], key[1:] != key[:-1]])] if len(key) else key
    return key & _U((1 << 52) - 1), (key >> _BITS).astype(np.int64)


def set_classes(s: np.ndarray, doc: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """(class, size) of each text's set; equal sets are one class."""
    size = np.bincount(doc, minlength=n_docs)
    total = np.zeros(n_docs, _U)
    if len(s):
        own = np.flatnonzero(size)
        total[own] = np.add.reduceat(K.mix(s + _SALT[0]), np.searchsorted(doc, own))
    return K.mix(total ^ size.astype(_U)), size


def prefixes(s: np.ndarray, doc: np.ndarray, size: np.ndarray, hot: K.HashTable) -> list[bytes]:
    """The shingles of each text that any set of similarity 0.8 or more must share one of: the first n - ceil(0.8 n) + 1 in the order."""
    rank = hot.find(s << _U(12))  # -1 for the others
    if (rank >= 0).any():
        order = np.argsort(doc * (len(hot.keys) + 1) + rank + 1, kind="stable")
        s = s[order]
    start = np.cumsum(size) - size
    take = np.where(size > 0, size - (4 * size + 4) // 5 + 1, 0)
    return [s[a : a + k].tobytes() for a, k in zip(start.tolist(), take.tolist())]


def hot_shingles(docs: DataFrame) -> np.ndarray:
    """Shingles of HOT or more different sets among about SAMPLE texts, rarest first; at most MOST_HOT."""

    def count(batches):
        seen, parts = set(), []
        for batch in batches:
            for _, arr in K.slices(batch):
                s, doc = shingle_sets(arr)
                cls, size = set_classes(s, doc, len(arr))
                new = np.zeros(len(arr), bool)
                for i, c in enumerate(cls.tolist()):
                    new[i] = c not in seen
                    seen.add(c)
                parts.append(s[new[doc]])
        if parts:
            k, c = np.unique(np.concatenate(parts), return_counts=True)
            order = np.argsort(c, kind="stable")[-MOST_HOT:]
            order = order[c[order] >= HOT]
            yield pa.RecordBatch.from_arrays([pa.array([k[order].tobytes()])], names=["hot"])

    every = max(1, docs.count() // SAMPLE)
    some = docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(every)) == 0).select("text").repartition(1)
    return joined([bytes(r["hot"]) for r in some.mapInArrow(count, "hot binary").collect()], _U)


def fingerprint_rows(docs: DataFrame) -> DataFrame:
    """doc_id, th (hash of the text), cls, size, prefix, fp (as in simhash.py) and f0, f1, ... of every document."""
    names = [f"f{i}" for i in range(WORDS5)]
    src = bound_batches(docs)
    hot = hot_shingles(src)
    table = docs.sparkSession.sparkContext.broadcast(hot)

    def run(batches):
        order = K.HashTable(table.value << _U(12))
        for batch in batches:
            for part, arr in K.slices(batch):
                n = len(arr)
                s, doc = shingle_sets(arr)
                cls, size = set_classes(s, doc, n)
                f = [set_simhash(K.mix(s ^ x), doc, n).view(np.int64) for x in _SALT]
                fp = simhash.fingerprint_array(arr, SIMHASH_SHINGLE)
                cols = [pa.array(cls.view(np.int64)), pa.array(size.astype(np.int32)), pa.array(prefixes(s, doc, size, order), pa.binary()), pa.array(fp), *(pa.array(x) for x in f)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *cols], names=["doc_id", "th", "cls", "size", "prefix", "fp", *names])

    kind = docs.schema["doc_id"].dataType.simpleString()
    src = src.select("doc_id", F.xxhash64("text").alias("th"), "text")
    return src.mapInArrow(run, f"doc_id {kind}, th long, cls long, size int, prefix binary, fp long, " + ", ".join(f"{c} long" for c in names))


def meetings(e: np.ndarray):
    """Index pairs of the entries that share a shingle and whose sizes allow a similarity of 0.8; e is by key and size."""
    key, size = e["key"], e["size"].astype(np.int64)
    at, off = np.arange(len(e)), 0
    while len(at):
        off += 1
        at = at[at + off < len(e)]
        # within a shingle sizes ascend: what is too long now stays too long
        at = at[(key[at] == key[at + off]) & (5 * size[at] >= 4 * size[at + off])]
        if len(at):
            yield at, at + off


def forest(classes: DataFrame, n: int) -> DataFrame:
    """Links (a, b) with the components, bucket by bucket, of all pairs of the classes (cls, size, prefix, f0, ...) that meet and are not far apart by the sketch."""

    def tables(batches):
        for batch in batches:
            prefix = batch.column(2).to_pylist()
            key = joined(prefix, _U)
            row = np.repeat(np.arange(len(prefix)), [len(p) // 8 for p in prefix])
            e = np.zeros(len(key), _ENTRY)
            e["key"], e["cls"], e["size"] = key, *(batch.column(k).to_numpy()[row] for k in range(2))
            for k in range(WORDS5):
                e["five"][:, k] = batch.column(3 + k).to_numpy().view(_U)[row]
            yield blob_batch(deal(K.mix(key), n, 0, e))

    def span(batches):
        e = joined([x[0] for _, _, x in by_kind(batches)], _ENTRY)
        e = e[np.lexsort((e["size"], e["key"]))]
        cls, own = np.unique(e["cls"], return_inverse=True)
        trees, out = Trees(len(cls)), [np.zeros((0, 2), np.int64)]
        for i, j in meetings(e):
            apart = trees.top[own[i]] != trees.top[own[j]]
            i, j = i[apart], j[apart]
            near = np.bitwise_count(e["five"][i] ^ e["five"][j]).sum(axis=1, dtype=np.int64) <= LOOSE
            out.append(cls[trees.link(np.stack([own[i[near]], own[j[near]]], axis=1))])
        x = np.concatenate(out)
        for a in range(0, len(x), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(x[a : a + (1 << 16), 0]), pa.array(x[a : a + (1 << 16), 1])], names=["a", "b"])

    return regroup(classes.mapInArrow(tables, BLOB_SCHEMA), n).mapInArrow(span, "a long, b long")


class Trees:
    """Disjoint sets of 0 to n - 1; `top` is each one's set."""

    def __init__(self, n: int):
        self.top = np.arange(n)

    def link(self, pairs: np.ndarray) -> np.ndarray:
        """Joins the sets of each pair; the pairs that did join two."""
        x = self.top[pairs]
        _, one = np.unique(x.min(axis=1) * len(self.top) + x.max(axis=1), return_index=True)
        up, new = {}, []

        def find(i):
            while i in up:
                up[i] = up.get(up[i], up[i])
                i = up[i]
            return i

        for k, (a, b) in zip(one.tolist(), x[one].tolist()):
            a, b = find(a), find(b)
            if a != b:
                up[b] = a
                new.append(k)
        if new:
            to = np.arange(len(self.top))
            old = list(up)
            to[old] = [find(i) for i in old]
            self.top = to[self.top]
        return pairs[new]


def block_links(member: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links (a, b) with the components of the pairs of similarity 0.8 or more between the two chunks of a block, given the roots."""
    member, one = np.unique(member, return_index=True)  # a text in several tasks is sent by each
    sets = [sets[i] for i in one.tolist()]
    size = np.array([len(x) for x in sets])
    _, root = np.unique(member["root"], return_inverse=True)
    trees, out = Trees(len(member)), []
    trees.top = root
    key, of = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
    order = np.lexsort((of, key))
    key, of = key[order], of[order]
    crossed = member["p"][0] != member["q"][0]
    for i, own in enumerate(sets):
        if len(member) == i + 1 or (trees.top == trees.top[i]).all():
            continue
        lo, hi = np.searchsorted(key, own), np.searchsorted(key, own, "right")
        many = hi - lo
        at = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(lo, many)
        both = np.bincount(of[at], minlength=len(sets))
        ok = 5 * both >= 4 * (size[i] + size - both)
        ok &= (np.arange(len(sets)) > i) & (trees.top != trees.top[i])
        if crossed:
            ok &= member["chunk"] != member["chunk"][i]
        j = np.flatnonzero(ok)
        if len(j):
            new = trees.link(np.stack([np.full(len(j), i), j], axis=1))
            out += [(int(member["cls"][a]), int(member["cls"][b])) for a, b in new.tolist()]
    return out


def exact_links(groups: DataFrame, docs: DataFrame, n: int) -> DataFrame:
    """Links (a, b) with the components of the pairs of classes of one family whose exact similarity is 0.8 or more.

    groups has family, cls, root (equal for what is linked already), and doc_id and th of one text of each class.
    """
    many = groups.groupBy("family").agg(F.count("*").alias("m"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("m > 1 and lo <> hi")
    chunks = F.ceil(F.col("m") / CHUNK).cast("int").alias("chunks")
    wanted = groups.join(many, "family").select(F.col("doc_id").alias("__id"), F.col("th").alias("__th"), "family", "cls", "root", chunks)
    own = docs.select("doc_id", "text", F.xxhash64("text").alias("th"))
    texts = own.join(wanted, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("th") == F.col("__th"))).select("family", "cls", "root", "chunks", "text")

    def sets(batches):
        seen = set()
        for batch in batches:
            for part, arr in K.slices(batch):
                s, doc = shingle_sets(arr)
                end, rows = np.cumsum(np.bincount(doc, minlength=len(arr))), []
                family, cls, root, chunks = (part.column(k).to_pylist() for k in range(4))
                chunk = (K.mix(np.array(cls, np.int64).view(_U)) % np.array(chunks, _U)).astype(np.int64).tolist()
                for i, (f, c) in enumerate(zip(family, cls)):
                    if c in seen:  # repeated rows
                        continue
                    seen.add(c)
                    own = s[end[i - 1] if i else 0 : end[i]].tobytes()
                    m = np.zeros(chunks[i], _MEMBER)
                    m["family"], m["cls"], m["root"], m["chunk"], k = f, c, root[i], chunk[i], np.arange(chunks[i])
                    m["p"], m["q"] = np.minimum(k, chunk[i]), np.maximum(k, chunk[i])
                    to = bucket_of(K.mix(K.mix(m["family"].view(_U)) + (m["p"].astype(_U) << _U(32)) + m["q"].astype(_U)), n)
                    rows += [(b, 0, m[k : k + 1].tobytes(), own) for k, b in enumerate(to.tolist())]
                    if len(rows) * (len(own) + 64) > 1 << 22:
                        yield blob_batch(rows)
                        rows = []
                yield blob_batch(rows)

    def decide(batches):
        member, own = [], []
        for _, _, x in by_kind(batches):
            member.append(x[0])
            own.append(np.frombuffer(x[1], _U))
        member, out = joined(member, _MEMBER), []
        order = np.lexsort((member["q"], member["p"], member["family"]))
        block = member[["family", "p", "q"]][order]
        cut = np.flatnonzero(block[1:] != block[:-1]) + 1
        for at in np.split(order, cut) if len(order) else []:
            out += block_links(member[at], [own[i] for i in at.tolist()])
        x = np.array(out, np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1])], names=["a", "b"])

    return materialize(regroup(texts.mapInArrow(sets, BLOB_SCHEMA), n).mapInArrow(decide, "a long, b long"), "near-links")


def class_links(classes: DataFrame, docs: DataFrame) -> DataFrame:
    """Links (a, b) with the components of all pairs of classes of similarity 0.8 or more."""
    n = buckets(docs)
    place = [F.col("low.doc_id").alias("doc_id"), F.col("low.th").alias("th")]
    lsh = simhash.simhash_components(classes.select(F.col("cls").alias("doc_id"), "fp"), RADIUS).select(F.col("doc_id").alias("node"), F.col("component_id").alias("family"))
    groups = classes.join(lsh, F.col("cls") == F.col("node")).select("family", "cls", F.col("cls").alias("root"), *place)
    first = exact_links(groups, docs, n)
    linked = connected_components(first).select("node", "root")
    families = connected_components(forest(classes.select("cls", "size", "prefix", *(f"f{i}" for i in range(WORDS5))), n))
    groups = classes.join(families.select(F.col("node").alias("member"), F.col("root").alias("family")), F.col("cls") == F.col("member"))
    groups = groups.join(linked, F.col("cls") == F.col("node"), "left").select("family", "cls", F.coalesce("root", "cls").alias("root"), *place)
    return first.unionAll(exact_links(groups, docs, n))


def kept_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, th) of the document that stays of each component."""
    own = ["size", "prefix", *(f"f{i}" for i in range(WORDS5))]
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "th")).alias("low")
    classes = materialize(fingerprint_rows(docs).groupBy("cls").agg(*[F.first(c).alias(c) for c in own], F.min("fp").alias("fp"), first), "near-classes")
    cc = connected_components(class_links(classes, docs))
    of = classes.select("cls", "low").join(cc, F.col("cls") == F.col("node"), "left")
    return of.groupBy(F.coalesce("root", "cls").alias("root")).agg(F.min("low").alias("low")).select("low.doc_id", "low.th")


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """One document of each group of near-duplicates, columns unchanged."""
    own, name, back = plain_names(docs)
    i, t = name["doc_id"], name["text"]
    keep = materialize(kept_rows(own.select(F.col(i).alias("doc_id"), F.col(t).alias("text"))).select(F.col("doc_id").alias("__id"), F.col("th").alias("__th")), "near-kept")
    got = own.withColumn("__h", F.xxhash64(t)).join(keep, F.col(i).eqNullSafe(F.col("__id")) & (F.col("__h") == F.col("__th")), "left_semi")
    # repeated rows have one id and text: one of them stays
    order = Window.partitionBy(i, "__h").orderBy(*[F.col(c).cast("string") for c in own.columns if c != t])
    return back(got.withColumn("__n", F.row_number().over(order)).where("__n = 1"))
