"""SimHash near-duplicates by covering locality-sensitive hashing.

A fingerprint has a bit set where over half of its shingle hashes have it.  To
find all fingerprints within radius r, every bit position i gets a nonzero
vector m(i) of r + 1 bits; table v (one for each nonzero vector v) keeps the
bits with <m(i), v> = 1 and hashes the fingerprint under that mask.  Any r
differing bits leave some v with <m(i), v> = 0 for all of them, so the pair
agrees under that mask: every pair within the radius collides in some table.

Equal fingerprints are one class, so only distinct ones enter the tables.  In a
small bucket the members are compared.  A crowded bucket is never paired up:
its members are regrouped, once each, by the 65 words within one bit of them;
two fingerprints are within two bits exactly if they share such a word, a word
has at most 65 of them, and all are linked to each other, so a star keeps the
whole link relation.

Nulls and odd cases: a null or empty text has fingerprint zero, linked like any
other; a text with fewer words than a shingle is one shingle; repeated rows get
the same fingerprint and class; a null id belongs to its class but never names
it unless nothing else does; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkit as K
from .common import bound_batches, materialize
from .components import connected_components

CROWD = 64
SEED = 42
_LOWER = K.LOWER.tobytes()
_CHUNK = 1 << 16


def shingle_hashes(text: str, n: int) -> np.ndarray:
    """XXH64 of each shingle of n lower-cased words, repeats included."""
    words = text.encode().translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    n = min(n, len(words))
    digest, join = xxhash.xxh64_intdigest, b" ".join
    return np.fromiter((digest(join(words[i : i + n]), SEED) for i in range(len(words) - n + 1)), np.uint64, len(words) - n + 1)


def simhash(h: np.ndarray) -> int:
    if not len(h):
        return 0
    ones = np.zeros(64, np.int64)
    for a in range(0, len(h), _CHUNK):
        part = h[a : a + _CHUNK].astype("<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprint_array(texts: pa.Array, n: int) -> np.ndarray:
    """The 64 bits of each text's fingerprint as a signed long."""
    return np.array([simhash(shingle_hashes(t, n)) for t in texts.to_pylist()], np.uint64).view(np.int64)


def fingerprints(docs: DataFrame, n: int, keep: list[str]) -> DataFrame:
    """The columns `keep` and fp, the 64 bits as a signed long."""
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField("fp", T.LongType())])
    src = bound_batches(docs).select(*[F.col(f"`{c}`") for c in keep], F.col("text").alias("__text"))

    def run(batches):
        for batch in batches:
            for part, arr in K.slices(batch, "__text"):
                fp = fingerprint_array(arr, n)
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(keep))), pa.array(fp)], names=[*keep, "fp"])

    return src.mapInArrow(run, schema)


def covering_masks(radius: int) -> list[int]:
    """The 2**(radius + 1) - 1 masks, as signed longs."""
    top = (1 << (radius + 1)) - 1
    member = [i % top + 1 for i in range(64)]
    out = []
    for v in range(1, top + 1):
        m = sum(1 << i for i in range(64) if (member[i] & v).bit_count() % 2)
        out.append(m - (1 << 64) if m >> 63 else m)
    return out


def _bucket_links(batches, radius: int):
    """Of each bucket a spanning forest of its links within the radius."""
    for batch in batches:
        a, b = [], []
        for members in batch.column(0).to_pylist():
            x = np.array(members, np.int64).view(np.uint64)
            near = np.bitwise_count(x[:, None] ^ x[None, :]) <= radius
            parent = list(range(len(x)))

            def find(i):
                while parent[i] != i:
                    parent[i] = parent[parent[i]]
                    i = parent[i]
                return i

            for i, j in zip(*np.nonzero(np.triu(near, 1))):
                p, q = find(i), find(j)
                if p != q:
                    parent[q] = p
                    a.append(members[i])
                    b.append(members[j])
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def fingerprint_links(distinct: DataFrame, radius: int = 2) -> DataFrame:
    """Links (a, b) of distinct fingerprints fp with the same components as all pairs within the radius."""
    if radius > 2:
        raise ValueError("the exact way for crowded buckets covers radius 0 to 2")
    masks = covering_masks(radius)
    keys = distinct.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks])).alias("t", "key"))
    crowd = keys.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1")
    members = materialize(keys.join(crowd, ["t", "key"]), "simhash-buckets")
    few = members.where(F.col("n") <= CROWD).groupBy("t", "key").agg(F.collect_list("fp").alias("fps")).select("fps")
    links = few.mapInArrow(lambda it: _bucket_links(it, radius), "a long, b long")
    flips = [F.lit(0).cast("long")] + [F.shiftleft(F.lit(1).cast("long"), i) for i in range(64)]
    ball = members.where(F.col("n") > CROWD).select("fp").distinct().select("fp", F.explode(F.array(*[F.col("fp").bitwiseXOR(x) for x in flips])).alias("z"))
    if radius == 2:
        star = ball.groupBy("z").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1).select(F.array_min("fps").alias("a"), F.explode("fps").alias("b"))
    else:
        star = ball.join(distinct.select(F.col("fp").alias("z")), "z").select(F.col("fp").alias("a"), F.col("z").alias("b"))
    return links.unionAll(star.where("a <> b"))


def simhash_components(fps: DataFrame, radius: int = 2) -> DataFrame:
    """fps(doc_id, fp, ...) plus component_id."""
    distinct = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("low")), "simhash-classes")
    cc = connected_components(fingerprint_links(distinct, radius))
    rep = distinct.join(cc, F.col("fp") == F.col("node"), "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    name = rep.groupBy("root").agg(F.min("low").alias("component_id"))
    of = rep.join(name, "root").select(F.col("fp").alias("__fp"), "component_id")
    return fps.join(of, F.col("fp") == F.col("__fp")).drop("__fp")


def near_duplicate_report(docs: DataFrame, shingle: int = 3, radius: int = 2) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every document."""
    fps = materialize(fingerprints(docs, shingle, ["doc_id"]), "simhash-fps")
    out = simhash_components(fps, radius)
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
