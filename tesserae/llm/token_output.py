"""Token ids as compressed binary shards, and the way back.

Documents are range-partitioned and sorted by id, tokenized, closed with an end
id and cut between documents into shards of about SHARD_IDS ids.  A shard is one
file: a header with its place, an index of (document id, number of ids), the
context-mixing coder's independently reset, checksummed blocks, and a line break
as the end mark.  Spark's text sink writes the bytes, one shard to a file, so that
the commit protocol, retries and any store that Spark reaches work as for any
table; Spark's binary source reads them back.  File names sort in document order.

Tokenizing is by distinct chunk.  A byte-level tokenizer never joins what stands
before and after a space that is followed by a visible character, or a line
break between visible characters; texts are cut there, each distinct chunk of
a run of texts is encoded once, and its ids are copied to all its places.  Chunks
are found by a hash and compared byte by byte.  Where the library would split
texts by the byte-level pattern, a space with letters is one piece to it and a few
signs after them the next; so these words go straight to the library's model,
without the split, and the letters of a word with signs are not asked again.

Nulls and odd cases: a null or empty text has only the end id; a null document
id sorts first and is carried as null; rows of one id follow each other in the
order of their texts' hashes; repeated rows are written each; a text of any
length stays in one shard.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import context_coder
from . import textkit as K
from .common import bound_batches, materialize, new_path, partitions

END_ID = 2
SHARD_IDS = 1 << 23
RUN_BYTES = 2 << 20
CACHE = 3 << 19
_HEAD = struct.Struct(">4siiqqqqI")  # magic, part, shard of the part, ids of the part before it, documents, ids, bytes of the index, its CRC-32
_MAGIC = b"TSH2"
_U = np.uint64
_SPACE, _BREAK = 0x20, 0x0A
_LEAD_OK = np.zeros(256, bool)  # first bytes of characters that are surely not white space
_LEAD_OK[0x21:0x7F] = True
_LEAD_OK[0xC3:0xE1] = True
_LEAD_OK[0xE4:0xF5] = True
_LETTER, _SIGN, _SIGNS = 1, 2, 4
_KIND = np.zeros(256, np.uint8)  # by byte; what leads two bytes here leads letters only, but for the signs of _TIMES
_KIND[0x21:0x7F] = _SIGN
_KIND[0x30:0x3A] = 0
_KIND[[*b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", *range(0x80, 0xC0), *range(0xC3, 0xC8), 0xD0, 0xD1]] = _LETTER
_TIMES = (0xC3, 0x97, 0xB7)
_PRINTED = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_CHARS = np.zeros(256, "<u4")  # the character that stands for a byte in a byte-level vocabulary
_CHARS[_PRINTED] = _PRINTED
_CHARS[_CHARS == 0] = 0x100 + np.arange(256 - len(_PRINTED))
_MARK = chr(_CHARS[_SPACE])


class _Buffer:
    """An array that grows at its end; eight bytes beyond it can be read."""

    def __init__(self, dtype, first: tuple = ()):
        self.all, self.n = np.zeros(1 << 12, dtype), 0
        self.add(np.array(first, dtype))

    def __len__(self) -> int:
        return self.n

    @property
    def own(self) -> np.ndarray:
        return self.all[: self.n]

    def add(self, x: np.ndarray) -> None:
        end = self.n + len(x)
        if end + 8 > len(self.all):
            more = np.zeros(max(end + 8, len(self.all) * 3 // 2), self.all.dtype)
            more[: self.n] = self.own
            self.all = more
        self.all[self.n : end] = x
        self.n = end


def _spread(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The positions start, start + 1, ... of n items each, one after another."""
    stop = np.cumsum(n)
    at = np.repeat(start - stop + n, n)
    at += np.arange(len(at))
    return at


def _eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each byte on; zeros follow the last one."""
    return np.ndarray(len(data), "<u8", buffer=np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))


class ChunkTokenizer:
    """Encodes runs of texts, each distinct chunk once; keeps the ids of chunks it has seen."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tok = Tokenizer.from_file(path)
        self.vocab = self.tok.get_vocab_size()
        at = lambda s: self.tok.encode(s, add_special_tokens=False).ids
        self.line = at("\nx")[0]
        vocab = self.tok.get_vocab()
        mark = self.tok.id_to_token(at(" x")[0])[0]
        self.opens = np.zeros(self.vocab, bool)
        self.opens[[i for t, i in vocab.items() if t.startswith(mark)]] = True
        split, self.tokenize = self.tok.pre_tokenizer, self.tok.model.tokenize
        # whether words are split by the byte-level pattern alone, and no added token can lie in one
        self.plain = type(split) is ByteLevel and split.use_regex and not split.add_prefix_space and self.tok.normalizer is None
        self.plain &= self.tok.truncation is None and self.tok.padding is None
        self.plain &= all(re.search(r"[!-/:-@\[-`{-~][A-Za-z]", t.content) for t in self.tok.get_added_tokens_decoder().values())
        self._forget()

    def _batch(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _joined(self, data: np.ndarray, a: np.ndarray, b: np.ndarray, breaks: bool) -> tuple[np.ndarray, np.ndarray] | None:
        """(ids, ids in each chunk) of simple chunks data[a:b] that all begin with a space, or all with a line break."""
        if not len(a):
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        n = b - a
        stop = np.cumsum(n)
        flat = data[_spread(a, n)]
        cut = np.concatenate([[0], stop[4095::4096], stop[-1:]])
        groups = [flat[x:y].tobytes().decode() for x, y in zip(cut[:-1], cut[1:]) if y > x]
        ids = np.concatenate([np.array(x, np.int32) for x in self._batch(groups)])
        first = np.flatnonzero(ids == self.line if breaks else self.opens[ids])
        if len(first) != len(a) or first[0]:
            return None
        return ids, np.diff(np.concatenate([first, [len(ids)]]))

    def _words(self, data: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(which, ids, ids in each) of the chunks data[a:b] that are a space, letters and at most _SIGNS signs."""
        kind = _KIND[data]
        lead, x, y = _TIMES
        kind[np.flatnonzero((data[:-1] == lead) & ((data[1:] == x) | (data[1:] == y)))] = 0
        seen = np.concatenate([[0], np.cumsum(kind == _LETTER)])
        letters = seen[b] - seen[a]
        sign, rest = kind == _SIGN, b - a - 1 - letters
        ok = (data[a] == _SPACE) & (letters > 0) & (rest >= 0) & (rest <= _SIGNS)
        for k in range(_SIGNS):
            ok &= (rest <= k) | sign[np.maximum(b - 1 - k, 0)]
        own = np.flatnonzero(ok)
        own = own[seen[b[own] - rest[own]] - seen[a[own]] == letters[own]]
        if not len(own):
            return own, np.zeros(0, np.int32), np.zeros(0, np.int64)
        a, b, rest = a[own], b[own], rest[own]
        stem = b - rest
        # the letters of words with signs may be a chunk that is known
        from_, n = np.zeros(len(own), np.int64), np.zeros(len(own), np.int64)
        known = np.zeros(len(own), bool)
        if len(has := np.flatnonzero(rest)):
            got = self.table.find(K.span_hashes(data, a[has], stem[has]))
            has, got = has[got >= 0], got[got >= 0]
            right = np.ones(len(has), bool)
            right[self._other(got, data, a[has], stem[has])] = False
            has, got = has[right], got[right]
            known[has] = True
            from_[has], n[has] = self.ends.own[got], self.ends.own[got + 1] - self.ends.own[got]
        new = np.flatnonzero(~known)
        words = _CHARS[data[_spread(a[new], (stem - a)[new])]].tobytes().decode("utf-32-le").split(_MARK)[1:]
        number = {w: i for i, w in enumerate(dict.fromkeys(words))}
        tokens = [self.tokenize(_MARK + w) for w in number]
        sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
        asked = np.fromiter((t.id for ts in tokens for t in ts), np.int32, int(sizes.sum()))
        which = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
        from_[new], n[new] = (np.cumsum(sizes) - sizes)[which], sizes[which]
        # signs by their bytes
        last = np.zeros(len(own), np.int64)
        for k in range(_SIGNS):
            last += np.where(rest > k, data[np.maximum(b - 1 - k, 0)], 0).astype(np.int64) << (8 * k)
        signs, which = np.unique(last, return_inverse=True)
        tails = self._batch([x.to_bytes(_SIGNS, "big").lstrip(b"\0").decode() for x in signs.tolist()])
        sizes = np.array([len(x) for x in tails], np.int64)
        tail, more = np.array([x for t in tails for x in t], np.int32), sizes[which]
        total = n + more
        at = np.cumsum(total) - total
        ids = np.empty(int(total.sum()), np.int32)
        for part, pool in ((known, self.ids.own), (~known, asked)):
            ids[_spread(at[part], n[part])] = pool[_spread(from_[part], n[part])]
        ids[_spread(at + n, more)] = tail[_spread((np.cumsum(sizes) - sizes)[which], more)]
        return own, ids, total

    def _learn(self, keys: np.ndarray, data: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
        n = b - a
        data = data[_spread(a, n)]
        b = np.cumsum(n)
        a = b - n
        space = np.concatenate([[0], np.cumsum(K.SPACE[data], dtype=np.int64)])
        lead = data[a]
        simple = (n > 1) & (space[b] - space[a] == 1)
        order, parts, sizes = [], [], []
        todo = np.ones(len(a), bool)
        if self.plain:
            own, ids, each = self._words(data, a, b)
            todo[own] = False
            order.append(own)
            parts.append(ids)
            sizes.append(each)
        rest = [np.flatnonzero(todo & ~(simple & ((lead == _SPACE) | (lead == _BREAK))))]
        for byte in (_SPACE, _BREAK):
            own = np.flatnonzero(todo & simple & (lead == byte))
            got = self._joined(data, a[own], b[own], byte == _BREAK)
            if got is None:
                rest.append(own)
                continue
            order.append(own)
            parts.append(got[0])
            sizes.append(got[1])
        own = np.concatenate(rest)
        if len(own):
            each = self._batch([data[x:y].tobytes().decode() for x, y in zip(a[own], b[own])])
            order.append(own)
            parts.append(np.array([x for e in each for x in e], np.int32))
            sizes.append(np.array([len(e) for e in each], np.int64))
        at = np.concatenate(order)
        self.keys.add(keys[at])
        self.heads.add(_eights(data)[a[at]] & K.KEEP[np.minimum(n[at], 8)])
        self.sizes.add(n[at])
        self.starts.add(np.cumsum(n[at]) - n[at] + len(self.raw))
        self.raw.add(data[_spread(a[at], n[at])])
        self.ends.add(np.cumsum(np.concatenate(sizes)) + len(self.ids))
        for ids in parts:
            self.ids.add(ids)
        self.table.extend(self.keys.own)

    def _forget(self) -> None:
        self.keys, self.ids, self.raw = _Buffer(_U), _Buffer(np.int32), _Buffer(np.uint8)
        self.heads, self.sizes, self.starts = _Buffer(_U), _Buffer(np.int64), _Buffer(np.int64)  # of a chunk's bytes: the first eight, their number, where they are
        self.ends = _Buffer(np.int64, (0,))  # of the ids, from the one before the first chunk on
        self.table = K.HashTable(self.keys.own, room=CACHE)

    def _other(self, got: np.ndarray, data: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Chunks data[a:b] whose bytes are not those of the chunk found by their hash; eight bytes at a time."""
        n = b - a
        here, there = _eights(data), np.ndarray(len(self.raw), "<u8", buffer=self.raw.all, strides=(1,))
        same = (here[a] & K.KEEP[np.minimum(n, 8)] == self.heads.own.take(got)) & (n == self.sizes.own.take(got))
        todo = np.flatnonzero(same & (n > 8) & (n <= K.LONG_WORD))
        left, x, y = n[todo] - 8, a[todo] + 8, self.starts.own[got[todo]] + 8
        while len(todo):
            ok = ((here[x] ^ there[y]) & K.KEEP[np.minimum(left, 8)]) == 0
            same[todo[~ok]] = False
            on = np.flatnonzero(ok & (left > 8))
            todo, left, x, y = todo[on], left[on] - 8, x[on] + 8, y[on] + 8
        for i in np.flatnonzero(same & (n > K.LONG_WORD)).tolist():
            at = self.starts.own[got[i]]
            same[i] = np.array_equal(data[a[i] : b[i]], self.raw.all[at : at + n[i]])
        return np.flatnonzero(~same)

    def encode(self, arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, ids of each text), without an end id."""
        data, offs = K.byte_view(arr)
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(len(arr), np.int64)
        cut = np.zeros(len(data) + 1, bool)
        ok = _LEAD_OK[data[1:]]
        visible = (data[:-2] > 0x20) & (data[:-2] < 0x7F)
        cut[:-2] = (data[:-1] == _SPACE) & ok
        cut[1:-2] |= (data[1:-1] == _BREAK) & ok[1:] & visible
        cut[offs] = True
        bounds = np.flatnonzero(cut)
        a, b = bounds[:-1], bounds[1:]
        key = K.span_hashes(data, a, b)
        got = self.table.find(key)
        new = np.flatnonzero(got < 0)
        if len(new):
            k, i = np.unique(key[new], return_index=True)
            if len(self.keys) + len(k) > CACHE and len(self.keys):
                self._forget()
                new = np.arange(len(key))
                k, i = np.unique(key, return_index=True)
            i = new[i]
            self._learn(k, data, a[i], b[i])
            got[new] = self.table.find(key[new])
        starts, ids = self.ends.own[got], self.ids.own
        n = self.ends.own[got + 1] - starts
        if len(own := self._other(got, data, a, b)):  # chunks that share another one's hash
            each = self._batch([data[x:y].tobytes().decode() for x, y in zip(a[own], b[own])])
            n[own] = [len(e) for e in each]
            starts[own] = len(ids) + np.cumsum(n[own]) - n[own]
            ids = np.concatenate([ids, np.array([x for e in each for x in e], np.int32)])
        total = np.concatenate([[0], np.cumsum(n)])
        return ids.take(_spread(starts, n)), np.diff(total[np.searchsorted(a, offs)])


@lru_cache(maxsize=2)
def _tokenizer(path: str) -> ChunkTokenizer:
    return ChunkTokenizer(path)


def pack_shard(place: tuple[int, int, int], doc_ids: list[int | None], sizes: np.ndarray, ids: np.ndarray, vocab: int) -> bytes:
    """Header with the place (part, shard of the part, ids of the part before), index (validity, ids, sizes; deflated), coded blocks, end mark."""
    valid = np.array([d is not None for d in doc_ids], np.uint8)
    index = valid.tobytes() + np.array([d or 0 for d in doc_ids], "<i8").tobytes() + np.asarray(sizes, "<i8").tobytes()
    packed = zlib.compress(index, 6)
    return _HEAD.pack(_MAGIC, *place, len(doc_ids), len(ids), len(packed), zlib.crc32(index)) + packed + context_coder.encode(ids, vocab) + b"\n"


def unpack_shard(data: bytes) -> tuple[tuple[int, int, int], list[int | None], np.ndarray, np.ndarray]:
    """(place, document ids, ids of each, all ids); ValueError on damage."""
    magic, part, seq, start, n, _, size, crc = _HEAD.unpack_from(data)
    if magic != _MAGIC or data[-1:] != b"\n":
        raise ValueError("not a shard, or cut short")
    at = _HEAD.size
    try:
        index = zlib.decompress(data[at : at + size])
    except zlib.error as e:
        raise ValueError("the index is damaged") from e
    if zlib.crc32(index) != crc:
        raise ValueError("the index does not match its checksum")
    valid = np.frombuffer(index, np.uint8, n)
    ids, sizes = np.frombuffer(index, "<i8", n, n), np.frombuffer(index, "<i8", n, 9 * n)
    return (part, seq, start), [int(d) if v else None for d, v in zip(ids, valid)], sizes, context_coder.decode(data[at + size : -1])


def write_shards(docs: DataFrame, tokenizer_path: str, folder: str | None = None, end_id: int = END_ID, shard_ids: int = SHARD_IDS) -> str:
    """Write the shard files to a new folder, in the shared folder unless one is named; returns it.

    Parts and the shards within a part follow ascending document ids.
    """
    spark = docs.sparkSession
    folder = folder or new_path(spark, "shards")
    src = bound_batches(docs).select("doc_id", "text", F.xxhash64("text").alias("h"))
    # ranges of ids and hashes, so that one id of very many rows is no single partition
    src = src.repartitionByRange(partitions(spark), "doc_id", "h").sortWithinPartitions("doc_id", "h").drop("h")

    def run(batches):
        tok, part = _tokenizer(tokenizer_path), TaskContext.get().partitionId()
        names, sizes, ids, held, seq, start = [], [], [], 0, 0, 0

        def shard():
            data = pack_shard((part, seq, start), names, np.concatenate(sizes), np.concatenate(ids), tok.vocab)
            return pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], names=["shard"])

        for batch in batches:
            for own, arr in K.slices(batch, limit=RUN_BYTES):
                flat, n_ids = tok.encode(arr)
                ends = np.cumsum(n_ids)
                names += own.column(0).to_pylist()
                sizes.append(n_ids + 1)
                ids.append(np.insert(flat, ends, end_id))
                held += len(ids[-1])
                if held >= shard_ids:
                    yield shard()
                    start, seq, held = start + held, seq + 1, 0
                    names, sizes, ids = [], [], []
        if names:
            yield shard()

    shards = src.mapInArrow(run, "shard binary").select(F.col("shard").cast("string").alias("value"))
    shards.write.option("maxRecordsPerFile", 1).option("compression", "none").text(folder)
    return folder


def shard_files(spark: SparkSession, folder: str) -> DataFrame:
    """path and content of every shard file."""
    return spark.read.format("binaryFile").load(folder).where(F.col("length") > 1).select("path", "content")


def shard_places(files: DataFrame) -> DataFrame:
    """part, seq, start_in_part, n_docs and n_ids of every shard, from the files' headers."""
    number = lambda at, n: F.conv(F.hex(F.substring("content", at + 1, n)), 16, 10).cast("long")
    return files.select(number(4, 4).alias("part"), number(8, 4).alias("seq"), number(12, 8).alias("start_in_part"), number(20, 8).alias("n_docs"), number(28, 8).alias("n_ids"))


def read_shards(files: DataFrame) -> DataFrame:
    """part, doc_id, start_in_part, n_tokens and ids_crc32 of every document, decoded from the shard files."""

    def run(batches):
        for batch in batches:
            for data in batch.column(0):
                (part, _, start), names, sizes, ids = unpack_shard(data.as_py())
                ends = np.cumsum(sizes)
                raw = ids.astype("<u4")
                crc = [zlib.crc32(raw[e - s : e]) for s, e in zip(sizes.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(names), part, np.int64)), pa.array(names, pa.int64()), pa.array(start + ends - sizes), pa.array(sizes), pa.array(crc, pa.int64()),
                ], names=["part", "doc_id", "start_in_part", "n_tokens", "ids_crc32"])

    return bound_batches(files).select("content").mapInArrow(run, "part long, doc_id long, start_in_part long, n_tokens long, ids_crc32 long")


def token_report(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, as read back from the files."""
    files = shard_files(docs.sparkSession, write_shards(docs, tokenizer_path))
    # one row for each range partition: as many as spark.sql.shuffle.partitions, not as the documents
    parts = shard_places(files).groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offset = materialize(parts.select(F.col("part").alias("__part"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__before")), "shard-offsets")
    own = read_shards(files).join(offset, F.col("part") == F.col("__part"))
    return own.select("doc_id", (F.col("start_in_part") + F.col("__before")).alias("start"), "n_tokens", "ids_crc32")
