"""Token-ID output as one wavelet matrix per shard.

A shard holds the ids of consecutive documents.  Its file has one bit-plane per bit of the largest id, from the top bit
down; each plane keeps the order that a stable partition by the planes above gave it.  Planes are stored in blocks that are
compressed one by one, beside the number of ones before each block, so token access, counting (rank) and occurrence lookup
(select) read a block per plane.  Whole shards are decoded by undoing the partitions from the last plane up.

Edge cases: a null text is an empty text (its only id is the end id); a document longer than a shard fills one of its own;
rows that repeat a doc_id stand next to each other in any order; null ids come last; an empty table gives no shard and no row.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import files
from .common import scratch, table, written

BLOCK_BITS = 1 << 17
#: Tokens after which a shard is closed: what a task holds at once.
SHARD_TOKENS = 1 << 20
#: Shards that a task reads, one after another.
SHARDS_A_TASK = 4
CACHE_CHUNKS = 1_000_000
#: Bytes of text that are cut and encoded at once.
SLICE_BYTES = 12 << 20
END_ID = 0
_HEAD = struct.Struct("<4sQIII")


def encode_shard(ids: np.ndarray, doc_ids: list, ends: np.ndarray) -> bytes:
    """The file: head, document ids and ends, zeros per plane, then per plane its blocks' ones and sizes, then the blocks."""
    n = len(ids)
    levels = max(1, int(ids.max()).bit_length()) if n else 1
    a = ids.astype(np.uint16 if levels <= 16 else np.uint32)
    pack = zstandard.ZstdCompressor(level=1)
    zeros, planes = [], []
    for level in range(levels):
        ones = (a >> np.array(levels - 1 - level, a.dtype) & np.array(1, a.dtype)).astype(bool)
        bits = np.packbits(ones)
        if level < levels - 1:
            a = np.concatenate((a.compress(~ones), a.compress(ones)))  # twice as fast as a boolean index or more
        parts = [bits[i : i + BLOCK_BITS // 8] for i in range(0, max(1, len(bits)), BLOCK_BITS // 8)]
        counts = np.cumsum([0, *(int(np.bitwise_count(p).sum()) for p in parts)]).astype(np.uint64)
        zeros.append(n - int(counts[-1]))
        planes.append((counts[:-1], [pack.compress(p.tobytes()) for p in parts]))
    known = np.array([x is not None for x in doc_ids], np.uint8)
    names = np.array([x or 0 for x in doc_ids], np.int64)
    table_ = zstandard.ZstdCompressor(level=3).compress(known.tobytes() + names.tobytes() + ends.astype(np.uint64).tobytes())
    out = [_HEAD.pack(b"WMX1", n, levels, len(doc_ids), len(table_)), table_, np.array(zeros, np.uint64).tobytes()]
    for counts, blocks in planes:
        out += [counts.tobytes(), np.array([len(b) for b in blocks], np.uint32).tobytes()]
    return b"".join(out + [b for _, blocks in planes for b in blocks])


class WaveletMatrix:
    """A shard's file.  Blocks are decompressed when they are needed; the last few of each plane stay."""

    def __init__(self, data: bytes):
        magic, self.n, self.levels, self.n_docs, size = _HEAD.unpack_from(data)
        if magic != b"WMX1":
            raise ValueError("not a wavelet-matrix shard")
        at = _HEAD.size
        docs = zstandard.ZstdDecompressor().decompress(data[at : at + size], max_output_size=max(1, self.n_docs * 17))
        known = np.frombuffer(docs, np.uint8, self.n_docs)
        names = np.frombuffer(docs, np.int64, self.n_docs, self.n_docs)
        self.doc_ids = [int(x) if k else None for k, x in zip(known, names)]
        self.ends = np.frombuffer(docs, np.uint64, self.n_docs, self.n_docs * 9).astype(np.int64)
        at += size
        self.zeros = np.frombuffer(data, np.uint64, self.levels, at).astype(np.int64)
        at += 8 * self.levels
        blocks = max(1, -(-((self.n + 7) // 8) // (BLOCK_BITS // 8)))
        self.ones, sizes = [], []
        for _ in range(self.levels):
            self.ones.append(np.frombuffer(data, np.uint64, blocks, at).astype(np.int64))
            sizes.append(np.frombuffer(data, np.uint32, blocks, at + 8 * blocks).astype(np.int64))
            at += 12 * blocks
        starts = at + np.concatenate(([0], np.cumsum(np.concatenate(sizes))))
        self.where = [(starts[k * blocks : (k + 1) * blocks], sizes[k]) for k in range(self.levels)]
        self.data, self.cache = data, {}

    def _block(self, level: int, k: int) -> np.ndarray:
        if (level, k) not in self.cache:
            if len(self.cache) > 8 * self.levels:
                self.cache.clear()
            start, size = int(self.where[level][0][k]), int(self.where[level][1][k])
            raw = zstandard.ZstdDecompressor().decompress(self.data[start : start + size], max_output_size=BLOCK_BITS // 8)
            self.cache[level, k] = np.unpackbits(np.frombuffer(raw, np.uint8))
        return self.cache[level, k]

    def _rank1(self, level: int, i: int) -> int:
        """Ones before position i of a plane."""
        k = min(i // BLOCK_BITS, len(self.ones[level]) - 1)
        return int(self.ones[level][k]) + int(self._block(level, k)[: i - k * BLOCK_BITS].sum())

    def access(self, i: int) -> int:
        """The id at position i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        out = 0
        for level in range(self.levels):
            bit = int(self._block(level, i // BLOCK_BITS)[i % BLOCK_BITS])
            ones = self._rank1(level, i)
            i = int(self.zeros[level]) + ones if bit else i - ones
            out = out << 1 | bit
        return out

    def _range(self, token: int, lo: int, hi: int) -> tuple[int, int]:
        for level in range(self.levels):
            a, b = self._rank1(level, lo), self._rank1(level, hi)
            lo, hi = (int(self.zeros[level]) + a, int(self.zeros[level]) + b) if token >> (self.levels - 1 - level) & 1 else (lo - a, hi - b)
        return lo, hi

    def count(self, token: int, lo: int = 0, hi: int | None = None) -> int:
        """How often the id stands in positions lo .. hi - 1."""
        if token < 0 or token.bit_length() > self.levels:
            return 0
        a, b = self._range(token, lo, self.n if hi is None else hi)
        return b - a

    def _select(self, level: int, bit: int, k: int) -> int:
        """Position of the k-th (from 0) such bit of a plane."""
        before = self.ones[level] if bit else np.arange(len(self.ones[level])) * BLOCK_BITS - self.ones[level]
        b = int(np.searchsorted(before, k, "right")) - 1
        return b * BLOCK_BITS + int(np.flatnonzero(self._block(level, b) == bit)[k - int(before[b])])

    def occurrence(self, token: int, k: int) -> int:
        """Position of the id's k-th occurrence, from 0."""
        if not 0 <= k < self.count(token):
            raise IndexError(k)
        i = self._range(token, 0, self.n)[0] + k
        for level in reversed(range(self.levels)):
            bit = token >> (self.levels - 1 - level) & 1
            i = self._select(level, bit, i - int(self.zeros[level]) if bit else i)
        return i

    def decode(self) -> np.ndarray:
        """All ids in order."""
        kind = np.uint16 if self.levels <= 16 else np.uint32
        a = np.zeros(self.n, kind)
        unpack = zstandard.ZstdDecompressor()
        for level in reversed(range(self.levels)):
            raw = b"".join(unpack.decompress(self.data[s : s + z], max_output_size=BLOCK_BITS // 8) for s, z in zip(*self.where[level]))
            ones = np.unpackbits(np.frombuffer(raw, np.uint8), count=self.n).view(bool)
            up, z = np.empty(self.n, kind), int(self.zeros[level])
            up[np.flatnonzero(~ones)] = a[:z]
            up[np.flatnonzero(ones)] = a[z:] | kind(1 << (self.levels - 1 - level))
            a = up
        return a.astype(np.uint32)


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes after which a white-space byte surely starts a piece: any ASCII character that no definition calls white space.
_SOLID = np.zeros(256, bool)
_SOLID[0x21:0x7F] = True
_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
_STOP = np.zeros(256, bool)
_STOP[[0x2C, 0x2E]] = True
#: First bytes of two-byte characters none of which is white space.
_LEAD = np.zeros(256, bool)
_LEAD[0xC3:0xE0] = True
_encoders: dict[str, Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]] = {}


def cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where chunks begin in texts given end to end: at texts' starts and where the byte-level pre-tokenizer surely starts a
    new piece, so that a text's pieces are those of its chunks.

    That is before white space that follows anything else, and between an ASCII letter or digit and a comma or full stop.
    """
    first = np.zeros(len(data) + 1, bool)
    if len(data) > 1:
        solid = _SOLID[data]
        solid[1:] |= (data[1:] >= 0x80) & _LEAD[data[:-1]]
        first[1:-1] = _SPACE[data[1:]] & solid[:-1] | _STOP[data[1:]] & _ALNUM[data[:-1]]
    first[offsets] = True
    first[-1] = False
    return np.flatnonzero(first)


def encoder(path: str) -> Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]:
    """texts -> their ids end to end, and how many each text has.

    Texts are cut into chunks without a Python object per chunk, Arrow finds the distinct ones, the library encodes each of
    those once, and ids are gathered by number.  Texts that hold one of the tokenizer's added tokens go to the library whole.
    """
    if path not in _encoders:
        from tokenizers import Tokenizer

        own = Tokenizer.from_file(path)
        batch = getattr(own, "encode_batch_fast", own.encode_batch)
        vocabulary = own.get_vocab()
        #: Bytes that each id stands for: the byte-level alphabet has one character a byte.
        width = np.ones(max(vocabulary.values()) + 1, np.int64)
        for token, k in vocabulary.items():
            width[k] = len(token)
        added = [t.content.encode() for t in own.get_added_tokens_decoder().values()]
        #: Number of each known chunk; its ids stand in `store` from begin[number] on.
        known: dict[bytes, int] = {}
        store, begin, count, used = np.zeros(1 << 20, np.uint32), np.zeros(1 << 17, np.int64), np.zeros(1 << 17, np.int64), 0

        def library(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
            found = [e.ids for e in batch(texts, add_special_tokens=False)]
            return np.fromiter((x for f in found for x in f), np.uint32), np.array([len(f) for f in found], np.int64)

        def together(chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
            """Chunks that start a piece and end one, encoded as one text, which is then cut where their bytes end."""
            found = np.array(batch([b"".join(chunks).decode()], add_special_tokens=False)[0].ids, np.uint32)
            upto, stops = np.cumsum(width[found]), np.cumsum([len(c) for c in chunks])
            cut = np.searchsorted(upto, stops) + 1
            if not len(found) or cut[-1] != len(found) or (upto[cut - 1] != stops).any():
                return library([c.decode() for c in chunks])
            return found, np.diff(cut, prepend=0)

        def learn(wanted: list[bytes]) -> None:
            nonlocal store, begin, count, used
            white = b" \t\n\x0b\x0c\r"
            heads, tails = [c[0] if c else 0 for c in wanted], [c[-2:] for c in wanted]
            plain = [h in white and (0x21 <= t[-1] <= 0x7E or t[-1] >= 0x80 and len(t) > 1 and 0xC3 <= t[0] <= 0xDF) for h, t in zip(heads, tails)]
            for kind in (True, False):
                own_ = [c for c, p in zip(wanted, plain) if p == kind]
                for k in range(0, len(own_), 20_000):
                    part = own_[k : k + 20_000]
                    ids, n = together(part) if kind else library([c.decode() for c in part])
                    while used + len(ids) > len(store):
                        store = np.concatenate((store, np.zeros_like(store)))
                    at = len(known)
                    while at + len(part) > len(begin):
                        begin, count = np.concatenate((begin, np.zeros_like(begin))), np.concatenate((count, np.zeros_like(count)))
                    store[used : used + len(ids)] = ids
                    begin[at : at + len(part)] = used + np.cumsum(n) - n
                    count[at : at + len(part)] = n
                    used += len(ids)
                    known.update(zip(part, range(at, at + len(part))))

        def chunked(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
            nonlocal used
            if len(known) > CACHE_CHUNKS:  # those met first stay, among them the common ones
                keep = dict(islice(known.items(), CACHE_CHUNKS // 2))
                known.clear()
                known.update(keep)
                used = int(begin[len(keep)])
            offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
            data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
            offsets = offsets - offsets[0]
            starts = cuts(data, offsets[:-1][offsets[:-1] < len(data)])
            edges = np.append(starts, len(data)).astype(np.int64)
            chunks = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(edges), pa.py_buffer(np.ascontiguousarray(data))])
            coded = chunks.dictionary_encode()
            names = coded.dictionary.to_pylist()
            number = list(map(known.get, names))
            if None in number:
                learn([c for c, k in zip(names, number) if k is None])
                number = list(map(known.__getitem__, names))
            which = np.array(number, np.int64)[coded.indices.to_numpy()]
            n = count[which]
            upto = np.cumsum(n)
            total = int(upto[-1]) if len(upto) else 0
            ids = store[np.repeat(begin[which] - upto + n, n) + np.arange(total)]
            upto = np.concatenate(([0], upto))
            at = upto[np.searchsorted(starts, offsets)]
            return ids, np.diff(at)

        def run(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
            texts = pc.fill_null(texts, "").cast(pa.large_string())
            odd = np.zeros(len(texts), bool)
            for token in added:
                odd |= pc.match_substring(texts.cast(pa.large_binary()), token).to_numpy(zero_copy_only=False)
            if not odd.any():
                return chunked(texts)
            parts, lengths, at = [], np.zeros(len(texts), np.int64), 0
            while at < len(texts):
                to = at + 1
                while to < len(texts) and odd[to] == odd[at]:
                    to += 1
                ids, lengths[at:to] = library(texts.slice(at, to - at).to_pylist()) if odd[at] else chunked(texts.slice(at, to - at))
                parts.append(ids)
                at = to
            return np.concatenate(parts), lengths

        _encoders[path] = run
    return _encoders[path]


def _texts(batch: pa.RecordBatch, most: int = SLICE_BYTES) -> Iterator[tuple[list, pa.Array]]:
    """Slices of a batch of about so many bytes; a longer text is a slice of its own."""
    texts = batch.column(1).cast(pa.large_string())
    at, n = 0, len(texts)
    upto = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    while at < n:
        to = min(n, max(at + 1, int(np.searchsorted(upto, upto[at] + most, "right")) - 1))
        yield batch.column(0).slice(at, to - at).to_pylist(), texts.slice(at, to - at)
        at = to


def write_shards(docs: DataFrame, to: str, tokenizer: str, key: str = "doc_id", text: str = "text", end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Encode all documents in ascending order of their ids and write shards.  Returns the manifest:
    path, n_docs, n_tokens and start, the number of ids in all shards before it."""
    keyed = docs.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    tie = F.xxhash64("text")
    placed = keyed.repartitionByRange(F.col("key").asc_nulls_last(), tie).sortWithinPartitions(F.col("key").asc_nulls_last(), tie).select("key", "text")

    def write(batches):
        from pyspark import TaskContext

        task, seq, encode = TaskContext.get().partitionId(), 0, encoder(tokenizer)
        names, parts, ends, n = [], [], [], 0

        def close():
            path = files.put(f"{to}/shard-{task:07d}-{seq:05d}", encode_shard(np.concatenate(parts), names, np.concatenate(ends)))
            return pa.RecordBatch.from_pydict({"task": [task], "seq": [seq], "path": [path], "n_docs": [len(names)], "n_tokens": [n]}, schema=_MANIFEST)

        for batch in batches:
            for keys, texts in _texts(batch):
                found, lengths = encode(texts)
                upto = np.cumsum(lengths)
                ids = np.insert(found, upto, end_id)  # the end id after each document
                upto += np.arange(1, len(upto) + 1)
                at = 0
                while at < len(keys):  # a shard is closed behind the document that fills it
                    before = int(upto[at - 1]) if at else 0
                    to_ = min(len(keys), int(np.searchsorted(upto, before + shard_tokens - n)) + 1)
                    names += keys[at:to_]
                    parts.append(ids[before : int(upto[to_ - 1])])
                    ends.append(upto[at:to_] - before + n)
                    n += len(parts[-1])
                    at = to_
                    if n >= shard_tokens:
                        yield close()
                        names, parts, ends, n, seq = [], [], [], 0, seq + 1
        if names:
            yield close()

    made = written(placed.mapInArrow(write, "task int, seq int, path string, n_docs long, n_tokens long"), "shards")
    tasks = made.groupBy("task").agg(F.sum("n_tokens").alias("n"))
    upto = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    tasks = tasks.select(F.col("task").alias("of"), upto("n", Window.orderBy("task")).alias("base"))
    inner = made.withColumn("inner", upto("n_tokens", Window.partitionBy("task").orderBy("seq")))
    return inner.join(tasks, F.col("of") == F.col("task")).select("path", "n_docs", "n_tokens", (F.col("base") + F.col("inner")).alias("start"))


_MANIFEST = pa.schema([("task", pa.int32()), ("seq", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())])
_READ = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()), ("ids_crc32", pa.int64())])


def read_shards(manifest: DataFrame, ids: bool = True) -> DataFrame:
    """Decode shards: doc_id, start, n_tokens, ids (little-endian unsigned 32-bit; null if not asked for), ids_crc32."""

    def read(batches):
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                shard = WaveletMatrix(files.get(path))
                raw, ends = memoryview(shard.decode().astype("<u4").tobytes()), shard.ends
                begins = np.concatenate(([0], ends[:-1])).astype(np.int64)
                own = [raw[4 * a : 4 * b] for a, b in zip(begins.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shard.doc_ids, pa.int64()), pa.array(begins + start), pa.array(ends - begins), pa.array([bytes(x) if ids else None for x in own], pa.binary()), pa.array([zlib.crc32(x) for x in own], pa.int64())],
                    schema=_READ,
                )

    several = max(1, min(-(-manifest.count() // SHARDS_A_TASK), 20_000))
    return manifest.select("path", "start").repartition(several).mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary, ids_crc32 long")


def token_file_digests(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Write the documents as shards, read the shards back, and return where each document's ids stand and their crc32."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    manifest = write_shards(docs, scratch(docs.sparkSession, "tokens"), tokenizer)
    return read_shards(manifest, ids=False).drop("ids")


def op7_wavelet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_file_digests(table(spark, sf_dir, "documents"))
