"""Benchmark decontamination over a distributed positional inverted index.

The index is split by document: each shard stores, for every word of its documents, the list of that word's positions in
the shard.  Documents stand one position apart, so no phrase crosses from one to the next, and a shard answers any test
alone: nothing is shuffled, and a frequent word is as long in each shard as the shard allows and no longer.  A phrase
starts from its rarest word's list and intersects it with the others' lists, shifted by their offsets, shortest first.

The tests are written to the shared folder in blocks of bounded size, and every shard goes through the blocks one by one,
so neither driver nor task ever holds all tests.

Edge cases: null or wordless texts have no words, no hits and are not contaminated; an item without words has no window;
items that share an id count once; a null item id is written as an empty string; rows that repeat a doc_id are documents
of their own; a document longer than a shard fills one of its own and is searched whole; other columns are carried along,
whatever their names; empty tables give empty or hitless results.
"""

from __future__ import annotations

import hashlib
import json
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import files
from .common import numbered, scratch, ship, table, written

WINDOW = 13
SHARD_WORDS = 1 << 21
BLOCK_BYTES = 16 << 20
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Runs of ASCII letters and digits, lower-cased, and of anything beyond ASCII."""
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split() if text else []


class _Ids(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def _packed(a: np.ndarray) -> bytes:
    """Bytes of equal weight stand together, so that the empty ones of small numbers compress away."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a.view(np.uint8).reshape(-1, a.itemsize).T).tobytes())


def _unpacked(data: bytes, kind: str, n: int) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(data, max_output_size=max(1, n * np.dtype(kind).itemsize))
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(np.dtype(kind).itemsize, n).T).view(kind).ravel()


def encode_shard(keys: list, counts: list[int], ids: list[np.ndarray], vocabulary: list[bytes]) -> bytes:
    counts_ = np.array(counts, np.int64)
    all_ids = np.concatenate(ids) if ids else np.zeros(0, np.int64)
    at = np.arange(len(all_ids), dtype=np.int64) + np.repeat(np.arange(len(keys), dtype=np.int64), counts_)
    by_word = np.sort(all_ids.astype(np.int64) << 32 | at)
    lengths = np.bincount(all_ids, minlength=len(vocabulary)).astype("<u4")
    at = (by_word & 0xFFFFFFFF).astype(np.int64)
    gaps = np.diff(at, prepend=0)
    heads = np.concatenate(([0], np.cumsum(lengths)[:-1])).astype(np.int64) if len(lengths) else np.zeros(0, np.int64)
    gaps[heads] = at[heads]
    parts = [
        _packed(np.array([k is not None for k in keys], "u1")), _packed(np.array([k or 0 for k in keys], "<i8")), _packed(counts_.astype("<u4")),
        zstandard.ZstdCompressor(level=1).compress(b" ".join(vocabulary)), _packed(lengths), _packed(gaps.astype("<u4")),
    ]
    return struct.pack("<4s9Q", b"PIX1", len(keys), len(vocabulary), len(all_ids), *map(len, parts)) + b"".join(parts)


class Shard:
    """Postings of one shard: the positions of each word, ascending."""

    def __init__(self, data: bytes):
        magic, docs, terms, n, *sizes = struct.unpack_from("<4s9Q", data)
        if magic != b"PIX1":
            raise ValueError("not a postings shard")
        at, parts = struct.calcsize("<4s9Q"), []
        for size in sizes:
            parts.append(data[at : at + size])
            at += size
        known, keys = _unpacked(parts[0], "u1", docs), _unpacked(parts[1], "<i8", docs)
        self.keys = [int(k) if have else None for k, have in zip(keys, known)]
        self.counts = _unpacked(parts[2], "<u4", docs).astype(np.int64)
        vocabulary = zstandard.ZstdDecompressor().decompress(parts[3], max_output_size=1 << 31).split()
        self.ids = dict(zip(vocabulary, range(terms)))
        self.heads = np.concatenate(([0], np.cumsum(_unpacked(parts[4], "<u4", terms), dtype=np.int64)))
        self.gaps = _unpacked(parts[5], "<u4", n)
        #: Where each document begins; one free position stands after each.
        self.begins = np.concatenate(([0], np.cumsum(self.counts + 1)))
        self.lists: dict[bytes, np.ndarray] = {}

    def positions(self, word: bytes) -> np.ndarray:
        if word not in self.lists:
            k = self.ids.get(word)
            self.lists[word] = np.zeros(0, np.int64) if k is None else np.cumsum(self.gaps[self.heads[k] : self.heads[k + 1]], dtype=np.int64)
        return self.lists[word]

    def frequency(self, word: bytes) -> int:
        k = self.ids.get(word)
        return 0 if k is None else int(self.heads[k + 1] - self.heads[k])

    def phrase(self, words: list[bytes]) -> np.ndarray:
        """Positions at which the words follow one another."""
        order = sorted(range(len(words)), key=lambda k: self.frequency(words[k]))
        if not order or not self.frequency(words[order[0]]):
            return np.zeros(0, np.int64)
        found = self.positions(words[order[0]]) - order[0]
        for k in order[1:]:
            own = self.positions(words[k])
            at = np.searchsorted(own, found + k)
            at[at == len(own)] = 0
            found = found[own[at] == found + k]
            if not len(found):
                break
        return found

    def near(self, words: list[bytes], within: int) -> np.ndarray:
        """First positions of stretches of `within` words of one document that hold all the words, in any order."""
        order = sorted(set(words), key=self.frequency)
        if not order or not self.frequency(order[0]):
            return np.zeros(0, np.int64)
        starts = np.unique((self.positions(order[0])[:, None] - np.arange(within)).ravel())
        starts = starts[starts >= 0]
        for w in order:
            own = self.positions(w)
            starts = starts[np.searchsorted(own, starts + within) > np.searchsorted(own, starts)]
        doc = self.doc_of(starts)
        last = np.minimum(starts + within, self.begins[doc + 1] - 1)
        for w in order:  # within one document
            own = self.positions(w)
            keep = np.searchsorted(own, last) > np.searchsorted(own, starts)
            starts, last = starts[keep], last[keep]
        return starts

    def doc_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.begins, at, "right") - 1


def build_index(docs: DataFrame, to: str, key: str = "doc_id", text: str = "text", shard_words: int = SHARD_WORDS) -> DataFrame:
    """Write the shards; returns the manifest: path, n_docs, n_words."""
    ship(docs.sparkSession)

    def write(batches):
        keys, counts, ids, vocabulary, n = [], [], [], _Ids(), 0

        def close():
            path = files.put(f"{to}/postings", encode_shard(keys, counts, ids, list(vocabulary)))
            return pa.RecordBatch.from_pydict({"path": [path], "n_docs": [len(keys)], "n_words": [n]})

        for batch in batches:
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = words_of(t.as_py())
                keys.append(k)
                counts.append(len(words))
                ids.append(np.fromiter(map(vocabulary.__getitem__, words), np.int64, len(words)))
                n += len(words)
                if n >= shard_words or len(keys) >= shard_words:
                    yield close()
                    keys, counts, ids, vocabulary, n = [], [], [], _Ids(), 0
        if keys:
            yield close()

    return written(docs.select(F.col(key).cast("long"), F.col(text)).mapInArrow(write, "path string, n_docs long, n_words long"), "postings")


def write_tests(items: DataFrame, to: str, block_bytes: int = BLOCK_BYTES) -> list[str]:
    """Write the items (id, text) in blocks of about so many bytes; the driver sees them as a stream."""
    paths, block, size = [], [], 0
    for name, text in items.toLocalIterator():
        words = words_of(text)
        if words:
            block.append(["" if name is None else str(name), b" ".join(words).decode("utf-8", "surrogatepass")])
            size += len(block[-1][1]) + 40
        if size >= block_bytes:
            paths.append(files.put(f"{to}/tests", json.dumps(block).encode()))
            block, size = [], 0
    return paths + ([files.put(f"{to}/tests", json.dumps(block).encode())] if block else [])


_blocks: dict[str, list] = {}


def _tests(paths: list[str]) -> Iterator[tuple[str, list[bytes]]]:
    for p in paths:
        if p not in _blocks:
            _blocks.clear()
            _blocks[p] = [(name, text.encode("utf-8", "surrogatepass").split(b" ")) for name, text in json.loads(files.get(p))]
        yield from _blocks[p]


def _by_shard(manifest: DataFrame, run, schema: str) -> DataFrame:
    """run(Shard) -> columns, for each shard of the manifest."""

    def read(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_pydict(run(Shard(files.get(path))))

    return manifest.select("path").repartition(max(1, min(manifest.count(), 20_000))).mapInArrow(read, schema)


def matches(manifest: DataFrame, tests: list[str], window: int = WINDOW, share: int = 20) -> DataFrame:
    """Per document: key, n_words, n_hit (words inside any window that occurs), n_items, items, contaminated."""

    def run(shard: Shard) -> dict:
        edge = np.zeros(int(shard.begins[-1]) + 1, np.int32)
        items: dict[int, set[str]] = {}
        for name, words in _tests(tests):
            size = min(window, len(words))
            for k in range(len(words) - size + 1):
                at = shard.phrase(words[k : k + size])
                if len(at):
                    np.add.at(edge, at, 1)
                    np.add.at(edge, at + size, -1)
                    for d in np.unique(shard.doc_of(at)).tolist():
                        items.setdefault(d, set()).add(name)
        inside = np.concatenate(([0], np.cumsum(np.cumsum(edge)[:-1] > 0)))
        hit = inside[shard.begins[1:]] - inside[shard.begins[:-1]]
        named = [sorted(items.get(d, ())) for d in range(len(shard.keys))]
        return {
            "key": pa.array(shard.keys, pa.int64()), "n_words": pa.array(shard.counts), "n_hit": pa.array(hit.astype(np.int64)),
            "n_items": pa.array([len(x) for x in named], pa.int64()), "items": pa.array(named, pa.list_(pa.string())),
            "contaminated": pa.array((hit > 0) & (share * hit >= shard.counts)),
        }

    return _by_shard(manifest, run, "key long, n_words long, n_hit long, n_items long, items array<string>, contaminated boolean")


def find(manifest: DataFrame, queries: dict[str, str], within: int | None = None) -> DataFrame:
    """Where named queries occur: key, query, position (words from the document's start).

    Exact phrases, or with `within` stretches of so many words that hold all words of the query.
    """
    asked = {name: words_of(text) for name, text in queries.items()}

    def run(shard: Shard) -> dict:
        keys, names, places = [], [], []
        for name, words in asked.items():
            at = shard.near(words, within) if within else shard.phrase(words)
            doc = shard.doc_of(at)
            keys += [shard.keys[d] for d in doc.tolist()]
            names += [name] * len(at)
            places += (at - shard.begins[doc]).tolist()
        return {"key": pa.array(keys, pa.int64()), "query": pa.array(names, pa.string()), "position": pa.array(places, pa.int64())}

    return _by_shard(manifest, run, "key long, query string, position long")


def contamination(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", **options) -> DataFrame:
    to = scratch(docs.sparkSession, "postings")
    return matches(build_index(docs, to, key, text), write_tests(items.select(item, text), to), **options)


def decontaminated(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """The documents without those that hold a whole window of an item, however long they are themselves, or of whose words
    a twentieth is inside shorter items; with all their columns."""
    rows = numbered(docs, "decontaminate")
    found = contamination(rows.select("at", F.col(f"doc.{text}").alias("text")), items, key="at", window=window)
    bad = found.filter(F.col("contaminated") | (F.col("n_hit") >= window)).select(F.col("key").alias("bad"))
    return rows.join(bad, F.col("at") == F.col("bad"), "left_anti").select("doc.*")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("key").alias("doc_id"), "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")
