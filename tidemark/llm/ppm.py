"""Language-model scoring by prediction by partial matching over bytes.

The trie of byte contexts up to ORDER is held as the counts of its deepest level: every byte is counted once with the ORDER
bytes before it, and shorter contexts are sums.  A byte's probability comes from the longest context that has been seen
with it; each longer context first pays its escape (method D: half of its distinct bytes' count), and the bytes it has seen
are excluded below it.  Below the empty context all remaining bytes are alike.  Code lengths add up to the text's score.

Where things are: words and byte strings are counted per shard of documents; only the distinct ones travel, to be summed
over all training documents and to be priced.  Prices go back to the shards that asked for them, as one dictionary file per
shard, and each document is scored beside its shard's dictionary.  So no task or driver ever holds the model, and what a
task holds follows from the size of a shard, which is bounded in rows and bytes.  A context's prices need those contexts that
end in the same two bytes, and two small tables (at most 65,536 and 256 rows) of shorter ones.  However large the corpus, so
many bytes apart there are at most 2 ** 24 codes; in text of a hundred different bytes, a million.

The text that is scored is its words (maximal runs of anything but white space, A-Z lower-cased) with single spaces between,
and an end; it stands for the same tokens as the base score's.  Edge cases: a null or empty text is an end alone; a null id
counts as training (remainder 0); rows that repeat an id are documents of their own; with no training document every byte
costs log10(256) and V and N are 0; a very long text is scored whole beside a dictionary of its own; equal texts get equal
scores; an empty table gives an empty result; other columns play no part, whatever their names.
"""

from __future__ import annotations

import math
import struct
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import files
from .common import crc_mod, scratch, ship, table, written

ORDER = 4
#: A shard, which has one dictionary, is closed at so many documents or bytes of text, or is one longer text.
SHARD_ROWS, SHARD_BYTES = 1 << 13, 1 << 26
_FOLD = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def tokens(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split() if text else []


def coded(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Each byte and each end with the ORDER bytes before it, as one number; and where each text's begin.  A start is zeros."""
    pad = bytes(ORDER)
    data = np.frombuffer(b"".join(x for t in texts for x in (pad, t, b"\0")), np.uint8)
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    code = np.zeros(max(0, len(data) - ORDER), np.int64)
    for k in range(ORDER + 1):
        code = (code << 8) | data[k : len(data) - ORDER + k]
    begins = np.concatenate(([0], np.cumsum(sizes)))
    keep = np.arange(begins[-1], dtype=np.int64) + ORDER * np.repeat(np.arange(len(texts), dtype=np.int64), sizes)
    return code[keep], begins


class _Counts:
    """Distinct numbers with their counts; sorted runs are merged when they outgrow the last merge."""

    def __init__(self):
        self.runs, self.size, self.least = [], 0, 1 << 20

    def add(self, code: np.ndarray, count: bool) -> None:
        if len(code):
            keys, n = np.unique(code, return_counts=True)
            self.runs.append((keys, n.astype(np.int64) if count else np.zeros(len(keys), np.int64)))
            self.size += len(keys)
            if self.size > self.least:
                self.merged()
                self.least = max(1 << 20, 2 * self.size)

    def merged(self) -> tuple[np.ndarray, np.ndarray]:
        if len(self.runs) > 1:
            keys, n = (np.concatenate(x) for x in zip(*self.runs))
            order = np.argsort(keys)
            keys, n = keys[order], n[order]
            first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
            self.runs = [(keys[first], np.add.reduceat(n, first))]
            self.size = len(first)
        return self.runs[0] if self.runs else (np.zeros(0, np.int64), np.zeros(0, np.int64))


_STATS = pa.schema([("shard", pa.int64()), ("word", pa.binary()), ("code", pa.int64()), ("n", pa.int64())])


def _slices(batch: pa.RecordBatch, most: int = 1 << 20):
    """shard, held, texts of rows next to each other, of about so many characters."""
    shards, held = batch.column(0).to_pylist(), batch.column(1).to_pylist()
    own, size, at = [], 0, 0
    for k, t in enumerate(batch.column(2)):
        own.append(t.as_py())
        size += len(own[-1] or "")
        if size >= most or k + 1 == len(shards) or shards[k + 1] != shards[k]:
            yield shards[k], held[at : k + 1], own, at, k + 1
            own, size, at = [], 0, k + 1


def _sharded(batches):
    """Rows -> the same with the number of their shard before them: next to each other, in bounded numbers and bytes."""
    from pyspark import TaskContext

    shard, rows, size = TaskContext.get().partitionId() << 33, 0, 0
    for batch in batches:
        upto = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        out, at = np.empty(batch.num_rows, np.int64), 0
        while at < batch.num_rows:
            before = int(upto[at - 1]) if at else 0
            if rows and (rows >= SHARD_ROWS or size + int(upto[at]) - before > SHARD_BYTES):
                shard, rows, size = shard + 1, 0, 0
            to = min(at + SHARD_ROWS - rows, max(at + 1, int(np.searchsorted(upto, before + SHARD_BYTES - size, "right"))), batch.num_rows)
            out[at:to] = shard
            rows, size, at = rows + to - at, size + int(upto[to - 1]) - before, to
        yield pa.RecordBatch.from_arrays([pa.array(out), *batch.columns], names=["shard", "held", "text", "key"])


def _count(batches):
    """shard, held, text -> each shard's distinct words and codes with their counts in training texts."""
    last, words, codes = None, Counter(), _Counts()

    def close():
        keys, n = codes.merged()
        for a in range(0, len(words), 500_000):
            part = list(words.items())[a : a + 500_000]
            yield pa.RecordBatch.from_arrays([pa.array([last] * len(part), pa.int64()), pa.array([w for w, _ in part], pa.binary()), pa.nulls(len(part), pa.int64()), pa.array([c for _, c in part], pa.int64())], schema=_STATS)
        for a in range(0, len(keys), 500_000):
            k, c = keys[a : a + 500_000], n[a : a + 500_000]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), last)), pa.nulls(len(k), pa.binary()), pa.array(k), pa.array(c)], schema=_STATS)

    for batch in batches:
        for shard, held, texts, _, _ in _slices(batch):
            if shard != last and last is not None:
                yield from close()
                words, codes = Counter(), _Counts()
            last = shard
            split = [tokens(t) for t in texts]
            for h, own in zip(held, split):
                if h:
                    for w in own:
                        if w not in words:
                            words[w] = 0
                else:
                    words.update(own)
            for h in (False, True):
                codes.add(coded([b" ".join(w) for w, x in zip(split, held) if x == h])[0], not h)
    if last is not None:
        yield from close()


def prices(code: np.ndarray, n: np.ndarray, one: np.ndarray, zero: np.ndarray) -> np.ndarray:
    """log10 probabilities of codes whose contexts all end in the same two bytes, given every such code with its count.

    one: counts by last context byte and byte (256 x 256); zero: counts by byte (256).
    """
    order = np.argsort(code)
    back = np.empty_like(order)
    back[order] = np.arange(len(order))
    code, n = code[order], n[order]
    byte = (code & 255).astype(np.int64)
    out = np.zeros(len(code))
    done = np.zeros(len(code), bool)
    # Of the context one longer: whether it was seen, its distinct bytes, and what they count here.
    above_d, excluded = np.zeros(len(code), np.int64), np.zeros(len(code), np.int64)
    levels = []
    for k in range(ORDER, 1, -1):
        short = code & ((1 << (8 * (k + 1))) - 1)
        keys, inverse = np.unique(short, return_inverse=True)
        count = np.bincount(inverse, weights=n, minlength=len(keys)).astype(np.int64)
        contexts, of = np.unique(keys >> 8, return_inverse=True)
        levels.append((keys, inverse, count, of, len(contexts)))
    last = int((code[0] >> 8) & 255) if len(code) else 0
    for k in range(ORDER, -2, -1):
        if k >= 2:
            keys, inverse, count, of, m = levels[ORDER - k]
            own = count[inverse]
            seen = (count > 0).astype(np.int64)
            total, distinct = (np.bincount(of, weights=x, minlength=m).astype(np.int64)[of[inverse]] for x in (count, seen))
            if k > 2:
                low_keys, low_count = levels[ORDER - k + 1][0], levels[ORDER - k + 1][2]
                below = low_count[np.searchsorted(low_keys, keys & ((1 << (8 * k)) - 1))]
            else:
                below = one[last, (keys & 255).astype(np.int64)]
            covers = np.bincount(of, weights=below * seen, minlength=m).astype(np.int64)[of[inverse]]
        elif k == 1:
            own, total, distinct = one[last, byte], np.full(len(code), one[last].sum()), np.full(len(code), np.count_nonzero(one[last]))
            covers = np.full(len(code), zero[one[last] > 0].sum())
        elif k == 0:
            own, total, distinct = zero[byte], np.full(len(code), zero.sum()), np.full(len(code), np.count_nonzero(zero))
            covers = np.full(len(code), np.count_nonzero(zero))
        else:  # every byte that no context has excluded
            out[~done] -= np.log10(256 - above_d[~done])
            break
        room, fresh = total - excluded, distinct - above_d
        some = ~done & (room > 0)
        hit = some & (own > 0)
        out[hit] += np.log10((2 * own[hit] - 1) / (2 * room[hit]))
        miss = some & (own == 0)
        out[miss] += np.log10(fresh[miss] / (2 * room[miss]))
        done |= hit
        seen_here = total > 0
        above_d, excluded = np.where(seen_here, distinct, above_d), np.where(seen_here, covers, 0)
    return out[back]


def _dictionary(path: str, kind: str):
    """Per shard: its words with their counts or its codes with their prices, as one file.  Returns shard, path."""

    def write(t: pa.Table) -> pa.Table:
        shard, pack = t.column("shard")[0].as_py(), zstandard.ZstdCompressor(level=1)
        keys = b" ".join(t.column("key").to_pylist()) if kind == "words" else t.column("key").to_numpy().astype("<i8").tobytes()
        values = t.column("value").to_numpy().astype("<f8").tobytes()
        data = struct.pack("<QQ", len(keys), len(values)) + pack.compress(keys + values)
        return pa.table({"shard": pa.array([shard], pa.int64()), "path": pa.array([files.put(f"{path}/{kind}", data)])})

    return write


def _loaded(uri: str) -> tuple[bytes, np.ndarray]:
    data = files.get(uri)
    a, b = struct.unpack_from("<QQ", data)
    raw = zstandard.ZstdDecompressor().decompress(data[16:], max_output_size=max(1, a + b))
    return raw[:a], np.frombuffer(raw, "<f8", b // 8, a)


class Prices:
    """Codes to prices: a table with open addressing, built and read by whole arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, (4 * len(keys)).bit_length())
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits)
        claim, left, probe = np.full(1 << self.bits, -1, np.int64), np.arange(len(keys)), 0
        while len(left):
            at = self._at(keys[left], probe)
            free = claim[at] < 0
            claim[at[free]] = left[free]
            left, probe = left[claim[at] != left], probe + 1
        taken = claim >= 0
        self.keys[taken], self.values[taken] = keys[claim[taken]], values[claim[taken]]

    def _at(self, code: np.ndarray, probe: int) -> np.ndarray:
        h = (code.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)
        return (h.astype(np.int64) + probe) & ((1 << self.bits) - 1)

    def of(self, code: np.ndarray) -> np.ndarray:
        at = self._at(code, 0)
        out = self.values[at]
        left, probe = np.flatnonzero(self.keys[at] != code), 1
        while len(left):
            at = self._at(code[left], probe)
            good = self.keys[at] == code[left]
            out[left[good]] = self.values[at[good]]
            left, probe = left[~good], probe + 1
            if probe > 1 << self.bits:
                raise KeyError("a code without a price")
        return out


_held: dict[str, object] = {}


def _kept(uri: str, make):
    """The dictionaries of the shard at hand; those of an earlier shard go."""
    if uri not in _held:
        if len(_held) > 1:
            _held.clear()
        _held[uri] = make(*_loaded(uri))
    return _held[uri]


def score(docs: DataFrame, held_out, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Learn from the rows where held_out is false, score all: key, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    ship(spark)
    to = scratch(spark, "ppm")
    rows = docs.select(held_out.alias("held"), F.col(text).alias("text"), F.col(key).alias("key"))
    kind = dict(rows.dtypes)["key"]
    rows = written(rows.mapInArrow(_sharded, f"shard long, held boolean, text string, key {kind}"), "ppm-rows")
    stats = written(rows.select("shard", "held", "text").mapInArrow(_count, "shard long, word binary, code long, n long"), "ppm-counts")
    words, codes = stats.filter("word is not null").select("shard", "word", "n"), stats.filter("code is not null").select("shard", "code", "n")

    counts = written(words.groupBy("word").agg(F.sum("n").alias("c")), "ppm-words").select(F.col("word").alias("w"), "c")
    said = counts.agg(F.sum("c"), F.sum((F.col("c") > 0).cast("long"))).first()
    texts = rows.filter("not held").count()
    tokens_all, distinct = (said[0] or 0) + texts, (said[1] or 0) + (1 if texts else 0)
    by_shard = words.join(counts, F.col("word") == F.col("w")).select("shard", F.col("word").alias("key"), F.col("c").cast("double").alias("value"))
    word_files = written(by_shard.groupBy("shard").applyInArrow(_dictionary(to, "words"), "shard long, path string"), "ppm-word-files")

    totals = written(codes.groupBy("code").agg(F.sum("n").alias("n")), "ppm-codes")
    small = totals.filter("n > 0").groupBy(F.shiftright("code", 8).bitwiseAND(255).alias("c"), F.col("code").bitwiseAND(255).alias("s")).agg(F.sum("n").alias("n")).collect()  # at most 65,536 rows
    one = np.zeros((256, 256), np.int64)
    for r in small:
        one[r["c"], r["s"]] = r["n"]
    zero = one.sum(axis=0)

    def priced(t: pa.Table) -> pa.Table:
        code = t.column("code").to_numpy()
        return pa.table({"c": t.column("code"), "value": pa.array(prices(code, t.column("n").to_numpy(), one, zero), pa.float64())})

    price = written(totals.groupBy(F.shiftright("code", 8).bitwiseAND(65_535)).applyInArrow(priced, "c long, value double"), "ppm-prices")
    by_shard = codes.join(price, F.col("code") == F.col("c")).select("shard", F.col("code").alias("key"), "value")
    code_files = written(by_shard.groupBy("shard").applyInArrow(_dictionary(to, "codes"), "shard long, path string"), "ppm-code-files")

    floor = math.log10(tokens_all + 0.5 * (distinct + 1))
    # The end: a token of every text, counted once per training text.
    end_cost, end_known = math.log10(texts + 0.5), int(texts > 0)

    def run(batches):
        for batch in batches:
            wpaths, cpaths = batch.column(4).to_pylist(), batch.column(5).to_pylist()
            n, known, base, total = [], [], [], []
            for _, _, texts_, a, _ in _slices(batch):
                count = _kept(wpaths[a], lambda k, v: dict(zip(k.split(b" "), v.tolist()))) if wpaths[a] else {}
                price = _kept(cpaths[a], lambda k, v: Prices(np.frombuffer(k, "<i8"), v))
                split = [tokens(t) for t in texts_]
                for own in split:
                    c = np.fromiter(map(count.__getitem__, own), np.float64, len(own))
                    n.append(len(own) + 1)
                    known.append(int(np.count_nonzero(c)) + end_known)
                    base.append(float(np.log10(c + 0.5).sum()) + end_cost - floor * (len(own) + 1))
                code, begins = coded([b" ".join(w) for w in split])
                total.append(np.add.reduceat(price.of(code), begins[:-1]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(3), batch.column(1), pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(np.full(len(n), tokens_all, np.int64)), pa.array(base, pa.float64()), pa.array(np.concatenate(total) if total else [], pa.float64())],
                names=["key", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    placed = rows.join(word_files.select(F.col("shard").alias("ws"), F.col("path").alias("wpath")), F.col("shard") == F.col("ws"), "left")
    placed = placed.join(code_files.select(F.col("shard").alias("cs"), F.col("path").alias("cpath")), F.col("shard") == F.col("cs"), "left")
    return placed.select("shard", "held", "text", "key", "wpath", "cpath").mapInArrow(run, f"key {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


class Adaptive:
    """The same model for one text at a time, learning as it goes: a trie of byte contexts."""

    def __init__(self, order: int = ORDER):
        self.order, self.counts = order, defaultdict(Counter)

    def learn(self, context: bytes, byte: int) -> None:
        for k in range(self.order + 1):
            self.counts[context[len(context) - k :]][byte] += 1

    def cost(self, context: bytes, byte: int) -> float:
        """log10 probability of the byte after the context."""
        out, excluded = 0.0, set()
        for k in range(self.order, -1, -1):
            own = self.counts.get(context[len(context) - k :])
            if not own:
                continue
            left = {s: n for s, n in own.items() if s not in excluded}
            room = sum(left.values())
            if room:
                if byte in left:
                    return out + math.log10((2 * left[byte] - 1) / (2 * room))
                out += math.log10(len(left) / (2 * room))
            excluded |= own.keys()
        return out - math.log10(256 - len(excluded))

    def code_length(self, text: str | None, learn: bool = True) -> float:
        """log10 probability of a whole text and its end."""
        data, out = bytes(self.order) + b" ".join(tokens(text)) + b"\0", 0.0
        for k in range(self.order, len(data)):
            context = data[k - self.order : k]
            out += self.cost(context, data[k])
            if learn:
                self.learn(context, data[k])
        return out


def op4_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, crc_mod(F.col("doc_id"), 5) == 1).withColumnRenamed("key", "doc_id")
