"""Near-duplicate documents by min-max hashing: each permutation of the shingles yields its minimum and its maximum.

The pair of values per permutation halves the hash evaluations for a signature of the same length.  Bands of the signature
bring candidates together; links are confirmed on the full sets of shingles.  Nothing forms all pairs of a bucket:

1. Equal word sequences are one class; only its first row goes on.
2. Each bucket's smallest row is its pivot, and every other member is compared with it: pairs in proportion to the rows.
3. Links found so far give components, and each component's member with most links is its hub.  A bucket that still spans
   several components is compared with the hub of the best linked of them.  Buckets around one text thus share one hub, and
   their members are one group around it: again in proportion to the rows.
4. What a member lacks of its hub and adds to it bounds how near it can be to other members.  Only pairs of different
   components that this bound leaves open are compared; equality joins find them, and where too many would meet in one,
   they are compared with a hub of their own first (see _unsettled).  Every pair that shares a bucket is then linked,
   connected or proven apart, and a large group of copies around one text costs no pairs.

A link at similarity 0.8 misses all 32 bands of 5 with probability 3e-6.  Shingles are compared as 64-bit hashes.  The
shingle sets of documents that share a bucket with another are written once, and comparisons read those; intermediate
tables are deleted as soon as later ones replace them.

Edge cases: a text of fewer words than a shingle is one shingle; a null text or one without words has an empty set and is
linked with nothing, not even its like; rows that repeat an id are rows of their own, and of equal ids in one component one
row stays; a very long text is one set, read whole, and costs its own length in one task; an empty table gives an empty
result; other columns are carried along untouched, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop, free_name, ship, table, written
from .graph import components
from .shingles import shingle_sets

BANDS, ROWS = 32, 5
#: Members of a group that are paired over one shingle that they add in common; more of them form a group of their own.
#: Each level of such groups allows EASED times as many, so that levels end.
OFTEN, EASED = 32, 8
_rng = np.random.default_rng(20240229)
_FLIP = _rng.integers(0, 1 << 63, BANDS * ROWS // 2, np.uint64)
_ODD = _rng.integers(0, 1 << 63, BANDS * ROWS // 2, np.uint64) * np.uint64(2) + np.uint64(1)
_BAND = _rng.integers(0, 1 << 63, (BANDS, ROWS), np.uint64) * np.uint64(2) + np.uint64(1)
_DEALT = _rng.permutation(BANDS * ROWS)
_SIGNED = pa.struct([("k1", pa.int64()), ("k2", pa.int64()), ("n", pa.int64()), ("bands", pa.list_(pa.int64()))])


def signatures(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Min-max signatures of sets given end to end; every set holds something."""
    out = np.empty((BANDS * ROWS, len(starts)), np.uint64)
    for k, (flip, odd) in enumerate(zip(_FLIP, _ODD)):
        v = (values ^ flip) * odd
        out[2 * k] = np.minimum.reduceat(v, starts)
        out[2 * k + 1] = np.maximum.reduceat(v, starts)
    return out[_DEALT].T


def band_keys(signature: np.ndarray) -> np.ndarray:
    from .shingles import mix

    by_band = signature.reshape(len(signature), BANDS, ROWS)
    return mix((mix(by_band) * _BAND).sum(axis=2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64))


def signer(words: int):
    """text -> class key, set size and band keys, as an Arrow UDF."""

    @F.arrow_udf("struct<k1: long, k2: long, n: long, bands: array<long>>")
    def signed(texts: pa.Array) -> pa.Array:
        keys, sizes, bands = [np.zeros((0, 2), np.int64)], [np.zeros(0, np.int64)], [np.zeros((0, BANDS), np.int64)]
        for a, b, values, begins, key in shingle_sets(texts, words):
            n = np.diff(begins)
            some = np.flatnonzero(n)
            own = np.zeros((b - a, BANDS), np.int64)
            if len(some):
                own[some] = band_keys(signatures(values, begins[some])).view(np.int64)
            keys.append(key.view(np.int64))
            sizes.append(n)
            bands.append(own)
        key, own = np.concatenate(keys), np.concatenate(bands)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, own.size + 1, BANDS, dtype=np.int32)), pa.array(own.ravel()))
        return pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(key[:, 0])), pa.array(np.ascontiguousarray(key[:, 1])), pa.array(np.concatenate(sizes)), lists], fields=list(_SIGNED))

    return signed


_FOLD = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def shingle_set(text: str | None, words: int) -> frozenset:
    """The set itself, of word tuples."""
    w = (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()
    return frozenset(zip(*(w[k:] for k in range(words)))) if len(w) >= words else frozenset([tuple(w)] if w else [])


def set_of(words: int):
    """text -> its sorted distinct shingle hashes, as an Arrow UDF."""

    @F.arrow_udf("array<long>")
    def hashed(texts: pa.Array) -> pa.Array:
        values, ends = [np.zeros(0, np.int64)], [np.zeros(1, np.int64)]
        for _, _, own, begins, _ in shingle_sets(texts, words):
            values.append(own.view(np.int64))
            ends.append(begins[1:] + ends[-1][-1])
        return pa.ListArray.from_arrays(pa.array(np.concatenate(ends).astype(np.int32)), pa.array(np.concatenate(values)))

    return hashed


def against():
    """Two sets -> the size of their intersection and, if wanted, what the first alone has, as an Arrow UDF.  Neighbours often share a y."""

    @F.arrow_udf("struct<shared: long, added: array<long>>")
    def told(x: pa.Array, y: pa.Array, wanted: pa.Array) -> pa.Array:
        flat, begin = x.flatten().to_numpy(zero_copy_only=False), np.concatenate(([0], np.cumsum(x.value_lengths().to_numpy(zero_copy_only=False)))).astype(np.int64)
        their, at = y.flatten().to_numpy(zero_copy_only=False).view(np.uint64), np.concatenate(([0], np.cumsum(y.value_lengths().to_numpy(zero_copy_only=False)))).astype(np.int64)
        hit, k, n = np.zeros(len(flat), bool), 0, len(x)
        while k < n:
            own, j = their[at[k] : at[k + 1]], k + 1
            while j < n and np.array_equal(own, their[at[j] : at[j + 1]]):
                j += 1
            v = flat[begin[k] : begin[j]].view(np.uint64)
            if len(own):
                hit[begin[k] : begin[j]] = own[np.minimum(np.searchsorted(own, v), len(own) - 1)] == v
            k = j
        upto = np.concatenate(([0], np.cumsum(hit)))
        shared = upto[begin[1:]] - upto[begin[:-1]]
        keep = ~hit & np.repeat(wanted.to_numpy(zero_copy_only=False), np.diff(begin))
        ends = np.concatenate(([0], np.cumsum(keep)))[begin]
        added = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat[keep]))
        return pa.StructArray.from_arrays([pa.array(shared), added], names=["shared", "added"])

    return told


def _compared(pairs: DataFrame, sets: DataFrame, added: bool, name: str) -> DataFrame:
    """pairs: x, y and others.  Adds mx, my, shared: the sizes of the sets and of their intersection; and what x alone has."""
    columns = pairs.columns
    both = pairs.join(sets.select(F.col("id").alias("xi"), F.col("set").alias("xs")), F.col("x") == F.col("xi")).drop("xi")
    both = both.join(sets.select(F.col("id").alias("yi"), F.col("set").alias("ys")), F.col("y") == F.col("yi"))
    told = both.select(*columns, F.size("xs").cast("long").alias("mx"), F.size("ys").cast("long").alias("my"), against()("xs", "ys", F.lit(added)).alias("told"))
    return written(told.select(*columns, "mx", "my", "told.shared", *(["told.added"] if added else [])), name)


def _links(compared: DataFrame, percent: int) -> DataFrame:
    return compared.filter(F.col("shared") * 100 >= (F.col("mx") + F.col("my") - F.col("shared")) * percent).select(F.col("x").alias("a"), F.col("y").alias("b"))


def _unsettled(around: DataFrame, found: DataFrame, percent: int, often: int) -> tuple[DataFrame, DataFrame]:
    """Pairs (x, y) of different components and one group that sizes alone don't keep apart; and the groups to look at next.

    around: group, x, its hub y, mx, my, shared, added.  Around its hub, a member x lacks r of the hub's shingles and adds a
    of its own.  Two members differ in at least a + a' + |r - r'| shingles less twice those that both add, and may differ in
    (1 - t) / (1 + t) of their sizes' sum.  So either they add a shingle in common, which an equality join finds, or the
    sizes satisfy the bound.  Of two members in different components at least one, x, is not linked to the hub; then
    the bound asks the other to be smaller than the hub, by what x differs by beyond what the two may differ by.  That is
    rare unless texts were cut short, and an equality join on bands of these numbers finds it.  A shingle that more than
    `often` members add would pair too many: they form a group of their own around one of them, which has that shingle.
    A hub is no member of its group, so groups of groups grow smaller and end.
    """
    told = around.join(found, F.col("x") == F.col("node"), "left")
    a, r = F.col("mx") - F.col("shared"), F.col("my") - F.col("shared")
    placed = told.select("group", "x", F.coalesce("root", "x").alias("root"), a.alias("a"), r.alias("r"), F.col("mx").alias("size"), F.col("my").alias("whole"), "added")
    mixed = placed.groupBy("group").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.max(F.col("whole") - F.col("size")).alias("cut"), F.max("size").alias("most"))
    mixed = written(mixed.filter("lo <> hi").select(F.col("group").alias("of"), "cut", "most"), "mixed")
    open_ = written(placed.join(mixed, F.col("group") == F.col("of")).drop("of"), "open")
    named = lambda df, k, *more: df.select(*[F.col(c).alias(f"{c}{k}") for c in ("x", "group", "root", "a", "r", "size")], *more)
    may = (F.col("size1") + F.col("size2")) * (100 - percent)
    gap = lambda both: (F.col("a1") + F.col("a2") - 2 * both + F.abs(F.col("r1") - F.col("r2"))) * (100 + percent) <= may
    apart = (F.col("group1") == F.col("group2")) & (F.col("root1") != F.col("root2"))

    # Sizes alone: whole - size of the one, against a + r of the other, which is not linked to the hub.
    width = F.greatest(F.lit(1), F.floor(F.col("whole") / 36))
    least = F.col("a") + F.col("r") - F.floor((F.col("size") + F.col("most")) * F.lit(100 - percent) / (100 + percent))
    lone = open_.filter((F.col("a") + F.col("r")) * (100 + percent) > (F.col("size") + F.col("whole")) * (100 - percent)).withColumn("least", F.greatest(F.lit(1), least)).filter("least <= cut")
    ones = named(open_.filter("whole > size"), 1, F.floor((F.col("whole") - F.col("size")) / width).alias("band1"))
    twos = named(lone, 2, F.explode(F.sequence(F.floor(F.col("least") / width), F.floor(F.col("cut") / width))).alias("band2"))
    by_size = ones.join(twos, apart & (F.col("band1") == F.col("band2")) & gap(0)).select("x1", "x2")

    # A shingle that both add.
    parts = written(open_.select("x", "group", "root", "a", "r", "size", F.explode("added").alias("shingle")), "added")
    nearest = F.min(F.struct((F.col("a") + F.col("r")).alias("far"), "x"))
    counts = parts.groupBy("group", "shingle").agg(F.count(F.lit(1)).alias("n"), nearest.alias("near"), F.min("root").alias("lo"), F.max("root").alias("hi")).filter("n > 1 and lo <> hi")
    counts = written(counts.select(F.col("group").alias("og"), F.col("shingle").alias("os"), "n", F.col("near.x").alias("next")), "often")
    shared = written(parts.join(counts, (F.col("group") == F.col("og")) & (F.col("shingle") == F.col("os"))).drop("og", "os"), "shared")
    drop(parts, counts)
    few, many = shared.filter(F.col("n") <= often), shared.filter(F.col("n") > often)
    close = (F.abs(F.col("a1") - F.col("a2")) + F.abs(F.col("r1") - F.col("r2"))) * (100 + percent) <= may
    both = named(few, 1, F.col("shingle").alias("s1")).join(named(few, 2, F.col("shingle").alias("s2")), apart & (F.col("s1") == F.col("s2")) & (F.col("x1") < F.col("x2")) & close)
    by_shingle = both.groupBy("x1", "x2", "group1", "a1", "a2", "r1", "r2", "size1", "size2").agg(F.count(F.lit(1)).alias("both"))
    # Shingles that many add aren't counted in `both`; a pair that has any is settled in the next groups as well.
    most = many.groupBy(F.col("group").alias("mg"), F.col("x").alias("mx1")).agg(F.count(F.lit(1)).alias("hidden"))
    by_shingle = by_shingle.join(most, (F.col("group1") == F.col("mg")) & (F.col("x1") == F.col("mx1")), "left").filter(gap(F.col("both") + F.coalesce("hidden", F.lit(0)))).select("x1", "x2")
    pairs = written(by_size.union(by_shingle).select(F.greatest("x1", "x2").alias("x"), F.least("x1", "x2").alias("y")).distinct(), "doubtful")
    after = written(many.filter("x <> next").select(F.xxhash64("group", "next").alias("group"), "x", F.col("next").alias("y")).distinct(), "groups")
    drop(mixed, open_, shared)
    return pairs, after


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80) -> tuple[DataFrame, DataFrame]:
    """The documents, as written, with a number for each row in one more column, the last; and per row: row (that number),
    key, n_shingles, component_id, first.

    component_id is the smallest key reachable over links; first marks the one row that stands for its component.
    """
    ship(docs.sparkSession)
    sig = free_name(docs, "signature")
    row = free_name(docs, "row")
    rows = written(docs.withColumn(sig, signer(words)(F.col(text))).withColumn(row, F.monotonically_increasing_id()), "signed")
    signed = rows.select(F.col(row).alias("id"), F.col(key).alias("key"), F.col(text).alias("text"), F.col(f"{sig}.k1").alias("k1"), F.col(f"{sig}.k2").alias("k2"), F.col(f"{sig}.n").alias("n"), F.col(f"{sig}.bands").alias("bands"))
    slim = signed.select("id", "key", "k1", "k2", "n")
    classes = written(slim.filter("n > 0").groupBy("k1", "k2").agg(F.min("id").alias("rep"), F.min("key").alias("low")), "classes")
    banded = written(signed.select("id", "bands").join(classes.select("rep"), F.col("id") == F.col("rep")).select("id", F.explode("bands").alias("band")), "bands")
    pivots = written(banded.groupBy("band").agg(F.min("id").alias("pivot"), F.count(F.lit(1)).alias("members")).filter("members > 1").select(F.col("band").alias("bucket"), "pivot"), "pivots")
    members = written(banded.join(pivots, F.col("band") == F.col("bucket")).select("bucket", "pivot", "id"), "members")
    drop(banded, pivots)
    shared = members.select(F.col("id").alias("met")).distinct()
    sets = written(signed.select("id", "text").join(shared, F.col("id") == F.col("met"), "left_semi").select("id", set_of(words)("text").alias("set")), "sets")

    star = _compared(members.filter("id <> pivot").select(F.col("id").alias("x"), F.col("pivot").alias("y")).distinct(), sets, False, "star")
    linked = written(_links(star, percent), "links")
    found = components(linked)
    # Per node of a component: the hub, which is the member with most links.
    degree = linked.select(F.explode(F.array("a", "b")).alias("v")).groupBy("v").count()
    ranked = written(found.join(degree, F.col("node") == F.col("v")).select("node", "root", "count"), "degrees")
    hubs = written(ranked.groupBy("root").agg(F.max(F.struct("count", -F.col("node"))).alias("top")).select(F.col("root").alias("of"), F.col("top")["count"].alias("degree"), (-F.col("top")["col2"]).alias("hub")), "hubs")
    known = ranked.join(hubs, F.col("root") == F.col("of")).select("node", "root", "degree", "hub")
    placed = written(members.join(known, F.col("id") == F.col("node"), "left").select("bucket", "id", F.coalesce("root", "id").alias("root"), F.coalesce("degree", F.lit(0)).alias("degree"), F.coalesce("hub", "id").alias("hub")), "placed")
    drop(members, ranked, hubs, star)
    open_ = placed.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.max(F.struct("degree", -F.col("hub"))).alias("top")).filter("lo <> hi")
    open_ = written(open_.select(F.col("bucket").alias("of"), (-F.col("top")["col2"]).alias("y")), "buckets")
    groups = placed.select("bucket", "id").join(open_, F.col("bucket") == F.col("of")).filter("id <> y")
    groups = written(groups.select(F.col("y").alias("group"), F.col("id").alias("x"), "y").distinct(), "groups")
    drop(placed, open_)

    tree = lambda found: found.filter("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))
    doubtful, fresh, often = [], [], OFTEN
    while not groups.isEmpty():
        around = _compared(groups, sets, True, "around")
        fresh.append(written(_links(around, percent).distinct(), "links"))
        if len(fresh) == 1:
            before, found = found, components(tree(found).union(fresh[0]))
            drop(before)
        pairs, after = _unsettled(around, found, percent, often)
        drop(around, groups)
        doubtful.append(pairs)
        groups, often = after, often * EASED
    if doubtful:
        last = tree(found)
        for more in fresh[1:]:
            last = last.union(more)
        pairs = doubtful[0]
        for more in doubtful[1:]:
            pairs = pairs.union(more)
        close = _compared(pairs.distinct(), sets, False, "pairs")
        before, found = found, components(last.union(_links(close, percent)))
        drop(before, close, *doubtful, *fresh)
    drop(sets, linked, groups)

    rooted = written(classes.join(found, F.col("rep") == F.col("node"), "left").select("k1", "k2", "low", F.coalesce("root", "rep").alias("root")), "rooted")
    lowest = written(rooted.groupBy(F.col("root").alias("of")).agg(F.min("low").alias("component_id")), "lowest")
    named = rooted.join(lowest, F.col("root") == F.col("of")).select(F.col("k1").alias("c1"), F.col("k2").alias("c2"), "root", "component_id")
    result = slim.join(named, (F.col("k1") == F.col("c1")) & (F.col("k2") == F.col("c2")) & (F.col("n") > 0), "left")
    result = written(result.select(F.col("id").alias("row"), "key", F.col("n").alias("n_shingles"), "root", F.when(F.col("root").isNull(), F.col("key")).otherwise(F.col("component_id")).alias("component_id")), "components")
    leader = written(result.filter("root is not null and key <=> component_id").groupBy(F.col("root").alias("led")).agg(F.min("row").alias("leader")), "leaders")
    drop(classes, found, rooted, lowest)
    first = F.col("root").isNull() | (F.col("row") == F.col("leader"))
    return rows.drop(sig), result.join(leader, F.col("root") == F.col("led"), "left").select("row", "key", "n_shingles", "component_id", first.alias("first"))


def deduplicated(docs: DataFrame, **options) -> DataFrame:
    """The documents without their near-duplicates: one row of each component stays, with all its columns."""
    rows, found = near_duplicates(docs, **options)
    stay = found.filter("first").select(F.col("row").alias("stays"))
    *columns, row = rows.columns
    kept = rows.select(F.struct(*columns).alias("doc"), F.col(row).alias("at"))
    return kept.join(stay, F.col("at") == F.col("stays"), "left_semi").select("doc.*")


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, found = near_duplicates(table(spark, sf_dir, "documents"), words=2, percent=80)
    return found.select(F.col("key").alias("doc_id"), "n_shingles", "component_id", F.col("key").eqNullSafe(F.col("component_id")).alias("kept"))
