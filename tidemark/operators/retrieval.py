"""Retrieval operators: keyword ranking (BM25), vector ranking (cosine), and their fusion by reciprocal rank.

Ranks are score descending, key ascending.  Statistics of BM25 cover all rows that have any text, also where a filter or a
limit narrows the result.  Nothing is exploded: a query's few terms are counted inside each row, and one aggregate gives the
corpus statistics, which travel as a single row.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import lower

K1, B, RRF_K = 1.2, 0.75, 60
CANDIDATES = 64
_SPLIT = r"[^\p{IsAlphabetic}\p{N}]+"


def candidate_budget(limit: int | None, offset: int = 0) -> int:
    """How many a ranking hands on: four times what is asked for, or 64."""
    return CANDIDATES if limit is None else 4 * (limit + offset)


def tokens(c: Column) -> Column:
    return F.filter(F.split(lower(c), _SPLIT), lambda x: x != "")


def query_terms(query: str) -> list[str]:
    low = query.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return [w for w in regex.split(r"[^\p{Alphabetic}\p{N}]+", low) if w]


def bm25(df: DataFrame, columns: str | Sequence[str], query: str, key: str, k: int | None = None, where: Column | None = None, name: str = "score") -> DataFrame:
    """Rows with at least one query term, with their score; repeated query terms count each time."""
    columns = [columns] if isinstance(columns, str) else list(columns)
    terms = query_terms(query)
    any_text = F.coalesce(*[F.col(c) for c in columns]).isNotNull()
    counted = df.filter(any_text).withColumn("__t", tokens(F.concat_ws(" ", *[F.col(c) for c in columns])))
    unique = sorted(set(terms))
    count = lambda t: F.size(F.filter("__t", lambda x: x == t)).cast("double")
    tf = {t: count(t) for t in unique}
    counted = counted.select(*df.columns, F.size("__t").cast("double").alias("__len"), *[tf[t].alias(f"__tf{i}") for i, t in enumerate(unique)])
    stats = counted.agg(F.count(F.lit(1)).cast("double").alias("__n"), F.avg("__len").alias("__avg"), *[F.count_if(F.col(f"__tf{i}") > 0).cast("double").alias(f"__df{i}") for i in range(len(unique))])
    rows = counted if where is None else counted.filter(where)
    both = rows.crossJoin(F.broadcast(stats))  # one row
    score, hit = F.lit(0.0), F.lit(False)
    for t in terms:
        i = unique.index(t)
        f, d = F.col(f"__tf{i}"), F.col(f"__df{i}")
        idf = F.log(1 + (F.col("__n") - d + 0.5) / (d + 0.5))
        score = score + idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("__len") / F.col("__avg")))
        hit = hit | (f > 0)
    out = both.filter(hit).select(*df.columns, score.alias(name))
    return out if k is None else out.orderBy(F.desc(name), F.asc(key)).limit(k)


def _vector(q: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in q])


def cosine(c: Column | str, q: Sequence[float]) -> Column:
    """Cosine similarity; a zero vector scores 0, one of another length is an error."""
    c = F.col(c) if isinstance(c, str) else c
    dot = F.aggregate(F.zip_with(c, _vector(q), lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
    norm = F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    own = float(np.sqrt(sum(float(x) ** 2 for x in q)))
    fine = F.when(F.size(c) != len(q), F.raise_error(F.lit("vector has another length"))).otherwise(F.lit(own) * norm)
    return F.when(c.isNull(), None).when(fine == 0, 0.0).otherwise(dot / fine)


def normalised(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    norm = F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.transform(c, lambda x: F.when(norm == 0, x.cast("double")).otherwise(x.cast("double") / norm))


def vector_top_k(df: DataFrame, column: str, q: Sequence[float], key: str, k: int | None = None, where: Column | None = None, name: str = "score") -> DataFrame:
    """Exact ranking by cosine similarity; the filter comes first, so rejected rows use no budget."""
    rows = df.filter(F.col(column).isNotNull() if where is None else F.col(column).isNotNull() & where)
    out = rows.withColumn(name, cosine(column, q))
    return out if k is None else out.orderBy(F.desc(name), F.asc(key)).limit(k)


def fuse(key: str, k: int, *rankings: DataFrame, name: str = "score", score: str = "score") -> DataFrame:
    """Reciprocal rank fusion of at least two rankings (key and score), each cut to k, and the result too."""
    if len(rankings) < 2:
        raise ValueError("fuse takes two rankings or more")
    from pyspark.sql import Window

    parts = None
    for r in rankings:
        top = r.select(key, score).orderBy(F.desc(score), F.asc(key)).limit(k)
        placed = top.withColumn("__rank", F.row_number().over(Window.orderBy(F.desc(score), F.asc(key))))  # k rows
        one = placed.select(key, (1.0 / (RRF_K + F.col("__rank"))).alias("__part"))
        parts = one if parts is None else parts.unionByName(one)
    return parts.groupBy(key).agg(F.sum("__part").alias(name)).orderBy(F.desc(name), F.asc(key)).limit(k)


def hybrid(df: DataFrame, key: str, text: str | Sequence[str], query: str, vector: str | None = None, embedding: Sequence[float] | None = None, limit: int = 10, where: Column | None = None) -> DataFrame:
    """Keyword ranking, or keyword and vector rankings fused; the rows with their score, best first."""
    budget = candidate_budget(limit)
    words = bm25(df, text, query, key, budget, where)
    if vector is None or embedding is None:
        return words.orderBy(F.desc("score"), F.asc(key)).limit(limit)
    near = vector_top_k(df, vector, embedding, key, budget, where)
    best = fuse(key, budget, words, near).limit(limit).withColumnRenamed(key, "__key")
    return df.join(F.broadcast(best), F.col(key) == F.col("__key")).drop("__key").orderBy(F.desc("score"), F.asc(key))


def quantised(c: Column | str) -> Column:
    """Eight-bit codes with one scale per vector."""
    c = F.col(c) if isinstance(c, str) else c
    scale = F.array_max(F.transform(c, lambda x: F.abs(x.cast("double")))) / 127
    return F.struct(scale.alias("scale"), F.transform(c, lambda x: F.when(scale == 0, F.lit(0)).otherwise(F.greatest(F.lit(-127), F.least(F.lit(127), F.round(x.cast("double") / scale)))).cast("tinyint")).alias("codes"))


def quantised_score(c: Column, q: Sequence[float]) -> Column:
    """Inner product of codes with an unquantised query."""
    dot = F.aggregate(F.zip_with(c["codes"], _vector(q), lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
    return dot * c["scale"]


def _hashed(text: str | None, dim: int) -> list[float] | None:
    """FNV-1a over the trigrams' characters, four little-endian bytes each; the hash's top bit is the sign."""
    if text is None:
        return None
    plain, out = [c if regex.match(r"[\p{Alphabetic}\p{N}]", c) else " " for c in text], np.zeros(dim, np.float32)
    low = [c.lower() if "A" <= c <= "Z" else c for c in plain]
    for three in zip(low, low[1:], low[2:]):
        if three == (" ", " ", " "):
            continue
        h = 0xCBF29CE484222325
        for byte in "".join(three).encode("utf-32-le", "surrogatepass"):
            h = ((h ^ byte) * 0x100000001B3) & 0xFFFFFFFFFFFFFFFF
        out[h % dim] += -1.0 if h >> 63 else 1.0
    norm = np.sqrt((out * out).sum(dtype=np.float32))
    return (out / norm if norm else out).tolist()


def hashed_embedding(c: Column | str, dim: int = 64) -> Column:
    """Character trigrams hashed into dim signed buckets, scaled to length one; a text under three characters is all zeros."""

    @F.arrow_udf("array<float>")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([_hashed(t.as_py(), dim) for t in texts], pa.list_(pa.float32()))

    return run(F.col(c) if isinstance(c, str) else c)


def trained_centres(df: DataFrame, column: str, key: str, n: int, sample: int = 4_096, rounds: int = 5) -> list[list[float]]:
    """Centres by Lloyd's rounds over a bounded sample of the directions, the same on every run."""
    drawn = df.filter(F.col(column).isNotNull()).orderBy(F.xxhash64(key), key).limit(sample).select(column).collect()
    x = np.array([r[0] for r in drawn], float)
    x = x[np.linalg.norm(x, axis=1) > 0]
    x /= np.linalg.norm(x, axis=1)[:, None]
    centres = x[:n].copy()
    for _ in range(rounds):
        own = np.argmax(x @ centres.T, axis=1)
        for c in np.unique(own):
            centres[c] = x[own == c].mean(axis=0)
            centres[c] /= np.linalg.norm(centres[c]) or 1
    return centres.tolist()


def paged(df: DataFrame, column: str, centres: Sequence[Sequence[float]], to: str) -> DataFrame:
    """The rows as a paged index: one folder per bucket, of which a search reads those that it probes."""
    bucketed(df, column, centres).write.partitionBy("bucket").parquet(to)
    return df.sparkSession.read.parquet(to)


def bucketed(df: DataFrame, column: str, centres: Sequence[Sequence[float]], name: str = "bucket") -> DataFrame:
    """Each row with its nearest centre: the layout of a paged index, to be written partitioned by bucket."""
    best = F.array_max(F.array(*[F.struct(cosine(column, c).alias("s"), F.lit(-i).alias("i")) for i, c in enumerate(centres)]))
    return df.withColumn(name, -best["i"]).withColumn(f"{name}_cos", best["s"])


def probed(df: DataFrame, column: str, q: Sequence[float], centres: Sequence[Sequence[float]], key: str, k: int, probes: int, bucket: str = "bucket") -> DataFrame:
    """Rank the nearest buckets, then all that can still hold a row of the result: a filter on the partition column.

    A bucket is bounded by the widest angle between its rows and its centre, so the result is that of an exact ranking.
    """
    norm = lambda v: np.asarray(v, float) / (np.linalg.norm(v) or 1)
    near = [float(norm(c) @ norm(q)) for c in centres]
    angle = lambda x: float(np.arccos(np.clip(x, -1, 1)))
    least = {r[0]: r[1] for r in df.groupBy(bucket).agg(F.min(f"{bucket}_cos")).collect() if r[0] is not None and r[1] is not None}
    bound = {b: np.cos(max(0.0, angle(near[b]) - angle(x) - 1e-6)) for b, x in least.items()}
    order = sorted(bound, key=lambda b: (-near[b], b))[:probes]
    ranked = lambda buckets: vector_top_k(df.filter(F.col(bucket).isin(buckets)), column, q, key, k)
    scores = [r["score"] for r in ranked(order).select("score").collect()]
    floor = scores[-1] if len(scores) == k else -np.inf
    return ranked(order + [b for b in bound if b not in order and bound[b] >= floor - 1e-9])


def listed(rankings: dict[int, DataFrame], key: str, name: str = "pair") -> DataFrame:
    """The rankings of several queries as one table of (query, key), for `recall`."""
    parts = [r.select(F.struct(F.lit(i).cast("long").alias("query"), F.col(key).alias("key")).alias(name)) for i, r in rankings.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def recall(found: DataFrame, exact: DataFrame, key: str) -> DataFrame:
    """Share of the exact list that was found: one row."""
    hits = exact.select(key).join(found.select(key).distinct(), key, "left_semi").agg(F.count(F.lit(1)).alias("hits"))
    return hits.crossJoin(exact.agg(F.count(F.lit(1)).alias("n"))).select((F.col("hits") / F.col("n")).alias("recall"))
