"""Mixing sources to target weights by systematic sampling, in DataFrame operations alone.

Every document of a source is expected `rate` = target / size of source times.  Prefix sums of the rate along the source,
shifted by one random offset, give each document as many copies as integer boundaries lie in its own interval.  Within a
source the documents are ordered by size, so by Abel's summation the words taken differ from the target by at most the
longest document, whatever the offset.

Edge cases: a null text has size 0 and takes part (its copies take no words); a null source is a source of its own, placed
last; documents of equal size and id are interchangeable; a very long text counts whole and may be taken alone beyond its
source's target, by less than itself; an empty table gives an empty result; other columns play no part, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import numbered, ranked, table, word_count, written

CAP = 3


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = CAP) -> DataFrame:
    """sizes: source, source_size.  Adds weight and target: shares by weight of all words, at most cap times a source's size.

    What a source can't take is shared among the others by weight until none is above.  Every round is one aggregate over
    the sources that yields two numbers; a round that adds no capped source ends it.
    """
    sizes = ranked(sizes, [], ["source"], "place", "sources").withColumn(
        "weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (((F.col("place") - 1) % len(weights)) + 1).cast("int"))
    )
    sizes = written(sizes, "source-weights")
    total = sizes.agg(F.sum("source_size")).first()[0] or 0
    left, over, capped = total, None, -1
    while True:
        full = F.lit(False) if over is None else F.col("weight") * F.lit(float(left)) / F.lit(float(over)) > cap * F.col("source_size")
        got = sizes.select(F.when(full, 1).otherwise(0).alias("full"), "weight", "source_size").agg(
            F.sum("full"), F.sum(F.when(F.col("full") == 1, cap * F.col("source_size"))), F.sum(F.when(F.col("full") == 0, F.col("weight")))
        ).first()
        if over is not None and got[0] == capped:
            break
        capped = got[0] or 0
        left, over = total - (got[1] or 0), got[2]
        if not over:
            break
    share = F.lit(0.0) if not over else F.col("weight") * F.lit(float(left)) / F.lit(float(over))
    target = F.when(F.lit(not over) | (share > cap * F.col("source_size")), (cap * F.col("source_size")).cast("double")).otherwise(share)
    return sizes.select("source", "source_size", "weight", target.alias("target"))


def plan_copies(docs: DataFrame, keys: list[str], weights: tuple[int, ...] = (1, 2, 3), cap: int = CAP, seed: str = "mix") -> DataFrame:
    """docs: keys, text, source.  One row each: keys, source, size, source_size, weight, target, copies.

    The text goes no further than the count of its words; all that is shuffled is keys, source and size.
    """
    sized = docs.select(*keys, "source", word_count(F.col("text")).alias("size"))
    placed = ranked(sized, ["source"], ["size", *keys], "place", "mix")
    targets = source_targets(placed.groupBy("source").agg(F.sum("size").alias("source_size")), weights, cap)
    drawn = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}/"), F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))).cast("binary")), 1, 8), 16, 10)
    targets = targets.select(
        F.col("source").alias("__source"), "source_size", "weight", "target",
        F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("__rate"), (drawn.cast("double") / 4294967296.0).alias("__offset"),
    )
    both = placed.join(targets, placed["source"].eqNullSafe(targets["__source"]), "left")
    upto = lambda n: F.floor(F.col("__offset") + F.col("__rate") * n)
    return both.select(*keys, "source", "size", "source_size", "weight", "target", (upto(F.col("place")) - upto(F.col("place") - 1)).cast("long").alias("copies"))


def mix(docs: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """The mix itself: every document once per copy, with the columns it came with.

    Rows that repeat an id are documents of their own: a row number, written with the rows, tells them apart.
    """
    rows = numbered(docs, "mix-rows")
    plan = plan_copies(rows.select(F.col(f"doc.{key}").alias("id"), "at", "doc.text", "doc.source"), ["id", "at"], **options)
    taken = plan.filter("copies > 0").select(F.col("at").alias("taken"), "copies")
    both = rows.join(taken, F.col("at") == F.col("taken"))
    return both.select("doc", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("doc.*")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = plan_copies(table(spark, sf_dir, "documents"), ["doc_id"])
    return plan.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


OP6_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3) + 1 AS weight FROM d GROUP BY source
), fill(n, total, room, w) AS (
  SELECT 0, sum(source_size), sum(source_size), sum(weight) FROM s
  UNION ALL
  SELECT n + 1, total,
    (SELECT total - coalesce(sum(3 * source_size) FILTER (WHERE weight * CAST(room AS DOUBLE) / CAST(w AS DOUBLE) > 3 * source_size), 0) FROM s),
    (SELECT sum(weight) FILTER (WHERE NOT weight * CAST(room AS DOUBLE) / CAST(w AS DOUBLE) > 3 * source_size) FROM s)
  FROM fill WHERE n < 50 AND w IS NOT NULL
), last AS (SELECT room, w FROM fill ORDER BY n DESC LIMIT 1
), t AS (
  SELECT source, source_size, CASE WHEN w IS NULL OR weight * CAST(room AS DOUBLE) / CAST(w AS DOUBLE) > 3 * source_size THEN CAST(3 * source_size AS DOUBLE)
    ELSE weight * CAST(room AS DOUBLE) / CAST(w AS DOUBLE) END AS target,
    CAST(('0x' || substr(md5('mix/' || coalesce('=' || source, '')), 1, 8)) AS BIGINT) / CAST(4294967296 AS DOUBLE) AS u
  FROM s, last
), p AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.u, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
    row_number() OVER (PARTITION BY d.source ORDER BY d.size, d.doc_id) AS k
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target, CAST(floor(u + rate * k) - floor(u + rate * (k - 1)) AS BIGINT) * size AS taken FROM p
"""
