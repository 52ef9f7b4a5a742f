"""A full-text index: postings written once, clustered by term, so that a query reads its own terms' rows and no text.

Postings are term, key, tf (how often the row has the term) and len (the row's words).  Words are counted inside their row
and each task writes its own rows' postings sorted by term, as a segment: nothing is shuffled, a term of a third of all rows
is in every segment, and the filter on the term skips the others' row groups and pages.  Each row with any text also has one
posting of the term '', which no word is; the number of these rows and their mean length are one row beside the segments.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .retrieval import B, K1, query_terms, tokens


def build(df: DataFrame, columns: str | Sequence[str], key: str, to: str) -> None:
    """Write the index of one or several text columns; rows without any text are no part of it."""
    columns = [columns] if isinstance(columns, str) else list(columns)
    texts = df.filter(F.coalesce(*[F.col(c) for c in columns]).isNotNull()).select(F.col(key).alias("key"), F.concat_ws(" ", *[F.col(c) for c in columns]).alias("text"))
    cores = df.sparkSession.sparkContext.defaultParallelism
    if texts.rdd.getNumPartitions() < cores:  # a file of one row group is one task
        texts = texts.repartition(cores, "key")
    postings(texts).sortWithinPartitions("term", "key").write.option("parquet.block.size", 8 << 20).parquet(f"{to}/postings")
    rows = df.sparkSession.read.parquet(f"{to}/postings").filter(F.col("term") == "")
    rows.agg(F.count(F.lit(1)).cast("double").alias("n"), F.avg("len").alias("mean")).write.parquet(f"{to}/statistics")


def postings(texts: DataFrame) -> DataFrame:
    """The postings of key and text: runs of equal words in each row's sorted words, and one row of the term ''."""
    words = texts.select("key", F.sort_array(tokens(F.col("text"))).alias("t"))
    starts = F.filter(F.transform("t", lambda x, i: F.when(~F.get("t", i - 1).eqNullSafe(x), i)), lambda i: i.isNotNull())
    runs = words.select("key", F.size("t").cast("double").alias("len"), "t", starts.alias("at"))
    counted = F.transform("at", lambda i, k: F.struct(F.get("t", i).alias("term"), (F.coalesce(F.get("at", k + 1), F.size("t")) - i).cast("double").alias("tf")))
    own = F.array(F.struct(F.lit("").alias("term"), F.lit(0.0).alias("tf")))
    return runs.select("key", "len", F.inline(F.concat(own, counted)))  # t must not be among these: each posting would carry its row's words


def exists(spark: SparkSession, to: str) -> bool:
    """Whether both parts have been written to their end."""
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{to}/statistics/_SUCCESS")
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def search(spark: SparkSession, index: str, query: str, k: int | None = None, name: str = "score", key: str = "key", only: DataFrame | None = None) -> DataFrame:
    """BM25 scores of the rows with at least one query term: key and score; repeated query terms count each time.

    only: a column of keys; statistics cover all rows all the same.  Per term one row of document frequencies is joined in.
    """
    terms = query_terms(query)
    postings = spark.read.parquet(f"{index}/postings").filter(F.col("term").isin(sorted(set(terms))))
    unique = sorted(set(terms))
    stats = spark.read.parquet(f"{index}/statistics").crossJoin(postings.agg(*[F.count_if(F.col("term") == t).cast("double").alias(f"d{i}") for i, t in enumerate(unique)])) if unique else None
    if only is not None:
        postings = postings.join(only.select(F.col(only.columns[0]).alias("wanted")), F.col("key") == F.col("wanted"), "left_semi")
    tf = postings.groupBy("key").agg(F.max("len").alias("len"), *[F.coalesce(F.sum(F.when(F.col("term") == t, F.col("tf"))), F.lit(0.0)).alias(f"f{i}") for i, t in enumerate(unique)])
    score: Column = F.lit(0.0)
    for t in terms:
        f, d = F.col(f"f{unique.index(t)}"), F.col(f"d{unique.index(t)}")
        score = score + F.log(1 + (F.col("n") - d + 0.5) / (d + 0.5)) * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("len") / F.col("mean")))
    both = tf if stats is None else tf.crossJoin(F.broadcast(stats))  # one row
    out = both.select(F.col("key").alias(key), score.alias(name))
    return out if k is None else out.orderBy(F.desc(name), F.asc(key)).limit(k)
