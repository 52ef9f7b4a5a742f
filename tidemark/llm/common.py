"""What the operators share: the cluster's shared folder, written tables that cut lineage, and distributed ranks."""

from __future__ import annotations

import atexit
import contextlib
import gc
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import ship

#: Words as the contracts define them: maximal runs of anything but space, tab, line feed .. carriage return.
WORD = r"[^\x20\x09-\x0D]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_own: dict[str, str] = {}
_made: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset, a session whose executors are threads of this process gets a temporary folder; any other is refused,
    as no folder of one machine would do.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _own:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        _own[app] = tempfile.mkdtemp(prefix="tidemark-")
        atexit.register(shutil.rmtree, _own[app], ignore_errors=True)
    return _own[app]


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def written(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """Write a table to the shared folder and read it back: the plan after it starts from files that survive lost executors."""
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete tables from `written` that nothing reads any more, and have Spark's cleaner drop the shuffles before them.

    The cleaner follows the garbage collector of the driver's JVM, which has no other cause to run when disks fill up.
    """
    for df in tables:
        drop_path(df.sparkSession, df.scratch_path)
        if df.scratch_path in _made:
            _made.remove(df.scratch_path)
    if tables:
        gc.collect()
        tables[0].sparkSession._jvm.System.gc()


@contextlib.contextmanager
def collected() -> Iterator[list[str]]:
    """The list that gets the scratch paths made inside; those deleted meanwhile leave it at the end."""
    at, made = len(_made), []
    try:
        yield made
    finally:
        made += _made[at:]


def discard(spark: SparkSession, paths: list[str], but: DataFrame) -> None:
    """Delete scratch paths, but those that a table still reads."""
    read = but.inputFiles()
    for path in paths:
        if not any(path.rsplit("/", 1)[1] in f for f in read):
            drop_path(spark, path)
            if path in _made:
                _made.remove(path)
    gc.collect()
    spark._jvm.System.gc()


def numbered(df: DataFrame, name: str) -> DataFrame:
    """The rows as written: doc, a struct of all columns, and at, a number for each row."""
    return written(df.select(F.struct(*df.columns).alias("doc"), F.monotonically_increasing_id().alias("at")), name)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a folder through Hadoop, whichever store holds it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def free_name(df: DataFrame, name: str) -> str:
    """The name, with underscores before it until no column of the table has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z alone."""
    return F.translate(c, _UPPER, _LOWER)


def crc_mod(key: Column, n: int) -> Column:
    """crc32 of the id's decimal text, modulo n; a null id counts as remainder 0."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % n, F.lit(0))


def word_count(text: Column) -> Column:
    """Number of words in the text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def ranked(df: DataFrame, group: list[str], order: list[str], rank: str, name: str) -> DataFrame:
    """Number the rows of each group from 1 in the given order without gathering a group in one task.

    The rows are dealt by range of (group, order), so that a hot group spreads over many tasks; each task numbers its own
    rows, and a small table of counts by (task, group) turns those numbers into ranks.  Ties in the order get ranks in any
    order, so the order should end in a key.  The frame is written once in between, because ranges are drawn from samples.
    """
    keys = [*group, *order]
    placed = df.repartitionByRange(*[F.col(k).asc_nulls_last() for k in keys]).sortWithinPartitions(*[F.col(k).asc_nulls_last() for k in keys])
    placed = written(placed.withColumn("__at", F.monotonically_increasing_id()), name)
    placed = placed.withColumn("__task", F.shiftright("__at", 33)).withColumn("__at", F.col("__at").bitwiseAND((1 << 33) - 1))
    groups = [f"__group{k}" for k in range(len(group))]
    counts = placed.groupBy("__task", *group).agg(F.count(F.lit(1)).alias("__n"), F.min("__at").alias("__first"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(*group).orderBy("__task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(F.col("__task").alias("__of"), *[F.col(g).alias(to) for g, to in zip(group, groups)], (before - F.col("__first") + 1).alias("__base"))
    same = F.col("__of") == F.col("__task")
    for g, to in zip(group, groups):
        same = same & F.col(to).eqNullSafe(F.col(g))
    return placed.join(counts, same, "left").select(*df.columns, (F.col("__at") + F.col("__base")).alias(rank))


def bounded_sample(rows: DataFrame, label: str, key: str, most: int, salt: str, most_labels: int = 2_000) -> DataFrame:
    """About most rows, as evenly over the label's values as their counts allow; the same rows on every run.

    A row is drawn by a hash of its key against its label's fraction.  The counts cover all rows; labels beyond the
    most_labels commonest are left out, and of a draw above twice the wanted number (which takes a key that many rows repeat)
    the lowest hashes stay, so its size is bounded.
    """
    counts = {r[0]: r[1] for r in rows.filter(F.col(label).isNotNull()).groupBy(label).count().orderBy(F.desc("count"), label).limit(most_labels).collect()}
    if not counts:
        return rows.limit(0)
    quota, left, share = {}, most, len(counts)
    for name, n in sorted(counts.items(), key=lambda x: (x[1], str(x[0]))):
        quota[name] = min(n, max(1, left // share))
        left, share = left - quota[name], share - 1
    fractions = F.create_map(*[F.lit(x) for name, n in counts.items() for x in (name, quota[name] / n)])
    drawn = F.pmod(F.xxhash64(F.lit(salt), F.col(key)), F.lit(1_000_003)) / 1_000_003.0
    taken = rows.filter(F.col(label).isNotNull() & (drawn < F.coalesce(F.element_at(fractions, F.col(label)), F.lit(0.0))))
    return taken.orderBy(drawn, *rows.columns).limit(2 * most)
