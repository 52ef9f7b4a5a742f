"""Relational operators whose semantics need more than one built-in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import fold


def scalar_lookup(left: DataFrame, right: DataFrame, left_key: str, right_key: str, value: str, order: str, name: str) -> DataFrame:
    """A correlated scalar subquery: the value of the first row by order, NULL where there is none; the rest is ignored."""
    first = right.groupBy(F.col(right_key).alias("__key")).agg(F.min_by(value, order).alias(name))
    return left.join(first, F.col(left_key) == F.col("__key"), "left").drop("__key")


def in_subquery(left: DataFrame, key: str, right: DataFrame, value: str, name: str) -> DataFrame:
    """x IN (subquery) as a column, NULL where three-valued logic says so.  The counts are one row; the values are joined."""
    stats = right.agg(F.count(F.lit(1)).alias("__rows"), F.count_if(F.col(value).isNull()).alias("__nulls"))
    found = right.select(F.col(value).alias("__value")).filter("__value IS NOT NULL").distinct().withColumn("__hit", F.lit(True))
    joined = left.join(found, F.col(key) == F.col("__value"), "left").crossJoin(F.broadcast(stats))  # one row
    verdict = F.when(F.col("__rows") == 0, False).when(F.col(key).isNull(), None).when(F.col("__hit"), True).when(F.col("__nulls") > 0, None).otherwise(False)
    return joined.withColumn(name, verdict).drop("__value", "__hit", "__rows", "__nulls")


def group_concat(df: DataFrame, keys: list[str], value: str, sep: str | None, order: str, name: str, distinct: bool = False) -> DataFrame:
    """Values in input order; NULLs are skipped, none at all is NULL, and so is a NULL separator."""
    if sep is None:
        return df.groupBy(*keys).agg(F.lit(None).cast("string").alias(name))
    if distinct:
        df = df.groupBy(*keys, value).agg(F.min(order).alias(order))
    listed = F.sort_array(F.collect_list(F.when(F.col(value).isNotNull(), F.struct(F.col(order), F.col(value).alias("__v")))))
    out = F.array_join(F.transform(listed, lambda x: x["__v"].cast("string")), sep)
    return df.groupBy(*keys).agg(F.when(F.count(value) > 0, out).alias(name))


def group_concat_over(value: str, sep: str, window) -> Column:
    found = F.collect_list(value).over(window)
    return F.when(F.size(found) > 0, F.array_join(F.transform(found, lambda x: x.cast("string")), sep))


def group_with_first(df: DataFrame, keys: list[str], aggregates: list[Column], bare: list[str], order: str, collations: dict[str, str] | None = None) -> DataFrame:
    """GROUP BY with bare columns: those of the group's first row.  Keys under a collation show that row's spelling."""
    collations = collations or {}
    grouped = [fold(k, collations[k]).alias(f"__{k}") if k in collations else F.col(k) for k in keys]
    shown = [F.min_by(k, order).alias(k) for k in keys if k in collations]
    out = df.groupBy(*grouped).agg(*shown, *aggregates, *[F.min_by(b, order).alias(b) for b in bare])
    return out.drop(*[f"__{k}" for k in collations])


def distinct(df: DataFrame, columns: list[str], order: str, collations: dict[str, str]) -> DataFrame:
    """SELECT DISTINCT under collations: the first spelling stays."""
    keys = [fold(c, collations.get(c, "BINARY")).alias(f"__{c}") for c in columns]
    return df.groupBy(*keys).agg(*[F.min_by(c, order).alias(c) for c in columns]).select(*columns)


def lag_by_column(df: DataFrame, partition: list[str], order: list[str], value: str, offset: Column, name: str, default: Column | None = None) -> DataFrame:
    """lag with an offset per row (negative looks ahead): a join on row numbers."""
    numbered = df.withColumn("__n", F.row_number().over(Window.partitionBy(*partition).orderBy(*order))).withColumn("__want", F.col("__n") - offset)
    other = numbered.select(*[F.col(p).alias(f"__p{k}") for k, p in enumerate(partition)], F.col("__n").alias("__at"), F.col(value).alias(name))
    same = F.col("__want") == F.col("__at")
    for k, p in enumerate(partition):
        same = same & F.col(p).eqNullSafe(F.col(f"__p{k}"))
    joined = numbered.join(other, same, "left")
    if default is not None:
        joined = joined.withColumn(name, F.when(F.col("__at").isNull(), default).otherwise(F.col(name)))
    return joined.drop("__n", "__want", "__at", *[f"__p{k}" for k in range(len(partition))])


def limited(df: DataFrame, limit: int | None, offset: int | None = None) -> DataFrame:
    """LIMIT and OFFSET; a negative or NULL limit is none, a negative offset is 0."""
    if offset is not None and offset > 0:
        df = df.offset(offset)
    return df if limit is None or limit < 0 else df.limit(limit)


def compound(first: DataFrame, *arms: tuple[str, DataFrame]) -> DataFrame:
    """A chain of set operations of one precedence, from left to right; names are the first arm's."""
    out = first
    for kind, arm in arms:
        arm = arm.toDF(*first.columns)
        if kind == "union all":
            out = out.unionAll(arm)
        elif kind == "union":
            out = out.unionAll(arm).distinct()
        elif kind == "intersect":
            out = out.intersect(arm)
        elif kind == "except":
            out = out.subtract(arm)
        else:
            raise NotImplementedError(f"set operation {kind!r}")
    return out


def union_collated(first: DataFrame, second: DataFrame, column: str, collation: str, order: str) -> DataFrame:
    """UNION under a collation: of equal rows the last one stays."""
    both = first.withColumn("__arm", F.lit(0)).unionByName(second.withColumn("__arm", F.lit(1)))
    return both.groupBy(fold(column, collation).alias("__key")).agg(F.max_by(column, F.struct("__arm", order)).alias(column)).drop("__key")
