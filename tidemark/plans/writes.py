"""Writes, definitions, transactions and change capture, over managed copies of small tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.store import Spec, Store
from ..streaming import changes as streams
from .registry import frame, read


def store(spark: SparkSession) -> Store:
    """A database of its own for one query, in the shared folder or else in the warehouse."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return Store(spark, f"{root.rstrip('/')}/db-{uuid.uuid4().hex}")


def nations(spark: SparkSession, d: str, conflict: str = "abort") -> Store:
    s = store(spark)
    s.create_table("t", [Spec("id", "INTEGER", primary_key=True), Spec("name", "TEXT", unique=True), Spec("n", "INTEGER", not_null=True, default="0", check="n >= 0")])
    s.insert("t", read(spark, d, "nation").select(F.col("n_nationkey").cast("bigint").alias("id"), F.col("n_name").alias("name"), F.col("n_regionkey").cast("bigint").alias("n")))
    return s


def proposals(spark: SparkSession, d: str) -> DataFrame:
    """Nations 0-9 again with n + 10; two new ones, one of them twice; and rows that agree with others on one key alone."""
    n = read(spark, d, "nation").filter("n_nationkey < 10").select(F.col("n_nationkey").cast("bigint").alias("id"), F.col("n_name").alias("name"), (F.col("n_regionkey") + 10).cast("bigint").alias("n"))
    more = [(100, "ATLANTIS", 1), (101, "MU", 2), (101, "MU", 40), (110, "THULE", 3), (111, "THULE", 4), (111, "AVALON", 5)]
    return n.coalesce(1).union(spark.createDataFrame(more, "id bigint, name string, n bigint").coalesce(1))


_OLD = "SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS name, CAST(n_regionkey AS BIGINT) AS n FROM nation"
_NEW = "SELECT CAST(100 AS BIGINT) AS id, 'ATLANTIS' AS name, CAST(1 AS BIGINT) AS n UNION ALL SELECT 101, 'MU', 2 UNION ALL SELECT 110, 'THULE', 3 UNION ALL SELECT 111, 'AVALON', 5"
#: As _NEW, where the last of rows that agree stays: 111 AVALON takes the place of 111 THULE, which had taken 110's.
_LAST = "SELECT CAST(100 AS BIGINT) AS id, 'ATLANTIS' AS name, CAST(1 AS BIGINT) AS n UNION ALL SELECT 101, 'MU', 40 UNION ALL SELECT 111, 'AVALON', 5"


@frame("d1_insert_values", f"{_OLD} UNION ALL SELECT 200, 'X', 0")
def d1(spark, d):
    s = nations(spark, d)
    s.insert("t", spark.createDataFrame([(200, "X")], "id bigint, name string"))
    return s.frame("t")


@frame("d2_insert_select", f"{_OLD} UNION ALL SELECT CAST(s_suppkey + 1000 AS BIGINT), s_name, 7 FROM supplier")
def d2(spark, d):
    s = nations(spark, d)
    s.insert("t", read(spark, d, "supplier").select((F.col("s_suppkey") + 1000).alias("id"), F.col("s_name").alias("name"), F.lit(7).alias("n")))
    return s.frame("t")


@frame("d3_insert_or_ignore", f"{_OLD} UNION ALL {_NEW}")
def d3(spark, d):
    s = nations(spark, d)
    s.insert("t", proposals(spark, d).union(spark.createDataFrame([(102, "BAD", -1)], "id bigint, name string, n bigint")), "ignore")
    return s.frame("t")


@frame("d4_insert_or_replace", f"SELECT id, name, CASE WHEN id < 10 THEN n + 10 ELSE n END AS n FROM ({_OLD}) UNION ALL {_LAST}")
def d4(spark, d):
    s = nations(spark, d)
    s.insert("t", proposals(spark, d), "replace")
    return s.frame("t")


@frame("d5_on_conflict_do_nothing", f"{_OLD} UNION ALL {_NEW}")
def d5(spark, d):
    s = nations(spark, d)
    s.insert("t", proposals(spark, d).filter("name <> 'THULE' OR id < 111"), "nothing", ["id"])
    return s.frame("t")


@frame(
    "d6_on_conflict_do_update",
    f"SELECT id, name, CASE WHEN id < 10 AND n > 1 THEN n + n + 10 ELSE n END AS n FROM ({_OLD}) UNION ALL "
    "SELECT 100, 'ATLANTIS', 1 UNION ALL SELECT 101, 'MU', 42 UNION ALL SELECT 110, 'THULE', 3 UNION ALL SELECT 111, 'AVALON', 5 UNION ALL SELECT 120, 'LEMURIA', 1020",
)
def d6(spark, d):
    s = nations(spark, d)
    again = spark.createDataFrame([(120, "LEMURIA", 20)] + [(120, "LEMURIA", 10**k) for k in range(2, 3)] * 10, "id bigint, name string, n bigint").coalesce(1)
    s.insert("t", proposals(spark, d).filter("name <> 'THULE' OR id < 111").union(again), "update", ["id"], {"n": "n + excluded_n"}, "n > 1")
    return s.frame("t")


@frame("d3_d6_collated_keys", "SELECT 'a' AS name, CAST(1 AS BIGINT) AS n UNION ALL SELECT 'B', 21 UNION ALL SELECT 'c', 5")
def collated(spark, d):
    """A NOCASE key is one key in any case, for IGNORE as for DO UPDATE."""
    s = store(spark)
    s.create_table("t", [Spec("name", "TEXT", unique=True, collation="NOCASE"), Spec("n")])
    new = lambda *rows: spark.createDataFrame(rows, "name string, n bigint").coalesce(1)
    s.insert("t", new(("a", 1), ("B", 1)))
    s.insert("t", new(("A", 9), ("c", 5), ("C", 6)), "ignore")
    s.insert("t", new(("b", 20)), "update", ["name"], {"n": "n + excluded_n"})
    return s.frame("t")


@frame("d7_update", f"SELECT id, name, CASE WHEN id % 2 = 0 THEN n * 100 + id ELSE n END AS n FROM ({_OLD})")
def d7(spark, d):
    s = nations(spark, d)
    s.update("t", {"n": "n * 100 + id"}, "id % 2 = 0")
    return s.frame("t")


@frame("d8_delete", f"SELECT * FROM ({_OLD}) WHERE NOT n = 3")
def d8(spark, d):
    s = nations(spark, d)
    s.delete("t", "n = 3")
    return s.frame("t")


@frame("d9_returning", f"SELECT id, n + 1 AS n FROM ({_OLD}) WHERE n = 2")
def d9(spark, d):
    return nations(spark, d).update("t", {"n": "n + 1"}, "n = 2").select("id", "n")


@frame("d10_row_ids", "SELECT CAST(row_number() OVER (ORDER BY s_suppkey) AS BIGINT) AS id, s_name AS name FROM supplier")
def d10(spark, d):
    s = store(spark)
    s.create_table("t", [Spec("id", "INTEGER", primary_key=True), Spec("name", "TEXT")])
    s.insert("t", read(spark, d, "supplier").select(F.col("s_name").alias("name")), order=[F.col("name")])
    return s.frame("t")


@frame("d10_ids_beside_keys", "SELECT CAST(s_suppkey * 10 AS BIGINT) AS id, s_name AS name FROM supplier UNION ALL SELECT (SELECT max(s_suppkey) * 10 FROM supplier) + row_number() OVER (ORDER BY n_name), n_name FROM nation")
def d10_keys(spark, d):
    """The counter stays ahead of keys that were given."""
    s = store(spark)
    s.create_table("t", [Spec("id", "INTEGER", primary_key=True), Spec("name", "TEXT")])
    s.insert("t", read(spark, d, "supplier").select((F.col("s_suppkey") * 10).alias("id"), F.col("s_name").alias("name")))
    s.insert("t", read(spark, d, "nation").select(F.col("n_name").alias("name")), order=[F.col("name")])
    return s.frame("t")


@frame("d11_constraints", "SELECT 'CHECK' AS kind, true AS refused UNION ALL SELECT 'NOT NULL', true UNION ALL SELECT 'UNIQUE', true")
def d11(spark, d):
    from ..errors import ConstraintError

    s, out = nations(spark, d), []
    taken = s.frame("t").orderBy("id").first()["name"]
    for kind, row in (("CHECK", (300, "A", -1)), ("NOT NULL", (301, "B", None)), ("UNIQUE", (302, taken, 1))):
        try:
            s.insert("t", spark.createDataFrame([row], "id bigint, name string, n bigint"))
            out.append((kind, False))
        except ConstraintError as e:
            out.append((kind, kind in str(e)))
    return spark.createDataFrame(out, "kind string, refused boolean")


@frame("t3_add_column", f"SELECT id, name, n, 'new' AS extra FROM ({_OLD})")
def t3(spark, d):
    s = nations(spark, d)
    s.add_column("t", Spec("extra", "TEXT", default="'new'"))
    return s.frame("t")


@frame("t4_t5_t6_renames_and_drop", f"SELECT id, n AS level FROM (SELECT id, n FROM ({_OLD}))")
def t456(spark, d):
    s = store(spark)
    s.create_table("a", [Spec("id"), Spec("name", "TEXT"), Spec("n")])
    s.insert("a", nations(spark, d).frame("t"))
    s.rename_table("a", "b")
    s.rename_column("b", "n", "level")
    s.drop_column("b", "name")
    return s.frame("b")


@frame("t1_t2_t7_t8_catalog", "SELECT 'k' AS table_name, 'id' AS column_name, CAST(1 AS BIGINT) AS ordinal_position, 'INTEGER' AS data_type UNION ALL SELECT 'k', 'v', 2, 'VECTOR(4)'")
def catalog(spark, d):
    s = store(spark)
    s.create_table("k", [Spec("id", "INTEGER", primary_key=True), Spec("v", "VECTOR(4)")])
    s.create_table("gone", [Spec("id")])
    s.create_index("ann", "k", ["v"])
    s.drop_index("ann")
    s.drop_table("gone")
    return s.information().select("table_name", "column_name", "ordinal_position", "data_type")


@frame("t9_transactions", f"SELECT * FROM ({_OLD}) WHERE n <> 1")
def t9(spark, d):
    s = nations(spark, d)
    s.begin()
    s.delete("t", "n = 2")
    s.rollback()
    s.begin()
    s.delete("t", "n = 1 AND id < 3")
    s.delete("t", "n = 1")
    s.commit()
    return s.frame("t")


@frame("x1_x2_changes", "SELECT 'delete' AS kind, count(*) AS n FROM nation WHERE n_regionkey = 3 UNION ALL SELECT 'update', count(*) FROM nation WHERE n_regionkey = 2")
def x12(spark, d):
    s = nations(spark, d)
    since = s.version
    s.delete("t", "n = 3")
    s.update("t", {"n": "n + 1"}, "n = 2")
    return s.changes(since).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@frame("x3_lost", "SELECT 'at the floor' AS since, false AS lost, CAST(4 AS BIGINT) AS n UNION ALL SELECT 'before the floor', true, 4")
def x3(spark, d):
    """A log that keeps little: who asks from before its floor is told that changes are lost."""
    s = store(spark)
    s.create_table("t", [Spec("id"), Spec("n")])
    s.keep, s.slack = 4, 0
    for k in range(6):
        s.insert("t", spark.createDataFrame([(k, k)], "id bigint, n bigint"))
    floor = s.floor
    return spark.createDataFrame([(name, s.lost(v), s.changes(v).count()) for name, v in (("at the floor", floor), ("before the floor", floor - 1))], "since string, lost boolean, n bigint")


@frame("x5_event_windows", "SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def x5(spark, d):
    return streams.windowed_counts(read(spark, d, "events")).withColumn("total", F.round("total", 4))


@frame("k4_vacuum", _OLD)
def k4(spark, d):
    s = nations(spark, d)
    return s.vacuum(s.root + "-compact").frame("t")


@frame("s11_information_views", "SELECT * FROM (VALUES ('COLUMNS', 5), ('KEY_COLUMN_USAGE', 4), ('ROUTINES', 0), ('SCHEMATA', 1), ('STATISTICS', 5), ('TABLES', 2), ('TABLE_CONSTRAINTS', 4), ('TRIGGERS', 0), ('VIEWS', 0)) v(name, n)")
def s11(spark, d):
    """Rows of each view of a catalog with two tables, a pair that is unique, a check, and a full-text index."""
    s = nations(spark, d)
    s.create_table("pair", [Spec("a"), Spec("b", "TEXT")], unique=[["a", "b"]])
    s.create_index("words", "t", ["name"], "FULLTEXT")
    names = ("TABLES", "COLUMNS", "SCHEMATA", "STATISTICS", "KEY_COLUMN_USAGE", "TABLE_CONSTRAINTS", "VIEWS", "TRIGGERS", "ROUTINES")
    return spark.createDataFrame([(n, s.information(n).count()) for n in names], "name string, n int")


@frame("s12_indexed_search", "SELECT CAST(n_nationkey AS BIGINT) AS id FROM nation WHERE n_nationkey = 7")
def s12(spark, d):
    """A search through a full-text index of a managed table; without one it is refused."""
    from ..errors import IndexRequired

    s = nations(spark, d)
    try:
        s.search_text("t", "name", "id", "x")
        return spark.createDataFrame([(-1,)], "id bigint")
    except IndexRequired:
        s.create_index("words", "t", ["name"], "FULLTEXT")
    name = s.frame("t").filter("id = 7").first()["name"]
    return s.search_text("t", "name", "id", name, 1).select("id")


@frame("k3_capped_json", "SELECT 200 AS shown, true AS cut, '<vector(64)>' AS vector")
def k3(spark, d):
    import json

    from ..operators.rendering import render

    told = json.loads(render(read(spark, d, "embeddings").select("vec_id", "embedding")))
    return spark.createDataFrame([(len(told["rows"]), told["truncated"], told["rows"][0][1])], "shown int, cut boolean, vector string")


@frame("t10_first_writer_wins", f"SELECT * FROM ({_OLD}) WHERE n <> 1")
def t10(spark, d):
    """Of two writers that began together the second to commit is refused, and leaves nothing."""
    from ..errors import ConflictError

    s = nations(spark, d)
    s.begin()
    s.delete("t", "n = 2")
    Store(spark, s.root).delete("t", "n = 1")
    try:
        s.commit()
    except ConflictError:
        return s.frame("t")
    return s.frame("t").limit(0)


@frame("d12_kinds_on_write", "SELECT * FROM (VALUES ('integer into real', false), ('number into text', true), ('real into integer', true), ('short vector', true), ('text into integer', true)) v(what, refused)")
def d12(spark, d):
    from ..errors import TypeMismatch

    s, out = store(spark), []
    s.create_table("k", [Spec("i"), Spec("r", "REAL"), Spec("t", "TEXT"), Spec("v", "VECTOR(2)")])
    for what, value, kind in (("integer into real", 1, "r long"), ("real into integer", 1.5, "i double"), ("text into integer", "1", "i string"), ("number into text", 1, "t long"), ("short vector", [1.0], "v array<double>")):
        try:
            s.insert("k", spark.createDataFrame([(value,)], kind))
            out.append((what, False))
        except TypeMismatch:
            out.append((what, True))
    return spark.createDataFrame(out, "what string, refused boolean")


@frame("m19_refusals", "SELECT unnest(['CONCAT_WS', 'DATE_FORMAT', 'DATEDIFF', 'ILIKE', 'JSON_TYPE', 'QUALIFY', 'RIGHT JOIN', 'ROLLUP', 'SYSDATE']) AS name, true AS refused")
def m19(spark, d):
    """What the dialects do not have is refused with its name."""
    from ..engine import Engine
    from ..errors import Unsupported

    e, out = Engine(spark, {"n": read(spark, d, "nation")}, mysql=True), []
    asked = {f: f"SELECT {f}(1, 2) FROM n" for f in ("CONCAT_WS", "DATE_FORMAT", "DATEDIFF", "JSON_TYPE", "SYSDATE")}
    asked |= {"ILIKE": "SELECT 1 FROM n WHERE n_name ILIKE 'a'", "QUALIFY": "SELECT 1 FROM n QUALIFY true", "RIGHT JOIN": "SELECT 1 FROM n RIGHT JOIN n AS m ON true", "ROLLUP": "SELECT 1 FROM n GROUP BY ROLLUP(n_name)"}
    for name, text in asked.items():
        try:
            e.sql(text)
            out.append((name, False))
        except Unsupported as x:
            out.append((name, name in str(x)))
    return spark.createDataFrame(out, "name string, refused boolean")


@frame("e1_engine_sql", "SELECT r_name, count(*) AS n, max(n_nationkey) AS m, substr(r_name, -3) AS tail FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey > 2 AND n_name ILIKE '%n_1%' GROUP BY r_name")
def e1(spark, d):
    """A text with parameters over named tables, in the dialect."""
    from ..engine import Engine

    e = Engine(spark, {"nation": read(spark, d, "nation"), "region": read(spark, d, "region")})
    return e.sql("SELECT r_name, count(*) AS n, max(n_nationkey) AS m, substr(r_name, -3) AS tail FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey > ? AND n_name LIKE ? GROUP BY r_name", [2, "%n_1%"])
