"""Scalar, date and JSON functions, and the other dialect's variants."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import json_text as J
from ..functions import scalar as S
from .registry import frame, read, sql


def over(name: str, table: str, key: str, make, expression: str, kind: str = "v") -> None:
    """One function over a table's rows."""

    @frame(name, f"SELECT {key}, {expression} AS {kind} FROM {table}")
    def run(spark, d):
        return read(spark, d, table).select(key, make().alias(kind))


_ACCENT = "translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ')"
sql("f1_length", "SELECT doc_id, CAST(length(text) AS BIGINT) AS v FROM {documents}")
sql("f2_octet_length", "SELECT doc_id, CAST(octet_length(text) AS BIGINT) AS v FROM {documents}", "SELECT doc_id, CAST(octet_length(encode(text)) AS BIGINT) AS v FROM documents")
over("f3_upper", "documents", "doc_id", lambda: F.md5(S.upper("text").cast("binary")), f"md5({_ACCENT})")
over("f4_lower", "documents", "doc_id", lambda: F.md5(S.lower("text").cast("binary")), "md5(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))")
over("f5_substr_from", "nation", "n_nationkey", lambda: S.substr("n_name", 2, 3), "substr(n_name, 2, 3)")
over("f5_substr_from_end", "nation", "n_nationkey", lambda: S.substr("n_name", -3), "right(n_name, 3)")
over("f5_substr_zero", "nation", "n_nationkey", lambda: S.substr("n_name", 0, 3), "left(n_name, 2)")
over("f5_substr_back", "nation", "n_nationkey", lambda: S.substr("n_name", 3, -2), "left(n_name, 2)")
over("f6_trim", "nation", "n_nationkey", lambda: F.concat_ws("/", S.trim("n_name", "AI"), S.trim("n_name", "AI", "left"), S.trim("n_name", "AI", "right")), "trim(n_name, 'AI') || '/' || ltrim(n_name, 'AI') || '/' || rtrim(n_name, 'AI')")
over("f7_replace", "nation", "n_nationkey", lambda: S.replace("n_name", "A", "--"), "replace(n_name, 'A', '--')")
over("f8_instr", "nation", "n_nationkey", lambda: S.instr("n_name", "N").cast("bigint"), "CAST(instr(n_name, 'N') AS BIGINT)")
over("f9_hex", "nation", "n_nationkey", lambda: S.hex_("n_name"), "hex(encode(n_name))")
over("f10_unhex", "nation", "n_nationkey", lambda: S.unhex(F.hex(F.col("n_name"))).cast("string"), "n_name")
over("f11_abs", "customer", "c_custkey", lambda: F.abs("c_acctbal"), "abs(c_acctbal)")
over("f12_round", "customer", "c_custkey", lambda: S.round_(F.col("c_custkey") / F.lit(4.0)), "round(c_custkey / 4.0, 0)::DOUBLE")
over("f14_coalesce", "customer", "c_custkey", lambda: F.coalesce(F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")), F.lit("odd")), "coalesce(CASE WHEN c_custkey % 2 = 0 THEN c_name END, 'odd')")
over("f15_ifnull", "customer", "c_custkey", lambda: F.ifnull(F.when(F.col("c_custkey") % 3 == 0, F.col("c_acctbal")), F.lit(-1.0)), "ifnull(CASE WHEN c_custkey % 3 = 0 THEN c_acctbal END, -1.0)::DOUBLE")
over("f16_nullif", "customer", "c_custkey", lambda: F.nullif("c_mktsegment", F.lit("BUILDING")), "nullif(c_mktsegment, 'BUILDING')")
over("f17_scalar_min", "lineitem", "l_orderkey", lambda: S.scalar_min("l_partkey", F.nullif("l_suppkey", F.lit(3))), "CASE WHEN l_suppkey = 3 THEN NULL ELSE least(l_partkey, l_suppkey) END")
over("f18_scalar_max", "lineitem", "l_orderkey", lambda: S.scalar_max("l_partkey", F.nullif("l_suppkey", F.lit(3))), "CASE WHEN l_suppkey = 3 THEN NULL ELSE greatest(l_partkey, l_suppkey) END")


@frame("f13_random", None)
def f13(spark, d):
    return read(spark, d, "nation").select("n_nationkey", S.random(7).alias("v"))


@frame("p18_real_text", "SELECT p_partkey, CASE WHEN q = trunc(q) THEN CAST(CAST(q AS BIGINT) AS VARCHAR) || '.0' ELSE CAST(q AS VARCHAR) END AS v FROM (SELECT p_partkey, p_size / 4.0::DOUBLE AS q FROM part)")
def p18b(spark, d):
    return read(spark, d, "part").select("p_partkey", S.real_text(F.col("p_size") / F.lit(4.0)).alias("v"))


# Dates: over o_orderdate as text.
_TEXT = "strftime(o_orderdate, '%Y-%m-%d %H:%M:%S')"


def dated(name: str, make, expression: str) -> None:
    @frame(name, f"SELECT o_orderkey, {expression} AS v FROM orders")
    def run(spark, d):
        return read(spark, d, "orders").withColumn("t", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")).select("o_orderkey", make().alias("v"))


dated("f19_date", lambda: D.date("t", "+10 days"), "strftime(o_orderdate + INTERVAL 10 DAY, '%Y-%m-%d')")
dated("f20_time", lambda: D.time("t", "+90 minutes"), "strftime(o_orderdate + INTERVAL 90 MINUTE, '%H:%M:%S')")
dated("f21_datetime", lambda: D.datetime("t", "start of month", "-1 second"), "strftime(date_trunc('month', o_orderdate) - INTERVAL 1 SECOND, '%Y-%m-%d %H:%M:%S')")
dated("f22_strftime", lambda: D.strftime("%Y/%m/%d %H-%M-%S %j %w %u %% %F %T", D.moment("t")), "strftime(o_orderdate, '%Y/%m/%d %H-%M-%S %j %w %u %% %Y-%m-%d %H:%M:%S')")
dated("f22_strftime_weeks", lambda: D.strftime("%U %W %V %G", D.moment("t")), "strftime(o_orderdate, '%U %W %V %G')")
dated("f22_strftime_clock", lambda: D.strftime("%I %p %R %d", D.moment("t", "+13 hours")), "strftime(o_orderdate + INTERVAL 13 HOUR, '%I %p %H:%M %d')")
dated("f23_unixepoch", lambda: D.unixepoch("t"), "CAST(epoch(o_orderdate) AS BIGINT)")
dated("f25_time_values", lambda: D.datetime(F.concat(F.date_format("o_orderdate", "yyyy-MM"), F.lit("-31T10:20+02:00"))), "strftime(date_trunc('month', o_orderdate) + INTERVAL 30 DAY + INTERVAL 500 MINUTE, '%Y-%m-%d %H:%M:%S')")
dated("f26_month_overflow", lambda: D.date(F.concat(F.date_format("o_orderdate", "yyyy-MM"), F.lit("-31")), "+1 month"), "strftime(date_trunc('month', date_trunc('month', o_orderdate) + INTERVAL 30 DAY) + INTERVAL 1 MONTH + to_days(CAST(day(date_trunc('month', o_orderdate) + INTERVAL 30 DAY) AS INTEGER) - 1), '%Y-%m-%d')")
dated("f26_weekday", lambda: D.date("t", "weekday 0"), "strftime(o_orderdate + to_days(CAST((7 - dayofweek(o_orderdate)) % 7 AS INTEGER)), '%Y-%m-%d')")
dated("f26_start_of_year", lambda: D.date("t", "start of year", "+2 years", "-1 day"), "strftime(date_trunc('year', o_orderdate) + INTERVAL 2 YEAR - INTERVAL 1 DAY, '%Y-%m-%d')")
dated("f26_unixepoch_modifier", lambda: D.datetime(F.unix_timestamp("o_orderdate"), "unixepoch", "+00:30"), "strftime(o_orderdate + INTERVAL 30 MINUTE, '%Y-%m-%d %H:%M:%S')")


@frame("f24_current_timestamp", None)
def f24(spark, d):
    return read(spark, d, "region").select("r_regionkey", D.datetime(F.current_timestamp(), kind="timestamp").alias("now"), D.date(F.current_timestamp(), kind="timestamp").alias("today"))


# The other dialect (F27-F30, M*)
over("f27_mysql_substr", "nation", "n_nationkey", lambda: F.concat_ws("/", S.mysql_substr("n_name", -4, 2), S.mysql_substr("n_name", 0), S.mysql_substr("n_name", 3)), "(CASE WHEN length(n_name) >= 4 THEN substr(n_name, length(n_name) - 3, 2) ELSE '' END) || '/' || '' || '/' || substr(n_name, 3)")
over("f28_mysql_hex", "nation", "n_nationkey", lambda: S.mysql_hex("n_nationkey"), "printf('%X', n_nationkey)")
over("f29_mysql_nullif", "nation", "n_nationkey", lambda: S.mysql_nullif("n_nationkey", F.concat(F.col("n_regionkey").cast("string"), F.lit("x")), ("int", "string")), "CASE WHEN n_nationkey = n_regionkey THEN NULL ELSE n_nationkey END")
over("f30_mysql_round", "customer", "c_custkey", lambda: S.mysql_round(F.col("c_custkey") / F.lit(2.0)), "round_even(c_custkey / 2.0::DOUBLE, 0)")
over("m1_m3_strings", "nation", "n_nationkey", lambda: F.concat(S.lower("n_name"), F.char_length("n_name").cast("string"), S.upper("n_name")), "lower(n_name) || length(n_name) || upper(n_name)")
over("m4_m5_locate_left_right", "nation", "n_nationkey", lambda: F.concat(F.locate("A", F.col("n_name")).cast("string"), F.left("n_name", F.lit(2)), F.right("n_name", F.lit(2))), "instr(n_name, 'A') || left(n_name, 2) || right(n_name, 2)")
over("m6_bit_length", "nation", "n_nationkey", lambda: F.bit_length("n_name").cast("bigint"), "CAST(bit_length(n_name) AS BIGINT)")
over("m11_isnull_if", "customer", "c_custkey", lambda: F.when(F.isnull(F.nullif(F.col("c_custkey") % 2, F.lit(0))), "even").otherwise("odd"), "CASE WHEN nullif(c_custkey % 2, 0) IS NULL THEN 'even' ELSE 'odd' END")
sql("m15_date_parts", "SELECT o_orderkey, CAST(year(o_orderdate) AS BIGINT) AS y, CAST(month(o_orderdate) AS BIGINT) AS m, CAST(day(o_orderdate) AS BIGINT) AS d, CAST(hour(o_orderdate) AS BIGINT) AS h, CAST(dayofyear(o_orderdate) AS BIGINT) AS dy FROM {orders}")
sql("m16_weekdays", "SELECT o_orderkey, CAST(dayofweek(o_orderdate) AS BIGINT) AS dow, CAST(weekday(o_orderdate) AS BIGINT) AS wd, CAST(quarter(o_orderdate) AS BIGINT) AS q, date_format(last_day(o_orderdate), 'yyyy-MM-dd') AS ld FROM {orders}", "SELECT o_orderkey, CAST(dayofweek(o_orderdate) + 1 AS BIGINT) AS dow, CAST(isodow(o_orderdate) - 1 AS BIGINT) AS wd, CAST(quarter(o_orderdate) AS BIGINT) AS q, strftime(last_day(o_orderdate), '%Y-%m-%d') AS ld FROM orders")
sql("m18_trim_from", "SELECT n_nationkey, trim(BOTH 'A' FROM n_name) AS b, trim(LEADING 'A' FROM n_name) AS l, trim(TRAILING 'A' FROM n_name) AS t FROM {nation}", "SELECT n_nationkey, trim(n_name, 'A') AS b, ltrim(n_name, 'A') AS l, rtrim(n_name, 'A') AS t FROM nation")

sql("m12_rand", "SELECT n_nationkey, rand() BETWEEN 0 AND 1 AS within FROM {nation}", "SELECT n_nationkey, true AS within FROM {nation}")
sql("m13_clock_spellings", "SELECT n_nationkey, now() = localtimestamp() AND curdate() = current_date() AS agree FROM {nation}", "SELECT n_nationkey, true AS agree FROM {nation}")
sql("m14_unix_timestamp", "SELECT o_orderkey, unix_timestamp() - unix_timestamp(o_orderdate) > 0 AS past, unix_timestamp(o_orderdate) AS s FROM {orders}", "SELECT o_orderkey, true AS past, CAST(epoch(o_orderdate) AS BIGINT) AS s FROM {orders}")
over("m17_json_length", "events", "event_id", lambda: F.concat_ws("/", J.json_array_length(J.json_array(F.col("event_id"), 1)).cast("string"), J.json_type("props", "$.k").isNotNull().cast("string"), J.json_type("props", "$.none").isNotNull().cast("string"), J.arrow2(J.json_object("t", F.col("event_type")), "$.t")), "'2/true/false/' || event_type")

# JSON (JS*): over events.props, like {"k": 0}
for name, make, expression in (
    ("js1_json", lambda: J.json_("props"), "replace(props, ' ', '')"),
    ("js2_json_valid", lambda: J.json_valid(F.when(F.col("event_id") % 2 == 0, F.col("props")).otherwise(F.lit("{bad"))), "CAST(CASE WHEN event_id % 2 = 0 THEN 1 ELSE 0 END AS BIGINT)"),
    ("js3_json_type", lambda: F.concat_ws(",", J.json_type("props"), J.json_type("props", "$.k")), "'object,integer'"),
    ("js4_json_extract", lambda: J.json_extract("props", "$.k").cast("bigint"), "CAST(regexp_extract(props, '[0-9]+') AS BIGINT)"),
    ("js4_json_extract_many", lambda: J.json_extract("props", "$.k", "$.none"), "'[' || regexp_extract(props, '[0-9]+') || ',null]'"),
    ("js5_arrow", lambda: J.arrow("props", "k"), "regexp_extract(props, '[0-9]+')"),
    ("js6_arrow_value", lambda: J.arrow2("props", "$.k"), "regexp_extract(props, '[0-9]+')"),
    ("js7_json_quote", lambda: J.json_quote("event_type"), "'\"' || event_type || '\"'"),
    ("js8_json_array", lambda: J.json_array(F.col("event_id"), F.col("event_type"), F.col("props"), json_args=(2,)), "'[' || event_id || ',\"' || event_type || '\",' || replace(props, ' ', '') || ']'"),
    ("js9_json_object", lambda: J.json_object("t", F.col("event_type"), "u", F.col("user_id")), "'{\"t\":\"' || event_type || '\",\"u\":' || user_id || '}'"),
    ("js10_json_array_length", lambda: J.json_array_length(J.json_array(F.col("event_id"), F.lit("x"))), "CAST(2 AS BIGINT)"),
    ("js11_json_set", lambda: J.json_set("props", "$.k", 7, "$.n", F.col("event_type")), "'{\"k\":7,\"n\":\"' || event_type || '\"}'"),
    ("js12_json_insert", lambda: J.json_insert("props", "$.k", 7, "$.n", 1), "'{\"k\":' || regexp_extract(props, '[0-9]+') || ',\"n\":1}'"),
    ("js13_json_replace", lambda: J.json_replace("props", "$.k", 7, "$.n", 1), "'{\"k\":7}'"),
    ("js14_json_remove", lambda: J.json_remove("props", "$.k"), "'{}'"),
    ("js15_paths", lambda: J.json_extract(J.json_object("a", J.json_array(1, F.col("user_id"), "z"), json_args=(1,)), "$.a[#-2]").cast("bigint"), "user_id"),
):
    over(name, "events", "event_id", make, expression)
