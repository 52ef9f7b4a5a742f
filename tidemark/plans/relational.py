"""Scans, projection, predicates, joins, aggregates, windows, ordering and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import relational as R
from .registry import frame, read, sql

# Sources (S*)
sql("s1_full_scan", "SELECT * FROM {nation}")
sql("s2_point_lookup", "SELECT c_custkey, c_name, c_acctbal FROM {customer} WHERE c_custkey = 42")
sql("s3_range_probe", "SELECT o_orderkey, o_totalprice FROM {orders} WHERE o_custkey = 7 AND o_totalprice BETWEEN 1000 AND 200000")
sql("s4_column_pruning", "SELECT l_orderkey, l_linenumber FROM {lineitem} WHERE l_quantity < 3")
sql("s5_fused_filter", "SELECT l_orderkey, l_extendedprice * (1 - l_discount) AS net FROM {lineitem} WHERE l_discount > 0.05 AND l_shipdate >= TIMESTAMP '1995-01-01 00:00:00'")
sql("s6_derived_table", "SELECT t.seg, t.n FROM (SELECT c_mktsegment AS seg, count(*) AS n FROM {customer} GROUP BY c_mktsegment) t WHERE t.n > 1")
sql("s7_cte", "WITH a(k, n) AS (SELECT o_custkey, count(*) FROM {orders} GROUP BY o_custkey), b AS (SELECT k, n FROM a WHERE n > 5) SELECT b.k, b.n, c.c_name FROM b JOIN {customer} c ON c.c_custkey = b.k")
sql("s8_scalar_select", "SELECT 1 + 2 AS three, 'a' || 'b' AS ab, CAST(NULL AS INTEGER) AS nothing")

# Projection and predicates (P*)
sql("p1_projection", "SELECT n.n_name AS name, n.n_nationkey + 100 AS code FROM {nation} n")


@frame("p2_truthy_filter", "SELECT doc_id FROM documents WHERE coalesce(TRY_CAST(nullif(regexp_extract(source, '[0-9]+'), '') AS DOUBLE), 0) <> 0")
def p2(spark, d):
    return read(spark, d, "documents").filter(S.truthy(F.regexp_extract("source", "[0-9]+", 0))).select("doc_id")


@frame("p3_parameters", "SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 1000 ORDER BY c_custkey LIMIT 5")
def p3(spark, d):
    read(spark, d, "customer").createOrReplaceTempView("p3_customer")
    return spark.sql("SELECT c_custkey FROM p3_customer WHERE c_mktsegment = ? AND c_acctbal > ? ORDER BY c_custkey LIMIT ?", args=["BUILDING", 1000, 5])


sql("p4_qualified_columns", "SELECT c.c_custkey, n.n_name FROM {customer} c, {nation} n WHERE c.c_nationkey = n.n_nationkey AND c.c_acctbal < 0")
sql("p5_outer_reference", "SELECT c_custkey FROM {customer} c WHERE c_acctbal > (SELECT avg(c2.c_acctbal) FROM {customer} c2 WHERE c2.c_nationkey = c.c_nationkey)")


@frame("p6_overflow_to_real", "SELECT c_custkey, CAST(9223372036854775800 AS DOUBLE) + c_custkey AS total FROM customer")
def p6(spark, d):
    return read(spark, d, "customer").select("c_custkey", S.add(F.lit(9223372036854775800), F.col("c_custkey")).alias("total"))


@frame("p7_division", "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 3 THEN NULL ELSE CAST(trunc(l_orderkey / (l_linenumber - 3)) AS BIGINT) END AS q FROM lineitem")
def p7(spark, d):
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", S.divide(F.col("l_orderkey"), F.col("l_linenumber").cast("bigint") - 3).alias("q"))


@frame("p8_remainder", "SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN NULL ELSE CAST(CAST(trunc(p_retailprice) AS BIGINT) % (p_size % 5) AS BIGINT) END AS rest FROM part")
def p8(spark, d):
    return read(spark, d, "part").select("p_partkey", S.remainder("p_retailprice", (F.col("p_size") % 5).cast("double")).alias("rest"))


sql("p9_unary_sign", "SELECT s_suppkey, -s_acctbal AS minus, +s_suppkey AS plus FROM {supplier}")


@frame("p10_affinity_compare", "SELECT doc_id FROM documents WHERE doc_id = TRY_CAST(substr(source, 4) AS BIGINT)")
def p10(spark, d):
    return read(spark, d, "documents").filter(S.compare_numeric_to_text("doc_id", F.substring("source", 4, 100))).select("doc_id")


_NULLED = "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_acctbal > 0 END AS a, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_acctbal < 5000 END AS b FROM {customer}"
sql("p11_three_valued_logic", f"SELECT c_custkey, a AND b AS both, a OR b AS either, NOT a AS neither FROM ({_NULLED}) t")
sql("p12_is_null", f"SELECT c_custkey FROM ({_NULLED}) t WHERE a IS NULL AND b IS NOT NULL")


@frame("p13_like", "SELECT n_name FROM nation WHERE translate(n_name, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') LIKE '%n_1%'")
def p13(spark, d):
    return read(spark, d, "nation").filter(S.like("n_name", "%N_1%")).select("n_name")


sql("p14_in_list", "SELECT n_name FROM {nation} WHERE n_regionkey IN (1, 3) AND n_name NOT IN ('FRANCE', 'CHINA')")
sql("p15_between", "SELECT p_partkey FROM {part} WHERE p_size BETWEEN 10 AND 20 AND p_retailprice NOT BETWEEN 1000 AND 1500")
sql("p16_case", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END AS code, CASE WHEN o_totalprice > 200000 THEN 'big' WHEN o_totalprice > 50000 THEN 'mid' END AS size FROM {orders}")


@frame("p17_cast", "SELECT doc_id, CAST(coalesce(nullif(regexp_extract(substr(source, 4) || 'x', '^[0-9]+'), ''), '0') AS BIGINT) AS n, CAST(trunc(n_chars / 7.0) AS BIGINT) AS cut FROM documents")
def p17(spark, d):
    return read(spark, d, "documents").select("doc_id", S.cast_integer(F.concat(F.substring("source", 4, 100), F.lit("x"))).alias("n"), S.cast_integer(F.col("n_chars") / F.lit(7.0), "double").alias("cut"))


sql("p18_concat", "SELECT c_custkey, c_name || '/' || c_mktsegment AS label FROM {customer}")


@frame("p19_collate", "SELECT lower(r_name) AS k, count(*) AS n FROM (SELECT r_name FROM region UNION ALL SELECT lower(r_name) FROM region) GROUP BY lower(r_name)")
def p19(spark, d):
    r = read(spark, d, "region").select("r_name")
    return r.union(r.select(S.lower("r_name"))).groupBy(S.fold("r_name", "NOCASE").alias("k")).agg(F.count(F.lit(1)).alias("n"))


@frame("p21_scalar_subquery", "SELECT c_custkey, (SELECT min(o_orderkey) FROM orders WHERE o_custkey = c_custkey) AS first_order FROM customer")
def p21(spark, d):
    return R.scalar_lookup(read(spark, d, "customer"), read(spark, d, "orders"), "c_custkey", "o_custkey", "o_orderkey", "o_orderkey", "first_order").select("c_custkey", "first_order")


sql("p22_exists", "SELECT c_custkey, EXISTS (SELECT 1 FROM {orders} WHERE o_custkey = c_custkey) AS has_orders FROM {customer}")


@frame("p23_in_subquery_select_list", "SELECT n_nationkey, n_nationkey IN (SELECT CASE WHEN s_nationkey > 20 THEN NULL ELSE s_nationkey END FROM supplier) AS found FROM nation")
def p23(spark, d):
    right = read(spark, d, "supplier").select(F.when(F.col("s_nationkey") <= 20, F.col("s_nationkey")).alias("v"))
    return R.in_subquery(read(spark, d, "nation"), "n_nationkey", right, "v", "found").select("n_nationkey", "found")


sql("p24_blob_literal", "SELECT n_nationkey, hex(X'4142') AS h FROM {nation}", "SELECT n_nationkey, '4142' AS h FROM {nation}")

sql("p24_vector_literal", "SELECT vec_id, round(aggregate(zip_with(embedding, transform(sequence(1, 64), i -> CAST(i AS FLOAT)), (x, y) -> CAST(x AS DOUBLE) * y), CAST(0 AS DOUBLE), (s, x) -> s + x), 4) AS dot FROM {embeddings}",
    "SELECT vec_id, round(list_dot_product(CAST(embedding AS DOUBLE[]), list_transform(range(1, 65), lambda i: CAST(i AS DOUBLE))), 4) AS dot FROM {embeddings}")

# Joins (J*)
sql("j1_inner_equi", "SELECT o.o_orderkey, c.c_name FROM {orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey")
sql("j1_inner_theta", "SELECT a.n_nationkey AS x, b.n_nationkey AS y FROM {nation} a JOIN {nation} b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
sql("j2_left_outer", "SELECT c.c_custkey, count(o.o_orderkey) AS n FROM {customer} c LEFT JOIN {orders} o ON c.c_custkey = o.o_custkey AND o.o_totalprice > 100000 GROUP BY c.c_custkey")
sql("j3_cross", "SELECT r_name, n_name FROM {region}, {nation}")
sql("j4_key_lookup_join", "SELECT l.l_orderkey, l.l_linenumber, p.p_brand FROM {lineitem} l JOIN {part} p ON p.p_partkey = l.l_partkey WHERE l.l_quantity = 50")
sql("j5_semi_join", "SELECT c_custkey FROM {customer} WHERE c_custkey IN (SELECT o_custkey FROM {orders} WHERE o_totalprice > 250000)")
sql("j5_exists_semi_join", "SELECT s_suppkey FROM {supplier} WHERE EXISTS (SELECT 1 FROM {lineitem} WHERE l_suppkey = s_suppkey AND l_quantity > 49)")
sql("j6_anti_join", "SELECT c_custkey FROM {customer} WHERE NOT EXISTS (SELECT 1 FROM {orders} WHERE o_custkey = c_custkey AND o_totalprice > 200000)")
sql("j6_not_in", "SELECT n_nationkey FROM {nation} WHERE n_nationkey NOT IN (SELECT s_nationkey FROM {supplier} WHERE s_acctbal > 5000)")


@frame("j6_not_in_null", "SELECT n_nationkey, n_nationkey NOT IN (SELECT CASE WHEN s_suppkey > 1 THEN s_nationkey END FROM supplier) AS absent FROM nation")
def j6_null(spark, d):
    """With a NULL on the right, NOT IN is false or unknown, never true."""
    right = read(spark, d, "supplier").select(F.when(F.col("s_suppkey") > 1, F.col("s_nationkey")).alias("k"))
    return R.in_subquery(read(spark, d, "nation"), "n_nationkey", right, "k", "inside").select("n_nationkey", (~F.col("inside")).alias("absent"))


sql("j7_multi_way", "SELECT r.r_name, n.n_name, count(*) AS n FROM {region} r JOIN {nation} n ON n.n_regionkey = r.r_regionkey JOIN {customer} c ON c.c_nationkey = n.n_nationkey JOIN {orders} o ON o.o_custkey = c.c_custkey GROUP BY r.r_name, n.n_name")

# Aggregation (A*)
sql("a1_group_by", "SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(l_linenumber) AS BIGINT) AS s, max(l_quantity) AS m FROM {lineitem} GROUP BY l_returnflag, l_linestatus")
sql("a2_global_aggregate", "SELECT count(*) AS n, max(o_totalprice) AS m FROM {orders} WHERE o_orderkey < 0")
sql("a3_count", "SELECT count(*) AS n, count(CASE WHEN c_acctbal > 0 THEN 1 END) AS positive FROM {customer}")
sql("a4_sum", "SELECT CAST(sum(c_custkey) AS BIGINT) AS s, sum(CAST(NULL AS BIGINT)) AS nothing FROM {customer}", "SELECT CAST(sum(c_custkey) AS BIGINT) AS s, CAST(NULL AS BIGINT) AS nothing FROM {customer}")
sql("a5_avg", "SELECT p_brand, avg(p_size) AS mean FROM {part} GROUP BY p_brand")
sql("a6_min_max", "SELECT min(c_name) AS lo, max(c_name) AS hi, min(c_acctbal) AS poor FROM {customer}")


@frame("a7_group_concat", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_nationkey) AS names FROM nation GROUP BY n_regionkey")
def a7(spark, d):
    return R.group_concat(read(spark, d, "nation"), ["n_regionkey"], "n_name", ",", "n_nationkey", "names")


sql("a8_distinct_aggregates", "SELECT o_orderpriority, count(DISTINCT o_custkey) AS customers, CAST(sum(DISTINCT o_custkey) AS BIGINT) AS s FROM {orders} GROUP BY o_orderpriority")
sql("a9_filter_clause", "SELECT o_custkey, count(*) FILTER (WHERE o_orderstatus = 'F') AS done, max(o_totalprice) FILTER (WHERE o_orderstatus = 'O') AS top FROM {orders} GROUP BY o_custkey")
sql("a10_group_by_expression", "SELECT c_nationkey % 4 AS g, count(*) AS n FROM {customer} GROUP BY c_nationkey % 4")
sql("a11_having", "SELECT o_custkey, count(*) AS n FROM {orders} GROUP BY o_custkey HAVING count(*) > (SELECT count(*) / count(DISTINCT o_custkey) FROM {orders})")


@frame("a12_first_row_of_group", "SELECT n_regionkey, count(*) AS n, arg_min(n_name, n_nationkey) AS n_name FROM nation GROUP BY n_regionkey")
def a12(spark, d):
    return R.group_with_first(read(spark, d, "nation"), ["n_regionkey"], [F.count(F.lit(1)).alias("n")], ["n_name"], "n_nationkey")


@frame("a13_distinct_collated", "SELECT arg_min(s, k) AS s FROM (SELECT CASE WHEN n_nationkey % 2 = 0 THEN n_name ELSE lower(n_name) END AS s, n_nationkey AS k FROM nation UNION ALL SELECT n_name, n_nationkey + 100 FROM nation) GROUP BY lower(s)")
def a13(spark, d):
    n = read(spark, d, "nation")
    one = n.select(F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name")).otherwise(S.lower("n_name")).alias("s"), F.col("n_nationkey").alias("k"))
    return R.distinct(one.union(n.select("n_name", F.col("n_nationkey") + 100)), ["s"], "k", {"s": "NOCASE"})


# Windows (W*)
_W = "OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey)"
for name, expression in {
    "w1_row_number": f"row_number() {_W}", "w2_rank": "rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority)", "w3_dense_rank": "dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority)",
    "w4_ntile": f"ntile(3) {_W}", "w5_lag": f"lag(o_totalprice, 2, 0.0) {_W}", "w6_lead": f"lead(o_orderkey) {_W}", "w7_first_value": f"first_value(o_orderkey) {_W}",
    "w8_last_value": "last_value(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)",
    "w9_nth_value": "nth_value(o_orderkey, 2) OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)",
    "w10_aggregates_over": "count(*) OVER (PARTITION BY o_custkey)", "w13_rows_frame": "max(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING)",
    "w14_default_frame": "count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderpriority)", "w12_filter_over": "count(*) FILTER (WHERE o_orderstatus = 'F') OVER (PARTITION BY o_custkey)",
}.items():
    spark_text = expression if name != "w12_filter_over" else "count(CASE WHEN o_orderstatus = 'F' THEN 1 END) OVER (PARTITION BY o_custkey)"
    wide = "CAST({} AS BIGINT)".format if name[:3] in ("w1_", "w2_", "w3_", "w4_") else str
    sql(name, f"SELECT o_orderkey, {wide(spark_text)} AS v FROM {{orders}}", f"SELECT o_orderkey, {wide(expression)} AS v FROM {{orders}}")


@frame("w5_lag_per_row_offset", "SELECT a.o_orderkey, b.o_totalprice AS v FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders) a LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders) b ON a.o_custkey = b.o_custkey AND b.rn = a.rn - a.o_orderkey % 3")
def w5b(spark, d):
    return R.lag_by_column(read(spark, d, "orders"), ["o_custkey"], ["o_orderkey"], "o_totalprice", F.col("o_orderkey") % 3, "v").select("o_orderkey", "v")


@frame("w11_group_concat_over", "SELECT n_nationkey, string_agg(n_name, '|') OVER (PARTITION BY n_regionkey ORDER BY n_nationkey ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS v FROM nation")
def w11(spark, d):
    w = Window.partitionBy("n_regionkey").orderBy("n_nationkey").rowsBetween(-1, 0)
    return read(spark, d, "nation").select("n_nationkey", R.group_concat_over("n_name", "|", w).alias("v"))


sql("w15_named_window", "SELECT o_orderkey, CAST(rank() OVER w AS BIGINT) AS r, count(*) OVER w AS n FROM {orders} WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)")
sql("w15_chained_windows", "SELECT o_orderkey, CAST(rank() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS BIGINT) AS r, count(*) OVER w AS n FROM {orders} WINDOW w AS (PARTITION BY o_custkey)", "SELECT o_orderkey, CAST(rank() OVER (w ORDER BY o_orderkey) AS BIGINT) AS r, count(*) OVER w AS n FROM {orders} WINDOW w AS (PARTITION BY o_custkey)")
sql("w10_numeric_aggregates_over", "SELECT l_orderkey, l_linenumber, CAST(sum(l_quantity) OVER w AS DOUBLE) AS s, round(avg(l_quantity) OVER w, 6) AS a, min(l_tax) OVER w AS lo, max(l_tax) OVER w AS hi FROM {lineitem} WINDOW w AS (PARTITION BY l_orderkey)")
sql("w16_window_over_groups", "SELECT o_custkey, count(*) AS n, CAST(rank() OVER (ORDER BY count(*) DESC) AS BIGINT) AS r FROM {orders} GROUP BY o_custkey")


@frame("w17_collated_partition", "SELECT k, row_number() OVER (PARTITION BY lower(s) ORDER BY k) AS rn FROM (SELECT n_nationkey AS k, r_name AS s FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 2 = 0 UNION ALL SELECT n_nationkey, lower(r_name) FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 2 = 1)")
def w17(spark, d):
    both = read(spark, d, "nation").join(read(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    named = both.select(F.col("n_nationkey").alias("k"), F.when(F.col("n_nationkey") % 2 == 0, F.col("r_name")).otherwise(S.lower("r_name")).alias("s"))
    return named.select("k", F.row_number().over(Window.partitionBy(S.fold("s", "NOCASE")).orderBy("k")).cast("bigint").alias("rn"))


# Ordering and limits (O*)
sql("o1_order_by", "SELECT p_partkey, p_brand FROM {part} ORDER BY p_brand DESC, p_partkey LIMIT 20")
sql("o2_nulls_last", "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_acctbal END AS b FROM {customer} ORDER BY b ASC NULLS LAST, c_custkey LIMIT 30")


@frame("o3_order_by_collated", "SELECT n_nationkey FROM nation ORDER BY lower(n_name), n_nationkey LIMIT 7")
def o3(spark, d):
    return read(spark, d, "nation").orderBy(S.fold("n_name", "NOCASE"), "n_nationkey").limit(7).select("n_nationkey")


@frame("o4_limit_forms", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 4 OFFSET 6")
def o4(spark, d):
    return R.limited(read(spark, d, "orders").orderBy("o_orderkey"), 4, 6).select("o_orderkey")


sql("o5_offset_past_end", "SELECT n_nationkey FROM {nation} ORDER BY n_nationkey LIMIT 5 OFFSET 1000")
sql("o6_top_k", "SELECT l_orderkey, l_linenumber, l_extendedprice FROM {lineitem} ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 25")
sql("o7_limit_only", "SELECT count(*) AS n FROM (SELECT l_orderkey FROM {lineitem} LIMIT 10) t")

# Set operations (U*)
sql("u1_union_all", "SELECT c_nationkey AS k FROM {customer} UNION ALL SELECT s_nationkey FROM {supplier}")
sql("u2_union", "SELECT c_nationkey AS k FROM {customer} UNION SELECT s_nationkey FROM {supplier}")
sql("u3_intersect", "SELECT c_nationkey AS k FROM {customer} INTERSECT SELECT s_nationkey FROM {supplier}")
sql("u4_except", "SELECT n_nationkey AS k FROM {nation} EXCEPT SELECT s_nationkey FROM {supplier} WHERE s_acctbal > 5000")


@frame("u5_left_associative_chain", "SELECT * FROM ((SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier) INTERSECT SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
def u5(spark, d):
    c, s, n = read(spark, d, "customer").select(F.col("c_nationkey").alias("k")), read(spark, d, "supplier").select("s_nationkey"), read(spark, d, "nation").filter("n_regionkey = 1").select("n_nationkey")
    return R.compound(c, ("union", s), ("intersect", n))


@frame("u2_union_collated", "SELECT arg_max(s, arm * 1000 + k) AS s FROM (SELECT n_name AS s, 0 AS arm, n_nationkey AS k FROM nation UNION ALL SELECT lower(n_name), 1, n_nationkey FROM nation WHERE n_regionkey = 2) GROUP BY lower(s)")
def u2c(spark, d):
    n = read(spark, d, "nation")
    return R.union_collated(n.select(F.col("n_name").alias("s"), F.col("n_nationkey").alias("k")), n.filter("n_regionkey = 2").select(S.lower("n_name").alias("s"), F.col("n_nationkey").alias("k")), "s", "NOCASE", "k").select("s")


sql("u6_compound_order_limit", "SELECT c_nationkey AS k FROM {customer} UNION SELECT n_nationkey FROM {nation} ORDER BY k DESC LIMIT 6 OFFSET 2")

# Headline analytics
sql("h1_pricing_summary", "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS net, round(avg(l_discount), 6) AS disc, count(*) AS n FROM {lineitem} WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus")
sql("h2_join_users_posts", "SELECT c.c_mktsegment, count(*) AS n, round(sum(l.l_extendedprice), 2) AS total FROM {customer} c JOIN {orders} o ON o.o_custkey = c.c_custkey JOIN {lineitem} l ON l.l_orderkey = o.o_orderkey GROUP BY c.c_mktsegment")
