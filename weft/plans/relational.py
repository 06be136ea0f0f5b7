"""Relational queries over the star schema: analytic shapes, joins, aggregates, windows, order and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.plans.base import Catalog, table

_C = Catalog()
QUERIES, ORACLE = _C.queries, _C.oracle
query, sql = _C.query, _C.sql


@query(
    "tpch_q1",
    """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty,
       round(sum(l_extendedprice), 2) AS sum_base_price,
       round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price,
       round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS sum_charge,
       round(avg(l_quantity), 4) AS avg_qty, round(avg(l_extendedprice), 4) AS avg_price,
       round(avg(l_discount), 6) AS avg_disc, count(*) AS count_order
       FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02'
       GROUP BY l_returnflag, l_linestatus""",
)
def tpch_q1(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").filter(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    disc = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return l.groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"),
        F.round(F.sum("l_extendedprice"), 2).alias("sum_base_price"),
        F.round(F.sum(disc), 2).alias("sum_disc_price"),
        F.round(F.sum(disc * (1 + F.col("l_tax"))), 2).alias("sum_charge"),
        F.round(F.avg("l_quantity"), 4).alias("avg_qty"),
        F.round(F.avg("l_extendedprice"), 4).alias("avg_price"),
        F.round(F.avg("l_discount"), 6).alias("avg_disc"),
        F.count(F.lit(1)).alias("count_order"),
    ).orderBy("l_returnflag", "l_linestatus")


# Analytic shapes. Columns that these tables lack have stand-ins.
sql("tpch_q3", """
SELECT l_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, o_orderdate, o_orderpriority
FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
WHERE c_mktsegment = 'BUILDING' AND o_orderdate < TIMESTAMP '1996-03-15 00:00:00' AND l_shipdate > TIMESTAMP '1996-03-15 00:00:00'
GROUP BY l_orderkey, o_orderdate, o_orderpriority ORDER BY revenue DESC, l_orderkey LIMIT 10""")
sql("tpch_q4", """
SELECT o_orderpriority, count(*) AS order_count FROM orders
WHERE o_orderdate >= TIMESTAMP '1996-07-01 00:00:00' AND o_orderdate < TIMESTAMP '1996-10-01 00:00:00'
  AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_shipdate > o_orderdate)
GROUP BY o_orderpriority""")
sql("tpch_q5", """
SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
FROM customer, orders, lineitem, supplier, nation, region
WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND l_suppkey = s_suppkey AND c_nationkey = s_nationkey
  AND s_nationkey = n_nationkey AND n_regionkey = r_regionkey AND r_name = 'ASIA'
GROUP BY n_name""")
sql("tpch_q6", """
SELECT round(sum(l_extendedprice * l_discount), 2) AS revenue FROM lineitem
WHERE l_shipdate >= TIMESTAMP '1996-01-01 00:00:00' AND l_shipdate < TIMESTAMP '1997-01-01 00:00:00'
  AND l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24""")
sql("tpch_q7", """
SELECT supp_nation, cust_nation, l_year, round(sum(volume), 0) AS revenue FROM (
  SELECT n1.n_name AS supp_nation, n2.n_name AS cust_nation, CAST(extract(year FROM l_shipdate) AS INT) AS l_year,
         l_extendedprice * (1 - l_discount) AS volume
  FROM supplier JOIN lineitem ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey
  JOIN customer ON c_custkey = o_custkey JOIN nation n1 ON s_nationkey = n1.n_nationkey JOIN nation n2 ON c_nationkey = n2.n_nationkey
  WHERE n1.n_regionkey = 1 AND n2.n_regionkey = 2) AS shipping
GROUP BY supp_nation, cust_nation, l_year""")
sql("tpch_q8", """
SELECT o_year, round(sum(CASE WHEN nation = 'NATION_3' THEN volume ELSE 0 END) / sum(volume), 6) AS mkt_share FROM (
  SELECT CAST(extract(year FROM o_orderdate) AS INT) AS o_year, l_extendedprice * (1 - l_discount) AS volume, n2.n_name AS nation
  FROM part JOIN lineitem ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey JOIN nation n1 ON c_nationkey = n1.n_nationkey JOIN nation n2 ON s_nationkey = n2.n_nationkey
  WHERE n1.n_regionkey = 1) AS all_nations
GROUP BY o_year""")
sql("tpch_q10", """
SELECT c_custkey, c_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, c_acctbal, n_name
FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN nation ON c_nationkey = n_nationkey
WHERE l_returnflag = 'R' GROUP BY c_custkey, c_name, c_acctbal, n_name ORDER BY revenue DESC, c_custkey LIMIT 20""")
sql("tpch_q12", """
SELECT l_linestatus, sum(CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END) AS high_line_count,
       sum(CASE WHEN o_orderpriority NOT IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END) AS low_line_count
FROM orders JOIN lineitem ON o_orderkey = l_orderkey
WHERE l_shipdate >= TIMESTAMP '1996-01-01 00:00:00' AND l_shipdate < TIMESTAMP '1997-01-01 00:00:00' GROUP BY l_linestatus""")
sql("tpch_q13", """
SELECT c_count, count(*) AS custdist FROM (
  SELECT c_custkey, count(o_orderkey) AS c_count FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus <> 'P'
  GROUP BY c_custkey) AS c_orders GROUP BY c_count""")
sql("tpch_q14", """
SELECT round(100.0 * sum(CASE WHEN p_type LIKE 'PROMO%' THEN l_extendedprice * (1 - l_discount) ELSE 0 END) / sum(l_extendedprice * (1 - l_discount)), 6) AS promo_revenue
FROM lineitem JOIN part ON l_partkey = p_partkey""")
sql("tpch_q15", """
WITH revenue AS (SELECT l_suppkey AS supplier_no, round(sum(l_extendedprice * (1 - l_discount)), 2) AS total_revenue FROM lineitem GROUP BY l_suppkey)
SELECT s_suppkey, s_name, total_revenue FROM supplier JOIN revenue ON s_suppkey = supplier_no
WHERE total_revenue = (SELECT max(total_revenue) FROM revenue)""")
sql("tpch_q17", """
SELECT round(sum(l_extendedprice) / 7.0, 4) AS avg_yearly FROM lineitem JOIN part ON p_partkey = l_partkey
WHERE p_brand = 'Brand#4' AND l_quantity < (SELECT 0.8 * avg(l2.l_quantity) FROM lineitem l2 WHERE l2.l_partkey = p_partkey)""")
sql("tpch_q18", """
SELECT c_name, c_custkey, o_orderkey, o_totalprice, round(sum(l_quantity), 2) AS qty
FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey
WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING sum(l_quantity) > 150)
GROUP BY c_name, c_custkey, o_orderkey, o_totalprice ORDER BY o_totalprice DESC, o_orderkey LIMIT 100""")
sql("tpch_q19", """
SELECT round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN part ON p_partkey = l_partkey
WHERE (p_size BETWEEN 1 AND 15 AND l_quantity BETWEEN 1 AND 11) OR (p_size BETWEEN 16 AND 30 AND l_quantity BETWEEN 10 AND 20)
   OR (p_size > 30 AND l_quantity BETWEEN 20 AND 30)""")
sql("tpch_q21", """
SELECT s_name, count(*) AS numwait FROM supplier JOIN lineitem l1 ON s_suppkey = l1.l_suppkey JOIN orders ON o_orderkey = l1.l_orderkey
WHERE o_orderstatus = 'F' AND l1.l_returnflag = 'R'
  AND EXISTS (SELECT 1 FROM lineitem l2 WHERE l2.l_orderkey = l1.l_orderkey AND l2.l_suppkey <> l1.l_suppkey)
  AND NOT EXISTS (SELECT 1 FROM lineitem l3 WHERE l3.l_orderkey = l1.l_orderkey AND l3.l_suppkey <> l1.l_suppkey AND l3.l_returnflag = 'R')
GROUP BY s_name""")
sql("tpch_q22", """
SELECT c_nationkey, count(*) AS numcust, round(sum(c_acctbal), 2) AS totacctbal FROM customer
WHERE c_acctbal > (SELECT avg(c_acctbal) FROM customer WHERE c_acctbal > 0)
  AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000) GROUP BY c_nationkey""")
# Parts by supplier, with the least unit price (whole cents) and all quantity of their lines, since these tables have no
# such relation.
_PARTSUPP = """WITH partsupp AS (SELECT l_partkey AS ps_partkey, l_suppkey AS ps_suppkey, min(CAST(floor(100 * l_extendedprice / l_quantity) AS DOUBLE)) / 100 AS ps_supplycost,
  sum(l_quantity) AS ps_availqty FROM lineitem GROUP BY l_partkey, l_suppkey)"""
sql("tpch_q2", f"""{_PARTSUPP}
SELECT s_acctbal, s_name, n_name, p_partkey, p_brand FROM part, supplier, partsupp, nation, region
WHERE p_partkey = ps_partkey AND s_suppkey = ps_suppkey AND p_size <= 15 AND p_type = 'STANDARD' AND s_nationkey = n_nationkey
  AND n_regionkey = r_regionkey AND r_name = 'EUROPE'
  AND ps_supplycost = (SELECT min(ps_supplycost) FROM partsupp, supplier, nation, region
    WHERE p_partkey = ps_partkey AND s_suppkey = ps_suppkey AND s_nationkey = n_nationkey AND n_regionkey = r_regionkey AND r_name = 'EUROPE')
ORDER BY s_acctbal DESC, n_name, s_name, p_partkey LIMIT 100""")
sql("tpch_q9", f"""{_PARTSUPP}
SELECT nation, o_year, round(sum(amount), 0) AS sum_profit FROM (
  SELECT n_name AS nation, CAST(extract(year FROM o_orderdate) AS INT) AS o_year,
         l_extendedprice * (1 - l_discount) - ps_supplycost * l_quantity AS amount
  FROM part JOIN lineitem ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey
  JOIN partsupp ON ps_suppkey = l_suppkey AND ps_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey
  JOIN nation ON s_nationkey = n_nationkey WHERE p_name LIKE '%ring%') AS profit
GROUP BY nation, o_year""")
sql("tpch_q11", f"""{_PARTSUPP}, held AS (SELECT ps_partkey, ps_supplycost * ps_availqty AS worth
  FROM partsupp JOIN supplier ON ps_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey = 3)
SELECT ps_partkey, round(sum(worth), 2) AS total FROM held GROUP BY ps_partkey
HAVING sum(worth) > (SELECT sum(worth) * 0.001 FROM held)""")
sql("tpch_q16", f"""{_PARTSUPP}
SELECT p_brand, p_type, p_size, count(DISTINCT ps_suppkey) AS supplier_cnt FROM partsupp JOIN part ON p_partkey = ps_partkey
WHERE p_brand <> 'Brand#4' AND p_type NOT LIKE 'MEDIUM%' AND p_size IN (3, 9, 14, 19, 23, 36, 45, 49)
  AND ps_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0)
GROUP BY p_brand, p_type, p_size""")
sql("tpch_q20", f"""{_PARTSUPP}
SELECT s_suppkey, s_name FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey = 1 AND s_suppkey IN (
  SELECT ps_suppkey FROM partsupp WHERE ps_partkey IN (SELECT p_partkey FROM part WHERE p_name LIKE 'small%')
    AND ps_availqty < 2 * (SELECT sum(l_quantity) FROM lineitem WHERE l_partkey = ps_partkey AND l_suppkey = ps_suppkey
      AND l_shipdate >= TIMESTAMP '1996-01-01 00:00:00' AND l_shipdate < TIMESTAMP '1998-01-01 00:00:00'))""")

# Joins.
sql("join_inner", "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
sql("join_left", "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
sql("join_right", "SELECT c_custkey, count(o_orderkey) AS n FROM orders RIGHT JOIN customer ON c_custkey = o_custkey GROUP BY c_custkey")
sql("join_full", """SELECT c.k AS ck, s.k AS sk, c.n AS cn, s.n AS sn FROM (SELECT c_nationkey AS k, count(*) AS n FROM customer WHERE c_acctbal > 5000 AND c_nationkey < 20 GROUP BY c_nationkey) c
FULL JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier WHERE s_nationkey > 4 GROUP BY s_nationkey) s ON c.k = s.k""")
sql("join_cross", "SELECT r_name, n_name FROM region CROSS JOIN nation")
sql("join_natural", "SELECT r_regionkey, r_name, n FROM region NATURAL JOIN (SELECT n_regionkey AS r_regionkey, count(*) AS n FROM nation GROUP BY n_regionkey) AS x")
sql("join_using", "SELECT k, a.n AS n_customers, b.n AS n_suppliers FROM (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY c_nationkey) a JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY s_nationkey) b USING (k)")
sql("join_theta", "SELECT a.n_name AS a_name, b.n_name AS b_name FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
sql("join_theta_left", "SELECT a.r_name AS a_name, b.r_name AS b_name FROM region a LEFT JOIN region b ON a.r_regionkey < b.r_regionkey")
sql("join_comma", "SELECT n_name, r_name FROM nation, region WHERE n_regionkey = r_regionkey AND r_name <> 'ASIA'")
sql("join_semi", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)")
sql("join_anti", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
sql("join_not_in_null", "SELECT n_name FROM nation WHERE n_nationkey NOT IN (SELECT CASE WHEN s_nationkey > 3 THEN s_nationkey END FROM supplier)")
sql("join_not_in", "SELECT n_name FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 3000)")
sql("join_null_safe", "SELECT a.k AS k, count(*) AS n FROM (SELECT nullif(n_regionkey, 2) AS k FROM nation) a JOIN (SELECT nullif(r_regionkey, 2) AS k FROM region) b ON a.k IS NOT DISTINCT FROM b.k GROUP BY a.k")
sql("join_lateral", """SELECT r_name, x.n_name AS first_nation FROM region, LATERAL (SELECT n_name FROM nation WHERE n_regionkey = r_regionkey ORDER BY n_name LIMIT 1) AS x""")
sql("join_lateral_left", """SELECT r_name, x.n AS n FROM region LEFT JOIN LATERAL (SELECT count(*) AS n FROM nation WHERE n_regionkey = r_regionkey AND n_nationkey > 10) AS x ON true""")
sql("join_interval", """SELECT count(*) AS n, sum(a.event_id) AS s FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL '1' HOUR""")
sql("sub_scalar", "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT 1.9 * avg(o_totalprice) FROM orders)")
sql("sub_in", "SELECT n_name FROM nation WHERE n_regionkey IN (SELECT r_regionkey FROM region WHERE r_name LIKE 'A%')")
sql("sub_correlated", "SELECT s_suppkey, (SELECT count(*) FROM lineitem WHERE l_suppkey = s_suppkey) AS n FROM supplier")
sql("with_cte", "WITH a AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey), b AS (SELECT max(n) AS m FROM a) SELECT o_custkey, n FROM a JOIN b ON n = m")
sql("in_list_long", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey IN (" + ", ".join(map(str, range(1, 200, 7))) + ")")
sql("values_rows", "SELECT * FROM (VALUES (1, 'a'), (2, 'b'), (3, NULL)) AS t(id, name)")

# Aggregates.
sql("agg_having", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12")
sql("agg_distinct", "SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers, sum(DISTINCT l_linenumber) AS s FROM lineitem GROUP BY l_returnflag")
sql("agg_filter", "SELECT o_orderstatus, count(*) FILTER (WHERE o_totalprice > 100000) AS big, count(*) AS n FROM orders GROUP BY o_orderstatus")
sql("agg_rollup", "SELECT l_returnflag, l_linestatus, grouping(l_returnflag) AS g1, grouping(l_linestatus) AS g2, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
sql("agg_cube", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
sql("agg_grouping_sets", "SELECT l_returnflag, l_linestatus, grouping_id(l_returnflag, l_linestatus) AS gid, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), (l_linestatus), ())".replace("grouping_id(l_returnflag, l_linestatus)", "grouping_id()"),
    "SELECT l_returnflag, l_linestatus, grouping_id(l_returnflag, l_linestatus) AS gid, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), (l_linestatus), ())")
sql("agg_stats", """SELECT l_linestatus, round(stddev_pop(l_quantity), 6) AS sp, round(stddev_samp(l_quantity), 6) AS ss, round(stddev(l_quantity), 6) AS sd,
round(var_pop(l_quantity), 6) AS vp, round(var_samp(l_quantity), 6) AS vs, round(variance(l_quantity), 6) AS va FROM lineitem GROUP BY l_linestatus""")
sql("agg_regression", """SELECT l_linestatus, round(covar_pop(l_quantity, l_discount), 6) AS cp, round(covar_samp(l_quantity, l_discount), 6) AS cs, regr_count(l_quantity, l_discount) AS rc,
round(regr_sxx(l_quantity, l_discount), 4) AS sxx, round(regr_syy(l_quantity, l_discount), 2) AS syy FROM lineitem GROUP BY l_linestatus""")
sql("agg_bits", "SELECT l_returnflag, bit_and(l_orderkey) AS ba, bit_or(l_orderkey) AS bo FROM lineitem GROUP BY l_returnflag")
sql("agg_min_max", "SELECT o_orderpriority, min(o_totalprice) AS lo, max(o_totalprice) AS hi, min(o_orderdate) AS d0, max(o_orderdate) AS d1 FROM orders GROUP BY o_orderpriority")
sql("agg_sum0", "SELECT n_nationkey, coalesce(sum(CASE WHEN c_acctbal > 9000 THEN 1 END), 0) AS n FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_nationkey")
sql("agg_count_columns", "SELECT count(a, b) AS n, count(*) AS m FROM (SELECT nullif(n_regionkey, 1) AS a, nullif(n_nationkey, 3) AS b FROM nation) AS x",
    "SELECT count(CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN 1 END) AS n, count(*) AS m FROM (SELECT nullif(n_regionkey, 1) AS a, nullif(n_nationkey, 3) AS b FROM nation) AS x")
sql("agg_null_key", "SELECT nullif(n_regionkey, 2) AS k, count(*) AS n FROM nation GROUP BY nullif(n_regionkey, 2)")
sql("agg_within_group", "SELECT r_regionkey, listagg(n_name, ',') WITHIN GROUP (ORDER BY n_name DESC) AS names FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_regionkey",
    "SELECT r_regionkey, string_agg(n_name, ',' ORDER BY n_name DESC) AS names FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_regionkey")
sql("agg_any_single", "SELECT n_regionkey, any_value(n_regionkey) AS a, (SELECT max(r_regionkey) FROM region) AS s FROM nation GROUP BY n_regionkey")
sql("agg_no_rows", "SELECT count(*) AS n, sum(l_quantity) AS s, min(l_quantity) AS m FROM lineitem WHERE l_quantity < 0")
sql("agg_approx_distinct", "SELECT o_orderstatus, CASE WHEN abs(approx_count_distinct(o_custkey) - count(DISTINCT o_custkey)) <= 0.15 * count(DISTINCT o_custkey) THEN 1 ELSE 0 END AS close_enough FROM orders GROUP BY o_orderstatus",
    "SELECT o_orderstatus, 1 AS close_enough FROM orders GROUP BY o_orderstatus")
sql("agg_distinct_rows", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")


@query("agg_group_id", """SELECT l_returnflag, l_linestatus, g AS group_id, count(*) AS n FROM
(SELECT l_returnflag, l_linestatus, 0 AS g FROM lineitem UNION ALL SELECT l_returnflag, l_linestatus, 1 FROM lineitem) GROUP BY l_returnflag, l_linestatus, g""")
def agg_group_id(spark, sf_dir):
    """GROUP_ID numbers the repeats of a grouping set: the set is aggregated once and its rows repeated."""
    g = table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"))
    return g.select("l_returnflag", "l_linestatus", F.explode(F.array(F.lit(0), F.lit(1))).alias("group_id"), "n")


@query("agg_collect_fusion", """SELECT r AS n_regionkey, list_sort(list(k)) AS keys, list_sort(flatten(list(ks))) AS fused FROM
(SELECT n_regionkey AS r, n_nationkey AS k, [n_nationkey, n_nationkey + 100] AS ks FROM nation) GROUP BY r""")
def agg_collect_fusion(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    return n.groupBy("n_regionkey").agg(
        F.array_sort(F.collect_list("n_nationkey")).alias("keys"),
        F.array_sort(F.flatten(F.collect_list(F.array("n_nationkey", F.col("n_nationkey") + 100)))).alias("fused"),
    )


# Windows.
_W = "PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey"
for _name, _call in {
    "row_number": "row_number()", "rank": "rank()", "dense_rank": "dense_rank()", "ntile": "ntile(3)",
    "lead": "lead(o_orderkey, 1, -1)", "lag": "lag(o_orderkey)", "first_value": "first_value(o_orderkey)",
    "last_value": "last_value(o_orderkey)", "nth_value": "nth_value(o_orderkey, 2)", "count": "count(*)",
}.items():
    sql(f"win_{_name}", f"SELECT o_orderkey, CAST({_call} OVER ({_W}) AS BIGINT) AS v FROM orders")
for _name in ("percent_rank", "cume_dist"):
    sql(f"win_{_name}", f"SELECT o_orderkey, round({_name}() OVER ({_W}), 9) AS v FROM orders")
for _name, _frame in {
    "rows_running": "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW", "rows_moving": "ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING",
    "rows_after": "ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING", "rows_whole": "ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING",
}.items():
    sql(f"win_{_name}", f"SELECT o_orderkey, round(sum(o_totalprice) OVER ({_W} {_frame}), 2) AS v FROM orders")
sql("win_range_number", "SELECT p_partkey, count(*) OVER (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS v FROM part")
sql("win_range_interval", "SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderdate RANGE BETWEEN INTERVAL '30' DAY PRECEDING AND CURRENT ROW) AS v FROM orders")
sql("win_several", """SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice DESC, o_orderkey) AS a,
count(*) OVER (PARTITION BY o_custkey) AS b, round(max(o_totalprice) OVER (PARTITION BY o_orderpriority), 2) AS c FROM orders""")
sql("win_named", "SELECT o_orderkey, sum(1) OVER w AS a, min(o_orderkey) OVER w AS b FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)")
sql("win_regr_count", "SELECT l_orderkey, l_linenumber, regr_count(l_quantity, l_discount) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS v FROM lineitem")
sql("win_top_per_group", "SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) AS x WHERE rn <= 2")

# Order, limit and set operations.
sql("sort_nulls", "SELECT k, row_number() OVER (ORDER BY k DESC NULLS FIRST, id) AS a, row_number() OVER (ORDER BY k ASC NULLS LAST, id) AS b FROM (SELECT n_nationkey AS id, nullif(n_regionkey, 2) AS k FROM nation) AS x")
sql("sort_limit_offset", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 5")
sql("sort_top_k", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 25")
_A, _B = "SELECT c_nationkey AS k FROM customer", "SELECT s_nationkey AS k FROM supplier WHERE s_acctbal > 8000"
for _name, _op in {"union": "UNION", "union_all": "UNION ALL", "intersect": "INTERSECT", "intersect_all": "INTERSECT ALL", "except": "EXCEPT", "except_all": "EXCEPT ALL"}.items():
    sql(f"set_{_name}", f"{_A} {_op} {_B}")


@query("sample_seeded")
def sample_seeded(spark, sf_dir):
    """TABLESAMPLE BERNOULLI (10) REPEATABLE (7): a sampling operator by nature."""
    return table(spark, sf_dir, "orders").sample(0.1, 7)


@query("win_percent_of_group", """SELECT n_name, round(100.0 * c / sum(c) OVER (PARTITION BY n_regionkey), 6) AS share FROM
(SELECT n_name, n_regionkey, count(*) AS c FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY n_name, n_regionkey)""")
def win_percent_of_group(spark, sf_dir):
    from pyspark.sql import Window

    c = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("c"))
    n = table(spark, sf_dir, "nation").join(c, F.col("c_nationkey") == F.col("n_nationkey"))
    return n.select("n_name", F.round(F.lit(100.0) * F.col("c") / F.sum("c").over(Window.partitionBy("n_regionkey")), 6).alias("share"))
