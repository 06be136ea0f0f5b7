"""Queries in the dialect, written anew for Spark."""

from __future__ import annotations

import re

from weft.operators import sql
from weft.plans.base import Catalog, table
from weft.sources.catalog import TABLES

_C = Catalog()
QUERIES, ORACLE = _C.queries, _C.oracle


def _sql(name: str, text: str, oracle: str) -> None:
    names = [t for t in TABLES if re.search(rf"\b{t}\b", text)]
    _C.query(f"sql_{name}", oracle)(lambda spark, sf_dir: sql.run(spark, text, lambda n: table(spark, sf_dir, n), names))


_sql("escapes", "SELECT n_nationkey, {fn UCASE({fn CONCAT(n_name, 'x')})} AS u, {fn MOD(n_nationkey, 7)} AS m, {fn LENGTH(n_name)} AS l, {fn TRUNCATE(n_nationkey / 2.0)} AS t FROM nation WHERE {d '2020-01-02'} > DATE '2020-01-01'",
     "SELECT n_nationkey, upper(n_name || 'x') AS u, n_nationkey % 7 AS m, length(n_name) AS l, trunc(n_nationkey / 2.0) AS t FROM nation")
_sql("quantified_some", "SELECT n_name FROM nation WHERE n_nationkey < SOME (SELECT s_nationkey FROM supplier WHERE s_acctbal > 9000) AND n_nationkey = ANY (SELECT s_nationkey FROM supplier)",
     "SELECT n_name FROM nation WHERE n_nationkey < (SELECT max(s_nationkey) FROM supplier WHERE s_acctbal > 9000) AND n_nationkey IN (SELECT s_nationkey FROM supplier)")
_sql("quantified_all", "SELECT n_name FROM nation WHERE n_nationkey >= ALL (SELECT r_regionkey FROM region) AND n_nationkey <> ALL (SELECT r_regionkey + 5 FROM region) AND n_nationkey > ALL (SELECT r_regionkey FROM region WHERE r_regionkey > 100)",
     "SELECT n_name FROM nation WHERE n_nationkey >= (SELECT max(r_regionkey) FROM region) AND n_nationkey NOT IN (SELECT r_regionkey + 5 FROM region)")
_sql("fetch", "SELECT o_orderkey FROM orders ORDER BY o_orderkey OFFSET 5 ROWS FETCH NEXT 10 ROWS ONLY", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 10 OFFSET 5")
_sql("symmetric", "SELECT p_partkey FROM part WHERE p_size BETWEEN SYMMETRIC 20 AND 5 AND p_name NOT SIMILAR TO '(red|blue) %'", "SELECT p_partkey FROM part WHERE p_size BETWEEN 5 AND 20 AND p_name NOT LIKE 'red %' AND p_name NOT LIKE 'blue %'")
_sql("json_tests", "SELECT event_id, props IS JSON OBJECT AS o, props IS NOT JSON ARRAY AS a, event_type IS JSON AS j FROM events", "SELECT event_id, true AS o, true AS a, false AS j FROM events")
_sql("periods", "SELECT p_partkey, (p_size, 20) OVERLAPS (25, 30) AS o, (p_size, 20) PRECEDES (25, 30) AS p, (10, 40) CONTAINS (p_size, 20) AS c FROM part", "SELECT p_partkey, greatest(p_size, 20) >= 25 AND 30 >= least(p_size, 20) AS o, greatest(p_size, 20) <= 25 AS p, 10 <= least(p_size, 20) AND 40 >= greatest(p_size, 20) AS c FROM part")
_sql("multisets", "SELECT k, array_sort(a MULTISET UNION b) AS u, array_sort(a MULTISET EXCEPT b) AS e, array_sort(a MULTISET INTERSECT b) AS i, k MEMBER OF b AS m, a IS A SET AS s, b IS NOT EMPTY AS n FROM (SELECT n_nationkey AS k, array(1, 1, 2) AS a, array(1, 3) AS b FROM nation) AS x",
     "SELECT n_nationkey AS k, [1, 1, 1, 2, 3] AS u, [1, 2] AS e, [1] AS i, n_nationkey IN (1, 3) AS m, false AS s, true AS n FROM nation")
_sql("tumble", "SELECT STREAM TUMBLE_START(ts, INTERVAL '1' HOUR) AS s, event_type, count(*) AS n FROM events GROUP BY TUMBLE(ts, INTERVAL '1' HOUR), event_type", "SELECT time_bucket(INTERVAL '1 hour', ts) AS s, event_type, count(*) AS n FROM events GROUP BY 1, 2")
_sql("session", "SELECT user_id, SESSION_START(ts, INTERVAL '2' HOUR) AS s, SESSION_END(ts, INTERVAL '2' HOUR) AS e, count(*) AS n FROM events GROUP BY user_id, SESSION(ts, INTERVAL '2' HOUR)",
     "WITH a AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL '2 hours' THEN 0 ELSE 1 END AS f FROM events), b AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM a) SELECT user_id, min(ts) AS s, max(ts) + INTERVAL '2 hours' AS e, count(*) AS n FROM b GROUP BY user_id, g")

_SOME_NULL = "(SELECT n_nationkey AS k, CASE WHEN n_nationkey % 3 > 0 THEN n_nationkey % 5 END AS v FROM nation) AS x"
_sql("nulls_high", f"SELECT k, v, row_number() OVER (ORDER BY v DESC, k) AS r FROM {_SOME_NULL} ORDER BY v DESC, k LIMIT 12", f"SELECT k, v, row_number() OVER (ORDER BY v DESC NULLS FIRST, k) AS r FROM {_SOME_NULL} ORDER BY v DESC NULLS FIRST, k LIMIT 12")
_sql("nulls_high_ascending", f"SELECT k, v, first_value(k) OVER (PARTITION BY k % 2 ORDER BY v, k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS f FROM {_SOME_NULL} ORDER BY v, k LIMIT 20", f"SELECT k, v, first_value(k) OVER (PARTITION BY k % 2 ORDER BY v NULLS LAST, k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS f FROM {_SOME_NULL} ORDER BY v NULLS LAST, k LIMIT 20")
_sql("quantified_nulls", f"SELECT r_regionkey AS k, r_regionkey < ALL (SELECT v + 3 FROM {_SOME_NULL}) AS a, r_regionkey <= SOME (SELECT v FROM {_SOME_NULL}) AS s, r_regionkey = ALL (SELECT v FROM {_SOME_NULL} WHERE k > 99) AS e, r_regionkey >= ALL (SELECT v FROM {_SOME_NULL} WHERE v IS NOT NULL) AS g FROM region",
     "SELECT r_regionkey AS k, CASE WHEN r_regionkey < 3 THEN CAST(NULL AS BOOLEAN) ELSE false END AS a, CASE WHEN r_regionkey <= 4 THEN true END AS s, true AS e, r_regionkey >= 4 AS g FROM region")
_sql("quantified_filter", f"SELECT n_name FROM nation WHERE n_nationkey < ALL (SELECT v + 3 FROM {_SOME_NULL})", "SELECT n_name FROM nation WHERE false")
_sql("division", "SELECT n_nationkey, 10 / n_regionkey AS d, n_nationkey % (n_regionkey - 1) AS m, 6 / 4 AS c FROM nation", "SELECT n_nationkey, 10 / nullif(n_regionkey, 0) AS d, n_nationkey % nullif(n_regionkey - 1, 0) AS m, 6 / 4 AS c FROM nation")
_sql("literals", "SELECT n_nationkey, 'a IS EMPTY' AS a, '{fn ABS(x)} ORDER BY y / 0' AS b, INTERVAL '2' DAY IS NOT NULL AS i FROM nation -- 'no'\n /* ORDER BY 5 */ WHERE n_name <> 'x /* y'", "SELECT n_nationkey, 'a IS EMPTY' AS a, '{fn ABS(x)} ORDER BY y / 0' AS b, true AS i FROM nation")
_sql("apply", "SELECT r_name, x.n FROM region CROSS APPLY (SELECT count(*) AS n FROM nation WHERE n_regionkey = r_regionkey) AS x", "SELECT r_name, count(n_nationkey) AS n FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY r_name")
_sql("outer_apply", "SELECT n_name, x.b FROM nation OUTER APPLY (SELECT max(s_acctbal) AS b FROM supplier WHERE s_nationkey = n_nationkey) AS x", "SELECT n_name, max(s_acctbal) AS b FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_nationkey, n_name")
_sql("context", "SELECT n_nationkey, SYSTEM_USER IS NOT NULL AS u, CURRENT_ROLE AS r, CURRENT_PATH AS p FROM nation", "SELECT n_nationkey, true AS u, '' AS r, '' AS p FROM nation")
_sql("timestamp_escapes", "SELECT o_orderkey, {fn TIMESTAMPADD(SQL_TSI_DAY, 3, o_orderdate)} AS a, {fn TIMESTAMPDIFF(DAY, {ts '1995-01-01 00:00:00'}, CAST(o_orderdate AS TIMESTAMP))} AS d FROM orders", "SELECT o_orderkey, CAST(o_orderdate AS TIMESTAMP) + INTERVAL 3 DAY AS a, datediff('day', DATE '1995-01-01', o_orderdate) AS d FROM orders")
