"""Windows over events, row patterns, statistics and constraint checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.operators import ddl, matching
from weft.plans.base import Catalog, table
from weft.streaming import windows as W

_C = Catalog()
QUERIES, ORACLE = _C.queries, _C.oracle
query = _C.query


@query("win_tumble", "SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, time_bucket(INTERVAL '1 hour', ts) + INTERVAL '1 hour' AS window_end, event_type, count(*) AS n, round(sum(value), 4) AS v FROM events GROUP BY 1, 2, 3")
def win_tumble(spark, sf_dir):
    return W.tumble(table(spark, sf_dir, "events"), "ts", "1 hour", ["event_type"], n=F.count(F.lit(1)), v=F.round(F.sum("value"), 4))


@query("win_hop", "SELECT s AS window_start, s + INTERVAL '1 hour' AS window_end, event_type, count(*) AS n FROM (SELECT event_type, unnest([time_bucket(INTERVAL '30 minutes', ts), time_bucket(INTERVAL '30 minutes', ts) - INTERVAL '30 minutes']) AS s FROM events) GROUP BY 1, 2, 3")
def win_hop(spark, sf_dir):
    return W.hop(table(spark, sf_dir, "events"), "ts", "30 minutes", "1 hour", ["event_type"], n=F.count(F.lit(1)))


_SESSION = """WITH a AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) {} INTERVAL '2 hours' THEN 0 ELSE 1 END AS fresh FROM events),
b AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM a) """


@query("win_session", _SESSION.format("<") + "SELECT user_id, min(ts) AS window_start, max(ts) + INTERVAL '2 hours' AS window_end, count(*) AS n FROM b GROUP BY user_id, session")
def win_session(spark, sf_dir):
    return W.session(table(spark, sf_dir, "events"), "ts", "2 hours", ["user_id"], n=F.count(F.lit(1)))


@query("win_session_ids", _SESSION.format("<=") + "SELECT event_id, session FROM b")
def win_session_ids(spark, sf_dir):
    return W.session_ids(table(spark, sf_dir, "events"), "ts", 7200, ["user_id"]).select("event_id", "session")


@query("match_rises", """WITH a AS (SELECT *, value > lag(value) OVER w AS up, row_number() OVER w AS rn FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
g AS (SELECT *, rn - row_number() OVER (PARTITION BY user_id, up ORDER BY ts) AS grp FROM a)
SELECT user_id, min(event_id) AS first_id, max(event_id) AS last_id, count(*) AS n FROM g WHERE up GROUP BY user_id, grp HAVING count(*) >= 3""")
def match_rises(spark, sf_dir):
    """Maximal rises of three steps and more."""
    e = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value")
    e = matching.shifted(e, ["user_id"], ["ts"], {"before": matching.prev("value")})
    return matching.match_recognize(e, ["user_id"], ["ts"], {"UP": F.col("value") > F.col("before")}, "UP{3,}", {"first_id": ("FIRST", "event_id"), "last_id": ("LAST", "event_id"), "n": ("COUNT", None)}, "user_id long, first_id long, last_id long, n long")


@query("stat_columns", """SELECT 'o_orderkey' AS name, count(*) AS n_rows, count(*) - count(o_orderkey) AS n_null, count(DISTINCT o_orderkey) AS n_distinct, CAST(min(o_orderkey) AS VARCHAR) AS least, CAST(max(o_orderkey) AS VARCHAR) AS greatest FROM orders
UNION ALL SELECT 'o_orderstatus', count(*), count(*) - count(o_orderstatus), count(DISTINCT o_orderstatus), min(o_orderstatus), max(o_orderstatus) FROM orders""")
def stat_columns(spark, sf_dir):
    return ddl.statistics(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"))


@query("check_unique", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 1")
def check_unique(spark, sf_dir):
    return ddl.duplicates(table(spark, sf_dir, "orders"), ["o_custkey"])


@query("check_foreign_key", "SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_regionkey NOT IN (SELECT r_regionkey FROM region WHERE r_name <> 'ASIA')")
def check_foreign_key(spark, sf_dir):
    return ddl.orphans(table(spark, sf_dir, "nation"), ["n_regionkey"], table(spark, sf_dir, "region").filter("r_name <> 'ASIA'"), ["r_regionkey"])


@query("check_condition", "SELECT p_partkey FROM part WHERE NOT (p_size < 45)")
def check_condition(spark, sf_dir):
    return ddl.failing(table(spark, sf_dir, "part"), "p_size < 45").select("p_partkey")
