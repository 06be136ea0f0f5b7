"""Contextual queries, dataflow scripts, resource requests and textual plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.operators import lang
from weft.plans.base import Catalog, table

_C = Catalog()
QUERIES, ORACLE = _C.queries, _C.oracle


def _add(name, text, sql, run, finish=None):
    def go(spark, sf_dir):
        out = run(text, lambda n: table(spark, sf_dir, n), spark, sf_dir)
        return finish(out) if finish else out

    _C.query(name, sql)(go)


def _cql(name, text, sql, finish=None):
    _add(f"cql_{name}", text, sql, lambda t, tables, spark, d: lang.Cql(tables).run(t), finish)


def _pig(name, text, sql, finish=None):
    _add(f"pig_{name}", text, sql, lambda t, tables, spark, d: lang.pig(t, tables, spark, empty_bags=True), finish)


def _rest(name, text, sql, finish=None):
    _add(f"rest_{name}", text, sql, lambda t, tables, spark, d: lang.rest(t, tables), finish)


def _alg(name, text, sql, finish=None):
    def run(t, tables, spark, d):
        from weft.plans.graphs import star

        return lang.Plans(spark, tables, star(spark, d) if "LPG" in t else None).run(t)

    _add(f"alg_{name}", text, sql, run, finish)


_cql("filter", 'nation.n_regionkey >= 2 and not nation.n_name == "NATION_7" project nation.n_name', "SELECT n_name AS nation_n_name FROM nation WHERE n_regionkey >= 2 AND n_name <> 'NATION_7'")
_cql("or", "(part.p_size < 3 or part.p_size > 48) and part.p_brand <> 'Brand#2' project part.p_partkey", "SELECT p_partkey AS part_p_partkey FROM part WHERE (p_size < 3 OR p_size > 48) AND p_brand <> 'Brand#2'")
_cql("columns", "lineitem.l_quantity < lineitem.l_linenumber project lineitem.l_orderkey lineitem.l_linenumber", "SELECT l_orderkey AS lineitem_l_orderkey, l_linenumber AS lineitem_l_linenumber FROM lineitem WHERE l_quantity < l_linenumber")
_cql("relation", "region.r_name <> 'ASIA' relation nation and/on=[nation.n_regionkey=region.r_regionkey] region project region.r_name nation.n_nationkey/count", "SELECT r_name AS region_r_name, count(n_nationkey) AS nation_n_nationkey_count FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name <> 'ASIA' GROUP BY r_name")
_cql("relation_outer", "relation nation or/null=right/on=[nation.n_nationkey=region.r_regionkey] region project nation.n_name region.r_name", "SELECT n_name AS nation_n_name, r_name AS region_r_name FROM nation LEFT JOIN region ON n_nationkey = r_regionkey")
_cql("aggregates", "orders.o_totalprice > 1000 project orders.o_orderstatus orders.o_orderkey/count orders.o_totalprice/max orders.o_totalprice/min sortby orders.o_orderstatus/descending", "SELECT o_orderstatus AS orders_o_orderstatus, count(o_orderkey) AS orders_o_orderkey_count, max(o_totalprice) AS orders_o_totalprice_max, min(o_totalprice) AS orders_o_totalprice_min FROM orders WHERE o_totalprice > 1000 GROUP BY 1")

_pig("filter", "A = LOAD 'nation'; B = FILTER A BY n_regionkey == 1; C = FOREACH B GENERATE n_nationkey AS k, upper(n_name) AS name; DUMP C;", "SELECT n_nationkey AS k, upper(n_name) AS name FROM nation WHERE n_regionkey = 1")
_pig("group", "A = LOAD 'orders'; B = GROUP A BY o_orderstatus; C = FOREACH B GENERATE group AS status, COUNT(A) AS n, MAX(A.o_totalprice) AS hi; DUMP C;", "SELECT o_orderstatus AS status, count(*) AS n, max(o_totalprice) AS hi FROM orders GROUP BY 1")
_pig("group_all", "A = LOAD 'lineitem'; B = GROUP A ALL; C = FOREACH B GENERATE COUNT(A) AS n, MIN(A.l_quantity) AS lo; DUMP C;", "SELECT count(*) AS n, min(l_quantity) AS lo FROM lineitem")
_pig("distinct_order", "A = LOAD 'customer'; B = FOREACH A GENERATE c_mktsegment, c_nationkey; C = DISTINCT B; D = ORDER C BY c_nationkey DESC, c_mktsegment; E = LIMIT D 7; DUMP E;", "SELECT DISTINCT c_mktsegment, c_nationkey FROM customer ORDER BY c_nationkey DESC, c_mktsegment LIMIT 7")
_pig("nested", "A = LOAD 'orders'; B = GROUP A BY o_custkey; C = FOREACH B { D = FILTER A BY o_orderstatus == 'F'; GENERATE group AS c, COUNT(D) AS n; }; DUMP C;", "SELECT o_custkey AS c, count(*) FILTER (o_orderstatus = 'F') AS n FROM orders GROUP BY 1")
_pig("values", "A = VALUES (1, 'a'), (2, 'b') AS (id, name); B = FILTER A BY id > 1; DUMP B;", "SELECT 2 AS id, 'b' AS name")

_rest("project", "GET nation?_project=n_name,n_regionkey@region&n_regionkey=>=3&_sort=n_name@DESC&_limit=4&_offset=1", "SELECT n_name, n_regionkey AS region FROM nation WHERE n_regionkey >= 3 ORDER BY n_name DESC LIMIT 4 OFFSET 1")
_rest("aggregate", "GET orders?_project=o_orderstatus,COUNT(o_orderkey)@n,MAX(o_totalprice)@hi&_groupby=o_orderstatus&o_totalprice=<300000", "SELECT o_orderstatus, count(o_orderkey) AS n, max(o_totalprice) AS hi FROM orders WHERE o_totalprice < 300000 GROUP BY o_orderstatus")
_rest("join", "GET nation,region?nation.n_regionkey=%3Dregion.r_regionkey&region.r_name=%25%25A%25&_project=n_name,r_name", "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name LIKE '%A%'")

_alg("project_filter", "REL_PROJECT[n_name AS name, n_regionkey + 1 AS r](REL_FILTER[n_regionkey > 2](REL_SCAN[nation]))", "SELECT n_name AS name, n_regionkey + 1 AS r FROM nation WHERE n_regionkey > 2")
_alg("join_aggregate", "REL_AGGREGATE[group=[r_name], aggregates=[count(*) AS n]](REL_JOIN[n_regionkey = r_regionkey, type=INNER](REL_SCAN[nation], REL_SCAN[region]))", "SELECT r_name, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
_alg("sort", "REL_SORT[order=[c_acctbal DESC, c_custkey], limit=5, offset=2](REL_PROJECT[c_custkey, c_acctbal](REL_SCAN[customer]))", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 5 OFFSET 2")
_alg("sets", "REL_MINUS[all=false](REL_UNION[all=true](REL_PROJECT[n_nationkey AS k](REL_SCAN[nation]), REL_PROJECT[r_regionkey AS k](REL_SCAN[region])), REL_VALUES[names=[k], tuples=[[0], [1]]])", "SELECT n_nationkey AS k FROM nation WHERE n_nationkey > 1")
_alg("calc_window", "REL_WINDOW[row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn](REL_CALC[condition=o_orderstatus = 'F', projects=[o_custkey, o_orderkey]](REL_SCAN[orders]))", "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders WHERE o_orderstatus = 'F'")
_alg("physical", "E_AGGREGATE[group=[n_regionkey], aggregates=[count(*) AS n]](E_MERGE_JOIN[condition=n_nationkey = s_nationkey](E_PROJECT[n_nationkey, n_regionkey](REL_SCAN[nation]), REL_SCAN[supplier]))", "SELECT n_regionkey, count(*) AS n FROM nation JOIN supplier ON n_nationkey = s_nationkey GROUP BY 1")
_alg("semi", "E_SEMI_JOIN[condition=n_nationkey = s_nationkey](REL_PROJECT[n_nationkey, n_name](REL_SCAN[nation]), REL_FILTER[s_acctbal > 9000](REL_SCAN[supplier]))", "SELECT n_nationkey, n_name FROM nation WHERE n_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 9000)")
_alg("documents", "DOC_AGGREGATE[group=[event_type], aggregates=[count(*) AS n]](DOC_FILTER[user_id < 50](DOC_SCAN[events]))", "SELECT event_type, count(*) AS n FROM events WHERE user_id < 50 GROUP BY 1")
_alg("graph", "LPG_MATCH[MATCH (n:Nation)-[:IN]->(r:Region) RETURN r.r_name AS region, count(*) AS n]", "SELECT r_name AS region, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
_alg("transform", "TRANSFORMER[DOCUMENT](REL_PROJECT[n_nationkey](REL_SCAN[nation]))", "SELECT '{\"n_nationkey\":' || n_nationkey || '}' AS d FROM nation")
_alg("grouping_sets", "REL_AGGREGATE[group=[n_regionkey, n_name], groups=[[n_regionkey], [n_name], []], aggregates=[count(*) AS n]](REL_SCAN[nation])", "SELECT n_regionkey, n_name, count(*) AS n FROM nation GROUP BY GROUPING SETS ((n_regionkey), (n_name), ())")
_alg("exchange", "REL_AGGREGATE[group=[k], aggregates=[count(*) AS n, max(v) AS hi]](REL_EXCHANGE[distributionType=HASH_DISTRIBUTED, numbers=[0]](REL_SORT_EXCHANGE[order=[v DESC], numbers=[1, 0], distributionType=RANGE_DISTRIBUTED](REL_PROJECT[o_custkey AS k, o_totalprice AS v](REL_SCAN[orders]))))", "SELECT o_custkey AS k, count(*) AS n, max(o_totalprice) AS hi FROM orders GROUP BY 1")
_alg("modify_insert", "REL_MODIFY[table=region, operation=INSERT, targets=[r_regionkey, r_name]](REL_VALUES[names=[a, b], tuples=[[50, 'X'], [51, 'Y']]])", "SELECT * FROM region UNION ALL VALUES (50, 'X'), (51, 'Y')")
_alg("modify_update", "REL_MODIFY[table=nation, operation=UPDATE, targets=[n_name], sources=[upper(concat('r', n_regionkey))]](REL_FILTER[n_regionkey < 2](REL_SCAN[nation]))", "SELECT n_nationkey, CASE WHEN n_regionkey < 2 THEN 'R' || n_regionkey ELSE n_name END AS n_name, n_regionkey FROM nation")
_alg("modify_delete", "REL_MODIFY[table=nation, operation=DELETE](REL_FILTER[n_regionkey = 3](REL_SCAN[nation]))", "SELECT * FROM nation WHERE n_regionkey <> 3")
_alg("correlate", "REL_CORRELATE[(SELECT c.n_nationkey * 2 AS twice WHERE c.n_regionkey > 1), id=c, type=LEFT](REL_SCAN[nation])", "SELECT n_nationkey, n_name, n_regionkey, CASE WHEN n_regionkey > 1 THEN n_nationkey * 2 END AS twice FROM nation")
_alg("document_values", "DOC_PROJECT[_id, a](DOC_VALUES[docs=[{_id: 1, a: 'x'}, {_id: 2, a: null}]])", "SELECT * FROM (VALUES (1, 'x'), (2, NULL)) AS t(_id, a)")
