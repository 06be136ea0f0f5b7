"""Builder plans and dataflow activities."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.operators import flow
from weft.operators.rel import Rel
from weft.plans.base import Catalog, table

_C = Catalog()
QUERIES, ORACLE = _C.queries, _C.oracle
query = _C.query


def _rel(spark, sf_dir) -> Rel:
    return Rel(spark, lambda name: table(spark, sf_dir, name))


@query("rel_builder", """SELECT r_name, n, share FROM (SELECT r_name, count(*) AS n, round(avg(c_acctbal), 4) AS share FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
WHERE c_acctbal > 0 GROUP BY r_name) ORDER BY n DESC, r_name LIMIT 3""")
def rel_builder(spark, sf_dir):
    b = _rel(spark, sf_dir).scan("customer").filter("c_acctbal > 0").scan("nation").join("INNER", F.col("c_nationkey") == F.col("n_nationkey"))
    b = b.scan("region").join("INNER", F.col("n_regionkey") == F.col("r_regionkey"))
    return b.aggregate(["r_name"], n=F.count(F.lit(1)), share=F.round(F.avg("c_acctbal"), 4)).sort_limit(0, 3, ("n", "DESC"), "r_name").build()


@query("rel_calc_window", """SELECT o_orderkey, d, rk FROM (SELECT o_orderkey, o_custkey, round(o_totalprice * 2, 2) AS d, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rk FROM orders WHERE o_orderstatus = 'F')""")
def rel_calc_window(spark, sf_dir):
    b = _rel(spark, sf_dir).scan("orders").calc(F.col("o_orderstatus") == "F", "o_orderkey", "o_custkey", F.round(F.col("o_totalprice") * 2, 2).alias("d"))
    return b.window(["o_custkey"], ["o_orderkey"], rk=F.row_number()).project("o_orderkey", "d", "rk").build()


@query("rel_sets", "(SELECT n_nationkey AS k FROM nation UNION SELECT r_regionkey FROM region) EXCEPT SELECT r_regionkey FROM region WHERE r_regionkey < 2")
def rel_sets(spark, sf_dir):
    b = _rel(spark, sf_dir).scan("nation").project(F.col("n_nationkey").alias("k")).scan("region").project(F.col("r_regionkey").alias("k")).union()
    return b.scan("region").filter("r_regionkey < 2").project(F.col("r_regionkey").alias("k")).minus().build()


@query("rel_semi_anti", "SELECT n_name FROM nation WHERE n_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000) AND n_regionkey NOT IN (SELECT r_regionkey FROM region WHERE r_name = 'ASIA')")
def rel_semi_anti(spark, sf_dir):
    b = _rel(spark, sf_dir).scan("nation").scan("supplier").filter("s_acctbal > 5000").semi_join(F.col("n_nationkey") == F.col("s_nationkey"))
    return b.scan("region").filter("r_name = 'ASIA'").anti_join(F.col("n_regionkey") == F.col("r_regionkey")).project("n_name").build()


@query("rel_correlate", "SELECT r_name, max(n_name) AS last_nation FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_name")
def rel_correlate(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    right = lambda d: nation.where(F.col("n_regionkey") == F.col("r_regionkey").outer()).select(F.max("n_name").alias("last_nation"))
    return _rel(spark, sf_dir).scan("region").correlate("INNER", right).project("r_name", "last_nation").build()


@query("rel_collect_uncollect", "SELECT n_regionkey AS r, unnest([n_nationkey, n_regionkey]) AS v FROM nation")
def rel_collect_uncollect(spark, sf_dir):
    return _rel(spark, sf_dir).scan("nation").project(F.col("n_regionkey").alias("r"), F.array("n_nationkey", "n_regionkey").alias("vs")).uncollect("vs", "v").build()


@query("rel_exchange", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey")
def rel_exchange(spark, sf_dir):
    return _rel(spark, sf_dir).scan("orders").project("o_custkey").sort_exchange("HASH", 8, ["o_custkey"], ["o_custkey"]).aggregate(["o_custkey"], n=F.count(F.lit(1))).build()


@query("rel_values", "SELECT 1 AS id, 'a' AS name UNION ALL SELECT 2, 'b'")
def rel_values(spark, sf_dir):
    return _rel(spark, sf_dir).values(["id", "name"], (1, "a"), (2, "b")).build()


@query("rel_grouping_sets", "SELECT n_regionkey, n_name, count(*) AS n FROM nation GROUP BY GROUPING SETS ((n_regionkey), (n_name), ())")
def rel_grouping_sets(spark, sf_dir):
    return _rel(spark, sf_dir).scan("nation").aggregate(["n_regionkey", "n_name"], [["n_regionkey"], ["n_name"], []], n=F.count(F.lit(1))).build()


# Activities.


@query("flow_filter", "SELECT p_partkey, p_size > 40 AND p_brand = 'Brand#2' AS hit FROM part")
def flow_filter(spark, sf_dir):
    hit, rest = flow.filter_rows(table(spark, sf_dir, "part"), [("p_size", "GREATER_THAN", 40), ("p_brand", "EQUALS", "brand#2", False)])
    return hit.select("p_partkey", F.lit(True).alias("hit")).union(rest.select("p_partkey", F.lit(False).alias("hit")))


@query("flow_conditions", """SELECT p_partkey, p_size <> 5 AS ne, p_size < 9 AS lt, p_size >= 9 AS ge, p_size <= 9 AS le, regexp_full_match(p_name, '.*bolt') AS re, NOT regexp_full_match(p_name, '.*bolt') AS nr,
p_name IS NULL AS nu, p_name IS NOT NULL AS nn, p_size IN (1, 2) AS inn, p_size NOT IN (1, 2) AS ni, p_name LIKE '%red%' AS ct, p_name NOT LIKE '%red%' AS nc FROM part""")
def flow_conditions(spark, sf_dir):
    c = {"ne": ("p_size", "NOT_EQUALS", 5), "lt": ("p_size", "LESS_THAN", 9), "ge": ("p_size", "GREATER_THAN_EQUALS", 9), "le": ("p_size", "LESS_THAN_EQUALS", 9), "re": ("p_name", "REGEX", ".*bolt"), "nr": ("p_name", "REGEX_NOT", ".*bolt"),
         "nu": ("p_name", "NULL"), "nn": ("p_name", "NON_NULL"), "inn": ("p_size", "INCLUDED", [1, 2]), "ni": ("p_size", "NOT_INCLUDED", [1, 2]), "ct": ("p_name", "CONTAINS", "red"), "nc": ("p_name", "NOT_CONTAINS", "red")}
    return table(spark, sf_dir, "part").select("p_partkey", *[flow.condition(*x).alias(n) for n, x in c.items()])


@query("flow_columns", "SELECT CAST(n_nationkey AS BIGINT) AS key, n_name AS name, 'x' AS mark FROM nation")
def flow_columns(spark, sf_dir):
    d = flow.add_column(table(spark, sf_dir, "nation"), "mark", "x", "string")
    d = flow.rename(flow.cast(d, {"n_nationkey": "bigint"}), {"n_nationkey": "key", "n_(name)": r"\1"}, "REGEX")
    return flow.validate_columns(flow.reorder(d, ["key", "name", "mark"]), ["key"])


@query("flow_strings", "SELECT c_custkey, upper(replace(c_name, 'Customer#', 'C-')) AS clean, split_part(c_name, '#', 1) AS a, split_part(c_name, '#', 2) AS b, regexp_extract(c_name, '([A-Z])(\\w+)', 1) AS g1, c_mktsegment || '/' || c_name AS t FROM customer")
def flow_strings(spark, sf_dir):
    d = table(spark, sf_dir, "customer").withColumn("clean", F.col("c_name"))
    d = flow.string_clean(d, ["clean"], "BOTH", None, "Customer#", "C-")
    d = flow.string_clean(d, ["clean"], None, "UPPER")
    d = flow.string_groups(flow.string_split(d, "c_name", "#", ["a", "b"]), "c_name", r"([A-Z])(\w+)", ["g1", "g2"])
    return flow.string_template(d, "t", "{c_mktsegment}/{c_name}").select("c_custkey", "clean", "a", "b", "g1", "t")


@query("flow_surrogate_key", "SELECT row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) + 99 AS k, o_orderkey FROM orders")
def flow_surrogate_key(spark, sf_dir):
    return flow.surrogate_key(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "k", [F.desc("o_totalprice"), F.col("o_orderkey")], 100).select("k", "o_orderkey")


@query("flow_deduplicate", "SELECT o_custkey, o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders) WHERE rn = 1")
def flow_deduplicate(spark, sf_dir):
    return flow.deduplicate(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderdate"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


@query("flow_aggregate", "SELECT o_orderstatus, count(o_orderkey) AS n, round(sum(o_totalprice), 2) AS s, min(o_totalprice) AS lo, max(o_totalprice) AS hi, round(avg(o_totalprice), 4) AS av FROM orders GROUP BY o_orderstatus")
def flow_aggregate(spark, sf_dir):
    d = flow.aggregate(table(spark, sf_dir, "orders"), ["o_orderstatus"], {"n": ("COUNT", "o_orderkey"), "s": ("SUM", "o_totalprice"), "lo": ("MIN", "o_totalprice"), "hi": ("MAX", "o_totalprice"), "av": ("AVG", "o_totalprice")})
    return d.withColumns({"s": F.round("s", 2), "av": F.round("av", 4)})


@query("flow_pivot", """SELECT o_custkey, count(*) FILTER (o_orderstatus = 'F') AS "F", count(*) FILTER (o_orderstatus = 'O') AS "O", count(*) FILTER (o_orderstatus = 'P') AS "P" FROM orders GROUP BY o_custkey""")
def flow_pivot(spark, sf_dir):
    return flow.pivot(table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderstatus", "o_orderkey", "COUNT", ["F", "O", "P"])


@query("flow_pivot_first", """SELECT o_custkey, min(o_orderkey) FILTER (o_orderstatus = 'F') AS "F", min(o_orderkey) FILTER (o_orderstatus = 'O') AS "O", min(o_orderkey) FILTER (o_orderstatus = 'P') AS "P" FROM orders GROUP BY o_custkey""")
def flow_pivot_first(spark, sf_dir):
    return flow.pivot(table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderstatus", "o_orderkey", "FIRST", None, ["o_orderkey"])


@query("flow_unpivot", "SELECT l_orderkey, l_linenumber, 'l_discount' AS name, l_discount AS value FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber, 'l_tax', l_tax FROM lineitem")
def flow_unpivot(spark, sf_dir):
    return flow.unpivot(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_discount", "l_tax"), ["l_orderkey", "l_linenumber"])


_GAPS = "(SELECT event_id, user_id, CASE WHEN event_id % 3 = 0 THEN value END AS v, user_id * 1.0 AS u FROM events)"


def _gaps(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", "user_id", F.when(F.col("event_id") % 3 == 0, F.col("value")).alias("v"), F.col("user_id").cast("double").alias("u"))


for _how, _sql in {
    "fixed": f"SELECT event_id, coalesce(v, -1) AS v FROM {_GAPS}",
    "lookup": f"SELECT event_id, coalesce(v, u) AS v FROM {_GAPS}",
    "drop": f"SELECT event_id, v FROM {_GAPS} WHERE v IS NOT NULL",
    "statistic": f"SELECT event_id, round(coalesce(v, (SELECT avg(v) FROM {_GAPS})), 6) AS v FROM {_GAPS}",
    "previous": f"SELECT event_id, last_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS v FROM {_GAPS}",
    "next": f"SELECT event_id, first_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS v FROM {_GAPS}",
}.items():

    def _run(spark, sf_dir, how=_how):
        settings = {"fixed": {"value": -1}, "lookup": {"lookup": "u"}, "drop": {}, "statistic": {"value": "AVG"}}.get(how, {"order": ["event_id"], "keys": ["user_id"]})
        return flow.impute(_gaps(spark, sf_dir), ["v"], how, **settings).select("event_id", F.round("v", 6).alias("v") if how == "statistic" else "v")

    query(f"flow_impute_{_how}", _sql)(_run)


@query("flow_join", "SELECT n_nationkey, n_name, n_regionkey, r_name FROM nation LEFT JOIN region ON n_regionkey = r_regionkey")
def flow_join(spark, sf_dir):
    return flow.join(table(spark, sf_dir, "nation"), table(spark, sf_dir, "region"), [("n_regionkey", "r_regionkey")], "LEFT")


@query("flow_lookup_exact", "SELECT c_custkey, (SELECT min(o_orderkey) FROM orders WHERE o_custkey = c_custkey) AS o_orderkey FROM customer")
def flow_lookup_exact(spark, sf_dir):
    return flow.lookup(table(spark, sf_dir, "customer").select("c_custkey"), table(spark, sf_dir, "orders"), [("c_custkey", "o_custkey")], ["o_orderkey"])


_ASOF = "SELECT e.event_id, p.event_id AS found FROM events e ASOF LEFT JOIN (SELECT user_id, ts, min(event_id) AS event_id FROM events WHERE event_type = 'purchase' GROUP BY user_id, ts) p ON e.user_id = p.user_id AND e.ts {} p.ts"
for _how, _op in {"smaller": ">=", "larger": "<="}.items():

    def _run(spark, sf_dir, how=_how):
        e = table(spark, sf_dir, "events")
        p = e.filter("event_type = 'purchase'").select("user_id", "ts", F.col("event_id").alias("found"))
        return flow.lookup(e.select("event_id", "user_id", "ts"), p, [("user_id", "user_id")], ["found"], how, ("ts", "ts")).select("event_id", "found")

    query(f"flow_lookup_{_how}", _ASOF.format(_op))(_run)


@query("flow_append_columns", "SELECT a.n_name, b.s_name FROM (SELECT n_name, row_number() OVER (ORDER BY n_nationkey) AS p FROM nation) a FULL JOIN (SELECT s_name, row_number() OVER (ORDER BY s_suppkey) AS p FROM supplier) b USING (p)")
def flow_append_columns(spark, sf_dir):
    n, s = table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    return flow.append_columns(n, s, ["n_nationkey"], ["s_suppkey"]).select("n_name", "s_name")


@query("flow_union_merge", "SELECT n_nationkey AS k, NULL AS extra FROM nation UNION ALL SELECT r_regionkey, r_name FROM region")
def flow_union_merge(spark, sf_dir):
    return flow.merge(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k")), None, table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("extra")))


@query("flow_sort", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 7 OFFSET 3")
def flow_sort(spark, sf_dir):
    return flow.sort(table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), [("c_acctbal", "DESC"), "c_custkey"], 3, 7)


@query("flow_query", "SELECT r_name, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def flow_query(spark, sf_dir):
    return flow.query("SELECT r_name, count(*) AS n FROM {a} JOIN {b} ON n_regionkey = r_regionkey GROUP BY r_name", a=table(spark, sf_dir, "nation"), b=table(spark, sf_dir, "region"))


@query("flow_user_transform", "SELECT o_orderkey, round(o_totalprice * 2, 2) AS v FROM orders")
def flow_user_transform(spark, sf_dir):
    return flow.user_transform(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), lambda p: p.assign(v=p.o_totalprice * 2)[["o_orderkey", "v"]], "o_orderkey long, v double").withColumn("v", F.round("v", 2))


@query("flow_workflow", """SELECT r_name, n FROM (SELECT r_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE c_acctbal > 1000 GROUP BY r_name)""")
def flow_workflow(spark, sf_dir):
    """A small workflow: filter, two lookups, aggregate, with a nested workflow."""
    inputs = {n: table(spark, sf_dir, n) for n in ("customer", "nation", "region")}

    def located(customers, nations, regions):
        c = flow.lookup(customers, nations, [("c_nationkey", "n_nationkey")], ["n_regionkey"])
        return flow.lookup(c, regions, [("n_regionkey", "r_regionkey")], ["r_name"])

    out = flow.run([
        ("rich", flow.filter_rows, ["customer"], {"items": [("c_acctbal", "GREATER_THAN", 1000)]}),
        ("located", lambda *frames: flow.nested(located, *frames), ["rich.0", "nation", "region"], {}),
        ("counted", flow.aggregate, ["located"], {"keys": ["r_name"], "calls": {"n": ("COUNT", "c_custkey")}}),
    ], inputs)
    return out["counted"]


@query("flow_variables", "SELECT 25 AS n, 'nation: 25' AS t")
def flow_variables(spark, sf_dir):
    v = flow.to_variables(table(spark, sf_dir, "nation").agg(F.count(F.lit(1)).alias("n")))[0]
    v = flow.validate_variables(flow.modify_variables(v, {"name": "nation"}), ["n"])
    return flow.from_variables(spark, {"n": v["n"], "t": flow.template_variable("{name}: {n}", v)})


@query("flow_named_activities", "SELECT c_mktsegment, count(c_custkey) AS n FROM customer WHERE c_acctbal > 0 GROUP BY c_mktsegment")
def flow_named_activities(spark, sf_dir):
    """A workflow by the names of its activities."""
    from weft.operators import activities

    return activities.run([
        ("rich", "relFilter", ["c"], {"items": [("c_acctbal", "GREATER_THAN", 0)]}),
        ("clean", "docStringClean", ["rich.0"], {"names": ["c_mktsegment"]}),
        ("n", "relAggregate", ["clean"], {"keys": ["c_mktsegment"], "calls": {"n": ("COUNT", "c_custkey")}}),
    ], {"c": table(spark, sf_dir, "customer")})["n"]


@query("flow_doc_modify", "SELECT n_nationkey, n_name AS label, [n_regionkey] AS n_regionkey, 'x' AS mark FROM nation")
def flow_doc_modify(spark, sf_dir):
    from weft.operators.activities import ACTIVITIES

    d = ACTIVITIES["docModify"](table(spark, sf_dir, "nation"), [("move", "n_name", "label"), ("arrWrap", "n_regionkey"), ("setValue", "mark", "x")])
    return d.select("n_nationkey", "label", "n_regionkey", "mark")
