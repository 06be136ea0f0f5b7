"""Pattern queries on the graph of regions, nations, customers and suppliers."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.operators import graph as G
from weft.plans.base import Catalog, table

_C = Catalog()
QUERIES, ORACLE = _C.queries, _C.oracle
query = _C.query


def star(spark, sf_dir) -> G.Graph:
    """Nodes are rows, edges foreign keys."""
    t = {n: table(spark, sf_dir, n) for n in ("region", "nation", "customer", "supplier")}
    ref = lambda label, c: F.concat(F.lit(f"{label}:"), F.col(c).cast("string"))
    nodes = [(t["region"], "Region", "r_regionkey"), (t["nation"], "Nation", "n_nationkey"), (t["customer"], "Customer", "c_custkey"), (t["supplier"], "Supplier", "s_suppkey")]
    edges = [
        G.edge_rows(t["nation"], "IN", ref("Nation", "n_nationkey"), ref("Region", "n_regionkey")),
        G.edge_rows(t["customer"], "LIVES", ref("Customer", "c_custkey"), ref("Nation", "c_nationkey"), ["c_mktsegment"]),
        G.edge_rows(t["supplier"], "SELLS", ref("Supplier", "s_suppkey"), ref("Nation", "s_nationkey")),
    ]
    return G.Graph.of_rows(nodes, edges)


def _cypher(name: str, text: str, sql: str, finish=None) -> None:
    def run(spark, sf_dir):
        out = G.run(star(spark, sf_dir), text)
        return finish(out) if finish else out

    query(name, sql)(run)


_cypher("cypher_node", "MATCH (n:Nation) WHERE n.n_regionkey = 2 RETURN n.n_name AS name", "SELECT n_name AS name FROM nation WHERE n_regionkey = 2")
_cypher("cypher_properties", "MATCH (c:Customer {c_mktsegment: 'BUILDING'}) WHERE c.c_acctbal > 5000 AND NOT c.c_nationkey = 3 RETURN c.c_name AS name", "SELECT c_name AS name FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 5000 AND c_nationkey <> 3")
_cypher("cypher_hop", "MATCH (n:Nation)-[:IN]->(r:Region) RETURN n.n_name AS nation, r.r_name AS region", "SELECT n_name AS nation, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey")
_cypher("cypher_back", "MATCH (r:Region {r_name: 'ASIA'})<-[:IN]-(n) RETURN n.n_name AS nation", "SELECT n_name AS nation FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'")
_cypher("cypher_two_hops", "MATCH (c:Customer)-[:LIVES]->(n:Nation)-[:IN]->(r:Region) RETURN r.r_name AS region, count(*) AS n, avg(c.c_acctbal) AS mean", "SELECT r_name AS region, count(*) AS n, round(avg(c_acctbal), 6) AS mean FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name", lambda d: d.withColumn("mean", F.round("mean", 6)))
_cypher("cypher_undirected", "MATCH (a:Nation)-[:IN]-(r:Region)-[:IN]-(b:Nation) WHERE r.r_name = 'AFRICA' RETURN a.n_name AS a, b.n_name AS b", "SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey JOIN region ON a.n_regionkey = r_regionkey WHERE r_name = 'AFRICA'")
_cypher("cypher_edge", "MATCH (c:Customer)-[l:LIVES {c_mktsegment: 'MACHINERY'}]->(n:Nation) RETURN n.n_name AS nation, type(l) AS kind, count(l) AS n", "SELECT n_name AS nation, 'LIVES' AS kind, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_mktsegment = 'MACHINERY' GROUP BY n_name")
_cypher("cypher_variable_length", "MATCH (c:Customer)-[p*1..2]->(x) RETURN labels(x) AS l, length(p) AS n, count(*) AS m", "SELECT ['Nation'] AS l, 1 AS n, count(*) AS m FROM customer UNION ALL SELECT ['Region'], 2, count(*) FROM customer")
_cypher("cypher_any_length", "MATCH (c:Customer {c_mktsegment: 'BUILDING'})-[p*]->(x) RETURN labels(x) AS l, length(p) AS n, count(*) AS m", "SELECT ['Nation'] AS l, 1 AS n, count(*) AS m FROM customer WHERE c_mktsegment = 'BUILDING' UNION ALL SELECT ['Region'], 2, count(*) FROM customer WHERE c_mktsegment = 'BUILDING'")
_cypher("cypher_length_from", "MATCH (c:Customer)-[p*2..]->(x:Region) RETURN x.r_name AS region, count(*) AS m", "SELECT r_name AS region, count(*) AS m FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
_cypher("cypher_length_zero", "MATCH (n:Nation)-[p*0..1]->(x) RETURN n.n_name AS name, length(p) AS n, labels(x) AS l", "SELECT n_name AS name, 0 AS n, ['Nation'] AS l FROM nation UNION ALL SELECT n_name, 1, ['Region'] FROM nation")
_cypher("cypher_named_path", "MATCH w = (c:Customer)-[:LIVES]->(n:Nation)-[:IN]->(r:Region) WHERE r.r_name = 'ASIA' RETURN c.c_name AS name, length(w) AS n, size(nodes(w)) AS k", "SELECT c_name AS name, 2 AS n, 3 AS k FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'")
_cypher("cypher_comprehension", "MATCH (r:Region) RETURN r.r_name AS name, [x IN [1, 2, 3, 4] WHERE x > 2 AND x <> 4 | x * 10] AS a, [x IN [5, 6] | x + 1] AS b, [1, 2, 3][1] AS c, [1, 2, 3, 4][1..3] AS d, [1, 2, 3][-1] AS e, [1, 2, 3][..2] AS f", "SELECT r_name AS name, [30] AS a, [6, 7] AS b, 2 AS c, [2, 3] AS d, 3 AS e, [1, 2] AS f FROM region")
_cypher("cypher_distinct_order", "MATCH (s:Supplier)-[:SELLS]->(n:Nation) RETURN DISTINCT n.n_name AS name ORDER BY name DESC SKIP 2 LIMIT 5", "SELECT DISTINCT n_name AS name FROM supplier JOIN nation ON s_nationkey = n_nationkey ORDER BY name DESC LIMIT 5 OFFSET 2")
_cypher("cypher_with", "MATCH (c:Customer)-[:LIVES]->(n:Nation) WITH n, count(c) AS n_customers WHERE n_customers > 60 MATCH (n)-[:IN]->(r:Region) RETURN n.n_name AS nation, r.r_name AS region, n_customers", "SELECT n_name AS nation, r_name AS region, count(*) AS n_customers FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY n_name, r_name HAVING count(*) > 60")
_cypher("cypher_optional", "MATCH (n:Nation) OPTIONAL MATCH (n)<-[:SELLS]-(s:Supplier) WHERE s.s_acctbal > 9000 RETURN n.n_name AS nation, count(s) AS n", "SELECT n_name AS nation, count(s_suppkey) AS n FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey AND s_acctbal > 9000 GROUP BY n_name")
_cypher("cypher_unwind", "UNWIND [1, 2, 3] AS x RETURN x AS x, x * 2 AS y", "SELECT x, x * 2 AS y FROM (VALUES (1), (2), (3)) AS t(x)")
_cypher("cypher_union", "MATCH (n:Nation) RETURN n.n_name AS name UNION MATCH (r:Region) RETURN r.r_name AS name", "SELECT n_name AS name FROM nation UNION SELECT r_name FROM region")
_cypher("cypher_aggregates", "MATCH (c:Customer) RETURN c.c_mktsegment AS segment, count(DISTINCT c.c_nationkey) AS n, min(c.c_acctbal) AS lo, max(c.c_acctbal) AS hi, sum(c.c_acctbal) AS total", "SELECT c_mktsegment AS segment, count(DISTINCT c_nationkey) AS n, min(c_acctbal) AS lo, max(c_acctbal) AS hi, round(sum(c_acctbal), 2) AS total FROM customer GROUP BY 1", lambda d: d.withColumn("total", F.round("total", 2)))
_cypher("cypher_predicates", "MATCH (n:Nation) WHERE n.n_name STARTS WITH 'NATION_1' XOR n.n_name ENDS WITH '3' RETURN n.n_name AS name, n.n_regionkey IN [1, 2] AS some", "SELECT n_name AS name, n_regionkey IN (1, 2) AS some FROM nation WHERE (n_name LIKE 'NATION_1%') <> (n_name LIKE '%3')")
_cypher("cypher_lists", "MATCH (n:Nation) RETURN n.n_name AS name, ANY(x IN [1, 2, 3] WHERE x > 2) AS a, ALL(x IN [1, 2, 3] WHERE x > 2) AS b, NONE(x IN [1, 2] WHERE x = 5) AS c, SINGLE(x IN [1, 2, 3] WHERE x = 2) AS d", "SELECT n_name AS name, true AS a, false AS b, true AS c, true AS d FROM nation")
_cypher("cypher_case", "MATCH (n:Nation) RETURN n.n_name AS name, CASE WHEN n.n_regionkey < 2 THEN 'low' ELSE 'high' END AS band", "SELECT n_name AS name, CASE WHEN n_regionkey < 2 THEN 'low' ELSE 'high' END AS band FROM nation")
_cypher("cypher_point", "MATCH (n:Nation {n_nationkey: 0}) RETURN distance(point({x: 0, y: 0}), point({x: 3, y: 4})) AS d", "SELECT 5.0 AS d")


@query("graph_subgraph", "SELECT count(*) AS n FROM nation WHERE n_regionkey IN (0, 1, 2, 3, 4)")
def graph_subgraph(spark, sf_dir):
    g = star(spark, sf_dir).filter_labels(["Nation", "Region"])
    return g.edges.agg(F.count(F.lit(1)).alias("n"))


@query("graph_rename", "SELECT n_name AS name FROM nation")
def graph_rename(spark, sf_dir):
    g = star(spark, sf_dir).rename_labels({"Nation": "Land"}).rename_properties({"n_name": "name"})
    return g.nodes_to_rows("Land", {"name": "string"}).select("name")


@query("graph_deduplicate", "SELECT count(DISTINCT c_mktsegment) AS n, (SELECT count(*) FROM customer) AS m FROM customer")
def graph_deduplicate(spark, sf_dir):
    g = star(spark, sf_dir)
    one = G.Graph(g.nodes.filter(F.array_contains("labels", "Customer")), g.edges.filter(F.array_contains("labels", "LIVES"))).deduplicate(["c_mktsegment"])
    return one.nodes.agg(F.count(F.lit(1)).alias("n")).join(one.edges.agg(F.count(F.lit(1)).alias("m")))


@query("graph_changes", "SELECT (SELECT count(*) FROM nation WHERE n_regionkey <> 1) + 1 AS n, (SELECT count(*) FROM nation WHERE n_regionkey <> 1) AS marked")
def graph_changes(spark, sf_dir):
    """CREATE, SET, REMOVE and DELETE as new graphs."""
    g = star(spark, sf_dir).filter_labels(["Nation"])
    gone = g.nodes.filter(F.col("properties")["n_regionkey"] == "1").select("id")
    g = g.delete(gone)
    g = g.set_property(g.nodes.select("id"), "mark", "x").create([("Nation:new", ["Nation"], {"n_name": "new"})]).set_labels(["Seen"]).remove_labels(["Seen"]).remove_property("n_regionkey")
    return g.nodes.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("properties")["mark"] == "x").alias("marked"))


@query("graph_to_rows", "SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1")
def graph_to_rows(spark, sf_dir):
    return star(spark, sf_dir).edges_to_rows("LIVES", {"c_mktsegment": "string"}).groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"))


@query("graph_to_documents", "SELECT count(*) AS n, count(*) AS named FROM nation")
def graph_to_documents(spark, sf_dir):
    d = star(spark, sf_dir).filter_labels(["Nation"]).nodes_to_documents()
    return d.agg(F.count(F.lit(1)).alias("n"), F.count(F.get_json_object("d", "$.properties.n_name")).alias("named"))


@query("model_rows_to_documents", "SELECT n_nationkey, n_name FROM nation")
def model_rows_to_documents(spark, sf_dir):
    d = table(spark, sf_dir, "nation").select(F.to_json(F.struct("*")).alias("d"))
    return d.select(F.from_json("d", "n_nationkey int, n_name string").alias("x")).select("x.*")


@query("model_documents_to_graph", "SELECT 'NATION_3' AS name")
def model_documents_to_graph(spark, sf_dir):
    d = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("id"), F.array(F.lit("doc")).alias("labels"), F.from_json(F.to_json(F.struct("*")), "map<string,string>").alias("properties"))
    g = G.Graph(d, star(spark, sf_dir).edges.limit(0))
    return G.run(g, "MATCH (n:doc {n_nationkey: 3}) RETURN n.n_name AS name")


@query("cypher_write", "SELECT n_name AS name, CASE WHEN n_regionkey = 1 THEN 'x' END AS mark FROM nation WHERE n_regionkey <> 2 UNION ALL SELECT 'new', NULL")
def cypher_write(spark, sf_dir):
    """CREATE, SET, REMOVE and DELETE as text."""
    g = star(spark, sf_dir).filter_labels(["Nation"])
    for text in ("MATCH (n:Nation) WHERE n.n_regionkey = 2 DELETE n", "MATCH (n:Nation {n_regionkey: 1}) SET n.mark = 'x', n:Seen", "MATCH (n:Seen) REMOVE n:Seen", "CREATE (a:Nation {n_name: 'new'})-[:NEAR]->(b:Other)"):
        g = G.execute(g, text)
    return G.run(g, "MATCH (n:Nation) RETURN n.n_name AS name, n.mark AS mark")


@query("model_nested_to_graph", "SELECT r_name AS region, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def model_nested_to_graph(spark, sf_dir):
    """Nested documents become nodes: regions with an array of nations."""
    n = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.collect_list(F.struct("n_nationkey", "n_name")).alias("nations"))
    docs = table(spark, sf_dir, "region").join(n, F.col("n_regionkey") == F.col("r_regionkey")).select("r_regionkey", "r_name", "nations")
    g = G.from_documents(docs, "Region", "r_regionkey", {"nations": "Nation"})
    return G.run(g, "MATCH (r:Region)-[:nations]->(n:Nation) RETURN r.r_name AS region, count(n) AS n")
