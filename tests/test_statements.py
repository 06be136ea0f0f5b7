"""Statements that must fail, and what they leave."""

import pytest

from weft.operators import doc, graph, sql
from weft.operators.statements import Statements


@pytest.fixture
def on(spark):
    spark.sql("DROP DATABASE IF EXISTS weft_test CASCADE")
    yield Statements(spark, "weft_test")
    spark.catalog.setCurrentDatabase("default")
    spark.sql("DROP DATABASE IF EXISTS weft_test CASCADE")


def test_constraints_hold(on):
    on.execute("CREATE TABLE p (id INTEGER PRIMARY KEY, v INTEGER NOT NULL)")
    assert on.execute("INSERT INTO p VALUES (1, 2), (2, 3)") == 2
    for bad in ("INSERT INTO p VALUES (1, 5)", "INSERT INTO p VALUES (9, NULL)", "INSERT INTO p (v) VALUES (4)", "UPDATE p SET id = 1"):
        with pytest.raises(ValueError):
            on.execute(bad)
    assert sorted(map(tuple, on.execute("SELECT * FROM p").collect())) == [(1, 2), (2, 3)]
    assert on.execute("UPDATE p SET v = 7 WHERE id = 2") == 1 and on.execute("DELETE FROM p") == 2
    for bad in ("ALTER TABLE p SHRINK", "DROP TABLE nothing", "CREATE SOMETHING x"):
        with pytest.raises(ValueError):
            on.execute(bad)
    on.execute("DROP TABLE IF EXISTS nothing")


def test_merge_of_several_matches_fails(on):
    on.execute("CREATE TABLE p AS SELECT 1 AS id, 'a' AS v")
    with pytest.raises(ValueError):
        on.execute("MERGE INTO p USING (SELECT * FROM VALUES (1, 'x'), (1, 'y') AS s(k, w)) AS s ON p.id = s.k WHEN MATCHED THEN UPDATE SET v = s.w")
    assert [tuple(r) for r in on.execute("TABLE p").collect()] == [(1, "a")]


def test_one_of_equal_documents(spark):
    c = doc.Collection(spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (2, None)], "k int, v string"))
    rows = lambda x: sorted(((r.k, r.v or "") for r in x.df.collect()))
    assert rows(c.delete_one({"k": 1})) == [(1, "a"), (1, "b"), (2, "")]
    assert rows(c.delete_one({"k": 5})) == rows(c)
    assert rows(c.update_one({"k": 1}, {"$set": {"v": "z"}})) == [(1, "a"), (1, "b"), (1, "z"), (2, "")]
    assert rows(c.replace_one({"v": "b"}, {"k": 9, "v": "n"})) == [(1, "a"), (1, "a"), (2, ""), (9, "n")]
    assert rows(c.delete({"v": "a"})) == [(1, "b"), (2, "")]


def test_paths_of_any_length(spark):
    ids = [f"n{i}" for i in range(7)]
    nodes = spark.createDataFrame([(i, ["N"], {"k": i}) for i in ids], "id string, labels array<string>, properties map<string,string>")
    links = [(f"e{a}", a, b, ["L"], {}) for a, b in zip(ids, ids[1:])]
    g = graph.Graph(nodes, spark.createDataFrame(links, "id string, source string, target string, labels array<string>, properties map<string,string>"))
    count = lambda text: graph.run(g, text).count()
    assert count("MATCH (a)-[*]->(b) RETURN a.k AS a, b.k AS b") == 21
    assert count("MATCH (a)-[*3..]->(b) RETURN a.k AS a, b.k AS b") == 10
    assert count("MATCH (a)-[*..2]->(b) RETURN a.k AS a, b.k AS b") == 11
    ring = graph.Graph(nodes, g.edges.unionByName(spark.createDataFrame([("back", "n6", "n0", ["L"], {})], g.edges.schema)))
    assert graph.run(ring, "MATCH (a)-[*]->(b) RETURN a.k AS a").count() == 49


def test_text_is_not_syntax():
    for text in ("SELECT 'ORDER BY x / 0 DESC'", "SELECT \"{fn ABS(x)}\" AS a", "SELECT '{d ''x''}'"):
        assert sql.translated(text) == text
    assert sql.translated("SELECT a -- ORDER BY b\nFROM t").split() == ["SELECT", "a", "FROM", "t"]
