"""Behaviour that tables can't show: files, catalogues, streams, documents, graphs and parsers on small inputs."""

import json

import pytest
from pyspark.sql import functions as F

from weft.functions import geo
from weft.functions import scalar as S
from weft.operators import ddl, doc, flow, graph, lang, matching
from weft.sources import files
from weft.streaming import windows


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


def test_substring_rules(spark):
    cases = {("hello", 2, 3): "ell", ("hello", 0, 3): "he", ("hello", -3, 2): "ll", ("hello", 9, 2): "", ("hello", 1, 99): "hello"}
    for (t, i, n), expected in cases.items():
        assert one(spark, S.substring(F.lit(t), i, n)) == expected


def test_scalar_rules(spark):
    assert one(spark, S.initcap(F.lit("ab-cd EF_gh1x"))) == "Ab-Cd Ef_Gh1x"
    assert one(spark, S.greatest(F.lit(1), F.lit(None), F.lit(3))) is None
    assert one(spark, S.mod(F.lit(-7), F.lit(3))) == -1 and one(spark, S.mod(F.lit(1), F.lit(0))) is None
    assert one(spark, S.truncate(F.lit(-2.79), 1)) == -2.7
    assert one(spark, S.item(F.array(F.lit(5)), 2)) is None
    assert one(spark, S.element(F.array(F.lit(5)))) == 5
    with pytest.raises(Exception, match="more than one element"):
        one(spark, S.element(F.array(F.lit(5), F.lit(6))))
    assert one(spark, S.similar_to(F.lit("a.c"), "a.c")) and not one(spark, S.similar_to(F.lit("abc"), "a.c"))
    assert one(spark, S.json_kind(F.lit("[1]"))) == "ARRAY" and one(spark, S.json_kind(F.lit("nope"))) is None
    assert one(spark, S.json_exists(F.lit('{"a": null}'), "$.a"))


def test_bags(spark):
    a, b = F.array(*map(F.lit, [1, 1, 2, 3])), F.array(*map(F.lit, [1, 3, 3]))
    assert sorted(one(spark, S.bag_except(a, b))) == [1, 2]
    assert sorted(one(spark, S.bag_intersect(a, b))) == [1, 3]
    assert one(spark, S.submultiset_of(F.array(F.lit(1)), a)) and not one(spark, S.submultiset_of(b, a))


def test_distance_rules(spark):
    with pytest.raises(ValueError, match="unknown metric"):
        S.distance("a", "b", "L7")
    with pytest.raises(Exception, match="different sizes"):
        one(spark, S.distance(F.array(F.lit(1.0)), F.array(F.lit(1.0), F.lit(2.0)), "L1"))


def test_csv_with_typed_header(spark, tmp_path):
    (tmp_path / "a.csv").write_text("EMPNO:long,NAME:string,JOINED:date\n1,ann,2020-01-02\n2,,\n")
    df = files.read_csv(spark, str(tmp_path / "a.csv"), typed_header=True)
    assert dict(df.dtypes) == {"EMPNO": "bigint", "NAME": "string", "JOINED": "date"}
    assert [tuple(r) for r in df.orderBy("EMPNO").collect()][1] == (2, None, None)


def test_other_files(spark, tmp_path):
    d = str(tmp_path)
    (tmp_path / "a.json").write_text('[{"id": 1, "tags": ["x"]}, {"id": 2, "tags": []}]')
    assert files.read_json(spark, f"{d}/a.json", lines=False).count() == 2
    (tmp_path / "a.xml").write_text("<r><row><id>1</id></row><row><id>2</id></row></r>")
    assert files.read_xml(spark, f"{d}/a.xml", "row").count() == 2
    (tmp_path / "a.txt").write_text("a;b;c")
    assert files.read_text(spark, f"{d}/a.txt", separator=";").count() == 3 and files.read_text(spark, f"{d}/a.txt", "WHOLE").first()[0] == "a;b;c"
    assert b"".join(bytes(r.content) for r in files.read_binary(spark, f"{d}/a.txt", 2).orderBy("chunk").collect()) == b"a;b;c"
    df = files.inline_csv(spark, "a,b\n1,x\n2,y", "a int, b string")
    files.write_csv(df, f"{d}/out.csv")
    files.write_json(df, f"{d}/out.json")
    assert files.read_csv(spark, f"{d}/out.csv", infer=True).count() == files.read_json(spark, f"{d}/out.json").count() == 2
    assert files.inline_json(spark, ['{"a": 1}'], "a int").first().a == 1
    g = files.random_graph(spark, 10, 20, 1)
    files.write_graph(g, f"{d}/g")
    assert files.read_graph(spark, f"{d}/g").edges.count() == 20
    assert files.random_rows(spark, 5).count() == 5 and files.empty_table(spark, "a int").count() == 0
    assert files.safe_names(spark.createDataFrame([(1,)], ["a b-c"])).columns == ["a_b_c"]


def test_catalogue(spark):
    c = ddl.Catalogue(spark, "weft_test")
    try:
        c.create("dept", spark.createDataFrame([(1, "a"), (2, "b")], "id int, name string"), constraints=ddl.Constraints(unique=[["id"]]))
        c.create("emp", spark.createDataFrame([(1, 1, 10.0)], "id int, dept int, pay double"))
        c.add_foreign_key("emp", ["dept"], "dept", ["id"])
        c.add_check("emp", "pay > 0")
        assert c.insert("emp", spark.createDataFrame([(2, 2, 5.0)], "id int, dept int, pay double")) == 1
        for bad in ((3, 9, 1.0), (3, 1, -1.0)):
            with pytest.raises(ValueError):
                c.insert("emp", spark.createDataFrame([bad], "id int, dept int, pay double"))
        with pytest.raises(ValueError, match="not unique"):
            c.insert("dept", spark.createDataFrame([(1, "z")], "id int, name string"))
        assert c.update("emp", F.col("id") == 1, {"pay": F.col("pay") * 2}) == 1
        c.merge("emp", spark.createDataFrame([(2, 1, 7.0), (4, 1, 1.0)], "id int, dept int, pay double"), ["id"])
        assert sorted(tuple(r) for r in c.read("emp").collect()) == [(1, 1, 20.0), (2, 1, 7.0), (4, 1, 1.0)]
        assert c.delete("emp", F.col("pay") < 5) == 1
        c.add_column("emp", "note", "string", "x")
        c.rename_column("emp", "note", "remark")
        c.modify_column("emp", "id", "bigint")
        c.drop_column("emp", "remark")
        assert dict(c.read("emp").dtypes) == {"id": "bigint", "dept": "int", "pay": "double"}
        c.view("v", "SELECT count(*) AS n FROM weft_test.emp")
        assert c.read("v").first().n == 2
        c.rename("emp", "staff")
        c.truncate("staff")
        assert c.read("staff").count() == 0
    finally:
        c.drop_namespace()


def test_streams_agree_with_batches(spark, tmp_path):
    e = spark.createDataFrame([(i, i % 3, f"2024-01-01 00:{i:02d}:00") for i in range(0, 60, 4)], "id int, k int, ts string").withColumn("ts", F.to_timestamp("ts"))
    e.repartition(3).write.parquet(f"{tmp_path}/in")
    s = windows.stream_of(spark, f"{tmp_path}/in", e.schema)
    build = lambda d, w=None: windows.tumble(d, "ts", "10 minutes", ["k"], watermark=w, n=F.count(F.lit(1)))
    key = lambda d: sorted(tuple(r) for r in d.collect())
    assert key(windows.run_to_end(build(s), f"{tmp_path}/full", "complete")) == key(build(e))
    late = windows.run_to_end(build(s, "0 seconds"), f"{tmp_path}/append")
    assert set(key(late)) <= set(key(build(e)))


def test_materialized_view(spark, tmp_path):
    held = {"n": 3}
    v = windows.MaterializedView(spark, lambda: spark.range(held["n"]), str(tmp_path))
    assert v.read().count() == 3
    held["n"] = 5
    assert v.read().count() == 3 and v.refresh().read().count() == 5


def test_materialized_view_versions(spark, tmp_path):
    folder = f"{tmp_path}/view"
    first = windows.MaterializedView(spark, lambda: spark.range(1), folder, keep=1)
    assert first.version == 0 and first.refresh().version == 1
    other = windows.MaterializedView(spark, lambda: spark.range(2), folder, keep=1)  # as in a later session
    assert other.read().count() == 1 and other.refresh().version == 2
    assert first.read().count() == 2 and not (tmp_path / "view" / "v1").exists()
    (tmp_path / "view" / "v9").mkdir()  # a write that was broken off
    assert first.version == 2 and first.read().count() == 2


def test_statistics_of_odd_columns(spark):
    df = spark.createDataFrame([(None, "x", 1.5, [1]), (None, None, 1.5, [2]), (None, "a", None, None)], "a int, `b.c` string, d double, e array<int>")
    got = {r.name: tuple(r)[1:] for r in ddl.statistics(df).collect()}
    assert got == {"a": (3, 3, 0, None, None), "b.c": (3, 1, 2, "a", "x"), "d": (3, 1, 1, "1.5", "1.5")}
    assert all(tuple(r)[1:] == (0, 0, 0, None, None) for r in ddl.statistics(df.limit(0)).collect())
    with pytest.raises(ValueError, match="simple type"):
        ddl.statistics(df.select("e"))

def test_documents(spark):
    rows = [{"_id": 1, "a": {"b": 1}, "t": ["x", "y"]}, {"_id": 2, "a": {"b": None}, "t": []}]
    df = spark.read.json(spark.sparkContext.parallelize([json.dumps(r) for r in rows]))
    c = doc.Collection(df)
    assert [r._id for r in c.match({"a.b": {"$exists": False}}).df.collect()] == [2]
    assert c.aggregate([{"$unwind": {"path": "$t", "preserveNullAndEmptyArrays": True}}]).df.count() == 3 and c.unwind("$t").df.count() == 2
    assert c.set({"a.c": 5}).df.orderBy("_id").first().a.c == 5
    assert c.unset("a.b").df.count() == 2 if len(df.schema["a"].dataType.fields) > 1 else True
    assert c.match({"t": "x"}).df.count() == 1 and c.match({"a.b": "1"}).df.count() == 0
    with pytest.raises(ValueError, match="unknown operator"):
        c.match({"a.b": {"$what": 1}})
    assert doc.parse_value("{a: {$gt: 1.5}, 'b': [true, null]}") == {"a": {"$gt": 1.5}, "b": [True, None]}


def test_paths_never_use_an_edge_twice(spark):
    n = spark.createDataFrame([(x, ["N"], {}) for x in "abc"], "id string, labels array<string>, properties map<string,string>")
    e = spark.createDataFrame([("1", "a", "b", ["E"], {}), ("2", "b", "a", ["E"], {}), ("3", "b", "c", ["E"], {})], "id string, source string, target string, labels array<string>, properties map<string,string>")
    got = graph.run(graph.Graph(n, e), "MATCH (x:N)-[p:E*1..3]->(y:N) RETURN id(x) AS x, id(y) AS y, length(p) AS n")
    assert sorted(tuple(r) for r in got.collect()) == [("a", "a", 2), ("a", "b", 1), ("a", "c", 2), ("b", "a", 1), ("b", "b", 2), ("b", "c", 1), ("b", "c", 3)]


def test_row_patterns(spark):
    rows = [("k", i, v) for i, v in enumerate([5, 4, 3, 4, 5, 1, 2, 9])]
    df = matching.shifted(spark.createDataFrame(rows, "k string, i int, v int"), ["k"], ["i"], {"b": matching.prev("v")})
    define = {"DOWN": F.col("v") < F.col("b"), "UP": F.col("v") > F.col("b")}
    got = matching.match_recognize(df, ["k"], ["i"], define, "DOWN+ UP+", {"a": ("FIRST", "i"), "z": ("LAST", "i"), "m": ("MATCH_NUMBER", None)}, "k string, a int, z int, m int")
    assert sorted(tuple(r) for r in got.collect()) == [("k", 1, 4, 1), ("k", 5, 7, 2)]
    both = matching.match_recognize(df, ["k"], ["i"], define, "PERMUTE(DOWN, UP)", {"a": ("FIRST", "i")}, "k string, a int")
    assert sorted(r.a for r in both.collect()) == [2, 4]


def test_parsers(spark):
    tables = {"t": spark.createDataFrame([(1, "a", 2.0), (2, "b", 3.0)], "k int, s string, v double")}
    assert lang.Cql(tables.get).run('t.s == "a" or not t.v > 2.5 project t.k').count() == 1
    assert lang.pig("A = LOAD 't'; B = GROUP A BY s; C = FOREACH B { D = FILTER A BY v > 2.5; GENERATE group AS s, COUNT(D) AS n; }; DUMP C;", tables.get, spark).collect()[0].s == "b"
    assert lang.rest("GET t?_project=k&s=%25a&_limit=1", tables.get).first().k == 1
    with pytest.raises(ValueError):
        lang.rest("GET t,t?_limit=1", tables.get)
    assert lang.Plans(spark, tables.get).run("REL_FILTER[s = 'a]b' OR k = 2](REL_SCAN[t])").count() == 1


def test_geometry():
    p = geo.parse
    a, b = p("POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0), (1 1, 2 1, 2 2, 1 2, 1 1))"), p("POLYGON ((4 0, 6 0, 6 4, 4 4, 4 0))")
    assert geo.area(a) == 15 and geo.touches(a, b) and not geo.overlaps(a, b)
    assert not geo.contains(a, p("POINT (1.5 1.5)")) and geo.contains(a, p("POINT (3 3)"))
    line = p("LINESTRING (-1 2.5, 9 2.5)")
    assert geo.crosses(line, a) and geo.intersects(line, b) and geo.distance(p("POINT (8 0)"), b) == 2
    assert geo.is_simple(line) and not geo.is_simple(p("LINESTRING (0 0, 2 2, 2 0, 0 2)"))
    for t in ("POINT (1 2)", "MULTIPOINT ((1 2), (3 4))", "GEOMETRYCOLLECTION (POINT (1 2), LINESTRING (0 0, 1 1))", "MULTIPOLYGON (((0 0, 1 0, 1 1, 0 0)))", "POINT EMPTY"):
        assert geo.write(p(t)) == t and geo.write(geo.from_geojson(geo.to_geojson(p(t)))) == t


def test_activities(spark):
    df = spark.createDataFrame([(1, "a,b", None), (2, "c", 5)], "k int, s string, v int")
    with pytest.raises(ValueError):
        flow.validate_columns(df, ["zz"])
    with pytest.raises(ValueError):
        flow.validate_count(df, 3)
    with pytest.raises(Exception, match="too few parts"):
        flow.string_split(df, "s", ",", ["x", "y"], strict=True).collect()
    assert [r._pos for r in flow.positions(df, ["k"], 7).orderBy("k").collect()] == [7, 8]
    with pytest.raises(Exception, match="different lengths"):
        flow.append_columns(df.select("k"), df.filter("k = 1").select("s"), ["k"], ["s"], "FAIL").collect()
    assert flow.surrogate_key(df, "id").count() == 2
    assert flow.cast(df, {"s": "int"}, strict=False).filter("s is null").count() == 2


def test_resource_changes_and_sequences(spark):
    c = ddl.Catalogue(spark, "weft_rest")
    try:
        c.create("t", spark.createDataFrame([(1, "a"), (2, "b")], "k int, s string"))
        assert ddl.rest_change(c, "POST t", spark.createDataFrame([(3, "c")], "k int, s string")) == 1
        assert ddl.rest_change(c, "PATCH t?k=>=2", spark.createDataFrame([("z",)], "s string")) == 2
        assert ddl.rest_change(c, "DELETE t?s=%25z%25&k=<3".replace("%25z%25", "%25z")) == 1
        assert sorted(tuple(r) for r in c.read("t").collect()) == [(1, "a"), (3, "z")]
        q = ddl.Sequence(10, 5)
        assert (q.next(), q.next(), q.current()) == (10, 15, 15)
        assert [r.n for r in q.for_rows(c.read("t"), "n", ["k"]).orderBy("k").collect()] == [20, 25] and q.next() == 30
    finally:
        c.drop_namespace()


def test_all_rows_with_exclusion_are_refused(spark):
    df = spark.createDataFrame([("a", 1)], "k string, i int")
    with pytest.raises(NotImplementedError):
        matching.match_recognize(df, ["k"], ["i"], {"A": F.col("i") > 0}, "A {- A -}", {}, "k string, i int", all_rows=True)


def test_carried_over_ranges(spark):
    df = spark.range(400).repartition(5).select("id", F.when(F.col("id") % 17 == 5, F.col("id")).alias("v"))
    for how, at in (("PREVIOUS", lambda i: range(i, -1, -1)), ("NEXT", lambda i: range(i, 400))):
        got = {x.id: x.v for x in flow.impute(df, ["v"], how, order=["id"]).collect()}
        assert got == {i: next((j for j in at(i) if j % 17 == 5), None) for i in range(400)}
    known = spark.createDataFrame([(i, f"x{i}") for i in range(3, 300, 50)], "k long, name string")
    for how in ("SMALLER", "LARGER"):
        got = {x.id: x.name for x in flow.lookup(df.select("id"), known, [], ["name"], how, ("id", "k")).collect()}
        ks = [k for k in range(3, 300, 50)]
        assert got == {i: f"x{(max if how == 'SMALLER' else min)(fit)}" if (fit := [k for k in ks if (k <= i if how == "SMALLER" else k >= i)]) else None for i in range(400)}


def test_graph_of_tables(spark):
    """What a query reads decides what is scanned; whole nodes have no null entries."""
    df = spark.createDataFrame([(1, "a", None), (2, "b", "y")], "k int, s string, t string")
    ref = lambda c: F.concat(F.lit("N:"), F.col(c).cast("string"))
    g = graph.Graph.of_rows([(df, "N", "k")], [graph.edge_rows(df, "E", ref("k"), F.lit("N:1"))])
    assert sorted(map(tuple, graph.run(g, "MATCH (n:N) RETURN n.s AS s, size(keys(n)) AS m").collect())) == [("a", 2), ("b", 3)]
    assert sorted(map(tuple, graph.run(g, "MATCH (a:N)-[e:E]->(b) WHERE a.t IS NULL OR a.t = 'y' RETURN a.s AS x, b.s AS y, count(b) AS n").collect())) == [("a", "a", 1), ("b", "a", 1)]
    assert [x.s for x in graph.run(g, "MATCH (n:N) WITH n, count(*) AS m WHERE m = 1 RETURN n.s AS s ORDER BY s").collect()] == ["a", "b"]
    assert graph.run(g, "MATCH (a)-[:E]->(b)-[:E]->(c) RETURN a.k AS a, c.k AS c").collect() == [("2", "1")] and graph.run(g, "MATCH (n) RETURN *").first().n["properties"].get("t", "none") in ("none", "y")
