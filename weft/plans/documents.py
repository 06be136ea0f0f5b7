"""Document pipelines and statements."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.operators import doc
from weft.plans.base import Catalog, table

_C = Catalog()
QUERIES, ORACLE = _C.queries, _C.oracle


def _mql(name: str, text: str, sql: str, shape=None, finish=None) -> None:
    """A statement over a table as a collection (or over what shape makes of it)."""

    def run(spark, sf_dir):
        out = doc.run(text, lambda n: shape(table(spark, sf_dir, n)) if shape else table(spark, sf_dir, n))
        return finish(out) if finish else out

    _C.query(name, sql)(run)


_mql("mql_find", 'db.part.find({p_size: {$gt: 40}, p_brand: "Brand#2"}, {p_partkey: 1, p_name: 1})', "SELECT p_partkey, p_name FROM part WHERE p_size > 40 AND p_brand = 'Brand#2'")
_mql("mql_find_sorted", "db.customer.find({c_acctbal: {$lt: 0}}, {c_custkey: 1, c_acctbal: 1}).sort({c_acctbal: 1, c_custkey: 1}).limit(5)", "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal < 0 ORDER BY c_acctbal, c_custkey LIMIT 5")
_mql("mql_count", "db.orders.countDocuments({o_orderstatus: {$in: ['F', 'P']}})", "SELECT count(*) AS count FROM orders WHERE o_orderstatus IN ('F', 'P')")
_mql("mql_logic", "db.part.find({$or: [{p_size: 1}, {$and: [{p_size: {$gte: 20}}, {p_size: {$lte: 22}}]}], $nor: [{p_type: 'SMALL'}], p_brand: {$nin: ['Brand#1', 'Brand#2']}, p_name: {$not: {$regex: '^RED', $options: 'i'}}}, {p_partkey: 1})",
     "SELECT p_partkey FROM part WHERE (p_size = 1 OR p_size BETWEEN 20 AND 22) AND p_type <> 'SMALL' AND p_brand NOT IN ('Brand#1', 'Brand#2') AND lower(p_name) NOT LIKE 'red%'")
_mql("mql_types", "db.nation.find({n_nationkey: {$type: 'int', $mod: [3, 1], $exists: true}, nothing: {$exists: false}, n_name: {$gt: 5}}, {n_name: 1})", "SELECT n_name FROM nation WHERE false")
_mql("mql_mod_ne", "db.nation.find({n_nationkey: {$mod: [3, 1]}, n_regionkey: {$ne: 2}}, {n_name: 1})", "SELECT n_name FROM nation WHERE n_nationkey % 3 = 1 AND n_regionkey <> 2")
_mql("mql_group", "db.orders.aggregate([{$match: {o_orderstatus: 'F'}}, {$group: {_id: '$o_orderpriority', n: {$count: {}}, total: {$sum: '$o_totalprice'}, mean: {$avg: '$o_totalprice'}, lo: {$min: '$o_totalprice'}, hi: {$max: '$o_totalprice'}}}])",
     "SELECT o_orderpriority AS _id, count(*) AS n, round(sum(o_totalprice), 1) AS total, round(avg(o_totalprice), 3) AS mean, min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders WHERE o_orderstatus = 'F' GROUP BY 1",
     None, lambda d: d.withColumns({"total": F.round("total", 1), "mean": F.round("mean", 3)}))
_mql("mql_group_all", "db.lineitem.aggregate([{$group: {_id: null, sp: {$stdDevPop: '$l_quantity'}, ss: {$stdDevSamp: '$l_quantity'}}}])",
     "SELECT CAST(NULL AS VARCHAR) AS _id, round(stddev_pop(l_quantity), 6) AS sp, round(stddev_samp(l_quantity), 6) AS ss FROM lineitem", None, lambda d: d.withColumns({"sp": F.round("sp", 6), "ss": F.round("ss", 6)}))
_mql("mql_project_math", "db.part.aggregate([{$project: {p_partkey: 1, a: {$add: ['$p_size', 1]}, s: {$subtract: ['$p_size', 1]}, m: {$multiply: ['$p_size', 2]}, d: {$divide: ['$p_size', 4]}, r: {$mod: ['$p_size', 7]}, w: {$pow: ['$p_size', 2]}, q: {$abs: {$subtract: ['$p_size', 30]}}, l: {$literal: 'x'}, f: {$floor: '$p_retailprice'}, c: {$ceil: '$p_retailprice'}, t: {$sum: ['$p_size', 5]}}}])",
     "SELECT p_partkey, p_size + 1 AS a, p_size - 1 AS s, p_size * 2 AS m, p_size / 4 AS d, p_size % 7 AS r, power(p_size, 2) AS w, abs(p_size - 30) AS q, 'x' AS l, floor(p_retailprice) AS f, ceil(p_retailprice) AS c, p_size + 5 AS t FROM part")
_mql("mql_trig", "db.part.aggregate([{$project: {p_partkey: 1, a: {$sin: '$p_size'}, b: {$cos: '$p_size'}, c: {$atan: '$p_size'}, d: {$ln: '$p_size'}, e: {$log10: '$p_size'}, f: {$sqrt: '$p_size'}, g: {$degreesToRadians: '$p_size'}, h: {$atan2: ['$p_size', 3]}}}])",
     "SELECT p_partkey, round(sin(p_size), 8) AS a, round(cos(p_size), 8) AS b, round(atan(p_size), 8) AS c, round(ln(p_size), 8) AS d, round(log10(p_size), 8) AS e, round(sqrt(p_size), 8) AS f, round(radians(p_size), 8) AS g, round(atan2(p_size, 3), 8) AS h FROM part",
     None, lambda d: d.select("p_partkey", *[F.round(c, 8).alias(c) for c in "abcdefgh"]))
_mql("mql_set_unset", "db.nation.aggregate([{$addFields: {twice: {$multiply: ['$n_nationkey', 2]}}}, {$set: {mark: 'n'}}, {$unset: ['n_regionkey']}])", "SELECT n_nationkey, n_name, n_nationkey * 2 AS twice, 'n' AS mark FROM nation")
_mql("mql_exclude", "db.orders.aggregate([{$project: {o_totalprice: 0, o_orderdate: 0}}, {$sort: {o_orderkey: -1}}, {$skip: 3}, {$limit: 4}])", "SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority FROM orders ORDER BY o_orderkey DESC LIMIT 4 OFFSET 3")
_mql("mql_count_stage", "db.events.aggregate([{$match: {event_type: 'click'}}, {$count: 'n'}])", "SELECT count(*) AS n FROM events WHERE event_type = 'click'")
_mql("mql_expr", "db.lineitem.find({$expr: {$gt: ['$l_quantity', {$multiply: ['$l_linenumber', 10]}]}}, {l_orderkey: 1, l_linenumber: 1})", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > l_linenumber * 10")

_nested = lambda d: d.select("n_nationkey", F.struct("n_name", F.struct("n_regionkey").alias("where")).alias("info"), F.array("n_nationkey", "n_regionkey").alias("keys"))
_mql("mql_nested", "db.nation.aggregate([{$match: {'info.where.n_regionkey': {$gte: 2}}}, {$project: {n_nationkey: 1, 'name': '$info.n_name', r: '$info.where.n_regionkey'}}])", "SELECT n_nationkey, n_name AS name, n_regionkey AS r FROM nation WHERE n_regionkey >= 2", _nested)
_mql("mql_unwind", "db.nation.aggregate([{$unwind: '$keys'}, {$project: {n_nationkey: 1, keys: 1}}])", "SELECT n_nationkey, unnest([n_nationkey, n_regionkey]) AS keys FROM nation", _nested)
_mql("mql_replace_root", "db.nation.aggregate([{$replaceRoot: {newRoot: '$info'}}, {$project: {n_name: 1}}])", "SELECT n_name FROM nation", _nested)
_mql("mql_arrays", "db.nation.find({keys: {$size: 2, $all: [3], $elemMatch: {$gt: 2}}}, {n_nationkey: 1})", "SELECT n_nationkey FROM nation WHERE n_nationkey = 3 OR n_regionkey = 3", _nested)
_mql("mql_array_contains", "db.nation.find({keys: 4}, {n_nationkey: 1, first: {$arrayElemAt: ['$keys', 0]}, last: {$arrayElemAt: ['$keys', -1]}})", "SELECT n_nationkey, n_nationkey AS first, n_regionkey AS last FROM nation WHERE n_nationkey = 4 OR n_regionkey = 4", _nested)
_mql("mql_slice", "db.nation.find({}, {n_nationkey: 1, keys: {$slice: -1}})", "SELECT n_nationkey, [n_regionkey] AS keys FROM nation", _nested)
_mql("mql_update", "db.nation.updateMany({n_regionkey: {$gte: 3}}, {$set: {n_name: 'far'}, $inc: {n_nationkey: 100}, $mul: {n_regionkey: 2}})", "SELECT CASE WHEN n_regionkey >= 3 THEN n_nationkey + 100 ELSE n_nationkey END AS n_nationkey, CASE WHEN n_regionkey >= 3 THEN 'far' ELSE n_name END AS n_name, CASE WHEN n_regionkey >= 3 THEN n_regionkey * 2 ELSE n_regionkey END AS n_regionkey FROM nation")
_mql("mql_update_min_max", "db.nation.updateMany({}, {$min: {n_nationkey: 10}, $max: {n_regionkey: 2}, $rename: {n_name: 'label'}})", "SELECT least(n_nationkey, 10) AS n_nationkey, greatest(n_regionkey, 2) AS n_regionkey, n_name AS label FROM nation")
_mql("mql_update_set_add", "db.nation.updateMany({}, {$addToSet: {keys: 7}, $unset: {info: ''}})", "SELECT n_nationkey, list_sort(list_distinct(list_append([n_nationkey, n_regionkey], 7))) AS keys FROM nation", _nested, lambda d: d.select("n_nationkey", F.array_sort(F.array_distinct("keys")).alias("keys")))
_mql("mql_update_pipeline", "db.nation.updateMany({n_regionkey: 1}, [{$set: {n_name: 'one'}}])", "SELECT n_nationkey, CASE WHEN n_regionkey = 1 THEN 'one' ELSE n_name END AS n_name, n_regionkey FROM nation")
_mql("mql_delete", "db.nation.deleteMany({n_regionkey: {$lt: 3}})", "SELECT * FROM nation WHERE n_regionkey >= 3")
_mql("mql_replace", "db.nation.replaceOne({n_nationkey: 3}, {n_nationkey: 300, n_name: 'new', n_regionkey: null})", "SELECT CASE WHEN n_nationkey = 3 THEN 300 ELSE n_nationkey END AS n_nationkey, CASE WHEN n_nationkey = 3 THEN 'new' ELSE n_name END AS n_name, CASE WHEN n_nationkey <> 3 THEN n_regionkey END AS n_regionkey FROM nation")

_points = lambda d: d.select("p_partkey", F.array((F.col("p_size") % 11).cast("double"), (F.col("p_size") % 7).cast("double")).alias("loc"))
_mql("mql_geo_box", "db.part.find({loc: {$geoWithin: {$box: [[2, 1], [6, 4]]}}}, {p_partkey: 1})", "SELECT p_partkey FROM part WHERE p_size % 11 BETWEEN 2 AND 6 AND p_size % 7 BETWEEN 1 AND 4", _points)
_mql("mql_geo_circle", "db.part.find({loc: {$geoWithin: {$center: [[3, 3], 2.5]}}}, {p_partkey: 1})", "SELECT p_partkey FROM part WHERE sqrt(power(p_size % 11 - 3, 2) + power(p_size % 7 - 3, 2)) <= 2.5", _points)
_mql("mql_geo_near", "db.part.aggregate([{$geoNear: {near: [3, 3], key: 'loc', distanceField: 'dist', maxDistance: 3}}, {$project: {p_partkey: 1, dist: 1}}])", "SELECT p_partkey, round(sqrt(power(p_size % 11 - 3, 2) + power(p_size % 7 - 3, 2)), 8) AS dist FROM part WHERE sqrt(power(p_size % 11 - 3, 2) + power(p_size % 7 - 3, 2)) <= 3", _points, lambda d: d.withColumn("dist", F.round("dist", 8)))
_mql("mql_json_events", "db.events.aggregate([{$match: {'props.k': {$gte: 50}}}, {$group: {_id: '$event_type', n: {$count: {}}, k: {$sum: '$props.k'}}}])", "SELECT event_type AS _id, count(*) AS n, sum(CAST(props->>'$.k' AS DOUBLE)) AS k FROM events WHERE CAST(props->>'$.k' AS INT) >= 50 GROUP BY 1",
     lambda d: d.withColumn("props", F.from_json("props", "k int")))

_N = "n_nationkey, n_name, n_regionkey"
_mql("mql_delete_one", "db.nation.deleteOne({n_regionkey: 2, n_nationkey: {$gte: 10}})", f"SELECT {_N} FROM nation WHERE n_nationkey <> (SELECT n_nationkey FROM nation WHERE n_regionkey = 2 AND n_nationkey >= 10 ORDER BY '{{\"n_nationkey\":' || n_nationkey || ',' LIMIT 1)")
_mql("mql_update_one", "db.nation.updateOne({n_regionkey: 1}, {$set: {n_name: 'one'}, $inc: {n_regionkey: 10}})", "SELECT n_nationkey, CASE WHEN h THEN 'one' ELSE n_name END AS n_name, CASE WHEN h THEN n_regionkey + 10 ELSE n_regionkey END AS n_regionkey FROM (SELECT *, n_nationkey = (SELECT n_nationkey FROM nation WHERE n_regionkey = 1 ORDER BY CAST(n_nationkey AS VARCHAR) || ',' LIMIT 1) AS h FROM nation) AS x")
_mql("mql_insert", "db.region.insertMany([{r_regionkey: 90, r_name: 'NORTH'}, {r_regionkey: 91, r_name: null, note: 'new'}])", "SELECT r_regionkey, r_name, CAST(NULL AS VARCHAR) AS note FROM region UNION ALL VALUES (90, 'NORTH', NULL), (91, NULL, 'new')")
_mql("mql_find_one_and_update", "db.nation.findOneAndUpdate({n_regionkey: 3}, {$set: {n_name: 'x'}}, {sort: {n_nationkey: -1}, returnNewDocument: true})", "SELECT n_nationkey, 'x' AS n_name, n_regionkey FROM nation WHERE n_regionkey = 3 ORDER BY n_nationkey DESC LIMIT 1")
_mql("mql_find_one_and_delete", "db.nation.findOneAndDelete({n_regionkey: 3}, {sort: {n_nationkey: 1}})", "SELECT * FROM nation WHERE n_regionkey = 3 ORDER BY n_nationkey LIMIT 1")
_mql("mql_find_one_and_replace", "db.nation.findOneAndReplace({n_nationkey: 4}, {n_nationkey: 44, n_name: 'z', n_regionkey: 9}, {returnDocument: 'after'})", "SELECT 44 AS n_nationkey, 'z' AS n_name, 9 AS n_regionkey")
_mql("mql_find_and_modify", "db.nation.findAndModify({query: {n_nationkey: 4}, update: {$mul: {n_nationkey: 3}}, new: true})", "SELECT 12 AS n_nationkey, n_name, n_regionkey FROM nation WHERE n_nationkey = 4")
_mql("mql_upsert", "db.region.updateOne({r_regionkey: 77}, {$set: {r_name: 'FAR'}}, {upsert: true})", "SELECT * FROM region UNION ALL VALUES (77, 'FAR')")


def _database(name: str, statements: list[str], sql: str) -> None:
    """The rows of the last of several statements on the collections nation and region."""

    def run(spark, sf_dir):
        db, out = doc.Database(spark, {n: table(spark, sf_dir, n) for n in ("nation", "region")}), None
        for s in statements:
            out = db.execute(s)
        return out

    _C.query(name, sql)(run)


_database("mql_collections", ["db.createCollection('box')", "db.box.insertOne({_id: 1, a: 'x'})", "db.box.insertMany([{_id: 2, a: 'y', b: {c: 5}}, {_id: 3, a: 'y'}])", "db.box.save({_id: 1, a: 'saved'})", "db.box.updateMany({a: 'y'}, {$set: {a: 'w'}})", "db.box.deleteOne({a: 'w', _id: 3})", "db.box.renameCollection('crate')", "db.crate.find({}, {_id: 1, a: 1, c: '$b.c'})"],
          "SELECT * FROM (VALUES (1, 'saved', NULL), (2, 'w', 5)) AS t(_id, a, c)")
_database("mql_show", ["db.createCollection('box')", "db.createView('asia', 'region', [{$match: {r_name: 'ASIA'}}])", "db.region.drop()", "show collections"], "SELECT unnest(['asia', 'box', 'nation']) AS name")
_database("mql_use", ["use other", "db.createCollection('a')", "use db", "show dbs"], "SELECT unnest(['db', 'other']) AS name")
