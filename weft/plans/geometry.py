"""Geometry functions on shapes made of table values."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.functions import geo
from weft.plans.base import Catalog, table

_C = Catalog()
QUERIES, ORACLE = _C.queries, _C.oracle
query = _C.query


def _shapes(spark, sf_dir):
    """A rectangle (0 0, w h) and a point (k r) for each nation."""
    n = table(spark, sf_dir, "nation").select("n_nationkey", (F.col("n_nationkey") + 1).alias("w"), (F.col("n_regionkey") + 1).alias("h"))
    rect = F.format_string("POLYGON ((0 0, %d 0, %d %d, 0 %d, 0 0))", "w", "w", "h", "h")
    return n.select("*", rect.alias("g"), geo.point(F.col("n_nationkey"), F.lit(2)).alias("p"), F.format_string("LINESTRING (0 0, %d 0, %d %d)", "w", "w", "h").alias("l"), F.lit("POLYGON ((0 0, 6 0, 6 3, 0 3, 0 0))").alias("base"))


_N = "(SELECT n_nationkey, n_nationkey + 1 AS w, n_regionkey + 1 AS h FROM nation)"


@query("geo_measures", f"SELECT n_nationkey, CAST(w * h AS DOUBLE) AS area, CAST(2 * (w + h) AS DOUBLE) AS perimeter, CAST(w + h AS DOUBLE) AS length, 5 AS n, 2 AS dim, CAST(n_nationkey AS DOUBLE) AS x, 2.0 AS y, true AS rect, true AS simple, false AS empty FROM {_N}")
def geo_measures(spark, sf_dir):
    s = geo.st
    return _shapes(spark, sf_dir).select("n_nationkey", s("AREA", "g").alias("area"), s("LENGTH", "g").alias("perimeter"), s("LENGTH", "l").alias("length"), s("NUMPOINTS", "g").alias("n"), s("DIMENSION", "g").alias("dim"),
        s("X", "p").alias("x"), s("Y", "p").alias("y"), s("ISRECTANGLE", "g").alias("rect"), s("ISSIMPLE", "l").alias("simple"), s("ISEMPTY", "g").alias("empty"))


@query("geo_shapes", f"""SELECT n_nationkey, 'POINT (' || CAST(w // 2 AS INT) || CASE WHEN w % 2 = 1 THEN '.5' ELSE '' END || ' ' || CAST(h // 2 AS INT) || CASE WHEN h % 2 = 1 THEN '.5' ELSE '' END || ')' AS centre,
'POLYGON ((0 0, ' || w || ' 0, ' || w || ' ' || h || ', 0 ' || h || ', 0 0))' AS env, 'LINESTRING (0 0, ' || w || ' 0, ' || w || ' ' || h || ', 0 ' || h || ', 0 0)' AS shell, 'POINT (0 0)' AS first, 'POINT (' || w || ' ' || h || ')' AS last, 0 AS holes, 1 AS parts,
'LINESTRING (' || w || ' ' || h || ', ' || w || ' 0, 0 0)' AS back, true AS same FROM {_N}""")
def geo_shapes(spark, sf_dir):
    s = geo.st
    return _shapes(spark, sf_dir).select("n_nationkey", s("CENTROID", "g").alias("centre"), s("ENVELOPE", "g").alias("env"), s("EXTERIORRING", "g").alias("shell"), s("STARTPOINT", "l").alias("first"), s("ENDPOINT", "l").alias("last"),
        s("NUMINTERIORRING", "g").alias("holes"), s("NUMGEOMETRIES", "g").alias("parts"), s("REVERSE", "l").alias("back"), s("EQUALS", s("GEOMFROMGEOJSON", s("ASGEOJSON", "g")), "g").alias("same"))


@query("geo_predicates", f"""SELECT n_nationkey, n_nationkey <= 6 AS inter, n_nationkey > 6 AS disj, n_nationkey BETWEEN 1 AND 5 AS within, n_nationkey IN (0, 6) AS touch, n_nationkey <= 6 AS cov,
(w <= 6 AND h <= 3) AS contains, (w = 6 AND h = 3) AS eq, CAST(greatest(n_nationkey - 6, 0) AS DOUBLE) AS dist, n_nationkey <= 8 AS near, CAST(least(w, 6) * least(h, 3) AS DOUBLE) AS shared, ((w > 6 AND h < 3) OR (w < 6 AND h > 3)) AS over FROM {_N}""")
def geo_predicates(spark, sf_dir):
    s = geo.st
    return _shapes(spark, sf_dir).select("n_nationkey", s("INTERSECTS", "p", "base").alias("inter"), s("DISJOINT", "p", "base").alias("disj"), s("WITHIN", "p", "base").alias("within"), s("TOUCHES", "p", "base").alias("touch"), s("COVERS", "base", "p").alias("cov"),
        s("CONTAINS", "base", "g").alias("contains"), s("EQUALS", "base", "g").alias("eq"), s("DISTANCE", "p", "base").alias("dist"), s("DWITHIN", "p", "base", 2).alias("near"), s("AREA", s("INTERSECTION", "g", "base")).alias("shared"), s("OVERLAPS", "g", "base").alias("over"))


@query("geo_overlays", f"""SELECT n_nationkey, CAST(w * h + 18 - least(w, 6) * least(h, 3) AS DOUBLE) AS either, CAST(w * h - least(w, 6) * least(h, 3) AS DOUBLE) AS first_, CAST(w * h + 18 - 2 * least(w, 6) * least(h, 3) AS DOUBLE) AS one,
CAST(least(w, 6) + CASE WHEN w <= 6 THEN least(h, 3) ELSE 0 END AS DOUBLE) AS inside, CAST(greatest(w - 2, 0) * greatest(h - 2, 0) AS DOUBLE) AS within FROM {_N}""")
def geo_overlays(spark, sf_dir):
    s = geo.st
    return _shapes(spark, sf_dir).select("n_nationkey", s("AREA", s("UNION", "g", "base")).alias("either"), s("AREA", s("DIFFERENCE", "g", "base")).alias("first_"), s("AREA", s("SYMDIFFERENCE", "g", "base")).alias("one"),
        s("LENGTH", s("INTERSECTION", "l", "base")).alias("inside"), s("AREA", s("BUFFER", "g", -1)).alias("within"))
