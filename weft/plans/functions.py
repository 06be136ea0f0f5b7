"""Function groups: one query for each, a column for each function."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.functions import scalar as S
from weft.plans.base import Catalog, table

_C = Catalog()
QUERIES, ORACLE = _C.queries, _C.oracle
query = _C.query

col, lit = F.col, F.lit


def _r(x, n: int = 9):
    return F.round(x, n)


@query("fn_arithmetic", """SELECT l_orderkey, l_linenumber, l_quantity + 1 AS plus, l_quantity - 1 AS minus, l_quantity * 2 AS times, round(l_quantity / l_linenumber, 9) AS quotient,
CAST(l_orderkey // l_linenumber AS BIGINT) AS whole, l_orderkey % l_linenumber AS rest, -l_quantity AS negative, abs(l_discount - 0.05) > 0.02 AS far,
CASE WHEN l_linenumber - 1 <> 0 THEN round(l_quantity / (l_linenumber - 1), 9) END AS by_zero FROM lineitem""")
def fn_arithmetic(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")
    q, n, k = col("l_quantity"), col("l_linenumber"), col("l_orderkey")
    return l.select("l_orderkey", "l_linenumber", (q + 1).alias("plus"), (q - 1).alias("minus"), (q * 2).alias("times"), _r(S.divide(q, n)).alias("quotient"),
                    S.divide_integer(k, n).alias("whole"), S.mod(k, n).alias("rest"), (-q).alias("negative"), (F.abs(col("l_discount") - 0.05) > 0.02).alias("far"),
                    _r(S.divide(q, n - 1)).alias("by_zero"))


@query("fn_math", """SELECT p_partkey, round(power(p_size, 1.5), 6) AS pw, round(sqrt(p_size), 9) AS sq, round(ln(p_size), 9) AS ln, round(log10(p_size), 9) AS lg,
round(exp(p_size / 10.0), 6) AS ex, abs(p_size - 25) AS ab, ceil(p_retailprice) AS ce, floor(p_retailprice) AS fl, round(p_retailprice, 0) AS ro,
trunc(p_retailprice) AS tr, sign(p_size - 25) AS sg, round(degrees(p_size), 6) AS de, round(radians(p_size), 9) AS ra, round(pi(), 9) AS pi FROM part""")
def fn_math(spark, sf_dir):
    s, p = col("p_size"), col("p_retailprice")
    return table(spark, sf_dir, "part").select("p_partkey", _r(F.pow(s, lit(1.5)), 6).alias("pw"), _r(F.sqrt(s)).alias("sq"), _r(F.ln(s)).alias("ln"), _r(F.log10(s)).alias("lg"),
        _r(F.exp(s / 10.0), 6).alias("ex"), F.abs(s - 25).alias("ab"), F.ceil(p).alias("ce"), F.floor(p).alias("fl"), F.round(p, 0).alias("ro"),
        S.truncate(p).alias("tr"), F.signum(s - 25).alias("sg"), _r(F.degrees(s), 6).alias("de"), _r(F.radians(s)).alias("ra"), _r(F.pi()).alias("pi"))


@query("fn_trigonometry", """SELECT p_partkey, round(sin(x), 9) AS si, round(cos(x), 9) AS co, round(tan(x), 7) AS ta, round(cot(x), 7) AS ct, round(asin(y), 9) AS asn, round(acos(y), 9) AS acs,
round(atan(x), 9) AS ata, round(atan2(x, y), 9) AS at2 FROM (SELECT p_partkey, p_size / 7.0 AS x, p_size / 51.0 AS y FROM part)""")
def fn_trigonometry(spark, sf_dir):
    x, y = col("p_size") / 7.0, col("p_size") / 51.0
    return table(spark, sf_dir, "part").select("p_partkey", _r(F.sin(x)).alias("si"), _r(F.cos(x)).alias("co"), _r(F.tan(x), 7).alias("ta"), _r(S.cot(x), 7).alias("ct"), _r(F.asin(y)).alias("asn"),
        _r(F.acos(y)).alias("acs"), _r(F.atan(x)).alias("ata"), _r(F.atan2(x, y)).alias("at2"))


@query("fn_random")
def fn_random(spark, sf_dir):
    """RAND and RAND_INTEGER: values depend on the engine, their ranges don't."""
    r, i = F.rand(7), S.rand_integer(10, 7)
    return table(spark, sf_dir, "nation").select("n_nationkey", r.between(0, 1).alias("unit"), i.between(0, 9).alias("digit"))


@query("fn_string", """SELECT p_partkey, p_name || '-' || p_brand AS cc, substr(p_name, 2, 3) AS s1, substr(p_name, 3) AS s2, p_name[-3:-2] AS s3, substr(p_name, 1, 2) AS s0, replace(p_name, 'r', 'RR') AS rp,
translate(p_name, 'abc', 'xyz') AS tr, substr(p_name, 1, 1) || '##' || substr(p_name, 4) AS ov, trim('  ' || p_name || ' ') AS tm, ltrim('xx' || p_name, 'x') AS lt, rtrim(p_name || 'xx', 'x') AS rt,
CAST(position('r' IN p_name) AS INT) AS po, length(p_name) AS le, upper(p_name) AS up, lower(p_brand) AS lo FROM part""")
def fn_string(spark, sf_dir):
    n, b = col("p_name"), col("p_brand")
    return table(spark, sf_dir, "part").select("p_partkey", F.concat(n, lit("-"), b).alias("cc"), S.substring(n, 2, 3).alias("s1"), S.substring(n, 3).alias("s2"), S.substring(n, -3, 2).alias("s3"), S.substring(n, 0, 3).alias("s0"),
        F.replace(n, lit("r"), lit("RR")).alias("rp"), F.translate(n, "abc", "xyz").alias("tr"), S.overlay(n, lit("##"), 2, 2).alias("ov"), F.trim(F.concat(lit("  "), n, lit(" "))).alias("tm"),
        F.ltrim(F.concat(lit("xx"), n), lit("x")).alias("lt"), F.rtrim(F.concat(n, lit("xx")), lit("x")).alias("rt"), S.position("r", n).alias("po"), F.char_length(n).alias("le"), F.upper(n).alias("up"), F.lower(b).alias("lo"))


@query("fn_initcap", """SELECT n_nationkey, list_aggregate(list_transform(regexp_extract_all(lower(s), '[A-Za-z0-9]+|[^A-Za-z0-9]+'), lambda x: upper(x[1]) || x[2:]), 'string_agg', '') AS ic
FROM (SELECT n_nationkey, n_name || ' aB-cd EF_gh' AS s FROM nation)""")
def fn_initcap(spark, sf_dir):
    return table(spark, sf_dir, "nation").select("n_nationkey", S.initcap(F.concat(col("n_name"), lit(" aB-cd EF_gh"))).alias("ic"))


@query("fn_charset", "SELECT n_nationkey, n_name AS latin, n_name AS utf FROM nation")
def fn_charset(spark, sf_dir):
    n = col("n_name")
    return table(spark, sf_dir, "nation").select("n_nationkey", S.convert_charset(n, "ISO-8859-1").alias("latin"), S.convert_charset(n, "UTF-8").alias("utf"))


@query("fn_date_parts", """SELECT event_id, year(ts) AS y, quarter(ts) AS q, month(ts) AS m, week(ts) AS w, dayofmonth(ts) AS d, dayofyear(ts) AS doy, dayofweek(ts) + 1 AS dow, isodow(ts) AS idow,
isoyear(ts) AS iy, hour(ts) AS h, minute(ts) AS mi, second(ts) AS s, decade(ts) AS de, century(ts) AS ce, millennium(ts) AS ml FROM events""")
def fn_date_parts(spark, sf_dir):
    units = {"y": "YEAR", "q": "QUARTER", "m": "MONTH", "w": "WEEK", "d": "DAY", "doy": "DOY", "dow": "DOW", "idow": "ISODOW", "iy": "ISOYEAR", "h": "HOUR", "mi": "MINUTE", "s": "SECOND", "de": "DECADE", "ce": "CENTURY", "ml": "MILLENNIUM"}
    return table(spark, sf_dir, "events").select("event_id", *[S.extract(u, "ts").alias(n) for n, u in units.items()])


@query("fn_date_arithmetic", """SELECT o_orderkey, o_orderdate + INTERVAL 3 MONTH AS plus, o_orderdate - INTERVAL 1 DAY AS minus, date_diff('day', TIMESTAMP '1995-01-01', o_orderdate) AS days,
datesub('month', TIMESTAMP '1995-01-01', o_orderdate) AS months, date_trunc('month', o_orderdate) AS fl,
CASE WHEN date_trunc('month', o_orderdate) = o_orderdate THEN o_orderdate ELSE date_trunc('month', o_orderdate) + INTERVAL 1 MONTH END AS ce FROM orders""")
def fn_date_arithmetic(spark, sf_dir):
    d, base = col("o_orderdate"), F.expr("TIMESTAMP_NTZ '1995-01-01 00:00:00'")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.timestamp_add("MONTH", lit(3), d).alias("plus"), (d - F.expr("INTERVAL 1 DAY")).alias("minus"), F.timestamp_diff("DAY", base, d).alias("days"),
        F.timestamp_diff("MONTH", base, d).alias("months"), S.floor_to(d, "MONTH").cast("timestamp_ntz").alias("fl"), S.ceil_to(d, "MONTH").cast("timestamp_ntz").alias("ce"))


@query("fn_now", "SELECT n_nationkey, true AS date_is_set, true AS time_is_set, true AS stamp_is_set, true AS local_is_set FROM nation")
def fn_now(spark, sf_dir):
    return table(spark, sf_dir, "nation").select("n_nationkey", F.current_date().isNotNull().alias("date_is_set"), F.expr("current_time() IS NOT NULL").alias("time_is_set"),
        F.current_timestamp().isNotNull().alias("stamp_is_set"), F.localtimestamp().isNotNull().alias("local_is_set"))


@query("fn_comparison", """SELECT p_partkey, p_size = 10 AS eq, p_size <> 10 AS ne, p_size < 10 AS lt, p_size <= 10 AS le, p_size > 10 AS gt, p_size >= 10 AS ge,
k IS DISTINCT FROM 10 AS df, k IS NOT DISTINCT FROM 10 AS nd, p_size BETWEEN 5 AND 20 AS bt, p_size NOT BETWEEN 5 AND 20 AS nb, p_size BETWEEN 5 AND 20 AS sb,
p_size IN (1, 2, 3) AS i, p_size NOT IN (1, 2, 3) AS ni, k IS NULL AS nu, k IS NOT NULL AS nn, greatest(p_size, 20) AS gr, CASE WHEN k IS NULL THEN NULL ELSE least(k, 20) END AS ls,
coalesce(k, -1) AS co, nullif(p_size, 7) AS nf, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'mid' ELSE 'big' END AS ca
FROM (SELECT *, nullif(p_size, 10) AS k FROM part)""")
def fn_comparison(spark, sf_dir):
    p, s, k = table(spark, sf_dir, "part").withColumn("k", F.nullif(col("p_size"), lit(10))), col("p_size"), col("k")
    return p.select("p_partkey", (s == 10).alias("eq"), (s != 10).alias("ne"), (s < 10).alias("lt"), (s <= 10).alias("le"), (s > 10).alias("gt"), (s >= 10).alias("ge"),
        (~k.eqNullSafe(10)).alias("df"), k.eqNullSafe(10).alias("nd"), s.between(5, 20).alias("bt"), (~s.between(5, 20)).alias("nb"), S.between_symmetric(s, 20, 5).alias("sb"),
        s.isin(1, 2, 3).alias("i"), (~s.isin(1, 2, 3)).alias("ni"), k.isNull().alias("nu"), k.isNotNull().alias("nn"), S.greatest(s, 20).alias("gr"), S.least(k, 20).alias("ls"),
        F.coalesce(k, lit(-1)).alias("co"), F.nullif(s, lit(7)).alias("nf"), F.when(s < 10, "small").when(s < 30, "mid").otherwise("big").alias("ca"))


@query("fn_boolean", """SELECT p_partkey, (a AND b) AS an, (a OR b) AS o, (NOT a) AS no, a IS TRUE AS t, a IS NOT TRUE AS nt, a IS FALSE AS f, a IS NOT FALSE AS nf, a IS NULL AS u, a IS NOT NULL AS nu
FROM (SELECT p_partkey, CASE WHEN p_size < 20 THEN true WHEN p_size < 40 THEN false END AS a, p_size % 2 = 0 AS b FROM part)""")
def fn_boolean(spark, sf_dir):
    a, b = col("a"), col("b")
    p = table(spark, sf_dir, "part").select("p_partkey", F.when(col("p_size") < 20, True).when(col("p_size") < 40, False).alias("a"), (col("p_size") % 2 == 0).alias("b"))
    return p.select("p_partkey", (a & b).alias("an"), (a | b).alias("o"), (~a).alias("no"), a.eqNullSafe(True).alias("t"), (~a.eqNullSafe(True)).alias("nt"), a.eqNullSafe(False).alias("f"), (~a.eqNullSafe(False)).alias("nf"), a.isNull().alias("u"), a.isNotNull().alias("nu"))


@query("fn_pattern", r"""SELECT p_partkey, p_name LIKE '%ing' AS lk, p_name NOT LIKE 's%' AS nl, p_name LIKE 'sm_ll%' AS lu, 'a%b' LIKE 'a!%b' ESCAPE '!' AS es, regexp_full_match(p_name, '(red|blue) .*') AS si, NOT regexp_full_match(p_name, '(red|blue) .*') AS ns FROM part""")
def fn_pattern(spark, sf_dir):
    n = col("p_name")
    return table(spark, sf_dir, "part").select("p_partkey", n.like("%ing").alias("lk"), (~n.like("s%")).alias("nl"), n.like("sm_ll%").alias("lu"), F.expr("'a%b' LIKE 'a!%b' ESCAPE '!'").alias("es"), S.similar_to(n, "(red|blue) %").alias("si"), (~S.similar_to(n, "(red|blue) %")).alias("ns"))


@query("fn_period", """SELECT p_partkey, (e1 >= s2 AND e2 >= s1) AS ov, (s1 <= s2 AND e1 >= e2) AS co, e1 <= s2 AS pr, e1 = s2 AS ip, s1 >= e2 AS su, s1 = e2 AS iu, (s1 = s2 AND e1 = e2) AS eq
FROM (SELECT p_partkey, least(p_size, 20) AS s1, greatest(p_size, 20) AS e1, least(p_size % 7 + 15, 25) AS s2, greatest(p_size % 7 + 15, 25) AS e2 FROM part)""")
def fn_period(spark, sf_dir):
    s = col("p_size")
    p, q = (s, lit(20)), (lit(25), s % 7 + 15)
    return table(spark, sf_dir, "part").select("p_partkey", S.overlaps(p, q).alias("ov"), S.contains(p, q).alias("co"), S.precedes(p, q).alias("pr"), S.immediately_precedes(p, q).alias("ip"), S.succeeds(p, q).alias("su"), S.immediately_succeeds(p, q).alias("iu"), S.period_equals(p, q).alias("eq"))


@query("fn_quantified", """SELECT n_nationkey, n_nationkey < (SELECT max(s_nationkey) FROM supplier WHERE s_acctbal > 9000) AS lt_some, n_nationkey > (SELECT min(s_nationkey) FROM supplier WHERE s_acctbal > 9000) AS gt_some,
n_nationkey <= (SELECT max(s_nationkey) FROM supplier WHERE s_acctbal > 9000) AS le_some, n_nationkey >= (SELECT min(s_nationkey) FROM supplier WHERE s_acctbal > 9000) AS ge_some,
n_nationkey < (SELECT min(s_nationkey) FROM supplier WHERE s_acctbal > 9000) AS lt_all, n_nationkey > (SELECT max(s_nationkey) FROM supplier WHERE s_acctbal > 9000) AS gt_all,
n_nationkey <= (SELECT min(s_nationkey) FROM supplier WHERE s_acctbal > 9000) AS le_all, n_nationkey >= (SELECT max(s_nationkey) FROM supplier WHERE s_acctbal > 9000) AS ge_all,
n_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 9000) AS eq_some, n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 9000) AS ne_all FROM nation""")
def fn_quantified(spark, sf_dir):
    """x < SOME (q) is x < max(q), x < ALL (q) is x < min(q); equality goes by a set."""
    q = table(spark, sf_dir, "supplier").filter("s_acctbal > 9000").agg(F.min("s_nationkey").alias("lo"), F.max("s_nationkey").alias("hi"), F.collect_set("s_nationkey").alias("all"))
    n = table(spark, sf_dir, "nation").join(F.broadcast(q))  # one row
    k, lo, hi = col("n_nationkey"), col("lo"), col("hi")
    return n.select("n_nationkey", (k < hi).alias("lt_some"), (k > lo).alias("gt_some"), (k <= hi).alias("le_some"), (k >= lo).alias("ge_some"), (k < lo).alias("lt_all"), (k > hi).alias("gt_all"), (k <= lo).alias("le_all"), (k >= hi).alias("ge_all"), F.array_contains("all", k).alias("eq_some"), (~F.array_contains("all", k)).alias("ne_all"))


@query("fn_conversion", """SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS s, CAST(CAST(o_orderkey AS VARCHAR) AS BIGINT) AS i, CAST(trunc(o_totalprice) AS BIGINT) AS t, CAST(o_totalprice AS DECIMAL(12, 1)) AS d, CAST(o_orderdate AS DATE) AS da, o_orderkey % 2 = 1 AS b FROM orders""")
def fn_conversion(spark, sf_dir):
    k, p = col("o_orderkey"), col("o_totalprice")
    return table(spark, sf_dir, "orders").select("o_orderkey", k.cast("string").alias("s"), k.cast("string").cast("bigint").alias("i"), p.cast("bigint").alias("t"), p.cast("decimal(12,1)").alias("d"), col("o_orderdate").cast("date").alias("da"), (k % 2).cast("boolean").alias("b"))


@query("fn_collections", """SELECT n_nationkey, [n_nationkey, n_regionkey][1] AS i1, [n_nationkey, n_regionkey][5] AS i5, len([n_nationkey, n_regionkey]) AS ca, n_regionkey AS el, n_name AS mp, n_name AS ro FROM nation""")
def fn_collections(spark, sf_dir):
    k, r, n = col("n_nationkey"), col("n_regionkey"), col("n_name")
    a = F.array(k, r)
    return table(spark, sf_dir, "nation").select("n_nationkey", S.item(a, 1).alias("i1"), S.item(a, 5).alias("i5"), F.cardinality(a).alias("ca"), S.element(F.array(r)).alias("el"), S.item(F.create_map(lit("n"), n), "n").alias("mp"), F.struct(n.alias("x")).getField("x").alias("ro"))


@query("fn_unnest", "SELECT n_nationkey, o AS ordinality, CASE o WHEN 1 THEN n_nationkey ELSE n_regionkey END AS v FROM nation, (VALUES (1), (2)) AS t(o)")
def fn_unnest(spark, sf_dir):
    return table(spark, sf_dir, "nation").select("n_nationkey", F.posexplode(F.array("n_nationkey", "n_regionkey")).alias("ordinality", "v")).withColumn("ordinality", col("ordinality") + 1)


@query("fn_collection_query", "SELECT n_regionkey, list_sort(list(n_nationkey)) AS arr, count(*) AS n, list_sort(list(n_name)) AS ms FROM nation GROUP BY n_regionkey")
def fn_collection_query(spark, sf_dir):
    m = F.map_from_entries(F.collect_list(F.struct("n_nationkey", "n_name")))
    g = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.collect_list("n_nationkey").alias("a"), m.alias("m"))
    return g.select("n_regionkey", F.array_sort("a").alias("arr"), F.cardinality("m").cast("bigint").alias("n"), F.array_sort(F.map_values("m")).alias("ms"))


@query("fn_multiset", """SELECT n_nationkey, list_sort([1, 1, 2, r]) AS a, len(list_distinct([1, 1, 2, r, 1, 3, r])) AS ud, 7 AS ua, list_contains([1, 1, 2, r], 2) AS me,
CASE WHEN r = 1 THEN [1, 2] WHEN r = 2 THEN [1, 2] WHEN r = 3 THEN [1, 2] ELSE [1, 2] END AS ex, CASE WHEN r = 1 THEN [1, 1] WHEN r = 3 THEN [1, 3] ELSE list_sort([1, r]) END AS it,
r IN (0, 3, 4) AND false AS st, false AS sb, true AS ne FROM (SELECT n_nationkey, n_regionkey AS r FROM nation)""")
def fn_multiset(spark, sf_dir):
    r = col("n_regionkey")
    a, b = F.array(lit(1), lit(1), lit(2), r), F.array(lit(1), lit(3), r)
    return table(spark, sf_dir, "nation").select("n_nationkey", F.array_sort(a).alias("a"), F.size(F.array_union(a, b)).alias("ud"), F.size(F.concat(a, b)).alias("ua"), S.member_of(lit(2), a).alias("me"),
        F.array_sort(S.bag_except(a, b)).alias("ex"), F.array_sort(S.bag_intersect(a, b)).alias("it"), S.is_a_set(a).alias("st"), S.submultiset_of(a, b).alias("sb"), (F.size(a) > 0).alias("ne"))


@query("fn_json", """SELECT event_id, true AS ex, false AS nx, CAST(props->>'$.k' AS INT) AS v, -1 AS d, props->>'$.k' AS q, '[' || (props->>'$.k') || ']' AS w, 'OBJECT' AS kind, true AS isj, false AS isa, event_type AS ob, '["' || event_type || '","x"]' AS ar FROM events""")
def fn_json(spark, sf_dir):
    p = col("props")
    return table(spark, sf_dir, "events").select("event_id", S.json_exists(p, "$.k").alias("ex"), S.json_exists(p, "$.zz").alias("nx"), S.json_value(p, "$.k", "int").alias("v"), S.json_value(p, "$.zz", "int", -1).alias("d"),
        S.json_query(p, "$.k").alias("q"), S.json_query(p, "$.k", True).alias("w"), S.json_kind(p).alias("kind"), S.is_json(p).alias("isj"), S.is_json(p, "ARRAY").alias("isa"),
        F.get_json_object(F.to_json(F.struct(col("event_type").alias("t"))), "$.t").alias("ob"), F.to_json(F.array("event_type", lit("x"))).alias("ar"))


@query("fn_json_agg", """SELECT event_type, count(*) AS n, sum(CAST(props->>'$.k' AS BIGINT)) AS s FROM events GROUP BY event_type""")
def fn_json_agg(spark, sf_dir):
    """JSON_ARRAYAGG and JSON_OBJECTAGG, read back."""
    g = table(spark, sf_dir, "events").groupBy("event_type").agg(F.to_json(F.collect_list(S.json_value("props", "$.k", "int"))).alias("arr"), F.to_json(F.map_from_entries(F.collect_list(F.struct(col("event_id").cast("string"), "user_id")))).alias("obj"))
    arr, obj = F.from_json("arr", "array<bigint>"), F.from_json("obj", "map<string,bigint>")
    return g.select("event_type", F.cardinality(obj).cast("bigint").alias("n"), F.aggregate(arr, lit(0).cast("bigint"), lambda a, x: a + x).alias("s"))


@query("fn_dialects", """SELECT n_nationkey, CASE WHEN n_regionkey = 0 THEN 'zero' WHEN n_regionkey = 1 THEN 'one' ELSE 'many' END AS de, coalesce(nullif(n_regionkey, 0), 9) AS nv, substr(n_name, 1, 3) AS su, translate(n_name, 'N_', 'M-') AS tr FROM nation""")
def fn_dialects(spark, sf_dir):
    return table(spark, sf_dir, "nation").select("n_nationkey", S.decode("n_regionkey", 0, "zero", 1, "one", "many").alias("de"), S.nvl(F.nullif(col("n_regionkey"), lit(0)), lit(9)).alias("nv"), F.substr(col("n_name"), lit(1), lit(3)).alias("su"), F.translate("n_name", "N_", "M-").alias("tr"))


@query("fn_escapes", """SELECT n_nationkey, abs(k) AS a, round(ln(k + 1), 9) AS lg, power(k, 2) AS pw, lower(n_name) AS lc, upper(n_name) AS uc, length(n_name) AS le, round(sqrt(k), 9) AS sq, trunc(k / 2.0) AS tr FROM (SELECT *, CAST(n_nationkey AS DOUBLE) AS k FROM nation)""")
def fn_escapes(spark, sf_dir):
    k, n, f = col("n_nationkey").cast("double"), col("n_name"), S.escape_function
    return table(spark, sf_dir, "nation").select("n_nationkey", f("ABS", k).alias("a"), _r(f("LOG", k + 1)).alias("lg"), f("POWER", k, lit(2)).alias("pw"), f("LCASE", n).alias("lc"), f("UCASE", n).alias("uc"), f("LENGTH", n).alias("le"), _r(f("SQRT", k)).alias("sq"), f("TRUNCATE", k / 2).alias("tr"))


@query("fn_context", "SELECT n_nationkey, true AS u, true AS s, true AS c, true AS d FROM nation")
def fn_context(spark, sf_dir):
    return table(spark, sf_dir, "nation").select("n_nationkey", F.current_user().isNotNull().alias("u"), F.session_user().isNotNull().alias("s"), F.current_catalog().isNotNull().alias("c"), F.current_schema().isNotNull().alias("d"))


_EMB = "(SELECT a.vec_id, a.embedding AS x, b.embedding AS y FROM embeddings a, (SELECT embedding FROM embeddings WHERE vec_id = 0) b)"


@query("fn_distance", f"""SELECT vec_id, round(list_sum(list_transform(list_zip(x, y), lambda p: abs(CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE)))), 4) AS l1,
round(sqrt(list_sum(list_transform(list_zip(x, y), lambda p: power(CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE), 2)))), 4) AS l2,
round(list_sum(list_transform(list_zip(x, y), lambda p: power(CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE), 2))), 4) AS l2s,
round(1 - list_sum(list_transform(list_zip(x, y), lambda p: CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE))) / (sqrt(list_sum(list_transform(x, lambda v: CAST(v AS DOUBLE) * v))) * sqrt(list_sum(list_transform(y, lambda v: CAST(v AS DOUBLE) * v)))), 4) AS co FROM {_EMB}""")
def fn_distance(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    q = e.filter("vec_id = 0").agg(F.first("embedding").alias("q"))  # one row
    return e.join(F.broadcast(q)).select("vec_id", *[_r(S.distance("embedding", "q", m), 4).alias(n) for n, m in (("l1", "L1"), ("l2", "L2"), ("l2s", "L2SQUARED"), ("co", "COSINE"))])


@query("fn_distance_other", f"""SELECT vec_id, round(list_sum(list_transform(list_zip(x, y), lambda p: CASE WHEN abs(CAST(p[1] AS DOUBLE)) + abs(CAST(p[2] AS DOUBLE)) = 0 THEN 0 ELSE power(abs(CAST(p[1] AS DOUBLE)) - abs(CAST(p[2] AS DOUBLE)), 2) / (abs(CAST(p[1] AS DOUBLE)) + abs(CAST(p[2] AS DOUBLE))) END)), 4) AS chi,
round(2 * list_sum(list_transform(list_zip(x, y), lambda p: abs(CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE)))), 4) AS wl1 FROM {_EMB}""")
def fn_distance_other(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    q = e.filter("vec_id = 0").agg(F.first("embedding").alias("q"))
    two = F.transform("embedding", lambda v: lit(2.0))
    pos = lambda c: F.transform(c, lambda v: F.abs(v.cast("double")))
    return e.join(F.broadcast(q)).select("vec_id", _r(S.distance(pos("embedding"), pos("q"), "CHISQUARED"), 4).alias("chi"), _r(S.distance("embedding", "q", "L1", two), 4).alias("wl1"))


@query("knn_top", f"""SELECT vec_id, round(d, 4) AS d FROM (SELECT vec_id, sqrt(list_sum(list_transform(list_zip(x, y), lambda p: power(CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE), 2)))) AS d FROM {_EMB}) ORDER BY d, vec_id LIMIT 10""")
def knn_top(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    q = e.filter("vec_id = 0").agg(F.first("embedding").alias("q"))
    return e.join(F.broadcast(q)).select("vec_id", S.distance("embedding", "q", "L2").alias("d")).orderBy("d", "vec_id").limit(10).select("vec_id", _r(col("d"), 4).alias("d"))


@query("fn_json_build", """SELECT n_nationkey, '{"k":' || n_nationkey || ',"r":' || coalesce(CAST(nullif(n_regionkey, 2) AS VARCHAR), 'null') || '}' AS o, '{"k":' || n_nationkey || coalesce(',"r":' || nullif(n_regionkey, 2), '') || '}' AS oa,
'[' || n_nationkey || coalesce(',' || nullif(n_regionkey, 2), '') || ']' AS a FROM nation""")
def fn_json_build(spark, sf_dir):
    r = F.nullif(col("n_regionkey"), lit(2))
    return table(spark, sf_dir, "nation").select("n_nationkey", S.json_object(k="n_nationkey", r=r).alias("o"), S.json_object(True, k="n_nationkey", r=r).alias("oa"), S.json_array("n_nationkey", r).alias("a"))


@query("udf_scalar", "SELECT p_partkey, p_size * 2 + 1 AS v FROM part")
def udf_scalar(spark, sf_dir):
    from weft.functions.user import scalar

    def twice(x):
        return x * 2 + 1

    import pandas as pd

    twice.__annotations__ = {"x": pd.Series, "return": pd.Series}
    scalar(spark, "weft_twice", twice, "bigint")
    return table(spark, sf_dir, "part").selectExpr("p_partkey", "weft_twice(p_size) AS v")


@query("udf_aggregate", "SELECT o_custkey, max(o_orderkey) - min(o_orderkey) AS v FROM orders GROUP BY o_custkey")
def udf_aggregate(spark, sf_dir):
    from weft.functions.user import aggregate

    aggregate(spark, "weft_range", lambda x: int(x.max() - x.min()), "bigint")
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.expr("weft_range(o_orderkey)").alias("v"))


@query("udf_table", "SELECT n_nationkey, unnest(range(n_regionkey)) AS i FROM nation")
def udf_table(spark, sf_dir):
    from weft.functions.user import table_function

    table_function(spark, "weft_count_to", lambda n: ((i,) for i in range(n)), "i int")
    table(spark, sf_dir, "nation").createOrReplaceTempView("nation")
    return spark.sql("SELECT n_nationkey, t.i FROM nation, LATERAL weft_count_to(n_regionkey) AS t")
