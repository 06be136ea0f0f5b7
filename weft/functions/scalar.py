"""Functions whose semantics differ from Spark's defaults, and those that Spark lacks. All stay in the JVM.

Every function takes columns (or names) and gives a Column.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(x) -> Column:
    """A column by name or as it is; other values become literals."""
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x)


# Arithmetic.


def divide(a, b) -> Column:
    """Division of whole numbers as decimals, of others as doubles; by zero gives null."""
    return F.try_divide(col(a), col(b))


def divide_integer(a, b) -> Column:
    """Quotient without its fraction, toward zero; by zero gives null."""
    a, b = col(a), col(b)
    return F.when(b != 0, (a - a % b) / b).cast("bigint")


def mod(a, b) -> Column:
    """Remainder with the sign of the dividend; by zero gives null."""
    return F.when(col(b) != 0, col(a) % col(b))


def truncate(a, n: int = 0) -> Column:
    """Toward zero at n decimal places."""
    scale = 10.0**n
    a = col(a)
    return F.signum(a) * F.floor(F.abs(a) * scale) / scale


def cot(a) -> Column:
    return F.cot(col(a))


def rand_integer(n: int, seed: int | None = None) -> Column:
    return F.floor(F.rand(seed) * n).cast("int")


def greatest(*xs) -> Column:
    """Null if any argument is null."""
    xs = [col(x) for x in xs]
    return F.when(_any_null(xs), None).otherwise(F.greatest(*xs))


def least(*xs) -> Column:
    """Null if any argument is null."""
    xs = [col(x) for x in xs]
    return F.when(_any_null(xs), None).otherwise(F.least(*xs))


def _any_null(xs: list[Column]) -> Column:
    out = xs[0].isNull()
    for x in xs[1:]:
        out = out | x.isNull()
    return out


# Text.


def substring(s, start, length=None) -> Column:
    """From start, 1-based, negative from the end; what lies before position 1 counts toward the length."""
    s, start = col(s), col(start).cast("int")
    size = F.char_length(s)
    first = F.when(start < 0, size + start + 1).otherwise(start)
    if length is None:
        return F.substring(s, F.greatest(first, F.lit(1)), size)
    end = first + col(length).cast("int")
    return F.substring(s, F.greatest(first, F.lit(1)), F.greatest(end - F.greatest(first, F.lit(1)), F.lit(0)))


def initcap(s) -> Column:
    """First letter of every run of ASCII letters and digits large, the rest small."""
    parts = F.regexp_extract_all(F.lower(col(s)), F.lit("[A-Za-z0-9]+|[^A-Za-z0-9]+"), F.lit(0))
    return F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, F.lit(2), F.char_length(p)))), "")


def position(x, s, start: int = 1) -> Column:
    return F.locate(x, col(s), start) if isinstance(x, str) else F.call_function("locate", x, col(s), F.lit(start))


def overlay(s, r, start, length=None) -> Column:
    return F.overlay(col(s), col(r), start, -1 if length is None else length)


def similar_pattern(pattern: str, escape: str | None = None) -> str:
    """A SQL regular expression as a Java one: % and _ are any text and any character, the rest keeps its meaning."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if escape and c == escape and i + 1 < len(pattern):
            i += 1
            out.append(re.escape(pattern[i]))
        elif c == "%":
            out.append(".*")
        elif c == "_":
            out.append(".")
        elif c in ".^$\\":
            out.append("\\" + c)
        else:
            out.append(c)
        i += 1
    return "(?s)^(?:" + "".join(out) + ")$"


def similar_to(s, pattern: str, escape: str | None = None) -> Column:
    return col(s).rlike(similar_pattern(pattern, escape))


def convert_charset(s, charset: str) -> Column:
    """Characters that the charset lacks are lost in the same way as when they are written in it."""
    return F.decode(F.encode(col(s), charset), charset)


# Predicates.


def between_symmetric(x, a, b) -> Column:
    return col(x).between(F.least(col(a), col(b)), F.greatest(col(a), col(b)))


def _period(p) -> tuple[Column, Column]:
    a, b = (col(x) for x in p)
    return F.least(a, b), F.greatest(a, b)


def overlaps(p, q) -> Column:
    """Periods are pairs of points in either order, with closed ends."""
    (a, b), (c, d) = _period(p), _period(q)
    return (b >= c) & (d >= a)


def contains(p, q) -> Column:
    (a, b), (c, d) = _period(p), _period(q)
    return (a <= c) & (b >= d)


def precedes(p, q) -> Column:
    return _period(p)[1] <= _period(q)[0]


def immediately_precedes(p, q) -> Column:
    return _period(p)[1] == _period(q)[0]


def succeeds(p, q) -> Column:
    return _period(p)[0] >= _period(q)[1]


def immediately_succeeds(p, q) -> Column:
    return _period(p)[0] == _period(q)[1]


def period_equals(p, q) -> Column:
    (a, b), (c, d) = _period(p), _period(q)
    return (a == c) & (b == d)


# Dates. SQL numbers days of the week from Sunday = 1.

_UNITS = {
    "YEAR": lambda d: F.year(d), "QUARTER": lambda d: F.quarter(d), "MONTH": lambda d: F.month(d), "WEEK": lambda d: F.weekofyear(d),
    "DAY": lambda d: F.dayofmonth(d), "DOY": lambda d: F.dayofyear(d), "DOW": lambda d: F.dayofweek(d), "ISODOW": lambda d: F.weekday(d) + 1,
    "ISOYEAR": lambda d: F.extract(F.lit("YEAROFWEEK"), d), "HOUR": lambda d: F.hour(d), "MINUTE": lambda d: F.minute(d), "SECOND": lambda d: F.second(d),
    "DECADE": lambda d: F.floor(F.year(d) / 10), "CENTURY": lambda d: F.floor((F.year(d) + 99) / 100), "MILLENNIUM": lambda d: F.floor((F.year(d) + 999) / 1000),
}


def extract(unit: str, d) -> Column:
    return _UNITS[unit.upper()](col(d)).cast("bigint")


def floor_to(d, unit: str) -> Column:
    return F.date_trunc(unit, col(d))


def ceil_to(d, unit: str) -> Column:
    d = col(d)
    down = F.date_trunc(unit, d)
    return F.when(down == d, down).otherwise(down + F.expr(f"INTERVAL 1 {unit}"))


# Collections. A bag is an array in which repeats count.


def item(c, i) -> Column:
    """1-based element of an array or value of a map; null beyond."""
    return F.try_element_at(col(c), i if isinstance(i, Column) else F.lit(i))


def element(c) -> Column:
    """The only element; null of none; more are an error."""
    c = col(c)
    return F.when(F.size(c) == 0, None).when(F.size(c) == 1, F.get(c, 0)).otherwise(F.raise_error(F.lit("more than one element")))


def bag_except(a, b) -> Column:
    """Each element as often as a has it beyond b; the first occurrences go."""
    a, b = col(a), col(b)
    seen = lambda arr, x: F.size(F.filter(arr, lambda y: y.eqNullSafe(x)))
    return F.filter(a, lambda x, i: seen(F.slice(a, 1, i + 1), x) > seen(b, x))


def bag_intersect(a, b) -> Column:
    """Each element as often as both have it."""
    a, b = col(a), col(b)
    seen = lambda arr, x: F.size(F.filter(arr, lambda y: y.eqNullSafe(x)))
    return F.filter(a, lambda x, i: seen(F.slice(a, 1, i + 1), x) <= seen(b, x))


def member_of(x, bag) -> Column:
    return F.array_contains(col(bag), col(x))


def submultiset_of(a, b) -> Column:
    return F.size(bag_except(a, b)) == 0


def is_a_set(a) -> Column:
    return F.size(F.array_distinct(col(a))) == F.size(col(a))


# Distance of vectors.

METRICS = ("L1", "L2", "L2SQUARED", "CHISQUARED", "COSINE")


def distance(a, b, metric: str, weights=None) -> Column:
    """Distance of two arrays of one size; other sizes are an error. Weights multiply the terms, for COSINE both vectors."""
    metric = metric.upper()
    if metric not in METRICS:
        raise ValueError(f"unknown metric: {metric}")
    a, b = (F.transform(col(x), lambda v: v.cast("double")) for x in (a, b))
    total = lambda terms: F.aggregate(terms, F.lit(0.0), lambda s, t: s + t)
    if metric == "COSINE":
        if weights is not None:
            w = col(weights)
            a, b = (F.zip_with(x, w, lambda v, k: v * k) for x in (a, b))
        norm = lambda x: F.sqrt(total(F.transform(x, lambda v: v * v)))
        out = 1 - total(F.zip_with(a, b, lambda x, y: x * y)) / (norm(a) * norm(b))
    else:
        term = {
            "L1": lambda x, y: F.abs(x - y),
            "L2": lambda x, y: (x - y) * (x - y),
            "L2SQUARED": lambda x, y: (x - y) * (x - y),
            "CHISQUARED": lambda x, y: F.when(x + y == 0, 0.0).otherwise((x - y) * (x - y) / (x + y)),
        }[metric]
        terms = F.zip_with(a, b, term)
        if weights is not None:
            terms = F.zip_with(terms, col(weights), lambda t, w: t * w)
        out = total(terms)
        if metric == "L2":
            out = F.sqrt(out)
    return F.when(F.size(a) == F.size(b), out).otherwise(F.raise_error(F.lit("arrays of different sizes")).cast("double"))


# JSON text. A path starts with $.


def json_exists(doc, path: str) -> Column:
    return F.coalesce(F.try_variant_get(F.try_parse_json(col(doc)), path, "variant").isNotNull(), F.lit(False))


def json_value(doc, path: str, kind: str = "string", default=None) -> Column:
    got = F.try_variant_get(F.try_parse_json(col(doc)), path, kind)
    return got if default is None else F.coalesce(got, F.lit(default))


def json_query(doc, path: str, wrapper: bool = False) -> Column:
    got = F.get_json_object(col(doc), path)
    return F.when(got.isNotNull(), F.concat(F.lit("["), got, F.lit("]"))) if wrapper else got


def json_object(absent_on_null: bool = False, **values) -> Column:
    return F.to_json(F.struct(*[col(v).alias(k) for k, v in values.items()]), {"ignoreNullFields": str(absent_on_null).lower()})


def json_array(*values, absent_on_null: bool = True) -> Column:
    out = F.array(*map(col, values))
    return F.to_json(F.filter(out, lambda x: x.isNotNull()) if absent_on_null else out)


def json_kind(doc) -> Column:
    """OBJECT, ARRAY or SCALAR; null if it isn't JSON."""
    v = F.try_parse_json(col(doc))
    s = F.schema_of_variant(v)
    return F.when(v.isNull(), None).when(s.startswith("OBJECT"), "OBJECT").when(s.startswith("ARRAY"), "ARRAY").otherwise("SCALAR")


def is_json(doc, kind: str = "VALUE") -> Column:
    found = json_kind(doc)
    return found.isNotNull() if kind == "VALUE" else F.coalesce(found == kind, F.lit(False))


# Functions of other dialects.


def decode(x, *pairs) -> Column:
    """Result of the first value that x equals (nulls are equal), else the last argument if their number is odd."""
    x, out = col(x), None
    for v, r in zip(pairs[::2], pairs[1::2]):
        test = x.eqNullSafe(F.lit(v))
        out = F.when(test, F.lit(r)) if out is None else out.when(test, F.lit(r))
    return out.otherwise(F.lit(pairs[-1])) if len(pairs) % 2 else out


def nvl(x, y) -> Column:
    return F.coalesce(col(x), col(y))


_ESCAPES = {
    "ABS": "abs", "ACOS": "acos", "ASIN": "asin", "ATAN": "atan", "ATAN2": "atan2", "CEILING": "ceil", "COS": "cos", "COT": "cot", "DEGREES": "degrees",
    "EXP": "exp", "FLOOR": "floor", "LOG": "ln", "LOG10": "log10", "MOD": "mod", "PI": "pi", "POWER": "power", "RADIANS": "radians", "RAND": "rand",
    "ROUND": "round", "SIGN": "signum", "SIN": "sin", "SQRT": "sqrt", "TAN": "tan", "CONCAT": "concat", "LCASE": "lower", "LENGTH": "char_length",
    "LOCATE": "locate", "REPLACE": "replace", "SUBSTRING": "substring", "UCASE": "upper", "YEAR": "year", "QUARTER": "quarter", "MONTH": "month",
    "WEEK": "weekofyear", "DAYOFYEAR": "dayofyear", "DAYOFMONTH": "dayofmonth", "DAYOFWEEK": "dayofweek", "HOUR": "hour", "MINUTE": "minute",
    "SECOND": "second", "CURDATE": "current_date", "CURTIME": "current_time", "NOW": "current_timestamp", "DATABASE": "current_catalog", "USER": "current_user",
}


def escape_function(name: str, *args) -> Column:
    """{fn NAME(args)} of the JDBC escape syntax."""
    name = name.upper()
    args = [col(a) for a in args]
    if name == "TRUNCATE":
        return truncate(args[0])
    if name == "INSERT":
        return F.overlay(args[0], args[3], args[1], args[2])
    return F.call_function(_ESCAPES[name], *args)


def escape_names() -> list[str]:
    return sorted([*_ESCAPES, "TRUNCATE", "INSERT"])
