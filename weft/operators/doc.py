"""Document collections: a frame whose columns are the fields of the documents, nested ones as structs and arrays.

A missing field is null. Query filters, pipeline stages, expressions, accumulators and update operators are given as the
document language's own objects (dicts and lists), or as text such as db.orders.aggregate([...]).
"""

from __future__ import annotations

import ast
import json
import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_NUMBERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
#: Names and numbers of document types.
TYPES = {"double": 1, "string": 2, "object": 3, "array": 4, "bool": 8, "date": 9, "null": 10, "int": 16, "timestamp": 17, "long": 18, "decimal": 19}


def kind_of(schema: T.StructType, path: str) -> T.DataType | None:
    """Type at a path, through arrays; None if there is no such field."""
    kind: T.DataType = schema
    for part in path.split("."):
        while isinstance(kind, T.ArrayType):
            kind = kind.elementType
        if not isinstance(kind, T.StructType) or part not in kind.names:
            return None
        kind = kind[part].dataType
    return kind


class Query:
    """Filters and expressions over the fields of a schema."""

    def __init__(self, schema: T.StructType):
        self.schema = schema

    def at(self, path: str) -> Column:
        return F.lit(None) if kind_of(self.schema, path) is None else F.col(path)

    def kind(self, path: str) -> T.DataType | None:
        return kind_of(self.schema, path)

    def filter(self, query: dict) -> Column:
        tests = []
        for key, value in query.items():
            if key == "$and":
                tests.append(self._all([self.filter(q) for q in value]))
            elif key == "$or":
                tests.append(reduce(lambda a, b: a | b, [self.filter(q) for q in value]))
            elif key == "$nor":
                tests.append(~reduce(lambda a, b: a | b, [self.filter(q) for q in value]))
            elif key == "$expr":
                tests.append(F.coalesce(self.expression(value), F.lit(False)))
            else:
                tests.append(self._field(key, value))
        return self._all(tests)

    @staticmethod
    def _all(tests: list[Column]) -> Column:
        return reduce(lambda a, b: a & b, tests) if tests else F.lit(True)

    def _field(self, path: str, test) -> Column:
        if isinstance(test, dict) and any(k.startswith("$") for k in test):
            return self._all([F.coalesce(self._operator(path, op, v, test), F.lit(False)) for op, v in test.items() if op != "$options"])
        return F.coalesce(self._equal(path, test), F.lit(False))

    def _equal(self, path: str, value) -> Column:
        """Of an array also if an element is equal."""
        c, kind = self.at(path), self.kind(path)
        if value is None:
            return c.isNull()
        if isinstance(kind, T.ArrayType) and not isinstance(value, list):
            return F.array_contains(c, F.lit(value)) if self._comparable(kind.elementType, value) else F.lit(False)
        if isinstance(value, list):
            return c == F.array(*[F.lit(v) for v in value])
        return c == F.lit(value) if kind is not None and self._comparable(kind, value) else F.lit(False)

    @staticmethod
    def _comparable(kind: T.DataType, value) -> bool:
        if isinstance(value, bool):
            return isinstance(kind, T.BooleanType)
        if isinstance(value, (int, float)):
            return isinstance(kind, _NUMBERS)
        return not isinstance(kind, (*_NUMBERS, T.BooleanType))

    def _operator(self, path: str, op: str, value, test: dict) -> Column:
        c, kind = self.at(path), self.kind(path)
        number = isinstance(kind, _NUMBERS)
        if op in ("$gt", "$gte", "$lt", "$lte"):
            if not number or isinstance(value, (str, bool)):
                return F.lit(False)
            return {"$gt": c > value, "$gte": c >= value, "$lt": c < value, "$lte": c <= value}[op]
        if op == "$eq":
            return self._equal(path, value)
        if op == "$ne":
            return ~F.coalesce(self._equal(path, value), F.lit(False))
        if op in ("$in", "$nin"):
            hit = reduce(lambda a, b: a | b, [F.coalesce(self._equal(path, v), F.lit(False)) for v in value]) if value else F.lit(False)
            return hit if op == "$in" else ~hit
        if op == "$exists":
            return c.isNotNull() if value else c.isNull()
        if op == "$type":
            wanted = [value] if not isinstance(value, list) else value
            return F.lit(self._type_name(kind) in [v if isinstance(v, str) else next(n for n, i in TYPES.items() if i == v) for v in wanted] or ("number" in wanted and number)) & c.isNotNull()
        if op == "$not":
            return ~F.coalesce(self._field(path, value), F.lit(False))
        if op == "$all":
            return self._all([F.array_contains(c, v) for v in value])
        if op == "$size":
            return F.size(c) == value if isinstance(kind, T.ArrayType) else F.lit(False)
        if op == "$elemMatch":
            inner = kind.elementType
            if isinstance(inner, T.StructType):
                return F.exists(c, lambda e: self._element(e, inner, value))
            return F.exists(c, lambda e: self._all([self._scalar(e, o, v) for o, v in value.items()]))
        if op == "$mod":
            return (c % value[0] == value[1]) if number else F.lit(False)
        if op == "$regex":
            options = test.get("$options", "")
            return c.rlike(f"(?s{''.join(o for o in options if o in 'imx')}){value}")
        if op in ("$near", "$nearSphere", "$geoWithin", "$geoIntersects"):
            return self._geo(path, op, value)
        raise ValueError(f"unknown operator: {op}")

    @staticmethod
    def _scalar(e: Column, op: str, v) -> Column:
        return {"$gt": e > v, "$gte": e >= v, "$lt": e < v, "$lte": e <= v, "$eq": e == v, "$ne": e != v}[op]

    def _element(self, e: Column, kind: T.StructType, query: dict) -> Column:
        tests = []
        for k, v in query.items():
            f = e[k]
            tests.append(self._all([self._scalar(f, o, x) for o, x in v.items()]) if isinstance(v, dict) else f == v)
        return F.coalesce(self._all(tests), F.lit(False))

    @staticmethod
    def _type_name(kind: T.DataType | None) -> str:
        return {T.StringType: "string", T.IntegerType: "int", T.LongType: "long", T.DoubleType: "double", T.BooleanType: "bool", T.ArrayType: "array", T.StructType: "object", T.DateType: "date", T.TimestampType: "timestamp", T.TimestampNTZType: "timestamp", T.DecimalType: "decimal"}.get(type(kind), "null")

    def _geo(self, path: str, op: str, value: dict) -> Column:
        """Points are arrays [x, y]. Boxes, circles and distances."""
        x, y = F.get(self.at(path), 0), F.get(self.at(path), 1)
        if "$box" in value:
            (x0, y0), (x1, y1) = value["$box"]
            return x.between(min(x0, x1), max(x0, x1)) & y.between(min(y0, y1), max(y0, y1))
        if "$center" in value:
            (a, b), r = value["$center"]
            return F.hypot(x - a, y - b) <= r
        if "$centerSphere" in value:
            (a, b), r = value["$centerSphere"]
            return great_circle(x, y, F.lit(a), F.lit(b), 1.0) <= r
        if "$polygon" in value:
            return in_polygon(x, y, value["$polygon"])
        a, b = value["$geometry"]["coordinates"] if "$geometry" in value else value["$point"]
        d = great_circle(x, y, F.lit(a), F.lit(b)) if op == "$nearSphere" else F.hypot(x - a, y - b)
        return d.between(value.get("$minDistance", 0), value.get("$maxDistance", float("inf")))

    def expression(self, e) -> Column:
        """A path ("$a.b"), a literal or an operator."""
        if isinstance(e, str) and e.startswith("$"):
            return self.at(e[1:])
        if isinstance(e, list):
            return F.array(*[self.expression(x) for x in e])
        if not isinstance(e, dict):
            return F.lit(e)
        if len(e) != 1 or not next(iter(e)).startswith("$"):
            return F.struct(*[self.expression(v).alias(k) for k, v in e.items()])
        (op, arg), = e.items()
        if op == "$literal":
            return F.lit(arg)
        args = [self.expression(a) for a in (arg if isinstance(arg, list) else [arg])]
        one = {"$abs": F.abs, "$acos": F.acos, "$asin": F.asin, "$atan": F.atan, "$ceil": F.ceil, "$cos": F.cos, "$degreesToRadians": F.radians, "$floor": F.floor, "$ln": F.ln,
               "$log": F.ln, "$log10": F.log10, "$sin": F.sin, "$sqrt": F.sqrt, "$tan": F.tan, "$exp": F.exp, "$size": F.size}
        if op in one:
            return one[op](args[0])
        many = {"$add": lambda a, b: a + b, "$subtract": lambda a, b: a - b, "$multiply": lambda a, b: a * b, "$divide": F.try_divide, "$mod": lambda a, b: a % b, "$pow": F.pow, "$atan2": F.atan2,
                "$eq": lambda a, b: a == b, "$ne": lambda a, b: a != b, "$gt": lambda a, b: a > b, "$gte": lambda a, b: a >= b, "$lt": lambda a, b: a < b, "$lte": lambda a, b: a <= b,
                "$and": lambda a, b: a & b, "$or": lambda a, b: a | b}
        if op in many:
            return reduce(many[op], args)
        if op == "$sum":
            return reduce(lambda a, b: a + b, [F.coalesce(a, F.lit(0)) for a in args])
        if op == "$not":
            return ~args[0]
        if op == "$arrayElemAt":
            n = arg[1]
            return F.get(args[0], n if n >= 0 else F.size(args[0]) + n)
        if op == "$slice":
            return slice_of(args[0], *arg[1:])
        raise ValueError(f"unknown expression: {op}")


def slice_of(c: Column, *bounds: int) -> Column:
    """[count] from the start (from the end if negative), or [skip, count]."""
    if len(bounds) == 1:
        n = bounds[0]
        return F.slice(c, 1, n) if n >= 0 else F.slice(c, F.greatest(F.size(c) + n + 1, F.lit(1)), F.lit(-n))
    skip, n = bounds
    start = F.lit(skip + 1) if skip >= 0 else F.greatest(F.size(c) + skip + 1, F.lit(1))
    return F.slice(c, start, F.lit(n))


def great_circle(x1: Column, y1: Column, x2: Column, y2: Column, radius: float = 6378137.0) -> Column:
    """Length of the arc between two points in degrees."""
    dx, dy = F.radians(x2 - x1), F.radians(y2 - y1)
    h = F.pow(F.sin(dy / 2), F.lit(2)) + F.cos(F.radians(y1)) * F.cos(F.radians(y2)) * F.pow(F.sin(dx / 2), F.lit(2))
    return F.lit(2 * radius) * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def in_polygon(x: Column, y: Column, ring: list) -> Column:
    """Whether a ray from the point crosses the ring an odd number of times."""
    crossed = F.lit(False)
    for (x1, y1), (x2, y2) in zip(ring, [*ring[1:], ring[0]]):
        if y1 == y2:
            continue
        hit = ((F.lit(y1) > y) != (F.lit(y2) > y)) & (x < (x2 - x1) * (y - y1) / (y2 - y1) + x1)
        crossed = crossed != hit
    return crossed


def put(df: DataFrame, path: str, value: Column) -> DataFrame:
    """Sets the field at a path; missing documents on the way are made."""
    head, _, rest = path.partition(".")
    if not rest:
        return df.withColumn(head, value)
    if head not in df.columns:
        for part in reversed(rest.split(".")):
            value = F.struct(value.alias(part))
        return df.withColumn(head, value)
    return df.withColumn(head, F.coalesce(F.col(head), F.from_json(F.lit("{}"), df.schema[head].dataType)).withField(rest, value))


def drop(df: DataFrame, path: str) -> DataFrame:
    head, _, rest = path.partition(".")
    if not rest:
        return df.drop(head)
    return df.withColumn(head, F.col(head).dropFields(rest)) if kind_of(df.schema, path) is not None else df


_ACCUMULATORS = {"$avg": F.avg, "$first": F.first, "$last": F.last, "$max": F.max, "$min": F.min, "$stdDevPop": F.stddev_pop, "$stdDevSamp": F.stddev_samp, "$sum": F.sum}


class Collection:
    """Stages and statements over a frame of documents; each gives a new collection."""

    def __init__(self, df: DataFrame):
        self.df = df

    @property
    def query(self) -> Query:
        return Query(self.df.schema)

    def match(self, query: dict) -> Collection:
        near = next(((p, op, v[op]) for p, v in query.items() if isinstance(v, dict) for op in ("$near", "$nearSphere") if op in v), None)
        out = self.df.filter(self.query.filter(query))
        if near:  # nearest first
            path, op, v = near
            x, y = F.get(F.col(path), 0), F.get(F.col(path), 1)
            a, b = v["$geometry"]["coordinates"] if "$geometry" in v else v["$point"]
            out = out.orderBy(great_circle(x, y, F.lit(a), F.lit(b)) if op == "$nearSphere" else F.hypot(x - a, y - b))
        return Collection(out)

    def project(self, spec: dict) -> Collection:
        q = self.query
        if all(v in (0, False) for v in spec.values()):
            return Collection(reduce(drop, spec, self.df))
        keep = [] if spec.get("_id", 1) in (0, False) or "_id" not in self.df.columns or "_id" in spec else [F.col("_id")]
        groups: dict = {}
        for path, v in spec.items():
            if v in (0, False) and path == "_id":
                continue
            value = q.at(path) if v in (1, True) and not isinstance(v, float) else slice_of(q.at(path), *(v["$slice"] if isinstance(v["$slice"], list) else [v["$slice"]])) if isinstance(v, dict) and "$slice" in v and not isinstance(v["$slice"], str) and not (isinstance(v["$slice"], list) and isinstance(v["$slice"][0], str)) else q.expression(v)
            groups.setdefault(path.split(".")[0], []).append((path.split(".")[1:], value))

        def built(items):
            if len(items) == 1 and not items[0][0]:
                return items[0][1]
            inner: dict = {}
            for rest, value in items:
                inner.setdefault(rest[0], []).append((rest[1:], value))
            return F.struct(*[built(v).alias(k) for k, v in inner.items()])

        return Collection(self.df.select(*keep, *[built(v).alias(k) for k, v in groups.items()]))

    def set(self, spec: dict) -> Collection:
        df = self.df
        for path, e in spec.items():
            df = put(df, path, self.query.expression(e))
        return Collection(df)

    add_fields = set

    def unset(self, paths) -> Collection:
        return Collection(reduce(drop, [paths] if isinstance(paths, str) else paths, self.df))

    def count(self, name: str) -> Collection:
        return Collection(self.df.agg(F.count(F.lit(1)).alias(name)))

    def group(self, spec: dict) -> Collection:
        q = self.query
        calls = []
        for name, call in spec.items():
            if name == "_id":
                continue
            (op, arg), = call.items()
            calls.append((F.count(F.lit(1)) if op == "$count" else _ACCUMULATORS[op](q.expression(arg).cast("double") if op not in ("$first", "$last", "$min", "$max") else q.expression(arg))).alias(name))
        key = spec.get("_id")
        if key is None:
            return Collection(self.df.agg(*calls).select(F.lit(None).cast("string").alias("_id"), "*"))
        return Collection(self.df.groupBy(q.expression(key).alias("_id")).agg(*calls) if calls else self.df.select(q.expression(key).alias("_id")).distinct())

    def sort(self, spec: dict) -> Collection:
        return Collection(self.df.orderBy(*[F.col(p).asc_nulls_first() if way == 1 else F.col(p).desc_nulls_last() for p, way in spec.items()]))

    def limit(self, n: int) -> Collection:
        return Collection(self.df.limit(n))

    def skip(self, n: int) -> Collection:
        return Collection(self.df.offset(n))

    def unwind(self, spec) -> Collection:
        spec = {"path": spec} if isinstance(spec, str) else spec
        path, keep = spec["path"].lstrip("$"), spec.get("preserveNullAndEmptyArrays", False)
        each = self.df.withColumn("_each", (F.explode_outer if keep else F.explode)(F.col(path)))
        return Collection(put(each, path, F.col("_each")).drop("_each"))

    def replace_root(self, e) -> Collection:
        return Collection(self.df.select(self.query.expression(e).alias("_root")).select("_root.*"))

    def geo_near(self, spec: dict) -> Collection:
        x, y = F.get(F.col(spec["key"]), 0), F.get(F.col(spec["key"]), 1)
        near = spec["near"]
        a, b = near["coordinates"] if isinstance(near, dict) else near
        d = great_circle(x, y, F.lit(a), F.lit(b)) if spec.get("spherical") else F.hypot(x - a, y - b)
        out = put(self.df, spec["distanceField"], d)
        d = F.col(spec["distanceField"])
        return Collection(out.filter(d.between(spec.get("minDistance", 0), spec.get("maxDistance", float("inf")))).orderBy(d))

    def aggregate(self, stages: list[dict]) -> Collection:
        out = self
        for stage in stages:
            (name, arg), = stage.items()
            out = {
                "$match": out.match, "$project": out.project, "$set": out.set, "$addFields": out.set, "$unset": out.unset, "$count": out.count, "$group": out.group, "$sort": out.sort, "$limit": out.limit,
                "$skip": out.skip, "$unwind": out.unwind, "$replaceRoot": lambda a: out.replace_root(a["newRoot"]), "$replaceWith": out.replace_root, "$geoNear": out.geo_near,  # noqa: B023
            }[name](arg)
        return out

    # Statements.

    def find(self, query: dict | None = None, projection: dict | None = None) -> Collection:
        out = self.match(query or {})
        return out.project(projection) if projection else out

    def find_one(self, query: dict | None = None, projection: dict | None = None) -> Collection:
        return self.find(query, projection).limit(1)

    def count_documents(self, query: dict | None = None) -> Collection:
        return self.match(query or {}).count("count")

    def insert(self, docs: DataFrame) -> Collection:
        return Collection(self.df.unionByName(docs, allowMissingColumns=True))

    def delete(self, query: dict) -> Collection:
        return Collection(self.df.filter(~F.coalesce(self.query.filter(query), F.lit(False))))

    def _parted(self, query: dict, sort: dict | None = None) -> tuple[Collection, Collection]:
        """One document that matches (the first of a sort, of equals the least as JSON), and the others."""
        shown = F.to_json(F.struct(*self.df.columns))
        found = self.match(query).df
        order = [F.col(p).asc_nulls_first() if way == 1 else F.col(p).desc_nulls_last() for p, way in (sort or {}).items()]
        first = found.orderBy(*order, shown).select(shown.alias("d")).first()
        if first is None:
            return Collection(self.df.limit(0)), self
        same = shown == first["d"]
        equals = self.df.filter(same)
        return Collection(equals.limit(1)), Collection(self.df.filter(~same).unionByName(equals.offset(1)))

    def delete_one(self, query: dict, sort: dict | None = None) -> Collection:
        return self._parted(query, sort)[1]

    def update_one(self, query: dict, update, sort: dict | None = None) -> Collection:
        one, others = self._parted(query, sort)
        return one.update({}, update).insert(others.df)

    def replace_one(self, query: dict, doc: dict, sort: dict | None = None) -> Collection:
        one, others = self._parted(query, sort)
        return one.replace({}, doc).insert(others.df)

    def of(self, docs: list[dict]) -> DataFrame:
        """Documents as a frame of this collection's fields and those they have besides; numbers take the fields' types."""
        spark = self.df.sparkSession
        if not docs:
            return self.df.limit(0)
        text = spark.createDataFrame([(json.dumps(d),) for d in docs], "d string")
        kind = text.select(F.schema_of_json(F.lit(json.dumps(_merged(docs))))).first()[0]
        new = text.select(F.from_json("d", kind).alias("d")).select("d.*")
        known = {f.name: f.dataType for f in self.df.schema.fields}
        return new.select(*[F.col(f"`{c}`").cast(known[c]).alias(c) if c in known else F.col(f"`{c}`") for c in new.columns])

    def replace(self, query: dict, doc: dict) -> Collection:
        hit = self.query.filter(query)
        return Collection(self.df.select(*[F.col(c) if c == "_id" else F.when(hit, F.lit(doc.get(c)).cast(self.df.schema[c].dataType)).otherwise(F.col(c)).alias(c) for c in self.df.columns]))

    def update(self, query: dict, update) -> Collection:
        """All matching documents: update operators, or a pipeline of $set, $addFields, $project and $unset."""
        if isinstance(update, list):
            return self.delete(query).insert(self.match(query).aggregate(update).df)
        hit, df = self.query.filter(query), self.df.withColumn("_hit", self.query.filter(query))
        hit = F.col("_hit")
        for op, fields in update.items():
            for path, v in fields.items():
                old = Query(df.schema).at(path)
                if op == "$rename":
                    df = drop(put(df, v, F.when(hit, old).otherwise(Query(df.schema).at(v))), path) if kind_of(df.schema, path) is not None else df
                    continue
                new = {
                    "$set": lambda: F.lit(v), "$unset": lambda: F.lit(None), "$inc": lambda: F.coalesce(old, F.lit(0)) + v, "$mul": lambda: F.coalesce(old, F.lit(0)) * v,  # noqa: B023
                    "$min": lambda: F.least(old, F.lit(v)), "$max": lambda: F.greatest(old, F.lit(v)), "$currentDate": lambda: F.current_timestamp(),  # noqa: B023
                    "$addToSet": lambda: F.when(F.array_contains(old, v), old).otherwise(F.array_append(old, F.lit(v))),  # noqa: B023
                }[op]()
                df = put(df, path, F.when(hit, new).otherwise(old))
        return Collection(df.drop("_hit"))

    def to_json(self, name: str = "d") -> DataFrame:
        return self.df.select(F.to_json(F.struct(*self.df.columns)).alias(name))


def _merged(docs: list):
    """One document with all fields of these, to tell their types."""
    out: dict = {}
    for d in docs:
        for k, v in d.items():
            old = out.get(k)
            out[k] = _merged([old, v]) if isinstance(old, dict) and isinstance(v, dict) else old if v is None else v
    return out


def parse_value(text: str):
    """A JSON-like value; keys may stand without quotes, strings in single ones."""
    try:
        return json.loads(text)
    except ValueError:
        pass
    quoted = re.sub(r"([{,]\s*)(\$?[A-Za-z_][\w.$]*)\s*:", r'\1"\2":', text)
    quoted = re.sub(r"\btrue\b", "True", re.sub(r"\bfalse\b", "False", re.sub(r"\bnull\b", "None", quoted)))
    return ast.literal_eval(quoted)


def _calls(rest: str) -> list[tuple[str, list]]:
    """The calls .name(arguments) of a statement, in order."""
    rest, calls = rest.strip().rstrip(";"), []
    while rest:
        name = re.match(r"\.?\s*(\w+)\s*\(", rest)
        depth, i, mark = 1, name.end(), None
        while depth:
            ch = rest[i]
            if mark:
                mark = None if ch == mark else mark
            elif ch in "'\"":
                mark = ch
            else:
                depth += (ch in "([{") - (ch in ")]}")
            i += 1
        inside = rest[name.end() : i - 1].strip()
        calls.append((name[1], parse_value(f"[{inside}]") if inside else []))
        rest = rest[i:].strip()
    return calls


def _options(args: list, at: int) -> dict:
    return args[at] if len(args) > at and isinstance(args[at], dict) else {}


def _written(c: Collection, name: str, args: list) -> Collection:
    """The collection after a statement that changes it."""
    if name in ("insertOne", "save", "insertMany", "insert"):
        docs = args[0] if isinstance(args[0], list) else [args[0]]
        if name == "save":  # an equal _id is replaced
            for d in docs:
                c = c.delete({"_id": d["_id"]}) if "_id" in d and "_id" in c.df.columns else c
        return c.insert(c.of(docs))
    if name == "deleteMany" or name == "remove" and not (len(args) > 1 and (args[1] is True or _options(args, 1).get("justOne"))):
        return c.delete(args[0] if args else {})
    if name in ("deleteOne", "remove"):
        return c.delete_one(args[0])
    upsert = name in ("updateOne", "updateMany", "replaceOne") and _options(args, 2).get("upsert")
    if upsert and c.match(args[0]).df.isEmpty():
        plain = {k: v for k, v in args[0].items() if not k.startswith("$") and not isinstance(v, dict)}
        return c.insert(c.of([{**plain, **(args[1] if name == "replaceOne" else args[1].get("$set", {}))}]))
    return {"updateMany": c.update, "updateOne": c.update_one, "replaceOne": c.replace_one}[name](*args[:2])


_READS = {"find": "find", "findOne": "find_one", "aggregate": "aggregate", "countDocuments": "count_documents", "sort": "sort", "limit": "limit", "skip": "skip"}


def _one_and(c: Collection, name: str, args: list) -> tuple[Collection, Collection]:
    """The document that a findOneAnd... statement gives, and the collection after it: the document before the change, or with
    returnNewDocument or returnDocument 'after' the changed one."""
    if name == "findAndModify":
        spec = args[0]
        how = "Delete" if spec.get("remove") else "Update" if isinstance(spec["update"], list) or any(k.startswith("$") for k in spec["update"]) else "Replace"
        query, change, options = spec.get("query", {}), spec.get("update"), {"sort": spec.get("sort"), "projection": spec.get("fields"), "returnNewDocument": spec.get("new")}
    else:
        how, query = name.removeprefix("findOneAnd"), args[0]
        change, options = (None, _options(args, 1)) if how == "Delete" else (args[1], _options(args, 2))
    one, others = c._parted(query, options.get("sort"))
    if how == "Delete":
        new, after = one, others
    else:
        new = one.update({}, change) if how == "Update" else one.replace({}, change)
        after = new.insert(others.df)
    shown = new if options.get("returnNewDocument") or options.get("returnDocument") == "after" else one
    return (shown.project(options["projection"]) if options.get("projection") else shown), after


def run(text: str, collections) -> DataFrame:
    """A statement db.collection.method(arguments), with .sort, .limit and .skip after find; collections(name) gives frames.
    A statement that changes documents gives the collection after it, findOneAnd... the document."""
    head = re.match(r"^\s*db\.(\w+)\.", text)
    c = Collection(collections(head[1]))
    for name, args in _calls(text[head.end() :]):
        if name.startswith("findOneAnd") or name == "findAndModify":
            c = _one_and(c, name, args)[0]
        else:
            c = getattr(c, _READS[name])(*args) if name in _READS else _written(c, name, args)
    return c.df


class Database:
    """Collections under names, and statements that change them: each change is held before the next reads it."""

    def __init__(self, spark, collections: dict[str, DataFrame] | None = None):
        self.spark, self.held = spark, {"db": dict(collections or {})}
        self.now = "db"

    @property
    def collections(self) -> dict[str, DataFrame]:
        return self.held[self.now]

    def _names(self, column: str, names) -> DataFrame:
        return self.spark.createDataFrame([(n,) for n in sorted(names)], f"{column} string")

    def execute(self, text: str) -> DataFrame | None:
        """use, show dbs and show collections; db.createCollection, createView, dropDatabase; of a collection drop,
        renameCollection, createIndex (which Spark has no use for), changes and reads. Gives rows of reads."""
        from weft.sources.scratch import held

        text = text.strip().rstrip(";")
        if m := re.fullmatch(r"use\s+(\w+)", text):
            self.now = m[1]
            self.held.setdefault(self.now, {})
            return None
        if re.fullmatch(r"show\s+(dbs|databases)", text):
            return self._names("name", self.held)
        if re.fullmatch(r"show\s+(collections|tables)", text):
            return self._names("name", self.collections)
        if m := re.match(r"db\.(\w+)\s*\(", text):
            name, args = _calls(text[3:])[0]
            if name == "dropDatabase":
                self.held.pop(self.now)
                self.now = "db"
                self.held.setdefault("db", {})
            elif name in ("createCollection", "createView") and args[0] in self.collections:
                raise ValueError(f"there is a collection {args[0]}")
            elif name == "createCollection":
                self.collections[args[0]] = self.spark.createDataFrame([], "_id string")
            elif name == "createView":
                self.collections[args[0]] = Collection(self.collections[args[1]]).aggregate(args[2]).df
            elif name == "getCollectionNames":
                return self._names("name", self.collections)
            else:
                raise ValueError(f"cannot run: {text}")
            return None
        name = re.match(r"db\.(\w+)\.", text)[1]
        calls = _calls(text[len(f"db.{name}.") :])
        verb, args = calls[0]
        if verb == "drop":
            self.collections.pop(name, None)
        elif verb == "renameCollection":
            self.collections[args[0]] = self.collections.pop(name)
        elif verb == "createIndex":
            pass
        elif verb.startswith("findOneAnd") or verb == "findAndModify":
            found, after = _one_and(Collection(self.collections[name]), verb, args)
            out = held(found.df)
            self.collections[name] = held(after.df)
            return out
        elif verb in _READS:
            return run(text, self.collections.__getitem__)
        else:
            frame = self.collections.get(name)
            empty = frame is None or frame.columns == ["_id"] and frame.isEmpty()
            if verb in ("insertOne", "insertMany", "insert", "save") and empty:
                frame = self.spark.createDataFrame([], "_id string").select()  # fields come with the documents
            self.collections[name] = held(_written(Collection(frame), verb, args).df)
        return None
