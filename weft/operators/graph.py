"""Property graphs as two frames, and a pattern query language on them.

nodes: id, labels (array), properties (map of texts); edges: id, source, target, labels, properties. A pattern is a chain of
equi-joins of edges with nodes; no edge is used twice within a pattern. A variable-length relationship is a union of chains
of fixed lengths.

A query that names some properties of a node only reads these: a graph of tables (Graph.of_rows) has its maps built after the
labels are chosen, so Catalyst drops the other tables and columns and pushes tests of texts into the scan.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.sources.scratch import held


def node_rows(df: DataFrame, label: str, key: str, id_prefix: str | None = None, nulls: bool = False) -> DataFrame:
    """Each row as a node: its columns are the properties, the table's name the label. nulls: missing values are entries too."""
    props = F.create_map(*[x for c in df.columns for x in (F.lit(c), F.col(c).cast("string"))])
    props = props if nulls else F.map_filter(props, lambda k, v: v.isNotNull())
    return df.select(F.concat(F.lit(f"{id_prefix or label}:"), F.col(key).cast("string")).alias("id"), F.array(F.lit(label)).alias("labels"), props.alias("properties"))


def edge_rows(df: DataFrame, label: str, source: Column, target: Column, properties: list[str] = ()) -> DataFrame:
    props = F.create_map(*[x for c in properties for x in (F.lit(c), F.col(c).cast("string"))]) if properties else F.create_map().cast("map<string,string>")
    return df.select(F.concat_ws("-", F.lit(label), source, target).alias("id"), source.alias("source"), target.alias("target"), F.array(F.lit(label)).alias("labels"), props.alias("properties"))


@dataclass
class Graph:
    nodes: DataFrame
    edges: DataFrame
    wide: DataFrame | None = None  # of a graph of tables, whose edges have one label each: the nodes, nulls being entries too

    @classmethod
    def of_rows(cls, nodes: list[tuple[DataFrame, str, str]], edges: list[DataFrame]) -> Graph:
        """Tables as nodes (rows, label, key), and frames of edge_rows."""
        wide = reduce(DataFrame.union, [node_rows(*n, nulls=True) for n in nodes])
        return cls(wide.withColumn("properties", F.map_filter("properties", lambda k, v: v.isNotNull())), reduce(DataFrame.union, edges), wide)

    def union(self, other: Graph) -> Graph:
        return Graph(self.nodes.unionByName(other.nodes), self.edges.unionByName(other.edges))

    def with_nodes(self, nodes: DataFrame) -> Graph:
        """Some of the nodes and the edges between them."""
        ids = nodes.select("id")
        e = self.edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
        return Graph(nodes, e.select(self.edges.columns))

    def filter_labels(self, labels: list[str]) -> Graph:
        return self.with_nodes(self.nodes.filter(F.arrays_overlap("labels", F.array(*map(F.lit, labels)))))

    def filter_property(self, name: str, test) -> Graph:
        return self.with_nodes(self.nodes.filter(test(F.col("properties")[name])))

    def _both(self, f) -> Graph:
        return Graph(f(self.nodes), f(self.edges))

    def rename_labels(self, names: dict[str, str]) -> Graph:
        m = F.create_map(*[F.lit(x) for p in names.items() for x in p])
        return self._both(lambda d: d.withColumn("labels", F.transform("labels", lambda x: F.coalesce(F.try_element_at(m, x), x))))

    def rename_properties(self, names: dict[str, str]) -> Graph:
        m = F.create_map(*[F.lit(x) for p in names.items() for x in p])
        return self._both(lambda d: d.withColumn("properties", F.transform_keys("properties", lambda k, v: F.coalesce(F.try_element_at(m, k), k))))

    def clean_properties(self, f) -> Graph:
        return self._both(lambda d: d.withColumn("properties", F.transform_values("properties", lambda k, v: f(v))))

    def deduplicate(self, properties: list[str]) -> Graph:
        """Of nodes with equal values the one with the least id stays; edges follow it."""
        key = [F.col("properties")[p].alias(p) for p in properties]
        keyed = self.nodes.select("id", *key)
        first = keyed.groupBy(*properties).agg(F.min("id").alias("kept"))
        on = reduce(lambda a, b: a & b, [keyed[p].eqNullSafe(first[p]) for p in properties])
        kept = keyed.join(first, on).select(keyed["id"].alias("old"), "kept")
        n = self.nodes.join(kept.filter("old = kept").select(F.col("old").alias("id")), "id", "left_semi")
        s, t = kept.toDF("source", "s_"), kept.toDF("target", "t_")
        e = self.edges.join(s, "source", "left").join(t, "target", "left").select("id", F.coalesce("s_", "source").alias("source"), F.coalesce("t_", "target").alias("target"), "labels", "properties")
        return Graph(n, e)

    # Changes.

    def create(self, nodes: list[tuple] = (), edges: list[tuple] = ()) -> Graph:
        spark = self.nodes.sparkSession
        n = spark.createDataFrame(list(nodes), "id string, labels array<string>, properties map<string,string>")
        e = spark.createDataFrame(list(edges), "id string, source string, target string, labels array<string>, properties map<string,string>")
        return Graph(self.nodes.unionByName(n), self.edges.unionByName(e))

    def set_property(self, ids: DataFrame, name: str, value: str) -> Graph:
        hit = self.nodes.join(ids.select(F.col("id").alias("_h")).distinct(), F.col("id") == F.col("_h"), "left")
        changed = F.map_concat(F.map_filter("properties", lambda k, v: k != name), F.create_map(F.lit(name), F.lit(value)))
        return Graph(hit.withColumn("properties", F.when(F.col("_h").isNotNull(), changed).otherwise(F.col("properties"))).drop("_h"), self.edges)

    def remove_property(self, name: str) -> Graph:
        return self._both(lambda d: d.withColumn("properties", F.map_filter("properties", lambda k, v: k != name)))

    def set_labels(self, labels: list[str], replace: bool = False) -> Graph:
        new = F.array(*map(F.lit, labels))
        return Graph(self.nodes.withColumn("labels", new if replace else F.array_union("labels", new)), self.edges)

    def remove_labels(self, labels: list[str]) -> Graph:
        return Graph(self.nodes.withColumn("labels", F.array_except("labels", F.array(*map(F.lit, labels)))), self.edges)

    def delete(self, ids: DataFrame) -> Graph:
        """Nodes go with their edges."""
        return self.with_nodes(self.nodes.join(ids.select("id"), "id", "left_anti"))

    # Other models.

    def nodes_to_rows(self, label: str, columns: dict[str, str]) -> DataFrame:
        return self.nodes.filter(F.array_contains("labels", label)).select("id", *[F.col("properties")[c].cast(k).alias(c) for c, k in columns.items()])

    def edges_to_rows(self, label: str, columns: dict[str, str]) -> DataFrame:
        return self.edges.filter(F.array_contains("labels", label)).select("source", "target", *[F.col("properties")[c].cast(k).alias(c) for c, k in columns.items()])

    def nodes_to_documents(self) -> DataFrame:
        return self.nodes.select(F.to_json(F.struct("id", "labels", "properties")).alias("d"))

    def edges_to_documents(self) -> DataFrame:
        return self.edges.select(F.to_json(F.struct("id", "source", "target", "labels", "properties")).alias("d"))


# The language.

_TOKEN = re.compile(r"\s*(?:(?P<num>\d+\.\d+|\d+(?!\.\d))|(?P<str>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<id>`[^`]+`|[A-Za-z_]\w*)|(?P<op><=|>=|<>|=~|\.\.|->|<-|[-+*/%^=<>()\[\]{},.:|]))")
_AGGREGATES = {"count": F.count, "avg": F.avg, "sum": F.sum, "min": F.min, "max": F.max, "collect": F.collect_list, "stdev": F.stddev_samp, "stdevp": F.stddev_pop}


@dataclass
class _Part:
    name: str | None
    labels: list[str] = field(default_factory=list)
    properties: dict = field(default_factory=dict)
    way: str = ""
    least: int = 1
    most: int = 1


class _Parser:
    def __init__(self, text: str):
        self.tokens: list[tuple[str, str]] = []
        at = 0
        text = text.strip().rstrip(";")
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise ValueError(f"cannot read: {text[at:at + 20]!r}")
            kind = m.lastgroup
            self.tokens.append((kind, m[kind].strip("`") if kind == "id" else m[kind]))
            at = m.end()
        self.at = 0
        self.fresh = 0

    def peek(self, *words: str, ahead: int = 0) -> bool:
        i = self.at + ahead
        return i < len(self.tokens) and (self.tokens[i][1].upper() in [w.upper() for w in words]) and self.tokens[i][0] != "str"

    def take(self, *words: str) -> bool:
        if self.peek(*words):
            self.at += 1
            return True
        return False

    def need(self, word: str) -> None:
        if not self.take(word):
            raise ValueError(f"expected {word}, found {self.tokens[self.at:self.at + 3]}")

    def name(self) -> str:
        self.at += 1
        return self.tokens[self.at - 1][1]

    def literal(self):
        kind, v = self.tokens[self.at]
        self.at += 1
        if kind == "num":
            return float(v) if "." in v else int(v)
        if kind == "str":
            return v[1:-1]
        return {"true": True, "false": False, "null": None}[v.lower()]

    def map(self) -> dict:
        out: dict = {}
        self.need("{")
        while not self.take("}"):
            k = self.name()
            self.need(":")
            out[k] = self.literal()
            self.take(",")
        return out

    def _inside(self, close: str) -> _Part:
        part = _Part(None)
        if self.tokens[self.at][0] == "id":
            part.name = self.name()
        while self.take(":", "|"):
            part.labels.append(self.name())
        if self.take("*"):
            part.least, part.most = 1, None  # of any length
            if self.tokens[self.at][0] == "num":
                part.least = part.most = int(self.name())
            if self.take(".."):
                part.most = int(self.name()) if self.tokens[self.at][0] == "num" else None
        if self.peek("{"):
            part.properties = self.map()
        self.need(close)
        if part.name is None:
            self.fresh += 1
            part.name = f"_{self.fresh}"
        return part

    def pattern(self) -> list[_Part]:
        self.need("(")
        parts = [self._inside(")")]
        while self.peek("-", "<-", "->"):
            left = self.take("<-")
            if not left:
                self.need("-")
            edge = _Part(None)
            if self.take("["):
                edge = self._inside("]")
            else:
                self.fresh += 1
                edge.name = f"_{self.fresh}"
            right = self.take("->")
            if not right:
                self.need("-")
            edge.way = "<" if left else ">" if right else ""
            self.need("(")
            parts += [edge, self._inside(")")]
        return parts


class Cypher:
    """Runs a query on a graph: MATCH, OPTIONAL MATCH, WHERE, WITH, UNWIND, RETURN [DISTINCT], ORDER BY, SKIP, LIMIT, UNION."""

    def __init__(self, graph: Graph):
        self.graph = graph
        self.uses: dict[str, set | None] = {}  # variable -> properties read of it, None for all
        self.names: dict[str, str] = {}  # variable -> node, edge, path or value

    # Expressions, lowest first.

    def _or(self, p: _Parser) -> Column:
        out = self._xor(p)
        while p.take("OR"):
            out = out | self._xor(p)
        return out

    def _xor(self, p: _Parser) -> Column:
        out = self._and(p)
        while p.take("XOR"):
            out = out != self._and(p)
        return out

    def _and(self, p: _Parser) -> Column:
        out = self._not(p)
        while p.take("AND"):
            out = out & self._not(p)
        return out

    def _not(self, p: _Parser) -> Column:
        return ~self._not(p) if p.take("NOT") else self._comparison(p)

    def _comparison(self, p: _Parser) -> Column:
        a, ta = self._sum(p)
        if p.take("IS"):
            negate = p.take("NOT")
            p.need("NULL")
            return a.isNotNull() if negate else a.isNull()
        if p.take("IN"):
            p.need("[")
            values = []
            while not p.take("]"):
                values.append(p.literal())
                p.take(",")
            return a.isin([str(v) for v in values] if ta == "text" else values)
        for word, f in (("STARTS", lambda x, y: x.startswith(y)), ("ENDS", lambda x, y: x.endswith(y))):
            if p.take(word):
                p.need("WITH")
                return f(a, self._sum(p)[0])
        if p.take("CONTAINS"):
            return a.contains(self._sum(p)[0])
        for op, f in {"<=": lambda x, y: x <= y, ">=": lambda x, y: x >= y, "<>": lambda x, y: x != y, "=~": lambda x, y: x.rlike(y), "=": lambda x, y: x == y, "<": lambda x, y: x < y, ">": lambda x, y: x > y}.items():
            if p.peek(op):
                p.take(op)
                b, tb = self._sum(p)
                if ta != tb and "number" in (ta, tb):  # properties are texts
                    a, b = (a.try_cast("double") if ta == "text" else a), (b.try_cast("double") if tb == "text" else b)
                return f(a, b)
        return a

    def _sum(self, p: _Parser) -> tuple[Column, str]:
        a, t = self._product(p)
        while p.peek("+", "-"):
            op = p.name()
            b, u = self._product(p)
            if op == "+" and t == u == "text" and not (p is None):
                a, t = F.concat(a, b), "text"
                continue
            x, y = self._number(a, t), self._number(b, u)
            a, t = (x + y, "number") if op == "+" else (x - y, "number")
        return a, t

    @staticmethod
    def _number(c: Column, t: str) -> Column:
        return c.try_cast("double") if t == "text" else c

    def _product(self, p: _Parser) -> tuple[Column, str]:
        a, t = self._atom(p)
        while p.peek("*", "/", "%"):
            op = p.name()
            b, u = self._atom(p)
            x, y = self._number(a, t), self._number(b, u)
            a, t = {"*": x * y, "/": F.try_divide(x, y), "%": x % y}[op], "number"
        return a, t

    def _atom(self, p: _Parser) -> tuple[Column, str]:
        if p.take("("):
            out = self._or(p)
            p.need(")")
            return out, "value"
        if p.take("-"):
            a, t = self._atom(p)
            return -self._number(a, t), "number"
        if p.peek("[") and p.peek("IN", ahead=2):
            return self._comprehension(p), "value"
        if p.take("["):
            items = []
            while not p.take("]"):
                items.append(self._sum(p)[0])
                p.take(",")
            return self._looked_up(p, F.array(*items)), "value"
        if p.peek("ALL", "ANY", "NONE", "SINGLE") and p.peek("(", ahead=1):
            return self._quantified(p), "value"
        if p.peek("CASE"):
            return self._case(p), "value"
        kind, v = p.tokens[p.at]
        if kind in ("num", "str") or v.lower() in ("true", "false", "null"):
            x = p.literal()
            return F.lit(x), "number" if isinstance(x, (int, float)) and not isinstance(x, bool) else "text" if isinstance(x, str) else "value"
        name = p.name()
        if name in getattr(self, "bound", {}):
            return self.bound[name], "value"
        if p.peek("("):
            return self._call(name.lower(), p)
        if p.take("."):
            key = p.name()
            if self.names.get(name) in ("node", "edge"):
                return F.col(f"`{name}`")["properties"][key], "text"
            return F.col(f"`{name}`")[key], "text"
        if p.peek("["):
            return self._looked_up(p, F.col(f"`{name}`")), "value"
        if p.peek(":") and self.names.get(name) == "node":
            p.take(":")
            return F.array_contains(F.col(f"`{name}`")["labels"], p.name()), "value"
        return F.col(f"`{name}`"), self.names[name] if self.names.get(name) in ("text", "walk") else "value"

    def _looked_up(self, p: _Parser, items: Column) -> Column:
        """[i] and [a..b] after a list; places count from 0, below 0 from the end."""
        while p.take("["):
            size, a = F.size(items), None if p.peek("..") else self._sum(p)[0].cast("int")
            from_end = lambda i, n=size: F.when(i < 0, i + n).otherwise(i)
            if p.take(".."):
                b = size if p.peek("]") else F.least(from_end(self._sum(p)[0].cast("int")), size)
                a = F.lit(0) if a is None else F.greatest(from_end(a), F.lit(0))
                items = F.slice(items, a + 1, F.greatest(b - a, F.lit(0)))
            else:
                items = F.get(items, from_end(a))
            p.need("]")
        return items

    def _comprehension(self, p: _Parser) -> Column:
        """[x IN list WHERE test | value]; test and value are expressions of x."""
        p.need("[")
        var = p.name()
        p.need("IN")
        items, _ = self._sum(p)
        outer = self.names

        def within(start: int, read) -> tuple:
            """The expression that starts there as a function of the variable, and where it ended."""
            ends: list[int] = []

            def of(x: Column) -> Column:
                p.at, self.names = start, {**outer, var: "value"}
                self.bound = {**getattr(self, "bound", {}), var: x}
                out = read()
                ends.append(p.at)
                self.names, self.bound = outer, {k: v for k, v in self.bound.items() if k != var}
                return out

            return of, ends

        if p.take("WHERE"):
            of, ends = within(p.at, lambda: self._or(p))
            items = F.filter(items, of)
            p.at = ends[-1]
        if p.take("|"):
            of, ends = within(p.at, lambda: self._sum(p)[0])
            items = F.transform(items, of)
            p.at = ends[-1]
        p.need("]")
        return items

    def _case(self, p: _Parser) -> Column:
        p.need("CASE")
        base = None if p.peek("WHEN") else self._sum(p)[0]
        out = None
        while p.take("WHEN"):
            test = self._or(p) if base is None else base == self._sum(p)[0]
            p.need("THEN")
            value = self._sum(p)[0]
            out = F.when(test, value) if out is None else out.when(test, value)
        if p.take("ELSE"):
            out = out.otherwise(self._sum(p)[0])
        p.need("END")
        return out

    def _quantified(self, p: _Parser) -> Column:
        how = p.name().upper()
        p.need("(")
        var = p.name()
        p.need("IN")
        items, _ = self._sum(p)
        p.need("WHERE")
        start = p.at

        def test(x: Column) -> Column:
            p.at = start
            outer = self.names
            self.names = {**outer, var: "value"}
            bound, self._bound = getattr(self, "_bound", {}), {var: x}
            a = self._lambda(p, var, x)
            self.names, self._bound = outer, bound
            return a

        out = {"ALL": lambda: F.forall(items, test), "ANY": lambda: F.exists(items, test), "NONE": lambda: ~F.exists(items, test), "SINGLE": lambda: F.size(F.filter(items, test)) == 1}[how]()
        p.need(")")
        return out

    @staticmethod
    def _lambda(p: _Parser, var: str, x: Column) -> Column:
        """var op literal."""
        if p.name() != var:
            raise ValueError("the predicate must start with its variable")
        op, v = p.name(), p.literal()
        return {"=": x == v, "<>": x != v, "<": x < v, ">": x > v, "<=": x <= v, ">=": x >= v}[op]

    def _call(self, f: str, p: _Parser) -> tuple[Column, str]:
        p.need("(")
        if f == "count" and p.take("*"):
            p.need(")")
            return F.count(F.lit(1)), "number"
        if f == "point":
            m = p.map()
            p.need(")")
            return F.struct(*[F.lit(float(v)).alias(k) for k, v in m.items()]), "value"
        distinct = p.take("DISTINCT")
        args = []
        while not p.take(")"):
            args.append(self._sum(p))
            p.take(",")
        a, t = args[0] if args else (None, "value")
        if f in _AGGREGATES:
            if f in ("avg", "sum", "stdev", "stdevp") or f in ("min", "max") and t == "text":
                a = self._number(a, t)
            if f == "collect":
                return (F.collect_set(a) if distinct else F.collect_list(a)), "value"
            return (F.count_distinct(a) if distinct and f == "count" else _AGGREGATES[f](a)), "number"
        return {
            "id": lambda: (a["id"], "text"), "labels": lambda: (a["labels"], "value"), "type": lambda: (F.get(a["labels"], 0), "text"), "keys": lambda: (F.map_keys(a["properties"]), "value"), "properties": lambda: (a["properties"], "value"),
            "size": lambda: (F.size(a), "number"), "length": lambda: (F.size(a["relationships"] if t == "walk" else a), "number"), "relationships": lambda: (a["relationships"] if t == "walk" else a, "value"), "nodes": lambda: (a["nodes"], "value"),
            "head": lambda: (F.get(a, 0), "value"), "last": lambda: (F.element_at(a, -1), "value"), "range": lambda: (F.sequence(a, args[1][0]), "value"), "reverse": lambda: (F.reverse(a), t), "tolower": lambda: (F.lower(a), "text"), "toupper": lambda: (F.upper(a), "text"), "tointeger": lambda: (a.try_cast("bigint"), "number"), "tofloat": lambda: (a.try_cast("double"), "number"),
            "tostring": lambda: (a.cast("string"), "text"), "abs": lambda: (F.abs(self._number(a, t)), "number"), "coalesce": lambda: (F.coalesce(*[x for x, _ in args]), t), "exists": lambda: (a.isNotNull(), "value"),
            "distance": lambda: (F.hypot(args[0][0]["x"] - args[1][0]["x"], args[0][0]["y"] - args[1][0]["y"]), "number"),
        }[f]()

    # Patterns.

    @staticmethod
    def _used(tokens: list[tuple[str, str]]) -> dict[str, set | None]:
        """The properties that a query reads of each variable, None where it may need them all: where the variable stands by
        itself, but in a pattern, with a label, or in a call that asks for none."""
        at = lambda i: tokens[i] if 0 <= i < len(tokens) else ("", "")
        everything = any(v == "*" and at(i - 1)[1].upper() in ("RETURN", "WITH", "DISTINCT") for i, (_, v) in enumerate(tokens))
        uses: dict[str, set | None] = {}
        for i, (kind, name) in enumerate(tokens):
            if kind != "id" or at(i - 1)[1] == ".":
                continue
            after, before = at(i + 1)[1], at(i - 1)[1]
            if after == "." and at(i + 2)[0] == "id":
                if uses.setdefault(name, set()) is not None:
                    uses[name].add(at(i + 2)[1])
                continue
            called = before == "(" and at(i - 2)[0] == "id" and at(i - 2)[1].upper() not in ("MATCH", "EXISTS")
            free = at(i - 2)[1].lower() in ("count", "id", "labels") and after == ")" if called else before == "(" and after in (")", ":", "{") or after == ":"
            uses[name] = uses.get(name, set()) if free and not everything else None
        return uses

    def _node(self, part: _Part) -> DataFrame:
        read = self.uses.get(part.name, set())
        n = self.graph.nodes if self.graph.wide is None or read is None else self.graph.wide
        for label in part.labels:
            n = n.filter(F.array_contains("labels", label))
        for k, v in part.properties.items():
            n = n.filter(F.col("properties")[k] == str(v))
        if read is not None:
            some = [x for k in sorted(read) for x in (F.lit(k), F.col("properties")[k])]
            n = n.withColumn("properties", F.create_map(*some) if some else F.create_map().cast("map<string,string>"))
        return n.select(F.struct("id", "labels", "properties").alias(part.name))

    def _edges(self, part: _Part) -> DataFrame:
        """Edges as (from, to, edge) in the way the pattern goes; without a way both."""
        e = self.graph.edges
        if part.labels:
            e = e.filter(F.arrays_overlap("labels", F.array(*map(F.lit, part.labels))))
        for k, v in part.properties.items():
            e = e.filter(F.col("properties")[k] == str(v))
        s = F.struct("id", "source", "target", "labels", "properties").alias("e")
        out, back = e.select(F.col("source").alias("f"), F.col("target").alias("t"), s), e.select(F.col("target").alias("f"), F.col("source").alias("t"), s)
        return back if part.way == "<" else out if part.way == ">" else out.union(back.filter("f <> t"))

    def _match(self, rows: DataFrame | None, parts: list[_Part]) -> DataFrame:
        first, out = parts[0], rows
        if first.name not in self.names:
            n = self._node(first)
            out = n if out is None else out.join(n)
            self.names[first.name] = "node"
        used: list[tuple[str, _Part]] = []
        for i in range(1, len(parts), 2):
            prev, edge, node = parts[i - 1].name, parts[i], parts[i + 1]
            fixed = edge.least == edge.most == 1
            out = self._hopped(out, prev, edge, used) if fixed else self._walked(out, prev, edge, used)
            track = f"_used{len(used)}_{edge.name}"
            out = out.withColumn(track, F.col("_path")).withColumn(edge.name, F.col("_path")).drop("_path")
            used.append((track, edge))
            self.names[edge.name] = "edge" if fixed else "path"
            if node.name in self.names:
                out = out.filter(F.col(f"`{node.name}`.id") == F.col("_end")).drop("_end")
            else:
                out = out.join(self._node(node), F.col("_end") == F.col(f"`{node.name}`.id")).drop("_end")
                self.names[node.name] = "node"
        return out.drop(*[track for track, _ in used])

    def _free(self, edge: _Part, used: list[tuple[str, _Part]], id_: Column) -> Column:
        """Whether the pattern hasn't used this edge yet; edges of one label each can't be those of other labels."""
        out = F.lit(True)
        for track, other in used:
            if self.graph.wide is not None and edge.labels and other.labels and not set(edge.labels) & set(other.labels):
                continue
            before = F.col(f"`{track}`")
            out = out & (before["id"] != id_ if other.least == other.most == 1 else ~F.exists(before, lambda x: x["id"] == id_))
        return out

    def _hopped(self, rows: DataFrame, start: str, edge: _Part, used: list[tuple[str, _Part]]) -> DataFrame:
        """The rows with _path, one edge from a node on, and _end, the id of the node there."""
        hop = self._edges(edge).toDF("_f", "_end", "_path")
        return rows.join(hop, F.col(f"`{start}`.id") == F.col("_f")).drop("_f").filter(self._free(edge, used, F.col("_path.id")))

    def _walked(self, rows: DataFrame, start: str, edge: _Part, used: list[tuple[str, _Part]]) -> DataFrame:
        """The rows with _path, edges one after another from a node on, and _end, the id of the last one's node. Of any length,
        a walk goes on while any row has an edge left that it hasn't used; each step is held."""
        hop = self._edges(edge).toDF("_f", "_t", "_e")
        none = F.expr(f"CAST(array() AS array<{hop.schema['_e'].dataType.simpleString()}>)")
        now, found, length = rows.withColumn("_path", none).withColumn("_end", F.col(f"`{start}`.id")), [], 0
        while True:
            if length >= edge.least:
                found.append(now)
            if length == edge.most or edge.most is None and length and now.isEmpty():
                break
            free = ~F.exists("_path", lambda x: x["id"] == F.col("_e.id")) & self._free(edge, used, F.col("_e.id"))
            step = now.join(hop, F.col("_end") == F.col("_f")).filter(free)
            now = step.withColumn("_path", F.array_append("_path", F.col("_e"))).withColumn("_end", F.col("_t")).drop("_f", "_t", "_e")
            now = held(now) if edge.most is None else now
            length += 1
        return reduce(lambda a, b: a.unionByName(b), found) if found else now

    # Clauses.

    def run(self, text: str) -> DataFrame:
        parts = re.split(r"\bUNION\b(\s+ALL\b)?", text, flags=re.I)
        if len(parts) > 1:
            out = Cypher(self.graph).run(parts[0])
            for all_, part in zip(parts[1::2], parts[2::2]):
                out = out.union(Cypher(self.graph).run(part))
                out = out if all_ else out.distinct()
            return out
        p, rows = _Parser(text), None
        self.uses = self._used(p.tokens)
        while p.at < len(p.tokens):
            if p.take("USE"):
                p.name()
            elif p.peek("MATCH", "OPTIONAL"):
                optional = p.take("OPTIONAL")
                p.need("MATCH")
                rows = self._optional(p, rows) if optional else self._plain(p, rows)
            elif p.take("WHERE"):
                rows = rows.filter(self._or(p))
            elif p.take("UNWIND"):
                items, _ = self._sum(p)
                p.need("AS")
                name = p.name()
                rows = (rows if rows is not None else self.graph.nodes.sparkSession.range(1).select(F.lit(1).alias("_one"))).withColumn(name, F.explode(items))
                self.names[name] = "value"
            elif p.take("WITH"):
                rows = self._project(p, rows)
            elif p.take("RETURN"):
                rows = self._project(p, rows)
            else:
                raise ValueError(f"cannot run: {p.tokens[p.at:p.at + 4]}")
        return rows

    def _plain(self, p: _Parser, rows):
        while True:
            name = None
            if p.peek("=", ahead=1):
                name = p.name()
                p.need("=")
            parts = p.pattern()
            rows = self._match(rows, parts)
            if name:  # edges of the whole pattern, and ids of its named nodes
                steps = [F.array(F.col(f"`{e.name}`")) if self.names[e.name] == "edge" else F.col(f"`{e.name}`") for e in parts[1::2]]
                ids = F.array(*[F.col(f"`{n.name}`.id") for n in parts[::2]])
                rows = rows.withColumn(name, F.struct(F.concat(*steps).alias("relationships"), ids.alias("nodes")) if steps else F.struct(F.array().alias("relationships"), ids.alias("nodes")))
                self.names[name] = "walk"
            if not p.take(","):
                return rows

    def _optional(self, p: _Parser, rows: DataFrame) -> DataFrame:
        """Rows without a match keep nulls for what it would bind."""
        before = dict(self.names)
        keyed = rows.withColumn("_row", F.sha2(F.to_json(F.struct(*[F.col(f"`{n}`") for n in before])), 256))
        found = self._match(keyed, p.pattern())
        if p.take("WHERE"):
            found = found.filter(self._or(p))
        new = [n for n in self.names if n not in before]
        bound = found.select(F.col("_row").alias("_r2"), *[F.col(f"`{n}`") for n in new]).withColumn("_json", F.to_json(F.struct(*[F.col(f"`{n}`") for n in new]))).dropDuplicates(["_r2", "_json"]).drop("_json")
        return keyed.join(bound, F.col("_row") == F.col("_r2"), "left").drop("_row", "_r2")

    def _project(self, p: _Parser, rows: DataFrame) -> DataFrame:
        distinct = p.take("DISTINCT")
        items: list[tuple[str, Column, bool, str]] = []
        if p.take("*"):
            items = [(n, F.col(f"`{n}`"), False, k) for n, k in self.names.items() if not n.startswith("_")]
        else:
            while True:
                start = p.at
                aggregate = any(p.tokens[i][1].lower() in _AGGREGATES and i + 1 < len(p.tokens) and p.tokens[i + 1][1] == "(" for i in self._span(p))
                a, t = self._sum(p) if not self._logical(p) else (self._or(p), "value")
                kind = self.names.get(p.tokens[start][1], t) if p.at == start + 1 else t
                name = p.name() if p.take("AS") else "".join(v for _, v in p.tokens[start : p.at])
                items.append((name, a, aggregate, kind))
                if not p.take(","):
                    break
        if any(i[2] for i in items):
            keys = [c.alias(n) for n, c, agg, _ in items if not agg]
            calls = [c.alias(n) for n, c, agg, _ in items if agg]
            out = (rows.groupBy(*keys).agg(*calls) if keys else rows.agg(*calls)).select(*[F.col(f"`{n}`") for n, *_ in items])
        else:
            out = rows.select(*[c.alias(n) for n, c, *_ in items])
        self.names = {n: k for n, _, _, k in items}
        out = out.distinct() if distinct else out
        if p.take("ORDER"):
            p.need("BY")
            keys = []
            while True:
                a, _ = self._sum(p)
                desc = p.take("DESC", "DESCENDING")
                if not desc:
                    p.take("ASC", "ASCENDING")
                keys.append(a.desc_nulls_first() if desc else a.asc_nulls_last())
                if not p.take(","):
                    break
            out = out.orderBy(*keys)
        if p.take("SKIP"):
            out = out.offset(p.literal())
        if p.take("LIMIT"):
            out = out.limit(p.literal())
        return out

    @staticmethod
    def _span(p: _Parser) -> range:
        """Tokens of the item that starts here."""
        depth, i = 0, p.at
        while i < len(p.tokens):
            v = p.tokens[i][1]
            if depth == 0 and p.tokens[i][0] != "str" and v.upper() in (",", "ORDER", "SKIP", "LIMIT", "WHERE", "MATCH", "RETURN", "WITH", "UNWIND", "OPTIONAL", "AS") and i > p.at:
                break
            depth += (v in ("(", "[", "{")) - (v in (")", "]", "}"))
            i += 1
        return range(p.at, i)

    def _logical(self, p: _Parser) -> bool:
        return any(p.tokens[i][0] != "str" and p.tokens[i][1].upper() in ("=", "<", ">", "<=", ">=", "<>", "AND", "OR", "NOT", "XOR", "IS", "IN", "STARTS", "ENDS", "CONTAINS") for i in self._span(p) if not p.peek("ALL", "ANY", "NONE", "SINGLE", "CASE"))


def run(graph: Graph, text: str) -> DataFrame:
    return Cypher(graph).run(text)


# Changes as text.


def execute(graph: Graph, text: str) -> Graph:
    """CREATE, or MATCH … [WHERE …] with SET, REMOVE or DELETE; gives the changed graph. New elements get ids from their
    pattern's text, so that running a plan again gives the same ones."""
    head = re.match(r"\s*CREATE\b(.*)$", text, re.I | re.S)
    if head:
        return _created(graph, head[1])
    m = re.match(r"(.*?)\b(SET|REMOVE|DETACH\s+DELETE|DELETE)\b(.*)$", text, re.I | re.S)
    found, verb = m[1], m[2].upper()
    for item in [i.strip().rstrip(";") for i in re.split(r",(?![^{}]*\})", m[3])]:
        var = re.match(r"\w+", item)[0]
        rows = Cypher(graph).run(f"{found} RETURN id({var}) AS id").distinct()
        graph = _changed(graph, verb, item, rows)
    return graph


def _created(graph: Graph, text: str) -> Graph:
    p, known = _Parser(text), {}
    nodes, edges = [], []
    while p.at < len(p.tokens):
        parts = p.pattern()
        for part in parts[::2]:
            if part.name not in known:
                known[part.name] = f"new:{part.name}:{'.'.join(part.labels)}:{sorted(part.properties.items())}"
                nodes.append((known[part.name], part.labels, {k: str(v) for k, v in part.properties.items()}))
        for i, part in enumerate(parts[1::2]):
            a, b = known[parts[2 * i].name], known[parts[2 * i + 2].name]
            a, b = (b, a) if part.way == "<" else (a, b)
            edges.append((f"{a}-{'.'.join(part.labels)}-{b}", a, b, part.labels, {k: str(v) for k, v in part.properties.items()}))
        p.take(",")
    return graph.create(nodes, edges)


def _changed(graph: Graph, verb: str, item: str, rows: DataFrame) -> Graph:
    if verb.endswith("DELETE"):
        return graph.delete(rows)
    hit = graph.nodes.join(rows.select(F.col("id").alias("h_")), F.col("id") == F.col("h_"), "left")
    on, props, labels = F.col("h_").isNotNull(), F.col("properties"), F.col("labels")
    if prop := re.fullmatch(r"\w+\.(\w+)(?:\s*=\s*(.*))?", item, re.S):
        rest = F.map_filter("properties", lambda k, v: k != prop[1])
        if verb == "SET":
            value = _Parser(prop[2]).literal()
            props = F.when(on, rest if value is None else F.map_concat(rest, F.create_map(F.lit(prop[1]), F.lit(str(value))))).otherwise(props)
        else:
            props = F.when(on, rest).otherwise(props)
    elif whole := re.fullmatch(r"\w+\s*(\+?=)\s*(\{.*\})", item, re.S):
        given = {k: str(v) for k, v in _Parser(whole[2]).map().items()}
        new = F.create_map(*[F.lit(x) for kv in given.items() for x in kv]) if given else F.create_map().cast("map<string,string>")
        kept = F.map_filter("properties", lambda k, v: ~k.isin(list(given)))
        props = F.when(on, F.map_concat(kept, new) if whole[1] == "+=" else new).otherwise(props)
    else:
        named = F.array(*[F.lit(x) for x in re.findall(r":(\w+)", item)])
        labels = F.when(on, F.array_union("labels", named) if verb == "SET" else F.array_except("labels", named)).otherwise(labels)
    return Graph(hit.select("id", labels.alias("labels"), props.alias("properties")), graph.edges)


def from_documents(df: DataFrame, label: str, key: str, children: dict[str, str]) -> Graph:
    """Documents as nodes; each nested document of a field (or of an array of them) is a node of its own, with an edge of the
    field's name. children: field -> label."""
    plain = [f.name for f in df.schema.fields if f.name not in children and "struct" not in f.dataType.simpleString() and "array" not in f.dataType.simpleString()]
    nodes, edges = node_rows(df.select(*plain), label, key), None
    for name, child in children.items():
        many = df.schema[name].dataType.simpleString().startswith("array")
        each = df.select(F.col(key).cast("string").alias("_p"), (F.posexplode(name) if many else F.posexplode(F.array(name))).alias("_i", "_c")).filter("_c is not null")
        fields = each.schema["_c"].dataType.names
        flat = each.select("_p", F.concat_ws(".", "_p", F.lit(name), F.col("_i").cast("string")).alias("_key"), *[F.col("_c")[f].alias(f) for f in fields])
        nodes = nodes.unionByName(node_rows(flat.select("_key", *fields), child, "_key").withColumn("properties", F.map_filter("properties", lambda k, v: k != "_key")))
        link = edge_rows(flat, name, F.concat(F.lit(f"{label}:"), "_p"), F.concat(F.lit(f"{child}:"), "_key"))
        edges = link if edges is None else edges.unionByName(link)
    return Graph(nodes, edges)
