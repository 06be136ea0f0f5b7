"""Small query surfaces: contextual queries, dataflow scripts, resource requests and textual plans. All give frames."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce
from urllib.parse import parse_qsl, unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.operators.rel import ordered

Tables = Callable[[str], DataFrame]
_AGGREGATES = {"COUNT": F.count, "MAX": F.max, "MIN": F.min, "SUM": F.sum, "AVG": F.avg}
_COMPARE = {"=": lambda a, b: a == b, "==": lambda a, b: a == b, "<>": lambda a, b: a != b, ">": lambda a, b: a > b, "<": lambda a, b: a < b, ">=": lambda a, b: a >= b, "<=": lambda a, b: a <= b}


def _literal(text: str):
    if re.fullmatch(r"-?\d+", text):
        return int(text)
    if re.fullmatch(r"-?\d*\.\d+", text):
        return float(text)
    return {"true": True, "false": False, "null": None}.get(text.lower(), text.strip("'\""))


# Contextual queries: filters [relation ...] [project ...] [sortby ...].

_CQL = re.compile(r"""\s*("(?:[^"\\]|\\.)*"|'[^']*'|[()]|<=|>=|<>|==|=|<|>|/|[^\s()=<>/"']+)""")


class Cql:
    """`a.x > 3 and not b.y == "q" relation a and/on=[k] b project a.x b.y/sum sortby a.x/descending`.

    relation joins tables: `and` is an inner join and `or` an outer one (null=left or right narrows it), on their columns of
    equal names or on those that on=[...] names. Columns are table.column.
    """

    def __init__(self, tables: Tables):
        self.tables = tables

    def run(self, text: str) -> DataFrame:
        parts = re.split(r"\b(relation|project|sortby)\b", text)
        sections = {"filter": parts[0], **dict(zip(parts[1::2], parts[2::2]))}
        names = list(dict.fromkeys(re.findall(r"([A-Za-z_]\w*)\.[A-Za-z_]\w*", text)))
        rows = self._relation(sections["relation"]) if "relation" in sections else self._table(names[0])
        if sections["filter"].strip():
            self.tokens, self.at = _CQL.findall(sections["filter"]), 0
            rows = rows.filter(self._or())
        if "project" in sections:
            rows = self._project(rows, sections["project"].split())
        if "sortby" in sections:
            keys = [k.split("/") for k in sections["sortby"].split()]
            rows = rows.orderBy(*[(F.col(f"`{self._shown(k[0])}`").desc_nulls_first() if "descending" in k[1:] else F.col(f"`{self._shown(k[0])}`").asc_nulls_last()) for k in keys])
        return rows

    def _shown(self, name: str) -> str:
        return name.replace(".", "_") if getattr(self, "projected", False) else name

    def _table(self, name: str) -> DataFrame:
        t = self.tables(name)
        return t.toDF(*[f"{name}.{c}" for c in t.columns])

    def _relation(self, text: str) -> DataFrame:
        tokens = re.findall(r"(?:[^\s\[\]]|\[[^\]]*\])+", text)
        out, seen = self._table(tokens[0]), [tokens[0]]
        for op, name in zip(tokens[1::2], tokens[2::2]):
            how, *settings = op.split("/")
            given = dict(s.split("=", 1) for s in settings)
            right = self._table(name)
            pairs = re.findall(r"[\w.]+=[\w.]+|\w+", given["on"].strip("[]")) if "on" in given else [c.split(".")[1] for c in right.columns if any(f"{s}.{c.split('.')[1]}" in out.columns for s in seen)]
            on = []
            for p in pairs:
                a, b = p.split("=") if "=" in p else (next(f"{s}.{p}" for s in seen if f"{s}.{p}" in out.columns), f"{name}.{p}")
                on.append(F.col(f"`{a}`") == F.col(f"`{b}`"))
            kind = "inner" if how == "and" else {"both": "full", "left": "right", "right": "left"}[given.get("null", "both")]
            out = out.join(right, reduce(lambda a, b: a & b, on), kind)
            seen.append(name)
        return out

    def _or(self) -> Column:
        out = self._and()
        while self.at < len(self.tokens) and self.tokens[self.at] == "or":
            self.at += 1
            out = out | self._and()
        return out

    def _and(self) -> Column:
        out = self._not()
        while self.at < len(self.tokens) and self.tokens[self.at] in ("and", "not"):
            negate = self.tokens[self.at] == "not"
            self.at += 1
            if self.tokens[self.at] == "not":
                self.at, negate = self.at + 1, True
            term = self._not()
            out = out & (~term if negate else term)
        return out

    def _not(self) -> Column:
        if self.tokens[self.at] == "not":
            self.at += 1
            return ~self._not()
        if self.tokens[self.at] == "(":
            self.at += 1
            out = self._or()
            self.at += 1
            return out
        left, op, right = self.tokens[self.at : self.at + 3]
        self.at += 3
        value = F.col(f"`{right}`") if re.fullmatch(r"[A-Za-z_]\w*\.[A-Za-z_]\w*", right) else F.lit(_literal(right))
        return _COMPARE[op](F.col(f"`{left}`"), value)

    def _project(self, rows: DataFrame, items: list[str]) -> DataFrame:
        self.projected = True
        keys, calls = [], []
        for item in items:
            name, *call = item.split("/")
            c, shown = F.col(f"`{name}`"), name.replace(".", "_")
            (calls.append(_AGGREGATES[call[0].upper()](c).alias(f"{shown}_{call[0]}")) if call else keys.append(c.alias(shown)))
        return rows.groupBy(*keys).agg(*calls) if calls else rows.select(*keys)


# Dataflow scripts.


def pig(script: str, tables: Tables, spark: SparkSession, empty_bags: bool = False) -> DataFrame:
    """LOAD, FILTER BY, FOREACH GENERATE, DISTINCT, ORDER BY, LIMIT, GROUP BY or ALL, VALUES and DUMP. A grouped relation has
    `group` and functions over its bag (COUNT(a), SUM(a.x), …) in the FOREACH that follows. empty_bags: a group whose nested FILTER
    leaves nothing stays, with a count of 0; otherwise it goes."""
    held: dict[str, tuple] = {}
    last = None
    for line in filter(None, (s.strip() for s in re.split(r";(?![^{}]*\})", script))):
        if m := re.fullmatch(r"DUMP\s+(\w+)", line, re.I):
            return held[m[1]][0]
        name, body = (s.strip() for s in line.split("=", 1))
        last = name
        if m := re.fullmatch(r"LOAD\s+'?(\w+)'?(?:\s+AS\s+\((.*)\))?", body, re.I):
            held[name] = (tables(m[1]),)
        elif m := re.fullmatch(r"VALUES\s+(.*?)\s+AS\s+\((.*)\)", body, re.I | re.S):
            rows = [tuple(_literal(v.strip()) for v in r.split(",")) for r in re.findall(r"\(([^()]*)\)", m[1])]
            held[name] = (spark.createDataFrame(rows, [c.strip() for c in m[2].split(",")]),)
        elif m := re.fullmatch(r"FILTER\s+(\w+)\s+BY\s+(.*)", body, re.I | re.S):
            held[name] = (held[m[1]][0].filter(m[2].replace("==", "=")),)
        elif m := re.fullmatch(r"DISTINCT\s+(\w+)", body, re.I):
            held[name] = (held[m[1]][0].distinct(),)
        elif m := re.fullmatch(r"LIMIT\s+(\w+)\s+(\d+)", body, re.I):
            held[name] = (held[m[1]][0].limit(int(m[2])),)
        elif m := re.fullmatch(r"ORDER\s+(\w+)\s+BY\s+(.*)", body, re.I | re.S):
            keys = [(k.split()[0], k.split()[1] if len(k.split()) > 1 else "ASC") for k in m[2].split(",")]
            held[name] = (held[m[1]][0].orderBy(*ordered(keys)),)
        elif m := re.fullmatch(r"GROUP\s+(\w+)\s+(?:BY\s+(.*)|ALL)", body, re.I | re.S):
            held[name] = (held[m[1]][0], m[1], [k.strip() for k in m[2].strip("()").split(",")] if m[2] else [])
        elif m := re.fullmatch(r"FOREACH\s+(\w+)\s+(?:\{(.*)GENERATE\s+(.*)\}|GENERATE\s+(.*))", body, re.I | re.S):
            source, inner, items = held[m[1]], m[2], (m[3] or m[4]).strip().rstrip(";")
            bags: dict[str, list[str]] = {}
            rows, grouped = source[0], len(source) > 1
            for step in filter(None, (s.strip() for s in (inner or "").split(";"))):
                if f := re.fullmatch(r"(\w+)\s*=\s*FILTER\s+(\w+)\s+BY\s+(.*)", step, re.I | re.S):
                    test = f[3].replace("==", "=")
                    if grouped and empty_bags:
                        bags[f[1]] = [*bags.get(f[2], []), test]
                    else:
                        rows = rows.filter(test)
                elif re.fullmatch(r"\w+\s*=\s*DISTINCT\s+\w+", step, re.I):
                    rows = rows.distinct()
            held[name] = (_generate(rows, source, items, bags),)
        else:
            raise ValueError(f"cannot read: {line}")
    return held[last][0]


def _generate(rows: DataFrame, source: tuple, text: str, bags: dict[str, list[str]]) -> DataFrame:
    """The items of a FOREACH. bags: the filters of nested relations that keep their groups."""
    items = [re.fullmatch(r"(.*?)(?:\s+AS\s+(\w+))?", s.strip(), re.I | re.S) for s in re.split(r",(?![^()]*\))", text)]
    if len(source) == 1:
        return rows.select(*[F.expr(m[1]).alias(m[2]) if m[2] else F.expr(m[1]) for m in items])
    keys, calls = source[2], []
    order: list[str] = []
    for m in items:
        if m[1].lower().startswith("group"):
            field = m[1].split(".")[1] if "." in m[1] else (keys[0] if keys else "group")
            order.append((field, m[2] or "group"))
            continue
        f, arg = re.fullmatch(r"(\w+)\((.*)\)", m[1]).groups()
        c = F.lit(1) if "." not in arg else F.col(arg.split(".")[1])
        for test in bags.get(arg.split(".")[0].strip(), []):
            c = F.when(F.expr(test), c)
        shown = m[2] or f.lower()
        calls.append(_AGGREGATES[f.upper()](c).alias(shown))
        order.append((shown, shown))
    out = rows.groupBy(*keys).agg(*calls) if keys else rows.agg(*calls)
    return out.select(*[F.col(a).alias(b) for a, b in order])


# Resource requests.


def rest_filters(query: str) -> Column:
    """All filters of a request on one resource."""
    out = F.lit(True)
    for name, v in parse_qsl(query, keep_blank_values=True):
        if name.startswith("_"):
            continue
        m = re.match(r"(!%|%|<=|>=|!=|=|<|>)(.*)", v, re.S)
        c = F.col(name)
        test = (c.like(m[2]) if m[1] == "%" else ~c.like(m[2])) if m[1] in ("%", "!%") else _COMPARE[{"!=": "<>"}.get(m[1], m[1])](c, F.lit(_literal(m[2])))
        out = out & test
    return out


def rest(request: str, tables: Tables) -> DataFrame:
    """GET a,b?_project=...&_groupby=...&_sort=col@DESC&_limit=n&_offset=n&column=<op>value; several resources are joined by
    the filters. Filter values start with =, !=, <, >, <=, >=, % (like) or !% (not like); & of one column repeats it."""
    path, _, query = request.removeprefix("GET").strip().lstrip("/").partition("?")
    pairs = parse_qsl(query, keep_blank_values=True)
    settings = {k: v for k, v in pairs if k.startswith("_")}
    filters = [(k, v) for k, v in pairs if not k.startswith("_")]
    frames = [tables(n.split(".")[-1]).alias(n.split(".")[-1]) for n in unquote(path).split(",")]
    joins, tests = [], []
    for name, v in filters:
        m = re.match(r"(!%|%|<=|>=|!=|=|<|>)(.*)", v, re.S)
        op, arg = m[1], m[2]
        other = F.col(arg) if re.fullmatch(r"[A-Za-z_]\w*\.[A-Za-z_]\w*", arg) else None
        c = F.col(name)
        if op in ("%", "!%"):
            test = c.like(arg) if op == "%" else ~c.like(arg)
        else:
            test = _COMPARE[{"!=": "<>"}.get(op, op)](c, other if other is not None else F.lit(_literal(arg)))
        (joins if other is not None else tests).append(test)
    out = frames[0]
    for f in frames[1:]:
        if not joins:
            raise ValueError("several resources need a filter that joins them")
        out = out.join(f, reduce(lambda a, b: a & b, joins))
    for t in tests:
        out = out.filter(t)
    calls, plain = [], []
    for item in filter(None, settings.get("_project", "").split(",")):
        name, _, alias = item.partition("@")
        m = re.fullmatch(r"(\w+)\(([\w.]+)\)", name)
        if m:
            calls.append(_AGGREGATES[m[1].upper()](F.col(m[2])).alias(alias or name))
        else:
            plain.append(F.col(name).alias(alias or name.split(".")[-1]))
    keys = [F.col(k) for k in filter(None, settings.get("_groupby", "").split(","))]
    if calls:
        out = out.groupBy(*(keys or plain)).agg(*calls)
    elif plain:
        out = out.select(*plain)
    if "_sort" in settings:
        out = out.orderBy(*ordered([(k.split("@")[0], k.split("@")[1] if "@" in k else "ASC") for k in settings["_sort"].split(",")]))
    if "_offset" in settings:
        out = out.offset(int(settings["_offset"]))
    return out.limit(int(settings["_limit"])) if "_limit" in settings else out


# Textual plans: OPERATOR[name=value, ...](inputs). E_ names the same operators.


class Plans:
    def __init__(self, spark: SparkSession, tables: Tables, graph=None):
        self.spark, self.tables, self.graph = spark, tables, graph

    def run(self, text: str) -> DataFrame:
        self.text, self.at = text.strip(), 0
        return self._node()

    def _node(self):
        m = re.compile(r"\s*([A-Z_]+)\s*\[").match(self.text, self.at)
        self.at = m.end()
        args = self._until("]")
        inputs = []
        while re.compile(r"\s*[(,]").match(self.text, self.at) and (inputs or self.text[self.at :].lstrip()[0] == "("):
            self.at = re.compile(r"\s*[(,]").match(self.text, self.at).end()
            inputs.append(self._node())
            rest = re.compile(r"\s*\)").match(self.text, self.at)
            if rest:
                self.at = rest.end()
                break
        positional, named = [], {}
        for a in self._split(args):
            k, eq, v = a.partition("=")
            if eq and re.fullmatch(r"\s*(condition|type|order|limit|offset|group|groups|aggregates|table|operation|targets|sources|docs|id|columns|matches|all|entity|projects|names|tuples|path|includes|excludes|distributionType|numbers|model)\s*", k):
                named[k.strip()] = v.strip()
            elif a.strip():
                positional.append(a.strip())
        return self._apply(m[1], positional, named, inputs)

    def _until(self, close: str) -> str:
        depth, start = 1, self.at
        while depth:
            ch = self.text[self.at]
            if ch == "'":
                self.at = self.text.index("'", self.at + 1)
            depth += (ch == "[") - (ch == "]")
            self.at += 1
        return self.text[start : self.at - 1]

    @staticmethod
    def _split(text: str) -> list[str]:
        out, depth, now, quoted = [], 0, "", False
        for ch in text:
            quoted ^= ch == "'"
            depth += (ch in "([") - (ch in ")]") if not quoted else 0
            if ch == "," and depth == 0 and not quoted:
                out.append(now)
                now = ""
            else:
                now += ch
        return [*out, now] if now.strip() else out

    @staticmethod
    def _columns(items: list[str]) -> list[Column]:
        return [F.expr(i) for i in items]

    def _list(self, text: str) -> list[str]:
        return [s.strip() for s in self._split(text.strip().removeprefix("[").removesuffix("]"))]

    def _dealt(self, df: DataFrame, named: dict) -> DataFrame:
        """Rows dealt by the columns at the given places (numbers), or by RANGE of them, to one task (SINGLETON), or evenly."""
        at = [df.columns[int(n)] for n in self._list(named["numbers"])] if named.get("numbers") else []
        kind = named.get("distributionType", "HASH_DISTRIBUTED" if at else "RANDOM_DISTRIBUTED").upper()
        if kind.startswith("SINGLETON"):
            return df.coalesce(1)
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        return df.repartition(n) if not at else df.repartitionByRange(n, *at) if kind.startswith("RANGE") else df.repartition(n, *at)

    def _modified(self, rows: DataFrame, named: dict) -> DataFrame:
        """The table after INSERT of the rows, DELETE of them, or UPDATE: targets = sources in the rows that are given. Rows
        are told apart by all their columns."""
        old, how = self.tables(named["table"]), named["operation"].upper()
        if how == "INSERT":
            return old.unionByName(rows.toDF(*self._list(named["targets"])) if named.get("targets") else rows, allowMissingColumns=True)
        keyed = rows.select(*[F.col(c).alias(f"_m_{c}") for c in old.columns]).distinct()
        same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_m_{c}")) for c in old.columns])
        if how == "DELETE":
            return old.join(keyed, same, "left_anti")
        if how == "UPDATE":
            hit = old.join(keyed.withColumn("_hit", F.lit(True)), same, "left")
            new = dict(zip(self._list(named["targets"]), self._columns(self._list(named["sources"]))))
            return hit.select(*[F.when(F.col("_hit"), new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in old.columns])
        raise ValueError(f"unknown operation: {how}")

    def _apply(self, op: str, args: list[str], named: dict, inputs: list[DataFrame]) -> DataFrame:
        kind = re.sub(r"^(E|REL|DOC|BINDABLE)_", "", op)
        if op.startswith("LPG_"):
            from weft.operators.graph import run

            return run(self.graph, ", ".join(args) if args else named["entity"])
        first = inputs[0] if inputs else None
        if kind in ("SCAN", "VIEW_SCAN"):
            return self.tables(named.get("entity", args[0] if args else ""))
        if op == "DOC_VALUES":
            from weft.operators.doc import Collection, parse_value

            return Collection(self.spark.createDataFrame([], "_id string").select()).of(parse_value(named["docs"] if "docs" in named else args[0]))
        if kind == "VALUES":
            return self.spark.createDataFrame([tuple(_literal(v) for v in self._list(t)) for t in self._list(named["tuples"])], self._list(named["names"]))
        if kind == "FILTER":
            return first.filter(named.get("condition", args[0] if args else ""))
        if kind == "PROJECT":
            if "excludes" in named:
                return first.drop(*self._list(named["excludes"]))
            return first.select(*self._columns(self._list(named.get("projects", named["includes"])) if "projects" in named or "includes" in named else args))
        if kind == "CALC":
            return first.filter(named["condition"]).select(*self._columns(self._list(named["projects"])))
        if kind == "AGGREGATE":
            keys = self._list(named["group"]) if named.get("group") else []
            calls = self._columns(self._list(named["aggregates"]) if "aggregates" in named else args)
            if named.get("groups"):
                sets = [self._list(g) if g.strip().startswith("[") else [g] for g in self._list(named["groups"])]
                keys = list(dict.fromkeys([*keys, *(k for g in sets for k in g)]))
                return first.groupingSets([[F.col(k) for k in g] for g in sets], *[F.col(k) for k in keys]).agg(*calls)
            return first.groupBy(*keys).agg(*calls) if keys else first.agg(*calls)
        if kind == "SORT_EXCHANGE":
            order = self._list(named["order"]) if named.get("order") else args
            return self._dealt(first, named).sortWithinPartitions(*ordered([tuple(k.split()) for k in order]))
        if kind == "MODIFY":
            return self._modified(first, named)
        if kind == "CORRELATE":
            names = ", ".join(inputs[0].columns)
            inputs[0].createOrReplaceTempView("_weft_left")
            how = {"INNER": "CROSS JOIN LATERAL", "LEFT": "LEFT JOIN LATERAL"}[named.get("type", "INNER").upper()]
            on = " ON true" if how.startswith("LEFT") else ""
            return self.spark.sql(f"SELECT * FROM (SELECT {names} FROM _weft_left) AS {named.get('id', 'outer_')} {how} ({args[0]}) AS inner_{on}")
        if kind in ("SORT", "LIMIT"):
            order = self._list(named["order"]) if named.get("order") else args
            out = first.orderBy(*ordered([tuple(k.split()) for k in order])) if order else first
            out = out.offset(int(named["offset"])) if "offset" in named else out
            return out.limit(int(named["limit"])) if "limit" in named else out
        if kind in ("JOIN", "MERGE_JOIN", "SEMI_JOIN"):
            how = "left_semi" if kind == "SEMI_JOIN" else named.get("type", "INNER").lower()
            right = inputs[1].hint("merge") if kind == "MERGE_JOIN" else inputs[1]
            return first.join(right, F.expr(named.get("condition", args[0] if args else "")), how)
        if kind in ("UNION", "INTERSECT", "MINUS"):
            all_ = named.get("all", "false").lower() == "true"
            f = {"UNION": lambda a, b: a.union(b), "INTERSECT": lambda a, b: a.intersectAll(b) if all_ else a.intersect(b), "MINUS": lambda a, b: a.exceptAll(b) if all_ else a.subtract(b)}[kind]
            out = reduce(f, inputs)
            return out.distinct() if kind == "UNION" and not all_ else out
        if kind == "EXCHANGE":
            return self._dealt(first, named)
        if kind == "WINDOW":
            return first.select("*", *self._columns(args))
        if kind == "UNWIND":
            path = named.get("path", args[0] if args else "")
            return first.withColumn(path, F.explode(path))
        if kind == "COLLECT":
            return first.agg(F.collect_list(F.struct(*first.columns)).alias(args[0]))
        if kind == "TRANSFORMER":
            return first.select(F.to_json(F.struct(*first.columns)).alias("d"))
        if kind in ("INTERPRETER", "CONTEXT_SWITCHER", "BATCH_ITERATOR"):
            return first
        raise ValueError(f"unknown operator: {op}")
