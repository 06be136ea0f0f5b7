"""A builder of relational plans: a stack of frames, combined by operators.

    Rel(spark, tables).scan("orders").filter(F.col("o_totalprice") > 10).aggregate(["o_custkey"], n=F.count("*")).build()

Nothing runs before the result is used; Catalyst sees the whole plan.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_HOW = {"INNER": "inner", "LEFT": "left", "RIGHT": "right", "FULL": "full", "SEMI": "left_semi", "ANTI": "left_anti"}


def ordered(keys: list) -> list[Column]:
    """Sort keys: names, columns, or (name, "ASC" or "DESC", "FIRST" or "LAST"). Nulls are high where nothing is said."""
    out = []
    for k in keys:
        if isinstance(k, Column):
            out.append(k)
            continue
        name, way, nulls = (*((k,) if isinstance(k, str) else tuple(k)), None, None)[:3]
        desc = (way or "ASC").upper() == "DESC"
        nulls = nulls or ("FIRST" if desc else "LAST")
        c = F.col(name)
        out.append((c.desc_nulls_first() if nulls == "FIRST" else c.desc_nulls_last()) if desc else (c.asc_nulls_first() if nulls == "FIRST" else c.asc_nulls_last()))
    return out


class Rel:
    def __init__(self, spark: SparkSession, tables: Callable[[str], DataFrame]):
        self.spark, self.tables = spark, tables
        self.stack: list[DataFrame] = []

    def _on(self, f) -> Rel:
        self.stack.append(f(self.stack.pop()))
        return self

    def push(self, df: DataFrame) -> Rel:
        self.stack.append(df)
        return self

    def build(self) -> DataFrame:
        return self.stack.pop()

    # Leaves.

    def scan(self, name: str) -> Rel:
        return self.push(self.tables(name))

    def values(self, names: list[str], *rows: tuple) -> Rel:
        return self.push(self.spark.createDataFrame(list(rows), names))

    def empty(self) -> Rel:
        """No rows of the columns on the stack."""
        return self._on(lambda d: d.limit(0))

    # One input.

    def filter(self, *conditions) -> Rel:
        def f(d):
            for c in conditions:
                d = d.filter(c)
            return d

        return self._on(f)

    def project(self, *columns) -> Rel:
        return self._on(lambda d: d.select(*columns))

    def project_plus(self, **columns: Column) -> Rel:
        return self._on(lambda d: d.withColumns(columns))

    def rename(self, *names: str) -> Rel:
        return self._on(lambda d: d.toDF(*names))

    def permute(self, *places: int) -> Rel:
        return self._on(lambda d: d.select(*[d.columns[i] for i in places]))

    reorder = permute

    def convert(self, **kinds: str) -> Rel:
        return self._on(lambda d: d.withColumns({c: F.col(c).cast(k) for c, k in kinds.items()}))

    def alias(self, name: str) -> Rel:
        return self._on(lambda d: d.alias(name))

    def distinct(self) -> Rel:
        return self._on(lambda d: d.distinct())

    def aggregate(self, keys: list[str], sets: list[list[str]] | None = None, **calls: Column) -> Rel:
        """Group by keys, or by grouping sets of them."""

        def f(d):
            grouped = d.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(k) for k in keys]) if sets is not None else d.groupBy(*keys)
            if not calls:
                return d.select(*keys).distinct()
            return grouped.agg(*[c.alias(n) for n, c in calls.items()])

        return self._on(f)

    def window(self, partition: list[str], order: list = (), rows: tuple | None = None, range_: tuple | None = None, **calls: Column) -> Rel:
        w = Window.partitionBy(*partition)
        if order:
            w = w.orderBy(*ordered(order))
        w = w.rowsBetween(*rows) if rows else w.rangeBetween(*range_) if range_ else w
        return self._on(lambda d: d.withColumns({n: c.over(w) for n, c in calls.items()}))

    def sort(self, *keys) -> Rel:
        return self._on(lambda d: d.orderBy(*ordered(list(keys))))

    def limit(self, offset: int = 0, fetch: int = -1) -> Rel:
        """fetch -1: all."""

        def f(d):
            d = d.offset(offset) if offset > 0 else d
            return d.limit(fetch) if fetch >= 0 else d

        return self._on(f)

    def sort_limit(self, offset: int, fetch: int, *keys) -> Rel:
        return self.sort(*keys).limit(offset, fetch)

    def calc(self, condition, *columns) -> Rel:
        return self.filter(condition).project(*columns)

    def sample(self, fraction: float, seed: int) -> Rel:
        return self._on(lambda d: d.sample(fraction, seed))

    def exchange(self, kind: str, parts: int | None = None, *keys: str) -> Rel:
        """Deals rows anew: HASH, RANGE, SINGLETON, ROUND_ROBIN or BROADCAST."""

        def f(d):
            n = [parts] if parts else []
            return {
                "HASH": lambda: d.repartition(*n, *keys), "RANGE": lambda: d.repartitionByRange(*n, *keys), "SINGLETON": lambda: d.coalesce(1),
                "ROUND_ROBIN": lambda: d.repartition(parts or d.sparkSession.sparkContext.defaultParallelism), "BROADCAST": lambda: F.broadcast(d),
            }[kind.upper()]()

        return self._on(f)

    def sort_exchange(self, kind: str, parts: int | None, keys: list[str], order: list) -> Rel:
        return self.exchange(kind, parts, *keys)._on(lambda d: d.sortWithinPartitions(*ordered(order)))

    def collect(self, field: str) -> Rel:
        """One row with all rows as a multiset; only for inputs known to be small."""
        return self._on(lambda d: d.agg(F.collect_list(F.struct(*d.columns)).alias(field)))

    def uncollect(self, field: str, alias: str, ordinality: str | None = None, outer: bool = False) -> Rel:
        def f(d):
            rest = [c for c in d.columns if c != field]
            if ordinality:
                return d.select(*rest, (F.posexplode_outer if outer else F.posexplode)(field).alias(ordinality, alias)).withColumn(ordinality, F.col(ordinality) + 1)
            return d.select(*rest, (F.explode_outer if outer else F.explode)(field).alias(alias))

        return self._on(f)

    # Two inputs and more.

    def join(self, kind: str, on) -> Rel:
        right, left = self.stack.pop(), self.stack.pop()
        return self.push(left.join(right, on, _HOW[kind.upper()]))

    def semi_join(self, on) -> Rel:
        return self.join("SEMI", on)

    def anti_join(self, on) -> Rel:
        return self.join("ANTI", on)

    def correlate(self, kind: str, right: Callable[[DataFrame], DataFrame]) -> Rel:
        """right builds, from the left frame's outer columns, what each left row is joined with."""
        return self._on(lambda d: d.lateralJoin(right(d), how=_HOW[kind.upper()]))

    def _set(self, n: int, every: Callable, single: Callable) -> Rel:
        parts = [self.stack.pop() for _ in range(n)][::-1]
        out = parts[0]
        for p in parts[1:]:
            out = every(out, p) if single is None else single(out, p)
        return self.push(out)

    def union(self, all_: bool = False, n: int = 2) -> Rel:
        self._set(n, lambda a, b: a.union(b), None)
        return self if all_ else self.distinct()

    def intersect(self, all_: bool = False, n: int = 2) -> Rel:
        return self._set(n, None, (lambda a, b: a.intersectAll(b)) if all_ else (lambda a, b: a.intersect(b)))

    def minus(self, all_: bool = False, n: int = 2) -> Rel:
        return self._set(n, None, (lambda a, b: a.exceptAll(b)) if all_ else (lambda a, b: a.subtract(b)))

    def transform(self, model: str) -> Rel:
        """Rows as documents (JSON text in d)."""
        if model.upper() != "DOCUMENT":
            raise ValueError(f"no such model: {model}")
        return self._on(lambda d: d.select(F.to_json(F.struct(*d.columns), {"ignoreNullFields": "false"}).alias("d")))

    @property
    def schema(self) -> T.StructType:
        return self.stack[-1].schema


def conditional(check: DataFrame, when_empty: bool, then: Callable[[], DataFrame]) -> DataFrame | None:
    """Runs then if check is empty (or is not)."""
    return then() if check.isEmpty() == when_empty else None


def table_function(df: DataFrame, f, schema: str) -> DataFrame:
    """f(iterator of pandas frames) -> iterator of frames, as a relation; it must not depend on how rows are dealt."""
    return df.mapInPandas(f, schema)
