"""Catalogue statements: namespaces, tables, views, constraints, and changes of rows as rewrites.

A table is parquet in the session's catalogue. A change reads the current version, checks the constraints, and replaces it.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.sources.scratch import held


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Key values that occur more than once; keys with a null don't count."""
    return df.na.drop(subset=keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def orphans(df: DataFrame, keys: list[str], parent: DataFrame, parent_keys: list[str]) -> DataFrame:
    """Rows whose key has no parent; keys with a null don't count."""
    p = parent.select(*[F.col(k).alias(f"_p{i}") for i, k in enumerate(parent_keys)]).distinct()
    on = [F.col(k) == F.col(f"_p{i}") for i, k in enumerate(keys)]
    return df.na.drop(subset=keys).join(p, on, "left_anti")


def failing(df: DataFrame, check: str) -> DataFrame:
    return df.filter(~F.coalesce(F.expr(check), F.lit(True)))


@dataclass
class Constraints:
    unique: list[list[str]] = field(default_factory=list)
    foreign: list[tuple[list[str], str, list[str]]] = field(default_factory=list)
    checks: list[str] = field(default_factory=list)


class Catalogue:
    """Tables with constraints in one namespace of a session."""

    def __init__(self, spark: SparkSession, namespace: str):
        self.spark, self.namespace, self.constraints = spark, namespace, {}
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {namespace}")

    def name(self, table: str) -> str:
        return f"{self.namespace}.{table}"

    def create(self, table: str, df: DataFrame, partition_by: list[str] = (), constraints: Constraints | None = None) -> None:
        c = constraints or Constraints()
        self._check(df, c)
        w = df.write.mode("error").format("parquet")
        (w.partitionBy(*partition_by) if partition_by else w).saveAsTable(self.name(table))
        self.constraints[table] = c

    def read(self, table: str) -> DataFrame:
        return self.spark.table(self.name(table))

    def view(self, name: str, sql: str) -> None:
        self.spark.sql(f"CREATE OR REPLACE VIEW {self.name(name)} AS {sql}")

    def drop(self, table: str, view: bool = False) -> None:
        self.spark.sql(f"DROP {'VIEW' if view else 'TABLE'} IF EXISTS {self.name(table)}")
        self.constraints.pop(table, None)

    def drop_namespace(self) -> None:
        self.spark.sql(f"DROP DATABASE IF EXISTS {self.namespace} CASCADE")

    def rename(self, table: str, to: str) -> None:
        self.spark.sql(f"ALTER TABLE {self.name(table)} RENAME TO {self.name(to)}")
        if table in self.constraints:
            self.constraints[to] = self.constraints.pop(table)

    def truncate(self, table: str) -> None:
        self.spark.sql(f"TRUNCATE TABLE {self.name(table)}")

    # Columns.

    def add_column(self, table: str, name: str, kind: str, default=None) -> None:
        self._replace(table, self.read(table).withColumn(name, F.lit(default).cast(kind)))

    def drop_column(self, table: str, name: str) -> None:
        self._replace(table, self.read(table).drop(name))

    def rename_column(self, table: str, name: str, to: str) -> None:
        self._replace(table, self.read(table).withColumnRenamed(name, to))

    def modify_column(self, table: str, name: str, kind: str) -> None:
        self._replace(table, self.read(table).withColumn(name, F.col(name).cast(kind)))

    def partition(self, table: str, by: list[str]) -> None:
        self._replace(table, self.read(table), by)

    # Constraints.

    def add_unique(self, table: str, keys: list[str]) -> None:
        self._add(table, lambda c: c.unique.append(keys))

    def add_foreign_key(self, table: str, keys: list[str], parent: str, parent_keys: list[str]) -> None:
        self._add(table, lambda c: c.foreign.append((keys, parent, parent_keys)))

    def add_check(self, table: str, check: str) -> None:
        self._add(table, lambda c: c.checks.append(check))

    def _add(self, table: str, change) -> None:
        old = self.constraints.get(table, Constraints())
        c = Constraints(list(old.unique), list(old.foreign), list(old.checks))
        change(c)
        self._check(self.read(table), c)
        self.constraints[table] = c

    def _check(self, df: DataFrame, c: Constraints) -> None:
        for keys in c.unique:
            if not duplicates(df, keys).isEmpty():
                raise ValueError(f"not unique: {keys}")
        for keys, parent, parent_keys in c.foreign:
            if not orphans(df, keys, self.read(parent), parent_keys).isEmpty():
                raise ValueError(f"without a row in {parent}: {keys}")
        for check in c.checks:
            if not failing(df, check).isEmpty():
                raise ValueError(f"check fails: {check}")

    # Rows.

    def insert(self, table: str, rows: DataFrame) -> int:
        new = held(rows)
        self._check(self.read(table).unionByName(new), self.constraints.get(table, Constraints()))
        new.select(self.read(table).columns).write.insertInto(self.name(table))
        return new.count()

    def update(self, table: str, condition: Column, values: dict[str, Column]) -> int:
        old = self.read(table)
        hit = F.coalesce(condition, F.lit(False))
        n = old.filter(hit).count()
        self._replace(table, old.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in values.items()}))
        return n

    def delete(self, table: str, condition: Column) -> int:
        old = self.read(table)
        hit = F.coalesce(condition, F.lit(False))
        n = old.filter(hit).count()
        self._replace(table, old.filter(~hit))
        return n

    def merge(self, table: str, source: DataFrame, keys: list[str]) -> None:
        """Rows of the source replace those with equal keys; the others are added."""
        old = self.read(table)
        self._replace(table, old.join(source.select(*keys), keys, "left_anti").select(old.columns).unionByName(source.select(old.columns)))

    def _replace(self, table: str, df: DataFrame, by: list[str] = ()) -> None:
        new = held(df)
        self._check(new, self.constraints.get(table, Constraints()))
        w = new.write.mode("overwrite").format("parquet")
        (w.partitionBy(*by) if by else w).saveAsTable(self.name(table))


class Sequence:
    """NEXT VALUE and CURRENT VALUE of a counter on the driver; values for rows of a frame come from their order."""

    def __init__(self, start: int = 1, step: int = 1):
        self.now, self.step = start - step, step

    def next(self) -> int:
        self.now += self.step
        return self.now

    def current(self) -> int:
        return self.now

    def for_rows(self, df: DataFrame, name: str, order: list) -> DataFrame:
        from weft.operators.flow import positions

        n, first = df.count(), self.now + self.step
        self.now += n * self.step
        return positions(df, order).withColumn(name, F.lit(first) + F.col("_pos") * self.step).drop("_pos")


def rest_change(catalogue: Catalogue, request: str, rows: DataFrame | None = None) -> int:
    """POST table (rows are inserted), PATCH table?filters&column=value of the rows' first, DELETE table?filters. Filters are
    as in a GET request."""
    from weft.operators.lang import rest_filters

    verb, _, rest = request.strip().partition(" ")
    name, _, query = rest.strip().lstrip("/").partition("?")
    if verb.upper() == "POST":
        return catalogue.insert(name, rows)
    condition = rest_filters(query)
    if verb.upper() == "DELETE":
        return catalogue.delete(name, condition)
    values = rows.first().asDict()
    return catalogue.update(name, condition, {k: F.lit(v) for k, v in values.items()})


def statistics(df: DataFrame) -> DataFrame:
    """One row a column: rows, nulls, distinct values, least and greatest value as text. Each column is read by itself and
    counted by value first, so no row is multiplied by the number of columns."""
    simple = [f.name for f in df.schema.fields if f.dataType.simpleString().split("(")[0] in ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal", "string", "date", "timestamp", "timestamp_ntz", "boolean")]
    if not simple:
        raise ValueError("no column of a simple type")
    none = F.lit(0).cast("long")
    each = []
    for c in simple:
        values = df.select(F.col(f"`{c}`").alias("v")).groupBy("v").agg(F.count(F.lit(1)).alias("n"))
        each.append(values.agg(
            F.coalesce(F.sum("n"), none).alias("n_rows"), F.coalesce(F.sum(F.when(F.col("v").isNull(), F.col("n"))), none).alias("n_null"),
            F.count("v").alias("n_distinct"), F.min("v").cast("string").alias("least"), F.max("v").cast("string").alias("greatest"),
        ).select(F.lit(c).alias("name"), "*"))
    return reduce(DataFrame.unionByName, each)
