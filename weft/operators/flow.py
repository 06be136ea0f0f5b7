"""Dataflow activities on frames: each takes frames and settings and gives frames.

Where a row's place matters (first row wins, next, previous, by position) the caller names the columns that order the rows.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.functions.scalar import col

# Conditions.


def condition(field: str, op: str, value=None, case: bool = True) -> Column:
    """One condition of the filter activities."""
    c = F.col(field)
    text, v = c.cast("string"), value
    if not case and isinstance(value, str):
        c, text, v = F.lower(c), F.lower(text), value.lower()
    kind = {
        "EQUALS": lambda: c == v, "NOT_EQUALS": lambda: c != v, "GREATER_THAN": lambda: c > v, "LESS_THAN": lambda: c < v,
        "GREATER_THAN_EQUALS": lambda: c >= v, "LESS_THAN_EQUALS": lambda: c <= v,
        "REGEX": lambda: F.col(field).cast("string").rlike(("" if case else "(?i)") + f"^(?:{value})$"),
        "REGEX_NOT": lambda: ~F.col(field).cast("string").rlike(("" if case else "(?i)") + f"^(?:{value})$"),
        "NULL": lambda: F.col(field).isNull(), "NON_NULL": lambda: F.col(field).isNotNull(),
        "INCLUDED": lambda: c.isin(*value), "NOT_INCLUDED": lambda: ~c.isin(*value),
        "CONTAINS": lambda: F.array_contains(F.col(field), value) if not isinstance(value, str) else text.contains(v),
        "NOT_CONTAINS": lambda: ~(F.array_contains(F.col(field), value) if not isinstance(value, str) else text.contains(v)),
        "HAS_KEY": lambda: F.map_contains_key(F.col(field), value),
        "IS_ARRAY": lambda: F.schema_of_variant(F.try_parse_json(text)).startswith("ARRAY"),
        "IS_OBJECT": lambda: F.schema_of_variant(F.try_parse_json(text)).startswith("OBJECT"),
    }[op.upper()]
    return kind()


def conditions(items: list[tuple], any_: bool = False) -> Column:
    """All of the conditions (field, op[, value[, case]]), or any."""
    return reduce((lambda a, b: a | b) if any_ else (lambda a, b: a & b), [condition(*x) for x in items])


def filter_rows(df: DataFrame, items: list[tuple], any_: bool = False, negate: bool = False) -> tuple[DataFrame, DataFrame]:
    """Rows that match, and the rest."""
    c = F.coalesce(conditions(items, any_), F.lit(False))
    return (df.filter(~c), df.filter(c)) if negate else (df.filter(c), df.filter(~c))


def efficient_filter(df: DataFrame, items: list[tuple], any_: bool = False) -> DataFrame:
    return df.filter(conditions(items, any_))


# Columns.


def identity(df: DataFrame) -> DataFrame:
    return df


def add_column(df: DataFrame, name: str, value, kind: str) -> DataFrame:
    return df.withColumn(name, F.lit(value).cast(kind))


def cast(df: DataFrame, kinds: dict[str, str], strict: bool = True) -> DataFrame:
    """strict fails at a value that the type can't hold, else it becomes null."""
    return df.withColumns({c: F.col(c).cast(k) if strict else F.col(c).try_cast(k) for c, k in kinds.items()})


def rename(df: DataFrame, rules: dict, mode: str = "EXACT") -> DataFrame:
    """By EXACT name, REGEX (whole name, groups as in re) or INDEX."""
    names = list(df.columns)
    for i, n in enumerate(names):
        if mode == "EXACT":
            names[i] = rules.get(n, n)
        elif mode == "INDEX":
            names[i] = rules.get(i, n)
        else:
            for pattern, to in rules.items():
                if re.fullmatch(pattern, n):
                    names[i] = re.sub(pattern, to, n)
                    break
    return df.toDF(*names)


def reorder(df: DataFrame, names: list[str], rest: bool = False) -> DataFrame:
    return df.select(*names, *([c for c in df.columns if c not in names] if rest else []))


def select_fields(df: DataFrame, include: list[str] = (), exclude: list[str] = (), pattern: str | None = None) -> DataFrame:
    names = [c for c in df.columns if (not include or c in include) and c not in exclude and (pattern is None or re.fullmatch(pattern, c))]
    return df.select(*names)


def validate_columns(df: DataFrame, names: list[str]) -> DataFrame:
    if missing := [n for n in names if n not in df.columns]:
        raise ValueError(f"missing columns: {missing}")
    return df


def validate_count(df: DataFrame, least: int = 0, most: int | None = None) -> DataFrame:
    n = df.limit(most + 1).count() if most is not None else df.limit(least).count()
    if n < least or most is not None and n > most:
        raise ValueError(f"{n} rows, not {least} to {most}")
    return df


def string_clean(df: DataFrame, names: list[str], trim: str | None = "BOTH", case: str | None = None, pattern: str | None = None, to: str = "") -> DataFrame:
    def clean(c: Column) -> Column:
        c = {"BOTH": F.trim, "LEFT": F.ltrim, "RIGHT": F.rtrim, None: lambda x: x}[trim](c)
        c = {"UPPER": F.upper, "LOWER": F.lower, None: lambda x: x}[case](c)
        return c if pattern is None else F.regexp_replace(c, pattern, to)

    return df.withColumns({n: clean(F.col(n)) for n in names})


def string_split(df: DataFrame, name: str, delimiter: str, into: list[str], strict: bool = False) -> DataFrame:
    """The parts at a delimiter (a regular expression) as columns; the last takes the rest, short texts give nulls or fail."""
    parts = F.split(F.col(name), delimiter, len(into))
    if strict:
        parts = F.when(F.size(parts) == len(into), parts).otherwise(F.raise_error(F.lit("too few parts")).cast("array<string>"))
    return df.select("*", *[F.get(parts, i).alias(n) for i, n in enumerate(into)])


def string_groups(df: DataFrame, name: str, pattern: str, into: list[str], full: bool = False) -> DataFrame:
    """The groups of a pattern, found in the text or matched to the whole of it."""
    p = f"^(?:{pattern})$" if full else pattern
    hit = F.col(name).rlike(p)
    return df.select("*", *[F.when(hit, F.regexp_extract(F.col(name), p, i + 1)).alias(n) for i, n in enumerate(into)])


def split_to_array(df: DataFrame, name: str, delimiter: str, into: str) -> DataFrame:
    return df.withColumn(into, F.split(F.col(name), delimiter))


def string_template(df: DataFrame, name: str, template: str) -> DataFrame:
    """{column} in the template stands for the column's text."""
    parts = re.split(r"\{(\w+)\}", template)
    return df.withColumn(name, F.concat(*[F.lit(p) if i % 2 == 0 else F.coalesce(F.col(p).cast("string"), F.lit("")) for i, p in enumerate(parts)]))


# Rows.


def positions(df: DataFrame, order: list, start: int = 0) -> DataFrame:
    """With _pos, the row's place in the order. Sorted ranges count their rows; a sum over the counts of the ranges, one
    row each, gives every range its start, so no task gets all rows."""
    if "_pos" in df.columns:
        raise ValueError("the frame has a column _pos")
    ranged = df.orderBy(*order).withColumn("_range", F.spark_partition_id()).withColumn("_id", F.monotonically_increasing_id())
    from weft.sources.scratch import held

    ranged = held(ranged)  # the ranges must be the same in both uses
    counts = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_first"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_range", "_first", (F.coalesce(F.sum("_n").over(before), F.lit(0)) + start).alias("_start"))
    return ranged.join(F.broadcast(starts), "_range").withColumn("_pos", F.col("_start") + F.col("_id") - F.col("_first")).drop("_range", "_id", "_first", "_start")


def carried(df: DataFrame, targets: list[str], order: list, back: bool = False) -> DataFrame:
    """Nulls filled from the last row before in the order (back: the next one) that has a value. Sorted ranges fill their own
    rows; what a range's first rows need comes from the last values of the ranges before, one row each."""
    from weft.sources.scratch import held

    names = {t: f"_c{i}" for i, t in enumerate(targets)}
    ranged = held(df.orderBy(*order).withColumn("_range", F.spark_partition_id()).withColumn("_id", F.monotonically_increasing_id()))
    ends = [(F.min_by if back else F.max_by)(t, F.when(F.col(t).isNotNull(), F.col("_id"))).alias(n) for t, n in names.items()]
    span = Window.orderBy(F.desc("_range") if back else F.asc("_range")).rowsBetween(Window.unboundedPreceding, -1)
    before = ranged.groupBy("_range").agg(*ends).select("_range", *[F.last(n, True).over(span).alias(n) for n in names.values()])
    own = Window.partitionBy("_range").orderBy(F.desc("_id") if back else F.asc("_id")).rowsBetween(Window.unboundedPreceding, 0)
    out = ranged.join(F.broadcast(before), "_range")  # a row for each range
    return out.withColumns({t: F.coalesce(F.last(t, True).over(own), F.col(n)) for t, n in names.items()}).select(*df.columns)


def surrogate_key(df: DataFrame, name: str, order: list | None = None, start: int = 0) -> DataFrame:
    """Counted from start in the given order, or a random uuid."""
    if order is None:
        return df.select(F.uuid().alias(name), "*")
    return positions(df, order, start).select(F.col("_pos").alias(name), *df.columns)


def union_rows(*frames: DataFrame, all_: bool = True) -> DataFrame:
    out = reduce(lambda a, b: a.union(b), frames)
    return out if all_ else out.distinct()


def merge(*frames: DataFrame | None) -> DataFrame:
    """All active inputs one after another."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [f for f in frames if f is not None])


def sort(df: DataFrame, keys: list, skip: int = 0, limit: int = -1) -> DataFrame:
    from weft.operators.rel import ordered

    out = df.orderBy(*ordered(keys))
    out = out.offset(skip) if skip else out
    return out.limit(limit) if limit >= 0 else out


def deduplicate(df: DataFrame, keys: list[str] | None = None, order: list = ()) -> DataFrame:
    """Distinct rows, or the first row of each key in the order; the first is found by a sum, not by sorting groups."""
    if not keys:
        return df.distinct()
    rest = [c for c in df.columns if c not in keys]
    first = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*[col(o) for o in order])).alias("_row"))
    return first.select(*keys, "_row.*").select(*df.columns)


_AGGREGATES = {"COUNT": F.count, "SUM": F.sum, "AVG": F.avg, "MIN": F.min, "MAX": F.max}


def aggregate(df: DataFrame, keys: list[str], calls: dict[str, tuple[str, str]]) -> DataFrame:
    """calls: output -> (function, column)."""
    return df.groupBy(*keys).agg(*[_AGGREGATES[f.upper()](c).alias(n) for n, (f, c) in calls.items()])


def pivot(df: DataFrame, keys: list[str], by: str, value: str, how: str, values: list | None = None, order: list = ()) -> DataFrame:
    """A column for each value of by, in sorted order. SUM and COUNT fill 0, FIRST (in the order) and AVG null."""
    call = {"SUM": lambda: F.sum(value), "COUNT": lambda: F.count(value), "AVG": lambda: F.avg(value), "FIRST": lambda: F.min_by(value, F.struct(*[col(o) for o in order]))}[how.upper()]()
    grouped = df.groupBy(*keys).pivot(by, values) if values else df.groupBy(*keys).pivot(by)
    out = grouped.agg(call)
    return out.na.fill(0, [c for c in out.columns if c not in keys]) if how.upper() in ("SUM", "COUNT") else out


def unpivot(df: DataFrame, ids: list[str], values: list[str] | None = None, name: str = "name", value: str = "value") -> DataFrame:
    return df.unpivot(ids, values, name, value)


def impute(df: DataFrame, targets: list[str], how: str, value=None, lookup: str | None = None, order: list = (), keys: list[str] = ()) -> DataFrame:
    """Fills nulls: FIXED value, LOOKUP from a column, STATISTIC (value: AVG, MIN, MAX), NEXT or PREVIOUS in the order (of
    the rows of each key), or DROP rows with nulls."""
    how = how.upper()
    if how == "DROP":
        return df.na.drop(subset=targets)
    if how == "FIXED":
        return df.withColumns({t: F.coalesce(F.col(t), F.lit(value).cast(df.schema[t].dataType)) for t in targets})
    if how == "LOOKUP":
        return df.withColumns({t: F.coalesce(F.col(t), F.col(lookup).cast(df.schema[t].dataType)) for t in targets})
    if how == "STATISTIC":
        stats = df.agg(*[_AGGREGATES[value.upper()](t).alias(f"_s_{t}") for t in targets])  # one row
        return df.join(F.broadcast(stats)).withColumns({t: F.coalesce(F.col(t), F.col(f"_s_{t}").cast(df.schema[t].dataType)) for t in targets}).drop(*stats.columns)
    if how in ("PREVIOUS", "NEXT") and not keys:
        return carried(df, targets, order, how == "NEXT")
    w = Window.partitionBy(*keys).orderBy(*order)
    if how == "PREVIOUS":
        return df.withColumns({t: F.last(t, True).over(w.rowsBetween(Window.unboundedPreceding, 0)) for t in targets})
    if how == "NEXT":
        return df.withColumns({t: F.first(t, True).over(w.rowsBetween(0, Window.unboundedFollowing)) for t in targets})
    raise ValueError(f"unknown strategy: {how}")


# Two inputs.


def join(left: DataFrame, right: DataFrame, on: list[tuple[str, str]], how: str = "INNER", keep: bool = False) -> DataFrame:
    """Left columns, then right ones without the keys unless keep; names that are taken get a number."""
    taken, names = set(left.columns), {}
    for c in right.columns:
        n, i = c, 0
        while n in taken:
            n, i = f"{c}{i}", i + 1
        taken.add(n)
        names[c] = n
    renamed = right.toDF(*[names[c] for c in right.columns])
    on_ = reduce(lambda a, b: a & b, [left[a] == renamed[names[b]] for a, b in on])
    out = left.join(renamed, on_, {"INNER": "inner", "LEFT": "left", "RIGHT": "right", "FULL": "full"}[how.upper()])
    return out if keep else out.drop(*[renamed[names[b]] for _, b in on])


def lookup(left: DataFrame, right: DataFrame, keys: list[tuple[str, str]], add: list[str], how: str = "EXACT", by: tuple[str, str] | None = None, order: list = ()) -> DataFrame:
    """Columns of the right row with equal keys, the first in the order if there are several. SMALLER and LARGER take, among
    rows with equal keys, the one with the greatest value of by up to the left one, or the least from it on."""
    rk = [b for _, b in keys]
    if how.upper() == "EXACT":
        first = right.groupBy(*rk).agg(F.min_by(F.struct(*add), F.struct(*[col(o) for o in (order or add)])).alias("_found"))
        first = first.select(*[F.col(b).alias(f"_k{i}") for i, b in enumerate(rk)], "_found")
        on = reduce(lambda a, b: a & b, [left[a] == F.col(f"_k{i}") for i, (a, _) in enumerate(keys)])
        return left.join(first, on, "left").select(*left.columns, *[F.col(f"_found.{c}").alias(c) for c in add])
    # As of: both sides in one stream by key and value; a row takes the last (next) right row before (after) it.
    at_l, at_r = by
    key = [F.col(a).alias(f"_k{i}") for i, (a, _) in enumerate(keys)]
    l = left.select(*key, F.col(at_l).alias("_at"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_l"), F.lit(None).cast(right.select(F.struct(*add)).schema[0].dataType).alias("_r"))
    best = right.groupBy(*rk, at_r).agg(F.min_by(F.struct(*add), F.struct(*[col(o) for o in (order or add)])).alias("_r"))
    r = best.select(*[F.col(b).alias(f"_k{i}") for i, b in enumerate(rk)], F.col(at_r).alias("_at"), F.lit(0).alias("_side"), F.lit(None).cast(left.select(F.struct(*left.columns)).schema[0].dataType).alias("_l"), "_r")
    if not keys:
        both = l.unionByName(r).withColumn("_f", F.col("_r"))
        found = carried(both, ["_f"], ["_at" if how.upper() == "SMALLER" else F.desc("_at"), "_side"])
        return found.filter("_side = 1").select("_l.*", *[F.col(f"_f.{c}").alias(c) for c in add])
    w = Window.partitionBy(*[f"_k{i}" for i in range(len(keys))])
    if how.upper() == "SMALLER":
        found = F.last("_r", True).over(w.orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, 0))
    else:
        found = F.last("_r", True).over(w.orderBy(F.desc("_at"), "_side").rowsBetween(Window.unboundedPreceding, 0))
    return l.unionByName(r).withColumn("_f", found).filter("_side = 1").select("_l.*", *[F.col(f"_f.{c}").alias(c) for c in add])


def append_columns(left: DataFrame, right: DataFrame, order_left: list, order_right: list, mismatch: str = "NULL") -> DataFrame:
    """Right columns beside the left ones by position. mismatch: SKIP drops rows without a partner, FAIL raises, NULL keeps."""
    a = positions(left, order_left).withColumnRenamed("_pos", "_p")
    b = positions(right, order_right).withColumnRenamed("_pos", "_q")
    out = a.join(b, F.col("_p") == F.col("_q"), "inner" if mismatch.upper() == "SKIP" else "full")
    if mismatch.upper() == "FAIL":
        out = out.filter(F.when(F.col("_p").isNull() | F.col("_q").isNull(), F.raise_error(F.lit("inputs of different lengths")).cast("boolean")).otherwise(True))
    return out.drop("_p", "_q")


combine_documents = append_columns


# User code, variables and nesting.


def user_transform(df: DataFrame, f, schema: str) -> DataFrame:
    """f(pandas frame) -> pandas frame over batches of rows."""
    return df.mapInPandas(lambda batches: (f(b) for b in batches), schema)


def query(sql: str, **inputs: DataFrame) -> DataFrame:
    """SQL over inputs, named in braces."""
    spark = next(iter(inputs.values())).sparkSession
    return spark.sql(sql, **inputs)


def nested(workflow, *inputs: DataFrame) -> DataFrame:
    """Another workflow as an activity."""
    return workflow(*inputs)


def to_variables(df: DataFrame, most: int = 1) -> list[dict]:
    """The first rows as variables; the number is bounded."""
    return [r.asDict(True) for r in df.limit(most).collect()]


def column_names(df: DataFrame) -> list[str]:
    return list(df.columns)


def from_variables(spark, variables: dict) -> DataFrame:
    return spark.createDataFrame([tuple(variables.values())], list(variables))


def modify_variables(variables: dict, changes: dict) -> dict:
    return {**variables, **changes}


def template_variable(template: str, variables: dict) -> str:
    return re.sub(r"\{(\w+)\}", lambda m: str(variables.get(m[1], "")), template)


def validate_variables(variables: dict, required: list[str]) -> dict:
    if missing := [n for n in required if variables.get(n) is None]:
        raise ValueError(f"missing variables: {missing}")
    return variables


def run(steps: list[tuple], inputs: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """A workflow: (output, activity, names of inputs, settings) in order; an activity may give a tuple, named output.0 …"""
    held = dict(inputs)
    for name, activity, sources, settings in steps:
        got = activity(*[held[s] for s in sources], **settings)
        if isinstance(got, tuple):
            held.update({f"{name}.{i}": g for i, g in enumerate(got)})
        else:
            held[name] = got
    return held
