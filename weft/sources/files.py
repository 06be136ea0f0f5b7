"""Sources and sinks besides the parquet tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Type names of typed CSV headers.
CSV_TYPES = {"int": "int", "long": "bigint", "short": "smallint", "byte": "tinyint", "float": "float", "double": "double", "boolean": "boolean", "string": "string", "date": "date", "time": "string", "timestamp": "timestamp_ntz"}


def read_csv(spark: SparkSession, path: str, typed_header: bool = False, infer: bool = False, delimiter: str = ",", **options) -> DataFrame:
    """With a typed header the first line has name:type for each column; only that line is read for the schema."""
    if not typed_header:
        return spark.read.options(header=True, inferSchema=infer, sep=delimiter, **options).csv(path)
    head = spark.read.text(path).first()[0].split(delimiter)
    fields = [(h.split(":")[0].strip(), CSV_TYPES[h.split(":")[1].strip()] if ":" in h else "string") for h in head]
    schema = ", ".join(f"`{n}` {t}" for n, t in fields)
    return spark.read.options(header=True, enforceSchema=True, sep=delimiter, **options).schema(schema).csv(path)


def read_json(spark: SparkSession, path: str, lines: bool = True, schema: str | None = None) -> DataFrame:
    """Objects a line, or one object or array a file."""
    r = spark.read.option("multiLine", not lines)
    return (r.schema(schema) if schema else r).json(path)


def read_xml(spark: SparkSession, path: str, row_tag: str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", row_tag).load(path)


def read_text(spark: SparkSession, path: str, mode: str = "LINES", separator: str | None = None) -> DataFrame:
    """A row a line, a file (WHOLE), or a part between separators."""
    if mode == "WHOLE":
        return spark.read.text(path, wholetext=True)
    return spark.read.text(path, lineSep=separator) if separator else spark.read.text(path)


def read_binary(spark: SparkSession, path: str, chunk: int | None = None) -> DataFrame:
    """path, chunk number and content; files in chunks of a size, or whole."""
    f = spark.read.format("binaryFile").load(path)
    if chunk is None:
        return f.select("path", F.lit(0).alias("chunk"), "content")
    n = F.greatest(F.ceil(F.col("length") / chunk), F.lit(1)).cast("int")
    return f.select("path", F.explode(F.sequence(F.lit(0), n - 1)).alias("chunk"), "content").select("path", "chunk", F.expr(f"substring(content, chunk * {chunk} + 1, {chunk})").alias("content"))


def read_excel(spark: SparkSession, path: str, sheet: str | int = 0) -> DataFrame:
    """A sheet, on the driver; needs a reader for such files."""
    import pandas as pd

    return spark.createDataFrame(pd.read_excel(path, sheet_name=sheet))


def read_jdbc(spark: SparkSession, url: str, source: str, column: str | None = None, bounds: tuple[int, int] = (0, 0), parts: int = 1, **options) -> DataFrame:
    """A table or query of a database; filters, columns, aggregates and limits are pushed down; parts are read in parallel."""
    r = spark.read.format("jdbc").options(url=url, dbtable=source, pushDownAggregate="true", pushDownLimit="true", pushDownOffset="true", **options)
    if column:
        r = r.options(partitionColumn=column, lowerBound=bounds[0], upperBound=bounds[1], numPartitions=parts)
    return r.load()


def inline_csv(spark: SparkSession, text: str, schema: str) -> DataFrame:
    rows = [(line,) for line in text.strip().splitlines()[1:]]
    return spark.createDataFrame(rows, "line string").select(F.from_csv("line", schema).alias("r")).select("r.*")


def inline_json(spark: SparkSession, documents: list[str], schema: str) -> DataFrame:
    return spark.createDataFrame([(d,) for d in documents], "d string").select(F.from_json("d", schema).alias("d")).select("d.*")


def random_rows(spark: SparkSession, n: int, seed: int = 0, groups: int = 10) -> DataFrame:
    return spark.range(n).select("id", F.floor(F.rand(seed) * groups).cast("int").alias("grp"), F.rand(seed + 1).alias("value"))


def random_graph(spark: SparkSession, n: int, m: int, seed: int = 0):
    from weft.operators.graph import Graph

    empty = F.create_map().cast("map<string,string>")
    node = lambda s: F.floor(F.rand(s) * n).cast("bigint").cast("string")
    nodes = spark.range(n).select(F.col("id").cast("string").alias("id"), F.array(F.lit("Node")).alias("labels"), empty.alias("properties"))
    edges = spark.range(m).select(F.concat(F.lit("e"), F.col("id").cast("string")).alias("id"), node(seed).alias("source"), node(seed + 1).alias("target"), F.array(F.lit("LINK")).alias("labels"), empty.alias("properties"))
    return Graph(nodes, edges)


def empty_table(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


def write_csv(df: DataFrame, path: str, mode: str = "error") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def write_json(df: DataFrame, path: str, mode: str = "error") -> None:
    df.write.mode(mode).json(path)


def write_table(df: DataFrame, name: str, mode: str = "error", partition_by: list[str] = ()) -> None:
    w = df.write.mode(mode).format("parquet")
    (w.partitionBy(*partition_by) if partition_by else w).saveAsTable(name)


def write_graph(graph, path: str, mode: str = "error") -> None:
    graph.nodes.write.mode(mode).parquet(f"{path}/nodes")
    graph.edges.write.mode(mode).parquet(f"{path}/edges")


def read_graph(spark: SparkSession, path: str):
    from weft.operators.graph import Graph

    return Graph(spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges"))


def safe_names(df: DataFrame) -> DataFrame:
    """Columns whose names are letters, digits and underscores."""
    return df.toDF(*[re.sub(r"\W", "_", c) or f"c{i}" for i, c in enumerate(df.columns)])
