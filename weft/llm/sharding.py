"""Contiguous shards of about equal bytes, in DataFrame functions only.

Rows are ordered by id (nulls first) and dealt into ranges of ids; each range sums its own sizes, the totals of the ranges
(PARTS at most) are summed in order, and every row's place in the global prefix sum follows. The sum is cut at equal
targets: a row belongs to the shard that holds its middle byte, so shards differ from the target by less than a row at
each end, and their slots run from 0 without a gap.

Rows that share an id stand in the order of a hash of their columns; a hot id is dealt over several ranges. Null texts have no bytes. An
empty table gives no rows; a shard stays empty only where one row is longer than a shard.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounds_of, bucket_of, checkpoint, free_name, parallelism

OVERHEAD = 16
PARTS = 4096
ROWS_IN_PART = 100_000


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, size and text_crc32 of docs(doc_id, text)."""
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + OVERHEAD
    return docs.select("doc_id", size.alias("size"), F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long").alias("text_crc32"))


def assign(rows: DataFrame, shards: int) -> DataFrame:
    """The columns of rows(doc_id, size, ...) with law, shard, slot and grown_shard (null: more shards move the cuts); names
    that rows has get _ after them."""
    spark = rows.sparkSession
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)).cast("long"))
    held = checkpoint(rows.select(F.struct(*rows.columns).alias("row"), F.col("size"), key.alias("key"), F.xxhash64(*[c for c, kind in rows.dtypes if "map<" not in kind]).alias("tie")))
    n = held.count()
    parts = min(PARTS, max(8 * parallelism(spark), n // ROWS_IN_PART))
    held = held.withColumn("part", bucket_of(F.col("key"), F.col("tie"), bounds_of(held, "key", parts, n)))
    order = Window.partitionBy("part").orderBy("key", "tie")
    placed = held.withColumn("place", F.row_number().over(order)).withColumn("sum", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    totals = held.groupBy("part").agg(F.sum("size").alias("s"), F.count(F.lit(1)).alias("n"))
    before, everything = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    offsets = totals.select(
        F.col("part").alias("p"),
        F.coalesce(F.sum("s").over(before), F.lit(0)).alias("s0"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"),
        F.sum("s").over(everything).alias("total"),
    )
    summed = placed.join(F.broadcast(offsets), F.col("part") == F.col("p"))
    middle = (2 * (F.col("s0") + F.col("sum")) - F.col("size")).cast("decimal(38,0)")
    cut = summed.withColumn("shard", F.least(F.lit(shards - 1), F.floor(middle * shards / (2 * F.col("total"))).cast("int"))).withColumn("at", F.col("n0") + F.col("place") - 1)
    first = cut.groupBy(F.col("shard").alias("first_shard")).agg(F.min("at").alias("first"))
    law, shard, slot, grown = (free_name(rows, c) for c in ("law", "shard", "slot", "grown_shard"))
    return cut.join(F.broadcast(first), F.col("shard") == F.col("first_shard")).select(
        *[F.col("row")[c].alias(c) for c in rows.columns], F.lit("bytes").alias(law), F.col("shard").alias(shard), (F.col("at") - F.col("first")).alias(slot), F.lit(None).cast("int").alias(grown)
    )
