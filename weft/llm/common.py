"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.sources.catalog import table

__all__ = ["table", "checkpoint", "bounded_batches", "text_bytes", "mixed", "word_hashes", "signed", "free_name", "bounds_of", "bucket_of", "parallelism", "lookup"]


def checkpoint(df: DataFrame) -> DataFrame:
    """Cuts the lineage in the folder the cluster names; where none is set, in the warehouse, which executors share."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(sc.getConf().get("spark.checkpoint.dir") or df.sparkSession.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints")
    return df.checkpoint()


HEAVY = 4096


def lookup(rows: DataFrame, side: DataFrame, key: str, count: str, by: Column) -> DataFrame:
    """rows with the other columns of side(key, count, longs ...) that belong to their key, null where side lacks it. side
    has one row for each key and the number of rows with it. Keys with more than 1 / HEAVY of all rows, so HEAVY at most, are
    broadcast, and their rows are dealt by the column by; all others are joined by shuffling."""
    names = [c for c in side.columns if c not in (key, count)]
    held = checkpoint(side.select(F.col(key).alias("k_"), F.col(count).alias("m_"), F.struct(*names).alias("v_"), F.lit(0).alias("s_")))
    total = held.agg(F.sum("m_")).first()[0] or 0
    hot = held.filter(F.col("m_") * HEAVY > total).select(F.col("k_").alias("hot_"), F.col("v_").alias("h_"))
    salt = F.when(F.col("h_").isNull(), 0).otherwise(F.pmod(F.xxhash64(by), F.lit(1 << 20)).cast("int") + 1)
    marked = rows.join(F.broadcast(hot), F.col(key) == F.col("hot_"), "left").withColumn("salt_", salt)
    cold = held.filter(F.col("m_") * HEAVY <= total).select("k_", "v_", "s_")
    joined = marked.join(cold, (F.col(key) == F.col("k_")) & (F.col("salt_") == F.col("s_")), "left")
    return joined.select(*rows.columns, *[F.coalesce(F.col("h_")[c], F.col("v_")[c]).alias(c) for c in names])


BATCH_ROWS, BATCH_BYTES = 2000, 16 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Bounds the batches that Python workers get, since texts have no bound; a session that asks for less keeps it."""
    rows = int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "0"))
    if not 0 < rows <= BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    size = re.match(r"(\d+)b?$", spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", f"{BATCH_BYTES + 1}b"))
    if not size or int(size[1]) > BATCH_BYTES:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{BATCH_BYTES}b")


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def free_name(df: DataFrame, wanted: str) -> str:
    """A column name that the frame does not have yet."""
    have = {c.lower() for c in df.columns}
    while wanted.lower() in have:
        wanted += "_"
    return wanted


def text_bytes(column: pa.Array) -> list:
    """UTF-8 bytes of each text, None for null."""
    return column.cast(pa.binary()).to_pylist()


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


_BASE = 0x9E3779B97F4A7C15
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BYTE = np.random.Generator(np.random.PCG64(20)).integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
for _c in range(65, 91):
    _BYTE[_c] = _BYTE[_c + 32]  # A-Z count as a-z
_BLOCK = 1 << 18
_LONG = 64  # bytes; sums modulo 2**64 of much longer words could be made to agree


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_GROWN: dict = {}


def powers(up: bool, n: int) -> np.ndarray:
    """The first n powers of an odd base modulo 2**64, or of its inverse."""
    got = _GROWN.get(up)
    if got is None or len(got) < n:
        got = _GROWN[up] = _powers(_BASE if up else pow(_BASE, -1, 1 << 64), max(_BLOCK + 1, 1 << n.bit_length()))
    return got[:n]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def word_hashes(raw: bytes) -> np.ndarray:
    """64-bit hashes of the words between ASCII white space, A-Z lower-cased."""
    return words_at(raw)[2]


def words_at(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and hash of each word between ASCII white space: hashes are differences of one running polynomial sum, of
    words beyond _LONG bytes xxh64; A-Z count as a-z. Long texts go in blocks, so the sums stay small in memory."""
    if len(raw) <= _BLOCK:
        return _block_words(np.frombuffer(raw, np.uint8))
    parts, at = [], 0
    while at < len(raw):
        end = min(len(raw), at + _BLOCK)
        if end < len(raw):
            back = next((i for i in range(end, at, -1) if _SPACE[raw[i]]), at)
            if back == at:  # one word longer than a block
                start = at + (1 if _SPACE[raw[at]] else 0)
                end = next((i for i in range(end, len(raw)) if _SPACE[raw[i]]), len(raw))
                parts.append((np.array([start]), np.array([end]), np.array([xxhash.xxh64_intdigest(raw[start:end].lower())], np.uint64)))
                at = end
                continue
            end = back
        s, e, h = _block_words(np.frombuffer(raw, np.uint8, end - at, at))
        parts.append((s + at, e + at, h))
        at = end
    return tuple(np.concatenate(x) for x in zip(*parts))


def _block_words(b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    none = np.empty(0, np.int64)
    if not len(b):
        return none, none, none.astype(np.uint64)
    space = _SPACE[b]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if not space[0]:
        edge = np.r_[0, edge]
    if not space[-1]:
        edge = np.r_[edge, len(b)]
    if not len(edge):
        return none, none, none.astype(np.uint64)
    sums = np.empty(len(b) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_BYTE[b] * powers(True, len(b)), out=sums[1:])
    start, end = edge[::2], edge[1::2]
    hashes = mixed((sums[end] - sums[start]) * powers(False, len(b) + 1)[start] + (end - start).astype(np.uint64))
    for i in np.flatnonzero(end - start > _LONG).tolist():
        hashes[i] = xxhash.xxh64_intdigest(b[start[i] : end[i]].tobytes().lower())
    return start, end, hashes


def bounds_of(df: DataFrame, key: str, n: int, rows: int = 0) -> list[int]:
    """At most n - 1 ascending cut points that deal a whole-number key into about equal parts; a hot key repeats. Where the
    number of rows is given, the points come from some 1000 n of them: they only deal the work, never decide a result."""
    if n < 2:
        return []
    at = [i / n for i in range(1, n)]
    if rows > 2000 * n:
        df = df.sample(1000 * n / rows, seed=1)
    cuts = df.agg(F.percentile_approx(F.col(key), F.array(*[F.lit(x) for x in at]), F.lit(max(10_000, 20 * n))).alias("b")).first()["b"]
    return [int(x) for x in cuts or []]


def bucket_of(key: Column, tie: Column, bounds: list[int]) -> Column:
    """Bucket by ascending key, nulls in bucket 0: the number of bounds at or below the key. The rows of a key that
    fills several bounds are dealt over these buckets by the ascending tie value (a long)."""
    if not bounds:
        return F.lit(0)
    cuts = F.split(F.lit(",".join(map(str, bounds))), ",").cast("array<bigint>")
    steps = [1 << s for s in range(len(bounds).bit_length() - 1, -1, -1)]

    def found(below) -> Column:
        return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), lambda lo, s: F.when(below(F.get(cuts, lo + s - 1)), lo + s).otherwise(lo))

    last, first = found(lambda b: b <= key), found(lambda b: b < key)
    if len(set(bounds)) == len(bounds):
        return F.when(key.isNull(), 0).otherwise(last)
    share = F.shiftrightunsigned(tie.bitwiseXOR(F.lit(-(1 << 63))), 33).cast("double") / float(1 << 31)
    return F.when(key.isNull(), 0).otherwise(first + F.floor(share * (last - first + 1)).cast("int"))

