"""Tumbling, hopping and session windows. The same builders serve batch frames and streams; streams need a watermark for
append mode.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def tumble(df: DataFrame, ts: str, size: str, keys: list[str], offset: str | None = None, watermark: str | None = None, **calls: Column) -> DataFrame:
    """window_start and window_end (TUMBLE_START, TUMBLE_END), keys and calls."""
    return _grouped(df, ts, F.window(ts, size, size, offset) if offset else F.window(ts, size), keys, watermark, calls)


def hop(df: DataFrame, ts: str, slide: str, size: str, keys: list[str], watermark: str | None = None, **calls: Column) -> DataFrame:
    return _grouped(df, ts, F.window(ts, size, slide), keys, watermark, calls)


def session(df: DataFrame, ts: str, gap: str, keys: list[str], watermark: str | None = None, **calls: Column) -> DataFrame:
    return _grouped(df, ts, F.session_window(ts, gap), keys, watermark, calls)


def _grouped(df, ts, window, keys, watermark, calls) -> DataFrame:
    df = df.withWatermark(ts, watermark) if watermark else df
    out = df.groupBy(window.alias("w"), *keys).agg(*[c.alias(n) for n, c in calls.items()])
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, *calls)


def session_ids(df: DataFrame, ts: str, gap_seconds: int, keys: list[str], name: str = "session") -> DataFrame:
    """Rows with the number of their session within the key: a new one starts after a gap."""
    w = Window.partitionBy(*keys).orderBy(ts)
    started = F.coalesce(F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.lag(ts).over(w).cast("timestamp")) > gap_seconds * 1_000_000, F.lit(True))
    return df.withColumn("_new", started.cast("int")).withColumn(name, F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def stream_of(spark: SparkSession, path: str, schema: T.StructType, files_at_once: int = 1) -> DataFrame:
    """A relation as a stream: the parquet files of a folder (SELECT STREAM)."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(path)


def run_to_end(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """A stream back to a relation: runs over all that is there now. Results in append mode go to parquet under the folder,
    other modes to a table that follows the last batch."""
    spark = stream.sparkSession
    if mode == "append":
        q = stream.writeStream.outputMode("append").format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{folder}/out")

    def follow(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out")

    q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(follow).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


class MaterializedView:
    """A query whose result is kept as parquet and made anew on refresh; each refresh is a new version, so readers of the
    last one aren't disturbed. Versions are found in the folder, so sessions follow one another's; all but the last keep of
    them are removed. A version counts once it is written whole. One session refreshes at a time."""

    def __init__(self, spark: SparkSession, build, folder: str, keep: int = 2):
        if keep < 1:
            raise ValueError("keep at least one version")
        self.spark, self.build, self.folder, self.keep = spark, build, folder, keep

    def _versions(self) -> list[tuple[int, object]]:
        """(number, path) of the whole versions, in order."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        self._fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        found = [s.getPath() for s in self._fs.listStatus(path)] if self._fs.exists(path) else []
        numbered = [(int(p.getName()[1:]), p) for p in found if re.fullmatch(r"v[0-9]+", p.getName())]
        whole = [(n, p) for n, p in numbered if self._fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
        return sorted(whole, key=lambda v: v[0])

    @property
    def version(self) -> int:
        """The last version, 0 where there is none."""
        return max((n for n, _ in self._versions()), default=0)

    def refresh(self) -> MaterializedView:
        self.build().write.mode("overwrite").parquet(f"{self.folder}/v{self.version + 1}")
        for _, path in self._versions()[: -self.keep]:
            self._fs.delete(path, True)
        return self

    def read(self) -> DataFrame:
        if not self.version:
            self.refresh()
        return self.spark.read.parquet(f"{self.folder}/v{self.version}")
