"""Results that several uses must see alike."""

from __future__ import annotations

from pyspark.sql import DataFrame


def held(df: DataFrame) -> DataFrame:
    """A checkpoint in the folder the cluster names; where none is set, in the warehouse, which executors share."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(sc.getConf().get("spark.checkpoint.dir") or df.sparkSession.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints")
    return df.checkpoint()
