import numpy as np
from pyspark.sql import functions as F

from weft.llm.bloom import Bloom


def test_holds_all_keys_and_few_others(spark):
    keys = spark.range(3000).select(F.xxhash64("id").alias("k"))
    b = Bloom.of(keys, "k")
    mine = np.array([r.k for r in keys.collect()], np.int64)
    other = np.array([r.k for r in spark.range(10_000, 20_000).select(F.xxhash64("id").alias("k")).collect()], np.int64)
    assert b.may_hold(mine).all() and b.may_hold(other).mean() < 0.1


def test_no_keys(spark):
    b = Bloom.of(spark.range(0).select(F.col("id").alias("k")), "k")
    assert not b.may_hold(np.arange(-50, 50)).any()
