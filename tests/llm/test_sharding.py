import zlib

from weft.llm import sharding

SCHEMA = "doc_id long, text string"


def placed(spark, rows, shards):
    return sharding.assign(sharding.sized(spark.createDataFrame(rows, SCHEMA)), shards).collect()


def check(got, rows, shards):
    assert sorted((r.doc_id is None, r.doc_id or 0, r.size, r.text_crc32) for r in got) == sorted((d is None, d or 0, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t in rows)
    assert {r.law for r in got} == {"bytes"} and {r.grown_shard for r in got} == {None}
    sizes, slots = [0] * shards, {}
    for r in got:
        sizes[r.shard] += r.size
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    most = max(r.size for r in got)
    assert max(sizes) - min(sizes) <= 2 * most
    order = sorted(got, key=lambda r: (r.shard, r.slot))
    ids = [-1 if r.doc_id is None else r.doc_id for r in order]
    assert ids == sorted(ids)  # contiguous in the order of ids


def test_shards(spark):
    rows = [(i * 7 % 1009, "é" * (i % 97)) for i in range(1009)]
    check(placed(spark, rows, 9), rows, 9)


def test_hot_and_odd_rows(spark):
    rows = [(5, "same")] * 400 + [(None, None)] * 300 + [(i, "" if i % 2 else None) for i in range(300)] + [(10**12, "x" * 500)]
    check(placed(spark, rows, 5), rows, 5)


def test_hot_id_is_dealt_over_parts(spark):
    from pyspark.sql import functions as F

    from weft.llm.common import bounds_of, bucket_of

    df = spark.range(4000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("k"), F.xxhash64("id").alias("t"))
    bounds = bounds_of(df, "k", 16)
    counts = [r["count"] for r in df.select(bucket_of(F.col("k"), F.col("t"), bounds).alias("b")).groupBy("b").count().collect()]
    assert max(counts) < 2.5 * 4000 / 16
    assert bounds == sorted(bounds)


def test_few_rows_and_none(spark):
    assert placed(spark, [], 4) == []
    got = placed(spark, [(1, "a")], 4)
    assert len(got) == 1 and got[0].slot == 0


def test_clashing_names(spark):
    df = spark.createDataFrame([(1, 20, 3, "k")], "doc_id long, size long, shard int, key string")
    out = sharding.assign(df, 2)
    assert out.columns == ["doc_id", "size", "shard", "key", "law", "shard_", "slot", "grown_shard"]
    assert out.first()["shard"] == 3


def test_places_against_one_running_sum(spark):
    """Shard and slot of each row from one sum over all rows in order of ids, and the same under another partitioning."""
    rows = [(i * 13 % 401, "é" * (i * 7 % 61)) for i in range(401)] + [(1000, "x" * 3000)]
    df = spark.createDataFrame(rows, SCHEMA)
    order = sorted((d, len(t.encode()) + 16) for d, t in rows)
    total, before, expected, slots = sum(s for _, s in order), 0, [], {}
    for d, s in order:
        shard = min(6, (2 * before + s) * 7 // (2 * total))
        expected.append((d, shard, slots.setdefault(shard, 0)))
        slots[shard] += 1
        before += s
    got = lambda d: sorted((r.doc_id, r.shard, r.slot) for r in sharding.assign(sharding.sized(d), 7).collect())
    assert got(df) == expected
    hot = spark.createDataFrame([(5, f"t{i}" * (i % 9)) for i in range(300)], SCHEMA)
    assert [[(r.text_crc32, r.shard, r.slot) for r in sharding.assign(sharding.sized(d), 7).orderBy("shard", "slot").collect()] for d in (hot.repartition(2),)] == [[(r.text_crc32, r.shard, r.slot) for r in sharding.assign(sharding.sized(hot.repartition(5)), 7).orderBy("shard", "slot").collect()]]
