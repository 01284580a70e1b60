from __future__ import annotations

import random

from pyspark.sql import functions as F

from worktrace.operators import ranks, synthesis


def test_ranks_equal_sorting(spark):
    r = random.Random(2)
    rows = [(r.choice([1, 1, 1, 1, 2, 3, None]), r.randint(0, 50), i) for i in range(800)]
    df = spark.createDataFrame(rows, "video_id long, pos long, i long").repartition(7)
    want = {}
    for v in {x[0] for x in rows}:
        own = sorted(x[1:] for x in rows if x[0] == v)
        want |= {i: (k, len(own)) for k, (_, i) in enumerate(own)}
    got = ranks.numbered(df, ["video_id"], ["pos", "i"], "k", "n").collect()
    assert {x.i: (x.k, x.n) for x in got} == want and len(got) == len(rows)
    assert ranks.numbered(df.filter("false"), ["video_id"], ["pos"]).count() == 0


def test_dense_ids_have_no_gaps_and_repeat(spark):
    df = spark.range(5000).select(F.xxhash64("id").alias("x"), "id")
    ids = ranks.dense_ids(df.repartition(9), ["x"], "n").collect()
    assert sorted(r.n for r in ids) == list(range(1, 5001))
    assert [r.x for r in sorted(ids, key=lambda r: r.n)] == sorted(r.x for r in ids)
    again = {r.x: r.n for r in ranks.dense_ids(df.repartition(3), ["x"], "n").collect()}
    assert again == {r.x: r.n for r in ids}


def test_a_long_video_fills_many_tasks(spark):
    df = spark.range(40_000).select(F.lit(1).cast("long").alias("video_id"), F.col("id").alias("frame_pos"), F.lit("x").alias("audio_context"))
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ranked = ranks.numbered(df, ["video_id"], ["frame_pos"])
        shares = [r["n"] for r in ranked.withColumn("f", F.floor(F.col("rank") / 10_000)).groupBy("f").agg(F.count("*").alias("n")).collect()]
        assert shares == [10_000] * 4
        plan = ranked._jdf.queryExecution().executedPlan().toString()
        assert "Window" not in plan
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
    assert [r.frame_pos for r in synthesis.sampled(df).orderBy("sample_pos").collect()] == [k * (40_000 // 30) for k in range(30)]
