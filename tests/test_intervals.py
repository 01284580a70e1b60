import random

import pytest

from worktrace.operators import intervals

SEG = "video_id long, seg_pos long, start_ms long, end_ms long, text string"
FRAME = "video_id long, frame_pos long, ts_ms long, labels array<string>, hand_active boolean"


def data(spark, seed):
    r = random.Random(seed)
    segs = [
        (v, p, s := r.randint(0, 60_000), s + r.choice([-5, 0, 1, 500, 9_000, 45_000]), f"t{p}") for v in range(3) for p in range(r.randint(0, 9))
    ]
    segs += [(0, 50, 10_000, 20_000, "a"), (0, 51, 20_000, 30_000, "b"), (0, 52, 20_000, 20_000, "zero")]
    times = [0, 10_000, 19_999, 20_000, 30_000, *(r.randint(0, 70_000) for _ in range(30))]
    frames = [(v, k, t, r.choices(["x", "y", "y"], k=r.randint(0, 3)), r.random() < 0.3) for v in range(4) for k, t in enumerate(times)]
    return segs, frames, spark.createDataFrame(segs, SEG), spark.createDataFrame(frames, FRAME)


@pytest.mark.parametrize("width", [700, 10_000, 1_000_000])
def test_sweeps_and_pyramid_equal_nested_loops(spark, width, monkeypatch):
    monkeypatch.setattr(intervals, "CELL_MS", {700: 64, 10_000: 1_000}.get(width, 8_192))
    segs, frames, s, f = data(spark, width)
    first = {(v, k): next((x for w, _, a, b, x in segs if w == v and a <= t < b), None) for v, k, t, *_ in frames}
    order = {(w, p): i for i, (w, p, *_) in enumerate(segs)}
    assert order  # list order is seg_pos order within a video
    got = {(r.video_id, r.frame_pos): r.audio_context for r in intervals.first_match(f, s, width).collect()}
    assert got == first
    want = {}
    for w, p, a, b, _ in segs:
        inside = [x for x in frames if x[0] == w and a <= x[2] <= b]
        want[w, p] = (len(inside), sorted({y for x in inside for y in x[3]}), any(x[4] for x in inside))
    assert {(r.video_id, r.seg_pos): (r.n_frames, r.labels, r.hand_active) for r in intervals.overlap(s, f).collect()} == want
    out = sorted((v, k) for v, k, t, *_ in frames if not any(w == v and a <= t <= b for w, _, a, b, _ in segs))
    assert sorted((r.video_id, r.frame_pos) for r in intervals.outside(f, s, width=width).collect()) == out


def test_no_join_is_a_product(spark):
    _, _, s, f = data(spark, 1)
    for df in (intervals.first_match(f, s), intervals.overlap(s, f), intervals.outside(f, s)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan and "Python" not in plan
        assert "MapInArrow" not in plan or df.columns[-1] == "audio_context"


def test_very_long_segments_and_a_hot_video(spark):
    r = random.Random(5)
    segs = [
        (1, 0, 0, 10**9, "days"), (1, 1, 5_000, 10**15, "wrong unit"), (1, 2, 10_000, 12_000, "short"),
        (2, 0, 0, 3_000_000, "hour"), (3, 0, 4_000, 9_000, "s"),
    ]
    frames = [
        (v, k, r.choice([r.randint(0, 60_000), r.randint(0, 2 * 10**9)]), ["x"], k % 3 == 0) for v,
        n in ((1, 200), (2, 60), (3, 40)) for k in range(n)
    ]
    s, f = spark.createDataFrame(segs, SEG), spark.createDataFrame(frames, FRAME)
    copies = intervals._bucketed(s, intervals.BUCKET_MS).groupBy("video_id", "seg_pos").count().collect()
    assert all(c["count"] <= intervals.MOST + 1 for c in copies)
    want = {(v, k): next((x for w, _, a, b, x in segs if w == v and a <= t < b), None) for v, k, t, *_ in frames}
    assert {(x.video_id, x.frame_pos): x.audio_context for x in intervals.first_match(f, s).collect()} == want
    inside = {(w, p): sum(v == w and a <= t <= b for v, _, t, *_ in frames) for w, p, a, b, _ in segs}
    assert {(x.video_id, x.seg_pos): x.n_frames for x in intervals.overlap(s, f).collect()} == inside
    out = sorted((v, k) for v, k, t, *_ in frames if not any(w == v and a <= t <= b for w, _, a, b, _ in segs))
    assert sorted((x.video_id, x.frame_pos) for x in intervals.outside(f, s).collect()) == out


def test_a_thousand_segments_over_one_minute(spark):
    """Rows follow segments and points, not their pairs."""
    r = random.Random(9)
    segs = [(1, p, s := r.randint(0, 40_000), s + r.randint(1, 60_000), f"t{p}") for p in range(1000)]
    frames = [(1, k, r.randint(0, 100_000), ["x"], True) for k in range(500)]
    s, f = spark.createDataFrame(segs, SEG), spark.createDataFrame(frames, FRAME)
    stretches = intervals.cover(s)
    assert stretches.count() <= 2 * intervals._bucketed(s, intervals.BUCKET_MS).count()
    assert stretches.groupBy("_bucket", "_at").count().filter("count > 1").count() == 0
    want = {k: next((x for _, _, a, b, x in segs if a <= t < b), None) for _, k, t, *_ in frames}
    assert {x.frame_pos: x.audio_context for x in intervals.first_match(f, s).collect()} == want
    plan = intervals.first_match(f, s)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Join" not in intervals.outside(f, s)._jdf.queryExecution().executedPlan().toString()
    inside = {p: sum(a <= t <= b for _, _, t, *_ in frames) for _, p, a, b, _ in segs}
    assert {x.seg_pos: x.n_frames for x in intervals.overlap(s, f).collect()} == inside


def test_a_day_reads_some_tens_of_rows(spark):
    day = 24 * 3600 * 1000
    s = spark.createDataFrame([(1, 0, 12_345, 12_345 + day, "day")], SEG)
    f = spark.range(200_000).selectExpr("1L as video_id", "id as frame_pos", "id * 500 as ts_ms", "array('x') as labels", "id % 7 = 0 as hand_active")
    levels = intervals._node_levels(s)
    ends = intervals._ends(s).join(f.withColumn("_c", (f.ts_ms / intervals.CELL_MS).cast("long")), ["video_id", "_c"]).filter("ts_ms between _a and _b")
    assert intervals._nodes(s, levels).count() + ends.count() < 100
    (row,) = intervals.overlap(s, f).collect()
    assert row.n_frames == sum(12_345 <= k * 500 <= 12_345 + day for k in range(200_000)) and row.labels == ["x"] and row.hand_active
