"""Points in time and intervals, per video, at a cost that follows rows instead of pairs.

A point lies in one time bucket and an interval is copied to the buckets it touches, so
a long video spreads over many tasks. An interval that touches more than MOST buckets
goes to the first level of coarser buckets, each MOST times as wide as the last, where
it doesn't; which levels occur is asked of the intervals first, and the points meet
each of those, mostly one.

Which point is covered, or by which interval first, is told by one pass over points and
intervals of a bucket in order of time: no interval meets a point, so a thousand that
lie over one minute cost a thousand rows. What happens during an interval is summed
from nodes of a pyramid: of a day's frames it reads some tens of rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BUCKET_MS = 10_000
MOST = 64  # buckets that an interval is copied to, about
CELL_MS = 8_192  # the pyramid's narrowest nodes


def _level(width: int) -> Column:
    length = F.col("end_ms") - F.col("start_ms")
    most = next(k for k in range(64) if (MOST * width) * MOST**k >= 1 << 56)  # longer than any time
    level = F.lit(most)
    for k in reversed(range(most)):
        level = F.when(length < (MOST - 1) * width * MOST**k, k).otherwise(level)
    return level


def _levels(intervals: DataFrame, width: int) -> list[int]:
    """The levels that occur, some ten at most."""
    return sorted(r["l"] for r in intervals.filter("end_ms >= start_ms").select(_level(width).alias("l")).distinct().collect())


def _bucket(time: Column, level: Column, width: int) -> Column:
    return F.floor(time / (width * F.pow(F.lit(MOST), level)).cast("long"))


def _bucketed(intervals: DataFrame, width: int) -> DataFrame:
    """Intervals once per bucket of their level; those that end before they start hold no point."""
    rows = intervals.filter("end_ms >= start_ms").withColumn("_level", _level(width))
    first, last = (_bucket(F.col(c), F.col("_level"), width) for c in ("start_ms", "end_ms"))
    return rows.withColumn("_bucket", F.explode(F.sequence(first, last)))


def _points(points: DataFrame, levels: list[int], width: int) -> DataFrame:
    """Points once per level."""
    level = F.lit(levels[0]) if len(levels) == 1 else F.explode(F.array(*map(F.lit, levels or [0])))
    return points.withColumn("_level", level).withColumn("_bucket", _bucket(F.col("ts_ms"), F.col("_level"), width))


_KEYS = ["video_id", "_level", "_bucket"]


def _before() -> Window:
    """Rows of a bucket up to this one; at one time, intervals (_kind 0) come before points (1)."""
    return Window.partitionBy(*_KEYS).orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)


def outside(points: DataFrame, intervals: DataFrame, width: int = BUCKET_MS) -> DataFrame:
    """The points that lie in no interval, ends included.

    A point is inside if, of the intervals of its bucket that begin up to it, the one
    that ends last reaches it.
    """
    levels = _levels(intervals, width)
    row = F.struct(*points.columns)
    spans = _bucketed(intervals.select("video_id", "start_ms", "end_ms"), width)
    ends = spans.groupBy(*_KEYS, F.col("start_ms").alias("_at")).agg(F.max("end_ms").alias("_end"))
    ends = ends.withColumn("_kind", F.lit(0)).withColumn("_row", F.lit(None).cast(points.select(row.alias("r")).schema["r"].dataType))
    marks = _points(points.withColumn("_row", row), levels, width).select(
        *_KEYS, F.col("ts_ms").alias("_at"), F.lit(None).cast("long").alias("_end"), F.lit(1).alias("_kind"), "_row"
    )
    inside = F.coalesce(F.max("_end").over(_before()) >= F.col("_at"), F.lit(False))
    seen = ends.unionByName(marks).withColumn("_inside", inside).filter("_kind = 1")
    if len(levels) > 1:  # a point is outside if it is so on all levels
        by = seen.groupBy("_row").agg(F.bool_or("_inside").alias("_any"), (F.count("*") / len(levels)).cast("int").alias("_n"))
        return by.filter("not _any").withColumn("_n", F.explode(F.sequence(F.lit(1), F.col("_n")))).select("_row.*")
    return seen.filter("not _inside").select("_row.*")


_STRETCH = "video_id long, _level int, _bucket long, _at long, seg_pos long, text string"


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Intervals by bucket and start -> disjoint stretches that begin at _at, each with its first interval in list order or with none."""
    key, heap, out, n = None, [], [], 0
    owner: tuple | None = None

    def emit(time: int) -> None:
        """A new stretch, if the owner has changed at this time."""
        nonlocal owner
        top = (heap[0][0], heap[0][3]) if heap else None
        if top != owner:
            if out and out[-1][:4] == (*key, time):
                out.pop()
            out.append((*key, time, *(top or (None, None))))
            owner = top

    def close(until: int | None) -> None:
        """What ends up to a time goes; each time an owner ends, the next one takes over."""
        while heap and (until is None or heap[0][1] <= until):
            end = heap[0][1]
            while heap and heap[0][1] <= end:
                heapq.heappop(heap)
            emit(end)

    for batch in batches:
        for video, level, bucket, start, end, pos, text in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
            if (video, level, bucket) != key:
                if key is not None:
                    close(None)
                key, heap, owner = (video, level, bucket), [], None
            close(start)
            n += 1  # equal ones come in the order of their arrival
            heapq.heappush(heap, (pos, end, n, text))
            emit(start)
        if len(out) > 2000:
            yield _stretches(out[:-1])
            out = out[-1:]
    if key is not None:
        close(None)
    yield _stretches(out)


def _stretches(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], [f.split()[0] for f in _STRETCH.split(", ")])


def cover(intervals: DataFrame, width: int = BUCKET_MS) -> DataFrame:
    """Disjoint stretches of each video's buckets: each begins at _at and belongs to the interval first in list order there, or to none.

    Intervals are half-open. One pass in order of start holds the intervals that are open, no more.
    """
    rows = _bucketed(intervals.select("video_id", "seg_pos", "start_ms", "end_ms", "text"), width).filter("end_ms > start_ms")
    as_long = lambda c: F.col(c).cast("long").alias(c)
    rows = rows.select(as_long("video_id"), "_level", "_bucket", "start_ms", "end_ms", as_long("seg_pos"), "text")
    ordered = rows.repartition(*_KEYS).sortWithinPartitions(*_KEYS, "start_ms")
    return ordered.mapInArrow(_sweep, _STRETCH)


def first_match(points: DataFrame, intervals: DataFrame, width: int = BUCKET_MS) -> DataFrame:
    """video_id, frame_pos, audio_context: text of the first segment in list order with start <= ts < end; null if there is none.

    Points take the stretch of the cover that begins last before them. Only keys and
    the text go through the shuffle; join wide columns back.
    """
    levels = _levels(intervals, width)
    none = F.lit(None)
    stretches = cover(intervals, width).select(
        *_KEYS, "_at", F.lit(0).alias("_kind"), none.cast("long").alias("frame_pos"), F.struct("seg_pos", "text").alias("_owner")
    )
    marks = _points(points.select("video_id", "frame_pos", "ts_ms"), levels, width)
    marks = marks.select(
        *_KEYS, F.col("ts_ms").alias("_at"), F.lit(1).alias("_kind"), "frame_pos", none.cast("struct<seg_pos:long,text:string>").alias("_owner")
    )
    owner = F.last("_owner", ignorenulls=True).over(_before())
    seen = stretches.unionByName(marks).withColumn("_owner", owner).filter("_kind = 1")
    if len(levels) <= 1:
        return seen.select("video_id", "frame_pos", F.col("_owner.text").alias("audio_context"))
    return seen.groupBy("video_id", "frame_pos").agg(F.min_by("_owner.text", "_owner.seg_pos").alias("audio_context"))


def _node_levels(segments: DataFrame) -> int:
    """Levels that nodes of the longest segment can have."""
    longest = segments.select(F.max(F.col("end_ms") - F.col("start_ms"))).first()[0] or 0
    return max(1, (max(longest, 0) // CELL_MS).bit_length())


def _nodes(segments: DataFrame, levels: int) -> DataFrame:
    """Each segment with the nodes that fill it: at most two a level."""
    low = F.floor((F.col("start_ms") + (CELL_MS - 1)) / CELL_MS)  # the first cell that lies inside
    high = F.floor((F.col("end_ms") + 1) / CELL_MS)  # behind the last one
    at = lambda j: (-F.floor(-low / F.pow(F.lit(2), j)).cast("long"), F.floor(high / F.pow(F.lit(2), j)).cast("long"))

    def two(j: Column) -> Column:
        a, b = at(j)
        left, right = (a < b) & (F.pmod(a, F.lit(2)) == 1), (a < b) & (F.pmod(b, F.lit(2)) == 1)
        # one node may be the left and the right one
        right = right & ~(left & (a == b - 1))
        return F.array(F.when(left, F.struct(j.alias("l"), a.alias("n"))), F.when(right, F.struct(j.alias("l"), (b - 1).alias("n"))))

    nodes = F.filter(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(levels - 1)), two)), lambda x: x.isNotNull())
    return segments.filter("end_ms >= start_ms").select("video_id", "seg_pos", F.explode(nodes).alias("_x")).select(
        "video_id", "seg_pos", F.col("_x.l").alias("_l"), F.col("_x.n").alias("_n")
    )


def pyramid(frames: DataFrame, levels: int) -> DataFrame:
    """Counts, label sets and hand flags per node (video, _l, _n) of 2^_l cells. Cells are summed first, nodes from cells."""
    cell = F.floor(F.col("ts_ms") / CELL_MS)
    what = [F.array_distinct(F.flatten(F.collect_set("labels"))).alias("labels"), F.bool_or("hand_active").alias("hand_active")]
    cells = frames.groupBy("video_id", cell.alias("_c")).agg(F.count(F.lit(1)).alias("n_frames"), *what)
    each = cells.withColumn("_l", F.explode(F.sequence(F.lit(0), F.lit(levels - 1))))
    each = each.withColumn("_n", F.floor(F.col("_c") / F.pow(F.lit(2), F.col("_l"))))
    return each.groupBy("video_id", "_l", "_n").agg(F.sum("n_frames").alias("n_frames"), *what)


def _ends(segments: DataFrame) -> DataFrame:
    """What nodes leave of each segment: (from, to) inside its first and its last cell."""
    low, high = F.floor((F.col("start_ms") + (CELL_MS - 1)) / CELL_MS), F.floor((F.col("end_ms") + 1) / CELL_MS)
    left = F.struct(F.col("start_ms").alias("a"), F.least(F.col("end_ms"), low * CELL_MS - 1).alias("b"))
    right = F.struct(F.greatest(F.col("start_ms"), high * CELL_MS).alias("a"), F.col("end_ms").alias("b"))
    inside = F.filter(F.array(left, F.when(high >= low, right)), lambda x: x.isNotNull() & (x["a"] <= x["b"]))
    rows = segments.filter("end_ms >= start_ms").select("video_id", "seg_pos", F.explode(inside).alias("_x"))
    return rows.select("video_id", "seg_pos", F.col("_x.a").alias("_a"), F.col("_x.b").alias("_b"), F.floor(F.col("_x.a") / CELL_MS).alias("_c"))


def overlap(segments: DataFrame, frames: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Per segment: video_id, seg_pos, n_frames, labels (distinct, sorted), hand_active, from the frames with start <= ts <= end, and columns to keep.

    frames: video_id, ts_ms, labels, hand_active. Segments without frames are kept. A
    segment reads the nodes that fill it and the frames of the cells at its ends.
    """
    slim = segments.select("video_id", "seg_pos", "start_ms", "end_ms")
    seen = frames.select("video_id", "ts_ms", F.array_distinct("labels").alias("labels"), "hand_active")
    levels = _node_levels(slim)
    stats = ["n_frames", "labels", "hand_active"]
    whole = _nodes(slim, levels).join(pyramid(seen, levels), ["video_id", "_l", "_n"]).select("video_id", "seg_pos", *stats)
    ends = _ends(slim).join(seen.withColumn("_c", F.floor(F.col("ts_ms") / CELL_MS)), ["video_id", "_c"])
    ends = ends.filter(F.col("ts_ms").between(F.col("_a"), F.col("_b"))).select("video_id", "seg_pos", F.lit(1).cast("long").alias("n_frames"), "labels", "hand_active")
    by = whole.unionByName(ends).groupBy("video_id", "seg_pos").agg(
        F.sum("n_frames").alias("n_frames"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("labels")))).alias("labels"),
        F.bool_or("hand_active").alias("hand_active"),
    )
    return segments.select("video_id", "seg_pos", *keep).join(by, ["video_id", "seg_pos"], "left").select(
        "video_id",
        "seg_pos",
        *keep,
        F.coalesce("n_frames", F.lit(0)).cast("long").alias("n_frames"),
        F.coalesce("labels", F.array().cast("array<string>")).alias("labels"),
        F.coalesce("hand_active", F.lit(False)).alias("hand_active"),
    )
