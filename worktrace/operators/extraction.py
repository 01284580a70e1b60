"""Post-processing of model outputs, and the integrated timeline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from worktrace.functions import hands, text
from worktrace.operators import intervals

MIN_CONFIDENCE = 0.4
SAMPLE_SECONDS = 0.5
DEFAULT_FPS = 30.0


def clean_segments(segments: DataFrame, ascii_classes: bool = False) -> DataFrame:
    """Transcript rows with stripped text and times of 3 digits; blank ones go. ascii_classes: see text.strip."""
    out = segments.withColumn("text", text.strip(F.col("text"), ascii_classes))
    for c in ("start_sec", "end_sec"):
        if c in segments.columns:
            out = out.withColumn(c, F.round(c, 3))
    return out.filter(F.length("text") > 0)


def confident(detections: DataFrame, threshold: float = MIN_CONFIDENCE) -> DataFrame:
    """Detections of enough confidence, which is rounded to 4 digits; box corners become whole numbers."""
    out = detections.filter(F.col("confidence") >= threshold).withColumn("confidence", F.round("confidence", 4))
    return out.withColumns({c: F.col(c).cast("int") for c in ("x1", "y1", "x2", "y2") if c in detections.columns})


def confident_boxes(boxes: Column, threshold: float = MIN_CONFIDENCE) -> Column:
    """The same on an array of boxes."""
    kept = F.filter(boxes, lambda b: b["confidence"] >= threshold)
    return F.transform(
        kept,
        lambda b: F.struct(
            b["label"].alias("label"), F.round(b["confidence"], 4).alias("confidence"),
            *[b[c].cast("int").alias(c) for c in ("x1", "y1", "x2", "y2")]
        )
    )


def usable_fps(fps: Column) -> Column:
    """A missing or zero rate counts as 30."""
    return F.when(F.coalesce(fps, F.lit(0.0)) == 0, F.lit(DEFAULT_FPS)).otherwise(fps)


def frame_step(fps: Column) -> Column:
    """Frames from one sample to the next."""
    return F.greatest(F.lit(1), F.floor(fps * SAMPLE_SECONDS)).cast("long")


def video_stats(videos: DataFrame) -> DataFrame:
    """`videos` (fps, total_frames) with a usable fps and duration_sec, both of 3 digits."""
    fps = usable_fps(F.col("fps").cast("double"))
    return videos.withColumn("duration_sec", F.round(F.try_divide(F.col("total_frames"), fps), 3)).withColumn("fps", F.round(fps, 3))


def sampled_frames(frames: DataFrame) -> DataFrame:
    """Rows (fps, frame_idx) that the half-second sampling keeps, with timestamp_sec."""
    fps = usable_fps(F.col("fps").cast("double"))
    return frames.filter(F.col("frame_idx") % frame_step(fps) == 0).withColumn("timestamp_sec", F.round(F.col("frame_idx") / fps, 3))


def sampling_grid(videos: DataFrame) -> DataFrame:
    """One row per sampled frame of each video (fps, total_frames): frame_idx, timestamp_sec."""
    fps = usable_fps(F.col("fps").cast("double"))
    grid = videos.filter("total_frames > 0").withColumn(
        "frame_idx", F.explode(F.sequence(F.lit(0).cast("long"), F.col("total_frames").cast("long") - 1, frame_step(fps))),
    )
    return grid.withColumn("timestamp_sec", F.round(F.col("frame_idx") / fps, 3))


def hands_by_side(detected: DataFrame, *keys: str) -> DataFrame:
    """Per `keys`: left_hand and right_hand. Rows: handedness, landmarks, hand_pos.

    "Left" is the left hand, anything else the right one; the last hand of a side
    wins. Landmarks are rounded to 4 digits.
    """
    left = F.coalesce(F.col("handedness") == "Left", F.lit(False))
    points = hands.rounded(F.col("landmarks"))
    return detected.groupBy(*keys).agg(
        F.max_by(points, F.when(left, F.col("hand_pos"))).alias("left_hand"), F.max_by(points, F.when(~left, F.col("hand_pos"))).alias("right_hand")
    )


def hand_vector(left: Column, right: Column) -> Column:
    """Both hands in one struct; null for a missing hand."""
    return F.struct(left.alias("left_hand"), right.alias("right_hand"))


def boxes_as_lists(boxes: Column) -> Column:
    """Boxes with their corners as one list."""
    return F.transform(
        boxes,
        lambda b: F.struct(b["label"].alias("label"), b["confidence"].alias("confidence"), F.array(b["x1"], b["y1"], b["x2"], b["y2"]).alias("bbox")),
    )


def timeline(frames: DataFrame, segments: DataFrame) -> DataFrame:
    """`frames` (video_id, frame_pos, ts_ms, ...) with audio_context; wide columns are joined back after the interval join."""
    return frames.join(intervals.first_match(frames, segments), ["video_id", "frame_pos"], "left")
