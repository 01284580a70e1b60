"""Behavioural highlights: rules over what is said, seen and done."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from worktrace.functions import text
from worktrace.functions.columns import once
from worktrace.operators import intervals

COLUMNS = ["timestamp_sec", "highlight_type", "trigger_reason", "feature_description", "speech_quote", "detected_tools", "hand_active"]


def slim_frames(frames: DataFrame) -> DataFrame:
    """video_id, frame_pos, ts_ms, labels, hand_active of wide frames: landmarks stay out of the shuffles."""
    from worktrace.functions import hands

    return frames.select(
        "video_id", "frame_pos", (F.col("timestamp_sec") * 1000).cast("long").alias("ts_ms"),
        F.coalesce(F.transform("detected_tools", lambda b: b["label"]), F.array().cast("array<string>")).alias("labels"),
        hands.active(F.col("hand_movement_vector")).alias("hand_active"),
    )


def midpoint(start: Column, end: Column) -> Column:
    """Middle of two times in milliseconds, half up."""
    return F.floor((start + end + 1) / 2).cast("long")


def classified(segments: DataFrame, frames: DataFrame, ascii_classes: bool = False) -> DataFrame:
    """Per segment with text: its measurements, keywords, domain labels and highlight_type (null: no rule holds). ascii_classes: see text.measurements and text.strip."""
    segments = segments.withColumn(
        "start_ms", F.coalesce("start_ms", F.lit(0).cast("long")),
    ).withColumn("end_ms", F.coalesce("end_ms", F.lit(0).cast("long")))
    spoken = segments.withColumn("text", text.strip(F.coalesce("text", F.lit("")), ascii_classes)).filter(F.length("text") > 0)
    seen = intervals.overlap(spoken, frames.withColumn("ts_ms", F.coalesce("ts_ms", F.lit(-1000).cast("long"))), keep=("text", "start_ms", "end_ms"))
    rows = once(once(seen, "measurements", text.measurements(F.col("text"), ascii_classes)), "keywords", text.keywords(F.col("text")))
    rows = rows.select(
        "video_id", "seg_pos", "text", midpoint(F.col("start_ms"), F.col("end_ms")).alias("ts_ms"), "hand_active",
        text.domain_labels(F.col("labels")).alias("detected_tools"), "measurements", "keywords",
    )
    kind = (
        F.when(F.size("measurements") > 0, "measurement_speech").when(F.size("keywords") > 0, "procedural_speech").when(
            F.size("detected_tools") > 0, "tool_active_speech",
        )
    )
    return rows.withColumn("highlight_type", kind)


def _shaped(rows: DataFrame, hits: Column, section: int, pos: str, quote: Column) -> DataFrame:
    kind = F.col("highlight_type")
    return rows.select(
        "video_id", F.lit(section).alias("section"), F.col(pos).cast("long").alias("pos"), "ts_ms",
        (F.col("ts_ms") / 1000).cast("decimal(12,3)").alias("timestamp_sec"), kind,
        text.trigger(kind, hits).alias("trigger_reason"),
        text.describe(kind, F.col("ts_ms"), hits, F.col("hand_active")).alias("feature_description"),
        quote.alias("speech_quote"), "detected_tools", "hand_active",
    )


def speech_highlights(segments: DataFrame, frames: DataFrame, ascii_classes: bool = False) -> DataFrame:
    """One highlight per segment for which a rule holds: measurement before keyword before tool."""
    rows = classified(segments, frames, ascii_classes).filter("highlight_type is not null")
    hits = F.when(
        F.col("highlight_type") == "measurement_speech", F.col("measurements"),
    ).when(F.col("highlight_type") == "procedural_speech", F.col("keywords"))
    return _shaped(rows, F.coalesce(hits, F.col("detected_tools")), 0, "seg_pos", F.col("text"))


def silent_hands(segments: DataFrame, frames: DataFrame) -> DataFrame:
    """Frames with an active hand outside all segments, blank ones included."""
    active = frames.filter("hand_active").withColumn("ts_ms", F.coalesce("ts_ms", F.lit(0).cast("long")))
    spans = segments.select(
        "video_id", F.coalesce("start_ms", F.lit(0).cast("long")).alias("start_ms"),
        F.coalesce("end_ms", F.lit(0).cast("long")).alias("end_ms"),
    )
    return intervals.outside(active, spans)


def silent_highlights(segments: DataFrame, frames: DataFrame) -> DataFrame:
    """One highlight per silent frame with an active hand; labels keep frame order and repeats."""
    rows = silent_hands(segments, frames).withColumn("highlight_type", F.lit("active_hands")).withColumn(
        "detected_tools", text.domain_labels(F.col("labels")),
    )
    return _shaped(rows, F.array().cast("array<string>"), 1, "frame_pos", F.lit(None).cast("string"))


def highlights(segments: DataFrame, frames: DataFrame, ascii_classes: bool = False) -> DataFrame:
    """All highlights; (video_id, section, pos) gives their order: speech as in the transcript, then silent hands by frame."""
    return speech_highlights(segments, frames, ascii_classes).unionByName(silent_highlights(segments, frames))
