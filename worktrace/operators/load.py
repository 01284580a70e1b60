"""Keys, row shapes, gates and counts of the relational load."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from worktrace.operators import ranks


def video_key(file_path: Column) -> Column:
    """The id of a video: the hash of the full path of its recording, in batches and streams alike."""
    return F.xxhash64(file_path)


def video_keys(videos: DataFrame) -> DataFrame:
    """`videos` with video_id, and an empty code as null. No global numbering."""
    return videos.withColumn("video_id", video_key(F.col("file_path"))).withColumn("ncs_code", F.nullif(F.col("ncs_code"), F.lit("")))


def numbered_keys(videos: DataFrame) -> DataFrame:
    """`videos` with dense video_ids from 1, in the order of file_path: those of a table that counts up by itself."""
    return ranks.dense_ids(videos, ["file_path"], "video_id").withColumn("ncs_code", F.nullif(F.col("ncs_code"), F.lit("")))


def attach_keys(children: DataFrame, videos: DataFrame) -> DataFrame:
    """`children` with the video_id of their file_path."""
    return children.join(videos.select("file_path", "video_id"), "file_path")


def frame_rows(frames: DataFrame) -> DataFrame:
    """video_id, frame_timestamp, and tools and hands as JSON text; a missing value is the JSON text null."""
    as_json = lambda c: F.coalesce(F.to_json(c, {"ignoreNullFields": "false"}), F.lit("null"))
    return frames.select(
        "video_id", F.col("timestamp_sec").cast("decimal(12,3)").alias("frame_timestamp"),
        as_json("detected_tools").alias("detected_tools"), as_json("hand_movement_vector").alias("hand_movement_vector"),
    )


def insight_rows(insights: DataFrame) -> DataFrame:
    """Rows of all statuses; status and evidence stay behind."""
    return insights.select(
        "video_id", F.col("step_number").cast("int").alias("step_number"), "standard_manual_text", "tacit_knowledge_description",
        F.lit(None).cast("array<float>").alias("insight_embedding"),
    )


def highlight_rows(highlights: DataFrame) -> DataFrame:
    """Rows with labels as JSON text and hand_active as 0 or 1; missing values take their defaults."""
    return highlights.select(
        "video_id", F.col("timestamp_sec").cast("decimal(12,3)").alias("timestamp_sec"), "highlight_type", "trigger_reason",
        F.coalesce("feature_description", F.lit("")).alias("feature_description"), "speech_quote",
        F.coalesce(F.to_json("detected_tools"), F.lit("[]")).alias("detected_tools"),
        F.coalesce("hand_active", F.lit(False)).cast("int").alias("hand_active"),
    )


def counts(videos: DataFrame, **tables: DataFrame) -> DataFrame:
    """video_id and, per named table, its rows of the video (0 where there are none)."""
    per = [t.groupBy("video_id").agg(F.count(F.lit(1)).alias(f"n_{name}")) for name, t in tables.items()]
    joined = reduce(lambda a, b: a.join(b, "video_id", "left"), per, videos.select("video_id"))
    return joined.select("video_id", *[F.coalesce(f"n_{name}", F.lit(0)).cast("long").alias(f"n_{name}") for name in tables])


def rejected(videos: DataFrame, timeline: DataFrame, frames: DataFrame, insights: DataFrame) -> DataFrame:
    """Videos that can't be loaded, a row per reason: no_timeline, no_frames, no_insights."""
    n = counts(videos, timeline=timeline, frames=frames, insights=insights)
    reasons = F.array(*[F.when(F.col(f"n_{t}") == 0, f"no_{t}") for t in ("timeline", "frames", "insights")])
    return n.select("video_id", F.explode(F.filter(reasons, lambda r: r.isNotNull())).alias("reason"))


def cascade(children: DataFrame, deleted: DataFrame) -> DataFrame:
    """`children` without those of deleted videos."""
    return children.join(deleted.select("video_id").distinct(), "video_id", "left_anti")


def cascaded(children: DataFrame, deleted: DataFrame) -> DataFrame:
    """The rows that cascade() removes."""
    return children.join(deleted.select("video_id").distinct(), "video_id", "left_semi")
