"""Features documents as they arrive: each file is a complete session, handled by the batch functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from worktrace import schemas
from worktrace.operators import highlights, load
from worktrace.sources import documents


def highlights_on_arrival(spark: SparkSession, features_path: str, out_path: str, checkpoint: str) -> StreamingQuery:
    """Start a query that takes all new documents, writes their highlights under batch_id=N, and ends.

    A batch that runs again after a failure replaces its own folder, so each
    document is counted once.
    """

    def one_batch(batch: DataFrame, batch_id: int) -> None:
        features = batch.withColumn("video_id", load.video_key(F.coalesce("file_path", "source_path")))
        segments = documents.segments(features, "video_id")
        frames = highlights.slim_frames(documents.frames(features, "video_id"))
        found = highlights.highlights(segments, frames)
        found.write.mode("overwrite").parquet(f"{out_path}/batch_id={batch_id}")

    stream = spark.readStream.schema(schemas.FEATURES).option("multiLine", True).json(features_path).withColumn(
        "source_path", F.col("_metadata.file_path"),
    )
    return stream.writeStream.foreachBatch(one_batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
