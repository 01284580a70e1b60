"""Reading and writing session documents: features, insights, highlights, manuals."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from worktrace import schemas
from worktrace.functions.text import artefact_stem
from worktrace.operators.highlights import COLUMNS


def _json(spark: SparkSession, schema, path: str, lines: bool = False) -> DataFrame:
    """Rows of JSON files: each an object or a root array of objects, or (lines) an object a line."""
    rows = spark.read.schema(schema).option("multiLine", not lines).json(path)
    return rows.withColumn("source_path", F.col("_metadata.file_path")).withColumn("stem", artefact_stem(F.col("source_path")))


def read_features(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """One row per features document, with source_path and stem: a file is one indented object, or a root array of them, or (lines) one a line."""
    return _json(spark, schemas.FEATURES, path, lines)


def _exploded(features: DataFrame, key: str, array: str, pos: str) -> DataFrame:
    return features.select(F.col(key), F.posexplode(array).alias(pos, "x")).select(key, pos, "x.*")


def segments(features: DataFrame, key: str = "source_path") -> DataFrame:
    """Transcript rows with seg_pos and times in milliseconds; missing times are 0."""
    rows = _exploded(features, key, "audio_transcript", "seg_pos")
    ms = lambda c: (F.coalesce(c, F.lit(0)) * 1000).cast("long")
    return rows.withColumn("start_ms", ms("start_sec")).withColumn("end_ms", ms("end_sec"))


def frames(features: DataFrame, key: str = "source_path") -> DataFrame:
    """Frame rows with frame_pos."""
    return _exploded(features, key, "frame_features", "frame_pos")


def timeline(features: DataFrame, key: str = "source_path") -> DataFrame:
    """Timeline rows with frame_pos."""
    return _exploded(features, key, "integrated_timeline", "frame_pos")


def read_insights(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """One row per element of the root arrays, or (lines) per line."""
    return _json(spark, schemas.INSIGHT, path, lines)


def read_highlights(spark: SparkSession, path: str | None, lines: bool = False) -> DataFrame:
    """As read_insights; None gives an empty table."""
    return spark.createDataFrame([], schemas.HIGHLIGHT) if path is None else _json(spark, schemas.HIGHLIGHT, path, lines)


def read_manual_text(spark: SparkSession, path: str) -> DataFrame:
    """source_path, manual_text: each file whole."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("source_path"), F.col("value").alias("manual_text"))


def read_manuals(spark: SparkSession, path: str | None = None, **jdbc: str) -> DataFrame:
    """The manual master: Parquet at `path`, or a JDBC table by its options (url, dbtable, ...)."""
    return spark.read.schema(schemas.NCS_MODULES).parquet(path) if path else spark.read.format("jdbc").options(**jdbc).load()


def nested_features(videos: DataFrame, segments: DataFrame, frames: DataFrame, timeline: DataFrame, key: str = "video_id") -> DataFrame:
    """One features document per video, its three arrays in order. For exports: a row holds a whole video."""

    def nested(rows: DataFrame, pos: str, schema, name: str) -> DataFrame:
        fields = [f.name for f in schema.fields]
        one = rows.groupBy(key).agg(
            F.array_sort(F.collect_list(F.struct(pos, F.struct(*fields).alias("x")))).alias(name),
            F.count(F.lit(1)).alias(f"n_{name}"),
        )
        return one.withColumn(name, F.transform(name, lambda e: e["x"])).drop(f"n_{name}")

    out = videos.join(nested(segments, "seg_pos", schemas.SEGMENT, "audio_transcript"), key, "left")
    out = out.join(nested(frames, "frame_pos", schemas.FRAME, "frame_features"), key, "left")
    out = out.join(nested(timeline, "frame_pos", schemas.TIMELINE_ENTRY, "integrated_timeline"), key, "left")
    return out.select(*[f.name for f in schemas.FEATURES.fields])


def _as_array(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The JSON texts of a partition as the lines of one root array."""
    held: str | None = None
    for batch in batches:
        lines = batch.column(0).to_pylist()
        if lines:
            shown = ["[" if held is None else held + ",", *(line + "," for line in lines[:-1])]
            held = lines[-1]
            yield pa.RecordBatch.from_arrays([pa.array(shown)], ["value"])
    yield pa.RecordBatch.from_arrays([pa.array(["[]"] if held is None else [held, "]"])], ["value"])


def write_arrays(rows: DataFrame, path: str) -> None:
    """`rows` as JSON documents: each file one root array with the rows of a partition in their order, nulls written. Streams, whatever the number of rows."""
    text = F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"})
    rows.select(text.alias("value")).mapInArrow(_as_array, "value string").write.text(path)


def write_features(documents: DataFrame, path: str, one_per_file: bool = False) -> None:
    """Features documents as root arrays; or each alone in a file, in a folder named by the stem of its recording."""
    if not one_per_file:
        return write_arrays(documents, path)
    text = F.to_json(F.struct(*documents.columns), {"ignoreNullFields": "false"})
    stem = F.regexp_extract("file_path", r"([^/]+?)(?:\.[^./]*)?$", 1)
    rows = documents.select(stem.alias("video"), text.alias("value")).repartition("video")
    return rows.write.partitionBy("video").option("maxRecordsPerFile", 1).text(path)


def write_highlights(rows: DataFrame, path: str, form: str = "parquet") -> None:
    """The seven columns in their order, in the order of the highlights: as JSON root arrays, or in another format with a folder per type."""
    ordered = rows.sortWithinPartitions("video_id", "section", "pos") if "section" in rows.columns else rows
    keys = [c for c in ("video_id",) if c in rows.columns]
    if form == "json":
        return write_arrays(ordered.select(*keys, *COLUMNS), path)
    return ordered.select(*keys, *COLUMNS).write.partitionBy("highlight_type").format(form).save(path)


def write_insights(rows: DataFrame, path: str, form: str = "json") -> None:
    """Insights as JSON root arrays, or in another format."""
    return write_arrays(rows, path) if form == "json" else rows.write.format(form).save(path)
