"""Explicit schemas of the documents and tables; reads never infer."""

from __future__ import annotations

from pyspark.sql import types as T

SECONDS = T.DecimalType(12, 3)
HAND = T.ArrayType(T.ArrayType(T.DoubleType()))
HANDS = T.StructType([T.StructField("left_hand", HAND), T.StructField("right_hand", HAND)])


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


SEGMENT = _struct(start_sec=SECONDS, end_sec=SECONDS, text=T.StringType())
BOX = _struct(label=T.StringType(), confidence=T.DoubleType(), x1=T.IntegerType(), y1=T.IntegerType(), x2=T.IntegerType(), y2=T.IntegerType())
TIMELINE_TOOL = _struct(label=T.StringType(), confidence=T.DoubleType(), bbox=T.ArrayType(T.IntegerType()))
FRAME = _struct(timestamp_sec=SECONDS, detected_tools=T.ArrayType(BOX), hand_movement_vector=HANDS)
TIMELINE_ENTRY = _struct(timestamp_sec=SECONDS, audio_context=T.StringType(), detected_tools=T.ArrayType(TIMELINE_TOOL), hand_movement_vector=HANDS)

#: One features document per video.
FEATURES = _struct(
    file_path=T.StringType(), duration_sec=T.DoubleType(), fps=T.DoubleType(), total_frames=T.IntegerType(),
    audio_transcript=T.ArrayType(SEGMENT), frame_features=T.ArrayType(FRAME), integrated_timeline=T.ArrayType(TIMELINE_ENTRY),
)

HIGHLIGHT = _struct(
    timestamp_sec=SECONDS, highlight_type=T.StringType(), trigger_reason=T.StringType(), feature_description=T.StringType(),
    speech_quote=T.StringType(), detected_tools=T.ArrayType(T.StringType()), hand_active=T.BooleanType(),
)

EVIDENCE = _struct(detected_tools=T.ArrayType(T.StringType()), verified_quotes=T.ArrayType(T.StringType()))
INSIGHT = _struct(
    step_number=T.IntegerType(), status=T.StringType(), standard_manual_text=T.StringType(),
    tacit_knowledge_description=T.StringType(), fact_evidence=EVIDENCE
)

# Tables of the load.
VIDEO_METADATA = _struct(
    video_id=T.LongType(), master_name=T.StringType(), job_category=T.StringType(), ncs_code=T.StringType(), file_path=T.StringType(),
    created_at=T.TimestampType(), updated_at=T.TimestampType(),
)
FRAME_FEATURES = _struct(
    feature_id=T.LongType(), video_id=T.LongType(), frame_timestamp=SECONDS, detected_tools=T.StringType(),
    hand_movement_vector=T.StringType(), created_at=T.TimestampType()
)
INSIGHTS_TABLE = _struct(
    insight_id=T.LongType(), video_id=T.LongType(), step_number=T.IntegerType(), standard_manual_text=T.StringType(),
    tacit_knowledge_description=T.StringType(),
    insight_embedding=T.ArrayType(T.FloatType()), created_at=T.TimestampType(), updated_at=T.TimestampType(),
)
HIGHLIGHTS_TABLE = _struct(
    video_id=T.LongType(), timestamp_sec=SECONDS, highlight_type=T.StringType(), trigger_reason=T.StringType(), feature_description=T.StringType(),
    speech_quote=T.StringType(), detected_tools=T.StringType(), hand_active=T.IntegerType(),
)
NCS_MODULES = _struct(ncs_code=T.StringType(), module_name=T.StringType(), standard_manual_text=T.StringType())
