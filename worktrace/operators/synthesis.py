"""From timelines and manuals to prompt rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from worktrace.functions import hands
from worktrace.functions.text import strip
from worktrace.operators import ranks

SAMPLE = 30

# Fixed value: what the model is asked, with the places of timeline and manual.
PROMPT = """## 타임스탬프별 오디오/비전 통합 데이터

```json
{timeline}
```

## NCS 엔진본체 정비 표준 매뉴얼

```
{manual}
```

## 출력 스키마 (JSON 배열만 반환)

[
  {
    "step_number": 1,
    "status": "SUCCESS | MISMATCH | STANDARD_COMPLIANCE",
    "standard_manual_text": "NCS 매뉴얼에서 해당 단계 기준선 요약",
    "tacit_knowledge_description": "SUCCESS 시 정량적 암묵지 상세 / 그 외 '해당 없음'",
    "fact_evidence": {
      "detected_tools": ["YOLO 탐지 공구명 목록"],
      "verified_quotes": ["Whisper 인식 정비사 발화 및 수치"]
    }
  }
]"""


def relevant(timeline: DataFrame) -> DataFrame:
    """Entries with spoken text or detected tools. Tools: `detected_tools` or `labels`."""
    tools = "detected_tools" if "detected_tools" in timeline.columns else "labels"
    return timeline.filter((F.coalesce(F.length("audio_context"), F.lit(0)) > 0) | (F.coalesce(F.size(tools), F.lit(0)) > 0))


def sampled(timeline: DataFrame, most: int = SAMPLE, pos: str = "frame_pos") -> DataFrame:
    """At most `most` entries of each video, evenly stepped: every (n div most)-th from the first. With sample_pos.

    Videos and positions alone are ranked (see `ranks`), so a long video fills many
    tasks; the few that stay pick their entries. A position is one entry's.
    """
    ranked = ranks.numbered(timeline.select("video_id", pos), ["video_id"], [pos], "_i", "_n")
    step = F.greatest(F.lit(1), F.floor(F.col("_n") / most))
    kept = ranked.filter((F.col("_n") <= most) | ((F.col("_i") % step == 0) & (F.floor(F.col("_i") / step) < most)))
    place = F.when(F.col("_n") <= most, F.col("_i")).otherwise(F.floor(F.col("_i") / step)).cast("int").alias("sample_pos")
    return timeline.join(kept.select("video_id", pos, place), ["video_id", pos]).select(*timeline.columns, "sample_pos")


def slim_hands(timeline: DataFrame) -> DataFrame:
    """Landmarks replaced by their summary, hand by hand."""
    vector = F.col("hand_movement_vector")
    return timeline.withColumn("hand_movement_vector", F.struct(*[hands.summary(vector[side]).alias(side) for side in ("left_hand", "right_hand")]))


#: The keys of an entry in a prompt, in their order (fixed values).
ENTRY = ["timestamp_sec", "audio_context", "detected_tools", "hand_movement_vector"]


def prompt_entries(timeline: DataFrame) -> DataFrame:
    """Entries (sample_pos, timestamp_sec, detected_tools as structs, ...) with the keys of a prompt: seconds as a number, hands as summaries."""
    return slim_hands(timeline).select("video_id", "sample_pos", F.col("timestamp_sec").cast("double").alias("timestamp_sec"), *ENTRY[1:])


def timeline_json(entries: DataFrame, *columns: str) -> DataFrame:
    """video_id, timeline: the sampled entries of each video as one JSON array in order (at most `SAMPLE` of them)."""
    rows = entries.groupBy("video_id").agg(F.array_sort(F.collect_list(F.struct("sample_pos", *columns))).alias("e"))
    shown = F.transform("e", lambda x: F.struct(*[x[c].alias(c) for c in columns]))
    return rows.select("video_id", F.to_json(shown, {"ignoreNullFields": "false"}).alias("timeline"), F.size("e").alias("n_entries"))


def with_manual(videos: DataFrame, manuals: DataFrame, text: Column | None = None, file_text: Column | None = None) -> DataFrame:
    """`videos` (ncs_code) with manual_text: the given text, else the file's, else that of the manual master by code.

    An empty code is no code. The master has one row per code; Spark broadcasts
    it when it is small. Else videos without a code stay out of the join, where
    they would meet in one task.
    """
    coded = videos.withColumn("ncs_code", F.nullif(F.col("ncs_code"), F.lit("")))
    found = manuals.select("ncs_code", F.col("standard_manual_text").alias("_manual"))
    joined = coded.filter("ncs_code is not null").join(found, "ncs_code", "left").select(*coded.columns, "_manual")
    joined = joined.unionByName(coded.filter("ncs_code is null").withColumn("_manual", F.lit(None).cast("string")))
    given = [F.nullif(c, F.lit("")) for c in (text, file_text) if c is not None]
    return joined.withColumn("manual_text", F.coalesce(*given, F.col("_manual"))).drop("_manual")


def missing_manuals(videos: DataFrame, manuals: DataFrame) -> DataFrame:
    """Videos without a manual, with the reason: no_code or unknown_code."""
    coded = videos.withColumn("ncs_code", F.nullif(F.col("ncs_code"), F.lit("")))
    lost = coded.filter("ncs_code is not null").join(manuals.select("ncs_code"), "ncs_code", "left_anti").select(*coded.columns)
    return lost.withColumn("reason", F.lit("unknown_code")).unionByName(coded.filter("ncs_code is null").withColumn("reason", F.lit("no_code")))


def prompts(timelines: DataFrame, videos: DataFrame, template: str = PROMPT, ascii_classes: bool = False) -> DataFrame:
    """video_id, prompt: the template, with {timeline} before {manual}, filled with a video's timeline and its manual. Videos without a manual have none: see missing_manuals(). ascii_classes: see text.strip."""
    head, rest = template.split("{timeline}")
    middle, tail = rest.split("{manual}")
    text = F.concat(F.lit(head), F.col("timeline"), F.lit(middle), strip(F.col("manual_text"), ascii_classes), F.lit(tail))
    known = videos.select("video_id", "manual_text").filter("manual_text is not null")
    return timelines.join(known, "video_id").select("video_id", "n_entries", text.alias("prompt"))
