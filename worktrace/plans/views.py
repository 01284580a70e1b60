"""Session views over the given tables: segments, frames, hands, videos, manuals and answers.

The tables hold no recordings, so queries map them: turns of conversations become
segments, events become detections, embeddings become hands. The SQL twins of the
views stand beside them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

UNITS = ["mm", "N-m", "ft-lb", "in", "degree", "psi"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A turn every 10 s; the gaps, touches and overlaps depend on the conversation."""
    unit = F.element_at(F.array(*[F.lit(u) for u in UNITS]), (F.col("turn") % 6 + 1).cast("int"))
    spoken = (
        F.when(F.col("conv_id") % 3 == 0, F.concat(F.col("text"), F.lit(" tighten to "), (F.col("turn") * 7 + 5).cast("string"), F.lit(" "), unit))
        .when(F.col("conv_id") % 3 == 1, F.col("text"))
        .otherwise(F.regexp_replace("text", "(?i)then", "thon"))
    )
    start = F.col("turn") * 10000
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("video_id"), F.col("turn").alias("seg_pos"), start.alias("start_ms"),
        (start + 7000 + F.col("conv_id") % 5 * 1000).alias("end_ms"), spoken.alias("text")
    )


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two events to a sampled frame, in order of time."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    label = (
        F.when(F.col("event_type") == "view", "person").when(
            F.col("event_type") == "signup", "scissors",
        ).when(F.col("event_type") == "purchase", "bottle")
        .when(F.col("event_type") == "error", "chair").otherwise("dining table")
    )
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("video_id"), "event_id", F.floor((F.row_number().over(order) - 1) / 2).alias("frame_pos"), label.alias("label"),
        (F.col("value") / 100).alias("confidence"), F.get_json_object("props", "$.k").cast("int").alias("k"),
    )


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A frame each half second: labels of confident detections in order, and whether a hand is active."""
    rows = detections(spark, sf_dir)
    kept = F.collect_list(F.when(F.col("confidence") >= 0.4, F.struct("event_id", "label")))
    out = rows.groupBy("video_id", "frame_pos").agg(F.array_sort(kept).alias("l"), F.bool_or(F.col("k") % 7 == 0).alias("hand_active"))
    return out.select(
        "video_id", "frame_pos", (F.col("frame_pos") * 500).alias("ts_ms"),
        F.transform("l", lambda x: x["label"]).alias("labels"), "hand_active",
    )


def tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """video_id, frame_pos, detected_tools: the confident detections of a frame, as a timeline has them."""
    from worktrace.operators import extraction

    k = F.col("k")
    box = F.struct("label", "confidence", k.alias("x1"), (k * 2).alias("y1"), (k + 10).alias("x2"), (k * 2 + 5).alias("y2"))
    rows = detections(spark, sf_dir).groupBy("video_id", "frame_pos").agg(F.array_sort(F.collect_list(F.struct("event_id", box.alias("b")))).alias("x"))
    boxes = extraction.confident_boxes(F.transform("x", lambda e: e["b"]))
    return rows.select("video_id", "frame_pos", extraction.boxes_as_lists(boxes).alias("detected_tools"))


def videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.when(F.col("o_orderkey") % 7 == 0, "").otherwise((F.col("o_custkey") % 250).cast("string"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("video_id"), code.alias("ncs_code"))


def manuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("ncs_code"), F.col("text").alias("standard_manual_text"))


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One answer per order, an item per line: plain or fenced JSON, broken JSON (text behind, two arrays, single quotes), or an object instead of an array.

    Some step numbers are no numbers, some items that should describe nothing do, some cite tools or quotes that may not be there.
    """
    line = table(spark, sf_dir, "lineitem")
    status = (
        F.when(F.col("l_returnflag") == "A", "SUCCESS").when(
            F.col("l_returnflag") == "N", "STANDARD_COMPLIANCE",
        ).when(F.col("l_linenumber") % 2 == 0, "MISMATCH").otherwise("UNKNOWN")
    )
    turn = F.col("l_linenumber") - 1
    unit = F.element_at(F.array(*[F.lit(u) for u in UNITS]), (turn % 6 + 1).cast("int"))
    quote = F.concat(F.lit("tighten to "), (turn * 7 + 5).cast("string"), F.lit(" "), unit)
    common = [
        F.when(F.col("l_suppkey") % 97 == 0, "n/a").otherwise(F.col("l_linenumber").cast("string")).alias("step_number"), status.alias("status"),
        F.concat(F.lit("step "), F.col("l_linenumber").cast("string")).alias("standard_manual_text"),
        F.when(
            (status == "SUCCESS") | (F.col("l_partkey") % 50 == 0), F.concat(F.lit("part "), F.col("l_partkey").cast("string")),
        ).otherwise("해당 없음").alias("tacit_knowledge_description"),
    ]
    evidence = F.struct(
        F.when(F.col("l_partkey") % 7 == 0, F.array(F.lit("person"), F.lit("drill"))).otherwise(F.array(F.lit("person"))).alias("detected_tools"),
        F.when(F.col("l_quantity") > 30, F.array(quote)).otherwise(F.array().cast("array<string>")).alias("verified_quotes"),
    ).alias("fact_evidence")
    keep_null = {"ignoreNullFields": "false"}
    item = F.when(F.col("l_quantity") <= 5, F.to_json(F.struct(*common), keep_null)).otherwise(F.to_json(F.struct(*common, evidence), keep_null))
    order = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_returnflag", item.alias("item"))
    per = line.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(order)).alias("x"))
    body = F.concat(F.lit("["), F.array_join(F.transform("x", lambda e: e["item"]), ","), F.lit("]"))
    k = F.col("l_orderkey")
    raw = (
        F.when(k % 11 == 0, F.when(k % 3 == 0, F.concat(body, F.lit(" and so on []"))).when(k % 3 == 1, F.concat(body, body)).otherwise(F.replace(body, F.lit('"'), F.lit("'"))))
        .when(k % 13 == 0, F.get(F.transform("x", lambda e: e["item"]), F.lit(0)))
        .when(k % 4 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise(body)
    )
    return per.select(k.alias("video_id"), raw.alias("raw_response"))


SEG_SQL = """
seg as (
  select conv_id as video_id, turn as seg_pos, turn * 10000 as start_ms, turn * 10000 + 7000 + (conv_id % 5) * 1000 as end_ms,
         case when conv_id % 3 = 0 then text || ' tighten to ' || (turn * 7 + 5) || ' ' || (['mm', 'N-m', 'ft-lb', 'in', 'degree', 'psi'])[cast(turn % 6 as int) + 1]
              when conv_id % 3 = 1 then text else regexp_replace(text, 'then', 'thon', 'gi') end as text
  from conversations
)"""
DET_SQL = """
det as (
  select user_id as video_id, event_id, (row_number() over (partition by user_id order by ts, event_id) - 1) // 2 as frame_pos,
         case event_type when 'view' then 'person' when 'signup' then 'scissors' when 'purchase' then 'bottle' when 'error' then 'chair' else 'dining table' end as label,
         value / 100 as confidence, cast(json_extract(props, '$.k') as int) as k
  from events
)"""
FRAMES_SQL = (
    DET_SQL
    + """, frames as (
  select video_id, frame_pos, frame_pos * 500 as ts_ms, coalesce(list(label order by event_id) filter (where confidence >= 0.4), []) as labels, bool_or(k % 7 = 0) as hand_active
  from det group by video_id, frame_pos
)"""
)
TOOLS_SQL = """
tools as (
  select video_id, frame_pos, '[' || coalesce(string_agg('{"label":"' || label || '","confidence":' || round(confidence, 4)::double || ',"bbox":[' || k || ',' || k * 2 || ',' || k + 10 || ',' || k * 2 + 5 || ']}',
           ',' order by event_id) filter (where confidence >= 0.4), '') || ']' as detected_tools
  from det group by video_id, frame_pos
)"""
VIDEOS_SQL = "videos as (select o_orderkey as video_id, case when o_orderkey % 7 = 0 then '' else cast(o_custkey % 250 as varchar) end as ncs_code from orders)"
MANUALS_SQL = "manuals as (select cast(item_id as varchar) as ncs_code, text as standard_manual_text from benchmark)"
#: The items of the answers, with whether the answer can be parsed; SQL needs no JSON text to say which are valid.
ITEMS_SQL = """
items as (
  select l_orderkey as video_id, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_returnflag) - 1 as item_pos,
         case when l_suppkey % 97 = 0 then null else l_linenumber end as step_number, case when l_suppkey % 97 = 0 then 'n/a' else l_linenumber::varchar end as step_text,
         case when l_partkey % 7 = 0 then ['person', 'drill'] else ['person'] end as tools,
         case when l_quantity > 30 then 'tighten to ' || (l_linenumber * 7 - 2) || ' ' || (['mm', 'N-m', 'ft-lb', 'in', 'degree', 'psi'])[((l_linenumber - 1) % 6 + 1)::int] end as quote,
         'step ' || l_linenumber as standard_manual_text, l_quantity <= 5 as lacks_evidence, l_partkey,
         case l_returnflag when 'A' then 'SUCCESS' when 'N' then 'STANDARD_COMPLIANCE' else case when l_linenumber % 2 = 0 then 'MISMATCH' else 'UNKNOWN' end end as status,
         case when l_orderkey % 11 = 0 or l_orderkey % 13 = 0 then false else true end as parsable
  from lineitem
), described as (
  select *, case when status = 'SUCCESS' or l_partkey % 50 = 0 then 'part ' || l_partkey else '해당 없음' end as tacit_knowledge_description from items
)"""
