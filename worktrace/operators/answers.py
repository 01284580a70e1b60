"""Parsing and validating model answers; what is rejected goes to side tables with a reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from worktrace.functions.columns import once
from worktrace.functions.text import strip
from worktrace.sources import storage

# Fixed values of the answer format.
REQUIRED = ["step_number", "status", "standard_manual_text", "tacit_knowledge_description", "fact_evidence"]
STATUSES = ["SUCCESS", "MISMATCH", "STANDARD_COMPLIANCE"]
NOTHING = "해당 없음"


def unfenced(clean: Column) -> Column:
    """A stripped answer without a Markdown fence: its first line goes, its last one only if it is a fence."""
    opened = F.regexp_replace(clean, r"^[^\r\n]*(?:\r\n|\r|\n)?", "")
    return F.when(clean.startswith("```"), F.regexp_replace(opened, r"(?U)(?:^|[\r\n])[^\S\r\n]*```$", "")).otherwise(clean)


def is_one_array(body: Column) -> Column:
    """Whether a text is one JSON array and nothing else, by strict rules: double quotes, no text behind, not two in a row.

    A parser may stop behind the first value, so the text is put inside an object and
    inside an array: what follows the first value breaks one of them, or is a second
    entry of the array. NaN and repeated keys of an object are not taken.
    """
    shaped = body.startswith("[") & body.endswith("]")
    in_object, in_array = [F.try_parse_json(F.concat(F.lit(a), body, F.lit(b))) for a, b in (('{"x":', "}"), ("[", "]"))]
    alone = F.try_variant_get(in_array, "$[1]", "variant").isNull()
    return F.coalesce(shaped & in_object.isNotNull() & in_array.isNotNull() & alone, F.lit(False))


def parsed(answers: DataFrame) -> DataFrame:
    """`answers` (video_id, raw_response) with items: array of maps; null where the answer is no JSON array of objects."""
    rows = once(answers, "_clean", strip(F.col("raw_response")))
    rows = once(rows, "_body", F.btrim(unfenced(F.col("_clean")), F.lit(" \t\n\r\x0b\f")))
    return once(rows, "items", F.when(is_one_array(F.col("_body")), F.from_json("_body", "array<map<string,string>>"))).drop("_clean", "_body")


def rejected_answers(answers: DataFrame) -> DataFrame:
    """Answers that can't be used as a whole: reason and the first 500 characters."""
    rows = parsed(answers)
    good = F.filter("items", lambda x: _valid(x))
    reason = F.when(F.col("items").isNull(), "not_a_json_array").when(F.size(good) == 0, "no_valid_insight")
    return rows.select("video_id", reason.alias("reason"), F.substring("raw_response", 1, 500).alias("snippet")).filter("reason is not null")


def missing_fields(item: Column) -> Column:
    """Required keys that an item lacks; a key with null is there."""
    return F.array_except(F.array(*[F.lit(k) for k in REQUIRED]), F.map_keys(item))


def _valid(item: Column) -> Column:
    return (F.size(missing_fields(item)) == 0) & F.coalesce(item["status"].isin(*STATUSES), F.lit(False))


def items(answers: DataFrame) -> DataFrame:
    """One row per item of the parsable answers: video_id, item_pos, item, reason (null: valid)."""
    rows = parsed(answers).select("video_id", F.posexplode("items").alias("item_pos", "item"))
    lacks = missing_fields(F.col("item"))
    reason = F.when(F.size(lacks) > 0, F.concat(F.lit("missing: "), F.array_join(lacks, ", "))).when(
        ~F.coalesce(F.col("item")["status"].isin(*STATUSES), F.lit(False)),
        F.concat(F.lit("status: "), F.coalesce(F.col("item")["status"], F.lit("null")))
    )
    return rows.withColumn("reason", reason)


def insights(answers: DataFrame) -> DataFrame:
    """The valid items as typed columns; a step number that is no number is null (see rejected_steps)."""
    item = F.col("item")
    evidence = F.from_json(item["fact_evidence"], "detected_tools array<string>, verified_quotes array<string>")
    return items(answers).filter("reason is null").select(
        "video_id", "item_pos", step(item["step_number"]).alias("step_number"), item["status"].alias("status"),
        item["standard_manual_text"].alias("standard_manual_text"),
        item["tacit_knowledge_description"].alias("tacit_knowledge_description"), evidence.alias("fact_evidence"),
    )


def step(text: Column) -> Column:
    """A step number: whole numbers as they are, others cut at the point; null if it is none or too large."""
    return text.try_cast("double").try_cast("int")


def rejected_steps(answers: DataFrame) -> DataFrame:
    """Valid items whose step number has a text that is no number: video_id, item_pos, step_number (the text). They stay insights."""
    text = F.col("item")["step_number"]
    rows = items(answers).filter(F.col("reason").isNull() & text.isNotNull() & step(text).isNull())
    return rows.select("video_id", "item_pos", text.alias("step_number"))


def rejected_items(answers: DataFrame) -> DataFrame:
    return items(answers).filter("reason is not null").select("video_id", "item_pos", "reason")


def outcomes(found: DataFrame) -> DataFrame:
    """Insights per status."""
    return found.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def know_how(found: DataFrame) -> DataFrame:
    """The insights that count as know-how."""
    return found.filter(F.col("status") == "SUCCESS")


def evidence_audit(found: DataFrame, labels: DataFrame, segments: DataFrame) -> DataFrame:
    """Breaches of the evidence rules: video_id, item_pos, rule, detail. Nothing is dropped.

    description: an item other than SUCCESS describes something. tool: a cited tool
    was not detected in the video (labels: video_id, label). quote: the words of a
    cited quote stand nowhere in the video's transcript one after the other, be it
    inside a segment or across neighbouring ones. A quote without words cites nothing.

    The answers are parsed once: what items claim is written as narrow rows, and one join takes out what was seen or said.
    """
    claims = storage.materialise(_claims(found), "claims")
    seen = labels.select("video_id", F.lit("tool").alias("rule"), F.col("label").alias("detail")).distinct()
    quotes = claims.filter("rule = 'quote'").select("video_id", F.col("detail").alias("text"))
    said = spoken(quotes, segments).select("video_id", F.lit("quote").alias("rule"), F.col("text").alias("detail"))
    kept = claims.join(seen.unionByName(said), ["video_id", "rule", "detail"], "left_anti")
    return kept.select("video_id", "item_pos", "rule", "detail")


def _claims(found: DataFrame) -> DataFrame:
    """video_id, item_pos, rule, detail: what each item says that has to be so, or that breaks a rule by itself."""
    none = F.array().cast("array<struct<rule:string,detail:string>>")
    claim = lambda rule, text: F.struct(F.lit(rule).alias("rule"), text.alias("detail"))
    described = (F.col("status") != "SUCCESS") & (F.coalesce("tacit_knowledge_description", F.lit("")) != NOTHING)
    said = F.when(described, F.array(claim("description", F.col("tacit_knowledge_description"))))
    tools = F.transform("fact_evidence.detected_tools", lambda x: claim("tool", x))
    words = F.filter(F.transform("fact_evidence.verified_quotes", lambda x: strip(x)), lambda x: x != "")
    quotes = F.transform(words, lambda x: claim("quote", x))
    every = F.concat(*[F.coalesce(c, none) for c in (said, tools, quotes)])
    return found.select("video_id", "item_pos", F.explode(every).alias("x")).select("video_id", "item_pos", "x.rule", "x.detail")


RUN = 3  # words of a run in the index of a transcript


def _words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"(?U)\s+"), lambda w: w != "")


def _runs(words: Column, width: int) -> Column:
    """(i, run) for each run of `width` words, or none."""
    starts = F.sequence(F.lit(0), F.size(words) - width)
    each = F.transform(starts, lambda i: F.struct(i.cast("long").alias("i"), F.array_join(F.slice(words, i + 1, F.lit(width)), " ").alias("run")))
    return F.when(F.size(words) >= width, each)


def transcript_runs(segments: DataFrame, width: int) -> DataFrame:
    """video_id, at, run: an index of the runs of `width` words of each transcript, by their place in it.

    A segment is lengthened by the first words of those behind it, so runs go on across
    segments. Places are counted by one narrow row per segment.
    """
    said = segments.select("video_id", "seg_pos", _words(F.col("text")).alias("w")).filter(F.size("w") > 0)
    order = Window.partitionBy("video_id").orderBy("seg_pos")
    edge = said.select("video_id", "seg_pos", F.size("w").alias("n"), F.slice("w", 1, RUN - 1).alias("head"))
    heads = [F.coalesce(F.lead("head", k).over(order), F.array().cast("array<string>")) for k in range(1, RUN)]
    before = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    edge = edge.select("video_id", "seg_pos", "n", before.alias("before"), F.slice(F.concat(*heads), 1, RUN - 1).alias("next"))
    rows = said.join(edge, ["video_id", "seg_pos"]).select("video_id", "before", "n", F.explode(_runs(F.concat("w", "next"), width)).alias("x"))
    return rows.filter(F.col("x.i") < F.col("n")).select("video_id", (F.col("before") + F.col("x.i")).alias("at"), F.col("x.run").alias("run"))


def unspoken(quotes: DataFrame, segments: DataFrame) -> DataFrame:
    """The rows of `quotes` (video_id, text, more) whose words the transcript of their video doesn't hold in a row."""
    return quotes.join(spoken(quotes, segments), ["video_id", "text"], "left_anti")


def spoken(quotes: DataFrame, segments: DataFrame) -> DataFrame:
    """video_id, text, once each, of the `quotes` whose words the transcript of their video holds in a row.

    A quote of up to RUN words is looked up as one run. The runs of a longer one must all
    stand at places that put the quote's beginning at the same word; its first run says
    which places those can be. Words are compared as they are. Only videos with quotes and
    a transcript take part; the quotes of these are written first and asked which widths
    of runs occur, and no other is indexed.
    """
    told = segments.select("video_id").distinct()
    asked = quotes.select("video_id", "text").join(told, "video_id", "left_semi").distinct()
    asked = storage.materialise(asked.withColumn("w", _words(F.col("text"))).filter(F.size("w") > 0), "quotes")
    widths = sorted(r["n"] for r in asked.select(F.least(F.size("w"), F.lit(RUN)).alias("n")).distinct().collect())
    segments = segments.join(asked.select("video_id").distinct(), "video_id", "left_semi")
    found = asked.filter("false").select("video_id", "text")
    for width in widths:
        some = asked.filter(F.size("w") == width if width < RUN else F.size("w") >= RUN)
        index = transcript_runs(segments, width)
        if width < RUN:
            first = some.withColumn("run", F.array_join("w", " "))
            hit = first.join(index.select("video_id", "run").distinct(), ["video_id", "run"], "left_semi").select("video_id", "text")
        else:
            needed = some.select("video_id", "text", F.size("w").alias("n"), F.explode(_runs(F.col("w"), width)).alias("x"))
            needed = needed.select("video_id", "text", (F.col("n") - width + 1).alias("runs"), F.col("x.i").alias("i"), F.col("x.run").alias("run"))
            placed = needed.join(index, ["video_id", "run"]).withColumn("begin", F.col("at") - F.col("i"))
            whole = placed.groupBy("video_id", "text", "runs", "begin").agg(F.count("*").alias("c")).filter("c = runs")
            hit = whole.select("video_id", "text").distinct()
        found = found.unionByName(hit)
    return found
