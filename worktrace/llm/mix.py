"""Mixing sources to target weights, in DataFrame functions only.

Words are summed per source (map-side first, so a hot source costs one row per
task), repetition rates follow, and each document is emitted floor(rate) times
plus once more with the fraction's probability, drawn from a hash.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from worktrace.llm.common import WORD, lookup_join, materialise, packed, quoted


def n_words(text: Column) -> Column:
    """Words of a text (null: 0)."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_plan(sizes: DataFrame, weights: Sequence[int] = (5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """Per source: source, source_size, target, rate, from rows (source, size).

    Sources in code-point order (null last) get `weights` in turn. All targets
    share `share` x the total size by weight; none goes over `cap` x its own
    source's size, and the excess is shared again by weight until none is above.
    That ends where every target is min(cap x size, level x weight), and the
    capped sources are those with the least cap/weight: one ordered running sum
    finds them, instead of a loop of jobs. The windows without a key order the
    source totals only, one narrow row per source, in one task: sources may number
    some millions, but not one per document. A source of size 0 has target and
    rate 0.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = totals.withColumn("_i", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_i") % len(weights) + 1).cast("int"))
    capped = ranked.withColumn("_w", weight).withColumn("_cap", F.col("source_size") * F.lit(cap))
    order = Window.orderBy(F.col("_cap") / F.col("_w"), "_i")
    before, after, whole = (order.rowsBetween(a, b) for a, b in ((Window.unboundedPreceding, -1), (0, Window.unboundedFollowing), (Window.unboundedPreceding, Window.unboundedFollowing)))
    level = capped.select(
        "*",
        (F.sum("source_size").over(whole) * F.lit(share)).alias("_budget"),
        F.coalesce(F.sum("_cap").over(before), F.lit(0.0)).alias("_spent"),
        F.sum("_w").over(after).alias("_open"),
    ).withColumn("_full", (F.col("_budget") - F.col("_spent")) * F.col("_w") >= F.col("_cap") * F.col("_open"))
    rest = level.select(
        "*",
        F.coalesce(F.sum(F.when(F.col("_full"), F.col("_cap"))).over(whole), F.lit(0.0)).alias("_taken"),
        F.sum(F.when(~F.col("_full"), F.col("_w"))).over(whole).alias("_left"),
    )
    target = F.when(F.col("_full"), F.col("_cap")).otherwise((F.col("_budget") - F.col("_taken")) * F.col("_w") / F.col("_left"))
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(cap))).otherwise(F.lit(0.0))
    return rest.withColumn("target", target).select("source", "source_size", "target", rate.alias("rate"))


def draw(doc_id: Column, text: Column, seed: str) -> Column:
    """A number in [0, 1) that depends on seed, id and text only, so reruns agree."""
    key = F.concat_ws(":", F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("null")), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "mix-1", **plan) -> DataFrame:
    """Per row of `docs`: doc_id, size, source_size, target, rate, copies and row (all columns of docs).

    Size is the number of words (null or empty text: 0). A null source is a
    source of its own. Rows that repeat id and text draw the same number. Empty
    table: no rows. Extra columns stay inside `row`, whatever their names.
    """
    text = quoted(text_col)
    sizes = docs.select(quoted(source_col).alias("source"), n_words(text).alias("size"))
    plans = materialise(source_plan(sizes, **plan), "mix-plan")
    rows = docs.select(
        quoted(id_col).alias("doc_id"), quoted(source_col).alias("source"), n_words(text).alias("size"),
        draw(quoted(id_col), text, seed).alias("_u"), packed(docs).alias("row")
    )
    joined = lookup_join(rows, plans, ["source"], F.xxhash64("doc_id", "_u"))
    whole = F.floor("rate")
    extra = (F.col("_u") < F.col("rate") - whole).cast("long")
    return joined.select("doc_id", "size", "source_size", "target", "rate", (whole + extra).alias("copies"), "row")


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each row of `docs` as often as its copies say, with the columns of `docs`.

    Null or empty texts have no words, but are drawn like any other; repeated rows
    draw the same number, so all of them go or stay. A null source is a source.
    Empty table: no rows.
    """
    out = copies(docs, **options).filter("copies > 0")
    out = out.select(F.explode(F.array_repeat(F.lit(True), F.col("copies").cast("int"))).alias("_"), "row")
    return out.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
