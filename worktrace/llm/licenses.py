"""License scans: ordered signature rules over whole texts, without Python in the tasks.

Texts with one of the rules' keywords are cut into tiles of words that overlap by more than the longest match, so that every match
lies whole in the tile of its first word, together with all that could contain it. Of a
tile, only rules whose keyword stands there are tried. A detection goes if a stronger
one, or one as strong and longer, contains its interval; base detections keep their label.

All of it is a projection: no row leaves its partition, whatever repeats.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from worktrace.llm.common import packed, quoted
from worktrace.llm.license_rules import WEIGHTS, Rule, compiled, keywords, longest, standard_rules

#: What separates words of a lower-cased text (fixed by the contract).
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

TILE = 96  # words of a tile, besides those before and behind

_RULE = "rule int, label string, strength int, base boolean, pattern string"
_FOUND = "array<struct<first:int,last:int,rule:int,label:string,strength:int,base:boolean>>"


def spaced(text: Column) -> Column:
    """The words of a text in lower case, each with a space before and one behind."""
    lower = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    words = F.regexp_replace(F.regexp_replace(lower, SEPARATORS, "  "), "^ +| +$", "")
    return F.when(words == "", "").otherwise(F.concat(F.lit(" "), words, F.lit(" ")))


def count_words(spaced: Column) -> Column:
    return F.floor((F.length(spaced) - F.length(F.replace(spaced, F.lit(" "), F.lit("")))) / 2).cast("int")


def _table(rules: list[Rule]) -> tuple[Column, Column]:
    """Rules by keyword, and the keywords, as constants."""
    by: dict[str, list[dict]] = {}
    for i, (r, word) in enumerate(zip(rules, keywords(rules), strict=True)):
        by.setdefault(word, []).append(
            {"rule": i, "label": r.label, "strength": r.strength, "base": r.base, "pattern": compiled(r.signature)}
        )
    schema = f"map<string,array<struct<{_RULE.replace(' ', ':').replace(',:', ',')}>>>"
    return F.from_json(F.lit(json.dumps(by)), schema), F.array(*[F.lit(k) for k in sorted(by)])


def _matches(tile: Column, rule: Column) -> Column:
    """First and last word, from 0 in the tile, of each match of a rule."""
    pieces = F.split(F.regexp_replace(tile, rule["pattern"], F.lit("\x01$0\x02")), "\x01")
    return F.transform(
        F.sequence(F.lit(1), F.size(pieces) - 1),
        lambda j: F.struct(
            F.aggregate(F.slice(pieces, 1, j), F.lit(0), lambda n, x: n + count_words(x)).alias("at"),
            count_words(F.substring_index(F.element_at(pieces, j + 1), "\x02", 1)).alias("n"),
        ),
    )


def _found(words: Column, offset: Column, table: Column, known: Column) -> Column:
    """All detections of a tile."""
    tile = F.concat(F.lit(" "), F.array_join(words, "  "), F.lit(" "))
    rules = F.flatten(F.transform(F.array_intersect(words, known), lambda k: F.element_at(table, k)))
    hits = F.filter(rules, lambda r: F.regexp_like(tile, r["pattern"]))
    return F.flatten(
        F.transform(
            hits,
            lambda r: F.transform(
                _matches(tile, r),
                lambda m: F.struct(
                    (offset + m["at"]).alias("first"), (offset + m["at"] + m["n"] - 1).alias("last"),
                    r["rule"].alias("rule"), r["label"].alias("label"), r["strength"].alias("strength"), r["base"].alias("base"),
                ),
            ),
        )
    )


def _covered(d: Column, found: Column) -> Column:
    """Whether a stronger, or a longer or earlier rule's equally strong detection contains this one."""
    def covers(o: Column) -> Column:
        holds = (o["first"] <= d["first"]) & (o["last"] >= d["last"])
        longer = (o["last"] - o["first"]) > (d["last"] - d["first"])
        return holds & ((o["strength"] < d["strength"]) | (o["strength"] == d["strength"]) & (longer | (o["rule"] < d["rule"])))

    return F.exists(found, covers)


def scan(docs: DataFrame, text_col: str = "text", rules: list[Rule] | None = None) -> DataFrame:
    """Each row as `row`, with what was found in its whole text.

    n_words; n_base, first_word, last_word: places of base phrases, and the least and
    the largest word where one begins (null if none); base_labels and labels: distinct,
    sorted, comma-joined; score: the most that a detection which stands is worth, 0 if
    none does; detections: (first, last, label, strength, base, stands) in order of
    place and rule, `stands` false for those that another one covers.

    Null and empty texts have no words and no labels. Rows are judged one by one: an
    empty table gives an empty one, repeated rows and null or tied ids each get their
    own result, and columns of any names stay in `row`. Texts of any length are tiled.
    """
    rules = standard_rules() if rules is None else rules
    reach = max(longest(r.signature) for r in rules)
    table, keys = _table(rules)
    text = F.coalesce(quoted(text_col), F.lit(""))
    rows = docs.select(packed(docs).alias("row"), text.alias("_t"), F.split(F.lower(text), SEPARATORS).alias("_p"))
    ends = (F.element_at("_p", 1) == "").cast("int") + (F.element_at("_p", -1) == "").cast("int")  # none of the pieces between is empty
    # lower() may make more matches than the contract's lower case, never fewer: it only says which texts are looked at
    rows = rows.select("row", F.greatest(F.size("_p") - ends, F.lit(0)).alias("n_words"), F.when(F.arrays_overlap("_p", keys), spaced(F.col("_t"))).alias("_s"))
    rows = rows.select("row", "n_words", F.when(F.length("_s") > 0, F.split(F.substring(F.col("_s"), F.lit(2), F.length("_s") - 2), "  ")).alias("_w"))

    def of_tile(start: Column) -> Column:
        begin = F.greatest(start - reach, F.lit(0))
        return F.struct(start.alias("start"), begin.alias("begin"), F.slice("_w", begin + 1, start + TILE + reach - begin).alias("words"))

    tiles = F.transform(F.sequence(F.lit(0), F.size("_w") - 1, F.lit(TILE)), of_tile)
    live = F.filter(tiles, lambda t: F.arrays_overlap(t["words"], keys))
    found = F.transform(live, lambda t: F.struct(t["start"].alias("start"), _found(t["words"], t["begin"], table, keys).alias("found")))

    def judged(t: Column) -> Column:
        own = F.filter(t["found"], lambda d: (d["first"] >= t["start"]) & (d["first"] < t["start"] + TILE))
        return F.transform(
            own,
            lambda d: F.struct(
                d["first"].alias("first"), d["last"].alias("last"), d["rule"].alias("rule"), d["label"].alias("label"), d["strength"].alias("strength"),
                d["base"].alias("base"), (~_covered(d, t["found"])).alias("stands"),
            ),
        )

    # each step is evaluated once: a column of its own, not part of every expression that uses it
    rows = rows.select("row", "n_words", found.alias("_t"))
    rows = rows.select("row", "n_words", F.array_sort(F.flatten(F.transform("_t", judged))).alias("_d"))
    rows = rows.withColumn("_d", F.coalesce("_d", F.array().cast(_FOUND.replace("boolean>>", "boolean,stands:boolean>>"))))
    base = F.filter("_d", lambda d: d["base"])
    labels = lambda which: F.array_join(F.array_sort(F.array_distinct(F.transform(F.filter("_d", which), lambda d: d["label"]))), ",")
    worth = F.create_map(*[F.lit(x) for pair in WEIGHTS.items() for x in pair])
    return rows.select(
        "row", F.col("n_words").cast("long").alias("n_words"), F.size(base).cast("long").alias("n_base"),
        F.array_min(F.transform(base, lambda d: d["first"])).cast("long").alias("first_word"),
        F.array_max(F.transform(base, lambda d: d["first"])).cast("long").alias("last_word"),
        labels(lambda d: d["base"]).alias("base_labels"), labels(lambda d: d["stands"] | d["base"]).alias("labels"),
        F.aggregate("_d", F.lit(0.0), lambda s, d: F.greatest(s, F.when(d["stands"], F.element_at(worth, d["strength"])).otherwise(0.0))).alias("score"),
        F.transform("_d", lambda d: d.dropFields("rule")).alias("detections"),
    )
