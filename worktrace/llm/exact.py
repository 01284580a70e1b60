"""Exact deduplication by skew-safe combining, in DataFrame functions only.

1. Each task combines its own rows of a (digest, salt, text) group: Spark's
   map-side aggregation, so a group of copies leaves a task as one row.
2. The salted groups merge: a digest with a third of all rows meets in as many
   tasks as there are salts.
3. The salt winners, at most one per salt, combine globally by (digest, text).

The whole text is a grouping key in each step, so texts are compared in full;
the digest only deals rows out. Null text counts as empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from worktrace.llm.common import materialise, packed, quoted, salt_count


def _keyed(docs: DataFrame, id_col: str, text_col: str, digest: Column | None) -> list[Column]:
    text = F.coalesce(quoted(text_col), F.lit(""))
    sha = F.sha2(text, 256)
    return [
        quoted(id_col).alias("_id"),
        text.alias("_text"),
        (sha if digest is None else digest).alias("_digest"),
        F.pmod(F.xxhash64(quoted(id_col)), F.lit(salt_count(docs.sparkSession))).cast("int").alias("_salt"),
    ]


def assign(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Column | None = None) -> DataFrame:
    """One row per row of `docs`: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the largest id stays (keep_id). Null text is the
    empty text. Rows that repeat an id with the same text are one document and
    share the answer; group_size counts rows. A null id loses against any other;
    where all ids of a text are null, keep_id is null and all its rows are kept.
    An empty table gives no rows. Other columns are ignored, whatever their names.

    `digest`: another expression that deals texts out (tests use a colliding
    one). Where two texts share a digest, their rows are told apart by text.
    """
    out = _assigned(docs, id_col, text_col, digest, F.sha2("_text", 256).alias("text_sha256"))
    return out.select(
        F.col("_id").alias("doc_id"), "keep_id", "group_size", F.col("_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )


def _assigned(docs: DataFrame, id_col: str, text_col: str, digest: Column | None, carried: Column) -> DataFrame:
    """_id, _digest, keep_id, group_size and a carried column of each row of `docs`."""
    rows = docs.select(*_keyed(docs, id_col, text_col, digest))
    salted = rows.groupBy("_digest", "_salt", "_text").agg(F.max("_id").alias("_keep"), F.count(F.lit(1)).alias("_n"))
    same = Window.partitionBy("_digest")
    classes = (
        salted.repartition("_digest")
        .groupBy("_digest", "_text")
        .agg(F.max("_keep").alias("keep_id"), F.sum("_n").alias("group_size"), F.collect_set("_salt").alias("_salts"))
        .withColumn("_texts", F.count(F.lit(1)).over(same))
        .select("_digest", "keep_id", "group_size", "_salts", "_texts", F.when(F.col("_texts") > 1, F.col("_text")).alias("_text"))
    )
    classes = materialise(classes, "exact-classes")
    clear = classes.filter("_texts = 1").select("_digest", F.explode("_salts").alias("_salt"), "keep_id", "group_size")
    keyed = docs.select(*_keyed(docs, id_col, text_col, digest), packed(docs).alias("_row"))
    names = ["_id", "_digest", "keep_id", "group_size"]
    out = keyed.select("_id", "_digest", "_salt", carried).join(clear, ["_digest", "_salt"])
    out = out.select(*names, *[c for c in out.columns if c not in [*names, "_salt"]])
    shared = classes.filter("_texts > 1")
    if not shared.isEmpty():  # never with SHA-256 as it stands
        shared = shared.select("_digest", "_text", F.explode("_salts").alias("_salt"), "keep_id", "group_size")
        more = keyed.select("_id", "_digest", "_salt", "_text", carried).join(shared, ["_digest", "_salt", "_text"])
        out = out.unionByName(more.select(*out.columns))
    return out


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` that stay, one per text, with all their columns.

    The row with the largest id stays; ties go to the largest values of the
    other columns in their order (those of a type without an order don't
    count), so rows that are equal in all columns leave one. A null text that
    stays is returned as null. An empty table stays empty.
    """
    kept = _assigned(docs, id_col, text_col, None, F.col("_row")).filter(F.col("_id").eqNullSafe(F.col("keep_id")))
    ids = docs.select(*_keyed(docs, id_col, text_col, None)).groupBy("_id", "_digest").agg(F.count(F.lit(1)).alias("_n"))
    tied = materialise(ids.filter("_n > 1").select(F.col("_id").alias("_tied"), F.col("_digest").alias("_of")), "exact-ties")
    if not tied.isEmpty():  # rows that repeat an id with the same text
        same = F.col("_id").eqNullSafe(F.col("_tied")) & (F.col("_digest") == F.col("_of"))
        ordered = [f.name for f in docs.schema.fields if f.name not in (id_col, text_col) and _orderable(f.dataType)]
        row = F.col("_row")
        key = F.struct(row.getField(text_col).isNotNull().alias("has_text"), *[row.getField(c).alias(f"o{i}") for i, c in enumerate(ordered)])
        best = kept.join(tied, same, "left_semi").groupBy("_id", "_digest").agg(F.max_by("_row", key).alias("_row"))
        kept = kept.join(tied, same, "left_anti").select("_row").unionByName(best.select("_row"))
    return kept.select(*[F.col("_row").getField(c).alias(c) for c in docs.columns])


def _orderable(kind: T.DataType) -> bool:
    if isinstance(kind, T.ArrayType):
        return _orderable(kind.elementType)
    if isinstance(kind, T.StructType):
        return all(_orderable(f.dataType) for f in kind.fields)
    return not isinstance(
        kind, (T.MapType, T.VariantType, T.CalendarIntervalType),
    ) if hasattr(T, "CalendarIntervalType") else not isinstance(kind, (T.MapType, T.VariantType))
